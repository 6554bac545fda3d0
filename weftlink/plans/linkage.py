"""Linking as one plan: block, compare, score, assign, evaluate, export.

Countries, segments and chunks are no loops: the country is part of every key,
and partitions do the rest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink import schema
from weftlink.llm._spark import drop, free_shuffles, written
from weftlink.operators import assign, blocking, export, metrics, models, pairs, scoring
from weftlink.sources import tables

#: Training entities: more than MOST, or None, become DEFAULT.
TRAIN_DEFAULT, TRAIN_MOST = 50_000, 60_000
VALIDATION_DEFAULT, VALIDATION_MOST = 10_000, 20_000


@dataclass
class Settings:
    """What differs between runs. countries: None for all."""

    cap: int = schema.MAX_BLOCK
    k: int = 20
    threshold: float = assign.THRESHOLD
    countries: tuple[str, ...] | None = None
    params: dict[str, dict] = field(default_factory=models.default_params)
    weights: dict[str, float] = field(default_factory=lambda: {"p_gbt": 0.4, "p_gbt_wide": 0.3, "p_forest": 0.3})


@dataclass
class Trained:
    models: dict[str, PipelineModel]
    weights: dict[str, float]
    threshold: float
    sweep: DataFrame | None = None
    #: (s1_id, target_id, p) of all candidates of the records that it was trained on.
    scored: DataFrame | None = None

    def save(self, folder: str) -> None:
        """Everything that link needs for new records; the sweep is a report and is not kept."""
        tables.save_bundle(self.models, {"weights": self.weights, "threshold": self.threshold}, folder)

    @classmethod
    def load(cls, folder: str) -> Trained | None:
        found = tables.load_bundle(folder)
        return found and cls(found[0], found[1]["weights"], found[1]["threshold"])


def train_or_load(folder: str, train: Callable[[], Trained]) -> Trained:
    """The bundle in folder; where there is none, the one that train gives, which is then kept there."""
    found = Trained.load(folder)
    if found is None:
        found = train()
        found.save(folder)
    return found


def guard(n: int | None, default: int, most: int) -> int:
    """A sample size: the default if none is given or it is above most."""
    return default if n is None or n > most else n


def only(records: DataFrame, countries: tuple[str, ...] | None) -> DataFrame:
    """Rows of some countries; an empty country stands for a missing one."""
    return records if countries is None else records.where(F.coalesce("country", F.lit("")).isin(*countries))


def find_pairs(s1: DataFrame, targets: DataFrame, settings: Settings) -> DataFrame:
    s1, targets = only(s1, settings.countries), only(targets, settings.countries)
    return blocking.candidates(blocking.block_index(targets, settings.cap), s1, settings.k)


def features(found: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    return pairs.fast_features(pairs.paired(found, pairs.profiles(s1), pairs.profiles(targets)))


def train_and_validate(s1: DataFrame, targets: DataFrame, truth: DataFrame, is_train: Column, settings: Settings | None = None) -> Trained:
    """Fits all models on the training entities' pairs (true pairs included) and picks the threshold on the others' (candidates only).

    The scores of all candidates stay in the shared folder, for link over the same records.
    """
    settings = settings or Settings()
    spark = s1.sparkSession
    part = s1.select(F.col("entity_id").alias("s1_id"), is_train.alias("is_train"))
    # tables between the steps are written: plans stay small on the driver, and nothing is worked out twice
    true = written(truth.select("s1_id", "target_id").join(part, "s1_id"), "true")
    found = written(find_pairs(s1, targets, settings).join(part, "s1_id"), "found")
    train = written(pairs.labelled_pairs(found.where("is_train"), true.where("is_train"), True), "train")
    every = found.select("s1_id", "target_id").union(train.select("s1_id", "target_id")).distinct()
    known = written(features(every, s1, targets), "features")
    rows = written(known.join(train, ["s1_id", "target_id"]).select("label", *pairs.FEATURES), "rows")
    free_shuffles(spark)
    fitted = models.train_all(rows, settings.params)
    asked = known.join(found.select("s1_id", "target_id"), ["s1_id", "target_id"], "left_semi")
    scored = written(models.predict(fitted, asked).withColumn("p", scoring.blend(settings.weights)).select("s1_id", "target_id", "p"), "scored")
    check = part.where("not is_train").select("s1_id")
    sweep = assign.threshold_sweep(scored.join(check, "s1_id"), true.where("not is_train"), check)
    sweep = spark.createDataFrame(sweep.collect(), sweep.schema)
    drop(true, found, train, known, rows)
    free_shuffles(spark)
    return Trained(fitted, settings.weights, assign.best_threshold(sweep), sweep, scored)


def link(s1: DataFrame, targets: DataFrame, trained: Trained, settings: Settings | None = None, same: bool = False) -> tuple[DataFrame, DataFrame]:
    """(matches, candidates) of new records; same: of those that it was trained on with these settings, whose scores are there."""
    settings = settings or Settings()
    if same and trained.scored is not None:
        return assign.injective(trained.scored, trained.threshold), trained.scored.select("s1_id", "target_id")
    found = find_pairs(s1, targets, settings)
    scored = models.predict(trained.models, features(found, s1, targets)).withColumn("p", scoring.blend(trained.weights))
    return assign.injective(scored, trained.threshold), found


def link_by(s1: DataFrame, targets: DataFrame, score: Callable[[DataFrame], DataFrame], settings: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """As link, by any function from pairs with p1 and p2 to (s1_id, target_id, p)."""
    settings = settings or Settings()
    found = find_pairs(s1, targets, settings)
    both = pairs.paired(found, pairs.profiles(s1), pairs.profiles(targets))
    return assign.injective(score(both), settings.threshold), found


def word_jaccard(both: DataFrame) -> DataFrame:
    """The smallest scorer: the Jaccard similarity of name words."""
    return both.select("s1_id", "target_id", pairs.set_features()["name_word_jaccard"].alias("p"))


def link_files(spark: SparkSession, s1: str, targets: list[str], out: str, score: Callable[[DataFrame], DataFrame], settings: Settings | None = None) -> None:
    """From tab-separated records to the two result files in the folder out."""
    read = lambda path: schema.normalise_sources(tables.read_tsv(spark, path))
    left, right = read(s1), read(targets[0])
    for path in targets[1:]:
        right = right.unionByName(read(path))
    left = only(left, (settings or Settings()).countries)
    matches, found = link_by(left, right, score, settings)
    rows = result(matches, found, left).persist()
    tables.write_results(rows, rows, out)
    rows.unpersist()


def result(matches: DataFrame, found: DataFrame, s1: DataFrame) -> DataFrame:
    return export.format_output(matches, found, s1.select(F.col("entity_id").alias("s1_id")))


def report(matches: DataFrame, truth: DataFrame, s1: DataFrame) -> DataFrame:
    return metrics.evaluate(matches, truth, s1.select(F.col("entity_id").alias("s1_id")))
