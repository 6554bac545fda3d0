"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Targets. Each source has a weight and a capacity (``most`` times its size). The
total is shared by weight; what a source cannot take is shared again by weight
among the others until none is above its capacity. That fixed point is
``min(capacity, level * weight)`` for one level, found by running sums over the
sources in order of capacity / weight.

Documents. A document's inclusion is its source's target over the source's size
(times its own weight, if documents have weights, and cut at ``most``). The
whole part gives certain copies. The fraction p is sampled: with a random number
u from a hash of the id, documents are ranked by ``(u / (1 - u)) / (p / (1 - p))``,
and the lowest ranks are taken while they fit into what the certain copies have
left of the target. A long document at that cut can leave a gap, so the ``LOOK``
documents that follow are gone through again: ``FILLS`` times for those that fit
into the gap, and finally up to the one whose end is nearest to the target.

Scale. Only the word counts are read again, five times. The cut is found by
counting the words in ``BINS`` equal ranges of the rank for each source, then
again within the ranges about the cut; only the documents there (of one source,
one in BINS * BINS, and LOOK more) are ordered, as a table that is written and
small. So a source with a third of all rows is never in one task. The table of
sources, one row each, is what is ordered as a whole.

Edge cases. Null text and text without words have size 0: they take whole
copies as others do and their sample costs nothing; long texts are counted
whole. A null source is a source. A source whose documents are all empty has
target 0. A null id is ranked as one smallest id. Of rows that tie in rank, id
and size a hash of the text decides; rows equal in that too are counted, and of
them as many are taken as fit. An empty table gives no rows. No document gets more
than ``ceil(most)`` copies. Columns of docs may have any names but for mix_doc.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.llm import _spark

BINS = 4096
#: Rows up to which the tables of sources and of decisions are broadcast (about 150 bytes a row).
FEW = 100_000
#: Parts of a source where its rows meet a table of more sources than that.
SALTS = 32
#: Documents after the cut that may fill the gap, and how often those that fit are gone through.
LOOK, FILLS = 256, 2
#: Bits of the random number, few enough for exact doubles.
_BITS = 52
_PLACE = ["mix_rank", "mix_name", "mix_size", "mix_mark"]


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weight: Column, share: float, most: float) -> DataFrame:
    """Adds target to a table with source and source_size; weight: of each row, above 0."""
    cap = F.col("source_size") * F.lit(most)
    rows = sizes.withColumns({"w": weight.cast("double"), "cap": cap})
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    rows = rows.withColumns({
        "total": F.sum("source_size").over(every) * F.lit(share),
        "cap_before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "w_left": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    level = (F.col("total") - F.col("cap_before")) / F.col("w_left")
    rows = rows.withColumn("level", level)
    # the level is right for the first source that it does not fill, and for all after it
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("x"), "level"))).over(every)
    return rows.select("mix_key", "source", "source_size", "own_size", F.least(F.col("cap"), F.coalesce(first["level"] * F.col("w"), F.col("cap"))).alias("target"))


def weights_in_turn(sizes: DataFrame, weights: list[float]) -> DataFrame:
    """sizes with column w: the weights in turn for sources in the order of their code points, null last."""
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (at % len(weights) + 1).cast("int")))


def uniform(seed: int, *columns: Column) -> Column:
    """A random number in (0, 1) that depends on the columns alone, the same in any SQL engine with md5."""
    text = F.concat_ws(":", *[c.cast("string") for c in columns], F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("double") + 0.5) / F.lit(float(2**_BITS))


def _with_sources(rows: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """rows with the columns of their source: broadcast while there are few, else joined in SALTS parts of each source."""
    if n <= FEW:
        return rows.join(F.broadcast(sources), "mix_key")
    parts = sources.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("mix_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return salted.join(parts, ["mix_key", "mix_salt"]).drop("mix_salt")


def _ranked(rows: DataFrame, sources: DataFrame, n: int, most: float, seed: int) -> DataFrame:
    """Adds the source's columns, mix_whole, mix_rank (null where nothing is left to sample) and mix_fine."""
    rate = F.least(F.when(F.col("own_size") > 0, F.col("target") / F.col("own_size")).otherwise(0.0) * F.col("mix_own"), F.lit(float(most)))
    out = _with_sources(rows, sources, n).withColumn("mix_rate", rate)
    p = F.col("mix_rate") - F.floor("mix_rate")
    u = uniform(seed, F.coalesce(F.col("mix_name"), F.lit("null")))
    odds = (u / (1 - u)) / (p / (1 - p))
    out = out.withColumns({"mix_whole": F.floor("mix_rate"), "mix_rank": F.when(p > 0, odds / (1 + odds))}).drop("mix_rate")
    return out.withColumn("mix_fine", F.least((F.col("mix_rank") * (BINS * BINS)).cast("long"), F.lit(BINS * BINS - 1)))


def _cut(bins: DataFrame) -> DataFrame:
    """From (mix_key, bin, words, docs, left, start): the bin in which the words reach what is left, the words before it, and the bin up to which LOOK documents follow."""
    run = Window.partitionBy("mix_key").orderBy("bin")
    bins = bins.withColumns({
        "before": F.col("start") + F.sum("words").over(run) - F.col("words"),
        "to": F.sum("docs").over(run),
    })
    every = Window.partitionBy("mix_key")
    # the first bin that the words reach; a struct compares by its bin
    cut = F.min(F.when((F.col("before") <= F.col("left")) & (F.col("before") + F.col("words") > F.col("left")), F.struct("bin", "before", "to"))).over(every)
    bins = bins.withColumn("cut", cut).where("cut is not null")
    end = F.coalesce(F.min(F.when(F.col("to") >= F.col("cut.to") + LOOK, F.col("bin"))), F.max("bin"))
    return bins.groupBy("mix_key", F.col("cut.bin").alias("cut"), F.col("cut.before").alias("start")).agg(end.alias("end"))


@dataclass(frozen=True)
class Mix:
    """What decides on each document: rows for sources and for the documents about the cuts, and the parameters."""

    sources: DataFrame
    decided: DataFrame
    rows: DataFrame
    n_sources: int
    n_decided: int
    partial: bool
    most: float
    seed: int


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight_col: str | None) -> DataFrame:
    """docs as mix_doc, with what the mix needs of each row."""
    doc = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("mix_doc"))
    field = lambda c: F.col("mix_doc")[c]
    own = F.coalesce(field(weight_col).cast("double"), F.lit(1.0)) if weight_col else F.lit(1.0)
    source, text = field(source_col).cast("string"), field(text_col).cast("string")
    return doc.select(
        "mix_doc", field(id_col).alias("mix_id"), field(id_col).cast("string").alias("mix_name"), source.alias("mix_source"), word_count(text).alias("mix_size"), own.alias("mix_own"), F.xxhash64(text).alias("mix_mark"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("")).alias("mix_key"),  # tells null from the empty string
    )


def plan_mix(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None) -> Mix:
    """weights: by turns for the sources in the order of their code points. share: the mix's size over that of all
    documents. weight_col: optional numbers above 0 that make inclusions unequal within a source."""
    rows = _spark.written(_rows(docs, id_col, text_col, source_col, weight_col).drop("mix_doc"), "mix-rows")
    sums = rows.groupBy("mix_key", F.col("mix_source").alias("source")).agg(F.sum("mix_size").alias("source_size"), F.sum(F.col("mix_size") * F.col("mix_own")).alias("own_size"))
    sizes = _spark.written(sums, "mix-sources")
    n = sizes.count()
    targets = _spark.written(source_targets(weights_in_turn(sizes, weights), F.col("w"), share, most), "mix-targets")
    ranked = lambda sources: _ranked(rows, sources, n, most, seed)
    fine, sampled = F.col("mix_fine"), F.col("mix_rank").isNotNull()

    outer = ranked(targets).groupBy("mix_key", F.floor(fine / BINS).alias("bin")).agg(
        F.first("target").alias("target"), F.sum(F.col("mix_whole") * F.col("mix_size")).alias("certain"), F.sum("mix_size").alias("words"), F.count("*").alias("docs"),
    )
    left = F.col("target") - F.sum("certain").over(Window.partitionBy("mix_key"))
    outer = _spark.written(outer.withColumns({"left": left, "start": F.lit(0).cast("long")}), "mix-outer")
    coarse = _cut(outer.where("bin is not null")).withColumnsRenamed({"cut": "outer_cut", "end": "outer_end", "start": "outer_start"})
    of = outer.groupBy("mix_key").agg(F.first("left").alias("left")).join(coarse, "mix_key", "left")
    sources = _spark.written(targets.join(of, "mix_key"), "mix-coarse")

    about = ranked(sources).where(sampled & F.floor(fine / BINS).between(F.col("outer_cut"), F.col("outer_end")))
    inner = about.groupBy("mix_key", fine.alias("bin")).agg(F.sum("mix_size").alias("words"), F.count("*").alias("docs"), F.first("left").alias("left"), F.first("outer_start").alias("start"))
    sources = _spark.written(sources.drop("outer_cut", "outer_end", "outer_start").join(_cut(inner), "mix_key", "left"), "mix-plan")

    edge = ranked(sources).where(sampled & fine.between(F.col("cut"), F.col("end")))
    edge = edge.groupBy("mix_key", *_PLACE).agg(F.count("*").alias("m"), F.first("left").alias("left"), F.first("start").alias("start"))
    decided = _spark.written(_decide(_spark.written(edge, "mix-edge")), "mix-decided")
    counts = decided.agg(F.count("*").alias("n"), F.max(((F.col("c") > 0) & (F.col("c") < F.col("m"))).cast("int")).alias("partial")).first()
    return Mix(sources, decided, rows, n, counts.n, bool(counts.partial), most, seed)


def _decide(edge: DataFrame) -> DataFrame:
    """(mix_key, place, m, c): how many of the m equal rows of each place about the cut are taken."""
    prior = Window.partitionBy("mix_key").orderBy(*_PLACE).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("mix_key")
    size, zero = F.col("mix_size"), F.lit(0).cast("long")
    before = lambda x: F.coalesce(F.sum(x).over(prior), zero)

    def fitting(room: Column, most: Column) -> Column:
        """How many rows of this size fit into room, of most."""
        return F.when(size > 0, F.greatest(zero, F.least(most, F.floor(room / size)))).otherwise(F.when(room >= 0, most).otherwise(zero))

    out = edge.withColumn("c", fitting(F.col("left") - F.col("start") - before(F.col("m") * size), F.col("m")))
    out = out.withColumn("gap", F.col("left") - F.col("start") - F.sum(F.col("c") * size).over(every))
    out = out.withColumn("open", F.greatest(zero, F.least(F.col("m") - F.col("c"), F.lit(LOOK) - before(F.col("m") - F.col("c")))))
    for i in range(FILLS + 1):
        final = i == FILLS
        out = out.withColumn("able", F.col("open") if final else F.when(size <= F.col("gap"), F.col("open")).otherwise(zero))
        out = out.withColumn("room", F.col("gap") - before(F.col("able") * size))
        out = out.withColumn("more", F.when(F.col("gap") > 0, fitting(F.col("room"), F.col("able"))).otherwise(zero))
        if final:
            left = F.col("room") - F.col("more") * size  # the row at the cut is taken if its end is the nearer
            out = out.withColumn("more", F.col("more") + ((F.col("gap") > 0) & (F.col("more") < F.col("able")) & (left > 0) & (2 * (size - left) <= size)).cast("long"))
        out = out.withColumns({"c": F.col("c") + F.col("more"), "open": F.col("open") - F.col("more"), "gap": F.col("gap") - F.sum(F.col("more") * size).over(every)})
    return out.select("mix_key", *_PLACE, "m", "c")


def _copies(rows: DataFrame, plan: Mix) -> DataFrame:
    """Adds target and the like, and copies, to rows with the mix_ columns."""
    ranked = _ranked(rows, plan.sources, plan.n_sources, plan.most, plan.seed)
    about = F.coalesce(F.col("mix_fine").between(F.col("cut"), F.col("end")), F.lit(False))
    on = ["mix_key", *_PLACE]
    names = [F.col(f"d.{c}").alias(f"of_{c}") for c in on]
    decided = plan.decided.alias("d").select(*names, "m", "c")
    decided = F.broadcast(decided) if plan.n_decided <= FEW else decided
    same = about
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    out = ranked.join(decided, same, "left").drop(*[f"of_{c}" for c in on])
    taken = F.col("mix_rank").isNotNull() & (F.col("cut").isNull() | (F.col("mix_fine") < F.col("cut")) | F.coalesce(F.col("c") == F.col("m"), F.lit(False)))
    if plan.partial:
        some = F.coalesce((F.col("c") > 0) & (F.col("c") < F.col("m")), F.lit(False))
        rest = out.where(~some).withColumn("mix_taken", taken)
        out = rest.unionByName(_numbered(out.where(some)))
    else:
        out = out.withColumn("mix_taken", taken)
    return out.withColumn("copies", F.col("mix_whole") + F.col("mix_taken").cast("long"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds mix_taken: the first c rows of each place are taken. Equal rows are numbered part by part, as they lie."""
    rows = _spark.written(rows.withColumn("mix_part", F.spark_partition_id()), "mix-equal")
    on = ["mix_key", *_PLACE]
    parts = rows.groupBy(*on, "mix_part").agg(F.count("*").alias("mix_n"))
    run = Window.partitionBy(*on).orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("mix_before", F.coalesce(F.sum("mix_n").over(run), F.lit(0))).drop("mix_n")
    names = [F.col(c).alias(f"of_{c}") for c in (*on, "mix_part")]
    same = F.lit(True)
    for c in (*on, "mix_part"):
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    out = rows.join(parts.select(*names, "mix_before"), same).drop(*[f"of_{c}" for c in (*on, "mix_part")])
    at = F.row_number().over(Window.partitionBy(*on, "mix_part").orderBy("mix_part"))
    return out.withColumn("mix_taken", at + F.col("mix_before") <= F.col("c")).drop("mix_before", "mix_part")


def mix(docs: DataFrame, weights: list[float], **how: object) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken) of each row of docs; parameters as of plan_mix."""
    plan = plan_mix(docs, weights, **how)
    out = _copies(plan.rows, plan)
    return out.select(F.col("mix_id").alias("doc_id"), F.col("mix_size").alias("size"), "source", "source_size", "target", "copies", (F.col("copies") * F.col("mix_size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: list[float], **how: object) -> DataFrame:
    """docs with each row as often as the mix takes it. Rows stay where they lie, but for equal rows at a cut."""
    plan = plan_mix(docs, weights, **how)
    named = {k: how.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"), ("weight_col", None))}
    out = _copies(_rows(docs, **named), plan).where("copies > 0").select("mix_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("mix_doc.*")
