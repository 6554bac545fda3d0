"""Cleaning and tokenising of names and addresses as Column functions.

Only accent folding has no built-in form; it is one Arrow UDF. Everything else
is built in and stays in generated code.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that count as legal forms, not as part of a name.
LEGAL_FORMS = (
    "inc", "incorporated", "corp", "corporation", "llc", "llp", "lp", "ltd", "limited",
    "co", "company", "pllc", "holdings", "group", "services", "enterprises", "solutions",
    "industries", "associates", "partners", "ventures", "technologies", "international",
    "pvt", "private", "proprietorship", "traders", "trading", "sangh",
    "sarl", "sasu", "sas", "eurl", "sa", "sci", "snc", "gie", "fils", "et fils", "cie", "ste",
    "gmbh", "ag", "ug", "kg", "kgaa", "holding",
)

# Address words and what they are written out as.
ADDRESS_WORDS = {
    "rd": "road",
    "st": "street",
    "ave": "avenue",
    "blvd": "boulevard",
    "dr": "drive",
    "ln": "lane",
    "ct": "court",
    "pl": "place",
    "pkwy": "parkway",
    "apt": "apartment",
    "ste": "suite",
    "bldg": "building",
    "fl": "floor",
    "po box": "pobox",
    "p o box": "pobox",
    "post office box": "pobox",
    "hwy": "highway",
    "nr": "near",
    "opp": "opposite",
    "bd": "boulevard",
    "rte": "route",
    "av": "avenue",
}


def _fold(column: pa.Array, lower: bool) -> pa.Array:
    """Without combining marks after compatibility decomposition; ASCII values skip Python."""
    column = column.cast(pa.string()).fill_null("")
    plain = pc.string_is_ascii(column)
    if pc.all(plain).as_py() is not False:
        return pc.ascii_lower(column) if lower else column
    out = []
    for text, ascii_only in zip(column.to_pylist(), plain.to_pylist(), strict=True):
        text = text.lower() if lower else text
        out.append(text if ascii_only else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)))
    return pa.array(out, pa.string())


@F.arrow_udf(StringType())
def _strip_accents(column: pa.Array) -> pa.Array:
    return _fold(column, lower=False)


@F.arrow_udf(StringType())
def _lower_plain(column: pa.Array) -> pa.Array:
    return _fold(column, lower=True)


def strip_accents(text: Column) -> Column:
    """Compatibility-decomposed text without characters that combine; null gives an empty string."""
    return _strip_accents(text)


def tidy(folded: Column) -> Column:
    """What follows lower-casing and folding: & as the word and, other marks as blanks, single blanks."""
    return F.trim(F.regexp_replace(F.replace(folded, F.lit("&"), F.lit(" and ")), "[^\\p{L}\\p{N}_]+", " "))


def clean_text(text: Column) -> Column:
    """Lower case, without accents and marks. Null, empty and exactly nan give an empty string."""
    return F.when(F.coalesce(text, F.lit("")).isin("", "nan"), "").otherwise(tidy(_lower_plain(text)))


def words(clean: Column) -> Column:
    """Words of clean text; none for an empty one."""
    return F.filter(F.split(clean, " "), lambda w: w != "")


def drop_legal_forms(clean: Column) -> Column:
    kept = F.filter(words(clean), lambda w: ~w.isin(*LEGAL_FORMS))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(clean)


def clean_name(name: Column, strip_legal: bool = True) -> Column:
    """Clean text without legal forms, unless nothing else is there."""
    clean = clean_text(name)
    return drop_legal_forms(clean) if strip_legal else clean


def write_out_address(clean: Column) -> Column:
    """Single words are written out; entries of several words never match a single word."""
    table = F.create_map(*[F.lit(x) for pair in ADDRESS_WORDS.items() for x in pair])
    return F.array_join(F.transform(words(clean), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def clean_address(address: Column, expand: bool = True) -> Column:
    clean = clean_text(address)
    return write_out_address(clean) if expand else clean


def again(clean: Column) -> Column:
    """Clean text cleaned once more: capitals that decomposition brought in are lowered, and nan is nothing."""
    return F.when(clean == "nan", "").otherwise(F.lower(clean))


def postal_codes(text: Column) -> Column:
    """Runs of exactly six digits, then of five, in order, each once."""
    text = F.coalesce(text, F.lit(""))
    found = [F.regexp_extract_all(text, F.lit(f"(?<![\\p{{L}}\\p{{N}}_])(\\p{{Nd}}{{{n}}})(?![\\p{{L}}\\p{{N}}_])"), 1) for n in (6, 5)]
    return F.array_distinct(F.concat(*found))


def numbers(text: Column) -> Column:
    """Distinct runs of digits that stand alone as words."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?<![\\p{L}\\p{N}_])(\\p{Nd}+)(?![\\p{L}\\p{N}_])"), 1))


def char_ngrams(clean: Column, n: int = 3) -> Column:
    """Distinct character n-grams of clean text without blanks; the whole if it is shorter."""
    tight = F.replace(again(clean), F.lit(" "), F.lit(""))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(tight) - n + 1, F.lit(1))), lambda i: F.substring(tight, i, F.lit(n)))
    return F.when(tight == "", F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def word_tokens(clean: Column) -> Column:
    """Words of clean text, repeated ones too."""
    return words(again(clean))


# Fixed value: the prompt before a query.
QUERY_PROMPT = "Instruct: Retrieve matching business identity records across noisy sources\nQuery: "


def format_record(clean_name_: Column, clean_address_: Column, country: Column, is_query: bool = False) -> Column:
    text = F.concat(F.lit("Business: "), clean_name_, F.lit(" | Address: "), clean_address_, F.lit(" | Country: "), F.trim(F.coalesce(country, F.lit(""))))
    return F.concat(F.lit(QUERY_PROMPT), text) if is_query else text


def format_pair(name1: Column, address1: Column, name2: Column, address2: Column) -> Column:
    """Both sides of a pair for a scorer of text pairs, from clean values."""
    side = lambda n, a: F.concat(F.lit("Business: "), n, F.lit(" | Address: "), a)
    return F.struct(side(name1, address1).alias("text1"), side(name2, address2).alias("text2"))


def fold_ids(ids: Column) -> Column:
    """An aggregate: the distinct ids in order, joined by commas. For the edge of the system only."""
    return F.array_join(F.array_sort(F.collect_set(ids)), ",")


def split_ids(joined: Column) -> Column:
    """Distinct trimmed ids of a comma-joined text; none for a missing one."""
    parts = F.filter(F.transform(F.split(joined, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.coalesce(joined, F.lit("")).isin("", "nan", "<NA>", "None"), F.array().cast("array<string>")).otherwise(F.array_distinct(parts))
