"""Text functions as column expressions: folding, name normalisation, numbers, sizes."""

from __future__ import annotations

import re
import sys
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Legal forms that end firm names, the longer ones first where one ends another.
LEGAL_FORMS = (
    "societe en nom collectif a responsabilite limitee", "societe en nom collectif", "senc rl", "sencrl", "senc", "srl", "incorporee", "incorporated", "inc", "limitee", "ltee",
    "limited", "ltd", "lte", "corporation", "corporate", "corp", "compagnie", "company", "cie", "co", "enregistree", "enr", "sa", "sas", "sec", "spa", "llc", "lp", "plc",
)
#: Names of contract sizes and their upper bounds, exclusive.
BANDS = (("<$100K", 1e5), ("$100–500K", 5e5), ("$500K–2M", 2e6), ("$2–10M", 1e7), (">$10M", None))
UNKNOWN_BAND = "unknown"
MARKS = re.compile("[" + "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.combining(c)) + "]+")
PLAIN = str.maketrans("’‘`", "'''")


def plain_fold(text: str) -> str:
    """Compatibility decomposition, case folded, without marks; typographic apostrophes and backticks made plain, white space collapsed."""
    return " ".join(MARKS.sub("", unicodedata.normalize("NFKD", text).casefold()).translate(PLAIN).split())


def fold(c: Column) -> Column:
    """plain_fold() of a column; null stays null. Texts of ASCII stay in the JVM, others go to Python a batch at a time: Spark has no decomposition."""

    @arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None else plain_fold(t) for t in texts.to_pylist()], pa.string())

    wide = c.rlike(r"[^\x00-\x7f]")
    return F.when(wide, of(F.when(wide, c))).otherwise(F.trim(F.regexp_replace(F.translate(F.lower(c), "`", "'"), r"[\s\x1c-\x1f]+", " ")))


def blank(c: Column) -> Column:
    """Null for null or nothing but white space."""
    return F.nullif(F.trim(c), F.lit(""))


def firm_name(c: Column) -> Column:
    """Folded, other signs as blanks, legal forms at the end taken off while a name is left."""
    plain = F.trim(F.regexp_replace(fold(c), r"[^a-z0-9]+", " "))
    return F.regexp_replace(plain, rf"(?: (?:{'|'.join(LEGAL_FORMS)}))+$", "")


def marked(folded: Column) -> Column:
    """Each run of letters and digits between bars, so that whole words are found by substring search: "|gas|-|pipe|"."""
    return F.regexp_replace(folded, "[a-z0-9]+", "|$0|")


def amount(c: Column) -> Column:
    """The first number of a text, times a thousand if k or thousand follows, a million if a word with m does; null for shares.

    The number is eaten from the left: a sign and digits, groups of three after commas, decimals; then what follows is looked at.
    """
    t = F.lower(F.trim(c.cast("string")))
    head = F.regexp_extract(t, "-?[0-9]+", 0)
    rest = F.substring(t, F.position(head, t) + F.length(head), F.length(t))
    groups = F.regexp_extract(rest, "^(?:,[0-9]{3})*", 0)
    rest = F.substring(rest, F.length(groups) + 1, F.length(rest))
    decimals = F.regexp_extract(rest, "^[.][0-9]+", 0)
    after = F.ltrim(F.substring(rest, F.length(decimals) + 1, F.length(rest)))
    number = F.concat(head, F.replace(groups, F.lit(","), F.lit("")), decimals).try_cast("double")
    scale = F.when(after.startswith("m"), 1e6).when(after.startswith("k") | after.startswith("thousand"), 1e3).otherwise(1.0)
    return F.when((head != "") & ~t.contains("%") & ~t.contains("percent"), number * scale)


#: How sums are written in descriptions, in the order in which they are tried, and what one of them is times.
SUMS = ((r"(\d[\d\s.,]*)\s*(?:m\$|\$m|million|millions|m\b)", 1e6), (r"(\d[\d\s.,]*)\s*(?:k\$|\$k|thousand|k\b)", 1e3), (r"\$\s*(\d[\d\s.,]*)", 1.0), (r"(\d[\d\s.,]*)\s*\$", 1.0))


def stated_value(folded: Column) -> Column:
    """The sum that a folded description states, above 0, else null. One comma before one or two digits is a decimal comma, others group digits."""

    def number(pattern: str) -> Column:
        plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract(folded, pattern, 1), r"\s", ""), r"\.$", ""), ",$", "")
        plain = F.when(plain.rlike(r"^\d+,\d{1,2}$"), F.replace(plain, F.lit(","), F.lit("."))).otherwise(F.replace(plain, F.lit(","), F.lit("")))
        value = F.regexp_extract(plain, r"^\d+(?:\.\d+)?", 0).try_cast("double")
        return F.when(value > 0, value)

    return F.coalesce(*(number(pattern) * times for pattern, times in SUMS))


def band(c: Column) -> Column:
    """The name of the size that an amount falls in; unknown for null and for no more than 0."""
    out = F.when(c.isNull() | (c <= 0), UNKNOWN_BAND)
    for name, upper in BANDS:
        out = out.when(c < upper, name) if upper else out.otherwise(name)
    return out


def band_distance(a: Column, b: Column) -> Column:
    """How many sizes apart two names are; null if either is unknown."""
    place = F.create_map(*(x for k, (name, _) in enumerate(BANDS) for x in (F.lit(name), F.lit(k))))
    return F.abs(F.try_element_at(place, a) - F.try_element_at(place, b))


#: Typographic signs that quotes and pages may write either way.
SAME_SIGNS = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-"})


def quote_form(text: str | None) -> str:
    """Compatibility composition, plain quotes and dashes, one blank for white space, case folded."""
    return " ".join(unicodedata.normalize("NFKC", text or "").translate(SAME_SIGNS).split()).casefold()


def normal_quote(c: Column) -> Column:
    """quote_form() of a column, a batch at a time: Spark has no composition of its own."""

    @arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([quote_form(t) for t in texts.to_pylist()], pa.string())

    return of(c)


def register(spark: SparkSession) -> None:
    """fold, normalize_name, band_of and amount_of for SQL statements of this session; cosine of two arrays as well."""
    spark.udf.register("fold", arrow_udf(lambda texts: pa.array([t if t is None else plain_fold(t) for t in texts.to_pylist()], pa.string()), "string"))
    suffix = re.compile(rf"(?: (?:{'|'.join(LEGAL_FORMS)}))+$")
    name = lambda t: suffix.sub("", re.sub("[^a-z0-9]+", " ", plain_fold(t)).strip())
    spark.udf.register("normalize_name", arrow_udf(lambda texts: pa.array([t if t is None else name(t) for t in texts.to_pylist()], pa.string()), "string"))
    steps = " ".join(f"WHEN value < {upper} THEN '{label}'" for label, upper in BANDS if upper)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION band_of(value DOUBLE) RETURNS STRING RETURN CASE WHEN value IS NULL OR value <= 0 THEN '{UNKNOWN_BAND}' {steps} ELSE '{BANDS[-1][0]}' END")
    dot = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)"
    size = lambda c: f"sqrt(aggregate({c}, 0D, (s, v) -> s + v * v))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN CASE WHEN {size('a')} * {size('b')} > 0 THEN {dot} / ({size('a')} * {size('b')}) ELSE 0D END")
