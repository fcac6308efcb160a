"""The federal notices CSV: every column a string, headers found by what they say, one notice a row with a reference number.

Cells are trimmed; empty ones count as missing. Rows without a reference number are left out. A header that is needed and not there is an
error. The file is read by Spark's CSV reader, with quoted cells of several lines, as UTF-8 with or without a byte order mark or else as Latin-1.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as n
from ..functions.text import blank

#: Words that a header of each concept holds, in the order in which they are tried, and words that it must not hold.
CONCEPTS = {
    "reference_number": (("referencenumber",), ("reference",)),
    "title": (("title", "eng"), ("title",)),
    "description": (("tenderdescription", "eng"), ("description", "eng")),
    "publication_date": (("publicationdate",), ("publication",)),
    "closing_date": (("closingdate",), ("cloture",)),
    "status": (("tenderstatus", "eng"), ("status", "eng")),
    "category": (("procurementcategory",),),
    "unspsc": (("unspsc",),),
    "gsin": (("gsin",),),
    "regions_delivery": (("regionsofdelivery", "eng"), ("regionslivraison", "eng")),
    "regions_opportunity": (("regionsofopportunity", "eng"), ("regionappeloffres", "eng")),
    "buyer_name": (("contractingentityname", "eng"), ("contractingentityname",)),
    "buyer_province": (("contractingentityaddressprovince", "eng"),),
    "notice_url": (("noticeurl",), ("url", "eng")),
    "attachments": (("attachment", "eng"),),
}
WITHOUT = {"description": ("gsin", "unspsc"), "unspsc": ("description",), "gsin": ("description",)}
NEEDED = ("reference_number", "title", "closing_date")


def headers(columns: list[str]) -> dict[str, str | None]:
    """The header of each concept: of those that hold all words of its first pattern with a hit the English ones, and of them the shortest."""
    plain = {c: re.sub("[^a-z0-9]", "", c.casefold()) for c in columns}
    found: dict[str, str | None] = {}
    for concept, patterns in CONCEPTS.items():
        allowed = [c for c in columns if not any(w in plain[c] for w in WITHOUT.get(concept, ()))]
        hits = next((h for p in patterns if (h := [c for c in allowed if all(w in plain[c] for w in p)])), [])
        english = [c for c in hits if "eng" in plain[c]]
        found[concept] = min(english or hits, key=lambda c: len(plain[c]), default=None)
    lost = [c for c in NEEDED if not found[c]]
    if lost:
        raise ValueError(f"no header for {', '.join(lost)}")
    return found


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-8 unless a line of the file is none, which ends the search; then Latin-1, in which every byte is a sign."""
    return "ISO-8859-1" if spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count() else "UTF-8"


def read(spark: SparkSession, path: str, now: Column | None = None, encoding: str | None = None) -> DataFrame:
    encoding = encoding or encoding_of(spark, path)
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding=encoding, inferSchema=False)
    at = headers(rows.columns)

    def cell(concept: str) -> Column:
        return blank(F.col(f"`{at[concept]}`")) if at[concept] else F.lit(None).cast("string")

    def instant(c: Column) -> Column:
        return F.coalesce(c.try_cast("timestamp"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))

    now = F.current_timestamp() if now is None else now
    cells = rows.select(*(cell(c).alias(c) for c in CONCEPTS)).where("reference_number is not null")
    codes = F.filter(F.split(F.concat_ws(" ", "unspsc", "gsin"), "[^A-Za-z0-9]+"), lambda x: x != "")
    urls = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("attachments", F.lit("")), r"[|,\r\n]+"), lambda x: F.trim(x)), lambda u: F.lower(u).rlike("^https?://")))
    c = F.col
    return cells.select(
        F.lit("canadabuys").alias("source"), c("reference_number").alias("source_id"), F.coalesce("title", F.lit("")).alias("title"), "description", "buyer_name",
        n.buyer_type(c("buyer_name"), F.lit("federal")).alias("buyer_type"), c("category").alias("category_raw"),
        n.category(c("category"), F.lit(None).cast("string"), c("title"), c("description"), codes).alias("category_normalized"),
        F.coalesce(n.provinces(c("regions_delivery"), c("regions_opportunity")), n.provinces(c("buyer_province"))).alias("region"),
        F.lit(None).cast("double").alias("estimated_value"), F.lit(None).cast("string").alias("currency"), "closing_date", c("publication_date").alias("posted_date"), "notice_url",
        (F.size(urls) > 0).alias("documents_open"), n.status(c("status"), instant(c("closing_date")), now).alias("status"), urls.alias("attachments"),
    )


def in_region(regions: Column, wanted: str) -> Column:
    """Whether the regions' text names the wanted one; Ontario also by its code as a word. An empty wish is met by all."""
    text, wanted = F.lower(F.coalesce(regions, F.lit(""))), wanted.strip().casefold()
    if not wanted:
        return F.lit(True)
    if wanted in ("ontario", "on"):
        return text.contains("ontario") | text.rlike("(?:^|[^a-z])on(?:$|[^a-z])")
    return text.contains(wanted)


def funnel(rows: DataFrame, region: str, now: Column, words: tuple[str, ...] = n.CONSTRUCTION_WORDS) -> DataFrame:
    """One row: how many rows (regions, category, title, description, closing_date, attachments) are left after each step.

    total, in_region, in_category (coded and by_word), dated (naive and aware, by whether the text names a zone) and invalid, future and closed, and
    with_attachments among the future ones. Each step counts what the one before kept, in one pass. Dates without a zone are the session's.
    """
    where = in_region(F.col("regions"), region)
    coded = F.lower(F.coalesce("category", F.lit(""))).contains("cnst")
    word = F.lower(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))).rlike(f"(?<![a-z0-9_])(?:{'|'.join(words)})(?![a-z0-9_])")
    said = F.trim(F.coalesce("closing_date", F.lit("")))
    closing = F.when(said.rlike(r"^\d{4}-\d{2}-\d{2}"), said.try_cast("timestamp"))
    zoned = said.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$") & said.rlike("[T ]")
    files = F.exists(F.split(F.coalesce("attachments", F.lit("")), r"[|,\r\n]+"), lambda u: F.lower(F.trim(u)).rlike("^https?://"))
    kept = where & (coded | word)
    n_of = lambda c: F.count(F.when(c, 1))
    future = kept & F.coalesce(closing > now, F.lit(False))
    return rows.agg(
        F.count("*").alias("total"), n_of(where).alias("in_region"), n_of(kept).alias("in_category"), n_of(kept & coded).alias("coded"), n_of(kept & ~coded).alias("by_word"),
        n_of(kept & closing.isNotNull() & ~zoned).alias("naive"), n_of(kept & closing.isNotNull() & zoned).alias("aware"), n_of(kept & closing.isNull()).alias("invalid"),
        n_of(future).alias("future"), n_of(kept & F.coalesce(closing <= now, F.lit(False))).alias("closed"), n_of(future & files).alias("with_attachments"),
    )
