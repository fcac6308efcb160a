"""Quotes found again in the pages they claim to come from.

Both sides are brought to one form (see text.quote_form). A quote is looked for whole, then by its first PREFIX characters if it is longer;
on single pages first, then across two pages that follow each other; in its own file first, then in the others by name. Numbered pages come
before others, in the order of numbers. Null or blank quotes are dropped as empty; repeated rows are each located; quotes meet only the pages
of their own tender, so the join is on the tender.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_quote

PREFIX = 120


def page_order(page) -> list:
    """Numbered pages first."""
    number = page.try_cast("long")
    return [number.isNull(), number, page]


def locate(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """quotes (tender_id, req_id, quote, source_file, page) with status (verified, page_repaired, quote_not_found, empty_quote), found_file
    and found_page."""
    q = quotes.withColumns({"_q": normal_quote(F.col("quote")), "_row": F.monotonically_increasing_id()})
    p = pages.select("tender_id", F.col("file").alias("_file"), F.col("page").cast("string").alias("_page"), "text")
    at = Window.partitionBy("tender_id", "_file").orderBy(*page_order(F.col("_page")))
    p = p.withColumns({"_place": F.row_number().over(at), "_next": F.lead("text").over(at)})
    p = p.withColumn("_both", F.when(F.col("_next").isNotNull(), F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.col("_next"))))
    p = p.select("tender_id", "_file", "_page", "_place", normal_quote(F.col("text")).alias("_one"), normal_quote(F.col("_both")).alias("_two"))
    asked = q.where("_q <> ''").select("tender_id", "_row", "source_file", "_q")
    head = F.substring("_q", 1, PREFIX)
    long = F.length("_q") > PREFIX
    tier = F.when(F.col("_one").contains(F.col("_q")), 0).when(long & F.col("_one").contains(head), 1).when(F.col("_two").contains(F.col("_q")), 2).when(long & F.col("_two").contains(head), 3)
    met = asked.join(p, "tender_id").withColumn("_tier", tier).where("_tier is not null")
    own = F.col("_file").eqNullSafe(F.col("source_file"))
    best = F.min(F.struct((~own).alias("other"), F.when(own, "").otherwise(F.col("_file")).alias("name"), "_tier", "_place", "_file", "_page"))
    found = met.groupBy("_row").agg(best.alias("b")).select("_row", F.col("b._file").alias("found_file"), F.col("b._page").alias("found_page"))
    rows = q.join(found, "_row", "left")
    same = F.col("found_file").eqNullSafe(F.col("source_file")) & F.col("found_page").eqNullSafe(F.col("page").cast("string"))
    status = F.when(F.col("_q") == "", "empty_quote").when(F.col("found_file").isNull(), "quote_not_found").when(same, "verified").otherwise("page_repaired")
    return rows.withColumn("status", status).drop("_q", "_row")
