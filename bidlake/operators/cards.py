"""What a site shows: the pool of open notices, a register of places, counts, and the lines of a card. Column functions and small joins.

Null and blank texts count as missing; a missing date, verdict, method or title has a wording of its own. Repeated rows stay; tables without rows
give none, counts give zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import UNKNOWN_BAND, blank

#: What classes of places are called, verdicts that are shown as they are, and the flag of notices without a trade.
CLASS_LABELS = {
    "bids_and_tenders": "On bids&tenders", "biddingo": "On Biddingo", "bidnet_or_other_platform": "On another platform", "own_site_open": "Open documents on their own site",
    "own_site_notices": "Notices visible, documents gated or absent", "no_procurement_page_found": "No procurement page found", "fetch_failed": "Could not be read",
    "no_website_listed": "No website in the register", "robots_disallowed": "Crawling disallowed",
}
VERDICTS = ("bid", "review", "no_bid")
UNMAPPED_FLAG = "trade_unmapped"
SOON_DAYS = 14


def open_pool(notices: DataFrame, trades: DataFrame) -> DataFrame:
    """Open notices with a closing time, with their trades (notice_id, trade_slugs, mapping_status), and what stands for what is missing.

    The caller orders by closing_utc, and limits, as the pool itself is all of them. A size without a source is not known.
    """
    rows = notices.where((F.col("status") == "open") & F.col("closing_utc").isNotNull()).join(trades.select("notice_id", "trade_slugs", "mapping_status"), "notice_id", "left")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select(
        "notice_id", "source", text("title"), text("buyer_name"), "buyer_type", "region", F.col("estimated_value").alias("value"), F.date_format("closing_utc", "yyyy-MM-dd").alias("closing_date"), "closing_utc", "notice_url",
        F.coalesce("trade_slugs", F.array().cast("array<string>")).alias("trade_slugs"), F.coalesce(blank(F.col("mapping_status")), F.lit("unmapped")).alias("mapping_status"),
        F.coalesce(blank(F.col("scale_band")), F.lit(UNKNOWN_BAND)).alias("scale_band"), F.coalesce(blank(F.col("scale_source")), F.lit("unknown")).alias("scale_source"), F.coalesce("scale_confidence", F.lit(0.0)).alias("scale_confidence"),
    )


def register(places: DataFrame) -> DataFrame:
    """slug, name, tier, area, population, class, label, confidence, platform and url of every place, by name."""
    labels = F.create_map(*(F.lit(x) for kv in CLASS_LABELS.items() for x in kv))
    return places.select(
        "slug", "name", "tier", F.coalesce("area", F.lit("")).alias("area"), F.col("population").cast("long").alias("population"), "class", F.coalesce(F.try_element_at(labels, F.col("class")), F.col("class")).alias("label"),
        "confidence", "platform", F.col("procurement_url").alias("url"),
    ).orderBy("name", "slug")


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: how many rows each table has, under its name."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.join(F.broadcast(one), how="cross")  # a row each
    return out


def tally(runs: DataFrame, by: str) -> DataFrame:
    """How many runs ended each way; unknown ends are counted as `unknown`."""
    return runs.groupBy(F.coalesce(blank(F.col(by)), F.lit("unknown")).alias(by)).agg(F.count("*").alias("n"))


def closing_text(closing: Column, today: Column) -> Column:
    """The closing time in words: closed if its day is past, and in how many days if they are few."""
    days = F.datediff(closing.cast("date"), today)
    said = F.date_format(closing, "MMM d, yyyy 'at' h:mm a")
    soon = F.concat(said, F.lit(" · closes in "), days.cast("string"), F.when(days == 1, " day").otherwise(" days"))
    return F.when(closing.isNull(), "Closing date unavailable").when(days < 0, F.concat(F.lit("Closed "), said)).when(days < SOON_DAYS, soon).otherwise(said)


def shown_verdict(verdict: Column) -> Column:
    return F.when(verdict.isin(*VERDICTS), verdict).otherwise("not_analyzed")


def display_title(tender_id: Column, *candidates: Column) -> Column:
    """The first candidate that says more than the id; else the id in words, short ones of letters alone in capitals."""
    good = lambda c: F.when(F.lower(F.trim(c)) != F.lower(tender_id), blank(c))
    word = lambda w: F.when(w.rlike(r"^\p{L}{1,3}$"), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000))))
    words = F.filter(F.split(tender_id, "[-_]+"), lambda w: w != "")
    return F.coalesce(*(good(c) for c in candidates), F.array_join(F.transform(words, word), " "))


def cut(c: Column, most: int) -> Column:
    """A text of at most so many signs; a longer one ends in three dots."""
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 3)), F.lit("..."))).otherwise(c)


def submission_lines(requirements: DataFrame) -> DataFrame:
    """tender_id with submission and bid_security, two lines of a card, of every tender of requirements.

    requirements has tender_id, pos, phase, category, check_field, check_value and requirement_text; only what applies while bidding counts. Methods
    come in the order in which they are first named, else the first requirement's text; without a security there is no line.
    """
    bid = F.col("phase") == "bid_phase_mandatory"
    sub, named = bid & (F.col("category") == "submission"), blank(F.col("check_value"))
    ways = F.when(sub & (F.col("check_field") == "submission_method") & named.isNotNull(), F.struct("pos", named.alias("v")))
    first = lambda c: F.min(F.when(c, F.struct("pos", blank(F.col("requirement_text")).alias("t"))))
    rows = requirements.groupBy("tender_id").agg(F.array_sort(F.collect_set(ways)).alias("w"), first(sub).alias("s"), first(bid & (F.col("category") == "bid_security")).alias("b"))
    methods = F.array_distinct(F.transform("w", lambda x: x["v"]))
    line = F.when(F.size(methods) > 0, F.array_join(methods, " / ")).when(F.col("s").isNotNull(), cut(F.coalesce("s.t", F.lit("see tender documents")), 80)).otherwise("not identified")
    security = F.when(F.col("b").isNotNull(), F.concat(F.lit("Bid security: "), cut(F.coalesce("b.t", F.lit("requirement identified")), 85)))
    return rows.select("tender_id", F.concat(F.lit("Submission: "), line).alias("submission"), security.alias("bid_security"))


def cohort(flags: Column) -> Column:
    return F.when(F.coalesce(F.array_contains(flags, UNMAPPED_FLAG), F.lit(False)), "unmapped").otherwise("mapped")


def blocker_title(title: Column, files: Column, tender_id: Column) -> Column:
    """The tender's title; else the number in the name of its first file that has one; else its id in capitals."""
    number = r"(?i)^([a-z]{3,4})-([a-z0-9]+-\d+-\d+)"
    named = F.get(F.filter(F.array_sort(F.coalesce(files, F.array().cast("array<string>"))), lambda f: f.rlike(number)), F.lit(0))
    read = F.when(named.isNotNull(), F.upper(F.concat(F.regexp_extract(named, number, 1), F.lit(" "), F.regexp_extract(named, number, 2))))
    return F.coalesce(blank(title), read, F.upper(F.replace(tender_id, F.lit("-"), F.lit(" "))))
