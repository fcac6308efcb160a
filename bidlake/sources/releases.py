"""Weekly packages of contracting releases: notices, the newest state of each procurement, and who took part.

A package is read by Spark's JSON reader under one schema, so unknown fields are ignored and unreadable files give no release. Within a file
releases come by date and place, files by name. Releases without ocid or title give no notice; null lists are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as n
from ..functions.text import blank

PARTY = "struct<id:string,name:string,roles:array<string>,details:struct<municipal:string,neq:string>,address:struct<region:string>>"
TENDER = (
    "struct<id:string,title:string,status:string,description:string,mainProcurementCategory:string,additionalProcurementCategories:array<string>,procuringEntity:struct<name:string>,"
    "items:array<struct<classification:struct<id:string>>>,tenderPeriod:struct<startDate:string,endDate:string>,value:struct<amount:string,currency:string>,documents:array<struct<url:string>>,tenderers:array<struct<id:string,name:string>>>"
)
RELEASE = f"struct<ocid:string,id:string,date:string,tag:array<string>,buyer:struct<id:string,name:string>,parties:array<{PARTY}>,tender:{TENDER},bids:array<struct<id:string,value:string>>,awards:array<struct<suppliers:array<struct<id:string>>>>>"
#: Ids that stand for no firm.
NO_FIRM = ("", "0", "None", "null")
WEEKLY = r"hebdo_(\d{8})_(\d{8})\.json$"


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, place, r) of all releases."""
    rows = spark.read.schema(f"releases array<{RELEASE}>").json(paths, multiLine=True)
    return rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.posexplode("releases").alias("place", "r")).where("r is not null")


def weekly(resources: DataFrame) -> DataFrame:
    """(name, url, start_date) of weekly files among resources (name, url, pos), each once (the first), the newest first."""
    start = lambda c: F.regexp_extract(F.lower(F.coalesce(c, F.lit(""))), WEEKLY, 1)
    end = lambda c: F.regexp_extract(F.lower(F.coalesce(c, F.lit(""))), WEEKLY, 2)
    named = start(F.col("name")) != ""
    a, b = (F.when(named, f(F.col("name"))).otherwise(f(F.col("url"))) for f in (start, end))
    rows = resources.where("url is not null and url <> ''").select("url", "pos", a.alias("a"), b.alias("b")).where("a <> ''")
    rows = rows.withColumn("start_date", F.to_date(F.try_to_timestamp("a", F.lit("yyyyMMdd")))).where("start_date is not null")
    rows = rows.groupBy(F.concat(F.lit("hebdo_"), "a", F.lit("_"), "b", F.lit(".json")).alias("name")).agg(F.min_by("url", "pos").alias("url"), F.min("start_date").alias("start_date"))
    return rows.orderBy(F.desc("start_date"), "name")


def buyer_party(r: Column) -> Column:
    """The party with the buyer's id, else the first with the role of a buyer."""
    by_id = F.filter(r["parties"], lambda p: (p["id"] == r["buyer"]["id"]) & (p["id"] != ""))
    by_role = F.filter(r["parties"], lambda p: F.coalesce(F.exists(p["roles"], lambda x: F.lower(x) == "buyer"), F.lit(False)))
    return F.coalesce(F.get(by_id, F.lit(0)), F.get(by_role, F.lit(0)))


def category_raw(t: Column) -> Column:
    listed = F.array_join(F.filter(t["additionalProcurementCategories"], lambda c: c.isNotNull() & (c != "")), " | ")
    return F.coalesce(F.nullif(listed, F.lit("")), blank(t["mainProcurementCategory"]))


def notices(releases: DataFrame, now: Column | None = None) -> DataFrame:
    """A notice for each release, with file, place and date of the release."""
    now = F.current_timestamp() if now is None else now
    rows = releases.select("file", "place", "r", buyer_party(F.col("r")).alias("p")).where(F.col("r.tender").isNotNull())
    r, t, p = F.col("r"), F.col("r.tender"), F.col("p")
    buyer = F.coalesce(blank(r["buyer"]["name"]), blank(t["procuringEntity"]["name"]))
    municipal = F.trim(p["details"]["municipal"])
    default = F.when(municipal == "1", "municipal").when(municipal == "0", "provincial").otherwise("unknown")
    raw, closing = category_raw(t), blank(t["tenderPeriod"]["endDate"])
    rows = rows.withColumn("state", n.status(t["status"], closing.try_cast("timestamp"), now))
    state = F.col("state")
    given = F.coalesce(F.exists(r["tag"], lambda x: F.lower(x).contains("award") | F.lower(x).contains("contract")), F.lit(False))
    amount = t["value"]["amount"].try_cast("double")
    urls = F.filter(F.transform(t["documents"], lambda d: F.trim(d["url"])), lambda u: F.lower(u).rlike("^https?://"))
    return rows.select(
        "file", "place", r["date"].alias("release_date"), F.lit("seao").alias("source"), blank(r["ocid"]).alias("source_id"), blank(t["title"]).alias("title"), blank(t["description"]).alias("description"),
        buyer.alias("buyer_name"), n.buyer_type(buyer, default).alias("buyer_type"), raw.alias("category_raw"),
        n.category(raw, t["mainProcurementCategory"], t["title"], t["description"], F.transform(t["items"], lambda i: i["classification"]["id"])).alias("category_normalized"),
        F.coalesce(n.provinces(p["address"]["region"]), F.lit("QC")).alias("region"), amount.alias("estimated_value"), F.when(amount.isNotNull(), F.coalesce(t["value"]["currency"], F.lit("CAD"))).alias("currency"),
        closing.alias("closing_date"), F.coalesce(blank(t["tenderPeriod"]["startDate"]), r["date"]).alias("posted_date"), F.get(urls, F.lit(0)).alias("notice_url"), F.lit(False).alias("documents_open"),
        F.when((state != "cancelled") & given, "awarded").otherwise(state).alias("status"),
    ).where("source_id is not null and title is not null")


def newest(rows: DataFrame) -> DataFrame:
    """Of each source_id the last release, by file, date and place."""
    content = [c for c in rows.columns if c != "source_id"]
    last = F.max_by(F.struct(*content), F.struct("file", F.coalesce("release_date", F.lit("")), "place"))
    return rows.groupBy("source_id").agg(last.alias("_n")).select("source_id", *(F.col(f"_n.{c}").alias(c) for c in content))


def participants(releases: DataFrame) -> DataFrame:
    """(file, place, ocid, firm_id, name, won, bid_amount, day, buyer_id, category, region, title): tenderers and winners of each release."""
    r, t = F.col("r"), F.col("r.tender")
    winners = F.array_distinct(F.flatten(F.transform(r["awards"], lambda a: F.transform(F.coalesce(a["suppliers"], F.array().cast("array<struct<id:string>>")), lambda s: s["id"]))))
    none = F.array().cast("array<string>")
    won = F.coalesce(winners, none)
    tenderers = F.coalesce(F.transform(t["tenderers"], lambda x: x["id"]), none)
    rows = releases.where(F.coalesce(r["ocid"], F.lit("")) != "").select(
        "file", "place", r["ocid"].alias("ocid"), F.array_union(tenderers, won).alias("firms"), won.alias("won"), t["tenderers"].alias("tenderers"), r["bids"].alias("bids"),
        F.coalesce(blank(t["tenderPeriod"]["endDate"]), blank(r["date"])).alias("day"), blank(r["buyer"]["id"]).alias("buyer_id"), category_raw(t).alias("category"), buyer_party(r)["address"]["region"].alias("region"), blank(t["title"]).alias("title"),
    )
    rows = rows.withColumn("firm_id", F.explode("firms")).where(F.col("firm_id").isNotNull() & ~F.col("firm_id").isin(*NO_FIRM))
    name = F.get(F.filter("tenderers", lambda x: x["id"] == F.col("firm_id")), F.lit(0))["name"]
    value = F.element_at(F.filter("bids", lambda b: b["id"] == F.col("firm_id")), -1)["value"]
    bid = F.when(F.size(F.filter("bids", lambda b: b["id"] == F.col("firm_id"))) > 0, value.try_cast("double"))
    return rows.select("file", "place", "ocid", "firm_id", blank(name).alias("name"), F.array_contains("won", F.col("firm_id")).alias("won"), bid.alias("bid_amount"), F.substring("day", 1, 10).alias("day"), "buyer_id", "category", "region", "title")


def folded(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows of participants() by key: won if ever, of everything else the first value that is not null."""
    at = F.struct(*order)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    rest = [c for c in rows.columns if c not in (*by, *order, "won")]
    return rows.groupBy(*by).agg(F.max(F.col("won").cast("int")).alias("won"), *(first(c) for c in rest))
