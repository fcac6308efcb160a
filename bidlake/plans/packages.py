"""Release packages made of the test tables, read by the sources' operators: notices, and who took part; the statements are from the rules.

An order is a procurement, its lines are bids, returned lines are awards. A package is the JSON that a file would hold.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import kept, shared_dir
from ..sources import federal_csv, releases
from .registry import query, table
from .rules import dealt, said

STATES, TAGS = ["active", "planifié", "Cancelled", "complete", None], [["tender"], ["award", "contract"], []]
KINDS = [["*CNST", "roads"], [], ["Services professionnels"]]


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, place, r): one release an order, in files by year; each is made and read as JSON once."""
    lines, orders, customers = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    firm = F.concat(F.lit("F"), F.col("l_suppkey").cast("string"))
    at = F.struct("l_linenumber", "l_extendedprice", firm.alias("id"), F.col("l_returnflag").alias("flag"))
    each = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(at)).alias("b"))
    rows = orders.join(each, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    key, none = F.col("o_orderkey"), F.array().cast("array<string>")
    bids = F.coalesce("b", F.array().cast("array<struct<l_linenumber:int,l_extendedprice:double,id:string,flag:string>>"))
    buyer = F.concat(F.lit("B"), F.col("o_custkey").cast("string"))
    party = lambda ident, roles, flag: F.struct(ident.alias("id"), F.concat(F.lit("Buyer "), ident).alias("name"), roles.alias("roles"), F.struct(flag.alias("municipal")).alias("details"), F.struct(F.lit("Québec").alias("region")).alias("address"))
    tender = F.struct(
        F.when(key % 11 != 4, F.concat(F.lit("Works "), F.col("o_orderpriority"))).alias("title"), dealt(STATES, "o_orderkey").alias("status"), dealt(KINDS, "o_orderkey").alias("additionalProcurementCategories"), F.lit("goods").alias("mainProcurementCategory"),
        F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("endDate")).alias("tenderPeriod"), F.struct(F.when(key % 3 == 0, F.col("o_totalprice").cast("string")).alias("amount")).alias("value"),
        F.transform(bids, lambda x: F.struct(x["id"].alias("id"), F.concat(F.lit("Firm "), x["id"]).alias("name"))).alias("tenderers"),
    )
    # Every other release names its buyer by id; the others by role alone.
    release = F.struct(
        key.cast("string").alias("ocid"), F.lit("1998-01-01").alias("date"), dealt(TAGS, "o_orderkey").alias("tag"), F.struct(F.when(key % 2 == 0, buyer).alias("id")).alias("buyer"),
        F.array(party(F.lit("X"), none, F.lit("0")), party(buyer, F.array(F.lit("Buyer")), (F.col("o_custkey") % 2).cast("string"))).alias("parties"), tender.alias("tender"),
        F.transform(bids, lambda x: F.struct(x["id"].alias("id"), x["l_extendedprice"].cast("string").alias("value"))).alias("bids"),
        F.array(F.struct(F.transform(F.filter(bids, lambda x: x["flag"] == "R"), lambda x: F.struct(x["id"].alias("id"))).alias("suppliers"))).alias("awards"),
    )
    file = F.concat(F.lit("hebdo_"), F.year("o_orderdate").cast("string"), F.lit(".json"))
    # Written, as conditions on what was read would else be moved below the reading, each with a reading of its own.
    return kept(rows.select(file.alias("file"), key.alias("place"), F.from_json(F.to_json(release), releases.RELEASE).alias("r")), "packages")


@query(
    "release_participants",
    f"""SELECT o_orderkey::VARCHAR AS ocid, 'F' || l_suppkey AS firm_id, bool_or(l_returnflag = 'R')::INT AS won, arg_max(l_extendedprice, (l_linenumber, l_extendedprice)) AS bid_amount, 'Firm F' || l_suppkey AS name, strftime(any_value(o_orderdate), '%Y-%m-%d') AS day,
  any_value(CASE WHEN o_orderkey % 2 = 0 THEN 'B' || o_custkey END) AS buyer_id, any_value(CASE o_orderkey % 3 WHEN 0 THEN '*CNST | roads' WHEN 1 THEN 'goods' ELSE 'Services professionnels' END) AS category
FROM {{orders}} JOIN {{lineitem}} ON l_orderkey = o_orderkey GROUP BY o_orderkey, l_suppkey""",
)
def release_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    took = releases.folded(releases.participants(packages(spark, sf_dir)), ["ocid", "firm_id"], ["file", "place"])
    return took.select("ocid", "firm_id", "won", "bid_amount", "name", "day", "buyer_id", "category")


@query(
    "release_notices",
    f"""WITH t AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS closing, o_totalprice AS p, {said(STATES, 'o_orderkey')} AS s, CAST(o_orderdate AS DATE) <= DATE '1998-08-02' AS past FROM {{orders}} WHERE o_orderkey % 11 <> 4),
u AS (SELECT *, CASE s WHEN 'active' THEN 'open' WHEN 'planifié' THEN 'planned' WHEN 'Cancelled' THEN 'cancelled' WHEN 'complete' THEN 'awarded' ELSE 'unknown' END AS plain FROM t),
v AS (SELECT *, CASE WHEN past AND plain IN ('open', 'planned', 'unknown') THEN 'closed' ELSE plain END AS state FROM u)
SELECT k::VARCHAR AS source_id, CASE WHEN c % 2 = 1 THEN 'municipal' ELSE 'provincial' END AS buyer_type, CASE k % 3 WHEN 0 THEN 'construction' WHEN 1 THEN 'goods' ELSE 'professional_services' END AS category_normalized, CASE WHEN k % 3 = 0 THEN p END AS estimated_value,
  CASE WHEN k % 3 = 0 THEN 'CAD' END AS currency, 'QC' AS region, CASE WHEN state <> 'cancelled' AND k % 3 = 1 THEN 'awarded' ELSE state END AS status FROM v""",
)
def release_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = releases.newest(releases.notices(packages(spark, sf_dir), F.lit("1998-08-02 12:00:00").cast("timestamp")))
    return rows.select("source_id", "buyer_type", "category_normalized", "estimated_value", "currency", "region", "status")


CATEGORIES, REGIONS = ["*CNST", "*SRV", None], ["Ontario", "Québec, Nouvelle-Écosse", "Canada", None, ""]
ATTACHED = ["https://a.example/x.pdf, https://a.example/y.pdf|https://a.example/x.pdf", "none", None]


@query(
    "federal_notices",
    f"""SELECT 'cb-' || o_orderkey AS source_id, 'Supply, "' || o_orderpriority || '"' AS title, CASE o_orderkey % 3 WHEN 0 THEN 'construction' WHEN 1 THEN 'services' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'construction' ELSE 'other' END END AS category_normalized,
  [ 'ON', 'NS,QC', 'CA', NULL, NULL ][o_orderkey % 5 + 1] AS region, CASE WHEN o_orderkey % 4 = 0 THEN 'municipal' ELSE 'federal' END AS buyer_type, o_orderkey % 3 = 0 AS documents_open, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END AS attachments,
  CASE WHEN o_orderdate <= TIMESTAMP '1998-08-02 12:00:00' THEN 'closed' ELSE 'open' END AS status FROM {{orders}} WHERE o_orderkey % 13 <> 5""",
)
def federal_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as a federal file, written under the shared folder and read by the reader of such files."""
    key = F.col("o_orderkey")
    cells = {
        "referenceNumber-numeroReference": F.when(key % 13 != 5, F.concat(F.lit(" cb-"), key.cast("string"))), "title-titre-eng": F.concat(F.lit('Supply, "'), F.col("o_orderpriority"), F.lit('"')), "title-titre-fra": F.lit("Titre"),
        "tenderClosingDate-appelOffresDateCloture": F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), "tenderStatus-appelOffresStatut-eng": F.lit("Open"), "procurementCategory-categorieApprovisionnement": dealt(CATEGORIES, "o_orderkey"),
        "unspsc": F.when(key % 2 == 0, "*72100000").otherwise("*81100000"), "regionsOfDelivery-regionsLivraison-eng": dealt(REGIONS, "o_orderkey"), "contractingEntityName-nomEntitContractante-eng": F.when(key % 4 == 0, "City of Guelph").otherwise("Department"),
        "attachment-piecesJointes-eng": dealt(ATTACHED, "o_orderkey"),
    }
    path = f"{shared_dir(spark)}/bidlake/federal-{uuid.uuid4().hex}"
    table(spark, sf_dir, "orders").select(*(c.alias(name) for name, c in cells.items())).write.csv(path, header=True, escape='"')
    rows = federal_csv.read(spark, path, F.lit("1998-08-02 12:00:00").cast("timestamp"))
    return rows.select("source_id", "title", "category_normalized", "region", "buyer_type", "documents_open", F.size("attachments").alias("attachments"), "status")
