"""What must not grow faster than the input, and the whole results beside it."""

import datetime as dt
import random

import pyarrow as pa
from pyspark.sql import functions as F

from bidlake.functions import normalize
from bidlake.operators import asof, census, entities, features, filters, ranking, scoring, shared, trades
from bidlake.plans import domain, registry
from bidlake.streaming import events


def test_best_pairs_stay_few(spark, monkeypatch):
    r = random.Random(5)
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    slug = lambda i: "ab"[i % 2]
    notices = [(i, "open", dt.datetime(2024, 3, 5 + i % 20), [slug(i)], {slug(i): "title"}, "mapped", True, "ON", "municipal", r.choice([1e5, 1.5e5, r.uniform(1e3, 5e5), float("nan"), None, -5.0])) for i in range(3000)]
    schema = "notice_id int, status string, closing_utc timestamp, trade_slugs array<string>, slug_sources map<string,string>, mapping_status string, construction_marked boolean, region string, buyer_type string, estimated_value double"
    firms = [(k, ["a"], ["ontario_any"], [], 1e3 * (k % 3), 4e5 if k % 3 else None, [1.5e5 if k % 4 else 9e6]) for k in range(60)]
    notices, firms = spark.createDataFrame(notices, schema), spark.createDataFrame(firms, "firm_id int, trades array<string>, regions array<string>, buyer_type_preferences array<string>, value_min double, value_max double, baseline_values array<double>")
    keys = ["firm_id", "place", "notice_id", "base_score", "value_modifier", "final_score"]
    rank, pairs = scoring.ranked, []
    want = rank(scoring.score(filters.evaluate(filters.against(notices, firms), {"a": "f", "b": "g"}, now).where("included")), 5).select(keys)
    monkeypatch.setattr(scoring, "ranked", lambda df, *args: pairs.append(df.count()) or rank(df, *args))
    got = scoring.best(notices, firms, {"a": "f", "b": "g"}, now, 5)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert pairs[0] < 3000 < 1500 * 60


def test_sessions_have_their_last_event(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = spark.createDataFrame([(1, at(0)), (1, at(20)), (1, at(49)), (1, at(80)), (2, at(5))], "user_id int, ts timestamp")
    got = sorted((x.user_id, x.session_start, x.last_event, x.n) for x in events.sessions(rows).collect())
    assert got == [(1, at(0), at(49), 3), (1, at(80), at(80), 1), (2, at(5), at(5), 1)]


def test_filters_by_kinds_equal_each_pair(spark, monkeypatch):
    r = random.Random(7)
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    some = lambda values, k: r.sample(values, r.randrange(k))
    notices = [
        (i, r.choice(["open", " Open", "closed", "unknown", None]), r.choice([None, dt.datetime(2024, 3, 1), dt.datetime(2024, 3, 2), dt.datetime(2024, 3, 2, 0, 0, 1), dt.datetime(2024, 9, 1)]), some(["a", "b", "c"], 3), {}, r.choice(["mapped", "unmapped", "non_construction", None]), True,
         r.choice([None, "", "QC", "ON, QC", "CA"]), r.choice([None, "federal", "health"]), r.choice([None, 50.0, 100.0, 1e6, float("nan")])) for i in range(150)
    ]
    firms = [(k, some(["a", "b", "c"], 3), some(["quebec", "federal_any"], 3), r.choice([None, 60.0]), r.choice([None, 5e5])) for k in range(20)]
    notices = spark.createDataFrame(notices, "notice_id int, status string, closing_utc timestamp, trade_slugs array<string>, slug_sources map<string,string>, mapping_status string, construction_marked boolean, region string, buyer_type string, estimated_value double")
    firms = spark.createDataFrame(firms, "firm_id int, trades array<string>, regions array<string>, value_min double, value_max double")
    kin = {"a": "f", "b": "f"}
    keys = ["notice_id", "firm_id", "included", "reasons", "flags", "region_kind", "affinity"]
    joined = {c: F.array_join(c, ",") for c in ("reasons", "flags")}
    want = filters.evaluate(filters.against(notices, firms), kin, now).withColumns(joined).select(keys).collect()
    judge, judged = filters.evaluate, []
    monkeypatch.setattr(filters, "evaluate", lambda df, *args: judged.append(df.count()) or judge(df, *args))
    got = filters.evaluated_by_kinds(notices, firms, kin, now).select(keys).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == 3000 and judged[0] < 3000


def test_filters_by_kinds_join_lists_of_firms(spark, monkeypatch):
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    by = {"notice_id": "id", "status": "'open'", "closing_utc": "TIMESTAMP '2024-05-01'", "trade_slugs": "array('a')", "slug_sources": "map('a', 'title')", "mapping_status": "'mapped'", "construction_marked": "true", "region": "'ON'", "buyer_type": "'health'", "estimated_value": "nullif(id, 3) * 10.0D"}
    notices = spark.range(200).selectExpr(*(f"{e} AS {c}" for c, e in by.items()))
    firms = spark.range(60).selectExpr("id % 50 AS firm_id", "IF(id % 2 = 0, array('a'), array('b')) AS trades", "array('ontario_any') AS regions", "IF(id % 7 = 0, null, id * 20.0D) AS value_min", "IF(id % 5 = 0, null, 1500.0D) AS value_max")
    keys = ["notice_id", "firm_id", "included", "reasons", "flags", "region_kind", "affinity"]
    want = filters.evaluate(filters.against(notices, firms), {"a": "f", "b": "g"}, now).withColumns({c: F.array_join(c, ",") for c in ("reasons", "flags")}).select(keys).collect()
    small, joined = filters.small, []
    monkeypatch.setattr(filters, "LIST_FIRMS", 8, raising=False)
    monkeypatch.setattr(filters, "PART_PAIRS", 100, raising=False)
    monkeypatch.setattr(filters, "small", lambda df, *args: joined.append(df) or small(df, *args))
    got = filters.evaluated_by_kinds(notices, firms, {"a": "f", "b": "g"}, now, parts=2).select(keys)
    assert joined[-1].count() == 8  # of 60 firms of two kinds
    assert max(len(x["_firms"]) for x in joined[-1].collect()) == 8
    sizes = [x["count"] for x in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 50 and max(sizes) < 1000 and sum(sizes) == 12_000
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want))


def test_equal_texts_are_classified_once(spark, monkeypatch):
    rows = [("a ring", "LARGE", None, None, "s1"), ("red", None, "x", None, "s1"), ("hat", "TINY", None, None, "s2"), ("cap", "TINY", None, None, "s2")]
    rows = spark.createDataFrame([x for k, x in enumerate(rows) for _ in range(50 * (k + 1))], "title string, category_raw string, description string, category_normalized string, source string")
    once = trades.distinct_texts(rows)
    assert once.count() == 4
    want = trades.unmapped_categories(trades.classify(rows, domain.PART_RULES)).collect()
    assert trades.unmapped_categories(trades.classify(once, domain.PART_RULES), weight=F.col("notices")).collect() == want == [("TINY", "s2", 350, "cap"), ("(none)", "s1", 100, "red")]
    classify, seen = trades.classify, []
    monkeypatch.setattr(trades, "classify", lambda df, *args: seen.append(df.count()) or classify(df, *args))
    part = spark.read.parquet("/root/testdata/sf0.01/part.parquet").where("p_partkey < 200")
    monkeypatch.setattr(domain, "table", lambda *_: part.union(part).union(part))
    domain.unmapped_categories(spark, "")
    assert seen[0] <= 200  # of 600 parts


def test_parts_of_joined_lines_follow_their_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "PART_ROWS", 500)
    rows = registry.lines_joined(spark, "/root/testdata/sf0.001")
    sizes = [x["count"] for x in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 1500 and sum(sizes) == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


def test_bids_of_entities_are_dealt_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "PART_ROWS", 300)
    keep, most = entities.kept, {}

    def noted(df, name):
        if name in ("took", "firms"):
            most[name] = df.rdd.getNumPartitions()
        return keep(df, name)

    monkeypatch.setattr(entities, "kept", noted)
    bids = spark.range(6000).select((F.col("id") % 3000).alias("firm_id"), (F.col("id") % 1700).alias("ocid")).unionByName(spark.range(50).select(F.lit(1).cast("long").alias("firm_id"), F.lit(None).cast("long").alias("ocid")))
    firms = spark.range(3000).select(F.col("id").alias("firm_id"), F.concat(F.lit("Firm "), (F.col("id") % 500).cast("string")).alias("name"))
    numbers = spark.range(0, 3000, 3).select(F.col("id").alias("firm_id"), F.floor(F.col("id") / 30).cast("string").alias("number"))
    found = [df.collect() for df in entities.merged(firms, numbers, bids)]
    assert most["took"] >= 20 and most["firms"] >= 10
    monkeypatch.setattr(shared, "PART_ROWS", 400_000)
    again = [df.collect() for df in entities.merged(firms, numbers, bids)]
    assert [sorted(map(repr, x)) for x in found] == [sorted(map(repr, x)) for x in again] and len(found[0]) == 3000
    assert sum(x.observations for x in found[0]) == 6000


def test_bids_of_entities_are_joined_in_parts_of_their_rows(spark, monkeypatch):
    two, sizes = entities._two, []

    def noted(rows, *args):
        sizes.append([x["count"] for x in rows.groupBy(F.spark_partition_id()).count().collect()])
        return two(rows, *args)

    monkeypatch.setattr(entities, "_two", noted)
    bids = spark.range(6000).select((F.col("id") % 3000).alias("firm_id"), (F.col("id") % 1700).alias("ocid"))
    firms = spark.range(3000).select(F.col("id").alias("firm_id"), F.concat(F.lit("Firm "), (F.col("id") % 500).cast("string")).alias("name"))
    run = lambda: [sorted(map(repr, df.collect())) for df in entities.merged(firms, firms.select("firm_id", F.lit(None).cast("string").alias("number")), bids)]
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        want = run()
        monkeypatch.setattr(shared, "PART_ROWS", 300)
        sizes.clear()
        assert run() == want and len(want[0]) == 3000
        assert len(sizes[0]) >= 15 and max(sizes[0]) < 1500 and sum(sizes[0]) == 6000
    finally:
        spark.conf.set(key, before)


def test_counts_of_firms_are_dealt_by_their_rows(spark, monkeypatch):
    count, parts = features.key_counts, []

    def noted(*args):
        got = count(*args)
        parts.append(got.rdd.getNumPartitions())
        return got

    monkeypatch.setattr(features, "key_counts", noted)
    by = {"canonical_id": "id % 500", "ocid": "id", "date": "date_add(DATE '2024-01-01', CAST(id % 100 AS INT))", "won": "id % 2", "bid_amount": "id % 77 + 0.5", "buyer_id": "id % 1700", "category": "CASE WHEN id % 3 > 0 THEN id % 40 || '' END", "region": "id % 5", "value": "id % 91 + 1.0"}
    rows, day = spark.range(6000).selectExpr(*(f"{e} AS {c}" for c, e in by.items())), F.lit("2024-03-01").cast("date")
    pairs = rows.where(F.col("date") >= day).select("canonical_id", "ocid", "category", "buyer_id", "region", "value")
    run = lambda: sorted(map(repr, features.cross_features(pairs, rows, features.histories(rows, day), day).collect()))
    want = run()
    assert max(parts) <= 4 and len(want) == pairs.count() > 1000
    monkeypatch.setattr(shared, "PART_ROWS", 300)
    parts.clear()
    assert run() == want and min(parts) >= 20


def test_metrics_place_few_positives(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 7)
    r = random.Random(11)
    pool = [(i * 3, r.choice("abcdefgh") if i % 9 else None) for i in range(300)]
    scores = [(f, c, r.choice([0.5, 0.25, 0.125, 0.0])) for f in range(40) for c in "abcdefg" if f % 10 and r.random() < 0.7] + [(50, "z", 0.5)]
    positives = sorted({(f, r.choice(pool)[0]) for f in range(41) for _ in range(1 + f)} | {(50, i) for i, _ in pool[:15]})
    frames = [spark.createDataFrame(x, of) for x, of in ((pool, "ocid long, category string"), (scores, "firm_id int, category string, score double"), (positives, "firm_id int, ocid long"))]
    want = ranking.metrics(ranking.places(*frames)).collect()
    place, seen = ranking._placed, []
    monkeypatch.setattr(ranking, "_placed", lambda keyed, scored, mine: seen.append(mine.count()) or place(keyed, scored, mine))
    got = ranking.metrics_of(*frames).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and any(0 < x.recall_10 < 1 for x in got)
    assert seen[0] < len(positives) / 3


def test_medians_of_a_firm_take_one_pass():
    r = random.Random(3)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=r.randrange(60)) for _ in range(200)]
    amounts = [r.choice([None, 5.0, r.uniform(1, 100)]) for _ in days]
    rows = pa.table({"firm_id": pa.array([7] * 200, pa.int64()), "day": pa.array(days, pa.date32()), "amount": pa.array(amounts, pa.float64())})
    want = []
    for day in sorted(set(days)):
        old = sorted(x for d, x in zip(days, amounts, strict=True) if d < day and x is not None)
        want += [(7, day, (old[(len(old) - 1) // 2] + old[len(old) // 2]) / 2)] if old else []
    got = asof._listed(rows)
    assert list(zip(*(c.to_pylist() for c in got.columns), strict=True)) == want and got.schema.field("firm_id").type == pa.int64()
    assert asof._listed(rows.slice(0, 1)).num_rows == 0


def test_packages_are_read_once_and_texts_folded_once(spark):
    for name in ("release_notices", "release_participants"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "from_json" not in plan and "StructsToJson" not in plan
    rows = spark.createDataFrame([("Planifié", "Travaux", "Ville de X", "Québec, ON"), (None, None, None, None), ("Ouvert", "services", "", "tout le Canada")], "a string, b string, c string, d string")
    at, day = F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-01").cast("timestamp")
    none = F.lit(None).cast("string")
    got = rows.select(normalize.status(F.col("a"), at, day), normalize.status(F.col("a"), day, at), normalize.category(F.col("b"), none, none, none, F.array(none)), normalize.buyer_type(F.col("c"), F.lit("unknown")), normalize.provinces(F.col("d")))
    assert [tuple(r) for r in got.collect()] == [("planned", "closed", "construction", "municipal", "ON,QC"), ("unknown", "closed", "other", "unknown", None), ("open", "closed", "services", "unknown", "CA")]
    told = rows.withColumn("said", F.concat("a", "b")).select(normalize.once(F.col("said"), lambda x: F.when(x == "p", x).otherwise(F.concat(x, x))))
    assert told._jdf.queryExecution().optimizedPlan().toString().count("concat(a") == 1


def test_pages_are_judged_in_batches_of_bounded_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.unset(key)
    try:
        html = '<a href="/docs/a.pdf">tender</a>' + "x" * 100_000
        pages = spark.range(60).coalesce(1).select(F.col("id").alias("page_id"), F.lit("https://a.example").alias("url"), F.lit(html).alias("html"))
        assert census.judge(pages).select("class").distinct().count() == 1
        sizes = pages.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
        assert len(sizes) > 1 and sum(x.n for x in sizes) == 60
    finally:
        spark.conf.set(key, before)
