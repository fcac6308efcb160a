"""Operators on literal frames: cases of filters, scores, rules, quotes, sources, features and streams."""

import datetime as dt
import json
import math
import random
import statistics
import unicodedata

import pytest
from pyspark.sql import functions as F

from bidlake.functions import normalize, text
from bidlake.operators import awards, boards, features, filters, packing, quotes, ranking, requirements, scoring, sinks, trades, trees, upsert
from bidlake.plans import domain
from bidlake.sources import federal_csv, releases, tables
from bidlake.streaming import events



def now():
    return F.lit("2026-07-30 12:00:00").cast("timestamp")


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


# text


def test_fold_equals_decomposition(spark):
    def plain(t):
        t = "".join(c for c in unicodedata.normalize("NFKD", t).casefold() if not unicodedata.combining(c))
        return " ".join(t.replace("’", "'").replace("‘", "'").replace("`", "'").split())

    r = random.Random(1)
    signs = [*"aB z\t\n'`’‘-,.", *map(chr, range(0xA1, 0x250)), *map(chr, range(0x1E00, 0x1F00)), *"…ﬁﬂＡ½²é  "]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(400)] + ["", "Égouts  d’Été", "STRAẞE ß", "Άλφα ΌΣ", "ёлка Йод", "ガギ ｶﾞ", "한국 각", "ǅ İ ﷺ", "A\x1cb\u2028c"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string").select("i", text.fold(F.col("t")).alias("f")).collect()
    got = {r.i: r.f for r in rows}
    assert got.pop(-1) is None and [t for i, t in enumerate(texts) if got[i] != plain(t)] == []


@pytest.mark.parametrize(
    ("value", "want"),
    [("$2,500,000", 2.5e6), ("2 million", 2e6), ("1.5M", 1.5e6), ("500k", 5e5), ("3 thousand", 3e3), ("10%", None), ("ten percent 10", None), ("none", None), ("-5", -5.0), ("1,2345", 1234.0), ("5 months", 5e6), ("12 km", 12e3), ("about 7.", 7.0), (None, None), ("", None), ("1,23", 1.0)],
)
def test_amounts(spark, value, want):
    assert one(spark, text.amount, value) == want


def test_bands_and_distances(spark):
    rows = spark.createDataFrame([(None,), (0.0,), (99_999.99,), (100_000.0,), (5e5,), (2e6,), (1e7,)], "v double").select(text.band(F.col("v")).alias("b")).collect()
    assert [r.b for r in rows] == ["unknown", "unknown", "<$100K", "$100–500K", "$500K–2M", "$2–10M", ">$10M"]
    far = spark.createDataFrame([("<$100K", "$500K–2M"), ("unknown", "<$100K"), (">$10M", ">$10M")], "a string, b string").select(text.band_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in far] == [2, None, 0]


def test_status_category_region_buyer(spark):
    past, later = "2026-07-01 00:00:00", "2026-09-01 00:00:00"
    cases = [("Active", later, "open"), ("Active", past, "closed"), ("Annulé", later, "cancelled"), ("Awarded", past, "awarded"), ("planned", later, "planned"), (None, None, "unknown"), ("", past, "closed"), ("Fermé", later, "closed"), ("open, cancelled", later, "cancelled")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string").select("i", normalize.status(F.col("a"), F.col("b").cast("timestamp"), now()).alias("s")).collect()
    assert {r.i: r.s for r in rows} == {i: c[2] for i, c in enumerate(cases)}
    cases = [("*CNST", None, "x", None, [], "construction"), ("*SRVTGD", None, "Road bridge", None, ["72100000"], "services"), (None, None, "Road works", None, [], "construction"), (None, None, "Broadband", None, [], "other"), (None, None, "x", None, ["*30-11"], "construction"), ("*GD", None, "x", None, [], "goods"), ("Services professionnels", None, "x", None, [], "professional_services"), (None, "works", "x", None, [], "construction")]
    rows = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)], "i int, raw string, main string, title string, d string, codes array<string>")
    got = {r.i: r.c for r in rows.select("i", normalize.category(*map(F.col, ("raw", "main", "title", "d", "codes"))).alias("c")).collect()}
    assert got == {i: c[5] for i, c in enumerate(cases)}
    cases = [("Québec and Ontario", "ON,QC"), ("on, bc", "BC,ON"), ("*Canada", "CA"), ("Trenton, ON", "ON"), (None, None), ("nowhere", None), ("Colombie-Britannique", "BC")]
    assert [one(spark, normalize.provinces, v) for v, _ in cases] == [w for _, w in cases]
    cases = [("Ville de Laval", "municipal"), ("CIUSSS de l'Est", "health"), ("Université McGill", "education"), ("Department of Defence", "federal"), (None, "federal")]
    assert [one(spark, lambda c: normalize.buyer_type(c, F.lit("federal")), v) for v, _ in cases] == [w for _, w in cases]
    assert [one(spark, normalize.preferred_buyer, v) for v in ("Health", "municipal", "unknown", None, "crown")] == ["hospital", "municipal", None, None, "other"]


# trades

RULES = {
    "version": "t1",
    "families": {"civil": ["roadwork", "bridge", "granular"], "building": ["hvac"]},
    "construction_markers": {"category_normalized": ["construction"], "category_raw_keywords": ["cnst"]},
    "rules": [
        {"slug": "bridge", "priority": 10, "keywords_en": ["bridge", "structural engineer"], "keywords_fr": ["pont"]},
        {"slug": "roadwork", "priority": 12, "keywords_en": ["road", "cast-in-place curb"], "keywords_fr": ["chaussée"]},
        {"slug": "granular", "priority": 13, "keywords_en": ["gravel supply"]},
        {"slug": "hvac", "priority": 22, "keywords_en": ["heating system", "boiler"]},
    ],
    "non_construction": {"category_raw_exact": ["*GD"], "keywords_en": ["software"], "keywords_fr": ["courtage d'assurance"]},
    "goods_category_guard": {"category_raw_exact": ["*GD"], "allowed_slugs": ["granular"]},
}


def test_trade_rules(spark):
    cases = [
        ("Bridges and roads", None, None, "other", ["bridge", "roadwork"], {"bridge": "title", "roadwork": "title"}, "mapped", ["bridge", "road"]),
        ("Heating systems", None, "fees: Structural Engineer", "other", ["hvac", "bridge"], {"hvac": "title", "bridge": "description"}, "mapped", ["heating system", "structural engineer"]),
        ("Broad abridged roadster", None, None, "other", [], {}, "unmapped", []),
        ("Réfection de la CHAUSSÉE", None, None, "construction", ["roadwork"], {"roadwork": "title"}, "mapped", ["chaussee"]),
        ("Bridge kit and gravel  supply", "*GD", None, "goods", ["granular"], {"granular": "title"}, "mapped", ["gravel supply"]),
        ("Bridge kit", "*GD", None, "goods", [], {}, "non_construction", ["category:*GD"]),
        ("Courtage d’assurance", None, "software", "services", [], {}, "non_construction", ["keyword:software"]),
        ("Software", "*CNST", None, "construction", [], {}, "unmapped", []),
        ("Cast-in-place  curbs", None, None, "other", ["roadwork"], {"roadwork": "title"}, "mapped", ["cast-in-place curb"]),
        ("New gravel", "supply", None, "other", ["granular"], {"granular": "description"}, "mapped", ["gravel supply"]),
        (None, None, None, None, [], {}, "unmapped", []),
        ("A site", "boiler", None, "other", ["hvac"], {"hvac": "category_raw"}, "mapped", ["boiler"]),
    ]
    rows = spark.createDataFrame([(i, *c[:4], "clash") for i, c in enumerate(cases)], "i int, title string, category_raw string, description string, category_normalized string, trade_slugs string")
    rules = trades.Rules.read(RULES)
    got = trades.classify(rows, rules)
    for r in got.collect():
        assert (r.trade_slugs, r.slug_sources, r.mapping_status, r.matched_terms) == cases[r.i][4:8], cases[r.i]
    tally = trades.coverage(got).first()
    assert (tally.notices, tally.mapped, tally.construction_total, tally.construction_mapped, tally.coverage_pct) == (12, 7, 2, 1, 50.0)
    assert trades.classify(rows.limit(0), rules).count() == 0
    with pytest.raises(ValueError, match="unknown trades"):
        trades.Rules.read(RULES, ["bridge", "roadwork"])
    assert rules.warnings(["bridge", "roadwork", "granular", "hvac", "snow"]) == ["no rule: snow"]


# filters and scores

FAMILY = {"roadwork": "civil", "water_wastewater": "civil", "bridge_structural": "civil", "landscaping": "grounds", "snow_ice_management": "grounds"}
NOTICE = {"notice_id": 1, "status": "open", "closing_utc": "2026-08-20 12:00:00", "mapping_status": "mapped", "trade_slugs": ["water_wastewater"], "slug_sources": {"water_wastewater": "title"}, "construction_marked": True, "region": "ON", "buyer_type": "municipal", "estimated_value": 800_000.0}
FIRM = {"firm_id": 1, "trades": ["water_wastewater", "bridge_structural"], "regions": ["simcoe", "grey"], "value_min": 100_000.0, "value_max": 5_000_000.0, "buyer_type_preferences": ["municipal", "federal"], "baseline_values": [400_000.0, 850_000.0, 1_200_000.0]}
PAIR = "notice_id long, status string, closing_utc string, mapping_status string, trade_slugs array<string>, slug_sources map<string,string>, construction_marked boolean, region string, buyer_type string, estimated_value double"
FIRM_SCHEMA = "firm_id long, trades array<string>, regions array<string>, value_min double, value_max double, buyer_type_preferences array<string>, baseline_values array<double>"


def frames(spark, notices, firms):
    n = spark.createDataFrame([tuple((NOTICE | {"notice_id": k} | x).values()) for k, x in enumerate(notices)], PAIR).withColumn("closing_utc", F.col("closing_utc").cast("timestamp"))
    return n, spark.createDataFrame([tuple((FIRM | {"firm_id": k} | x).values()) for k, x in enumerate(firms)], FIRM_SCHEMA)


FILTER_CASES = [
    ({}, {}, [], [], "single_province_match", "exact"),
    ({"status": "awarded"}, {}, ["closed"], [], "single_province_match", "exact"),
    ({"status": "unknown", "closing_utc": None}, {}, ["closing_date_unknown", "closing_date_missing"], [], "single_province_match", "exact"),
    ({"status": ""}, {}, ["closing_date_unknown"], [], "single_province_match", "exact"),
    ({"status": None}, {}, ["closing_date_unknown"], [], "single_province_match", "exact"),
    ({"closing_utc": "2026-07-31 09:00:00"}, {}, ["closing_within_24h"], [], "single_province_match", "exact"),
    ({"closing_utc": "2026-07-31 13:00:00"}, {}, [], [], "single_province_match", "exact"),
    ({"closing_utc": "2026-07-29 09:00:00"}, {}, ["closing_within_24h"], [], "single_province_match", "exact"),
    ({"closing_utc": None}, {}, ["closing_date_missing"], [], "single_province_match", "exact"),
    ({"region": "AB"}, {}, ["region_mismatch"], [], None, "exact"),
    ({"estimated_value": 25_000.0}, {}, ["value_out_of_range"], [], "single_province_match", "exact"),
    ({"estimated_value": 9e6}, {}, ["value_out_of_range"], [], "single_province_match", "exact"),
    ({"estimated_value": 5e6}, {}, [], [], "single_province_match", "exact"),
    ({"estimated_value": 1e5}, {}, [], [], "single_province_match", "exact"),
    ({"trade_slugs": ["snow_ice_management"]}, {}, ["trade_mismatch"], [], "single_province_match", "none"),
    ({"mapping_status": "non_construction", "trade_slugs": []}, {}, ["non_construction"], [], "single_province_match", "none"),
    ({"status": "cancelled", "region": "AB", "estimated_value": 9e6, "trade_slugs": ["landscaping"]}, {}, ["closed", "trade_mismatch", "region_mismatch", "value_out_of_range"], [], None, "none"),
    ({"region": None}, {}, [], ["region_unknown"], "unknown", "exact"),
    ({"region": " "}, {}, [], ["region_unknown"], "unknown", "exact"),
    ({"estimated_value": None}, {}, [], ["value_unknown"], "single_province_match", "exact"),
    ({"mapping_status": "unmapped", "trade_slugs": []}, {}, [], ["trade_unmapped"], "single_province_match", "unmapped"),
    ({"mapping_status": None, "trade_slugs": None}, {}, [], ["trade_unmapped"], "single_province_match", "unmapped"),
    ({"trade_slugs": ["roadwork"]}, {}, [], ["trade_family_only"], "single_province_match", "family"),
    ({"region": "CA"}, {}, [], [], "multi_province_or_national", "exact"),
    ({"region": "ON,QC"}, {}, [], [], "multi_province_or_national", "exact"),
    ({"region": "AB", "buyer_type": "federal"}, {"regions": ["ontario_any", "federal_any"]}, [], [], "multi_province_or_national", "exact"),
    ({"region": "AB"}, {"regions": ["ontario_any", "federal_any"]}, ["region_mismatch"], [], None, "exact"),
    ({}, {"trades": None}, ["trade_mismatch"], [], "single_province_match", "none"),
    ({}, {"value_min": None, "value_max": None}, [], [], "single_province_match", "exact"),
]


def test_filters(spark):
    n, f = frames(spark, [c[0] for c in FILTER_CASES], [c[1] for c in FILTER_CASES])
    pairs = n.join(f, n.notice_id == f.firm_id).withColumn("detail", F.lit("clash"))
    got = {r.notice_id: r for r in filters.evaluate(pairs, FAMILY, now()).collect()}
    for k, (_, _, reasons, flags, region, affinity) in enumerate(FILTER_CASES):
        r = got[k]
        assert (r.reasons, r.flags, r.region_kind, r.affinity, r.included) == (reasons, flags, region, affinity, not reasons), FILTER_CASES[k]
    assert got[1].detail == "status=awarded" and got[0].detail is None and got[5].detail == "closes inside the 24h floor" and got[7].detail == "closing date has passed"
    assert got[9].detail == "notice region ['AB'] vs firm ['simcoe', 'grey']" and got[10].detail == "value 25,000 below firm minimum 100,000" and "above firm maximum 5,000,000" in got[11].detail
    assert got[14].detail == "notice trades ['snow_ice_management'] vs firm trades ['water_wastewater', 'bridge_structural']"
    tally = {r.reason: (r.pairs, r.pairs_primary) for r in filters.reason_tally(filters.evaluate(pairs, FAMILY, now())).collect()}
    assert tally["closed"] == (2, 2) and tally["region_mismatch"] == (3, 2) and tally["closing_date_missing"] == (2, 1)
    assert filters.evaluate(pairs.limit(0), FAMILY, now()).count() == 0


def test_context_of_filters(spark):
    n, f = frames(spark, [{"closing_utc": "2026-08-09 12:00:00"}, {"trade_slugs": ["water_wastewater", "bridge_structural"], "slug_sources": {"water_wastewater": "description", "bridge_structural": "description"}}, {"trade_slugs": ["roadwork"], "slug_sources": {"roadwork": "description"}}], [{}])
    got = {r.notice_id: r for r in filters.evaluate(n.crossJoin(f), FAMILY, now()).collect()}
    assert (got[0].days_to_close, got[0].hours_to_close, got[0].evidence) == (10.0, 240.0, "title")
    assert (got[1].overlap, got[1].matched, got[1].evidence) == (2, ["water_wastewater", "bridge_structural"], "description")
    assert got[2].evidence == "description"


def test_candidates_hold_all_included_pairs(spark):
    r = random.Random(2)
    slugs = list(FAMILY)
    notices = [{"trade_slugs": r.sample(slugs, r.randint(0, 2)), "mapping_status": r.choice(["mapped", "mapped", "unmapped", "non_construction"]), "region": r.choice([None, "ON", "QC", "ON,QC", "CA", "AB"]), "buyer_type": r.choice(["federal", "municipal", None]), "estimated_value": r.choice([None, 1e3, 2e5])} for _ in range(120)]
    firms = [{"trades": r.sample(slugs, r.randint(0, 3)), "regions": r.choice([[], ["quebec"], ["toronto", "federal_any"], None]), "value_min": r.choice([None, 1e4])} for _ in range(25)]
    n, f = frames(spark, notices, firms)
    ids = lambda df: sorted((x.notice_id, x.firm_id) for x in filters.evaluate(df, FAMILY, now()).where("included").collect())
    every, keyed = n.crossJoin(f), filters.candidates(n, f, FAMILY, blocks=3)
    assert ids(every) == ids(keyed) != [] and keyed.count() < every.count()


SCORE_CASES = [
    ({}, {}, {"trade_match": 36.0, "region_match": 20.0, "buyer_type_preference": 20.0, "recency_urgency": 15.0}),
    ({"trade_slugs": ["water_wastewater", "bridge_structural"]}, {}, {"trade_match": 40.5}),
    ({"trade_slugs": ["roadwork"]}, {}, {"trade_match": 18.0}),
    ({"trade_slugs": ["water_wastewater"], "slug_sources": {"water_wastewater": "description"}}, {}, {"trade_match": 25.2}),
    ({"mapping_status": "unmapped", "trade_slugs": []}, {}, {"trade_match": 13.5}),
    ({"mapping_status": "unmapped", "trade_slugs": [], "construction_marked": False}, {}, {"trade_match": 6.75}),
    ({"region": None}, {}, {"region_match": 10.0}),
    ({"region": "CA"}, {}, {"region_match": 10.0}),
    ({"buyer_type": "health"}, {}, {"buyer_type_preference": 8.0}),
    ({"buyer_type": "unknown"}, {}, {"buyer_type_preference": 10.0}),
    ({"closing_utc": "2026-08-02 12:00:00"}, {}, {"recency_urgency": 3.75}),
    ({"closing_utc": "2026-08-04 12:00:00"}, {}, {"recency_urgency": 9.0}),
    ({"closing_utc": "2026-08-19 12:00:00"}, {}, {"recency_urgency": 12.75}),
    ({"closing_utc": "2026-09-20 12:00:00"}, {}, {"recency_urgency": 15.0}),
    ({"closing_utc": "2027-07-30 12:00:00"}, {}, {"recency_urgency": 10.5}),
]


def test_scores(spark):
    n, f = frames(spark, [c[0] | {"estimated_value": None} for c in SCORE_CASES], [c[1] for c in SCORE_CASES])
    got = {r.notice_id: r for r in scoring.score(filters.evaluate(n.join(f, n.notice_id == f.firm_id), FAMILY, now())).collect()}
    for k, (_, _, points) in enumerate(SCORE_CASES):
        assert {name: getattr(got[k].points, name) for name in points} == points, SCORE_CASES[k]
        assert got[k].base_score == round(sum(got[k].points), 2) == got[k].final_score and got[k].value_modifier == 0.0
    assert got[0].score_flags == [] and got[14].score_flags == ["long_horizon"]
    n, f = frames(spark, [{"estimated_value": 850_000.0}, {"estimated_value": 4e6}, {"estimated_value": 2e5}], [{}, {}, {"baseline_values": []}])
    got = {r.notice_id: r for r in scoring.score(filters.evaluate(n.join(f, n.notice_id == f.firm_id), FAMILY, now())).collect()}
    assert got[0].value_modifier == 10.0 and got[0].final_score == min(100.0, round(got[0].base_score + 10, 2)) and -10 <= got[1].value_modifier < -9.9
    assert (got[2].value_modifier, got[2].score_flags) == (0.0, ["value_baseline_unknown"])


def test_weights_are_checked():
    scoring.checked(scoring.WEIGHTS)
    for bad in ({"components": {"trade_match": 60, "region_match": 40}}, {"components": scoring.WEIGHTS["components"] | {"value_sweetspot": 0}}, {"components": scoring.WEIGHTS["components"] | {"trade_match": 40}}, {"components": scoring.WEIGHTS["components"], "recency_curve": []}):
        with pytest.raises(ValueError):
            scoring.checked({"recency_curve": [{"max_days": None, "score": 1.0}]} | bad)


def test_ranks(spark):
    rows = spark.createDataFrame([(1, k, float(k % 3), f"2026-09-{1 + k % 5:02d}" if k % 7 else None) for k in range(60)], "firm_id int, notice_id int, final_score double, closing_utc string")
    got = [r.notice_id for r in scoring.ranked(rows, 12, blocks=4).orderBy("place").collect()]
    assert got == sorted(range(60), key=lambda k: (-(k % 3), f"2026-09-{1 + k % 5:02d}" if k % 7 else "9999", k))[:12]


# requirements

PROFILE = "certifications array<string>, bonding_capacity double, cgl_limit double, auto_limit double, regions array<string>, submission_capabilities array<string>"


def test_requirement_rules(spark):
    cases = [
        ("certification", "==", "cor", None, "", True, "pass"), ("certification", "==", "ISO 9001", None, "", True, "fail"), ("certification", "==", " ", None, "", True, "unknown"),
        ("bonding_capacity", ">=", "$2 million", None, "", True, "pass"), ("bonding_capacity", ">=", "9,000,000", None, "", True, "fail"), ("bonding_capacity", ">=", "10%", None, "", True, "unknown"),
        ("insurance_cgl", ">=", "5M", None, "", True, "pass"), ("Automobile liability insurance", ">=", "5M", None, "", True, "unknown"),
        ("region", "in", None, ["Ontario", "quebec"], "", True, "pass"), ("region", "==", "Alberta", None, "", True, "fail"), ("region", "==", None, None, "", True, "unknown"),
        ("submission_method", "==", "email", None, "", True, "pass"), ("submission_method", "==", "fax", None, "", True, "fail"), ("submission_method", "!=", "fax", None, "", True, "pass"),
        ("submission_method", "==", "courier or fax", None, "", True, "pass"), ("submission_method", "in", "as stated", None, "bids by facsimile only", True, "fail"),
        ("submission_method", "==", "as stated", None, "through MERX", True, "fail"), ("submission_method", ">=", "email", None, "", True, "unknown"), ("submission_method", "==", "as stated", None, "", True, "unknown"),
        ("submission_method", "!=", "email, physical", None, "", True, "fail"), ("colour", "==", "red", None, "", True, "unknown"), ("certification", "==", "COR", None, "", False, "unknown"), (None, None, None, None, None, None, "unknown"),
    ]
    rows = spark.createDataFrame([(i, *c[:6]) for i, c in enumerate(cases)], "i int, check_field string, check_operator string, check_value string, check_values array<string>, requirement_text string, machine_checkable boolean").withColumn("verbatim_quote", F.lit(None).cast("string"))
    profile = spark.createDataFrame([(["COR"], 5e6, 5e6, None, ["Ontario"], ["email", "physical"])], PROFILE)
    got = {r.i: r.outcome for r in requirements.evaluate_rules(rows.crossJoin(profile)).collect()}
    assert got == {i: c[6] for i, c in enumerate(cases)}
    able = {r.i: r.machine_checkable for r in requirements.checkable(rows).collect()}
    assert able[0] and not able[17] and not able[20] and not able[21]


def test_decisions(spark):
    rows = [("a", "r1", 1, "text one", "pass", False), ("a", "r2", 2, "two ", "fail", False), ("a", "r2", 9, "again", "pass", False), ("a", "r3", 3, "three", "unknown", True), *(("b", f"q{k}", k, "q", "unknown", True) for k in range(1, 6)), ("c", "r1", 1, "x", "pass", False), ("d", "r1", 1, "x", "pass", True), ("d", "r2", 2, "y", None, True), ("d", "r3", 3, "y", "pass", True), ("d", "r4", 4, "y", "pass", True)]
    frame = spark.createDataFrame(rows, "tender_id string, req_id string, pos int, requirement_text string, outcome string, fuzzy boolean")
    tenders = spark.createDataFrame([(t,) for t in "abcde"], "tender_id string")
    got = {r.tender_id: r for r in requirements.decide(tenders, frame).collect()}
    assert (got["a"].verdict, got["a"].confidence, got["a"].blockers, got["a"].open_questions, got["a"].rationale) == ("no_bid", "medium", ["r2"], ["r3"], "Do not bid: r2 (two).")
    assert (got["b"].verdict, got["b"].confidence, got["b"].rationale) == ("review", "low", "Manual review required: q1 (q); q2 (q); q3 (q) and 2 more.")
    assert (got["c"].verdict, got["c"].confidence) == ("bid", "high") and (got["e"].verdict, got["e"].confidence, got["e"].mandatory) == ("review", "low", 0)
    assert (got["d"].verdict, got["d"].confidence, got["d"].open_questions, got["d"].passed) == ("review", "medium", ["r2"], 3)


def test_judgments_and_phases(spark):
    asked = spark.createDataFrame([("t", f"r{k}") for k in range(4)], "tender_id string, req_id string")
    judged = spark.createDataFrame([("t", "r0", " Satisfied ", "ok", 0), ("t", "r0", "uncertain", "later", 1), ("t", "r1", "maybe", "", 2), ("t", "zz", "satisfied", "x", 3), ("t", "r3", None, None, 4)], "tender_id string, req_id string, verdict string, rationale string, pos int")
    got = {r.req_id: (r.verdict, r.source) for r in requirements.with_judgments(asked, judged).collect()}
    assert got == {"r0": ("satisfied", "explicit"), "r1": ("uncertain", "coerced"), "r2": ("uncertain", "defaulted"), "r3": ("uncertain", "explicit")}
    assert [r.req_id for r in requirements.missing(asked, judged).collect()] == ["r2"]
    phases = spark.createDataFrame([("t", "r0", "Contract_Condition", 0), ("t", "r1", "nonsense", 1)], "tender_id string, req_id string, phase string, pos int")
    assert {r.req_id: r.phase for r in requirements.with_phases(asked, phases).collect()} == {"r0": "contract_condition", "r1": "bid_phase_mandatory", "r2": "bid_phase_mandatory", "r3": "bid_phase_mandatory"}


def test_quotes(spark):
    long = "The bidder must hold a certificate " * 5
    pages = spark.createDataFrame([("t", "a.pdf", "1", "First “page” text"), ("t", "a.pdf", "2", "ends here with the bid"), ("t", "a.pdf", "10", "bond of ten percent."), ("t", "b.pdf", "1", f"Other — words. {long}but not so"), ("t", "a.pdf", "x", "bond of last"), ("u", "a.pdf", "1", "only in u")], "tender_id string, file string, page string, text string")
    cases = [("first \"page\"", "a.pdf", 1, "verified", "a.pdf", "1"), ("FIRST  \"PAGE\"", "a.pdf", 2, "page_repaired", "a.pdf", "1"), ("the bid bond of ten", "a.pdf", 2, "verified", "a.pdf", "2"), (long + "and so on", "a.pdf", 1, "page_repaired", "b.pdf", "1"), ("other - words", "b.pdf", 1, "verified", "b.pdf", "1"), ("only in u", "a.pdf", 1, "quote_not_found", None, None), (" ", "a.pdf", 1, "empty_quote", None, None), (None, "a.pdf", 1, "empty_quote", None, None), ("ten percent. bond of last", "c.pdf", 1, "page_repaired", "a.pdf", "10")]
    rows = spark.createDataFrame([("t", str(i), *c[:3]) for i, c in enumerate(cases)], "tender_id string, req_id string, quote string, source_file string, page int")
    got = {int(r.req_id): (r.status, r.found_file, r.found_page) for r in quotes.locate(rows, pages).collect()}
    assert got == {i: c[3:] for i, c in enumerate(cases)}


# features, awards, ranking, boards


def test_features(spark):
    rows = [("f", "o1", "2026-01-10", 0, 100.0, "b1", "works", "QC"), ("f", "o2", "2026-02-09", 1, 300.0, "b1", "goods", ""), ("f", "o3", "2026-03-01", 1, 9e9, "b9", "x", "ON"), ("f", "o4", None, 1, 1.0, "b", "x", "ON"), ("g", "o1", "2026-02-01", 0, None, None, None, None), ("f", "o5", "2026-02-09", 1, -5.0, "b2", "works", "QC")]
    inter = spark.createDataFrame(rows, "canonical_id string, ocid string, date string, won int, bid_amount double, buyer_id string, category string, region string").withColumn("date", F.col("date").cast("date"))
    day = F.lit("2026-03-01").cast("date")
    history = features.histories(inter, day)
    got = {r.canonical_id: r.asDict() for r in features.firm_features(spark.createDataFrame([("f",), ("g",), ("new",)], "canonical_id string"), history, day).collect()}
    f = got["f"]
    assert (f["firm_interactions"], f["firm_wins"], f["firm_distinct_categories"], f["firm_distinct_buyers"], f["firm_distinct_regions"]) == (3.0, 2.0, 2.0, 2.0, 1.0)
    assert abs(f["firm_category_concentration"] - 5 / 9) < 1e-12 and f["firm_median_bid"] == 200.0 and f["firm_days_since_last"] == 20.0 and f["firm_active_days"] == 50.0
    assert abs(f["firm_bid_spread"] - abs(math.log1p(300) - math.log1p(100)) / 2) < 1e-12 and abs(f["firm_bids_per_month"] - 3 / (50 / 30.44)) < 1e-12
    assert (got["g"]["firm_has_amounts"], got["g"]["firm_bid_spread"], got["g"]["firm_interactions"]) == (0.0, 0.0, 1.0)
    assert got["new"]["firm_days_since_last"] == 3650.0 and sum(v for k, v in got["new"].items() if k not in ("canonical_id", "firm_days_since_last")) == 0.0
    pairs = spark.createDataFrame([("f", "n1", "works", "b1", "QC", 2000.0, [3.0, 4.0], [4.0, 3.0]), ("new", "n2", "works", "b1", None, None, None, [1.0])], "canonical_id string, ocid string, category string, buyer_id string, region string, value double, firm_embedding array<double>, tender_embedding array<double>")
    c = {r.canonical_id: r.asDict() for r in features.cross_features(pairs, inter, history, day).collect()}
    assert (c["f"]["cross_category_share"], c["f"]["cross_buyer_prior_bids"], c["f"]["cross_buyer_prior_wins"], c["f"]["cross_region_seen"], c["f"]["cross_value_ratio"]) == (2 / 3, 2.0, 2.0, 1.0, 1.0)
    assert abs(c["f"]["cross_embedding_similarity"] - 0.96) < 1e-12 and abs(c["f"]["cross_value_fit"] - math.exp(-0.5 * (1 / 0.75) ** 2)) < 1e-12
    assert all(c["new"][n] == 0.0 for n in features.CROSS)
    t = spark.createDataFrame([("Travaux", None, 99.0, "abc"), (None, 3, None, None)], "category string, bidder_count int, value double, title string").select(*features.tender_columns()).collect()
    assert tuple(t[0]) == (1.0, math.log1p(99.0), 0.0, 3.0, 1.0, 0.0, 0.0) and tuple(t[1]) == (0.0, 0.0, 3.0, 0.0, 0.0, 0.0, 0.0)
    assert len(features.NAMES) == 31 and features.group_of("firm_wins") == "firm" and features.group_of("x") == "other"


def test_awards_and_lookup(spark):
    index = spark.createDataFrame([("2023-Q1", 100.0), ("2023-Q2", 110.0), ("2023-Q4", 120.0)], "quarter string, value double")
    rows = spark.createDataFrame([(1, "2023-02-01", 1000.0), (2, "2023-08-01", 1000.0), (3, "2022-12-31", 1000.0), (4, "2025-01-01", 1000.0), (5, None, 1000.0)], "i int, day string, amount double").withColumn("day", F.col("day").cast("date"))
    assert {r.i: r.adjusted for r in awards.adjusted(rows, index).collect()} == {1: 1200.0, 2: None, 3: None, 4: 1000.0, 5: None}
    past = [("road", "municipal", "QC", 100.0 + k) for k in range(12)] + [("road", "federal", None, 500.0 + k) for k in range(11)] + [("road", "federal", "ON", 700.0)] + [(None, "health", "QC", 50.0)] * 12
    found = awards.cells(spark.createDataFrame(past, "slug string, buyer_type string, region string, adjusted double"))
    asked = spark.createDataFrame([(1, "road", "municipal", "QC"), (2, "road", "federal", None), (3, "road", "health", "AB"), (4, None, "health", "QC"), (5, "x", "y", "z")], "i int, slug string, buyer_type string, region string")
    got = {r.i: (r.level, r.estimate) for r in awards.estimates(asked, found).collect()}
    assert got[1] == (0, 105.5) and got[2][0] == 1 and got[3][0] == 3 and got[4] == (4, 50.0) and got[5][0] == 5
    bands = spark.createDataFrame([("Travaux MINEURS",), ("Phase 2 du projet",), ("Travaux mineurs, phase 2",), (None,)], "t string").select(awards.pattern_band(F.col("t"), [r"\bphase\s*[0-9]+\b"], [r"\btravaux mineurs\b"], ("big", "little")).alias("b")).collect()
    assert [r.b for r in bands] == ["little", "big", "unknown", "unknown"]


def test_places_equal_a_full_sort(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 7)
    r = random.Random(5)
    pool = [(i * 3, r.choice("abcde")) for i in range(100)]
    scores = [(f, c, r.choice([0.5, 0.25, 0.25, 0.0])) for f in range(6) for c in "abcd" if r.random() < 0.7]
    positives = [(f, r.choice(pool)[0]) for f in range(7) for _ in range(4)]
    positives = sorted(set(positives))
    of = {(f, c): s for f, c, s in scores}
    want = {(f, i): 1 + sorted(pool, key=lambda p: (-of.get((f, p[1]), 0.0), p[0])).index((i, dict(pool)[i])) for f, i in positives}
    got = ranking.places(spark.createDataFrame(pool, "ocid long, category string"), spark.createDataFrame(scores, "firm_id int, category string, score double"), spark.createDataFrame(positives, "firm_id int, ocid long"))
    assert {(x.firm_id, x.ocid): x.place for x in got.collect()} == want


def test_boards(spark):
    cases = [(["roadwork"], ["roadwork"], True), (["facility_maintenance", "landscaping", "building", "roadwork"], ["roadwork"], False), (["roadwork", "landscaping"], ["roadwork"], True), (["hvac"], ["roadwork"], False), ([], ["roadwork"], False), (None, ["roadwork"], False)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a array<string>, b array<string>").select("i", boards.on_trade(F.col("a"), F.col("b")).alias("t")).collect()
    assert {r.i: r.t for r in rows} == {i: c[2] for i, c in enumerate(cases)}
    cases = [("ON", ["ON"], True), ("QC", ["ON"], False), (None, ["ON"], True), ("CA", ["ON"], True), ("QC, ON", ["ON"], True), ("QC", [], True)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b array<string>").select("i", boards.region_allows(F.col("a"), F.col("b")).alias("t")).collect()
    assert {r.i: r.t for r in rows} == {i: c[2] for i, c in enumerate(cases)}
    row = spark.range(1).select(boards.size_points(F.lit("<$100K"), F.lit("<$100K")), boards.size_points(F.lit("<$100K"), F.lit("$100–500K")), boards.size_points(F.lit("<$100K"), F.lit(">$10M")), boards.size_points(F.lit("unknown"), F.lit(">$10M")), boards.absolute_fit(F.lit(-3.1)), boards.value_points(F.lit(5.0), F.lit(5.0)), boards.value_points(F.lit(None).cast("double"), F.lit(5.0)), boards.deterministic_score(F.lit(1.0), F.lit(9.0), F.lit(0.5))).first()
    assert tuple(row) == (8.0, 0.0, -18.0, 0.0, 50.0, 10.0, 0.0, 75.0)
    skew = boards.province_skew(spark.createDataFrame([(1, "QC"), (1, "QC"), (1, "ON"), (1, "QC,ON"), (2, None), (3, "ON")], "f int, region string"), ["f"]).collect()
    assert {r.f: (r.province, r.share) for r in skew} == {1: ("QC", 0.5), 3: ("ON", 1.0)}


# packing and trees


def test_packing_equals_a_plain_loop(spark):
    r = random.Random(4)
    pages = [(f, p, "x" * r.choice([0, 5, 40, 90, 400])) for f in range(8) for p in range(1, r.randint(2, 12))]
    got = {}
    for x in packing.pack_pages(spark.createDataFrame(pages, "file long, page long, text string"), 120, 1).collect():
        got.setdefault(x.file, []).append((x.first_page, x.last_page, x.n_chars))
    for f in range(8):
        mine = [(p, len(f"\n[PAGE {p}]\n") + len(t)) for g, p, t in pages if g == f]
        want, at = [], 0
        while at < len(mine):
            total, end = 0, at
            while end < len(mine) and (end == at or total < 120 and total + mine[end][1] <= 120):
                total += mine[end][1]
                end += 1
            want.append((mine[at][0], mine[end - 1][0], total))
            at = end - 1 if end - 1 > at else end
        assert sorted(got[f]) == sorted(want)


def test_dedup_equals_a_plain_loop(spark):
    r = random.Random(6)
    rows = [(t, p, r.choice(["ab", "abc", "b", "xyz", "xy", "q", "abcd"])) for t in range(10) for p in range(9)]
    got = sorted((x.tender, x.pos) for x in packing.greedy_dedup(spark.createDataFrame(rows, "tender long, pos long, quote string")).collect())
    want = []
    for t in range(10):
        kept = []
        for _, p, q in [x for x in rows if x[0] == t]:
            if not any(q in k or k in q for k in kept):
                kept.append(q)
                want.append((t, p))
    assert got == sorted(want)


def test_trees_equal_a_plain_walk(spark):
    r = random.Random(7)
    forest = trees.sample_forest(5, 3, 6)
    vectors = [[0.0] * 6, [1.0] * 6, [0.5] * 6, [float("nan")] * 6, *([r.uniform(-1, 1) * k for _ in range(6)] for k in (1, 10, 1000) for _ in range(7))]

    def walk(tree, x, at=0):
        feature, threshold, left, right, value = tree[at]
        if feature < 0:
            return value
        return walk(tree, x, left if math.isnan(x[feature]) or x[feature] <= threshold else right)

    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "i int, v array<double>").select("i", trees.tree_scores(F.col("v"), forest).alias("s")).collect()
    assert all(abs(x.s - sum(walk(t, vectors[x.i]) for t in forest)) < 1e-6 for x in rows)


# sources and sinks


def test_federal_csv(spark, tmp_path):
    head = "title-titre-eng,title-titre-fra,referenceNumber-numeroReference,publicationDate-datePublication,tenderClosingDate-appelOffresDateCloture,tenderStatus-appelOffresStatut-eng,gsinDescription-nibsDescription-eng,gsin-nibs,unspsc,unspscDescription-eng,procurementCategory-categorieApprovisionnement,regionsOfOpportunity-regionAppelOffres-eng,regionsOfDelivery-regionsLivraison-eng,contractingEntityName-nomEntitContractante-eng,contractingEntityAddressProvince-entiteContractanteAdresseProvince-eng,noticeURL-URLavis-eng,attachment-piecesJointes-eng,tenderDescription-descriptionAppelOffres-eng"
    rows = [
        'Rental,LOCATION,cb-1,2026-07-08,2026-08-28T14:00:00,Open,,,*22100000,*Heavy,*CNST,*Canada,*Ontario,Department of Defence,Ontario,,"https://x.example/a.pdf,https://x.example/a.pdf","Line one\n\nsays ""two"""',
        "Advice,Avis,mx-2,2025-10-29,2025-11-26T13:00:00,Open,,,,,*SRV,,,City of Ottawa,Ontario,https://m.example/1,,text",
        "No number,x, ,2025-10-29,2025-11-26,Open,,,,,,,,,,,,",
    ]
    (tmp_path / "n.csv").write_text("﻿" + head + "\n" + "\n".join(rows) + "\n", encoding="utf-8")
    got = {r.source_id: r for r in federal_csv.read(spark, str(tmp_path / "n.csv"), now()).collect()}
    assert set(got) == {"cb-1", "mx-2"}
    a, b = got["cb-1"], got["mx-2"]
    assert (a.title, a.category_normalized, a.region, a.buyer_type, a.status, a.documents_open, a.attachments) == ("Rental", "construction", "ON", "federal", "open", True, ["https://x.example/a.pdf"])
    assert a.description == 'Line one\n\nsays "two"' and a.notice_url is None and a.closing_date == "2026-08-28T14:00:00"
    assert (b.category_normalized, b.region, b.buyer_type, b.status, b.documents_open) == ("services", "ON", "municipal", "closed", False)
    with pytest.raises(ValueError, match="closing_date"):
        federal_csv.headers(["title-eng", "referenceNumber"])
    assert federal_csv.headers(head.split(","))["description"].startswith("tenderDescription") and federal_csv.headers(head.split(","))["unspsc"] == "unspsc"


def release(ocid, date, title="Road", **more):
    tender = {"title": title, "status": "active", "mainProcurementCategory": "works", "additionalProcurementCategories": ["Travaux de construction"], "tenderPeriod": {"startDate": date, "endDate": "2026-08-27T11:00:00-04:00"}, "items": [{"classification": {"id": "72000000"}}], "documents": [{"url": "ftp://x"}, {"url": "https://s.example/1"}]} | more.pop("tender", {})
    return {"ocid": ocid, "date": date, "tag": ["tender"], "buyer": {"id": "OP-1", "name": "Centre X"}, "parties": [{"id": "OP-2", "roles": ["buyer"]}, {"id": "OP-1", "name": "Centre X", "details": {"municipal": "1"}, "address": {"region": "QC"}}], "tender": tender} | more


def test_releases(spark, tmp_path):
    week1 = [release("o1", "2026-07-20", "Old title", tender={"value": {"amount": 653199}}), release("o2", "2026-07-21", tag=["contract"], bids=[{"id": "F1", "value": 10}, {"id": "F2", "value": "x"}], awards=[{"suppliers": [{"id": "F2"}, {"id": "F3"}]}], tender={"tenderers": [{"id": "F1", "name": "One"}, {"id": "", "name": "none"}, {"id": "F2", "name": "Two"}]}), {"ocid": "o3"}, release("", "2026-07-20"), release("o4", "2026-07-20", " ")]
    week2 = [release("o1", "2026-07-28", "New title"), release("o1", "2026-07-27", "Middle"), release("o2", "2026-07-29", bids=[{"id": "F1", "value": 99}, {"id": "F2", "value": 20}], tender={"tenderers": [{"id": "F1"}]})]
    for name, rows in (("hebdo_20260720_20260726.json", week1), ("hebdo_20260727_20260802.json", week2)):
        (tmp_path / name).write_text(json.dumps({"releases": rows}))
    (tmp_path / "hebdo_20260803_20260809.json").write_text("{not json")
    read = releases.read(spark, str(tmp_path))
    got = {r.source_id: r for r in releases.newest(releases.notices(read, now())).collect()}
    assert set(got) == {"o1", "o2"}
    assert (got["o1"].title, got["o1"].category_normalized, got["o1"].region, got["o1"].buyer_type, got["o1"].status, got["o1"].notice_url) == ("New title", "construction", "QC", "municipal", "open", "https://s.example/1")
    first = releases.notices(read, now()).where("title = 'Old title' or file like '%0726%' and source_id = 'o2'").collect()
    assert sorted((r.source_id, r.estimated_value, r.currency, r.status) for r in first) == [("o1", 653199.0, "CAD", "open"), ("o2", None, None, "awarded")]
    took = releases.participants(read)
    fold = {r.firm_id: (r.won, r.bid_amount, r.name) for r in releases.folded(took, ["firm_id", "ocid"], ["file", "place"]).collect()}
    assert fold == {"F1": (0, 10.0, "One"), "F2": (1, None, "Two"), "F3": (1, None, None)}
    res = spark.createDataFrame([("hebdo_20260727_20260802.json", "u1", 0), ("Mensuel_202607.json", "u2", 1), ("x", "http://y/hebdo_20260720_20260726.json", 2), ("HEBDO_20260727_20260802.json", "u4", 3), ("hebdo_20261340_20261341.json", "u5", 4), ("hebdo_20260713_20260719.json", "", 5)], "name string, url string, pos int")
    assert [(r.name, r.url) for r in releases.weekly(res).collect()] == [("hebdo_20260727_20260802.json", "u1"), ("hebdo_20260720_20260726.json", "http://y/hebdo_20260720_20260726.json")]


def test_small_sources(spark, tmp_path):
    (tmp_path / "r.csv").write_text('municipality,tier\n"<a href=""https://a.example/"">Town of A</a>",Lower\nPlain B,Upper\n,Upper\n', encoding="utf-8")
    assert sorted((r.name, r.website) for r in tables.roster(spark, str(tmp_path / "r.csv"), "municipality").collect()) == [("Plain B", None), ("Town of A", "https://a.example/")]
    (tmp_path / "p.csv").write_text("﻿REF_DATE,GEO,Type,VALUE\n2024-01,Quebec,N,100.5\n2024-07,Quebec,N,101\n2024-07,Ontario,N,1\n2024-10,Quebec,N,\n", encoding="utf-8")
    assert sorted(map(tuple, tables.price_index(spark, str(tmp_path / "p.csv"), {"GEO": "Quebec", "Type": "N"}).collect())) == [("2024-Q1", 100.5), ("2024-Q3", 101.0)]
    html = '<table><tr><th>x</th></tr><tr><td>R-1</td><td><a href="/help">?</a><a href="/Tender/Detail/ab-1?x=1">Road <b>works</b></a></td><td>Tuesday, August 18, 2026 2:00:00 PM (EDT)</td><td>Open</td></tr><tr><td><a href="/Tender/Detail/ab-1">again</a></td></tr><tr><td><a href="/Tender/Detail/cd-2">Old one</a></td><td>Monday, June 1, 2026 9:05 AM</td></tr><tr><td><a href="/Tender/Detail/e"> </a></td></tr></table>'
    pages = spark.createDataFrame([("https://www.t.example/list", html, "Town", None), ("https://e.example", None, None, None)], "url string, html string, buyer_name string, region string")
    got = {r.source_id: r for r in tables.listings(pages, now=now()).collect()}
    assert set(got) == {"t.example:ab-1", "t.example:cd-2"}
    r = got["t.example:ab-1"]
    assert (r.title, r.category_normalized, r.region, r.status, str(r.closing_date)) == ("Road works", "construction", "ON", "open", "2026-08-18 14:00:00") and got["t.example:cd-2"].status == "closed"


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "keep"), (2, "b", None)], "k int, v string, verdict string")
    new = spark.createDataFrame([(2, "B", "x"), (3, "C", "y"), (3, "C", "y"), (None, "n", "z")], "k int, v string, verdict string")
    assert sorted((r.k, r.v) for r in sinks.insert_or_ignore(old, new, ["k"]).collect()) == [(1, "a"), (2, "b"), (3, "C")]
    assert sorted((r.k, r.v) for r in sinks.replace_group(old, new.where("k = 2"), ["k"]).collect()) == [(1, "a"), (2, "B")]
    assert sorted((r.k, r.v, r.verdict) for r in sinks.keep_columns(old, new.where("k = 2"), ["k"], ["verdict"]).collect()) == [(1, "a", "keep"), (2, "B", None)]
    store = sinks.Snapshots(spark, str(tmp_path / "s"))
    assert store.current() is None
    store.write(old)
    store.write(new)
    assert store.current().count() == 4
    ranked = spark.createDataFrame([(1, "t,1", ["a", "b"]), (2, 'q"', [])], "rank int, title string, flags array<string>")
    sinks.export_labels(ranked, str(tmp_path / "l"))
    part = next((tmp_path / "l").glob("part-*.csv"))
    lines = part.read_bytes().decode("utf-8")
    assert lines.startswith("﻿rank,") and "a|b" in lines
    part = tmp_path / "labelled.csv"
    part.write_text(lines.replace('a|b,""', "a|b,Relevant"), encoding="utf-8")
    got = sinks.import_labels(spark, str(part), 2)
    assert [(r.rank, r.label) for r in got.orderBy("rank").collect()][0] == (1, "relevant")
    p = sinks.precision(spark.createDataFrame([(1, "relevant", True), (2, "marginal", True), (3, None, False), (4, "irrelevant", False)], "rank int, label string, mapped boolean"), 3).first()
    assert (p.labelled, p.relevant, p.precision_at_k) == (2, 1, 0.5)
    part.write_text("rank,label\n1,great\n", encoding="utf-8")
    with pytest.raises(ValueError, match="great"):
        sinks.import_labels(spark, str(part), 5)
    sinks.export_json(old, str(tmp_path / "j"))
    lines = [json.loads(x) for part in (tmp_path / "j").glob("part-*") for x in part.read_text().splitlines()]
    assert sorted(x["k"] for x in lines) == [1, 2] and all("verdict" in x for x in lines)


# streams


def test_streams_equal_their_batch_queries(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"))
    events.run_once(events.tumbling(stream), "tumble", str(tmp_path / "c1"))
    events.run_once(events.sessions(stream), "sessions", str(tmp_path / "c2"))
    from bidlake.plans import registry

    def rows(df, *cs):
        return sorted(tuple(str(r[c]) for c in cs) for r in df.collect())

    assert rows(spark.table("tumble"), "hour", "event_type", "n") == rows(registry.QUERIES["events_tumbling"](spark, sf), "hour", "event_type", "n")
    assert rows(spark.table("sessions"), "user_id", "session_start", "n") == rows(registry.QUERIES["events_sessions"](spark, sf), "user_id", "session_start", "n")


def test_upsert_stream_and_changes(spark, tmp_path):
    folder = tmp_path / "in"
    schema = "k long, v string, pos long"
    spark.createDataFrame([(1, "a", 1), (2, "b", 1), (2, "bb", 2), (None, "x", 1)], schema).coalesce(1).write.parquet(str(folder))
    store = sinks.Snapshots(spark, str(tmp_path / "out"))
    run = lambda day: events.upsert_stream(spark.readStream.schema(schema).parquet(str(folder)), store, ["k"], ["v"], ["pos"], F.lit(day).cast("timestamp"), str(tmp_path / "c"))
    run("2026-01-01")
    first = store.current()
    spark.createDataFrame([(2, "bb", 5), (3, "c", 1), (1, "A", 9)], schema).coalesce(1).write.mode("append").parquet(str(folder))
    run("2026-01-02")
    got = {r.k: (r.v, str(r.created_at)[:10], str(r.updated_at)[:10]) for r in store.current().collect()}
    assert got == {1: ("A", "2026-01-01", "2026-01-02"), 2: ("bb", "2026-01-01", "2026-01-01"), 3: ("c", "2026-01-02", "2026-01-02")}
    assert {r.k: r.change for r in events.changes(first, store.current(), ["k"], ["v"]).collect()} == {1: "changed", 3: "new"}


def test_rate_limits_keep_state(spark, tmp_path):
    times = [(i, "2026-01-01 00:00:%02d" % i, 7) for i in range(12)] + [(20, "2026-01-01 00:01:05", 7), (21, "2026-01-01 00:00:30", 8)]
    spark.createDataFrame(times, "event_id long, ts string, user_id long").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long").parquet(str(tmp_path / "in"))
    events.run_once(events.limited(stream, "user_id"), "limited", str(tmp_path / "c"), "append")
    got = {r.event_id: r.allowed for r in spark.table("limited").collect()}
    assert got == {**{i: i < 10 for i in range(12)}, 20: True, 21: True}


def test_medians_equal_percentiles(spark):
    r = random.Random(7)
    rows = [(r.choice(["a", "b", None, "one"]), r.choice([1.0, 1.0, 2.5, 2.5000001, 1e-9, 1e9, r.random() * 1e5, None, 0.0, -3.0])) for _ in range(300)] + [("single", 4.0), ("two", 4.0), ("two", 1e6), ("none", None)]
    frame = spark.createDataFrame(rows, "k string, v double")
    got = {x.k: (x.n, x.median) for x in awards.medians(frame, ("k",), "v").collect()}
    want = {k: [v for j, v in rows if j == k and v and v > 0] for k in {k for k, _ in rows}}
    assert got == {k: (len(v), statistics.median(v)) for k, v in want.items() if v}
    every = [v for _, v in rows if v and v > 0]
    assert [tuple(x) for x in awards.medians(frame, (), "v").collect()] == [(len(every), statistics.median(every))]
    assert awards.medians(frame.limit(0), (), "v").count() == 0


def test_best_estimates_by_tier(spark):
    past = [("road", "municipal", "QC", 200_000.0)] * 12 + [("road", "federal", "ON", 50_000.0)] * 3
    found = awards.cells(spark.createDataFrame(past, "slug string, buyer_type string, region string, adjusted double"))
    asked = [
        (1, 3e6, "road", "municipal", "QC", "x", 1.0), (2, -1.0, "road", "municipal", "QC", "x", 7e5), (3, None, "road", "municipal", "QC", "x", None), (4, None, "road", "health", "QC", "x", None),
        (5, None, "other", "health", "QC", "phase 2", None), (6, None, None, "municipal", "QC", "phase 2", 9e9), (7, None, "", "municipal", "QC", "travaux mineurs", None), (8, None, None, None, None, None, None),
    ]
    rows = spark.createDataFrame(asked, "i int, estimated_value double, slug string, buyer_type string, region string, title string, modelled double")
    got = {x.i: (x.band, x.source, x.confidence, x.level) for x in awards.best_estimates(rows, found, [r"\bphase\s*[0-9]+\b"], [r"\btravaux mineurs\b"], (">$10M", "<$100K")).collect()}
    assert got == {
        1: ("$2–10M", "published", 1.0, None), 2: ("$500K–2M", "estimated_model", 0.6, None), 3: ("$100–500K", "estimated_model", 0.7, 0), 4: ("$100–500K", "estimated_model", 0.6, 2), 5: ("$100–500K", "estimated_model", 0.3, 5),
        6: (">$10M", "estimated_pattern", 0.35, None), 7: ("<$100K", "estimated_pattern", 0.35, None), 8: ("unknown", "unknown", 0.0, None),
    }


def test_usual_size_and_accuracy(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("a", 3), ("b", 4), (None, 0), ("c", 0)], "v string, pos int")
    assert awards.usual(rows, "v", ["pos"]).first()[0] == "b"
    pairs = spark.createDataFrame([("<$100K", "<$100K"), ("<$100K", "$100–500K"), ("unknown", "unknown"), ("<$100K", ">$10M"), (None, ">$10M")], "g string, t string")
    assert tuple(awards.accuracy(pairs, F.col("g"), F.col("t")).first()) == (5, 0.2, 0.4)


def test_limits_do_not_count_refused_events(spark):
    r = random.Random(11)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=r.randrange(600), microseconds=r.choice([0, 0, 1, 999_999])), r.choice(["a", "a", "a", "b", None])) for i in range(300)] + [(900, None, "a")]
    got = {x.event_id: (x.allowed, x.retry_after) for x in events.limits(spark.createDataFrame(rows, "event_id long, ts timestamp, who string"), "who", ((10, 2), (60, 5))).collect()}
    want, hits = {900: (False, None)}, {}
    for i, ts, who in sorted((x for x in rows if x[1]), key=lambda x: (x[1], x[0])):
        mine, wait = hits.setdefault(who, []), None
        for seconds, most in ((10, 2), (60, 5)):
            recent = [t for t in mine if t > ts - dt.timedelta(seconds=seconds)]
            if len(recent) >= most and wait is None:
                wait = max(1, math.ceil(round((recent[0] + dt.timedelta(seconds=seconds) - ts).total_seconds(), 6)))
        mine += [ts] if wait is None else []
        want[i] = (wait is None, wait)
    assert got == want and sum(not a for a, _ in want.values()) > 50


def test_competitive_and_eligible(spark):
    day = lambda k: dt.date(2024, 1, k)
    rows = [("a", "o1", day(1)), ("b", "o1", day(1)), ("a", "o2", day(2)), ("a", "o2", day(2)), ("b", "o3", day(9)), ("c", "o3", day(9)), ("a", "o4", day(9)), ("b", "o4", None)]
    frame = spark.createDataFrame(rows, "canonical_id string, ocid string, date date")
    assert sorted((x.canonical_id, x.ocid, x.bidders) for x in features.competitive(frame).collect()) == [("a", "o1", 2), ("a", "o4", 2), ("b", "o1", 2), ("b", "o3", 2), ("b", "o4", 2), ("c", "o3", 2)]
    got = features.eligible(frame, F.lit("2024-01-05").cast("date"), F.lit("2024-01-10").cast("date"), 1).collect()
    assert sorted(map(tuple, got)) == [("a", 3, 1), ("b", 1, 1)]


def test_answers_live_for_their_time_across_restarts(spark, tmp_path):
    schema, start = "event_id long, ts timestamp, who string", dt.datetime(2024, 1, 1)
    at = lambda i, minutes, who: (i, start + dt.timedelta(minutes=minutes), who)
    parts = [[at(1, 0, "a"), at(2, 30, "a"), at(3, 61, "a"), at(4, 5, "b")], [at(5, 100, "a"), at(6, 64, "b"), at(7, 121, "a")], [at(8, 300, "c"), at(9, 300, "b")], [at(10, 310, "a"), at(11, 355, "b"), at(12, 359, "c"), at(13, 360, "c")]]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = events.asked_again(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "who", 3600)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()  # a new query from the same checkpoint
    got = {x.event_id: x.cached for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: True, 6: True, 7: False, 8: False, 9: False, 10: False, 11: True, 12: True, 13: False}
    every = spark.createDataFrame([x for rows in parts for x in rows], schema)
    assert {x.event_id: not x.allowed for x in events.limits(every, "who", ((3600, 1),)).collect()} == got


def test_best_notices_by_cells_equal_all_pairs(spark):
    r = random.Random(13)
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    slugs = ["a", "b", "c", "d"]
    some = lambda values, k: r.sample(values, r.randrange(k))
    notices = []
    for i in range(260):
        own = some(slugs, 4)
        notices.append((
            i, r.choice(["open", "open", "open", "closed", "unknown", " Open"]), r.choice([None, *(dt.datetime(2024, 3, 1) + dt.timedelta(days=d, hours=5) for d in (0, 1, 4, 9, 30, 200))]), own, {s: r.choice(["title", "description"]) for s in own},
            "mapped" if own else r.choice(["unmapped", "non_construction"]), r.choice([True, False]), r.choice([None, "", "QC", "ON", "QC,ON", "CA", "AB"]), r.choice([None, "municipal", "federal", "health"]), r.choice([None, 50.0, 100.0, 1e5, 2e5, 1e6]),
        ))
    firms = [(k, some(slugs, 3), some(["quebec", "ontario_any", "federal_any", "x"], 3), some(["municipal", "federal", "hospital"], 3), r.choice([None, 60.0]), r.choice([None, 5e5]), r.choice([[], [1e5], [1e5, 3e5, 50.0], None])) for k in range(25)]
    schema = "notice_id int, status string, closing_utc timestamp, trade_slugs array<string>, slug_sources map<string,string>, mapping_status string, construction_marked boolean, region string, buyer_type string, estimated_value double"
    notices = spark.createDataFrame(notices, schema)
    firms = spark.createDataFrame(firms, "firm_id int, trades array<string>, regions array<string>, buyer_type_preferences array<string>, value_min double, value_max double, baseline_values array<double>")
    kin = {"a": "f", "b": "f", "c": "g"}
    keys = ["firm_id", "place", "notice_id", "base_score", "value_modifier", "final_score"]
    for top in (1, 3, 500):
        want = scoring.ranked(scoring.score(filters.evaluate(filters.against(notices, firms), kin, now).where("included")), top).select(keys)
        got = scoring.best(notices, firms, kin, now, top)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > 300 and scoring.best(notices.limit(0), firms, kin, now, 3).count() == 0


def test_federal_csv_in_either_encoding(spark, tmp_path):
    head = "referenceNumber-numeroReference,title-titre-eng,tenderClosingDate-appelOffresDateCloture"
    for name, data in (("bom", f"﻿{head}\nA1,Égouts,2030-01-01\n".encode()), ("latin", f"{head}\nA1,Égouts,2030-01-01\n".encode("latin-1"))):
        (tmp_path / f"{name}.csv").write_bytes(data)
        assert [(r.source_id, r.title) for r in federal_csv.read(spark, str(tmp_path / f"{name}.csv"), now()).collect()] == [("A1", "Égouts")]
    assert federal_csv.encoding_of(spark, str(tmp_path / "bom.csv")) == "UTF-8" and federal_csv.encoding_of(spark, str(tmp_path / "latin.csv")) == "ISO-8859-1"


def test_funnel_counts_each_step(spark):
    rows = [
        ("Ontario", "*CNST", "x", "y", "2030-01-01", "https://a.ca/x"), ("QC, ON", None, "New road", None, "2030-01-01T10:00:00Z", None), ("Ontario", "*SRV", "broadroad", None, "2030-01-01", None), ("Quebec", "*CNST", "x", None, "2030-01-01", None),
        ("ontario", "cnst", None, None, "2020-01-01", "http://b.ca|x"), ("Ontario", "*CNST", None, None, "soon", None), (None, "*CNST", None, None, None, None), ("London", None, "a", "the sewer", None, None),
    ]
    frame = spark.createDataFrame(rows, "regions string, category string, title string, description string, closing_date string, attachments string")
    assert tuple(federal_csv.funnel(frame, "Ontario", F.lit("2026-01-01").cast("timestamp")).first()) == (8, 5, 4, 3, 1, 2, 1, 1, 2, 1, 1)
    assert federal_csv.funnel(frame, "", F.lit("2026-01-01").cast("timestamp")).first().in_region == 8 and federal_csv.funnel(frame, "quebec", F.lit("2026-01-01").cast("timestamp")).first().in_region == 1


def test_only_what_changed_is_given_back(spark):
    rows = spark.createDataFrame([(1, 10, "a"), (2, None, "b"), (3, 30, None), (4, 40, "d")], "k int, x int, y string")
    new = {"x": F.when(F.col("k") == 4, 41).when(F.col("k") != 2, F.col("k") * 10), "y": F.when(F.col("k") == 3, "c").otherwise(F.col("y"))}
    assert sorted(map(tuple, upsert.recomputed(rows, ["k"], new).collect())) == [(3, 30, "c"), (4, 41, "d")]


def test_values_outside_bounds_either_way(spark, monkeypatch):
    r = random.Random(3)
    values = [(r.choice("ab"), r.choice([1.0, 5.0, 5.000001, 1e6, -3.0, 0.0, r.random() * 100])) for _ in range(200)]
    bounds = [(1.0, 5.0), (5.0, 5.0), (-10.0, 1e9), (0.0, 50.0), (200.0, 300.0), (1.0, 50.0)]
    want = {(c, lo, hi): n for c in "ab" for lo, hi in bounds if (n := sum(k == c and not lo <= v <= hi for k, v in values))}
    frames = spark.createDataFrame(values, "cell string, v double"), spark.createDataFrame(bounds, "value_min double, value_max double")
    for most in (500, 3):
        monkeypatch.setattr(domain, "MOST_MARKS", most)
        assert {(x.cell, x.value_min, x.value_max): x.out for x in domain.below_and_above(*frames).collect()} == want
