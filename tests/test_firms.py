"""Firms by typed names, firms that are one, histories and profiles, on literal frames against plain versions."""

import datetime as dt
import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from bidlake.functions import text
from bidlake.operators import asof, entities, firms

INDEX = "firm_id string, name string, bids int, last string"


def plain_lookup(typed, index, limit=6):
    """Rule by rule over all names."""
    suffix = re.compile(rf"( ({'|'.join(text.LEGAL_FORMS)}))+$")
    normal = suffix.sub("", re.sub("[^a-z0-9]+", " ", text.plain_fold(typed)).strip())
    names = sorted({n for _, n, _, _ in index if n})

    def resolved(chosen, confidence):
        best = {}
        for i, n, bids, last in index:
            if n in chosen:
                best[i] = max(best.get(i, (bids, last or "")), (bids, last or ""))
        ordered = sorted(best, key=lambda i: i)
        ordered.sort(key=lambda i: best[i], reverse=True)
        return ("match" if len(ordered) == 1 else "ambiguous", confidence, ordered[:limit])

    if not normal:
        return "none", None, []
    if normal in names:
        return resolved({normal}, "exact")
    words = normal.split()
    if len(words) > 8:
        return "none", None, []
    begins = {n for n in names if n.startswith(normal + " ") or normal.startswith(n + " ")}
    if len(normal) >= 6 and len(words) >= 2 and begins:
        return resolved(begins, "prefix")
    if len(normal) >= 5 and (re.search(rf"\b({'|'.join(firms.MARKERS)})\b", typed, re.I | re.A) or "&" in typed):
        share = {n: len(set(words) & set(n.split())) / len(set(words) | set(n.split())) for n in names}
        near = sorted((n for n in names if share[n] >= 0.75), key=lambda n: -share[n])[:limit]
        if near:
            return resolved(set(near), "fuzzy")
    return "none", None, []


def test_lookup_equals_a_plain_search(spark):
    r = random.Random(2)
    vocabulary = ["groupe", "nord", "pavage", "construction", "abc", "excavation", "est", "bergeron", "ring", "a"]
    name = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 6)))
    index = [(f"f{i:03}", name(), r.randrange(4), r.choice([None, "2024-01-01", "2025-02-03"])) for i in range(150)] + [("x", None, 3, None), ("y", "", 3, None), ("z", "construction", 9, None), ("p", "alpha beta gamma delta", 2, None), ("q", "alpha beta gamma omega", 2, "2024-01-01"), ("f001", "second name of one", 1, None)]
    typed = [r.choice(["", "Les ", "& "]) + r.choice([str.title, str.upper, str])(name()) + r.choice(["", " Inc.", " Ltée inc", " of the west coast", " S.E.N.C."]) for _ in range(400)]
    typed += ["", "  ", "!!", "inc", "Inc. Ltd", "a b c d e f g h i", None, "Économie Québec", "second name of", "beta alpha gamma inc", "beta alpha gamma"]
    got = {x.asked: (x.kind, x.confidence, list(x.candidates)) for x in firms.lookup(spark.createDataFrame([(t,) for t in typed], "asked string"), spark.createDataFrame(index, INDEX)).collect()}
    want = {t: plain_lookup(t, index) for t in typed if t is not None}
    assert got == want
    assert {v[:2] for v in want.values()} >= {(k, c) for k in ("match", "ambiguous") for c in ("exact", "prefix", "fuzzy")} | {("none", None)}


def test_lookup_of_empty_tables(spark):
    none, one = spark.createDataFrame([], INDEX), spark.createDataFrame([("Groupe Nord Inc",)], "asked string")
    assert [tuple(x) for x in firms.lookup(one, none).collect()] == [("Groupe Nord Inc", "groupe nord", "none", None, [])]
    assert firms.lookup(one.limit(0), none).count() == 0


def test_what_could_be_a_name(spark):
    texts = ["Excavation Bergeron", "watermain replacement, $200K", "small jobs", "we do roads", "we doodle", "a b c d e f g h i", "", None, "...", "CIMA+ S.E.N.C."]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    assert [x[0] for x in rows.select(firms.could_be_name(F.col("t"))).collect()] == [True, False, False, False, True, False, False, False, False, True]
    marked = ["ABC ltée", "incense", "Co-op", "A&B", "groupe", "constructions x", "ltéee"]
    assert [x[0] for x in spark.createDataFrame(list(enumerate(marked)), "i int, t string").orderBy("i").select(firms.company_marked(F.col("t"))).collect()] == [True, False, True, True, True, True, False]


def plain_merge(firms, numbers, bids):
    root = {f: f for f in firms}

    def find(x, root):
        while root[x] != x:
            x = root[x]
        return x

    def union(pairs, root):
        for a, b in pairs:
            a, b = find(a, root), find(b, root)
            root[max(a, b)] = min(a, b)

    union([(a, b) for a, x in numbers for b, y in numbers if x == y and x], root)
    business = {f: find(f, root) for f in firms}
    on = {}
    for f, o in bids:
        on.setdefault(o, set()).add(business[f])
    rivals = {frozenset((a, b)) for members in on.values() for a in members for b in members if a != b}
    by_name = {}
    for f, n in firms.items():
        if n:
            by_name.setdefault(n, set()).add(business[f])
    apart, top = {}, {b: b for b in business.values()}
    free = {}
    for n, members in by_name.items():
        if len(members) > 1 and any(frozenset((a, b)) in rivals for a in members for b in members):
            apart[n] = (len(members), "rivals")
        elif len(members) > 1:
            free[n] = members
            union([(a, b) for a in members for b in members], top)
    comp = {b: find(b, top) for b in top}
    broken = {comp[a] for a in comp for b in comp if a != b and comp[a] == comp[b] and frozenset((a, b)) in rivals}
    for n, members in free.items():
        if any(comp[b] in broken for b in members):
            apart[n] = (len(members), "chained_rivals")
    linked = {b for members in free.values() for b in members if comp[b] not in broken}
    out = {}
    for f in firms:
        b = business[f]
        same = sum(x == b for x in business.values())
        out[f] = (firms[f], comp[b] if b in linked else b, "name_no_rivalry" if b in linked else "shared_number" if same > 1 else "identifier", sum(x == f for x, _ in bids))
    return out, apart


@pytest.mark.parametrize("seed", range(3))
def test_merges_equal_union_find(spark, seed):
    r = random.Random(seed)
    firms_ = {i: r.choice([None, *(f"n{k}" for k in range(25))]) for i in range(80)}
    numbers = [(i, r.choice(["", *(f"x{k}" for k in range(60))])) for i in range(80) if r.random() < 0.7] + [(i, f"chain{i // 2}") for i in range(60, 80)] + [(i + 1, f"chain{i // 2}") for i in range(61, 79, 2)]
    bids = [(r.randrange(80), f"o{r.randrange(200)}") for _ in range(250)]
    frames = spark.createDataFrame(list(firms_.items()), "firm_id int, name string"), spark.createDataFrame([*numbers, (999, "x1"), (3, None)], "firm_id int, number string"), spark.createDataFrame([*bids, (998, "o1"), (4, None)], "firm_id int, ocid string")
    got, apart = entities.merged(*frames)
    want = plain_merge(firms_, numbers, bids)
    assert {x.firm_id: (x.normalized_name, x.canonical_id, x.merge_rule, x.observations) for x in got.collect()} == want[0]
    assert {x.normalized_name: (x.businesses, x.why) for x in apart.collect()} == want[1]


def test_components_of_stars_and_chains(spark):
    star = [(i, "hub") for i in range(100, 160)]
    chain = [(i, f"c{i}") for i in range(200, 300)] + [(i + 1, f"c{i}") for i in range(200, 299)]
    frame = spark.createDataFrame([*star, *chain, (7, None), (8, "own"), (8, "own")], "id int, key string")
    got = {x.id: x.component for x in entities.linked(frame).collect()}
    assert got == {**{i: 100 for i in range(100, 160)}, **{i: 200 for i in range(200, 300)}, 8: 8}
    assert entities.linked(frame.limit(0)).count() == 0


def test_most_common_name_and_ties(spark):
    seen = [("a", "X", 1), ("a", "Y", 2), ("a", "Y ", 3), ("b", "Q", 5), ("b", "P", 6), ("b", "P", 9), ("b", "Q", 9), ("c", " ", 1), (None, "Z", 1), ("d", "M", 4), ("d", "L", 4)]
    got = entities.common_names(spark.createDataFrame(seen, "firm_id string, name string, pos int"), ["pos"]).collect()
    assert {x.firm_id: x.name for x in got} == {"a": "Y", "b": "Q", "d": "L"}


@pytest.mark.parametrize("most", [10**6, 7, 0])
def test_histories_as_of_each_day(spark, monkeypatch, most):
    monkeypatch.setattr(asof, "MOST_AMOUNTS", most)
    r = random.Random(3)
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
    rows = [(r.choice(["a", "a", "a", "b", "c"]), day(r.randrange(12)), r.choice([0, 1, None]), r.choice([None, 0.0, -4.0, float("nan"), float("inf"), 5e-324, 1.0, 1.0, 2.5, 1e9, 1e9 + 1e-6, r.random() * 1000]), r.choice([None, "x", "y", "z"])) for _ in range(150)]
    rows += [("d", None, 1, 2.0, "x"), ("e", day(3), 1, 2.0, "x"), rows[0], rows[0]]
    got = {(x.firm_id, x.day): x for x in asof.histories(spark.createDataFrame(rows, "firm_id string, day date, won int, amount double, buyer_id string")).collect()}
    assert set(got) == {(f, d) for f, d, *_ in rows if d}
    for (firm, d), x in got.items():
        past = [q for q in rows if q[0] == firm and q[1] and q[1] < d]
        paid = [q[3] for q in past if q[3] is not None and 0 < q[3] < math.inf]
        assert (x.bids, x.wins, x.buyers, x.amounts) == (len(past), sum(q[2] or 0 for q in past), len({q[4] for q in past} - {None}), len(paid))
        assert (x.first_day, x.last_day) == ((min(q[1] for q in past), max(q[1] for q in past)) if past else (None, None))
        assert x.median_bid == (statistics.median(paid) if paid else None)
        assert (x.spread is None) == (not paid) and (not paid or abs(x.spread - statistics.pstdev(map(math.log1p, paid))) < 1e-6)


def test_histories_of_an_empty_table(spark):
    assert asof.histories(spark.createDataFrame([], "firm_id string, day date, won int, amount double, buyer_id string")).count() == 0
