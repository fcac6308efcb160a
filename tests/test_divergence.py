"""Ranks of eight-bit vectors against all pairs in plain Python."""

import numpy as np
import pytest

from bidlake.operators import divergence


def plain(firms, tenders, factor):
    unit = lambda v: v / np.linalg.norm(v) if v.any() else v
    out = {}
    for name, v in firms:
        v = np.array(v, float)
        scale = (np.abs(v).max() or 1.0) / 127
        q = np.clip(np.round(v / scale), -127, 127)
        ids = [i for i, t in tenders if t and None not in t and np.isfinite(t).all() and len(t) == len(v)]
        x = [unit(np.array(t, float)) for i, t in tenders if i in ids]
        e, a = ([round(float(t @ unit(c)), 12) for t in x] for c in (v, q))
        order = lambda s: {ids[k]: p for p, k in enumerate(sorted(range(len(ids)), key=lambda k: (-s[k], ids[k])))}  # noqa: E731, B023
        pe, pa = order(e), order(a)
        error = max(abs(s - t) for s, t in zip(e, a))
        turns = sum(e[i] - e[j] > factor * error and pa[ids[i]] > pa[ids[j]] for i in range(len(ids)) for j in range(len(ids)))
        first = lambda p: [i for i, _ in sorted(p.items(), key=lambda kv: kv[1])][:10]
        out[name] = (len(ids), round(error, 9), max(abs(pe[i] - pa[i]) for i in ids), first(pe) != first(pa), turns)
    return out


@pytest.mark.parametrize("factor", [0.0, 0.3, 1.0, 2.0])
def test_divergence_equals_all_pairs(spark, monkeypatch, factor):
    monkeypatch.setattr(divergence, "BLOCK", 50)
    r = np.random.default_rng(1)
    base = r.standard_normal(12)
    firms = [(f"f{k}", [float(x) for x in base + r.standard_normal(12) * 0.3]) for k in range(4)] + [("coarse", [1000.0] + [3.9] * 11), ("zero", [0.0] * 12)]
    tenders = [(i, [float(x) for x in base + r.standard_normal(12) * 0.02]) for i in range(180)] + [(500 + i, [1.0] * 12) for i in range(10)]
    tenders += [(600, [0.0] * 12), (601, None), (602, [float("nan")] * 12), (603, [1.0, 2.0]), (604, [None] * 12)]
    each = divergence.by_firm(spark.createDataFrame(firms, "firm_id string, vector array<double>"), spark.createDataFrame(tenders, "tender_id long, vector array<double>"), factor)
    got = {x.firm_id: (x.tenders, round(x.max_cosine_error, 9), x.max_rank_shift, x.changed_first, x.reorderings) for x in each.collect()}
    want = plain(firms, tenders, factor)
    assert got == want and (any(v[4] for v in want.values()) or factor >= 1)


def test_turned_pairs():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 40, 129):
        e, p = np.round(r.random(n), 1), r.permutation(n)
        assert divergence.turned(e.copy(), p, 0.15) == sum(e[i] > e[j] + 0.15 and p[i] > p[j] for i in range(n) for j in range(n))


def test_divergence_of_empty_tables(spark):
    firms, tenders = spark.createDataFrame([], "firm_id string, vector array<double>"), spark.createDataFrame([(1, [1.0])], "tender_id long, vector array<double>")
    assert divergence.by_firm(firms, tenders).count() == 0
    assert tuple(divergence.report(divergence.by_firm(firms, tenders)).first()) == (0, 0, 0.0, 0, 0.0, 0, 0)
