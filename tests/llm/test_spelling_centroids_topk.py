"""Spelling variants, centroid clusters and exact top-k against plain versions, with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidlake.llm import centroids, queries, spelling, vafile

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>"

# 11


def plain_words(rows, least=7, times=2):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= times}


def plain_near(words):
    """By what is left when one position is taken out or left open."""
    gaps = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            gaps["open", w[:i], w[i + 1 :]].add(w)
            gaps["out", w[:i] + w[i + 1 :]].add(w)
    near = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            near[w] |= gaps["open", w[:i], w[i + 1 :]]
        for longer in gaps.get(("out", w), ()):
            near[w].add(longer)
            near[longer].add(w)
    return {w: found - {w} for w, found in near.items()}


def plain_variants(rows, least=7, times=2):
    n = plain_words(rows, least, times)
    near = plain_near(n)
    form = {}
    for w in n:
        best = min(near.get(w, ()), key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near.get(w, ())), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def variants_of(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, "clash", 7, "clash") for i, t in rows], "doc_id long, text string, word string, n int, form string")
    return sorted(map(tuple, spelling.variants(docs, **more).collect()), key=repr)


def test_spelling_variants_equal_brute_force(spark, monkeypatch):
    r = random.Random(4)
    stems = ["".join(r.choice("abcé") for _ in range(r.randrange(7, 12))) for _ in range(60)]
    rows = []
    for i in range(200):
        words = []
        for _ in range(150):
            w = stems[min(int(r.expovariate(0.2)), 59)]
            if r.random() < 0.2:
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("abcéÀ") + w[at:], w[:at] + r.choice("abcé") + w[at + 1 :]])
            words.append(w if r.random() < 0.8 else w.upper())
        rows.append((i, r.choice([" ", "-", "2", "中", "\x00"]).join(words)))
    rows += [(7, None), (8, ""), (9, "short words only"), (None, "aaaaaaa aaaaaaaa aaaaaaaaa " * 3), (3, rows[3][1]), (10, "×" * 9 + " " + "÷" * 9 + " " + "×" * 9)]
    want = plain_variants(rows)
    assert sum(r[4] for r in want) > 500 and sum(r[1] is not None for r in want) > 50
    assert any(r[1] and r[1] != r[2] for r in want)
    assert variants_of(spark, rows) == want
    for name, value in (("MOST_WORDS", 6), ("BLOCK_CELLS", 200), ("PIECE", 40), ("HELD", 10)):
        monkeypatch.setattr(spelling, name, value)
    assert variants_of(spark, rows) == want


def test_spelling_of_one_crowded_beginning_and_end(spark, monkeypatch):
    monkeypatch.setattr(spelling, "MOST_WORDS", 20)
    words = [f"prefix{a}{b}{c}suffix" for a in "abcdef" for b in "abcdef" for c in "abcd"] + [f"prefix{a}{b}suffix" for a in "abcdef" for b in "abcdef"]
    rows = [(i, " ".join(words)) for i in range(2)] + [(i, "prefixaasuffix " * 60) for i in range(5, 9)]
    assert variants_of(spark, rows) == plain_variants(rows)


def test_spelling_of_very_long_words_and_empty_tables(spark):
    long = "ab" * 9_000
    rows = [(i, f"{long} {long[:5000]}x{long[5000:]} {long[:-1]} {long[:700]}é{long[701:]}") for i in range(4)]
    assert variants_of(spark, rows) == plain_variants(rows)
    assert variants_of(spark, rows[:0]) == variants_of(spark, [(1, None)]) == []


def test_spelling_query_on_the_tables_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, queries.QUERIES["op11_spelling_variants"](spark, SF).collect()), key=repr)
    assert got == plain_variants(docs) and len(got) > 1000


def test_wavelet_tree_reports_what_stands_in_both_intervals():
    r = np.random.default_rng(2)
    for size in (1, 2, 3, 17, 64, 300):
        values = r.permutation(size)
        tree = spelling.WaveletTree(values)
        lo, first = r.integers(0, size, 50), r.integers(0, size, 50)
        hi, last = lo + r.integers(0, size, 50).clip(max=size - lo), first + r.integers(0, size, 50).clip(max=size - first)
        asked, found = tree.report(lo, hi, first, last)
        want = sorted((q, int(v)) for q in range(50) for v in values[lo[q] : hi[q]] if first[q] <= v < last[q])
        assert sorted(zip(asked.tolist(), found.tolist())) == want


# 12


def plain_clusters(rows, k=16, rounds=3, dim=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [v for _, v in start]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((dist(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(centres)):
            own = [v for (_, v), c in zip(kept, of) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = collections.Counter()
    for _, c, d in found:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in found), key=repr)


def clusters_of(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], f"{VECTORS}, cluster int, h string")
    return sorted(map(tuple, centroids.cluster(df, **more).collect()), key=repr)


def test_clusters_equal_brute_force(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal((6, 64)) / 8
    rows = [(i, [float(x) for x in base[i % 6] + r.standard_normal(64) * 0.05 * (i % 3)]) for i in range(300)]
    rows += [(900 + i, rows[3][1]) for i in range(150)] + [rows[0], (None, rows[1][1])]
    odd = [(1000, None), (1001, []), (1002, [0.5] * 63), (1003, [0.5] * 65), (1004, [float("nan")] + [0.0] * 63), (1005, [float("inf")] + [0.0] * 63), (1006, [None] + [0.0] * 63)]
    want = plain_clusters(rows)
    assert clusters_of(spark, rows + odd) == want
    assert len({r[1] for r in want}) > 4


def test_clusters_of_ties_few_rows_and_empty_tables(spark):
    halves = [(i, [float((i >> d) & 1) for d in range(4)]) for i in range(16)] * 2  # many vectors lie as near to several
    assert clusters_of(spark, halves, k=5, dim=4) == plain_clusters(halves, k=5, dim=4)
    few = [(i, [i / 10] * 64) for i in range(5)]
    assert clusters_of(spark, few) == plain_clusters(few)
    same = [(i, [0.3] * 64) for i in range(40)]
    assert clusters_of(spark, same) == plain_clusters(same) and {r[1] for r in clusters_of(spark, same)} == {0}
    assert clusters_of(spark, few[:0]) == clusters_of(spark, [(1, None)]) == []
    assert clusters_of(spark, [*few, (77, [1e30] * 64)]) == plain_clusters(few)  # distances that no long holds


def test_partial_distances_find_the_nearest_and_the_smaller_of_equals():
    r = np.random.default_rng(6)
    for _ in range(30):
        x, c = r.integers(-3, 4, (200, 20)), r.integers(-2, 3, (9, 20))
        c[5] = c[2]
        best, least = centroids.nearest(x, c, r.permutation(20))
        every = ((x[:, None] - c) ** 2).sum(2)
        assert (best == every.argmin(1)).all() and (least == every.min(1)).all()


# 13


def plain_top(rows, k=5, every=50):
    x = [(i, [math.floor(256 * a) for a in v]) for i, v in rows if i is not None and v is not None and all(a is not None and math.isfinite(a) for a in v)]
    out = []
    for at, (q, v) in enumerate(x):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for other, (i, w) in enumerate(x) if other != at and len(w) == len(v))
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def top_of(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], f"{VECTORS}, row int, vec string, q int")
    return sorted(map(tuple, vafile.top_k(df, **more).collect()))


@pytest.mark.parametrize("cells,block", [(256, 8 << 20), (4, 700), (2, 8 << 20)])
def test_top_k_equals_brute_force(spark, monkeypatch, cells, block):
    for name, value in (("CELLS", cells), ("BLOCK_BYTES", block), ("SAMPLE", 40), ("CHUNK", 64), ("QUERIES", 3)):
        monkeypatch.setattr(vafile, name, value)
    r = np.random.default_rng(8)
    base = r.standard_normal((5, 24)) / 5
    rows = [(i, [float(x) for x in base[i % 5] + r.standard_normal(24) * 0.1 * (i % 4)]) for i in range(600)]
    rows += [(1000 + i, rows[5][1]) for i in range(200)] + [rows[50], rows[100], rows[100], (-50, rows[7][1])]
    rows += [(1300, [1.0, 2.0]), (1301, [1.0, -2.0]), (1302, [0.5, 0.5]), (1350, []), (1351, []), (1400, [3.0])]
    odd = [(None, rows[5][1]), (1450, None), (1451, [float("nan")] * 24), (1500, [float("inf")] * 24), (1501, [None] + [1.0] * 23)]
    want = plain_top(rows)
    assert top_of(spark, rows + odd) == want
    assert {q for q, *_ in want} >= {-50, 0, 50, 100, 1000, 1300, 1350}


def test_top_k_of_ties_few_rows_and_empty_tables(spark):
    ties = [(i, [float(i % 2), float(i % 3 == 0)]) for i in range(160)]
    assert top_of(spark, ties, k=7, every=10) == plain_top(ties, k=7, every=10)
    few = [(0, [1.0]), (3, [2.0])]
    assert top_of(spark, few) == plain_top(few) == [(0, 1, 3, 256 * 512)]
    assert top_of(spark, few[:0]) == top_of(spark, [(0, None)]) == top_of(spark, [(7, [1.0])]) == []
    assert top_of(spark, [(0, [0.0] * 3), (1, [0.0] * 3)]) == [(0, 1, 1, 0)]


def test_bounds_hold_every_score():
    r = np.random.default_rng(9)
    x, q = r.integers(-400, 400, (300, 12)).astype(np.int32), r.integers(-400, 400, (20, 12)).astype(np.int32)
    first, last = vafile.edges_of(x[:10].ravel(), int(x.min()), int(x.max()))
    cells = (np.searchsorted(first, x, "right") - 1).astype(np.uint8)
    assert (first[cells] <= x).all() and (x <= last[cells]).all()
    lower, upper = vafile.bounds(q, cells, first, last)
    score = q.astype(np.int64) @ x.astype(np.int64).T
    assert (lower <= score).all() and (score <= upper).all()
