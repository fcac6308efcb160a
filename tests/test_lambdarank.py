"""Ordering of lists: gradients against plain pairs, trees against a known order, and the other models on one data set."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from bidlake.operators import lambdarank, rankers
from bidlake.operators.features import NAMES


def plain_gradients(score, label):
    order = sorted(range(len(score)), key=lambda i: -score[i])
    rank = {i: r for r, i in enumerate(order)}
    ideal = sum(1 / math.log2(2 + r) for r in range(sum(x > 0 for x in label)))
    g, h = [0.0] * len(score), [0.0] * len(score)
    for i in range(len(score)):
        for j in range(len(score)):
            if label[i] > 0 >= label[j]:
                swap = abs(1 / math.log2(2 + rank[i]) - 1 / math.log2(2 + rank[j])) / ideal
                wrong = 1 / (1 + math.exp(score[i] - score[j]))
                g[i] += wrong * swap
                g[j] -= wrong * swap
                h[i] += wrong * (1 - wrong) * swap
                h[j] += wrong * (1 - wrong) * swap
    return g, h


def test_gradients_equal_plain_pairs():
    r = np.random.default_rng(1)
    for n in (1, 2, 7, 30):
        score, label = np.round(r.standard_normal(n), 1), r.integers(0, 2, n)
        for got, want in zip(lambdarank.gradients(score, label), plain_gradients(score.tolist(), label.tolist())):
            assert np.allclose(got, want)


def lists(spark, firms, seed):
    """A firm wants what is large for its own list; lists lie at different heights, so the same number is much in one and little in another."""
    r, rows = random.Random(seed), []
    for f in range(firms):
        height = r.uniform(-2, 2)
        values = [r.random() for _ in range(60)]
        best = sorted(values)[-9:]
        rows += [(f, o, int(a in best), a + height, r.random(), r.random() if o % 9 else None) for o, a in enumerate(values)]
    return spark.createDataFrame(rows, "firm_id int, ocid int, label int, height double, noise double, holes double")


def test_lists_are_ordered_better_than_rows(spark):
    """Both models see the same columns and may grow as many trees of the same depth."""
    train, test, columns = lists(spark, 40, 1), lists(spark, 15, 2), ["height", "noise"]
    model = lambdarank.fit(train, columns, trees=8, depth=4, rate=0.5, bins=64, least=10)
    assert len(model) == 8 and all(n[0] < 2 for t in model for n in t)
    recall = lambda rows: rankers.firm_results(rows, 10).agg(F.avg("recall_10")).first()[0]
    by_list = recall(lambdarank.scored(model, test, columns))
    by_row = recall(rankers.scored(rankers.fit_boosted(train, tuple(columns), trees=8, depth=4), test))
    assert by_list > 0.5 and by_list > by_row + 0.1, (by_list, by_row)


def test_long_lists_are_dealt_and_holes_go_left(spark):
    rows = lists(spark, 10, 5).withColumn("holes", F.when(F.col("label") == 0, F.col("holes")))
    model = lambdarank.fit(rows, ["noise", "holes"], trees=1, depth=1, longest=20)
    (feature, threshold, left, right, _), *leaves = model[0]
    assert feature == 1 and threshold == -math.inf and leaves[left - 1][4] > 0 > leaves[right - 1][4]


def test_without_rows_or_without_a_choice_there_are_no_trees(spark):
    rows = lists(spark, 2, 3)
    assert lambdarank.fit(rows.limit(0), ["noise"], trees=2) == []
    assert lambdarank.fit(rows.withColumn("label", F.lit(1)), ["noise"], trees=2) == []
    assert lambdarank.scored([], rows, ["noise"]).agg(F.sum("score")).first()[0] == 0.0


def test_models_are_compared_on_one_data_set(spark):
    r = random.Random(4)
    rows = []
    for f in range(10):
        for o in range(20):
            label = int(o < 5)
            x = {n: r.random() for n in NAMES}
            x |= {"cross_category_seen": float(label), "cross_buyer_prior_bids": 0.0, "cross_region_seen": 0.0, "cross_embedding_similarity": r.random(), "tender_bidder_count": label + r.random() / 9}
            rows.append((f, o, label, *(float(x[n]) for n in NAMES)))
    frame = spark.createDataFrame(rows, f"firm_id int, ocid int, label int, {', '.join(f'{n} double' for n in NAMES)}")
    got = {x.model: x for x in rankers.compared(frame, frame, trees=2).collect()}
    assert set(got) == set(rankers.MODELS) and all(x.firms == 10 for x in got.values())
    assert got["deterministic"].recall_10 == got["boosted"].recall_10 == got["boosted_no_leakage"].mrr == 1.0 > got["embedding_only"].recall_10


def test_size_regressor_sees_titles(spark):
    titles = spark.createDataFrame([("a b", [1.0, 2.0]), (None, None), ("xyz", [5.0])], "title string, e array<double>")
    rows, names = rankers.with_title(titles, "title", "e", 2)
    assert names == ("title_signs", "title_words", "title_0", "title_1")
    assert [tuple(x[n] for n in names) for x in rows.collect()] == [(3.0, 2.0, 1.0, 2.0), (0.0, 1.0, 0.0, 0.0), (3.0, 1.0, 5.0, 0.0)]
    past = spark.createDataFrame([("k", "long " * 5 if n % 2 else "short", 1e3 if n % 2 else 1e6) for n in range(60)], "kind string, title string, amount double")
    rows, names = rankers.with_title(past)
    model = rankers.fit_size(rows, ("kind",), names, trees=3)
    found = {x.title: x.estimate for x in rankers.sized(model, rows, ("kind",), names).collect()}
    assert found["short"] > 10 * found["long " * 5]
