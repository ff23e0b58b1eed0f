import random

import pytest

from tagweave.operators import evaluate


@pytest.fixture(scope="module")
def judged_rows():
    rng = random.Random(8)
    rows = [("hot", rng.randint(0, 15) / 4.0, rng.randint(0, 1)) for _ in range(120)]
    rows += [(f"t{n % 3}", float(rng.randint(0, 5)), int(rng.random() < 0.3)) for n in range(60)]
    return [*rows, ("never", 1.0, 0), ("never", 2.0, 0)]


def by_tag(rows):
    out = {}
    for tag, score, hit in rows:
        out.setdefault(tag, []).append((score, hit))
    return out


def test_auc_equals_all_pairs(spark, judged_rows):
    got = {r.tag: r.auc for r in evaluate.tag_auc(frame(spark, judged_rows)).collect()}
    for tag, pairs in by_tag(judged_rows).items():
        pos, neg = [s for s, h in pairs if h], [s for s, h in pairs if not h]
        if not pos or not neg:
            assert got[tag] is None
            continue
        won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert got[tag] == pytest.approx(won / (len(pos) * len(neg)), rel=1e-12)


def test_average_precision_equals_a_threshold_sweep(spark, judged_rows):
    got = {r.tag: r.ap for r in evaluate.average_precision(frame(spark, judged_rows)).collect()}
    for tag, pairs in by_tag(judged_rows).items():
        n_pos = sum(h for _, h in pairs)
        if not n_pos:
            assert got[tag] is None
            continue
        ap, before = 0.0, 0.0
        for threshold in sorted({s for s, _ in pairs}, reverse=True):
            kept = [h for s, h in pairs if s >= threshold]
            ap += (sum(kept) / n_pos - before) * sum(kept) / len(kept)
            before = sum(kept) / n_pos
        assert got[tag] == pytest.approx(ap, rel=1e-12)


def frame(spark, rows):
    return spark.createDataFrame(rows, "tag string, score double, hit int").repartition(5)


def test_top_k_breaks_ties_by_tag(spark):
    rows = [(1, "b", 1.0), (1, "a", 1.0), (1, "c", 2.0), (2, "a", 0.0)]
    best = evaluate.topk_tags(spark.createDataFrame(rows, "item long, tag string, score double"), 2)
    assert {(r.item, r.tag, r["rank"]) for r in best.collect()} == {(1, "c", 1), (1, "a", 2), (2, "a", 1)}


def test_precision_and_recall(spark):
    predicted = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "item long, tag string")
    truth = spark.createDataFrame([(1, "a"), (4, "a"), (5, "c")], "item long, tag string")
    got = {r.tag: r for r in evaluate.precision_recall_at_k(predicted, truth).collect()}
    assert (got["a"].precision, got["a"].recall, got["a"].f1) == (0.5, 0.5, 0.5)
    assert (got["b"].precision, got["b"].recall) == (0.0, None)
    assert (got["c"].precision, got["c"].recall) == (None, 0.0)
