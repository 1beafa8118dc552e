"""Hard negatives against brute force, on few and on many shards."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlens.llm import hard_negatives


def brute(rows, every=5, k=5, m=3):
    """Rows (id, label, vector); one a vec_id, the smallest."""
    whole = {}
    for i, label, v in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] and all(
            c is not None and math.isfinite(c) for c in r[2])), key=lambda r: (
                r[0], r[1], [math.floor(256 * float(np.float32(c))) for c in r[2]])):
        whole.setdefault(i, (label, [math.floor(256 * float(np.float32(c))) for c in v]))
    out = set()
    for a, (label, x) in whole.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), b, other) for b, (other, y) in whole.items()
                        if b != a and len(x) == len(y))
        for s, p, _ in [t for t in scored if t[2] == label][:k]:
            near = [(b, t) for t, b, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s][:m]
            out |= {(a, p, rank, b, -s, -t) for rank, (b, t) in enumerate(near, 1)}
    return out


def sample(n=240, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((4, dim))
    rows = []
    for i in range(n):
        label = 0 if i % 3 == 0 else int(rng.integers(0, 4))  # a hot label
        v = np.round(centre[int(rng.integers(0, 4))] + rng.standard_normal(dim) * 0.4, 1)  # many ties
        rows.append((i, label, [float(c) for c in v]))
    rows += [(n + i, 5, rows[i][2]) for i in range(20)]  # copies under another label
    rows += [(1000, None, [1.0] * dim), (1005, 1, None), (1010, 1, []), (1015, 1, [None] * dim), (None, 1, [1.0] * dim),
             (1020, 1, [math.nan] * dim), (1025, 2, [0.0] * dim), (1030, 9, [1.0] * dim), (1035, 1, [1.0, 2.0]),
             (1036, 1, [2.0, 2.0]), (1037, 3, [1.5, 1.5]), (5, 0, rows[5][2]), (5, 7, rows[9][2]), (-10, 1, rows[4][2])]
    return rows


@pytest.mark.parametrize("shard,anchors", [(16_384, 16_384), (40, 7)])
def test_equals_brute_force(spark, monkeypatch, shard, anchors):
    monkeypatch.setattr(hard_negatives, "SHARD", shard)
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    rows = sample()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows],
                                  "vec_id long, label int, embedding array<float>, rank int, x string")
    got = [tuple(r) for r in hard_negatives.hard_negatives(frame, F.col("vec_id") % 5 == 0).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200


def test_no_rows(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert hard_negatives.hard_negatives(spark.createDataFrame([], schema), F.col("vec_id") % 5 == 0).count() == 0
    alone = spark.createDataFrame([(0, 1, [1.0]), (1, 2, [0.7])], schema)
    assert hard_negatives.hard_negatives(alone, F.col("vec_id") % 5 == 0).count() == 0


def test_large_components_are_exact(spark):
    rows = [(0, 1, [3e6, 1.0]), (1, 1, [3e6, 1.5]), (2, 2, [2.5e6, 0.25]), (3, 2, [2.5e6, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = {tuple(r) for r in hard_negatives.hard_negatives(frame, F.col("vec_id") % 5 == 0).collect()}
    assert got == brute(rows) and len(got) == 2


def test_reading_stops_early_and_misses_nothing():
    rng = np.random.default_rng(2)
    x = rng.integers(-9, 10, (5000, 4)).astype(np.float32)
    lists, ids = hard_negatives.Lists(x), rng.permutation(5000)
    for q in (np.array([5, 0, -1, 0], np.float32), np.array([1, 2, 3, 4], np.float32), np.zeros(4, np.float32)):
        scores = x @ q
        want = np.lexsort((ids, -scores))[:5]
        top, score = hard_negatives.nearest(lists, ids, q, -1, 5)
        assert (top == ids[want]).all() and (score == scores[want]).all()
        inside = np.flatnonzero((scores >= 10) & (scores <= 20))
        want = inside[np.lexsort((ids[inside], -scores[inside]))[:3]]
        [(top, score)] = hard_negatives.in_windows(lists, ids, np.ones(5000, bool), q, [(10, 20)], 3)
        assert (top == ids[want]).all() and (score == scores[want]).all()
        left = [(len(r), t) for r, _, t in lists.rounds(q)]
        assert sum(n for n, _ in left) == 5000 and left[-1][1] == -math.inf
    met = 0
    for rows, scores, threshold in lists.rounds(np.array([9, 0, 0, 0], np.float32)):
        met += len(rows)
        if threshold < 81:
            break
    assert met < 1000
