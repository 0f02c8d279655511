"""Hard negatives against brute force, with the awkward cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import negatives

LEAST = -(2**63)
SCHEMA = "vec_id long, label int, embedding array<float>, block int, part int, score long, place string"


def brute(rows, positives=5, k=10):
    """rows of (vec_id, label, vector): the answer as a sorted list of tuples, by Python's integers."""
    ready = []
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        ready.append((vec_id, label, [int(np.floor(256.0 * float(np.float32(x)))) for x in vector]))
    found = []
    asking = {}
    for row in sorted(ready):
        if row[0] % 100 == 0:
            asking.setdefault(row[0], row)
    for anchor, label, vector in asking.values():
        scored = sorted(
            (-min(max(sum(a * b for a, b in zip(vector, other, strict=False)), LEAST), -LEAST - 1), vec_id, of) for vec_id, of, other in ready if vec_id != anchor
        )
        best = [(vec_id, -score) for score, vec_id, of in scored if of == label][:positives]
        others = [(vec_id, -score) for score, vec_id, of in scored if of != label]
        for positive, high in best:
            fits = [(i, s) for i, s in others if 30 * high <= 100 * s <= 90 * high][:k]
            found += [(anchor, positive, rank, i, high, s) for rank, (i, s) in enumerate(fits, 1)]
    return sorted(found)


def frame(spark, rows):
    return spark.createDataFrame([(*row, 1, 2, 3, "x") for row in rows], SCHEMA)


def mined(df, **options):
    return sorted(tuple(row) for row in negatives.mine(df, F.col("vec_id") % 100 == 0, **options).collect())


def test_scores_are_inner_products():
    rng = np.random.default_rng(1)
    for low, high, dtype in ((-150, 150, np.int32), (-(2**20), 2**20, np.int64), (0, 1, np.int32), (-1, 0, np.int32)):
        vectors, anchors = (rng.integers(low, high + 1, (n, 16)) for n in (37, 5))
        kind = negatives.sum_type(vectors, anchors)
        assert kind in (dtype, np.int32, np.int64)
        got = negatives.scores(negatives.bit_planes(vectors), negatives.subset_sums(anchors, kind))
        assert (got == vectors @ anchors.T).all()


def test_scores_beyond_64_bits():
    rng = np.random.default_rng(2)
    vectors, anchors = (np.array([[int(x) << 70 for x in row] for row in rng.integers(-9, 9, (n, 8))], dtype=object) for n in (4, 3))
    assert negatives.sum_type(vectors, anchors) is object
    got = negatives.scores(negatives.bit_planes(vectors), negatives.subset_sums(anchors, object))
    assert (got == vectors.dot(anchors.T)).all()


@pytest.mark.parametrize("sizes", [(32_768, 8_192, 2_048), (16, 2, 8)])
def test_mine_equals_brute_force(spark, monkeypatch, sizes):
    """Few large blocks and many small ones; ties, repeated rows, nulls and vectors of other lengths."""
    monkeypatch.setattr(negatives, "CANDIDATES", sizes[0])
    monkeypatch.setattr(negatives, "ANCHORS", sizes[1])
    monkeypatch.setattr(negatives, "TILE", sizes[2])
    rng = np.random.default_rng(3)
    rows = [(int(i) * 20, int(rng.integers(0, 3)), [float(x) for x in np.round(rng.normal(0, 0.4, 12) + 0.2, 1)]) for i in range(120)]
    common = [0.5] * 12
    rows += [(10_000 + i, i % 3, common) for i in range(40)]  # one frequent vector: equal scores
    rows += [rows[0], rows[5], (100, 1, common)]  # repeated rows and a second vector under an anchor's id
    rows += [(None, 1, common), (300, None, common), (301, 1, None), (302, 1, [None] * 12), (303, 1, [float("nan")] * 12)]
    rows += [(304, 1, [float("inf")] * 12), (500, 2, []), (305, 0, [0.9] * 3), (600, 77, common)]
    assert mined(frame(spark, rows)) == brute(rows)


def test_huge_components_and_empty_tables(spark):
    rows = [(0, 1, [2.0**28, 1.0]), (1, 1, [2.0**20, 0.25]), (2, 2, [0.25, 0.0]), (3, 2, [3e38, 3e38]), (100, 2, [-1.0, 0.0])]
    rows += [(i, 2, [2.0**15 * i, 0.0]) for i in range(4, 30)]
    got = mined(frame(spark, rows))
    assert got == brute(rows) and len(got)
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [(0, 1, [1.0])])) == []
