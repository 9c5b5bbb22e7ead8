"""Hard negatives against sorting all scores."""

import math

import numpy as np
import pyarrow as pa
import pytest

from factweave.llm import negatives


def brute(rows, anchors, positives=5, k=3, low=50, high=95):
    items = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = (label, [math.floor(256 * x) for x in v])
        items[i] = min(items.get(i, own), own)
    out = []
    for a in sorted(set(anchors) & set(items)):
        label, v = items[a]
        score = lambda b: sum(x * y for x, y in zip(v, items[b][1], strict=False))  # noqa: B023, E731
        order = sorted((-score(b), b) for b in items if b != a)
        for p, i in [x for x in order if items[x[1]][0] == label][:positives]:
            fits = [(-s, b) for s, b in order if items[b][0] != label and low * -p <= 100 * -s <= high * -p]
            out += [(a, i, r + 1, b, -p, s) for r, (s, b) in enumerate(fits[:k])]
    return sorted(out)


def found(frame):
    return sorted(tuple(r) for r in frame.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def made(n, seed=0, width=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, width))
    v = centres[rng.integers(0, 7, n)] + 0.2 * rng.normal(size=(n, width))
    v[rng.random(n) < 0.33] = v[0]
    return [(int(i), int(rng.integers(0, 3)), v[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("block_rows", [40, 8192])
def test_equals_sorting_with_copies_of_a_third(spark, block_rows):
    rows = made(700)
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    anchors = frame.filter("vec_id % 20 = 0")
    assert found(negatives.hard_negatives(frame, anchors, block_rows=block_rows)) == brute(rows, range(0, 700, 20))


def test_odd_rows(spark):
    rows = made(60, 3)
    rows += [(0, None, [1.0] * 6), (100, 1, None), (101, 1, [1.0, None]), (102, 0, [float("nan")] * 6), (103, 0, [float("inf")] + [0.0] * 5), (None, 1, [1.0] * 6)]
    rows += [(104, 1, [1.0, 2.0]), (105, 2, []), (106, 1, [0.0] * 6), (20, 1, rows[5][2]), rows[7], rows[7], (107, 0, [-3.0] * 6), (108, 1, [9.0] * 6)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, cell string, score int")
    anchors = [0, 5, 7, 20, 40, 100, 102, 104, 105, 106, 107, 108, 999]
    asked = spark.createDataFrame([(a,) for a in [*anchors, None, 7]], "vec_id long")
    assert found(negatives.hard_negatives(frame, asked, block_rows=16)) == brute(rows, anchors)
    assert found(negatives.hard_negatives(frame.limit(0), asked)) == []
    assert found(negatives.hard_negatives(frame, asked.limit(0))) == []
    with pytest.raises(ValueError, match="squared norm"):
        found(negatives.hard_negatives(spark.createDataFrame([(1, 1, [1e9])], "vec_id long, label int, embedding array<double>"), asked))


def test_annulus_search_visits_few_leaves(monkeypatch):
    monkeypatch.setattr(negatives, "LEAF_ROWS", 16)
    rng = np.random.default_rng(5)
    v = np.rint(rng.normal(size=(4000, 3)) * 100).astype(np.int64)
    norm = int((v**2).sum(axis=1).max())
    space = negatives.Space(3, norm, np.zeros((0, 4)), np.zeros(0))
    points = negatives.lifted(v, norm)
    assert np.allclose((points**2).sum(axis=1), norm)
    order, leaves, vantage = negatives.tree(points, 16)
    for a, b, _ in leaves:
        order[a:b].sort()
    path = np.full((len(leaves), max(len(p) for *_, p in leaves), 3), -1.0)
    for j, (*_, p) in enumerate(leaves):
        path[j, : len(p)] = np.array(p)
    label = rng.integers(0, 2, 4000)
    row = {"ids": order.astype(np.int64), "labels": label[order], "vectors": v[order], "leaves": np.array([x[:2] for x in leaves], np.int64), "paths": path, "vantage": points[vantage]}
    block = negatives.Block({k: np.ascontiguousarray(x).tobytes() for k, x in row.items()}, space)
    looked = []
    block.vectors = _Counted(block.vectors, looked)
    anchors = {"id": np.arange(50), "label": label[:50], "vector": v[:50].astype(np.float64)}
    high = rng.integers(100, norm // 2, 50)
    probes = {"anchor": np.arange(50), "low": high // 2, "high": high, "floor": high // 2}
    probe, score, name = negatives.search(block, space, anchors, probes, 3, False)
    got = sorted(zip(probe.tolist(), (-score).tolist(), name.tolist(), strict=True))
    want = []
    for p in range(50):
        s = v @ v[p]
        fits = sorted((-int(s[i]), i) for i in range(4000) if label[i] != label[p] and high[p] // 2 <= s[i] <= high[p])
        want += [(p, *x) for x in fits[:3]]
    assert got == sorted(want)
    assert sum(looked) < 0.5 * len(leaves) * 50


class _Counted:
    """Vectors that tell how many slices were taken of them."""

    def __init__(self, vectors, looked):
        self.vectors, self.looked = vectors, looked

    def __getitem__(self, at):
        self.looked.append(1)
        return self.vectors[at]


def test_matrix_of_lists():
    col = pa.array([[1, 2, 3], [], [4]], pa.list_(pa.int64())).slice(1)
    assert negatives._matrix(col, 2).tolist() == [[0, 0], [4, 0]]
