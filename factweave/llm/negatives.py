"""Hard negatives: a vantage-point tree over vectors of equal norm, searched inside annuli, nearest first."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, scratch, scratch_scope, small_batches

#: Positives of an anchor and negatives of each.
POSITIVES, NEGATIVES = 5, 3
#: Rows of one block of the index, of one leaf of its tree, and anchors that meet a block at once.
BLOCK_ROWS, LEAF_ROWS, ANCHOR_ROWS = 8192, 256, 256
#: The upper tree is fitted on at most so many rows and has at most so many cells; every row is indexed.
SAMPLE_ROWS, MOST_CELLS = 4096, 1024
#: What a squared norm and a score may be at most, so that both are exact as longs with room for the order of ties.
MOST_NORM = 1 << 53

#: Lowest score, for a place not taken and a window without a lower end.
_NONE = -(1 << 62)


class Space(NamedTuple):
    """What all vectors share: their length, the largest squared norm, and the upper tree as (vector, radius) by node."""

    width: int
    norm: int
    vectors: np.ndarray
    radii: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.radii) + 1


def lifted(vectors: np.ndarray, norm: int) -> np.ndarray:
    """The vectors with one component more, which gives all the same norm; anchors have 0 there.

    Then a larger inner product with an anchor is a smaller distance to it.
    """
    room = np.maximum(float(norm) - (vectors.astype(np.float64) ** 2).sum(axis=1), 0.0)
    return np.concatenate([vectors.astype(np.float64), np.sqrt(room)[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` and all of ``b``."""
    squares = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _slack(norm: int) -> float:
    """More than rounding can change a distance by."""
    return 1e-5 * (1.0 + float(norm) ** 0.5)


def tree(points: np.ndarray, leaf: int):
    """Order of the points, and of each leaf its begin and end there and its path of (vantage point, nearest, farthest).

    The vantage point of a node is its point farthest from the last one; points are halved by their
    distance to it, also among equal distances, so a tree over copies is no deeper.
    """
    order, leaves, vantage = np.arange(len(points)), [], []
    stack = [(0, len(points), ())]
    while stack:
        a, b, path = stack.pop()
        if b - a <= leaf:
            leaves.append((a, b, path))
            continue
        own = order[a:b]
        last = vantage[path[-1][0]] if path else own[0]
        pick = own[int(np.argmax(distances(points[[last]], points[own])[0]))]
        away = distances(points[[pick]], points[own])[0]
        sort = np.argsort(away, kind="stable")
        order[a:b], away = own[sort], away[sort]
        half = (b - a) // 2
        vantage.append(pick)
        k = len(vantage) - 1
        stack.append((a + half, b, (*path, (k, away[half], away[-1]))))
        stack.append((a, a + half, (*path, (k, away[0], away[half - 1]))))
    return order, leaves, np.array(vantage, np.int64)


def reach(paths: list[tuple], away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance that points below each path may have, from distances to the vantage points."""
    low = np.zeros((len(away), len(paths)))
    high = np.full((len(away), len(paths)), np.inf)
    for j, path in enumerate(paths):
        for k, near, far in path:
            np.maximum(low[:, j], np.maximum(away[:, k] - far, near - away[:, k]), out=low[:, j])
            np.minimum(high[:, j], away[:, k] + far, out=high[:, j])
    return low, high


def _cell_paths(space: Space) -> list[tuple]:
    """The paths of the cells of the upper tree, whose node k has the nodes 2k+1 (inside its radius) and 2k+2."""
    paths = [()]
    nodes = [0]
    while nodes and nodes[0] < len(space.radii):
        paths = [p for k, path in zip(nodes, paths, strict=True) for p in ((*path, (k, 0.0, space.radii[k])), (*path, (k, space.radii[k], np.inf)))]
        nodes = [n for k in nodes for n in (2 * k + 1, 2 * k + 2)]
    return paths


def _cell_of(space: Space, vectors: np.ndarray) -> np.ndarray:
    points = lifted(vectors, space.norm)
    node = np.zeros(len(points), np.int64)
    away = distances(points, space.vectors) if len(space.radii) else None
    while away is not None and len(node) and node[0] < len(space.radii):
        rows = np.arange(len(node))
        node = 2 * node + 1 + (away[rows, node] > space.radii[node])
    return node - len(space.radii)


def _upper_tree(sample: np.ndarray, cells: int, norm: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and median radii of a full tree with ``cells`` leaves, a power of two."""
    points = lifted(sample, norm)
    vectors, radii, groups = [], [], [np.arange(len(points))]
    while len(groups) < cells:
        below = []
        for own in groups:
            own = own if len(own) else np.arange(1)
            pick = own[int(np.argmax(distances(points[own[:1]], points[own])[0]))]
            away = distances(points[[pick]], points[own])[0]
            radius = float(np.median(away))
            vectors.append(points[pick])
            radii.append(radius)
            below += [own[away <= radius], own[away > radius]]
        groups = below
    return np.array(vectors).reshape(len(vectors), points.shape[1]), np.array(radii)


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    size = np.diff(col.offsets.to_numpy())
    out = np.zeros((len(col), width), np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(col)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label and v (array of long: floor of 256 times each component) of the rows that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(F.coalesce(whole, F.lit(False)))
    return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.transform(x, lambda c: F.floor(F.lit(256.0) * c)).alias("v"))


def _space(rows: DataFrame, block_rows: int) -> Space:
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    n, width, norm = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    if norm is not None and norm >= MOST_NORM:
        raise ValueError(f"a squared norm of {norm:.4g} is more than exact scores allow ({MOST_NORM})")
    cells = 1
    while cells < MOST_CELLS and cells * block_rows < (n or 0):
        cells *= 2
    if cells == 1:
        return Space(width or 0, int(norm or 0), np.zeros((0, (width or 0) + 1)), np.zeros(0))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").toArrow()["v"].combine_chunks()
    return Space(width, int(norm), *_upper_tree(_matrix(sample, width), cells, int(norm)))


def _index(rows: DataFrame, space: Space, block_rows: int) -> DataFrame:
    """Blocks of the index (cell, part, packed rows in the order of a tree, packed tree), at most about ``block_rows`` rows each."""
    width = space.width

    def place(batches):
        for b in batches:
            v = _matrix(b.column("v"), width)
            packed = pa.array([x.tobytes() for x in v.astype(np.int64)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), packed, pa.array(_cell_of(space, v).astype(np.int32))], names=["vec_id", "label", "v", "cell"])

    placed = scratch(small_batches(rows).mapInArrow(place, "vec_id bigint, label bigint, v binary, cell int"))
    # a cell of many copies is dealt to as many parts as it takes
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_n"))
    dealt = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(11)), F.col("_n")).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id").combine_chunks()
        v = np.frombuffer(b"".join(table["v"].to_pylist()), np.int64).reshape(table.num_rows, width)
        points = lifted(v, space.norm)
        order, leaves, vantage = tree(points, LEAF_ROWS)
        for a, b, _ in leaves:
            order[a:b].sort()
        depth = max(len(p) for *_, p in leaves)
        path = np.full((len(leaves), depth, 3), -1.0)
        for j, (*_, p) in enumerate(leaves):
            path[j, : len(p)] = np.array(p).reshape(-1, 3)
        cut = lambda x: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())
        made = [table["vec_id"].to_numpy()[order], table["label"].to_numpy()[order], v[order], np.array([x[:2] for x in leaves], np.int64), path, points[vantage]]
        return pa.table([table["cell"].combine_chunks().slice(0, 1), table["part"].combine_chunks().slice(0, 1), *map(cut, made)], names=["cell", "part", "ids", "labels", "vectors", "leaves", "paths", "vantage"])

    schema = "cell int, part int, ids binary, labels binary, vectors binary, leaves binary, paths binary, vantage binary"
    tasks = max(8, space.cells)
    return scratch(small_batches(dealt.select("cell", "part", "vec_id", "label", "v").repartition(tasks, "cell", "part")).groupBy("cell", "part").applyInArrow(build, schema))


class Block:
    """A block of the index with its tree."""

    def __init__(self, row: dict, space: Space):
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        self.vectors = np.frombuffer(row["vectors"], np.int64).reshape(len(self.ids), space.width).astype(np.float64)
        self.leaves = np.frombuffer(row["leaves"], np.int64).reshape(-1, 2)
        self.vantage = np.frombuffer(row["vantage"], np.float64).reshape(-1, space.width + 1)
        paths = np.frombuffer(row["paths"], np.float64).reshape(len(self.leaves), -1, 3)
        self.paths = [tuple((int(k), near, far) for k, near, far in p.tolist() if k >= 0) for p in paths]


def annulus(norms: np.ndarray, norm: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distances (inner, outer) of scores from ``low`` to ``high`` with anchors of these squared norms."""
    inner = np.where(high >= -_NONE, 0.0, norms + norm - 2.0 * high)
    outer = np.where(low <= _NONE, np.inf, norms + norm - 2.0 * low)
    return np.sqrt(np.maximum(inner, 0.0)), np.sqrt(np.maximum(outer, 0.0))


def search(block: Block, space: Space, anchors: dict[str, np.ndarray], probes: dict[str, np.ndarray], k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """probe, score and id of the best ``k`` rows of the block for each probe, of equal scores the smaller ids.

    Anchors have id, label and vector. A probe is an anchor (its place), a window of scores from ``low``
    to ``high`` and the score it needs at least, ``floor``. Each probe visits the leaves its annulus
    meets, nearest first, until no leaf left can hold a better row; the probes that are at one leaf at
    the same step are scored together.
    """
    vectors, slack = anchors["vector"], _slack(space.norm)
    norms = (vectors**2).sum(axis=1)
    points = np.concatenate([vectors, np.zeros((len(vectors), 1))], axis=1)
    near, far = reach(block.paths, distances(points, block.vantage) if len(block.vantage) else np.zeros((len(points), 0)))
    own, low, high = probes["anchor"], probes["low"], probes["high"]
    inner, outer = annulus(norms[own], space.norm, low.astype(np.float64), high.astype(np.float64))
    begin = np.maximum(near[own], inner[:, None])
    begin[(far[own] < inner[:, None] - slack) | (near[own] > outer[:, None] + slack)] = np.inf
    visits = np.argsort(begin, axis=1, kind="stable")
    begin = np.take_along_axis(begin, visits, axis=1)
    # the score that nothing from there on exceeds
    bound = np.floor((norms[own][:, None] + space.norm - np.maximum(begin - slack, 0.0) ** 2) / 2 + 1e-6 * (1 + space.norm))
    best = np.full((len(own), k), _NONE, np.int64)
    names = np.zeros((len(own), k), np.int64)
    floor = probes["floor"].copy()
    for step in range(len(block.leaves)):
        live = np.flatnonzero(np.isfinite(begin[:, step]) & (bound[:, step] >= np.maximum(floor, low)))
        if not len(live):
            break
        leaf = visits[live, step]
        live = live[np.argsort(leaf, kind="stable")]
        leaf = visits[live, step]
        edges = np.append(np.flatnonzero(np.diff(leaf, prepend=-1)), len(leaf)).tolist()
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            at = live[i:j]
            a, b = block.leaves[leaf[i]]
            who, back = np.unique(own[at], return_inverse=True)
            score = (vectors[who] @ block.vectors[a:b].T)[back].astype(np.int64)
            label = block.labels[a:b] == anchors["label"][own[at]][:, None]
            fits = (label & (block.ids[a:b] != anchors["id"][own[at]][:, None])) if same else ~label
            fits &= (score >= np.maximum(low[at], floor[at])[:, None]) & (score <= high[at][:, None])
            some = fits.any(axis=1)
            if not some.any():
                continue
            at, score, fits = at[some], score[some], fits[some]
            # ids rise inside a leaf, so the place breaks ties
            key = np.where(fits, score * LEAF_ROWS + np.arange(b - a)[::-1], _NONE)
            if b - a > k:
                pick = np.argpartition(key, b - a - k, axis=1)[:, b - a - k :]
                key = np.take_along_axis(key, pick, axis=1)
            else:
                pick = np.broadcast_to(np.arange(b - a), key.shape)
            new = np.where(key > _NONE, np.take_along_axis(score, pick, axis=1), _NONE)
            all_scores = np.concatenate([best[at], new], axis=1)
            all_names = np.concatenate([names[at], block.ids[a:b][pick]], axis=1)
            rank = np.lexsort((all_names, -all_scores), axis=1)[:, :k]
            best[at] = np.take_along_axis(all_scores, rank, axis=1)
            names[at] = np.take_along_axis(all_names, rank, axis=1)
            floor[at] = np.maximum(floor[at], best[at, -1])
    probe, place = np.nonzero(best > _NONE)
    return probe, best[probe, place], names[probe, place]


#: An anchor in its searches: identifier, label, packed vector, and of its windows the numbers, ends and least scores.
_ASKED = "cell int, anchor_id bigint, label bigint, v binary, windows array<struct<w:bigint,low:bigint,high:bigint,floor:bigint>>"
_FOUND = "anchor_id bigint, w bigint, score bigint, id bigint"


def _routed(asked: DataFrame, space: Space, first: bool) -> DataFrame:
    """An anchor once for each cell it needs: the nearest its windows meet (``first``), or all others they meet and a better score may be in."""
    paths = _cell_paths(space)

    def run(batches):
        slack = _slack(space.norm)
        for b in batches:
            if not b.num_rows:
                continue
            v = np.frombuffer(b"".join(b.column("v").to_pylist()), np.int64).reshape(b.num_rows, space.width).astype(np.float64)
            norms = (v**2).sum(axis=1)
            near, far = reach(paths, distances(np.concatenate([v, np.zeros((len(v), 1))], axis=1), space.vectors) if len(space.radii) else np.zeros((len(v), 0)))
            windows = b.column("windows")
            row = np.repeat(np.arange(len(v)), np.diff(windows.offsets.to_numpy()))
            low, high, floor = (windows.flatten().field(c).to_numpy() for c in ("low", "high", "floor"))
            inner, outer = annulus(norms[row], space.norm, low.astype(np.float64), high.astype(np.float64))
            # of each window the cells its annulus meets
            begin = np.maximum(near[row], inner[:, None])
            met = (far[row] >= inner[:, None] - slack) & (near[row] <= outer[:, None] + slack)
            begin = np.where(met, begin, np.inf)
            home = np.argmin(begin, axis=1)
            is_home = (np.arange(len(paths)) == home[:, None]) & met
            bound = (norms[row][:, None] + space.norm - np.where(met, np.maximum(begin - slack, 0.0), 0.0) ** 2) / 2 + 1e-6 * (1 + space.norm)
            want = is_home if first else met & ~is_home & (bound >= floor[:, None])
            window, cell = np.nonzero(want)
            order = np.lexsort((window, cell, row[window]))
            window, cell = window[order], cell[order]
            owner = row[window]
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (cell[1:] != cell[:-1])
            heads = np.flatnonzero(new)
            lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(owner)).astype(np.int32)), windows.flatten().take(pa.array(window)))
            at = pa.array(owner[heads])
            yield pa.RecordBatch.from_arrays([pa.array(cell[heads].astype(np.int32)), *(b.column(c).take(at) for c in ("anchor_id", "label", "v")), lists], names=["cell", "anchor_id", "label", "v", "windows"])

    return small_batches(asked).mapInArrow(run, _ASKED)


def _asked_blocks(routed: DataFrame, blocks: DataFrame, space: Space, k: int, same: bool) -> DataFrame:
    """The best rows of every block for the windows of the anchors sent to its cell; anchors meet a block in batches."""
    parts = blocks.groupBy("cell").agg(F.max("part").alias("_last"))
    # few rows: one a cell, of which there are at most MOST_CELLS
    sent = routed.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_last")))).drop("_last")
    own = sent.withColumn("kind", F.lit(1)).unionByName(blocks.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    dealt = own.repartition(max(8, space.cells), "cell", "part").sortWithinPartitions("cell", "part", "kind")

    def run(batches):
        now, block, held = -1, None, []

        def answer():
            table = pa.Table.from_batches(held).combine_chunks()
            windows = table["windows"].combine_chunks()
            flat = windows.flatten()
            size = np.diff(windows.offsets.to_numpy())
            vectors = np.frombuffer(b"".join(table["v"].to_pylist()), np.int64).reshape(table.num_rows, space.width).astype(np.float64)
            anchors = {"id": table["anchor_id"].to_numpy(), "label": table["label"].to_numpy(), "vector": vectors}
            probes = {"anchor": np.repeat(np.arange(table.num_rows), size)} | {c: flat.field(c).to_numpy() for c in ("low", "high", "floor")}
            probe, score, name = search(block, space, anchors, probes, k, same)
            return pa.RecordBatch.from_arrays([pa.array(anchors["id"][probes["anchor"][probe]]), flat.field("w").take(pa.array(probe)), pa.array(score), pa.array(name)], names=["anchor_id", "w", "score", "id"])

        for b in batches:
            kind, key = b.column("kind").to_numpy(), b.column("cell").to_numpy().astype(np.int64) << 32 | b.column("part").to_numpy()
            edges = np.append(np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(kind, prepend=-1) != 0) | (kind == 0)), len(kind)).tolist()
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if kind[i] == 0 or key[i] != now:
                    if held:
                        yield answer()
                        held = []
                    # a part that got no rows has no block, and its anchors find nothing there
                    now, block = key[i], Block(b.slice(i, 1).to_pylist()[0], space) if kind[i] == 0 else None
                if kind[i] == 0 or block is None:
                    continue
                held.append(b.slice(i, j - i))
                if sum(x.num_rows for x in held) >= ANCHOR_ROWS:
                    yield answer()
                    held = []
        if held:
            yield answer()

    return small_batches(dealt).mapInArrow(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest(asked: DataFrame, blocks: DataFrame, space: Space, k: int, same: bool) -> DataFrame:
    """(anchor_id, w, score, id, rank) of the best ``k`` rows of every window of ``asked``.

    Two rounds: the nearest cell of a window gives the score that a row of another cell must reach, and
    only cells that may hold such a row are searched then.
    """
    near = scratch(_asked_blocks(_routed(asked, space, True), blocks, space, k, same))
    if space.cells == 1:
        return _best(near, k)
    # a cell of several parts gives k rows for each, of which the k-th best counts
    kth = _best(near, k).filter(F.col("rank") == k).select("anchor_id", "w", F.col("score").alias("_kth"))
    each = asked.select("anchor_id", "label", "v", F.explode("windows").alias("x")).select("anchor_id", "label", "v", "x.*")
    raised = each.join(kth, ["anchor_id", "w"], "left").withColumn("floor", F.greatest("floor", F.coalesce("_kth", "floor")))
    again = raised.groupBy("anchor_id", "label", "v").agg(F.collect_list(F.struct("w", "low", "high", "floor")).alias("windows"))
    more = _asked_blocks(_routed(scratch(again), space, False), blocks, space, k, same)
    return _best(near.unionByName(more), k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 50, high: int = 95, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``rows`` has vec_id, label and embedding, ``anchors`` the vec_id of the anchors. An anchor's positives are
    the ``positives`` other rows of its label with the highest scores, integer inner products of floor(256 * x);
    the negatives of a positive are the first ``negatives`` rows of another label whose score is from ``low``
    to ``high`` per cent of the positive's. Ties go to the smaller vec_id.

    Rows with a null vec_id or label, a null vector or a null or non-finite component take no part. Rows of
    one vec_id are one item, of which the first by label and vector stands. Shorter vectors end in zeros; an
    empty vector has score 0 with all. Windows of a negative positive score are empty. An empty table gives
    no rows. Squared norms must be under 2^53, which is an error otherwise. Other columns are ignored.

    Every row is in one block of the index; a third of all rows being copies of one vector only makes more
    blocks of one cell. Anchors meet only the blocks of cells that their annuli reach.
    """
    with scratch_scope(rows.sparkSession):
        one = usable(rows).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("_x")).select("vec_id", "_x.label", "_x.v")
        known = scratch(one)
        space = _space(known, block_rows)
        blocks = _index(known, space, block_rows)
        packed = small_batches(known.join(anchors.select("vec_id").distinct(), "vec_id", "left_semi"))
        width = space.width

        def pack(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([x.tobytes() for x in _matrix(b.column("v"), width)], pa.binary())], names=["anchor_id", "label", "v"])

        asked = scratch(packed.mapInArrow(pack, "anchor_id bigint, label bigint, v binary"))
        whole = F.array(F.struct(F.lit(0).cast("bigint").alias("w"), F.lit(_NONE).alias("low"), F.lit(-_NONE).alias("high"), F.lit(_NONE).alias("floor")))
        best = scratch(nearest(asked.withColumn("windows", whole), blocks, space, positives, True))
        p = F.col("score")
        # whole scores n with low * p <= 100 * n <= high * p
        ends = best.select("anchor_id", F.struct(F.col("rank").cast("bigint").alias("w"), F.ceil(F.expr(f"({low} * score) div 100")).cast("bigint").alias("_l"), F.floor(F.expr(f"({high} * score) div 100")).cast("bigint").alias("high")).alias("x"), p)
        least = F.col("x._l") + F.when(F.lit(low) * p > 100 * F.col("x._l"), 1).otherwise(0)
        window = F.struct("x.w", least.alias("low"), "x.high", least.alias("floor"))
        windows = ends.filter("score >= 0").groupBy("anchor_id").agg(F.collect_list(window).alias("windows"))
        found = nearest(scratch(asked.join(windows, "anchor_id")), blocks, space, negatives, False)
        chosen = best.select("anchor_id", F.col("rank").cast("bigint").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        made = found.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(chosen, ["anchor_id", "w"])
        return scratch(made.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), keep=True)


def op13_hard_negatives(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), rows.filter("vec_id % 50 = 0"))


SQL = """
WITH item AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
score AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s
  FROM item a JOIN item b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positive AS (SELECT anchor_id, other_id AS positive_id, s AS positive_score FROM score WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, s AS negative_score
FROM positive JOIN score USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s AND 100 * s <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s DESC, other_id) QUALIFY row_number() OVER w <= 3
"""
