"""Candidate pairs of shared keys, links verified on full sets, and connected components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import HOT_KEYS, HOT_ROWS, scratch, small_batches, spread_join, utf8

#: Keys that are sorted at once, about, and keys that a worker packs at a time.
SLOT_KEYS, FLUSH_KEYS = 1 << 17, 1 << 19
#: Every so-many-th set's keys are counted to find the hot ones.
HOT_STEP = 16
#: Tasks that the members of one bucket may be compared with its leader in.
LEADER_PARTS = 1024
#: Set members that one verification task holds at most, unless one text alone has more.
TASK_MEMBERS = 4_000_000
#: Sets of a group that are compared each with each, at most; in larger groups their rarest members choose whom to compare.
FEW_SETS = 48
#: Sets times their members that are compared as rows of bits, at most.
BIT_CELLS = 1 << 24
#: Bytes of texts that a worker gathers before it links the groups among them.
FLUSH_BYTES = 2 << 20
#: Edges of a component search that one file holds, about.
EDGES_PER_FILE = 250_000


def _with_least(edges: DataFrame, hot: bool) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) with the smallest v of each u as m, and the table of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if not hot:
        return edges.join(least.drop("n"), "u"), least
    least = scratch(least)
    return spread_join(edges, least, ["u"]), least


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b), the component named by its smallest node.

    Alternates large-star and small-star rounds; each is a partially aggregated minimum and an
    equi-join, in which the rows of hubs are not shuffled. Each round's edges are written to the
    shared folder. Nodes are longs.
    """
    now = scratch(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # done when each node has one edge and none leads on
        ends = now.select("u", F.lit(1).alias("out")).unionByName(now.select(F.col("v").alias("u"), F.lit(0).alias("out")))
        nodes = ends.groupBy("u").agg(F.sum("out").alias("outs"), F.min("out").alias("least"), F.count("*").alias("n"))
        loose, rows, most = nodes.agg(F.count_if((F.col("outs") > 1) | ((F.col("outs") == 1) & (F.col("least") == 0))), F.sum("outs"), F.max("n")).first()
        if not loose:
            break
        hot = most > HOT_ROWS
        met, _ = _with_least(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), hot)
        large = met.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = scratch(large) if hot else large
        met, roots = _with_least(large, hot)
        small = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(roots.select("u", F.col("m").alias("v"))).distinct()
        # a round's edges are as many as the last one's or fewer, so its files need not be as many as its tasks
        now = scratch(small.coalesce(max(8, rows // EDGES_PER_FILE)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, weights and the bands as rows of a matrix; bands are lists of longs or their bytes."""
    bands = batch.column("bands")
    bands = utf8(bands)[0].view(np.uint64) if pa.types.is_binary(bands.type) else bands.flatten().to_numpy().view(np.uint64)
    return batch.column("id").to_numpy(), batch.column("weight").to_numpy(), bands.reshape(batch.num_rows, -1)


def _stars(key: np.ndarray, ids: np.ndarray, weight: np.ndarray, near: tuple[int, int]) -> pa.Table:
    """The pairs of whole buckets, as ``bucket_stars`` returns them."""
    num, den = near
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    order = order[np.lexsort((ids[order], key[order]))]
    key, ids, weight = key[order], ids[order], weight[order].astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.append(begin, len(key)))
    lead = np.repeat(begin, n)
    name = K.mix(np.add.reduceat(K.mix(ids.view(np.uint64)), begin) + n.astype(np.uint64)).view(np.int64) if len(key) else key.view(np.int64)
    large = np.repeat(n > 2, n)
    low, high = np.minimum(weight, weight[lead]), np.maximum(weight, weight[lead])
    pick = (np.arange(len(key)) != lead) & (large | (den * low >= num * high))
    bucket = pa.array(np.repeat(name, n)[pick], mask=~large[pick])
    made = pa.table({"bucket": bucket, "a": ids[lead][pick], "b": ids[pick], "wa": weight[lead][pick], "wb": weight[pick]})
    return made.group_by(made.column_names).aggregate([])


def bucket_stars(sets: DataFrame, rows: int, expand: Callable[[np.ndarray], np.ndarray], width: int, near: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of the smallest id of each bucket and another member, with their weights.

    ``sets`` has (id, weight, bands), ``rows`` rows about; ``expand`` turns a matrix of bands into one
    of ``width`` keys a row. ``bucket`` names the member set of a bucket of three and more; of smaller
    ones only pairs whose weights allow a similarity of ``near`` stay.

    Keys are shuffled once, packed in arrays by slots of about ``SLOT_KEYS`` keys, and sorted there.
    The most frequent keys, at most ``HOT_KEYS``, are found by counting one of ``HOT_STEP`` sets;
    their smallest ids are broadcast, and their rows are not shuffled.
    """
    slots = max(8, -(-rows * width // SLOT_KEYS))

    def all_keys(batches):
        for b in batches:
            ids, weight, bands = _matrix(b)
            key = expand(bands).reshape(-1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(ids, width)), pa.array(np.repeat(weight, width).astype(np.int64))], names=["key", "id", "weight"])

    kind = "key bigint, id bigint, weight bigint"
    counted = small_batches(sets.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(HOT_STEP)) == 0)).mapInArrow(all_keys, kind).groupBy("key").agg(F.count("*").alias("n"))
    hot = sorted(r["key"] for r in counted.filter(F.col("n") > HOT_ROWS // HOT_STEP).orderBy(F.desc("n")).limit(HOT_KEYS).collect())
    known = np.array(hot, np.int64)

    def deal(batches):
        held, size = [], 0

        def flush():
            ids, weight, bands = (np.concatenate([h[k] for h in held]) for k in range(3))
            key = expand(bands).reshape(-1)
            ids, weight = np.repeat(ids, width), np.repeat(weight, width).astype(np.int32)
            if len(known):
                cold = ~np.isin(key.view(np.int64), known)
                key, ids, weight = key[cold], ids[cold], weight[cold]
            slot = (key % np.uint64(slots)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            key, ids, weight, slot = key[order], ids[order], weight[order], slot[order]
            edges = np.append(np.flatnonzero(np.diff(slot, prepend=-1)), len(slot)).tolist()
            cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(slot[edges[:-1]]), cut(key), cut(ids), cut(weight)], names=["slot", "key", "id", "weight"])

        for b in batches:
            if b.num_rows:
                held.append(_matrix(b))
                size += b.num_rows * width
            if size >= FLUSH_KEYS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def sort(batches):
        now, held = None, []

        def done():
            return _stars(*(np.frombuffer(b"".join(x[k] for x in held), t) for k, t in enumerate((np.uint64, np.int64, np.int32))), near).to_batches()

        for b in batches:
            for slot, *parts in zip(*(b.column(c).to_pylist() for c in ("slot", "key", "id", "weight")), strict=True):
                if slot != now and held:
                    yield from done()
                    held = []
                now = slot
                held.append(parts)
        if held:
            yield from done()

    schema = "bucket bigint, a bigint, b bigint, wa bigint, wb bigint"
    dealt = small_batches(sets).mapInArrow(deal, "slot bigint, key binary, id binary, weight binary").repartition(max(8, slots // 8), "slot").sortWithinPartitions("slot")
    stars = small_batches(dealt).mapInArrow(sort, schema)
    if hot:

        def hot_keys(batches):
            for b in all_keys(batches):
                pick = np.flatnonzero(np.isin(b.column("key").to_numpy(), known))
                yield b.take(pa.array(pick))

        found = scratch(small_batches(sets).mapInArrow(hot_keys, kind))
        lead = found.groupBy("key").agg(F.min(F.struct("id", "weight")).alias("_lead"))
        pairs = found.join(F.broadcast(lead), "key").filter("_lead.id <> id")
        stars = stars.unionByName(pairs.select(F.col("key").alias("bucket"), F.col("_lead.id").alias("a"), F.col("id").alias("b"), F.col("_lead.weight").alias("wa"), F.col("weight").alias("wb")))
    return stars


def verified_pairs(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], sets: Callable, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that come near enough, with a level.

    Level 2: den * intersection >= num * union. Level 1: the similarity is at least 2 * num / den - 1.
    ``texts`` adds the text to a frame of ids and ``sets`` turns texts into sorted sets. A pair meets
    in the group of its smaller id; a group is dealt to up to ``LEADER_PARTS`` parts, and its members
    pass the leader one batch after the other, so it may be of any size.
    """
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(LEADER_PARTS)).cast("int").alias("_part"))
    rows = dealt.select("a", "_part", F.col("b").alias("id")).unionByName(dealt.select("a", "_part", F.col("a").alias("id")).distinct())
    rows = texts(rows).select("a", "_part", "id", "text").repartition("a", "_part").sortWithinPartitions("a", "_part", "id")

    def judge(table: pa.Table, leader):
        table = table.combine_chunks()
        a, part, ids = (table[c].to_numpy() for c in ("a", "_part", "id"))
        edges = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (part[1:] != part[:-1]), [True]]))
        values, after = sets(table["text"].combine_chunks())
        near = np.zeros(len(a), np.int8)
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if ids[i] == a[i]:
                leader = (a[i], part[i], values[after[i] : after[i + 1]])
                i += 1
            own = leader[2]
            if i == j or (leader[0], leader[1]) != (a[i], part[i]) or not len(own):
                continue
            x = values[after[i] : after[j]]
            hits = np.concatenate([[0], np.cumsum(own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x)])
            met = hits[after[i + 1 : j + 1] - after[i]] - hits[after[i:j] - after[i]]
            union = len(own) + np.diff(after[i : j + 1]) - met
            near[i:j] = np.where(den * met >= num * union, 2, np.where(den * met >= (2 * num - den) * union, 1, 0))
        pick = np.flatnonzero(near)
        return pa.RecordBatch.from_arrays([pa.array(a[pick]), pa.array(ids[pick]), pa.array(near[pick].astype(np.int32))], names=["a", "b", "level"]), leader

    def run(batches):
        held, size, leader = [], 0, None
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= FLUSH_BYTES:
                out, leader = judge(pa.Table.from_batches(held), leader)
                yield out
                held, size = [], 0
        if held and any(b.num_rows for b in held):
            yield judge(pa.Table.from_batches(held), leader)[0]

    return small_batches(rows).mapInArrow(run, "a bigint, b bigint, level int")


def linked_components(sets: DataFrame, rows: int, expand: Callable, width: int, texts: Callable[[DataFrame], DataFrame], members: Callable, num: int, den: int) -> DataFrame:
    """(node, component) of the ids that links join; ids are compared where they share a key.

    ``sets`` has (id, weight, bands), see ``bucket_stars``; ``texts`` gives (id, text) of a frame of
    ids and ``members`` turns texts into sorted sets. First each bucket's smallest id is compared
    with its other members. Where x is linked to that leader and the leader's similarity to y is
    less than 2 * num / den - 1, x and y cannot be linked, since the Jaccard distance is a metric.
    What this leaves open is compared inside its bucket, but for members that the links found so far
    connect; large buckets are dealt to several tasks.
    """
    reach = (2 * num - den, den)
    stars = scratch(bucket_stars(sets, rows, expand, width, reach))
    found_texts = scratch(texts(stars.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    add = lambda frame: frame.join(found_texts, "id")
    close = F.lit(reach[1]) * F.least("wa", "wb") >= F.lit(reach[0]) * F.greatest("wa", "wb")
    levels = scratch(verified_pairs(stars.filter(close).select("a", "b").distinct(), add, members, num, den))
    found = scratch(components(levels.filter("level = 2").select("a", "b")))
    large = stars.filter("bucket IS NOT NULL").select("bucket", "a", "b", "wb").distinct()
    marked = large.join(levels, ["a", "b"], "left").select("bucket", F.col("b").alias("id"), F.col("wb").alias("weight"), F.coalesce("level", F.lit(0)).alias("level"))
    marked = scratch(marked.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")))
    # level 2 is one component; level 1 may be linked to all, level 0 to all but level 2
    name = lambda f, cond: f(F.when(cond, F.col("component")))
    low, one = F.col("level") < 2, F.col("level") == 1
    sums = marked.groupBy("bucket").agg(F.count("*").alias("n"), name(F.min, ~low).alias("lead"), name(F.min, low).alias("l0"), name(F.max, low).alias("l1"), name(F.min, one).alias("m0"), name(F.max, one).alias("m1"), F.count_if(low).alias("few"), F.min(F.when(low, F.col("weight"))).alias("w0"), F.max(F.when(low, F.col("weight"))).alias("w1"))
    # two sets whose sizes are too different cannot be linked
    unlike = (F.col("few") == 2) & (F.lit(den) * F.col("w0") < F.lit(num) * F.col("w1"))
    sums = sums.select("bucket", "n", F.coalesce((F.col("l0") != F.col("l1")) & ~unlike, F.lit(False)).alias("among"), F.coalesce((F.col("m0") != F.col("lead")) | (F.col("m1") != F.col("lead")), F.lit(False)).alias("across"))
    sums = scratch(sums.filter("among OR across"))
    if sums.isEmpty():
        return found
    apart = spread_join(marked, sums, ["bucket"]).filter("across OR level < 2").select(F.col("bucket").alias("block"), "id", "weight", "component")
    more = verified_links(scratch(apart), add, members, num, den)
    if more.isEmpty():
        return found
    return scratch(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))


def prefix_lists(ids: np.ndarray, after: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each set its rarest members, as many as two qualifying sets must share one of, and the sets by such a member.

    Returns the members and where those of each set begin, the sets sorted by member and where each
    member's begin. A set x that qualifies with another shares den * shared >= num * |x| members with
    it, so in one order of all members both have one in common among their first |x| - shared + 1.
    """
    size = np.diff(after)
    owner = np.repeat(np.arange(len(size)), size)
    often = np.bincount(ids, minlength=1)
    order = np.lexsort((ids, often[ids], owner))
    ids = ids[order]
    place = np.arange(len(ids)) - np.repeat(after[:-1], size)
    keep = (place < np.repeat(size + -(num * size) // den + 1, size)) & (often[ids] > 1)
    members, owner = ids[keep], owner[keep]
    begin = np.searchsorted(owner, np.arange(len(size) + 1))
    by = np.argsort(members, kind="stable")
    return members, begin, owner[by], np.searchsorted(members[by], np.arange(len(often) + 1))


def _few_links(values: np.ndarray, after: np.ndarray, num: int, den: int, label: np.ndarray) -> list[tuple[int, int]]:
    """``link_sets`` of a few sets: all pairs that may qualify at once, sets as bits of the members that several have."""
    sizes = np.diff(after)
    low, high = np.minimum.outer(sizes, sizes), np.maximum.outer(sizes, sizes)
    a, b = np.nonzero(np.triu((label[:, None] != label) & (den * low >= num * high) & (low > 0), 1))
    if not len(a):
        return []
    order = np.argsort(values)
    ranked = values[order]
    again = np.concatenate([[False], ranked[1:] == ranked[:-1], [False]])
    several = np.flatnonzero(again[1:] | again[:-1])
    place = np.cumsum(~again[several]) - 1
    marks = np.zeros((len(sizes), -(-(int(place[-1]) + 1 if len(place) else 1) // 64) * 64), bool)
    marks[np.repeat(np.arange(len(sizes)), sizes)[order[several]], place] = True
    bits = np.packbits(marks, axis=1).view(np.uint64)
    met = np.bitwise_count(bits[a] & bits[b]).sum(1, dtype=np.int64)
    near = den * met >= num * (sizes[a] + sizes[b] - met)
    links, label = [], label.copy()
    for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
        if label[i] != label[j]:
            label[label == label[j]] = label[i]
            links.append((i, j))
    return links


def link_sets(values: np.ndarray, after: np.ndarray, num: int, den: int, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join all sets with den * intersection >= num * union, but those between equal labels.

    Every pair of sets that the links found so far leave apart is compared if the rarest members of
    both meet, so the components of the links are those of all qualifying pairs.
    """
    n = len(after) - 1
    label = np.arange(n) if label is None else label.copy()
    if n <= FEW_SETS and n * len(values) <= BIT_CELLS:
        return _few_links(values, after, num, den, label)
    sizes = np.diff(after)
    ids = np.unique(values, return_inverse=True)[1] if len(values) else values.astype(np.int64)
    flags = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    links = []
    left = len(np.unique(label))
    lists = prefix_lists(ids, after, num, den) if n > FEW_SETS else None
    for i in range(n - 1):
        if left == 1:
            break
        if not sizes[i]:
            continue
        out = None
        if lists:
            members, begin, sets, edges = lists
            own = members[begin[i] : begin[i + 1]]
            a, b = edges[own], edges[own + 1]
            # as many as there are sets: then all of them are compared
            if int((b - a).sum()) < n:
                out = np.unique(np.concatenate([sets[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)] or [sets[:0]]))
                out = out[(out > i) & (label[out] != label[i])]
        if out is None:
            out = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        size = sizes[out]
        out = out[(den * np.minimum(size, sizes[i]) >= num * np.maximum(size, sizes[i])) & (size > 0)]
        if not len(out):
            continue
        own = ids[after[i] : after[i + 1]]
        flags[own] = True
        size = sizes[out]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(after[out] - (ends - size), size)
        met = np.add.reduceat(flags[ids[at]].astype(np.int64), ends - size)
        flags[own] = False
        for j in out[den * met >= num * (sizes[i] + size - met)].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                left -= 1
                links.append((i, j))
    return links


def _verify(rows: DataFrame, by: list[str], sets: Callable, num: int, den: int) -> DataFrame:
    """Links within groups; rows have id, text and, where components are known, component.

    Groups are runs of equal group hash in sorted partitions, and a worker turns many of them into
    sets at once: most groups are pairs, and a call for each would cost more than its work. Two
    groups of equal hash are one larger group, in which no more than what qualifies is linked.
    """
    kind = rows.schema["id"].dataType.simpleString()
    known = "component" in rows.columns
    cols = ["_group", "id", "text", *(["component"] if known else [])]
    dealt = rows.withColumn("_group", F.xxhash64(*by)).select(*cols).repartition("_group").sortWithinPartitions("_group")

    def link(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        group = table["_group"].to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        label = np.unique(table["component"].to_numpy(), return_inverse=True)[1] if known else None
        values, after = sets(table["text"].combine_chunks())
        pairs = []
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if j - i > 1:
                own = link_sets(values[after[i] : after[j]], after[i : j + 1] - after[i], num, den, None if label is None else label[i:j])
                pairs += [(i + x, i + y) for x, y in own]
        ids = table["id"].combine_chunks()
        a, b = (pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1))
        return pa.RecordBatch.from_arrays([ids.take(a), ids.take(b)], names=["a", "b"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column("_group").to_numpy()
            # where the last group of this batch begins, which may go on in the next
            last = int(np.searchsorted(group, group[-1]))
            before = held and held[-1].column("_group")[-1].as_py() != group[0]
            if size >= FLUSH_BYTES and (last or before):
                if last:
                    held.append(batch.slice(0, last))
                yield link(pa.Table.from_batches(held))
                held, size, batch = [], 0, batch.slice(last)
            held.append(batch)
            size += batch.nbytes
        if held:
            yield link(pa.Table.from_batches(held))

    return small_batches(dealt).mapInArrow(run, f"a {kind}, b {kind}")


def verified_links(members: DataFrame, texts: Callable[[DataFrame], DataFrame], sets: Callable, num: int, den: int, task: int = TASK_MEMBERS) -> DataFrame:
    """Edges between members of a block whose sets qualify, enough to give the true components.

    ``members`` has id, block, weight (set size) and may have the component that other links give an
    id; members of one component are not compared. A block over ``task`` set members is dealt to
    several tasks by id: first each part is linked on its own, then one member of each component
    found is compared, and where a block still falls apart sets meet by their rarest members,
    without the pairs already connected. No task holds more than two parts.
    """
    known = "component" in members.columns
    sizes = scratch(members.groupBy("block").agg(F.ceil(F.sum("weight") / task).cast("int").alias("_q"), F.count("*").alias("n")))
    parted = scratch(spread_join(members, sizes, ["block"]).drop("n").withColumn("part", F.pmod(F.xxhash64("id"), F.col("_q")).cast("int")))
    found = scratch(_verify(texts(parted.select("id", "block", "part", *(["component"] if known else []))), ["block", "part"], sets, num, den))
    if sizes.filter("_q > 1").isEmpty():
        return found
    before = members.select(F.col("id").alias("a"), F.col("component").alias("b")).distinct() if known else found.limit(0)

    def labelled(edges):
        named = components(edges.unionByName(before)).withColumnRenamed("node", "id")
        return parted.filter("_q > 1").drop("component").join(named, "id", "left").withColumn("component", F.coalesce("component", "id"))

    heads = labelled(found).withColumn("_r", F.row_number().over(Window.partitionBy("block", "component", "part").orderBy("id"))).filter("_r = 1").drop("_r")
    loads = heads.groupBy("block").agg(F.ceil(F.sum("weight") / task).cast("int").alias("_h"))
    heads = heads.join(loads, "block").withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), F.col("_h")).cast("int"))
    found = scratch(found.unionByName(_verify(texts(heads.select("id", "block", "part", "component")), ["block", "part"], sets, num, den)))
    rest = labelled(found)
    apart = rest.groupBy("block").agg(F.min("component").alias("_l"), F.max("component").alias("_m")).filter("_l <> _m").select("block")
    more = _by_members(rest.join(apart, "block", "left_semi").select("id", "block", "component"), texts, sets, num, den, task)
    return scratch(found.unionByName(more))


def _by_members(rows: DataFrame, texts: Callable[[DataFrame], DataFrame], sets: Callable, num: int, den: int, task: int) -> DataFrame:
    """Links between the components of large blocks: sets meet where one of their rarest members is the same.

    Members are counted in their block, and each set goes to the groups of as many of its rarest ones
    as two qualifying sets must share one of (see ``prefix_lists``). The work grows with the sets, not
    with their pairs. Only a group over ``task`` set members is dealt to pairs of its parts.
    """

    def run(batches):
        for b in batches:
            values, after = sets(b.column("text"))
            size = np.diff(after)
            at = pa.array(np.repeat(np.arange(b.num_rows), size))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("id", "block", "component")), pa.array(values.view(np.int64)), pa.array(np.repeat(size, size))], names=["id", "block", "component", "member", "size"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    each = scratch(small_batches(texts(rows).select("id", "block", "component", "text")).mapInArrow(run, f"{fields}, member bigint, size bigint"))
    often = scratch(each.groupBy("block", "member").agg(F.count("*").alias("n")).filter("n > 1"))
    own = Window.partitionBy("block", "id")
    # members that no other set has come first and meet nothing
    ranked = spread_join(each, often, ["block", "member"]).withColumn("_k", F.row_number().over(own.orderBy("n", "member"))).withColumn("_m", F.count("*").over(own))
    kept = scratch(ranked.filter(F.col("size") - F.col("_m") + F.col("_k") <= F.col("size") - F.ceil(F.col("size") * num / den) + 1).select("id", "block", "component", "member", "size"))
    parts = scratch(kept.groupBy("block", "member").agg(F.ceil(F.sum("size") / task).cast("int").alias("_q"), F.count("*").alias("n")).filter("n > 1"))
    dealt = spread_join(kept, parts, ["block", "member"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("_q")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.when(F.col("_q") > 1, F.sequence(F.lit(0), F.col("_q") - 1)).otherwise(F.array(F.lit(0)))))
    pairs = dealt.select("id", "block", "member", "component", F.least("part", "_o").alias("p"), F.greatest("part", "_o").alias("r"))
    return _verify(texts(pairs), ["block", "member", "p", "r"], sets, num, den)
