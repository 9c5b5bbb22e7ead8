"""Removal of repeated passages: super-k-mers dealt by minimiser, windows counted by sorting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import HOT_KEYS, flag_keys, matching, read, scratch, scratch_scope, small_batches, spans, spread_join, utf8

WINDOW = 50
#: Words of a minimiser.
MINIMISER = 8
#: Windows that one super-k-mer holds at most.
RUN = 64
#: Bytes of packed strings per bucket, and of text that a task packs at a time.
BUCKET_BYTES, FLUSH_BYTES = 6 << 20, 8 << 20
#: A bucket of more bytes than this is hot: its equal strings are merged by an aggregation before they meet in a task.
#: The strings of one of ``HOT_STEP`` documents tell which are, at most ``HOT_KEYS`` of them.
HOT_BYTES, HOT_STEP = 8 * BUCKET_BYTES, 16


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, x.copy()
    while 2 * have <= width:
        out[:-have] = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out[: have - width] = np.minimum(out[: have - width], out[width - have :])
    return out


class Runs:
    """Super-k-mers of some texts: text, first word in it, windows, minimiser, two hashes, and the packed bytes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, window: int, minimiser: int):
        starts, ends, before = K.words(data, offs)
        counts = np.diff(before)
        full = np.flatnonzero(counts >= window)
        made = counts[full] - window + 1
        total = int(made.sum())
        self.size = 0
        if not total:
            self.text = self.first = self.windows = np.zeros(0, np.int64)
            self.minimum = self.h0 = self.h1 = np.zeros(0, np.uint64)
            self.packed, self.a, self.b = b"", self.first, self.first
            return
        h = K.word_hashes(data, starts, ends)
        n = len(h)
        c = K.constants(minimiser, 91)
        grams = np.zeros(n, np.uint64)
        for t in range(minimiser):
            grams[: n - t] += (h[t:] ^ c[t]) * (c[t] | np.uint64(1))
        low = _sliding_minimum(K.mix(grams), window - minimiser + 1)
        ends_of = np.cumsum(made)
        at = np.arange(total) + np.repeat(before[full] - (ends_of - made), made)
        value = low[at]
        new = np.ones(total, bool)
        new[1:] = value[1:] != value[:-1]
        new[ends_of[:-1]] = True
        begin = np.flatnonzero(new)
        place = np.arange(total) - np.repeat(begin, np.diff(np.append(begin, total)))
        begin = np.flatnonzero(place % RUN == 0)
        self.windows = np.diff(np.append(begin, total))
        self.text = np.repeat(full, made)[begin]
        first = at[begin]
        self.first = first - before[self.text]
        self.minimum = value[begin]
        joined, word_at = K.one_space(data, ~K.SPACE[data], starts, ends)
        self.a, self.b = word_at[first], word_at[first + self.windows + window - 1] - 1
        self.h0, self.h1 = (K.range_hash(K._BYTE[f][joined], self.a, self.b) for f in (0, 1))
        self.packed = joined.tobytes()
        self.size = len(begin)


def _blobs(docs: DataFrame, buckets: int, window: int, minimiser: int, hot: list[int] = (), take: bool = False) -> DataFrame:
    """Distinct super-k-mers of a task, per bucket, with the smallest doc_id of each and whether it is in other documents.

    Those of the buckets in ``hot`` alone, or all others.
    """
    named = np.array(sorted(hot), np.int64)

    def flush(held):
        ids, mins, h0, h1 = (np.concatenate([x[k] for x in held]) for k in range(4))
        part = np.concatenate([np.full(len(x[0]), k) for k, x in enumerate(held)])
        a, b = (np.concatenate([x[k] for x in held]) for k in (4, 5))
        bucket = (K.mix(mins) % np.uint64(buckets)).astype(np.int64)
        if len(named):
            pick = np.flatnonzero(np.isin(bucket, named) == take)
            if not len(pick):
                return _packed_rows([])
            ids, mins, h0, h1, part, a, b, bucket = (x[pick] for x in (ids, mins, h0, h1, part, a, b, bucket))
        order = np.lexsort((ids, h1, h0, bucket))
        new = np.ones(len(order), bool)
        new[1:] = (bucket[order][1:] != bucket[order][:-1]) | (h0[order][1:] != h0[order][:-1]) | (h1[order][1:] != h1[order][:-1])
        heads = np.flatnonzero(new)
        lasts = np.append(heads[1:], len(order)) - 1
        keep = order[heads]
        shared = ids[order[lasts]] != ids[keep]
        edges = np.append(np.flatnonzero(np.diff(bucket[keep], prepend=-1)), len(keep))
        out = []
        pack = zstandard.ZstdCompressor(level=3)
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = keep[x:y]
            strings = [held[p][6][i:j] for p, i, j in zip(part[own].tolist(), a[own].tolist(), b[own].tolist(), strict=True)]
            out.append((int(bucket[own[0]]), ids[own].tobytes(), shared[x:y].tobytes(), h0[own].tobytes(), h1[own].tobytes(), (b - a)[own].astype(np.int32).tobytes(), pack.compress(b"".join(strings)), int((b - a)[own].sum())))
        return _packed_rows(out)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            data, offs = utf8(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j in spans(offs):
                r = Runs(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], window, minimiser)
                if r.size:
                    held.append((ids[i:j][r.text], r.minimum, r.h0, r.h1, r.a, r.b, r.packed))
                    size += len(r.packed)
                if size >= FLUSH_BYTES:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, PACKED)


#: Strings of a bucket, packed: identifiers, marks, hashes, sizes and the strings themselves, and how many bytes these are.
PACKED = "bucket bigint, ids binary, shared binary, h0 binary, h1 binary, sizes binary, strings binary, size bigint"


def _packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.binary()] * 6, pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[f.split()[0] for f in PACKED.split(", ")])


def _unpack(row: dict):
    """Identifier, mark, hashes and string of each string of a packed row."""
    text = zstandard.ZstdDecompressor().decompress(row["strings"])
    ends = np.cumsum(np.frombuffer(row["sizes"], np.int32).astype(np.int64)).tolist()
    ids, shared, h0, h1 = (np.frombuffer(row[c], t).tolist() for c, t in (("ids", np.int64), ("shared", bool), ("h0", np.int64), ("h1", np.int64)))
    return zip(ids, shared, h0, h1, (text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)), strict=True)


def _merged(blobs: DataFrame) -> DataFrame:
    """The same strings, each once in its bucket: copies that any number of tasks have sent are merged by an aggregation.

    It is partial before the shuffle and streams after it, so no task holds the copies of a string.
    """

    def apart(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, shared, h0, h1, strings = zip(*_unpack(row), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([row["bucket"]] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(shared), pa.array(h0, pa.int64()), pa.array(h1, pa.int64()), pa.array(strings, pa.binary())], names=["bucket", "id", "shared", "h0", "h1", "string"])

    def together(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by("bucket").combine_chunks()
            bucket = table["bucket"].to_numpy()
            edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)).tolist()
            pack, out = zstandard.ZstdCompressor(level=3), []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own = table.slice(a, b - a)
                strings = own["string"].to_pylist()
                sizes = np.array([len(x) for x in strings], np.int32)
                out.append((int(bucket[a]), *(own[c].to_numpy().astype(t).tobytes() for c, t in (("id", np.int64), ("shared", bool), ("h0", np.int64), ("h1", np.int64))), sizes.tobytes(), pack.compress(b"".join(strings)), int(sizes.sum())))
            yield _packed_rows(out)

    rows = small_batches(blobs).mapInArrow(apart, "bucket bigint, id bigint, shared boolean, h0 bigint, h1 bigint, string binary")
    one = rows.groupBy("bucket", "h0", "h1", "string").agg(F.min("id").alias("id"), (F.bool_or("shared") | (F.min("id") != F.max("id"))).alias("shared"))
    return small_batches(one.select("bucket", "id", "shared", "h0", "h1", "string")).mapInArrow(together, PACKED)


def count_bucket(table: pa.Table, window: int) -> pa.Table:
    """For each super-k-mer that may lose words: runs of windows and the smallest doc_id that has them.

    Strings that several tasks sent become one. All windows of the bucket are sorted by a hash of
    their words; neighbours of equal hash are compared as bytes before they count as equal.
    """
    known: dict[bytes, int] = {}
    ids, shared, h0, h1 = [], [], [], []
    for row in table.to_pylist():
        for i, m, x, y, s in _unpack(row):
            k = known.setdefault(s, len(ids))
            if k == len(ids):
                ids.append(i)
                shared.append(m)
                h0.append(x)
                h1.append(y)
            else:
                shared[k] |= m or ids[k] != i
                ids[k] = min(ids[k], i)
    ids, shared = np.array(ids, np.int64), np.array(shared, bool)
    lengths = np.array([len(s) for s in known], np.int64)
    data = np.frombuffer(b"".join(known), np.uint8)
    offs = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    del known
    starts, ends, before = K.words(data, offs)
    made = np.diff(before) - window + 1
    edges = np.concatenate([[0], np.cumsum(made)])
    owner = np.repeat(np.arange(len(ids)), made)
    at = np.arange(edges[-1]) - np.repeat(edges[:-1], made) + np.repeat(before[:-1], made)
    key = K.range_hash(K.word_hashes(data, starts, ends), at, at + window)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    raw = data.tobytes()
    left, right = at[order[:-1][same]], at[order[1:][same]]
    a, b, c, d = (x.tolist() for x in (starts[left], ends[left + window - 1], starts[right], ends[right + window - 1]))
    if not all(raw[i:j] == raw[k:m] for i, j, k, m in zip(a, b, c, d, strict=True)):
        exact: dict[bytes, int] = {}
        key = np.array([exact.setdefault(raw[i:j], len(exact)) for i, j in zip(starts[at].tolist(), ends[at + window - 1].tolist(), strict=True)])
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
    heads = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else np.zeros(0, np.int64)
    low = np.empty(len(order), np.int64)
    if len(order):
        low[order] = np.repeat(np.minimum.reduceat(ids[owner[order]], heads), np.diff(np.append(heads, len(order))))
    useful = shared[owner] | (low < ids[owner])
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(low))
    pick = useful[begin] if len(begin) else np.zeros(0, bool)
    begin, end = begin[pick], end[pick]
    own = owner[begin]
    return pa.table({"h0": np.array(h0, np.int64)[own], "h1": np.array(h1, np.int64)[own], "w_from": begin - edges[own], "w_to": end - edges[own], "least": low[begin]})


def repeat_spans(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """doc_id, a hash of the text, and spans: first and last word (exclusive) of each run to remove.

    Two rounds. First each task packs its distinct super-k-mers, one string for all documents that
    share it, and sends them to the bucket of their minimiser, where windows are sorted and the
    smallest doc_id of each is found; copies of a string in the largest buckets are merged before.
    Then the documents' super-k-mers, as hashes, are joined with the strings found to repeat; those
    in very many documents are not shuffled.
    """
    rows = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(48, int(size * 3.3) // BUCKET_BYTES)
    hot = []
    if 3.3 * size > HOT_BYTES:
        some = _blobs(rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(HOT_STEP)) == 0), buckets, window, minimiser).groupBy("bucket").agg(F.sum("size").alias("_bytes"))
        hot = [r["bucket"] for r in some.filter(F.col("_bytes") * HOT_STEP > HOT_BYTES).orderBy(F.desc("_bytes")).limit(HOT_KEYS).collect()]
    blobs = _blobs(rows, buckets, window, minimiser, hot)
    if hot:
        blobs = blobs.unionByName(_merged(_blobs(rows, buckets, window, minimiser, hot, True)))
    # a task holds one bucket after the other; eight buckets to a task keep what it reads bounded at any size
    found = scratch(blobs.repartition(max(48, buckets // 8), "bucket").groupBy("bucket").applyInArrow(lambda t: count_bucket(t, window), "h0 bigint, h1 bigint, w_from bigint, w_to bigint, least bigint"))

    def run(batches):
        for batch in batches:
            data, offs = utf8(batch.column("text"))
            for i, j in spans(offs):
                r = Runs(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], window, minimiser)
                at = pa.array(r.text + i)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("_text").take(at), pa.array(r.first), pa.array(r.h0.view(np.int64)), pa.array(r.h1.view(np.int64))], names=["doc_id", "_text", "first", "h0", "h1"])

    own = small_batches(rows.withColumn("_text", F.xxhash64("text"))).mapInArrow(run, "doc_id bigint, _text bigint, first bigint, h0 bigint, h1 bigint")
    near = scratch(matching(own, found, ["h0", "h1"]))
    # of each string, the runs of its windows and how many documents' strings they are for
    runs = found.groupBy("h0", "h1").agg(F.collect_list(F.struct("w_from", "w_to", "least")).alias("_runs"))
    counted = scratch(runs.join(near.groupBy("h0", "h1").agg(F.count("*").alias("n")), ["h0", "h1"]))
    met = spread_join(near, counted, ["h0", "h1"]).select("doc_id", "_text", "first", F.inline("_runs")).filter("least < doc_id")
    span = F.struct((F.col("first") + F.col("w_from")).alias("a"), (F.col("first") + F.col("w_to") + window - 1).alias("b"))
    return met.groupBy("doc_id", "_text").agg(F.collect_set(span).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space) of every row.

    A word goes if a window of ``window`` words of its document covers it whose words also start
    somewhere in a document with a smaller doc_id; windows are those of the input. Null and empty
    texts have no words; texts shorter than a window lose none; rows with a null doc_id neither
    lose words nor cost others any. Rows of one doc_id are one document: windows that only they
    share stay, and each is judged by its own text. Other columns are ignored.
    """
    with scratch_scope(docs.sparkSession):
        found = scratch(repeat_spans(docs, window, minimiser), keep=True)
    rows = docs.select("doc_id", "text").withColumn("_text", F.xxhash64("text"))
    flagged = flag_keys(rows, found, ["doc_id", "_text"])
    none = F.lit(None).cast(found.schema["spans"].dataType)
    both = flagged.filter("_hit").drop("_hit").join(found, ["doc_id", "_text"], "left").select("doc_id", "text", "spans")
    both = both.unionByName(flagged.filter("NOT _hit").select("doc_id", "text", none.alias("spans")))

    def run(batches):
        for batch in batches:
            data, offs = utf8(batch.column("text"))
            removed = batch.column("spans")
            for i, j in spans(offs):
                own = data[offs[i] : offs[j]]
                starts, ends, before = K.words(own, offs[i : j + 1] - offs[i])
                joined, at = K.one_space(own, ~K.SPACE[own], starts, ends)
                raw = joined.tobytes()
                kept, gone = [], []
                for d in range(j - i):
                    w, z = int(before[d]), int(before[d + 1])
                    text, lost = raw[at[w] : max(at[w], at[z] - 1)], 0
                    if removed[i + d].is_valid:
                        alive = np.ones(z - w, bool)
                        for s in removed[i + d].as_py():
                            alive[s["a"] : s["b"]] = False
                        lost = int((~alive).sum())
                        words = text.split(b" ")
                        text = b" ".join([words[k] for k in np.flatnonzero(alive).tolist()])
                    kept.append(text.decode())
                    gone.append(lost)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(before)), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return small_batches(both).mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def op8_substring_dedup(spark, sf_dir):
    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
