"""Benchmark decontamination: Wu-Manber search for many word windows at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import read, scratch, small_batches, spans, utf8

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Words of a block, by whose hash the shift of a position is found.
BLOCK = 2
#: Ends of windows that one cursor passes; many cursors move in step.
SEGMENT = 64
#: Bytes of normalised item texts that one pass over the documents searches for: what is broadcast at once is some twenty times as large at most.
BLOCK_BYTES = 4 << 20
#: Windows of an item that are searched for in one block, at most.
ITEM_WORDS = 4096
#: Bytes of a text that are read at once.
PIECE = 1 << 20
#: Entries of a shift table for each block of words in it.
SPARSE = 4

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


class Shifts:
    """The tables of all windows of one number of words: shifts, buckets by suffix and prefix, and the windows themselves."""

    def __init__(self, windows: list[bytes], size: int):
        self.size, self.block = size, min(BLOCK, size)
        #: The last step of a search: the words are compared as bytes.
        self.numbers = {w: k for k, w in enumerate(windows)}
        data = np.frombuffer(b" ".join(windows) + b" ", np.uint8)
        starts, ends, _ = K.words(data, np.array([0, len(data)]))
        names = block_names(K.word_hashes(data, starts, ends), self.block).reshape(-1)
        inside = size - self.block + 1
        at = np.arange(len(windows))[:, None] * size + np.arange(inside)
        names = names[at]
        self.width = max(10, int(SPARSE * at.size).bit_length())
        self.shift = np.full(1 << self.width, inside, np.uint8 if inside < 256 else np.int64)
        for j in range(inside):
            np.minimum.at(self.shift, self._slot(names[:, j]), inside - 1 - j)
        #: Hashes of the last and the first block of the windows that begin and end so.
        self.buckets = np.unique(K.mix(names[:, -1] ^ (names[:, 0] * K._BASE)))

    def _slot(self, names: np.ndarray) -> np.ndarray:
        return (names >> np.uint64(64 - self.width)).astype(np.int64)

    def search(self, blocks: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The last words of windows that may end there, of texts whose windows end at ``first`` to ``last`` (exclusive).

        ``blocks`` names the block that begins at each word. Each text is cut in segments, whose cursors
        move together: one at a block of shift zero has a candidate and goes one word on, the others
        skip as many words as no window can end at.
        """
        count = np.maximum(-(-(last - first) // SEGMENT), 0)
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        cursor = np.repeat(first, count) + place * SEGMENT
        stop = np.minimum(cursor + SEGMENT, np.repeat(last, count))
        found = []
        while len(cursor):
            names = blocks[cursor - (self.block - 1)]
            step = self.shift[self._slot(names)].astype(np.int64)
            zero = np.flatnonzero(step == 0)
            if len(zero):
                key = K.mix(names[zero] ^ (blocks[cursor[zero] - (self.size - 1)] * K._BASE))
                near = self.buckets[np.minimum(np.searchsorted(self.buckets, key), len(self.buckets) - 1)] == key
                found.append(cursor[zero[near]])
                step[zero] = 1
            cursor = cursor + step
            left = cursor < stop
            cursor, stop = cursor[left], stop[left]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def block_names(hashes: np.ndarray, block: int) -> np.ndarray:
    """A hash of the ``block`` words that begin at each word, as far as there are so many."""
    if block == 1 or len(hashes) < block:
        return K.mix(hashes)
    out = np.zeros(len(hashes), np.uint64)
    for j in range(block):
        out[: len(hashes) - j] += (hashes[j:] ^ K.constants(block, 5)[j]) * (K.constants(block, 6)[j] | np.uint64(1))
    return K.mix(out)


class Patterns:
    """All windows of some items, by their number of words, and the items of each."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        found: dict[int, dict[bytes, set[str]]] = {}
        for item, text in items:
            joined, at, _, _ = normalised(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
            raw, n = joined.tobytes(), len(at) - 1
            size = min(window, n)
            for w in range(n - size + 1) if n else ():
                found.setdefault(size, {}).setdefault(raw[at[w] : at[w + size] - 1], set()).add(item)
        self.tables = [Shifts(list(own), size) for size, own in sorted(found.items())]
        self.items = [[sorted(x) for x in own.values()] for _, own in sorted(found.items())]


def normalised(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words joined by spaces, where each begins (and the end), the words before each text, and their hashes.

    A-Z are lower-cased; words are runs of digits, of a-z and of what is not ASCII.
    """
    low = K.LOWER[data]
    solid = _WORD[low]
    starts, ends, before = K.word_edges(solid, offs)
    joined, at = K.one_space(low, solid, starts, ends)
    return joined, at, before, K.word_hashes(low, starts, ends)


def _scan(patterns: Patterns, data: np.ndarray, offs: np.ndarray):
    """Words before each text; begin, end and table and number of each window that occurs, by words."""
    joined, at, before, hashes = normalised(data, offs)
    raw, rows = None, []
    named: dict[int, np.ndarray] = {}
    for t, table in enumerate(patterns.tables):
        if table.block not in named:
            named[table.block] = block_names(hashes, table.block)
        ends = table.search(named[table.block], before[:-1] + table.size - 1, before[1:])
        if len(ends):
            raw = joined.tobytes() if raw is None else raw
            begin = ends - table.size + 1
            for w, i, j in zip(begin.tolist(), at[begin].tolist(), at[ends + 1].tolist(), strict=True):
                k = table.numbers.get(raw[i : j - 1])
                if k is not None:
                    rows.append((w, w + table.size, t, k))
    return before, rows


def _pieces(data: np.ndarray, limit: int):
    """The bytes of a long text in pieces that end where a word does."""
    at = 0
    while at < len(data):
        end = at + limit
        while end < len(data):
            loose = np.flatnonzero(~_WORD[K.LOWER[data[end : end + limit]]])
            if len(loose):
                end += int(loose[0])
                break
            end += limit
        yield data[at:end]
        at = end


def _long(patterns: Patterns, data: np.ndarray, window: int):
    """The same of one long text, a piece at a time, with the last words of one piece before the next."""
    words, rows, carry = 0, [], b""
    for piece in _pieces(data, PIECE):
        whole = np.frombuffer(carry + b" " + piece.tobytes(), np.uint8)
        joined, at, before, _ = normalised(whole, np.array([0, len(whole)]))
        known = len(carry.split(b" ")) if carry else 0
        shift = words - known
        rows += [(a + shift, b + shift, t, k) for a, b, t, k in _scan(patterns, whole, np.array([0, len(whole)]))[1] if b > known]
        n = int(before[1])
        words += n - known
        carry = joined[at[max(0, n - window + 1)] :].tobytes().strip(b" ")
    return words, rows


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """n_words, spans (begin and end word of each run that windows cover) and items of every row, beside ``carried``.

    ``items`` has item_id (string) and text and is searched for whole; its tables must be of a bounded size.
    """
    patterns = docs.sparkSession.sparkContext.broadcast(Patterns([(r["item_id"], r["text"]) for r in items.collect()], window))
    kinds = [f for f in docs.schema if f.name in carried]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "n_words bigint, spans array<struct<a:bigint,b:bigint>>, items array<string>"])

    def merged(rows, items):
        """Covered runs, and the items of the windows, in string order."""
        out: list[dict] = []
        for a, b, _, _ in sorted(rows):
            if out and a <= out[-1]["b"]:
                out[-1]["b"] = max(out[-1]["b"], b)
            else:
                out.append({"a": a, "b": b})
        return out, sorted({x for t, k in {r[2:] for r in rows} for x in items[t][k]})

    def run(batches):
        known = patterns.value
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for batch in batches:
            data, offs = utf8(batch.column("text"))
            for i, j in spans(offs):
                own = data[offs[i] : offs[j]]
                if j == i + 1 and len(own) > PIECE:
                    n, rows = _long(known, own, window)
                    counts, each = [n], [rows]
                else:
                    before, rows = _scan(known, own, offs[i : j + 1] - offs[i])
                    counts, each = np.diff(before).tolist(), [[] for _ in range(j - i)]
                    owner = np.searchsorted(before, [r[0] for r in rows], "right") - 1
                    for d, (a, b, t, k) in zip(owner.tolist(), rows, strict=True):
                        each[d].append((a - int(before[d]), b - int(before[d]), t, k))
                found = [merged(rows, known.items) if rows else ([], []) for rows in each]
                kept = [batch.column(f.name).slice(i, j - i) for f in kinds]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64()), pa.array([x for x, _ in found], kind), pa.array([x for _, x in found], pa.list_(pa.string()))], names=[*(f.name for f in kinds), "n_words", "spans", "items"])

    return small_batches(docs.select(*(f"`{f.name}`" for f in kinds), "text")).mapInArrow(run, schema)


def _item_blocks(items: DataFrame, window: int, limit: int) -> list[DataFrame]:
    """The words of the items in blocks of about ``limit`` bytes; a long item is cut in pieces that share all but one word of a window."""

    def cut(batches):
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = text.encode()
                joined, at, _, _ = normalised(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                joined = joined.tobytes()
                for w in range(0, max(1, len(at) - window), ITEM_WORDS):
                    piece = joined[at[w] : at[min(w + ITEM_WORDS + window - 1, len(at) - 1)]].decode()
                    yield pa.RecordBatch.from_pylist([{"item_id": item, "text": piece}])

    known = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text")
    kept = scratch(small_batches(known).mapInArrow(cut, "item_id string, text string"))
    size = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // limit))
    return [kept.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else kept for k in range(n)]


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans and items of every row of ``docs``: the runs of words that windows of ``items`` cover.

    A window is ``window`` consecutive words of an item, or all words of an item that has fewer; spans are
    begin and end word (exclusive) of each run, items the identifiers, as strings in their order, of the
    items any of whose windows occurs. One pass over the documents searches for the windows of one block of
    items, about ``block_bytes`` of their texts; only a block is broadcast. With several blocks, rows with
    hits are merged by doc_id and a hash of the text.

    Null and empty texts have no words. Repeated rows, and rows with a null doc_id, are each judged by their
    own text. Items with a null identifier or text take no part; texts of equal item_id are one item. Empty
    tables of documents give no rows, of items no hits. Other columns are ignored. Texts over a megabyte are
    read in pieces.
    """
    rows = docs.select("doc_id", "text")
    blocks = _item_blocks(items, window, block_bytes)
    if len(blocks) == 1:
        return occurrences(rows, blocks[0], window)
    named = rows.withColumn("_text", F.xxhash64("text")).withColumn("_size", F.octet_length("text"))
    key = ["doc_id", "_text", "_size"]
    each = [scratch(occurrences(named, block, window, tuple(key)).filter("size(spans) > 0").dropDuplicates(key)) for block in blocks]
    met = each[0]
    for more in each[1:]:
        met = met.unionByName(more)
    # of overlapping runs in order, one that begins after all before it have ended begins a new run
    ordered = F.array_sort(F.flatten(F.collect_list("spans")))
    joined = F.aggregate(
        ordered, F.array().cast("array<struct<a:bigint,b:bigint>>"),
        lambda out, x: F.when((F.size(out) > 0) & (F.element_at(out, -1)["b"] >= x["a"]),
                              F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["a"].alias("a"), F.greatest(F.element_at(out, -1)["b"], x["b"]).alias("b")))))
        .otherwise(F.concat(out, F.array(x))),
    )
    hits = met.groupBy(*key).agg(joined.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    words = occurrences(named, blocks[0].limit(0), window, tuple(key)).select(*key, "n_words")
    same = F.lit(True)
    for k in key:
        same = same & words[k].eqNullSafe(hits[k])
    none = hits.schema["spans"].dataType, hits.schema["items"].dataType
    both = words.join(hits, same, "left")
    return both.select(words["doc_id"], "n_words", *(F.coalesce(hits[c], F.array().cast(t)).alias(c) for c, t in zip(("spans", "items"), none, strict=True)))


def op12_decontam(spark, sf_dir):
    found = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["b"] - x["a"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


SQL = r"""
WITH word AS (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), p) AS w FROM documents, word),
item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), p) AS w FROM benchmark, word WHERE item_id IS NOT NULL),
pattern AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
place AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM doc, (SELECT DISTINCT k FROM pattern) WHERE len(w) >= k)),
met AS (SELECT DISTINCT doc_id, i, place.k, item_id FROM place JOIN pattern USING (k, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM met) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""
