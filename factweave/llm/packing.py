"""Packing token sequences: linear grouping, configurations, substitution and best fit."""

from __future__ import annotations

import array
import json
import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, scratch, small_batches, utf8

CAPACITY = 2048
#: Pieces longer than this share of the capacity are large.
LARGE = 1 / 8
#: Groups of equal cardinality that the large lengths are rounded up within, and the numbers of them that are tried:
#: many round up less, few leave more of their configurations whole.
GROUPS = 40
TRIED = (20, 30, 40, 60)
#: Bytes of words, and of parts of words, whose ids a Python worker remembers at most.
REMEMBERED = 24 << 20
#: What the fast way of finding ids assumes of a vocabulary; any other is asked for whole texts.
_NORMAL = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Rows that one rank window holds, on average at most, for one length.
BLOCK_ROWS = 200_000


# --- tokens ------------------------------------------------------------------------------------


#: After lower-casing: runs of letters, single digits, and the rest, for words of ASCII and Latin-1.
_PART = re.compile("[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
#: Words with these take the tokenizer's own way: apostrophes, special tokens, controls, other scripts.
_OTHER = re.compile("['<\x00-\x20\x7f-\xa0\u0100-\U0010ffff]")
#: The printable form that byte-level vocabularies give each byte; the others follow from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _PRINTED} | {b: 256 + n for n, b in enumerate(x for x in range(256) if x not in _PRINTED)}


def reads_words(tokenizer) -> bool:
    """Whether the ids of a text are those of its runs between white space, each by the steps that ``Ids`` takes."""
    d = json.loads(tokenizer.to_str())
    normal, split, model = d["normalizer"] or {}, d["pre_tokenizer"] or {}, d["model"]
    steps = [(x["type"], x.get("pattern", {}).get("Regex")) for x in normal.get("normalizers", [])]
    first, last = (split.get("pretokenizers") or [{}, {}])[:1], (split.get("pretokenizers") or [{}])[1:]
    same = steps == _NORMAL and [x.get("pattern", {}).get("Regex") for x in first] == [_SPLIT] and [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in last] == [("ByteLevel", False, False)]
    return same and d["post_processor"] is None and model["type"] == "BPE" and not model.get("unk_token") and not model.get("dropout") and all(x["special"] and "<" in x["content"] for x in d["added_tokens"])


class Ids(dict):
    """Ids of runs between ASCII white space, as bytes of 32-bit numbers.

    Of a vocabulary that lower-cases and splits as ``reads_words`` tells, a text's ids are those of its
    runs; runs and their parts are remembered up to a bound in bytes. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.by_words = reads_words(self.whole)
        self.parts: dict[str, bytes] = {}
        self.held = self.held_parts = 0

    def _encoded(self, s: str) -> bytes:
        return array.array("I", self.whole.encode(s, add_special_tokens=False).ids).tobytes()

    def part(self, s: str) -> bytes:
        found = array.array("I", [t.id for t in self.model.tokenize(s if s.isascii() else s.encode().decode("latin-1").translate(_BYTES))]).tobytes()
        self.parts[s] = found
        self.held_parts += len(s) + len(found)
        return found

    def __missing__(self, word: bytes) -> bytes:
        s = word.decode()
        if _OTHER.search(s):
            found = self._encoded(s)
        else:
            parts = self.parts
            found = b"".join([parts.get(p) or self.part(p) for p in _PART.findall(s.lower())])
        self[word] = found
        self.held += len(word) + len(found)
        return found

    def text(self, raw: bytes) -> bytes:
        if not self.by_words:
            return self._encoded(raw.decode())
        if self.held > REMEMBERED:
            self.clear()
            self.held = 0
        if self.held_parts > REMEMBERED:
            self.parts.clear()
            self.held_parts = 0
        return b"".join(map(self.__getitem__, raw.split()))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0, text_columns: list[str] = ("doc_id",)) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document, the id ``end`` closing each document."""
    keep = list(text_columns)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids = Ids(tokenizer)
        tail = np.array([end], "<u4").tobytes()
        step = 4 * capacity
        for b in batches:
            data, offs = utf8(b.column("text"))
            raw = data.tobytes()
            row, piece, start, length, crc = [], [], [], [], []
            for d in range(b.num_rows):
                made = ids.text(raw[offs[d] : offs[d + 1]]) + tail
                for p, at in enumerate(range(0, len(made), step)):
                    part = made[at : at + step]
                    row.append(d)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in keep], pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=[*keep, "piece", "start", "length", "ids_crc32"])

    return small_batches(docs.select(*keep, "text")).mapInArrow(run, f"{kinds}, piece int, start bigint, length bigint, ids_crc32 bigint")


# --- the plan ----------------------------------------------------------------------------------


def linear_groups(counts: np.ndarray, large: int, groups: int) -> list[tuple[int, int]]:
    """(rounded length, cardinality) of the large lengths, dealt from the longest down."""
    total = int(counts[large:].sum())
    out, size, have, top = [], -(-total // groups) if total else 0, 0, 0
    for length in range(len(counts) - 1, large - 1, -1):
        left = int(counts[length])
        while left:
            top = top or length
            take = min(left, size - have)
            have += take
            left -= take
            if have == size:
                out.append((top, have))
                have = top = 0
    if have:
        out.append((top, have))
    merged: dict[int, int] = {}
    for length, n in out:
        merged[length] = merged.get(length, 0) + n
    return sorted(merged.items(), reverse=True)


def _knapsack(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best multiset of sizes within the capacity, by dynamic programming, one size after the other.

    For a size s the rooms that differ by multiples of s are a column; the best with any number of
    copies is a running maximum down the column, less what the copies are worth.
    """
    order = [k for k in range(len(sizes)) if values[k] > 1e-12 and sizes[k] <= capacity]
    tables = [np.zeros(capacity + 1)]
    for k in order:
        rows = -(-(capacity + 1) // sizes[k])
        padded = np.full(rows * sizes[k], -np.inf)
        padded[: capacity + 1] = tables[-1]
        worth = np.arange(rows)[:, None] * values[k]
        tables.append((np.maximum.accumulate(padded.reshape(rows, -1) - worth, axis=0) + worth).reshape(-1)[: capacity + 1])
    out, room = np.zeros(len(sizes), np.int64), capacity
    for k, before, now in zip(order[::-1], tables[-2::-1], tables[:0:-1], strict=True):
        copies = np.arange(room // sizes[k] + 1)
        out[k] = np.argmax(before[room - copies * sizes[k]] + copies * values[k] >= now[room] - 1e-9)
        room -= int(out[k]) * sizes[k]
    return float(tables[-1][capacity]), out


def configurations(groups: list[tuple[int, int]], capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Configurations of rounded lengths and how often each is used, by column generation.

    The linear programme over configurations starts with one length each; a knapsack prices new
    ones until none helps. Uses are rounded down; what is left is for best fit.
    """
    sizes = [s for s, _ in groups]
    need = np.array([n for _, n in groups], float)
    m = len(sizes)
    if not m:
        return []
    basis = np.diag([float(capacity // s) for s in sizes])
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(m))
        value, column = _knapsack(sizes, prices, capacity)
        if value <= 1 + 1e-9:
            break
        use, change = np.linalg.solve(basis, need), np.linalg.solve(basis, column.astype(float))
        ratio = np.where(change > 1e-9, np.maximum(use, 0) / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    use = np.floor(np.maximum(np.linalg.solve(basis, need), 0) + 1e-9)
    return [(np.rint(basis[:, k]).astype(np.int64), int(use[k])) for k in range(m) if use[k] > 0]


class _Bins:
    """Runs of alike bins by the room they have left; each run is (first bin, how many)."""

    def __init__(self, capacity: int):
        self.room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.capacity, self.made = capacity, 0

    def put(self, room: int, first: int, n: int) -> None:
        if n:
            self.room[room].append((first, n))


def plan(counts: np.ndarray, capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS) -> list[tuple[int, int, int, int, int, int]]:
    """Where pieces go, given how many there are of each length.

    Returns rows (length, rank from, rank to, first bin, pieces per bin, offset): the pieces of a
    length with ranks in that range fill bins from the first one on, so many to a bin. Pieces of a
    length are alike, so runs of bins are planned, never single pieces, and the work depends on
    the number of lengths, not of pieces.
    """
    left = counts.astype(np.int64).copy()
    used = np.zeros(len(counts), np.int64)
    rows: list[tuple[int, int, int, int, int, int]] = []
    bins = _Bins(capacity)

    def place(length: int, first: int, n: int, each: int, offset: int) -> None:
        rows.append((length, int(used[length]), int(used[length] + n * each), first, each, offset))
        used[length] += n * each
        left[length] -= n * each

    cut = max(1, int(capacity * large) + 1)
    found = linear_groups(left, cut, groups)
    sizes = [s for s, _ in found]
    # of each group, the actual lengths from the longest down
    supply: list[list[list[int]]] = []
    rest = {k: int(left[k]) for k in range(cut, len(left)) if left[k]}
    for size, n in found:
        own = []
        for length in sorted((k for k in rest if k <= size), reverse=True):
            if not n:
                break
            take = min(n, rest[length])
            own.append([length, take])
            rest[length] -= take
            n -= take
            if not rest[length]:
                del rest[length]
        supply.append(own)
    for column, uses in sorted(configurations(found, capacity), key=lambda c: -sum(s * int(k) for s, k in zip(sizes, c[0], strict=True))):
        # Rounding may leave a configuration too few actual documents: it is then used less often.
        uses = min([uses, *[sum(x[1] for x in supply[g]) // int(k) for g, k in enumerate(column) if k]])
        if uses <= 0:
            continue
        slots = [g for g, k in enumerate(column) for _ in range(int(k))]
        first, done = bins.made, 0
        bins.made += uses
        takes = []
        for g in slots:
            run, need = [], uses
            while need:
                x = supply[g][0]
                n = min(need, x[1])
                run.append((x[0], n))
                x[1] -= n
                need -= n
                if not x[1]:
                    supply[g].pop(0)
            takes.append(run)
        while done < uses:
            n = min(run[0][1] for run in takes)
            offset = 0
            for run in takes:
                place(run[0][0], first + done, n, 1, offset)
                offset += run[0][0]
            bins.put(capacity - offset, first + done, n)
            for k, run in enumerate(takes):
                takes[k] = run[1:] if run[0][1] == n else [(run[0][0], run[0][1] - n), *run[1:]]
            done += n
    # best fit, longest first: the least room that fits, filled with as many of a length as it takes
    for length in range(len(left) - 1, 0, -1):
        room = length
        while left[length]:
            while room < capacity and not bins.room[room]:
                room += 1
            if room >= capacity or not bins.room[room]:
                each = capacity // length
                n = int(left[length] // each) or 1
                each = min(each, int(left[length]))
                place(length, bins.made, n, each, 0)
                bins.put(capacity - each * length, bins.made, n)
                bins.made += n
                continue
            first, n = bins.room[room].pop()
            each = min(room // length, int(left[length]))
            take = min(n, int(left[length]) // each)
            bins.put(room, first + take, n - take)
            place(length, first, take, each, capacity - room)
            bins.put(room - each * length, first, take)
    return rows


def bins_of(rows: list) -> int:
    """How many bins a plan fills."""
    return max((first - (begin - end) // each for _, begin, end, first, each, _ in rows), default=0)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Numbers rows of equal length from 0. Rows are dealt to blocks by a hash, counted per block
    and numbered inside it, so a length that a third of all rows have is spread over all blocks."""
    spark = rows.sparkSession
    blocks = max(16, -(-rows.count() // BLOCK_ROWS))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    from pyspark.sql import Window

    ahead = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "_block").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    inner = Window.partitionBy("length", "_block").orderBy(*order)
    return dealt.withColumn("_own", F.row_number().over(inner) - 1).join(bases, ["length", "_block"]).withColumn("rank", F.col("_base") + F.col("_own")).drop("_block", "_own", "_base")


def pack(rows: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a length of 1 to ``capacity``.

    The driver gets one count per length, at most ``capacity`` numbers, and sends back a plan of
    runs whose size depends on the lengths alone. Rows may repeat; they are packed one by one.
    Sequences are numbered so that those alike in the plan are far apart.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in rows.groupBy("length").count().collect():
        counts[length] = n
    made = np.array(sorted(min((plan(counts, capacity, groups=g) for g in TRIED), key=bins_of)), np.int64).reshape(-1, 6)
    # places of the plan in order of (length, first rank); the place of a piece is the last one that begins at or before it
    begin = made[:, 0] << 40 | made[:, 1]
    bins = bins_of(made.tolist())
    step = _stride(bins)
    kept = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            _, first, _, bin_, each, offset = made[np.searchsorted(begin, length << 40 | rank, "right") - 1].T
            at = rank - first
            number = bin_ + at // each
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(number * step % bins if bins < 1 << 31 else number), pa.array(offset + at % each * length)], names=[*kept, "sequence_id", "offset"])

    return small_batches(ranked(rows, order).select(*kept, F.col("rank").cast("bigint").alias("rank"))).mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")


def _stride(n: int) -> int:
    """A number without common divisors with n, near the golden section of it: multiples of it modulo n are a permutation far from order.

    The plan fills bins from the longest pieces down; numbered this way, bins that follow each other hold unlike pieces.
    """
    step = max(1, int(n * 0.6180339887))
    while math.gcd(step, max(n, 1)) > 1:
        step += 1
    return step


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of ``docs``.

    A document is its ids and a closing 0; only one of more than ``capacity`` ids is cut, and only
    its last piece is shorter. Large lengths are rounded up to the longest of their group of equal
    cardinality, a linear programme picks configurations of rounded lengths, actual documents take
    their places and the room they leave is filled by best fit, longest first. Null and empty
    texts are the closing id alone. Rows with null or repeated doc_id are packed as rows of their
    own. An empty table gives an empty result; other columns are ignored.
    """
    rows = scratch(pieces(docs, tokenizer or default_tokenizer(), capacity))
    return pack(rows, ["doc_id", "piece"], capacity)


def op3_packing(spark, sf_dir):
    return pack_documents(read(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
