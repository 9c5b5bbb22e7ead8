"""Spelling variants: every string one edit away from a word, joined with the vocabulary."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import read, scratch, small_batches, spans, utf8

#: Code points and occurrences a word has at least, and how many times a word's count its form's is at least.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One run in so many loses a code point.
DAMAGED = 199
#: Bytes of a text that are read at once, unless one run of letters alone is longer.
PIECE = 1 << 20
#: Distinct words that a task counts before it sends them on.
FLUSH_WORDS = 400_000
#: The filter of candidates has 64 bits for each word, at least and at most so many.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: Words whose neighbourhoods are made at once: about this many candidates.
CANDIDATES = 1 << 18
#: Words whose neighbourhoods one task makes, about.
TASK_WORDS = 10_000

#: The first byte of U+00C0 to U+00FF in UTF-8; the second one is the low six bits.
_HIGH = 0xC3
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True

_crc = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _crc = np.where(_crc & 1, (_crc >> 1) ^ np.uint32(0xEDB88320), _crc >> 1).astype(np.uint32)


def crc_after(seed: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, limit: int = 64) -> np.ndarray:
    """crc32 of each range of bytes, going on from ``seed``: byte by byte for all ranges at once, long ones alone."""
    out = seed.astype(np.uint32)
    order = np.argsort(-sizes, kind="stable")
    order = order[np.searchsorted(-sizes[order], -limit) :]
    at, size, state = starts[order], sizes[order], ~out[order]
    for j in range(int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size, -j))
        now = state[:m]
        state[:m] = _crc[(now ^ data[at[:m] + j]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out[order] = ~state
    for k in np.flatnonzero(sizes > limit).tolist():
        out[k] = zlib.crc32(data[starts[k] : starts[k] + sizes[k]].tobytes(), int(seed[k]))
    return out


def _runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes, and which of them belong to runs of letters."""
    low = K.LOWER[data]
    lead = low == _HIGH
    solid = _LETTER[low] | lead
    solid[1:] |= lead[:-1]
    return low, solid


def _pieces(data: np.ndarray, limit: int):
    """The bytes of a long text in pieces that end at no letter."""
    at = 0
    while at < len(data):
        end = at + limit
        while end < len(data):
            # up to the next byte that is no part of a run
            ahead = data[end : end + limit]
            loose = np.flatnonzero(~_runs(ahead)[1] & ((ahead < 0x80) | (ahead >= 0xC0)))
            if len(loose):
                end += int(loose[0])
                break
            end += limit
        yield data[at:end]
        at = end


def words_of(data: np.ndarray, offs: np.ndarray, seeds: np.ndarray, least: int = LEAST_LENGTH, damaged: int = DAMAGED) -> pa.StringArray:
    """The words of all texts, with repetitions: runs of letters, A-Z lower-cased, some without one code point.

    ``seeds`` has the crc32 of what stands before a run in its checksum, for each text. Runs that are
    too short are dropped first, since no run gets longer.
    """
    low, solid = _runs(data)
    starts, ends, before = K.word_edges(solid, offs)
    first = np.concatenate([[0], np.cumsum((low & 0xC0) != 0x80)])
    length = first[ends] - first[starts]
    text = np.repeat(np.arange(len(offs) - 1), np.diff(before))
    pick = length >= least
    starts, ends, length, text = starts[pick], ends[pick], length[pick], text[pick]
    crc = crc_after(seeds[text], low, starts, ends - starts)
    hit = np.flatnonzero(crc % np.uint32(damaged) == 0)
    keep = np.zeros(len(low) + 1, np.int32)
    np.add.at(keep, starts, 1)
    np.add.at(keep, ends, -1)
    keep = np.cumsum(keep[:-1]) > 0
    sizes = ends - starts
    if len(hit):
        begins = np.flatnonzero((low & 0xC0) != 0x80)
        gone = begins[first[starts[hit]] + (crc[hit] % length[hit].astype(np.uint32)).astype(np.int64)]
        wide = low[gone] == _HIGH
        keep[gone] = False
        keep[gone[wide] + 1] = False
        sizes[hit] -= 1 + wide
        length[hit] -= 1
    edges = np.concatenate([[0], np.cumsum(sizes)])
    made = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(low[keep].tobytes()))
    return made.filter(pa.array(length >= least)) if len(hit) else made


def vocabulary(docs: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT, damaged: int = DAMAGED) -> DataFrame:
    """(word, n) of all words of at least ``count`` occurrences; each task sends a word once for many occurrences."""

    def run(batches):
        held, size = [], 0

        def counted():
            table = pa.Table.from_batches(held).group_by("word").aggregate([("n", "sum")])
            return table.rename_columns(["word", "n"]).combine_chunks().to_batches()

        for batch in batches:
            data, offs = utf8(batch.column("text"))
            ids = batch.column("doc_id").cast(pa.string()).fill_null("")
            seeds = np.array([zlib.crc32(f"{i}:".encode()) for i in ids.to_pylist()], np.uint32)
            for i, j in spans(offs):
                whole = data[offs[i] : offs[j]]
                parts = [(whole, offs[i : j + 1] - offs[i])] if len(whole) <= PIECE else [(p, np.array([0, len(p)])) for p in _pieces(whole, PIECE)]
                for part, edges in parts:
                    found = words_of(part, edges, seeds[i:j], least, damaged).value_counts()
                    if len(found):
                        held.append(pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"]))
                        size += len(found)
                    if size >= FLUSH_WORDS:
                        held = counted()
                        size = sum(h.num_rows for h in held)
                        if size >= FLUSH_WORDS // 2:
                            yield from held
                            held, size = [], 0
        if held:
            yield from counted()

    found = small_batches(docs.select("doc_id", "text").filter("text IS NOT NULL")).mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= count)


def _name(raw: np.ndarray) -> np.ndarray:
    return K.mix(raw)


def _raw(chars: np.ndarray) -> np.ndarray:
    """Sums of symbols times powers, of equally long words in rows."""
    return (K._BYTE[0][chars] * K.powers(chars.shape[1])).sum(axis=1, dtype=np.uint64)


def _by_length(col: pa.Array):
    """Words (of code points under 256) as matrices of their code points, one for each length, and their places."""
    raw = [w.encode("latin-1") for w in col.to_pylist()]
    size = np.array([len(w) for w in raw], np.int64)
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        yield at, np.frombuffer(b"".join(raw[k] for k in at.tolist()), np.uint8).reshape(len(at), n)


def _bits(name: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a name in a bitmap."""
    top = np.uint64(bits - 1)
    return name & top, (name >> np.uint64(32)) & top


def _bitmap(vocab: DataFrame, bits: int) -> np.ndarray:
    """A bitmap with two places for each word, as words of 64 bits; its size is bounded whatever ``vocab`` holds."""

    def run(batches):
        for batch in batches:
            places = [np.concatenate(_bits(_name(_raw(chars)), bits)) for _, chars in _by_length(batch.column("word"))]
            if places:
                place = np.unique(np.concatenate(places))
                slot = (place >> np.uint64(6)).astype(np.int64)
                heads = np.flatnonzero(np.diff(slot, prepend=-1))
                value = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), heads)
                yield pa.RecordBatch.from_arrays([pa.array(slot[heads]), pa.array(value.view(np.int64))], names=["slot", "value"])

    parts = small_batches(vocab.select("word")).mapInArrow(run, "slot bigint, value bigint")
    table = parts.groupBy("slot").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[table["slot"].to_numpy()] = table["value"].to_numpy().view(np.uint64)
    return out


def neighbours(chars: np.ndarray, alphabet: np.ndarray, known: np.ndarray, least: int = LEAST_LENGTH):
    """All distinct deletions, replacements and insertions of equally long words that ``known`` may hold.

    Yields (row, place, letter, kind). Of the deletions in a run of one letter only the first is made, and
    none of the insertions of a letter behind itself, so no string is made twice. Only hashes are made;
    what the bitmap ``known`` lacks for certain is dropped before it becomes a string.
    """
    n, size = chars.shape
    bits = len(known) * 64
    power = K.powers(size + 1)
    symbol = K._BYTE[0][chars]
    term = symbol * power[:size]
    upto = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(term, axis=1, dtype=np.uint64)], axis=1)
    total = upto[:, -1:]
    letters = K._BYTE[0][alphabet]

    def seen(raw, allowed):
        found = np.flatnonzero(allowed.reshape(-1))
        name = _name(raw.reshape(-1)[found])
        a, b = _bits(name, bits)
        hit = (known[a >> np.uint64(6)] >> (a & np.uint64(63))) & (known[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1)
        return np.unravel_index(found[hit.astype(bool)], allowed.shape)

    if size > least:
        fresh = np.ones((n, size), bool)
        fresh[:, 1:] = chars[:, 1:] != chars[:, :-1]
        row, place = seen(upto[:, :-1] + (total - upto[:, 1:]) * K._INVERSE, fresh)
        yield row, place, np.zeros(len(row), np.int64), "delete"
    wide = max(1, CANDIDATES // (n * max(1, len(alphabet))))
    for p in range(0, size + 1, wide):
        q = slice(p, min(p + wide, size))
        swap = (total - term[:, q])[:, :, None] + letters * power[q, None]
        row, place, letter = seen(swap, chars[:, q, None] != alphabet)
        yield row, place + p, letter, "replace"
        q = slice(p, min(p + wide, size + 1))
        put = (upto[:, q] + (total - upto[:, q]) * K._BASE)[:, :, None] + letters * power[q, None]
        fresh = np.ones(put.shape, bool)
        fresh[:, max(1 - p, 0) :] = chars[:, max(p - 1, 0) : q.stop - 1, None] != alphabet
        row, place, letter = seen(put, fresh)
        yield row, place + p, letter, "insert"


def near_words(vocab: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """(word, n, near, near_n) of all pairs of words one edit apart, in both directions.

    Candidates are strings made by one edit over the letters that occur, so those the vocabulary has
    are near words by construction. ``vocab`` should be a written table.
    """
    letters = vocab.select(F.explode(F.split("word", "")).alias("letter")).distinct()
    # letters are of a class of 90 code points
    alphabet = np.array(sorted(ord(r["letter"]) for r in letters.collect() if r["letter"]), np.uint8)
    rows, bits = vocab.count(), LEAST_BITS
    while bits < MOST_BITS and bits < 64 * rows:
        bits *= 2
    known = vocab.sparkSession.sparkContext.broadcast(_bitmap(vocab, bits))

    def run(batches):
        for batch in batches:
            word, count = batch.column("word"), batch.column("n")
            for at, chars in _by_length(word):
                step = max(1, CANDIDATES // (2 * (chars.shape[1] + 1) * (len(alphabet) + 1)))
                for k in range(0, len(at), step):
                    own = chars[k : k + step]
                    rows, made = [], []
                    for row, place, letter, kind in neighbours(own, alphabet, known.value, least):
                        skip = 0 if kind == "insert" else 1
                        extra = [b""] * len(row) if kind == "delete" else [bytes([x]) for x in alphabet[letter].tolist()]
                        lines = [x.tobytes() for x in own]
                        made += [(lines[r][:p] + x + lines[r][p + skip :]).decode("latin-1") for r, p, x in zip(row.tolist(), place.tolist(), extra, strict=True)]
                        rows.append(row)
                    place = pa.array(at[k : k + step][np.concatenate(rows)])
                    yield pa.RecordBatch.from_arrays([word.take(place), count.take(place), pa.array(made, pa.string())], names=["word", "n", "near"])

    made = small_batches(vocab.select("word", "n").repartition(max(48, rows // TASK_WORDS), "word")).mapInArrow(run, "word string, n bigint, near string")
    return made.join(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last. Each round doubles the steps made.

    A form has at least ``RATIO`` times the count of its word, so chains are short and have no rings.
    """
    now = scratch(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        ahead = scratch(now.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        now = ahead.drop("_moved")
        if ahead.filter("_moved").isEmpty():
            return now


def variant_groups(docs: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT, ratio: int = RATIO, damaged: int = DAMAGED) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, of at least ``least``
    code points and ``count`` occurrences. Two words are near if one insertion, deletion or replacement
    makes one the other; a word's form is its near word of the largest count (of equals the first in
    code-point order) if that is at least ``ratio`` times its own, and its root the last form on the way.
    One run in ``damaged``, chosen by the checksum of doc_id and run, loses a code point first.

    Null and empty texts have no words. A null doc_id stands as the empty string in the checksum. Repeated
    rows count each time. An empty table gives no rows. Other columns are ignored. A run of any length is
    one word; texts are read in pieces. Counts cover all texts.
    """
    vocab = scratch(vocabulary(docs, least, count, damaged))
    best = near_words(vocab, least).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("_best"))
    form_n = -F.col("_best.less")
    chosen = scratch(best.select("word", "n_near", F.when(form_n >= ratio * F.col("n"), F.struct(F.col("_best.near").alias("form"), form_n.alias("form_n"))).alias("_form")))
    found = roots(chosen.filter("_form IS NOT NULL").select("word", "_form.form"))
    both = vocab.join(chosen, "word", "left").join(found, "word", "left")
    return both.select("word", F.col("_form.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.col("_form.form_n").alias("form_n"))


def op11_spelling(spark, sf_dir):
    return variant_groups(read(spark, sf_dir, "documents"))


#: Near words meet by what is left when a place is blanked or taken out; the checksum goes byte by byte and bit by bit.
SQL = r"""
WITH RECURSIVE run AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
each AS (SELECT d, r, count(*) AS k, hex(encode(concat(d, ':', r))) AS x FROM run WHERE length(r) >= 6 GROUP BY d, r),
bytes AS (SELECT d, r, k, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS b FROM each),
crc AS (SELECT r, k, xor(list_reduce(list_prepend(4294967295, b), lambda c, y: list_reduce([xor(c, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295) AS h FROM bytes),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN left(r, (h % length(r))::BIGINT) || substr(r, (h % length(r))::BIGINT + 2) ELSE r END AS word, k FROM crc),
vocab AS (SELECT word, sum(k)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
place AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab),
swap AS (SELECT word, n, i, left(word, i - 1) || '_' || substr(word, i + 1) AS s FROM place),
less AS (SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS s FROM place),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM swap a JOIN swap b USING (i, s) WHERE a.word <> b.word
  UNION SELECT l.word, l.n, v.word, v.n FROM less l JOIN vocab v ON v.word = l.s UNION SELECT v.word, v.n, l.word, l.n FROM less l JOIN vocab v ON v.word = l.s),
best AS (SELECT word, n, count(*) AS n_near, max(m) AS m FROM near GROUP BY word, n),
form AS (SELECT best.word, min(other) AS form, best.m AS form_n FROM best JOIN near ON near.word = best.word AND near.m = best.m WHERE best.m >= 5 * best.n GROUP BY best.word, best.m),
walk AS (SELECT word, form AS w, 1 AS step FROM form UNION ALL SELECT walk.word, form.form, step + 1 FROM walk JOIN form ON form.word = walk.w),
root AS (SELECT word, arg_max(w, step) AS root FROM walk GROUP BY word)
SELECT v.word, form, coalesce(root, v.word) AS root, v.n, coalesce(n_near, 0) AS n_near, form_n FROM vocab v LEFT JOIN best USING (word) LEFT JOIN form USING (word) LEFT JOIN root USING (word)
"""
