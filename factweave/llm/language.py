"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import read, scratch, small_batches, spans, spread_join, utf8

ORDER = 4
#: The models are fitted on at most so many documents of each language, those with the smallest hash
#: of their identifier; every fifth of them calibrates the scores instead.
PER_LANGUAGE = 250
#: Of so many bytes of text of a language the model is made at most, unless its first document alone is longer.
SAMPLE_BYTES = 8 << 20
#: Letters with ids of their own, which have 16 bits; should a sample have more, the rarest share one id.
ALPHABET = 65_533
#: Up to so many sampled identifiers are broadcast.
BROADCAST_IDS = 100_000
#: Bytes of text that are looked up at a time.
SPAN = 1 << 20
UNKNOWN = "und"
#: Share of the calibration documents of a language whose cross-entropy may be above the limit.
REJECT_SHARE = 0.005


# --- text to symbols ---------------------------------------------------------------------------

_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Each code point's lower-case letter, 0 for everything else."""
    if "letters" not in _tables:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _tables["letters"] = table
    return _tables["letters"]


def symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts, runs of other characters as one 0, and each text's offset."""
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs]
    letters = _letters()[codes]
    keep = letters != 0
    first = np.zeros(len(codes) + 1, bool)
    first[at] = True
    keep[1:] |= (letters[:-1] != 0) & ~first[1:-1]
    count = np.concatenate([[0], np.cumsum(keep)])
    return letters[keep], count[at]


def grams(ids: np.ndarray, offs: np.ndarray, order: int) -> np.ndarray:
    """Each position's n-gram, 16 bits a symbol, the newest lowest; texts begin with white space."""
    out = ids.astype(np.uint64)
    for t in range(1, order):
        out[t:] |= ids[:-t].astype(np.uint64) << np.uint64(16 * t)
    for s in range(order - 1):
        p = offs[:-1] + s
        p = p[p < offs[1:]]
        out[p] &= _mask(s + 1)
    return out


def _mask(k: int) -> np.uint64:
    return np.uint64((1 << (16 * k)) - 1)


# --- the model ---------------------------------------------------------------------------------


class SortedHashes:
    """Sorted hashes of keys with a value each; the top bits of a hash say where to begin."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = K.mix(keys)
        order = np.argsort(h)
        self.hashes, self.values = np.append(h[order], np.uint64(2**64 - 1)), np.append(values[order], 0).astype(np.float32)
        bits = max(1, int(len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.begin = np.searchsorted(self.hashes[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for those that are not there."""
        h = K.mix(keys)
        at = self.begin[(h >> self.shift).astype(np.int64)]
        have = self.hashes[at]
        late = np.flatnonzero(have < h)
        while len(late):
            at[late] += 1
            have[late] = now = self.hashes[at[late]]
            late = late[now < h[late]]
        hit = (have == h) & (at < len(self.hashes) - 1)
        return np.where(hit, at, -1)


class Model:
    """One interpolated Kneser-Ney character model per language, over one alphabet.

    ``tables[j][k]`` holds the log-probabilities of the k-grams that language j has, fully
    interpolated, and ``backoff[j][k]`` the logarithms of the interpolation weights of its contexts,
    both as sorted hash arrays; what a language has not seen takes no room.
    """

    def __init__(self, texts: dict[str, list[np.ndarray]], order: int = ORDER):
        self.order, self.languages = order, sorted(texts)
        found, counts = np.unique(np.concatenate([x for ls in texts.values() for x in ls] or [np.zeros(0, np.uint32)]), return_counts=True)
        found, counts = found[found > 0], counts[found > 0]
        self.common = np.sort(found[np.argsort(-counts, kind="stable")[:ALPHABET]])
        self.floor = float(-np.log(len(self.common) + 2))
        self.tables, self.backoff = [], []
        for j, lang in enumerate(self.languages):
            ids = [self.ids(t) for t in texts[lang] if len(t)]
            offs = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
            keys, n = np.unique(grams(np.concatenate(ids) if ids else np.zeros(0, np.uint16), offs, order), return_counts=True)
            counted = {order: (keys, n)}
            for k in range(order - 1, 0, -1):  # how many different symbols come before
                counted[k] = np.unique(counted[k + 1][0] & _mask(k), return_counts=True)
            self.tables.append({})
            self.backoff.append({})
            for k in range(1, order + 1):
                keys, n = counted[k]
                once, twice = int((n == 1).sum()), int((n == 2).sum())
                discount = once / (once + 2 * twice) if once and twice else 0.5
                contexts, where = np.unique(keys >> np.uint64(16), return_inverse=True)
                totals = np.bincount(where, n, len(contexts))
                weight = discount * np.bincount(where, minlength=len(contexts)) / totals
                p = np.maximum(n - discount, 0) / totals[where] + weight[where] * np.exp(self._known(keys & _mask(k - 1), k - 1, j))
                self.tables[j][k] = SortedHashes(keys, np.log(p))
                self.backoff[j][k] = SortedHashes(contexts, np.log(weight))
        self.limits = np.full(len(self.languages), np.inf)
        self.sharpness = 4.0

    def ids(self, letters: np.ndarray) -> np.ndarray:
        """1 and up for known letters, the last id for others, 0 for white space."""
        at = np.searchsorted(self.common, letters)
        found = self.common[np.minimum(at, len(self.common) - 1)] == letters if len(self.common) else np.zeros(len(letters), bool)
        return np.where(letters == 0, 0, np.where(found, at + 1, len(self.common) + 1)).astype(np.uint16)

    def _known(self, keys: np.ndarray, k: int, j: int) -> np.ndarray:
        """Log-probabilities of k-grams in language j, seen or not."""
        if k == 0:
            return np.full(len(keys), self.floor, np.float32)
        at = self.tables[j][k].find(keys)
        out = self.tables[j][k].values[at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            lower = self._known(keys[miss] & _mask(k - 1), k - 1, j)
            context = self.backoff[j][k].find(keys[miss] >> np.uint64(16))
            seen = context >= 0
            lower[seen] += self.backoff[j][k].values[context[seen]]
            out[miss] = lower
        return out

    def sums(self, keys: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Nats of the n-grams from each beginning to the next, under each language; each n-gram is looked up once."""
        different, where = np.unique(keys, return_inverse=True)
        return np.stack([-np.add.reduceat(self._known(different, self.order, j)[where], begin, dtype=np.float64) for j in range(len(self.languages))], axis=1)

    def entropies(self, letters: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Nats per symbol of each text under each language."""
        size = np.diff(offs)
        out = np.zeros((len(size), len(self.languages)))
        full = np.flatnonzero(size > 0)
        if len(full) and self.languages:
            out[full] = self.sums(grams(self.ids(letters), offs, self.order), offs[full]) / size[full, None]
        return out

    def long_entropies(self, data: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, int, bool]:
        """The same of one long text, ``span`` bytes at a time, its number of symbols, and whether it has letters."""
        total, size, some, before = np.zeros(len(self.languages)), 0, False, np.zeros(0, np.uint32)
        at = 0
        while at < len(data):
            end = min(len(data), at + span)
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
            own = symbols(data[at:end], np.array([0, end - at]))[0]
            first = data[at:end][:4].tobytes().decode("utf-8", "ignore")[:1]
            at = end
            # white space at the beginning of a piece is a symbol if a letter comes before it
            if len(before) and before[-1] and not _letters()[ord(first or " ")]:
                own = np.append(np.zeros(1, own.dtype), own)
            if not len(own):
                continue
            some |= bool((own != 0).any())
            joined = np.concatenate([before, own])
            if self.languages:
                total += self.sums(grams(self.ids(joined), np.array([0, len(joined)]), self.order)[len(before) :], np.array([0]))[0]
            size += len(own)
            before = joined[-(self.order - 1) :] if self.order > 1 else own[:0]
        return total / max(size, 1), size, some

    def posterior(self, entropies: np.ndarray, size: np.ndarray) -> np.ndarray:
        x = -self.sharpness * np.sqrt(size)[:, None] * entropies
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    def calibrate(self, texts: dict[str, list[np.ndarray]]) -> None:
        """Picks the sharpness of the posterior and, per language, the cross-entropy beyond which a text is rejected."""
        rows, truth, sizes = [], [], []
        for j, lang in enumerate(self.languages):
            for t in texts.get(lang, []):
                if len(t):
                    rows.append(self.entropies(t, np.array([0, len(t)]))[0])
                    truth.append(j)
                    sizes.append(len(t))
        if not rows:
            return
        rows, truth, sizes = np.array(rows), np.array(truth), np.array(sizes)
        losses = []
        for s in (0.25, 0.5, 1, 2, 4, 8, 16):
            self.sharpness = s
            losses.append((-np.log(np.maximum(self.posterior(rows, sizes)[np.arange(len(truth)), truth], 1e-9)).mean(), s))
        self.sharpness = min(losses)[1]
        for j in range(len(self.languages)):
            own = rows[truth == j, j]
            if len(own):
                self.limits[j] = np.quantile(own, 1 - REJECT_SHARE) + 0.25


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, order: int = ORDER) -> Model:
    """A model of every language in ``lang`` (null and 'und' excepted), from a bounded sample of ``docs``.

    Only identifiers are counted and ranked; the texts of those chosen are fetched after that, one for
    each language and identifier, of several the shortest and then that of the smallest hash. Repeated
    rows count once, so a sample never holds more than it may.
    """
    size, print_ = F.octet_length("text").cast("long").alias("_size"), F.xxhash64("text").alias("_text")
    named = docs.filter(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    named = named.select("lang", "doc_id", size, print_, F.xxhash64(F.lit("language"), "doc_id").alias("_h"))
    counts = scratch(named.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("doc_id").alias("_ids")))
    # a hash threshold leaves about four times the identifiers wanted of each language, so that the ranking is small
    near = spread_join(named, counts, ["lang"]).filter(F.shiftrightunsigned("_h", 11) / float(1 << 53) < 4.0 * per_language / F.col("_ids"))
    near = near.groupBy("lang", "doc_id", "_h").agg(F.min(F.struct("_size", "_text")).alias("_one")).select("lang", "doc_id", "_h", "_one.*")
    order_by = Window.partitionBy("lang").orderBy("_h", "doc_id")
    ranked = near.withColumn("_r", F.row_number().over(order_by)).filter(F.col("_r") <= per_language)
    chosen = scratch(ranked.withColumn("_upto", F.sum("_size").over(order_by.rowsBetween(Window.unboundedPreceding, 0))).filter((F.col("_r") == 1) | (F.col("_upto") <= SAMPLE_BYTES)).select("lang", "doc_id", "_size", "_text", "_r"))
    few = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen
    texts = docs.select("lang", "doc_id", "text", size, print_).join(few, ["lang", "doc_id", "_size", "_text"]).groupBy("lang", "_r").agg(F.min("text").alias("text"))
    train: dict[str, list] = {}
    held: dict[str, list] = {}
    for r in sorted(texts.toLocalIterator(), key=lambda r: (r["lang"], r["_r"])):
        data = np.frombuffer(r["text"].encode(), np.uint8)
        own = symbols(data, np.array([0, len(data)]))[0]
        (held if r["_r"] % 5 == 0 else train).setdefault(r["lang"], []).append(own)
    model = Model(train, order)
    model.calibrate(held)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_best, lang, score, cross_entropy and rejected of every whole text of ``docs``.

    The language with the lowest cross-entropy per symbol is the best; ``score`` is its calibrated
    posterior. ``lang`` is 'und' where the best is rejected for a cross-entropy above its limit.
    Null and empty texts and those without letters have no best language ('und', score 0).
    Ties go to the first language by name; repeated rows give repeated results, and only doc_id and
    text are read. With no language learned every text is 'und'.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for b in batches:
            data, offs = utf8(b.column("text"))
            for i, j in spans(offs, SPAN):
                own = data[offs[i] : offs[j]]
                if j == i + 1 and len(own) > SPAN:
                    one, count, letters = m.long_entropies(own)
                    e, size, some = one[None, :], np.array([count]), np.array([letters])
                else:
                    found, at = symbols(own, offs[i : j + 1] - offs[i])
                    # texts whose one symbol stands for other characters have no letter
                    e, size, some = m.entropies(found, at), np.diff(at), np.zeros(j - i, bool)
                    filled = np.flatnonzero(size > 0)
                    if len(filled):
                        some[filled] = np.add.reduceat((found != 0).astype(np.int64), at[filled]) > 0
                if m.languages:
                    best = np.where(some, e.argmin(axis=1), len(m.languages))
                    score = np.where(some, m.posterior(e, size).max(axis=1), 0.0)
                    entropy = np.where(some, e.min(axis=1), 0.0)
                    rejected = some & (entropy > np.append(m.limits, np.inf)[best])
                else:
                    best, score, entropy, rejected = np.zeros(j - i, np.int64), np.zeros(j - i), np.zeros(j - i), some
                lang = np.where(rejected, UNKNOWN, names[best])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(names[best], pa.string()), pa.array(lang, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)], names=["doc_id", "lang_best", "lang", "score", "cross_entropy", "rejected"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, lang_best string, lang string, score double, cross_entropy double, rejected boolean")


def op1_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = fit(docs.filter(~held))
    return identify(docs, model).select("doc_id", held.alias("held_out"), F.col("lang_best").alias("lang_pred"), "score", "rejected")
