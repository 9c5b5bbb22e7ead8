"""Document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import field_list, read, scratch, small_batches, spans, utf8

#: Words of a passage.
PASSAGE = 64
#: The classifier is fitted on at most so many labelled documents, those with the smallest hash of their identifier.
MOST_LABELS = 3000
#: Of so many bytes of text in all, unless the first document alone is longer.
MOST_BYTES = 64 << 20
PAIRS = 64
#: Scores from here on count as quality 1.
THRESHOLD = 0.3

_CLASS = np.full(256, 15, np.uint8)
for _k, _set in enumerate((b" \t\n\r\v\f", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".", b",", b"!?", b"|", b"*#$%&", b"-_'\"", b"()[]{}<>", b"/\\:;@=+~^`")):
    _CLASS[list(_set)] = _k
_CLASS[128:192] = 12
_CLASS[192:] = 13
CLASSES = 16
_LEFT, _RIGHT = (K.constants(256, s) for s in (31, 32))
FEATURES = CLASSES + PAIRS + 7


def passages(data: np.ndarray, offs: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of all texts, and the number of passages before each text.

    Passages are consecutive runs of ``size`` words, the last one shorter; a text without words is
    one passage. Features are shares of byte classes and hashed byte pairs, and word statistics.
    """
    starts, ends, before = K.words(data, offs)
    counts = np.diff(before)
    made = np.maximum(1, -(-counts // size))
    after = np.concatenate([[0], np.cumsum(made)])
    total = int(after[-1])
    inner = np.arange(total) - np.repeat(after[:-1], made)
    begin = np.repeat(offs[:-1], made)
    later = np.flatnonzero(inner > 0)
    begin[later] = starts[np.repeat(before[:-1], made)[later] + inner[later] * size]
    sizes = np.diff(np.append(begin, len(data)))
    own = np.repeat(np.arange(total), sizes)
    x = np.zeros((total, FEATURES), np.float32)
    length = np.maximum(sizes, 1)[:, None]
    x[:, :CLASSES] = np.bincount(own * CLASSES + _CLASS[data], minlength=total * CLASSES).reshape(total, CLASSES) / length
    if len(data) > 1:
        pair = ((_LEFT[data[:-1]] ^ _RIGHT[data[1:]]) >> np.uint64(58)).astype(np.int64)
        # a pair that spans two passages counts for neither, so a score does not depend on the texts around
        pair = (own[:-1] * PAIRS + pair)[own[:-1] == own[1:]]
        x[:, CLASSES : CLASSES + PAIRS] = np.bincount(pair, minlength=total * PAIRS).reshape(total, PAIRS) / length
    if len(starts):
        passage = own[starts]
        n = np.bincount(passage, minlength=total)
        some = np.maximum(n, 1)
        h = K.word_hashes(data, starts, ends)
        wide = ends - starts
        upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
        caps = (upper[ends] - upper[starts]) * 2 > wide
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
        key = np.sort((passage.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        x[:, -7] = np.log1p(n) / 5
        x[:, -6] = np.bincount(passage, wide, total) / some / 10
        x[:, -5] = np.bincount(passage, wide == 1, total) / some
        x[:, -4] = np.bincount(passage, caps, total) / some
        x[:, -3] = np.bincount(passage, again, total) / some
        x[:, -2] = np.bincount((key >> np.uint64(40)).astype(np.int64), fresh, total) / some
        x[:, -1] = np.bincount(passage, np.minimum(wide, 40) ** 2, total) / some / 100
    return x, after


def _sums(values: np.ndarray, after: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, after[:-1], axis=0)


class GatedAttention:
    """Passage encoder, gated attention and a logistic score of the weighted representation."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        shapes = {"e": (FEATURES, hidden), "eb": (hidden,), "v": (hidden, gate), "u": (hidden, gate), "w": (gate,), "c": (hidden,), "cb": ()}
        self.p = {k: (r.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 or k in "wc" else np.zeros(s)) for k, s in shapes.items()}

    def forward(self, x: np.ndarray, after: np.ndarray) -> tuple:
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["e"] + p["eb"])
        a, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        s = (a * g) @ p["w"]
        made = np.diff(after)
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, after[:-1]), made))
        alpha = s / np.repeat(_sums(s, after), made)
        z = _sums(alpha[:, None] * h, after)
        return x, h, a, g, alpha, z, 1 / (1 + np.exp(-(z @ p["c"] + p["cb"])))

    def fit(self, x: np.ndarray, after: np.ndarray, y: np.ndarray, epochs: int = 250, rate: float = 0.02, decay: float = 1e-4) -> None:
        """Adam on the mean logistic loss of all documents, with every passage's gradient through its weight."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        made = np.diff(after)
        for t in range(1, epochs + 1):
            p = self.p
            xs, h, a, g, alpha, z, y_hat = self.forward(x, after)
            d = (y_hat - y) / len(y)
            dz = np.repeat(d[:, None] * p["c"], made, axis=0)
            da = (dz * h).sum(axis=1)
            ds = alpha * (da - np.repeat(_sums(alpha * da, after), made))
            dv, du = ds[:, None] * p["w"] * g * (1 - a * a), ds[:, None] * p["w"] * a * g * (1 - g)
            dh = (alpha[:, None] * dz + dv @ p["v"].T + du @ p["u"].T) * (1 - h * h)
            grad = {"e": xs.T @ dh, "eb": dh.sum(axis=0), "v": h.T @ dv, "u": h.T @ du, "w": (a * g).T @ ds, "c": z.T @ d, "cb": d.sum()}
            for k, v in grad.items():
                m, s = moments[k]
                v = v + decay * p[k]
                m, s = 0.9 * m + 0.1 * v, 0.999 * s + 0.001 * v * v
                moments[k] = (m, s)
                p[k] = p[k] - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)

    def scores(self, x: np.ndarray, after: np.ndarray) -> np.ndarray:
        return self.forward(x, after)[-1]


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> GatedAttention | None:
    """A classifier of ``labels.quality`` from at most ``most`` labelled documents; None without labels."""
    rows = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = rows.withColumn("_h", F.xxhash64(F.lit("quality"), "doc_id"))
    # a hash threshold leaves about four times the rows wanted, so that no task sorts all labels
    share = 4.0 * most / max(1, rows.count())
    chosen = rows.filter(F.shiftrightunsigned("_h", 11) / float(1 << 53) < share).orderBy("_h", "doc_id").limit(most)

    def run(batches):
        for b in batches:
            data, offs = utf8(b.column("text"))
            for i, j in spans(offs, 1 << 19):
                x, after = passages(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                cut = pa.array([x[a:b_].astype("<f4").tobytes() for a, b_ in zip(after[:-1], after[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("quality").slice(i, j - i), cut], names=["doc_id", "quality", "x"])

    # at most ``most`` identifiers are broadcast; their sizes are few rows, so that one window may add them up
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("_size")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", "_h").agg(F.sum("_size").alias("_size"))
    upto = F.sum("_size").over(Window.orderBy("_h", "doc_id"))
    chosen = scratch(sizes.withColumn("_upto", upto).filter((F.col("_upto") <= MOST_BYTES) | (F.col("_upto") == F.col("_size"))).select("doc_id", "quality"))
    found = small_batches(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("quality")).mapInArrow(run, "doc_id bigint, quality int, x binary")
    bags = sorted({(r["doc_id"], r["quality"], bytes(r["x"])) for r in found.toLocalIterator()})
    if not bags:
        return None
    parts = [np.frombuffer(x, "<f4").reshape(-1, FEATURES) for _, _, x in bags]
    model = GatedAttention()
    model.fit(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.array([min(1, max(0, q)) for _, q, _ in bags], float))
    return model


def score(docs: DataFrame, model: GatedAttention | None, name: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text in a column ``name`` (0 to 1, higher: better).

    Null and empty texts are scored as one passage without words. Without a model, that is with no
    labels to learn from, every score is 1. Repeated rows give repeated results; a column of that
    name is replaced and all others pass unchanged.
    """
    keep = [c for c in docs.columns if c != name]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*field_list(docs, keep), f"`{name}` double"])

    def run(batches):
        m = shared.value
        for b in batches:
            data, offs = utf8(b.column("text"))
            found = [np.zeros(0)]
            for i, j in spans(offs, 1 << 19):
                x, after = passages(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                found.append(m.scores(x, after) if m else np.ones(j - i))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(np.concatenate(found), pa.float64())], names=[*keep, name])

    return small_batches(docs.select(*[f"`{c}`" for c in keep])).mapInArrow(run, schema)


def held_out(col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string")), F.lit(5)) == 0, F.lit(False))


def op4_quality(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(~held_out()))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
