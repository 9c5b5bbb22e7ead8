"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, read, scratch, unpacked

#: A source of n of all N rows gets the weight (n / N) ** ALPHA; 1 keeps the proportions, 0 makes sources equal.
ALPHA = 0.5
#: Rows wanted, as a multiple of the rows given.
EPOCHS = 1.0
#: Quantiles of the Poisson distribution that are written out; with rates up to 16 the rest is under 1e-12.
STEPS = 64
#: Up to so many sources their rates are broadcast; beyond, rows are joined with them by a shuffle.
BROADCAST_SOURCES = 10_000


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, epochs: float = EPOCHS) -> DataFrame:
    """Mean repetitions of each source's rows: its share of the wanted rows over its rows."""
    counts = docs.groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("_n"))
    if weights is None:
        share = F.pow(F.col("_n").cast("double"), F.lit(alpha))
    else:
        share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]), F.col("_source")) if weights else F.lit(None).cast("double"), F.lit(0.0))
    shares = counts.withColumn("_share", share)
    total = shares.agg(F.sum("_n").alias("_all"), F.sum("_share").alias("_shares"))
    return shares.crossJoin(F.broadcast(total)).select("_source", (F.col("_share") / F.nullif("_shares", F.lit(0.0)) * F.col("_all") * F.lit(float(epochs)) / F.col("_n")).alias("rate"))


def digits(seed: str, *cols):
    """A number of 52 bits from an MD5 digest of the values; the same on every engine."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def uniform(seed: str, *cols):
    """A number from 0 up to 1."""
    return digits(seed, *cols) / F.lit(float(1 << 52))


def poisson(rate, u, steps: int = STEPS):
    """The smallest k with P(X <= k) > u. A rate is split in equal parts of at most 16 by the caller."""
    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("n"))

    def step(s, i):
        p = s["p"] * rate / i
        return F.struct(i.alias("k"), p.alias("p"), (s["c"] + p).alias("c"), (s["n"] + F.when(s["c"] <= u, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["n"])


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, epochs: float = EPOCHS, seed: str = "mix") -> DataFrame:
    """``docs`` with each row repeated a Poisson number of times, in a global shuffle.

    The mean is the source's rate and the random number a hash of seed and doc_id, so a run can be
    repeated and no state is shared. ``copy`` numbers a row's copies from 0, ``shuffle_key`` is a
    hash by which the result is range-partitioned and sorted. Rows with a null source form a
    source of their own. Rows with equal doc_id get equal counts. A rate above 16 is made of equal
    parts, each with its own number. Sources that ``weights`` does not name get no rows. Empty
    tables give empty results, and all other columns, of whatever name, are passed on.
    """
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c not in ("rate", "copy", "shuffle_key")])
    table = scratch(rates(docs.select("source"), weights, alpha, epochs).withColumnRenamed("rate", "_rate"))
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    joined = packed(kept, "doc_id", "source").join(table, F.col("source").eqNullSafe(F.col("_source")))
    parts = F.greatest(F.ceil(F.col("_rate") / 16).cast("int"), F.lit(1))
    each = F.col("_rate") / parts
    first = poisson(each, uniform(seed, F.col("doc_id")))
    more = F.aggregate(F.sequence(F.lit(2), parts), F.lit(0), lambda n, i: n + poisson(each, uniform(seed, F.col("doc_id"), F.lit("part"), i)))
    counted = joined.withColumn("_copies", F.when(F.col("_rate") > 0, F.when(parts > 1, first + more).otherwise(first)).otherwise(F.lit(0)))
    copies = counted.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    keyed = copies.withColumn("_key", digits(seed, F.col("doc_id"), F.lit("order"), F.col("_copy")))
    return keyed.select(*unpacked(keyed), F.col("_rate").alias("rate"), F.col("_copy").alias("copy"), F.col("_key").alias("shuffle_key")).repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key")


def op6_source_mix(spark, sf_dir):
    made = mix(read(spark, sf_dir, "documents"))
    return made.select("doc_id", "source", F.round("rate", 9).alias("rate"), "copy", "shuffle_key", "text")


#: For sources whose rate is at most 16, as with the default weights on the tables here.
SQL = f"""
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (pow(n::DOUBLE, {ALPHA}) / (SELECT sum(pow(n::DOUBLE, {ALPHA})) FROM c) * (SELECT sum(n) FROM c) * {EPOCHS} / n) AS rate FROM c),
q AS (
  SELECT source, rate, k, sum(exp(-rate) * pow(rate, k) / gamma(k + 1.0)) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM r, range({STEPS}) AS s(k)
),
u AS (SELECT *, (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / {float(1 << 52)}) AS u FROM documents),
n AS (SELECT u.doc_id, any_value(u.source) AS source, any_value(q.rate) AS rate, any_value(u.text) AS text, count(*) FILTER (q.cdf <= u.u) AS copies FROM u JOIN q ON u.source IS NOT DISTINCT FROM q.source GROUP BY u.doc_id)
SELECT doc_id, source, round(rate, 9) AS rate, copy::INT AS copy, ('0x' || substr(md5('mix:' || doc_id::VARCHAR || ':order:' || copy::VARCHAR), 1, 13))::BIGINT AS shuffle_key, text
FROM n, LATERAL (SELECT unnest(range(copies)) AS copy)
"""
