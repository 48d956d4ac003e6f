"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.native import let, long
from assayer.llm.shared import table

#: Largest mean inverted at once, and terms of its distribution; past the last the tail is below 2**-52.
MEAN, TERMS = 16, 96
#: Sources up to which the rates are broadcast, and salts of the join beyond.
BROADCAST, SALTS = 10_000, 64
#: Copies, and hashes of one row, that stand in an array at once.
RUN = 4096
SEED = "mix-1"


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) out of 52 bits of the MD5 of the parts, joined by colons; null parts count as empty."""
    text = F.concat_ws(":", *(F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / float(1 << 52)


def poisson_cdf(mean: Column) -> Column:
    """P(N <= k) for k from 0 to TERMS - 1."""
    first = F.exp(-mean)
    zero = F.struct(first.alias("p"), F.array(first).alias("c"))

    def add(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), zero, add, lambda acc: acc["c"])


def rates(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, exponent: float = 0.5) -> DataFrame:
    """(source, rate): the mean repetition at which each source's share of ``total`` rows (default: as many as there are)
    is its weight over the sum of weights. Without ``weights`` (source, weight) a source of n rows weighs
    n ** exponent; a source that ``weights`` lacks or gives null or less than zero gets none. Null is a source of its own."""
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(exponent)))
    else:
        given = weights.groupBy(F.col("source").alias("named")).agg(F.sum("weight").alias("weight"))
        n = n.join(given, F.col("source").eqNullSafe(F.col("named")), "left").drop("named")
    n = n.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    sums = n.agg(F.sum("weight").alias("weights"), F.sum("n").alias("rows"))
    rows = F.col("rows").cast("double") if total is None else F.lit(float(total))
    share = F.when(F.col("weights") > 0, F.col("weight") / F.col("weights")).otherwise(0.0)
    return n.crossJoin(F.broadcast(sums)).select("source", (share * rows / F.col("n")).alias("rate"))


def mix(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, exponent: float = 0.5, seed: str = SEED) -> DataFrame:
    """Each row of ``docs`` (doc_id, source, any others) as often as a Poisson number with its source's rate, in a global
    random order, with ``copy`` (from 1) and ``shuffle_key``, by which the result is sorted: its partitions hold even ranges of the
    key in order, and each is sorted.

    The number is the inverse of the distribution at a uniform hash of seed and doc_id; a mean over MEAN is
    the sum of equal parts, each with a hash of its own. So a rerun or a lost executor gives the same
    rows, and rows that share a doc_id (null included) and a source repeat alike. Columns named copy and shuffle_key in the input are
    replaced. An empty table gives an empty result. Counts cover all rows; the rates are one row a source: broadcast up
    to BROADCAST sources, joined by source and salt beyond that.
    """
    own = docs.drop("copy", "shuffle_key")
    own_columns = own.columns
    parts = F.greatest(F.lit(1.0), F.ceil(F.col("rate") / MEAN)).cast("long")
    known = rates(own, weights, total, exponent).withColumn("_parts", parts)
    known = table(known.select(F.col("source").alias("_source"), "_parts", poisson_cdf(F.col("rate") / F.col("_parts")).alias("_cdf")), "rates")
    if known.count() <= BROADCAST:
        joined = own.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("_source")))
    else:
        salted = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = own.withColumn("_of", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        joined = own.join(salted, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_of") == F.col("_salt"))).drop("_of")

    def inverse(u: Column) -> Column:
        return let(u, lambda x: F.size(F.filter("_cdf", lambda c: c <= x)))

    def drawn(block: Column) -> Column:
        low = block * RUN + 1
        js = F.sequence(low, F.least(low + (RUN - 1), F.col("_parts")))
        return F.aggregate(js, long(0), lambda acc, j: acc + inverse(uniform(F.lit(seed), F.col("doc_id"), j)))

    blocks = F.sequence(long(0), F.floor((F.col("_parts") - 1) / RUN))
    times = F.aggregate(blocks, long(0), lambda acc, b: acc + drawn(b))
    # a count is exploded in runs, so that no row holds a sequence as long as its count; a filter would count twice
    runs = F.when(F.col("_times") > 0, F.sequence(long(0), F.floor((F.col("_times") - 1) / RUN)))
    counted = joined.withColumn("_times", times).withColumn("_run", F.explode(runs))
    copies = F.sequence(F.col("_run") * RUN + 1, F.least((F.col("_run") + 1) * RUN, F.col("_times")))
    counted = counted.select(*own_columns, F.explode(copies).alias("copy"))
    parts = (F.lit(seed), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string"))
    keyed = counted.withColumn("shuffle_key", F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long"))
    # keys are even over 60 bits: cutting that range evenly needs no sampling pass over the texts
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.col("shuffle_key") / float(1 << 60) * n).cast("int")
    return keyed.repartitionById(n, F.least(place, F.lit(n - 1))).sortWithinPartitions("shuffle_key", "doc_id", "copy")


#: DuckDB SQL for mix(documents) with the default weights.
ORACLE = f"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, sqrt(n) / (SELECT sum(sqrt(n)) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
p AS (SELECT source, rate, greatest(1, ceil(rate / {MEAN}))::INT AS parts FROM r),
c AS (SELECT source, any_value(parts) AS parts, list(c ORDER BY k) AS cdf
      FROM (SELECT source, parts, k, sum(exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
            FROM p, range({TERMS}) t(k)) GROUP BY source),
d AS (SELECT d.*, list_sum([len(list_filter(c.cdf, lambda x: x <= ('0x' || substr(md5('{SEED}:' || d.doc_id || ':' || j), 1, 13))::BIGINT / 4503599627370496.0))
                            for j in range(1, c.parts + 1)])::BIGINT AS times
      FROM documents d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, text, lang, source, n_chars, copy, ('0x' || substr(md5('{SEED}:order:' || doc_id || ':' || copy), 1, 15))::BIGINT AS shuffle_key
FROM (SELECT *, unnest(range(1, times + 1)) AS copy FROM d)
"""
