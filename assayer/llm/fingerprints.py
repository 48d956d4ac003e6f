"""Document fingerprints by one-permutation MinHash, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.native import let, long, words
from assayer.llm.shared import table

#: Words in a shingle; bins (a power of two) and bits kept of each.
SHINGLE, BINS, BITS = 5, 256, 8
#: Probes of an empty bin before the ranked choice among all non-empty ones, each an affine map (odd factor) over the bins.
PROBES = ((173, 91), (59, 214), (227, 37), (101, 150), (13, 69), (199, 248), (85, 5), (147, 122))
#: Rows wanted in a range of doc_id, in which each row's successor is found; ranges cut at once, and cuts of each again in larger tables.
RANGE_ROWS, RANGES, FINER = 500, 4096, 256
LOW = (1 << 56) - 1


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """64-bit hashes of the runs of ``size`` words; a shorter text is one run, no words give an empty array."""
    return let(
        F.transform(words(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w)),
        lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>"))
        .when(F.size(h) < size, F.array(F.aggregate(h, long(0), lambda acc, x: F.xxhash64(acc, x))))
        .otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - size, F.lit(0))), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size))))),
    )


def fingerprint(text: Column, size: int = SHINGLE) -> Column:
    """BINS bytes as binary: the low-order byte of the least hash of each bin; empty for a text without words.

    A hash is drawn once per shingle and its top byte names the bin. One sort brings the bins together; a
    sentinel, the largest value of its bin, stands in each, so that exactly one least value per bin remains and
    an empty bin shows as its sentinel. An empty bin takes the value of the first non-empty one in an order of
    its own that doesn't depend on the text (optimal densification): eight hashed probes, then the rest ranked by a hash.
    """
    sentinels = F.transform(F.sequence(long(-BINS // 2), long(BINS // 2 - 1)), lambda b: F.shiftleft(b, 56).bitwiseOR(long(LOW)))
    hexes = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda c: F.lpad(F.hex(c), 2, "0"))

    def least(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(s, i - 1), 56)))

    def codes(minima: Column) -> Column:
        return F.transform(minima, lambda x: F.when(x.bitwiseAND(long(LOW)) != long(LOW), x.bitwiseAND(long(255)).cast("int")))

    def dense(c: Column, full: Column) -> Column:
        probes = lambda b: [F.get(c, (b * a + k).bitwiseAND(F.lit(BINS - 1))) for a, k in PROBES]
        ranked = lambda b: F.get(c, F.array_min(F.transform(full, lambda j: F.xxhash64(b, j).bitwiseAND(long(~255)).bitwiseOR(j.cast("long")))).bitwiseAND(long(255)).cast("int"))
        return F.transform(c, lambda x, b: F.coalesce(x, *probes(b), ranked(b)))

    def pack(c: Column) -> Column:
        full = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.get(c, b).isNotNull())
        return let(hexes, lambda names: let(full, lambda f: F.unhex(F.array_join(F.transform(dense(c, f), lambda x: F.get(names, x)), ""))))

    def of(h: Column) -> Column:
        sorted_ = F.sort_array(F.concat(h, sentinels))
        return F.when(F.size(h) == 0, F.unhex(F.lit(""))).otherwise(let(sorted_, lambda s: let(least(s), lambda m: let(codes(m), pack))))

    return let(shingle_hashes(text, size), of)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints: the share of equal bytes less what chance makes equal
    (1 / 2**BITS), 0 to 1. Two empty ones are alike, an empty one is unlike any other."""
    share = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)))) / float(BINS)
    chance = 2.0**-BITS
    unbiased = F.greatest(F.lit(0.0), (share - chance) / (1 - chance))
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(unbiased)


def _cuts(parts: int) -> Column:
    """Values of ``key`` that cut the rows into even parts."""
    return F.percentile_approx("key", [i / parts for i in range(1, parts)], 10 * max(parts, 1000))


def _place(bounds: Column, most: int) -> Column:
    """The last of the ascending ``bounds``, at most ``most`` of them, that ``key`` is not below, from 0."""
    steps = [1 << i for i in range(most.bit_length(), -1, -1)]
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, s: at + F.when(F.get(bounds, at + s - 1) <= F.col("key"), s).otherwise(0)) - 1


def _dealt(keyed: DataFrame, rows: int, ranges: int) -> DataFrame | None:
    """The rows with ``range``, ``finer`` and ``end``: their range of key, and once more with end = 1 under the range before if they
    are the first of theirs. None for no rows.

    Up to ``ranges`` values cut the table, in large tables FINER values cut each range again, so ranges stay
    small: 10**10 rows make some 10**6 ranges of 10**4. The finer cuts, 2 KB a range, are joined to the rows."""
    n, low = keyed.agg(F.count("*"), F.min("key")).first()
    if not n:
        return None
    parts = min(ranges, -(-n // rows))
    first = [low]
    if parts > 1:
        near = F.lit(sorted({low, *map(int, keyed.agg(_cuts(parts)).first()[0])})).cast("array<bigint>")
        # percentiles are rounded to doubles: the least key of each part is an exact cut
        first = sorted(r["low"] for r in keyed.groupBy(_place(near, parts).alias("range")).agg(F.min("key").alias("low")).collect())
    bounds = F.lit(first).cast("array<bigint>")
    out = keyed.withColumn("range", _place(bounds, len(first)))
    finer = min(FINER, -(-n // (len(first) * rows)))
    if finer > 1:
        start = F.array(F.get(bounds, F.col("range")))
        cuts = out.select("range", "key").groupBy("range").agg(_cuts(finer).alias("cuts")).select("range", F.array_sort(F.array_distinct(F.concat(start, "cuts"))).alias("cuts"))
        rough = out.select("range", "key").join(F.broadcast(table(cuts, "rough")), "range")
        exact = rough.groupBy("range", _place(F.col("cuts"), finer + 1).alias("finer")).agg(F.min("key").alias("low"))
        cuts = table(exact.groupBy("range").agg(F.array_sort(F.collect_list("low")).alias("cuts")), "cuts")
        lasts = {r["range"]: r["n"] - 1 for r in cuts.select("range", F.size("cuts").alias("n")).collect()}
        out = out.join(F.broadcast(cuts), "range").withColumn("finer", _place(F.col("cuts"), finer + 1))
        starts = F.get("cuts", F.col("finer")) == F.col("key")
        last = F.get(F.lit([lasts.get(i, 0) for i in range(len(first))]), F.pmod(F.col("range") - 1, F.lit(len(first))))
    else:
        out, last = out.withColumn("finer", F.lit(0)), F.lit(0)
        starts = F.get(bounds, F.col("range")) == F.col("key")
    before = F.when(F.col("finer") > 0, F.struct("range", (F.col("finer") - 1).alias("finer"), F.lit(1).alias("end"))).otherwise(
        F.struct(F.pmod(F.col("range") - 1, F.lit(len(first))).alias("range"), last.alias("finer"), F.lit(1).alias("end"))
    )
    own = F.struct("range", "finer", F.lit(0).alias("end"))
    kept = [c for c in keyed.columns]
    return out.select(*kept, F.explode(F.when(starts, F.array(own, before)).otherwise(F.array(own))).alias("at")).select(*kept, "at.*")


def with_next(docs: DataFrame, rows: int = RANGE_ROWS, ranges: int = RANGES) -> DataFrame:
    """Each row of (doc_id, text, ...) with ``next_`` + name: the other columns of the next row by (doc_id, text); after the last, the first.

    Rows are dealt by ranges of doc_id; the first row of each range is also dealt to the range before it as its
    end, so that texts move once and no range needs another. A row with a null doc_id has no place in the order and
    is its own successor.
    """
    kept = [c for c in docs.columns if c != "doc_id"]
    alone = docs.select("doc_id", *kept, *(F.col(c).alias(f"next_{c}") for c in kept))
    dealt = _dealt(docs.where("doc_id is not null").withColumn("key", F.col("doc_id").cast("long")), rows, ranges)
    if dealt is None:
        return alone
    order = Window.partitionBy("range", "finer").orderBy("end", "key", "text")
    found = dealt.select("doc_id", *kept, "end", *(F.lead(c).over(order).alias(f"next_{c}") for c in kept)).where("end = 0").drop("end")
    return found.unionByName(alone.where("doc_id is null"))


def edit_likeness(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The fingerprint of each text of (doc_id, text), of its edited text, and their likeness to each other and to the next document's.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all) of the next
    document's. Null texts count as empty. Rows sharing a doc_id follow one another by text; an only
    row, and one without a doc_id, is its own successor. Extra columns are ignored; an empty table gives an empty result.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("print", fingerprint(F.col("text"), size))
    near = with_next(own)
    half = F.floor(F.length("text") / 2).cast("int")
    near = near.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    near = near.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "print", "next_print", fingerprint(F.col("edited"), size).alias("edited_print"))
    return near.select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("print")).alias("fingerprint"), F.lower(F.hex("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
