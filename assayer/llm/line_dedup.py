"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.native import let, long
from assayer.llm.shared import table

#: Edits up to which two lines may link, and characters of the shorter line for each: lines link at min(EDITS, length // EACH) edits or fewer.
EDITS, EACH = 2, 10
#: Kinds of characters counted.
KINDS = 15


def banded_distance(short: Column, long_: Column, edits: int = EDITS) -> Column:
    """Edit distance of two arrays of characters, the first no longer than the second and at most ``edits`` shorter;
    over ``edits`` where it is larger.

    Myers' bit-vectors on a band (Hyyrö, 2003): bit b of a word of 2 * edits + 1 bits stands for the row that is
    b - edits below the diagonal, so each character of the longer line is one step of some ten word operations
    whatever the length. The distance is followed down the lowest diagonal of the band and then along the last row.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    mask = lambda c: c.bitwiseAND(long(full))
    state = lambda vp, vn, d: F.struct(vp.alias("vp"), vn.alias("vn"), d.alias("d"))
    rows = F.size(short)

    def step(acc: Column, j: Column) -> Column:
        vp, vn = acc["vp"], acc["vn"]
        char = F.get(long_, j)
        same = [F.when(F.get(short, j + (b - edits)) == char, long(1 << b)).otherwise(long(0)) for b in range(width)]
        x = same[0]
        for bit in same[1:]:
            x = x.bitwiseOR(bit)
        one = F.transform(F.array(x), lambda x: mask(((x.bitwiseAND(vp)) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn)))

        def of(d0: Column) -> Column:
            hp = mask(vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))))
            hn = d0.bitwiseAND(vp)
            down = F.shiftright(d0, 1)
            last = F.call_function("shiftleft", long(1), rows - 1 - j + edits)
            along = F.when(hp.bitwiseAND(last) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(last) != 0, 1).otherwise(0)
            diagonal = F.when(d0.bitwiseAND(long(1 << (width - 1))) == 0, 1).otherwise(0)
            d = acc["d"] + F.when(j + edits < rows, diagonal).otherwise(along)
            return state(mask(hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)))), down.bitwiseAND(hp), d)

        return F.get(F.transform(one, of), F.lit(0))

    zero = state(long(((1 << (edits + 1)) - 1) << edits), long(0), F.least(F.lit(edits), rows))
    return F.when(F.size(long_) == 0, 0).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(long_) - 1, F.lit(0))), zero, step, lambda acc: acc["d"]))


def _shared_start(a: Column, b: Column) -> Column:
    """How many characters two texts share from the start, by halving."""
    steps = F.lit([1 << i for i in range(20, -1, -1)])
    most = F.least(F.length(a), F.length(b))
    test = lambda n, s: (n + s <= most) & (F.substring(a, n + 1, s) == F.substring(b, n + 1, s))
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when(test(n, s), n + s).otherwise(n))


def _core(a: Column, b: Column, body) -> Column:
    """body(a, b) of what is left of two texts without what they share at the start and then at the end."""
    tail = lambda x, n: F.substring(x, n + 1, F.length(x))

    def cut(p: Column) -> Column:
        end = _shared_start(p["x"], p["y"])
        return let(end, lambda n: let(F.struct(tail(p["x"], n).alias("x"), tail(p["y"], n).alias("y")), lambda q: body(q["x"], q["y"])))

    start = let(_shared_start(a, b), lambda n: F.struct(F.reverse(tail(a, n)).alias("x"), F.reverse(tail(b, n)).alias("y")))
    return let(start, cut)


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _strange_words(a: Column, b: Column) -> Column:
    """How many words of one text the other lacks; an edit makes two at most."""
    return F.size(F.array_except(F.split(a, " "), F.split(b, " ")))


def distance(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Edit distance of two texts whose lengths differ by at most ``edits``; over ``edits`` where it is larger."""

    def ordered(x: Column, y: Column) -> Column:
        one, two = F.struct(_characters(x).alias("s"), _characters(y).alias("l")), F.struct(_characters(y).alias("s"), _characters(x).alias("l"))
        measured = let(F.when(F.length(x) <= F.length(y), one).otherwise(two), lambda p: banded_distance(p["s"], p["l"], edits))
        return F.when((_strange_words(x, y) > 2 * edits) | (_strange_words(y, x) > 2 * edits), edits + 1).otherwise(measured)

    return _core(a, b, ordered)


def reach(length: Column, edits: int = EDITS) -> Column:
    """Edits at which a line of so many characters links to one that is no shorter: one in EACH characters, ``edits`` at most."""
    return F.least(F.lit(edits), F.floor(length / EACH).cast("int"))


def _probes(edits: int) -> list[tuple[int, int, int, int]]:
    """(edits, gap, segment, shift) of the substrings that find all lines of ``gap`` fewer characters at so many edits: a place is
    probed only if the edits left of it, and those right of it, can still add up (multi-match-aware selection)."""
    out = []
    for gap in range(edits + 1):
        for i in range(edits + 1):
            right = edits - i
            out += [(edits, gap, i, shift) for shift in range(max(-i, gap - right), min(i, gap + right) + 1)]
    return out


def _keyed(own: DataFrame, edits: int) -> DataFrame:
    """(id, key, indexed, gap) of lines (id, line, size): a line's own segments and the substrings it probes for the lines of
    its own length and of up to ``edits`` fewer characters. A length has one segment more than it may have edits; segments
    differ by one character at most, the longer ones last.

    The places come first, a row each, so that what computes a key is short enough for the JVM to compile.
    """
    place = lambda p: F.struct(*(F.lit(x).alias(n) for x, n in zip(p, ("edits", "gap", "segment", "shift"), strict=True)))
    most, all_ = (F.array(*map(place, ps)) for ps in (_probes(edits), [p for n in range(1, edits + 1) for p in _probes(n)]))
    rows = own.where(F.col("size") >= EACH).select("id", "line", "size", F.inline(F.when(F.col("size") - edits >= edits * EACH, most).otherwise(all_)))
    rows = rows.withColumn("length", F.expr("size - gap")).where(F.expr(f"edits = least({edits}, length div {EACH})")).withColumn("parts", F.expr("edits + 1"))
    rows = rows.withColumn("place", F.expr("(length div parts) * segment + greatest(0, length % parts - (parts - segment)) + 1 + shift"))
    rows = rows.withColumn("width", F.expr("(length div parts) + if(length % parts >= parts - segment, 1, 0)"))
    rows = rows.where("place >= 1 and place + width <= size + 1")
    return rows.select("id", F.expr("xxhash64(length, segment, substring(line, int(place), int(width)))").alias("key"), F.expr("gap = 0 and shift = 0").alias("indexed"), "gap")


def _counts(line: Column) -> Column:
    """How many characters of a line fall in each of KINDS kinds, by code point. An edit moves at most two counts, by one each."""
    kinds = F.transform(_characters(line), lambda c: F.pmod(F.ascii(c), F.lit(KINDS)))
    return let(kinds, lambda k: F.transform(F.sequence(F.lit(0), F.lit(KINDS - 1)), lambda b: F.size(F.filter(k, lambda x: x == b))))


def _part(edits: int):
    """Hash of every (2 * edits + 1)-th count: lines within reach differ in 2 * edits counts at most, so they agree in one such part."""

    def of(c: Column, counts: str = "counts") -> Column:
        own = F.filter(F.sequence(F.lit(0), F.lit(KINDS - 1)), lambda i: i % (2 * edits + 1) == c)
        return F.xxhash64(F.array_join(F.transform(own, lambda i: F.get(counts, i)), ","))

    return lambda c: of(c)


def _count_gap(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda n, d: n + d)


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos from 0, line) of the non-empty lines of (doc_id, text)."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where("line <> ''")


#: Places up to which (doc_id, place) is one number, and what a null doc_id counts as.
PLACES, NULL_DOC = 1 << 31, -(1 << 63)
#: Lines that stand in more places than this, and in more than this share of all, are frequent.
OFTEN, SHARE = 1_000, 1e-4


def _exact(n: int) -> Column:
    return F.lit(n).cast("decimal(20,0)")


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("decimal(20,0)"), _exact(NULL_DOC))


def _order() -> Column:
    """(doc_id, place) as one number."""
    return (_doc() * F.lit(PLACES).cast("decimal(11,0)") + F.col("pos")).cast("decimal(38,0)")


def _ids() -> list[Column]:
    """128 bits of a line: at 10**12 different lines the chance that any two share them is below 10**-14."""
    return [F.xxhash64("line").alias("id"), F.xxhash64(F.lit(2), "line").alias("id2")]


def _lines_at(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(id, id2, line) of lines (id, id2, first) from where they first stand. Only the places move to the texts' shuffle."""
    at = firsts.select(F.floor(F.col("first") / F.lit(PLACES).cast("decimal(11,0)")).cast("decimal(20,0)").alias("_doc"), F.struct(F.pmod("first", F.lit(PLACES).cast("decimal(11,0)")).cast("int").alias("pos"), "id", "id2").alias("at"))
    texts = docs.select(_doc().alias("_doc"), "text").join(at.groupBy("_doc").agg(F.collect_list("at").alias("at")), "_doc")
    parts = F.split("text", "\n", -1)
    found = F.transform(F.array(parts), lambda p: F.transform("at", lambda x: F.struct(x["id"].alias("id"), x["id2"].alias("id2"), F.get(p, x["pos"]).alias("line"))))
    return texts.select(F.explode(F.get(found, F.lit(0))).alias("l")).select("l.*").where("id = xxhash64(line) and id2 = xxhash64(2, line)")


def _frequent(firsts: DataFrame) -> DataFrame:
    """(id, id2, first) of lines (id, id2, first, n) that stand in more than OFTEN places and more than a SHARE of all: 1 / SHARE at most."""
    most = firsts.agg(F.sum("n")).first()[0] or 0
    return firsts.where(F.col("n") > max(OFTEN, int(most * SHARE))).select("id", "id2", "first")


def _once(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(id, line, size) of lines, the frequent ones only from where they first stand: their keys would all go to the same tasks."""
    own = lines(docs).select(*_ids(), "line", F.length("line").alias("size"), _order().alias("order"))
    often = F.broadcast(_frequent(firsts))
    return own.join(often, ["id", "id2"], "left").where("first is null or first = order").select("id", "line", "size")


def links(docs: DataFrame, firsts: DataFrame, edits: int = EDITS, once: bool = True) -> DataFrame:
    """(a, a2, b, b2, distance): the pairs of different lines no more edits apart than the shorter one's ``reach``, each named by
    128 bits of its text; ``firsts`` has (id, id2, first, n) of each different line: its least place and how many it has.

    Lines are cut into a segment more than their edits, of which one must stand unharmed in any line within reach; an index of the
    segments, by length and place, is met by the substrings of the longer line (PassJoin; Li et al., 2011). A segment that many
    lines share would propose all their pairs; so lines meet only where a part of their character counts agrees too, of which
    lines within reach must share one, and where the counts differ by no more than the edits can. What is left is verified.
    """
    if once:
        # dealt by key for those that find which keys are shared and for those that hold them: the sum reads every column, so that
        # Spark takes both for the same
        keyed = _keyed(_once(docs, firsts), edits).repartition("key")
    else:
        keyed = _keyed(lines(docs).select(F.xxhash64("line").alias("id"), "line", F.length("line").alias("size")), edits)
    shared = keyed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("indexed").alias("indexed"), F.max("gap").alias("gap"))
    shared = shared.where("low <> high and indexed and gap >= 0").select("key") if once else table(shared.where("low <> high and indexed").select("key"), "segments")
    held = table(keyed.join(shared.hint("shuffle_hash"), "key").distinct(), "held")
    texts = table(_lines_at(docs, firsts.join(held.select("id").distinct(), "id", "left_semi")).distinct().withColumn("counts", _counts(F.col("line"))), "lines")
    parts = F.transform(F.sequence(F.lit(0), F.lit(2 * edits)), _part(edits))
    told = table(texts.select("id", "id2", "counts", F.posexplode(parts).alias("part", "same")), "told")
    fine = held.join(told, "id")
    index = fine.where("indexed").select("key", "part", "same", F.col("id").alias("a"), F.col("id2").alias("a2"), F.col("counts").alias("ca"))
    probes = fine.select("key", "part", "same", F.col("id").alias("b"), F.col("id2").alias("b2"), F.col("counts").alias("cb"), "gap")
    ordered = (F.col("gap") > 0) | (F.struct("a", "a2") < F.struct("b", "b2"))
    other = (F.col("a") != F.col("b")) | (F.col("a2") != F.col("b2"))
    met = index.join(probes, ["key", "part", "same"]).where(other & ordered & (_count_gap(F.col("ca"), F.col("cb")) <= 2 * edits))
    pairs = table(met.select("a", "a2", "b", "b2").distinct(), "pairs")
    side = lambda n, line: texts.select(F.col("id").alias(n), F.col("id2").alias(f"{n}2"), F.col("line").alias(line))
    both = pairs.join(side("a", "one"), ["a", "a2"]).join(side("b", "two"), ["b", "b2"])
    # written before it is filtered: a filter pushed into the projection would run each verification twice
    most = reach(F.least(F.length("one"), F.length("two")), edits)
    measured = table(both.select("a", "a2", "b", "b2", distance(F.col("one"), F.col("two"), edits).alias("distance"), most.alias("most")), "measured")
    return measured.where("distance <= most").drop("most").distinct()


def repeated_lines(docs: DataFrame, edits: int = EDITS, once: bool = True) -> DataFrame:
    """(doc_id, pos, removed, links) of each non-empty line: ``removed`` if an equal line or a linked one comes
    earlier, by (doc_id, pos); ``links`` counts the different lines it links to. Null doc_ids come first; rows with the same
    doc_id and place come together."""
    all_ = table(lines(docs).select("doc_id", "pos", *_ids()), "all")
    order = _order()
    firsts = table(all_.groupBy("id", "id2").agg(F.min(order).alias("first"), F.count("*").alias("n")), "firsts")
    found = table(links(docs, firsts, edits, once), "links")
    both = found.select("a", "a2", "b", "b2").union(found.select("b", "b2", "a", "a2"))
    both = both.join(firsts.select(F.col("id").alias("b"), F.col("id2").alias("b2"), "first"), ["b", "b2"]).groupBy(F.col("a").alias("id"), F.col("a2").alias("id2")).agg(F.min("first").alias("near"), F.count("*").alias("links"))
    known = table(firsts.drop("n").join(both, ["id", "id2"], "left"), "known")
    joined = all_.join(known, ["id", "id2"])
    earlier = (order > F.col("first")) | F.coalesce(F.col("near") < F.col("first"), F.lit(False))
    return joined.select("doc_id", "pos", earlier.alias("removed"), F.coalesce("links", long(0)).alias("links"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, once: bool = True) -> DataFrame:
    """Each row of ``docs`` with its other columns and: text without its removed lines, ``removed`` (their places from 0),
    ``n_lines`` and ``n_links``.

    A line goes if an equal line, or one within reach (an edit for each EACH characters of the shorter line, at most ``edits``), comes
    earlier by (doc_id, place). So lines under EACH characters go only as equals: at one edit they would be other words. Empty lines stay and never link; a text all of whose other lines go becomes what is left, null and empty
    texts stay as they are. Rows that share a doc_id lose the places that go in any of them, but the least such row's first
    occurrence counts for all. Columns named removed, n_lines or n_links in the input are replaced. Lines are told apart by
    128 bits of their text. With ``once`` each line's keys are made once and dealt to both that need them; without, they are made
    twice, which takes more CPU. The rows are the same.
    """
    own = docs.drop("removed", "n_lines", "n_links")
    found = repeated_lines(own, edits, once).groupBy(F.col("doc_id").alias("_doc")).agg(
        F.array_sort(F.collect_set(F.when(F.col("removed"), F.col("pos")))).alias("removed"), F.sum("links").alias("n_links")
    )
    joined = own.join(table(found, "removed"), F.col("doc_id").eqNullSafe(F.col("_doc")), "left").drop("_doc")
    parts = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("removed"))
    text = F.when(F.size("removed") > 0, F.array_join(F.transform(F.array(parts), lambda p: F.array_join(F.transform(kept, lambda i: F.get(p, i)), "\n")), "")).otherwise(F.col("text"))
    return joined.select(
        *(F.when(F.col("text").isNotNull(), text).alias("text") if c == "text" else c for c in own.columns),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
        F.when(F.col("text").isNull(), long(0)).otherwise(F.size(parts).cast("long")).alias("n_lines"),
        F.coalesce("n_links", long(0)).alias("n_links"),
    )
