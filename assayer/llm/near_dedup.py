"""SimHash fingerprints and near-duplicates by BK-trees within pigeonhole shards, alone or verified by Jaccard similarity, with an exact join for the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.components import components
from assayer.llm.shared import table
from assayer.llm.words import CHUNK, pieces, rolling, text_chunks, text_hashes

#: Differing bits up to which two fingerprints link, and words in a shingle.
RADIUS, SHINGLE = 3, 3
#: Fingerprints in one tree; larger shards are refined, and at last cut into several trees.
TREE = 2000
#: Words in a shingle of the exact join, and the Jaccard similarity from which two texts link, as a fraction.
WORDS, ALIKE = 5, (4, 5)
#: One text in SAMPLE tells which shingles are common, of which COMMON are kept. They only order the shingles of a set.
SAMPLE, COMMON = 16, 100_000
#: Kinds of shingles counted.
KINDS = 128


def _bits_of(hashes: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)


def _long_simhash(text: bytes, shingle: int) -> int:
    """The fingerprint of one text, of which only a piece is split into words at a time."""
    ones, n, tail = np.zeros(64, np.int64), 0, []
    for piece in pieces(text):
        words = tail + piece.lower().split()
        if len(words) >= shingle:
            own = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(len(words) - shingle + 1)]
            ones += _bits_of(own).sum(axis=0, dtype=np.int64)
            n += len(own)
            words = words[len(own) :]
        tail = words
    if not n and tail:
        ones, n = _bits_of([xxhash.xxh64_intdigest(b" ".join(tail), 42)])[0].astype(np.int64), 1
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def simhash(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each text, as uint64. No words: zero."""
    if sum(map(len, texts)) > 2 * CHUNK:
        return np.array([_long_simhash(t, shingle) for t in texts], np.uint64)
    hashes, sizes = [], []
    for text in texts:
        words = text.lower().split()
        if len(words) < shingle:
            parts = [b" ".join(words)] if words else []
        else:
            parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        own = [xxhash.xxh64_intdigest(x, 42) for x in parts]
        sizes.append(len(own))
        hashes += own
    out = np.zeros(len(texts), np.uint64)
    sizes = np.array(sizes)
    some = sizes > 0
    if some.any():
        starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        counts = np.add.reduceat(_bits_of(hashes), starts, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * counts > sizes[some][:, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of each row of (doc_id, text); a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(simhash(texts, shingle).view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


class BKTree:
    """Burkhard and Keller's tree: each child hangs on the edge that bears its distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at = len(self.values)
        self.values.append(value)
        self.edges.append({})
        node = 0
        while at:
            gap = (value ^ self.values[node]).bit_count()
            child = self.edges[node].setdefault(gap, at)
            if child == at:
                break
            node = child

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Positions of the values at most radius away; only edges in [gap - radius, gap + radius] are followed."""
        todo = [0] if self.values else []
        while todo:
            node = todo.pop()
            gap = (value ^ self.values[node]).bit_count()
            if gap <= radius:
                yield node
            todo += [child for edge, child in self.edges[node].items() if gap - radius <= edge <= gap + radius]


def _linked(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Star edges of the local components. Rows come sorted by (key, shard, probe): the members of a tree, then
    the fingerprints of the other trees of its key, which only ask. So a tree has at most about TREE values and
    the rest streams by."""
    at, tree, parent, out = None, BKTree(), {}, []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def flush() -> pa.RecordBatch:
        pairs = np.array([(a & (2**64 - 1), b & (2**64 - 1)) for a, b in out], np.uint64).reshape(-1, 2).view(np.int64)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        rows = zip(*(batch.column(i).to_numpy(zero_copy_only=False).tolist() for i in range(4)), strict=True)
        for key, shard, probe, fp in rows:
            if (key, shard) != at:
                out += [(x, root(x)) for x in parent if root(x) != x]
                at, tree, parent = (key, shard), BKTree(), {}
            value = fp & (2**64 - 1)
            if probe:
                out += [(value, y) for y in {root(tree.values[i]) for i in tree.within(value, radius)}]
                continue
            parent[value] = value
            for i in tree.within(value, radius):
                a, b = root(tree.values[i]), root(value)
                parent[max(a, b)] = min(a, b)
            tree.add(value)
        if len(out) > 50_000:
            yield flush()
    out += [(x, root(x)) for x in parent if root(x) != x]
    yield flush()


def _blocks(bits: int, radius: int, skip: tuple[int, int] | None) -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 blocks of the bits that are not in ``skip``."""
    free = [i for i in range(bits) if not skip or not skip[0] <= i < skip[0] + skip[1]]
    cuts = [round(len(free) * i / (radius + 1)) for i in range(radius + 2)]
    return [(free[a], b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _bits(shift: int, width: int) -> F.Column:
    return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def links(fps: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (fp long) at most ``radius`` bits apart.

    Two such fingerprints agree in one of radius + 1 blocks, so each block's value is a shard with a BK-tree
    of its own. A shard of more than ``tree`` values is refined by a second block out of the other bits, which
    loses no pair for the same reason; one that is still larger is dealt over several trees, each of
    which every other value of the shard asks. The edges are stars of the components in each tree,
    so a dense group of m values gives about m of them, not its pairs.
    """
    parts = _blocks(64, radius, None)
    first = fps.select("fp", F.posexplode(F.array(*(_bits(*x) for x in parts))).alias("block", "value"))
    first = first.select("fp", "block", F.col("block").cast("long").bitwiseOR(F.shiftleft("value", 8)).alias("key"))
    size = table(first.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shards")
    # block and value fit in 24 bits: the key of a refined shard is that, the second block and its value.
    sized = first.join(size, "key")
    small = sized.where(F.col("n") <= tree).select("key", "fp")
    second = None
    for i, part in enumerate(parts):
        cut = F.array(*(F.shiftleft(_bits_around(*x, part), 8).bitwiseOR(F.lit(j).cast("long")) for j, x in enumerate(_blocks(64, radius, part))))
        one = sized.where((F.col("n") > tree) & (F.col("block") == i)).select("fp", "key", F.explode(cut).alias("sub"))
        second = one if second is None else second.unionByName(one)
    second = table(second.select((F.shiftleft("key", 32).bitwiseOR(F.col("sub")).bitwiseOR(F.lit(-(2**63)))).alias("key"), "fp"), "refined")
    trees = second.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / tree).cast("int").alias("trees"))
    dealt = second.join(table(trees, "trees"), "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
    dealt = dealt.select("key", "fp", "own", F.explode(F.sequence("own", F.col("trees") - 1)).alias("shard"))
    members = small.select("key", F.lit(0).alias("shard"), F.lit(False).alias("probe"), "fp").unionByName(dealt.select("key", "shard", (F.col("own") != F.col("shard")).alias("probe"), "fp"))
    ordered = members.repartition("key", "shard").sortWithinPartitions("key", "shard", "probe", "fp")
    return ordered.mapInArrow(lambda batches: _linked(batches, radius), "a long, b long")


def _bits_around(shift: int, width: int, hole: tuple[int, int]) -> F.Column:
    """``width`` bits from ``shift`` on, jumping the hole if the block spans it."""
    low = max(0, min(width, hole[0] - shift)) if shift < hole[0] else width
    if low == width:
        return _bits(shift, width)
    return _bits(shift, low).bitwiseOR(F.shiftleft(_bits(hole[0] + hole[1], width - low), low))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long, component_id) for each row of (doc_id, text).

    component_id is the smallest doc_id of the documents reachable over links of at most ``radius`` bits.
    Equal fingerprints link at no cost: the graph has one node for each. Null or word-free texts have
    fingerprint zero and link like any other; repeated rows each come back; a null doc_id
    counts for a component only where it has no other. Extra columns are ignored.
    """
    prints = table(fingerprints(docs, shingle), "prints")
    nodes = table(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    linked = table(components(links(nodes.select("fp"), radius)), "linked")
    named = nodes.join(linked, nodes.fp == linked.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = table(named.groupBy("root").agg(F.min("first").alias("component_id")), "lowest")
    of = table(named.join(lowest, "root").select("fp", "component_id"), "of")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def _sets(batches: Iterator[pa.RecordBatch], shingle: int, hot: tuple[np.ndarray, np.ndarray], alike: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
    for ids, texts in text_chunks(batches):
        hashes, words = text_hashes(texts, lower=True)
        ends = np.cumsum(words)
        runs = rolling(hashes, shingle)
        nodes, sets = [], []
        for end, size in zip(ends.tolist(), words.tolist(), strict=True):
            own = np.unique(runs[end - size : end - shingle + 1] if size >= shingle else rolling(hashes[end - size : end], size))
            nodes.append(xxhash.xxh3_64_intdigest(own.tobytes()))
            sets.append(own)
        sizes = np.array([len(x) for x in sets])
        flat, rank = np.concatenate(sets), np.zeros(sizes.sum(), np.int64)
        kinds = np.repeat(np.arange(len(sets)) * KINDS, sizes) + (flat % np.uint64(KINDS)).astype(np.int64)
        counts = np.minimum(np.bincount(kinds, minlength=len(sets) * KINDS), 255).astype(np.uint8).reshape(-1, KINDS)
        if len(hot[0]):
            place = np.minimum(np.searchsorted(hot[0], flat), len(hot[0]) - 1)
            rank = np.where(hot[0][place] == flat, hot[1][place], 0)
        flat = flat[np.lexsort((flat, rank, np.repeat(np.arange(len(sets)), sizes)))]
        kept = sizes
        if alike:
            num, den = alike
            kept = np.where(sizes > 0, sizes - -(-sizes * num // den) + 1, 0)
            flat = flat[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(kept, sizes)]
        offsets = pa.array(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32))
        shingles = pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64)))
        yield pa.RecordBatch.from_arrays([ids, pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes.astype(np.int32)), shingles, pa.array([x.tobytes() for x in counts], pa.binary())], names=["row", "node", "size", "shingles", "counts"])


def shingle_sets(texts: DataFrame, shingle: int = WORDS, common: DataFrame | None = None, alike: tuple[int, int] | None = None) -> DataFrame:
    """(row, node, size, shingles, counts) of each row of (row, text): the set of its runs of ``shingle`` words in lower case, as 64-bit
    hashes, and a hash that names the set. A shorter text is one run; no words or null: the empty set. Shingles
    stand in one order in all sets: those not in ``common`` (shingle, n) first, then by n; ties by hash. With ``alike``
    only the first size - ceil(alike * size) + 1 of them are given, of which any two sets that are so alike share one.
    ``counts`` has a byte for each of KINDS kinds of shingle, by hash: how many there are, 255 at most."""
    rows = common.collect() if common is not None else []
    keys, n = (np.array([r[c] for r in rows], np.int64) for c in ("shingle", "n"))
    order = np.argsort(keys.view(np.uint64))
    hot = (keys.view(np.uint64)[order], n[order])
    shipped = texts.sparkSession.sparkContext.broadcast(hot)
    kind = texts.schema["row"].dataType.simpleString()
    return texts.select("row", "text").mapInArrow(lambda batches: _sets(batches, shingle, shipped.value, alike), f"row {kind}, node long, size int, shingles array<long>, counts binary")


def common_shingles(docs: DataFrame, shingle: int = WORDS) -> DataFrame:
    """(shingle, n) of at most COMMON shingles that are in three or more different texts of a sample, the commonest ones."""
    sample = shingle_sets(docs.select(F.lit(0).alias("row"), "text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0), shingle).dropDuplicates(["node"])
    counted = sample.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).where("n > 2")
    return counted.orderBy(F.desc("n"), "shingle").limit(COMMON)


def _countable(pairs: DataFrame, prints: DataFrame, alike: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of nodes whose counts differ by no more than those of sets so alike can; it loses no such pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, KINDS).astype(np.int64) for c in ("counts_a", "counts_b"))
            gap = np.abs(a - b).sum(axis=1)
            total = batch.column("size_a").to_numpy().astype(np.int64) + batch.column("size_b").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array((alike[0] + alike[1]) * gap <= (alike[1] - alike[0]) * total))

    own = table(prints.select("node", "size", "counts").dropDuplicates(["node"]), "counts")
    one, two = (own.select(F.col("node").alias(n), F.col("size").alias(f"size_{n}"), F.col("counts").alias(f"counts_{n}")) for n in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "size_a", "size_b", "counts_a", "counts_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, prints: DataFrame, alike: tuple[int, int], shingle: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are alike enough; the sets are made again, of one text for each node that is in a pair."""
    pairs = table(_countable(pairs, prints, alike), "countable")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = table(prints.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("text_key").alias("row")).select("row").distinct(), "wanted")
    texts = docs.select(F.xxhash64("text").alias("row"), "text").join(wanted, "row", "left_semi").dropDuplicates(["row"])
    sets = table(shingle_sets(texts, shingle).select("node", "shingles").dropDuplicates(["node"]), "sets")
    one, two = (sets.select(F.col("node").alias(n), F.col("shingles").alias(f"_{n}")) for n in "ab")
    both = pairs.join(one, "a").join(two, "b")
    # written before it is filtered: a filter pushed into the projection would run each verification twice
    sizes = F.size("_a") + F.size("_b")
    found = table(both.select("a", "b", sizes.alias("sizes"), F.size(F.array_intersect("_a", "_b")).alias("shared")), "measured")
    return found.where((alike[0] + alike[1]) * F.col("shared") >= alike[0] * F.col("sizes")).select("a", "b")


def simhash_pairs(docs: DataFrame, prints: DataFrame, shingle: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(a, b) of nodes of ``prints`` (text_key, node, ...): each node and the least one of its component, over SimHash
    fingerprints of ``shingle`` words that BK-trees find at most ``radius`` bits apart. a < b; the pairs are not verified yet."""
    near = near_duplicates(docs.select(F.xxhash64("text").alias("doc_id"), "text"), radius, shingle)
    nodes = prints.select("text_key", "node").distinct().join(near.select(F.col("doc_id").alias("text_key"), "component_id").distinct(), "text_key")
    nodes = table(nodes.select("component_id", "node").distinct(), "near")
    least = table(nodes.groupBy("component_id").agg(F.min("node").alias("a"), F.max("node").alias("high")).where("a <> high").drop("high"), "least")
    return nodes.join(least, "component_id").where("node <> a").select("a", F.col("node").alias("b"))


def alike_links(docs: DataFrame, prints: DataFrame, alike: tuple[int, int] = ALIKE, shingle: int = WORDS) -> DataFrame:
    """Edges (a, b) that connect all different sets of a Jaccard similarity of at least ``alike``; ``prints`` has
    (text_key, node, size, shingles, counts) with the first shingles of each row's set.

    SimHash and its BK-trees propose the near copies within their radius (``simhash_pairs``), which are verified on the whole sets. At
    this similarity most pairs lie beyond any radius that pigeonhole shards can serve, so an exact join finds the rest.

    Two such sets share one of their first shingles, whatever order the shingles stand in, and by the places of the first they
    share enough can still follow (PPJoin; Xiao et al., 2008). The rarer shingles come first, so few unlike sets meet. All
    members of a shard meet its least node first; the rest meet only where that has not connected them
    yet, so a group of close copies costs its size and not its pairs. Pairs whose counts of shingles by kind agree are verified on the whole sets.
    """
    num, den = alike
    heads = prints.select("node", "size", F.posexplode("shingles").alias("pos", "key"))
    shared = table(heads.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key", "low"), "shared")
    held = table(heads.join(shared, "key").distinct(), "held")
    side = lambda n, *more: held.select("key", F.col("node").alias(n), F.col("size").alias(f"size_{n}"), F.col("pos").alias(f"pos_{n}"), *more)
    left = F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b"))
    near = (num + den) * left >= num * (F.col("size_a") + F.col("size_b"))
    hubs = held.where("node = low").select("key", F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("pos").alias("pos_a"))
    met = hubs.join(side("b"), "key").where((F.col("a") != F.col("b")) & near).select("a", "b")
    first = table(simhash_pairs(docs, prints, shingle).unionByName(met).distinct(), "first")
    star = _verified(first, docs, prints, alike, shingle)
    roots = table(components(star), "roots")
    held = table(held.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    met = side("a", F.col("root").alias("root_a")).join(side("b", F.col("root").alias("root_b")), "key").where((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & near)
    rest = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = table(rest.join(first, ["a", "b"], "left_anti"), "rest")
    return star.unionByName(_verified(rest, docs, prints, alike, shingle))


def _row_key(seed: int) -> F.Column:
    """64 bits of (doc_id, text), nulls told from values; two seeds make 128."""
    return F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def _grouped(docs: DataFrame, alike: tuple[int, int], shingle: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k1, k2, node, ...) of each row, where k1 and k2 name its (doc_id, text); and (node, root) of the sets that link."""
    own = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_key"), _row_key(1).alias("k1"), _row_key(2).alias("k2")).alias("row"), "text")
    prints = table(shingle_sets(own, shingle, common_shingles(docs, shingle), alike).select("row.*", "node", "size", "shingles", "counts"), "prints")
    return prints, table(components(table(alike_links(docs, prints, alike, shingle), "links")), "linked")


def _least(prints: DataFrame, linked: DataFrame, value: F.Column) -> DataFrame:
    """(node, least): the least value of any row in the node's component."""
    nodes = prints.groupBy("node").agg(F.min(value).alias("first"))
    named = table(nodes.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    lowest = table(named.groupBy("root").agg(F.min("first").alias("least")), "lowest")
    return table(named.join(lowest, "root").select("node", "least"), "of")


def alike_documents(docs: DataFrame, alike: tuple[int, int] = ALIKE, shingle: int = WORDS) -> DataFrame:
    """(doc_id, node, component_id) for each row of (doc_id, text), where component_id is the smallest doc_id of the documents
    reachable over pairs of a Jaccard similarity of at least ``alike`` of their sets of ``shingle`` words. Equal sets are alike, also empty ones."""
    prints, linked = _grouped(docs, alike, shingle)
    of = _least(prints, linked, F.col("doc_id"))
    return prints.join(of, "node").select("doc_id", "node", F.col("least").alias("component_id"))


def one_of_each(docs: DataFrame, alike: tuple[int, int] = ALIKE, shingle: int = WORDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, less the near-duplicates (SimHash and BK-trees, verified, and the exact join
    for what lies beyond their radius): of each group one row stays, that with the
    smallest doc_id, a null one only where there is no other; of rows that share it, the least by a hash of the text. Rows are
    told apart by 128 bits of (doc_id, text), so rows of other groups with the same doc_id stay."""
    prints, linked = _grouped(docs, alike, shingle)
    of = _least(prints, linked, F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k1", "k2"))
    later = prints.join(of, "node").where((F.col("k1") != F.col("least.k1")) | (F.col("k2") != F.col("least.k2")))
    later = table(later.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct(), "later")
    kept = docs.withColumn("_k1", _row_key(1)).withColumn("_k2", _row_key(2)).join(later, ["_k1", "_k2"], "left_anti")
    order = Window.partitionBy("_k1", "_k2").orderBy("_k1")
    return kept.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select(*docs.columns)
