"""Benchmark decontamination by greedy string tiling (running Karp-Rabin)."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import table
from assayer.llm.words import rolling, text_chunks

#: Tokens of a shared seed and of the shortest tile; share of a benchmark item's tokens that tiles must cover.
SEED, COVERAGE = 5, 0.5
TOKEN = re.compile(r"\w+")
#: Tokens of a text taken at once.
BLOCK = 1 << 20
#: Least and most bits (as powers of two) of the filter of benchmark seeds that tasks hold; about BITS_A_SEED bits a seed.
FILTER, BITS_A_SEED = (16, 26), 16


def tokens(text: str) -> Iterator[str]:
    return (m.group() for m in TOKEN.finditer(text.lower()))


def token_hashes(text: str) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in tokens(text)), np.uint64)


def seeds(hashes: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Karp-Rabin hashes of the runs of ``width`` tokens, a block at a time; runs of different widths hash apart."""
    salt = np.uint64(width * 0x9E3779B97F4A7C15 & 2**64 - 1)
    for at in range(0, max(0, len(hashes) - width + 1), BLOCK):
        yield rolling(hashes[at : at + BLOCK + width - 1], width) ^ salt


def coded(item: str, doc: str) -> tuple[np.ndarray, np.ndarray]:
    """Both texts' tokens as numbers that are equal where tokens are; a token that the item lacks is -1."""
    ids: dict[str, int] = {}
    own = np.fromiter((ids.setdefault(w, len(ids)) for w in tokens(item)), np.int32)
    return own, np.fromiter((ids.get(w, -1) for w in tokens(doc)), np.int32)


def _diagonals(item: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """The diagonals j - i on which the item's run at i and the document's at j have one hash. A bit for each diagonal is all
    that is held, however often a run repeats."""
    grams = rolling(item.astype(np.uint64), width)
    order = np.argsort(grams, kind="stable")
    keys = grams[order]
    marks = np.zeros(len(item) + len(doc), bool)
    for at in range(0, len(doc) - width + 1, BLOCK):
        own = rolling(doc[at : at + BLOCK + width - 1].astype(np.uint64), width)
        lo = np.searchsorted(keys, own)
        j = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == own)
        by = np.argsort(own[j], kind="stable")
        j = j[by]
        starts, ends = np.searchsorted(own[j], keys), np.searchsorted(own[j], keys, side="right")
        for i, a, b in zip(order.tolist(), starts.tolist(), ends.tolist(), strict=True):
            marks[at + j[a:b] - i + len(item)] = True
    return np.flatnonzero(marks) - len(item)


def _runs(same: np.ndarray, width: int) -> list[tuple[int, int]]:
    """(start, end) of the runs of at least ``width`` true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same, [0]])))
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= width]


def _matches_of(item: np.ndarray, doc: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(-length, start in item, start in doc) of the matches of at least ``width`` tokens along the diagonals that can hold one.

    Where the same stretch of the item matches at very many places, as in a text of one repeated line, only the first n + n * length / width
    are kept, n the item's tokens: tiles mark n tokens of the document at most, so one of those always stays free, and the
    later ones can add nothing to it. Diagonals with one pattern of matches are looked at once."""
    n, m, out, kept = len(item), len(doc), [], {}
    marked = _diagonals(item, doc, width)

    def keep(a: int, b: int, starts: np.ndarray) -> None:
        room = n + n * (b - a) // width + 1 - kept.get((a, b), 0)
        starts = starts[: max(0, room)]
        kept[(a, b)] = kept.get((a, b), 0) + len(starts)
        out.extend((a - b, a, j + a) for j in starts.tolist())

    for d in marked[(marked < 0) | (marked > m - n)].tolist():
        low, high = max(0, -d), min(n, m - d)
        for a, b in _runs(item[low:high] == doc[low + d : high + d], width):
            keep(low + a, low + b, np.array([d]))
    inner = marked[(marked >= 0) & (marked <= m - n)]
    step = max(1, (4 * BLOCK) // n)
    for at in range(0, len(inner), step):
        ds = inner[at : at + step]
        packed = np.packbits(np.lib.stride_tricks.sliding_window_view(doc, n)[ds] == item, axis=1)
        patterns, which = np.unique(packed, axis=0, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")
        ends = np.cumsum(np.bincount(which.ravel(), minlength=len(patterns)))
        for u, (lo, hi) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
            for a, b in _runs(np.unpackbits(patterns[u])[:n], width):
                keep(a, b, ds[order[lo:hi]])
    return out


def tiles(item: np.ndarray, doc: np.ndarray, shortest: int = SEED) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, length) of greedy tiles of two arrays of token numbers: the longest match of unmarked tokens
    again and again, ties to the earliest, down to ``shortest`` tokens (or the whole of a shorter item).

    Hashes of the seeds give the diagonals that can hold a match; along those tokens are compared one by one, so that no
    collision of hashes counts. A match that a tile cuts into comes back with what is left of it."""
    k = min(shortest, len(item))
    if not k or len(doc) < k:
        return []
    heap = _matches_of(item, doc, k)
    heapq.heapify(heap)
    item_free, doc_free, left, out = np.ones(len(item), bool), np.ones(len(doc), bool), len(item), []
    while heap and left >= k:
        size, i, j = heapq.heappop(heap)
        free = item_free[i : i - size] & doc_free[j : j - size]
        if free.all():
            out.append((i, j, -size))
            item_free[i : i - size] = doc_free[j : j - size] = False
            left += size
            continue
        for a, b in _runs(free, k):
            heapq.heappush(heap, (a - b, i + a, j + a))
    return out


def _named(*columns: str) -> list[Column]:
    """Two hashes of the columns, 128 bits, nulls told from values."""
    parts = [c for name in columns for c in (F.col(name).isNull(), F.col(name))]
    return [F.xxhash64(F.lit(s), *parts) for s in (1, 2)]


def _items(benchmark: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(item, item_id, text, copies, width, size) of the distinct items that have tokens, and (seed, item, place) of their seeds."""
    named = benchmark.where("text is not null").groupBy("item_id", "text").agg(F.count("*").alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches):
            for i, text in enumerate(texts):
                hashes = token_hashes(text.decode("utf-8", "replace"))
                width = min(seed, len(hashes))
                at = 0
                for own in seeds(hashes, width) if width else ():
                    n = len(own)
                    columns = [ids.take(pa.array([i] * n, pa.int64())), pa.array(own.view(np.int64)), pa.array(np.arange(at, at + n, dtype=np.int32))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([width] * n, pa.int32()), pa.array([len(hashes)] * n, pa.int32())], names=["item", "seed", "place", "width", "size"])
                    at += n

    items = table(named.withColumn("item", _named("item_id", "text")[0]), "items")
    return items, table(items.select("item", "text").mapInArrow(run, "item long, seed long, place int, width int, size int"), "seeds")


def _filter(known: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the seeds, as 64-bit words, and how many of a seed's bits name its place: at most 2 ** FILTER[1] bits however
    large the benchmark. It only saves work: what it lets through by chance finds no partner in the join."""
    n = known.count()
    bits = min(FILTER[1], max(FILTER[0], (BITS_A_SEED * max(1, n)).bit_length()))
    place = F.col("seed").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    found = known.select(F.shiftright(place, 6).alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << bits - 6, np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return words, bits


def _seeded(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(k1, k2, seed) of the seeds of each text of (k1, text, k2) that the filter knows, distinct within a block."""
    shipped = texts.sparkSession.sparkContext.broadcast(_filter(known))
    widths = sorted(r["width"] for r in known.select("width").distinct().collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = shipped.value
        for k1, texts, k2 in text_chunks(batches, 1):
            rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for i, text in enumerate(texts):
                hashes = token_hashes(text.decode("utf-8", "replace"))
                for width in widths:
                    for own in seeds(hashes, width):
                        place = own & np.uint64((1 << bits) - 1)
                        own = np.unique(own[(words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)])
                        rows.append(np.full(len(own), i))
                        found.append(own)
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([k1.take(at), k2.take(at), pa.array(np.concatenate(found).view(np.int64))], names=["k1", "k2", "seed"])

    return texts.select("k1", "text", "k2").mapInArrow(run, "k1 long, k2 long, seed long")


def _candidates(seeded: DataFrame, known: DataFrame, coverage: float) -> DataFrame:
    """(k1, k2, item) of texts and items whose shared seeds, laid out in the item, reach ``coverage`` of its tokens: tiles can cover no more."""
    met = seeded.join(known, "seed").groupBy("k1", "k2", "item").agg(F.sort_array(F.collect_set("place")).alias("places"), F.first("width").alias("width"), F.first("size").alias("size"))
    steps = F.zip_with(F.slice("places", 2, F.size("places")), F.slice("places", 1, F.size("places") - 1), lambda b, a: F.least(b - a, F.col("width")))
    covered = F.aggregate(steps, F.col("width"), lambda n, s: n + s)
    return met.where(covered >= F.lit(coverage) * F.col("size")).select("k1", "k2", "item")


def _tiled(pairs: DataFrame, coverage: float, seed: int) -> DataFrame:
    """(k1, k2, item, coverage, n_tiles, longest) of the (k1, k2, item, item_text, text) that tiles cover far enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, (item, text) in enumerate(zip(batch.column("item_text"), batch.column("text"), strict=True)):
                own, doc = coded(item.as_py(), text.as_py())
                found = tiles(own, doc, seed)
                share = sum(n for *_, n in found) / max(1, len(own))
                if found and share >= coverage:
                    out.append((row, share, len(found), max(n for *_, n in found)))
            row, share, n, longest = zip(*out, strict=True) if out else ((),) * 4
            kept = batch.select(["k1", "k2", "item"]).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(share, pa.float64()), pa.array(n, pa.int32()), pa.array(longest, pa.int32())], names=["k1", "k2", "item", "coverage", "n_tiles", "longest"])

    return pairs.mapInArrow(run, "k1 long, k2 long, item long, coverage double, n_tiles int, longest int")


def _matches(docs: DataFrame, benchmark: DataFrame, coverage: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, item, coverage, n_tiles, longest) of the distinct texts that items contaminate, and the items.

    Texts meet items in a join over shared seeds; a bitmap of the benchmark's seeds, of a fixed size, keeps the others
    at home. Pairs whose shared seeds can't cover enough fall away before any text moves, and equal texts are tiled once."""
    k1, k2 = _named("text")
    texts = docs.select(k1.alias("k1"), "text", k2.alias("k2")).where("text is not null")
    items, known = _items(benchmark.select("item_id", "text"), seed)
    pairs = table(_candidates(_seeded(texts, known), known, coverage), "candidates")
    wanted = texts.join(pairs.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    both = pairs.join(table(wanted, "wanted"), ["k1", "k2"]).join(items.select("item", F.col("text").alias("item_text")), "item")
    return table(_tiled(both.select("k1", "k2", "item", "item_text", "text"), coverage, seed), "tiled"), items


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest) for each document of (doc_id, text) and item of (item_id, text) whose
    tokens the document's tiles cover to at least ``coverage``; clean documents give no rows.

    Tokens are runs of letters and digits, lower-cased. Documents are joined to items on seeds of ``seed`` shared tokens; coverage
    counts tiles in any order, so reordered passages are caught. An item of fewer tokens must occur whole. Null or empty texts
    and items without tokens match nothing; an item with a null item_id counts like any other and gives a null item_id; repeated
    rows each give their rows; ids may have any type; extra columns are ignored.
    """
    found, items = _matches(docs, benchmark, coverage, seed)
    k1, k2 = _named("text")
    named = found.join(items.select("item", "item_id", "copies"), "item").select("k1", "k2", "item_id", "coverage", "n_tiles", "longest", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return docs.select("doc_id", k1.alias("k1"), k2.alias("k2")).join(named, ["k1", "k2"]).select("doc_id", "item_id", "coverage", "n_tiles", "longest")


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no benchmark item contaminates."""
    found, _ = _matches(docs, benchmark, coverage, seed)
    gone = found.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct()
    k1, k2 = _named("text")
    return docs.withColumns({"_k1": k1, "_k2": k2}).join(gone, ["_k1", "_k2"], "left_anti").select(*docs.columns)
