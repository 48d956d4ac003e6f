"""Passages that repeat an earlier document's, by winnowed seeds and extension over whole windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import table
from assayer.llm.words import MULTIPLIERS, pieces, rolling, text_chunks, text_hashes

#: Words in a window, and in a seed. Any window holds WINDOW - SEED + 1 seeds and its least one is an anchor.
WINDOW, SEED = 13, 6
#: Windows that a task compares at once.
BLOCK = 1 << 20


def _blocks(texts: list[bytes], width: int, seed: int) -> Iterator[tuple]:
    """(place of the block's first word, hashes of its words, row of each window, its start in the block, the hash of its
    anchor) for BLOCK windows of the rows at a time, so that a long text needs little more than its words' hashes."""
    hashes, sizes = text_hashes(texts)
    ends = np.cumsum(sizes)
    for at in range(0, max(0, len(hashes) - width + 1), BLOCK):
        part = hashes[at : at + BLOCK + width - 1]
        grams = rolling(part, seed)
        starts = np.arange(len(part) - width + 1)
        owner = np.searchsorted(ends, starts + at, side="right")
        inside = starts + at + width <= ends[owner]
        near = np.lib.stride_tricks.sliding_window_view(grams, width - seed + 1).min(axis=1)
        yield at, part, owner[inside], starts[inside], near[inside]


def _pairs(owner: np.ndarray, *values: np.ndarray) -> tuple:
    """Distinct (owner, *values)."""
    order = np.lexsort((*values[::-1], owner))
    owner, values = owner[order], [v[order] for v in values]
    new = np.ones(len(owner), bool)
    if len(owner):
        new[1:] = (owner[1:] != owner[:-1]) | np.logical_or.reduce([v[1:] != v[:-1] for v in values])
    return owner[new], *(v[new] for v in values)


def anchors(docs: DataFrame, width: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, anchor long), distinct within a block: the least seed hash of each window, which depends on the window's words alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches):
            for _, _, owner, _, least in _blocks(texts, width, seed):
                run_starts = np.ones(len(owner), bool)
                run_starts[1:] = (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])
                owner, least = _pairs(owner[run_starts], least[run_starts])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array(least.view(np.int64))], names=["doc_id", "anchor"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, anchor long")


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of list<long>; null lists are empty."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), np.int64)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _keys(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return values ^ (rows.astype(np.uint64) + np.uint64(1)) * np.uint64(MULTIPLIERS[0])


def _member(owner: np.ndarray, value: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether (owner, value) is among the sorted ``known`` keys."""
    if not len(known):
        return np.zeros(len(owner), bool)
    keys = _keys(owner, value)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _covered(starts: np.ndarray, width: int) -> np.ndarray:
    """For each word up to the end of the last of the windows that start at ``starts``, whether one covers it."""
    if not len(starts):
        return np.zeros(0, bool)
    depth = np.zeros(int(starts.max()) + width + 1, np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + width, -1)
    return np.cumsum(depth)[:-1] > 0


def copies(docs: DataFrame) -> DataFrame:
    """doc_id of the documents whose every row has the whole text of a document with a smaller doc_id."""
    texts = table(docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")), "texts")
    first = texts.groupBy("digest").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    later = texts.join(table(first.select("digest", "lo"), "firsts"), "digest", "left")
    return later.groupBy("doc_id").agg(F.bool_and(F.coalesce(F.col("doc_id") > F.col("lo"), F.lit(False))).alias("copy")).where("copy").select("doc_id")


def repeats(docs: DataFrame, copied: DataFrame, width: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, windows array<long>): the windows of each document but ``copied`` that also start in one with a smaller doc_id.

    Copies lose every window they have and have none that a smaller document lacks, so they need no comparing.

    Seeds: each window of ``width`` words is bound to its least ``seed``-word hash (winnowing), so that equal windows
    share an anchor; anchors of one document only fall away. Extension: around each anchor that several
    documents hold, the windows reaching left and right of it are compared by 128 bits of their words, all
    documents at once through their least holder. So a passage in m documents costs m rows and not its pairs,
    and the windows found, run together, are the maximal repeats of at least ``width`` words.
    """
    seeds = anchors(docs, width, seed)
    shared = table(seeds.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor"), "shared")
    held = table(seeds.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")).join(copied, "doc_id", "left_anti"), "held")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, lists in text_chunks(batches, 1):
            known = np.sort(_keys(*_flat(lists)))
            for _, part, owner, starts, least in _blocks(texts, width, seed):
                here = _member(owner, least, known)
                owner, starts = owner[here], starts[here]
                one, two = (rolling(part, width, m)[starts] for m in MULTIPLIERS)
                owner, one, two = _pairs(owner, one, two)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["doc_id", "one", "two"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    windows = table(docs.select("doc_id", "text").join(held, "doc_id").select("doc_id", "text", "anchors").mapInArrow(extend, f"doc_id {kind}, one long, two long"), "windows")
    first = windows.groupBy("one", "two").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    first = table(first.select("one", "two", "lo"), "first")
    return windows.join(first, ["one", "two"]).where("doc_id > lo").groupBy("doc_id").agg(F.collect_set("one").alias("windows"))


def dedup(docs: DataFrame, width: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept string) for each row of (doc_id, text).

    Words are runs of bytes other than space and \\t to \\r. A word goes if a window of ``width`` words over it also
    starts in a document with a smaller doc_id; the rest is joined by single spaces. Documents of
    fewer words, null and empty texts lose nothing. Rows that share a doc_id count as one document's and
    each come back; rows with a null doc_id neither lose nor take words. Extra columns are ignored.
    """
    copied = table(copies(docs), "copied")
    found = repeats(docs, copied, width, seed).withColumn("copy", F.lit(False))
    found = table(found.unionByName(copied.withColumn("windows", F.lit(None).cast("array<bigint>")).withColumn("copy", F.lit(True))), "repeats")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, lists, copied in text_chunks(batches, 2):
            known, marks = np.sort(_keys(*_flat(lists))), []
            if len(known):
                for start, part, owner, starts, _ in _blocks(texts, width, seed):
                    marks.append(start + starts[_member(owner, rolling(part, width)[starts], known)])
            gone = _covered(np.concatenate(marks), width) if marks else np.zeros(0, bool)
            at, n, removed, kept = 0, [], [], []
            for text, copy in zip(texts, copied.to_pylist(), strict=True):
                n.append(0)
                removed.append(0)
                left = []
                for piece in pieces(text):
                    words = piece.split()
                    own = np.zeros(len(words), bool)
                    own[: max(0, len(gone) - at)] = gone[at : at + len(words)]
                    left.append((words, own))
                    at += len(words)
                    n[-1] += len(words)
                    removed[-1] += int(own.sum())
                    if not copy:
                        left[-1] = b" ".join(words if not own.any() else [w for w, g in zip(words, own.tolist(), strict=True) if not g])
                if copy:
                    whole = n[-1] >= width
                    removed[-1] = n[-1] if whole else 0
                    left = [] if whole else [b" ".join(w) for w, _ in left]
                kept.append(b" ".join(x for x in left if x))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.select("doc_id", "text").join(found, "doc_id", "left").select("doc_id", "text", "windows", "copy")
    return joined.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept string")




#: DuckDB SQL for the query over documents.
ORACLE = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d)),
f AS (SELECT win, min(doc_id) AS lo FROM g GROUP BY win),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM g JOIN f USING (win) WHERE lo < doc_id),
r AS (SELECT doc_id, count(*) AS n, list(i) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ws[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
