"""Words of whole texts as flat numpy arrays."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text taken together; a longer text is taken alone.
CHUNK = 2 << 20
#: Odd multipliers of the two polynomial hashes over word hashes.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
GAP = re.compile(rb"[\x20\x09-\x0D]")


def give_back() -> None:
    """Hand memory that is free to the system: a Python worker outlives its task, and idles while later steps run beside it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def text_chunks(batches: Iterator[pa.RecordBatch], extra: int = 0) -> Iterator[tuple]:
    """(ids, texts as bytes, *extra columns) in chunks of about CHUNK bytes. Columns: doc_id, text, extra ones. What is free
    at the end is given back."""
    for batch in batches:
        ids, raw = batch.column(0), batch.column(1).cast(pa.binary())
        ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(raw), 0), np.int64)) if len(raw) else np.zeros(0, np.int64)
        start = 0
        while start < len(raw):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + CHUNK)))
            n = stop - start
            texts = [x or b"" for x in raw.slice(start, n).to_pylist()]
            yield (ids.slice(start, n), texts, *(batch.column(2 + i).slice(start, n) for i in range(extra)))
            start = stop
            del texts
        del batch, ids, raw, ends
    give_back()


def pieces(text: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes that cut no word, so that its words never stand in memory all at once."""
    at = 0
    while len(text) - at > size:
        cut = GAP.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


def word_hashes(lists: list[list[bytes]]) -> np.ndarray:
    """64-bit hashes of the words of all lists, one after another."""
    n = sum(map(len, lists))
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in lists for w in ws), np.uint64, n)


def text_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words of the texts, number of words of each); of a long text only a piece is split at a time."""
    flat, sizes = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        for piece in pieces(text):
            own = word_hashes([piece.lower().split() if lower else piece.split()])
            sizes[i] += len(own)
            flat.append(own)
    return (np.concatenate(flat) if flat else np.zeros(0, np.uint64)), sizes


def rolling(hashes: np.ndarray, width: int, multiplier: int = MULTIPLIERS[0]) -> np.ndarray:
    """A hash of each run of ``width`` consecutive words, mixed so that its low and high bits are even."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, m = np.zeros(n, np.uint64), np.uint64(multiplier)
    with np.errstate(over="ignore"):
        for i in range(width):
            out *= m
            out += hashes[i : i + n]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out
