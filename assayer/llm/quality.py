"""Quality by a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.labelled import remainder, sample
from assayer.llm.words import text_chunks

#: Bytes under a filter, filters, bytes of a chunk, bytes from one chunk to the next.
WIDTH, FILTERS, CHUNK, STRIDE = 6, 16, 256, 224
#: Labelled documents used for fitting, chunks of each from which filters are learned, rounds.
ROWS, CHUNKS, ROUNDS = 3000, 6, 6
#: Share of rows held out of fitting (crc32 modulo), its remainder, and the score from which a document is accepted.
MODULUS, HELD_OUT, ACCEPT = 5, 0, 0.3
#: Chunks convolved at once.
BLOCK = 256


def chunked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a view of all runs of CHUNK bytes, starts, owner): overlapping chunks that cover all of each text; the last is padded with zeros."""
    n = np.array([max(1, -(-(len(t) - (CHUNK - STRIDE)) // STRIDE)) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(t + bytes(k * STRIDE + CHUNK - STRIDE - len(t)) for t, k in zip(texts, n.tolist(), strict=True)), np.uint8)
    owner = np.repeat(np.arange(len(texts)), n)
    starts = np.arange(len(owner)) * STRIDE + owner * (CHUNK - STRIDE)
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK), starts, owner


@dataclass
class Network:
    """Filters as a table of byte responses, a bias for each, their weights, and how chunks combine."""

    table: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    mix: np.ndarray

    def responses(self, x: np.ndarray) -> np.ndarray:
        places = CHUNK - WIDTH + 1
        out = np.take(self.table[0], x[:, :places], axis=0)
        for j in range(1, WIDTH):
            out += np.take(self.table[j], x[:, j : j + places], axis=0)
        return out

    def logits(self, view: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts))
        for i in range(0, len(starts), BLOCK):
            pooled = self.responses(view[starts[i : i + BLOCK]]).max(axis=1)
            out[i : i + BLOCK] = np.maximum(pooled + self.bias, 0) @ self.weight + self.offset
        return out

    def features(self, texts: list[bytes]) -> np.ndarray:
        view, starts, owner = chunked(texts)
        z = np.clip(self.logits(view, starts), -30, 30)
        p = 1 / (1 + np.exp(-z))
        n = np.bincount(owner, minlength=len(texts))
        low = np.full(len(texts), 1.0)
        np.minimum.at(low, owner, p)
        return np.stack([np.bincount(owner, z, len(texts)) / n, np.bincount(owner, p, len(texts)) / n, low, np.ones(len(texts))], axis=1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.mix, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's steps; the last column is the intercept."""
    w, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    keep[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
    return w


def taken(text: bytes, chunks: int = CHUNKS) -> np.ndarray:
    """At most ``chunks`` of a text's chunks, drawn evenly from all of it by a generator seeded with the text."""
    view, starts, _ = chunked([text])
    rng = np.random.default_rng(xxhash.xxh3_64_intdigest(text))
    return view[np.sort(rng.permutation(starts)[:chunks])]


def filters(x: np.ndarray, target: np.ndarray, seed: int = 0) -> Network:
    """Filters and weights by Adam on chunks (n x CHUNK bytes) labelled 0 or 1, classes weighted evenly; ``mix`` is still empty."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), 0.0, np.zeros(4))
    if len(set(target.tolist())) < 2:
        return net
    cost = np.where(target == 1, 0.5 / target.mean(), 0.5 / (1 - target.mean()))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.table, net.bias, net.weight, np.zeros(1, np.float32))]
    offset, step, rate = np.zeros(1, np.float32), 0, 0.02
    places = np.arange(WIDTH)[None, None, :]
    for _ in range(ROUNDS):
        for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // BLOCK)):
            own, step = x[batch], step + 1
            r = net.responses(own)
            at = r.argmax(axis=1)
            pooled = np.take_along_axis(r, at[:, None, :], axis=1)[:, 0, :] + net.bias
            hidden = np.maximum(pooled, 0)
            z = hidden @ net.weight + offset[0]
            d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[batch]) * cost[batch] / len(batch)).astype(np.float32)
            back = d[:, None] * net.weight * (pooled > 0)
            grad = np.zeros_like(net.table)
            byte = own[np.arange(len(own))[:, None, None], at[:, :, None] + places]
            np.add.at(grad, (np.broadcast_to(places, byte.shape), byte, np.arange(FILTERS)[None, :, None]), back[:, :, None])
            for p, g, (m, v) in zip((net.table, net.bias, net.weight, offset), (grad, back.sum(0), hidden.T @ d, d.sum(keepdims=True)), state, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    net.offset = float(offset[0])
    return net


def _even(labels: np.ndarray) -> np.ndarray:
    """``mix`` that scores every text alike: the share of label 1, or one half of nothing."""
    share = np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99)
    return np.array([0, 0, 0, np.log(share / (1 - share))])


def fit(sampled: DataFrame, seed: int = 0) -> Network:
    """The network for (doc_id, text, label): filters learned from some chunks of each text, then how chunks combine, by logistic
    regression over the whole texts. Texts stay with the executors; CHUNKS chunks and four numbers of each reach the driver.

    Without rows of both classes the network scores every text alike."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, labels in text_chunks(batches, 1):
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array([taken(t).tobytes() for t in texts], pa.binary())], names=["doc_id", "label", "chunks"])

    kind = sampled.schema["doc_id"].dataType.simpleString()
    rows = sampled.mapInArrow(draw, f"doc_id {kind}, label int, chunks binary").orderBy("doc_id", "label").collect()
    parts = [np.frombuffer(r["chunks"], np.uint8).reshape(-1, CHUNK) for r in rows]
    x = np.concatenate(parts) if parts else np.zeros((0, CHUNK), np.uint8)
    net = filters(x, np.repeat([float(r["label"]) for r in rows], [len(c) for c in parts]), seed)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, labels in text_chunks(batches, 1):
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(net.features(texts).tolist(), pa.list_(pa.float64()))], names=["doc_id", "label", "features"])

    y = np.array([r["label"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        net.mix = _even(y)
        return net
    rows = sampled.mapInArrow(measure, f"doc_id {kind}, label int, features array<double>").orderBy("doc_id", "label").collect()
    net.mix = logistic(np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows], float))
    return net


def score(docs: DataFrame, labels: DataFrame, modulus: int = MODULUS, held_out: int = HELD_OUT, rows: int = ROWS) -> DataFrame:
    """(doc_id, held_out boolean, score double) for each row of (doc_id, text), fitted on ``labels`` (doc_id, quality).

    Whole texts are scored, in overlapping chunks of bytes; null and empty ones as a chunk of padding. Labels come from at
    most ``rows`` documents outside the held-out remainder; only the text goes into the score. A null doc_id is
    not held out. Repeated rows each come back; extra columns are ignored.
    """
    net = fit(sample(docs, labels, "quality", modulus, held_out, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(net.scores(texts))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), modulus) == held_out, F.lit(False)).alias("held_out"), "score")


def keep(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``accept``, with all their columns."""
    net = fit(sample(docs, labels, "quality", MODULUS, HELD_OUT, ROWS))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([pa.array(np.arange(len(batch))), batch.column(at)], names=["row", "text"])
            scores = [net.scores(texts) for _, texts in text_chunks(iter([pair]))]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= accept))

    return docs.mapInArrow(run, docs.schema)
