"""Ranked metrics of large groups under many draws: rows by falling score, packed into chunks that blocks of draws walk through."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Slots that are hashed, and rows that are unpacked, at a time; numbers (rows x draws) that are walked at a time.
PIECE, CHUNK, WALKED = 1 << 12, 1 << 15, 1 << 17
#: Rows without ties that are summed up as one, and counts up to which their sums fit 16 bits.
TOGETHER, NARROW = 16, 15
#: A row's flags in a chunk: it is of class 1; its score differs from the row's before.
LABEL, START = 1, 2


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal, and so are nans."""
    x, y = column[1:], column[:-1]
    unlike = pc.fill_null(pc.not_equal(x, y), False)
    if pa.types.is_floating(column.type):
        unlike = pc.and_(unlike, pc.invert(pc.and_(pc.fill_null(pc.is_nan(x), False), pc.fill_null(pc.is_nan(y), False))))
    return pc.or_(unlike, pc.xor(pc.is_null(x), pc.is_null(y))).to_numpy(zero_copy_only=False)


def packed(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Chunks (keys..., _seq, _slot binary, _flags binary) of rows (keys..., _slot, _label, _score) that come sorted by the keys, then
    by falling score. ``_seq`` numbers the chunks of a key; steps of tied scores may run on from one chunk to the next."""
    last, seq = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        at = [batch.schema.get_field_index(k) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for i in at:
            new[1:] |= _differs(batch.column(i))
        score = batch.column(batch.schema.get_field_index("_score"))
        start = new.copy()
        start[1:] |= _differs(score)
        text = lambda i: repr([*(batch.column(j)[i].as_py() for j in at)])
        here = text(0)
        new[0] = last is None or here != last[0]
        start[0] = new[0] or repr(score[0].as_py()) != last[1]
        last = (text(batch.num_rows - 1), repr(score[batch.num_rows - 1].as_py()))
        slot = batch.column(batch.schema.get_field_index("_slot")).to_numpy().astype(np.int32)
        flags = (batch.column(batch.schema.get_field_index("_label")).to_numpy() * LABEL + start * START).astype(np.uint8)
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(new), [batch.num_rows]]))
        numbers = []
        for a in cuts[:-1].tolist():
            seq = 0 if new[a] else seq + 1
            numbers.append(seq)
        parts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        first = pa.array(cuts[:-1])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i).take(first) for i in at), pa.array(numbers, pa.int64()), pa.array([slot[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([flags[a:b].tobytes() for a, b in parts], pa.binary())],
            names=[*keys, "_seq", "_chunk", "_flags"],
        )


class Picked:
    """How often each slot is drawn, in each draw of a block. Groups that share a seed share its counter hash."""

    def __init__(self, draws: range) -> None:
        self.draws, self.seed, self.bits, self.at, self.found, self.turned = draws, None, None, None, None, None

    def _hash(self, seed: str, slots: int) -> None:
        if seed != self.seed:
            self.seed, self.bits = seed, np.zeros((len(self.draws), 0), np.uint32)
        have = self.bits.shape[1]
        if slots <= have:
            return
        grown = np.empty((len(self.draws), slots), np.uint32)
        grown[:, :have] = self.bits
        self.bits, sha = grown, hashlib.sha256
        heads = [f"{seed}/{d}/".encode() for d in self.draws]
        for a in range(have, slots, PIECE):
            tails = [b"%d" % s for s in range(a, min(slots, a + PIECE))]
            for i, head in enumerate(heads):
                grown[i, a : a + len(tails)] = np.frombuffer(b"".join([sha(head + t).digest() for t in tails]), ">u4")[::8]

    def counts(self, seed: str, slots: int, whole: bool) -> np.ndarray:
        """A line for each draw, of as small a type as holds them; with ``whole`` a first line of ones."""
        if self.at != (seed, slots):
            self._hash(seed, slots)
            lines = np.zeros((len(self.draws) + whole, slots), np.uint8)
            lines[:whole] = 1
            for i, bits in enumerate(self.bits, int(whole)):
                line = np.bincount((bits[:slots] / float(1 << 32) * slots).astype(np.int64), minlength=slots)
                if line.max() > np.iinfo(lines.dtype).max:
                    lines = lines.astype(np.uint32)
                lines[i] = line
            self.at, self.found, self.turned = (seed, slots), lines, None
        return self.found

    def walk(self, name: str, seed: str, slots: int, whole: bool) -> Walk:
        counts = self.counts(seed, slots, whole)
        if self.turned is None:
            self.turned = by_slot(counts)
        return Walk(name, counts, self.turned)


def by_slot(counts: np.ndarray) -> np.ndarray:
    """Counts (draws x slots) with a line for each slot, and a last one of zeros, of a type that holds the sums of ``TOGETHER`` rows."""
    out = np.zeros((counts.shape[1] + 1, len(counts)), np.uint16 if counts.max(initial=0) <= NARROW else np.int64)
    out[:-1] = counts.T
    return out


class Walk:
    """A ranked metric of one group under each line of counts (draws x slots), over rows that come by falling score, a chunk at a time."""

    def __init__(self, name: str, counts: np.ndarray, lines: np.ndarray | None = None) -> None:
        self.name, self.lines = name, by_slot(counts) if lines is None else lines
        #: Weights of both classes so far, the sum of the metric, and the weights of the step that may run on.
        self.tp, self.fp, self.area, self.p, self.n = (np.zeros(len(counts)) for _ in range(5))

    def add(self, slot: np.ndarray, flags: np.ndarray) -> None:
        step = TOGETHER * max(1, WALKED // (TOGETHER * len(self.tp)))
        for at in range(0, len(slot), step):
            own = flags[at : at + step]
            label, start = (own & LABEL).astype(self.lines.dtype), np.flatnonzero(own & START)
            run = not len(start) or start[0] > 0  # the first ties with rows of chunks before
            (self._roc if self.name == "roc_auc" else self._pr)(slot[at : at + step].astype(np.intp), label, np.concatenate([[0], start]) if run else start, run)

    def _roc(self, slot: np.ndarray, label: np.ndarray, start: np.ndarray, run: bool) -> None:
        area, p, n = self._ordered(slot, label)
        if len(start) < len(slot):  # of two tied rows either comes first in one of both orders
            step = np.repeat(np.arange(len(start)), np.diff(start, append=len(slot)))
            back = (start + np.append(start[1:], len(slot)))[step] - 1 - np.arange(len(slot))
            area = (area + self._ordered(slot[back], label[back])[0]) / 2
        self.area += self.tp * n + area
        on = run and len(start) == 1
        if run:
            first, other = (p, n) if on else self._sums(slot[: start[1]], label[: start[1]])
            self.area += (self.n * first - self.p * other) / 2
        last, other = (p, n) if len(start) == 1 else self._sums(slot[start[-1] :], label[start[-1] :])
        self.p, self.n = last + self.p * on, other + self.n * on
        self.tp += p
        self.fp += n

    def _sums(self, slot: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of both classes in each draw."""
        both = self.lines.take(slot, axis=0)
        p = both[label > 0].sum(axis=0, dtype=float)
        return p, both.sum(axis=0, dtype=float) - p

    def _ordered(self, slot: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """In each draw: weights of rows of class 0, each times the class 1 above it as if nothing were tied, summed; weights of both
        classes. Each few rows are summed up at once and then follow one another as blocks."""
        blocks = -(-len(slot) // TOGETHER)
        place, side = np.full(blocks * TOGETHER, len(self.lines) - 1), np.zeros(blocks * TOGETHER, label.dtype)
        place[: len(slot)], side[: len(slot)] = slot, label
        up, down, area = (np.zeros((blocks, len(self.tp)), self.lines.dtype) for _ in range(3))
        for at, one in zip(place.reshape(blocks, TOGETHER).T, side.reshape(blocks, TOGETHER).T, strict=True):
            both = self.lines.take(at, axis=0)
            p = both * one[:, None]
            up += p
            both -= p
            down += both
            both *= up  # a row is of one class
            area += both
        up, down = up.astype(float), down.astype(float)
        above = np.cumsum(up, axis=0)
        return area.sum(axis=0, dtype=float) + np.einsum("ij,ij->j", above - up, down), above[-1], down.sum(axis=0)

    def _pr(self, slot: np.ndarray, label: np.ndarray, start: np.ndarray, run: bool) -> None:
        both = self.lines.take(slot, axis=0)
        ups = both * label[:, None]
        p, n = (np.add.reduceat(x, start, axis=0, dtype=float) for x in (ups, both - ups))
        tp, fp = self.tp + np.cumsum(p, axis=0), self.fp + np.cumsum(n, axis=0)
        if run:
            p[0] += self.p
        else:  # the step before is over
            p, tp, fp = np.vstack([self.p, p]), np.vstack([self.tp, tp]), np.vstack([self.fp, fp])
        done, hits, falls = p[:-1], tp[:-1], fp[:-1]  # the last step may run on
        self.area += np.divide(done * hits, hits + falls, out=np.zeros_like(done), where=done > 0).sum(axis=0)
        self.p, self.tp, self.fp = p[-1], tp[-1], fp[-1]

    def values(self) -> list[float | None]:
        """One for each draw; None where it has one class."""
        out = []
        for tp, fp, area, p in zip(self.tp, self.fp, self.area, self.p, strict=True):
            if not (tp > 0 and fp > 0):
                out.append(None)
            elif self.name == "roc_auc":
                out.append(float(area / (tp * fp)))
            else:
                out.append(float((area + p * tp / (tp + fp)) / tp))
        return out


def walked(batches: Iterator[pa.RecordBatch], by: Sequence[str], name: str, draws: int, step: int) -> Iterator[pa.RecordBatch]:
    """(by..., _side, draw, value) of each group and side, whose chunks come in order: a task's block of ``step`` draws, and in the first
    block draw -1, which has every row once."""
    picked, walk, at, key, held, size = None, None, None, None, [], 0

    def flush() -> None:
        nonlocal held, size
        if held:
            walk.add(np.frombuffer(b"".join(s for s, _ in held), np.int32), np.frombuffer(b"".join(f for _, f in held), np.uint8))
        held, size = [], 0

    def done() -> pa.RecordBatch:
        flush()
        values = walk.values()
        numbers = [*picked.draws]
        numbers = [-1, *numbers] if len(values) > len(numbers) else numbers
        own = [pa.array([v] * len(values), t) for v, t in zip(key, types, strict=True)]
        return pa.RecordBatch.from_arrays([*own, pa.array(numbers, pa.int32()), pa.array(values, pa.float64())], names=[*by, "_side", "draw", "value"])

    for batch in batches:
        types = [batch.schema.field(c).type for c in (*by, "_side")]
        rows = zip(*(batch.column(c).to_pylist() for c in ("_block", "_seed", "_slots", *by, "_side")), strict=True)
        slots, flags = (batch.column(c) for c in ("_chunk", "_flags"))
        for i, (block, seed, n, *own) in enumerate(rows):
            if (here := (block, repr(own))) != at:
                if at is not None:
                    yield done()
                if at is None or at[0] != block:
                    picked = Picked(range(block * step, min(draws, (block + 1) * step)))
                at, key, walk = here, own, picked.walk(name, seed, n, block == 0)
            held.append((slots[i].as_py(), flags[i].as_py()))
            size += len(held[-1][1])
            if size >= CHUNK:
                flush()
    if at is not None:
        yield done()


def areas(batches: Iterator[pa.RecordBatch], by: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """(by..., p, n, area) of rows (by..., _slot, _label, _score) that come sorted by the keys, then by falling score: of each key the rows
    of both classes, and those of class 0 each times the class 1 above it, ties by half."""
    once, walk, at, key = np.ones((1, 1), np.uint8), None, None, None

    def done(types: list[pa.DataType]) -> pa.RecordBatch:
        own = [pa.array([v], t) for v, t in zip(key, types, strict=True)]
        return pa.RecordBatch.from_arrays([*own, *(pa.array(x, pa.float64()) for x in (walk.tp, walk.fp, walk.area))], names=[*by, "p", "n", "area"])

    for batch in packed(batches, by):
        types = [batch.schema.field(c).type for c in by]
        for flags, *own in zip(batch.column("_flags").to_pylist(), *(batch.column(c).to_pylist() for c in by), strict=True):
            if repr(own) != at:
                if at is not None:
                    yield done(types)
                at, key, walk = repr(own), own, Walk("roc_auc", once)
            walk.add(np.zeros(len(flags), np.int32), np.frombuffer(flags, np.uint8))
    if at is not None:
        yield done(types)
