"""Logistic regressions over sparse counts, several at a time: each pass over the rows serves the models of all folds.

Rows lie in blocks, by slot: slots that occur (int32), how many rows of the block have each (int32), those rows' places
in the block (uint16) and their counts (uint8, or uint32 if one is larger); y and fold of each row; other columns as
an Arrow stream. The objective is MLlib's: mean loss, a ridge on weights of features divided by their deviation, a free
intercept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_SCHEMA = "slots binary, sizes binary, places binary, times binary, y binary, fold binary, kept binary"
#: Rows of a block at most, and characters of a block about.
MOST_ROWS, BLOCK = 1 << 16, 1_000_000
#: Entries that are worked on at once.
PIECE = 1 << 16


def block(place: np.ndarray, slot: np.ndarray, y: np.ndarray, fold: np.ndarray, kept: pa.RecordBatch) -> pa.RecordBatch:
    """One block of kept.num_rows rows; place and slot of each occurrence."""
    both = (slot.astype(np.int64) << 16) | place
    both.sort()
    first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
    times, both = np.diff(np.r_[first, len(both)]), both[first]
    slot = both >> 16
    new = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, np.int64)
    times = times.astype(np.uint32 if len(times) and times.max() > 255 else np.uint8)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, kept.schema) as out:
        out.write_batch(kept)
    parts = [slot[new].astype(np.int32), np.diff(np.r_[new, len(slot)]).astype(np.int32), both.astype(np.uint16), times, y.astype(np.uint8), fold.astype(np.int32)]
    names = ["slots", "sizes", "places", "times", "y", "fold", "kept"]
    return pa.record_batch([pa.array([x], pa.binary()) for x in (*(p.tobytes() for p in parts), sink.getvalue().to_pybytes())], names=names)


class Block:
    def __init__(self, row: dict[str, bytes]):
        self.slots, self.sizes = np.frombuffer(row["slots"], np.int32), np.frombuffer(row["sizes"], np.int32)
        self.places = np.frombuffer(row["places"], np.uint16)
        self.times = np.frombuffer(row["times"], np.uint8 if len(row["times"]) == len(self.places) else np.uint32)
        self.y, self.fold = np.frombuffer(row["y"], np.uint8).astype(np.float64), np.frombuffer(row["fold"], np.int32)
        self.starts, self.kept = np.r_[0, np.cumsum(self.sizes)], row["kept"]

    def pieces(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first slot, last slot, places, counts) of slots that hold some PIECE entries together, which caches bear."""
        a = 0
        while a < len(self.slots):
            b = max(a + 1, int(np.searchsorted(self.starts, self.starts[a] + PIECE, "right")) - 1)
            here = slice(self.starts[a], self.starts[b])
            yield a, b, self.places[here].astype(np.intp), self.times[here].astype(np.float64)
            a = b

    def margins(self, weights: np.ndarray) -> np.ndarray:
        """For each row of weights, the rows' margins without an intercept."""
        out = np.zeros((len(weights), len(self.y)))
        for a, b, places, times in self.pieces():
            for w, m in zip(weights, out):
                m += np.bincount(places, np.repeat(w.take(self.slots[a:b]), self.sizes[a:b]) * times, len(m))
        return out

    def by_slot(self, values: np.ndarray, power: int = 1) -> np.ndarray:
        """For each row of values, one for each row of the block, their sums by slot, times counts to this power."""
        out = np.zeros((len(values), len(self.slots)))
        for a, b, places, times in self.pieces():
            for v, o in zip(values, out):
                o[a:b] = np.add.reduceat(v.take(places) * times**power, self.starts[a:b] - self.starts[a])
        return out


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for row in b.to_pylist():
            yield Block(row)


def summed(blocks: DataFrame, rows: int, size: int, more: int, add: Callable[[Block, np.ndarray], None], sent_as: type = np.float32) -> np.ndarray:
    """The sum over all blocks of what `add` adds to an array of (rows, size + more). Tasks add up in doubles; the first
    `size` columns are `sent_as`. It is a few MB from each task, and no more with larger tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, size + more))
        for x in blocks_of(batches):
            add(x, total)
        for m, t in enumerate(total):
            yield pa.record_batch([pa.array([m], pa.int32()), pa.array([t[:size].astype(sent_as).tobytes()], pa.binary()), pa.array([t[size:].tobytes()], pa.binary())], names=["m", "body", "tail"])

    total = np.zeros((rows, size + more))
    for b in blocks.mapInArrow(run, "m int, body binary, tail binary").toArrow().to_batches():
        for m, body, tail in zip(*b.columns):
            total[m.as_py(), :size] += np.frombuffer(body.as_buffer(), sent_as)
            total[m.as_py(), size:] += np.frombuffer(tail.as_buffer())
    return total


class Descent:
    """L-BFGS of one model, a point at a time: the caller evaluates `trial` and tells value and gradient."""

    def __init__(self, start: np.ndarray, history: int = 10, tol: float = 1e-6):
        self.x = self.trial = start
        self.value, self.gradient, self.direction = np.inf, None, None
        self.pairs: list[tuple[np.ndarray, np.ndarray, float]] = []  # in floats, as they only shape the direction
        self.history, self.tol, self.step, self.steps, self.done = history, tol, 1.0, 0, False

    def tell(self, value: float, gradient: np.ndarray) -> None:
        if self.gradient is not None:
            slope = self.gradient @ self.direction
            if not value <= self.value + 1e-4 * self.step * slope:
                self.step /= 4 if np.isfinite(value) else 16
                self.done = self.step < 1e-10
                self.trial = self.x + self.step * self.direction
                return
            s, y = (self.trial - self.x).astype(np.float32), (gradient - self.gradient).astype(np.float32)
            if (sy := float(s @ y)) > 1e-12 * (y @ y):
                self.pairs = [*self.pairs[1 - self.history :], (s, y, 1 / sy)]
            self.steps += 1
            self.done = abs(self.value - value) <= self.tol * max(abs(value), abs(self.value), 1e-9)
        self.x, self.value, self.gradient = self.trial, value, gradient
        self.done = self.done or np.sqrt(gradient @ gradient) <= self.tol * max(abs(value), 1e-9)
        q, used = gradient.copy(), []
        for s, y, rho in reversed(self.pairs):
            used.append(a := rho * (s @ q))
            q -= a * y
        if self.pairs:
            s, y, rho = self.pairs[-1]
            q /= rho * (y @ y)
        for (s, y, rho), a in zip(self.pairs, reversed(used)):
            q += (a - rho * (y @ q)) * s
        self.direction = -q
        self.step = 1.0 if self.pairs else 1 / max(np.sqrt(gradient @ gradient), 1e-12)
        self.trial = self.x + self.step * self.direction


def fitted(blocks: DataFrame, size: int, models: int, ridge: float, steps: int) -> np.ndarray:
    """(models, size + 1) weights of raw counts, the intercept last. Model m is fitted without the rows whose fold is m."""
    sc = blocks.sparkSession.sparkContext

    def moments(power: int) -> np.ndarray:
        def add(x: Block, total: np.ndarray) -> None:
            own = np.stack([x.fold != m for m in range(models)]).astype(np.float64)
            total[:, x.slots] += x.by_slot(own, power)
            total[:, size] += own.sum(1) if power == 1 else own @ x.y

        return summed(blocks, models, size, 1, add, np.float64)

    sums = np.stack([moments(1), moments(2)])
    n, ones = sums[:, :, size]
    if (n == 0).any():
        raise ValueError("no rows to fit a model on")
    mean = sums[0, :, :size] / n[:, None]
    deviation = np.sqrt(np.maximum(sums[1, :, :size] - n[:, None] * mean**2, 0) / np.maximum(n - 1, 1)[:, None])
    # a deviation that is nothing but rounding is none
    scale = np.where(deviation > 1e-9, 1 / np.maximum(deviation, 1e-9), 0.0)
    # rows of one label only leave nothing to fit: all weights are 0, and the intercept is as large as doubles bear
    one = (ones == 0) | (ones == n)
    del sums, deviation
    share = np.clip(ones / n, 1e-300, 1 - 1e-16)
    runs = [Descent(np.r_[np.zeros(size), np.log(share[m] / (1 - share[m]))]) for m in range(models)]
    for m in np.flatnonzero(one):
        runs[m].done = True
    while live := [m for m in range(models) if not runs[m].done and runs[m].steps < steps]:
        raw = np.stack([runs[m].trial for m in live])
        raw[:, :size] *= scale[live]
        raw[:, size] -= (raw[:, :size] * mean[live]).sum(1)
        sent = sc.broadcast(raw)

        def gradients(x: Block, total: np.ndarray, sent=sent, live=tuple(live)) -> None:
            margin = x.margins(sent.value[:, :size]) + sent.value[:, size:]
            own = np.stack([x.fold != m for m in live])
            off = np.where(own, 1 / (1 + np.exp(-np.clip(margin, -700, 700))) - x.y, 0.0)
            total[:, x.slots] += x.by_slot(off)
            total[:, size] += off.sum(1)
            total[:, size + 1] += np.where(own, np.logaddexp(0, margin) - x.y * margin, 0.0).sum(1)

        sums = summed(blocks, len(live), size, 2, gradients)
        sent.destroy()
        for i, m in enumerate(live):
            w, off = runs[m].trial, sums[i, size]
            slope = (sums[i, :size] - mean[m] * off) * scale[m] / n[m] + ridge * w[:size]
            runs[m].tell(sums[i, size + 1] / n[m] + ridge / 2 * (w[:size] @ w[:size]), np.r_[slope, off / n[m]])
    out = np.stack([r.x for r in runs])
    out[:, :size] *= scale
    out[:, size] -= (out[:, :size] * mean).sum(1)
    return out


def scored(blocks: DataFrame, weights: np.ndarray, schema: str) -> DataFrame:
    """The kept columns + (p), as schema says: each row scored by the model that was fitted without its fold."""
    sent = blocks.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in blocks_of(batches):
            p = np.zeros(len(x.y))
            for m in np.unique(x.fold):
                w = sent.value[m : m + 1]
                p = np.where(x.fold == m, 1 / (1 + np.exp(-np.clip(x.margins(w)[0] + w[0, -1], -700, 700))), p)
            for kept in pa.ipc.open_stream(x.kept):
                yield pa.record_batch([*kept.columns, pa.array(p)], names=[*kept.schema.names, "p"])

    return blocks.mapInArrow(run, schema)
