"""Exactly one copy of messages that were delivered at least once.

An identifier is a producer and a number that the producer counts up (here the event time in ticks). Per producer the
numbers seen so far are disjoint ranges: a number that no range covers is accepted once and joins its neighbours, a
number that one covers is a copy. Identifiers off the tick grid are malformed: they can't be counted and are looked up
by their exact value among the keys seen.

Plan
1. In each Arrow batch of the scan, copies of a number are reduced to the best one. This is the map-side combine: a
   message with millions of copies leaves a batch once. The others are known to be surplus; they only travel on to be
   reported and are spread by row id.
2. The rest is shuffled by (producer, block of numbers) and sorted by block, number, received, id, what was seen before
   ahead of the block's rows. Ranges of different blocks are disjoint, so a producer with a third of all rows is spread
   over its blocks.
3. A stream over the sorted partition keeps the seen ranges and keys of one block (`Seen`), and those of all blocks
   that lie in one Arrow batch side by side on one line, so that coverage is tested, and ranges are merged, for a
   batch at once. Memory follows the ranges of a block, of which there are at most half as many as ticks in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOUR = 3_600_000_000
SCHEMA = "kind string, producer string, first long, last long, row_id long"


def _best_first(p: np.ndarray, n: np.ndarray, r: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (producer, number, received, id), and which rows in that order repeat the number before them."""
    order = np.lexsort((i, r, n, p))
    a, b = p[order], n[order]
    again = np.zeros(len(order), bool)
    again[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return order, again


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        p, n, r, i = (batch.column(k) for k in range(4))
        codes = p.dictionary_encode().indices.to_numpy()
        order, again = _best_first(codes, n.to_numpy(), r.to_numpy(), i.to_numpy())
        surplus = np.zeros(batch.num_rows, bool)
        surplus[order] = again
        yield batch.append_column("surplus", pa.array(surplus))


class Seen:
    """Disjoint ranges [a, b] of numbers, in order, that no two of touch, and exact keys."""

    def __init__(self) -> None:
        self.a = self.b = self.keys = np.zeros(0, np.int64)

    def covers(self, x: np.ndarray) -> np.ndarray:
        if not len(self.a):
            return np.zeros(len(x), bool)
        at = np.searchsorted(self.a, x, "right") - 1
        return (at >= 0) & (x <= self.b[np.maximum(at, 0)])

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Merges the ranges [a, b], in any order, with those seen; ranges that overlap or touch become one."""
        if not len(a):
            return
        a, b = np.concatenate([self.a, a]), np.concatenate([self.b, b])
        order = np.argsort(a, kind="stable")
        a, far = a[order], np.maximum.accumulate(b[order])
        cut = np.flatnonzero(np.r_[True, a[1:] > far[:-1] + 1])
        self.a, self.b = a[cut], far[np.r_[cut[1:] - 1, len(a) - 1]]

    def knows(self, k: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(k), bool)
        at = np.searchsorted(self.keys, k)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == k)

    def learn(self, k: np.ndarray) -> None:
        self.keys = np.union1d(self.keys, k)

    def take(self, x: np.ndarray) -> np.ndarray:
        """Which of the numbers x, copies side by side and the best first, are accepted; they are covered from then on."""
        first = np.r_[True, x[1:] != x[:-1]] if len(x) else np.zeros(0, bool)
        accepted = first & ~self.covers(x)
        self.add(x[accepted], x[accepted])
        return accepted

    def take_keys(self, k: np.ndarray) -> np.ndarray:
        """As `take`, for malformed identifiers by exact lookup."""
        first = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
        accepted = first & ~self.knows(k)
        if accepted.any():
            self.learn(k[accepted])
        return accepted

    def split(self, x: int, k: int) -> tuple[Seen, Seen]:
        """What lies before x (keys: k), and what from there on, counted from there."""
        low, high = Seen(), Seen()
        n, m = int(np.searchsorted(self.a, x)), int(np.searchsorted(self.keys, k))
        low.a, low.b, low.keys = self.a[:n], self.b[:n], self.keys[:m]
        high.a, high.b, high.keys = self.a[n:] - x, self.b[n:] - x, self.keys[m:] - k
        return low, high


KINDS = ("accepted", "surplus", "range", "key")


def accept(rows: DataFrame, *, producer: list[str], event_time: str, received: str, row_id: str, tick_us: int = 1000, block_us: int = HOUR, seen: DataFrame | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Sorts `rows` into accepted ones and copies, and gives the ranges that they cover.

    Result (kind, producer, first, last, row_id) of the `kinds` asked for, one row of kind
    'accepted' or 'surplus' for each input row with a whole identifier (row_id; first = last = its time in us),
    'range' for each range of ticks covered (first, last in ticks), 'key' for each malformed identifier (first in us).
    Of copies the earliest received is accepted (null received last), then the lowest row_id. Rows with a null in a
    producer column or the time have no identifier, are never copies and aren't in the result; nor are rows with a
    null row_id. `seen`, the 'range' and 'key' rows of earlier calls with the same tick and block, makes their numbers
    covered from the start; they are merged with the new ones and come out again, so that the result's ranges are the
    whole state. Ranges end at blocks of `block_us`; the block is a multiple of the tick.
    """
    if block_us % tick_us:
        raise ValueError("block_us must be a multiple of tick_us")
    latest = 2**63 - 1
    keyed = rows.select(
        F.to_json(F.struct(*[F.col(c).alias(f"k{k}") for k, c in enumerate(producer)])).alias("producer"),
        F.unix_micros(F.col(event_time).cast("timestamp")).alias("t"),
        F.coalesce(F.unix_micros(F.col(received).cast("timestamp")), F.lit(latest)).alias("r"),
        F.col(row_id).cast("long").alias("row_id"),
        *[F.col(c).alias(f"__p{k}") for k, c in enumerate(producer)],
    ).where(" and ".join(["t is not null", "row_id is not null", *[f"__p{k} is not null" for k in range(len(producer))]]))
    combined = keyed.select("producer", "t", "r", "row_id").mapInArrow(_combine, "producer string, t long, r long, row_id long, surplus boolean")
    if not {"surplus"} & set(kinds):
        combined = combined.where("not surplus")
    combined = combined.withColumns({"until": F.lit(None).cast("long"), "turn": F.lit(1)})
    if seen is not None:
        past = seen.where("kind in ('range', 'key')").select(
            "producer",
            F.when(F.col("kind") == "range", F.col("first") * tick_us).otherwise(F.col("first")).alias("t"),
            F.lit(None).cast("long").alias("r"),
            F.lit(None).cast("long").alias("row_id"),
            F.lit(False).alias("surplus"),
            F.when(F.col("kind") == "range", F.col("last") * tick_us).otherwise(F.col("first")).alias("until"),
            F.lit(0).alias("turn"),
        )
        combined = combined.unionByName(past)
    blocked = combined.withColumn("block", F.floor(F.col("t") / block_us))
    spread = blocked.withColumn("route", F.when(F.col("surplus"), F.xxhash64("row_id")).otherwise(F.xxhash64("producer", "block")))
    ordered = spread.repartition("route").sortWithinPartitions("surplus", "producer", "block", "turn", "t", "r", "row_id").drop("route")
    ticks = block_us // tick_us
    line, keyline = ticks + 2, block_us + 2  # a block's part of the line; ranges of neighbours don't touch

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: str, producers, first, last, ids) -> Iterator[pa.RecordBatch]:
            if kind in kinds and len(first):
                who = producers if isinstance(producers, pa.Array) else pa.array(producers, pa.string())
                yield pa.record_batch([pa.array([kind] * len(first), pa.string()), who, pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(ids, pa.int64(), from_pandas=True) if ids is not None else pa.nulls(len(first), pa.int64())], names=["kind", "producer", "first", "last", "row_id"])

        def report(state: Seen, producers: list, blocks: np.ndarray) -> Iterator[pa.RecordBatch]:
            """The state of the blocks that lie side by side on the line."""
            code = state.a // line
            base = blocks[code] * ticks - code * line
            yield from out("range", [producers[c] for c in code.tolist()], state.a + base, state.b + base, None)
            code = state.keys // keyline
            at = state.keys + blocks[code] * block_us - code * keyline
            yield from out("key", [producers[c] for c in code.tolist()], at, at, None)

        state, open_block = Seen(), None  # of the block that the last batch ended in
        for batch in batches:
            done = batch.column("surplus").to_numpy(zero_copy_only=False)
            if done.any():
                gone = batch.filter(pa.array(done))
                t = gone.column("t").to_numpy()
                yield from out("surplus", gone.column("producer"), t, t, gone.column("row_id").to_numpy())
                batch = batch.filter(pa.array(~done))
            if not batch.num_rows:
                continue
            p, t, block = batch.column("producer"), batch.column("t").to_numpy(), batch.column("block").to_numpy()
            who = p.dictionary_encode().indices.to_numpy()
            new = np.r_[True, (who[1:] != who[:-1]) | (block[1:] != block[:-1])]
            starts = np.flatnonzero(new)
            code = np.cumsum(new) - 1
            producers, blocks = p.take(pa.array(starts)).to_pylist(), block[starts]
            if open_block is not None and open_block != (producers[0], int(blocks[0])):
                yield from report(state, [open_block[0]], np.array([open_block[1]]))
                state = Seen()
            into = t - block * block_us  # within the block, in us
            x, k = into // tick_us + code * line, into + code * keyline
            grid, old = into % tick_us == 0, batch.column("turn").to_numpy() == 0
            if old.any():
                until = (batch.column("until").fill_null(0).to_numpy() - block * block_us) // tick_us + code * line
                state.add(x[old & grid], until[old & grid])
                state.learn(k[old & ~grid])
            taken = np.zeros(len(t), bool)
            on, off = np.flatnonzero(grid & ~old), np.flatnonzero(~grid & ~old)
            taken[on] = state.take(x[on])
            taken[off] = state.take_keys(k[off])
            copies = np.zeros(len(t), bool)
            copies[on], copies[off] = state.covers(x[on]), state.knows(k[off])
            copies &= ~taken
            for kind, which in (("surplus", copies), ("accepted", taken)):
                if kind in kinds and which.any():
                    part = batch.filter(pa.array(which))
                    at = part.column("t").to_numpy()
                    yield from out(kind, part.column("producer"), at, at, part.column("row_id").to_numpy())
            last = len(starts) - 1
            whole, state = state.split(last * line, last * keyline)
            yield from report(whole, producers, blocks)
            open_block = (producers[-1], int(blocks[-1]))
        if open_block is not None:
            yield from report(state, [open_block[0]], np.array([open_block[1]]))

    return ordered.mapInArrow(stream, SCHEMA)
