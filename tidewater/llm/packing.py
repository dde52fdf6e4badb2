"""Packing documents into containers of a fixed number of tokens, window by window in a target mixture of sources.

Every source has a queue. A window is a set of containers; a source's part of it is its target share of the window's
tokens plus its deficit, what it is owed from the windows before (deficit round-robin: a turn takes items while the
deficit covers them). The window's items are then placed best fit, largest first. Containers that are full enough are
closed; items of the others go back and are placed first in the next window, so little room is left anywhere.

Every container is closed in a window, whose number is in the result, so the mixture can be audited (`mixture`). When a
source has no more items its share falls to the others in proportion; as documents are dealt by hash, all sources of a
shard run out near its end when the targets are the corpus's own shares, and as their tokens last when targets are given.

Plan: token counts are taken in Arrow batches by a public tokenizer, and only (id, source, count) goes on. Target
shares, unless given, are the corpus's own, from one aggregation over all documents. Documents are dealt to shards by
the hash of their id, so every shard sees every source and a source with a third of all tokens is spread over all
shards; a shard holds about `SHARD` documents whatever the corpus's size. What a shard can't close, its open items
and the deficits of its sources, is carried to a second level, where `FAN` shards' remainders are packed together in
the same way.
"""

from __future__ import annotations

import base64
import heapq
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.arrow import Columns, over_groups
from tidewater.session import settle

SHARD, FAN, WINDOW = 40_000, 64, 64
FULL = 0.995


def default_vocabulary() -> str:
    """Where the public byte-level vocabulary lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


_encoders: dict = {}


def encoder(path: str):
    """The tokenizer of a ranks file, one per worker process."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(docs: DataFrame, *, doc_id: str, text: str, source: str, vocabulary: str) -> DataFrame:
    """(doc_id, source, tokens) of every document with an id; null text has 0 tokens, a null source is a source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            counts = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "source", "tokens"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")).where("doc_id is not null")
    return narrow.mapInArrow(run, "doc_id long, source string, tokens long")


class Packer:
    """Open containers of one shard, and the windows that fill them."""

    def __init__(self, capacity: int, full: float = FULL):
        self.capacity, self.full = capacity, full
        self.window = 0
        self.closed: list[tuple[int, list]] = []  # (window, items)

    def place(self, items: list, last: bool) -> list:
        """Best fit, largest first; returns the items of the containers that aren't full enough, or [] at the end."""
        room: list[tuple[int, int]] = []  # (room left, container), sorted
        inside: list[list] = []
        for item in sorted(items, key=lambda x: (-x[-1], x[1:])):
            size = item[-1]
            k = bisect_left(room, (size, -1))
            if k == len(room):
                inside.append([item])
                left, at = self.capacity - size, len(inside) - 1
            else:
                left, at = room.pop(k)
                inside[at].append(item)
                left -= size
            if left:
                insort(room, (left, at))
        back = []
        open_room = dict((at, left) for left, at in room)
        for at, content in enumerate(inside):
            if last or open_room.get(at, 0) <= (1 - self.full) * self.capacity:
                self.closed.append((self.window, content))
            else:
                back += content
        return back


def pack_shard(items: list[tuple], shares: dict, deficits: dict, capacity: int, last: bool, window: int = WINDOW) -> tuple[list, list, dict]:
    """Packs (source, doc, part, size) items; returns closed containers with their windows, items and deficits carried on.

    All deficits grow at once: a source has been owed its share of `credit`, less what it has spent. Its next item's
    turn comes at the credit at which the deficit covers it, so one heap of turns serves any number of sources, and a
    window takes the items whose turn has come, then those whose turn is next until it is full.
    """
    queues: dict = {}
    for item in items:
        queues.setdefault(item[0], deque()).append(item)
    names = sorted(queues, key=lambda s: (s is None, s))
    weight = {s: max(shares.get(s, 0.0), 1e-12) for s in names}
    spent = {s: -deficits.get(s, 0.0) for s in names}
    turns = [((spent[s] + queues[s][0][-1]) / weight[s], k, s) for k, s in enumerate(names)]
    heapq.heapify(turns)
    waiting, credit = sum(weight.values()), 0.0
    packer, carried, whole, ended = Packer(capacity), [], window * capacity, {}
    while turns:
        need, taken = max(capacity, whole - sum(x[-1] for x in carried)), 0
        credit += need / max(waiting, 1e-12)  # the shares of sources that have run out fall to the others
        while turns and (turns[0][0] <= credit or taken < need):
            _, k, s = heapq.heappop(turns)
            item = queues[s].popleft()
            spent[s] += item[-1]
            taken += item[-1]
            carried.append(item)
            if queues[s]:
                heapq.heappush(turns, ((spent[s] + queues[s][0][-1]) / weight[s], k, s))
            else:
                waiting -= weight[s]
                ended[s] = credit
        carried = packer.place(carried, last=False)
        packer.window += 1
    if last:
        carried = packer.place(carried, last=True)
    return packer.closed, carried, {s: weight[s] * ended.get(s, credit) - spent[s] for s in names}


def pack(docs: DataFrame, *, doc_id: str, text: str, source: str, capacity: int = 2048, vocabulary: str | None = None, shares: dict[str, float] | None = None) -> DataFrame:
    """(container, slot, window, doc_id, source, first_token, tokens): where every token of every document lies.

    Only a document longer than the capacity is split, into full containers and one rest that is packed as an item;
    the full ones wait in their source's queue as all items do, so that they count in the windows' mixture. Any other
    document lies whole in one container. Documents without tokens (null or empty text) take no room and aren't in the
    result. Repeated ids are packed as often as they come. `shares`, by source, needn't sum to 1; a
    source without one gets the least turn. An empty table gives no rows.
    """
    spark = docs.sparkSession
    sizes = settle(token_counts(docs, doc_id=doc_id, text=text, source=source, vocabulary=vocabulary or default_vocabulary()).where("tokens > 0"))
    if shares is None:
        total = sizes.agg(F.sum("tokens").alias("all"))
        target = sizes.groupBy("source").agg(F.sum("tokens").alias("own")).crossJoin(F.broadcast(total)).select("source", (F.col("own") / F.col("all")).alias("share"))
    else:
        target = spark.createDataFrame([(k, float(v)) for k, v in shares.items()], "source string, share double")
    # few tokens of a source make a small row, a source with a third of them is split by adaptive skew handling
    shared = sizes.join(target.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")), "left").select("doc_id", "source", "tokens", F.coalesce("share", F.lit(0.0)).alias("share"))
    many = max(1, -(-sizes.count() // SHARD))
    dealt = shared.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(many)).cast("long"))

    row = "shard long, kind string, container long, slot int, window int, doc_id long, source string, first_token long, tokens long, share double, deficit double"

    def out(shard: int, closed: list, carried: list, owed: dict, shares: dict) -> dict:
        cols: dict[str, list] = {k.split()[0]: [] for k in row.split(", ")}

        def add(*v) -> None:
            for k, x in zip(cols, v, strict=True):
                cols[k].append(x)

        for n, (window, content) in enumerate(closed):
            for slot, (s, d, f, size) in enumerate(content):
                add(shard, "placed", n, slot, window, d, s, f, size, None, None)
        for s, d, f, size in carried:
            add(shard, "carried", None, None, None, d, s, f, size, shares.get(s, 0.0), None)
        for s, x in owed.items():
            add(shard, "owed", None, None, None, None, s, None, None, shares.get(s, 0.0), x)
        return cols

    def first(c: Columns) -> dict:
        items, shares = [], {}
        for d, s, n, share in zip(c["doc_id"].tolist(), c["source"].tolist(), c["tokens"].tolist(), c["share"].tolist(), strict=True):
            shares[s] = share
            cut = n // capacity * capacity if n > capacity else 0
            items += [(s, d, f, capacity) for f in range(0, cut, capacity)]
            if n > cut:
                items.append((s, d, cut, n - cut))
        packed, carried, owed = pack_shard(items, shares, {}, capacity, last=False)
        return out(int(c["shard"][0]), packed, carried, owed, shares)

    def second(c: Columns) -> dict:
        items, shares, owed = [], {}, {}
        for kind, d, s, f, n, share, x in zip(c["kind"].tolist(), c["doc_id"].tolist(), c["source"].tolist(), c["first_token"].tolist(), c["tokens"].tolist(), c["share"].tolist(), c["deficit"].tolist(), strict=True):
            shares[s] = share
            if kind == "owed":
                owed[s] = owed.get(s, 0.0) + x
            else:
                items.append((s, int(d), int(f), int(n)))
        closed, _, owed = pack_shard(items, shares, owed, capacity, last=True)
        return out(int(c["group"][0]), closed, [], {}, shares)

    level = settle(over_groups(dealt.withColumn("turn", F.xxhash64("doc_id", F.lit(1))), ["shard"], ["turn", "doc_id"], first, row))
    rest = level.where("kind <> 'placed'").withColumn("group", F.floor(F.col("shard") / FAN)).drop("shard")
    tail = over_groups(rest, ["group"], ["kind", "source", "doc_id", "first_token"], second, row)
    name = lambda lvl, what: F.concat_ws("-", F.lit(lvl), "shard", what)
    named = lambda df, lvl: df.where("kind = 'placed'").select(name(lvl, "container").alias("container"), "slot", name(lvl, "window").alias("window"), "doc_id", "source", "first_token", "tokens")
    return named(level, "a").unionByName(named(tail, "b"))


def mixture(packed: DataFrame) -> DataFrame:
    """(window, source, tokens, part): what each source has in each window, and which part of the window that is."""
    own = packed.groupBy("window", "source").agg(F.sum("tokens").alias("tokens"))
    total = own.groupBy("window").agg(F.sum("tokens").alias("all"))
    return own.join(total, "window").select("window", "source", "tokens", (F.col("tokens") / F.col("all")).alias("part"))
