"""Spans of at least `least` code points that stand verbatim in more than one document.

Plan
1. Rabin-Karp hashes (modulo 2^64, by prefix sums) of every window of `probe` code points of every text; of any
   `least` - `probe` + 1 successive windows one with the least hash is an anchor (winnowing). Of equal ones the last is
   taken, and kept while it is in reach, so that rules of dashes, padding and other periodic text have few anchors. Two
   texts that share `least` code points share an anchor's hash, and a text of c code points has about 2 c / (`least` -
   `probe`) anchors; only these are shuffled. Anchors that stand in one document only are counted out.
2. An anchor owns the windows of `least` code points of which it is the anchor. Where all documents that hold it own
   equal windows (the Rabin-Karp hashes of the first and the last agree), these are shared and done with: the inside
   of long spans costs a row an anchor. For the others, at the edges of spans, two Rabin-Karp hashes (128 bits, of
   independent bases) of every owned window are taken and counted in Spark over documents: windows in two or more are
   shared. Only texts with such anchors are moved; a Bloom filter of their ids leaves the others where they lie.
3. Overlapping shared windows of a document merge into maximal intervals, the ones a removal would cut.
4. Windows that stand in the same set of documents are one by a commutative digest of the set, so a long span counts
   once (`sharing_sets`). For pairs the members of a large set are split over salts before they meet; their number
   grows with the square of a set, so where sets are large the sets with their members say the same in less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import bloom
from tidewater.functions.arrow import Columns, over_groups
from tidewater.session import settle

BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
SET_LIMIT, HOLD = 1000, 1_000_000
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n + 1 of each; kept by the worker."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = 1 << max(16, int(n + 1).bit_length())
        with np.errstate(over="ignore"):
            up, down = (np.cumprod(np.r_[np.uint64(1), np.full(size, np.uint64(b))], dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        _powers[base] = up, down
    return _powers[base]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def prefix_sums(points: np.ndarray, base: int = BASE) -> np.ndarray:
    up, _ = _tables(len(points), base)
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], dtype=np.uint64)])


def window_hashes(sums: np.ndarray, at: np.ndarray | slice, size: int, base: int = BASE) -> np.ndarray:
    """Hashes of the windows of `size` that start at the positions `at`, mixed so that their order is arbitrary."""
    _, down = _tables(len(sums), base)
    with np.errstate(over="ignore"):
        if isinstance(at, slice):
            h = (sums[size:] - sums[:-size]) * down[: len(sums) - size]
        else:
            h = (sums[at + size] - sums[at]) * down[at]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x7FB5D329728EA185)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x81DADEF4BC2DD44D)
        h ^= h >> np.uint64(33)
    return h


def anchors(h: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, first, last): a position of the least hash of every `span` successive ones, each with the spans, by their
    first position, that have it. Every span belongs to one anchor. Of equal least hashes a span takes the one that the
    span before it has, if it holds it, otherwise the last.

    Positions of the minima of blocks by doubling: block k covers 2^k hashes, and two overlapping blocks cover a span.
    """
    n = len(h)
    if n <= span:
        at = np.array([n - 1 - int(h[::-1].argmin())] if n else [], int)
        return at, np.zeros(len(at), int), np.zeros(len(at), int)

    def less(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.where(h[j] <= h[i], j, i)  # j is the last of equals

    m, width = np.arange(n), 1
    while width * 2 <= span:
        m = less(m[:-width], m[width:])
        width *= 2
    rest = span - width
    owner = less(m[: len(m) - rest], m[rest:]) if rest else m  # of each span
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    before = owner[first[1:] - 1]
    if ((before >= first[1:]) & (h[before] == h[owner[first[1:]]])).any():  # some span could have kept its anchor
        least = h[owner]
        falls = [*(np.flatnonzero(least[1:] != least[:-1]) + 1).tolist(), len(owner)]
        own, starts, at, k, next_fall = owner, [], [], 0, 0
        while k < len(own):
            starts.append(k)
            at.append(int(own[k]))
            while falls[next_fall] <= k:
                next_fall += 1
            k = min(at[-1] + 1, falls[next_fall])
        first = np.array(starts)
        return np.array(at), first, np.r_[first[1:], len(owner)] - 1
    return owner[first], first, np.r_[first[1:], len(owner)] - 1


def _texts(docs: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null").where(F.length("text") >= least)


def _past_groups(batches: Iterator[pa.RecordBatch], whole: Callable[[list[np.ndarray]], pa.RecordBatch | None], apart: Callable[[list[np.ndarray]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hash, then document: complete groups of one hash go to `whole`, many at a time, and those of a
    group with more than `HOLD` rows of several documents to `apart`, piece by piece.

    A document has few rows of one hash and many hashes, so no hash has more than a small part of the rows.
    """
    held: list[np.ndarray] | None = None
    large = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [c.to_numpy() for c in batch.columns]
        cols = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        if large is not None:
            end = int(np.searchsorted(cols[0], large, "right"))
            if end:
                yield apart([x[:end] for x in cols])
            if end == len(cols[0]):
                held = None
                continue
            cols, large = [x[end:] for x in cols], None
        cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        if cut and (out := whole([x[:cut] for x in cols])) is not None:
            yield out
        held = [x[cut:] for x in cols]
        if len(held[0]) > HOLD and held[1][0] != held[1][-1]:
            large = held[0][0]
            yield apart(held)
            held = None
    if held is not None and (out := whole(held)) is not None:
        yield out


def _sets(h: np.ndarray, d: np.ndarray, g: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by hash (h, and g if given) and document: where groups start, their sizes, and for each group the
    number of its documents and two commutative digests of them."""
    first = np.r_[True, h[1:] != h[:-1]]
    if g is not None:
        first[1:] |= g[1:] != g[:-1]
    fresh = first | np.r_[True, d[1:] != d[:-1]]
    starts = np.flatnonzero(first)
    with np.errstate(over="ignore"):
        x = d.view(np.uint64) * np.uint64(BASE)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        y = x * np.uint64(0x94D049BB133111EB)
        y ^= y >> np.uint64(31)
        d1, d2 = (np.add.reduceat(np.where(fresh, v, np.uint64(0)), starts).view(np.int64) for v in (x, y * y))
    return starts, np.diff(np.r_[starts, len(h)]), np.add.reduceat(fresh.astype(np.int64), starts), d1, d2


def _batch(**cols: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v) for v in cols.values()], names=list(cols))


SHARED = "doc_id long, start int, n int, members long, d1 long, d2 long"


def resolved_anchors(texts: DataFrame, least: int, probe: int) -> DataFrame:
    """(doc_id, start, n, members, d1, d2, whole) of the anchors that stand in two documents or more.

    An anchor owns the windows of `least` from `start` on, n of them, whose least hash it is; a window that two
    documents share has the same anchor in both. Where all documents with an anchor own the same windows around it
    (`whole`), all these windows are shared by just these documents and nothing is left to find out.
    """
    span = least - probe + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums = prefix_sums(code_points(t))
                h = window_hashes(sums, slice(None), probe)
                at, first, last = anchors(h, span)
                with np.errstate(over="ignore"):
                    same = window_hashes(sums, first, least) * np.uint64(BASE) + window_hashes(sums, last, least)
                    same = (same ^ (same >> np.uint64(30))) * np.uint64(BASE) + ((at - first) * span + last - first).astype(np.uint64)
                parts.append([h[at].view(np.int64), np.full(len(at), d, np.int64), first.astype(np.int32), (last - first + 1).astype(np.int32), same.view(np.int64)])
            if parts:
                yield _batch(**dict(zip(("h", "doc_id", "start", "n", "same"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    def whole(cols: list[np.ndarray]) -> pa.RecordBatch | None:
        h, d, start, n, same = cols
        starts, size, members, d1, d2 = _sets(h, d)
        agree = np.minimum.reduceat(same, starts) == np.maximum.reduceat(same, starts)
        keep = np.repeat(members > 1, size)
        if not keep.any():
            return None
        each = [np.repeat(x, size)[keep] for x in (members, d1, d2, agree)]
        return _batch(doc_id=d[keep], start=start[keep], n=n[keep], members=each[0], d1=each[1], d2=each[2], whole=each[3])

    def apart(cols: list[np.ndarray]) -> pa.RecordBatch:
        zero = np.zeros(len(cols[0]), np.int64)
        return _batch(doc_id=cols[1], start=cols[2], n=cols[3], members=zero, d1=zero, d2=zero, whole=zero.astype(bool))

    every = texts.mapInArrow(run, "h long, doc_id long, start int, n int, same long")
    return every.repartition("h").sortWithinPartitions("h", "doc_id", "start").mapInArrow(lambda b: _past_groups(b, whole, apart), f"{SHARED}, whole boolean")


def window_rows(texts: DataFrame, ranges: DataFrame, least: int) -> DataFrame:
    """(h, g, doc_id, start, n) of the windows of `least` in a document's ranges, h and g of independent bases; n
    successive equal ones are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, t, r in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                points = code_points(t)
                starts = np.unique(np.concatenate([np.arange(x["start"], x["start"] + x["n"]) for x in r]))
                starts = starts[starts <= len(points) - least]
                if not len(starts):
                    continue
                h, g = (window_hashes(prefix_sums(points, b), starts, least, b).view(np.int64) for b in (BASE, OTHER_BASE))
                new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (starts[1:] != starts[:-1] + 1)])
                n = np.diff(np.r_[new, len(h)]).astype(np.int32)
                h, g, starts = h[new], g[new], starts[new].astype(np.int32)
                for k in range(0, len(h), 200_000):
                    part = slice(k, k + 200_000)
                    yield _batch(h=h[part], doc_id=np.full(len(h[part]), d, np.int64), g=g[part], start=starts[part], n=n[part])

    few = bloom.keep(texts.withColumn("__h", F.xxhash64("doc_id")), "__h", bloom.build(ranges.select(F.xxhash64("doc_id").alias("h")), "h", bloom.bits_for(ranges.count()))).drop("__h")
    # never broadcast: texts are far larger than their files
    return few.hint("merge").join(ranges, "doc_id").mapInArrow(run, "h long, doc_id long, g long, start int, n int")


def in_several(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n, members, d1, d2): the windows (h, doc_id, g, start, n) that stand in two documents or more.

    members is their number, d1 and d2 digest which ones; of a window with more than `HOLD` rows, which are passed on
    without being held, its own hashes take the place of the digest.
    """

    def whole(cols: list[np.ndarray]) -> pa.RecordBatch | None:
        h, d, g, start, n = cols
        _, size, members, d1, d2 = _sets(h, d, g)
        keep = np.repeat(members > 1, size)
        return _batch(doc_id=d[keep], start=start[keep], n=n[keep], members=np.repeat(members, size)[keep], d1=np.repeat(d1, size)[keep], d2=np.repeat(d2, size)[keep]) if keep.any() else None

    def apart(cols: list[np.ndarray]) -> pa.RecordBatch:
        h, d, g, start, n = cols
        return _batch(doc_id=d, start=start, n=n, members=np.full(len(h), HOLD, np.int64), d1=h, d2=g)

    return rows.repartition("h").sortWithinPartitions("h", "g", "doc_id", "start").mapInArrow(lambda b: _past_groups(b, whole, apart), SHARED)


def shared_windows(docs: DataFrame, *, doc_id: str, text: str, least: int = 300, probe: int = 200) -> DataFrame:
    """(doc_id, start, n, members, d1, d2): the windows that stand in two documents or more, with the set of them."""
    texts = _texts(docs, doc_id, text, least)
    found = settle(resolved_anchors(texts, least, probe))
    # a document's ranges, at most one an anchor: two or three for every `least` - `probe` code points of its text
    open_ranges = settle(found.where("not whole").groupBy("doc_id").agg(F.collect_set(F.struct("start", "n")).alias("ranges")))
    return found.where("whole").drop("whole").unionByName(in_several(window_rows(texts, open_ranges, least)))


def shared_intervals(docs: DataFrame, *, doc_id: str, text: str, least: int = 300, probe: int = 200) -> DataFrame:
    """(doc_id, first, last, n_spans, shared): maximal intervals [first, last) that stand elsewhere too, and for each
    document their number and how many code points they cover. Documents that share nothing have no rows.

    Null texts, texts under `least` and null ids share nothing; rows with one id are one document, so what repeats
    within an id isn't shared.
    """
    at = shared_windows(docs, doc_id=doc_id, text=text, least=least, probe=probe).select("doc_id", "start", "n")

    def merge(c: Columns) -> dict:
        s, e = c["start"].astype(np.int64), c["start"].astype(np.int64) + c["n"] - 1 + least
        far = np.maximum.accumulate(e)
        cut = np.r_[True, s[1:] > far[:-1]]
        first, last = s[cut], far[np.r_[np.flatnonzero(cut)[1:] - 1, len(s) - 1]]
        k = len(first)
        return {"doc_id": np.repeat(c["doc_id"][:1], k), "first": first, "last": last, "n_spans": np.full(k, k), "shared": np.full(k, int((last - first).sum()))}

    return over_groups(at, ["doc_id"], ["start"], merge, "doc_id long, first long, last long, n_spans long, shared long")


def sharing_sets(docs: DataFrame, *, doc_id: str, text: str, least: int = 300, probe: int = 200) -> DataFrame:
    """(members, d1, d2, doc_id): the sets of documents that hold a same window, each once with all its documents.

    (members, d1, d2) names a set; all windows of one set are one set of rows, so a long span counts once. Two documents
    share a span exactly if they are in a same set. Grows with the documents' spans, not with the pairs among them.
    """
    return shared_windows(docs, doc_id=doc_id, text=text, least=least, probe=probe).select("members", "d1", "d2", "doc_id").distinct()


def sharing_pairs(docs: DataFrame, *, doc_id: str, text: str, least: int = 300, probe: int = 200) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: pairs that share a span of `least` code points or more, each once."""
    key = ["members", "d1", "d2"]
    member = settle(sharing_sets(docs, doc_id=doc_id, text=text, least=least, probe=probe))
    salts = F.ceil(F.col("members") / SET_LIMIT).cast("int")
    left = member.select(*key, F.col("doc_id").alias("doc_a"), F.pmod(F.xxhash64("doc_id"), salts).cast("int").alias("salt"))
    right = member.select(*key, F.col("doc_id").alias("doc_b"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return left.join(right, [*key, "salt"]).where("doc_a < doc_b").select("doc_a", "doc_b").distinct()
