"""Evaluation items that lie, whole or in part, in a training corpus.

Plan
1. Items become words, and their `n`-grams 64-bit hashes. These go into a Bloom filter sized from their number and
   bounded (32 MB), which is broadcast.
2. One pass over the corpus in Arrow batches hashes each document's n-grams and keeps the places of those that the
   filter may know; only these (numbers, no text) are shuffled.
3. The n-grams' frequencies are counted over these places by distinct surroundings, so that copies of one passage count
   once and an item that stands in much of the corpus stays rare. Every n-gram that occurs in at most `rare` of the
   number of documents (or ten) surroundings is a seed, so edited copies are met however many whole ones there are. For
   each window of `least` words of an item whose n-grams are all more frequent than that, the rarest becomes a seed
   too: a document that holds the window holds the seed. Other n-grams are everyday wording, which would join
   everything with everything.
4. Seeds join places to items by hash, exactly and salted. Only the documents that come out are read again, whole (a
   second Bloom filter, JVM-side, leaves the others where they lie). Smith-Waterman alignment over words scores each
   pair, batched over anti-diagonals; a long stretch is cut into pieces of six item lengths that overlap by three, so
   that any alignment lies whole in one of them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import bloom
from tidewater.session import settle

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Characters that show nothing: soft hyphen, joiners, direction marks, fillers, variation selectors, tags.
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f-\u1160\u17b4-\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff]")
WORD = re.compile(r"[^\W_]+")
#: A seed's rows go to this many places, as one seed may have a large part of all of them.
SALTS = 16
MATCH, MISMATCH, GAP = 2, -1, -1


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in order, without case; invisible characters don't part a word."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFC", INVISIBLE.sub("", text))
    return WORD.findall(text.casefold())


_known: dict[str, int] = {}


def word_hashes(ws: list[str]) -> np.ndarray:
    if len(_known) > 1_000_000:
        _known.clear()
    out = np.empty(len(ws), np.uint64)
    for k, w in enumerate(ws):
        h = _known.get(w)
        if h is None:
            h = _known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        out[k] = h
    return out


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = out * BASE + h[k : len(h) - n + 1 + k]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def item_ngrams(items: DataFrame, *, item_id: str, text: str, n: int) -> DataFrame:
    """(item_id, pos, h) of every n-gram of every item, and n_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pos, hs, many = [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = words(t)
                h = ngram_hashes(word_hashes(ws), n).astype(np.int64).tolist()
                ids += [i] * len(h)
                pos += range(len(h))
                hs += h
                many += [len(ws)] * len(h)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(pos, pa.int32()), pa.array(hs, pa.int64()), pa.array(many, pa.int32())], names=["item_id", "pos", "h", "n_words"])

    return items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("item_id is not null and text is not null").mapInArrow(run, "item_id long, pos int, h long, n_words int")


def places(docs: DataFrame, words_of_filter, *, n: int) -> DataFrame:
    """(doc_id, dkey, pos, h, around): where in each document (doc_id, dkey, text) an n-gram stands that the filter may
    know; `around` digests it with the three words before it and after it. Whole texts are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = words_of_filter.value
        for batch in batches:
            parts: list[list[np.ndarray]] = []
            for d, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ws = words(t)
                if len(ws) < n:
                    continue
                h = ngram_hashes(word_hashes(ws), n)
                at = np.flatnonzero(bloom.holds(table, h))
                if not len(at):
                    continue
                with np.errstate(over="ignore"):
                    around = (h[np.maximum(at - 3, 0)] * BASE + h[at]) * BASE + h[np.minimum(at + 3, len(h) - 1)]
                parts.append([np.full(len(at), d, np.int64), np.full(len(at), k, np.int64), at.astype(np.int32), h[at].view(np.int64), around.view(np.int64)])
            if parts:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=["doc_id", "dkey", "pos", "h", "around"])

    return docs.select("doc_id", "dkey", "text").mapInArrow(run, "doc_id long, dkey long, pos int, h long, around long")


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local score and longest verbatim run of each pair of rows of a (k, la) and b (k, lb), padded with -1 and -2,
    and for each position of b the longest verbatim run that ends there.

    Cells of an anti-diagonal don't depend on each other, so one is computed at once for all pairs.
    """
    k, la, lb = len(a), a.shape[1], b.shape[1]
    best, ends = np.zeros(k, np.int32), np.zeros((k, lb), np.int32)
    if not la or not lb:
        return best, best.copy(), ends
    zero = np.zeros((k, lb + 1), np.int32)  # by position of b, one ahead
    before, last, runs_before, runs_last = zero, zero, zero, zero  # two diagonals ago and the last one
    flipped = a[:, ::-1]
    for d in range(la + lb - 1):
        lo, hi = max(0, d - la + 1), min(lb, d + 1)
        same = b[:, lo:hi] == flipped[:, la - 1 - d + lo : la - 1 - d + hi]
        score = np.maximum(np.maximum(before[:, lo:hi] + np.where(same, MATCH, MISMATCH), 0), np.maximum(last[:, lo:hi], last[:, lo + 1 : hi + 1]) + GAP)
        length = np.where(same, runs_before[:, lo:hi] + 1, 0)
        best = np.maximum(best, score.max(1))
        np.maximum(ends[:, lo:hi], length, out=ends[:, lo:hi])
        now, runs_now = np.zeros_like(zero), np.zeros_like(zero)
        now[:, lo + 1 : hi + 1], runs_now[:, lo + 1 : hi + 1] = score, length
        before, last, runs_before, runs_last = last, now, runs_last, runs_now
    return best, ends.max(1), ends


def covered(ends: np.ndarray, n: int) -> np.ndarray:
    """Positions that lie in a run of n or more, from the runs' lengths by the position they end at."""
    step = np.zeros(len(ends) + 1, np.int64)
    at = np.flatnonzero(ends >= n)
    np.add.at(step, at + 1 - ends[at], 1)
    np.add.at(step, at + 1, -1)
    return step[:-1].cumsum() > 0


class Aligner:
    """Pieces of passages wait until there are some of like length; `rows` are what is known of each pair."""

    def __init__(self, n: int, cells: int = 4_000_000):
        self.n, self.cells = n, cells
        self.rows: list[list] = []  # score, longest run, covered words, words
        self.pieces: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, passage: list[str], item: list[str]) -> None:
        codes = {w: k for k, w in enumerate(dict.fromkeys(item))}
        p, q = np.array([codes.get(w, -3) for w in passage], np.int32), np.array([codes[w] for w in item], np.int32)
        self.rows.append([0, 0, np.zeros(len(q), bool)])
        # an alignment of positive score has gaps of less than two item lengths, so it is shorter than three
        step = max(64, 3 * len(q))
        for lo in range(0, max(1, len(p) - step), step):
            piece = p[lo : lo + 2 * step]
            self.pieces.append((len(self.rows) - 1, piece, q))
            self.waiting += len(piece) * len(q)
        if self.waiting > self.cells:
            self.align()

    def align(self) -> None:
        self.pieces.sort(key=lambda x: (len(x[2]), len(x[1])))
        for k in range(0, len(self.pieces), 128):
            part = self.pieces[k : k + 128]
            a = np.full((len(part), max(len(x[1]) for x in part)), -1, np.int32)
            b = np.full((len(part), max(len(x[2]) for x in part)), -2, np.int32)
            for r, (_, p, q) in enumerate(part):
                a[r, : len(p)], b[r, : len(q)] = p, q
            score, run, ends = smith_waterman(a, b)
            for r, (row, _, q) in enumerate(part):
                known = self.rows[row]
                known[0], known[1] = max(known[0], int(score[r])), max(known[1], int(run[r]))
                known[2] |= covered(ends[r, : len(q)], self.n)
        self.pieces, self.waiting = [], 0


def leaks(docs: DataFrame, items: DataFrame, *, doc_id: str, text: str, item_id: str, item_text: str, least: int = 12, n: int = 5, rare: float = 0.001) -> DataFrame:
    """(doc_id, item_id, score, similarity, longest_run, coverage) of every pair that shares a seed.

    `longest_run` is the most successive words in common; a pair with a run of `least` words or more is always
    among the rows. `score` is the Smith-Waterman score (match 2, mismatch and gap -1), `similarity` its part of the
    score of the whole item, `coverage` the part of the item's words that lie in common runs of `n` words or more,
    wherever in the document these stand. Null or empty texts and items under `least` words give no rows; items and
    documents with a null id are left out; of repeated ids the best values count. Empty tables give no rows.
    """
    spark = docs.sparkSession
    # an item's key is its id and text: repeated rows fall together, different texts under one id stay apart
    texts = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("item_text")).where("item_id is not null and item_text is not null").distinct().withColumn("key", F.xxhash64("item_id", "item_text"))
    grams = settle(item_ngrams(texts, item_id="key", text="item_text", n=n).withColumnRenamed("item_id", "key").where(F.col("n_words") >= least))
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null").withColumn("dkey", F.xxhash64("doc_id", "text"))
    known = spark.sparkContext.broadcast(bloom.build(grams, "h", bloom.bits_for(grams.count())))
    hits = settle(places(whole, known, n=n))
    frequency = hits.select("h", "around").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("f"))
    # each window of `least` words has `least` - n + 1 n-grams
    span = least - n
    often = max(10.0, rare * docs.count())
    ranked = grams.join(frequency, "h", "left").select("key", "pos", F.struct(F.coalesce("f", F.lit(0)).alias("f"), "h").alias("r"))
    per = ranked.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "r"))).alias("g"))  # one item's n-grams, bounded by its text
    window = F.transform(F.sequence(F.lit(0), F.size("g") - 1 - span), lambda k: F.transform(F.slice("g", k + 1, span + 1), lambda e: e["r"]))
    # a window whose n-grams all occur, each too often, still gets its rarest; an edited copy's intact n-grams are not
    # the rarest where another document has the item whole, so all rare ones are seeds
    common = F.transform(window, lambda w: F.when(F.array_min(w)["f"] > often, F.array_min(w)))
    kept = F.filter(F.transform("g", lambda e: e["r"]), lambda r: (r["f"] > 0) & (r["f"] <= often))
    seeds = per.select("key", F.explode(F.array_union(kept, common)).alias("r")).where("r is not null").select("key", F.col("r.h").alias("h")).distinct()
    salted = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = hits.select("doc_id", "dkey", "pos", "h", F.pmod(F.xxhash64("dkey"), F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["h", "salt"])
    pairs = settle(met.groupBy("doc_id", "dkey", "key").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")))
    held = bloom.keep(whole, "dkey", bloom.build(pairs, "dkey", bloom.bits_for(pairs.count())))
    joined = held.hint("merge").join(pairs.join(texts, "key"), ["doc_id", "dkey"])  # never broadcast: texts are far larger than their files

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ws = None, []
        for batch in batches:
            aligner = Aligner(n)
            for k, t, item, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("dkey", "text", "item_text", "lo", "hi")), strict=True):
                if k != last:
                    last, ws = k, words(t)
                q = words(item)
                aligner.add(ws[max(0, lo - 3 * len(q)) : hi + n + 3 * len(q)], q)
            aligner.align()
            rows = aligner.rows
            size = np.array([max(1, len(r[2])) for r in rows], float)
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("item_id"), pa.array([r[0] for r in rows], pa.int32()), pa.array(np.array([r[0] for r in rows], float) / (MATCH * size)), pa.array([r[1] for r in rows], pa.int32()), pa.array(np.array([r[2].sum() for r in rows], float) / size)],
                names=["doc_id", "item_id", "score", "similarity", "longest_run", "coverage"],
            )

    aligned = joined.select("doc_id", "dkey", "item_id", "text", "item_text", "lo", "hi").mapInArrow(align, "doc_id long, item_id long, score int, similarity double, longest_run int, coverage double")
    return aligned.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("score", "similarity", "longest_run", "coverage")])


def edited_copies(pairs: DataFrame, least: int = 12, alike: float = 0.6) -> DataFrame:
    """Of `leaks` the pairs without `least` successive words in common that are as good as a leak all the same: an
    alignment that scores as much as `least` words in a row, or as `alike` of the whole item."""
    return pairs.where((F.col("longest_run") < least) & ((F.col("score") >= MATCH * least) | (F.col("similarity") >= alike)))
