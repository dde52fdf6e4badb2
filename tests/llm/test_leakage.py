from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm import brute
from tidewater.llm import leakage

VOCAB = "the of port vessel harbour tide été straße 42 x7 anchor lamp copper river stone window quiet".split()


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in docs], "id long, text string, h string, pos int, words string")
    e = spark.createDataFrame([(i, t, 5) for i, t in items], "id long, text string, key int")
    return leakage.leaks(d, e, doc_id="id", text="text", item_id="id", item_text="text", **more)


def found(rows):
    return sorted((r.doc_id, r.item_id) for r in rows.where("longest_run >= 12").collect())


def passage(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def disguise(rng, text):
    """Case, punctuation, white space and invisible characters don't count."""
    out = []
    for w in text.split():
        w = rng.choice([w, w.upper(), w.capitalize()])
        if len(w) > 3 and rng.random() < 0.2:
            w = w[:2] + rng.choice(["­", "​", "﻿"]) + w[2:]
        out.append(w + rng.choice(["", ",", ".", " -", " "]))
    return rng.choice([" ", "\n", "  "]).join(out)


def test_against_brute_force(spark):
    rng = random.Random(30)
    items = [(i, passage(rng, rng.choice([5, 11, 12, 13, 40, 60]))) for i in range(40)]
    items += [(100, None), (101, ""), (102, items[3][1]), (None, items[4][1])]
    docs = []
    for i in range(150):
        parts = [passage(rng, rng.randrange(0, 80))]
        for _ in range(rng.randrange(0, 3)):
            ws = (rng.choice(items)[1] or "").split()
            a = rng.randrange(0, max(1, len(ws) - 11))
            parts += [disguise(rng, " ".join(ws[a : a + rng.choice([10, 11, 12, 13, 30])])), passage(rng, rng.randrange(0, 30))]
        docs.append((i, " . ".join(parts)))
    docs += [(900, None), (901, ""), (902, "!!"), (None, items[5][1])]
    want = brute.leaks([d for d in docs if d[0] is not None], [x for x in items if x[0] is not None])
    assert found(run(spark, docs, items)) == sorted(want) and len(want) > 50


def test_repeated_rows_and_one_item_in_most_documents(spark):
    rng = random.Random(31)
    item = passage(rng, 30)
    docs = [(i, f"{passage(rng, 20)} {item} {passage(rng, 20)}") for i in range(80)] + [(0, "nothing here")]
    assert found(run(spark, docs * 2, [(1, item)] * 3)) == [(i, 1) for i in range(80)]


def test_edited_copies_score_without_being_found(spark):
    rng = random.Random(32)
    ws = [f"w{k}" for k in range(40)]
    edited = [w if k % 9 else "other" for k, w in enumerate(ws)]
    rows = run(spark, [(1, passage(rng, 30) + " " + " ".join(edited))], [(1, " ".join(ws))]).collect()
    assert len(rows) == 1 and rows[0].longest_run == 8 and rows[0].similarity > 0.6 and rows[0].coverage == 32 / 40


def test_edited_copies_beside_a_whole_one(spark):
    """The whole copy makes the n-grams that the edits broke the rarest."""
    ws = [f"w{k}" for k in range(40)]
    edited = [w if k % 9 else "other" for k, w in enumerate(ws)]
    rows = run(spark, [(1, " ".join(ws)), (2, " ".join(edited)), (3, " ".join(ws[:5] + ["x"] * 9))], [(1, " ".join(ws))]).collect()
    assert {r.doc_id: r.longest_run for r in rows} == {1: 40, 2: 8, 3: 5}


def test_every_pair_that_shares_a_rare_ngram_is_aligned(spark):
    rng = random.Random(35)
    items = [(i, " ".join(f"i{i}x{k}" for k in range(30))) for i in range(8)]
    docs, want = [], set()
    for d in range(60):
        i, parts = rng.randrange(8), [passage(rng, 10)]
        ws = items[i][1].split()
        a, m = rng.randrange(0, 18), rng.choice([4, 5, 6, 12])
        parts += ws[a : a + m]
        want |= {(d, i)} if m >= 5 else set()
        docs.append((d, " ".join([*parts, passage(rng, 10)])))
    got = run(spark, docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c d e f g h i j k l m")]).count() == 0
    assert run(spark, [(1, "a b c d e f g h i j k l m")], []).count() == 0


def test_very_long_document_with_many_items(spark):
    rng = random.Random(33)
    items = [(i, passage(rng, 40)) for i in range(30)]
    long = " ".join(f"{t} {passage(rng, rng.choice([0, 3, 200]))}" for _, t in items for _ in range(3))
    want = brute.leaks([(1, long)], items)
    assert found(run(spark, [(1, long)], items)) == sorted(want)


def plain(a, b):
    """Smith-Waterman by its recurrence."""
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    r = np.zeros_like(h)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            same = a[i - 1] == b[j - 1]
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if same else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            r[i, j] = r[i - 1, j - 1] + 1 if same else 0
    return h.max(), r.max()


def test_alignment_against_the_recurrence():
    rng = np.random.default_rng(34)
    a = [rng.integers(0, 4, rng.integers(1, 25)) for _ in range(40)]
    b = [rng.integers(0, 4, rng.integers(1, 18)) for _ in range(40)]
    pa, pb = np.full((40, 25), -1), np.full((40, 18), -2)
    for k in range(40):
        pa[k, : len(a[k])], pb[k, : len(b[k])] = a[k], b[k]
    score, run_, _ = leakage.smith_waterman(pa, pb)
    assert [(s, r) for s, r in zip(score.tolist(), run_.tolist(), strict=True)] == [plain(x, y) for x, y in zip(a, b, strict=True)]


def test_long_items_are_aligned_whole(spark):
    rng = random.Random(36)
    ws = [f"w{k}" for k in range(2000)]
    filler = lambda k: [f"f{rng.randrange(10**9)}" for _ in range(k)]
    whole = filler(3000) + ws + filler(2000)
    halves = filler(50) + ws[:900] + filler(9000) + ws[1100:] + filler(50)
    rows = run(spark, [(1, " ".join(whole)), (2, " ".join(halves)), (3, " ".join(filler(500)))], [(1, " ".join(ws))]).collect()
    got = {r.doc_id: (r.longest_run, round(r.coverage, 3), r.score) for r in rows}
    assert got == {1: (2000, 1.0, 4000), 2: (900, 0.9, 1800)}


def test_pieces_find_what_one_alignment_finds():
    rng = np.random.default_rng(37)
    for _ in range(20):
        q = [str(x) for x in rng.integers(0, 6, 25)]
        p = [str(x) for x in rng.integers(0, 6, 900)]
        a = leakage.Aligner(4)
        a.add(p, q)
        assert len(a.pieces) > 5
        a.align()
        codes = lambda x: np.array([[int(v) for v in x]])
        score, longest, ends = leakage.smith_waterman(codes(p), codes(q))
        assert (a.rows[0][0], a.rows[0][1]) == (score[0], longest[0])
        assert (a.rows[0][2] == leakage.covered(ends[0], 4)).all()


def edit(rng, ws, rate):
    out = []
    for w in ws:
        x = rng.random()
        out += [] if x < rate / 3 else [f"e{rng.randrange(10**6)}"] if x < 2 * rate / 3 else [w, f"e{rng.randrange(10**6)}"] if x < rate else [w]
    return out


@pytest.mark.parametrize("rate", [0.05, 0.1, 0.2])
def test_recall_of_planted_edited_copies(spark, rate):
    """Words dropped, changed and put in; some items stand whole in many documents besides."""
    rng = random.Random(38)
    common = [f"c{k}" for k in range(150)]
    text = lambda k: [rng.choice(common) for _ in range(k)]
    items = [(i, " ".join(text(rng.randrange(20, 80)))) for i in range(60)]
    docs, planted = [], []
    for i, t in items:
        for k in range(3):
            d = 1000 * i + k
            docs.append((d, " ".join(text(60) + edit(rng, t.split(), rate) + text(60))))
            planted.append((d, i))
    docs += [(10**6 + i * 100 + k, f"{' '.join(text(20))} {t} {' '.join(text(20))}") for i, t in items[:10] for k in range(60)]
    docs += [(10**7 + k, " ".join(text(300))) for k in range(300)]
    rows = run(spark, docs, items).persist()
    whole = {(r.doc_id, r.item_id) for r in rows.where("longest_run >= 12").collect()}
    close = {(r.doc_id, r.item_id) for r in leakage.edited_copies(rows).collect()}
    assert len((whole | close) & set(planted)) >= 0.9 * len(planted)
    assert len(close - set(planted)) <= 0.05 * len(planted)
    assert all((10**6 + i * 100 + k, i) in whole for i in range(10) for k in range(60))
