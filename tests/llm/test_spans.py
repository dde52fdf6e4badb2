from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm import brute
from tidewater.llm import spans

SCHEMA = "doc_id long, text string, h string, start int, n int, members string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], SCHEMA)


def covered(rows):
    out: dict = {}
    for r in rows:
        out.setdefault(r.doc_id, set()).update(range(r.first, r.last))
    return out


def texts(rng):
    alphabet = "abcdefgh é中\U0001f600\n"
    make = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [make(k) for k in (49, 50, 51, 60, 120, 400)]
    out = []
    for i in range(60):
        parts = [make(rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 4)):
            s = rng.choice(shared)
            cut = rng.randrange(0, 20)
            parts += [s[cut:] if rng.random() < 0.3 else s, make(rng.randrange(0, 60))]
        out.append((i, "".join(parts)))
    return out + [(100, None), (101, ""), (102, "a" * 300), (103, "b" + "a" * 150), (104, "ab" * 100), (105, "ab" * 40), (106, out[0][1]), (107, out[0][1]), (None, out[0][1])]


@pytest.mark.parametrize("hold", [10, 1_000_000])
def test_against_brute_force(spark, monkeypatch, hold):
    monkeypatch.setattr(spans, "HOLD", hold)
    rows = texts(random.Random(20))
    pairs, cover = brute.sharing([r for r in rows if r[0] is not None], 50)
    got = [(r.doc_a, r.doc_b) for r in spans.sharing_pairs(docs(spark, rows), doc_id="doc_id", text="text", least=50, probe=30).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    iv = spans.shared_intervals(docs(spark, rows), doc_id="doc_id", text="text", least=50, probe=30).collect()
    assert covered(iv) == cover
    for r in iv:
        assert r.shared == len(cover[r.doc_id]) and r.n_spans == sum(x.doc_id == r.doc_id for x in iv)


def test_a_span_that_most_documents_hold(spark, monkeypatch):
    monkeypatch.setattr(spans, "SET_LIMIT", 7)
    rng = random.Random(21)
    common = "".join(rng.choice("xyz ") for _ in range(80))
    rows = [(i, f"{i} " * 10 + common + f" {i * 7}") for i in range(60)]
    got = {(r.doc_a, r.doc_b) for r in spans.sharing_pairs(docs(spark, rows), doc_id="doc_id", text="text", least=50, probe=30).collect()}
    assert got == {(a, b) for a in range(60) for b in range(a + 1, 60)}


def test_empty_and_repeated_rows(spark):
    assert spans.sharing_pairs(docs(spark, []), doc_id="doc_id", text="text").count() == 0
    assert spans.shared_intervals(docs(spark, []), doc_id="doc_id", text="text").count() == 0
    long = "".join(random.Random(22).choice("abc d") for _ in range(2000))
    assert spans.sharing_pairs(docs(spark, [(1, long), (1, long)]), doc_id="doc_id", text="text").count() == 0


def test_anchors_cover_every_span():
    rng = np.random.default_rng(23)
    for n, span in ((1, 5), (5, 5), (40, 5), (300, 101), (500, 64), (64, 64), (65, 64)):
        for top in (1, 2, 3, 1 << 40):
            h = rng.integers(0, top, n).astype(np.uint64)
            owner = {}
            for at, first, last in zip(*(x.tolist() for x in spans.anchors(h, span)), strict=True):
                for k in range(first, last + 1):
                    assert k not in owner
                    owner[k] = at
            assert list(owner) == list(range(max(1, n - span + 1)))
            before = None
            for k, at in owner.items():
                part = h[k : k + span]
                assert k <= at < k + span and h[at] == part.min()
                held = before is not None and before >= k and h[before] == part.min()
                assert at == (before if held else k + len(part) - 1 - int(part[::-1].argmin()))
                before = at


@pytest.mark.parametrize("text", ["-" * 100_000, "ab" * 50_000, ("x" * 70 + "\n") * 1400, "| 1 | 2 |\n" * 10_000])
def test_periodic_text_has_few_anchors(text):
    h = spans.window_hashes(spans.prefix_sums(spans.code_points(text)), slice(None), 200)
    at, first, last = spans.anchors(h, 101)
    assert len(at) < 2_500 and last[-1] == len(h) - 101


def test_periodic_texts_against_brute_force(spark):
    rng = random.Random(24)
    noise = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    rules = ["-" * 200, "ab" * 90, "| 1 |\n" * 30, "=" * 49, "=" * 50]
    rows = [(i, noise(rng.randrange(60)) + rng.choice(rules)[: rng.randrange(40, 200)] + noise(rng.randrange(60)) + rng.choice(rules)) for i in range(40)]
    pairs, cover = brute.sharing(rows, 50)
    got = {(r.doc_a, r.doc_b) for r in spans.sharing_pairs(docs(spark, rows), doc_id="doc_id", text="text", least=50, probe=30).collect()}
    assert got == pairs
    assert covered(spans.shared_intervals(docs(spark, rows), doc_id="doc_id", text="text", least=50, probe=30).collect()) == cover
    sets: dict = {}
    for r in spans.sharing_sets(docs(spark, rows), doc_id="doc_id", text="text", least=50, probe=30).collect():
        sets.setdefault((r.members, r.d1, r.d2), set()).add(r.doc_id)
    assert {(a, b) for s in sets.values() for a in s for b in s if a < b} == pairs and all(len(s) == k[0] for k, s in sets.items())


def test_window_hashes_are_equal_where_windows_are():
    t = spans.code_points("abcabcabc\U0001f600abc")
    h = spans.window_hashes(spans.prefix_sums(t), slice(None), 3)
    assert h[0] == h[3] == h[6] == h[10] and len(set(h.tolist())) == 6
    assert (spans.window_hashes(spans.prefix_sums(t), np.array([3, 7]), 3) == h[[3, 7]]).all()
