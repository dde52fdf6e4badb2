from __future__ import annotations

import json
import os
import random

import pyarrow.parquet as pq
import pytest

from tests import brute
from tidewater.operators import compaction as c

SCHEMA = "file_id long, n_bytes long, body string, group_id string, keep int, line_no string"


def files(spark, rows):
    return spark.createDataFrame([(i, None if b is None else len(b), b, "x", 1, "y") for i, b in rows], SCHEMA)


def compacted(spark, tmp_path, rows, **more):
    out = f"file://{tmp_path}/out"
    c.compact(files(spark, rows), out, **more)
    kept = sorted((r.file_id, r.line_no, r.message) for r in c.published_messages(spark, out).collect())
    return kept, {(r.file_id, r.line_no) for r in c.set_aside(spark, out).collect()}, out


def test_round_trip_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    values = [{"a": i % 7, "b": {"x": [1, None, "\u00e9"], "y": i % 3}, "c": i / 2} for i in range(12)]
    rows = []
    for fid in range(60):
        lines = []
        for _ in range(rng.randrange(8)):
            v = rng.choice(values)
            line = rng.choice([json.dumps(v), json.dumps(v, sort_keys=True, indent=None, separators=(",", ":")), json.dumps(dict(reversed(v.items())), ensure_ascii=False), json.dumps(v)[: rng.randrange(1, 9)], "", "  ", "7", "null"])
            lines.append(line)
        rows.append((fid, None if rng.random() < 0.05 else rng.choice(["\n", "\r\n"]).join(lines)))
    kept, surplus, out = compacted(spark, tmp_path, rows, target_bytes=300)
    assert surplus == brute.surplus_lines(rows)
    lines = {(f, k): line for f, b in rows if b is not None for k, line in enumerate(b.split("\n"), 1)}
    parsed = {p for p, line in lines.items() if c.canonical(line) is not None}
    assert {(f, n) for f, n, _ in kept} == parsed - surplus
    assert all(lines[f, n].rstrip("\r") == m for f, n, m in kept)
    assert len({c.canonical(m) for *_, m in kept}) == len(kept)
    m = c.current_manifest(spark, out)
    assert m.count() > 1 and m.agg({"kept": "sum"}).first()[0] == len(kept)


def test_what_equals_as_json():
    same = ['{"a":1,"b":2}', '{ "b" : 2, "a" : 1 }', '{"\\u0061":1,"b":2.0}\r']
    assert len({c.canonical(x) for x in same}) == 1
    assert c.canonical('{"a":true}') != c.canonical('{"a":1}') and c.canonical("[1,2]") != c.canonical("[2,1]")
    assert [c.canonical(x) for x in ("", "{", "NaN", "[1e999]", "a")] == [None] * 5


def test_schedule_is_balanced_and_whole(spark):
    rng = random.Random(5)
    rows = [(i, "x" * rng.randrange(1, 200)) for i in range(500)] + [(1000, "y" * 5000), (1001, None)]
    assert c.shards_of(55_000.0, len(rows), 4000) == (3, 5)
    got = c.schedule(files(spark, rows), 1, 14, file_id="file_id", size="n_bytes").collect()
    assert sorted(r.file_id for r in got) == sorted(i for i, _ in rows)
    size = {i: len(b or "") for i, b in rows}
    load: dict = {}
    for r in got:
        load[r.group_id] = load.get(r.group_id, 0) + size[r.file_id]
    rest = sorted(load.values())[:-1]
    assert max(load.values()) == 5000 and max(rest) - min(rest) <= 200


def test_empty_and_one_long_line(spark, tmp_path):
    kept, surplus, _ = compacted(spark, tmp_path / "a", [])
    assert kept == [] and surplus == set()
    long = json.dumps({"t": "z" * 3_000_000})
    kept, surplus, _ = compacted(spark, tmp_path / "b", [(2, long), (1, "\n\n" + long)])
    assert [(f, n) for f, n, _ in kept] == [(1, 3)] and surplus == {(2, 1)}


def test_publishing_again_leaves_old_manifests_readable(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    first = c.compact(files(spark, [(1, "1\n2\n1")]), out)
    c.compact(files(spark, [(1, "3")]), out)
    assert [r.message for r in c.published_messages(spark, out).collect()] == ["3"]
    assert spark.read.parquet(first).first().surplus == 1


def test_repeated_file_ids_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="more than once|account"):
        compacted(spark, tmp_path, [(1, "1"), (1, "2\n3")])


def test_files_of_a_folder(spark, tmp_path):
    from tidewater.sources import landing

    for k in range(30):
        at = tmp_path / "in" / f"hour={k % 3}"
        at.mkdir(parents=True, exist_ok=True)
        (at / f"{k}.ndjson").write_text("\n".join(json.dumps({"k": j % 20, "é": k % 2}) for j in range(k)))
    (tmp_path / "in" / "note.txt").write_text("1")
    out = f"file://{tmp_path}/out"
    c.compact(landing.small_files(spark, f"{tmp_path}/in"), out, target_bytes=2000)
    got = sorted(json.loads(r.message)["k"] * 2 + json.loads(r.message)["é"] for r in c.published_messages(spark, out).collect())
    assert got == list(range(40))


FILES = [(1, '{"a":1}\n{"a":2}\n{"a":1}'), (2, '{"a":3}\n\n{"a"'), (3, '{"a":4}')]


def test_a_message_that_is_set_aside_instead_of_kept_is_seen(spark, tmp_path, monkeypatch):
    class Faulty(c.OutputGroup):
        def add(self, fid, lines, nos, stay):
            super().add(fid, lines, nos, stay - {2})

    monkeypatch.setattr(c, "OutputGroup", Faulty)
    with pytest.raises(RuntimeError, match="distinct"):
        compacted(spark, tmp_path, FILES)
    assert not (tmp_path / "out" / "CURRENT").exists()


def test_a_message_that_is_written_twice_for_another_is_seen(spark, tmp_path, monkeypatch):
    """All counts agree."""

    class Faulty(c.OutputGroup):
        def flush(self):
            texts = self.waiting[0][2]
            texts[-1:] = texts[:1]
            super().flush()

    monkeypatch.setattr(c, "OutputGroup", Faulty)
    with pytest.raises(RuntimeError, match="distinct"):
        compacted(spark, tmp_path, FILES)


def test_lost_places_of_messages_are_seen(spark, tmp_path, monkeypatch):
    """Half of what to keep is lost on the way to the writer."""
    whole = c.F.collect_list
    monkeypatch.setattr(c.F, "collect_list", lambda x: c.F.slice(whole(x), 2, 1000))
    with pytest.raises(RuntimeError, match="distinct"):
        compacted(spark, tmp_path, FILES)


def test_a_lost_line_is_seen(spark, tmp_path, monkeypatch):
    class Faulty(c.OutputGroup):
        def add(self, fid, lines, nos, stay):
            super().add(fid, lines[:-1], nos, stay)

    monkeypatch.setattr(c, "OutputGroup", Faulty)
    with pytest.raises(RuntimeError, match="account"):
        compacted(spark, tmp_path, FILES)


def test_output_does_not_depend_on_how_joins_are_planned(spark, tmp_path):
    """One shard is one partition, also where the session has more of them and broadcasts nothing."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept, _, out = compacted(spark, tmp_path, [(k, f'{{"n": {k}}}') for k in range(300)])
        assert len(kept) == 300 and c.current_manifest(spark, out).count() == 1
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_row_groups_are_few_and_output_is_small(spark, tmp_path, monkeypatch):
    lines = [json.dumps({"message_type": "PositionReport", "n": k, "text": "harbour of " + str(k % 9)}) for k in range(5000)]
    rows = [(k, "\n".join(lines[10 * k : 10 * k + 10])) for k in range(500)]
    kept, _, out = compacted(spark, tmp_path / "a", rows)
    m = c.current_manifest(spark, out).collect()
    assert len(kept) == 5000 and len(m) == 1
    f = pq.ParquetFile(m[0].kept_path)
    assert f.num_row_groups == 1
    assert sum(len(b) for _, b in rows) > 5 * os.path.getsize(m[0].kept_path)

    class Small(c.OutputGroup):
        most_rows = 1000

    monkeypatch.setattr(c, "OutputGroup", Small)
    *_, out = compacted(spark, tmp_path / "b", rows, target_bytes=1000)
    m = c.current_manifest(spark, out).collect()
    assert len(m) > 4 and sum(r.kept for r in m) == 5000
    assert all(pq.ParquetFile(r.kept_path).num_row_groups <= -(-r.kept // 1000) for r in m)
