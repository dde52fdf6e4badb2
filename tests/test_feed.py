from __future__ import annotations

import time

from tidewater.sources import feed


class Clock:
    def __init__(self):
        self.now, self.pauses = 0.0, []

    def __call__(self):
        self.now += 0.001
        return self.now

    def pause(self, s):
        self.pauses.append(s)
        self.now += s


def test_reconnects_with_doubling_pauses_and_drops_what_is_no_message():
    clock, calls = Clock(), []

    def connect(ask):
        calls.append(ask)
        if len(calls) in (2, 3, 4):
            raise OSError("gone")
        yield '{"a": 1}'
        yield "no json"
        yield "[1]"

    link = feed.Connection(connect, feed.subscription("NW", "k"), clock.pause, clock)
    assert link.take(3, 1000) == ['{"a": 1}'] * 3
    assert calls[0] == {"APIKey": "k", "BoundingBoxes": [[[0.0, -180.0], [90.0, 0.0]]]}
    assert clock.pauses == [1, 2, 4, 8, 1] and link.dropped == 4 and link.reconnects == 5


def test_a_batch_ends_by_time():
    clock = Clock()

    def connect(ask):
        while True:
            clock.now += 1
            yield "{}"

    assert len(feed.Connection(connect, {}, clock.pause, clock).take(1000, 10)) in (9, 10)


def endless(ask):
    for k in range(10**9):
        time.sleep(0.005)
        yield f'{{"k": {k}}}'


def test_as_a_stream(spark, tmp_path):
    spark.dataSource.register(feed.LiveFeed)
    s = spark.readStream.format("live_feed").option("connect", "tests.test_feed:endless").option("shard", "NW").option("batch", "7").load()
    q = s.writeStream.format("memory").queryName("feed_out").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    while spark.table("feed_out").count() < 7:
        assert q.exception() is None
    q.stop()
    assert spark.table("feed_out").distinct().count() >= 7


def test_a_full_queue_drops_and_counts():
    waiting = feed.Waiting(3)
    assert [waiting.offer(str(k)) for k in range(5)] == [True] * 3 + [False] * 2 and waiting.dropped == 2
    assert waiting.take(2, 5) == ["0", "1"] and waiting.take(9, 0.05) == ["2"]


def test_a_planned_batch_comes_again_until_it_is_committed(tmp_path):
    options = {"connect": "tests.test_feed:endless", "batch": "7", "seconds": "5", "spool": f"file://{tmp_path}/spool"}
    reader = feed.LiveFeedReader(options)
    first, end = reader.read(reader.initialOffset())
    second, last = reader.read(end)
    first, second = list(first), list(second)
    assert (end, last) == ({"n": 7}, {"n": 14})
    reader.close()
    again = feed.LiveFeedReader(options)  # after a restart
    assert list(again.readBetweenOffsets({"n": 7}, {"n": 14})) == second
    assert list(again.readBetweenOffsets({"n": 0}, {"n": 14})) == first + second
    again.commit({"n": 7})
    assert list(again.readBetweenOffsets({"n": 0}, {"n": 14})) == second
    assert list(feed.LiveFeedReader({k: v for k, v in options.items() if k != "spool"}).readBetweenOffsets({"n": 0}, {"n": 7})) == []
