"""A live message feed as a streaming source: one connection, a box subscription, bounded batches, reconnection.

    spark.dataSource.register(feed.LiveFeed)
    spark.readStream.format("live_feed").option("connect", "package.module:function").option("shard", "NW").load()

`connect(subscription)` gives an iterator of JSON texts; what it talks to is its own affair (a WebSocket client, a
test). A batch ends after `batch` messages or `seconds`, whichever is first. When the connection ends or fails it is
opened again after a pause that doubles from 1 to 60 seconds. A thread keeps reading between batches into a queue of
`queue` messages; what comes while it is full is dropped and counted, so a slow query never holds the connection up.

A live feed can't be asked again for what it has sent. With `spool`, a folder that outlives the driver, a batch is
written there before it is handed on and removed once it is committed, so a batch that was planned when a query died
comes again; without it such a batch is lost. What the queue holds when the driver dies is lost either way.
"""

from __future__ import annotations

import importlib
import json
import queue
import threading
import time
from collections.abc import Callable, Iterator

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tidewater.functions.geo import SHARDS

FIRST_PAUSE, LONGEST_PAUSE = 1.0, 60.0


def subscription(shard: str, key: str = "") -> dict:
    """What the feed is asked for: a shard's box as corners (south, west) and (north, east)."""
    s, w, n, e = SHARDS[shard]
    return {"APIKey": key, "BoundingBoxes": [[[s, w], [n, e]]]}


class Connection:
    """Messages of a feed that is reconnected with growing pauses; `dropped` counts texts that are no JSON objects."""

    def __init__(self, connect: Callable[[dict], Iterator[str]], ask: dict, pause: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.connect, self.ask, self.pause, self.clock = connect, ask, pause, clock
        self.stream: Iterator[str] | None = None
        self.wait, self.dropped, self.reconnects = FIRST_PAUSE, 0, 0

    def take(self, batch: int, seconds: float) -> list[str]:
        until, got = self.clock() + seconds, []
        while len(got) < batch and self.clock() < until:
            try:
                if self.stream is None:
                    self.stream = iter(self.connect(self.ask))
                text = next(self.stream)
            except (StopIteration, OSError, RuntimeError):
                self.stream = None
                self.reconnects += 1
                self.pause(min(self.wait, max(0.0, until - self.clock())))
                self.wait = min(2 * self.wait, LONGEST_PAUSE)
                continue
            self.wait = FIRST_PAUSE
            try:
                whole = isinstance(json.loads(text), dict)
            except ValueError:
                whole = False
            if whole:
                got.append(text)
            else:
                self.dropped += 1
        return got


class Waiting:
    """A bounded queue between a connection and the batches that are taken from it."""

    def __init__(self, most: int = 100_000):
        self.queue: queue.Queue[str] = queue.Queue(maxsize=most)
        self.dropped = 0

    def offer(self, text: str) -> bool:
        """False, and one more dropped, where the queue is full."""
        try:
            self.queue.put_nowait(text)
            return True
        except queue.Full:
            self.dropped += 1
            return False

    def take(self, batch: int, seconds: float, clock: Callable[[], float] = time.monotonic) -> list[str]:
        """Up to `batch` messages; fewer when the time is over."""
        until, got = clock() + seconds, []
        while len(got) < batch and (left := until - clock()) > 0:
            try:
                got.append(self.queue.get(timeout=min(left, 1.0)))
            except queue.Empty:
                continue
        return got

    def fill(self, link: Connection, stop: threading.Event) -> threading.Thread:
        """Starts reading the connection until `stop` is set."""

        def run() -> None:
            while not stop.is_set():
                for text in link.take(1000, 1.0):
                    self.offer(text)

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        return thread


class Spool:
    """Batches that aren't committed yet, a file each, named by its offsets."""

    def __init__(self, folder: str):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)

    def _files(self) -> list[tuple[int, int, str]]:
        found = self.fs.get_file_info(pafs.FileSelector(self.root))
        return sorted((*map(int, f.base_name.split(".")[0].split("-")), f.path) for f in found if f.base_name.endswith(".json"))

    def put(self, start: int, end: int, texts: list[str]) -> None:
        path = f"{self.root}/{start:020d}-{end:020d}.json"
        with self.fs.open_output_stream(path + ".part") as f:
            f.write(json.dumps(texts).encode())
        self.fs.move(path + ".part", path)

    def between(self, start: int, end: int) -> list[str]:
        got: list[str] = []
        for a, b, path in self._files():
            if start <= a and b <= end:
                with self.fs.open_input_stream(path) as f:
                    got += json.loads(f.read())
        return got

    def forget(self, end: int) -> None:
        for _, b, path in self._files():
            if b <= end:
                self.fs.delete_file(path)


class LiveFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "live_feed"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return LiveFeedReader(self.options)


class LiveFeedReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = {k: options[k] for k in ("connect", "batch", "seconds", "shard", "key", "queue", "spool") if k in options}
        self.batch, self.seconds = int(options.get("batch", 50_000)), float(options.get("seconds", 60))
        self.waiting: Waiting | None = None  # with the connection, once the first batch is asked for
        self.spool = Spool(options["spool"]) if "spool" in options else None

    def __reduce__(self):
        """Copies of the reader, as Spark makes them for its tasks, have no connection."""
        return LiveFeedReader, (self.options,)

    def _start(self) -> Waiting:
        module, _, function = self.options["connect"].partition(":")
        link = Connection(getattr(importlib.import_module(module), function), subscription(self.options.get("shard", "WORLD"), self.options.get("key", "")))
        waiting = Waiting(int(self.options.get("queue", 100_000)))
        self.stop = threading.Event()
        waiting.fill(link, self.stop)
        return waiting

    def close(self) -> None:
        """Ends the thread that reads the connection; the next batch opens it again."""
        if self.waiting is not None:
            self.stop.set()
            self.waiting = None

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple[str]], dict]:
        if self.waiting is None:
            self.waiting = self._start()
        got = self.waiting.take(self.batch, self.seconds)
        end = start["n"] + len(got)
        if self.spool and got:
            self.spool.put(start["n"], end, got)
        return iter([(t,) for t in got]), {"n": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[str]]:
        """A planned batch again, after a restart."""
        return iter([(t,) for t in self.spool.between(start["n"], end["n"])] if self.spool else [])

    def commit(self, end: dict) -> None:
        if self.spool:
            self.spool.forget(end["n"])
