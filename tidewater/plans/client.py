"""What an interactive client needs around its queries: checked parameters, cached results, cancelling, chunks."""

from __future__ import annotations

import math
import re
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import relational as rel


def number(x: object) -> float:
    """A finite number, or ValueError. Numbers and their text are taken, truth values aren't."""
    try:
        v = float("nan") if isinstance(x, bool) else float(x)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        v = float("nan")
    if not math.isfinite(v):
        raise ValueError(f"no number: {x!r}")
    return v


def iso_date(x: object) -> str:
    """'YYYY-MM-DD' of a day that exists, or ValueError."""
    text = str(x)
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise ValueError(f"no date: {x!r}")
    return date.fromisoformat(text).isoformat()


def iso_timestamp(x: object) -> str:
    """'YYYY-MM-DDThh:mm:ss', with a fraction and a zone if wanted, as 'YYYY-MM-DD hh:mm:ss[.ffffff]' in UTC, or ValueError."""
    text = str(x)
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?", text):
        raise ValueError(f"no timestamp: {x!r}")
    t = datetime.fromisoformat(text)
    return (t if t.tzinfo is None else t.astimezone(UTC).replace(tzinfo=None)).isoformat(" ")


def bounds(x: dict | None) -> dict[str, float] | None:
    """West, east, south and north as numbers; None stays None."""
    return None if x is None else {k: number(x[k]) for k in ("west", "east", "south", "north")}


def run_sql(spark: SparkSession, text: str, **parameters) -> DataFrame:
    """SQL with named parameters (:name). They are bound as values, so a name that begins another, a quote or a colon in
    a text can't change the statement."""
    return spark.sql(text, args=parameters)


def blocks(text: str, tables: set[str] | None = None) -> list[str]:
    """Statements of a file whose blocks begin with a line '-- 1. name'; with `tables`, those whose line names one of
    them. What stands before the first block always comes first."""
    head, *rest = re.split(r"\n(?=-- \d+\. )", "\n" + text)
    wanted = [b for b in rest if tables is None or any(re.search(rf"\b{re.escape(t)}\b", b.split("\n", 1)[0].lower()) for t in tables)]
    return [b.strip() for b in (head, *wanted) if b.strip()]


class ResultCache:
    """Results by key for some minutes; the oldest goes when there are too many."""

    def __init__(self, seconds: float = 300, entries: int = 100, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.entries, self.clock = seconds, entries, clock
        self.held: OrderedDict = OrderedDict()

    def get(self, key, make: Callable):
        at = self.held.get(key)
        if at is not None and self.clock() - at[0] < self.seconds:
            return at[1]
        value = make()
        self.held.pop(key, None)
        self.held[key] = (self.clock(), value)
        while len(self.held) > self.entries:
            self.held.popitem(last=False)
        return value


class Latest:
    """Runs one query at a time: a new one cancels the jobs of the one before, whose result no longer counts."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag = spark, None

    @contextmanager
    def run(self) -> Iterator[Callable[[], bool]]:
        context, tag = self.spark.sparkContext, f"client-{uuid.uuid4().hex}"
        if self.tag is not None:
            context.cancelJobsWithTag(self.tag)
        self.tag = tag
        context.addJobTag(tag)
        try:
            yield lambda: self.tag == tag
        finally:
            context.removeJobTag(tag)


def chunks(df: DataFrame, rows: int = 1000) -> Iterator[list]:
    """A result in pieces, a partition at a time on the driver."""
    piece = []
    for r in df.toLocalIterator(prefetchPartitions=True):
        piece.append(r)
        if len(piece) == rows:
            yield piece
            piece = []
    if piece:
        yield piece


def accumulate(held: DataFrame, fresh: DataFrame, key: str = "mmsi", newest: str = "ts_us") -> DataFrame:
    """What a view has plus what has come, the newest row of each key."""
    return rel.upsert(held, fresh, [key], F.col(newest))
