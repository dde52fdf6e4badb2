from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidewater.functions import bloom


def test_nothing_is_lost_and_little_else_passes(spark):
    known = spark.range(0, 3000).select(F.xxhash64("id").alias("h"))
    words = bloom.build(known, "h", bloom.bits_for(3000))
    others = spark.range(3000, 43000).select("id", F.xxhash64("id").alias("h"))
    every = others.unionByName(spark.range(0, 3000).select("id", F.xxhash64("id").alias("h")))
    passed = bloom.keep(every, "h", words)
    assert passed.where("id < 3000").count() == 3000 and passed.columns == ["id", "h"]
    extra = passed.where("id >= 3000").count()
    assert extra < 40000 * 0.01
    h = np.array([r.h for r in others.collect()], np.int64).view(np.uint64)
    assert int(bloom.holds(words, h).sum()) == extra
    assert "BatchEvalPython" not in passed._jdf.queryExecution().executedPlan().toString()


def test_sizes_are_bounded(spark):
    assert bloom.bits_for(0) == bloom.LEAST_BITS and bloom.bits_for(10**12) == bloom.MOST_BITS
    assert 24 * 10**5 <= 1 << bloom.bits_for(10**5) <= 48 * 10**5
    empty = bloom.build(spark.range(0).select(F.xxhash64("id").alias("h")), "h", 16)
    assert not empty.any() and bloom.keep(spark.range(9).select(F.xxhash64("id").alias("h")), "h", empty).count() == 0
