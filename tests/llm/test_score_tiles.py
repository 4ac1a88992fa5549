"""What an executor holds of the score tiles of hard negatives does not grow with anchors times rows."""

from __future__ import annotations

import os
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.llm import hard_negatives

from .test_new_operators import mined_by_brute_force, vectors_fixture

KIND = "vec_id long, embedding array<double>, label int"


@pytest.fixture
def tiles(monkeypatch):
    """Of each table of tiles: scores, bytes of its largest row, bytes of its largest row group, and its folder."""
    seen, staged = [], hard_negatives.staged

    def noted(df, name, *more):
        out = staged(df, name, *more)
        if name == "score-tiles":
            scores = sum(len(r.a_place) * len(r.b_place) // 64 for r in out.select("a_place", "b_place").collect())
            folder = out.staged_at.removeprefix("file:")
            groups = [m.row_group(k).total_byte_size for f in os.listdir(folder) if f.endswith(".parquet") for m in [pq.read_metadata(f"{folder}/{f}")] for k in range(m.num_row_groups)]
            seen.append((scores, out.agg(F.max(F.octet_length("tile"))).first()[0] or 0, max(groups, default=0), folder))
        return out

    monkeypatch.setattr(hard_negatives, "staged", noted)
    return seen


def test_passes_are_bounded_and_go(spark, tiles, monkeypatch):
    rows = vectors_fixture()
    monkeypatch.setattr(hard_negatives, "PASS_BYTES", 50_000, raising=False)  # of 14 chunks at 4 bytes: one block of two anchors
    got = hard_negatives.mined(spark.createDataFrame(rows, KIND).coalesce(1), F.col("vec_id") % 100 == 0, sizes=(2, 16, 3))
    order = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert Counter(tuple(r[c] for c in order) for r in got.collect()) == mined_by_brute_force(rows)
    assert len(tiles) > 3 and max(t[0] for t in tiles) < sum(t[0] for t in tiles) / 2  # rows are dealt to blocks by hash
    assert not any(os.path.exists(t[-1]) for t in tiles)


def test_rows_and_row_groups_are_small(spark, tiles, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROW_GROUP", 100_000, raising=False)
    rng = random.Random(6)
    rows = [(k, [rng.gauss(0, 0.125) for _ in range(64)], k // 25 % 5) for k in range(0, 60_000, 25)]
    got = hard_negatives.mined(spark.createDataFrame(rows, KIND).coalesce(1), F.col("vec_id") % 100 == 0, sizes=(64, 256, 32))
    assert got.select("anchor_id", "positive_id").distinct().count() == 600 * 5
    (scores, largest, group, _), = tiles
    assert scores == 600 * len(rows)
    assert largest < 3 * 100 * 400  # blocks of 64 and 256 on average are a little larger
    assert group < 300_000


def test_packed_numbers():
    rng = np.random.default_rng(1)
    most = np.iinfo(np.int64)
    some = rng.integers(-9000, 9000, 1000)
    for x in ([], [0], [most.min, most.max, -1, 0], some, some * 2**20, np.where(np.arange(1000) % 50, some, some * 2**40)):
        x = np.array(x, np.int64)
        assert hard_negatives.unpacked(hard_negatives.packed(x)).tolist() == x.tolist()
    assert len(hard_negatives.packed(some)) < 2100


@pytest.mark.parametrize(("before", "after"), [("64m", "8388608b"), ("1m", "1m"), ("8388608b", "8388608b")])
def test_batches_are_lowered(spark, before, after):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    kept = spark.conf.get(key)
    try:
        spark.conf.set(key, before)
        hard_negatives._lower_batches(spark)
        assert spark.conf.get(key) == after
    finally:
        spark.conf.set(key, kept)
