"""Bucketed tables are joined without a shuffle; a batch beside one is the only side that is dealt."""

from collections import Counter

import pytest

from lodestone.operators import lookup

KIND = "source_system string, external_id string, doc_id string"


@pytest.fixture
def known(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lookup.write_bucketed(spark.createDataFrame([(f"s{k % 3}", f"e{k}", f"d{k}") for k in range(500)], KIND), "lookup_known", buckets=8)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lookup.drop(spark, "lookup_known")


def exchanges(df):
    """Shuffles in the plan that ran."""
    df.collect()
    return sum("Exchange" in line and "AQEShuffleRead" not in line for line in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("\n"))


def test_tables_of_as_many_buckets(spark, known):
    asked = lookup.write_bucketed(spark.createDataFrame([(f"s{k % 3}", f"e{k}") for k in range(400, 600)] + [(None, "e1")], "source_system string, external_id string"), "lookup_asked", buckets=8)
    found = lookup.looked_up(asked, known, ["doc_id"])
    assert exchanges(found) == 0 and exchanges(lookup.unknown(asked, known)) == 0
    assert Counter(r.doc_id for r in found.collect()) == Counter([f"d{k}" for k in range(400, 500)] + [None] * 101)
    assert lookup.unknown(asked, known).count() == 101
    lookup.drop(spark, "lookup_asked")


def test_a_batch_is_the_only_side_that_moves(spark, known):
    batch = spark.createDataFrame([("s1", "e1"), ("s0", "e1"), ("s1", "e1")], "source_system string, external_id string")
    found = lookup.looked_up(batch, known, ["doc_id"])
    assert exchanges(found) == 1
    assert Counter(r.doc_id for r in found.collect()) == Counter({"d1": 2, None: 1})
