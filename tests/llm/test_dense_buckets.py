"""Members of a dense bucket meet their representatives, and no other table of the bucket besides."""

from __future__ import annotations

import numpy as np

from lodestone.llm import jaccard_join


def test_members_of_dense_buckets_are_not_joined_twice(spark, monkeypatch):
    joins, plain = [], jaccard_join.met

    def counted(big, small, key, rows, how="inner"):
        joins.extend(key)
        return plain(big, small, key, rows, how)

    monkeypatch.setattr(jaccard_join, "met", counted)
    raw = np.arange(1 + jaccard_join.POOL, dtype=np.uint32).tobytes()
    classes = spark.createDataFrame([(i, bytearray(raw)) for i in range(40)], "cid long, samples binary")
    links = {(r.a, r.b) for r in jaccard_join.candidate_links(classes, 1, 0.8, 8).collect()}
    assert {a for a, _ in links} | {b for _, b in links} == set(range(40))
    # at the first level: small buckets, large ones, representatives; at the second, small ones alone
    assert joins.count("key") == 4
