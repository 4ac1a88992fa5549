"""Hash trees of listings: the same as a full comparison, with few rows read."""

import random
from collections import Counter

import pytest

from lodestone.operators import trees


def listing(rng, many=400):
    return {"/".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 5))) + f"/f{k}".lstrip("/" if k % 50 == 0 else ""): f"h{rng.randrange(9)}" for k in range(many)}


def by_hand(old, new):
    return Counter((p, "new" if p not in old else "removed" if p not in new else "changed") for p in old.keys() | new.keys() if old.get(p) != new.get(p))


@pytest.mark.parametrize("kept", [False, True])
def test_changed_files(spark, tmp_path, kept):
    rng = random.Random(3)
    old = {k.strip("/"): v for k, v in listing(rng).items()}
    new = dict(old)
    some = sorted(old)
    for p in some[:3]:
        new[p] = "other"
    for p in some[100:102]:
        del new[p]
    new |= {"a/brand/new/file": "h", "top": "h", f"{some[200]}/below": "h"}
    del new[some[200]]  # a file that is a folder now
    frame = lambda d: spark.createDataFrame([*d.items()], "path string, digest string")
    a, b = trees.tree(frame(old)), trees.tree(frame(new))
    if kept:
        for name, t in (("old", a), ("new", b)):
            trees.write_tree(t, str(tmp_path / name))
        a, b = (trees.read_tree(spark, str(tmp_path / name)) for name in ("old", "new"))
    read: list = []
    got = Counter(tuple(r) for r in trees.changed_files(a, b, read).collect())
    assert got == by_hand(old, new)
    assert read[0] == 2 and sum(read) < (a.count() + b.count()) / 2
    same: list = []
    assert trees.changed_files(a, a, same).count() == 0 and same == [2]


def test_empty_listings_nulls_and_repeats(spark):
    frame = lambda rows: trees.tree(spark.createDataFrame(rows, "path string, digest string"))
    none, some = frame([]), frame([("x/y", "1"), ("x/y", "1"), (None, "2"), ("z", None)])
    assert Counter(tuple(r) for r in trees.changed_files(none, some).collect()) == Counter([("x/y", "new"), ("z", "new")])
    assert Counter(tuple(r) for r in trees.changed_files(some, none).collect()) == Counter([("x/y", "removed"), ("z", "removed")])
    assert trees.changed_files(none, none).count() == 0
    assert {(r.path, r.files, r.depth) for r in some.where("not is_file").collect()} == {("", 2, 0), ("x", 1, 1)}
