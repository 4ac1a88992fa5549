"""Data sources: what they read and pass over, cursors as stream offsets, and keyed state against whole snapshots."""

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators.incremental import delta
from lodestone.sources import connectors
from lodestone.streaming import keyed


@pytest.fixture(scope="module")
def formats(spark):
    connectors.register(spark)


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "root"
    for name, raw in {"a.md": b"---\ndate: 2020-01-02\n---\n# A", "sub/b.txt": "naïve \xff".encode("latin-1"), "sub/deep/c.py": b"x = 1", "big.txt": b"x" * 3000, "bin.txt": b"a\0b", "pic.png": b"P", "node_modules/d.md": b"no", "private/e.md": b"no", "sub/empty.md": b""}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(raw)
    outside = tmp_path / "outside"
    outside.mkdir()
    (outside / "secret.md").write_text("secret")
    os.symlink(outside / "secret.md", root / "link.md")
    os.symlink(outside, root / "linked")
    os.symlink(root, root / "sub/loop")
    return root


def test_folder(spark, formats, folder):
    rows = spark.read.format("lodestone_folder").option("path", str(folder)).option("exclude", "private/*").option("max_bytes", "2000").option("authority", "1.5").load()
    got = {r.external_id: r for r in rows.collect()}
    skipped = {k: r.skipped for k, r in got.items() if r.skipped}
    assert skipped == {"big.txt": "too_large", "bin.txt": "binary", "pic.png": "not_text", "node_modules/d.md": "skip_pattern", "private/e.md": "excluded", "link.md": "symlink", "linked": "symlink", "sub/loop": "symlink"}
    assert {k for k, r in got.items() if not r.skipped} == {"a.md", "sub/b.txt", "sub/deep/c.py", "sub/empty.md"}
    assert got["sub/b.txt"].text == "na�ve �" and got["a.md"].authority == 1.5 and got["a.md"].title == "a.md" and got["sub/empty.md"].text == ""
    docs = {r.external_id: r for r in connectors.documents(rows).collect()}
    assert docs["a.md"].source_updated_at == 1577923200.0 and docs["a.md"].text.strip() == "# A" and docs["sub/deep/c.py"].language == "python"
    assert {r.skipped: r.units for r in connectors.skipped_counts(rows).collect()}["symlink"] == 3


def test_patterns_and_followed_links(spark, formats, folder):
    read = lambda **o: {r.external_id for r in spark.read.format("lodestone_folder").options(path=str(folder), **o).load().where("skipped is null").collect()}
    assert read(patterns="*.md") == {"a.md"}
    assert read(patterns="sub/*.txt, **/*.py") == {"sub/b.txt", "sub/deep/c.py"}
    followed = read(follow_symlinks="true", patterns="**/*.md")
    assert {"link.md", "linked/secret.md", "a.md"} <= followed and not any("loop/" in k for k in followed)


def test_parts_are_bounded(monkeypatch):
    monkeypatch.setattr(connectors, "PARTITION_BYTES", 10)
    units = [connectors.Unit(str(k), 0.0, 4) for k in range(7)] + [connectors.Unit("large", 0.0, 99)]
    assert [[u.key for u in p.units] for p in connectors._parts(units)] == [["0", "1"], ["2", "3"], ["4", "5"], ["6"], ["large"]]


def test_chat(spark, formats, tmp_path):
    turns = [{"role": "user", "text": "How?\nmore"}, {"role": "assistant", "content": "So."}, {"role": "user", "text": "  "}, 5, {"x": 1}]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, turns)) + "\nnot json\n")
    (tmp_path / "short.jsonl").write_text(json.dumps(turns[0]))
    got = {r.external_id: r for r in spark.read.format("lodestone_chat").option("path", str(tmp_path)).load().collect()}
    assert (got["s.jsonl"].title, got["s.jsonl"].text, got["s.jsonl"].kind) == ("How?", "user: How?\nmore\n\nassistant: So.", "chat")
    assert got["short.jsonl"].skipped == "too_short"


def test_stream_goes_on_from_its_cursor(spark, formats, tmp_path):
    root, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    root.mkdir()

    def put(name, text, at):
        (root / name).write_text(text)
        os.utime(root / name, (at, at))

    def run():
        stream = spark.readStream.format("lodestone_folder").option("path", str(root)).load()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return Counter((r.external_id, r.text) for r in spark.read.parquet(out).collect())

    put("a.txt", "one", 1000)
    put("b.txt", "two", 1000)
    first = Counter({("a.txt", "one"): 1, ("b.txt", "two"): 1})
    assert run() == first
    assert run() == first  # nothing new
    put("a.txt", "one, changed", 2000)
    put("c.txt", "three", 3000)
    put("old.txt", "older than the cursor", 500)
    assert run() == first + Counter({("a.txt", "one, changed"): 1, ("c.txt", "three"): 1})


def test_keyed_state_equals_snapshots(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = "source_system string, external_id string, content_hash string, run long, failed int"
    snapshots = [
        {("s", f"d{k}"): "h0" for k in range(40)} | {("t", "x"): "h"},
        {("s", f"d{k}"): "h1" if k % 5 == 0 else "h0" for k in range(10, 45)},
        {("s", f"d{k}"): "h1" if k % 5 == 0 else "h0" for k in range(0, 20)} | {("t", "x"): "h"},
    ]
    failed = {(1, "t"): 1}
    out, mark, place = str(tmp_path / "out"), str(tmp_path / "mark"), tmp_path / "in"

    def run():
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(place))
        write = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)
        q = keyed.changes(stream, buckets=3).writeStream.foreachBatch(write).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(180)

    place.mkdir()
    for n, snapshot in enumerate(snapshots):
        rows = [{"source_system": s, "external_id": i, "content_hash": h, "run": n} for (s, i), h in snapshot.items()]
        rows += [{"source_system": s, "run": n, "failed": failed.get((n, s), 0)} for s in ("s", "t")]
        (place / f"run{n}.json").write_text("\n".join(map(json.dumps, rows)))
        run()  # a restart between any two runs
    got = Counter((r.source_system, r.external_id, r.run, r.status) for r in spark.read.parquet(out).collect())
    expected = Counter()
    previous: dict = {}
    table = lambda d: spark.createDataFrame([(s, i, h) for (s, i), h in d.items()], "source_system string, external_id string, content_hash string")
    for n, snapshot in enumerate(snapshots):
        # where reading failed, what was not seen stays
        kept = {k: h for k, h in previous.items() if k not in snapshot and failed.get((n, k[0]))}
        for r in delta(table(previous), table(snapshot | kept), ["source_system", "external_id"]).collect():
            if (r.source_system, r.external_id) not in kept:
                expected[r.source_system, r.external_id, n, r.status] += 1
        previous = snapshot | kept
    assert got == expected


def test_a_batch_rewrites_only_the_parts_it_touches(spark, tmp_path):
    from lodestone.streaming import ingest

    store, told = ingest.Snapshots(spark, str(tmp_path / "store"), parts=8), []
    kind = "source_system string, external_id string, uri string, title string, text string"
    run = ingest.merge_batch(store, lambda d, n: told.append((n, Counter((r.external_id, r.status) for r in d.collect()))))
    rows = lambda names, text: spark.createDataFrame([("s", n, "u", "t", text) for n in names], kind)
    run(rows([f"d{k}" for k in range(100)], "one"), 0)
    first = store.manifest(0)
    assert len(first) == 8 and store.read().count() == 100
    run(rows(["d3", "d3", "x"], "two"), 1)
    second = store.manifest(1)
    written = {p for p, v in second.items() if v == 1}
    assert 1 <= len(written) <= 2 and {p: v for p, v in second.items() if p not in written} == {p: v for p, v in first.items() if p not in written}
    files = [p for p in (tmp_path / "store/data/version=00000001").rglob("*.parquet")]
    assert {p.parent.name for p in files} == {f"part={p}" for p in written}
    assert told == [(1, Counter({("d3", "changed"): 1, ("x", "new"): 1}))]
    whole = lambda: Counter((r.external_id, r.text) for r in store.read().collect())
    after = whole()
    assert after == Counter([(f"d{k}", "two" if k == 3 else "one") for k in range(100)] + [("x", "two")])
    run(rows(["d3", "d3", "x"], "two"), 1)  # again, as after a failure
    assert whole() == after and told[1] == told[0]
    run(rows([], ""), 2)
    assert whole() == after and store.manifest(2) == second
    # an unfinished snapshot does not count
    (tmp_path / "store/manifest/snapshot=00000002/_SUCCESS").unlink()
    assert store.latest() == 1 and store.vacuum() == [] and whole() == after
    run(rows([f"d{k}" for k in range(100)] + ["x"], "three"), 2)
    assert store.vacuum() == [0, 1] and set(whole().values()) == {1} and {t for _, t in whole()} == {"three"}
