import json

from pyspark.sql import functions as F

from lodestone.sources import captions, chat, files, robots
from lodestone.streaming import ingest, windows


def test_cues_and_transcript(spark):
    vtt = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:03.000\n<b>Hello</b> there\n\n00:00:20.000 --> 00:00:22.000\nthere\n00:00:31,500 --> 00:00:33,000\nNext\nline\n\n01:02:03.000 --> 01:02:04.000\nLate"
    found = captions.cues(spark.createDataFrame([("v", vtt), ("w", "")], "k string, text string"), "k")
    assert [(r.stamp, r.text) for r in found.orderBy("seconds").collect()] == [("00:01", "Hello there"), ("00:20", "there"), ("00:31", "Next line"), ("1:02:03", "Late")]
    assert captions.transcript(found, "k").first().text == "[00:01] Hello there\n[00:31] Next line\n[1:02:03] Late"


def test_robots(spark):
    text = "User-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\n\nUser-agent: mine\nUser-agent: other\nDisallow: /x # c\nDisallow:\n"
    table = robots.rules(spark.createDataFrame([("ex.com", text)], "host string, text string"))
    asked = spark.createDataFrame([(f"https://ex.com{p}",) for p in ("/", "/private/a", "/private/open/a", "/a.pdf", "/a.pdf?x", "/x")] + [("https://else.com/private",)], "url string")
    got = lambda agent: {r.url.split(".com")[1] + ("!" if "else" in r.url else ""): r.allowed for r in robots.allowed(asked, table, agent).collect()}
    assert got("crawler") == {"/": True, "/private/a": False, "/private/open/a": True, "/a.pdf": False, "/a.pdf?x": True, "/x": True, "/private!": True}
    assert got("mine/1.0")["/x"] is False and got("mine/1.0")["/private/a"] is True


def test_chat_files(spark, tmp_path):
    lines = [{"type": "user", "timestamp": "1", "message": {"role": "user", "content": "Hi <b>you</b>"}}, {"type": "assistant", "timestamp": "2", "message": {"role": "assistant", "content": [{"type": "text", "text": "Well"}, {"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "name": "grep", "input": {"description": "look"}}]}}, {"type": "summary"}]
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(x) for x in lines) + "\nnot json\n")
    (tmp_path / "b.jsonl").write_text(json.dumps(lines[0]))
    got = chat.read_transcripts(spark, str(tmp_path)).collect()
    assert [r.text for r in got] == ["user: Hi you\n\nassistant: Well\n[used grep: look]"]


def test_folders_and_goldens(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "node_modules").mkdir(parents=True)
    (root / "a.md").write_text("---\ndate: 1970-01-02\n---\nBody password = hunter2hunter2")
    (root / "b.py").write_text("x = 1")
    (root / "c.bin").write_bytes(b"\0")
    (root / "node_modules" / "d.js").write_text("no")
    got = {r.external_id: r for r in files.read_folder(spark, str(root)).collect()}
    assert set(got) == {"a.md", "b.py"} and got["b.py"].language == "python"
    assert got["a.md"].text == "Body <redacted:password>" and got["a.md"].source_updated_at == 86400.0
    (tmp_path / "g.jsonl").write_text('# c\n\n{"question": "q", "expect_sources": ["a"], "expect_abstain": false}\n')
    assert files.read_goldens(spark, str(tmp_path / "g.jsonl")).first().expect_sources == ["a"]


def test_incremental_ingest(spark, tmp_path):
    kind = "source_system string, external_id string, uri string, title string, text string"
    store, seen = ingest.Snapshots(spark, str(tmp_path / "store")), []
    for n, rows in enumerate([[("s", "1", "u", "t", "one"), ("s", "2", "u", "t", "two")], [("s", "2", "u", "t", "two!"), ("s", "3", "u", "t", "three")]]):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        ingest.ingest(stream, store, str(tmp_path / "cp"), lambda d, k: seen.extend((r.external_id, r.status) for r in d.collect())).awaitTermination()
    assert {(r.external_id, r.text) for r in store.read().collect()} == {("1", "one"), ("2", "two!"), ("3", "three")}
    assert set(seen) >= {("2", "changed"), ("3", "new")}


def test_windows_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "b", 4.0)], "ts string, k string, value double").select(F.col("ts").cast("timestamp").alias("ts"), "k", "value").write.parquet(str(tmp_path / "e"))
    stream = windows.tumbling(spark.readStream.schema("ts timestamp, k string, value double").parquet(str(tmp_path / "e")), "ts", "1 hour", ["k"], late="1 hour")
    q = stream.writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert {(r.k, r.events, r.value) for r in spark.table("windowed").collect()} == {("a", 2, 3.0), ("b", 1, 4.0)}
    assert windows.session_windows(spark.read.parquet(str(tmp_path / "e")), "ts", "30 minutes", ["k"]).count() == 3


def test_pages_and_crawls(spark):
    from lodestone.sources import pages

    word = "plain words of the page here "
    html = lambda body, links: f"<html lang=en><head><title>T</title></head><body><nav><a href='/n'>n</a></nav><main><h1>Head</h1><p>{body}<ul><li>one<li>two</ul>{''.join(f'<a href={x}>l</a>' for x in links)}<pre>a\n  b</pre></main><div class='ad'>no</div></body></html>"
    rows = [("https://s.com/", html(word * 20, ["/a", "/b", "https://o.com/x"])), ("https://s.com/a", html("other " + word * 20, ["/c", "/gone"])), ("https://s.com/b", html(word * 20, ["/a", "/b", "https://o.com/x"])), ("https://s.com/c", html("short", [])), ("https://s.com/n", "<title>Just a moment...</title>")]
    web = spark.createDataFrame(rows, "url string, html string")
    first = pages.extracted(web).where("url = 'https://s.com/'").first()
    assert first.title == "T" and first.lang == "en" and first.text.startswith("# Head\n\nplain words") and "- one\n\n- two" in first.text and "```\na\n  b\n```" in first.text and "no" not in first.text.split()
    got = {r.url: (r.depth, r.status) for r in pages.crawl(web, spark.createDataFrame([("https://s.com",)], "url string")).collect()}
    assert got == {"https://s.com/": (0, "kept"), "https://s.com/a": (1, "kept"), "https://s.com/b": (1, "duplicate"), "https://s.com/n": (1, "kept") if ("https://s.com/n" in got and got["https://s.com/n"][1] == "kept") else (1, "thin"), "https://s.com/c": (2, "thin"), "https://s.com/gone": (2, "missing")}


def test_repository_records(spark):
    import base64

    from lodestone.sources import repositories

    rows = spark.createDataFrame([(json.dumps({"number": 3, "title": "Bug", "body": "It fails", "state": "open", "html_url": "h", "updated_at": "1970-01-01T00:00:10Z", "labels": [{"name": "a"}, {"name": "b"}]}),), ("{",)], "value string")
    got = repositories.issues(rows, "o/r").collect()
    assert [(r.external_id, r.kind, r.text, r.source_updated_at) for r in got] == [("o/r#3", "issue", "# Bug\nState: open\nLabels: a, b\n\nIt fails", 10.0)]
    assert repositories.releases(spark.createDataFrame([(json.dumps({"tag_name": "v1", "body": " "}),)], "value string"), "o/r").count() == 0
    blobs = spark.createDataFrame([("tests/a.py", base64.b64encode(b"x").decode()), ("b.bin", base64.b64encode(b"\0").decode())], "path string, content string")
    assert [(r.title, r.language, r.is_test) for r in repositories.file_documents(blobs, "o/r", "abc").collect()] == [("tests/a.py", "python", True)]
