"""Each operator against a brute-force version, an exact round trip or held-out labels, on small fixtures."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import best_fit_packing, gif_media, jaccard_join, pair_index_bpe, quality_rules, sharding, suffix_dedup, tag_paths, token_files, weak_quality
from lodestone.llm.queries import TOKENIZER
from lodestone.llm.tokens import library_tokenizer, piece_ids

from .fixtures import SCHEMA, documents, frame, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(rows, key="doc_id"):
    return {r[key]: r for r in rows}


# 1 n-gram Jaccard join


def links_by_brute_force(rows):
    ids, sets = [], []
    for r in rows:
        w = WORD.findall(r[1] or "")
        ids.append(r[0])
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w and r[0] is not None else set())
    links, root = Counter(), {i: i for i in ids if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return Counter((i, None if i is None else find(i), links[k]) for k, i in enumerate(ids))


@pytest.mark.parametrize("leaf", [256, 4])
def test_near_duplicates(spark, leaf):
    rows = [r for r in documents() if r[0] is not None]
    got = Counter(tuple(r) for r in jaccard_join.near_duplicates(frame(spark), leaf=leaf).collect())
    assert got == links_by_brute_force(rows) + Counter({(None, None, 0): 1})


def test_links_of_a_real_table_are_all_found(spark):
    """All documents of a table, with its planted copies, in one group beyond a leaf where leaves are small."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 600")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = links_by_brute_force(rows)
    assert Counter(tuple(r) for r in jaccard_join.near_duplicates(docs, leaf=8).collect()) == want
    assert sum(n for _, _, n in want.elements()) > 50


def test_large_groups_of_near_copies(spark):
    """Two dense families, texts between them, and texts that no representative covers."""
    rng = random.Random(3)
    a, rows = words(rng, 120), []
    b = a[:12] + words(rng, 108)
    for k in range(150):
        near = list(a if k % 3 else b)
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            near[rng.randrange(len(near))] = f"w{rng.randrange(40)}"
        rows.append((k, " ".join(near), *[None] * 6))
    got = Counter(tuple(r) for r in jaccard_join.near_duplicates(frame(spark, rows), leaf=16).collect())
    assert got == links_by_brute_force(rows)


def test_near_duplicates_of_nothing(spark):
    assert jaccard_join.near_duplicates(frame(spark, [])).count() == 0
    assert jaccard_join.near_duplicates(frame(spark, [(1, None, *[None] * 6)])).collect() == [(1, 1, 0)]


def test_keep_one_keeps_the_smallest_of_each_class(spark):
    got = [r.doc_id for r in jaccard_join.keep_one(frame(spark)).collect()]
    classes = {c for _, c, _ in links_by_brute_force([r for r in documents() if r[0] is not None])}
    assert {i for i in got if i is not None} == classes and None in got


def test_runs_reach_the_target_recall():
    """A run loses what does not share its first sample, and what neither sample of a split keeps together."""
    n = jaccard_join.runs_for(0.999, 0.8, 3)
    one = 0.8 * (1 - 0.2**2) ** 3
    assert 1 - (1 - one) ** n >= 0.999 > 1 - (1 - one) ** (n - 1)


# 2 sharding


def test_every_slot_is_claimed_in_turns():
    shards, slots = 7, 101
    owner = sharding.lookup_table(shards, slots)
    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    expected: dict[int, int] = {}
    at = 0
    while len(expected) < slots:
        s = at % shards
        prefers = ((number(f"offset-{s}") + k * (number(f"skip-{s}") % (slots - 1) + 1)) % slots for k in range(slots))
        expected[next(x for x in prefers if x not in expected)] = s
        at += 1
    assert owner == [expected[k] for k in range(slots)]
    assert max(Counter(owner).values()) - min(Counter(owner).values()) <= 1


def test_fewer_shards_move_few_slots():
    a, b = sharding.lookup_table(64, 6553), sharding.lookup_table(63, 6553)
    assert sum(x != y for x, y in zip(a, b)) < 6553 * 0.1


def test_sharded_rows(spark):
    got = sharding.sharded(frame(spark)).collect()
    table = sharding.lookup_table()
    assert len(got) == len(documents())
    for r in got:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, table[slot])
    with pytest.raises(ValueError):
        sharding.sharded(frame(spark), slot="kept")
    with pytest.raises(ValueError):
        sharding.lookup_table(3, 10)


def test_write_sharded(spark, tmp_path):
    sharding.write_sharded(frame(spark), str(tmp_path / "out"), files_per_shard=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(documents())


# 3 quality classifier


def test_em_finds_accuracies_of_labellers():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.8
    signs = np.array([v for _, v, _ in weak_quality.LABELLERS])
    right = np.linspace(0.75, 0.95, len(signs))
    fires = rng.random((len(good), len(signs))) < np.where((signs > 0) == good[:, None], right * 0.6, (1 - right) * 0.6)
    pattern, count = np.unique(weak_quality.patterns((fires * signs).astype(np.int8)), return_counts=True)
    found = weak_quality.estimate(pattern, count.astype(float))
    assert abs(found.prior - 0.8) < 0.05
    truth = [(good if s > 0 else ~good)[fires[:, k]].mean() for k, s in enumerate(signs)]
    assert np.abs(found.accuracies - truth).max() < 0.08


def test_classifier_against_labels_it_never_saw(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality is not null")
    got = weak_quality.classified(d, weak_quality.fitted(d)[1]).join(labels, "doc_id").select("kept", "quality").collect()
    assert sum(r.kept == bool(r.quality) for r in got) / len(got) > 0.97
    assert all(r.kept for r in got if r.quality) or sum(not r.kept for r in got if r.quality) / len(got) < 0.01


def test_classifier_edge_cases(spark):
    d = frame(spark)
    scorer = weak_quality.fitted(d)[1]
    kept = weak_quality.keep_good(d, scorer)
    assert kept.columns == d.columns and kept.count() == weak_quality.classified(d, scorer).where("kept").count()
    assert weak_quality.classified(d, scorer).count() == len(documents())
    empty = frame(spark, [])
    assert weak_quality.fitted(empty) == (None, None) and weak_quality.classified(empty, None).count() == 0


# 4 media columns


def test_lzw_round_trips():
    rng = np.random.default_rng(2)
    for size in (2, 3, 7, 8):
        for n in (0, 1, 2, 5000, 30_000):
            s = rng.integers(0, 1 << size, n, np.uint8).tobytes()
            assert gif_media.lzw_decode(gif_media.lzw_encode(s, size), size, n) == s
    assert gif_media.lzw_decode(gif_media.lzw_encode(b"a" * 9999), 8, 9999) == b"a" * 9999


def animation(frames, palette, wide, high):
    """A GIF by hand: frames of (x, y, w, h, samples, disposal, transparent index or None, delay, interlaced)."""
    out = [b"GIF89a", wide.to_bytes(2, "little"), high.to_bytes(2, "little"), bytes([0x80 | 1, 0, 0]), bytes(c for p in palette for c in p)]
    for x, y, w, h, samples, disposal, clear, delay, interlaced in frames:
        out += [b"\x21\xf9\x04", bytes([disposal << 2 | (clear is not None), delay & 255, delay >> 8, clear or 0, 0])]
        out += [b"\x2c", *[v.to_bytes(2, "little") for v in (x, y, w, h)], bytes([0x40 * interlaced]), b"\x02"]
        code = gif_media.lzw_encode(bytes(samples), 2)
        out += [bytes([len(code)]), code, b"\0"]
    return b"".join([*out, b"\x3b"])


def test_disposal_transparency_and_interlacing():
    palette = [(0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)]
    gif = animation([(0, 0, 2, 2, [1, 1, 1, 1], 1, None, 5, False), (0, 0, 1, 1, [2], 2, None, 6, False), (1, 1, 1, 1, [3], 3, None, 7, False), (0, 0, 2, 2, [0, 2, 0, 0], 1, 0, 8, False)], palette, 2, 2)
    f = list(gif_media.gif_frames(gif))
    assert [x["delay"] for x in f] == [5, 6, 7, 8]
    red, green, blue, none = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    seen = [[tuple(map(int, p)) for row in x["canvas"] for p in row] for x in f]
    assert seen == [[red] * 4, [green, red, red, red], [none, red, red, blue], [none, green, red, red]]
    rows = list(range(4)) * 2  # eight rows of one sample: stored 0 4 2 6 1 3 5 7
    stored = [rows[k] for k in (0, 4, 2, 6, 1, 3, 5, 7)]
    got = next(gif_media.gif_frames(animation([(0, 0, 1, 8, stored, 0, None, 0, True)], palette, 1, 8)))
    assert got["indices"].ravel().tolist() == rows


def test_media_query(spark):
    d = frame(spark)
    got = gif_media.media_digests(gif_media.with_media(d)).collect()
    texts = Counter((r[0], r[1] or "") for r in documents())
    assert len(got) == len(documents())
    stored = {r.doc_id: r.media for r in gif_media.with_media(d).collect()}
    for r in got:
        if r.doc_id is None:
            continue
        text = next(t for (i, t) in texts if i == r.doc_id).encode()
        payload = text + b" " * ((-len(text)) % 192 or (0 if text else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())
    one = by_id(got)
    assert one[0].feature == one[1].feature and one[6].media_sha256 == one[7].media_sha256
    assert gif_media.media_digests(gif_media.with_media(frame(spark, []))).count() == 0


def test_frames_of_media_and_of_damage(spark):
    whole = gif_media.gif_of(bytes(range(192)) * 130)
    rows = spark.createDataFrame([(1, whole), (2, whole[:900]), (3, None), (4, b"PNG")], "doc_id long, media binary")
    got = defaultdict(list)
    for r in gif_media.frames(rows).orderBy("doc_id", "frame").collect():
        got[r.doc_id].append(r)
    assert [(r.frame, r.start_cs, r.height, sum(r.colours)) for r in got[1]] == [(0, 0, 64, 64 * 192), (1, 10, 64, 64 * 192), (2, 20, 2, 64 * 192)]
    assert all(got[k][-1].error for k in (2, 3, 4))


# 5 suffix-array dedup


def spans_by_brute_force(rows, passage):
    seen, out = {}, {}
    for i, text in sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda r: r[0]):
        w = WORD.findall(text or "")
        mine, spans = set(), []
        for k in range(len(w) - passage + 1):
            key = tuple(w[k : k + passage])
            if key in seen:
                source = i if key in mine else seen[key]
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + passage
                    spans[-1][2].add(source)
                else:
                    spans.append([k, k + passage, {source}])
            else:
                seen[key] = i
            mine.add(key)
        for a, b, c in spans:
            out[i, a, b] = sorted(c)
    return out


@pytest.mark.parametrize("passage,prefix,block", [(50, 25, 1 << 15), (12, 6, 1 << 15), (12, 6, 3)])
def test_repeated_spans(spark, passage, prefix, block):
    """Blocks of three rows send most runs the other way, by the order of all passages."""
    got = {(r.doc_id, r.start, r.end): list(r.sources) for r in suffix_dedup.repeated_spans(frame(spark), passage, prefix, block).collect()}
    assert got == spans_by_brute_force(documents(), passage)


def test_repeats_are_cut_from_texts(spark):
    d = frame(spark)
    got = by_id(suffix_dedup.without_repeats(d).collect())
    spans = defaultdict(list)
    for (i, a, b) in spans_by_brute_force(documents(), 50):
        spans[i].append((a, b))
    for r in documents():
        if r[0] is None:
            continue
        left = [w for k, w in enumerate(WORD.findall(r[1] or "")) if not any(a <= k < b for a, b in spans[r[0]])]
        if spans[r[0]] and not left:
            assert r[0] not in got
        else:
            assert WORD.findall(got[r[0]].text or "") == left
            assert got[r[0]].text == r[1] if not spans[r[0]] else got[r[0]].n_chars == len(got[r[0]].text)
    assert suffix_dedup.repeated_spans(frame(spark, [])).count() == 0


# 6 best-fit packing


def ids_of(text):
    return library_tokenizer(TOKENIZER).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packed_sequences(spark):
    got = best_fit_packing.packed(frame(spark), TOKENIZER, 0, 2048, bucket=20).collect()
    pieces = Counter()
    for r in documents():
        ids = [*ids_of(r[1]), 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            pieces[r[0], k // 2048, k, len(part), crc(part)] += 1
    assert Counter(tuple(r)[:5] for r in got) == pieces
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for row in places.values():
        at = 0
        for offset, length in sorted(row):
            assert offset == at
            at += length
        assert at <= 2048
    assert best_fit_packing.packed(frame(spark, []), TOKENIZER).count() == 0


def test_packing_is_near_the_least_possible():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 2049, 4000), np.minimum(2048, rng.lognormal(6, 1, 5000).astype(int) + 1), np.full(100, 1025), np.array([1]), np.array([2048, 1, 2047])):
        seq = best_fit_packing.pack(lengths)
        fill = np.bincount(seq, lengths)
        assert fill.max() <= 2048 and fill.min() > 0
        least = max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum()))
        assert len(fill) <= 1.02 * least + 1


# 7 token files


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17])
def test_bits_are_packed_and_cut_anywhere(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 301)
    raw = token_files.pack_bits(ids, bits)
    assert len(raw) == -(-301 * bits // 8)
    for a, b in ((0, 301), (0, 0), (7, 8), (13, 300), (300, 301)):
        assert token_files.unpack_bits(raw, bits, a, b).tolist() == ids[a:b].tolist()


def test_token_files(spark):
    d = frame(spark)
    got = token_files.document_digests(token_files.write_blocks(d, TOKENIZER, 2)).collect()
    rows = sorted(documents(), key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for r, expected in zip(sorted(got, key=lambda r: r.start), rows, strict=True):
        ids = [*ids_of(expected[1]), 2]
        assert tuple(r) == (expected[0], at, len(ids), crc(ids))
        at += len(ids)
    assert token_files.document_digests(token_files.write_blocks(frame(spark, []), TOKENIZER, 2)).count() == 0


# 8 quality rules


def statistics_by_brute_force(text):
    w = WORD.findall(text or "")
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_statistics(spark):
    got = quality_rules.quality_rules(frame(spark), None).collect()
    expected = Counter()
    for r in documents():
        s = statistics_by_brute_force(r[1])
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        expected[(r[0], *s, failed, not failed)] += 1
    assert Counter(tuple(r)[:8] for r in got) == expected
    assert quality_rules.quality_rules(frame(spark, []), None).count() == 0


def test_trees_learn_and_keep_their_constraints():
    rng = np.random.default_rng(4)
    x = rng.random((4000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.1 * rng.normal(size=4000)) > 0.6).astype(float)
    trees = quality_rules.fit_trees(x[:3000], y[:3000], [1, 0, -1])
    assert ((trees.probability(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    probe = rng.random((200, 3))
    for j, sign in ((0, 1), (2, -1)):
        steps = []
        for v in np.linspace(0, 1, 30):
            probe[:, j] = v
            steps.append(trees.probability(probe))
        assert (sign * np.diff(steps, axis=0) >= -1e-12).all()
    slow = []
    for row in x[:50]:
        z = trees.base
        for root in trees.roots:
            node = root
            while trees.low[node] != node:
                node = trees.low[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.high[node]
            z += trees.value[node]
        slow.append(1 / (1 + np.exp(-z)))
    assert np.allclose(slow, trees.probability(x[:50]))


def test_rules_against_labels_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality is not null")
    model = quality_rules.fitted(d, labels.where("doc_id % 2 = 0"))
    got = quality_rules.quality_rules(d, model).where("not base_failed").join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert sum(r.kept == bool(r.quality) for r in got) / len(got) > 0.97
    assert quality_rules.fitted(d, labels.where("1 = 0")) is None
    assert quality_rules.keep_good(d, model).count() == quality_rules.quality_rules(d, model).where("kept").count()


# 9 byte-pair encoding


def test_own_encoder_equals_the_library(spark):
    texts = [r[1] or "" for r in documents()] + ["it's we'RE 'tis", "x<|startoftext|>y", "a b", "\x1c\x1d   ", "ǅ ﬁ Å İ ς K ² Ⅷ", "aaaaaaa aaaa", "'''s '", "한국어 조합"]
    bpe, lib = pair_index_bpe.pair_index(TOKENIZER), library_tokenizer(TOKENIZER)
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert bpe.encode(t) == ids
        assert bpe.decode(ids) == lib.decode(ids, skip_special_tokens=False)
        assert np.frombuffer(piece_ids(TOKENIZER)([t])[0], "<u4").tolist() == ids


def test_bpe_query_and_tables(spark):
    d = frame(spark)
    lib = library_tokenizer(TOKENIZER)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = Counter()
    for r in documents():
        ids = ids_of(r[1])
        expected[r[0], len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(tuple(r) for r in pair_index_bpe.round_trip_digests(d, TOKENIZER).collect()) == expected
    ids = pair_index_bpe.encoded(d, TOKENIZER)
    assert Counter((r.doc_id, tuple(r.ids)) for r in ids.collect()) == Counter((r[0], tuple(ids_of(r[1]))) for r in documents())
    assert Counter(tuple(r) for r in pair_index_bpe.decoded(ids, TOKENIZER).collect()) == Counter((r[0], lib.decode(ids_of(r[1]), skip_special_tokens=False)) for r in documents())
    assert pair_index_bpe.round_trip_digests(frame(spark, []), TOKENIZER).count() == 0


# 10 HTML extraction

PAGES = [
    (None, ""), ("", ""), ("<p>", ""), ("plain text", "plain text"), ("<article></article>", ""), ("<script>var a = '<p>no</p>';", ""),
    ("<body><nav><a>menu</a></nav><article><h1>Title &amp; more</h1><p><b>First.<br><p>Second  part\n here.</p></article><footer>&copy; x</footer></body>", "Title & more\nFirst.\nSecond part here."),
    ("<header>Site</header><main><div><p>Long text, with marks, and words.</p><p>Short</p><div class='ad-box'>Buy</div></div><section id=comments><p>I disagree, a lot.</p></section></main>", "Long text, with marks, and words.\nShort"),
    ("<div class=layout><div class=sidebar><p>Side text, long enough, to count, maybe.</p></div><div class=post><p>The article, which is long, has several marks, and words.</p><ul><li>one<li>two</ul><p>End.</p></div><div class='cookie-notice'>We use cookies.</div></div>", "The article, which is long, has several marks, and words.\none\ntwo\nEnd."),
    ("<article><p>a &nbsp; b</p><form><p>Name</p></form><aside>x</aside><p style='display: none'>no</p><!-- c --><p>c &lt;d&gt; &#233; &copy</p></article>", "a b\nc <d> é ©"),
]


def test_main_text_of_pages(spark):
    for page, text in PAGES:
        assert tag_paths.main_text(page) == text
    rows = spark.createDataFrame([(k, f"http://x/{k}", p) for k, (p, _) in enumerate(PAGES)], "page_id long, url string, html string")
    got = by_id(tag_paths.extracted(rows).collect(), "page_id")
    assert all((got[k].text, got[k].n_chars) == (t, len(t)) for k, (_, t) in enumerate(PAGES))
    assert tag_paths.extracted(rows.limit(0)).count() == 0


def test_names_alone_drop_no_content():
    body = "".join(f"<p>Paragraph {k}, which has words, and marks, as text does.</p>" for k in range(4))
    text = re.sub("</?p>", "\n", body).replace("\n\n", "\n").strip()
    for page, want in [
        (f"<article><section id=intro>{body}</section><section id='discussion'><h2 id=related-work>Discussion</h2>{body}</section></article>", f"{text}\nDiscussion\n{text}"),
        (f"<article><h2 id='related-work'>Related</h2>{body}<section id=search>{body}</section></article>", f"Related\n{text}\n{text}"),
        (f"<article><header class='entry-header'><h1>Title</h1></header>{body}</article>", f"Title\n{text}"),
        (f"<article><div class='entry-header'><h1>Title</h1></div>{body}</article>", f"Title\n{text}"),
        (f"<div class='content has-sidebar'>{body}</div><footer>f</footer>", text),
        (f"<div class='content no-sidebar'>{body}</div>", text),
        (f"<main><article class='post has-sidebar'>{body}</article></main>", text),
        (f"<div class='sidebar widget'>{body}</div>", text),
        (f"<div class='sidebar'><p>Ab.</p></div><div class='comments'>{body}</div>", text),
        (f"<article>{body}<pre>x = 1 <span class=comment># one</span></pre><p>See <a id=search>here</a>.</p></article>", f"{text}\nx = 1 # one\nSee here."),
        (f"<article>{body}<div class=related><ul><li>More<li>Again</ul></div><div class=comments><p>No, I think.</p></div></article>", text),
        (f"<div class=page><div class=sidebar><a>Home</a></div><div class=post>{body}</div><div class=share>Share</div></div>", text),
    ]:
        assert tag_paths.main_text(page) == want, page


def test_text_around_the_core_is_kept():
    body = "".join(f"<p>Paragraph {k}, which has words, and marks, as text does.</p>" for k in range(30))
    text = re.sub("</?p>", "\n", body).replace("\n\n", "\n").strip()
    links = "<div class=top><a>Home</a> <a>About us</a></div>"
    table = "<table>" + "<tr><td>A cell, with words, and marks, in it.</td></tr>" * 30 + "</table>"
    cells = "\n".join(["A cell, with words, and marks, in it."] * 30)
    for page, want in [
        (f"<body>{links}<div class=post><h1>Title</h1><p>Lead, with a comma.</p><div class=body>{body}</div></div></body>", f"Title\nLead, with a comma.\n{text}"),
        (f"<body>{links}<div class=post><h1>Title</h1><div class=by>By Jo</div><div class=body>{body}</div><p>End.</p></div><p>2020 Site</p></body>", f"Title\nBy Jo\n{text}\nEnd."),
        (f"<body>{links}<div class=post><p>An intro, short.</p>{table}</div></body>", f"An intro, short.\n{cells}"),
        (f"<body>{links}<div class=post><p>An intro, short.</p><blockquote>{body}</blockquote></div></body>", f"An intro, short.\n{text}"),
        (f"<body>{links}<main><article>{body}</article><article><h2>Second</h2><p>Another, with words, and marks, of its own.</p></article></main></body>", f"{text}\nSecond\nAnother, with words, and marks, of its own."),
        (f"<body>{links}<main><p>Lead.</p><article>{body}</article></main><div class=x>More</div></body>", f"Lead.\n{text}"),
        (f"<body>{links}<article>{body}</article><article><p>Another, with words, and marks.</p></article></body>", f"{text}\nAnother, with words, and marks."),
        (f"<body>{links}<div class=post>{body}</div><div class=bottom><h3>Links</h3><a>Imprint</a></div></body>", text),
    ]:
        assert tag_paths.main_text(page) == want, page


def test_embedded_elements_hide_nothing_after_them():
    for tag in ("<svg-icon name=x></svg-icon>", "<video-player src='a'>", "<math-field></math-field>", "<template-part>", "<title-bar></title-bar>", "<svg class='a' />", "<math/>", "<svg><path d='M0'/>", "<video src=x>", "<object data=x>",
                "<svg><style/><title/><path/></svg>", "<svg><svg><text>a</text></svg><text>b</text></svg>", "<video><p>No video</video>", "<svg><foreignObject><p>label</p></foreignObject></svg>", "<script>x</script >", "<script/>y</script>"):
        assert tag_paths.main_text(f"<article><p>one</p>{tag}<p>two three</p></article>") == "one\ntwo three", tag
        assert tag_paths.main_text(f"<article><p>one</p>{tag}<p>two three</p><svg><text>c</text></svg><p>four</p></article>") == "one\ntwo three\nfour", tag
    assert tag_paths.main_text("<article><p>a <svg><title>t</title><text>x</text></svg>b <object><p>f</p></object>c</p></article>") == "a b c"
    assert tag_paths.main_text("<article><p>one</p><textarea>rest <p>two</p></article>") == "one"
    assert len(tag_paths.main_text("<article>" + "<svg><video src=x>word " * 20_000)) == 5 * 20_000 - 1


def test_damaged_and_long_pages_take_linear_time():
    assert tag_paths.main_text("<a href='" * 20_000) == ""
    assert tag_paths.main_text("<div>" * 5000 + "text") == "text"
    assert len(tag_paths.main_text("<article>" + "<p>words here, again" * 20_000)) == 20_000 * 17 + 19_999


def test_pages_by_their_template(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        import html

        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
        assert tag_paths.main_text(r.html) == "\n".join(b for b in blocks if b)


# schema of the fixture has names that operators use themselves
def test_clashing_columns_do_no_harm(spark):
    d = frame(spark)
    assert {"kept", "class_id", "start"} <= set(SCHEMA.replace(",", " ").split())
    assert quality_rules.keep_good(d, None).columns == jaccard_join.keep_one(d).columns == d.columns
