"""What readers and the site add to an article goes, even if it is prose; the article's own sections stay."""

from __future__ import annotations

import re

import pytest

from lodestone.llm import tag_paths

BODY = "".join(f"<p>Paragraph {k}, which has words, and marks, as text does.</p>" for k in range(6))
TEXT = re.sub("</?p>", "\n", BODY).replace("\n\n", "\n").strip()
PROSE = "<p>I read this twice, and, frankly, I disagree with the third point, as others do.</p>"
ENTRIES = "".join(f"<div class=x><b>Jo</b> 3 days ago {PROSE}</div>" for _ in range(4))
INNER = [PROSE, PROSE * 3, "<h3>3 replies</h3>" + PROSE * 3, ENTRIES, f"<div class=c>{PROSE}<div class=c>{PROSE}</div></div>"]
ADDED = ["section class=comment-section", "div class=comment", "div id=replies", "div class=discussion", "div class=responses", "div class=notice", "div class=promotion", "section id=replies", "ol class=commentlist", "section class=discussion"]


@pytest.mark.parametrize("part", ADDED)
@pytest.mark.parametrize("around", ["article", "main"])
def test_added_parts_go(around, part):
    tag = part.split()[0]
    for inner in INNER:
        assert tag_paths.main_text(f"<body><{around}>{BODY}<{part}>{inner}</{tag}></{around}></body>") == TEXT
        assert tag_paths.main_text(f"<body><{around}><p>Lead, here.</p><{part}>{inner}</{tag}>{BODY}</{around}></body>") == f"Lead, here.\n{TEXT}"


def test_comment_after_a_post():
    assert tag_paths.main_text(f"<body><div class=post>{BODY}</div><div class=comment>{PROSE}</div></body>") == TEXT


def test_a_section_of_entries_is_no_section_of_the_article():
    assert tag_paths.main_text(f"<article>{BODY}<section id=discussion><h2>Discussion</h2>{ENTRIES}</section></article>") == TEXT
    assert tag_paths.main_text(f"<article>{BODY}<section id=discussion><h2>Discussion</h2>{BODY}</section></article>") == f"{TEXT}\nDiscussion\n{TEXT}"


def test_cells_lists_and_inline_words_stay():
    table = "<table><tr><th class=comment>Remark</th></tr><tr><td class=comment>Fine, as it is.</td></tr></table>"
    assert tag_paths.main_text(f"<article>{BODY}{table}<p>A <span class=notice>last</span> word.</p></article>") == f"{TEXT}\nRemark\nFine, as it is.\nA last word."


def test_pages_with_clashing_columns(spark):
    rows = [(1, "u", f"<article>{BODY}</article>", "a", 2, "c"), (1, "u", f"<article>{BODY}</article>", "a", 2, "c"), (None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, path string")
    got = sorted(tag_paths.extracted(pages).collect(), key=lambda r: r.n_chars)
    assert [tuple(r) for r in got] == [(None, None, "", 0)] + [(1, "u", TEXT, len(TEXT))] * 2
