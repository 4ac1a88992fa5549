"""Main text of web pages by tag-path ratios.

A block is the text between two block-level tags; its path is the chain of tags (with classes) from the root to it.
Blocks of one template share a path, so text length and punctuation are summed per path and divided by its number of
blocks. Both ratios, given to each block in page order, are smoothed over neighbours and fused by multiplication;
blocks above a threshold (a share of the spread of all) are content nodes. The content region is the article-like
element that holds most of their score, or else the smallest element that holds nearly all of it, with what is around it
and passes the threshold by its own path, and titles and leads next to it (kept_around); every block there is kept, whatever its own length, except those in elements that are no text (menus, page headers, footers, asides, forms,
scripts) and in parts whose class, id or role names a sidebar, notice, advert, reader comments or the like and whose path
ratio is low for such a name. Comments, replies, notices and promotions may be prose, so a block-level part of such a name
goes unless it holds most of the page; but a section that opens with a heading of its own, is named by its id alone by a
word that is also a subject (discussion, notice) and does not consist of entries (elements of one path that each begin with
a byline, a time or a reply link) is a section of the article. Headings, table cells, layout switches (has-sidebar) and an
article's own header are never left out so.

Null and empty html give an empty text, and so do pages with nothing but such parts. Damaged markup is read as browsers
do where it is cheap: unclosed paragraphs and list items end at the next one, stray end tags are dropped. Scripts and
other raw text without an end tag run to the end of the page; pictures, media and templates are left out with what they
hold only if their end tag follows, and otherwise hide nothing. The whole page is read, of any length, in time proportional to it. Repeated pages give equal texts. Further columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean
from .textarrays import in_slices

# Kinds of elements in HTML.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
_RAW = set("script style noscript textarea title iframe xmp noembed noframes".split())
_EMBEDDED = set("template svg math object audio video canvas".split())
_FOREIGN = set("svg math".split())
_BREAKOUT = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta ol p pre s small span strong sub sup table u ul var".split())
_DROPPED = set("nav footer aside form button select head dialog menu label fieldset".split())
_CLOSES_P = _BLOCK - set("body html option optgroup".split())
_ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_SCOPE = set("ul ol dl table article section div main body html blockquote td th aside nav footer header form".split())
# Words of class, id and role that name a part which is not the main text.
_NOISE = set("ad ads advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist respond disqus cookie cookies consent gdpr footer header masthead menu menubar nav navbar navigation newsletter notice notices notification alert popup modal overlay promo promoted promotion recommended recommendations related rail share sharing sidebar sidenav social sponsor sponsored subscribe subscription signup login search toolbar toc widget widgets pager pagination contentinfo complementary dialog paywall outbrain taboola reply replies feedback discussion skip responses notifications".split())
# Those of them that are also ordinary subjects or parts of an article.
_AMBIGUOUS = set("alert banner comment consent dialog discussion feedback footer header login masthead menu modal navigation notice notices notification overlay popup promotion rail recommended recommendations related reply replies search share sharing signup skip social subscribe subscription toolbar widget widgets".split())
# Names of what readers or the site add, which may be prose; those of them that are subjects too.
_ADDED = set("alert comment comments commentlist discussion feedback notice notices notification notifications promo promoted promotion replies reply respond responses".split())
_SUBJECT = set("alert discussion feedback notice notices notification notifications promotion responses".split())
_CELLS = set("dd dt td th pre".split())
_MODIFIER = re.compile(r"(?:has|no|not|is|with|without|hide|show)[-_]")
_OWN_HEADER = set("article chapter content entry page post section story title".split())
_MAIN = set("articlebody mainentity".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|"
    r"<[/a-zA-Z][^>]*+\Z|"
    r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?>[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*+)>",
    re.S | re.I,
)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for t in _RAW}
_ATTR = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?")
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_PUNCT = re.compile(r"[^\w\s]")
_TITLES = {"h1", "h2", "h3", "h4", "h5", "h6"}
_NEVER_NAMED = _TITLES | {"body", "html", "header"}


def _noise(value: str, article: bool) -> set[str]:
    """The words of a class, id or role that name a part apart from the main text; not those of layout switches such as
    has-sidebar, nor of an article's own header."""
    found = set()
    for token in value.strip("\"'").lower().split():
        words = set(_WORDS.findall(token))
        here = words & _NOISE
        if here and not _MODIFIER.match(token):
            found |= here - {"header", "masthead"} if article or words & _OWN_HEADER else here
    return found


class _Element:
    __slots__ = ("tag", "parent", "path", "dropped", "main", "depth", "header", "foreign", "embedded", "mark", "named", "certain", "added", "muted", "code", "paths")

    def __init__(self, tag: str, attrs: str, parent: _Element | None):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.mark = None
        self.foreign = tag in _FOREIGN or bool(parent and parent.foreign) and tag not in ("foreignobject", "desc")
        self.embedded = self if tag in _EMBEDDED else parent and parent.embedded
        name, noisy, certain, hidden, main = tag, False, False, False, tag in ("article", "main")
        added: set[tuple[str, str]] = set()
        inline = tag not in _BLOCK
        article = bool(parent and (parent.main or parent.header == "main"))
        if attrs:
            for k, v in _ATTR.findall(attrs):
                k = k.lower()
                if k in ("class", "id", "role"):
                    words = _WORDS.findall(v.lower())
                    if not (k == "id" and inline):
                        found = _noise(v, article)
                        if tag in _CELLS and found <= _AMBIGUOUS | _ADDED:
                            found = set()  # a column of that name
                        noisy |= bool(found)
                        added |= {(k, x) for x in found & _ADDED}
                        certain |= k == "role" and bool(found) or not found <= _AMBIGUOUS
                    main |= k == "role" and words == ["main"]
                    if k == "class":
                        name += "." + "-".join(words)
                elif k == "hidden" or k == "aria-hidden" and "true" in v:
                    hidden = True
                elif k == "style":
                    hidden |= "display:none" in v.replace(" ", "").lower()
                elif k == "itemprop":
                    main |= not _MAIN.isdisjoint(_WORDS.findall(v.lower()))
        self.main = main
        inside = article
        self.header = ("main" if inside or main else None) if tag != "header" else ("main" if inside else "page")
        self.dropped = bool(parent and parent.dropped) or tag in _DROPPED or hidden or tag == "header" and not inside
        outer = parent and parent.named
        self.code = tag in ("pre", "code") or bool(parent and parent.code)
        self.certain = certain
        #: names what readers or the site added: 2 if surely, 1 if it may name a subject
        self.added = 0 if inline or not added or tag in _CELLS else 1 if tag == "section" and all(k == "id" and x in _SUBJECT for k, x in added) else 2
        self.named = self if noisy and not (main and not (tag == "article" and inside)) and tag not in _NEVER_NAMED and not (inline and self.code) else outer
        self.muted = inline and (bool(parent and parent.muted) or self.named is self and certain)
        # paths are numbered by the path above and the last step, so that depth costs nothing
        self.paths: dict[tuple[int, str], int] = parent.paths if parent else {}
        self.path: int = parent.path if parent and inline else self.paths.setdefault((parent.path if parent else -1, name), len(self.paths))


def _blocks(page: str) -> list[tuple[str, _Element]]:
    """The blocks of a page in order, with the element each is in, but for those in dropped parts."""
    root = _Element("html", "", None)
    top, parts, out, at = root, [], [], 0
    opened: dict[str, int] = {}

    def pop(to: _Element) -> None:
        nonlocal top
        while top is not to:
            opened[top.tag] -= 1
            top = top.parent

    def flush() -> None:
        nonlocal parts
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                home = top
                while home.tag not in _BLOCK:
                    home = home.parent
                out.append((text, home))
            parts = []

    while m := _TOKEN.search(page, at):
        if m.start() > at and not top.dropped and not top.muted:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if page.startswith("<![CDATA[", m.start()) and not top.dropped and not top.muted:
                parts.append(entities.escape(m[0][9:-3]))
            continue
        tag = tag.lower()
        if tag == "br" or tag == "wbr":
            if tag == "br" and not top.dropped:
                parts.append(" ")
            continue
        if m["end"] and tag in _EMBEDDED:
            node = top.embedded
            while node and node.tag != tag:
                node = node.parent.embedded
            if node:
                pop(node.parent)
                n, parts, k = node.mark
                del out[n:], parts[k:]
            continue
        if m["end"]:
            if not opened.get(tag):
                continue
            node = top
            while node is not root and node.tag != tag and not (tag not in _BLOCK and node.tag in _BLOCK):
                node = node.parent
            if node is not root and node.tag == tag:
                if tag in _BLOCK:
                    flush()
                pop(node.parent)
            continue
        if tag in _RAW and not top.foreign:
            ended = _RAW_END[tag].search(page, at)
            at = ended.end() if ended else len(page)
            continue
        if top.foreign and tag in _BREAKOUT:
            node = top
            while node.foreign:
                node = node.parent
            pop(node)
        if (tag in _FOREIGN or top.foreign) and m["attrs"].endswith("/"):
            continue
        if tag in _BLOCK:
            flush()
            ends = _ENDS.get(tag, set()) | ({"p"} if tag in _CLOSES_P else set())
            node = top
            while node is not root and node.tag not in ends and (node.tag not in _SCOPE and node.tag not in _EMBEDDED or tag in ("td", "th", "tr") and node.tag in ("td", "th")):
                node = node.parent
            if node is not root and node.tag in ends:
                pop(node.parent)
                if tag == "tr" and top.tag == "tr":
                    pop(top.parent)
        if tag in ("html",):
            continue
        if tag not in _VOID:
            top = _Element(tag, m["attrs"], top)
            opened[tag] = opened.get(tag, 0) + 1
            if tag in _EMBEDDED:
                top.mark = len(out), parts, len(parts)
    if not top.dropped and not top.muted:
        parts.append(page[at:])
    flush()
    return out


def path_ratios(blocks: list[tuple[str, _Element]]) -> tuple[np.ndarray, np.ndarray]:
    """For each block the mean text length and the mean punctuation of its path."""
    _, which = np.unique([e.path for _, e in blocks], return_inverse=True)
    chars = np.array([len(t) for t, _ in blocks], float)
    marks = np.array([len(_PUNCT.findall(t)) for t, _ in blocks], float)
    count = np.bincount(which)
    return (np.bincount(which, chars) / count)[which], (np.bincount(which, marks) / count)[which]


_BYLINE = 60
_REPLY = re.compile(r"\b(?:reply|replies|says|said|wrote|ago|\d{1,2}:\d\d|\d{4})\b", re.I)


def own_section(part: _Element, inside: list[tuple[str, _Element]]) -> bool:
    """Whether a part named by a subject is a section of the article: it opens with a heading and is no list of entries."""
    if inside[0][1].tag not in _TITLES:
        return False
    entries: dict[int, dict[_Element, str]] = {}
    for text, e in inside:
        node = e.parent if e.tag not in ("li", "div", "article") else e
        if node is not part and node.depth > part.depth:
            entries.setdefault(node.path, {}).setdefault(node, text)
    return not any(len(found) > 1 and 2 * sum(len(t) < _BYLINE and bool(_REPLY.search(t)) for t in found.values()) >= len(found) for found in entries.values())


def without_named(blocks: list[tuple[str, _Element]]) -> list[tuple[str, _Element]]:
    """blocks but for those in parts whose names say that they are not the main text and whose path ratios agree. A name
    lowers a part's ratio to a quarter, or not at all if the word is ambiguous; the part goes if that is below the ratio
    of the unnamed blocks (half of it for an ambiguous word), and whatever its ratio if it names what readers or the site
    added, unless that is a section of the article (own_section). It stays if it holds most of the page's lowered score, or
    is a section that shares its paths with unnamed blocks. If nothing would be left, nothing goes."""
    if not any(e.named for _, e in blocks):
        return blocks
    chars, marks = path_ratios(blocks)
    ratio, size = chars * (1 + marks), np.array([len(t) for t, _ in blocks], float)
    weight = ratio * size
    plain = {e.path for _, e in blocks if not e.named}
    level = [0.0, 0.0]
    own: dict[_Element, list[float]] = {}
    for k, (_, e) in enumerate(blocks):
        mine = own.setdefault(e.named, [0.0, 0.0, 0.0]) if e.named else level
        mine[0] += weight[k]
        mine[1] += size[k]
        if e.named and e.path in plain:
            mine[2] += size[k]
    whole: dict[_Element, list[float]] = {}
    for node, sums in own.items():
        whole[node] = list(sums)
        node = node.parent and node.parent.named
        while node and node not in own and node not in whole:
            whole[node] = [0.0, 0.0, 0.0]
            node = node.parent and node.parent.named
    inward = sorted(whole, key=lambda e: e.depth)
    for node in reversed(inward):
        outer = node.parent and node.parent.named
        if outer:
            whole[outer] = [x + y for x, y in zip(whole[outer], whole[node], strict=True)]
    maybe: dict[_Element, list[tuple[str, _Element]]] = {e: [] for e in whole if e.added == 1}
    for text, e in blocks if maybe else ():
        node = e.named
        while node:
            if node in maybe:
                maybe[node].append((text, e))
                break
            node = node.parent and node.parent.named
    added = {e: e.added == 2 or e.added == 1 and bool(maybe[e]) and not own_section(e, maybe[e]) for e in whole}
    surely: dict[_Element, bool] = {}
    for node in inward:
        outer = node.parent and node.parent.named
        surely[node] = node.certain or added[node] or bool(outer and surely[outer])
    total = level[0] + sum(sums[0] * (0.25 if surely[e] else 1.0) for e, sums in own.items())
    gone: set[_Element] = set()
    for node in inward:
        outer = node.parent and node.parent.named
        if outer in gone:
            gone.add(node)
            continue
        held, length, shared = whole[node]
        most = held * (0.25 if node.certain or added[node] else 1.0) > 0.5 * total
        series = node.tag == "section" and shared * 2 >= length and not added[node]
        common = level[0] / level[1] if level[1] else np.inf
        low = added[node] or held / length < common * (4.0 if node.certain else 0.5)
        if low and not most and not series:
            gone.add(node)
        elif node in own:
            level[0] += own[node][0]
            level[1] += own[node][1]
    return [b for b in blocks if b[1].named not in gone] or blocks


def content_scores(blocks: list[tuple[str, _Element]]) -> np.ndarray:
    """The fused ratio of each block: mean text length times mean punctuation of its path, smoothed over neighbours."""
    chars, marks = path_ratios(blocks)
    kernel = np.array([0.25, 0.5, 0.25])
    smooth = lambda x: np.convolve(np.pad(x, 1, mode="edge"), kernel, "valid")
    return smooth(chars) * (1 + smooth(marks))


def kept_around(region: _Element, blocks: list[tuple[str, _Element]], score: np.ndarray) -> list[bool]:
    """For each block whether it is in the region or belongs to it. Outside, the children of each element around the
    region are taken one by one, from the region outwards: those whose text mostly passes the threshold by its own path
    belong to it; so do headings before what belongs to it and paragraphs right next to it, and the last h1 before a
    region that has none, with what is between them. Around an article or main, within main the same holds, and beyond
    that only other articles whose text passes."""
    chars, marks = path_ratios(blocks)
    passes = chars * (1 + marks) >= 0.5 * score.std()
    chain = []
    node = region.parent
    while node:
        chain.append(node)
        node = node.parent
    level = {e: k for k, e in enumerate(chain)}
    limit = max((level[e] for e in chain if e.main), default=-1) if region.main else len(chain)
    # for each element the level of its ancestor around the region and the child of that it is in; None inside
    known: dict[_Element, tuple[int, _Element] | None] = {region: None}
    groups: list[dict[object, list[int]]] = [{} for _ in chain]
    keep, first = [False] * len(blocks), len(blocks)
    for k, (_, e) in enumerate(blocks):
        node, way = e, []
        while node not in known and node not in level:
            way.append(node)
            node = node.parent
        found = known[node] if node in known else (level[node], way[-1] if way else None)
        for w in way:
            known[w] = found
        if found is None:
            keep[k], first = True, min(first, k)
        else:
            groups[found[0]].setdefault(found[1] or k, []).append(k)
    titled = any(e.tag == "h1" for (_, e), kept in zip(blocks, keep, strict=True) if kept)
    near = {True: True, False: True}
    for at, (around, parts) in enumerate(zip(chain, groups, strict=True)):
        ordered = list(parts.items())
        before = [g for g in ordered if g[1][0] < first]
        after = [g for g in ordered if g[1][0] > first]
        size = lambda g, only: sum(len(blocks[k][0]) for k in g[1] if not only or passes[k])
        content = lambda g: size(g, True) * 2 >= size(g, False)
        take = []
        if at > limit:
            take = [g for g in ordered if isinstance(g[0], _Element) and blocks[g[1][0]][1].header == "main" and content(g)]
        else:
            for g in reversed(before):
                tags = {blocks[k][1].tag for k in g[1]}
                good = content(g) or near[True] and tags <= _TITLES | {"p"}
                if not good and near[True] and around.tag not in ("body", "html") and not titled:
                    # a line such as the author's between the title and the text
                    rest = before[: before.index(g)]
                    good = any(blocks[k][1].tag == "h1" for r in rest for k in r[1]) and size(g, False) < 200
                if "h1" in tags and not titled:
                    good = good or tags <= _TITLES | {"p"}
                    titled = good
                near[True] &= good
                if good:
                    take.append(g)
            chosen = set()
            follows = False
            for i in range(len(after) - 1, -1, -1):
                tags = {blocks[k][1].tag for k in after[i][1]}
                follows = content(after[i]) and not tags <= _TITLES or tags <= _TITLES and follows
                if follows:
                    chosen.add(i)
            for i, g in enumerate(after):
                good = i in chosen or near[False] and around.tag not in ("body", "html") and {blocks[k][1].tag for k in g[1]} == {"p"}
                near[False] &= good
                if good:
                    take.append(g)
        for g in take:
            for k in g[1]:
                keep[k] = True
    return keep


def main_text(page: str | None) -> str:
    blocks = without_named(_blocks(page or ""))
    if not blocks:
        return ""
    score = content_scores(blocks)
    chosen = np.flatnonzero(score >= 0.5 * score.std())
    held: dict[_Element, float] = {}
    for k in chosen:
        node = blocks[k][1]
        while node and node not in held:
            held[node] = 0.0
            node = node.parent
        held[blocks[k][1]] += score[k] * len(blocks[k][0])
    for node in sorted(held, key=lambda e: -e.depth):
        if node.parent:
            held[node.parent] += held[node]
    named = [e for e in held if e.main]
    if named:
        most = max(held[e] for e in named)
        region = max((e for e in named if held[e] >= 0.9 * most), key=lambda e: e.depth)
    else:
        total = sum(score[k] * len(blocks[k][0]) for k in chosen)
        region = max((e for e in held if held[e] >= 0.9 * total), key=lambda e: e.depth)
        while region.tag not in _SCOPE and region.parent:
            region = region.parent
    keep = kept_around(region, blocks, score)

    # an element is outside if a header holds it within the region, with no heading between
    known: dict[_Element | None, bool] = {region: False, None: False}

    def outside(e: _Element) -> bool:
        way = []
        while e not in known and e.tag != "header" and e.tag not in _TITLES:
            way.append(e)
            e = e.parent
        found = known[e] if e in known else e.tag == "header"
        for w in way:
            known[w] = found
        return found

    return "\n".join(t for (t, e), kept in zip(blocks, keep, strict=True) if kept and not outside(e))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, and each page's main text with its length in code points."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in in_slices(whole, "html"):
                texts = [main_text(h) for h in b.column(2).to_pylist()]
                yield pa.record_batch({"page_id": b.column(0), "url": b.column(1).cast(pa.string()), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
