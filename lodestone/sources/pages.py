"""Web pages: title, language, links and Markdown of their main part, and breadth-first crawls over a table of pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T, urls
from ..operators.staging import small_side

# Elements by how they are read.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset("script style noscript template svg iframe object select button head".split())
_CHROME = frozenset("nav header footer aside form dialog menu".split())
_BLOCK = frozenset("p div section article main ul ol li table tr td th blockquote pre h1 h2 h3 h4 h5 h6 dl dt dd figure figcaption body hr".split())
_NOISE = re.compile(r"(?i)\b(nav|menu|footer|sidebar|cookie|banner|advert|ad|ads|promo|share|social|comments?|breadcrumb|newsletter|popup)\b")


class _Reader(HTMLParser):
    """Blocks of Markdown with the element each is in; links and the head's facts on the way."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.title, self.lang, self.canonical = base, "", "", ""
        self.links: list[tuple[str, str, bool]] = []
        self.stack: list[tuple[str, bool, bool]] = []  # tag, silent, main
        self.blocks: list[tuple[str, bool]] = []
        self.now: list[str] = []
        self.mark, self.in_title, self.anchor = "", False, None

    def _flush(self) -> None:
        raw = "".join(self.now)
        pre = any(t == "pre" for t, _, _ in self.stack)
        said = raw.strip("\n") if pre else re.sub(r"\s+", " ", raw).strip()
        if said:
            said = f"```\n{said}\n```" if pre else self.mark + said
            self.blocks.append((said, any(m for _, _, m in self.stack)))
        self.now, self.mark = [], ""

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = a.get("lang", "")
        elif tag == "title":
            self.in_title = True
        elif tag == "link" and "canonical" in a.get("rel", ""):
            self.canonical = urljoin(self.base, a.get("href", ""))
        if tag == "a" and a.get("href"):
            self.anchor = [urljoin(self.base, a["href"]), "", "nofollow" in a.get("rel", "")]
        if tag in _BLOCK:
            self._flush()
            if tag in ("p", "li") and any(t == tag for t, _, _ in self.stack) and self.stack[-1][0] == tag:
                self.stack.pop()
            depth = sum(t in ("ul", "ol") for t, _, _ in self.stack)
            self.mark = "#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else "  " * max(0, depth - 1) + "- " if tag == "li" else "> " if tag == "blockquote" else ""
        elif tag == "br":
            self.now.append(" ")
        elif tag == "img" and a.get("alt"):
            self.now.append(a["alt"])
        if tag not in _VOID:
            outer = self.stack[-1] if self.stack else ("", False, False)
            named = f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}"
            silent = outer[1] or tag in _SILENT or tag in _CHROME or "hidden" in a or tag not in ("body", "html", "main", "article") and bool(_NOISE.search(named))
            self.stack.append((tag, silent, outer[2] or tag in ("main", "article") or a.get("role") == "main"))

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag == "a" and self.anchor:
            self.links.append((self.anchor[0], self.anchor[1].strip(), self.anchor[2]))
            self.anchor = None
        if tag in _BLOCK:
            self._flush()
        if any(t == tag for t, _, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if self.anchor:
            self.anchor[1] += data
        if not (self.stack and self.stack[-1][1]):
            self.now.append(data)


def read_page(html: str, url: str) -> dict:
    """What a page says: its main element's blocks where it has one of 200 characters or more, else all blocks."""
    r = _Reader(url)
    r.feed(html)
    r.close()
    r._flush()
    inner = [b for b, main in r.blocks if main]
    text = "\n\n".join(inner if sum(map(len, inner)) > 200 else [b for b, _ in r.blocks])
    words = len(text.split())
    linked = sum(len(t.split()) for _, t, _ in r.links)
    return {"title": r.title.strip(), "lang": r.lang, "canonical": r.canonical, "text": text, "word_count": words, "link_density": round(linked / max(1, words + linked), 4), "links": [{"url": u, "text": t, "nofollow": n} for u, t, n in r.links if u.startswith("http")]}


def extracted(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages' other columns and title, lang, canonical, text (Markdown), word_count, link_density, links and blocked (the
    name of a challenge page, whose text is left empty)."""
    keep = [c for c in pages.columns if c != html]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema)
    new = "title string, lang string, canonical string, text string, word_count int, link_density double, links array<struct<url:string,text:string,nofollow:boolean>>, blocked string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = [read_page("" if b else (h or ""), u or "") for h, u, b in zip(df["_html"], df[url], df["blocked"], strict=True)]
            found = pd.DataFrame(rows, columns=["title", "lang", "canonical", "text", "word_count", "link_density", "links"], index=df.index)
            yield pd.concat([df[keep], found, df[["blocked"]]], axis=1)

    return pages.select(*keep, F.col(html).alias("_html"), urls.interstitial_reason(F.coalesce(html, F.lit(""))).alias("blocked")).mapInPandas(run, f"{schema}, {new}")


def crawl(web: DataFrame, seeds: DataFrame, max_depth: int = 2, thin: int = 40) -> DataFrame:
    """Breadth-first over web (url, html): (url, depth, status) with status kept, thin, duplicate or missing.

    One join per depth: the frontier meets the pages by normalized address, its pages' links are the next one, less what
    was seen. Links marked nofollow and offsite ones are not followed, nor are those of duplicates (equal text, the first
    by depth and address stays) or missing pages."""
    pages = web.withColumn("_key", urls.normalize_url(F.col("url"))).dropDuplicates(["_key"])
    start = seeds.select(urls.normalize_url(F.col("url")).alias("_key"), urls.host(F.col("url")).alias("_site")).distinct()
    frontier, seen = start.withColumn("depth", F.lit(0)), start.select("_key")
    out = None
    for depth in range(max_depth + 1):
        got = frontier.join(extracted(pages), "_key", "left").withColumn("h", T.content_hash(F.col("text"))).checkpoint()
        known = got.where("text is not null and text <> ''")
        if out is not None:
            known = known.join(out.where("status = 'kept'").select("h").distinct(), "h", "left_anti")
        firsts = known.groupBy("h").agg(F.min("_key").alias("_first")).select(F.col("_first").alias("_key"), F.lit(True).alias("_new"))
        status = F.when(F.col("text").isNull(), "missing").when(F.col("_new").isNull() & (F.col("text") != ""), "duplicate").when(F.col("word_count") < thin, "thin").otherwise("kept")
        level = got.join(firsts, "_key", "left").withColumn("status", status).select("_key", "_site", "depth", "h", "status", "links")
        out = level.drop("links") if out is None else out.unionByName(level.drop("links"))
        out = out.checkpoint()
        if depth == max_depth:
            break
        following = level.where("status in ('kept', 'thin')").select("_site", F.explode("links").alias("l")).where("not l.nofollow").select("_site", urls.normalize_url(F.col("l.url")).alias("_key"))
        inside = (urls.host(F.col("_key")) == F.col("_site")) | urls.host(F.col("_key")).endswith(F.concat(F.lit("."), F.col("_site")))
        frontier = following.where(inside).groupBy("_key").agg(F.min("_site").alias("_site")).join(seen, "_key", "left_anti").withColumn("depth", F.lit(depth + 1)).checkpoint()
        seen = seen.unionByName(frontier.select("_key"))
        if frontier.isEmpty():
            break
    return out.select(F.col("_key").alias("url"), "depth", "status")


def sitemap_urls(maps: DataFrame, most: int = 5) -> DataFrame:
    """Addresses that sitemaps name. maps: site, url, body (XML), the first `most` of a site by address. Rows (site, url,
    is_index): entries of an index are further sitemaps, to be read like these."""
    first = maps.withColumn("_n", F.row_number().over(Window.partitionBy("site").orderBy("url"))).where(F.col("_n") <= most)
    places = F.regexp_extract_all("body", F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*([^<\]]+?)\s*(?:\]\]>)?\s*</loc>"), F.lit(1))
    rows = first.select("site", F.explode(places).alias("url"), F.col("body").rlike(r"(?i)<sitemapindex[\s>]").alias("is_index"))
    return rows.withColumn("url", F.replace("url", F.lit("&amp;"), F.lit("&"))).distinct()


def admitted(links: DataFrame, seen: DataFrame, sites: DataFrame, depth: int, max_depth: int = 2, most: int = 1000) -> DataFrame:
    """What a crawl reads next. links: url, depth, nofollow; seen: url; sites: site. Followed links of the sites (or below
    them), not seen, not too deep, each once, the first `most` of a site by address."""
    url = urls.normalize_url(F.col("url"))
    wanted = links.where(~F.col("nofollow") & (F.col("depth") <= min(depth, max_depth))).select(url.alias("url")).distinct().withColumn("_host", urls.host(F.col("url")))
    inside = wanted.join(small_side(sites.select("site").distinct()), (F.col("_host") == F.col("site")) | F.col("_host").endswith(F.concat(F.lit("."), F.col("site"))))
    fresh = inside.join(seen.select(urls.normalize_url(F.col("url")).alias("url")).distinct(), "url", "left_anti")
    return fresh.withColumn("_n", F.row_number().over(Window.partitionBy("site").orderBy("url"))).where(F.col("_n") <= most).select("site", "url")
