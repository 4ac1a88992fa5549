"""Addresses: one form for each page, sites, admission to a crawl, and pages that only challenge the reader."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that do not change a page.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref", "ref_src", "mc_cid", "mc_eid")
# Marks of challenge pages and what they are.
INTERSTITIALS = (
    ("<title>Client Challenge</title>", "Fastly client challenge"),
    ("/_fs-ch-", "Fastly client challenge"),
    ("<title>Just a moment...</title>", "Cloudflare interstitial"),
    ("cf-browser-verification", "Cloudflare interstitial"),
    ("<title>Attention Required!", "Cloudflare block page"),
)
_URL = r"^\s*(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://(?:[^/?#@\s]*@)?([^/?#:\s]*)(?::(\d+))?)?([^?#\s]*)(?:\?([^#\s]*))?(?:#(\S*))?\s*$"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 2))


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, fragment or tracking parameters, sorted query, upper-case escapes."""
    scheme = F.lower(F.regexp_extract(url, _URL, 1))
    scheme = F.when(scheme == "", "https").otherwise(scheme)
    port = F.regexp_extract(url, _URL, 3)
    usual = (port == "") | ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    path = F.regexp_replace(F.regexp_extract(url, _URL, 4), r"/index\.html$", "/")
    pieces = F.split(path, "%")
    path = F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, 2, 10_000), lambda p: F.concat(F.lit("%"), F.when(p.rlike("^[0-9a-fA-F]{2}"), F.concat(F.upper(F.substring(p, 1, 2)), F.substr(p, F.lit(3)))).otherwise(p))), ""))
    pairs = F.filter(F.split(F.regexp_extract(url, _URL, 5), "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*TRACKING))
    query = F.array_join(F.array_sort(F.transform(pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))), "&")
    return F.concat(scheme, F.lit("://"), host(url), F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def same_site(url: Column, of: Column, subdomains: bool = True) -> Column:
    """Whether url is on the host that `of` names, or under it."""
    a, b = host(url), host(of)
    inside = (a == b) | a.endswith(F.concat(F.lit("."), b)) if subdomains else a == b
    return (a != "") & (b != "") & inside


def interstitial_reason(html: Column) -> Column:
    out = F.lit("")
    for mark, name in reversed(INTERSTITIALS):
        out = F.when(html.contains(mark), name).otherwise(out)
    return out


def crawl_verdict(url: Column, depth: Column, seed: Column, max_depth: int = 2, include: str | None = None, exclude: str | None = None) -> Column:
    """The first reason against fetching url, or "ok"."""
    binary = r"(?i)\.(png|jpe?g|gif|webp|svg|ico|pdf|zip|gz|tgz|bz2|xz|7z|rar|mp[34]|m4[av]|avi|mov|webm|wav|ogg|woff2?|ttf|eot|exe|dmg|iso|jar|whl)$"
    path = F.regexp_extract(url, _URL, 4)
    out = F.when(depth > max_depth, "depth").when(~F.lower(F.regexp_extract(url, _URL, 1)).isin("http", "https"), "scheme")
    out = out.when(path.rlike(binary), "binary_ext").when(~same_site(url, seed), "offsite")
    if exclude:
        out = out.when(url.rlike(exclude), "excluded")
    if include:
        out = out.when(~url.rlike(include), "not_included")
    return out.otherwise("ok")
