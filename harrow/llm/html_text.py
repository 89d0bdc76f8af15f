"""HTML extraction with a site style tree.

1. Each page is read into blocks: the text of block elements with the path of elements above it (tag and class), menus,
   notices and footers included. A path is known by a hash.
2. The pages of a host are merged into a style tree: for each path, on how many pages it stands, on how many of them
   each of its texts stands, and how its presentation (its number of blocks and what is around them) spreads. A node's
   importance is 0.9 parts content, 1 less the mean over its texts of log(pages with the text) / log(pages with the node),
   and 0.1 parts presentation, the entropy of its forms over the greatest one. A branch that reads and looks the same page
   after page has little.
3. Of nodes of low importance (under ``low`` inside an article or main element, elsewhere under ``low_outside`` times that
   of the host's most important node, as many copies among a host's pages lower all nodes) the blocks whose text repeats
   are removed from each page of the host. A page's own text stays, whatever its path.
4. What a host's pages cannot tell, few pages or noise that differs from page to page, a prior tells: elements whose
   tag, role or class names say menu, header, footer, sidebar, notice, advert, form or reader comment, and what is outside
   where a page has an article (or else a main element), count so little that they go. A form, or an element that only
   its name calls noise, is none around the article or main. ``prior=False`` leaves everything to the tree.

Pages of a host with equal contents are one page of the tree: they are merged by digest before anything is counted.
Nodes to remove are joined to the pages by host; Spark broadcasts them where they are small and else splits a hot host's
pages. A host's node is judged only if at least ``least_pages`` of its differing pages have it.

Defined cases: null or empty html gives an empty text; pages without a host are not merged; a null url is such a page;
html without tags is one block; unclosed elements end where HTML ends them; a quote that is never closed ends at the
next ``>``; reading takes time linear in the page; other columns are left out of the work.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.shared import arrow_rows, read, staged
from harrow.llm.url_filter import url_host

FORMS = 64  # hash buckets of presentations
SKIPPED = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>", re.S)
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
QUOTED = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
PLAIN = re.compile(r"([^>]*+)>")
CLOSE = {}
ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre",
    "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
NOISE_TAGS = {
    "script", "style", "noscript", "template", "head", "title", "nav", "footer", "aside", "form", "button", "select", "textarea", "iframe", "object", "svg", "math",
    "canvas", "audio", "video", "menu", "dialog", "datalist", "xmp", "noembed", "noframes", "map",
}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar", "status"}
NOISE_NAMES = {
    "nav", "navbar", "navigation", "menu", "submenu", "breadcrumb", "breadcrumbs", "masthead", "topbar", "footer", "sidebar", "aside", "rail", "widget", "widgets",
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertisements", "advertising", "adsense", "banner", "sponsor", "sponsored", "sponsors", "promo",
    "promos", "promotion", "promoted", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "notifications", "alert", "popup", "modal",
    "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "comment", "comments", "reply", "replies", "respond", "disqus", "discussion", "share",
    "sharing", "social", "related", "recommended", "recommendations", "pager", "pagination", "toolbar", "disclaimer",
}
#: What a start tag ends when such an element is open, and the elements that shield it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, set()),
}
SHIELD = {"td", "th", "table", "button", "object", "html", "body", "article", "section", "div", "li", "blockquote"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
FORM, NAMED, NOISE = 1, 2, 3
CAMEL = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")


def _noise(tag: str, attrs: str, in_article: bool) -> tuple[int, str]:
    """How surely an element is noise by itself (FORM and NAMED: unless it holds the article or main), and its class for the path."""
    if tag != "form" and (tag in NOISE_TAGS or tag == "header" and not in_article):
        return NOISE, ""
    form = FORM if tag == "form" else 0
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return form, ""
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)}
    name = a.get("class", "")
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return NOISE, name
    if a.get("role", "").lower() in NOISE_ROLES:
        return NOISE, name
    if tag not in ("html", "body", "main"):
        for word in re.split(r"[^A-Za-z]+", f"{name} {a.get('id', '')}"):
            if word and (word.lower() in NOISE_NAMES or not in_article and word.lower() == "header"
                         or not word.islower() and any(p.lower() in NOISE_NAMES for p in CAMEL.findall(word))):
                return NAMED, name
    return form, name


def _tokens(source: str):
    """(text, None, None, None) and (None, end, tag, attributes) in page order; raw elements are left out. Linear: a scan that fails is not tried again."""
    at, n, broken, closes = 0, len(source), False, True
    while at < n:
        if source[at] != "<":
            to = source.find("<", at)
            to = n if to < 0 else to
            yield source[at:to], None, None, None
            at = to
            continue
        m = NAME.match(source, at)
        if m is None:
            m = SKIPPED.match(source, at) if source.startswith("<!--", at) or source.startswith("<![CDATA[", at) or closes and source[at + 1 : at + 2] in ("!", "?") else None
            if m is None:
                closes = closes and source.find(">", at) >= 0
                yield "<", None, None, None
                at += 1
            else:
                at = m.end()
            continue
        a = QUOTED.match(source, m.end()) if closes and not broken else None
        if a is None and closes:
            broken, a = True, PLAIN.match(source, m.end())
        if a is None:
            closes = False
            yield source[at : m.end()], None, None, None
            at = m.end()
            continue
        at, tag = a.end(), m[2].lower()
        if not m[1] and tag in RAW:
            close = CLOSE.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I)).search(source, at)
            at = close.end()
            continue
        yield None, m[1], tag, a[1]


def blocks(source: str) -> list[tuple[int, str, bool, bool]]:
    """(path, text, prior, inside) of all blocks of a page in page order: whether the prior removes it, and whether it is inside an article or main."""
    found: list[list] = []  # path, text, in article, in main, number of the article inside NAMED, noise
    stack: list[tuple[str, int, bool, bool, int, int]] = [("", 0, False, False, 0, 0)]  # tag, noise, in article, in main, path, number of the article inside NAMED
    opened: Counter = Counter()
    parts: list[str] = []
    place: tuple = ()  # where the block of ``parts`` began
    doubtful = 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append([place[0], text, *place[1:]])
            parts.clear()

    def pop_to(k: int) -> None:
        if any(e[0] in BLOCK for e in stack[k:]):
            flush()
        for e in stack[k:]:
            opened[e[0]] -= 1
        del stack[k:]

    for text, end, tag, attrs in _tokens(source):
        if text is not None:
            _, noise, article, main, path, inner = stack[-1]
            if parts and noise != place[4]:  # inline noise is a block of its own
                flush() if not noise and place[4] else None
            if not parts:
                place = (path, article, main, inner, noise)
            if noise == place[4] or not noise:
                parts.append(html.unescape(text))
            continue
        block = tag in BLOCK
        if end:
            if opened[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        pop_to(k)
                        break
                    if not block and stack[k][0] in BLOCK:
                        break
            continue
        if tag == "br":
            if parts:
                parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if block:
            wanted, shield = ENDS.get(tag, (set(), set()))
            if any(opened[t] for t in wanted):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in wanted:
                        pop_to(k)
                        break
                    if stack[k][0] in shield:
                        break
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p" or tag in HEADINGS and stack[k][0] in HEADINGS:
                    pop_to(k)
                    break
                if stack[k][0] in SHIELD:
                    break
            flush()
        _, noise, article, main, path, inner = stack[-1]
        own, name = _noise(tag, attrs, article)
        if block or own:
            starts_main = tag == "main" or "main" in attrs and 'role="main"' in attrs
            if not own and (starts_main and noise <= NAMED or tag == "article" and noise == FORM):
                noise = 0
            elif not own and tag == "article" and noise == NAMED:
                doubtful += 1
                noise, inner = 0, doubtful
            inside = article or tag == "article" and not (own or noise)
            stack.append((tag, max(noise, own), inside, main or starts_main, _digest(f"{path}>{tag}.{name}"), inner))
            opened[tag] += 1
    flush()
    kept = {id(b) for b in _content([b for b in found if not b[5]])}
    return [(b[0], b[1], id(b) not in kept, b[2] or b[3]) for b in found]


def _content(found: list) -> list:
    """The blocks that count: the articles' or else main's or else all.

    Of the articles inside elements that are noise by name the longest is the article if it is longer than the rest;
    otherwise it is a teaser beside an article, and kept with the rest where there is none.
    """
    firm = [b for b in found if not b[4]]
    articles = [b for b in firm if b[2]]
    body = articles or [b for b in firm if b[3]] or firm
    size: Counter = Counter()
    for b in found:
        if b[4]:
            size[b[4]] += len(b[1])
    if not size:
        return body
    best, longest = size.most_common(1)[0]
    if longest > sum(len(b[1]) for b in body):
        body = articles
    elif articles:
        return body
    kept = {id(b) for b in body}
    return [b for b in found if b[4] == best or id(b) in kept]


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


NODES = "array<struct<path long, prior boolean, inside boolean, form int, texts array<long>>>"


def distinct_pages(pages: DataFrame, prior: bool = True) -> DataFrame:
    """(host, nodes): each content of a host's pages once. For each path of a page its presentation and its texts' digests."""

    def run(batches):
        for b in batches:
            out = []
            for host, source in zip(b["host"], b["html"]):
                if not host or not source:
                    continue
                of: dict[int, list] = {}
                found = blocks(source)
                for k, (path, text, gone, inside) in enumerate(found):
                    node = of.get(path)
                    if node is None:
                        of[path] = node = [k, k, gone and prior, inside and prior, []]
                    node[1], node[2] = k, node[2] and gone
                    node[4].append(_digest(text))
                whole = "\n".join(t for _, t, gone, _ in found if not (gone and prior))
                nodes = []
                for path, (first, last, gone, inside, texts) in of.items():
                    around = f"{found[first - 1][0] if first else ''}|{len(texts)}|{found[last + 1][0] if last + 1 < len(found) else ''}"
                    nodes.append((path, gone, inside, zlib.crc32(around.encode()) % FORMS, sorted(set(texts))))
                out.append((host, _digest(whole), _digest(f"{len(whole)}|{whole}"), nodes))
            yield pd.DataFrame(out, columns=["host", "page", "rest", "nodes"])

    found = pages.select("host", "html").mapInPandas(run, f"host string, page long, rest long, nodes {NODES}")
    return found.groupBy("host", "page", "rest").agg(F.min("nodes").alias("nodes")).select("host", "nodes")


def style_tree(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merged nodes (host, path, pages, prior, inside, content, presentation) and the texts (host, path, text, n): on how many pages of the node each stands."""
    x = distinct.select("host", F.explode("nodes").alias("x")).select("host", "x.*")
    texts = x.select("host", "path", F.explode("texts").alias("text")).groupBy("host", "path", "text").agg(F.count(F.lit(1)).alias("n"))
    log_n = F.sum(F.col("n") * F.log("n"))
    forms = x.groupBy("host", "path", "form").agg(F.count(F.lit(1)).alias("n"), F.min("prior").alias("prior"), F.min("inside").alias("inside"))
    pages = F.sum("n")
    forms = forms.groupBy("host", "path").agg(
        pages.alias("pages"), F.min("prior").alias("prior"), F.min("inside").alias("inside"),
        F.try_divide(F.log(pages) - log_n / pages, F.log(F.least(pages, F.lit(FORMS)))).alias("presentation"))
    spread = texts.groupBy("host", "path").agg((log_n / pages).alias("spread"))
    nodes = forms.join(spread, ["host", "path"]).withColumn("content", 1 - F.coalesce(F.try_divide("spread", F.log("pages")), F.lit(0.0)))
    return nodes.select("host", "path", "pages", "prior", "inside", "content", F.coalesce("presentation", F.lit(0.0)).alias("presentation")), texts


def importance() -> Column:
    return 0.9 * F.col("content") + 0.1 * F.col("presentation")


def repeated_texts(nodes: DataFrame, texts: DataFrame, least_pages: int = 10, low: float = 0.15, low_outside: float = 0.85, share: float = 1 / 256) -> DataFrame:
    """(host, low): for each host its nodes of low importance with the digests of the texts that repeat on them.

    A text repeats if two pages that differ have it, and at least ``share`` of the node's pages; so a node has at most
    1 / share of them for each text of a page. Nodes that the prior removes anyway are left out.
    """
    judged = nodes.filter(F.col("pages") >= least_pages).withColumn("worth", importance())
    best = judged.groupBy("host").agg(F.max("worth").alias("best"))
    weak = judged.filter(~F.col("prior")).join(best, "host").filter(F.col("worth") < F.when(F.col("inside"), low).otherwise(low_outside * F.col("best")))
    x = texts.filter("n >= 2").join(weak.select("host", "path", "pages"), ["host", "path"]).filter(F.col("n") >= F.col("pages") * share)
    x = x.groupBy("host", "path").agg(F.collect_list("text").alias("texts"))
    return x.groupBy("host").agg(F.collect_list(F.struct("path", "texts")).alias("low"))


def extract(pages: DataFrame, prior: bool = True) -> DataFrame:
    """(page_id, url, text) for each row of (page_id, url, html)."""
    spark = pages.sparkSession
    p = pages.select("page_id", "url", "html", url_host(F.col("url")).alias("host"))
    with arrow_rows(spark, 500):
        nodes, texts = style_tree(staged(distinct_pages(p, prior), "html-pages"))
        low = staged(repeated_texts(nodes, texts), "html-low")
        joined = p.join(low, "host", "left").select("page_id", "url", "html", "low")

        def run(batches):
            for b in batches:
                out = []
                for source, weak in zip(b["html"], b["low"]):
                    gone = {x["path"]: set(x["texts"]) for x in weak} if weak is not None else {}
                    out.append("\n\n".join(t for path, t, out_of, _ in blocks(source or "") if not (prior and out_of) and (path not in gone or _digest(t) not in gone[path])))
                yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": out})

        return staged(joined.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "low").mapInPandas(run, "page_id long, url string, text string"), "html-text")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.char_length("text").cast("long"))
