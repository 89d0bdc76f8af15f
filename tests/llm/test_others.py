"""Operators on URLs, pages and vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.llm import html_text, registry, url_filter, vector_dup
from tests.conftest import DATA


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i, ch in enumerate(rest) if ch in "/?#"]
    at = ends[0] if ends else len(rest)
    path = rest[at:]
    for k, ch in enumerate(path):
        if ch in "?#":
            path = path[:k]
            break
    return rest[:at].translate({c: c + 32 for c in range(65, 91)}), path


def brute_rule(host, path):
    best = None
    for rule, verdict in url_filter.RULES:
        domain, prefix = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + prefix) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return best


URLS = [
    None, "", "nothing", "http://", "http://A.Example.ORG", "http://a.example.org/", "https://example.org/en/15", "https://x.example.org/es/1?q=/fr/", "http://notexample.org/es/",
    "ftp://m.COM/fr/x#y", "http://com/de/", "http://a.com?x=/de/", "http://a.com/DE/", "x://y://z/fr/", "http://a.net/b\nc?d", "http://É.com/fr/é",
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(URLS * 2)], "page_id long, url string, grams string").withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "verdict", "p_allow", "h", "row")})
    got = url_filter.filter_urls(df).collect()
    assert len(got) == len(URLS) * 2
    for r in got:
        host, path = brute_parts(r["row"]["url"])
        assert (r["host"], r["path"]) == (host, path) and r["row"]["verdict"] == "clash", r["row"]["url"]
        rule = brute_rule(host, path)
        assert (r["rule"], r["verdict"]) == rule if rule else (r["rule"] is None and r["verdict"] in ("allow", "block")), r["row"]["url"]
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(df.filter("page_id = 2")).collect()} == {"allow"}
    known = spark.createDataFrame([("http://a.bad/x", "block")], "url string, verdict string")
    assert {r["verdict"] for r in url_filter.filter_urls(df.filter("page_id = 2"), known).collect()} == {"block"}


def test_url_model_learns(spark):
    rng = random.Random(1)
    rows = [(f"http://{rng.choice(['casino', 'pills'])}{rng.randint(0, 99)}.net/win{i}", "block") for i in range(200)] + [(f"http://{rng.choice(['news', 'blog'])}{rng.randint(0, 99)}.net/story{i}", "allow") for i in range(200)]
    known = spark.createDataFrame(rows, "url string, verdict string")
    test = spark.createDataFrame([("http://casino777.net/win", "block"), ("http://blog7.net/story", "allow")], "url string, want string")
    assert all(r["verdict"] == r["row"]["want"] for r in url_filter.filter_urls(test, known).collect())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header>Top</header><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice">We use</div><div id="main-content"><article><header><h1>Head &amp; line</h1></header><p>One <b>two<br>three <span class="ad">BUY</span> four<p>Five&nbsp;six&#33;
<div class=related-posts>More</div><ul><li>a<li>b</ul><form>f</form><footer>foot</footer></article><section id="comments"><article class="comment"><p>First!</p></article></section></div><aside>side</aside><footer>&copy;</footer></body></html>"""


def kept(page):
    return [t for _, t, prior, _ in html_text.blocks(page) if not prior]


@pytest.mark.parametrize("piece", ['<a "', "<div>", "</section><div>", "<!", "<p <", "<a 'x>", "<b", "<li><p>x", "<script>"])
def test_html_is_read_in_linear_time(piece):
    import time

    def took(n):
        began = time.perf_counter()
        html_text.blocks(piece * n)
        return time.perf_counter() - began

    took(100)
    assert took(40_000) < 12 * max(took(8_000), 0.02)


def test_html_blocks():
    assert kept(PAGE) == ["Head & line", "One two three four", "Five six!", "a", "b"]
    assert kept("plain &lt; text") == ["plain < text"]
    assert html_text.blocks("") == [] and kept("<") == ["<"] and html_text.blocks("<!-- open") == []
    assert kept("<main><p>in</p></main><p>out</p>") == ["in"]
    assert len(html_text.blocks("<p>x" * 20_000)) == 20_000


def test_style_tree_removes_what_repeats(spark):
    pages = [(i, f"http://h.com/{i}", f"<article><h1>Title {i}</h1><p>Body {i} of text</p><div class=box><p>Share this story</p></div></article>") for i in range(40)]
    pages += [(100 + i, f"http://copy.com/{i}", "<article><h1>Same</h1><p>same</p></article>") for i in range(40)] + [(200, None, None), (201, "x", ""), (202, "http://h.com/z", "<p>alone</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("low", F.lit(1))
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert got[3] == "Title 3\n\nBody 3 of text" and got[105] == "Same\n\nsame" and got[200] == "" == got[201] and got[202] == "alone"
    assert html_text.extract(df.limit(0)).count() == 0


def test_style_tree_keeps_copies_and_own_text(spark):
    pages = [(i, f"http://a.com/{i}", f"<article><h1>Title {i}</h1><p>Body {i}</p></article>") for i in range(100)]
    pages += [(100 + i, f"http://a.com/c{i}", "<article><h1>Copy</h1><blockquote>Quoted</blockquote></article>") for i in range(12)]
    pages += [(200 + i, f"http://b.com/{i}", f"<article><p>Body {i}</p><ul><li>{'Own item' if i == 3 else 'Share'}</ul></article>") for i in range(10)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert all(got[100 + i] == "Copy\n\nQuoted" for i in range(12)) and got[7] == "Title 7\n\nBody 7"
    assert got[203] == "Body 3\n\nOwn item" and got[204] == "Body 4"


def test_noise_around_the_article():
    of = kept
    assert of("<div class=has-sidebar><p>menu</p><main><p>in</p></main></div>") == ["in"]
    assert of("<form id=aspnetForm><p>top</p><article><p>in</p><form>f</form></article></form>") == ["in"]
    assert of("<div class=with-ads><article><p>the long article</p></article></div><p>short</p>") == ["the long article"]
    assert of("<article><p>the long article</p></article><div class=related><article>tease</article></div>") == ["the long article"]
    assert of("<nav><article>a</article></nav><p>b</p>") == ["b"]


def test_tree_alone_removes_menus_adverts_and_footers(spark):
    """Ablation: without the prior, the tree takes what repeats out of the hosts with enough pages and leaves the articles."""
    import re

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")
    got = {r["page_id"]: set(r["text"].split("\n\n")) for r in html_text.extract(pages, prior=False).collect()}
    rows = pages.toPandas()
    hosts = rows.url.str.extract(r"://([^/]*)")[0]
    many = rows[hosts.map(hosts.value_counts()) >= 120]
    left, of, own, whole = 0, 0, 0, 0
    for i, page in zip(many.page_id, many.html):
        for _, text, _, inside in html_text.blocks(page):
            if inside:
                own, whole = own + (text in got[i]), whole + 1
            else:
                left, of = left + (text in got[i]), of + 1
    assert of > 2000 and left < 0.1 * of and own > 0.99 * whole, (left, of, own, whole)


def test_other_templates(spark):
    def page(i):
        menu = "".join(f"<li><a href=/{k}>Section {k}</a>" for k in range(5))
        body = "".join(f"<div class=txt>Paragraph {i} {k} of its own</div>" for k in range(1 + i % 7))
        return f"<table><tr><td class=left><ul>{menu}</ul><td class=mid><h2>Story {i}</h2>{body}<tr><td class=low>All rights reserved</table>"

    df = spark.createDataFrame([(i, f"http://t.com/{i}", page(i)) for i in range(60)], "page_id long, url string, html string")
    for r in html_text.extract(df).collect():
        i = r["page_id"]
        assert r["text"] == "\n\n".join([f"Story {i}", *(f"Paragraph {i} {k} of its own" for k in range(1 + i % 7))]), r["text"]


def test_html_query(spark):
    import html
    import re

    got = {r["page_id"]: r for r in registry.queries()["op5_html_text"](spark, DATA).collect()}
    for p in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", p["html"], re.S)[1]
        want = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:h1|p)>", re.sub(r"<br>|</?b>", " ", body))]
        text = "\n\n".join(x for x in want if x)
        assert got[p["page_id"]]["text"] == text and got[p["page_id"]]["n_chars"] == len(text) and got[p["page_id"]]["url"] == p["url"]


def test_e8_points():
    x = np.random.Generator(np.random.PCG64(1)).normal(0, 2, (500, 8))
    p = vector_dup.e8(x) / 2
    assert np.allclose(p.sum(1) % 2, 0)
    near = np.array([((x[i] - p[i]) ** 2).sum() for i in range(500)])
    around = vector_dup._minimal_vectors()
    assert len(around) == 240 and np.allclose((around**2).sum(1), 2)
    best = np.array([((x[i] - (p[i] + around)) ** 2).sum(1).min() for i in range(500)])
    assert (near <= best + 1e-9).all() and near.max() <= 1 + 1e-9


def test_vectors(spark):
    g = np.random.Generator(np.random.PCG64(2))
    base = g.normal(size=(40, 64))
    rows = []
    for i in range(400):
        v = base[i % 40] + 0.22 * g.normal(size=64)
        rows.append((i, [float(np.float32(x)) for x in v]))
    rows += [(400 + i, rows[7][1]) for i in range(30)]
    rows += [(500, None), (501, [0.0] * 64), (502, [float("nan")] * 64), (503, []), (504, [1.0] * 32), (505, [2.0] * 32), (506, [None] + [1.0] * 63), (507, [float("inf")] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("bucket", F.lit(2)).repartition(3)
    got = {r["vec_id"]: r for r in vector_dup.vector_duplicates(df).collect()}
    x = np.array([r[1] for r in rows[:430]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = (x @ x.T >= 0.95) & ~np.eye(430, dtype=bool)
    found = sum(got[i]["n_links"] for i in range(430))
    assert found >= 0.99 * link.sum() and all(got[i]["n_links"] <= link[i].sum() for i in range(430))
    assert got[7]["n_links"] >= 30 and got[405]["component_id"] == got[7]["component_id"]
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in (500, 501, 502, 503, 506, 507))
    assert got[504]["n_links"] == 1 == got[505]["n_links"] and got[505]["component_id"] == 504
    assert vector_dup.vector_duplicates(df.limit(0)).count() == 0


def test_vector_recall(spark):
    d = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    x = np.stack(e.embedding.to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    true = (x @ x.T >= 0.95).sum(1) - 1
    got = registry.queries()["op9_vector_dup"](spark, d).toPandas().set_index("vec_id").n_links.loc[e.vec_id].to_numpy()
    assert (got <= true).all() and got.sum() >= 0.99 * true.sum()


def test_shared_vector_ids(spark):
    one, two, three = ([float(i == k) for i in range(16)] for k in range(3))
    df = spark.createDataFrame([(1, one), (2, two), (5, one), (5, one), (5, two), (5, None), (7, three), (None, one)], "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in vector_dup.vector_duplicates(df).collect())
    assert got == [(0, 0, None, True), (1, 1, 1, True), (2, 1, 1, False), (5, 0, 1, False), (5, 1, 1, False), (5, 1, 1, False), (5, 1, 1, False), (7, 0, 7, True)]


@pytest.mark.parametrize("n", [1_000, 1_000_000, 1_000_000_000])
def test_lattice_designs_find_pairs_and_little_else(n):
    d = vector_dup.design(n)
    g = np.random.Generator(np.random.PCG64(4))
    x, z = g.normal(size=(2, 400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z
    a, b = vector_dup.cells(x, **d), vector_dup.cells(y, **d)
    assert np.mean([np.isin(p, q).any() for p, q in zip(a, b)]) >= 0.97
    met = d["tables"] * ((1 + d["probes"]) ** 2 * (d["scale"] / (2 * np.sqrt(np.pi))) ** 8) ** d["blocks"]
    assert a.shape[1] < 600 and n * met < 6000


@pytest.mark.parametrize("block", [1, 4096])
def test_blocks_count_alike(spark, block):
    g = np.random.Generator(np.random.PCG64(3))
    x = g.normal(size=(30, 16)) * 0.1 + 1
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(0, i, 1 + i % 3, bytearray(v.tobytes())) for i, v in enumerate(x)], "cluster long, node long, n long, vec binary")
    got = {r["node"]: r["links"] for r in vector_dup.count_links(df, 0.97, block).collect()}
    link = (x @ x.T >= 0.97) & ~np.eye(30, dtype=bool)
    n = np.array([1 + i % 3 for i in range(30)])
    assert got == {i: int((link[i] * n).sum()) for i in range(30)}
