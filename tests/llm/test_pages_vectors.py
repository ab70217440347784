"""Site style trees and exact top-k: odd inputs, brute force, planted structure."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiersmith.llm import site_tree, top_k

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header class="site">Head</header><nav><ul><li><a href="/a">A</a></li><li>B</li></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies</div><article><header><h1>The &amp;amp; title</h1></header><p>First   <b>bold</b>text<br>line&nbsp;two &lt;3
<p>Second<ul><li>one<li>two</ul><form><p>Mail</p><input name=x></form><section class="comments"><p>reader</p></section>
<p>a &copy &#233; &eacute; &bogus; 5 < 6</p></article><aside>Side</aside><div hidden>hid</div><div id="sidebar">bar</div><footer>Foot</footer></body></html>"""


def test_named_noise_entities_and_misnesting():
    assert site_tree.main_text(PAGE).split("\n") == [
        "The &amp; title", "First boldtext line two <3", "Second", "one", "two", "a © é é &bogus; 5 < 6"]


@pytest.mark.parametrize("page, text", [
    ("", ""), ("   ", ""), ("just text", "just text"), ("<p>a<p>b</div>c", "a\nb\nc"), ("<article><p>open", "open"), ("<script>never closed", ""),
    ("<p title='a>b'>x</p>", "x"), ("<p title='unclosed>x</p>", "x"), ("<!-- open <p>no", ""), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<p>" + "word " * 50_000 + "</p>", ("word " * 50_000).strip()),
    ("<P>UP</P><Br/>x", "UP\nx"), ("<p>one\ttwo\n three</p>", "one two three")])
def test_odd_pages(page, text):
    assert site_tree.main_text(page) == text


def site(n, rng):
    """Pages of one host whose parts have no telling names; copies of one page with a changing frame are among them."""
    menus = [" ".join(f"m{k}{j}" for j in range(4)) for k in range(3)]
    copy = " ".join(f"copied{k}" for k in range(40))
    for k in range(n):
        body = copy if k % 10 == 0 else " ".join(f"w{rng.randrange(5000)}" for _ in range(40))
        yield k, body, (f"<html><body><div class='x1'><div>{menus[k % 3]}</div></div><div class='x2'><p>{body}</p><p>own {k}</p></div>"
                        f"<div class='x3'>All rights {k % 2}</div></body></html>")


def test_repeated_branches_of_a_host_are_removed(spark):
    rng = random.Random(1)
    pages = list(site(60, rng))
    rows = [(k, f"http://u@Host.example.com:80/{k}", h, 1, "x") for k, _, h in pages]
    rows += [(100, "http://host.example.com/5", pages[5][2], 1, "x")] * 40  # exact copies count once
    rows += [(200, "http://lonely.example.org/", pages[1][2], 1, "x"), (201, None, pages[1][2], 1, "x"), (202, "no url", None, 1, "x"), (203, "http://a.b/", "", 1, "x"),
             (None, "http://a.b/", "<p>hi", 1, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, k0 int, host string").repartition(5)
    got = {}
    for r in site_tree.extract(df).collect():
        got.setdefault(r.page_id, set()).add(r.text)
    assert len(site_tree.extract(df, keep=("page_id", "k0", "host")).columns) == 4
    for k, body, _ in pages:
        assert got[k] == {f"{body}\nown {k}"}
    assert got[100] == {f"{pages[5][1]}\nown 5"}
    whole = {f"{' '.join(f'm1{j}' for j in range(4))}\n{pages[1][1]}\nown 1\nAll rights 1"}
    assert got[200] == whole and got[201] == whole and got[202] == {""} and got[203] == {""} and got[None] == {"hi"}
    assert site_tree.extract(df.limit(0)).count() == 0


def test_repeated_branches_inside_article_and_main_are_removed(spark):
    rng = random.Random(7)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(30))
    rows, want = [], {}
    for main in ("main", "article"):
        for k in range(40):
            own = [text(), text()]
            want[f"{main}{k}"] = "\n".join(own)
            rows.append((f"{main}{k}", f"http://{main}.example.com/{k}", f"<html><body><{main}><div><p>{own[0]}</p><p>Pass this on</p><p>{own[1]}</p></div>"
                         f"<div class='x1'><span>Written by</span> author {k % 4}</div><div class='x2'><p>Read more</p><ul><li>one<li>two</ul></div></{main}></body></html>"))
    for k in range(30):  # three near copies of each page: their paragraphs are the text
        if k % 3 == 0:
            own = [text() for _ in range(5)]
        want[f"c{k}"] = "\n".join([*own, f"seen {k}"])
        rows.append((f"c{k}", f"http://copies.example.com/{k}", "<article>" + "".join(f"<p>{x}</p>" for x in own) + f"<p>seen {k}</p></article>"))
    got = {r.page_id: r.text for r in site_tree.extract(spark.createDataFrame(rows, "page_id string, url string, html string").repartition(4)).collect()}
    assert got == want


def brute(rows, every=20, k=20):
    codes = {}
    for i, v in rows:
        if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v):
            codes.setdefault(len(v), []).append((i, [int(np.floor(64 * float(c))) for c in v]))
    out = []
    for vs in codes.values():
        for q, x in vs:
            if q % every == 0:
                best = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in vs if j != q)[:k]
                out += [(q, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("settings", [{}, {"block_queries": 3, "sample": 40}, {"sample": 0}])
def test_top_k_against_brute_force(spark, settings):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 40)).astype(np.float32)
    base[100:160] = base[100]  # many equal vectors: ties go to the smaller id
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(400, None), (420, [None] * 40), (440, [float("nan")] * 40), (460, [float("inf")] * 40), (None, rows[0][1]), (480, []), (481, []), (500, [1.0, 2.0]), (501, [0.5, -1.0]),
             (520, [3e6] * 40), (521, [-2e6] * 40)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, id string").repartition(3)
    got = sorted(tuple(r) for r in top_k.search(df, F.col("vec_id") % 20 == 0, **settings).collect())
    assert got == brute(rows)
    assert top_k.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_exclude_only_beaten_candidates(monkeypatch):
    """With tight bounds most pairs fall out early; what is left holds the best."""
    monkeypatch.setattr(top_k, "GROUP", 7)
    rng = np.random.default_rng(0)
    q, x = np.floor(64 * rng.normal(size=(20, 64)) / 8), np.floor(64 * rng.normal(size=(900, 64)) / 8)
    scores = (q @ x.T).astype(np.int64)
    bounds = np.sort(scores, 1)[:, -20].astype(float)
    query, ids, got = top_k.search_chunk(q, np.full(20, -1), bounds, x.T, np.arange(900))
    assert (scores[query, ids] == got).all() and len(got) == (scores >= bounds[:, None]).sum()
