import itertools

import numpy as np

from lodestrata.llm import html_extract as E

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li><li><a href="/b">Other</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy this now.</div>
<article><h1>The  title &amp; more</h1><p>First paragraph of the text, with &lt;signs&gt; and
 a <a href="/x">link</a> inside, long enough to be read.<p>Second one, not closed, <b>bold</b>, and of some length too, it is.<br></article>
<aside><h4>Related</h4><ul><li><a href="/r">Read more</a></li></ul></aside><footer>&copy; Someone</footer></body></html>"""
MAIN = "The title & more\nFirst paragraph of the text, with <signs> and a link inside, long enough to be read.\nSecond one, not closed, bold, and of some length too, it is."


def test_page_tree():
    p = E.Page("<div>a<p>b <i>c</i><p>d<ul><li>e<li>f</ul>g</div>h")
    assert [(t, p.tag[p.parent[i]]) for i, t in enumerate(p.text) if t for t in [t]] == [("a", "div"), ("b c", "p"), ("d", "p"), ("e", "li"), ("f", "li"), ("g", "div"), ("h", "#root")]
    assert all(p.parent[i] < i for i in range(len(p.parent)))


def test_broken_pages_end():
    for source in ["", "<", "<p", "a < b > c", "</p></p>x", "<script>never closed", "<p>&am", "<!-- open", "<a href='x>y", "<p " * 50, "<table><td>x<p>y</table>z", "<div>" * 3000 + "deep"]:
        E.Page(source)
    assert "a < b > c" in E.Page("<p>a < b > c").text
    assert isinstance(E.main_texts(["<div>" * 20_000 + "deep"], E.train())[0], str)


def test_main_text_of_a_page():
    assert E.main_texts([PAGE, None, "", "<nav>only</nav>"], E.train())[:3] == [MAIN, "", ""]


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(2, 9))
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        odds = rng.standard_normal(n).round(2)
        odds[0] = abs(odds[0])
        got = E.decode(parent, odds)
        ok = [c for c in itertools.product([False, True], repeat=n) if c[0] and all(not c[i] or c[parent[i]] for i in range(1, n))]
        best = max(sum(o for o, k in zip(odds, c) if k) for c in ok)
        assert tuple(got) in ok and abs(sum(o for o, k in zip(odds, got) if k) - best) < 1e-9


def test_held_out_pages():
    rng, forest, right = np.random.default_rng(77), E.train(), 0
    for _ in range(100):
        source, main = E.training_page(rng)
        right += E.main_texts([source], forest)[0] == "\n".join(" ".join(E.html_.unescape(t).split()) for t in main)
    assert right >= 90


def test_training_is_repeatable():
    a = E.train(seed=5, pages=12)
    E._TRAINED.clear()
    b = E.train(seed=5, pages=12)
    assert all(np.array_equal(x, y) for s, t in zip(a.trees, b.trees) for x, y in zip(s, t))


def test_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "", "", "y"), (3, "u", "<article>" + "<p>some words of text here, more of them.</p>" * 3000 + "</article>", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, source string")
    got = E.with_main_text(pages, E.train(), name="text").collect()
    assert [r["text"] for r in got][:4] == [MAIN, MAIN, "", ""] and got[4]["text"].count("\n") == 2999
    assert [r["source"] for r in got] == ["x", "x", None, "y", "z"]
    assert E.with_main_text(pages.limit(0), E.train()).count() == 0
