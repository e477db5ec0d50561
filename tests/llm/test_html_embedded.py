from lodestrata.llm import html_extract as E


def _texts(source):
    p = E.Page(source)
    return [(t, p.tag[p.parent[i]]) for i, t in enumerate(p.text) if t]


LONG = "of the text, long enough to be read as such, with some words more."


def test_self_closed_and_unclosed_graphics_lose_nothing():
    for mark in ("<svg class=i />", "<math/>", "<svg/>", "<svg>", "<math>", "<svg><path d='M0'>", "<svg><title/><style/><script/></svg>", "<svg><svg></svg>"):
        assert E.main_texts([f"<article><h1>Title</h1>{mark}<p>First {LONG}</p><p>Second {LONG}</p></article>"], E.train()) == [f"Title\nFirst {LONG}\nSecond {LONG}"], mark
    assert _texts("<p>a <svg><svg><path/></svg><text>x</text></svg> b</p>") == [("a", "p"), ("x", "svg"), ("b", "p")]
    assert _texts("<div><svg>a<div>b</div></svg>c</div>d") == [("a", "svg"), ("b", "div"), ("c", "div"), ("d", "#root")]


def test_text_of_embedded_elements_is_in_the_tree():
    assert _texts("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == [("so x=2 holds", "p")]
    for tag in ("object", "noscript", "template", "iframe"):
        assert _texts(f"<p>a<{tag} class=k><div>b</div>c</{tag}>d<p>e") == [("a", "p"), ("b", "div"), ("c", tag), ("d", "p"), ("e", "p")], tag
        assert _texts(f"<p>a <{tag}>b<{tag}>c</{tag}>d</{tag}> e") == [("a", "p"), ("b", tag), ("c", tag), ("d", tag), ("e", "p")], tag
    got = E.main_texts([f"<article><h1>Title</h1><p>First {LONG}</p><noscript><p>Second {LONG}</p></noscript><object><p>Third {LONG}</p></object></article>"], E.train())
    assert got == [f"Title\nFirst {LONG}\nSecond {LONG}\nThird {LONG}"]


def test_embedded_elements_without_text_do_not_cut_a_run():
    assert _texts("<p>a <svg viewBox='0'><g><path d='M0'/></g><title>no</title></svg>b <noscript><img src=x></noscript>c <iframe src=x></iframe>d</p>") == [("a b c d", "p")]


def test_scripts_and_styles_are_passed_over():
    assert _texts("<p>a<script>x</p>y</script>b<style>p{}</style><noscript><style>q</style></noscript></p>") == [("ab", "p")]


def test_deep_graphics_end():
    E.Page("<svg>x" * 20_000 + "</svg>" * 20_000)
    assert _texts("<svg>" * 3000 + "</svg>" * 3000 + "<p>a") == [("a", "p")]


def test_tokens_come_from_ancestors_at_any_depth():
    for depth in (3, 80, 3000):
        page = E.Page('<article class="story"><nav>' + "<div>" * depth + "<p>deep")
        got, tags = E.node_features(page)[1][-1], ["in:article", "in.story", "in:nav", "in:div", "in:p", "in:#root", "parent:p", "own:#text"]
        assert sorted(got) == sorted({E._bucket(x) for x in tags})
