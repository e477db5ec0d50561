"""Pages written by hand, not by the training generator."""

import time

import pytest

from lodestrata.llm import html_extract as E

A = "The river rose by two metres in the night, and the lower town was under water before anyone was awake."
B = "It took the council four days to open the road again. Most of the shops stayed closed for a month."
C = "She said that it's the third flood in ten years, and that nobody isn't tired of it."


def _main(source):
    return E.main_texts([source], E.train())[0]


def _texts(source):
    return [t for t in E.Page(source).text if t]


def test_a_news_page():
    page = f"""<!doctype html><html lang=en><head><meta charset=utf-8><title>Flood</title><link rel=stylesheet href=/s.css></head><body>
    <div id=consent class="cookie-notice"><p>We use cookies. <a href=/c>Settings</a> <button>Accept all</button></p></div>
    <header class="site-header"><a href=/>The Paper</a><nav aria-label=Main><ul><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li><li><a href=/w>Weather</a></li></ul></nav></header>
    <main><article><h1>Flood in the lower town</h1><p class="lead">{A}</p><p>{B}</p><blockquote>{C}</blockquote></article>
    <aside class=sidebar><h3>Most read</h3><ol><li><a href=/1>Ten recipes</a></li><li><a href=/2>Match report</a></li></ol></aside></main>
    <section id=comments><h2>2 comments</h2><div class=comment><p>I was there and it was worse than that.</p></div><div class=comment><p>Nobody asked you.</p></div></section>
    <form action=/search><input name=q><button>Search</button></form>
    <footer><p>&copy; 2024 The Paper. All rights reserved.</p></footer><script>track("</p><p>no")</script></body></html>"""
    assert _main(page) == f"Flood in the lower town\n{A}\n{B}\n{C}"


def test_a_blog_in_upper_case_tags_without_end_tags():
    page = f"""<HTML><BODY><DIV CLASS=menu><UL><LI><A HREF=/>Home</A><LI><A HREF=/about>About</A></UL></DIV>
    <DIV CLASS="post content"><H1>Notes</H1><P>{A}<P>{B}<P>{C}</DIV><DIV CLASS=footer>Powered by nothing</DIV></BODY></HTML>"""
    assert _main(page) == f"Notes\n{A}\n{B}\n{C}"


@pytest.mark.parametrize("attribute", ["title=it's", 'title="it\'s"', "title='say \"x\"'", 'data-x="a > b"', "data-x='<p>'", "href=/a?b='c", 'alt=6"', "a=b=c", "=x", "x = y", "disabled"])
def test_quotes_in_attributes_lose_no_text(attribute):
    page = f"<article><h1>Title of it</h1><p {attribute}>{A}</p><p class=x>{C}</p></article>"
    assert _texts(page) == ["Title of it", A, C]
    assert _main(page) == f"Title of it\n{A}\n{C}"


def test_a_quote_that_is_never_closed_leaks_no_markup():
    assert _texts(f"<article><h1>Title</h1><p class=\"a>{A}</p><p>{B}</p></article>") == ["Title", A, B]
    assert _texts(f"<article><h1>Title</h1><p class='a>{A.replace(chr(39), '')}</p><p>{B}</p></article>") == ["Title", A, B]


def test_comments_and_declarations():
    assert _texts("<p>a<!-->b<!--->c<!-- x > y -->d<!---->e<!-- z --!>f<!DOCTYPE x>g<?php 1 ?>h</>i</ x>j") == ["abcdefghij"]
    assert _texts("<p>1 < 2 and 3 > 2 </p>") == ["1 < 2 and 3 > 2"]


def test_formulas_and_fallbacks_stay():
    page = f"<article><h1>Area</h1><p>{A} So <math><mi>a</mi><mo>=</mo><mn>2</mn></math> holds.</p><p>{B}</p></article>"
    assert "So a=2 holds." in _main(page)


@pytest.mark.parametrize("tag, stray", [("div", "section"), ("noscript", "div"), ("svg", "div"), ("table", "ul"), ("li", "p")])
def test_time_is_linear_in_nested_and_stray_tags(tag, stray):
    def seconds(n):
        page = f"<{tag}>" * n + f"</{stray}>" * n + "<tr>" * n + "<li>" * n + "text"
        best = 1e9
        for _ in range(3):
            t = time.perf_counter()
            E.Page(page)
            best = min(best, time.perf_counter() - t)
        return best

    assert seconds(16_000) < 8 * seconds(4_000) + 0.05


def test_many_unclosed_quotes_end():
    for page in ("<p a=\"" * 20_000, "<p a='" * 20_001, "<" * 100_000, "<a =" * 50_000, "<!--" * 50_000, "<a " + "b='" * 50_001):
        t = time.perf_counter()
        E.Page(page)
        assert time.perf_counter() - t < 5


def test_a_page_without_markup_is_kept():
    assert _main("Only text, without any markup at all. It is kept.") == "Only text, without any markup at all. It is kept."


def test_forms_and_buttons_are_never_main_text():
    form = "<form action=/poll><p>Were you there that night?</p><select><option>Yes, I was</option><option>No</option></select><textarea>Tell us</textarea><button>Vote now</button></form>"
    found = _main(f"<article><h1>Flood in the lower town</h1><p>{A}</p>{form}<p>{B}</p><button>Show more</button><p>{C}</p></article>")
    assert not any(x in found for x in ("Were you", "Yes, I was", "Tell us", "Vote now", "Show more")) and A in found
