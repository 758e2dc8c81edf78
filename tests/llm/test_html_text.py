import pytest

from cellweave.llm import html_text as H
from cellweave.llm.labelled_pages import labelled_pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header class="site-header"><div>My site</div></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-notice">We use cookies. Accept all of them, please, now.</div><!-- <p>hidden</p> -->
<article><h1>A   title &amp; more</h1><p>First&nbsp;paragraph of the text, which goes on, and on, for some while.<br>Still &lt;first&gt;.
<p title="a>b">Second paragraph, a little shorter. It ends here.</p><aside class="ad">Buy this now, cheap.</aside></article>
<div id="comments"><h3>Comments</h3><div class="comment"><p>I do not agree with this, not at all. Bad.</p></div></div>
<form><label>Search</label><input name=q><button>Go</button></form><footer>&copy; 2020 My site. All rights reserved.</footer></body></html>"""


def test_a_page():
    got = H.main_blocks(PAGE, H.trained())
    assert got == ["A title & more", "First paragraph of the text, which goes on, and on, for some while. Still <first>.", "Second paragraph, a little shorter. It ends here."]


def test_held_out_pages():
    w, moves = H.trained()
    right = total = 0
    for page in labelled_pages(200, 77):
        blocks = H.leaf_blocks(page)
        y = H.decode([sum(w.get(f, 0.0) for f in H.features(b)) for b in blocks], moves)
        right += sum(a == (b.gold == "1") for a, b in zip(y, blocks, strict=True))
        total += len(y)
    assert right / total > 0.97


def test_viterbi_is_the_best_of_all():
    import itertools

    odds, moves = [0.4, -1.2, 0.3, 2.0, -0.1], (-0.7, 0.9, -0.2)

    def value(y):
        s = (moves[2] if y[0] else 0) + sum(o for o, v in zip(odds, y, strict=True) if v)
        return s + sum(moves[1] if a else moves[0] for a, b in zip(y, y[1:]) if b)

    assert tuple(H.decode(odds, moves)) == max(itertools.product((0, 1), repeat=5), key=value)


def test_same_letters_as_another_parser():
    from html.parser import HTMLParser

    class Letters(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.hidden = [], []

        def handle_starttag(self, tag, attrs):
            if tag in H.HIDDEN:
                self.hidden.append(tag)

        def handle_endtag(self, tag):
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(data)

    for page in [PAGE, *labelled_pages(150, 91)]:
        other = Letters()
        other.feed(page)
        other.close()
        assert "".join("".join(b.text for b in H.leaf_blocks(page)).split()) == "".join("".join(other.out).split())


def test_a_head_without_end():
    model = H.trained()
    assert H.main_blocks(PAGE.replace("</head>", ""), model) == H.main_blocks(PAGE, model)
    assert H.main_blocks(PAGE.replace("</head><body>", ""), model) == H.main_blocks(PAGE, model)


def test_weights_of_ancestors_add_up():
    weights, _ = H.trained()
    for page in [PAGE, "<div class='a b'>x" * 300, *labelled_pages(20, 5)]:
        blocks, odds = H.emissions(page, weights)
        plain = [sum(weights.get(f, 0.0) for f in H.features(b)) for b in H.leaf_blocks(page)]
        assert len(blocks) == len(plain) and all(abs(a - b) < 1e-4 for a, b in zip(odds, plain))


def test_deep_pages_take_time_in_proportion():
    import time

    took = []
    for n in (4000, 32000):
        start = time.perf_counter()
        assert len(H.leaf_blocks("<div class='a'>x" * n, {})) == n
        took.append(time.perf_counter() - start)
    assert took[1] < 30 * took[0] + 1


def test_awkward_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "u", "<p"), (3, "u", "plain words only, nothing else here."), (4, "u", "<" * 2000), (5, "u", "<div>" * 3000 + "x"), (6, "u", "<a title='x" * 50)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "page_id long, url string, html string, id string, n_chars int, text string")
    got = H.extract(df).collect()
    assert len(got) == len(rows) and all(r.text == "" for r in got if r.page_id in (1, 2)) and all(r.n_chars == len(r.text) for r in got)
    assert H.extract(df.limit(0)).count() == 0


#: Malformed pages, and their blocks written by hand.
MALFORMED = {
    "<p title=it's>Hello one</p><p>second paragraph</p><p>don't drop me</p><p>four</p>": ["Hello one", "second paragraph", "don't drop me", "four"],
    "<p>a<!-->b</p><p>c</p>": ["ab", "c"],
    "<p>a<!--->b</p><p>c</p>": ["ab", "c"],
    "<p>a<!-- x --!>b</p><p>c</p>": ["ab", "c"],
    "<p>a<!-- > -- - -> -->b": ["ab"],
    "<p>a<!---->b": ["ab"],
    "<p>a<!x>b<?php y ?>c</ z>d</>e": ["abcde"],
    "<select><option>x<p>para</p><h2>head</h2>": ["para", "head"],
    "<select><option>x</option></select><p>one<select><option>y<p>two</p><select><option>z</select><p>three": ["one", "two", "three"],
    "<p>a</p><button>go<p>b</p><div>c</div>": ["a", "b", "c"],
    "<button><p>go</p></button><p>b</p>": ["b"],
    "<p>one</p><audio src=x><p>two</p><video src=y><p>three</p>": ["one", "two", "three"],
    "<audio src=x>your browser</audio><p>two</p>": ["two"],
    "<p>a <svg/> b</p><p>c <svg viewBox='0 0 1 1' /> d</p>": ["a b", "c d"],
    "<p>a <svg><path d='M0'/><title>t</title></svg> b</p>": ["a b"],
    "<p>a <svg><path d='M0'> b</p><p>c</p>": ["a", "c"],
    "<head><title>T</title>Body text<p>p</p>": ["Body text", "p"],
    "<head><title>T</title> <meta charset=x> <p>p</p>": ["p"],
    "<head><style>x</style></head>\n<p>p": ["p"],
    "<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold": ["Let x=2 hold"],
    "<p>Let <math><semantics><mi>x</mi><annotation encoding='t'>\\x</annotation></semantics></math> hold": ["Let x hold"],
    '<p class="a"b="c">x</p><p id=a"b>y</p>': ["x", "y"],
    "<p class='a>b'>x</p><p title='a\"b'>y": ["x", "y"],
    "<p title=\"never closed>x</p><p>y</p>": ["x", "y"],
    "<p title='never closed>x</p><p>y</p>": ["x", "y"],
    "<p title = 'spaced > out' >x<p title=>y<p =a>z": ["x", "y", "z"],
    "<p>1 < 2 and 3 > 2, a<b>c</b> <3 </p>": ["1 < 2 and 3 > 2, ac <3"],
    "<p/>x<div/>y": ["x", "y"],
    "<p>x<br/>y<hr>z": ["x y", "z"],
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": ["a", "b", "c", "d"],
    "<table><tr><td>a<td>b<tr><th>c</table>": ["a", "b", "c"],
    "<p>a<script>if (a < b) '</p>'</script >b<style>p{}</style/>c": ["abc"],
    "<p>a<script>x</scripty></script>b": ["ab"],
    "<p>a</p><textarea><p>b</textarea><p>c": ["a", "c"],
    "<P CLASS=X>a</P><DIV>b": ["a", "b"],
    "<p>a</div></span></p>b<p>c": ["a", "b", "c"],
    "<b><p>a</b>b</p>c": ["ab", "c"],
    "<object data=x><p>a</p><p>b": ["a", "b"],
    "<template><p>no</p></template><p>a<template>b<p>c": ["a", "c"],
    "a<p": ["a"],
    "<p>a<": ["a<"],
    "<p>a &amp b &nosuch; &#x41;&#66; &lt;p&gt;": ["a & b &nosuch; AB <p>"],
}


@pytest.mark.parametrize("page", MALFORMED)
def test_malformed_pages(page):
    assert [b.text for b in H.leaf_blocks(page)] == MALFORMED[page]


@pytest.mark.parametrize("odd", ["title=it's", "data-x=\"a>b\"", "title='"])
def test_an_article_with_odd_tags_is_whole(odd):
    model = H.trained()
    whole = H.main_blocks(PAGE, model)
    for change in (PAGE.replace("<h1>", f"<h1 {odd}>"), PAGE.replace("<article>", "<article><!-->"), PAGE.replace("Second paragraph", "Second <svg/>paragraph"), PAGE.replace("<h1>", "<select><option>x<h1>")):
        assert H.main_blocks(change, model) == whole


def test_many_elements_left_open_take_time_in_proportion():
    import time

    took = []
    for n in (4000, 32000):
        start = time.perf_counter()
        H.leaf_blocks("<select><option>x<button>y<p title='a>z" * n, {})
        took.append(time.perf_counter() - start)
    assert took[1] < 30 * took[0] + 1
