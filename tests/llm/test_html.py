import random
import re
import time

import pytest

from lakecat.llm.html import extracted, render

CASES = {
    "": "",
    "plain": "plain",
    "<p>one<p>two": "one\n\ntwo",
    "<div>a</div><div>b  c</div>": "a\nb c",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<ul><li>x<ul><li>y<li>z</ul><li>w</ul>": "- x\n  - y\n  - z\n- w",
    "<ol start=3><li>k<li value=9>l</ol>": "3. k\n9. l",
    "<table><tr><th>Name<th>Qty<tr><td>Apple pie<td>2</table>": "Name      | Qty\nApple pie | 2",
    "<table><tr><td rowspan=2>r<td>1<tr><td>2</table>": "r | 1\n  | 2",
    "<table><tr><td colspan=2>wide cell<tr><td>a<td>b</table>": "wide cell\na | b",
    "<title>t</title><script>x<p></script><style>p{}</style>a<!-- c -->b": "ab",
    "<p hidden>a</p><p style='display:none'>b</p><p>c</p>": "c",
    "<div style='visibility:hidden'>a<b style='visibility:visible'>b</b></div>": "b",
    "<style>.x, #y {display:none} em{visibility:hidden}</style><p class='w x'>a</p><p id=y>b</p><em>c</em>d": "d",
    "<details><summary>s</summary>t</details><details open><summary>u</summary>v</details>": "s\nu\nv",
    "<pre>\n a\n   b</pre>": " a\n   b",
    "5 < 6 &amp; 7 &lt; 8 &copy;": "5 < 6 & 7 < 8 ©",
    "<b>a</i>b</b>c": "abc",
    "<input value=v><input type=hidden value=h>": "v",
    "<dl><dt>t<dd>d</dl>": "t\nd",
}


@pytest.mark.parametrize("page", CASES)
def test_layout(page):
    assert render(page) == CASES[page]


@pytest.mark.parametrize("page", ["<", "<a", "</", "<!", "<!--x", "<table><td>x", "<li>" * 3000 + "d", "<div>" * 5000 + "x", '<ol start="999999999999999999999"><li>q', '<td colspan="9999999">a</td>', "<tr><td rowspan=99999999>b", '<a href="x>y', "</p></p></td>"])
def test_malformed_pages_do_not_fail(page):
    render(page)


def test_null_pages_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, None, "t"), (None, "<p>a", "t"), (None, "<p>a", "t")], "page_id long, html string, text string")
    out = extracted(rows)
    assert sorted((r.page_id or 0, r.text) for r in out.collect()) == [(0, "a"), (0, "a"), (1, "")]
    assert extracted(rows.where("false")).count() == 0


LOOSE = {
    "<table><tr><form><td>a</td><td>b</td></form></tr><tr><td>c<td>d</table>": "a | b\nc | d",
    "<table><form><tr><td>a<td>b</tr></form></table>": "a | b",
    "<table><tr><div>x <b>y</b></div><td>a</td></tr></table>": "x y\na",
    "<table><tr>loose<td>a</td>more</tr></table>": "loose\nmore\na",
    "<table><tr><td>a</td><div hidden>h</div><form style='display:none'><td>n</td></form></tr></table>": "a",
    "<table><tr><div><table><tr><td>in</table></div><td>out</table>": "in\nout",
    "<html><head><title>t</title><meta charset=x>text<p>more": "text\n\nmore",
    "<head> <title>t</title> <p>p": "p",
}


@pytest.mark.parametrize("page", LOOSE)
def test_text_outside_cells_and_after_an_open_head_is_kept(page):
    assert render(page) == LOOSE[page]


STYLED = {
    "<style>.x{display:none}</style><p class=x style='display:block'>a</p><p class=x>b</p>": "a",
    "<style>.a{display:none} .b{display:block}</style><p class='a b'>s</p><p class='b a'>t</p><p class=a>h</p>": "s\n\nt",
    "<style>.b{display:block} .a{display:none}</style><p class='a b'>h</p>s": "s",
    "<style>#i{display:block} p.a{display:none}</style><p id=i class=a>s</p>": "s",
    "<style>.a{display:none!important} #i{display:block}</style><p id=i class=a style='display:block'>h</p>s": "s",
    "<style>@media print{.nav{display:none}} @media screen{.h{display:none}}</style><p class=nav>s</p><p class=h>h</p>": "s",
    "<style media=print>p{display:none}</style><p>s": "s",
    "<style>@media (max-width:9px){.n{display:none} .o{display:block}} /* { */ .q{display:none}</style><p class=n>s</p><p class=q>h</p>": "s",
    "<style>.tab{display:none} .tab.active{display:block}</style><p class=tab>h</p><p class='tab active'>s</p>": "s",
    "<style>.m{display:none} nav > .m[open]{display:block}</style><p class=m>s</p>": "s",
    "<style>.m{display:none} .m:hover{display:block} .m::before{display:block}</style><p class=m>h</p>s": "s",
    "<style>.v{visibility:hidden} .v.w{visibility:visible}</style><p class=v>h<b class='v w'>s</b></p>": "s",
    "<p hidden style='display:block'>s</p><p hidden>h</p>": "s",
    "<style>.x{display:none</style><p class=x>h</p>s": "s",
    "<style>@import url(a); @font-face{src:x} .x{display:none; color:red;}</style><p class=x>h</p>s": "s",
}


@pytest.mark.parametrize("page", STYLED)
def test_visibility_follows_the_cascade(page):
    assert render(page) == STYLED[page]


@pytest.mark.parametrize("page", ["<table><div>" * 300 + "x", "<table><tr><div>" * 300 + "x", "<table><tr><form><td>" * 200 + "x", "<style>" + "@media screen{" * 3000 + "p{display:none}</style>x", "<style>}}{;{p{</style>x"])
def test_deep_tables_and_odd_sheets_keep_their_text(page):
    assert render(page).endswith("x")


@pytest.mark.parametrize("odd", ["<a x", "<a x='", '<a "', "<a x\"y'", "<", "</", "<!--", "<p title='a\">", "<script>", "<b>", "</b>", "<table><tr>", "<li>", "&amp", "<style>.a{", "<td><p>"])
def test_long_malformed_pages_take_linear_time(odd):
    def took(n):
        page = odd * (n // len(odd)) + "'"
        began = time.process_time()
        render(page)
        return time.process_time() - began

    took(1000)
    assert took(1_000_000) < 8


def test_against_trees_whose_text_is_known():
    """Random pages that are written with the text that a reader sees, in order."""
    rng = random.Random(4)
    word = iter(f"w{i}" for i in range(10**9)).__next__

    def made(depth):
        """(source, words that are visible)"""
        kind = rng.randrange(9 if depth < 5 else 2)
        if kind == 0:
            w = word()
            return w + " ", [w]
        if kind == 1:
            return rng.choice([f"<!-- {word()} > -->", f"<script>if (a < b) '{word()}'</script>", f"<style>{word()}</style>", f"<template><p>{word()}</p></template>", "<br>", "<img alt='x'>", "\n\t "]), []
        inner = [made(depth + 1) for _ in range(rng.randrange(4))]
        source, seen = "".join(s for s, _ in inner), [w for _, ws in inner for w in ws]
        if kind == 2:
            return f"<div {rng.choice(['hidden', 'style=\"display: none\"', 'class=gone'])}>{source}</div>", []
        if kind == 3:
            return f"<ul><li>{source}</ul>", seen
        if kind == 4:
            return f"<div title='a > b'>{source}</div>", seen
        if kind == 5:
            return f"<section>{source}</section>", seen
        if kind == 6:
            return f"<table><tr><td>{source}</td></tr></table>", seen
        if kind == 7:
            return f"<em class=\"x\">{source}</em>", seen
        return f"<blockquote>{source}", seen

    for _ in range(150):
        source, seen = made(0)
        page = f"<html><head><title>{word()}</title><style>.gone {{ display: none }}</style></head><body>{source}</body></html>"
        text = render(page)
        assert re.findall(r"w\d+", text) == seen, page
