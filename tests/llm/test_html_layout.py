"""Pages that took quadratic time, and layouts that went wrong: preformatted text, options, slashes, spans."""

import random
import time

import pytest

from tidemark.llm import html

PAGES = {
    "ends behind a scope": lambda n: "<i><table><tr><td>" + "<b>" * n + "</i>" * n,
    "paragraph behind a button": lambda n: "<p><button>" + "<b>" * n + "<div></div>" * n,
    "spans to the end": lambda n: "<table>" + "<tr><td rowspan=65534>x" * n,
    "wide spans": lambda n: "<table>" + "<tr><td colspan=1000 rowspan=9>x<td>y" * n,
    "spans of all lengths": lambda n: "<table>" + "".join(f"<tr><td rowspan={3 + i * 7 % 5000}>x<td>y" for i in range(n)),
    "cells of many lines": lambda n: "<table><tr><td>" + "a<br>" * n + "<td>" + "b<br>" * (n // 2),
    "nested and mixed": lambda n: ("<div><p>a<ul><li>b<table><tr><td rowspan=2>c<td><pre>d\n\ne</pre><tr><td>f</table></ul>" + "<span hidden/>g</span></div>") * n,
    "options": lambda n: "<select>" + "<option>a" * n,
    "list behind list": lambda n: "<ul>" + "<li><b><i>" * n + "<ul>" + "<li>x" * n,
}


@pytest.mark.parametrize("name", PAGES)
def test_a_page_of_a_megabyte_takes_linear_time(name):
    def took(size):
        n = size // (len(PAGES[name](100)) // 100)
        page = PAGES[name](n)
        start = time.process_time()
        text = html.to_text(page)
        assert len(text) <= 8 * len(page) + 20_000
        return time.process_time() - start

    small, large = took(100_000), took(1_000_000)
    assert large < 25 * max(small, 0.05) and large < 30, (small, large)


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<pre>line1\n<b>line2</b>", "line1\nline2"),
        ("<pre>\na\n\n\n  b\n</pre>c", "a\n\n\n  b\n\nc"),
        ("<p>x</p><pre>\n\na</pre>", "x\n\n\na"),
        ("<pre>a <b>b</b>  c</pre>", "a b  c"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("<select><optgroup label=g><option>a</optgroup><option>b</select>", "a\nb"),
        ("<div hidden/>secret</div>open", "open"),
        ("a<br/>b<hr/>c<img alt=d />", "a\nb\n\nc d"),
        ("<p/>a<span/>b", "ab"),
        ("<table><tr><td rowspan=3>a<td>b<td rowspan=2>c<tr><td>d<tr><td>e<td>f<tr><td>g</table>", "a  b  c\n   d\n   e  f\ng"),
        ("<table><tr><td>1<td rowspan=2>2<tr><td colspan=2>wide<td>3</table>", "1  2\nwide  3"),
        ("<i><table><tr><td>a</i>b</table>c", "ab\n\nc"),
        ("<p><button>a<div>b</div></button>c", "a\nb\nc"),
    ],
)
def test_layout(source, text):
    assert html.to_text(source) == text


def test_free_columns_match_a_grid():
    """Spanning cells against a grid filled column by column."""
    made = random.Random(8)
    for _ in range(200):
        free, grid = html.Free(), {}
        for row in range(12):
            free.row(row)
            at = 0
            for _ in range(made.randint(0, 4)):
                want = at
                while grid.get(want, 0) > row:
                    want += 1
                assert free.first(at) == want
                across, down = made.randint(1, 4), made.randint(1, 5)
                if down > 1:
                    free.take(want, want + across, row + down)
                    for c in range(want, want + across):
                        if grid.get(c, 0) <= row:
                            grid[c] = row + down
                at = want + across
