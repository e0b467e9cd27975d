"""Markup that HTML takes as text, and text in svg and math."""

import pytest

from marlstone.llm import html_text

CASES = [
    ("a <été b <b>c</b>", "a <été b c"), ("x <中文 y<p>z", "x <中文 y\n\nz"), ("a</é b>c", "ac"),
    ("<p>a <svg width='1'/> b<p>c", "a b\n\nc"), ("<div><math/>rest</div>more", "rest\nmore"), ("<svg><title/><path d='M0'/><text>one</text><text>two</text></svg> on", "one two on"),
    ("<svg>not shown<defs><text>x</text></defs><desc>y</desc></svg>z", "z"), ("<svg><foreignObject><div/>in</foreignObject></svg>out", "in\nout"), ("<svg><path><p>after</p>", "after"),
    ("<math><mi>x</mi><mo>&lt;</mo><mn>2</mn><mspace/><annotation>x &lt; 2</annotation></math>, yes", "x<2, yes"), ("<math><mtext><![CDATA[a & b]]></mtext><![CDATA[&lt;]]></math>", "a & b&lt;"), ("<svg width=1/>in it", ""),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_html_text(html, text):
    assert html_text.render(html) == text


SHEETS = [
    ("<style>.gone{display:none} p{margin:0}</style><p class='a gone'>x<p>y", "y"), ("<style>div.gone, #z{display:none}</style><p class=gone>x<div class=gone>y</div><b id=z>z</b>", "x"),
    ("<style>.a{display:none}</style><p class=a style='display:block'>x", "x"), ("<style>.a.b{display:none}.b{display:block}</style><p class='a b'>x<p class=b>y", "y"),
    ("<style>.a{display:none}#k{display:inline}</style><p class=a id=k>x", "x"), ("<style media=print>p{display:none}</style><p>x", "x"), ("<style>@media print{p{display:none}} /* p{display:none} */ nav p{display:none}</style><p>x", "x"),
    ("<!-- <style>p{display:none}</style> --><p>x", "x"), ("<style>i{visibility:hidden}b{visibility:visible}</style><i>x<b>y</b></i>", "y"), ("<p class=late>x</p><style>.late{display:none}</style>y", "y"),
]


@pytest.mark.parametrize(("html", "text"), SHEETS)
def test_style_sheets(html, text):
    assert html_text.render(html) == text
