"""Pages whose head, drawing or button is not closed, and formulas."""

import pytest

from gleaner.llm.html_crf import trained
from gleaner.llm.html_pages import blocks

PROSE = "Some words that go on for a while, as articles do, and say a thing or two about the matter at hand."


@pytest.mark.parametrize(("html", "want"), [
    ("<html><head><title>t</title><meta charset=utf-8><script>x</script><article><p>a</article>", ["a"]),
    ("<head><link rel=x><style>s</style><span>a</span><p>b", ["a", "b"]), ("<head><title>t</title>a<p>b", ["a", "b"]),
    ("<head>\n <title>t</title>\n <base href=x>\n</head>\n<p>b", ["b"]), ("<head><head><title>t</title><p>b</head>c", ["bc"]),
    ("<head><noscript>n</noscript><iframe>i</iframe>a", ["a"]), ("<head><svg>n</svg>a", ["a"]), ("<head><title>t</title><select><option>o</select><p>b", ["b"]),
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds", ["so x=1 holds"])])
def test_head_and_math(html, want):
    assert " ".join(b.text for b in blocks(html)) == " ".join(want)


def test_article_under_an_open_head():
    html = f"<!DOCTYPE html><html><head><title>T</title><article><h1>A title of some words</h1><p>{PROSE}</p><p>{PROSE} <math><mi>x</mi></math>.</p></article>"
    assert trained().text(html) == "\n\n".join(["A title of some words", PROSE, f"{PROSE} x."])


@pytest.mark.parametrize(("html", "want"), [
    ("<body><svg><path><div><p>Text here.</p></div></body>", ["Text here."]),
    ("<svg><g><text>mark</text></g></svg><p>a", ["a"]), ("<svg><text>mark<p>a</svg><p>b", ["a", "b"]),
    ("<svg><foreignObject><div>label</div></foreignObject></svg><p>a", ["a"]),
    ("<button>Menu<article><p>a</p></article>", ["a"]), ("<button><div>Menu</div></button><p>a", ["a"]),
    ("<button>One<p>a</p><button>Two</button><p>b", ["a", "b"]), ("<div><button>Menu</div><p>a", ["a"])])
def test_drawings_and_buttons(html, want):
    assert [b.text for b in blocks(html)] == want


@pytest.mark.parametrize("opening", ["<svg><path><circle>", "<button>Menu"])
def test_article_behind_what_is_not_closed(opening):
    html = f"<html><body>{opening}<article><h1>A title of some words</h1><p>{PROSE}</p><p>{PROSE} Again.</p></article></body></html>"
    assert trained().text(html) == "\n\n".join(["A title of some words", PROSE, f"{PROSE} Again."])
