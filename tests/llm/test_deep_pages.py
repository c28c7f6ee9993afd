"""Blocks far below their ancestors."""

import time

import numpy as np

from gleaner.llm.html_crf import _bucket, path_features, trained
from gleaner.llm.html_pages import blocks


def ancestors(block):
    out, above = [], block.above
    while above:
        out.insert(0, above.entry)
        above = above.parent
    return (*out, *block.path)


def test_inline_elements_take_no_room():
    found = blocks('<footer class="legal"><div>' + "<font><b>" * 50 + "<p>x</p><p>y</p>")
    assert [ancestors(b) for b in found] == [(("footer", ("legal",)), ("div", ()), ("p", ()))] * 2 and not found[0].above


def test_no_ancestor_is_cut():
    html = '<footer class="legal"><nav id="menu">' + "<div><i>" * 100 + "<p>x</p><p>y</p>" + "</i></div>" * 100 + "<p>z"
    found = blocks(html)
    top = (("footer", ("legal",)), ("nav", ("menu",)))
    assert [ancestors(b) for b in found] == [(*top, *[("div", ())] * 100, ("p", ()))] * 2 + [(*top, ("p", ()))]
    assert found[0].place == found[1].place != found[2].place


def test_scores_see_the_ancestors_far_up():
    field = trained()
    deep, cut = blocks('<footer class="copyright">' + "<div>" * 100 + "Some words"), blocks("<div>" * 101 + "Some words")
    got, without = field.scores(deep), field.scores(cut)
    more = sorted({_bucket(n) for n in ("in footer", "name copyright")} - {_bucket(n) for n in path_features(cut[0].path)})
    assert np.allclose(got[0] - without[0], field.weights[more].sum(0)) and abs(got - without).max() > 0.1


def test_deep_pages_take_linear_time():
    began = time.time()
    html = "".join(f'<div class="{"abcdefghij"[k % 10]}x{"klmnopqrst"[k // 10 % 10] * (1 + k // 100 % 50)}">t' for k in range(10_000))
    assert len(trained().scores(blocks(html))) == 10_000 and time.time() - began < 60
