"""Pages written by hand, of layouts that the training pages do not copy, and markup that is slow to read."""

from __future__ import annotations

import time

import numpy as np
import pytest

from encore.llm.html_extract import ChainField, features, fitted, leaf_blocks, main_text

A = "The river rose again last night, and the lower road was closed before dawn."
B = "Two families were moved to the school, where volunteers had set out beds."
C = "Officials said that the water would fall by Friday, if no more rain came."
HEAD = "<html><head><title>x</title></head><body>"

#: (page, text)
PAGES = {
    "bare": (f"<html><body><p>{A}</p><p>{B}</p></body></html>", f"{A}\n{B}"),
    "bare short": ("<html><body><p>Only text, no wrapper here at all.</p><p>Second one.</p></body></html>", "Only text, no wrapper here at all.\nSecond one."),
    "banner": (f"{HEAD}<div class='cookie-banner'><p>We use cookies to serve you.</p><button>OK</button></div><div><h1>The flood</h1><p>{A}</p><p>{B}</p></div>", f"The flood\n{A}\n{B}"),
    "nav above": (f"{HEAD}<nav><a href=/>Home</a> <a href=/n>News</a></nav><h1>The flood</h1><p>{A}</p><p>{C}</p>", f"The flood\n{A}\n{C}"),
    "footer below": (f"{HEAD}<div><p>{A}</p><p>{B}</p></div><footer><p>&copy; 2020 The Herald.</p></footer>", f"{A}\n{B}"),
    "aside": (f"{HEAD}<div><h1>The flood</h1><p>{A}</p><p>{B}</p></div><aside><h3>Read more</h3><ul><li><a href=/1>Rain</a></li><li><a href=/2>Wind</a></li></ul></aside>", f"The flood\n{A}\n{B}"),
    "table": (f"{HEAD}<table><tr><td><p>{A}</p><p>{B}</p><p>{C}</p></td></tr></table>", f"{A}\n{B}\n{C}"),
    "section": (f"{HEAD}<section><h2>The flood</h2><p>{A}</p><p>{B}</p></section><footer>All rights kept.</footer>", f"The flood\n{A}\n{B}"),
    "soup": (f"{HEAD}<div><div><div class=x1><div><p>{A}</p></div><div><p>{B}</p></div></div></div></div>", f"{A}\n{B}"),
    "bare quote": (f"{HEAD}<p title=don't>{A}</p><p data-a=\"it's\">{B}</p>", f"{A}\n{B}"),
    "article quote": (f"{HEAD}<article><p title=don't>{A}<p>{B}</article>", f"{A}\n{B}"),
    "script": (f"{HEAD}<script>if (a < b) document.write('<p>no</p>')</script><p>{A}</p><p>{B}</p><style>p > b {{}}</style>", f"{A}\n{B}"),
    "form": (f"{HEAD}<form action=/s><label>Search</label><input name=q><button>Go</button></form><h1>The flood</h1><p>{A}</p><p>{B}</p>", f"The flood\n{A}\n{B}"),
    "references": (f"{HEAD}<main><p>Tom &amp; Jerry &lt;3 caf&eacute;, said &#8220;yes&#8221;.</p><p>{A}</p></main>", f"Tom & Jerry <3 café, said “yes”.\n{A}"),
    "spaces": (f"{HEAD}<article><p>  The\n\triver   <b>rose</b>\nagain.  </p><p>{B}</p></article>", f"The river rose again.\n{B}"),
    "comments": (f"{HEAD}<article><h1>The flood</h1><p>{A}</p><p>{B}</p></article><section id=comments><h3>Comments</h3><p>I saw it too, terrible night.</p></section>", f"The flood\n{A}\n{B}"),
    "advert": (f"{HEAD}<article><p>{A}</p><div class='ad'><p>Buy boots, now half price.</p></div><p>{B}</p></article>", f"{A}\n{B}"),
    "list": (f"{HEAD}<main><h1>What to pack</h1><ul><li>Boots and a coat.</li><li>A torch, with cells.</li></ul><p>{C}</p></main>", f"What to pack\nBoots and a coat.\nA torch, with cells.\n{C}"),
    "unclosed": (f"{HEAD}<article><h1>The flood<p>{A}<p>{B}<p>{C}", f"The flood\n{A}\n{B}\n{C}"),
    "only links": (f"{HEAD}<nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav><footer>&copy; X</footer>", ""),
}


@pytest.fixture(scope="module")
def field():
    return fitted()


@pytest.mark.parametrize("name", sorted(PAGES))
def test_foreign_page(field, name):
    page, text = PAGES[name]
    assert main_text(page, field) == text


SLOW = {
    "nested": "<div>" * 100_000 + "deep",
    "sections": "<![CDATA[" * 110_000,
    "ended sections": "<![CDATA[" * 110_000 + "]]>",
    "tags in tags": "<a<" * 330_000,
    "open paragraph": "<p><table>" + "<div>" * 100_000,
    "broken attributes": '<p class="x ' * 80_000,
    "quotes": "<a b='" * 160_000,
    "drawings": "<svg " * 200_000,
    "stray ends": "</p></div>" * 100_000,
    "lists": "<ul><li>" * 60_000,
}


@pytest.mark.parametrize("name", sorted(SLOW))
def test_time_in_proportion(name):
    leaf_blocks(SLOW[name][:1000])
    start = time.process_time()
    leaf_blocks(SLOW[name])
    assert time.process_time() - start < 4  # a walk for each tag takes minutes


def test_gradient_against_differences():
    """The direction of the first step of the fit against differences of the log-likelihood, which
    is summed over all labellings."""
    import itertools

    blocks = leaf_blocks("<h1>T</h1><p>one.</p><nav>x</nav><p>two, three.</p>")
    gold = [1, 1, 0, 1]
    names = sorted({f for fs in features(blocks) for f in fs})

    def likelihood(one: ChainField) -> float:
        scores = one.scores(blocks)
        total = lambda ys: one.start[ys[0]] + sum(s[y] for s, y in zip(scores, ys, strict=True)) + sum(one.step[a, b] for a, b in zip(ys, ys[1:]))  # noqa: B905, E731
        return total(gold) - np.logaddexp.reduce([total(ys) for ys in itertools.product((0, 1), repeat=len(blocks))])

    base = likelihood(ChainField(names))
    stepped = ChainField(names).fit([(blocks, gold)], steps=1, l2=0.0)
    for part, shape in (("w", (len(names), 2)), ("step", (2, 2)), ("start", (2,))):
        for place in np.ndindex(shape):
            up, down = ChainField(names), ChainField(names)
            getattr(up, part)[place], getattr(down, part)[place] = 1e-4, -1e-4
            slope = (likelihood(up) - likelihood(down)) / 2e-4
            assert abs(slope) < 1e-6 or np.sign(getattr(stepped, part)[place]) == np.sign(slope)
    assert likelihood(ChainField(names).fit([(blocks, gold)], steps=50)) > base
