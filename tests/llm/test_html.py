"""Extraction: accuracy on pages from another seed, decoding against all labellings, odd markup."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from encore.llm.html_extract import ChainField, extract_text, features, fitted, labelled_blocks, labelled_pages, leaf_blocks, main_text


@pytest.fixture(scope="module")
def field():
    return fitted()


def test_held_out_pages(field):
    right = total = whole = 0
    pages = [labelled_blocks(p) for p in labelled_pages(150, 99)]
    for blocks, labels in pages:
        got = field.decode(blocks)
        right += sum(a == b for a, b in zip(got, labels, strict=True))
        total += len(labels)
        whole += got == labels
    assert right / total > 0.97
    assert whole / len(pages) > 0.75


def test_viterbi_finds_the_best_labels():
    blocks = leaf_blocks("<h1>T</h1><p>one.</p><nav>x</nav><p>two, three.</p><footer>f</footer>")
    names = sorted({f for fs in features(blocks) for f in fs})
    rng = np.random.default_rng(1)
    for _ in range(20):
        one = ChainField(names)
        one.w, one.step, one.start = rng.normal(size=(len(names), 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
        scores = one.scores(blocks)

        def total(ys):
            return one.start[ys[0]] + sum(s[y] for s, y in zip(scores, ys, strict=True)) + sum(one.step[a, b] for a, b in zip(ys, ys[1:]))  # noqa: B023, B905

        assert one.decode(blocks) == list(max(itertools.product((0, 1), repeat=len(blocks)), key=total))


PAGE = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>First  line,\n with <b>bold</b> text &#233;.<p>Second &lt;tag&gt; line.</article><aside class=sidebar><p>Related links here</p></aside><footer>&copy; x.example</footer>"


def test_text_of_a_page(field):
    assert main_text(PAGE, field) == "A & B\nFirst line, with bold text é.\nSecond <tag> line."


def test_nulls_and_broken_pages(spark, field):
    pages = [(1, None), (2, ""), (3, "   "), (4, "<"), (5, "</p></div>"), (6, "<!-- open"), (7, "<script>var a"), (8, "<p"), (9, PAGE), (9, PAGE), (10, "<div>" * 3000 + "deep"), (11, "<article><p>" + "word, " * 60_000 + "end.</p></article>")]
    got = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, html string, text string").select("page_id", extract_text(F.col("html"), field).alias("main")).collect()
    assert len(got) == len(pages)
    by = {r["page_id"]: r["main"] for r in got}
    assert all(by[k] == "" for k in (1, 2, 3, 5, 6, 7))
    assert len(by[11]) == len("word, ") * 60_000 + 4
    assert spark.createDataFrame([], "page_id long, html string").select(extract_text(F.col("html"), field)).count() == 0


@pytest.mark.parametrize("tag", ["<svg-icon name=x></svg-icon>", "<template-x>", "<object-viewer data=y></object-viewer>", "<STYLE-box/>", "<svg/>", '<svg class="i" width=1 />', "<svg\n viewBox='0 0 1 1'/>"])
def test_nothing_is_swallowed_after_names_that_only_begin_so(tag, field):
    whole = main_text(PAGE, field)
    assert main_text(PAGE.replace("<b>bold</b>", f"{tag}<b>bold</b>"), field) == whole
    assert [b.text for b in leaf_blocks(f"<p>One {tag} two.</p><p>Three.</p><svg><text>drawn</text></svg><p>Four.</p>")] == ["One two.", "Three.", "Four."]


def test_drawings_and_scripts_are_still_left_out():
    page = "<p>a<svg width=1><path d='m0'/><text>no</text></svg>b</p><script src=x/>no</script ><SVG>no</svg><template>no</template><p>c<svg>no"
    assert [b.text for b in leaf_blocks(page)] == ["ab", "c"]
