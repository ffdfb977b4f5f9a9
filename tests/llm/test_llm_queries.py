"""The registered queries: their columns, their SQL, and the pipeline's stages on planted cases."""

from __future__ import annotations

import importlib
import random

import pytest

from encore.llm import queries
from encore.llm.common import table
from tests_llm_brute import brute_decontaminate, brute_jaccard, brute_lines

corpus_pipeline = importlib.import_module("corpus_pipeline")

COLUMNS = {
    "op2_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op3_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op4_chat_format": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op6_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op7_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op8_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op9_ngram_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op11_piece_round_trip": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op12_filter_audit": {"part": "string", "filter_order": "string", "step": "int", "kept": "bigint", "removed": "bigint", "redundant": "bigint", "unique_fails": "bigint", "good_lost": "bigint", "toxic_lost": "bigint", "shapley": "bigint"},
    "op13_hard_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf_dir, same_rows, name):
    same_rows(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf_dir, name):
    found = dict(queries.queries()[name](spark, sf_dir).dtypes)
    assert {k: found.get(k) for k in COLUMNS[name]} == COLUMNS[name]


@pytest.mark.parametrize("name", ["op1_toxicity", "op3_html_extraction", "op7_quality_rules", "op10_license_scan", "op11_piece_round_trip"])
def test_one_row_for_each_input_row(spark, sf_dir, name):
    source = "pages" if name.startswith("op3") else "documents"
    assert queries.queries()[name](spark, sf_dir).count() == table(spark, sf_dir, source).count()


def test_op11_is_what_the_library_gives(spark, sf_dir):
    import hashlib

    import numpy as np
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    due = set()
    for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        due.add((r["doc_id"], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode()), True))
    assert {tuple(r) for r in queries.op11_piece_round_trip(spark, sf_dir).collect()} == due


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Tables with copies, near copies, repeated lines, a benchmark passage and toxic documents."""
    rng = random.Random(12)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne") for b in ("ran", "tel", "vos", "dim") for c in ("a", "o", "us", "ix")]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    docs = {k: f"{prose(60)}\n{prose(40)}" for k in range(60)}
    leak = prose(25)
    docs[60] = docs[3]
    docs[61] = docs[4].replace("\n", " more\n") + " end"  # no line of it repeats
    docs[62] = f"{prose(30)} {leak} {prose(30)}"
    docs[63] = f"{prose(50)}\na footer line that repeats\n{prose(30)}"
    docs[64] = f"{prose(50)}\nA footer line that repeats \n{prose(30)}"
    for k in range(65, 95):
        words = prose(80).split()
        for at in rng.sample(range(80), 8):
            words[at] = rng.choice(["vileword", "nastyterm", "hatespeak"])
        docs[k] = " ".join(words)
    rows = [(k, t, rng.choice(["en", "de"]), f"src{k % 7}", len(t), "extra") for k, t in docs.items()] + [(200, None, None, None, None, None), (201, "", "en", "src1", 0, None)]
    folder = tmp_path_factory.mktemp("planted")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, int(65 <= k < 95)) for k in [*range(0, 60, 2), *range(65, 95, 2)]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_on_planted_cases(spark, planted):
    docs = table(spark, planted, "documents")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    texts = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]

    clean = steps["toxicity"](spark, docs, planted).cache()
    assert clean.columns == columns
    assert ids(clean) == {*range(65), 200, 201}

    lined = steps["line dedup"](spark, clean, planted).cache()
    assert lined.columns == columns
    want = {i: None if t is None else kept for (i, t), kept in brute_lines(texts(clean))}
    assert dict(texts(lined)) == want
    assert "repeats" in want[63] and "repeats" not in want[64]

    single = steps["n-gram Jaccard join"](spark, lined, planted).cache()
    assert single.columns == columns
    assert ids(single) == brute_jaccard(texts(lined)) and 61 not in ids(single)

    free = steps["benchmark decontamination"](spark, single, planted).cache()
    assert free.columns == columns
    items = [(r["item_id"], r["text"]) for r in table(spark, planted, "benchmark").collect()]
    assert ids(free) == {i for i, t in texts(single) if not brute_decontaminate(t, items)}
    assert 62 in ids(single) and 62 not in ids(free)

    mixed = steps["mixing to target weights"](spark, free, planted)
    assert ids(mixed) <= ids(free)
    whole = corpus_pipeline.run(spark, planted)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, mixed.collect()))


def test_pipeline_on_empty_tables(spark, planted, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, planted, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
