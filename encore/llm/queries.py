"""The queries of the text operators, `opN_<name>`, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.llm import audit, chat, decontaminate, html_extract, jaccard, license, lines, mix, negatives, pieces, quality, toxicity, urls
from encore.llm.common import table

#: op8: rules of host and path, and the blocklist for pages that no rule fits.
URL_RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
URL_GLOBS = {f"**{name}**": "block" for name in ("casino", "free-bets", "ads-track", "spam-farm", "cheap-pills", "adult-x")}
#: op5: target weights of the tree's nodes; others weigh 1.
MIX_WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}


def domain() -> F.Column:
    """The tables name no domain: sources are dealt to four by their number."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"(\d+)$", 1)
    return F.when(number == "", "d0").otherwise(F.concat(F.lit("d"), (F.try_to_number(number, F.lit("999999999999")) % 4).cast("int").cast("string")))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.score_toxicity(F.col("text"), model).alias("s"))
    return scored.select("doc_id", F.round("s.severity", 6).alias("severity"), F.round("s.p_toxic", 6).alias("p_toxic"), "s.grade", (F.col("s.p_toxic") >= 0.5).alias("toxic"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "hits.n_words", F.size("hits.hit").cast("long").alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"), F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), (F.size("hits.hit") > 0).alias("contaminated"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html_extract.extract_text(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.inline(F.array(*(F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(hard).alias("text")) for k, r in enumerate(("user", "assistant"))))))
    chats = chat.format_chats(rows.unionByName(more))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text(F.col("turns"))
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(table(spark, sf_dir, "documents"), domain(), weights=MIX_WEIGHTS)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("lines.kept", 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return found.select("doc_id", *(F.col(f"quality_check.{c}") for c in names), F.round("quality_check.score", 6).alias("score"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, URL_GLOBS).select("page_id", "url_check.*")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "license.n_sentences", F.array_join("license.ids", ",").alias("sentence_ids"), F.array_join("license.licenses", ",").alias("licenses"), "license.n_unmatched")


def op11_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = pieces.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", (F.octet_length("pieces.ids") / 4).cast("long").alias("n_tokens"), F.sha2("pieces.ids", 256).alias("ids_sha256"), F.sha2("pieces.text", 256).alias("decoded_sha256"), "pieces.agrees")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_toxicity, op2_decontamination, op3_html_extraction, op4_chat_format, op5_source_mix, op6_line_dedup, op7_quality_rules, op8_url_filter, op9_ngram_jaccard, op10_license_scan, op11_piece_round_trip, op12_filter_audit, op13_hard_negatives, pipeline)
    return {f.__name__: f for f in own}


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _op2_sql() -> str:
    words = r"regexp_extract_all(" + _LOW.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH item AS (SELECT item_id, {words} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS p
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
spot AS (SELECT r, m, i, array_to_string(w[i : i + m - 1], ' ') AS p
       FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
occ AS (SELECT r, i, a.m, item_id FROM spot a JOIN win USING (m, p)),
hit AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + m)) AS k FROM occ) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM occ WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(x.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit h USING (r) LEFT JOIN items x USING (r)"""


_OP4_SQL = r"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
esc AS (SELECT *, regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') AS r2, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS t2 FROM raw)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(12 + length(replace(r2, chr(10), '<|nl|>')) + 1 + length(t2) + 11)::BIGINT AS formatted_chars
FROM esc GROUP BY conv_id"""


def mix_sql(docs: str) -> str:
    """The mix over the rows of `docs`, a table expression."""

    def weight(level: str) -> str:
        cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS.get(level, {}).items())
        return f"CASE {level} {cases} ELSE 1 END" if cases else "1"

    parts, keys = [], []
    for level in mix.LEVELS:
        all_keys = ", ".join([*keys, level])
        group = f"PARTITION BY {', '.join(keys)}" if keys else ""
        source = f"(SELECT {all_keys}, sum(cap)::HUGEINT AS cap FROM leaves GROUP BY ALL) x " + (f"JOIN fill_{keys[-1]} USING ({', '.join(keys)})" if keys else "CROSS JOIN (SELECT least(floor(sum(tokens) * 0.5), sum(cap))::HUGEINT AS budget FROM leaves)")
        parts.append(f"""
fill_{level} AS (
  SELECT {all_keys}, CASE WHEN is_full THEN cap ELSE (weight * (b - used)) // nullif(all_w - used_w, 0) END AS budget FROM (
    SELECT *, max(CASE WHEN is_full THEN cum_cap ELSE 0 END) OVER ({group}) AS used, max(CASE WHEN is_full THEN cum_w ELSE 0 END) OVER ({group}) AS used_w FROM (
      SELECT *, cap * (all_w - cum_w + weight) <= weight * (b - cum_cap + cap) AS is_full FROM (
        SELECT *, sum(cap) OVER (o ROWS UNBOUNDED PRECEDING)::HUGEINT AS cum_cap, sum(weight) OVER (o ROWS UNBOUNDED PRECEDING)::HUGEINT AS cum_w, sum(weight) OVER ({group})::HUGEINT AS all_w FROM (
          SELECT {all_keys}, cap, budget AS b, ({weight(level)})::HUGEINT AS weight FROM {source})
        WINDOW o AS ({group} ORDER BY cap::DOUBLE / weight, {level})))))""")
        keys.append(level)
    cols = ", ".join(mix.LEVELS)
    return rf"""
slim AS (
  SELECT * FROM (SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '(\d+)$', 1) = '' THEN 'd0' ELSE 'd' || (regexp_extract(source, '(\d+)$', 1)::BIGINT % 4) END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM {docs}) WHERE n_tokens > 0),
leaves AS (SELECT {cols}, sum(n_tokens)::HUGEINT AS tokens, sum(n_tokens)::HUGEINT * 2 AS cap FROM slim GROUP BY ALL),{",".join(parts)},
plan AS (SELECT {cols}, budget // tokens AS epochs, budget % tokens AS rest FROM leaves JOIN fill_source USING ({cols})),
placed AS (SELECT *, md5('7:' || epochs || ':' || coalesce(doc_id::VARCHAR, 'null')) AS place FROM slim JOIN plan USING ({cols})),
picked AS (SELECT *, epochs + CASE WHEN sum(n_tokens) OVER (PARTITION BY {cols} ORDER BY place RANGE UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS copies FROM placed)
SELECT doc_id, {cols}, n_tokens, copies::BIGINT AS copies FROM picked WHERE copies > 0"""


_OP6_SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (SELECT r, doc_id, k, ls[k] AS line, {_LOW.format(f"trim(ls[k], {_SPACE})")} AS key FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS k FROM doc)),
rep AS (SELECT key, min(coalesce(doc_id, 9223372036854775807)) AS owner FROM line WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT coalesce(doc_id, 9223372036854775807)) > 1)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM (SELECT line.*, owner IS NOT NULL AND owner <> coalesce(doc_id, 9223372036854775807) AS gone FROM line LEFT JOIN rep USING (key))
GROUP BY r, doc_id"""


def _op8_sql() -> str:
    host = _LOW.format(r"regexp_extract(url, '://([^/?#]*)', 1)")
    rules = "UNION ALL ".join(f"SELECT '{r}' AS rule, '{r.split('/')[0]}' AS h, '/{r.split('/', 1)[1]}' AS p, '{v}' AS v " for r, v in URL_RULES.items())
    names = " OR ".join(f"contains(host || path, '{g.strip('*')}')" for g in URL_GLOBS)
    return rf"""
WITH page AS (SELECT row_number() OVER () AS r, page_id, coalesce({host}, '') AS host, coalesce(regexp_extract(url, '^[^:]*(:[^:]+)*?://[^/?#]*(/[^?#]*)', 2), '') AS path FROM pages),
rule AS ({rules}),
best AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM page JOIN rule ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN {names} THEN 'block' ELSE 'allow' END) AS verdict FROM page LEFT JOIN best USING (r)"""


_OP9_SQL = rf"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT x, y FROM pair JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM doc UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT doc.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id
FROM doc LEFT JOIN size USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)"""


_OP12_SQL = rf"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
own AS (SELECT t, min(doc_id) AS first FROM doc GROUP BY t),
mark AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
mask AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
         (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN first < doc_id THEN 16 ELSE 0 END) AS mask
         FROM doc JOIN own USING (t) LEFT JOIN mark USING (doc_id)),
cell AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE bad) AS b FROM mask GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letter a, letter b, letter c, letter d, letter e
           WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
step AS (SELECT filter_order, step::INT AS step, filter_order[step] AS f, (1 << (ascii(filter_order[step]) - 65)) AS bit,
         list_sum(list_transform(string_split(filter_order[1 : step - 1], ''), lambda x: CASE WHEN x = '' THEN 0 ELSE 1 << (ascii(x) - 65) END)) AS seen
         FROM orders, range(1, 6) s(step)),
fig AS (SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (WHERE mask & coalesce(seen, 0)::INT = 0 AND mask & bit = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE mask & coalesce(seen, 0)::INT = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE mask & coalesce(seen, 0)::INT <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(g) FILTER (WHERE mask & coalesce(seen, 0)::INT = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost, coalesce(sum(b) FILTER (WHERE mask & coalesce(seen, 0)::INT = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
        FROM cell, step GROUP BY ALL),
total AS (SELECT part, f, sum(removed)::BIGINT AS shapley FROM fig GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley FROM fig JOIN total USING (part, f)"""


_OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
         FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
pos AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other))::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM pos JOIN pair USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 3"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": _op2_sql(), "op4_chat_format": _OP4_SQL, "op5_source_mix": "WITH " + mix_sql("documents").lstrip(), "op6_line_dedup": _OP6_SQL, "op8_url_filter": _op8_sql(), "op9_ngram_jaccard": _OP9_SQL, "op12_filter_audit": _OP12_SQL, "op13_hard_negatives": _OP13_SQL}
