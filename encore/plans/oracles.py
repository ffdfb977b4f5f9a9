"""SQL that DuckDB runs on the same tables, one statement for each query it can express."""

from __future__ import annotations

_BASE = """WITH RECURSIVE li AS MATERIALIZED (
  SELECT l_partkey AS song_id, p_name AS title, p_brand, p_type, l_shipdate::TIMESTAMP AS ts, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS skip_type,
    (l_returnflag <> 'N')::INT AS is_skipped, (l_linestatus = 'F')::INT AS is_proactive, l_discount * 10 AS proactive_score, l_orderkey AS t1, l_linenumber AS t2, l_partkey AS t3, l_suppkey AS t4
  FROM lineitem JOIN part ON l_partkey = p_partkey),
pl AS (SELECT *, p_brand AS artist, p_type AS genre FROM li),
pd AS MATERIALIZED (SELECT * FROM (SELECT *, p_type AS artist, p_brand AS genre, TIMESTAMP '1995-01-02' + to_days((90 * (song_id % 3))::INT) AS birth,
    CASE p_type WHEN 'ECONOMY' THEN 90 WHEN 'STANDARD' THEN 180 WHEN 'PROMO' THEN 365 WHEN 'SMALL' THEN 730 WHEN 'LARGE' THEN 1500 WHEN 'MEDIUM' THEN 1000000 END::DOUBLE AS tau,
    ('0x' || substr(md5(concat_ws(':', t1, t2, t3, t4)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM li)
  WHERE ts >= birth AND u < exp(-((epoch(ts)::BIGINT - epoch(birth)::BIGINT) / 86400.0::DOUBLE) / tau)),
pe0 AS (SELECT event_id, user_id, ts::TIMESTAMP AS ts, regexp_extract(props, '(\\d+)', 1)::BIGINT AS song_id, CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS skip_type FROM events),
pe AS MATERIALIZED (SELECT *, song_id % 20 AS artist, coalesce((lag(song_id % 20) OVER w = song_id % 20)::INT, 0) AS dive, coalesce((floor(epoch(ts))::BIGINT - floor(epoch(lag(ts) OVER w))::BIGINT > 1800)::INT, 1) AS starts,
    coalesce((floor(epoch(lead(ts) OVER w))::BIGINT - floor(epoch(ts))::BIGINT < 30)::INT, 0) AS gap_skip FROM pe0 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
"""
_TIE = "ts, t1, t2, t3, t4"
_ORD = f"row({_TIE})"
_CAT = f"cat AS (SELECT song_id, arg_min(title, {_ORD}) AS title, arg_min(artist, {_ORD}) AS artist, count(*)::BIGINT AS plays FROM pl GROUP BY song_id)"
_RATED = """rated AS (SELECT i.*, A FROM (SELECT song_id, sum(pow(0.5, age / 30)) AS R, min(age) AS dsl, count(*) FILTER (WHERE age <= 28)::BIGINT AS level28, count(*)::BIGINT AS familiarity
    FROM (SELECT song_id, (epoch((SELECT max(ts) FROM pl WHERE skip_type = 0)) - epoch(ts)) / 86400.0::DOUBLE AS age FROM pl WHERE skip_type = 0) GROUP BY song_id HAVING count(*) >= 5) i
  JOIN (SELECT song_id, 1 + 4 * avg((skip_type = 0)::INT) AS A FROM pl GROUP BY song_id) USING (song_id))"""
_WEEK = "(extract(week FROM {0}) + extract(isoyear FROM {0}) * 52)::BIGINT"
_LABEL = "lab AS (SELECT doc_id AS song_id, 1.0::DOUBLE + 3 * quality + (1 - toxic) AS label FROM labels)"


def _ord(p: str) -> str:
    return f"ordn AS (SELECT *, row_number() OVER (ORDER BY {_TIE}) - 1 AS gidx FROM {p})"


_INTERVALS = "iv AS (SELECT * FROM (SELECT song_id, gidx, gidx - lag(gidx) OVER w AS iv, row_number() OVER w - 1 AS fam FROM ordn WINDOW w AS (PARTITION BY song_id ORDER BY gidx)) WHERE iv IS NOT NULL)"
_SPEAR = "sp AS (SELECT song_id, count(*)::BIGINT AS n, CASE WHEN count(DISTINCT iv) > 1 AND count(DISTINCT fam) > 1 THEN corr(rx, ry) END AS rho FROM (SELECT *, rank() OVER (PARTITION BY song_id ORDER BY fam) + (count(*) OVER (PARTITION BY song_id, fam) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY song_id ORDER BY iv) + (count(*) OVER (PARTITION BY song_id, iv) - 1) / 2.0::DOUBLE AS ry FROM iv) GROUP BY song_id HAVING count(*) >= 8)"


def _curve(p: str) -> str:
    return f"""life AS (SELECT song_id, count(*) AS n, min(ts) AS t0, max(ts) AS tl FROM {p} GROUP BY song_id HAVING count(*) >= 16 AND epoch(max(ts)) - epoch(min(ts)) >= 7 * 86400),
cur AS (SELECT song_id, g::BIGINT AS g, count(*) FILTER (WHERE (epoch(ts)::BIGINT - epoch(t0)::BIGINT) * 20 <= g * (epoch(tl)::BIGINT - epoch(t0)::BIGINT)) / any_value(n)::DOUBLE AS y FROM {p} JOIN life USING (song_id), range(21) r(g) GROUP BY song_id, g)"""


_PANEL = """done AS (SELECT song_id, epoch(ts)::BIGINT AS t FROM pd WHERE skip_type = 0),
big AS (SELECT song_id FROM done GROUP BY song_id HAVING count(*) >= 5),
grid AS (SELECT unnest(range(lo + 90 * 86400, hi - 28 * 86400, 14 * 86400)) AS T0 FROM (SELECT min(t) AS lo, max(t) AS hi FROM done)),
panel AS MATERIALIZED (SELECT *, c1 + c2 + c3 + c4 AS level, c4 + c3 - c2 - c1 AS slope, (c4 - c3) - (c2 - c1) AS accel FROM (
  SELECT song_id, g.T0 AS T, """ + ", ".join(f"count(*) FILTER (WHERE t >= g.T0 - {k} * 604800 AND t < g.T0 - {k - 1} * 604800)::BIGINT AS c{5 - k}" for k in (4, 3, 2, 1)) + """,
    (g.T0 - max(t) FILTER (WHERE t < g.T0)) / 86400.0::DOUBLE AS dsl, count(*) FILTER (WHERE t < g.T0)::BIGINT AS familiarity, (g.T0 - min(t)) / 86400.0::DOUBLE AS age,
    count(*) FILTER (WHERE t >= g.T0 AND t < g.T0 + 28 * 86400)::BIGINT AS future
  FROM done JOIN big USING (song_id), grid g GROUP BY song_id, g.T0 HAVING count(*) FILTER (WHERE t < g.T0) >= 3))"""
_NOW_D = "(SELECT max(ts) FROM pd)"
_TREND = f"""trend AS (SELECT artist, CASE WHEN sum(n) < 5 OR count(*) < 2 THEN 0.5 ELSE least(1.0, (sum(r) / 4.0::DOUBLE) / avg(n)) END::DOUBLE AS artist_trend FROM (
  SELECT artist, {_WEEK.format('ts')} AS w, count(*)::DOUBLE AS n, count(*) FILTER (WHERE ts >= {_NOW_D} - INTERVAL 28 DAY)::DOUBLE AS r FROM pd GROUP BY ALL) GROUP BY artist)"""


def _totals(p: str) -> str:
    now = f"(SELECT max(ts) FROM {p})"
    return f"""tot AS (SELECT song_id, arg_min(artist, {_ORD}) AS artist, arg_min(title, {_ORD}) AS title, count(*)::BIGINT AS total_plays, sum(is_skipped)::BIGINT AS skips, avg(is_skipped) AS skip_rate,
  count(*) FILTER (WHERE ts >= {now} - INTERVAL 30 DAY)::BIGINT AS recent_30d_plays, count(*) FILTER (WHERE ts >= {now} - INTERVAL 90 DAY AND ts < {now} - INTERVAL 30 DAY)::BIGINT AS prev_60d_plays,
  avg(proactive_score) AS avg_proactive, floor((epoch({now}) - epoch(max(ts))) / 86400)::BIGINT AS days_since_last FROM {p} GROUP BY song_id)"""


def _halves(p: str) -> str:
    return f"""half AS (SELECT song_id, avg(is_skipped) FILTER (WHERE rn <= n // 2) AS first_half_skip, avg(is_skipped) FILTER (WHERE rn > n // 2) AS second_half_skip FROM (
  SELECT song_id, is_skipped, row_number() OVER (PARTITION BY song_id ORDER BY {_TIE}) AS rn, count(*) OVER (PARTITION BY song_id) AS n FROM {p}) WHERE n >= 3 GROUP BY song_id)"""


_FAMIL = "fam AS (SELECT artist, count(*)::BIGINT AS songs, count(*) FILTER (WHERE n >= 3)::BIGINT AS known, least(1.0::DOUBLE, count(*) FILTER (WHERE n >= 3) / greatest(count(*), 1)::DOUBLE) AS artist_familiarity FROM (SELECT artist, song_id, count(*) AS n FROM pd GROUP BY ALL) GROUP BY artist)"
_SCORES = ",".join([_totals("pd"), _halves("pd"), _FAMIL, _TREND]) + """,
score AS MATERIALIZED (SELECT song_id, artist, total_plays,
  round(least(greatest(0.30 * (1 - skip_rate) + 0.20 * coalesce(least(greatest(0.5 + first_half_skip - second_half_skip, 0), 1), 0.5) + 0.20 * log2(1 + total_plays) / log2(1 + max_plays) + 0.15 * coalesce(avg_proactive, 0) + 0.15 * coalesce(artist_familiarity, 0), 0), 1), 3)::DOUBLE AS affinity,
  round(least(greatest(0.25 * exp(-greatest(0, days_since_last - 7) / 60.0::DOUBLE) + 0.20 * least(1.0, recent_30d_plays / greatest(n_rows::DOUBLE / span * 30 / songs_all * 5, 0.5)) + 0.20 * coalesce(artist_trend, 0.5)
    + 0.35 * CASE WHEN prev_60d_plays > 0 THEN least(greatest((recent_30d_plays / (prev_60d_plays / 2.0::DOUBLE) - 0.5) / 1.5, 0), 1) WHEN recent_30d_plays > 0 THEN 1.0 ELSE 0.3 END, 0), 1), 3)::DOUBLE AS momentum,
  CASE WHEN total_plays < 3 OR first_half_skip IS NULL THEN 'N/A' WHEN first_half_skip <= 0.33 AND skip_rate <= 0.3 THEN 'liked at once' WHEN first_half_skip > second_half_skip + 0.10 THEN 'grew on me' WHEN second_half_skip > first_half_skip + 0.10 THEN 'wore off' ELSE 'so so' END AS zone
  FROM tot LEFT JOIN half USING (song_id) LEFT JOIN fam USING (artist) LEFT JOIN trend USING (artist),
    (SELECT max(total_plays) AS max_plays, count(*) AS songs_all, sum(total_plays) AS n_rows FROM tot), (SELECT greatest(floor((epoch(max(ts)) - epoch(min(ts))) / 86400), 1) AS span FROM pd))"""
_DECL = f"""decl AS (SELECT artist, count(*)::BIGINT AS weeks, avg(n) FILTER (WHERE rn <= w // 2) AS first_mean, avg(n) FILTER (WHERE rn > w // 2) AS second_mean, regr_slope(n::DOUBLE, (rn - 1)::DOUBLE) AS slope,
  avg(n) FILTER (WHERE rn > w // 2) / greatest(avg(n) FILTER (WHERE rn <= w // 2), 0.1) AS ratio FROM (
  SELECT artist, n, row_number() OVER (PARTITION BY artist ORDER BY wk) AS rn, count(*) OVER (PARTITION BY artist) AS w, sum(n) OVER (PARTITION BY artist) AS p FROM (SELECT artist, {_WEEK.format('ts')} AS wk, count(*) AS n FROM pd GROUP BY ALL))
  WHERE p >= 15 AND w >= 6 GROUP BY artist HAVING avg(n) FILTER (WHERE rn <= w // 2) >= 1),
sev AS (SELECT *, CASE WHEN ratio <= 0.3 AND slope < -0.3 THEN 'critical' WHEN ratio <= 0.4 AND slope < -0.2 THEN 'severe' WHEN ratio <= 0.5 AND slope < -0.1 THEN 'mild' END AS severity FROM decl)"""


def _norm(s: str) -> str:
    for pattern, to in ((r"[​‌‍⁠﻿­]", ""),):
        s = f"regexp_replace({s}, '{pattern}', '{to}', 'g')"
    s = f"lower({s})"
    for pattern, to in ((r"\([^)]*\)", ""), (r"\[[^\]]*\]", ""), (r"feat.*$", ""), (r"[^\p{L}\p{N}_\s]", ""), (r"\s+", " ")):
        s = f"regexp_replace({s}, '{pattern}', '{to}', 'g')"
    return f"trim({s})"


_WORDS = r"regexp_extract_all(lower(text), '([\p{L}\p{N}_]+)', 1)"
_TFIDF = rf"""tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS token FROM documents) GROUP BY ALL),
wt AS (SELECT doc_id, token, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN (SELECT token, count(*) AS df FROM tf GROUP BY token) USING (token)),
tfidf AS MATERIALIZED (SELECT doc_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM wt)"""
_TAGS = rf"tag AS (SELECT doc_id AS id, list_distinct({_WORDS}) AS tags, coalesce(source, '') = 'src0' AS lib FROM documents)"
_TOP = "top AS (SELECT tag, sum(w)::BIGINT AS weight FROM (SELECT unnest(tags) AS tag, 1 AS w FROM tag WHERE lib UNION ALL SELECT unnest(tags), 3 FROM tag WHERE id IN (1, 2)) GROUP BY tag ORDER BY weight DESC, tag LIMIT 10)"
_MODES = {"comfort": 0, "balanced": 1, "now": 2}
_GENRES = [("indie", ["indie rock", "indie", "alternative"]), ("rock", ["rock", "punk", "metal"]), ("ballad", ["ballad", "adult contemporary"]), ("rnb", ["r&b", "soul"]), ("pop", ["pop"]), ("hiphop", ["hip-hop", "rap", "hip hop"]), ("electronic", ["electronic", "edm", "house", "techno"]), ("singer-songwriter", ["singer/songwriter", "folk"])]
_FAMILY = "CASE WHEN lower(p_type) IN ('k-pop', 'kpop') THEN 'k-pop' " + " ".join(f"WHEN contains(lower(p_type), '{p}') THEN '{f}'" for f, ps in _GENRES for p in ps) + " ELSE 'other' END"
_NAMES = """['K-Pop', 'Korean Pop', 'K-Hip-Hop', 'Korean Hip-Hop', 'Pop', 'J-Pop', 'Rock', 'Alternative', 'Indie Rock', 'Korean Indie', 'R&B/Soul', 'R&B', 'Soul', 'Hip-Hop/Rap', 'Hip-Hop', 'Electronic', 'Dance',
    'Singer/Songwriter', 'Ballad', 'Korean Ballad', 'Metal', 'Hard Rock', 'Classical', 'Jazz', 'Blues', 'Country', 'Soundtrack', 'Anime',
    'kpop', 'Alternative Folk', 'Post-Punk', 'Adult Contemporary', 'Neo Soul', 'Synthpop', 'Trap', 'Deep House', 'Contemporary Folk', 'Polka', '', NULL]"""
_NAMED = f"named AS (SELECT p_partkey, 1990 + p_size % 30 AS y, {_NAMES}[1 + p_partkey % len({_NAMES})] AS p_type FROM part)"
_GROUP = """CASE WHEN {0} IN ('K-Pop', 'Korean Pop') THEN 'korean_pop' WHEN {0} IN ('K-Hip-Hop', 'Korean Hip-Hop') THEN 'korean_hiphop' WHEN {0} = 'J-Pop' THEN 'jpop' WHEN {0} IN ('Rock', 'Alternative', 'Indie Rock') THEN 'rock'
    WHEN {0} = 'Korean Indie' THEN 'korean_indie' WHEN {0} IN ('R&B/Soul', 'R&B', 'Soul') THEN 'rnb' WHEN {0} IN ('Hip-Hop/Rap', 'Hip-Hop') THEN 'hiphop' WHEN {0} IN ('Electronic', 'Dance') THEN 'electronic'
    WHEN {0} = 'Singer/Songwriter' THEN 'singer_songwriter' WHEN {0} IN ('Ballad', 'Korean Ballad') THEN 'ballad' WHEN {0} IN ('Metal', 'Hard Rock') THEN 'metal' ELSE lower({0}) END"""
_DOT = "list_inner_product(list_transform({0}, lambda x: x::DOUBLE), list_transform({1}, lambda x: x::DOUBLE))"
_COS = "(" + _DOT + ") / (sqrt(" + _DOT.format("{0}", "{0}") + ") * sqrt(" + _DOT.format("{1}", "{1}") + "))"


def _u(seed: str, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


_IDX = f"{_CAT}, idx AS (SELECT lower(trim(regexp_replace(artist, '(?i)vevo$', ''))) AS alias, song_id, {_norm('title')} AS nt, list_transform(regexp_extract_all(title, '\\(([^)]+)\\)', 1), lambda x: {_norm('x')}) AS ps, plays FROM cat)"
_EXT = f"ext AS (SELECT p_partkey AS ext_id, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' (live)' ELSE ' x' END AS title, lower(p_brand) AS alias FROM part), en AS (SELECT *, {_norm('title')} AS t, list_transform(regexp_extract_all(title, '\\(([^)]+)\\)', 1), lambda x: {_norm('x')}) AS p FROM ext)"
_MATCH = "EXISTS (SELECT 1 FROM idx WHERE idx.alias = en.alias AND (t = nt OR list_contains(ps, t) OR list_contains(p, nt) OR len(list_filter(ps, lambda x: length(x) > 3 AND length(t) > 3 AND (contains(x, t) OR contains(t, x)))) > 0 OR len(list_filter(p, lambda x: length(x) > 3 AND length(nt) > 3 AND (contains(x, nt) OR contains(nt, x)))) > 0))"

_SQUEEZE = r"regexp_replace(lower(trim({0})), '\s+', ' ', 'g')"

_AVG_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE"
_FOLDS = [_CAT, _LABEL, f"kf AS (SELECT song_id, artist, label, rep, floor({_u('rep', "(rep || ':' || song_id)")} * 5)::INT AS fold FROM cat JOIN lab USING (song_id), range(10) r(rep))",
          "ag AS (SELECT rep, f, artist, count(label) FILTER (WHERE fold <> f) AS n, coalesce(sum(label) FILTER (WHERE fold <> f), 0) AS s FROM kf, range(5) q(f) GROUP BY ALL)", "gl AS (SELECT rep, f, avg(label) FILTER (WHERE fold <> f) AS g FROM kf, range(5) q(f) GROUP BY ALL)"]
_BASELINES = """hv AS (SELECT song_id, count(*)::BIGINT AS n, count(*) FILTER (WHERE t <= 1 + 0.5::DOUBLE * (h - 1))::BIGINT AS past, count(*) FILTER (WHERE t > 1 + 0.5::DOUBLE * (h - 1))::BIGINT AS future
  FROM (SELECT song_id, (epoch(ts)::BIGINT - epoch(t0)::BIGINT) / 86400.0::DOUBLE + 1 AS t, (epoch((SELECT max(ts) FROM pd))::BIGINT - epoch(t0)::BIGINT) / 86400.0::DOUBLE + 1 AS h FROM pd JOIN life USING (song_id)) GROUP BY song_id HAVING past >= 8),
bl AS (SELECT *, past::DOUBLE AS persistence, past * (SELECT quantile_cont(future / greatest(past, 1)::DOUBLE, 0.5) FROM hv) AS population FROM hv)"""

_ALIASES = r"""nm AS (SELECT p_partkey AS song_id, CASE p_partkey % 5 WHEN 0 THEN '노래 ' || p_partkey WHEN 1 THEN p_name || ' (빨강 ' || p_partkey || ')' WHEN 2 THEN 'Step (live)' WHEN 3 THEN p_name || ' (live)' ELSE p_name END AS title_en,
  CASE WHEN p_partkey % 5 = 2 THEN CASE WHEN p_partkey % 2 = 0 THEN 'JANNABI' ELSE 'Nell' END ELSE p_brand END AS artist, p_name, CASE WHEN p_partkey % 8 = 0 THEN split_part(p_name, ' ', 1) || ' 노을' WHEN p_partkey % 4 = 0 THEN split_part(p_name, ' ', 1) END AS found FROM part),
al AS (SELECT song_id, title_en, CASE WHEN artist = 'JANNABI' THEN '한걸음' WHEN song_id % 5 = 1 THEN '빨강 ' || song_id WHEN song_id % 5 = 0 THEN title_en WHEN song_id % 8 = 0 THEN found END AS title_kr, artist,
  list_sort(list_distinct(list_filter([CASE WHEN song_id % 5 = 1 THEN '빨강 ' || song_id END, CASE WHEN song_id % 5 = 1 THEN p_name END, CASE WHEN found <> title_en THEN found END, CASE WHEN artist = 'JANNABI' THEN '한걸음' END], lambda x: x IS NOT NULL))) AS aliases FROM nm)"""

#: name: (common table expressions, select)
_SQL: dict[str, tuple[list[str], str]] = {
    "scan_filter_completed": ([], "SELECT artist, count(*)::BIGINT AS n, sum(is_proactive)::BIGINT AS proactive FROM pl WHERE skip_type = 0 GROUP BY artist"),
    "catalogue_first_values": ([_CAT], "SELECT * FROM cat"),
    "song_features": ([], f"SELECT song_id, arg_min(artist, {_ORD}) AS artist, arg_min(title, {_ORD}) AS title, count(*) FILTER (WHERE skip_type = 0)::BIGINT AS completed_plays, round(avg((skip_type = 0)::INT), 6) AS completion_rate, round(avg((skip_type = 2)::INT), 6) AS immediate_skip_rate, round(avg((skip_type = 1)::INT), 6) AS sample_skip_rate, round(avg(is_proactive), 6) AS proactive_rate FROM pl GROUP BY song_id HAVING count(*) >= 5"),
    "song_intensity": ([_RATED], "SELECT song_id, round(R, 6) AS R, round(dsl, 6) AS dsl, level28, familiarity FROM rated"),
    "artist_stats": ([], "SELECT artist, count(DISTINCT song_id)::BIGINT AS unique_songs, count(*)::BIGINT AS total_plays, count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM pl) - INTERVAL 30 DAY)::BIGINT AS recent_plays_30d, greatest(floor((epoch(max(ts)) - epoch(min(ts))) / 86400), 1)::BIGINT AS listening_span_days, round(count(*) / greatest(floor((epoch(max(ts)) - epoch(min(ts))) / 86400), 1), 6) AS play_density, floor((epoch((SELECT max(ts) FROM pl)) - epoch(max(ts))) / 86400)::BIGINT AS days_since_last FROM pl GROUP BY artist"),
    "song_totals": ([_totals("pl")], "SELECT song_id, artist, title, total_plays, skips, round(skip_rate, 6) AS skip_rate, recent_30d_plays, prev_60d_plays, round(avg_proactive, 6) AS avg_proactive, days_since_last FROM tot"),
    "half_split_skip": ([_halves("pl")], "SELECT song_id, round(first_half_skip, 6) AS first_half_skip, round(second_half_skip, 6) AS second_half_skip FROM half"),
    "peak_time": ([], "SELECT song_id, arg_min(slot, row(-n, slot)) AS peak_time_of_day FROM (SELECT song_id, CASE WHEN hour(ts) < 6 THEN 'Night' WHEN hour(ts) < 12 THEN 'Morning' WHEN hour(ts) < 18 THEN 'Afternoon' ELSE 'Evening' END AS slot, count(*) AS n FROM pe GROUP BY ALL) GROUP BY song_id"),
    "artist_known_ratio": ([_FAMIL], "SELECT artist, songs, known, round(artist_familiarity, 6) AS artist_familiarity FROM fam"),
    "weekly_trend": ([_TREND], "SELECT artist, round(artist_trend, 6) AS artist_trend FROM trend"),
    "affinity_momentum": ([_SCORES], "SELECT song_id, affinity, momentum, zone, total_plays FROM score"),
    "hidden_gems": ([_SCORES], "SELECT song_id, affinity, momentum, CASE WHEN momentum > 0.8 THEN 'fire' WHEN affinity > 0.8 THEN 'heart' WHEN momentum < 0.2 THEN 'snow' ELSE 'note' END AS icon FROM score WHERE affinity >= 0.4 AND momentum <= 0.15"),
    "growth_signals": ([], "SELECT artist, song_id AS trigger_song_id, recent, history, round(recent / history::DOUBLE, 6) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY recent DESC, song_id) AS rn FROM (SELECT artist, song_id, count(*)::BIGINT AS recent FROM pe WHERE ts >= (SELECT max(ts) FROM pe) - INTERVAL 14 DAY GROUP BY artist, song_id)) JOIN (SELECT song_id, count(*)::BIGINT AS history FROM pe GROUP BY song_id) USING (song_id) WHERE rn = 1 AND recent >= 5 AND recent / history::DOUBLE >= 0.3"),
    "decline_series": ([_DECL], "SELECT artist, weeks, round(first_mean, 6) AS first_mean, round(second_mean, 6) AS second_mean, round(slope, 6) AS slope, round(ratio, 6) AS ratio FROM decl"),
    "decline_signals": ([_DECL], "SELECT artist, coalesce(severity, 'none') AS severity FROM sev"),
    "decline_correction": ([_DECL, _totals("pd")], "SELECT song_id, artist, round(skip_rate, 6) AS skip_rate, temperature, severity, CASE WHEN severity = 'critical' AND temperature = 'Warm' THEN 'Cool' WHEN severity = 'critical' AND temperature = 'Cool' AND skip_rate > 0.15 THEN 'Frozen' WHEN severity = 'severe' AND temperature = 'Warm' AND skip_rate > 0.2 THEN 'Cool' ELSE temperature END AS corrected FROM (SELECT *, CASE WHEN skip_rate < 0.66 THEN 'Warm' ELSE 'Cool' END AS temperature FROM tot) LEFT JOIN (SELECT artist, severity FROM sev WHERE severity IS NOT NULL) USING (artist)"),
    "active_artists": ([], "SELECT artist, count(*)::BIGINT AS plays FROM pl WHERE ts >= (SELECT max(ts) FROM pl) - INTERVAL 90 DAY GROUP BY artist HAVING count(*) >= 10"),
    "modal_genre": ([], "SELECT artist, arg_min(genre, row(-n, genre)) AS genre FROM (SELECT artist, genre, count(*) AS n FROM pl GROUP BY ALL) GROUP BY artist"),
    "decline_correction_graded": ([_totals("pd")], "SELECT *, CASE WHEN severity = 'critical' AND temperature = 'Warm' THEN 'Cool' WHEN severity = 'critical' AND skip_rate > 0.15 THEN 'Frozen' WHEN severity = 'severe' AND temperature = 'Warm' AND skip_rate > 0.2 THEN 'Cool' ELSE temperature END AS corrected FROM (SELECT song_id, artist, round(skip_rate, 6) AS skip_rate, CASE WHEN skip_rate < 0.66 THEN 'Warm' ELSE 'Cool' END AS temperature, CASE artist WHEN 'ECONOMY' THEN 'critical' WHEN 'STANDARD' THEN 'severe' WHEN 'PROMO' THEN 'mild' END AS severity FROM tot)"),
    "genre_labels_named": ([_NAMED], f"SELECT p_partkey, p_type AS genre, CASE WHEN p_type <> '' THEN {_FAMILY} END AS family, {_GROUP.format('p_type')} AS grp FROM named"),
    "metadata_similarity_named": ([_NAMED], f"SELECT p.p_partkey, round(CASE WHEN p.p_type = s.p_type THEN 0.5 WHEN {_GROUP.format('p.p_type')} = {_GROUP.format('s.p_type')} THEN 0.25 ELSE 0 END + CASE WHEN abs(p.y - s.y) <= 5 THEN 0.5 * (1 - abs(p.y - s.y) / 5.0::DOUBLE) ELSE 0 END, 6)::DOUBLE AS s FROM named p, (SELECT * FROM named WHERE p_partkey = 1) s"),
    "genre_labels": ([], f"SELECT DISTINCT p_type AS genre, {_FAMILY} AS family, lower(p_type) AS grp FROM part"),
    "value_distribution": ([], "SELECT skip_type::BIGINT AS skip_type, count(*)::BIGINT AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM pl), 6) AS pct FROM pl GROUP BY skip_type"),
    "summary_quantiles": ([_RATED], "SELECT round(avg(R), 6) AS mean, " + ", ".join(f"round(quantile_cont(R, {q}), 6) AS {n}" for q, n in ((0.1, "p10"), (0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.9, "p90"))) + " FROM rated"),
    "dataset_profile": ([], "SELECT count(*)::BIGINT AS n_rows, count(DISTINCT song_id)::BIGINT AS n_songs, count(DISTINCT artist)::BIGINT AS n_artists, min(ts)::DATE::VARCHAR AS first_day, max(ts)::DATE::VARCHAR AS last_day FROM pl"),
    "score_coverage": ([_LABEL], "SELECT count(*)::BIGINT AS songs, count(label)::BIGINT AS scored, round(count(label) / count(*)::DOUBLE, 6) AS share FROM (SELECT DISTINCT song_id FROM pl) LEFT JOIN lab USING (song_id)"),
    "artist_names": ([], "SELECT p_partkey, lower(p_brand) || 'vevo' AS name, lower(p_brand) AS base FROM part"),
    "label_join": ([_LABEL], "SELECT song_id, completed_plays, label FROM (SELECT song_id, count(*) FILTER (WHERE skip_type = 0)::BIGINT AS completed_plays FROM pl GROUP BY song_id HAVING count(*) >= 5) LEFT JOIN lab USING (song_id)"),
    "score_fallback_join": ([_CAT, "sc AS (SELECT song_id, 1 + 4 * avg((skip_type = 0)::INT) AS A FROM pl GROUP BY song_id), nk AS (SELECT song_id, regexp_replace(lower(trim(title)), '\\s+', ' ', 'g') AS kt, regexp_replace(lower(trim(artist)), '\\s+', ' ', 'g') AS ka FROM cat), byname AS (SELECT kt, ka, arg_min(A, song_id) AS A2 FROM nk JOIN sc USING (song_id) WHERE song_id % 3 = 1 GROUP BY ALL)"], "SELECT song_id, round(coalesce(CASE WHEN song_id % 3 = 0 THEN A END, A2), 6) AS A FROM nk JOIN sc USING (song_id) LEFT JOIN byname USING (kt, ka)"),
    **{name: ([_CAT, _LABEL], f"SELECT song_id, artist, round(coalesce((s + {k} * g) / nullif(n + {k}, 0), g), 6) AS artist_enc FROM cat LEFT JOIN (SELECT artist, count(label) AS n, sum(label) AS s FROM cat JOIN lab USING (song_id) GROUP BY artist) USING (artist), (SELECT avg(label) AS g FROM cat JOIN lab USING (song_id))") for name, k in (("target_mean_encoding", "0.0::DOUBLE"), ("shrinkage_encoding", "3.0::DOUBLE"))},
    "play_ordinal": ([_ord("pl")], "SELECT artist, sum(gidx)::BIGINT AS total, min(gidx)::BIGINT AS first, max(gidx)::BIGINT AS last FROM ordn GROUP BY artist"),
    "exposure_interval": ([_ord("pl"), _INTERVALS], "SELECT song_id, sum(iv)::BIGINT AS total, max(iv)::BIGINT AS longest, max(fam)::BIGINT AS familiarity FROM iv GROUP BY song_id"),
    "cumulative_curve": ([_curve("pl")], "SELECT song_id, g, round(y, 6) AS y FROM cur"),
    "mean_curve": ([_curve("pd")], "SELECT g, round(avg(y), 6) AS y, count(*)::BIGINT AS songs FROM cur GROUP BY g"),
    "life_bins": ([_ord("pl"), _INTERVALS], "SELECT song_id, bin, round(m, 6) AS mean_interval FROM (SELECT song_id, bin, m, count(*) OVER (PARTITION BY song_id) AS f FROM (SELECT song_id, bin::BIGINT AS bin, avg(iv) AS m FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY fam) - 1 AS k, count(*) OVER (PARTITION BY song_id) AS n FROM iv), range(5) b(bin) WHERE n >= 8 AND bin * (n - 1) <= 5 * k AND 5 * k <= (bin + 1) * (n - 1) GROUP BY ALL)) WHERE f = 5"),
    "snapshot_panel": ([_PANEL], "SELECT song_id, T, c1, c2, c3, c4, level, slope, accel, round(dsl, 6) AS dsl, familiarity, round(age, 6) AS age, future FROM panel"),
    "state_distribution": ([_PANEL, "st AS (SELECT CASE WHEN level = 0 AND future = 0 THEN 'dead/dormant' WHEN level = 0 THEN 'revived' WHEN future > level * 1.5 THEN 'heating' WHEN future < level * 0.5 THEN 'cooling' ELSE 'stable' END AS state FROM panel)"], "SELECT state, count(*)::BIGINT AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM st), 6) AS pct FROM st GROUP BY state"),
    "session_derivation": ([], "SELECT user_id, sum(starts)::BIGINT AS sessions, sum(gap_skip)::BIGINT AS gap_skips, sum(dive)::BIGINT AS deep_dives FROM pe GROUP BY user_id"),
    "topk_per_group": ([_CAT], "SELECT artist, song_id, plays FROM cat QUALIFY row_number() OVER (PARTITION BY artist ORDER BY plays DESC, song_id) <= 3"),
    "spearman_per_song": ([_ord("pl"), _INTERVALS, _SPEAR], "SELECT song_id, n, round(rho, 6) + 0.0 AS rho FROM sp"),
    "global_spearman": ([_RATED, "rk AS (SELECT rank() OVER (ORDER BY A) + (count(*) OVER (PARTITION BY A) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY R) + (count(*) OVER (PARTITION BY R) - 1) / 2.0::DOUBLE AS y FROM rated)"], "SELECT count(*)::BIGINT AS n, round(corr(x, y), 6) AS rho FROM rk"),
    "partial_spearman": ([_RATED, "rk AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {n}" for c, n in (("A", "x"), ("R", "y"), ("familiarity", "z"))) + " FROM rated), co AS (SELECT corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM rk)"], "SELECT round(xy, 6) AS xy, round((xy - xz * yz) / sqrt((1 - xz ** 2) * (1 - yz ** 2)), 6) AS partial FROM co"),
    "wilcoxon_w": ([_ord("pl"), _INTERVALS, _SPEAR, "wr AS (SELECT v, rank() OVER (ORDER BY abs(v)) + (count(*) OVER (PARTITION BY abs(v)) - 1) / 2.0::DOUBLE AS r FROM (SELECT round(rho, 9) AS v FROM sp WHERE round(rho, 9) <> 0))"], "SELECT count(*)::BIGINT AS n, least(coalesce(sum(r) FILTER (WHERE v > 0), 0), coalesce(sum(r) FILTER (WHERE v < 0), 0)) AS W FROM wr"),
    "mannwhitney_u": ([_RATED, "mw AS (SELECT A >= 3 AS one, rank() OVER (ORDER BY familiarity) + (count(*) OVER (PARTITION BY familiarity) - 1) / 2.0::DOUBLE AS r FROM rated), mu AS (SELECT sum(r) FILTER (WHERE one) AS s, count(*) FILTER (WHERE one) AS n1, count(*) FILTER (WHERE NOT one) AS n0 FROM mw)"], "SELECT n1::BIGINT AS n1, n0::BIGINT AS n0, s - n1 * (n1 + 1) / 2.0::DOUBLE AS U, round((s - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0), 6) AS auc FROM mu"),
    "r2_persistence": ([_PANEL], "SELECT round(1 - sum((future - level) ** 2) / sum((future - m) ** 2), 6) AS r2, round(avg(abs(future - level)), 6) AS mae FROM panel, (SELECT avg(future) AS m FROM panel)"),
    "holdout_cooling": (["bef AS (SELECT * FROM pl WHERE ts < TIMESTAMP '1997-06-01')", _ord("bef"), _INTERVALS, _SPEAR], "SELECT song_id, n, round(rho, 6) + 0.0 AS rho, coalesce(f, 0)::BIGINT AS future_plays FROM sp LEFT JOIN (SELECT song_id, count(*) AS f FROM pl WHERE ts >= TIMESTAMP '1997-06-01' GROUP BY song_id) USING (song_id)"),
    "normalize_title": (["mk AS (SELECT p_partkey, p_name || ' (' || p_brand || ') feat. x' AS m, p_brand FROM part)"], f"SELECT p_partkey, {_norm('m')} AS t, array_to_string(regexp_extract_all(m, '\\(([^)]+)\\)', 1), '|') AS parens, lower(p_brand) AS a FROM mk"),
    "artist_alias": ([], "SELECT s_suppkey, lower(s_name) || CASE WHEN s_suppkey BETWEEN 1 AND 9 THEN '|supplier#' || lpad((s_suppkey + 1)::VARCHAR, 9, '0') ELSE '' END || CASE WHEN s_suppkey BETWEEN 1 AND 8 THEN '|supplier#' || lpad((s_suppkey + 2)::VARCHAR, 9, '0') ELSE '' END AS aliases FROM supplier"),
    "catalogue_search": ([_CAT], "SELECT song_id, title, artist FROM cat WHERE contains(lower(title), 'r') OR contains(lower(artist), 'r') ORDER BY title, song_id LIMIT 30"),
    "lyrics_clean": ([], "SELECT doc_id, md5(CASE WHEN length(b) > 50 THEN b END) AS digest FROM (SELECT doc_id, trim(text, ' ') AS b FROM documents)"),
    "merged_artists": (["ma AS (SELECT CASE WHEN song_id % 3 = 0 THEN artist || ' - Topic' ELSE artist END AS a, artist AS base FROM pl), mc AS (SELECT base, a, count(*) AS n FROM ma GROUP BY ALL)"], "SELECT arg_min(a, row(-n, a)) AS artist_key, sum(n)::BIGINT AS n FROM mc GROUP BY base"),
    "library_anti_join": ([_IDX, _EXT], f"SELECT ext_id, title FROM en WHERE NOT {_MATCH}"),
    "library_anti_join_all": ([_IDX, _EXT], f"SELECT ext_id, title FROM en WHERE NOT {_MATCH}"),
    "known_songs": ([_IDX], "SELECT alias, count(*)::BIGINT AS entries, count(DISTINCT song_id)::BIGINT AS songs FROM idx WHERE plays >= 30 GROUP BY alias"),
    "song_aliases": ([_ALIASES], "SELECT song_id, title_en, title_kr, artist, array_to_string(aliases, '|') AS aliases FROM al"),
    "alias_names": ([_ALIASES], "SELECT name, arg_max(song_id, song_id) AS song_id FROM (SELECT song_id, unnest(list_transform(list_filter(aliases || [title_en, title_kr], lambda x: x IS NOT NULL), lambda x: lower(trim(x)))) AS name FROM al) WHERE name <> '' GROUP BY name"),
    "find_song": ([_ALIASES], "SELECT song_id, CASE WHEN title_kr <> title_en THEN title_kr || ' (' || title_en || ')' ELSE title_en END || ' — ' || artist AS display, (CASE WHEN contains(title_kr, '노을') THEN 0.9 ELSE 0.85 END)::DOUBLE AS score FROM al WHERE contains(title_kr, '노을') OR len(list_filter(aliases, lambda x: contains(x, '노을'))) > 0 ORDER BY score DESC, song_id LIMIT 10"),
    "find_song_exact": ([_ALIASES], "SELECT song_id, title_kr || ' (' || title_en || ') — ' || artist AS display, 1.0::DOUBLE AS score FROM al WHERE title_kr = '한걸음' AND contains(lower(artist), 'jannabi') ORDER BY song_id DESC LIMIT 1"),
    "seed_resolution": ([_CAT, "sd AS (SELECT p_partkey AS seed_id, CASE p_partkey % 4 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN p_name || ' (Remix)' WHEN 2 THEN upper(p_name) ELSE substr(p_name, 2, 2) END AS t, CASE WHEN p_partkey % 3 = 0 THEN substr(p_brand, 1, 7) ELSE upper(p_brand) END AS a FROM part)"], "SELECT seed_id, min(song_id) AS song_id FROM sd LEFT JOIN cat ON (contains(lower(title), lower(t)) OR contains(lower(t), lower(title))) AND contains(lower(artist), lower(a)) GROUP BY seed_id"),
    "nostalgia_by_tags": ([_IDX, "tr AS (SELECT c_custkey AS ext_id, n_name AS tag, CASE WHEN c_custkey % 2 = 0 THEN 'BRAND#1' ELSE 'Band#' END || c_custkey % 9 AS artist, c_mktsegment || ' ' || c_custkey % 40 AS title, c_acctbal AS l FROM customer JOIN nation ON c_nationkey = n_nationkey QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey) <= 30), t1 AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY lower(artist), lower(title) ORDER BY tag, l DESC, ext_id) = 1)", f"en AS (SELECT *, lower(artist) AS alias, {_norm('title')} AS t, list_transform(regexp_extract_all(title, '\\(([^)]+)\\)', 1), lambda x: {_norm('x')}) AS p FROM t1)"], f"SELECT ext_id, tag, artist, title, alias IN (SELECT alias FROM idx) AS knows_artist FROM en WHERE NOT {_MATCH}"),
    "lyrics_query": ([], "SELECT p_partkey, p_name AS title, p_brand AS artist, p_name || ' — ' || p_brand AS shown FROM part"),
    "mixer_weights": ([_SCORES, "mw AS (SELECT s.song_id, affinity, momentum, greatest(0.01, coalesce(CASE WHEN s.song_id % 7 <> 0 THEN (s.song_id % 101) * 100.0::DOUBLE / 103.0::DOUBLE END, 100.0::DOUBLE) / 100.0::DOUBLE) AS ctx, A FROM score s LEFT JOIN (SELECT song_id, 1 + 4 * avg((skip_type = 0)::INT) AS A FROM pd GROUP BY song_id HAVING 1 + 4 * avg((skip_type = 0)::INT) < 3) USING (song_id))"], "SELECT song_id, " + ", ".join(f"round(pow(affinity, {a}) * pow(momentum, {m}) * pow(ctx, {c}), 6) AS w_{n}" for n, a, m, c in (("default", 1, 1, 1), ("explore", 0.7, 0.5, 1.5), ("comfort", 1.5, 0.7, 0.8))) + ", round(0.45 * coalesce(A, 2.5) / 5 + 0.55 * ctx, 6) AS w_lgbm FROM mw"),
    "vector_cosine_topk": ([], f"SELECT vec_id AS song_id, round({_COS.format('embedding', 's')}, 6) AS similarity FROM embeddings, (SELECT embedding AS s FROM embeddings WHERE vec_id = 0) WHERE vec_id <> 0 ORDER BY {_COS.format('embedding', 's')} DESC, vec_id LIMIT 20"),
    "vector_zscore": (["lo AS (SELECT vec_id AS song_id, i, embedding[i + 1]::DOUBLE AS x FROM embeddings, range(64) r(i))"], "SELECT song_id, i::BIGINT AS i, round(coalesce((x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0), 0), 6) + 0.0 AS z FROM lo WINDOW w AS (PARTITION BY i)"),
    "vector_zscore_all": (["lo AS (SELECT vec_id AS song_id, i, embedding[i + 1]::DOUBLE AS x FROM embeddings, range(64) r(i))"], "SELECT song_id, i::BIGINT AS i, round(coalesce((x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0), 0), 6) + 0.0 AS z FROM lo WINDOW w AS (PARTITION BY i)"),
    "vector_impute": ([_CAT, "lo AS (SELECT vec_id AS song_id, i, embedding[i + 1]::DOUBLE AS x FROM embeddings, range(64) r(i)), mn AS (SELECT i, avg(x) AS m FROM lo GROUP BY i)"], "SELECT song_id, round(sum(coalesce(x, m)), 6) AS x FROM cat CROSS JOIN mn LEFT JOIN lo USING (song_id, i) GROUP BY song_id"),
    "tfidf": ([_TFIDF], "SELECT doc_id, count(*)::BIGINT AS terms, round(max(w), 6) AS top, round(sum(w), 6) AS total FROM tfidf GROUP BY doc_id"),
    "tfidf_cosine": ([_TFIDF], "SELECT seed, doc_id, similarity FROM (SELECT a.doc_id AS seed, b.doc_id AS doc_id, round(sum(a.w * b.w), 6) AS similarity FROM tfidf a JOIN tfidf b USING (token) WHERE a.doc_id % 20 = 0 AND a.doc_id <> b.doc_id GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY similarity DESC, doc_id) <= 10"),
    "candidate_library_similarity": ([_TAGS, "n AS (SELECT count(*) AS n FROM tag WHERE lib), lib AS (SELECT id, unnest(tags) AS tag FROM tag WHERE lib), cand AS (SELECT id, unnest(tags) AS tag FROM tag WHERE NOT lib), df AS (SELECT tag, count(*) AS df FROM lib GROUP BY tag), al AS (SELECT c.id AS cand, l.id AS lib, l.tag, (ln((2.0 + (SELECT n FROM n))::DOUBLE / (1 + df + (EXISTS (SELECT 1 FROM cand x WHERE x.id = c.id AND x.tag = l.tag))::INT)) + 1) AS w FROM (SELECT DISTINCT id FROM cand) c, lib l JOIN df USING (tag)), ll AS (SELECT cand, lib, sqrt(sum(w * w)) AS l FROM al GROUP BY ALL), cw AS (SELECT id AS cand, tag, ln((2.0 + (SELECT n FROM n))::DOUBLE / (2 + coalesce(df, 0))) + 1 AS w FROM cand LEFT JOIN df USING (tag)), cl AS (SELECT cand, sqrt(sum(w * w)) AS l FROM cw GROUP BY cand), dd AS (SELECT cand, lib, sum(al.w * cw.w) AS d FROM al JOIN cw USING (cand, tag) GROUP BY ALL)"], "SELECT id, round(coalesce(s, 0), 6) AS similarity FROM (SELECT id FROM tag WHERE NOT lib) LEFT JOIN (SELECT cand AS id, sum(d / ll.l / cl.l) / (SELECT n FROM n) AS s FROM dd JOIN ll USING (cand, lib) JOIN cl USING (cand) GROUP BY cand) USING (id)"),
    "metadata_similarity": (["py AS (SELECT p_partkey, p_type, 1990 + p_size % 30 AS y FROM part)"], "SELECT p.p_partkey, round(CASE WHEN p.p_type = s.p_type THEN 0.5 ELSE 0 END + CASE WHEN abs(p.y - s.y) <= 5 THEN 0.5 * (1 - abs(p.y - s.y) / 5.0::DOUBLE) ELSE 0 END, 6)::DOUBLE AS s FROM py p, (SELECT * FROM py WHERE p_partkey = 1) s"),
    "multi_signal": (["sg AS (SELECT p_partkey, " + ", ".join(f"CASE WHEN p_partkey % {m} <> 0 THEN (p_partkey % {q}) / {q}.0::DOUBLE END AS {n}" for n, m, q in (("tag", 5, 17), ("lyrics", 3, 11), ("audio", 7, 13), ("meta", 4, 19))) + " FROM part)"], "SELECT p_partkey, round(least(greatest(CASE WHEN tag > 0 THEN 0.25 * tag + 0.03 * coalesce(lyrics, 0.3) + 0.58 * coalesce(audio, 0.3) + 0.14 * coalesce(meta, 0.3) ELSE 0.04 * coalesce(lyrics, 0.3) + 0.78 * coalesce(audio, 0.3) + 0.18 * coalesce(meta, 0.3) END, 0), 1), 6)::DOUBLE AS s FROM sg"),
    "signal_breakdown": (["sg AS (SELECT p_partkey, " + ", ".join(f"CASE WHEN p_partkey % {m} <> 0 THEN (p_partkey % {q}) / {q}.0::DOUBLE END AS {n}" for n, m, q in (("tag", 5, 17), ("lyrics", 3, 11), ("audio", 7, 13), ("meta", 4, 19))) + " FROM part)"], "SELECT p_partkey, " + ", ".join(f"round({c}, 6) AS {c}, round(CASE WHEN tag > 0 THEN {w} ELSE {o} END::DOUBLE * coalesce({c}, 0.3), 6) AS {c}_part" for c, w, o in (("tag", 0.25, 0.0), ("lyrics", 0.03, 0.04), ("audio", 0.58, 0.78), ("meta", 0.14, 0.18))) + " FROM sg"),
    "context_score": ([_CAT, f"sv AS (SELECT c.*, embedding AS v FROM cat c JOIN embeddings ON vec_id = song_id), sd AS (SELECT * FROM sv WHERE artist = 'Brand#11' ORDER BY song_id LIMIT 1), t3 AS (SELECT * FROM sv QUALIFY row_number() OVER (PARTITION BY artist ORDER BY plays DESC, song_id) <= 3), ar AS (SELECT a.artist, avg({_COS.format('a.v', 'b.v')}) AS s FROM t3 a, t3 b WHERE b.artist = 'Brand#11' GROUP BY a.artist)"], f"SELECT sv.song_id, round(100 * (0.6 * least(greatest({_COS.format('sv.v', 'sd.v')}, 0), 1) + 0.4 * CASE sv.artist WHEN 'Brand#11' THEN 1 WHEN 'Brand#12' THEN 0.8 WHEN 'Brand#13' THEN 0.4 ELSE coalesce(ar.s, 0) END), 6) AS context FROM sv JOIN sd ON sv.song_id <> sd.song_id LEFT JOIN ar ON ar.artist = sv.artist"),
    **{f"mode_playlist_{m}": ([_RATED, f"rs AS (SELECT *, A * pow(1 + R, {b}) AS s, (SELECT quantile_cont(familiarity, 0.3) FROM rated) AS q FROM rated), mn AS (SELECT *, 'main' AS slot FROM rs WHERE familiarity > q ORDER BY s DESC, song_id LIMIT 16), nw AS (SELECT *, 'new' AS slot FROM rs WHERE familiarity <= q ORDER BY A DESC, song_id LIMIT 4)"], "SELECT song_id, round(A, 6) AS A, round(R, 6) AS R, round(s, 6) AS s, familiarity, slot FROM (FROM mn UNION ALL FROM nw)") for m, b in _MODES.items()},
    "playlist_tags": ([_RATED], "SELECT song_id, CASE WHEN familiarity < 8 THEN 'new' WHEN level28 >= 3 THEN 'now' WHEN dsl >= 30 THEN 'dormant' ELSE '' END AS tag FROM rated"),
    "seed_recommend": ([_RATED, f"uv AS (SELECT r.*, list_transform(embedding, lambda x: x::DOUBLE / (sqrt({_DOT.format('embedding', 'embedding')}) + 1e-9)) AS u FROM rated r JOIN embeddings ON vec_id = song_id), nr AS (SELECT a.song_id, a.A, a.R, list_inner_product(a.u, b.u) AS similarity FROM uv a, uv b WHERE b.song_id = 7 AND a.song_id <> 7 ORDER BY similarity DESC, a.song_id LIMIT 40), rk AS (SELECT *, similarity * A * (1 + R) AS score FROM nr ORDER BY score DESC, song_id LIMIT 19)"], "SELECT song_id, round(similarity, 6) AS similarity, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, song_id) + 1 AS pos FROM rk UNION ALL SELECT 7, 1.0, NULL, 1 FROM uv WHERE song_id = 7"),
    "weighted_sample": ([_RATED], f"SELECT song_id, round(A, 6) AS A FROM rated ORDER BY -ln(greatest({_u('s1', 'song_id')}, 1e-12)) / greatest(A, 1e-9), song_id LIMIT 25"),
    "artist_cap": ([_RATED, _CAT], "SELECT song_id, artist FROM rated JOIN cat USING (song_id) QUALIFY row_number() OVER (PARTITION BY artist ORDER BY A * (1 + R) DESC, song_id) <= 4"),
    "quota_fill": ([_totals("pl"), "qt AS (SELECT song_id, CASE WHEN total_plays > 34 THEN 'deep_dive' WHEN total_plays > 28 THEN 'expand' ELSE 'explore' END AS tier, 1 - skip_rate AS score FROM tot), qr AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY score DESC, song_id) <= CASE tier WHEN 'explore' THEN 4 ELSE 8 END AS in_quota FROM qt)"], "SELECT song_id, tier, in_quota FROM qr ORDER BY in_quota DESC, score DESC, song_id LIMIT 20"),
    "slot_insert": ([], "SELECT unnest([101, 102, 103, 104])::BIGINT AS song_id, unnest([4, 7, 10, 13])::BIGINT AS pos, true AS is_new UNION ALL SELECT * FROM (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16])::BIGINT, unnest([0, 1, 2, 3, 5, 6, 8, 9, 11, 12, 14, 15, 16, 17, 18, 19])::BIGINT, false) WHERE (SELECT count(*) FROM part) >= 104"),
    "internal_discovery": ([_SCORES], "SELECT song_id, artist, 2::BIGINT AS kind, similarity FROM (SELECT *, (song_id % 50)::DOUBLE AS similarity FROM score WHERE total_plays <= 3 AND affinity >= 0.3 AND song_id % 50 >= 15) QUALIFY row_number() OVER (PARTITION BY lower(artist) ORDER BY similarity DESC, song_id) = 1 ORDER BY similarity DESC, song_id LIMIT 6"),
    "external_discovery": (["tk AS (SELECT c_custkey AS ext_id, n_name AS artist, greatest(0, c_acctbal) AS listeners, n_nationkey / 25.0::DOUBLE AS m, n_nationkey % 13 AS songs, (c_custkey % 100) / 100.0::DOUBLE AS sim FROM customer JOIN nation ON c_nationkey = n_nationkey), tt AS (SELECT *, CASE WHEN songs >= 11 THEN 'deep_dive' WHEN songs >= 3 THEN 'expand' ELSE 'explore' END AS tier FROM tk WHERE sim BETWEEN 0.25 AND 0.85), ts AS (SELECT *, 0.5 * sim + 0.3 * m + 0.2 * coalesce(listeners / nullif(max(listeners) OVER (PARTITION BY tier), 0), 0) AS score FROM tt), tc AS (SELECT * FROM ts QUALIFY row_number() OVER (PARTITION BY artist ORDER BY score DESC, ext_id) <= 2), tq AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY score DESC, ext_id) <= CASE tier WHEN 'explore' THEN 4 ELSE 8 END AS q FROM tc)"], "SELECT ext_id, artist, tier, round(score, 6) AS score FROM tq ORDER BY q DESC, tq.score DESC, ext_id LIMIT 20"),
    "nostalgia_internal": ([], f"SELECT song_id, artist, plays, away FROM (SELECT song_id, arg_min(artist, {_ORD}) AS artist, count(*)::BIGINT AS plays, min(ts) AS f, floor((epoch({_NOW_D}) - epoch(max(ts))) / 86400)::BIGINT AS away FROM pd GROUP BY song_id) WHERE f <= (SELECT min(ts) FROM pd) + INTERVAL 400 DAY AND plays BETWEEN 3 AND 15 AND away >= 180 AND artist NOT IN (SELECT artist FROM pd WHERE ts >= {_NOW_D} - INTERVAL 90 DAY GROUP BY artist HAVING count(*) >= 10)"),
    "nostalgia_external": ([_IDX, "mo AS (SELECT artist FROM pl GROUP BY artist ORDER BY count(*) DESC, artist LIMIT 30), tr AS (SELECT p_partkey AS ext_id, p_brand AS artist, p_name || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' ' || p_partkey END AS title FROM part WHERE p_brand IN (FROM mo) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 10)", f"en AS (SELECT *, lower(artist) AS alias, {_norm('title')} AS t, list_transform(regexp_extract_all(title, '\\(([^)]+)\\)', 1), lambda x: {_norm('x')}) AS p FROM tr)"], f"SELECT ext_id, artist, title FROM en WHERE NOT {_MATCH}"),
    "tag_frequency": ([_TAGS, _TOP], "SELECT tag, weight FROM top"),
    "tag_frequency_all": ([_TAGS, _TOP.replace("WHERE lib UNION", "UNION")], "SELECT tag, weight FROM top"),
    "nostalgia_select": ([_TAGS, _TOP], "SELECT id AS song_id, overlap, round(overlap / (SELECT count(*) FROM top)::DOUBLE + CASE WHEN id % 2 = 0 THEN 0.15 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 0.1 ELSE 0 END, 6) AS score FROM (SELECT id, len(list_intersect(tags, tt))::BIGINT AS overlap FROM tag, (SELECT list(tag) AS tt FROM top) WHERE NOT lib) WHERE overlap >= 2 ORDER BY score DESC, song_id LIMIT 10"),
    "incremental_anti_join": ([], "SELECT doc_id AS song_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"),
    "ordered_union_distinct": (["ow AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), oc AS (SELECT doc_id, w || list_reverse(w) AS c FROM ow), ou AS (SELECT doc_id, min(i) AS i, c[i] AS x FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM oc) GROUP BY doc_id, c[i])"], "SELECT doc_id, array_to_string(list(x ORDER BY i)[1:15], ' ') AS tags FROM ou GROUP BY doc_id"),
    "hash_uniform": ([], f"SELECT p_partkey, round({_u('u', 'p_partkey')}, 6) AS u FROM part"),
    "time_keys": ([], f"SELECT o_orderkey, {_WEEK.format('o_orderdate')} AS week, floor((epoch(TIMESTAMP '1999-01-01 12:00:00') - epoch(o_orderdate)) / 86400)::BIGINT AS days, CASE WHEN hour(o_orderdate) < 6 THEN 'Night' WHEN hour(o_orderdate) < 12 THEN 'Morning' WHEN hour(o_orderdate) < 18 THEN 'Afternoon' ELSE 'Evening' END AS slot FROM orders"),
    "lyrics_head": ([], "SELECT doc_id, md5(left(text, 2000)) AS digest FROM documents"),
    "url_quote": ([], "SELECT p_partkey, replace(url_encode(p_name || ' & ~' || p_brand || '/*+é'), '%2F', '/') AS q FROM part"),
    "release_fields": ([], "SELECT p_partkey, try_cast(left(CASE WHEN p_size > 5 THEN (1990 + p_size % 30)::VARCHAR || '-05-01' ELSE p_name END, 4) AS BIGINT) AS year, split_part(p_brand || ' - Topic - ' || p_name, ' - ', 1) AS artist FROM part"),
    "artist_tier_default": ([_CAT], "SELECT song_id, CASE WHEN p >= 30 THEN 'S' WHEN p IS NOT NULL THEN 'A' ELSE 'B' END AS tier FROM cat LEFT JOIN (SELECT artist, count(*) AS p FROM pl WHERE ts >= (SELECT max(ts) FROM pl) - INTERVAL 90 DAY GROUP BY artist HAVING count(*) >= 10) USING (artist)"),
    "labels_by_name": ([_CAT, _LABEL, "nk AS (SELECT song_id, lower(trim(title)) AS kt, lower(trim(artist)) AS ka FROM cat)"], "SELECT song_id, round(coalesce(l2, l1), 6) AS label FROM nk LEFT JOIN (SELECT kt, ka, arg_max(label, song_id) AS l1, arg_max(5 - label, song_id) FILTER (WHERE label > 2) AS l2 FROM nk JOIN lab USING (song_id) GROUP BY kt, ka) USING (kt, ka)"),
    "uniform_of_best": ([_RATED], f"SELECT song_id FROM (SELECT song_id FROM rated ORDER BY A DESC, song_id LIMIT 20) ORDER BY {_u('pick', 'song_id')}, song_id LIMIT 1"),
    "ranking_file_join": ([_CAT], "SELECT song_id, round(score, 6) AS score FROM cat JOIN (SELECT p_name AS title, p_brand AS artist, arg_max(p_retailprice::DOUBLE, p_partkey) AS score FROM part GROUP BY ALL) USING (title, artist)"),
    "song_rates": ([], "SELECT song_id, round(avg(starts), 6) AS is_session_start, round(avg(dive), 6) AS is_artist_deep_dive, round(avg(pro), 6) AS is_proactive FROM pe JOIN (SELECT event_id, (event_type = 'purchase')::INT AS pro FROM events) USING (event_id) WHERE song_id IS NOT NULL GROUP BY song_id HAVING count(*) >= 5"),
    "fold_encodings": (_FOLDS, "SELECT rep::BIGINT AS rep, f::BIGINT AS fold, song_id, round(coalesce(s / nullif(n, 0), g), 6) AS mean_enc, round((s + 3 * g) / (n + 3), 6) AS shrink_enc FROM (SELECT DISTINCT song_id, artist FROM kf) JOIN ag USING (artist) JOIN gl USING (rep, f)"),
    "panel_line_oof": ([_PANEL, f"pf AS (SELECT *, floor({_u('fold', 'song_id')} * 5)::INT AS fold FROM panel), ft AS (SELECT f, regr_slope(future::DOUBLE, level::DOUBLE) FILTER (WHERE fold <> f) AS b, regr_intercept(future::DOUBLE, level::DOUBLE) FILTER (WHERE fold <> f) AS a FROM pf, range(5) q(f) GROUP BY f)"], "SELECT song_id, T, round(a + b * level, 6) AS predicted FROM pf JOIN ft ON f = fold"),
    "forecast_baselines": ([_curve("pd"), _BASELINES], "SELECT song_id, n, past, future, persistence, round(population, 6) AS population FROM bl"),
    "baseline_errors": ([_curve("pd"), _BASELINES], " UNION ALL ".join(f"SELECT '{c}' AS predictor, count(*)::BIGINT AS n, round(avg(abs({c} - future)), 6) AS mae, round(quantile_cont(abs({c} - future), 0.5), 6) AS median_error, round(corr(x, y), 6) AS rho FROM (SELECT *, {_AVG_RANK.format(c)} AS x, {_AVG_RANK.format('future')} AS y FROM bl)" for c in ("persistence", "population"))),
    "holdout_groups": (["bef AS (SELECT * FROM pl WHERE ts < TIMESTAMP '1997-06-01')", _ord("bef"), _INTERVALS, _SPEAR, "hd AS (SELECT round(rho, 9) AS rho, coalesce(f, 0)::BIGINT AS fp FROM sp LEFT JOIN (SELECT song_id, count(*) AS f FROM pl WHERE ts >= TIMESTAMP '1997-06-01' GROUP BY song_id) USING (song_id) WHERE rho IS NOT NULL)",
                        "hq AS (SELECT quantile_cont(rho, 0.25) AS lo, quantile_cont(rho, 0.75) AS hi FROM hd), hg AS (SELECT fp, true AS one FROM hd, hq WHERE rho >= hi UNION ALL SELECT fp, false FROM hd, hq WHERE rho <= lo)", f"hr AS (SELECT *, {_AVG_RANK.format('fp')} AS r FROM hg)"],
                       "SELECT n1, n0, round(m1, 6) AS mean1, round(m0, 6) AS mean0, s - n1 * (n1 + 1) / 2.0::DOUBLE AS U, round((s - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0), 6) AS auc FROM (SELECT count(*) FILTER (WHERE one)::BIGINT AS n1, count(*) FILTER (WHERE NOT one)::BIGINT AS n0, avg(fp) FILTER (WHERE one) AS m1, avg(fp) FILTER (WHERE NOT one) AS m0, sum(r) FILTER (WHERE one) AS s FROM hr)"),
    "vector_silhouette": (["sv AS (SELECT vec_id, label::BIGINT AS label, embedding::DOUBLE[] AS e FROM embeddings), sp AS (SELECT a.vec_id, a.label AS c, b.label AS o, avg(list_distance(a.e, b.e)) AS d FROM sv a JOIN sv b ON a.vec_id <> b.vec_id GROUP BY ALL), ss AS (SELECT vec_id, c, max(d) FILTER (WHERE o = c) AS a, min(d) FILTER (WHERE o <> c) AS b FROM sp GROUP BY ALL)"], "SELECT c AS label, count(*)::BIGINT AS n, round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM ss GROUP BY c"),
}


def oracle_sql() -> dict[str, str]:
    return {name: f"{_BASE}{''.join(f', {c}' for c in ctes)}\n{select}" for name, (ctes, select) in _SQL.items()}
