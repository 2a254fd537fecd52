"""The queries of this subpackage, opN_<name>, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fairloom.operators.storage import table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairloom.llm.decontamination import contamination_report

    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairloom.llm.surrogates import pseudonymised

    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairloom.llm.language import language_report

    return language_report(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairloom.llm.substrings import removal_report

    return removal_report(table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairloom.llm.neighbours import neighbour_report

    return neighbour_report(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairloom.llm.toxicity import toxicity_report

    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairloom.llm.simhash import component_report

    return component_report(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairloom.llm.chat import formatted

    return formatted(table(spark, sf_dir, "conversations"))


def op9_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairloom.llm.secrets import secrets_report

    return secrets_report(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairloom.llm.runs import run_report

    return run_report(table(spark, sf_dir, "documents"))


def op12_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairloom.llm.wrappers import extracted

    return extracted(table(spark, sf_dir, "pages"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairloom.llm.alignment import alignment_report

    return alignment_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_benchmark_decontamination,
    op2_pii_surrogates,
    op3_language_id,
    op4_substring_dedup,
    op5_nearest_neighbours,
    op6_toxicity,
    op7_simhash_near_dedup,
    op8_chat_formatting,
    op9_best_two_fit_packing,
    op10_secret_scans,
    op11_periodic_runs,
    op12_wrapper_induction,
    op13_cross_tokenizer_alignment,
)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_WORDS1 = r"regexp_extract_all(" + _ASCII_LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_benchmark_decontamination": f"""
WITH item AS (SELECT item_id, {_WORDS1} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < 10 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i+9], ' ') FOR i IN range(1, len(w) - 8)] END) AS gram,
    CASE WHEN len(w) < 10 THEN len(w) ELSE 10 END AS n
  FROM item WHERE len(w) > 0),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS1} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS p,
    unnest([array_to_string(w[i:i+n-1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS gram
  FROM doc, sizes WHERE len(w) >= n),
hits AS (SELECT r, p, g.n, item_id FROM grams g JOIN windows USING (gram, n)),
covered AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
named AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s
  FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
""",
    "op4_substring_dedup": r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT r, doc_id, unnest(range(1, len(w) - 11)) AS p,
    unnest([array_to_string(w[i:i+12], ' ') FOR i IN range(1, len(w) - 11)]) AS g FROM doc WHERE len(w) >= 13),
firsts AS (SELECT g, min(doc_id) AS first_id FROM grams GROUP BY g),
hit AS (SELECT r, p FROM grams JOIN firsts USING (g) WHERE doc_id > first_id),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 13)) AS q FROM hit),
lists AS (SELECT r, list(q) AS q, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN q IS NULL THEN w ELSE [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(q, i)] END, ' ')) AS kept_sha256
FROM doc LEFT JOIN lists USING (r)
""",
    "op8_chat_formatting": r"""
WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
chats AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY turn NULLS FIRST, role, text) AS chat,
    list(len(role) || ':' || role || len(text) || ':' || text ORDER BY turn NULLS FIRST, role, text) AS said
  FROM turns GROUP BY conv_id, CASE WHEN conv_id IS NULL THEN concat_ws(chr(31), coalesce(turn::VARCHAR, ''), role, text) END),
begun AS (SELECT DISTINCT array_to_string(said[1:i], chr(31)) AS s, i FROM (SELECT said, unnest(range(1, len(said))) AS i FROM chats)),
whole AS (SELECT array_to_string(said, chr(31)) AS s, n_turns, chat, min(conv_id) AS conv_id, count(*) AS copies FROM chats GROUP BY ALL)
SELECT conv_id, n_turns, copies, chat FROM whole WHERE NOT EXISTS (SELECT 1 FROM begun WHERE begun.s = whole.s AND begun.i = whole.n_turns)
""",
    "op10_secret_scans": r"""
WITH rules(rank, kind, pattern, least) AS (VALUES
  (1, 'assign', '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 12),
  (2, 'access', 'AKIA[A-Z0-9]+', 18), (3, 'hex', '[0-9a-f]+', 16),
  (4, 'private_key', '-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)?', 0),
  (5, 'jwt', 'eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}', 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT r, 1 AS rank, regexp_extract_all(text, (SELECT pattern FROM rules WHERE rank = 1)) AS m,
    regexp_extract_all(text, (SELECT pattern FROM rules WHERE rank = 1), 2) AS v,
    string_split_regex(text, (SELECT pattern FROM rules WHERE rank = 1)) AS g FROM doc
  UNION ALL SELECT r, 2, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'),
    string_split_regex(text, 'AKIA[A-Z0-9]+') FROM doc
  UNION ALL SELECT r, 3, regexp_extract_all(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'),
    string_split_regex(text, '[0-9a-f]+') FROM doc
  UNION ALL SELECT r, 4, regexp_extract_all(text, (SELECT pattern FROM rules WHERE rank = 4)), regexp_extract_all(text, (SELECT pattern FROM rules WHERE rank = 4)), string_split_regex(text, (SELECT pattern FROM rules WHERE rank = 4)) FROM doc
  UNION ALL SELECT r, 5, regexp_extract_all(text, (SELECT pattern FROM rules WHERE rank = 5)), regexp_extract_all(text, (SELECT pattern FROM rules WHERE rank = 5)), string_split_regex(text, (SELECT pattern FROM rules WHERE rank = 5)) FROM doc),
each AS (SELECT r, rank, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(v) AS v, unnest(g[1:len(m)]) AS g FROM parts),
placed AS (
  SELECT r, rank, length(v) AS n, sum(length(g) + length(m)) OVER (PARTITION BY r, rank ORDER BY i) AS stop, length(m) AS size FROM each),
kept AS (
  SELECT r, rank, kind, (stop - size)::BIGINT AS s, stop::BIGINT AS e FROM placed JOIN rules USING (rank) WHERE n >= least),
found AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank <= 3) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM kept GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN found USING (r)
""",
    "op11_periodic_runs": r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sums AS (SELECT *, len(w) AS n, coalesce(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ascii(d)::BIGINT FOR d IN string_split(doc_id::VARCHAR, '')]),
    lambda c, d: list_reduce(list_prepend(xor(c, d), [0::BIGINT FOR k IN range(8)]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))), 1) AS h FROM doc),
parts AS (SELECT *, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM sums),
said AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] FOR i IN range(n)] ELSE w END AS w FROM parts),
grams AS (SELECT r, n, unnest(range(n - 4)) AS i, unnest([w[i:i+4] FOR i IN range(1, n - 3)]) AS g FROM said WHERE n >= 5),
twice AS (SELECT * FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
same AS (SELECT x.r, y.i - x.i AS q, x.i FROM twice x JOIN twice y ON x.r = y.r AND x.g = y.g AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same),
long AS (SELECT r, q, min(i) AS s, count(*) + 4 + q AS len FROM islands GROUP BY r, q, island HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
runs AS (SELECT r, s, len, min(q) AS q FROM long GROUP BY r, s, len),
listed AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS l FROM runs GROUP BY r),
best AS (SELECT r, s, len, q FROM runs x WHERE NOT EXISTS (SELECT 1 FROM runs y WHERE y.r = x.r
  AND (y.len * x.q > x.len * y.q OR (y.len * x.q = x.len * y.q AND (y.s < x.s OR (y.s = x.s AND y.q < x.q)))))),
gone AS (SELECT r, list(DISTINCT i) AS gone FROM (SELECT r, unnest(range(s + q, s + len)) AS i FROM runs) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, len::BIGINT AS length, q::BIGINT AS period, (1000 * len // q)::BIGINT AS exponent_milli,
  sha256(coalesce(l, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE [w[i + 1] FOR i IN range(n) IF NOT list_contains(gone, i)] END, ' ')) AS collapsed_sha256
FROM said LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN gone USING (r)
""",
}
