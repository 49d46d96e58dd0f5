"""One query for each operator over its whole table, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, fingerprints, jaccard_join, lattice_lm, licences, mixing, packing, page_text, quality_rules, suffix_dedup
from .scratch import documents

Query = Callable[[SparkSession, str], DataFrame]

_CONTROL = "<|im_end|><|im_start|>assistant ok"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_texts(documents(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_report(documents(spark, sf_dir))


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_documents(documents(spark, sf_dir))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(documents(spark, sf_dir))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{_CONTROL}'), (-1L, 1L, 'assistant', '{_CONTROL}') AS t(conv_id, turn, role, text)")
    return chat_format.digests(chat_format.format_chats(turns.union(probe)))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).documents


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(documents(spark, sf_dir))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_packing, op2_page_text, op3_suffix_dedup, op4_lattice_lm, op5_fingerprints, op6_chat_format, op7_mixing,
        op8_jaccard_join, op9_licences, op10_quality_rules, pipeline,
    )
}  # fmt: skip

_CHATS_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{_CONTROL}'), (-1, 1, 'assistant', '{_CONTROL}')
), e AS (
  SELECT *, replace(replace(text, '&', '&amp;'), '<|', '&lt;|') AS said,
    replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&nl;') AS name,
    lag(role) OVER w IS DISTINCT FROM role AS opens, lead(role) OVER w IS DISTINCT FROM role AS closes
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(said) + CASE WHEN opens THEN {len(chat_format.START)} + length(name) + 1 ELSE {len(chat_format.APART)} END
    + CASE WHEN closes THEN {len(chat_format.END)} + 1 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w
), sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_common FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * n_common >= 75 * (p.n + q.n - n_common)
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, r AS component_id
FROM documents d JOIN (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id) USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


def _canonical_sql(text: str) -> str:
    kept = rf"regexp_replace(lower(coalesce({text}, '')), '(?m)^[^\p{{L}}\n]*(?:copyright\b[^\n]*(?:\d{{4}}|\(c\)|©|<)|©|\(c\))[^\n]*$', ' ', 'g')"
    words = rf"' ' || regexp_replace(trim(regexp_replace({kept}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ', '  ', 'g') || ' '"
    for other, one in licences.SPELLINGS.items():
        words = f"replace({words}, ' {other.replace(' ', '  ')} ', ' {one} ')"
    return f"sha256(regexp_replace(trim({words}), ' +', ' ', 'g'))"


def _licences_sql() -> str:
    known = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in licences.KNOWN)
    return f"""
WITH known AS (SELECT {_canonical_sql("body")} AS digest, any_value(license) AS license FROM (VALUES {known}) k(license, body) GROUP BY 1),
d AS (SELECT doc_id, {_canonical_sql("text")} AS digest FROM documents)
SELECT doc_id, digest, license FROM d LEFT JOIN known USING (digest)
"""


def _quality_sql() -> str:
    rules = quality_rules.LineRules()
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    n_of = lambda text, signs: f"(length({text}) - length(translate({text}, '{signs}', '')))"  # noqa: E731
    bars = n_of("line", rules.separators)
    furniture = " OR ".join(f"contains(lower(line), '{x}')" for x in rules.furniture)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ 	-]+'), lambda x: x <> '') AS ws FROM d),
l AS (
  SELECT doc_id, line, len(list_filter(regexp_split_to_array(line, '[ 	-]+'), lambda x: x <> '')) AS n,
    length(translate(line, {blanks}, '')) AS chars FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
), judged AS (
  SELECT *, {n_of("line", rules.symbols)} > n * {rules.symbols_per_word} OR (n > 3 AND {n_of("line", "!?")} > n * {rules.marks_per_word})
    OR (n >= {rules.run_on_words} AND {n_of("line", ".!?,;:")} = 0)
    OR ({bars} >= {rules.least_separators} AND n - {bars} <= ({bars} + 1) * {rules.words_per_item})
    OR (n <= {rules.furniture_words} AND ({furniture})) AS fails FROM l WHERE n > 0
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dup, coalesce(sum(chars) FILTER (NOT fails), 0) AS kept_chars FROM judged GROUP BY doc_id
), tri AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS again FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), cover AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE again > 1) GROUP BY doc_id
), figures AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(translate(t, {blanks}, ''))::BIGINT AS word_chars, {n_of("t", "#*$%&|<>")}::BIGINT AS n_symbols,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words, coalesce(kept_chars, 0)::BIGINT AS kept_chars
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN cover USING (doc_id)
), failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM figures)
SELECT *, NOT base_failed AND word_chars - kept_chars <= word_chars * {rules.most_lost} AS kept FROM failed
"""


#: For the others SQL has no tokenizers, bytes of strings, hash or segmentations of the method; tests/llm has brute-force versions.
ORACLE_SQL: dict[str, str] = {"op6_chat_format": _CHATS_SQL, "op8_jaccard_join": _JACCARD_SQL, "op9_licences": _licences_sql(), "op10_quality_rules": _quality_sql()}
