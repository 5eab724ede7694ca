"""One query per operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from guidescape.llm import chat, exact_dedup, hard_negatives, language, line_dedup, lm, ngram_join, packing, pieces, quality
from guidescape.llm import repair, token_files, toxicity
from guidescape.runtime import checkpointed, ensure_checkpoint_dir


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, folder, "documents"), digests=True)


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(_table(spark, folder, "documents")))
    base = F.col("failed").bitwiseAND(F.lit(quality.BASE)) != 0
    return rows.select(
        *["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        base.alias("base_failed"),
        "kept",
        *["n_lines", "n_exclamations", "n_capitals", "failed"],
    )


def quality_ablations(spark: SparkSession, folder: str) -> DataFrame:
    """What every rule of every policy version does to all documents, from one ledger."""
    rows = checkpointed(quality.ledger(_table(spark, folder, "documents")).select("failed"))
    found = [quality.ablations(rows, name).withColumn("policy", F.lit(name)) for name in quality.POLICIES]
    return functools.reduce(DataFrame.unionByName, found)


def op3_chat_collapse(spark: SparkSession, folder: str) -> DataFrame:
    return chat.collapse_and_render(_table(spark, folder, "conversations"))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, folder, "documents").select("doc_id", "text"))


def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, folder, "documents"))


def op6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return pieces.nbest(_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"))


def op9_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm.lm_scores(_table(spark, folder, "documents"))


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = f"{ensure_checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"
    token_files.write_files(_table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_index(spark, path)


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations")
    return repair.repair_report(turns, repair.damage(turns))


def op12_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_id(_table(spark, folder, "documents"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(_table(spark, folder, "embeddings"), label, F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        *(op1_exact_dedup, op2_quality_rules, op3_chat_collapse, op4_line_dedup, op5_ngram_join),
        *(op6_pieces, op7_toxicity, op8_packing, op9_lm_scores, op10_token_files),
        *(op11_conversation_repair, op12_language_id, op13_hard_negatives, quality_ablations),
    )
}

ORACLE = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op2_quality_rules": r"""
        WITH docs AS (
            SELECT doc_id, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ln
            FROM documents),
        windows AS (
            SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
        twice AS (
            SELECT doc_id, unnest([i, i + 1, i + 2]) AS place
            FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows) WHERE n > 1),
        repeats AS (SELECT doc_id, count(DISTINCT place) AS n FROM twice GROUP BY doc_id),
        measured AS (
            SELECT docs.doc_id, len(w) AS n_words,
                   length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                   length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                   len(ln) - len(list_distinct(ln)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
                   len(ln) AS n_lines, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclamations,
                   length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals
            FROM docs LEFT JOIN repeats USING (doc_id)),
        judged AS (
            SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
                   + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
                   + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
                   + (CASE WHEN 10 * n_exclamations > n_words THEN 8 ELSE 0 END)
                   + (CASE WHEN 2 * n_capitals > word_chars THEN 16 ELSE 0 END)
                   + (CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END)
                   + (CASE WHEN 2 * word_chars < 5 * n_words THEN 64 ELSE 0 END)
                   + (CASE WHEN word_chars > 14 * n_words THEN 128 ELSE 0 END) AS failed
            FROM measured)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
               CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
               CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept,
               CAST(n_lines AS BIGINT) AS n_lines, CAST(n_exclamations AS BIGINT) AS n_exclamations,
               CAST(n_capitals AS BIGINT) AS n_capitals, CAST(failed AS BIGINT) AS failed
        FROM judged""",
    "op3_chat_collapse": r"""
        WITH turns AS (
            SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
                   count(*) OVER (PARTITION BY conv_id) AS n_turns,
                   '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line
            FROM turns),
        prefixes AS (
            SELECT conv_id, pos, n_turns, line,
                   string_agg(role || chr(1) || text, chr(2)) OVER (PARTITION BY conv_id ORDER BY pos) AS so_far
            FROM placed),
        ends AS (
            SELECT min(conv_id) AS conv_id, n_turns, so_far, count(*) AS copies
            FROM prefixes WHERE pos = n_turns GROUP BY n_turns, so_far),
        kept AS (
            SELECT * FROM ends
            WHERE NOT EXISTS (SELECT 1 FROM prefixes p
                              WHERE p.pos = ends.n_turns AND p.so_far = ends.so_far AND p.pos < p.n_turns))
        SELECT kept.conv_id, CAST(row_number() OVER (PARTITION BY kept.conv_id ORDER BY block) - 1 AS INTEGER) AS part,
               kept.n_turns, kept.copies, text
        FROM kept JOIN (
            SELECT conv_id, block, string_agg(line, '' ORDER BY pos) AS text
            FROM (SELECT *, coalesce(floor(turn / 512.0), -1e18) AS block FROM placed) GROUP BY conv_id, block) USING (conv_id)""",
    "op13_hard_negatives": """
        WITH e AS (
            SELECT row_number() OVER () AS r, vec_id,
                   CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        scores AS (
            SELECT a.r AS anchor, a.vec_id AS anchor_id, a.label = c.label AS same, c.r, c.vec_id,
                   CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
            FROM e a JOIN e c ON a.r <> c.r WHERE a.vec_id % 50 = 0),
        positives AS (
            SELECT * FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, p.vec_id AS positive_id,
               CAST(row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
               n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN scores n
          ON n.anchor = p.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
        QUALIFY rank <= 3""",
}

_POLICIES = ", ".join(f"('{name}', {mask})" for name, mask in quality.POLICIES.items())
_RULES = ", ".join(f"('{name}', {bit})" for name, bit in quality.BIT.items())
ORACLE["quality_ablations"] = f"""
    WITH ledger AS ({ORACLE['op2_quality_rules']})
    SELECT policy, rule, count(*) FILTER (failed & bit <> 0) AS failing,
           count(*) FILTER (failed & mask = bit) AS only_rule, count(*) FILTER (failed & mask <> 0) AS rejected,
           count(*) FILTER (failed & mask <> 0 AND failed & mask <> bit) AS rejected_without
    FROM ledger, (VALUES {_POLICIES}) p(policy, mask), (VALUES {_RULES}) r(rule, bit)
    WHERE bit & mask <> 0 GROUP BY policy, rule"""


def _cost_and_audit() -> tuple[str, str]:
    """First and next row of the least-cost programme in SQL: a column per state, holding its cost in nine digits, then its audit."""

    def after(value: str, cost: str | int, letter: str) -> str:
        return f"lpad(CAST(CAST(substr({value}, 1, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || substr({value}, 10) || '{letter}'"

    def inserted(w: list[str], source: str) -> str:
        x2 = f"least({w[2]}, {after(w[0], 3, 'I')}, {after(w[1], 3, 'I')}, {after(w[3], 3, 'I')})"
        return f"SELECT conv_id, i, w0 AS v0, w1 AS v1, x2 AS v2, least(w3, {after('x2', 3, 'I')}) AS v3 FROM (SELECT *, {x2} AS x2 FROM ({source}))"

    def kept(value: str, role: str) -> str:
        return f"CASE WHEN first = '{role}' AND fault < 2 THEN {after(value, '3 * fault', 'K')} END"

    def given(value: str) -> str:
        return f"CASE WHEN fault < 2 THEN {after(value, '3 + 3 * fault', 'R')} END"

    names = ["w0", "w1", "w2", "w3"]
    start = "SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS w0, CAST(NULL AS VARCHAR) AS w1, CAST(NULL AS VARCHAR) AS w2, CAST(NULL AS VARCHAR) AS w3 FROM faulty"
    users = ", ".join(f(v) for v in ("v0", "v1", "v3") for f in (lambda v: kept(v, "u"), given))
    step = f"""
        SELECT f.conv_id, f.i, {after('v0', 4, 'D')} AS w0, least({after('v1', 4, 'D')}, {kept('v0', 's')}) AS w1,
               least({after('v2', 4, 'D')}, {users}) AS w2,
               least({after('v3', 4, 'D')}, {kept('v2', 'a')}, {given('v2')}) AS w3
        FROM programme p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1"""
    return inserted(names, start), inserted(names, step)


_START, _STEP = _cost_and_audit()

ORACLE["op11_conversation_repair"] = rf"""
    WITH RECURSIVE crc_table AS (
        SELECT [list_reduce([CAST(i AS BIGINT)] || [CAST(0 AS BIGINT) FOR k IN range(8)],
                            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                FOR i IN range(256)] AS entries),
    coded AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               xor(list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(ord(c) AS BIGINT) FOR c IN string_split(
                       coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')],
                   lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
        FROM conversations, crc_table),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
        FROM coded WHERE kind <> 0),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role,
                                     sha256(length(role) || ':' || role || text)) AS i,
               right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last, role[1] AS first
        FROM damaged),
    faulty AS (
        SELECT *, CASE WHEN last = '' OR again THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault,
               coalesce(lag(first) OVER (PARTITION BY conv_id ORDER BY i) || first NOT IN ('su', 'ua', 'au'), false) AS jump
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM placed)),
    programme AS ({_START} UNION ALL {_STEP}),
    solved AS (
        SELECT conv_id, CAST(substr(least(v0, v3), 1, 9) AS BIGINT) AS cost, substr(least(v0, v3), 10) AS audit
        FROM programme QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
    letters AS (
        SELECT conv_id, k, audit[k] AS letter, length(replace(audit[1:k], 'I', '')) AS i,
               length(replace(audit[1:k], 'D', '')) AS made
        FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS k FROM solved)),
    turns AS (
        SELECT l.conv_id, l.k, l.made, l.letter, f.role AS own, f.text,
               max(l.made = 1 AND l.letter = 'K' AND f.first = 's') OVER (PARTITION BY l.conv_id) AS led
        FROM letters l LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i AND l.letter <> 'I'
        WHERE l.letter <> 'D'),
    repaired AS (
        SELECT conv_id, sha256(string_agg(
                   CASE WHEN letter = 'K' THEN own WHEN (made - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user'
                        ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k)) AS digest
        FROM turns GROUP BY conv_id),
    counted AS (
        SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
               count(*) FILTER (last = '') AS blank, count(*) FILTER (last <> '' AND again) AS duplicate,
               count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (jump) AS illegal
        FROM faulty GROUP BY conv_id)
    SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
           CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
           CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
           coalesce(digest, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id"""
