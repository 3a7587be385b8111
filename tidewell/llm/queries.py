"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import shards

    return shards.write_and_read(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(table(spark, sf_dir, "documents"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lines

    return lines.similar_lines(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language

    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.sample(docs.where(~language.held_out())))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import archives

    return archives.round_trip(table(spark, sf_dir, "pages"))


OP4_SQL = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
             CASE WHEN strlen(html) >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first
      FROM pages)
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), mixing.WITHIN_REACH)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substrings

    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import exact

    return exact.exact_duplicates(table(spark, sf_dir, "documents"), hash_all=True).drop("text_hash")


OP8_SQL = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import dialogue

    return dialogue.digests(*dialogue.repair(table(spark, sf_dir, "conversations")))


#: Damage, faults and the cheapest repair, row by row in a recursion that keeps the least (cost, audit) for each end so far.
OP11_SQL = r"""
WITH RECURSIVE hit AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
               lambda r, b: list_reduce(list_prepend(xor(r, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), CAST(4294967295 AS BIGINT)) % 20 AS m
    FROM conversations
), damaged AS (
    SELECT conv_id, turn, CASE m WHEN 4 THEN 'user' ELSE role END AS role, CASE m WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(CASE WHEN m = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM hit WHERE m <> 0
), ordered AS (
    SELECT conv_id, turn, role, text, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), found AS MATERIALIZED (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
           WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS two
    FROM ordered
), counted AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
    FROM found GROUP BY conv_id
), put(node, after, letters, lines) AS (
    VALUES ('', '', '', ''), ('s', 's', '', ''), ('u', 'u', '', ''), ('a', 'a', '', ''), ('', 'u', 'I', 'user:'), ('', 'a', 'II', 'user:' || chr(10) || 'assistant:'),
           ('s', 'u', 'I', chr(10) || 'user:'), ('s', 'a', 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), ('u', 'a', 'I', chr(10) || 'assistant:'),
           ('u', 'u', 'II', chr(10) || 'assistant:' || chr(10) || 'user:'), ('a', 'u', 'I', chr(10) || 'user:'), ('a', 'a', 'II', chr(10) || 'user:' || chr(10) || 'assistant:')
), letters(letter, price) AS (
    VALUES ('D', 4), ('K', 0), ('R', 3)
), best AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS i, '' AS node, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS said FROM counted
    UNION ALL
    SELECT conv_id, i, node, cost, audit, said FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id, node ORDER BY cost, audit) AS k FROM (
            SELECT f.conv_id, f.i, CASE letter WHEN 'D' THEN p.after WHEN 'K' THEN f.initial ELSE CASE WHEN p.after = 'u' THEN 'a' ELSE 'u' END END AS node,
                   b.cost + 3 * len(p.letters) + price + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS cost, b.audit || p.letters || letter AS audit,
                   b.said || p.lines || CASE WHEN letter = 'D' THEN '' ELSE CASE WHEN p.after = '' THEN '' ELSE chr(10) END
                       || CASE WHEN letter = 'K' THEN f.role WHEN p.after = 'u' THEN 'assistant' ELSE 'user' END || ':' || f.text END AS said
            FROM best b JOIN found f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1 JOIN put p ON p.node = b.node CROSS JOIN letters
            WHERE letter = 'D' OR fault NOT IN ('blank', 'duplicate') AND (letter = 'R' OR p.after || f.initial IN ('s', 'u', 'su', 'ua', 'au'))
        )
    ) WHERE k = 1
), ended AS (
    SELECT c.conv_id, b.cost + 3 * len(p.letters) AS cost, b.audit || p.letters AS audit, b.said || p.lines AS said,
           row_number() OVER (PARTITION BY c.conv_id ORDER BY b.cost + 3 * len(p.letters), b.audit || p.letters) AS k
    FROM best b JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.i JOIN put p ON p.node = b.node WHERE p.after IN ('', 'a')
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id AND k = 1
"""


def op12_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ann

    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import audit

    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: All orders by which filter of each takes the document away first; copies by the text itself.
OP13_SQL = r"""
WITH read AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), failing AS (
    SELECT doc_id, part, concat(
        CASE WHEN len(w) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * list_unique(w) < 50 * len(w) THEN 'B' ELSE '' END,
        CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END,
        CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
    FROM read
), kinds AS (
    SELECT part, fails, count(*) AS n, coalesce(sum(CASE WHEN q THEN 1 ELSE 0 END), 0) AS good, coalesce(sum(CASE WHEN x THEN 1 ELSE 0 END), 0) AS toxic
    FROM failing LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS q, bool_or(toxic = 1) AS x FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY part, fails
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
    SELECT concat(a.f, b.f, c.f, d.f, e.f) AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), gone AS (
    SELECT part, filter_order, fails, n, good, toxic, coalesce((SELECT min(p) FROM unnest(range(1, 6)) AS s(p) WHERE contains(fails, filter_order[p])), 6) AS gone_at FROM kinds, orders
), steps AS (
    SELECT part, filter_order, step, filter_order[step] AS f, sum(CASE WHEN gone_at > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone_at = step THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN gone_at < step AND contains(fails, filter_order[step]) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = filter_order[step] THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN gone_at = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone_at = step THEN toxic ELSE 0 END) AS toxic_lost
    FROM gone, range(1, 6) AS s(step) GROUP BY part, filter_order, step
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM steps
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality, op2_line_dedup, op3_language, op4_arc_to_warc, op5_mixing, op6_suffix_dedup, op7_token_shards, op8_exact_dedup, op9_simhash, op10_packing, op11_conversation_repair, op12_permutation_index, op13_filter_audit)
}

SQL: dict[str, str] = {"op4_arc_to_warc": OP4_SQL, "op8_exact_dedup": OP8_SQL, "op11_conversation_repair": OP11_SQL, "op13_filter_audit": OP13_SQL}
