"""The subpackage's queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import bpe, clustering, conversations, exact_dedup, mixing, near_dedup, packing, personal_data, secret_scan, suffix_dedup, topk, toxicity, warc
from textloom.plans.scratch import read_dealt

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_dealt(spark, f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_counts(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encoding_digests(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(_table(spark, sf_dir, "documents")).drop("h")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(_table(spark, sf_dir, "conversations"))


def op13_dual_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(_table(spark, sf_dir, "embeddings"))


def _rounds_sql(rounds: int = clustering.ROUNDS) -> str:
    """Lloyd's rounds, each vector against each centroid."""
    width, n = clustering.WIDTH, clustering.CLUSTERS
    parts = [f"""
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v
            FROM embeddings
            WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS (
            SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v
            FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM v ORDER BY h, v LIMIT {n}))"""]
    for i in range(rounds + 1):
        parts.append(f"""
        a{i} AS (
            SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(d * {n} + k) % {n} AS k, min(d) AS d
            FROM (SELECT v.r, v.vec_id, v.v, c.k,
                         CAST(list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
                  FROM v, c{i} c) GROUP BY r)""")
        if i < rounds:
            parts.append(f"""
        m{i} AS (
            SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v
            FROM (SELECT k, j, sum(x) AS s, count(*) AS n
                  FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY k, j) GROUP BY k)""")
            parts.append(f"""
        c{i + 1} AS (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (k))""")
    return ",".join(parts) + f"""
        SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c USING (k)"""


QUERIES: dict[str, Query] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_top_k": op4_top_k,
    "op5_personal_data": op5_personal_data,
    "op6_toxicity": op6_toxicity,
    "op7_warc": op7_warc,
    "op8_near_dedup": op8_near_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_mix_sources": op10_mix_sources,
    "op11_best_fit": op11_best_fit,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_dual_tree_clusters": op13_dual_tree_clusters,
}

ORACLES: dict[str, str] = {
    "op4_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(
                embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
        FROM scored
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 20""",
    "op7_warc": """
        SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
               sha256(coalesce(html, '')) AS payload_digest,
               CASE WHEN strlen(html) >= 100 AND page_id <> min(page_id) OVER w THEN 'revisit' ELSE 'response'
               END AS record_type,
               CASE WHEN strlen(html) >= 100 AND page_id <> min(page_id) OVER w THEN min(page_id) OVER w
               END AS refers_to
        FROM pages
        WINDOW w AS (PARTITION BY coalesce(html, ''))""",
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op10_mix_sources": r"""
        WITH sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                   CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hash
            FROM documents),
        per AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   CAST([3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
            FROM sized GROUP BY source),
        caps AS (SELECT *, source_size * CAST(2 AS DOUBLE) AS cap FROM per),
        level AS (
            SELECT *, sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS budget,
                   coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                   + cap / weight * sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                                                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled
            FROM caps),
        targets AS (
            SELECT source, source_size,
                   CASE WHEN filled <= budget THEN cap
                        ELSE (budget - coalesce(sum(CASE WHEN filled <= budget THEN cap END) OVER (), 0))
                             / sum(CASE WHEN filled > budget THEN weight END) OVER () * weight END AS target
            FROM level),
        groups AS (
            SELECT source, hash, sum(size) AS own,
                   sum(sum(size)) OVER (PARTITION BY source ORDER BY hash) - sum(size) AS earlier
            FROM sized GROUP BY source, hash),
        plan AS (
            SELECT g.source, g.hash, t.source_size, t.target,
                   CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
                   CASE WHEN 2 * g.earlier + g.own <= 2 * (t.target - CASE WHEN t.source_size > 0
                        THEN floor(t.target / t.source_size) * t.source_size ELSE 0 END) THEN 1 ELSE 0 END AS extra
            FROM groups g JOIN targets t ON g.source IS NOT DISTINCT FROM t.source)
        SELECT s.doc_id, s.size, p.source_size, p.target, CAST(s.size * (p.whole + p.extra) AS BIGINT) AS taken
        FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source AND s.hash = p.hash""",
    "op12_conversation_repair": r"""
        WITH RECURSIVE
        remainders AS (
            SELECT list(v ORDER BY n) AS t
            FROM (SELECT n, list_reduce(list_prepend(n, CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda a, x:
                             CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(n))),
        keyed AS (
            SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(
                           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                           lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS h
            FROM conversations, remainders),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM keyed, (VALUES (0), (1)) c(copy) WHERE h <> 0 AND (copy = 0 OR h = 3)),
        placed AS (
            SELECT *, row_number() OVER w AS i, left(role, 1) AS ini, lag(left(role, 1)) OVER w AS ini_before,
                   right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ending
            FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        faulted AS (
            SELECT *, CASE WHEN ending = '' THEN 'b'
                           WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'd'
                           WHEN ending NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
            FROM placed),
        grammar(p, ini, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        inserts(p, q, n) AS (VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)),
        edits AS (
            SELECT f.conv_id, f.i, 'K' AS label, g.p, g.q, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS cost
            FROM faulted f JOIN grammar g ON g.ini = f.ini WHERE fault NOT IN ('b', 'd')
            UNION ALL
            SELECT f.conv_id, f.i, 'R', g.p, g.q, CASE WHEN fault = 't' THEN 6 ELSE 1 END
            FROM faulted f JOIN grammar g ON g.ini IN ('u', 'a') WHERE fault NOT IN ('b', 'd')
            UNION ALL
            SELECT f.conv_id, f.i, 'D', p, p, 2 FROM faulted f, (VALUES (0), (1), (2), (3)) s(p)),
        best AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, '000000000000' AS w FROM damaged
            UNION ALL
            SELECT b.conv_id, e.i, e.q, min(lpad(CAST(CAST(left(b.w, 12) AS BIGINT) + 5 * s.n + e.cost AS VARCHAR), 12, '0')
                                            || substr(b.w, 13) || repeat('I', s.n) || e.label)
            FROM best b JOIN inserts s ON s.p = b.q
            JOIN edits e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.i = b.i + 1 AND e.p = s.q
            GROUP BY b.conv_id, e.i, e.q),
        done AS (
            SELECT b.conv_id, min(lpad(CAST(CAST(left(b.w, 12) AS BIGINT) + 5 * s.n AS VARCHAR), 12, '0')
                                  || substr(b.w, 13) || repeat('I', s.n)) AS w
            FROM best b JOIN inserts s ON s.p = b.q AND s.q IN (0, 3)
            JOIN (SELECT conv_id, count(*) AS n FROM faulted GROUP BY conv_id) t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.n = b.i
            GROUP BY b.conv_id),
        audited AS (SELECT conv_id, CAST(left(w, 12) AS BIGINT) AS cost, substr(w, 13) AS audit FROM done),
        labels AS (
            SELECT conv_id, j, substr(audit, CAST(j AS INTEGER), 1) AS label
            FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM audited)),
        steps AS (
            SELECT *, sum(CASE WHEN label <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN label <> 'D' THEN 1 ELSE 0 END) OVER w AS e
            FROM labels WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
        shown AS (
            SELECT s.*, f.role, f.text, bool_or(s.e = 1 AND s.label = 'K' AND f.ini = 's') OVER (PARTITION BY s.conv_id) AS has_system
            FROM steps s LEFT JOIN faulted f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i WHERE s.label <> 'D'),
        repaired AS (
            SELECT conv_id, string_agg(CASE WHEN label = 'K' THEN role WHEN (e - CAST(has_system AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                       || ':' || CASE WHEN label = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS whole
            FROM shown GROUP BY conv_id),
        counted AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                   count(*) FILTER (i > 1 AND ini_before || ini NOT IN ('su', 'ua', 'au')) AS illegal
            FROM faulted GROUP BY conv_id)
        SELECT c.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate,
               coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal, coalesce(a.cost, 0) AS cost,
               coalesce(a.audit, '') AS audit, sha256(coalesce(r.whole, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c
        LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN audited a ON a.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op13_dual_tree_clusters": _rounds_sql(),
}
