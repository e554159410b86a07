"""Registered queries of the operators and the SQL that states their results."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from axonframe.llm import chunk_dedup, fim, hnsw, importance, line_rules, packing, quality, secrets, sentencepiece_codec, simhash, substring, token_orc, toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.encode_to_orc(_docs(spark, sf_dir))


def op2_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.exact_duplicates(_docs(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_digest(_docs(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_docs(spark, sf_dir))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_docs(spark, sf_dir))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(_docs(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.quality_rules(_docs(spark, sf_dir)).drop("n_removed")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(_docs(spark, sf_dir))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (op1_token_orc, op2_chunk_dedup, op3_quality, op4_suffix_trees, op5_best_fit_packing, op6_secrets, op7_sentencepiece, op8_simhash, op9_toxicity, op10_hnsw, op11_line_rules, op12_fill_in_middle, op13_importance)} | {"pipeline": corpus_pipeline.run}

ORACLE_SQL = {
    "op2_chunk_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op4_suffix_trees": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
             h AS (SELECT r, i, array_to_string(list_slice(w, i, i + 34), ' ') AS t FROM s),
             again AS (SELECT r, i FROM h QUALIFY count(*) OVER (PARTITION BY t) > 1),
             gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM again),
             x AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
             k AS (SELECT x.r, string_agg(word, ' ' ORDER BY x.j) AS kept FROM x ANTI JOIN gone g ON g.r = x.r AND g.j = x.j GROUP BY 1),
             n AS (SELECT r, count(*) AS n FROM gone GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (r) LEFT JOIN n USING (r)""",
    "op10_hnsw": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
             l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
             r(id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.reach = l.a),
             c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
        SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM c LEFT JOIN n ON n.a = c.id""",
    "op11_line_rules": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS t FROM documents),
             l AS (SELECT r, host, t, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
             w AS (SELECT r, host, t, line, i, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM l),
             norm AS (SELECT r, host, t, len(w) AS n, translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS dup FROM w WHERE len(w) > 0),
             hosts AS (SELECT host, count(DISTINCT t) AS texts FROM d GROUP BY 1),
             often AS (SELECT host, k FROM norm JOIN hosts USING (host) GROUP BY host, k, hosts.texts HAVING count(DISTINCT t) > 10 AND count(DISTINCT t) > 0.02::DOUBLE * hosts.texts),
             gone AS (SELECT r, sum(n) AS n FROM norm SEMI JOIN often USING (host, k) GROUP BY 1),
             dups AS (SELECT r, count(*) FILTER (dup) AS n FROM norm GROUP BY 1),
             words AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
             x AS (SELECT r, unnest(w) AS w, unnest(range(len(w))) AS i FROM words),
             five AS (SELECT r, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g FROM x WINDOW o AS (PARTITION BY r ORDER BY i)),
             again AS (SELECT r, i FROM five WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
             rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 5)) AS j FROM again) GROUP BY 1),
             m AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines,
                          coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0) AS removed FROM words LEFT JOIN dups USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 2 * removed <= n_words AS kept FROM m""",
    "op12_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
             n AS (SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
             c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                          CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
             p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
    # CRC-32 has no function there: its table comes from the polynomial, and each n-gram is folded over its bytes.
    "op13_importance": r"""
        WITH RECURSIVE k(b, i, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT b, i + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM k WHERE i < 8),
             tab AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM k WHERE i = 8),
             src AS (SELECT 's' AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark),
             w AS (SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM src),
             x AS (SELECT side, r, unnest(w) AS a, unnest(range(len(w))) AS i FROM w),
             y AS (SELECT *, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM x WINDOW o AS (PARTITION BY side, r ORDER BY i)),
             g AS (SELECT side, r, a AS g FROM y UNION ALL SELECT side, r, a || ' ' || b FROM y WHERE b IS NOT NULL UNION ALL SELECT side, r, a || ' ' || b || ' ' || c FROM y WHERE c IS NOT NULL),
             n AS MATERIALIZED (SELECT side, r, g, count(*) AS n FROM g GROUP BY ALL),
             hx AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM n)),
             crc AS MATERIALIZED (SELECT g, xor(4294967295, list_reduce(list_transform(range(1, strlen(h) // 2 + 1), lambda p: ('0x' || substr(h, 2 * p - 1, 2))::BIGINT), lambda s, v: xor(s // 256, t[(xor(s % 256, v) + 1)::BIGINT]), 4294967295)) % 10000 AS bucket FROM hx, tab),
             f AS MATERIALIZED (SELECT side, r, bucket, sum(n) AS n FROM n JOIN crc USING (g) GROUP BY ALL),
             b AS (SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t FROM f GROUP BY 1),
             total AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM b),
             gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM b, total),
             docs AS (SELECT r, sum(f.n)::BIGINT AS n_features, sum(f.n * gain)::BIGINT AS weight FROM f JOIN gain USING (bucket) WHERE side = 's' GROUP BY 1),
             scored AS (SELECT doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                               coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
                        FROM w LEFT JOIN docs USING (r) WHERE side = 's'),
             placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, (sum(able::INT) OVER () * 5) // 100 AS most FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= most THEN place END AS rank FROM placed""",
}
