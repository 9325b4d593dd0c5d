"""The opN queries: each operator on its whole table, and SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import (centroids, decontaminate, langid, merkle, packing, piece_bpe, quality, records, secrets, simhash, token_counts,
                        topk, warc)
from canopy.sources.tables import table


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file, the same on the driver and every worker."""
    return public_tokenizers.path(name)


def op1_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).drop("url")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(table(spark, sf_dir, "documents"), with_text=False)


def op4_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_texts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_edited_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = token_counts.planned_edits(table(spark, sf_dir, "documents"))
    return token_counts.edited_counts(edits, vocabulary("byte_bpe_50k.json"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_proofs(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_warc_normalise, op2_secret_scan, op3_quality_rules, op4_piece_bpe, op5_simhash,
                                   op6_packing, op7_topk, op8_language_id, op9_token_records, op10_edited_counts,
                                   op11_merkle_manifest, op12_centroids, op13_decontaminate, pipeline)}

def _counted(value: str) -> str:
    """SQL: a value as its byte count, a colon and its text; null as '-'."""
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _crc_step(state: str) -> str:
    """SQL: a CRC-32 state eight bits on."""
    for _ in range(8):
        state = f"list_reduce([0, {state}], lambda z, c: xor(c >> 1, 3988292384 * (c & 1)))"
    return state


# Words of an item or a document: A-Z lower-cased, other ASCII signs apart.
_WORDS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


def _clustering_sql(rounds: int) -> str:
    """SQL: k-means as op12 does it, distances of every pair of vector and centroid."""
    steps = ["""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS w
                      FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             """c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), w) - 1 AS cluster, w AS c FROM v
                       QUALIFY cluster < 16)"""]
    near = """(SELECT r, vec_id, w, cluster, c, list_sum(list_transform(list_zip(w, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance
               FROM v, c{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)"""
    for n in range(rounds):
        steps += [f"a{n} AS MATERIALIZED {near.format(n=n)}",
                  f"""m{n} AS (SELECT cluster, list(floor_mean ORDER BY i) AS c FROM (
                          SELECT cluster, i, (sum(w[i]) - ((sum(w[i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_mean
                          FROM a{n}, range(1, 65) t(i) GROUP BY cluster, i) GROUP BY cluster)""",
                  f"c{n + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (cluster))"]
    return f"""WITH {", ".join(steps)}, z AS MATERIALIZED {near.format(n=rounds)}
        SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
               (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM z"""


ORACLE = {
    "op1_warc_normalise": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hexed FROM pages),
        d AS (SELECT page_id, strlen(body) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr(
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + (((('0x' || substr(hexed, 1 + 5 * (i // 4), 5))::BIGINT) >> (5 * (3 - i % 4))) & 31)::INT, 1)), '') AS payload_digest
              FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> original THEN original END AS refers_to
        FROM m""",
    "op7_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
        SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_merkle_manifest": f"""
        WITH RECURSIVE
        d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, 'n') AS tree, text,
                     {_counted('doc_id')} || {_counted('source')} || {_counted('lang')} || {_counted('n_chars')} AS head,
                     list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                                 lambda crc, b: {_crc_step('xor(crc, b)')}) AS crc
              FROM documents),
        h AS (SELECT r, doc_id, tree, sha256(head || {_counted('text')}) AS leaf,
                     CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(head || {_counted("replace(text, chr(10), '')")})
                          ELSE sha256(head || {_counted('text')}) END AS claimed FROM d),
        l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS idx,
                     count(*) OVER (PARTITION BY tree) AS n FROM h),
        nodes AS (SELECT tree, 0 AS level, idx, n, leaf AS digest FROM l
                  UNION ALL
                  SELECT tree, level + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
                  FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 3),
        t AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
        top AS (SELECT 0 AS level, idx, n, digest FROM t
                UNION ALL
                SELECT level + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
                FROM top WHERE n > 1 GROUP BY level, idx // 3),
        runs AS (SELECT tree, level, idx // 3 AS up, list(digest ORDER BY idx) AS own FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 3
                 UNION ALL
                 SELECT 't', level, idx // 3, list(digest ORDER BY idx) FROM top WHERE n > 1 GROUP BY level, idx // 3),
        path AS (SELECT l.r, u.level, (l.idx // (3 ** u.level)::BIGINT) % 3 AS spot, u.own FROM l
                 JOIN runs u ON u.tree = l.tree AND u.up = l.idx // (3 ** (u.level + 1))::BIGINT
                 UNION ALL
                 SELECT l.r, 100 + u.level, (t.idx // (3 ** u.level)::BIGINT) % 3, u.own FROM l JOIN t USING (tree)
                 JOIN runs u ON u.tree = 't' AND u.up = t.idx // (3 ** (u.level + 1))::BIGINT),
        steps AS (SELECT r, list([array_to_string(own[:spot], ''), array_to_string(own[spot + 2:], '')] ORDER BY level) AS s FROM path GROUP BY r),
        f AS (SELECT l.r, list_reduce(list_prepend([claimed, ''], coalesce(s, [])), lambda a, b: [sha256(b[1] || a[1] || b[2]), ''])[1] AS folded,
                     sha256(array_to_string(list_transform(coalesce(s, []), lambda b: b[1] || b[2]), '')) AS proof
              FROM l LEFT JOIN steps USING (r)),
        top_root AS (SELECT digest AS root FROM top WHERE n = 1)
        SELECT doc_id, leaf, t.digest AS subroot, root, proof AS proof_sha256, folded AS folded_root, folded = root AS verified
        FROM l JOIN t USING (tree) JOIN f USING (r) CROSS JOIN top_root""",
    "op12_centroids": _clustering_sql(3),
    "op13_decontaminate": r"""
        WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, """ + _WORDS + r""" AS w FROM benchmark),
        win AS (SELECT DISTINCT item, w[i:i + least(len(w), 10) - 1] AS words
                FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
        size AS (SELECT DISTINCT len(words) AS k FROM win),
        d AS (SELECT row_number() OVER () AS r, doc_id, """ + _WORDS + r""" AS w FROM documents),
        starts AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, size WHERE len(w) >= k),
        found AS (SELECT r, i, k, item FROM starts s JOIN win ON win.words = s.w[i:i + k - 1]),
        hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM found) GROUP BY r),
        own AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM found GROUP BY r)
        SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
               sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hits USING (r) LEFT JOIN own USING (r)""",
}
