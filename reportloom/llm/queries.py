"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.llm.bpe import encode_digests
from reportloom.llm.common import read_table
from reportloom.llm.embed import near_vectors
from reportloom.llm.exact import exact_groups
from reportloom.llm.manifest import audit_documents
from reportloom.llm.minhash import near_classes
from reportloom.llm.packing import pack_documents
from reportloom.llm.periods import run_digests, with_planted_periods
from reportloom.llm.pii import find_personal_data
from reportloom.llm.quality import quality
from reportloom.llm.repeats import repeat_digests
from reportloom.llm.shards import shard_documents
from reportloom.llm.toxicity import toxicity
from reportloom.llm.warc import damaged_replica, fixity_audit

VOCAB = public_tokenizers.path("word_bpe_49k.json")


def op1_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read_table(spark, sf_dir, "documents"))


def op2_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as an archive, audited against a replica with damage of six kinds."""
    return fixity_audit(*damaged_replica(read_table(spark, sf_dir, "pages")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(read_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), VOCAB, remembered=400_000)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read_table(spark, sf_dir, "documents"), VOCAB)


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(read_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(with_planted_periods(read_table(spark, sf_dir, "documents")))


def op13_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bag_minhash": op1_bag_minhash,
    "op2_pca_tiles": op2_pca_tiles,
    "op3_toxicity": op3_toxicity,
    "op4_merkle_audit": op4_merkle_audit,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_pii": op6_pii,
    "op7_quality": op7_quality,
    "op8_pack": op8_pack,
    "op9_bpe": op9_bpe,
    "op10_hilbert_shards": op10_hilbert_shards,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_prefix_doubling": op13_prefix_doubling,
}

# crc32 of the decimal doc_id, bit by bit.
_CRC32 = """xor(list_reduce(
    list_transform(range(0, length(doc_id::VARCHAR) + 1),
        lambda i: CASE WHEN i = 0 THEN 4294967295::BIGINT ELSE ord(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT END),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))
), 4294967295)"""

ORACLES = {
    "op2_pca_tiles": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
        ), link AS (
            SELECT a.vec_id AS a, b.vec_id AS b
            FROM v a JOIN v b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9
        ), both_ways AS (
            SELECT a, b FROM link UNION ALL SELECT b, a FROM link
        ), reach AS (
            SELECT vec_id AS node, vec_id AS other FROM v
            UNION
            SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.other
        ), n AS (
            SELECT a, count(*) AS n FROM both_ways GROUP BY a
        ), part AS (
            SELECT node AS vec_id, min(other) AS component_id FROM reach GROUP BY node
        )
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM part LEFT JOIN n ON n.a = vec_id
    """,
    # Every pair that shares a shingle, compared exactly.
    "op1_bag_minhash": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS words
            FROM documents
        ), s AS (
            SELECT doc_id, unnest(CASE
                WHEN len(words) = 0 THEN []
                WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
            END) AS shingle
            FROM w
        ), items AS (
            SELECT doc_id, shingle, row_number() OVER (PARTITION BY doc_id, shingle) AS copy FROM s
        ), n AS (
            SELECT doc_id, count(*) AS n FROM items GROUP BY doc_id
        ), shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m
            FROM items a JOIN items b ON a.shingle = b.shingle AND a.copy = b.copy AND a.doc_id < b.doc_id
            GROUP BY ALL
        ), link AS (
            SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
            WHERE m * 100 >= (x.n + y.n - m) * 80
        ), reach AS (
            SELECT doc_id AS node, doc_id AS other FROM documents
            UNION
            SELECT r.node, e.v
            FROM reach r JOIN (SELECT a AS u, b AS v FROM link UNION ALL SELECT b, a FROM link) e ON e.u = r.other
        ), class AS (
            SELECT node AS doc_id, min(other) AS class_id, count(*) AS class_size FROM reach GROUP BY node
        )
        SELECT doc_id, class_id, class_size, doc_id = class_id AS kept FROM class
    """,
    "op4_merkle_audit": r"""
        WITH p AS (
            SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
        ), texts AS (
            SELECT 'left' AS side, page_id AS home, page_id, 0 AS later, url, html FROM p
            UNION ALL
            SELECT 'right', page_id, page_id, 0, url,
                CASE WHEN page_id % 97 = 13 THEN '#' || substr(html, 2)
                    WHEN page_id % 223 = 100 THEN html || '!'
                    WHEN page_id % 227 = 150 THEN substr(html, 2)
                    ELSE html END
            FROM p WHERE page_id % 211 <> 40
            UNION ALL
            SELECT 'right', page_id, -1 - page_id, 1, url, '+' || html FROM p WHERE page_id % 229 = 200
        ), records AS (
            SELECT side, home, page_id, later,
                'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
                    || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
                    || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
                    || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10)
                    || html || chr(13) || chr(10) || chr(13) || chr(10) AS record
            FROM texts
        ), files AS (
            SELECT page_id AS home, (row_number() OVER (ORDER BY page_id) - 1) // 1024 AS file FROM p
        ), placed AS (
            SELECT side, page_id, file, sha256(record) AS sha256, strlen(record) AS length,
                (sum(strlen(record)) OVER (PARTITION BY side, file
                    ORDER BY side = 'right' AND later = 0 AND home % 233 = 60, home, later) - strlen(record))::BIGINT AS "offset"
            FROM records JOIN files USING (home)
        ), l AS (SELECT * FROM placed WHERE side = 'left'), r AS (SELECT * FROM placed WHERE side = 'right')
        SELECT page_id, coalesce(l.file, r.file) AS file, coalesce(l."offset", r."offset") AS "offset",
            coalesce(l.length, r.length) AS length, l.sha256 AS sha256, r.sha256 AS replica_sha256,
            CASE WHEN r.sha256 IS NULL THEN 'missing' WHEN l.sha256 IS NULL THEN 'added'
                WHEN l.sha256 = r.sha256 THEN 'ok' ELSE 'changed' END AS status,
            coalesce(l.sha256 = r.sha256 AND l."offset" <> r."offset", false) AS moved
        FROM l FULL JOIN r USING (page_id)
    """,
    "op5_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body
            FROM documents
        )
        SELECT doc_id,
            first_value(doc_id) OVER best AS keep_id,
            count(*) OVER (PARTITION BY body) AS group_size,
            doc_id = first_value(doc_id) OVER best AS kept,
            sha256(body) AS text_sha256
        FROM d
        WINDOW best AS (PARTITION BY body ORDER BY n DESC, doc_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    """,
    # Trees level by level, paths by joining every level's runs, roots folded up the path.
    "op11_merkle_manifest": rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce('=' || lang, '') AS k, text, {_CRC32} % 3 = 0 AS hit,
                list_aggregate(list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR],
                    lambda v: coalesce(strlen(v) || ':' || v, '-')), 'string_agg', '') AS head
            FROM documents
        ), leaves AS (
            SELECT doc_id, k, row_number() OVER (PARTITION BY k ORDER BY doc_id) - 1 AS pos,
                count(*) OVER (PARTITION BY k) AS n,
                sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS now,
                head
            FROM d
        ), nodes AS (
            SELECT k, 0 AS lvl, pos, n, leaf AS h FROM leaves
            UNION ALL
            SELECT k, any_value(lvl) + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY pos))
            FROM nodes WHERE n > 1 GROUP BY k, pos // 8
        ), subroots AS (
            SELECT k, lvl AS depth, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n
            FROM nodes WHERE n = 1
        ), tops AS (
            SELECT 0 AS lvl, pos, n, subroot AS h FROM subroots
            UNION ALL
            SELECT any_value(lvl) + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY pos))
            FROM tops WHERE n > 1 GROUP BY pos // 8
        ), runs AS (
            SELECT k, lvl, pos // 8 AS run, string_agg(h, '' ORDER BY pos) AS hs FROM nodes WHERE n > 1 GROUP BY ALL
        ), top_runs AS (
            SELECT lvl, pos // 8 AS run, string_agg(h, '' ORDER BY pos) AS hs FROM tops WHERE n > 1 GROUP BY ALL
        ), steps AS (
            SELECT doc_id, r.lvl AS step, hs, (l.pos // (8 ** r.lvl)::BIGINT) % 8 AS slot
            FROM leaves l JOIN runs r ON r.k = l.k AND r.run = l.pos // (8 ** (r.lvl + 1))::BIGINT
            UNION ALL
            SELECT doc_id, s.depth + r.lvl, hs, (s.pos // (8 ** r.lvl)::BIGINT) % 8
            FROM leaves l JOIN subroots s ON s.k = l.k JOIN top_runs r ON r.run = s.pos // (8 ** (r.lvl + 1))::BIGINT
        ), sides AS (
            SELECT doc_id, step, substr(hs, 1, 64 * slot) AS a, substr(hs, 64 * slot + 65) AS b FROM steps
        ), path AS (
            SELECT doc_id, list({{'a': a, 'b': b}} ORDER BY step) AS p, string_agg(a || b, '' ORDER BY step) AS proof
            FROM sides GROUP BY doc_id
        ), folding AS (
            SELECT l.doc_id, 0 AS i, sha256(head || coalesce(strlen(now) || ':' || now, '-')) AS h FROM leaves l
            UNION ALL
            SELECT f.doc_id, f.i + 1, sha256(p.p[f.i + 1].a || f.h || p.p[f.i + 1].b)
            FROM folding f JOIN path p ON p.doc_id = f.doc_id WHERE f.i < len(p.p)
        ), folded AS (
            SELECT doc_id, max_by(h, i) AS folded_root FROM folding GROUP BY doc_id
        ), root AS (
            SELECT h AS root FROM tops WHERE n = 1
        )
        SELECT l.doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM leaves l JOIN subroots s ON s.k = l.k JOIN folded f ON f.doc_id = l.doc_id LEFT JOIN path p ON p.doc_id = l.doc_id, root
    """,
    # All pairs of equal words of a document, as islands of equal distance.
    "op12_periodic_runs": rf"""
        WITH t AS (
            SELECT doc_id, {_CRC32} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), c AS (
            SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t
        ), c2 AS (
            SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM c
        ), words AS (
            SELECT doc_id, i, n, w[(CASE WHEN i < a OR a IS NULL THEN i ELSE a + (i - a) % p END) + 1] AS word
            FROM (SELECT *, unnest(range(n)) AS i FROM c2)
        ), eq AS (
            SELECT x.doc_id, y.i - x.i AS q, x.i AS j
            FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
        ), islands AS (
            SELECT doc_id, q, min(j) AS s, max(j) + 1 AS e
            FROM (SELECT *, j - row_number() OVER (PARTITION BY doc_id, q ORDER BY j) AS g FROM eq) GROUP BY doc_id, q, g
        ), runs AS (
            SELECT doc_id, s, e - s + q AS l, min(q) AS q FROM islands
            WHERE e - s + q >= greatest(24, 3 * q) GROUP BY doc_id, s, e - s + q
        ), most AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l / q DESC, s, q) AS nr FROM runs
        ), listed AS (
            SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS txt
            FROM runs GROUP BY doc_id
        ), kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS txt FROM words w
            WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = w.doc_id AND w.i >= r.s + r.q AND w.i < r.s + r.l)
            GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, m.s AS start, m.l AS length, m.q AS period,
            1000 * m.l // m.q AS exponent_milli, sha256(coalesce(r.txt, '')) AS runs_sha256,
            sha256(coalesce(k.txt, '')) AS collapsed_sha256
        FROM documents d LEFT JOIN most m ON m.doc_id = d.doc_id AND nr = 1
        LEFT JOIN listed r ON r.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
    """,
}
