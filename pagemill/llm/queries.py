"""The queries and the SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm.alignment import op12_tokenizer_alignment
from pagemill.llm.decontamination import op2_benchmark_decontamination
from pagemill.llm.language_id import op7_language_id
from pagemill.llm.line_dedup import op1_line_dedup
from pagemill.llm.minhash_join import op6_minhash_join
from pagemill.llm.multiset_hash import op5_multiset_hash
from pagemill.llm.packing import op9_best_fit_packing
from pagemill.llm.resampling import op11_target_resampling
from pagemill.llm.secrets import op8_secret_scan
from pagemill.llm.suffix_dedup import op3_suffix_dedup
from pagemill.llm.superminhash import op13_superminhash_dedup
from pagemill.llm.token_planes import op4_token_planes
from pagemill.llm.warc import op10_warc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_token_planes": op4_token_planes,
    "op5_multiset_hash": op5_multiset_hash,
    "op6_minhash_join": op6_minhash_join,
    "op7_language_id": op7_language_id,
    "op8_secret_scan": op8_secret_scan,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_warc": op10_warc,
    "op11_target_resampling": op11_target_resampling,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_superminhash_dedup": op13_superminhash_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_benchmark_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), p AS (
            SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS phrase
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM b WHERE len(w) > 0)
        ), sizes AS (SELECT DISTINCT size FROM p), h AS (
            SELECT doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') AS phrase
            FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes)
        ), hits AS (
            SELECT DISTINCT doc_id, k, h.size, item_id FROM h JOIN p ON p.size = h.size AND p.phrase = h.phrase
        ), covered AS (
            SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS pos FROM hits) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op10_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), q AS (
            SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS largest FROM p
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN largest = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN largest <> page_id THEN largest END AS refers_to, CAST(NULL AS VARCHAR) AS problem
        FROM q
    """,
    "op11_target_resampling": r"""
        WITH codes AS (
            SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS code
        ), d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), f AS (
            SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) GROUP BY ALL
        ), g AS (
            SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM b) GROUP BY ALL
        ), words AS (
            SELECT word, list_prepend(4294967295, list_transform(range(strlen(word)), lambda k: CAST('0x' || hex(word)[2 * k + 1:2 * k + 2] AS BIGINT))) AS octets
            FROM (SELECT word FROM f UNION SELECT word FROM g)
        ), hashed AS (
            SELECT word, xor(list_reduce(octets, lambda c, o: xor(code[xor(c, o) % 256 + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM words, codes
        ), s AS (SELECT bucket, sum(n) AS n FROM f JOIN hashed USING (word) GROUP BY bucket),
        t AS (SELECT bucket, sum(n) AS n FROM g JOIN hashed USING (word) GROUP BY bucket),
        gains AS (
            SELECT k AS bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + CAST(1 AS DOUBLE)) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000) / ((coalesce(s.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + CAST(10000 AS DOUBLE))))) AS BIGINT) AS gain
            FROM range(10000) r(k) LEFT JOIN s ON s.bucket = k LEFT JOIN t ON t.bucket = k
        ), weights AS (
            SELECT doc_id, sum(n * gain) AS total FROM f JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id
        ), scored AS (
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(CASE WHEN len(w) = 0 THEN 0 ELSE floor(CAST(coalesce(total, 0) AS DOUBLE) / len(w)) END AS BIGINT) AS weight,
                CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) + CAST(0.5 AS DOUBLE)) / 4294967296))) AS BIGINT) AS noise
            FROM d LEFT JOIN weights USING (doc_id)
        ), placed AS (
            SELECT doc_id, n_features, weight, weight + noise AS score, n_features >= 20 AS fit, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS place FROM scored
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= (SELECT count(*) * 10 // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank FROM placed
    """,
}
