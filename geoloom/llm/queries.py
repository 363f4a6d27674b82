"""The registered queries of this package, each an operator on its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geoloom.llm import decontaminate, langid, mixing, quality, rules, sharding, simhash, suffixes, suffixtree, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1,
    "op2_suffixes": suffixes.op2,
    "op3_suffixtree": suffixtree.op3,
    "op4_rules": rules.op4,
    "op5_langid": langid.op5,
    "op6_simhash": simhash.op6,
    "op7_quality": quality.op7,
    "op8_sharding": sharding.op8,
    "op9_warc": warc.op9,
    "op10_decontaminate": decontaminate.op10,
}

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {shift}) & 31) + 1, 1)" for shift in (15, 10, 5, 0))
_WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
hashed AS (SELECT page_id, strlen(body) AS n, sha1(body) AS h FROM p),
digests AS (SELECT DISTINCT h, array_to_string(list_transform(list_transform(range(8), lambda k: CAST('0x' || substr(h, CAST(5 * k + 1 AS BIGINT), 5) AS BIGINT)), lambda v: {_BASE32}), '') AS digest FROM hashed),
firsts AS (SELECT h, max(page_id) AS top FROM hashed GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM hashed JOIN digests USING (h) JOIN firsts USING (h)"""

#: Every 50-byte window of every text, in hexadecimal: only for small tables.
_SUFFIXES = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, s, substr(x, CAST(2 * s + 1 AS BIGINT), 100) AS k FROM (SELECT doc_id, x, unnest(range(length(x) // 2 - 49)) AS s FROM d)),
hit AS (SELECT doc_id, s FROM w JOIN (SELECT k, min(doc_id) AS lo FROM w GROUP BY k) USING (k) WHERE doc_id > lo),
runs AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS b FROM (SELECT doc_id, s, sum(step) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS step FROM hit)) GROUP BY doc_id, g),
pieces AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM runs),
cut AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS n, string_agg(substr(x, CAST(2 * z + 1 AS BIGINT), CAST(2 * (a - z) AS BIGINT)), '' ORDER BY a) AS head, max(b) AS last FROM pieces JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(CASE WHEN n IS NULL THEN x ELSE head || substr(x, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""

#: DuckDB SQL for those of QUERIES that it can express: the others need CRC-32, XXH64, a model or seeded choices.
ORACLES: dict[str, str] = {"op2_suffixes": _SUFFIXES, "op9_warc": _WARC}
