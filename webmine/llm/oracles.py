"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .common import WORD

_OP2 = """
WITH v AS (
  SELECT vec_id, min(embedding::DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_cosine_similarity(q.v, d.v) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP3 = """
WITH d AS (
  SELECT doc_id, (coalesce(octet_length(encode(text)), 0) + 8)::BIGINT AS size, coalesce(doc_id::VARCHAR, '') AS name, text
  FROM documents
), r AS (
  SELECT *, row_number() OVER () AS row_no FROM d
), u AS (
  SELECT row_no, s AS shard, (('0x' || substr(md5(name || ':' || s::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM r, range(0, 25) t(s)
), w AS (
  SELECT row_no, arg_min(shard, -ln(u)) FILTER (shard < 24)::INTEGER AS shard, arg_min(shard, -ln(u))::INTEGER AS grown_shard
  FROM u GROUP BY row_no
), c AS (
  SELECT doc_id, size, name, shard, grown_shard, {crc32} AS text_crc32 FROM r JOIN w USING (row_no)
), b AS (
  SELECT *, ('0x' || substr(md5(name || ':' || text_crc32::VARCHAR), 1, 3))::INTEGER AS bucket FROM c
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS LAST, text_crc32, size) - 1 AS slot
FROM b
"""

_OP7 = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, coalesce(text, '') AS text
  FROM documents
), t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight FROM t
), f AS (
  SELECT *, source_size * 3 AS cap, (source_size * 3)::DOUBLE / weight AS full_time FROM w
), p AS (
  SELECT *, row_number() OVER o AS place,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_time
  FROM f WINDOW o AS (ORDER BY full_time, source NULLS LAST)
), g AS (
  SELECT source, source_size, least(cap::DOUBLE, (SELECT arg_min(at_time, place) FROM p WHERE at_time <= full_time) * weight) AS target
  FROM p
), k AS (
  SELECT d.*, g.source_size, g.target, md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(text)) AS h
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY substr(h, 1, 3), h, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS through
  FROM k
)
SELECT doc_id, size, source_size, target,
  (size * len(list_filter([0, 1, 2], lambda e: (e * source_size + through) * 2 - size <= target * 2)))::BIGINT AS taken
FROM c
"""

_OP9 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
  f AS (SELECT payload, min(page_id) AS first_id FROM p GROUP BY payload)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, {base32} AS payload_digest,
  CASE WHEN first_id IS NULL OR page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p JOIN f USING (payload)
"""


def _op12(rounds: int = 6) -> str:
    """The rounds of assigning and averaging, one pair of common table expressions each."""
    distance = "list_sum(list_transform(range(1, len(d.v) + 1), lambda i: (d.v[i] - b.v[i]) * (d.v[i] - b.v[i])))::BIGINT"
    sql = """
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda c: floor(4096 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), p AS MATERIALIZED (
  SELECT rid, part, list_slice(x, part * (len(x) // 8) + 1, (part + 1) * (len(x) // 8)) AS v FROM k, range(0, 8) t(part)
), d AS MATERIALIZED (SELECT part, v, count(*) AS n FROM p GROUP BY part, v
), f AS (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS e FROM k QUALIFY e < 16
), b0 AS MATERIALIZED (SELECT part, e, v FROM p JOIN f USING (rid))"""
    for r in range(rounds + 1):
        sql += f"""
, a{r} AS MATERIALIZED (
  SELECT part, v, n, arg_min(e, s * 16 + e) AS e, min(s) AS s FROM (SELECT d.part, d.v, d.n, b.e, {distance} AS s FROM d JOIN b{r} b USING (part))
  GROUP BY part, v, n
)"""
        if r < rounds:
            sql += f"""
, c{r} AS (
  SELECT part, e, i, sum(v[i] * n)::BIGINT AS s, sum(n)::BIGINT AS n FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM a{r}) GROUP BY part, e, i
), m{r} AS (SELECT part, e, list((s - (s % n + n) % n) // n ORDER BY i) AS moved FROM c{r} GROUP BY part, e
), b{r + 1} AS MATERIALIZED (SELECT part, e, coalesce(moved, v) AS v FROM b{r} LEFT JOIN m{r} USING (part, e))"""
    return sql + f"""
, h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds}
), o AS (
  SELECT rid, string_agg(printf('%02x', e::INTEGER), '' ORDER BY part) AS code, sum(s)::BIGINT AS error
  FROM p JOIN a{rounds} USING (part, v) GROUP BY rid
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM k JOIN o USING (rid), h
"""


def _crc_table() -> list[int]:
    """The byte table of CRC-32 (polynomial EDB88320, as in gzip): eight shifts of each byte."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return table


def _with_crc(sql: str) -> str:
    """``sql`` with a CRC-32 of the UTF-8 of ``text`` where it says ``{crc32}``; DuckDB has no such function."""
    hexed = "hex(encode(coalesce(text, '')))"
    bytes_ = f"list_transform(range(0, length({hexed}) // 2), lambda i: ('0x' || substr({hexed}, i * 2 + 1, 2))::BIGINT)"
    fold = (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: "
        f"xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295)"
    )
    return sql.replace("{crc32}", f"({fold})")


def _base32_sha1() -> str:
    """Upper-case base32 of the SHA-1 of ``payload``: its 160 bits in 32 groups of five."""
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, g * 10 + 1, 10))::BIGINT >> (35 - k * 5)) & 31)::INTEGER + 1, 1)"
    return f"(SELECT string_agg({digit}, '' ORDER BY g, k) FROM (SELECT sha1(payload) AS h), range(4) a(g), range(8) b(k))"


ORACLES = {
    "op2_nearest_neighbours": _OP2,
    "op3_sharding": _with_crc(_OP3),
    "op7_mixing": _OP7,
    "op12_vector_codes": _op12(),
    "op9_warc": _OP9.replace("{base32}", _base32_sha1()),
}
