"""DuckDB twins of the queries that SQL can express. The others are tested against brute force in tests/llm."""

from __future__ import annotations

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS n, sha1(body) AS h FROM p),
f AS (SELECT h, min(page_id) AS first, count(*) AS copies FROM d GROUP BY h),
b AS (SELECT d.*, first, copies > 1 AND d.page_id IS DISTINCT FROM first AS again,
      CAST(CAST(unhex(d.h) AS BIT) AS VARCHAR) AS bits FROM d JOIN f USING (h))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT)
    + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to
FROM b
"""

_LINES = """
WITH l AS (
  SELECT source, md5(line) AS digest FROM (
    SELECT source, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13))))) AS line
    FROM documents WHERE source IS NOT NULL) WHERE line <> ''),
t AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source),
c AS (SELECT source, digest, count(*) AS pages FROM l GROUP BY source, digest),
bad AS (SELECT source, list(digest) AS digests FROM c JOIN t USING (source)
        WHERE pages >= 3 AND pages > CAST(0.1 AS DOUBLE) * n GROUP BY source),
k AS (
  SELECT doc_id, d.source, string_split(text, chr(10)) AS lines,
    list_filter(string_split(text, chr(10)),
      lambda x: NOT list_contains(coalesce(digests, []), md5(trim(x, chr(32) || chr(9) || chr(13))))) AS kept
  FROM documents d LEFT JOIN bad ON d.source = bad.source)
SELECT doc_id, source, CASE WHEN len(kept) = 0 THEN '' ELSE array_to_string(kept, chr(10)) END AS text,
  CAST(coalesce(len(lines), 0) AS BIGINT) AS lines_total,
  CAST(coalesce(len(lines), 0) - coalesce(len(kept), 0) AS BIGINT) AS lines_dropped
FROM k
"""

_MIX = """
WITH RECURSIVE s AS MATERIALIZED (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    md5('17:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS place FROM documents),
w AS MATERIALIZED (
  SELECT source, CAST(sum(size) AS BIGINT) AS size,
    [5.0, 2.0, 1.0][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)]::DOUBLE AS weight
  FROM s GROUP BY source),
t AS MATERIALIZED (SELECT CAST(sum(size) AS DOUBLE) AS total FROM w),
-- Sources in the order in which a rising level reaches their cap.
o AS MATERIALIZED (
  SELECT *, row_number() OVER o AS place,
    coalesce(sum(3.0::DOUBLE * size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(weight) OVER (ORDER BY 3.0::DOUBLE * size / weight DESC, source DESC NULLS FIRST) AS free
  FROM w WINDOW o AS (ORDER BY 3.0::DOUBLE * size / weight, source NULLS LAST)),
lv AS (SELECT min_by((total - used) / free, place) AS level FROM o, t WHERE (total - used) / free * weight <= 3.0::DOUBLE * size),
g AS MATERIALIZED (
  SELECT source, size AS source_size,
    CASE WHEN level IS NULL OR level * weight > 3.0::DOUBLE * size THEN 3.0::DOUBLE * size ELSE level * weight END AS target
  FROM w, lv),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM g),
e AS (SELECT s.doc_id, s.size, s.source, source_size, target, whole,
    CAST(round(target - whole * source_size) AS BIGINT) AS part,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY place, doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS before
  FROM s JOIN q ON s.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + least(greatest(part - before, 0), size) AS BIGINT) AS taken FROM e
"""

_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, p.vec_id, CAST(list_inner_product(q.w, p.w) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id % 100 = 0 AND p.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INT) AS rank, vec_id, score FROM r WHERE place <= 10
"""

# All pairs of a label; components by following the smallest id until nothing changes.
_LINKS = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT DISTINCT a, a AS b FROM p UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id,
  vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.a
"""

_FIM = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
  regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units
  FROM documents),
d AS (SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1,
  CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
    THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS pre,
  coalesce(array_to_string(units[a + 1:b], ''), '') AS mid, coalesce(array_to_string(units[b + 1:n], ''), '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""

_CHAT = """
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, replace(regexp_replace(role, '<(\\\\*)\\|', '<\\\\\\1|', 'g'), chr(10), '<|nl|>') AS shown_role,
  regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') AS shown FROM m)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(shown_role) + 1 + length(shown) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def _codes(parts: int = 8, size: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Six rounds of assignment and floored means, each a pair of CTEs."""
    with_ = [
        """k AS MATERIALIZED (SELECT vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT vec_id, label, part, v[part * {size} + 1:part * {size} + {size}] AS v FROM k, range({parts}) r(part))",
        f"""b0 AS MATERIALIZED (SELECT part, rank - 1 AS entry, v FROM
        (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS rank FROM p) WHERE rank <= {entries})""",
    ]
    for i in range(rounds + 1):
        apart = " + ".join(f"(p.v[{j}] - b.v[{j}]) * (p.v[{j}] - b.v[{j}])" for j in range(1, size + 1))
        with_.append(
            f"""a{i} AS MATERIALIZED (SELECT vec_id, part, min(label) AS label, min(p.v) AS v, min(({apart}) * 256 + entry) AS best
            FROM p JOIN b{i} b USING (part) GROUP BY vec_id, part)"""
        )
        if i < rounds:
            means = ", ".join(
                f"CAST((sum(v[{j}]) - ((sum(v[{j}]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)" for j in range(1, size + 1)
            )
            with_.append(
                f"""b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN
                (SELECT part, best % 256 AS entry, [{means}] AS v FROM a{i} GROUP BY part, best % 256) m USING (part, entry))"""
            )
    return f"""
    WITH {", ".join(with_)},
    c AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code,
      CAST(sum(best // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
      (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
    FROM c
    """


STATEMENTS = {"op1_warc": _WARC, "op2_line_dedup": _LINES, "op5_mixing": _MIX, "op7_embedding_dedup": _LINKS, "op8_top_k": _TOP_K, "op11_fill_in_middle": _FIM, "op12_chat_format": _CHAT, "op13_vector_codes": _codes()}
