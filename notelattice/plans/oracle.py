"""DuckDB statements that give what the registered queries give, written apart from the Spark code."""

from __future__ import annotations

WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)||chr(8232)||chr(8233)||chr(12288)"
NOT_PLAIN = (
    r"\A(?:---|\.\.\.|[#,\[\]{}&*!|>''\"%@`]|[-?:](?:\s|\z))|:(?:\s|\z)|\s#|\A\s|\s\z|\A\z"
    r"|\A(?:~|null|Null|NULL|true|True|TRUE|false|False|FALSE)\z"
    r"|\A[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?\z"
)


def trim(x: str) -> str:
    return f"trim({x}, {WS})"


def slug(x: str) -> str:
    return f"('wiki/' || ({x}) % 20 || '/' || ({x}) || CASE WHEN ({x}) % 29 = 0 THEN '!' ELSE '' END)"


def scalar(x: str) -> str:
    quoted = "'''' || replace({x}, '''', '''''') || ''''".format(x=x)
    return f"CASE WHEN regexp_matches({x}, '{NOT_PLAIN}') THEN {quoted} ELSE {x} END"


def block(x: str) -> str:
    items = f"array_to_string(list_transform({x}, lambda v: '- ' || ({scalar('v')})), chr(10))"
    return f"CASE WHEN len({x}) = 0 THEN ' []' ELSE chr(10) || {items} END"


def entries(x: str) -> str:
    by = "coalesce(' [' || coalesce(e.source_url, e.agent) || ']', '')"
    line = f"'- ' || e.date || {by} || ': ' || e.content || chr(10)"
    return f"array_to_string(list_transform({x}, lambda e: {line}), '')"


def rendered(truth: str, title="title", tags="tags", timeline="timeline", page_type="page_type") -> str:
    nl = "chr(10)"
    null = lambda x: f"coalesce({scalar(x)}, 'null')"
    return (
        f"'---' || {nl} || 'title: ' || {scalar(title)} || {nl} || 'page_type: ' || {page_type} || {nl} || 'tags:' || "
        f"{block(tags)} || {nl} || 'sources:' || {block('sources')} || {nl} || 'date: ' || {null('date')} || {nl} || "
        f"'visibility: ' || visibility || {nl} || 'created_by: ' || {null('created_by')} || {nl} || '---' || {nl} || "
        f"{truth} || {nl} || {nl} || '---' || {nl} || {entries(timeline)}"
    )


ENTRY = "STRUCT(date VARCHAR, source_url VARCHAR, content VARCHAR, agent VARCHAR)"
LINKS_TEXT = (
    "chr(10) || chr(10) || 'See [[' || typed || {s1} || ']] and [[' || typed || {s2} || '.md|second]].' || chr(10) || "
    "chr(10) || '```' || chr(10) || '[[decoy]]' || chr(10) || '---' || chr(10) || '```' || chr(10) || chr(10) || "
    "'Use `[[code]]` too.'"
)

BASE = f"""
kb0 AS MATERIALIZED (
  SELECT d.doc_id, d.lang, d.source, {slug('d.doc_id')} AS slug,
    CASE WHEN d.doc_id % 17 = 0 THEN ' ' ELSE {trim("split_part(d.text, chr(10), 1)")} END AS title,
    (['Entity','Concept','Source','Query','Synthesis','Comparison'])[d.doc_id % 6 + 1] AS page_type,
    CASE WHEN d.doc_id % 13 = 0 THEN []::VARCHAR[] WHEN l.quality = 1 THEN [d.lang, d.source, 'quality']
         ELSE [d.lang, d.source] END AS tags,
    CASE WHEN d.doc_id % 5 = 0 THEN []::VARCHAR[]
         ELSE ['https://example.org/' || d.source || '/' || d.doc_id] END AS sources,
    CASE WHEN d.doc_id % 3 <> 0 THEN '2024-' || lpad((d.doc_id % 12 + 1)::VARCHAR, 2, '0') || '-' ||
         lpad((d.doc_id % 28 + 1)::VARCHAR, 2, '0') END AS date,
    CASE WHEN d.doc_id % 10 = 0 THEN 'private' ELSE 'shared' END AS visibility,
    CASE WHEN d.doc_id % 4 <> 0 THEN d.lang END AS created_by,
    CASE WHEN d.doc_id % 31 = 0 THEN '' ELSE {trim('d.text')} END AS truth,
    list_transform(range(d.doc_id % 4), lambda i: {{
        'date': '2024-01-0' || (i + 1), 'source_url': CASE WHEN i = 0 THEN 'https://example.org/' || d.source END,
        'content': d.source || '-note ' || i || ' of ' || d.lang, 'agent': CASE WHEN i = 1 THEN d.lang END
    }}::{ENTRY}) AS timeline,
    1672531200 + d.doc_id * 60 AS created, 1704067200 + d.doc_id * 3600 AS updated
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
kb AS (SELECT *, array_to_string(list_transform(timeline, lambda e: e.content), ' ') AS timeline_text FROM kb0),
n_docs AS (SELECT count(*) AS n FROM documents),
targets AS (
  SELECT doc_id, (doc_id * 7 + 1) % (n + n // 10) AS t1, (doc_id * 13 + 5) % (n // 2) AS t2,
    (['plain','cites','references'])[doc_id % 3 + 1] AS kind FROM documents, n_docs),
two AS (
  SELECT doc_id, t1 AS t, kind, NULL AS snip, 0 AS pos FROM targets UNION ALL
  SELECT doc_id, t2, kind, 'second', 1 FROM targets),
lk AS MATERIALIZED (
  SELECT source_slug, target_slug, link_type, context_snippet FROM (
    SELECT {slug('doc_id')} AS source_slug, {slug('t')} AS target_slug, kind AS link_type,
      snip AS context_snippet,
      row_number() OVER (PARTITION BY doc_id, t, kind ORDER BY pos) AS rn
    FROM two WHERE t <> doc_id) WHERE rn = 1),
notes0 AS (
  SELECT kb.* EXCLUDE (truth), t1, t2, kind,
    CASE WHEN kind = 'plain' THEN '' ELSE kind || '::' END AS typed, truth AS plain_truth FROM kb JOIN targets USING (doc_id)),
notes1 AS (SELECT *, {trim("plain_truth || " + LINKS_TEXT.format(s1=slug('t1'), s2=slug('t2')))} AS truth FROM notes0),
notes AS (SELECT *, {rendered('truth')} AS raw FROM notes1),
valid AS (SELECT * FROM notes WHERE doc_id % 29 <> 0)
"""

def shared_pairs(condition: str) -> str:
    return f"""WITH {GRAPH}, e AS (SELECT DISTINCT source_slug AS s, target_slug AS t FROM lk),
sets AS (SELECT s, list_sort(list(t)) AS ts FROM e GROUP BY s),
cls AS (SELECT s, ts, len(ts) AS size, min(s) OVER (PARTITION BY ts) AS rep FROM sets),
r AS (SELECT e.s, e.t, size FROM e JOIN cls USING (s) WHERE e.s = rep)
SELECT a.s AS slug_a, b.s AS slug_b, count(*)::BIGINT AS n_shared FROM r a JOIN r b ON a.t = b.t AND a.s < b.s
GROUP BY 1, 2, a.size, b.size HAVING {condition}
UNION ALL SELECT rep, s, size::BIGINT FROM cls WHERE s <> rep AND size >= 2"""


GRAPH = """
lk AS MATERIALIZED (
  SELECT 'order/' || o_orderkey AS source_slug, 'customer/' || o_custkey AS target_slug, 'placed_by' AS link_type FROM orders
  UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey, 'in' FROM customer
  UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey, 'in' FROM nation
  UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey, 'in' FROM supplier
  UNION ALL SELECT DISTINCT 'order/' || l_orderkey, 'part/' || l_partkey, 'contains' FROM lineitem),
pg AS (
  SELECT 'order/' || o_orderkey AS slug, 'order' AS page_type FROM orders
  UNION ALL SELECT 'customer/' || c_custkey, 'customer' FROM customer
  UNION ALL SELECT 'nation/' || n_nationkey, 'nation' FROM nation
  UNION ALL SELECT 'region/' || r_regionkey, 'region' FROM region
  UNION ALL SELECT 'supplier/' || s_suppkey, 'supplier' FROM supplier
  UNION ALL SELECT 'part/' || p_partkey, 'part' FROM part)
"""

COLUMNS = {"slug": 10, "title": 5, "truth": 1, "timeline_text": 1}


def _count(column: str, term: str) -> str:
    """Occurrences of a term; three-letter terms like 'ere' that overlap themselves by one letter included."""
    if term[0] == term[-1] and len(term) == 3:
        inner = f"string_split({column}, '{term[0]}')"
        return f"len(list_filter({inner}[2:len({inner}) - 1], lambda x: x = '{term[1]}'))"
    return f"(length({column}) - length(replace({column}, '{term}', ''))) // {len(term)}"


def _search(terms: list[str], condition: str, order: str, limit: int | None, where: str = "", counts=None) -> str:
    """``condition`` names the terms {0}, {1}, ...; ``counts`` says for each term where it is scored."""
    weights = COLUMNS
    held = [f"h{i}" for i in range(len(terms))]
    counts = [c.format(*held) for c in counts or ["true"] * len(terms)]
    lower = ", ".join(f"lower({c}) AS low_{c}" for c in COLUMNS)
    tokens = " + ".join(f"greatest(length({c}) - 2, 0)" for c in COLUMNS)
    freq = ", ".join(
        "(" + " + ".join(f"{w} * {_count('low_' + c, t)}" for c, w in weights.items()) + f") AS f{i}"
        for i, t in enumerate(terms)
    )
    has = ", ".join(
        "(" + " OR ".join(f"contains(low_{c}, '{t}')" for c in COLUMNS) + f") AS h{i}" for i, t in enumerate(terms)
    )
    n_with = ", ".join(f"count(*) FILTER (h{i}) AS n{i}" for i in range(len(terms)))
    idf = "greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 0)"
    score = " + ".join(
        f"CASE WHEN f{i} > 0 AND {counts[i]} THEN -(CASE WHEN {idf.format(i=i)} > 0 THEN {idf.format(i=i)} ELSE 1e-6 END) * f{i} * 2.2 / "
        f"(f{i} + 1.2 * (0.25 + 0.75 * d / mean_d)) ELSE 0 END"
        for i in range(len(terms))
    )
    tail = f"ORDER BY {order} LIMIT {limit}" if limit else ""
    return f"""WITH {BASE},
t AS (SELECT slug, title, truth, updated, page_type, {tokens} AS d, {lower} FROM kb),
h AS (SELECT *, {has} FROM t),
st AS (SELECT count(*) AS n, avg(d) AS mean_d, {n_with} FROM h),
f AS (SELECT *, {freq} FROM h WHERE {condition.format(*held)}),
s AS (SELECT slug, title, left(truth, 200) AS preview, {score} AS score, updated FROM f, st {where})
SELECT slug, title, preview, round(score, 8) AS rank FROM s {tail}"""


def _neighbors(base: str, edges: str, start: str, depth: int) -> str:
    return f"""WITH RECURSIVE {base}, e AS ({edges}),
b AS (SELECT '{start}' AS slug, 0 AS distance UNION
      SELECT e.dst, b.distance + 1 FROM b JOIN e ON e.src = b.slug WHERE b.distance < {depth})
SELECT slug, min(distance)::BIGINT AS distance FROM b WHERE slug <> '{start}' GROUP BY slug"""


FORWARD = "SELECT source_slug AS src, target_slug AS dst FROM lk"
BACKWARD = "SELECT target_slug AS src, source_slug AS dst FROM lk"

LINT = """
  SELECT 'error' AS severity, 'lint' AS scope, 'Page ''' || slug || ''' has empty title' AS message FROM kb WHERE trim(title) = ''
  UNION ALL SELECT 'warning', 'lint', 'Page ''' || slug || ''' has empty compiled_truth' FROM kb WHERE truth = ''
  UNION ALL SELECT 'error', 'lint', 'Page ''' || slug || ''' has invalid slug format' FROM kb WHERE contains(slug, '!')
  UNION ALL SELECT 'warning', 'lint', 'Page ''' || slug || ''' (Source) has empty sources' FROM kb
    WHERE page_type = 'Source' AND len(sources) = 0
  UNION ALL SELECT 'warning', 'lint', 'Page ''' || slug || ''' has empty tags' FROM kb WHERE len(tags) = 0
  UNION ALL SELECT 'warning', 'lint', 'Page ''' || slug || ''' has empty timeline' FROM kb WHERE len(timeline) = 0"""

SLUG_ERROR = """CASE WHEN slug = '' THEN 'slug must not be empty'
    WHEN strlen(slug) > 255 THEN 'slug exceeds maximum length of 255 characters (got ' || strlen(slug) || ' characters)'
    WHEN contains(slug, '..') THEN 'slug must not contain ''..'' (path traversal)'
    WHEN starts_with(slug, '/') OR ends_with(slug, '/') THEN 'slug must not start or end with ''/'''
    WHEN NOT regexp_full_match(slug, '[A-Za-z0-9_./-]*') THEN 'slug ''' || slug ||
      ''' contains invalid characters: only ASCII alphanumeric, ''-'', ''_'', ''/'', and ''.'' are allowed' END"""
INVALID = """'slug ''' || slug || ''' contains invalid characters: only ASCII alphanumeric, ''-'', ''_'', ''/'', and ''.'' are allowed'"""

_OLD_TRUTH = "CASE WHEN source IN ('src3', 'src4') THEN 'Draft. ' || truth ELSE truth END"
SNAPSHOTS = f"""{BASE},
older AS (SELECT slug, doc_id, title, source, lang, {rendered(_OLD_TRUTH)} AS raw FROM valid WHERE lang <> 'de'),
newer AS (SELECT slug, doc_id, title, page_type, source, raw FROM notes WHERE source <> 'src7'),
status AS (
  SELECT coalesce(n.slug, o.slug) AS slug, CASE WHEN n.slug IS NULL THEN 'removed' WHEN n.source = 'src5' THEN 'failed'
    WHEN o.slug IS NULL THEN 'new' WHEN o.raw <> n.raw THEN 'changed' ELSE 'unchanged' END AS status
  FROM newer n FULL JOIN older o ON n.slug = o.slug),
todo AS (SELECT slug FROM status WHERE status IN ('new', 'changed') AND NOT contains(slug, '!')),
synced AS (
  SELECT n.slug, trim_title AS title, sha256(n.raw) AS content_hash,
    CASE WHEN o.slug IS NULL THEN 1735689600 ELSE 1672531200 END AS created, 1735689600 AS updated
  FROM (SELECT *, title AS trim_title FROM newer) n JOIN todo USING (slug) LEFT JOIN older o ON n.slug = o.slug
  UNION ALL
  SELECT o.slug, o.title, sha256(o.raw), 1672531200, 1672531200 FROM older o JOIN status s ON o.slug = s.slug
  WHERE s.status IN ('unchanged', 'failed')),
gone AS (SELECT slug FROM status WHERE status = 'removed')
"""
_LINKS_OF = "SELECT lk.* FROM lk JOIN {0} x ON lk.source_slug = x.slug"

_TALK = """
stored AS (SELECT slug, sha256(raw) AS hash, * EXCLUDE (slug, raw) FROM notes),
turns AS (
  SELECT c.*, max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM conversations c),
named AS (
  SELECT *, CASE WHEN last_turn >= 4 THEN {slug} ELSE 'talk/' || conv_id END AS slug FROM turns),
ed AS (
  SELECT n.*, s.hash, CASE WHEN turn IN (0, 2) THEN s.hash END AS etag, contains(n.slug, '!') AS bad
  FROM named n LEFT JOIN stored s ON n.slug = s.slug),
res AS (
  SELECT slug, turn AS seq, role, text, CASE WHEN bad THEN 'rejected'
    WHEN hash IS NOT NULL AND turn = 2 THEN 'conflict' ELSE 'applied' END AS status, etag, bad FROM ed)
""".format(slug=slug("conv_id"))



def _folded(page: str, condition: str) -> str:
    """Common table ``page``: pages after the applied edits that meet the condition, with their note text."""
    return f"""
{page}_fold AS (
  SELECT slug, arg_max(text, seq) AS body, arg_min(role, seq) AS role0, arg_min(text, seq) AS text0,
    list({{'date': '2025-01-01', 'source_url': NULL, 'content': role || ' turn ' || seq,
      'agent': CASE WHEN seq <> 1 THEN role END}}::{ENTRY} ORDER BY seq) AS added
  FROM res WHERE status = 'applied' AND {condition} GROUP BY slug),
{page}_page AS (
  SELECT f.slug, {trim("split_part(text0, chr(10), 1)")} AS title, [role0, 'talk'] AS tags, coalesce(s.page_type, 'Entity') AS page_type,
    coalesce(s.sources, []) AS sources, s.date, coalesce(s.visibility, 'shared') AS visibility, s.created_by, body,
    list_concat(coalesce(s.timeline, []), added) AS timeline, coalesce(s.created, 1735689600) AS created
  FROM {page}_fold f LEFT JOIN stored s ON f.slug = s.slug),
{page} AS (SELECT *, sha256({rendered('body')}) AS content_hash FROM {page}_page)"""


_FOLDED = f"""{_TALK}, {_folded('page', 'true')}
SELECT slug, title, array_to_string(tags, '|') AS tags, {trim('body')} AS compiled_truth,
  array_to_string(list_transform(timeline, lambda e: e.content), ' ') AS timeline_text, content_hash, created FROM page"""


def statements() -> dict[str, str]:
    ending = "CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.MD' ELSE '' END"
    out = {
        "search_relevance": _search(["tion"], "{0}", "score, slug", 50),
        "search_overlap": _search(["ere"], "{0}", "score, slug", 100),
        "search_title_sort": _search(["tion"], "{0}", "title, slug", 25),
        "search_date_sort": _search(["ment"], "{0}", "updated DESC, slug", 25),
        "search_type_filter": _search(["tion"], "{0}", "score, slug", 100, "WHERE page_type = 'Source'"),
        "search_and": _search(["tion", "note"], "{0} AND {1}", "score, slug", 100),
        "search_or": _search(
            ["keit", "ment", "note"], "{0} OR ({1} AND {2})", "score, slug", 100, counts=["{0}", "{1} AND {2}", "{1} AND {2}"]
        ),
        "search_not": _search(["tion", "ment"], "{0} AND NOT {1}", "score, slug", 100),
        "search_phrase": _search(["src1-note 0"], "{0}", "score, slug", 100),
        "search_unweighted": "SELECT slug FROM (" + _search(["tion", "keit"], "{0} OR {1}", "", None) + ")",
        "search_batch": f"""WITH {BASE},
t AS (SELECT slug, title, truth, timeline_text, greatest(length(slug)-2,0)+greatest(length(title)-2,0)+greatest(length(truth)-2,0)+
        greatest(length(timeline_text)-2,0) AS d, lower(slug) AS a, lower(title) AS b, lower(truth) AS c, lower(timeline_text) AS e FROM kb),
w AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\s]', ' ', 'g'), '\\s+')) AS term
      FROM benchmark),
q AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n_terms FROM w WHERE length(term) >= 3),
terms AS (SELECT DISTINCT term FROM q),
has AS (SELECT t.slug, term FROM t, terms WHERE contains(a, term) OR contains(b, term) OR contains(c, term) OR contains(e, term)),
nt AS (SELECT term, count(*) AS nw FROM has GROUP BY term),
m AS MATERIALIZED (SELECT query_id, slug FROM q JOIN has USING (term) GROUP BY query_id, slug, n_terms HAVING count(*) = n_terms),
txt AS MATERIALIZED (SELECT slug, d, string_split(unnest([a, b, c, e]), '') AS x, unnest([10, 5, 1, 1]) AS w
  FROM t WHERE slug IN (SELECT slug FROM m)),
win AS MATERIALIZED (SELECT slug, d, w, unnest(list_transform(range(1, len(x) - 1), lambda i: array_to_string(x[i:i + 99], ''))) AS win
  FROM txt),
hit AS (SELECT query_id, slug, term, d, sum(w) AS f FROM m JOIN q USING (query_id) JOIN win USING (slug)
  WHERE starts_with(win, term) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(d) AS mean_d FROM t),
sc AS (SELECT query_id, slug, sum(-(CASE WHEN ln((n-nw+0.5)/(nw+0.5)) > 0 THEN ln((n-nw+0.5)/(nw+0.5))
      ELSE 1e-6 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean_d))) AS rank
  FROM hit JOIN nt USING (term), st GROUP BY ALL)
SELECT query_id, position::BIGINT AS position, slug, round(rank, 6) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, slug) AS position FROM sc) WHERE position <= 10""",
        "search_batch_status": """WITH w AS (SELECT item_id AS query_id,
  list_distinct(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\s]', ' ', 'g'), '\\s+')) AS t FROM benchmark),
c AS (SELECT query_id, len(t) AS n, len(list_filter(t, lambda x: length(x) < 3)) AS short FROM w)
SELECT query_id, n AS n_terms, short AS n_dropped,
  CASE WHEN short = n THEN 'no_terms' WHEN short > 0 THEN 'partly' ELSE 'searched' END AS status FROM c""",
        "search_after_sync": f"""WITH {SNAPSHOTS},
body AS (SELECT n.slug, n.title, n.truth, n.timeline_text FROM notes n JOIN todo USING (slug)
  UNION ALL SELECT n.slug, n.title, CASE WHEN n.source IN ('src3', 'src4') THEN 'Draft. ' || n.truth ELSE n.truth END, n.timeline_text
  FROM older o JOIN valid n USING (slug) JOIN status s ON o.slug = s.slug WHERE s.status IN ('unchanged', 'failed'))
SELECT slug FROM body WHERE contains(lower(slug || chr(10) || title || chr(10) || truth || chr(10) || timeline_text), 'tion')
  OR contains(lower(slug || chr(10) || title || chr(10) || truth || chr(10) || timeline_text), 'keit')""",
        "trigram_postings": f"""WITH {BASE},
c AS (SELECT slug, unnest(['slug','title','compiled_truth','timeline_text']) AS "column",
        unnest([lower(slug), lower(title), lower(truth), lower(timeline_text)]) AS s FROM kb),
ch AS (SELECT slug, "column", string_split(s, '') AS x FROM c WHERE length(s) >= 3),
g AS (SELECT slug, "column", unnest(list_transform(range(1, len(x) - 1), lambda i: x[i] || x[i + 1] || x[i + 2])) AS trigram FROM ch)
SELECT trigram, "column", count(DISTINCT slug) AS n_pages, count(*) AS n_occurrences FROM g GROUP BY ALL""",
        "page_lookup": f"""WITH {BASE} SELECT slug, title, page_type, sha256({rendered('truth')}) AS content_hash FROM kb
WHERE slug IN (SELECT target_slug FROM lk WHERE link_type = 'cites')""",
        "page_view": f"""WITH {BASE}
SELECT slug, title, array_to_string(tags, '|') AS tags, truth AS body, len(timeline)::BIGINT AS n_entries, sha256(raw) AS content_hash, NULL AS error FROM valid
UNION ALL SELECT 'raw/' || conv_id || '/' || turn, NULL, NULL, text, 0, sha256(text), NULL FROM conversations
UNION ALL SELECT slug, NULL, NULL, NULL, NULL, NULL, {INVALID} FROM notes WHERE doc_id % 29 = 0""",
        "page_list": f"""WITH p AS (SELECT {slug('doc_id')} || '.md' AS path FROM documents
  UNION ALL SELECT 'raw/' || conv_id || '/' || turn || '.md' FROM conversations)
SELECT DISTINCT split_part(path, '/', 1) AS path, 'folder' AS kind FROM p
UNION ALL SELECT DISTINCT 'wiki/' || split_part(path, '/', 2), 'folder' FROM p WHERE path LIKE 'wiki/%'
UNION ALL SELECT DISTINCT path, 'file' FROM p WHERE path LIKE 'wiki/7/%'""",
        "note_walk": """WITH p AS (SELECT CASE source WHEN 'src1' THEN 'wiki/.trash/' WHEN 'src2' THEN 'wiki/a/b/c/d/e/f/g/h/i/j/'
    WHEN 'src3' THEN 'wiki/a/b/c/d/e/f/g/h/i/j/k/' WHEN 'src4' THEN 'raw/' ELSE 'wiki/' END || doc_id || '.md' AS path,
    source, lang, text FROM documents)
SELECT path, sha256(text) AS content_hash FROM p WHERE source NOT IN ('src1', 'src3', 'src4') AND lang NOT IN ('de', 'fr')""",
        "has_link_batch": f"""WITH {BASE}, back AS (SELECT DISTINCT target_slug AS source_slug, source_slug AS target_slug FROM lk)
SELECT b.source_slug, b.target_slug, EXISTS (SELECT 1 FROM lk WHERE lk.source_slug = b.source_slug AND lk.target_slug = b.target_slug)
  AS has_link FROM back b""",
        "stats": f"""WITH {BASE} SELECT count(*) AS total_pages, count(*) FILTER (page_type = 'Entity') AS n_entity,
  count(*) FILTER (page_type = 'Concept') AS n_concept, count(*) FILTER (page_type = 'Source') AS n_source,
  count(*) FILTER (page_type = 'Query') AS n_query, count(*) FILTER (page_type = 'Synthesis') AS n_synthesis,
  count(*) FILTER (page_type = 'Comparison') AS n_comparison, (SELECT count(*) FROM lk) AS total_links,
  (SELECT count(*) FROM kb ANTI JOIN lk ON slug = target_slug) AS orphan_count FROM kb""",
        "pages_by_type": f"WITH {GRAPH} SELECT page_type, count(*) AS n_pages FROM pg GROUP BY page_type",
        "tags_list": f"WITH {BASE} SELECT DISTINCT unnest(tags) AS tag FROM kb",
        "tags_or": f"""WITH {BASE} SELECT DISTINCT slug, title, array_to_string(tags, '|') AS tags, page_type FROM (
  SELECT *, unnest(tags) AS tag FROM kb) WHERE tag IN ('de', 'quality', 'src7')""",
        "tags_and": f"""WITH {BASE} SELECT slug, title, array_to_string(tags, '|') AS tags, page_type FROM kb
WHERE list_contains(tags, 'en') AND list_contains(tags, 'quality')""",
        "outlinks": f"WITH {GRAPH} SELECT *, NULL::VARCHAR AS context_snippet FROM lk WHERE source_slug = 'order/7'",
        "backlinks": f"""WITH {GRAPH} SELECT *, NULL::VARCHAR AS context_snippet FROM lk
WHERE target_slug = 'nation/7' AND link_type = 'in'""",
        "links_both": f"""WITH {GRAPH} SELECT source_slug, target_slug, 'Custom("' || link_type || '")' AS link_type, NULL::VARCHAR AS context_snippet
FROM (SELECT * FROM lk WHERE source_slug = 'customer/7' UNION ALL SELECT * FROM lk WHERE target_slug = 'customer/7')""",
        "links_of_orphans": f"""WITH {GRAPH}, hit AS (SELECT DISTINCT target_slug AS slug FROM lk),
lonely AS MATERIALIZED (SELECT slug FROM pg ANTI JOIN hit USING (slug))
SELECT source_slug, target_slug, link_type FROM lk SEMI JOIN lonely ON source_slug = slug""",
        "neighbors_out": _neighbors(BASE, FORWARD, "wiki/1/1", 6),
        "neighbors_in": _neighbors(GRAPH, BACKWARD, "region/1", 3),
        "neighbors_both": _neighbors(
            BASE, f"{FORWARD} WHERE link_type = 'cites' UNION ALL {BACKWARD} WHERE link_type = 'cites'", "wiki/1/1", 4
        ),
        "orphans": f"WITH {GRAPH} SELECT slug FROM pg ANTI JOIN lk ON slug = target_slug",
        "link_types": f"WITH {GRAPH} SELECT DISTINCT link_type FROM lk",
        "shared_links": f"""WITH {GRAPH} SELECT target_slug FROM lk WHERE source_slug = 'order/1'
INTERSECT SELECT target_slug FROM lk WHERE source_slug = 'order/2'""",
        "shared_links_batch": f"""WITH {GRAPH}, pr AS (SELECT 'order/' || lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS slug_a,
  'order/' || o_orderkey AS slug_b FROM orders)
SELECT DISTINCT slug_a, slug_b, x.target_slug FROM pr JOIN lk x ON x.source_slug = slug_a
  JOIN lk y ON y.source_slug = slug_b AND y.target_slug = x.target_slug""",
        "shared_links_top": shared_pairs("count(*) >= 2"),
        "shared_links_near": shared_pairs("count(*) >= 2 AND count(*) / (a.size + b.size - count(*)) >= 1 / 3"),
        "lint": f"WITH {BASE} {LINT}",
        "broken_links": f"""WITH {BASE} SELECT source_slug, target_slug, link_type FROM lk
ANTI JOIN kb ON target_slug = slug""",
        "maintain_full": f"""WITH {BASE} {LINT}
UNION ALL SELECT 'warning', 'orphans', 'Page ''' || slug || ''' has no inbound links' FROM kb
  ANTI JOIN lk ON slug = target_slug
UNION ALL SELECT 'error', 'backlinks', 'Page ''' || source_slug || ''' links to nonexistent page ''' || target_slug || '''' FROM lk
  ANTI JOIN kb ON target_slug = slug""",
        "slug_checks": f"""WITH s AS (SELECT regexp_replace(url, '^https?://', '') AS slug FROM pages
  UNION ALL SELECT {slug('doc_id')} || CASE WHEN lang = 'en' THEN '.md' ELSE '' END FROM documents)
SELECT slug, {SLUG_ERROR} AS error,
  CASE WHEN slug = '.md' THEN NULL WHEN ends_with(slug, '.md') THEN left(slug, length(slug) - 3) ELSE slug END AS normalized,
  CASE WHEN ends_with(slug, '.md') THEN slug ELSE slug || '.md' END AS path,
  starts_with(split_part(slug, '/', -1), '.') AS hidden, starts_with(slug, 'raw/') AS raw FROM s""",
        "parse_roundtrip": f"""WITH {BASE} SELECT slug, title, page_type, array_to_string(tags, '|') AS tags,
  array_to_string(sources, '|') AS sources, date, visibility, created_by, truth AS compiled_truth, timeline_text,
  len(timeline)::BIGINT AS n_entries FROM valid""",
        "frontmatter_escapes": f"""WITH x AS (SELECT doc_id, lang, source, ['C:\\new ', 'say "x" ', 'it''s ', 'tab' || chr(9) || 'and' || chr(10) || 'line ',
  'a: b # ', 'é日本 ', '\\\\', '- ', chr(7) || chr(133) || ' '] AS t FROM documents)
SELECT {slug('doc_id')} AS slug, t[doc_id % 9 + 1] || source AS title,
  t[(doc_id + 1) % 9 + 1] || lang || '|' || source || t[(doc_id + 2) % 9 + 1] AS tags FROM x""",
        "parse_errors": f"WITH {BASE} SELECT slug || '.md' AS path, {INVALID} AS parse_error FROM notes WHERE doc_id % 29 = 0",
        "timeline_entries": f"""WITH {BASE}, x AS (SELECT slug, unnest(range(len(timeline))) AS position, unnest(timeline) AS e FROM valid)
SELECT slug, position, e.date AS date, e.source_url AS source_url, e.content AS content, e.agent AS agent FROM x""",
        "timeline_stats": f"""WITH {BASE}, x AS (SELECT slug, unnest(timeline) AS e FROM kb)
SELECT e.date AS date, e.agent AS agent, count(*) AS n_entries, count(DISTINCT slug) AS n_pages FROM x GROUP BY e.date, e.agent""",
        "extract_wikilinks": f"WITH {BASE} " + _LINKS_OF.format("valid"),
        "repeated_links": """WITH d AS (SELECT 'wiki/' || doc_id AS slug, source || '/x' AS target, lang = 'en' AS twice FROM documents),
l AS (SELECT slug AS source_slug, target AS target_slug, 'Custom("cites")' AS link_type, twice FROM d UNION ALL SELECT slug, unnest(['plain/x', 'decoy']), 'Plain', twice FROM d)
SELECT source_slug, target_slug, link_type, 'first' AS mode FROM l
UNION ALL SELECT source_slug, target_slug, link_type, 'reject' FROM l WHERE NOT twice
UNION ALL SELECT slug || '.md', 'failed to update links for ' || slug || ': repeated link', 'links', 'reject' FROM d WHERE twice""",
        "notes_store": """WITH c AS (SELECT 'raw/' || conv_id || '/' || turn || '.md' AS path, turn, text FROM conversations)
SELECT path, sha256(CASE turn WHEN 0 THEN 'replaced' WHEN 2 THEN text || '+' ELSE text END) AS value FROM c WHERE turn <> 3
UNION ALL SELECT path || '.md', sha256('new') FROM c WHERE turn = 1
UNION ALL SELECT 'lost/' || path, 'note does not exist: lost/' || path FROM c WHERE turn = 2""",
        "notes_append": """WITH c AS (SELECT 'raw/' || conv_id || '/' || turn || '.md' AS path, turn, coalesce(text, '') AS text FROM conversations)
SELECT path, sha256(CASE WHEN turn < 2 THEN 'afirstsecond' WHEN turn = 3 THEN text WHEN turn <> 5 THEN text || 'firstsecond' END) AS value FROM c
UNION ALL SELECT path, 'no content to write: ' || path FROM c WHERE turn < 2
UNION ALL SELECT CASE turn WHEN 3 THEN 'lost/' ELSE '' END || path, 'no content to append: ' || CASE turn WHEN 3 THEN 'lost/' ELSE '' END || path FROM c
UNION ALL SELECT 'lost/' || path, 'note does not exist: lost/' || path FROM c WHERE turn = 3
UNION ALL SELECT path, 'note could not be read: ' || path FROM c WHERE turn = 5""",
        "reindex_errors": """WITH n AS (SELECT doc_id, CASE source WHEN 'src1' THEN 'wiki/a/b/c/d/e/f/g/h/i/j/k/' ELSE 'wiki/' END || doc_id || '.md' AS path,
  coalesce(source = 'src1', false) AS deep, coalesce(source = 'src3', false) AS unread, coalesce(lang = 'de', false) AS broken FROM documents),
a AS (SELECT *, path LIKE '%7.md' AS twice, path LIKE '%8.md' AS same FROM n)
SELECT path AS slug, 'walk' AS stage, 'more than 10 folders deep: ' || path AS message FROM a WHERE deep
UNION ALL SELECT path, 'walk', 'more than 10 folders deep: ' || path FROM a WHERE deep AND (twice OR same)
UNION ALL SELECT path, 'fetch', 'failed to fetch ' || path FROM a WHERE NOT deep AND (unread OR twice)
UNION ALL SELECT path, 'parse', 'failed to parse ' || path || ': failed to parse frontmatter for page ''wiki/' || doc_id || ''': missing opening frontmatter delimiter' FROM a WHERE NOT deep AND NOT unread AND broken
UNION ALL SELECT left(path, length(path) - 3), 'page', 'T' || doc_id FROM a WHERE NOT deep AND NOT unread AND NOT broken""",
        "edits_validation": """WITH c AS (SELECT *, turn % 7 AS k, CASE WHEN turn % 7 IN (0, 2, 4) THEN 'raw/' ELSE 'wiki/n' END || conv_id || '-' || turn AS slug FROM conversations)
SELECT slug, turn AS seq, CASE k WHEN 0 THEN 'applied' ELSE 'rejected' END AS status, CASE k
  WHEN 1 THEN 'frontmatter is required when creating a new page' WHEN 2 THEN 'frontmatter must not be provided for raw pages'
  WHEN 3 THEN 'title is required in frontmatter for new pages' WHEN 4 THEN 'timeline must not be provided for raw pages'
  WHEN 5 THEN 'invalid page_type: ''Foo''. Valid types: Entity, Concept, Source, Query, Synthesis, Comparison'
  WHEN 6 THEN 'title must not be empty for new pages' END AS message,
  CASE k WHEN 0 THEN sha256(text) END AS content_hash, CASE k WHEN 0 THEN false END AS indexed FROM c""",
        "graph_query": _neighbors(GRAPH, f"{FORWARD} UNION ALL {BACKWARD}", "customer/7", 2).replace(
            "SELECT slug, min(distance)::BIGINT AS distance",
            """SELECT source_slug, target_slug, link_type FROM lk WHERE source_slug = 'customer/7'
UNION ALL SELECT source_slug, target_slug, link_type FROM lk WHERE target_slug = 'customer/7'
UNION ALL SELECT 'customer/7', slug, min(distance)::VARCHAR""",
        ),
        "search_page": f"""WITH {BASE}, m AS (SELECT slug, title FROM kb
  WHERE contains(lower(slug || chr(10) || title || chr(10) || truth || chr(10) || timeline_text), 'tion'))
SELECT row_number() OVER (ORDER BY title, slug) AS position, slug, (SELECT count(*) FROM m) AS total FROM m
QUALIFY position <= 25""",
        "issue_counts": f"""WITH {BASE}, r AS ({LINT}
UNION ALL SELECT 'warning', 'orphans', slug FROM kb ANTI JOIN lk ON slug = target_slug
UNION ALL SELECT 'error', 'backlinks', target_slug FROM lk ANTI JOIN kb ON target_slug = slug)
SELECT scope, severity, count(*) AS issues_count FROM r GROUP BY ALL""",
        "listing_json": """SELECT '{"kind":"folder","n_children":' || count(DISTINCT conv_id) || '}' AS value FROM conversations HAVING count(*) > 0""",
        "search_edge_cases": f"""WITH {BASE}, g AS (SELECT count(*) AS n FROM kb
  WHERE contains(lower(slug || chr(10) || title || chr(10) || truth || chr(10) || timeline_text), 'tion'))
SELECT unnest(['blank', 'quotes', 'short', 'malformed', 'no tags']) AS query, 0::BIGINT AS n_hits
UNION ALL SELECT 'good', least(n, 100) FROM g""",
        "content_hash": f"WITH {BASE} SELECT slug || '.md' AS path, sha256(raw) AS content_hash FROM notes",
        "sync_classify": f"WITH {SNAPSHOTS} SELECT slug, status FROM status",
        "sync_pages": f"WITH {SNAPSHOTS} SELECT slug, title, content_hash, created::BIGINT AS created, updated::BIGINT AS updated FROM synced",
        "sync_links": f"WITH {SNAPSHOTS} {_LINKS_OF.format('synced')} ANTI JOIN gone ON lk.target_slug = gone.slug",
        "sync_counts": f"""WITH {SNAPSHOTS} SELECT (SELECT count(*) FROM todo) AS files_changed, (SELECT count(*) FROM todo) AS pages_indexed,
  (SELECT count(*) FROM gone) AS pages_removed, (SELECT count(*) FROM lk JOIN todo ON lk.source_slug = todo.slug) AS links_updated,
  (SELECT count(*) FROM newer WHERE source = 'src5' OR contains(slug, '!')) AS n_errors""",
        "sync_errors": f"""WITH {SNAPSHOTS} SELECT slug || '.md' AS path, 'fetch' AS stage, 'failed to fetch ' || slug || '.md' AS message
FROM newer WHERE source = 'src5'
UNION ALL SELECT slug || '.md', 'parse', 'failed to parse ' || slug || '.md: ' || {INVALID} FROM newer WHERE source <> 'src5' AND contains(slug, '!')""",
        "files_sync": """WITH d AS (SELECT doc_id, lang, 'wiki/' || coalesce(source, 'none') || CASE lang WHEN 'en' THEN '/_' ELSE '/n' END || doc_id AS slug FROM documents)
SELECT CASE lang WHEN 'fr' THEN 'wiki/_moved/' || doc_id ELSE slug END AS slug, 'T' || doc_id AS title,
  1735689600::BIGINT + CASE lang WHEN 'fr' THEN 60 ELSE 0 END AS created,
  1735689600::BIGINT + CASE WHEN lang = 'fr' OR (doc_id % 10 = 7 AND lang <> 'de') THEN 60 ELSE 0 END AS updated
FROM d WHERE lang IS NULL OR lang <> 'de'""",
        "sync_deep_paths": """WITH d AS (SELECT source, CASE source WHEN 'src3' THEN 'wiki/a/b/c/d/e/f/g/h/i/j/k/' ELSE 'wiki/' END || doc_id AS slug FROM documents)
SELECT slug, CASE source WHEN 'src3' THEN 'kept' WHEN 'src7' THEN 'removed' ELSE 'unchanged' END AS status FROM d
UNION ALL SELECT 'more than 10 folders deep: ' || slug || '.md', 'walk' FROM d WHERE source = 'src3'""",
        "sync_duplicates": """SELECT 'wiki/' || doc_id AS slug, 'wiki/' || doc_id || '.md' AS path, 'unchanged' AS status FROM documents
UNION ALL SELECT 'same slug as wiki/' || doc_id || '.md: wiki/' || doc_id, 'wiki/' || doc_id, 'duplicate' FROM documents WHERE lang = 'fr'""",
        "envelope_sync": f"""WITH d AS (SELECT doc_id, {slug('doc_id')} AS slug, doc_id % 20 = 3 AS partly FROM documents)
SELECT slug, CASE WHEN partly AND doc_id < 2000 THEN 'kept' ELSE 'unchanged' END AS status FROM d
UNION ALL SELECT slug || '-old', CASE WHEN partly THEN 'kept' ELSE 'removed' END FROM d""",
        "envelope_listings": """SELECT 'wiki/' || doc_id % 20 AS folder, count(*) FILTER (doc_id % 20 <> 3 OR doc_id >= 2000) AS received,
  count(*) AS total, doc_id % 20 <> 3 AS complete FROM documents GROUP BY ALL""",
        "reindex": f"""WITH {SNAPSHOTS} SELECT slug, title, page_type, sha256(raw) AS content_hash, 1735689600::BIGINT AS created
FROM newer WHERE source <> 'src5' AND NOT contains(slug, '!')""",
        "upsert_pages": f"""WITH {BASE} SELECT slug, CASE WHEN lang = 'fr' THEN upper(slug) ELSE title END AS title, created,
  CASE WHEN lang = 'fr' THEN 1735689600 ELSE updated END AS updated FROM kb""",
        "delete_cascade": f"""WITH {BASE}, gone AS (SELECT slug FROM kb WHERE page_type = 'Query')
SELECT slug, 'page' AS kind FROM kb WHERE page_type <> 'Query'
UNION ALL SELECT source_slug || ' ' || link_type || ' ' || target_slug, 'link' FROM lk
  ANTI JOIN gone ON source_slug = gone.slug ANTI JOIN gone g ON target_slug = g.slug""",
        "slug_cleanup": f"""WITH {BASE}, dirty AS (SELECT slug || {ending} AS slug FROM kb)
SELECT CASE WHEN lower(slug) LIKE '%.md' THEN left(slug, length(slug) - 3) ELSE slug END AS slug, 'page' AS kind FROM dirty
UNION ALL SELECT source_slug || ' ' || link_type || ' ' || target_slug, 'link' FROM lk""",
        "edits_apply": f"WITH {BASE}, {_FOLDED}",
        "edits_results": f"""WITH {BASE}, {_TALK}, {_folded('page', 'true')}, {_folded('early', 'seq < 2')}
SELECT res.slug, seq, status, CASE WHEN status = 'conflict' THEN 'etag mismatch: expected ' || etag || ', got ' || early.content_hash
  WHEN status = 'rejected' THEN {INVALID.replace("slug ||", "res.slug ||")} END AS message,
  page.content_hash, CASE WHEN status = 'applied' THEN true END AS indexed, CASE WHEN status = 'applied' THEN 0 END AS links_count,
  CASE WHEN status = 'applied' THEN len(page.timeline) END AS timeline_count
FROM res LEFT JOIN early USING (slug) LEFT JOIN page ON res.slug = page.slug AND status = 'applied'""",
        "envelope_decode": f"SELECT {slug('doc_id')} || '.md' AS path, text AS raw_content FROM documents",
        "envelope_errors": """SELECT 'not_found' AS stage, 'Note does not exist' AS message, count(*) AS n_responses FROM documents WHERE source = 'src9'
HAVING count(*) > 0 UNION ALL SELECT 'service', 'denied ' || lang, count(*) FROM documents WHERE source = 'src8' GROUP BY lang""",
        "nearest_vectors": """WITH g AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], v::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) /
  sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[])) AS similarity FROM embeddings, g WHERE vec_id <> 0)
SELECT vec_id, round(similarity, 6) AS similarity FROM (SELECT * FROM s ORDER BY similarity DESC, vec_id LIMIT 20)""",
    }
    many = """WITH RECURSIVE {base}, e AS ({edges}),
b AS (SELECT 'customer/' || c_custkey AS start, 'customer/' || c_custkey AS slug, 0 AS distance FROM customer UNION
      SELECT b.start, e.dst, b.distance + 1 FROM b JOIN e ON e.src = b.slug WHERE b.distance < {depth}),
r AS (SELECT start, slug, min(distance)::BIGINT AS distance FROM b GROUP BY start, slug HAVING min(distance) > 0)"""
    out["neighbors_many"] = many.format(base=GRAPH, edges=FORWARD, depth=3) + " SELECT start, slug, distance FROM r"
    out["neighbors_reach"] = (
        many.format(base=GRAPH, edges=f"{FORWARD} UNION ALL {BACKWARD}", depth=2)
        + " SELECT start, distance, count(*) AS n_pages FROM r GROUP BY start, distance"
    )
    out["search_index_batch"] = out["search_batch"]
    changed = f"""WITH {SNAPSHOTS},
body AS (SELECT n.slug, n.title, n.truth, n.timeline_text FROM notes n JOIN todo USING (slug)
  UNION ALL SELECT n.slug, n.title, CASE WHEN n.source IN ('src3', 'src4') THEN 'Draft. ' || n.truth ELSE n.truth END, n.timeline_text
  FROM older o JOIN valid n USING (slug) JOIN status s ON o.slug = s.slug WHERE s.status IN ('unchanged', 'failed')),
last AS MATERIALIZED (SELECT slug, CASE WHEN slug LIKE '%3' THEN 'Revised ' || title ELSE title END AS title, truth, timeline_text
  FROM body WHERE slug NOT LIKE '%7')"""
    out["search_index_sync"] = f"""{changed},
c AS (SELECT slug, unnest([lower(slug), lower(title), lower(truth), lower(timeline_text)]) AS s FROM last),
ch AS (SELECT slug, string_split(s, '') AS x FROM c WHERE length(s) >= 3),
g AS (SELECT slug, unnest(list_transform(range(1, len(x) - 1), lambda i: x[i] || x[i + 1] || x[i + 2])) AS trigram FROM ch)
SELECT trigram, count(DISTINCT slug) AS n_pages, count(DISTINCT slug) AS n_listed, count(*) AS n_occurrences FROM g GROUP BY trigram"""
    out["search_index_merged"] = out["search_index_sync"]
    out["search_index_stats"] = f"""{changed}
SELECT count(*) AS n_pages, CAST(sum(greatest(length(slug)-2,0)+greatest(length(title)-2,0)+greatest(length(truth)-2,0)+
  greatest(length(timeline_text)-2,0)) AS BIGINT) AS n_tokens FROM last"""
    out["stream_sync_pages"] = f"""WITH {SNAPSHOTS} SELECT slug, title, sha256(raw) AS content_hash FROM newer
WHERE source <> 'src5' AND NOT contains(slug, '!')
UNION ALL SELECT slug, title, sha256(raw) FROM older WHERE source IN ('src5', 'src7')"""
    out["stream_sync_one_batch"] = out["stream_sync_compacted"] = out["stream_sync_pages"]
    out["stream_sync_errors"] = f"""WITH {SNAPSHOTS},
bad AS (SELECT slug FROM notes WHERE lang <> 'de' AND contains(slug, '!')
  UNION ALL SELECT slug FROM newer WHERE source <> 'src5' AND contains(slug, '!'))
SELECT slug || '.md' AS path, 'parse' AS stage, 'failed to parse ' || slug || '.md: ' || {INVALID} AS message FROM bad
UNION ALL SELECT slug || '.md', 'fetch', 'failed to fetch ' || slug || '.md' FROM newer WHERE source = 'src5'"""
    out["stream_edits_pages"] = out["edits_apply"]
    return out
