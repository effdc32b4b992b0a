"""DuckDB SQL of the registered queries that SQL can state."""

from __future__ import annotations

from shopstar.llm.urlfilter import ATTRIBUTE, NAMED, NUMBERED, QUOTED, REFRESH, SKIPPED, TAG

SQL: dict[str, str] = {}

# ---- op6: the same patterns as the operator, RE2 and Java read them alike ----
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&nbsp;", " "), ("&copy;", "©"),
             ("&reg;", "®"), ("&middot;", "·"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&euro;", "€"),
             ("&laquo;", "«"), ("&raquo;", "»"), ("&amp;", "&")]


def _plain(html: str) -> str:
    t = (f"regexp_replace({html}, '(?is)<!--.*?-->|<script\\b[^>]*>.*?</script[ \\t\\r\\n]*>|<style\\b[^>]*>.*?</style[ \\t\\r\\n]*>"
         "|<head\\b[^>]*>.*?</head[ \\t\\r\\n]*>', ' ', 'g')")
    t = (f"regexp_replace({t}, '(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|nav|footer|header|blockquote|pre)\\b[^>]*>', "
         "chr(10), 'g')")
    t = f"regexp_replace({t}, '<[A-Za-z/!?][^>]*>', '', 'g')"
    n = "coalesce(TRY_CAST(CASE WHEN ref[1] IN ('x', 'X') THEN '0x' || substr(ref, 2) ELSE ref END AS BIGINT), 0)"
    char = f"CASE WHEN {n} = 38 THEN '&amp;' WHEN {n} BETWEEN 1 AND 55295 OR {n} BETWEEN 57344 AND 1114111 THEN chr(CAST({n} AS INTEGER)) ELSE '&#' || ref || ';' END"
    refs = f"list_distinct(regexp_extract_all(tagless, '{NUMBERED}', 1))"
    t = f"(SELECT list_reduce(list_prepend(tagless, {refs}), lambda held, ref: replace(held, '&#' || ref || ';', {char})) FROM (SELECT {t} AS tagless))"
    for name, char in _ENTITIES:
        t = f"replace({t}, '{name}', '{char}')"
    t = f"regexp_replace({t}, '[ \\t\\r\u00a0]+', ' ', 'g')"
    return f"trim(regexp_replace({t}, ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"


def _name(*parts: str) -> str:
    h = "sha256(" + " || chr(10) || ".join(parts) + ")"
    cuts = " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || {cuts} || '>'"


SQL["op6_warc_derivatives"] = f"""
WITH source AS (
    SELECT page_id, url AS target_uri, coalesce(html, '') AS payload,
           {_name("'response'", "coalesce(CAST(page_id AS VARCHAR), '')", "coalesce(url, '')")} AS refers_to
    FROM pages),
told AS (
    SELECT *, 'sha256:' || sha256(payload) AS source_digest,
           'source-http-status: 200' || chr(13) || chr(10)
           || 'source-content-type: text/html; charset=UTF-8' || chr(13) || chr(10)
           || 'source-content-length: ' || strlen(payload) || chr(13) || chr(10)
           || 'source-payload-digest: sha256:' || sha256(payload) || chr(13) || chr(10)
           || 'language: ' || regexp_extract(payload, '(?is)<html\\b[^>]*\\blang=["'']?([A-Za-z-]+)', 1) || chr(13) || chr(10)
           || 'title: ' || trim(regexp_replace(regexp_extract(payload, '(?is)<title\\b[^>]*>([^<]*)', 1), '[ \\t\\r\\n]+', ' ', 'g'))
           || chr(13) || chr(10)
           || 'outlinks: ' || len(regexp_extract_all(payload, '(?i)<a\\b[^>]*\\bhref=')) || chr(13) || chr(10) AS fields
    FROM source),
both_kinds AS (
    SELECT page_id, target_uri, refers_to, source_digest, 'metadata' AS record_type,
           'application/warc-fields' AS content_type, fields AS content FROM told
    UNION ALL
    SELECT page_id, target_uri, refers_to, source_digest, 'conversion', 'text/plain', {_plain("payload")} FROM told)
SELECT page_id, record_type, {_name("record_type", "refers_to")} AS record_id, refers_to, target_uri,
       '2024-01-01T00:00:00Z' AS "date", content_type, CAST(strlen(content) AS BIGINT) AS content_length,
       'sha256:' || sha256(content) AS block_digest, 'sha256:' || sha256(content) AS payload_digest, source_digest, content
FROM both_kinds
"""

# ---- op8: every source's documents in hash order, cut where the words come nearest to the rest of the budget ----
SQL["op8_mixing"] = """
WITH RECURSIVE sized AS (
    SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
           CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
           CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
    FROM documents),
sources AS (
    SELECT k, CAST(sum(size) AS BIGINT) AS source_size,
           CASE (row_number() OVER (ORDER BY encode(k)) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
    FROM sized GROUP BY k),
total AS (SELECT CAST(sum(source_size) AS DOUBLE) * 1.5 AS budget FROM sources),
fill AS (  -- the price of a unit of weight, raised until no target is above its limit
    SELECT 0 AS round, (SELECT budget FROM total) / (SELECT sum(w) FROM sources) AS price
    UNION ALL
    SELECT round + 1, nxt.price FROM fill, LATERAL (
        SELECT ((SELECT budget FROM total) - coalesce(sum(CASE WHEN w * fill.price > 2.0 * source_size THEN 2.0 * source_size END), 0))
               / sum(CASE WHEN w * fill.price <= 2.0 * source_size THEN w END) AS price FROM sources) nxt
    WHERE nxt.price > fill.price),
goal AS (
    SELECT k, source_size, least(w * (SELECT max(price) FROM fill), CAST(2 * source_size AS DOUBLE)) AS target FROM sources),
pass AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM goal),
by_hash AS (
    SELECT k, h, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY k, h HAVING sum(size) > 0),
run AS (
    SELECT b.*, p.target - p.passes * p.source_size AS rest,
           sum(words) OVER (PARTITION BY b.k ORDER BY h ROWS UNBOUNDED PRECEDING) AS upto
    FROM by_hash b JOIN pass p ON p.k = b.k),
edge AS (  -- the first hash that passes the rest
    SELECT k, min(h) AS h FROM run WHERE upto > rest GROUP BY k),
bound AS (
    SELECT r.k, r.h + CASE WHEN r.upto - r.rest < r.rest - (r.upto - r.words) THEN 1 ELSE 0 END AS threshold
    FROM run r JOIN edge e ON e.k = r.k AND e.h = r.h)
SELECT s.doc_id, s.size, p.source_size, p.target,
       CAST(s.size * (p.passes + CASE WHEN s.h < b.threshold THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN pass p ON p.k = s.k LEFT JOIN bound b ON b.k = s.k
"""

# ---- op9: all scores of the stated queries ----
SQL["op9_top_k"] = """
WITH rows AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings),
kept AS (
    SELECT r, vec_id, list_transform(x, lambda c: CAST(floor(256 * c) AS BIGINT)) AS v FROM rows
    WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
q AS (SELECT * FROM kept WHERE vec_id % 50 = 0),
scores AS (
    SELECT q.r AS qr, q.vec_id AS query_id, c.vec_id, c.r AS cr,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM q JOIN kept c ON c.r <> q.r AND len(c.v) = len(q.v)),
ranked AS (
    SELECT query_id, vec_id, score,
           CAST(row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id NULLS LAST, cr) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

# ---- op10: longest rule, then blocks that reach aliases over canonical links and redirects ----
_UP, _LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def _host(url: str) -> str:
    return f"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), ''), {_UP}, {_LOW})"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _node(url: str) -> str:
    rest = f"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
    return (f"CASE WHEN {_host(url)} <> '' THEN translate(regexp_extract({url}, '(?s)^(.*?)://', 1), {_UP}, {_LOW}) || '://' || {_host(url)}"
            f" || CASE WHEN {rest} = '' THEN '/' ELSE {rest} END END")


_RULES = "(VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))"


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _attribute(rest: str, name: str) -> str:
    """The first attribute of that name, before its references are decoded; null if there is none."""
    names = f"list_transform(regexp_extract_all({rest}, {_text(ATTRIBUTE)}, 1), lambda n: translate(n, {_UP}, {_LOW}))"
    parts = " || ".join(f"coalesce(regexp_extract_all({rest}, {_text(ATTRIBUTE)}, {g})[list_position({names}, '{name}')], '')" for g in (2, 3, 4))
    return f"CASE WHEN list_contains({names}, '{name}') THEN {parts} END"


def _resolved(name: str, source: str) -> str:
    """CTEs that make ``source`` (k, link, src) into ``name`` (k, url): null for other schemes and bare fragments."""
    own = f"CASE WHEN {_path('src')} = '' THEN '/' ELSE {_path('src')} END"
    return f"""
{name}_parts AS (
    SELECT k, link, src, regexp_extract(link, '(?s)^([^?#]*)', 1) AS p, regexp_extract(link, '(?s)^[^?#]*(.*)$', 1) AS rest, {own} AS own FROM {source}),
{name}_segments AS (
    SELECT *, string_split(CASE WHEN starts_with(link, '/') THEN p ELSE regexp_extract(own, '(?s)^(.*/)', 1) || p END, '/') AS segs FROM {name}_parts),
{name}_walk AS (
    SELECT k, segs, 2 AS i, CAST([] AS VARCHAR[]) AS done FROM {name}_segments
    UNION ALL
    SELECT k, segs, i + 1, CASE segs[i] WHEN '..' THEN done[1:len(done) - 1] WHEN '.' THEN done ELSE list_append(done, segs[i]) END
    FROM {name}_walk WHERE i <= len(segs)),
{name}_clean AS (
    SELECT k, '/' || array_to_string(done, '/') || CASE WHEN segs[-1] IN ('.', '..') AND len(done) > 0 THEN '/' ELSE '' END AS clean
    FROM {name}_walk WHERE i = len(segs) + 1),
{name} AS (
    SELECT s.k, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
                     WHEN starts_with(link, '//') THEN regexp_extract(src, '(?s)^(.*?)://', 1) || ':' || link
                     WHEN regexp_matches(link, '^([A-Za-z][A-Za-z0-9+.-]*:|#)') THEN NULL
                     ELSE regexp_extract(src, '(?s)^(.*?)://', 1) || '://' || {_host('src')}
                          || CASE WHEN p = '' AND NOT starts_with(link, '/') THEN own ELSE clean END || rest END AS url
    FROM {name}_segments s JOIN {name}_clean c ON c.k = s.k)"""


def _named(value: str) -> str:
    for name, char in NAMED:
        value = f"replace({value}, '{name}', {_text(char)})"
    return value


SQL["op10_url_filter"] = f"""
WITH RECURSIVE rules AS (SELECT * FROM {_RULES} t(rhost, rpath, decision)),
cleaned AS (
    SELECT row_number() OVER () AS page, url, regexp_replace(html, {_text(SKIPPED)}, ' ', 'g') AS html FROM pages
    WHERE regexp_matches(html, '(?i)canonical|http-equiv')),
tags AS (
    SELECT page, url, unnest(regexp_extract_all(html, {_text(TAG)}, 1)) AS kind, unnest(regexp_extract_all(html, {_text(TAG)}, 2)) AS rest,
           generate_subscripts(regexp_extract_all(html, {_text(TAG)}, 1), 1) AS pos FROM cleaned),
attributes AS (
    SELECT page, url, pos, translate(kind, {_UP}, {_LOW}) AS kind, name, value FROM tags, LATERAL (
        SELECT unnest(['href', 'rel', 'http-equiv', 'content']) AS name,
               unnest([{", ".join(_attribute("rest", n) for n in ("href", "rel", "http-equiv", "content"))}]) AS value) v
    WHERE value IS NOT NULL),
numbered AS (  -- one numeric reference after the other
    SELECT page, url, pos, kind, name, value, list_distinct(regexp_extract_all(value, {_text(NUMBERED)}, 1)) AS refs, 1 AS i FROM attributes
    UNION ALL
    SELECT page, url, pos, kind, name, CASE WHEN n BETWEEN 1 AND 55295 OR n BETWEEN 57344 AND 1114111 THEN replace(value, '&#' || refs[i] || ';', chr(n)) ELSE value END, refs, i + 1
    FROM (SELECT *, CAST(CASE WHEN lower(refs[i][1]) = 'x' THEN CAST('0x' || refs[i][2:] AS BIGINT) ELSE CAST(refs[i] AS BIGINT) END AS INTEGER) AS n
          FROM numbered WHERE i <= len(refs))),
decoded AS (SELECT page, url, pos, kind, name, {_named("value")} AS value FROM numbered WHERE i = len(refs) + 1),
wide AS (
    SELECT page, url, pos, kind, max(value) FILTER (WHERE name = 'href') AS href, max(value) FILTER (WHERE name = 'rel') AS rel,
           max(value) FILTER (WHERE name = 'http-equiv') AS equiv, max(value) FILTER (WHERE name = 'content') AS content FROM decoded GROUP BY ALL),
base_links AS (
    SELECT page AS k, trim(href) AS link, url AS src FROM wide WHERE kind = 'base' AND href IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY page ORDER BY pos) = 1),
{_resolved("bases", "base_links")},
raw_links AS (
    SELECT page, url, trim(href) AS link FROM wide
    WHERE kind = 'link' AND list_contains(regexp_split_to_array(translate(trim(rel), {_UP}, {_LOW}), '\\s+'), 'canonical')
    UNION ALL
    SELECT page, url, trim(regexp_extract(r, {_text(QUOTED)}, 1) || regexp_extract(r, {_text(QUOTED)}, 2) || regexp_extract(r, {_text(QUOTED)}, 3))
    FROM (SELECT page, url, trim(regexp_extract(content, {_text(REFRESH)}, 1)) AS r FROM wide
          WHERE kind = 'meta' AND translate(trim(equiv), {_UP}, {_LOW}) = 'refresh')),
links AS (
    SELECT row_number() OVER () AS k, l.url, link, coalesce(b.url, l.url) AS src FROM raw_links l LEFT JOIN bases b ON b.k = l.page WHERE link <> ''),
{_resolved("targets", "links")},
resolved AS (SELECT l.url, t.url AS link FROM links l JOIN targets t ON t.k = l.k),
edges AS (
    SELECT {_node("url")} AS a, {_node("link")} AS b FROM resolved),
both_ways AS (
    SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach AS (
    SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
places AS (
    SELECT DISTINCT {_host("u")} AS host, {_path("u")} AS path FROM (SELECT url AS u FROM pages UNION SELECT a FROM both_ways)),
best AS (
    SELECT p.host, p.path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(decision, length(rhost || rpath)) AS decision
    FROM places p JOIN rules r ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath) GROUP BY 1, 2),
blocked AS (
    SELECT DISTINCT reach.a AS node FROM reach JOIN best ON best.host = {_host("reach.b")} AND best.path = {_path("reach.b")}
    WHERE best.decision = 'block')
SELECT p.page_id, {_host("p.url")} AS host, {_path("p.url")} AS path, best.rule,
       coalesce(best.decision, CASE WHEN blocked.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM pages p LEFT JOIN best ON best.host = {_host("p.url")} AND best.path = {_path("p.url")}
LEFT JOIN blocked ON blocked.node = {_node("p.url")}
"""

# ---- op11: trees by source, then the tree over them; a proof has the other nodes of each run on the way up ----
_FIELD = "CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c=c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_LOWERED = f"translate(text, {_UP}, {_LOW})"


def _grown(name: str, start: str) -> str:
    """All nodes above ``start`` (tree, h, idx, n, digest)."""
    return f"""{name} AS (
    SELECT tree, h, idx, n, digest FROM {start}
    UNION ALL
    SELECT tree, h + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx))
    FROM {name} WHERE n > 1 GROUP BY tree, h, n, idx // 16)"""


SQL["op11_merkle_manifest"] = f"""
WITH RECURSIVE hashed AS (
    SELECT doc_id, row_number() OVER () AS r, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree,
           {_LEAF.format(text="text")} AS leaf, {_LEAF.format(text=_LOWERED)} AS lowered FROM documents),
crc AS (  -- bit by bit over the decimal id
    SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
    UNION ALL
    SELECT doc_id, s, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
    FROM (SELECT doc_id, s, k, CASE WHEN k % 8 = 0 THEN xor(c, CAST(ascii(s[k // 8 + 1]) AS BIGINT)) ELSE c END AS c FROM crc WHERE k < 8 * length(s))),
fold5 AS (SELECT doc_id, xor(c, 4294967295) % 5 = 0 AS tampered FROM crc WHERE k = 8 * length(s)),
ranked AS (
    SELECT h.r, h.doc_id, h.tree, leaf, CASE WHEN tampered THEN lowered ELSE leaf END AS claim,
           row_number() OVER (PARTITION BY tree ORDER BY h.doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n
    FROM hashed h LEFT JOIN fold5 f ON f.doc_id = h.doc_id),
first_nodes AS (SELECT tree, 0 AS h, idx, n, leaf AS digest FROM ranked),
{_grown("nodes", "first_nodes")},
tops AS (SELECT tree, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
source_nodes AS (SELECT '*' AS tree, 0 AS h, idx, n, digest FROM tops),
{_grown("over_sources", "source_nodes")},
root AS (SELECT digest AS root FROM over_sources WHERE n = 1),
highest AS (SELECT tree, max(h) AS top FROM nodes GROUP BY tree),
all_nodes AS (SELECT tree, h, idx, n, digest FROM nodes UNION ALL SELECT tree, h, idx, n, digest FROM over_sources),
sides AS (  -- for each node that is not a top: what stands left and right of it in its run
    SELECT tree, h, idx,
           coalesce(string_agg(digest, '' ORDER BY idx) OVER (PARTITION BY tree, h, idx // 16 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
           coalesce(string_agg(digest, '' ORDER BY idx) OVER (PARTITION BY tree, h, idx // 16 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
    FROM all_nodes WHERE n > 1),
climb AS (
    SELECT r, tree, 0 AS h, idx, claim AS node, '' AS proof, 0 AS over FROM ranked
    UNION ALL
    SELECT c.r, CASE WHEN s.tree IS NULL THEN '*' ELSE c.tree END, CASE WHEN s.tree IS NULL THEN 0 ELSE c.h + 1 END,
           CASE WHEN s.tree IS NULL THEN t.idx ELSE c.idx // 16 END,
           CASE WHEN s.tree IS NULL THEN c.node ELSE sha256(s.before || c.node || s.after) END,
           CASE WHEN s.tree IS NULL THEN c.proof ELSE c.proof || s.before || s.after END,
           CASE WHEN s.tree IS NULL THEN c.over + 1 ELSE c.over END
    FROM climb c LEFT JOIN sides s ON s.tree = c.tree AND s.h = c.h AND s.idx = c.idx
    LEFT JOIN tops t ON t.tree = c.tree
    WHERE c.over < 2),
done AS (SELECT r, node, proof FROM climb WHERE over = 2)
SELECT k.doc_id, k.leaf, t.digest AS subroot, root.root, sha256(d.proof) AS proof_sha256, d.node AS folded_root, d.node = root.root AS verified
FROM ranked k JOIN done d ON d.r = k.r JOIN tops t ON t.tree = k.tree, root
"""

# ---- op13: every phrase of 1 to 3 words counted by itself ----
SQL["op13_phrases"] = f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {_UP}, {_LOW}), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM pieces),
grams AS (
    SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
    FROM split, (VALUES (1), (2), (3)) sizes(m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= 10),
cuts AS (
    SELECT c.lang, c.phrase, c.m, c.a, k, h.f AS l, t.f AS r,
           CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
    FROM candidates c, (VALUES (1), (2)) ks(k)
    JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:k], ' ')
    JOIN f t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[k + 1:c.m], ' ') WHERE k < c.m),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (
    SELECT lang, phrase, max(a) AS outer_a FROM (
        SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM candidates WHERE m = 3) GROUP BY ALL),
kept AS (
    SELECT s.* FROM scored s LEFT JOIN held h ON h.lang = s.lang AND h.phrase = s.phrase
    WHERE h.outer_a IS NULL OR 100 * h.outer_a < 50 * s.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept k JOIN total t ON t.lang = k.lang QUALIFY rank <= 2000
"""
