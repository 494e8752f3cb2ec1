"""DuckDB SQL for those operators of this subpackage that SQL can express."""

#: The rules and the rank's damping and rounds are written out; each round is a query of its own.
def op1(damping: float = 0.85, rounds: int = 12) -> str:
    steps, last = [], "seeds"
    for i in range(1, rounds + 1):
        steps.append(
            f"rank{i} AS (SELECT kind, host, sum(score) AS score FROM (SELECT e.kind, e.dst AS host, s.score * e.share * {damping} AS score FROM shares e JOIN {last} s ON e.kind = s.kind AND e.src = s.host"
            f" UNION ALL SELECT kind, host, score * (1 - {damping}) FROM seeds) GROUP BY kind, host)"
        )
        last = f"rank{i}"
    return rf"""
WITH rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), cutup AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, CAST(instr(url, '://') + 3 AS BIGINT)) ELSE '' END AS rest FROM pages
), parted AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cutup
), fitting AS (
  SELECT p.page_id, p.host, arg_max(r.rule_host || r.rule_path, length(r.rule_host || r.rule_path)) AS rule, arg_max(r.verdict, length(r.rule_host || r.rule_path)) AS verdict
  FROM parted p JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path) GROUP BY p.page_id, p.host
), hosts AS (
  SELECT host, count(*) AS pages FROM parted WHERE host <> '' GROUP BY host
), given AS (
  SELECT CASE verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, f.host, count(*) / any_value(h.pages) AS weight FROM fitting f JOIN hosts h USING (host) GROUP BY ALL
), seeds AS (
  SELECT kind, host, weight / sum(weight) OVER (PARTITION BY kind) AS score FROM given
), linked AS (
  SELECT DISTINCT page_id, host AS src, lower(unnest(regexp_extract_all(html, '(?i)(?:href|src)\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/"''?#\s>]+)', 1))) AS dst FROM parted WHERE host <> ''
), suffixes AS (
  SELECT DISTINCT array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS src FROM hosts, LATERAL (SELECT unnest(range(1, len(string_split(host, '.')) + 1)) AS i) x
), tree AS (
  SELECT src, substr(src, CAST(instr(src, '.') + 1 AS BIGINT)) AS dst FROM suffixes WHERE contains(src, '.')
), edges AS (
  SELECT src, dst, sum(weight) AS weight FROM (
    SELECT src, dst, 1.0::DOUBLE AS weight FROM linked WHERE src <> dst
    UNION ALL SELECT src, dst, 1.0 FROM tree WHERE contains(dst, '.') UNION ALL SELECT dst, src, 1.0 FROM tree WHERE contains(dst, '.')
  ) GROUP BY src, dst
), shares AS MATERIALIZED (
  SELECT 'trust' AS kind, src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM edges
  UNION ALL SELECT 'distrust', dst, src, weight / sum(weight) OVER (PARTITION BY dst) FROM edges
), {", ".join(steps)}, scores AS (
  SELECT host, coalesce(sum(score) FILTER (WHERE kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (WHERE kind = 'distrust'), 0) AS distrust FROM {last} GROUP BY host
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, CASE WHEN coalesce(s.distrust, 0) > coalesce(s.trust, 0) * (1 + 1e-9) THEN 'block' ELSE 'allow' END) AS verdict,
  round(coalesce(s.trust, 0.0)::DOUBLE, 9) AS trust, round(coalesce(s.distrust, 0.0)::DOUBLE, 9) AS distrust
FROM parted p LEFT JOIN fitting f ON p.page_id = f.page_id LEFT JOIN scores s ON p.host = s.host
"""


#: Each margin's fit in each round is a query, and so is each step of the scale.
def op3(rounds: int = 12, budget: float = 0.5, steps: int = 16, seed: int = 20) -> str:
    powers = {"source": 0.5, "lang": 0.6, "topic": 0.8}
    wanted = ", ".join(f"want_{m} AS (SELECT {m}, pow(n, {p}) / sum(pow(n, {p})) OVER () AS want FROM (SELECT {m}, CAST(sum(tokens) AS DOUBLE) AS n FROM cells GROUP BY {m}))" for m, p in powers.items())
    fits, last = [], "w0"
    for i in range(rounds):
        for m in powers:
            now = f"w{len(fits) + 1}"
            fits.append(f"{now} AS MATERIALIZED (SELECT source, lang, topic, tokens, weight * want / sum(weight) OVER (PARTITION BY {m}) AS weight FROM {last} JOIN want_{m} USING ({m}))")
            last = now
    scales = [f"s0 AS (SELECT {budget}::DOUBLE AS scale)"]
    for i in range(1, steps + 1):
        scales.append(
            f"s{i} AS MATERIALIZED (SELECT greatest(any_value(scale), coalesce(({budget} * sum(tokens) - coalesce(sum(tokens) FILTER (WHERE rate * scale >= 1), 0))"
            f" / nullif(sum(tokens * rate) FILTER (WHERE rate * scale < 1), 0), 0)) AS scale FROM rates, s{i - 1})"
        )
    return f"""
WITH rows AS (
  SELECT doc_id, source, lang, CAST(len(regexp_extract_all(text, '[^ \t\n\r]+')) AS INT) AS n_tokens,
    CASE WHEN (length(text) - length(translate(text, '0123456789#$%&*|@!<>=_/', ''))) * 8 > length(text) THEN 'noisy'
      WHEN length(text) < (length(text) - length(replace(text, chr(10), '')) + 1) * 80 THEN 'listing' ELSE 'prose' END AS topic FROM documents
), cells AS MATERIALIZED (
  SELECT source, lang, topic, sum(n_tokens) AS tokens FROM rows GROUP BY source, lang, topic
), {wanted}, w0 AS (SELECT *, tokens / sum(tokens) OVER () AS weight FROM cells),
{", ".join(fits)}, rates AS MATERIALIZED (
  SELECT *, CASE WHEN tokens > 0 THEN weight * sum(tokens) OVER () / tokens ELSE 0 END AS rate FROM {last}
), {", ".join(scales)}, drawn AS (
  SELECT source, lang, topic, round(least(1.0, rate * scale), 9) AS probability FROM rates, s{steps}
)
SELECT doc_id, source, lang, topic, n_tokens, probability,
  CAST('0x' || substr(md5(doc_id || ':{seed}'), 1, 8) AS BIGINT) / 4294967296.0 < probability AS sampled
FROM rows JOIN drawn USING (source, lang, topic)
"""


#: All pairs of a label by brute force.
OP2 = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach(node, other) AS (
  SELECT a, b FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
), named AS (
  SELECT node, least(node, min(other)) AS component_id FROM reach GROUP BY node
), counted AS (
  SELECT a, count(*) AS n_links FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(c.n_links, 0) AS n_links, coalesce(n.component_id, e.vec_id) AS component_id, coalesce(n.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counted c ON e.vec_id = c.a LEFT JOIN named n ON e.vec_id = n.node
"""

OP7 = """
WITH vectors AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER best AS INT) AS rank, vec_id, score FROM scores
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER best <= 10
"""

#: Equal lines keep their first copy; a line one edit from an earlier one goes.  Two lines one edit
#: apart share their first or their last half; the place where they first differ decides.
OP8 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents
), firsts AS (
  SELECT line, doc_id, line_no, length(line) AS n FROM lines WHERE length(line) >= 20
  QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, line_no) = 1
), halves AS (
  SELECT *, left(line, CAST(n // 2 AS INT)) AS head, right(line, CAST(n - n // 2 AS INT)) AS tail FROM firsts
), longer AS (
  SELECT f.line, f.doc_id, f.line_no, f.n, m, left(f.line, CAST(m // 2 AS INT)) AS head, right(f.line, CAST(m - m // 2 AS INT)) AS tail
  FROM firsts f, (VALUES (0), (1)) v(d), LATERAL (SELECT f.n - d AS m) x
), pairs AS (
  SELECT a.line AS a, b.line AS b, a.n AS na, b.n AS nb, a.doc_id AS da, a.line_no AS la, b.doc_id AS db, b.line_no AS lb FROM halves a JOIN longer b ON a.n = b.m AND a.head = b.head AND a.line <> b.line
  UNION
  SELECT a.line, b.line, a.n, b.n, a.doc_id, a.line_no, b.doc_id, b.line_no FROM halves a JOIN longer b ON a.n = b.m AND a.tail = b.tail AND a.line <> b.line
), differ AS (
  SELECT *, coalesce(list_filter(range(1, na + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))[1], na + 1) AS spot FROM pairs
), near AS (
  SELECT DISTINCT CASE WHEN (da, la) < (db, lb) THEN b ELSE a END AS line FROM differ
  WHERE (na = nb AND substr(a, spot + 1) = substr(b, spot + 1)) OR (nb = na + 1 AND substr(a, spot) = substr(b, spot + 1))
), marked AS (
  SELECT l.doc_id, l.line_no, l.line,
    length(l.line) < 20 OR (f.doc_id = l.doc_id AND f.line_no = l.line_no AND l.line NOT IN (SELECT line FROM near)) AS stays
  FROM lines l LEFT JOIN firsts f ON l.line = f.line
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE stays), '') AS text,
  CAST(count(*) AS INT) AS n_lines, CAST(count(*) FILTER (WHERE NOT stays) AS INT) AS n_dropped
FROM marked GROUP BY doc_id
"""


from quire.llm.license_tfidf import CUE, TEMPLATES  # noqa: E402


def _templates() -> str:
    return ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))


OP10 = rf"""
WITH templates(t, license, line) AS (VALUES {_templates()}),
files AS (
  SELECT doc_id, text, concat_ws('/', source, doc_id // 1000, doc_id // 50, CASE WHEN doc_id % 50 = 0 THEN 'LICENSE' ELSE 'doc' || doc_id || '.txt' END) AS path FROM documents
), parts AS (
  SELECT doc_id, path, doc_id % 50 = 0 AS named, text,
    list_filter(string_split_regex(regexp_replace(text, '[^A-Za-z0-9\n]*\n[^A-Za-z0-9\n]*', chr(10), 'g'), '\n\n+'), lambda u: doc_id % 50 = 0 OR regexp_matches(u, '{CUE}')) AS told FROM files
), lines AS (
  SELECT DISTINCT doc_id, path, line FROM (
    SELECT doc_id, path, text AS line FROM parts WHERE named
    UNION ALL SELECT doc_id, path, unnest(told) FROM parts
    UNION ALL SELECT doc_id, path, line FROM (SELECT doc_id, path, unnest(string_split(array_to_string(told, chr(10)), chr(10))) AS line FROM parts) WHERE regexp_matches(line, '{CUE}')
  ) WHERE line IS NOT NULL
), words AS (
  SELECT 'l' || line AS k, list_filter(regexp_split_to_array(lower(line), '[^a-z0-9]+'), lambda w: w <> '') AS ws, count(*) AS n FROM lines GROUP BY line
  UNION ALL SELECT 't' || t, list_filter(regexp_split_to_array(lower(line), '[^a-z0-9]+'), lambda w: w <> ''), 1 FROM templates
), idf AS (
  SELECT term, ln((SELECT sum(n) + 1 FROM words)::DOUBLE / (sum(n) + 1)) + 1 AS idf FROM (SELECT n, unnest(list_distinct(ws)) AS term FROM words) GROUP BY term
), vectors AS (
  SELECT k, term, (1 + ln(count(*))) * any_value(idf) AS w FROM (SELECT k, unnest(ws) AS term FROM words) JOIN idf USING (term) GROUP BY k, term
), unit AS (
  SELECT k, term, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM vectors
), scored AS (
  SELECT substr(a.k, 2) AS line, t.license, round(sum(a.w * b.w), 9) AS score FROM unit a JOIN unit b USING (term) JOIN templates t ON b.k = 't' || t.t
  WHERE a.k[1] = 'l' AND b.k[1] = 't' GROUP BY a.k, t.t, t.license HAVING round(sum(a.w * b.w), 9) >= 0.8
), own AS (
  SELECT doc_id, path, license, score FROM lines JOIN scored USING (line) QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY score DESC, license) = 1
), given AS (
  SELECT regexp_replace(path, '(^|/)[^/]*$', '') AS license_dir, license, score FROM own WHERE doc_id % 50 = 0
  QUALIFY row_number() OVER (PARTITION BY license_dir ORDER BY score DESC, license) = 1
), dirs AS (
  SELECT doc_id, path, regexp_replace(path, '(^|/)[^/]*$', '') AS dir FROM files
), above AS (
  SELECT d.doc_id, g.license, g.score, g.license_dir FROM dirs d JOIN given g ON d.dir = g.license_dir OR starts_with(d.dir, g.license_dir || '/') OR g.license_dir = ''
  QUALIFY row_number() OVER (PARTITION BY d.doc_id ORDER BY length(g.license_dir) DESC) = 1
)
SELECT d.doc_id, d.path, coalesce(o.license, a.license) AS license, coalesce(o.score, a.score) AS score,
  CASE WHEN o.license IS NOT NULL THEN 'header' WHEN a.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN o.license IS NULL THEN a.license_dir END AS license_dir
FROM dirs d LEFT JOIN own o USING (doc_id) LEFT JOIN above a USING (doc_id)
"""
