"""DuckDB twins of the llm queries that SQL can express."""

from __future__ import annotations

from textcards.llm.license_templates import TEMPLATES

LOW = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = "[^\\x20\\x09-\\x0D]+"
ALNUM = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _words(pattern: str, text: str = "coalesce(text, '')") -> str:
    return f"regexp_extract_all({LOW.format(t=text)}, '{pattern}')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_B32 = "array_to_string(list_transform(range(0, 160, 5), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ({five}):1 + ({five})]), '')"
_NIBBLES = "(CAST(strpos('0123456789abcdef', x[1 + i // 4:1 + i // 4]) AS INTEGER) - 1) * 16 + " \
           "(CASE WHEN i // 4 = 39 THEN 0 ELSE CAST(strpos('0123456789abcdef', x[2 + i // 4:2 + i // 4]) AS INTEGER) - 1 END)"

OP2 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(encode(p.h)) AS BIGINT) AS payload_bytes,
       {_B32.format(five=f"(({_NIBBLES}) >> (3 - i % 4)) & 31")} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT *, sha1(h) AS x FROM p) p JOIN f ON f.h = p.h"""

OP4 = f"""
WITH it AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words(ALNUM)} AS w FROM benchmark),
ik AS (SELECT item, w, least(10, len(w)) AS k FROM it WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS s
        FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM ik)),
d AS (SELECT doc_id, {_words(ALNUM)} AS w FROM documents),
dk AS (SELECT doc_id, w, k FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
       FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM dk)),
hit AS (SELECT dw.doc_id, dw.i, dw.k, win.item FROM dw JOIN win ON win.s = dw.s AND win.k = dw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n, 0) AS BIGINT) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id"""

OP5 = f"""
WITH RECURSIVE ln AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line, unnest(l) AS s
             FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
lw AS (SELECT doc_id, line, {_words(SPACED, 's')} AS w FROM ln),
c AS (SELECT doc_id, line, w, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY line) AS upto FROM lw),
run AS (SELECT a.doc_id, a.line, min(b.line) AS last FROM c a JOIN c b ON b.doc_id = a.doc_id AND b.line >= a.line
        AND b.upto - a.upto + len(a.w) >= 20 WHERE len(a.w) > 0 GROUP BY a.doc_id, a.line),
p AS (SELECT doc_id, line, last, row_number() OVER (ORDER BY doc_id, line) AS id, w
      FROM (SELECT run.doc_id, run.line, run.last, flatten(list(c.w ORDER BY c.line)) AS w
            FROM run JOIN c ON c.doc_id = run.doc_id AND c.line BETWEEN run.line AND run.last GROUP BY run.doc_id, run.line, run.last)),
sh AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM p)),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
pair AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id),
link AS (SELECT x, y FROM pair JOIN n a ON a.id = x JOIN n b ON b.id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
both_ AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
r AS (SELECT DISTINCT x AS a, x AS b FROM both_ UNION SELECT r.a, both_.y FROM r JOIN both_ ON both_.x = r.b),
after AS (SELECT a AS id, min(b) AS first FROM r GROUP BY a HAVING min(b) < a),
gone AS (SELECT DISTINCT doc_id, line FROM (
           SELECT p.doc_id, unnest(range(p.line, p.last + 1)) AS line, f.doc_id AS fd, f.line AS fl, f.last AS ft
           FROM after JOIN p ON p.id = after.id JOIN p f ON f.id = after.first)
         WHERE NOT (doc_id = fd AND line BETWEEN fl AND ft)),
g AS (SELECT doc_id, list(line ORDER BY line) AS lines FROM gone GROUP BY doc_id),
np AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
kept AS (SELECT ln.doc_id, string_agg(s, chr(10) ORDER BY line) AS t FROM ln LEFT JOIN g ON g.doc_id = ln.doc_id
         WHERE g.lines IS NULL OR NOT list_contains(g.lines, line) GROUP BY ln.doc_id)
SELECT d.doc_id, CAST(coalesce(np.n, 0) AS BIGINT) AS n_paragraphs, CAST(coalesce(len(g.lines), 0) AS BIGINT) AS n_removed,
       coalesce(array_to_string(g.lines, ','), '') AS removed_lines, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM documents d LEFT JOIN np ON np.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""

_TEMPLATES = ", ".join(f"({_text(k)}, {_text(v)})" for k, v in TEMPLATES.items())
_GRAMS = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"


def _plain(x: str) -> str:
    return f"string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), ' ')"


OP6 = f"""
WITH t AS (SELECT name, {_GRAMS} AS g FROM (SELECT name, {_plain('body')} AS w FROM (VALUES {_TEMPLATES}) v(name, body))),
u AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line, unnest(l) AS s
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
      UNION ALL SELECT doc_id, -1, coalesce(text, '') FROM documents),
g AS (SELECT doc_id, line, {_GRAMS} AS g FROM (SELECT doc_id, line, {_plain('s')} AS w FROM u)),
m AS (SELECT doc_id, line, name, 2.0::DOUBLE * len(list_intersect(g.g, t.g)) / (len(g.g) + len(t.g)) AS dice
      FROM g JOIN t ON len(g.g) * 1.2 >= len(t.g) * 0.8 AND len(t.g) * 1.2 >= len(g.g) * 0.8),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, line, name) AS r FROM m WHERE dice >= 0.8),
a AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n_units, CAST(coalesce(a.n, 0) AS BIGINT) AS n_matches,
       coalesce(h.name, '') AS license, coalesce(h.dice, 0.0::DOUBLE) AS dice, CAST(coalesce(h.line, -2) AS INTEGER) AS line, coalesce(a.names, '') AS licenses
FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN h ON h.doc_id = d.doc_id AND h.r = 1"""

OP7 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 400)) AS h
      FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 199)) AS p FROM d WHERE len(x) >= 400)),
twice AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
m AS (SELECT doc_id, p FROM w WHERE h IN (SELECT h FROM twice)),
e AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS new FROM m),
s AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM e)
      GROUP BY doc_id, k),
cut AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t, a FROM s
        UNION ALL SELECT doc_id, max(b), NULL, 9e18 FROM s GROUP BY doc_id),
kept AS (SELECT d.doc_id, string_agg(substr(x, 2 * f + 1, 2 * (coalesce(t, len(x) // 2) - f)), '' ORDER BY a) AS x
         FROM cut JOIN d ON d.doc_id = cut.doc_id GROUP BY d.doc_id),
n AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n.removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(SPACED)} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN 'all ' || array_to_string(w, ' ') ELSE '3 ' || array_to_string(w[i:i + 2], ' ') END AS g
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT x, y FROM pair JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
both_ AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
r AS (SELECT DISTINCT x AS a, x AS b FROM both_ UNION SELECT r.a, both_.y FROM r JOIN both_ ON both_.x = r.b),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id"""

_FINITE = ("embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = len(embedding)")


def _clustering(rounds: int, k: int, dim: int) -> str:
    near = """a{r} AS (SELECT vec_id, c, d FROM (SELECT vec_id, c, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS r
      FROM (SELECT e.vec_id, c.c, CAST(sum((e.x - c.x) * (e.x - c.x)) AS BIGINT) AS d FROM e JOIN c{r} c ON c.i = e.i GROUP BY e.vec_id, c.c))
      WHERE r = 1),"""
    move = """m{r} AS (SELECT a.c, e.i, sum(e.x) AS s, count(*) AS n FROM a{r} a JOIN e ON e.vec_id = a.vec_id GROUP BY a.c, e.i),
c{q} AS (SELECT c.c, c.i, coalesce(CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT), c.x) AS x
         FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c AND m.i = c.i),"""
    steps = "\n".join(near.format(r=r) + "\n" + move.format(r=r, q=r + 1) for r in range(rounds))
    return f"""
WITH k AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v
           FROM embeddings WHERE len(embedding) = {dim} AND {_FINITE}),
e AS (SELECT vec_id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM k),
f AS (SELECT v, sha256('1:' || vec_id) AS h FROM k ORDER BY h LIMIT {k}),
c0 AS (SELECT c, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM (SELECT v, row_number() OVER (ORDER BY h) - 1 AS c FROM f)),
{steps}
{near.format(r=rounds)}
t AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, t.h AS centroid_sha256
FROM a{rounds} a JOIN t ON t.c = a.c"""


OP11 = _clustering(3, 16, 64)

OP12 = f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s
      FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.a, p.b AS p, p.s AS ps, s.b AS n, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS k
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
SELECT a AS anchor_id, p AS positive_id, CAST(k AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score
FROM n WHERE k <= 3"""

ORACLES = {"op2_warc": OP2, "op4_decontamination": OP4, "op5_paragraph_dedup": OP5, "op6_license_scan": OP6, "op7_suffix_dedup": OP7,
           "op10_shingle_join": OP10, "op11_centroid_clustering": OP11, "op12_hard_negatives": OP12}
