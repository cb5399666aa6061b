"""SQL of those queries that SQL can state, over the same tables. It compares windows, sets and pairs as they are."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _components(nodes: str, links: str) -> str:
    """CTEs ``reach`` and ``comp`` (node, component_id) from a table of nodes and one of links a, b in both directions."""
    return f"""reach AS (SELECT node, node AS other FROM {nodes} UNION SELECT reach.node, b AS other FROM reach JOIN {links} ON a = other),
comp AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)"""


BLOCKS = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
w AS (SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM d)),
r AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM w JOIN r USING (s) CROSS JOIN range(35) t(k)),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM d),
kept AS (SELECT doc_id, count(gone.j) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE gone.j IS NULL) AS s
  FROM each LEFT JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

SUFFIXES = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d)),
r AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w JOIN r USING (s)),
part AS (SELECT doc_id, i, count(*) FILTER (WHERE before IS NULL OR i > before + 200) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hit),
run AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM part GROUP BY doc_id, run),
gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0)::BIGINT AS c, a::BIGINT AS e FROM run
  UNION ALL SELECT doc_id, max(b), 1000000000 FROM run GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * c + 1, 2 * (e - c)), '' ORDER BY c) AS k FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM run GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
nodes AS (SELECT doc_id AS node FROM documents), {_components("nodes", "l")}
SELECT node AS doc_id, coalesce(n, 0) AS n_shingles, component_id FROM comp LEFT JOIN n ON n.doc_id = node"""

EPSILON = f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
nodes AS (SELECT vec_id AS node FROM embeddings), {_components("nodes", "l")}
SELECT node AS vec_id, CAST((SELECT count(*) FROM l WHERE a = node) AS BIGINT) AS n_links, component_id, node = component_id AS kept FROM comp"""

FILTER_AUDIT = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
f AS (SELECT doc_id, part, concat(CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
  CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
  CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 'E' END) AS fails FROM d),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
  count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic FROM f GROUP BY part, fails),
o AS (SELECT '' AS o UNION ALL SELECT o || x FROM o CROSS JOIN (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) l(x) WHERE NOT contains(o, x)),
s AS (SELECT o AS filter_order, CAST(k AS INTEGER) AS step, substr(o, k, 1) AS here, substr(o, 1, k - 1) AS before
  FROM o CROSS JOIN range(1, 6) t(k) WHERE length(o) = 5),
r AS (SELECT part, filter_order, step, here, sum(n) FILTER (WHERE translate(fails, before || here, '') = fails) AS kept,
  sum(n) FILTER (WHERE contains(fails, here) AND translate(fails, before, '') = fails) AS removed,
  sum(n) FILTER (WHERE contains(fails, here) AND translate(fails, before, '') <> fails) AS redundant, sum(n) FILTER (WHERE fails = here) AS unique_fails,
  sum(good) FILTER (WHERE contains(fails, here) AND translate(fails, before, '') = fails) AS good_lost,
  sum(toxic) FILTER (WHERE contains(fails, here) AND translate(fails, before, '') = fails) AS toxic_lost FROM m CROSS JOIN s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
coalesce(sum(removed) OVER (PARTITION BY part, here), 0)::BIGINT AS shapley FROM r"""

DIVERGENCE = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, r, unnest(w) AS term FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS ln FROM c GROUP BY ALL HAVING sum(docs) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(ln) AS lt FROM k GROUP BY lang),
x AS (SELECT g.lang, g.source, k.term, ln, coalesce(n, 0) AS n FROM g JOIN k ON k.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT AS p,
  1 + 1000000000::HUGEINT * (ln + 5)::HUGEINT // (lt + 5 * v)::HUGEINT AS q FROM x JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term
  AND a.source <> b.source GROUP BY ALL),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM e QUALIFY part = 'pair' OR rank <= 50"""

SQL = {
    "op3_block_anchors": BLOCKS,
    "op5_suffix_dedup": SUFFIXES,
    "op6_jaccard_join": JACCARD,
    "op10_epsilon_grid": EPSILON,
    "op11_filter_audit": FILTER_AUDIT,
    "op12_source_divergence": DIVERGENCE,
}
