"""DuckDB statements of the training-data queries that SQL can express."""

from __future__ import annotations

import string

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase

OP11 = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare, length(coalesce(text, '')) AS points FROM documents),
p AS (SELECT doc_id, sha256(bare) AS text_sha256, count(*) OVER g AS group_size, row_number() OVER o AS place, first_value(doc_id) OVER o AS keep_id
  FROM d WINDOW g AS (PARTITION BY bare), o AS (PARTITION BY bare ORDER BY points DESC, doc_id ASC NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM p
"""


def _climb(nodes: str, name: str, levels: int, width: int) -> list[str]:
    """CTEs ``{name}0 .. {name}{levels}`` of ``nodes (t, i, h)``: each level's parents, and the runs they come from."""
    out = [f"{name}0 AS (SELECT t, i, h, count(*) OVER (PARTITION BY t) AS n FROM {nodes})"]
    for k in range(levels):
        out.append(f"""{name}_run{k} AS (SELECT t, i // {width} AS i, list(h ORDER BY i) AS hs FROM {name}{k} WHERE n > 1 GROUP BY t, i // {width})""")
        out.append(f"""{name}{k + 1} AS (SELECT t, i, h, count(*) OVER (PARTITION BY t) AS n FROM (
  SELECT t, i, sha256(list_aggregate(hs, 'string_agg', '')) AS h FROM {name}_run{k} UNION ALL SELECT t, i, h FROM {name}{k} WHERE n = 1))""")
    return out


def merkle(levels: int = 4, width: int = 16) -> str:
    """Up to ``width ** levels`` rows a source, and as many sources."""
    field = lambda v: f"coalesce(strlen({v}) || ':' || {v}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(
        field(v) for v in ("d.doc_id::varchar", "source", "lang", "n_chars::varchar", text)) + ")"
    # bit by bit: divide by the reflected polynomial
    ctes = ["""bits AS (SELECT range::ubigint AS b FROM range(256))""",
            "crc_table AS (SELECT list(v ORDER BY b) AS tbl FROM (SELECT b, list_reduce([b] || [0::ubigint for x in range(8)], "
            "lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::ubigint) ELSE c >> 1 END) AS v FROM bits))",
            """keys AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)""",
            "fifth AS (SELECT doc_id, xor(list_reduce([4294967295::ubigint] || [ascii(x)::ubigint for x in string_split(doc_id::varchar, '')], "
            "lambda c, x: xor(tbl[(xor(c, x) & 255)::bigint + 1], c >> 8)), 4294967295::ubigint) % 5 = 0 AS touched FROM keys, crc_table)",
            f"""leaves AS (SELECT d.doc_id, d.source, {leaf('text')} AS leaf, coalesce(touched, false) AS touched,
  {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} AS forged FROM documents d LEFT JOIN fifth f ON d.doc_id = f.doc_id)""",
            """placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves)""",
            "nodes AS (SELECT t, i, leaf AS h FROM placed)"]
    ctes += _climb("nodes", "a", levels, width)
    ctes.append(f"subs AS (SELECT t, h FROM a{levels})")
    ctes.append("tops AS (SELECT 0 AS t, t AS i, h FROM subs)")
    ctes += _climb("tops", "b", levels, width)
    ctes.append(f"root AS (SELECT h AS root FROM b{levels})")
    source, steps = "placed JOIN subs USING (t)", []
    state = "p0 AS (SELECT placed.*, subs.h AS subroot, '' AS proof, CASE WHEN touched THEN forged ELSE leaf END AS folded FROM " + source + ")"
    ctes.append(state)
    k = 0
    for name, tree, place in (("a", "p.t", "p.i"), ("b", "0", "p.t")):
        for n in range(levels):
            at = f"{place} // {width ** n}"
            run = f"{place} // {width ** (n + 1)}"
            slot = f"({at}) % {width}"
            left = f"coalesce(list_aggregate(hs[:{slot}], 'string_agg', ''), '')"
            right = f"coalesce(list_aggregate(hs[{slot} + 2:], 'string_agg', ''), '')"
            # a tree that has ended by this level has no run here: nothing changes
            ctes.append(f"""p{k + 1} AS (SELECT p.* EXCLUDE (proof, folded), CASE WHEN hs IS NULL THEN proof ELSE proof || {left} || {right} END AS proof,
  CASE WHEN hs IS NULL THEN folded ELSE sha256({left} || folded || {right}) END AS folded
  FROM p{k} p LEFT JOIN {name}_run{n} r ON r.t = {tree} AND r.i = {run})""")
            k += 1
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM p{k}, root"""


OP13 = f"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, words FROM (
    SELECT lang, list_filter(string_split_regex(body, '[ \\t]+'), lambda w: w <> '') AS words FROM (
      SELECT coalesce(lang, 'und') AS lang,
             unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\n\\x0B\\f\\r]')) AS body FROM documents))
  WHERE len(words) > 0),
w AS (SELECT piece, lang, unnest(words) AS w1, generate_subscripts(words, 1) AS i FROM pieces),
g AS (SELECT lang, w1, lead(w1) OVER p AS w2, lead(w1, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY piece ORDER BY i)),
total AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
longer AS (SELECT lang, w1, w2, max(f) AS f FROM (
  SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY lang, w1, w2),
cuts AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
  LEFT JOIN longer o ON o.lang = f2.lang AND o.w1 = f2.w1 AND o.w2 = f2.w2 WHERE coalesce(100 * o.f < 50 * f2.f, true)
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 1, x.f, y.f
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 2, x.f, y.f
  FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3),
scored AS (SELECT *, (1000000::hugeint * a * a) // (l::hugeint * r) AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT ranked.lang, rank, phrase, a, l, r, n, score::bigint AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

OP1 = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(words) - 48)) AS i, words FROM w WHERE len(words) >= 50),
windows AS (SELECT doc_id, i, sha256(list_aggregate(words[i:i + 49], 'string_agg', ' ')) AS h FROM starts),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM late),
words_of AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
kept AS (SELECT x.doc_id, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN word END, ' ' ORDER BY x.i) AS text
  FROM words_of x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY x.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

# a null or non-finite component makes its whole vector unusable
USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

OP2 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND {USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(l.b, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(l.b, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN least l ON l.a = vec_id
"""

OP9 = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE {USABLE}),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

ORACLES = {
    "op1_repeat_automata": OP1,
    "op2_projection_passes": OP2,
    "op9_norm_buckets": OP9,
    "op11_fuse_dedup": OP11,
    "op12_merkle_manifest": merkle(),
    "op13_collocations": OP13,
}
