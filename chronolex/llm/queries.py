"""Queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bm25, chat_format, chunk_bpe, dac, html_text, imatch, merkle, near_dup, packing, phrases, pii, quality, token_rollup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        html_text.op1_template_text,
        near_dup.op2_lsh_forest,
        token_rollup.op3_delta_rollup,
        chunk_bpe.op4_chunk_reuse_bpe,
        chat_format.op5_chat_masks,
        pii.op6_weak_pii,
        dac.op7_direct_codes,
        packing.op8_local_search_packing,
        quality.op9_weak_quality,
        bm25.op10_block_max_wand,
        merkle.op11_mountain_manifest,
        phrases.op12_suffix_sigma,
        imatch.op13_imatch_fingerprints,
    )
    return {f.__name__: f for f in found}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases of two to four words within pieces, counted one by one.
_PHRASES = f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), words AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces
), totals AS (
    SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang
), grams AS (
    SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, w[i : i + k - 1] AS w
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3, 4]) AS k FROM words) WHERE len(w) >= k)
), counted AS (
    SELECT lang, k, phrase, any_value(w) AS w, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30
), cuts AS (
    SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, cut, CAST(floor(CAST(c.f AS HUGEINT) * 2000000 // (x.f + y.f)) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM counted WHERE k > 1) c
    JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : cut], ' ')
    JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1 : c.k], ' ')
), best AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_ AS (
    SELECT lang, f, array_to_string(w[i : i + size - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, k - size + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS size FROM counted WHERE k > 2))
), longer AS (
    SELECT lang, phrase, max(f) AS f FROM inner_ GROUP BY lang, phrase
), ranked AS (
    SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, CAST(t.n AS BIGINT) AS n, b.score
    FROM best b JOIN totals t USING (lang) LEFT JOIN longer x ON x.lang = b.lang AND x.phrase = b.phrase
    WHERE x.f IS NULL OR 100 * x.f < 80 * b.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


#: Sets of five-word shingles, links of pairs of sets that share a shingle, and what links reach.
_NEAR = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM words
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
    SELECT doc_id, doc_id AS r FROM documents UNION SELECT reached.doc_id, ways.b FROM reached JOIN ways ON ways.a = reached.r
), named AS (
    SELECT doc_id, min(r) AS component_id FROM reached GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN named USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


def _levels(name: str, start: str, height: int) -> str:
    """Common tables name0 to name<height> (tree, idx, h, n of its level and tree) of trees of runs of 16, with name<k>s, the siblings of each node before and after it, for nodes that have a parent."""
    out = [f"{name}0 AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM ({start}))"]
    for k in range(height):
        run = "PARTITION BY tree, idx // 16 ORDER BY idx ROWS BETWEEN"
        out.append(f"{name}{k}s AS (SELECT tree, idx, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k} WHERE n > 1)")
        out.append(f"{name}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM (SELECT tree, idx // 16 AS idx, sha256(string_agg(h, '' ORDER BY idx)) AS h FROM {name}{k} WHERE n > 1 GROUP BY ALL))")
    return ",\n".join(out)


def _merkle(height: int = 6, top: int = 4) -> str:
    """Trees of up to 16 ** height documents a source and 16 ** top sources, level by level."""
    part = lambda v: f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || {v}, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(part, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    bits = "flatten(list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda i: [ascii(CAST(doc_id AS VARCHAR)[i]), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform({bits}, lambda x: CAST(x AS BIGINT))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"
    last = lambda name, n: " UNION ALL ".join(f"SELECT tree, h FROM {name}{k} WHERE n = 1" for k in range(n + 1))
    joins = [f"LEFT JOIN t{k}s ON t{k}s.tree = x.tree AND t{k}s.idx = x.idx // {16**k}" for k in range(height)] + [f"LEFT JOIN u{k}s ON u{k}s.idx = o.idx // {16**k}" for k in range(top)]
    steps = [f"t{k}s" for k in range(height)] + [f"u{k}s" for k in range(top)]
    folded = "coalesce(x.tampered, x.h)"
    folds = []
    for k, step in enumerate(steps):
        folds.append(f"f{k + 1} AS (SELECT *, CASE WHEN b{k} IS NULL THEN f ELSE sha256(b{k} || f || a{k}) END AS g FROM {'f0' if k == 0 else f'(SELECT * EXCLUDE (f, g), g AS f FROM f{k})'})")
    columns = ", ".join(f"{s}.b AS b{k}, {s}.a AS a{k}" for k, s in enumerate(steps))
    proof = " || ".join(f"coalesce(b{k} || a{k}, '')" for k in range(len(steps)))
    return f"""WITH leaves AS (
    SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, {leaf('text')} AS h, CASE WHEN {crc} % 5 = 0 THEN {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS tampered FROM documents
), placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS idx FROM leaves),
{_levels('t', 'SELECT tree, idx, h FROM placed', height)},
subroots AS ({last('t', height)}), ordered AS (SELECT tree AS source, h, row_number() OVER (ORDER BY tree) - 1 AS idx FROM subroots),
{_levels('u', "SELECT '' AS tree, idx, h FROM ordered", top)},
root AS ({last('u', top)}),
f0 AS (SELECT x.doc_id, x.h AS leaf, o.h AS subroot, root.h AS root, {folded} AS f, {columns} FROM placed x JOIN ordered o ON o.source = x.tree CROSS JOIN root {' '.join(joins)}),
{(',' + chr(10)).join(folds)}
SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, g AS folded_root, g = root AS verified FROM f{len(steps)}"""


def oracle_sql() -> dict[str, str]:
    return {"op2_lsh_forest": _NEAR, "op11_mountain_manifest": _merkle(), "op12_suffix_sigma": _PHRASES}
