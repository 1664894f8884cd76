"""Results of the numbered queries in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

_WHOLE = """embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

JACCARD_JOIN = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(
        regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'),
        lambda w: w <> '') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    END AS s
    FROM words
), sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
tokens AS (SELECT doc_id, unnest(s) AS t FROM sets),
pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
    FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id
), links AS (
    SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
    WHERE 100 * shared >= 90 * (p.n + q.n - shared)
), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (
    SELECT doc_id AS x, doc_id AS y FROM sizes
    UNION
    SELECT r.x, e.y FROM reached r JOIN edges e ON e.x = r.y
)
SELECT s.doc_id, s.n AS n_shingles, min(r.y) AS component_id
FROM sizes s JOIN reached r ON r.x = s.doc_id GROUP BY s.doc_id, s.n
"""

HARD_NEGATIVES = f"""
WITH kept AS (
    SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings WHERE label IS NOT NULL AND {_WHOLE}
), scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
        list_inner_product(a.q, c.q)::BIGINT AS score
    FROM kept a JOIN kept c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.q) = len(c.q)
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), negatives AS (
    SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
    FROM positives p JOIN scored s USING (anchor_id)
    WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 10
"""


def _vector_codes(rounds: int = 4) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS (
    SELECT nr, part, any_value(v) AS v,
        min(struct_pack(d := d, entry := entry)) AS best
    FROM (
        SELECT p.nr, p.part, p.v, b.entry,
            list_sum(list_transform(list_zip(p.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM parts p JOIN book{k} b ON b.part = p.part
    ) GROUP BY nr, part
)""")
        if k < rounds:
            steps.append(f"""mean{k} AS (
    SELECT part, entry, list(m ORDER BY place) AS c FROM (
        SELECT part, entry, place, floor(sum(x) / count(*))::BIGINT AS m FROM (
            SELECT part, best.entry AS entry, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM near{k}
        ) GROUP BY part, entry, place
    ) GROUP BY part, entry
), book{k + 1} AS (
    SELECT b.part, b.entry, coalesce(m.c, b.c) AS c
    FROM book{k} b LEFT JOIN mean{k} m ON m.part = b.part AND m.entry = b.entry
)""")
    return f"""
WITH kept AS (
    SELECT row_number() OVER () AS nr, vec_id, label,
        list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q
    FROM embeddings WHERE {_WHOLE}
), parts AS (
    SELECT nr, part, q[part * (len(q) // 4) + 1 : (part + 1) * (len(q) // 4)] AS v
    FROM kept, range(4) p(part)
), book0 AS (
    SELECT part, rank - 1 AS entry, v AS c
    FROM parts JOIN (SELECT nr, row_number() OVER (ORDER BY vec_id) AS rank FROM kept) USING (nr)
    WHERE rank <= 256
), {", ".join(steps)}, coded AS (
    SELECT nr, string_agg(format('{{:02x}}', best.entry), '' ORDER BY part) AS code,
        sum(best.d)::BIGINT AS error
    FROM near{rounds} GROUP BY nr
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (nr)
"""


ORACLE = {
    "op8_jaccard_join": JACCARD_JOIN,
    "op12_hard_negatives": HARD_NEGATIVES,
    "op13_vector_codes": _vector_codes(),
}
