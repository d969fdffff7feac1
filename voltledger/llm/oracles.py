"""Corpus queries that SQL can express, as DuckDB SQL over the same tables."""

OP13 = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
        CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

# CRC-32 bit by bit over the decimal digits of conv_id.
OP11 = """
WITH turns AS (
    SELECT conv_id, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS t,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, list(t ORDER BY i) AS ts FROM turns GROUP BY conv_id
), heads AS (
    SELECT conv_id, ts, list_reduce(
        list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
        lambda crc, x: list_reduce([0, 1, 2, 3, 4, 5, 6, 7],
            lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END, xor(crc, x)),
        CAST(4294967295 AS BIGINT)) AS crc
    FROM own
), rebuilt AS (
    SELECT a.conv_id, list_concat(
        coalesce(b.ts[1:CAST(xor(a.crc, 4294967295) % 9 AS BIGINT)], []),
        a.ts[CAST(xor(a.crc, 4294967295) % 9 AS BIGINT) + 1:]) AS ts
    FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5
), steps AS (
    SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS depth FROM rebuilt
), nodes AS (
    SELECT depth, ts[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
        coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(ts) = depth), '') AS ends
    FROM steps GROUP BY ALL
), weighed AS (
    SELECT n.*, p.conv_id AS parent_conv_id,
        (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.path[1:n.depth] = n.path) AS n_children,
        (n.n_convs - 1) * coalesce(strlen(n.path[n.depth].text), 0) AS saved
    FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
)
SELECT n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children,
    count(*) FILTER (c.n_children = 0) AS n_leaves, CAST(sum(c.saved) AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM weighed n JOIN weighed c ON c.depth >= n.depth AND c.path[1:n.depth] = n.path
GROUP BY ALL
"""

QUERIES = {"op11_prefix_trie": OP11, "op13_hard_negatives": OP13}
