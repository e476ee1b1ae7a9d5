"""SQL for the corpus queries that SQL can express."""

ORACLE: dict[str, str] = {
    "op7_arc_to_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest,
                   octet_length(encode(coalesce(html, ''))) AS bytes
            FROM pages
        ), f AS (
            SELECT digest, min(page_id) AS first_id FROM p WHERE bytes >= 100 GROUP BY digest
        )
        SELECT page_id, bytes AS payload_bytes, p.digest AS payload_digest,
               CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f ON p.digest = f.digest AND p.bytes >= 100
    """,
    "op5_near_duplicates": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS t
            FROM documents
        ), s AS MATERIALIZED (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) < 2 THEN t
                ELSE list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) END) AS g
            FROM w
        ), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
            FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
        ), l AS MATERIALIZED (
            SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
            WHERE 100 * c >= 80 * (a.n + b.n - c)
        ), both_ways AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r(x, m) AS (
            SELECT doc_id, doc_id FROM documents
            UNION SELECT b.y, r.m FROM r JOIN both_ways b ON b.x = r.x
        ), c AS (SELECT x, min(m) AS component_id FROM r GROUP BY x)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM documents d JOIN c ON c.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
    """,
    "op13_substring_dedup": r"""
        WITH w AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents
        ), g AS MATERIALIZED (
            SELECT doc_id, i, sha256(array_to_string(t[i + 1:i + 13], ' ')) AS g
            FROM (SELECT doc_id, t, unnest(range(0, len(t) - 12)) AS i FROM w WHERE len(t) >= 13)
        ), f AS MATERIALIZED (
            SELECT g, min(doc_id) AS source FROM g GROUP BY g HAVING count(DISTINCT doc_id) > 1
        ), c AS MATERIALIZED (
            SELECT DISTINCT doc_id, i + k AS word
            FROM g JOIN f USING (g), unnest(range(13)) AS r(k) WHERE source < doc_id
        ), e AS (
            SELECT doc_id, unnest(t) AS x, unnest(range(len(t))) AS word FROM w
        ), k AS (
            SELECT e.doc_id, count(c.word) AS n_removed,
                   string_agg(CASE WHEN c.word IS NULL THEN x END, ' ' ORDER BY e.word) AS kept
            FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.word = e.word GROUP BY e.doc_id
        )
        SELECT w.doc_id, len(t)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN k ON k.doc_id = w.doc_id
    """,
}
