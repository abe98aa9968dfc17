"""DuckDB SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_DARK = r"[^\x20\x09-\x0D]+"
_DIGITS = "('0x' || substr(digest, 5 * g + 1, 5))::INTEGER"
_SIGNS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_DIGITS} >> {shift}) & 31) + 1, 1)" for shift in (15, 10, 5, 0)
)


def _centroid_rounds(k: int, rounds: int, size: int, scale: int) -> str:
    """Whole k-means, a chain of tables per round; d and a: distances and choices, c: centroids."""
    parts = [f"""
        WITH kept AS (
            SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings
            WHERE len(embedding) = {size}
                AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}
        ), points AS MATERIALIZED (
            SELECT row, i, floor({scale}.0::DOUBLE * embedding[i]::DOUBLE)::BIGINT AS x
            FROM (SELECT *, unnest(range(1, {size + 1})) AS i FROM kept)
        ), firsts AS (
            SELECT row, row_number() OVER (ORDER BY h, embedding) - 1 AS j
            FROM (SELECT *, sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h FROM kept) ORDER BY h, embedding LIMIT {k}
        ), c0 AS (SELECT j, i, x FROM points JOIN firsts USING (row))"""]
    for r in range(rounds + 1):
        parts.append(f"""d{r} AS (
            SELECT p.row, c.j, sum((p.x - c.x) * (p.x - c.x))::BIGINT AS d FROM points p JOIN c{r} c USING (i) GROUP BY ALL
        ), a{r} AS MATERIALIZED (
            SELECT row, j, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, j) = 1
        )""")
        if r < rounds:
            parts.append(f"""s{r} AS (
                SELECT j, i, sum(x) AS s, count(*) AS n FROM points JOIN a{r} USING (row) GROUP BY ALL
            ), c{r + 1} AS MATERIALIZED (
                SELECT j, i, coalesce((s - ((s % n) + n) % n) // n, x)::BIGINT AS x FROM c{r} LEFT JOIN s{r} USING (j, i)
            )""")
    return ", ".join(parts) + f"""
        , names AS (SELECT j, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS digest FROM c{rounds} GROUP BY j)
        SELECT vec_id, j::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY j)::BIGINT AS cluster_inertia,
            sum(d) OVER ()::BIGINT AS inertia, digest AS centroid_sha256
        FROM a{rounds} JOIN kept USING (row) JOIN names USING (j)
    """


STATEMENTS = {
    "op2_decontamination": f"""
        WITH items AS (
            SELECT item_id, regexp_extract_all({_LOWER.format(t='text')}, '{_ALNUM}') AS w FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
            FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i
                FROM (SELECT *, least(10, len(w)) AS n FROM items WHERE len(w) > 0))
        ), sizes AS (SELECT DISTINCT n FROM windows), docs AS (
            SELECT doc_id, regexp_extract_all({_LOWER.format(t='text')}, '{_ALNUM}') AS w FROM documents
        ), spots AS (
            SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes)
        ), hits AS (SELECT doc_id, item_id, n, i FROM spots JOIN windows USING (n, phrase)),
        places AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
        ), found AS (
            SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits GROUP BY doc_id
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
            coalesce(len(ids), 0)::BIGINT AS n_items,
            sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
    "op3_near_dedup": f"""
        WITH RECURSIVE docs AS (
            SELECT doc_id, regexp_extract_all({_LOWER.format(t='text')}, '{_DARK}') AS w FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
            FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
        ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE 100 * common.n >= 75 * (x.n + y.n - common.n)
        ), reached AS (
            SELECT DISTINCT a AS doc_id, a AS other FROM links
            UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
        ), smallest AS (SELECT doc_id, min(other) AS m FROM reached GROUP BY doc_id)
        SELECT doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles,
            coalesce(m, doc_id) AS component_id, coalesce(m, doc_id) = doc_id AS kept
        FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN smallest USING (doc_id)
    """,
    # Two hexadecimal digits are a byte.
    "op7_suffix_dedup": """
        WITH docs AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
        ), spots AS (
            SELECT doc_id, i, md5(substr(h, 2 * i - 1, 400)) AS piece
            FROM (SELECT *, unnest(range(1, n - 198)) AS i FROM docs WHERE n >= 200)
        ), again AS (SELECT piece FROM spots GROUP BY piece HAVING count(*) > 1),
        starts AS (SELECT doc_id, i FROM spots SEMI JOIN again USING (piece)),
        runs AS (
            SELECT doc_id, min(i) AS a, max(i) + 200 AS b
            FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run
                FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200
                    THEN 0 ELSE 1 END AS fresh FROM starts))
            GROUP BY doc_id, run
        ), marked AS (
            SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS last FROM runs GROUP BY doc_id
        ), before AS (
            SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS from_place FROM runs
        ), kept AS (
            SELECT doc_id, string_agg(substr(h, 2 * from_place - 1, 2 * (a - from_place)), '' ORDER BY a) AS part
            FROM before JOIN docs USING (doc_id) GROUP BY doc_id
        )
        SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed,
            coalesce(spans, 0)::BIGINT AS n_spans,
            sha256(unhex(CASE WHEN gone IS NULL THEN h ELSE part || substr(h, 2 * last - 1) END)) AS kept_sha256
        FROM docs LEFT JOIN marked USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    # Five hexadecimal digits are four of the 32 signs.
    "op9_warc": f"""
        WITH records AS (
            SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS chief
            FROM pages
        )
        SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
            array_to_string(list_transform(range(0, 8), lambda g: {_SIGNS}), '') AS payload_digest,
            CASE WHEN page_id = chief THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> chief THEN chief END AS refers_to
        FROM (SELECT *, sha1(payload) AS digest FROM records)
    """,
    "op10_phrase_dedup": f"""
        WITH docs AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_DARK}') AS w FROM documents
        ), spots AS (
            SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS phrase
            FROM (SELECT *, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)
        ), again AS (SELECT phrase FROM spots GROUP BY phrase HAVING count(*) > 1),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM spots SEMI JOIN again USING (phrase)
        ), places AS (
            SELECT doc_id, p, w[p] AS word FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM docs)
        ), kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS words, count(*) AS n
            FROM places ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
            sha256(coalesce(words, '')) AS kept_sha256
        FROM docs LEFT JOIN kept USING (doc_id)
    """,
    "op11_clustering": _centroid_rounds(8, 10, 64, 1024),
    "op12_lexical_search": f"""
        WITH docs AS (
            SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all({_LOWER.format(t='text')}, '{_ALNUM}') AS w
            FROM documents
        ), totals AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM docs WHERE len(w) > 0),
        postings AS (
            SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(w) AS term FROM docs) GROUP BY ALL
        ), weights AS (
            SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
            FROM postings, totals GROUP BY term
        ), items AS (SELECT row_number() OVER () AS item, item_id, text FROM benchmark),
        asked AS (
            SELECT item, term, count(*) AS repeats
            FROM (SELECT item, unnest(regexp_extract_all({_LOWER.format(t='text')}, '{_ALNUM}')) AS term FROM items) GROUP BY ALL
        ), sizes AS (
            SELECT doc, doc_id, 75 + (25 * len(w) * n_docs) // n_terms AS m FROM docs, totals WHERE len(w) > 0
        ), scores AS (
            SELECT item, doc, sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
            FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN sizes USING (doc) GROUP BY item, doc
        )
        SELECT item_id, rank::INTEGER AS rank, doc_id, score
        FROM (SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank
            FROM scores JOIN sizes USING (doc) WHERE score > 0) JOIN items USING (item)
        WHERE rank <= 20
    """,
    "op13_exact_dedup": """
        WITH docs AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS plain
            FROM documents
        )
        SELECT doc_id, first_value(doc_id) OVER best AS keep_id,
            count(*) OVER (PARTITION BY plain)::BIGINT AS group_size,
            row_number() OVER best = 1 AS kept, sha256(plain) AS text_sha256
        FROM docs WINDOW best AS (PARTITION BY plain ORDER BY n DESC, doc_id)
    """,
}
