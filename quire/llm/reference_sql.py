"""DuckDB SQL with the rows of the registered queries."""

SQL = {
    "op5_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY t)""",
    "op7_line_dedup": r"""
        WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS line
                   FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
             k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
             c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
             m AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op10_warc": r"""
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
             q AS (SELECT *, n >= 100 AND page_id > min(page_id) OVER (PARTITION BY d) AS again,
                          min(page_id) OVER (PARTITION BY d) AS keeper FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again THEN keeper END AS refers_to
        FROM q""",
    "op11_periodic_runs": r"""
        WITH crc AS (
          SELECT doc_id, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
              lambda x, c: list_reduce(list_prepend(xor(x, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) AS h
          FROM documents),
        s AS (SELECT doc_id, h, h // 10 AS g, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM crc),
        a AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN g % len(w) END AS a FROM s),
        p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
        d AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM p),
        t AS (SELECT doc_id, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
        e AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
        f AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
        r AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM f GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
        runs AS (SELECT doc_id, start, length, min(q) AS period FROM r GROUP BY doc_id, start, length),
        gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
        kept AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.i) AS text FROM t ANTI JOIN gone ON t.doc_id = gone.doc_id AND t.i = gone.i GROUP BY t.doc_id),
        best AS (SELECT doc_id, count(*) AS n_runs, max(struct_pack(length := length, start := -start, period := -period)) AS b,
            string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, -b.start AS start, b.length AS length, -b.period AS period,
               1000 * b.length // -b.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
        FROM d LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op12_ranked_search": r"""
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
             tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
             d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
             s AS (SELECT count(*) AS N_docs, sum(n)::BIGINT AS L FROM d),
             m AS (SELECT doc_id, 100 - 75 + ((75 * n * N_docs) // L) AS m FROM d, s),
             w AS (SELECT term, floor(1000 * ln((2 * N_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, N_docs),
             q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
             a AS (SELECT item_id, term, count(*) AS asked FROM q GROUP BY ALL),
             r AS (SELECT item_id, doc_id, sum(asked * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
                   FROM a JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL),
             k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM r WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10""",
}
