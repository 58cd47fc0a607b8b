"""Plain SQL of the corpus queries that SQL can express, for whole tables of a size a second engine holds."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

JACCARD = f"""WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
    grams AS (SELECT r, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS g FROM docs),
    sizes AS (SELECT docs.r, docs.doc_id, count(g) AS n FROM docs LEFT JOIN grams ON docs.r = grams.r GROUP BY docs.r, docs.doc_id),
    shared AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM grams AS a JOIN grams AS b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
    links AS (SELECT s.a, s.b FROM shared AS s JOIN sizes AS x ON s.a = x.r JOIN sizes AS y ON s.b = y.r WHERE 100 * s.n >= 85 * (x.n + y.n - s.n)),
    edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reached AS (SELECT r AS a, r AS b FROM docs UNION SELECT reached.a, edges.b FROM reached JOIN edges ON reached.b = edges.a)
    SELECT x.doc_id, x.n AS n_shingles, min(y.doc_id) AS component_id FROM sizes AS x JOIN reached ON x.r = reached.a JOIN sizes AS y ON reached.b = y.r GROUP BY x.r, x.doc_id, x.n"""

SUBSTRINGS = f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
    windows AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, unnest(list_transform(range(1, len(w) - 33), lambda i: array_to_string(w[i:i + 34], ' '))) AS t FROM docs WHERE len(w) >= 35),
    repeated AS (SELECT t FROM windows GROUP BY t HAVING count(*) > 1),
    removed AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM windows SEMI JOIN repeated ON windows.t = repeated.t),
    words AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM docs),
    kept AS (SELECT r, array_to_string(list(word ORDER BY i), ' ') AS t, count(*) AS n FROM words ANTI JOIN removed ON words.r = removed.r AND words.i = removed.i GROUP BY r)
    SELECT doc_id, len(w) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM docs LEFT JOIN kept ON docs.r = kept.r"""

_SOURCES = r"""sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
    totals AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight FROM sized GROUP BY source),
    placed AS (SELECT source, source_size, weight, row_number() OVER (ORDER BY 3 * source_size::DOUBLE / weight, encode(source) NULLS LAST) AS i FROM totals),
    levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM placed WINDOW before AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    level AS (SELECT min_by(level, i) AS level FROM levels WHERE level * weight <= 3 * source_size)"""

#: Sizes and targets alone: which documents are drawn has no form in SQL.
MIXING_TARGETS = f"""WITH {_SOURCES}
    SELECT s.doc_id, s.size::BIGINT AS size, p.source_size, round(least(3 * p.source_size, coalesce((SELECT level FROM level), 0) * p.weight)::DOUBLE, 3) AS target
    FROM sized AS s JOIN placed AS p ON s.source IS NOT DISTINCT FROM p.source"""

#: What SQL can say of the fingerprints: lengths, and the edited texts by their hash.
FINGERPRINT_EDITS = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER w, first_value(t) OVER w) AS after FROM d WINDOW w AS (ORDER BY doc_id))
    SELECT doc_id, n AS n_chars, sha256(left(t, n - n // 2) || left(after, n // 2)) AS edited_sha256 FROM n"""

#: Words, places and labels of the base phrases.
LICENCE_PHRASES = """WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    words AS (SELECT r, unnest(range(0, len(w))) AS i, unnest(w) AS a FROM d),
    runs AS (SELECT r, i, a, lead(a, 1) OVER run AS b, lead(a, 2) OVER run AS c, lead(a, 3) OVER run AS e FROM words WINDOW run AS (PARTITION BY r ORDER BY i)),
    places AS (SELECT r, i, CASE WHEN a = 'gnu' AND b = 'general' AND c = 'public' AND e = 'license' THEN 'gpl' WHEN a = 'apache' AND b = 'license' THEN 'apache'
    WHEN a = 'cc' AND b = 'by' THEN 'cc-by' WHEN a = 'mit' AND b = 'license' THEN 'mit' END AS l FROM runs WHERE l IS NOT NULL),
    found AS (SELECT r, count(*) AS n, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT l, ',' ORDER BY l) AS labels FROM places GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN found ON d.r = found.r"""

#: crc32 by its table of 256 entries, which follow from the reversed polynomial.
RESAMPLING = """WITH crc AS (SELECT list(list_reduce(range(8), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, c) ORDER BY c) AS t FROM range(256) AS r(c)),
    docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    target AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS g FROM benchmark),
    grams AS (SELECT r, unnest(w) AS g FROM docs),
    known AS (SELECT g, hex(encode(g)) AS h FROM (SELECT g FROM grams UNION SELECT g FROM target)),
    buckets AS (SELECT g, xor(list_reduce(list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT), lambda a, x: xor(a >> 8, t[xor(a, x) % 256 + 1]), 4294967295), 4294967295) % 10000 AS b FROM known, crc),
    s AS (SELECT b, count(*) AS n FROM grams JOIN buckets ON grams.g = buckets.g GROUP BY b),
    t AS (SELECT b, count(*) AS n FROM target JOIN buckets ON target.g = buckets.g GROUP BY b),
    sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t),
    gains AS (SELECT buckets.g, floor(1000 * ln((coalesce(t.n, 0) + 1) * (sums.s + 10000) / ((coalesce(s.n, 0) + 1) * (sums.t + 10000))))::BIGINT AS gain
    FROM buckets LEFT JOIN s ON buckets.b = s.b LEFT JOIN t ON buckets.b = t.b CROSS JOIN sums),
    weights AS (SELECT r, sum(gain) AS weight FROM grams JOIN gains ON grams.g = gains.g GROUP BY r),
    scored AS (SELECT docs.r, doc_id, len(w) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM docs LEFT JOIN weights ON docs.r = weights.r),
    places AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM scored LEFT JOIN places ON scored.r = places.r"""

NEAR_VECTORS = """WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    valid AS (SELECT r, vec_id, label, e, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    links AS (SELECT a.r AS a, b.r AS b FROM valid AS a JOIN valid AS b ON a.label = b.label AND a.r < b.r AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
    edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    degrees AS (SELECT a, count(*) AS n FROM edges GROUP BY a),
    reached AS (SELECT r AS a, r AS b FROM v UNION SELECT reached.a, edges.b FROM reached JOIN edges ON reached.b = edges.a),
    roots AS (SELECT reached.a, min(x.vec_id) AS root FROM reached JOIN v AS x ON reached.b = x.r GROUP BY reached.a)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, root AS component_id, vec_id IS NOT DISTINCT FROM root AS kept FROM v JOIN roots ON v.r = roots.a LEFT JOIN degrees ON v.r = degrees.a"""
