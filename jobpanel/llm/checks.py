"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

CHECKS: dict[str, str] = {}

CHECKS["op1_chat_format"] = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
    SELECT *,
        replace(replace(replace(replace(role, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>'), ':', '\:') AS r,
        replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') AS t
    FROM turns)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(4 + length(r) + 2 + length(t) + 8) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""

CHECKS["op5_decontamination"] = """
WITH normal_items AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
    FROM benchmark),
windows AS (
    SELECT DISTINCT item, size, array_to_string(list_slice(words, spot, spot + size - 1), ' ') AS gram
    FROM (SELECT item, words, least(13, len(words)) AS size, unnest(generate_series(1, len(words) - least(13, len(words)) + 1)) AS spot
          FROM normal_items WHERE len(words) > 0)),
docs AS (
    SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
    FROM documents),
spots AS (
    SELECT row, size, spot, array_to_string(list_slice(words, spot, spot + size - 1), ' ') AS gram
    FROM (SELECT row, size, words, unnest(generate_series(1, len(words) - size + 1)) AS spot
          FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(words) >= size)),
hits AS (SELECT row, size, spot, item FROM spots JOIN windows USING (size, gram)),
marked AS (
    SELECT row, count(DISTINCT word) AS n_hit FROM (SELECT row, unnest(range(spot, spot + size)) AS word FROM hits) GROUP BY row),
named AS (
    SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN marked USING (row) LEFT JOIN named USING (row)
"""

CHECKS["op8_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

MIXED = """
    counted AS (
        SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS BIGINT) AS tokens,
            CASE WHEN contains(text, 'icense') THEN 'license'
                WHEN contains(text, '@') OR contains(text, 'http') THEN 'contact'
                WHEN contains(text, ' | ') THEN 'table'
                WHEN contains(text, '###') OR contains(text, '$$$') THEN 'markup' ELSE 'prose' END AS topic
        FROM {docs}),
    cells AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM counted GROUP BY ALL),
    roots AS (
        SELECT *, sqrt(sum(tokens) OVER (PARTITION BY source)) AS ws, sqrt(sum(tokens) OVER (PARTITION BY lang)) AS wl,
            sqrt(sum(tokens) OVER (PARTITION BY topic)) AS wt,
            row_number() OVER (PARTITION BY source ORDER BY lang, topic) AS fs,
            row_number() OVER (PARTITION BY lang ORDER BY source, topic) AS fl,
            row_number() OVER (PARTITION BY topic ORDER BY source, lang) AS ft
        FROM cells),
    aims AS (
        SELECT source, lang, topic, tokens, tokens / sum(tokens) OVER () AS share,
            ws / sum(ws) FILTER (WHERE fs = 1) OVER () AS ts, wl / sum(wl) FILTER (WHERE fl = 1) OVER () AS tl,
            wt / sum(wt) FILTER (WHERE ft = 1) OVER () AS tt
        FROM roots),
    raked AS (
        SELECT 0 AS round, * FROM aims
        UNION ALL
        SELECT round + 1, source, lang, topic, tokens, coalesce(b * tt / nullif(sum(b) OVER (PARTITION BY topic), 0), 0), ts, tl, tt
        FROM (SELECT *, coalesce(a * tl / nullif(sum(a) OVER (PARTITION BY lang), 0), 0) AS b
              FROM (SELECT *, coalesce(share * ts / nullif(sum(share) OVER (PARTITION BY source), 0), 0) AS a
                    FROM raked WHERE round < 40))),
    factors AS (
        SELECT source, lang, topic, tokens,
            CASE WHEN tokens > 0 THEN share * sum(tokens) OVER () / tokens ELSE 1 END AS factor
        FROM raked WHERE round = 40),
    misses AS (
        SELECT max(greatest(abs(ms - ts), abs(ml - tl), abs(mt - tt))) AS missed FROM (
            SELECT ts, tl, tt, sum(share) OVER (PARTITION BY source) AS ms, sum(share) OVER (PARTITION BY lang) AS ml,
                sum(share) OVER (PARTITION BY topic) AS mt
            FROM raked WHERE round = 40)),
    ordered AS (
        SELECT *, sum(tokens) OVER () AS whole,
            coalesce(sum(tokens) OVER down, 0) AS taken, sum(tokens * factor) OVER up AS rest
        FROM factors WINDOW
            down AS (ORDER BY factor DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
            up AS (ORDER BY factor DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    -- cells before this one taken whole; the multiple is the first that does not pass 1 here
    multiple AS (
        SELECT coalesce(arg_max((0.5 * whole - taken) / rest, factor), 0.5) AS m FROM ordered
        WHERE rest > 0 AND (0.5 * whole - taken) / rest * factor < 1),
    drawn AS (
        SELECT c.*, factor, least(1.0, factor * m) AS probability,
            CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':7'), 1, 12) AS BIGINT) / 281474976710656.0 AS u
        FROM counted c JOIN factors f ON c.source IS NOT DISTINCT FROM f.source AND c.lang IS NOT DISTINCT FROM f.lang
            AND c.topic = f.topic, multiple)
"""

CHECKS["op7_mixing"] = "WITH RECURSIVE" + MIXED.format(docs="documents") + """
SELECT doc_id, source, lang, topic, tokens, round(factor, 6) AS factor, round(probability, 6) AS probability,
    u < probability AS sampled, round(missed, 6) AS missed
FROM drawn, misses
"""

CHECKS["op11_fill_in_middle"] = """
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
        sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents),
numbers AS (
    SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
            WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn),
parts AS (
    SELECT *, substring(t, 1, least(a, b)) AS p, substring(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS m,
        substring(t, greatest(a, b) + 1) AS s
    FROM numbers)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN greatest(a, b) - least(a, b) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
"""

_ROUND = """
    near{k} AS (
        SELECT row, arg_min(c, (distance, c)) AS c, min(distance) AS distance FROM (
            SELECT row, c, CAST(sum((x.v - y.v) * (x.v - y.v)) AS BIGINT) AS distance
            FROM parts x JOIN centre{k} y USING (dim) GROUP BY row, c)
        GROUP BY row)"""
_MOVE = """,
    centre{next} AS (
        SELECT c, dim, coalesce(m, v) AS v FROM centre{k} LEFT JOIN (
            SELECT c, dim, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*)) AS BIGINT) AS m
            FROM near{k} JOIN parts USING (row) GROUP BY c, dim) USING (c, dim)),"""

CHECKS["op13_centroid_clustering"] = """
WITH kept AS (
        SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), ints) AS row, vec_id, ints
        FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints
              FROM embeddings WHERE len(embedding) = 64
                AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = 64)),
    parts AS (SELECT row, unnest(range(64)) AS dim, unnest(ints) AS v FROM kept),
    centre0 AS (SELECT row - 1 AS c, dim, v FROM parts WHERE row <= 16),""" + "".join(
    _ROUND.format(k=k) + _MOVE.format(k=k, next=k + 1) for k in range(3)) + _ROUND.format(k=3) + """,
    names AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM centre3 GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
    CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM kept JOIN near3 USING (row) JOIN names USING (c)
"""
