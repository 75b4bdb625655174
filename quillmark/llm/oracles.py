"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

import math

from quillmark.llm import licenses, mixing, secrets


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The contract's pattern with both cases spelled out: the SQL engine folds more letters than A-Z.
_EITHER = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
_ASSIGN = quoted(_EITHER + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = quoted(rf"AKIA[A-Z0-9]{{{secrets.ACCESS_LEAST - 4},}}")
_HEX = quoted(rf"[0-9a-f]{{{secrets.HEX_LEAST},}}")
_CANDIDATE = quoted(secrets.CANDIDATE)
_MOST = {k: (math.log2(secrets.WINDOW) - bits) * secrets.WINDOW + 1e-5 for k, bits in secrets.LEAST_BITS.items()}
_ALLOWED = " OR ".join(f"regexp_matches(m, {quoted(p)})" for p in secrets.ALLOWED)

SECRETS = rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 raw AS (SELECT doc_id, 0 AS rank, 'assign' AS kind, string_split_regex(text, {_ASSIGN}) AS p, regexp_extract_all(text, {_ASSIGN}) AS x, regexp_extract_all(text, {_ASSIGN}, 2) AS g, {secrets.ASSIGN_LEAST} AS least FROM t
  UNION ALL SELECT doc_id, 1, 'access', string_split_regex(text, {_ACCESS}), regexp_extract_all(text, {_ACCESS}), regexp_extract_all(text, {_ACCESS}), {secrets.ACCESS_LEAST} FROM t
  UNION ALL SELECT doc_id, 2, 'hex', string_split_regex(text, {_HEX}), regexp_extract_all(text, {_HEX}), regexp_extract_all(text, {_HEX}), {secrets.HEX_LEAST} FROM t
  UNION ALL SELECT doc_id, 3, 'entropy', string_split_regex(text, {_CANDIDATE}), regexp_extract_all(text, {_CANDIDATE}), regexp_extract_all(text, {_CANDIDATE}), {secrets.WINDOW} FROM t),
 each AS (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM raw),
 pos AS (SELECT doc_id, rank, kind, x[i] AS m, coalesce(list_sum(list_transform(p[1:i], lambda z: length(z))), 0) + coalesce(list_sum(list_transform(x[1:i - 1], lambda z: length(z))), 0) AS s FROM each WHERE length(g[i]) >= least),
 spans AS (SELECT doc_id, rank, kind, m, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e FROM pos),
 wins AS (SELECT doc_id, s, m, k, substr(m, k, {secrets.WINDOW}) AS win FROM (SELECT *, unnest(range(1, length(m) - {secrets.WINDOW} + 2)) AS k FROM spans WHERE rank = 3)),
 chars AS (SELECT doc_id, s, m, k, substr(win, CAST(j AS INTEGER), 1) AS c FROM (SELECT *, unnest(range(1, {secrets.WINDOW} + 1)) AS j FROM wins)),
 counts AS (SELECT doc_id, s, m, k, c, count(*) AS n FROM chars GROUP BY ALL),
 sums AS (SELECT doc_id, s, m, k, sum(n * log2(n)) AS v FROM counts GROUP BY ALL),
 best AS (SELECT doc_id, s, m, min(v) AS v FROM sums GROUP BY ALL),
 random AS (SELECT doc_id, s FROM best WHERE NOT ({_ALLOWED}) AND v <= CASE WHEN regexp_full_match(m, '[0-9a-fA-F]+') THEN {_MOST["hex"]} WHEN regexp_full_match(m, '[A-Za-z0-9]+') THEN {_MOST["alnum"]} ELSE {_MOST["base64"]} END),
 base AS (SELECT * FROM spans WHERE rank < 3),
 new AS (SELECT c.* FROM spans c JOIN random r ON c.doc_id = r.doc_id AND c.s = r.s WHERE c.rank = 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s < c.e AND c.s < b.e)),
 joined AS (SELECT * FROM base UNION ALL SELECT * FROM new),
 said AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS a, count(*) FILTER (WHERE rank = 1) AS k, count(*) FILTER (WHERE rank = 2) AS h, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE rank < 3) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS n FROM joined GROUP BY doc_id)
 SELECT t.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(n, '') AS spans FROM t LEFT JOIN said ON t.doc_id = said.doc_id"""

_TEMPLATES = ", ".join(f"({k}, {quoted(name)}, {quoted(text)})" for k, (name, text) in enumerate(licenses.TEMPLATES))
_TRIGGER = quoted(licenses.TRIGGER)
_TERM = quoted(r"[a-z0-9]+(?:\.[0-9]+)*")

LICENSES = rf"""WITH flagged AS (SELECT doc_id, coalesce(source, 'none') AS d1, coalesce(lang, 'none') AS d2, CAST(floor(doc_id / 1000) AS BIGINT) AS d3, coalesce(text, '') AS text, coalesce(regexp_matches(string_split(text, chr(10))[-1], {_TRIGGER}), false) AS closes FROM documents),
 files AS (SELECT doc_id, text, closes, d1, d1 || '/' || d2 AS d2, d1 || '/' || d2 || '/' || d3 AS d3, CASE WHEN closes THEN ((doc_id % 3) + 3) % 3 + 1 ELSE 3 END AS depth FROM flagged),
 placed AS (SELECT *, CASE depth WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS dir FROM files),
 units AS (SELECT doc_id, row_number() OVER () AS n, regexp_extract_all(lower(s), {_TERM}) AS words FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10))) AS s FROM placed UNION ALL SELECT doc_id, text FROM placed WHERE closes) WHERE regexp_matches(s, {_TRIGGER})),
 tpl(template, license, text) AS (VALUES {_TEMPLATES}),
 ttf AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest(regexp_extract_all(lower(text), {_TERM})) AS term FROM tpl) GROUP BY ALL),
 total AS (SELECT (SELECT count(*) FROM units WHERE len(words) > 0) + {len(licenses.TEMPLATES)} AS n),
 tf AS (SELECT doc_id, n AS unit, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(words) AS term FROM units) GROUP BY ALL),
 seen AS (SELECT term, count(*) AS c FROM tf WHERE term IN (SELECT term FROM ttf) GROUP BY term UNION ALL SELECT term, 1 FROM ttf),
 idf AS (SELECT term, ln((n + 1.0) / (d + 1)) + 1 AS idf FROM (SELECT term, sum(c) AS d FROM seen GROUP BY term), total),
 tw AS (SELECT template, license, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS norm FROM ttf JOIN idf USING (term)),
 uw AS (SELECT doc_id, unit, tf.term, tf * coalesce(idf, ln((n + 1) / 2.0) + 1) AS w FROM tf LEFT JOIN idf ON tf.term = idf.term, total),
 un AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM uw GROUP BY unit),
 cos AS (SELECT doc_id, license, round(sum(uw.w * tw.w / tw.norm) / any_value(un.norm), 6) AS score FROM uw JOIN tw USING (term) JOIN un USING (unit) GROUP BY doc_id, unit, template, license),
 ranked AS (SELECT doc_id, license, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) AS rn FROM cos WHERE score >= {licenses.LEAST}),
 own AS (SELECT doc_id, license, score FROM ranked WHERE rn = 1),
 heads AS (SELECT DISTINCT dir, license, score FROM placed JOIN own USING (doc_id) WHERE closes),
 given AS (SELECT dir, license, score FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) AS rn FROM heads) WHERE rn = 1)
 SELECT f.doc_id, f.dir || '/' || f.doc_id || '.txt' AS path, coalesce(o.license, g3.license, g2.license, g1.license) AS license, coalesce(o.score, g3.score, g2.score, g1.score) AS score, CASE WHEN o.license IS NOT NULL THEN 'header' WHEN coalesce(g3.license, g2.license, g1.license) IS NOT NULL THEN 'inherited' END AS origin, CASE WHEN o.license IS NULL THEN coalesce(g3.dir, g2.dir, g1.dir) END AS from_dir
 FROM placed f LEFT JOIN own o ON f.doc_id = o.doc_id LEFT JOIN given g3 ON f.depth = 3 AND f.d3 = g3.dir LEFT JOIN given g2 ON f.depth >= 2 AND f.d2 = g2.dir LEFT JOIN given g1 ON f.d1 = g1.dir"""

_FLAT = mixing.FLATTENING
_share = lambda c: f"(length(text) - length(replace(text, '{c}', ''))) / greatest(length(text), 1)"
_scaled = lambda d, w: f"{w} * t.to_{d} / sum({w}) OVER (PARTITION BY t.{d})"

#: Raking by a recursion of 200 rounds; the factor by the sorted cells, of which those in front have probability one.
MIXING = f"""WITH RECURSIVE t0 AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, text, CAST(ceil(coalesce(length(text), 0) / 4) AS BIGINT) AS n_tokens FROM documents),
 p AS (SELECT doc_id, source, lang, CASE WHEN text IS NULL THEN '(none)' WHEN {_share("|")} > 0.02 THEN 'table' WHEN {_share("#")} + {_share("%")} + {_share("*")} > 0.02 THEN 'noise' WHEN {_share("!")} > 0.02 THEN 'shouting' WHEN length(text) < 1000 THEN 'short' ELSE 'long' END AS topic, n_tokens FROM t0),
 cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n FROM p GROUP BY ALL HAVING sum(n_tokens) > 0),
 ws AS (SELECT source, pow(sum(n), {_FLAT["source"]}) AS raw FROM cells GROUP BY source), wl AS (SELECT lang, pow(sum(n), {_FLAT["lang"]}) AS raw FROM cells GROUP BY lang), wt AS (SELECT topic, pow(sum(n), {_FLAT["topic"]}) AS raw FROM cells GROUP BY topic),
 start AS (SELECT c.*, ws.raw / (SELECT sum(raw) FROM ws) AS to_source, wl.raw / (SELECT sum(raw) FROM wl) AS to_lang, wt.raw / (SELECT sum(raw) FROM wt) AS to_topic, n / (SELECT sum(n) FROM cells) AS w FROM cells c JOIN ws USING (source) JOIN wl USING (lang) JOIN wt USING (topic)),
 rk AS (SELECT 0 AS round, * FROM start UNION ALL SELECT round + 1, source, lang, topic, n, to_source, to_lang, to_topic, {_scaled("topic", "w2")} FROM (SELECT *, {_scaled("lang", "w1")} AS w2 FROM (SELECT *, {_scaled("source", "w")} AS w1 FROM rk t WHERE round < 200) t) t),
 fit AS (SELECT source, lang, topic, n, w, to_source, to_lang, to_topic, w * (SELECT sum(n) FROM cells) / n AS ratio FROM rk WHERE round = 200),
 ranked AS (SELECT *, row_number() OVER f AS j, sum(n) OVER f AS sure, sum(n * ratio) OVER (ORDER BY ratio, source DESC, lang DESC, topic DESC) - n * ratio AS rest, lead(ratio) OVER f AS next FROM fit WINDOW f AS (ORDER BY ratio DESC, source, lang, topic)),
 cut AS (SELECT 0 AS j, 0.5 * (SELECT sum(n) FROM cells) / (SELECT sum(n * ratio) FROM fit) AS factor, (SELECT max(ratio) FROM fit) AS next UNION ALL SELECT j, (0.5 * (SELECT sum(n) FROM cells) - sure) / rest, next FROM ranked WHERE next IS NOT NULL AND rest > 0),
 best AS (SELECT arg_min(factor, j) AS factor FROM cut WHERE factor * next < 1),
 missed AS (SELECT max(x) AS r FROM (SELECT abs(sum(w) - any_value(to_source)) AS x FROM fit GROUP BY source UNION ALL SELECT abs(sum(w) - any_value(to_lang)) FROM fit GROUP BY lang UNION ALL SELECT abs(sum(w) - any_value(to_topic)) FROM fit GROUP BY topic)),
 found AS (SELECT p.*, coalesce(w, 0.0) AS w, coalesce(least(1.0, ratio * factor), 0.5) AS probability FROM p LEFT JOIN fit USING (source, lang, topic), best)
 SELECT doc_id, source, lang, topic, n_tokens, round(w, 9) AS weight, round(probability, 6) AS probability, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)) AS UBIGINT) / 4294967296.0 < probability AS sampled, round(r, 6) AS residual FROM found, missed"""

#: Every row in every order: the step that removes it is the first whose filter it fails.
AUDIT = r"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
 l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
 f AS (SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic, (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
  || (CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
 x(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
 p AS (SELECT a.c || b.c || d.c || e.c || g.c AS o FROM x a, x b, x d, x e, x g WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
 r AS (SELECT f.*, o, list_min(list_transform(list_filter(string_split(fails, ''), lambda c: c <> ''), lambda c: strpos(o, c))) AS gone FROM f, p),
 s AS (SELECT part, o, k, count(*) FILTER (WHERE gone IS NULL OR gone > k) AS kept, count(*) FILTER (WHERE gone = k) AS removed, count(*) FILTER (WHERE gone < k AND contains(fails, o[k])) AS redundant, count(*) FILTER (WHERE fails = o[k]) AS unique_fails, count(*) FILTER (WHERE gone = k AND good = 1) AS good_lost, count(*) FILTER (WHERE gone = k AND toxic = 1) AS toxic_lost FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS k FROM r) GROUP BY part, o, k)
 SELECT part, o AS filter_order, k AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, o[k]) AS BIGINT) AS shapley FROM s"""

def _clusters(rounds: int = 5, k: int = 40) -> str:
    """Every distance in every round: tables a0, a1, ... of the nearest centroid, c0, c1, ... of the centroids' components."""
    total = "CAST(sum(x) AS HUGEINT)"
    parts = [
        """WITH kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)""",
        "v AS (SELECT r, unnest(range(1, 65)) AS i, unnest(v) AS x FROM kept)",
        f"s AS (SELECT v, row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {k})",
        "c0 AS (SELECT c, unnest(range(1, 65)) AS i, unnest(v) AS x FROM s)",
    ]
    for j in range(rounds + 1):
        parts.append(f"d{j} AS (SELECT r, c, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{j} c USING (i) GROUP BY r, c), a{j} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{j} GROUP BY r)")
        if j < rounds:
            parts.append(f"m{j} AS (SELECT c, i, {total} AS t, count(*) AS n FROM a{j} JOIN v USING (r) GROUP BY c, i), c{j + 1} AS MATERIALIZED (SELECT o.c, o.i, CAST(coalesce((t - (((t % n) + n) % n)) // n, o.x) AS BIGINT) AS x FROM c{j} o LEFT JOIN m{j} m ON o.c = m.c AND o.i = m.i)")
    return ",\n ".join(parts) + f"""
 SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
 FROM a{rounds} JOIN kept USING (r) JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c) USING (c)"""


#: Every window of 50 words of every document, by its words.
SUBSTRING = r"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
 wins AS (SELECT r, doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS s FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM t)),
 first AS (SELECT s, min(doc_id) AS f FROM wins GROUP BY s),
 hit AS (SELECT r, i FROM wins JOIN first USING (s) WHERE f < doc_id),
 gone AS (SELECT DISTINCT r, i + unnest(range(0, 50)) AS p FROM hit),
 each AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM t),
 left_over AS (SELECT e.r, count(g.p) AS n, string_agg(word, ' ' ORDER BY e.p) FILTER (WHERE g.p IS NULL) AS k FROM each e LEFT JOIN gone g ON e.r = g.r AND e.p = g.p GROUP BY e.r)
 SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM t LEFT JOIN left_over USING (r)"""

ORACLES = {"op11_substring_dedup": SUBSTRING, "op12_yinyang": _clusters(), "op4_secrets": SECRETS, "op5_mixing": MIXING, "op9_licenses": LICENSES, "op13_filter_audit": AUDIT}
