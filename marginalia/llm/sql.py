"""DuckDB SQL of the queries of this subpackage, and of those columns of op2, op5 and op10 that SQL can express."""

from __future__ import annotations

from marginalia.llm.secret_scan import KINDS

WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _either_case(name: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name)


_ASSIGNED = f"({'|'.join(map(_either_case, ('password', 'passwd', 'secret', 'token', 'api_?key')))})" + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
# kind, pattern, group that is measured, its least length
_BASE = [("assign", _ASSIGNED, 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)]


def _spans(kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one kind; a match begins after the gaps and matches before it."""
    return f"""
        SELECT r, '{kind}' AS kind, {KINDS.index(kind)} AS no, begin, begin + length(m) AS until
        FROM (SELECT r, ms[i] AS m, gs[i] AS g, (coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS begin
              FROM (SELECT r, ms, gs, gaps, unnest(range(1, len(ms) + 1)) AS i
                    FROM (SELECT r, regexp_extract_all(text, '{pattern}', 0) AS ms, regexp_extract_all(text, '{pattern}', {group}) AS gs, string_split_regex(text, '{pattern}') AS gaps FROM t)))
        WHERE length(g) >= {least}"""


SECRET_BASE_SPANS = f"""
    WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
         s AS ({' UNION ALL '.join(_spans(*kind) for kind in _BASE)}),
         n AS (SELECT r, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, *_ in _BASE)}, string_agg(kind || ':' || begin || ':' || until, ',' ORDER BY begin, no) AS spans FROM s GROUP BY r)
    SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k, *_ in _BASE)}, sha256(coalesce(spans, '')) AS base_sha256 FROM t LEFT JOIN n USING (r)"""

MIXING_TARGETS = f"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
         s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place FROM d GROUP BY source),
         c AS (SELECT source, source_size, place, CASE place WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
         f AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
               FROM c WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
         w AS (SELECT max(level) FILTER (cap / weight >= level) AS water FROM f)
    SELECT doc_id, size, source_size, coalesce(least(cap, weight * water), cap) AS target FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source CROSS JOIN w"""

QUALITY_BASE_COUNTS = f"""
    WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
         w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{WORD}') AS ws, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS lines FROM t),
         n AS (SELECT r, i, array_to_string(ws[i:i + 2], ' ') AS words FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
         twice AS (SELECT r, i FROM n QUALIFY count(*) OVER (PARTITION BY r, words) > 1),
         again AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
         b AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                      len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN again USING (r))
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b"""

# one row a distinct set: links between sets are counted with their copies
NGRAM_JACCARD_JOIN = f"""
    WITH RECURSIVE
         w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER}, '{WORD}'), []) AS ws FROM documents),
         s AS (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                                                         ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END)) AS shingles FROM w),
         c AS (SELECT row_number() OVER () AS c, shingles, min(doc_id) AS least, count(*) AS copies FROM s WHERE len(shingles) > 0 GROUP BY shingles),
         x AS (SELECT c, len(shingles) AS n, copies, unnest(shingles) AS shingle FROM c),
         links AS (SELECT a.c AS a, b.c AS b, any_value(b.copies) AS copies FROM x AS a JOIN x AS b ON a.shingle = b.shingle AND a.c <> b.c AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
                   GROUP BY a.c, b.c HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
         reach(a, b) AS (SELECT c, c FROM c UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
         best AS (SELECT reach.a AS c, min(c.least) AS component_id FROM reach JOIN c ON reach.b = c.c GROUP BY reach.a),
         many AS (SELECT a AS c, sum(copies)::BIGINT AS others FROM links GROUP BY a)
    SELECT doc_id, len(s.shingles) AS n_shingles, CASE WHEN c.c IS NULL THEN doc_id ELSE component_id END AS component_id, (coalesce(c.copies - 1, 0) + coalesce(others, 0))::BIGINT AS n_links
    FROM s LEFT JOIN c ON s.shingles = c.shingles LEFT JOIN best ON c.c = best.c LEFT JOIN many ON c.c = many.c"""


def _own_words(column: str) -> str:
    lowered = f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


_FEATURES = "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))"
#: Op11. The table of crc32 is made by its rule; each distinct feature is hashed once.
IMPORTANCE_RESAMPLING = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_own_words('text')} AS w FROM documents),
         b AS (SELECT {_own_words('text')} AS w FROM benchmark),
         fd AS (SELECT r, {_FEATURES} AS f FROM d),
         fb AS (SELECT {_FEATURES} AS f FROM b),
         tab AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t
                 FROM (SELECT unnest(range(256)) AS i)),
         u AS (SELECT DISTINCT f FROM (SELECT f FROM fd UNION ALL SELECT f FROM fb)),
         x AS (SELECT f, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT) AS bytes FROM (SELECT f, hex(f) AS h FROM u)),
         dict AS MATERIALIZED (
             SELECT f, xor(list_reduce(bytes, lambda c, y: xor(c // 256, t[(xor(c % 256, y))::BIGINT + 1]), 4294967295), 4294967295) % 10000 AS k FROM x, tab),
         s AS (SELECT k, count(*) AS s FROM fd JOIN dict USING (f) GROUP BY k),
         t AS (SELECT k, count(*) AS t FROM fb JOIN dict USING (f) GROUP BY k),
         g AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1) * (sa + 10000)::DOUBLE / ((coalesce(s, 0) + 1) * (ta + 10000)::DOUBLE)))::BIGINT AS gain
               FROM s FULL JOIN t USING (k), (SELECT count(*) AS sa FROM fd), (SELECT count(*) AS ta FROM fb)),
         m AS (SELECT r, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight FROM fd JOIN dict USING (f) JOIN g USING (k) GROUP BY r),
         h AS (SELECT r, ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d),
         e AS (SELECT d.r, doc_id, len(w) AS many, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
                      coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score
               FROM d JOIN h USING (r) LEFT JOIN m ON d.r = m.r),
         o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 25 * count(*) OVER () // 100 AS take FROM e WHERE many >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= take THEN rank END AS rank FROM e LEFT JOIN o USING (r)"""


def _rounds() -> str:
    """Op12: the parts assigned to the codebooks, whose entries are then replaced, six times; and assigned once more."""
    steps = []
    for i in range(7):
        steps.append(f"""
         a{i} AS MATERIALIZED (SELECT r, p, e, dist FROM (
             SELECT x.r, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist
             FROM x JOIN b{i} AS b ON x.p = b.p) QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY dist, e) = 1)""")
        if i < 6:
            steps.append(f"""
         b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{i} AS b LEFT JOIN (
             SELECT p, e, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY c) AS v FROM (
                 SELECT a.p, a.e, s.c, sum(x.v[s.c]) AS total, count(*) AS n
                 FROM a{i} AS a JOIN x ON a.r = x.r AND a.p = x.p, (SELECT unnest(range(1, 9)) AS c) AS s GROUP BY ALL) GROUP BY p, e) AS m
             ON b.p = m.p AND b.e = m.e)""")
    return ",".join(steps)


VECTOR_CODES = f"""
    WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
                      list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
         x AS MATERIALIZED (SELECT r, p, v[p * 8 + 1:p * 8 + 8] AS v FROM k, (SELECT unnest(range(8)) AS p)),
         b0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM x WHERE r <= 16),{_rounds()},
         c AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error FROM a6 GROUP BY r),
         l AS (SELECT label, sum(error)::BIGINT AS label_error FROM c JOIN k USING (r) GROUP BY label),
         s AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b6)
    SELECT k.vec_id, code, error, label_error, codebooks_sha256
    FROM k JOIN c USING (r) JOIN l ON k.label IS NOT DISTINCT FROM l.label, s"""

LINE_DEDUP = r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
         l AS (SELECT r, doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
               FROM (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)),
         f AS (SELECT key, min(coalesce(doc_id, 9223372036854775807)) AS first FROM l WHERE length(key) >= 10 GROUP BY key),
         j AS (SELECT l.*, coalesce(coalesce(l.doc_id, 9223372036854775807) <> f.first, false) AS gone FROM l LEFT JOIN f USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM j GROUP BY r, doc_id"""
