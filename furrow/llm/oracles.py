"""SQL for the queries that SQL can express."""

from furrow.llm.license_texts import NOTICES, SPELLINGS, TEXTS
from furrow.llm.licenses import COPYRIGHT_LINE, LIST_ITEM, OPENINGS, OWNER, SEPARATORS
from furrow.llm.rules import STOP_WORDS

ORACLES: dict[str, str] = {}

ORACLES["op1_exact_dedup"] = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
             sha256(coalesce(text, '')) AS text_sha256
      FROM documents WINDOW w AS (PARTITION BY coalesce(text, '')))
"""

# Verdict of the threshold table, over the counts of one text.
_RULES_SQL = """NOT (
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words
    OR NOT (word_chars::DOUBLE / greatest(n_words, 1) BETWEEN 2 AND 15)
    OR n_symbols::DOUBLE / greatest(n_words, 1) > 0.1
    OR n_exclamations::DOUBLE / greatest(n_words, 1) > 0.5
    OR (n_words >= 30 AND n_stop_words < 2)
    OR n_dup_lines::DOUBLE / greatest(n_lines, 1) > 0.3
    OR n_lines::DOUBLE / greatest(n_words, 1) > 0.5)"""

_STOP_LIST = "[" + ", ".join(f"'{word}'" for word in STOP_WORDS) + "]"

COUNTS_SQL = f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
listed AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^ \\t\\n\\x0B\\x0C\\r]+') AS w,
         [l FOR l IN string_split(t, chr(10))
          IF regexp_matches(l, '[^ \\t\\n\\x0B\\x0C\\r]')] AS lines FROM texts),
windows AS (
  SELECT r, i, list_slice(w, i, i + 4) AS five
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM listed WHERE len(w) >= 5)),
doubled AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS n FROM windows)
  WHERE n > 1),
covered AS (
  SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM doubled)
  GROUP BY r),
counted AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclamations,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         len(list_intersect(list_distinct(w), {_STOP_LIST})) AS n_stop_words,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM listed LEFT JOIN covered USING (r))
"""

ORACLES["op2_quality_rules"] = COUNTS_SQL + f"""
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines,
       n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       {_RULES_SQL} AS kept, n_lines, n_exclamations, n_stop_words
FROM counted
"""

# DuckDB has no base32: the digest's bits in groups of five, out of the hex digits.
ORACLES["op4_archive_conversion"] = """
WITH paged AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages),
digests AS (
  SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
           (CAST('0x' || substr(hex, 1 + (k * 5) // 4, 2) || '0' AS INTEGER)
            >> (7 - (k * 5) % 4)) & 31 AS INTEGER), 1), '' ORDER BY k) AS b32
  FROM (SELECT DISTINCT hex FROM paged), range(32) AS t(k) GROUP BY hex),
firsts AS (SELECT page_id, h, hex, min(page_id) OVER (PARTITION BY h) AS first_id FROM paged)
SELECT page_id, strlen(h) AS payload_bytes, b32 AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM firsts JOIN digests USING (hex)
"""

ORACLES["op8_source_mixing"] = """
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\x0C\\r]+')) AS size
  FROM documents),
marked AS (
  SELECT doc_id, source, size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(t)) AS mark,
         1 / (1 + 20 * length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::DOUBLE
                  / greatest(length(t), 1)) AS quality
  FROM docs),
keyed AS (
  SELECT *, -ln((CAST('0x' || substr(mark, 1, 13) AS BIGINT)::DOUBLE + 0.5)
                / 4503599627370496) / quality AS key FROM marked),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighted AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS most,
         ([3.0, 1.0, 2.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE
           AS weight FROM sizes),
filled AS (
  SELECT *, coalesce(sum(most) OVER o, 0) AS most_before,
         coalesce(sum(weight) OVER o, 0) AS weight_before, sum(source_size) OVER () AS total,
         sum(weight) OVER () AS all_weight FROM weighted
  WINDOW o AS (ORDER BY most / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT *, (1.5::DOUBLE * total - most_before) / (all_weight - weight_before) AS level
  FROM filled),
targets AS (
  SELECT source, source_size, least(most, weight * (
           SELECT min_by(level, most / weight) FROM levels WHERE level <= most / weight)) AS target
  FROM levels),
planned AS (
  SELECT k.*, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
         coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, mark
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + (before + size / 2 <= target - epochs * source_size)::BIGINT))::BIGINT
         AS taken FROM planned
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(line: str) -> str:
    words = f"' ' || regexp_replace({line}, '{SEPARATORS}', ' ', 'g') || ' '"
    for variant, standard in SPELLINGS:
        words = f"replace({words}, ' {variant} ', ' {standard} ')"
    return (f"CASE WHEN regexp_matches({line}, '{COPYRIGHT_LINE}') "
            f"AND NOT regexp_matches({line}, '{LIST_ITEM}') THEN '' ELSE trim({words}) END")


# A mark before every opening cuts the line; the cut takes the rest of its piece, so what a pattern
# only looks at may be taken with it.
_OWNER_SQL = OWNER.replace("(?=", "(")
_PIECES_SQL = (f"string_split(regexp_replace(lower(line), '\\b{OPENINGS}', chr(57344) || '\\1', 'g'), "
               "chr(57344))")
_OWNERLESS_SQL = (f"array_to_string([regexp_replace(x, '{_OWNER_SQL}[^\\n]*$', ' ') "
                  "FOR x IN p[:-2]], '') || p[-1]")


def _values(pairs) -> str:
    return ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in pairs)


ORACLES["op6_license_scan"] = f"""
WITH texts AS (
  SELECT 'd' AS kind, row_number() OVER () AS r, doc_id, NULL AS license_id,
         coalesce(text, '') AS t FROM documents
  UNION ALL SELECT 'k', -row_number() OVER (), NULL, column0, column1
  FROM (VALUES {_values(TEXTS)}) AS v(column0, column1)
  UNION ALL SELECT 'n', -1000 - row_number() OVER (), NULL, column0, column1
  FROM (VALUES {_values(NOTICES)}) AS v(column0, column1)),
lines AS (
  SELECT r, k, {_canonical_sql("line")} AS c FROM (
    SELECT r, k, {_OWNERLESS_SQL} AS line FROM (
      SELECT r, k, {_PIECES_SQL} AS p FROM (
        SELECT r, unnest(string_split(t, chr(10))) AS line,
               unnest(range(len(string_split(t, chr(10))))) AS k FROM texts)))),
wholes AS (
  SELECT kind, r, doc_id, license_id, sha256(coalesce(whole, '')) AS digest
  FROM texts LEFT JOIN (
    SELECT r, string_agg(c, ' ' ORDER BY k) AS whole FROM lines WHERE c <> '' GROUP BY r) USING (r)),
known AS (SELECT digest, min(license_id) AS license_id FROM wholes WHERE kind = 'k' GROUP BY 1),
noted AS (SELECT digest, min(license_id) AS license_id FROM wholes WHERE kind = 'n' GROUP BY 1),
notices AS (
  SELECT r, string_agg(license_id, ',' ORDER BY license_id) AS notice_ids FROM (
    SELECT DISTINCT r, n.license_id FROM lines JOIN noted n ON sha256(c) = n.digest
    WHERE c <> '') GROUP BY r)
SELECT doc_id, w.digest AS canonical_sha256, known.license_id,
       coalesce(notice_ids, '') AS notice_ids
FROM wholes w LEFT JOIN known ON w.digest = known.digest LEFT JOIN notices USING (r)
WHERE kind = 'd'
"""


# ---- vector codes: rounds written out, every part against every entry --------------------------

_KEPT_SQL = """
kept AS (
  SELECT row_number() OVER () AS r, vec_id, label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS (
  SELECT r, p, list_slice(v, p * (len(v) // 16) + 1, (p + 1) * (len(v) // 16)) AS x
  FROM kept, range(16) AS t(p)),
firsts AS (
  SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept),
book0 AS (SELECT p, e, x AS y FROM parts JOIN firsts USING (r) WHERE e < 64)"""


def _assigned(step: int) -> str:
    return f"""
near{step} AS (
  SELECT r, p, x, min(struct_pack(d := d, e := e)) AS best FROM (
    SELECT r, p, x, e, list_sum([(x[i] - y[i]) * (x[i] - y[i]) FOR i IN range(1, len(x) + 1)])
                         ::BIGINT AS d
    FROM parts JOIN book{step} USING (p))
  GROUP BY r, p, x)"""


def _moved(step: int) -> str:
    return f"""
mean{step} AS (
  SELECT p, e, list(floor_mean ORDER BY i) AS y FROM (
    SELECT p, best.e AS e, i,
           ((sum(x[i]) - (((sum(x[i]) % count(*)) + count(*)) % count(*))) // count(*))::BIGINT
             AS floor_mean
    FROM (SELECT p, best, x, unnest(range(1, len(x) + 1)) AS i FROM near{step})
    GROUP BY p, best.e, i) GROUP BY p, e),
book{step + 1} AS (
  SELECT p, e, coalesce(m.y, b.y) AS y FROM book{step} b LEFT JOIN mean{step} m USING (p, e))"""


ORACLES["op12_vector_codes"] = f"""
WITH {_KEPT_SQL}, {_assigned(0)}, {_moved(0)}, {_assigned(1)}, {_moved(1)}, {_assigned(2)},
whole AS (
  SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256
  FROM book2),
coded AS (
  SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code,
         sum(best.d)::BIGINT AS error FROM near2 GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       codebooks_sha256
FROM coded JOIN kept USING (r), whole
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms_sql(table: str, key: str) -> str:
    return f"""
  SELECT {key}, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM {table}"""


ORACLES["op13_ranked_search"] = f"""
WITH words AS ({_terms_sql("documents", "doc_id")}),
counted AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counted GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sizes),
damped AS (SELECT doc_id, 25 + (75 * n * docs) // total AS m FROM sizes, whole),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), whole),
asked AS (SELECT item_id, term, count(*) AS times FROM ({_terms_sql("benchmark", "item_id")})
          GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counted USING (term) JOIN damped USING (doc_id)
  GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank
  FROM scored WHERE score > 0)
WHERE rank <= 10
"""
