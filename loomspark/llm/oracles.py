"""SQL (DuckDB) of the queries that SQL can express. Written from the contracts, by plain means."""

from __future__ import annotations

# The patterns of op10's contract and of its weak candidates, stated here anew.
ACCESS, HEX, OPAQUE, ENDPOINT = "AKIA[A-Z0-9]+", "[0-9a-f]{16,}", "[A-Za-z0-9+/]{32,}", "[a-z]{2,8}://[A-Za-z0-9.:/_-]+"
LEAST_VALUE, LEAST_ACCESS, LEAST_SHORT = 12, 18, 6

_WORDS = "[w FOR w IN string_split_regex(coalesce({}, ''), '[\\x20\\x09-\\x0D]+') IF w <> '']"

OP4 = f"""
WITH docs AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM docs),
starts AS (SELECT *, md5(string_agg(w, ' ') OVER f) AS h, count(*) OVER f = 50 AS whole FROM words
  WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
firsts AS (SELECT h, min(doc_id) AS least FROM starts WHERE whole GROUP BY h),
marked AS (SELECT s.*, coalesce(whole AND least < doc_id, false) AS gone FROM starts s LEFT JOIN firsts USING (h)),
covered AS (SELECT *, bool_or(gone) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS cut FROM marked),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (cut) AS n_removed, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (NOT cut), '') AS k FROM covered GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)
"""

OP7 = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP8 = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
sets AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN [array_to_string(ws[i:i + 2], ' ') FOR i IN range(1, len(ws) - 1)] WHEN len(ws) > 0 THEN [len(ws) || ' ' || array_to_string(ws, ' ') || ' '] ELSE [] END) AS s FROM docs)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN sizes USING (doc_id)
"""


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _named(words: tuple[str, ...], value: str) -> str:
    """Pattern of `word = value`, letters of the words in either case."""
    names = "|".join(_either(w) for w in words)
    return f"""({names})["'']?\\x20*[:=]\\x20*["'']?({value}+)"""


def _spans(pattern: str, group: int = 0) -> str:
    """List of {s, e, v}: running lengths of what lies between matches, and of the matches."""
    m, g = f"regexp_extract_all(text, '{pattern}')", f"string_split_regex(text, '{pattern}')"
    start = f"coalesce(list_sum([length(y) FOR y IN {g}[1:i]]), 0) + coalesce(list_sum([length(y) FOR y IN {m}[1:i - 1]]), 0)"
    return f"[{{'s': ({start})::BIGINT, 'e': ({start} + length({m}[i]))::BIGINT, 'v': length(regexp_extract_all(text, '{pattern}', {group})[i])}} FOR i IN range(1, len({m}) + 1)]"


_TEXT = "{'s': x.s, 'k': %d, 'e': x.e}"
_LISTED = "array_to_string([['assign', 'access', 'hex', 'user', 'short', 'opaque', 'endpoint'][x.k + 1] || ':' || x.s || ':' || x.e FOR x IN list_sort({})], ',')"
_PART = "[1, 0, 1, 0, 1, 1, 2]"
OP10 = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS (SELECT doc_id, text, {_spans(_named(("password", "passwd", "secret", "token", "api_?key"), "[A-Za-z0-9+/_.=-]"), 2)} AS a, {_spans(ACCESS)} AS c, {_spans(HEX)} AS h FROM docs),
based AS (SELECT *, list_concat(list_concat([{_TEXT % 0} FOR x IN a IF x.v >= {LEAST_VALUE}], [{_TEXT % 1} FOR x IN c IF x.v >= {LEAST_ACCESS}]), [{_TEXT % 2} FOR x IN h]) AS base FROM found),
weaker AS (SELECT *, CASE WHEN len(base) > 0 OR contains(text, '://') THEN list_concat(list_concat(list_concat(
  [{_TEXT % 3} FOR x IN {_spans(_named(("user", "username", "login", "client_id"), "[A-Za-z0-9_.@-]"), 2)}],
  [{_TEXT % 4} FOR x IN a IF x.v < {LEAST_VALUE} AND x.v >= {LEAST_SHORT}]), [{_TEXT % 5} FOR x IN {_spans(OPAQUE)}]), [{_TEXT % 6} FOR x IN {_spans(ENDPOINT)}])
  ELSE [{_TEXT % 4} FOR x IN a IF x.v < {LEAST_VALUE} AND x.v >= {LEAST_SHORT}] END AS w FROM based),
weak AS (SELECT * REPLACE ([x FOR x IN w IF len([b FOR b IN base IF b.s < x.e AND x.s < b.e]) = 0] AS w) FROM weaker),
linked AS (SELECT *, [x FOR x IN w IF
  len([b FOR b IN base IF b.s - x.e <= 200 AND x.s - b.e <= 200 AND {_PART}[b.k + 1] <> {_PART}[x.k + 1]]) > 0
  OR len(list_distinct([{_PART}[b.k + 1] FOR b IN list_concat(base, w) IF b.s - x.e <= 200 AND x.s - b.e <= 200 AND {_PART}[b.k + 1] <> {_PART}[x.k + 1]])) >= 2] AS l FROM weak)
SELECT doc_id, len([x FOR x IN base IF x.k = 0])::BIGINT AS n_assign, len([x FOR x IN base IF x.k = 1])::BIGINT AS n_access, len([x FOR x IN base IF x.k = 2])::BIGINT AS n_hex,
  sha256({_LISTED.format("base")}) AS base_sha256, {_LISTED.format("list_concat(base, l)")} AS spans, len(l)::BIGINT AS n_linked FROM linked
"""

def _texts(pattern: str) -> str:
    """List of {s, e, t}: places and texts of a pattern's matches."""
    return f"[{{'s': x.s, 'e': x.e, 't': regexp_extract_all(text, '{pattern}')[i]}} FOR x, i IN {_spans(pattern)}]"


# The patterns of op1's contract.
EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"
_DIGITS = "regexp_replace(x.t, '[^0-9]', '', 'g')"
_LUHN = f"list_sum([CASE WHEN j % 2 = 1 THEN d ELSE d * 2 // 10 + d * 2 % 10 END FOR d, j IN [c::INT FOR c IN string_split(reverse({_DIGITS}), '')]]) % 10 = 0"
BASE_SPANS = f"""
WITH found AS (SELECT doc_id, {_texts(EMAIL)} AS m, {_texts(IP)} AS i, {_texts(CARD)} AS c, {_texts(PHONE)} AS p FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
kept AS (SELECT doc_id, m, [x FOR x IN i IF len([y FOR y IN string_split(x.t, '.') IF y::HUGEINT > 255]) = 0] AS i,
  [x FOR x IN c IF length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}] AS c, [x FOR x IN p IF length({_DIGITS}) BETWEEN 10 AND 15] AS p FROM found),
listed AS (SELECT *, list_sort(list_concat(list_concat([{{'s': x.s, 'k': 0, 'e': x.e}} FOR x IN m], [{{'s': x.s, 'k': 1, 'e': x.e}} FOR x IN i]), list_concat([{{'s': x.s, 'k': 2, 'e': x.e}} FOR x IN c], [{{'s': x.s, 'k': 3, 'e': x.e}} FOR x IN p]))) AS a FROM kept)
SELECT doc_id, len(m)::BIGINT AS n_email, len(i)::BIGINT AS n_ip, len(c)::BIGINT AS n_card, len(p)::BIGINT AS n_phone,
  sha256(array_to_string([['email', 'ip', 'card', 'phone'][x.k + 1] || ':' || x.s || ':' || x.e FOR x IN a], ',')) AS base_sha256 FROM listed
"""

# Targets rise with one level for all sources, up to twice a source's size: the level is the first that the next cap does not stop.
TARGETS = f"""
WITH docs AS (SELECT doc_id, source, len({_WORDS.format("text")})::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS n, [1, 5, 2][1 + row_number() OVER (ORDER BY source NULLS LAST) % 3] AS w FROM docs GROUP BY source),
caps AS (SELECT *, 2 * n / w::DOUBLE AS cap, coalesce(sum(2 * n) OVER before, 0) AS full_, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open_, 1.5::DOUBLE * sum(n) OVER () AS total FROM sources
  WINDOW before AS (ORDER BY 2 * n / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT max((total - full_) / open_) FILTER ((total - full_) / open_ <= cap) AS l FROM caps)
SELECT doc_id, size, n AS source_size, round(least(2 * n::DOUBLE, l * w), 3) AS target FROM docs d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source, level
"""

EDITED = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
beside AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS f, length(text) AS n FROM docs)
SELECT doc_id, n::BIGINT AS n_chars, sha256(substr(text, 1, n - n // 3) || substr(f, 1, n // 3)) AS edited_sha256 FROM beside
"""

ORACLE = {"op4_substring_dedup": OP4, "op7_exact_top_k": OP7, "op8_near_dedup": OP8, "op10_secret_scan": OP10, "personal_data_patterns": BASE_SPANS, "source_mix_targets": TARGETS, "edited_texts": EDITED}
