"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from larkspur.llm import leaks
from larkspur.llm.rules import RULES, STOP_WORDS, SYMBOLS

WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"


def op8() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    held = " AND ".join(f"{name} BETWEEN {least} AND {most}" for name, least, most in RULES)
    return rf"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t, {WORDS} AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
x AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM s)),
r AS (SELECT doc_id, a, b, c FROM x GROUP BY ALL HAVING count(*) > 1),
v AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat FROM x JOIN r USING (doc_id, a, b, c), (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(coalesce(list_sum(list_transform(w, lambda z: length(z))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
  len(lines) AS n_lines, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper,
  len(list_filter(w, lambda z: lower(z) IN ({stop}))) AS n_stop
  FROM s LEFT JOIN v USING (doc_id)),
q AS (SELECT *, word_chars / greatest(n_words, 1)::DOUBLE AS mean_word_chars, n_symbols / greatest(n_words, 1)::DOUBLE AS symbols_per_word,
  n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup_line_share, n_stop / greatest(n_words, 1)::DOUBLE AS stop_word_share,
  n_upper / greatest(word_chars, 1)::DOUBLE AS upper_share,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {held} AS kept FROM q
"""


def op4(depth: int = 2, least: int = 5, short: int = 20, wide: int = 10, cover: float = 0.5) -> str:
    """Lines, leaves and templates by their tokens; d has the texts as given, u each different text once."""
    word = r"[^\x20\x09-\x0D]"
    return rf"""
WITH d AS MATERIALIZED (SELECT doc_id, text, string_split(text, chr(10)) AS raw FROM documents),
u AS MATERIALIZED (SELECT DISTINCT text, raw FROM d WHERE text IS NOT NULL),
l AS MATERIALIZED (SELECT *, len(tokens) AS n, tokens[1:{depth}] AS lead FROM (
  SELECT text, i, regexp_extract_all(regexp_replace(raw[i], '{word}*[0-9]{word}*', '<*>', 'g'), '{word}+') AS tokens
  FROM (SELECT text, raw, unnest(range(1, len(raw) + 1)) AS i FROM u)) WHERE len(tokens) > 0),
v AS MATERIALIZED (SELECT n, lead FROM l GROUP BY ALL HAVING count(DISTINCT text) >= {least}),
e AS MATERIALIZED (SELECT n, lead, tokens, count(DISTINCT text) AS texts FROM l JOIN v USING (n, lead) GROUP BY ALL),
w AS (SELECT n, lead FROM e WHERE n > {depth} GROUP BY ALL HAVING sum(texts) >= {wide} AND count(*) > 1),
p AS MATERIALIZED (SELECT n, lead, tokens, texts, i, tokens[i] AS token FROM (SELECT *, unnest(range({depth} + 1, n + 1)) AS i FROM e JOIN w USING (n, lead)) WHERE tokens[i] <> '<*>'),
c AS (SELECT n, lead, i, token FROM p GROUP BY ALL HAVING sum(texts) >= {least}),
g AS (SELECT n, lead, tokens, list((i, token) ORDER BY i) AS constants FROM p JOIN c USING (n, lead, i, token) GROUP BY ALL),
k AS MATERIALIZED (
  SELECT n, lead, tokens, (tokens, NULL) AS template, CASE WHEN n > {depth} THEN {least} ELSE {short} END AS needed FROM e WHERE texts >= CASE WHEN n > {depth} THEN {least} ELSE {short} END
  UNION ALL SELECT n, lead, tokens, (NULL, (n, lead, constants)), {wide} FROM g WHERE 2 * (len(constants) + len(list_filter(lead, lambda z: z <> '<*>'))) > n),
h AS MATERIALIZED (SELECT text, i, l.n, template, needed FROM l JOIN k ON k.n = l.n AND k.lead = l.lead AND k.tokens = l.tokens),
r AS (SELECT template FROM h GROUP BY template, needed HAVING count(DISTINCT text) >= needed),
hr AS MATERIALIZED (SELECT h.* FROM h JOIN r USING (template)),
s AS (SELECT text FROM (SELECT text, sum(n) AS covered FROM (SELECT DISTINCT text, i, n FROM hr) GROUP BY text) JOIN (SELECT text, sum(n) AS total FROM l GROUP BY text) USING (text) WHERE covered <= {cover} * total),
b AS (SELECT template FROM hr JOIN s USING (text) GROUP BY template, needed HAVING count(DISTINCT text) >= needed),
x AS MATERIALIZED (SELECT DISTINCT text, i, true AS gone FROM hr JOIN b USING (template)),
o AS (SELECT text, count(gone) AS n_removed, string_agg(line, chr(10) ORDER BY i) FILTER (gone IS NULL) AS kept
  FROM (SELECT text, unnest(range(1, len(raw) + 1)) AS i, unnest(raw) AS line FROM u) LEFT JOIN x USING (text, i) GROUP BY text)
SELECT doc_id, CAST(coalesce(len(raw), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o USING (text)
"""


def op10() -> str:
    chars = leaks.PUNCTUATION.replace("'", "''")
    word = r"[^\x20\x09-\x0D]"

    def canonical(source: str, key: str) -> str:
        # No look-behind here: a name takes the end of the name before it, so every second word of one is found the second time.
        named = "coalesce(text, '')"
        for _ in range(2):
            named = rf"regexp_replace({named}, '([\p{{Ll}},;:] )(\p{{Lu}}\p{{L}}*)', '\1' || chr(1) || '\2', 'g')"
        valued = f"lower(translate({named}, '{chars}', ''))"
        return rf"""SELECT CAST({key} AS BIGINT) AS {key}, regexp_extract_all(x, '{word}+') AS v,
  list_transform(regexp_extract_all(y, '{word}+'), lambda z: replace(z, chr(2), '')) AS t
  FROM (SELECT {key}, x, regexp_replace(regexp_replace(' ' || regexp_replace(regexp_replace(x, '{word}*[0-9]{word}*', '<num>', 'g'), chr(1) || '{word}+', '<name>', 'g'),
    '<num> ({"|".join(leaks.UNITS)})([\x20\x09-\x0D])', '<num> <unit>\2', 'g'), '<num> ({"|".join(leaks.UNITS)})$', '<num> <unit>', 'g') AS y
  FROM (SELECT {key}, {valued} AS x FROM {source}))"""

    return rf"""
WITH d AS MATERIALIZED ({canonical("documents", "doc_id")}),
b AS MATERIALIZED ({canonical("benchmark", "item_id")}),
i AS (SELECT item_id, v, t, least(len(t), {leaks.WINDOW}) AS w, unnest(range(1, len(t) - least(len(t), {leaks.WINDOW}) + 2)) AS p FROM b WHERE len(t) >= {leaks.SHORTEST}),
iw AS MATERIALIZED (SELECT item_id, w, p, len(t) - w + 1 AS n_windows, t[p:p + w - 1] AS tw, v[p:p + w - 1] AS vw FROM i
  WHERE len(list_filter(t[p:p + w - 1], lambda z: z NOT IN ('<num>', '<name>', '<unit>'))) >= least({leaks.LITERALS}, w - 1)),
s AS (SELECT DISTINCT w FROM iw),
dw AS (SELECT doc_id, w, q, t[q:q + w - 1] AS tw, v[q:q + w - 1] AS vd FROM (SELECT doc_id, v, t, w, unnest(range(1, len(t) - w + 2)) AS q FROM d, s)),
m AS MATERIALIZED (SELECT doc_id, item_id, q - p AS shift, p, n_windows, w, iw.tw, vw, vd FROM dw JOIN iw USING (w, tw)),
x AS (SELECT DISTINCT doc_id, item_id, shift, vw[k] AS a, vd[k] AS z FROM (SELECT *, unnest(range(1, w + 1)) AS k FROM m) WHERE tw[k] IN ('<num>', '<name>', '<unit>')),
c AS (SELECT doc_id, item_id, shift, count(*) = count(DISTINCT a) AND count(*) = count(DISTINCT z) AS fits, bool_or(a <> z) AS changed FROM x GROUP BY ALL),
g AS (SELECT doc_id, item_id, CAST(max(n_windows) AS BIGINT) AS n_windows, CAST(count(DISTINCT p) AS BIGINT) AS n_held, bool_or(coalesce(fits AND changed, false)) AS reparameterised
  FROM m LEFT JOIN c USING (doc_id, item_id, shift) WHERE coalesce(fits, true) OR vw = vd GROUP BY doc_id, item_id)
SELECT * FROM g WHERE n_held >= {leaks.SHARE} * n_windows AND n_held >= least({leaks.LEAST}, n_windows)
"""


def op2(window: int = 200) -> str:
    """Texts as hexadecimal digits, two for each byte; x holds every window, c the covered bytes."""
    return f"""
WITH d AS MATERIALIZED (SELECT CAST(doc_id AS BIGINT) AS doc_id, hex(encode(coalesce(text, ''))) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
x AS MATERIALIZED (SELECT doc_id, i, md5(substr(t, 2 * i + 1, {2 * window})) AS h FROM (SELECT doc_id, t, unnest(range(0, n - {window - 1})) AS i FROM d)),
r AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
s AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > {window}, true) AS fresh FROM x JOIN r USING (h)),
g AS (SELECT doc_id, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM s),
c AS MATERIALIZED (SELECT doc_id, span, min(i) AS a, max(i) + {window} AS b FROM g GROUP BY ALL),
k AS (SELECT d.doc_id, t, n, span, a, b, coalesce(lag(b) OVER (PARTITION BY d.doc_id ORDER BY span), 0) AS last FROM d LEFT JOIN c ON c.doc_id = d.doc_id),
o AS (SELECT doc_id, n, coalesce(sum(b - a), 0) AS n_removed, count(span) AS n_spans,
  CASE WHEN count(span) = 0 THEN any_value(t) ELSE string_agg(substr(t, 2 * last + 1, 2 * (a - last)), '' ORDER BY span) || substr(any_value(t), 2 * max(b) + 1) END AS kept FROM k GROUP BY doc_id, n)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM o
"""


def op3(size: int = 4, similarity: int = 80) -> str:
    """All pairs with a shingle in common; fine for small tables only."""
    return rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT CAST(doc_id AS BIGINT) AS doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + {size - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {size - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {similarity} * (x.n + y.n - k)),
c(a, b) AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS least FROM c GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(least, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(least, d.doc_id)) AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op5(window: int = 35) -> str:
    return rf"""
WITH d AS MATERIALIZED (SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + {window - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM d)),
r AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
c AS MATERIALIZED (SELECT DISTINCT doc_id, i + k AS i, true AS gone FROM (SELECT doc_id, i FROM x JOIN r USING (h)), (SELECT unnest(range(0, {window})) AS k)),
o AS (SELECT doc_id, i, word, gone FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) LEFT JOIN c USING (doc_id, i)),
g AS (SELECT doc_id, count(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone IS NULL) AS kept FROM o GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""
