"""DuckDB SQL that states what the opN_ queries return."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"list_filter(regexp_split_to_array(%s, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_SPACED % _LOWER} AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS sh
  FROM d
), n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, k.b FROM r JOIN both_ways k ON r.b = k.a
)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept
FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""

#: (kind, pattern, group that is measured, its least length)
_SECRETS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
)


def _secret(no: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""
  SELECT doc_id, {no} AS no, '{kind}' AS kind, unnest(regexp_extract_all(t, '{pattern}')) AS m,
    unnest(regexp_extract_all(t, '{pattern}', {group})) AS g, {least} AS least,
    unnest(regexp_split_to_array(t, '{pattern}')[:len(regexp_extract_all(t, '{pattern}'))]) AS p,
    unnest(range(len(regexp_extract_all(t, '{pattern}')))) AS nth
  FROM t"""


OP2 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_secret(n, *x) for n, x in enumerate(_SECRETS))}),
e AS (
  SELECT *, sum(length(p) + length(m)) OVER (PARTITION BY doc_id, no ORDER BY nth) AS stop FROM m
), f AS (
  SELECT doc_id, no, kind, stop - length(m) AS start, kind || ':' || CAST(stop - length(m) AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM e WHERE length(g) >= least
), s AS (
  SELECT doc_id, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
    coalesce(string_agg(span, ',' ORDER BY start, no) FILTER (no < 3), '') AS base, string_agg(span, ',' ORDER BY start, no) AS spans
  FROM f GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN s USING (doc_id)
"""

OP3 = rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, {_SPACED % "t"} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
h AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM h, range(3) AS s(k) GROUP BY doc_id),
c AS (
  SELECT doc_id, lang, t, CAST(len(w) AS BIGINT) AS n_words,
    length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines,
    length(t) - length(replace(t, '!', '')) AS n_shouts,
    length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals,
    length(t) - length(translate(t, '0123456789', '')) AS n_digits
  FROM t JOIN w USING (doc_id) LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, greatest(3000 * n_symbols // greatest(word_chars, 1), 4000 * n_shouts // greatest(word_chars, 1), 1000 * n_capitals // greatest(word_chars, 1),
    1000 * n_digits // greatest(word_chars, 1), 1000 * n_repeat_words // greatest(n_words, 1), 1000 * n_dup_lines // greatest(n_lines, 1)) AS score,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM c
), good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1),
held AS (SELECT DISTINCT lang, t, score FROM f JOIN good USING (doc_id)),
k AS (
  SELECT lang, cutoff, count(*) AS n, count(*) FILTER (score >= cutoff) AS k
  FROM held, unnest([900, 800, 700, 600, 500, 450, 400, 350, 300, 250, 220, 200, 180, 160, 140, 120, 100, 90, 80, 70, 60, 50, 40, 30, 20]) AS s(cutoff)
  GROUP BY lang, cutoff
), p AS (
  SELECT lang, cutoff, k < 0.02 * n AND list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.02) + (n - i) * ln(0.98))))
    <= 0.05 / (SELECT count(DISTINCT coalesce(lang, '')) FROM held) AS passes
  FROM k
), x AS (
  SELECT lang, min(cutoff) AS cutoff FROM p a
  WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.lang IS NOT DISTINCT FROM a.lang AND b.cutoff >= a.cutoff AND NOT b.passes) GROUP BY lang
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(score >= cutoff, false) AS kept, score, CAST(coalesce(cutoff, 1000000) AS BIGINT) AS cutoff
FROM f LEFT JOIN x ON x.lang IS NOT DISTINCT FROM f.lang
"""

OP4 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(replace(role, '\', '\\'), '##', '#\#'), '</', '<\/'), ':', '\:') AS r,
    replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</', '<\/') AS t FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(r) + 2 + length(t) + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP6 = rf"""
WITH RECURSIVE z AS (
  SELECT doc_id, source, CAST(len({_SPACED % "coalesce(text, '')"}) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 13) AS BIGINT) + 1) / (CAST(4503599627370496 AS DOUBLE) + 1)) /
      greatest(0.25, 1 - (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '0123456789#*$%&|<>!', ''))) / greatest(length(coalesce(text, '')), 1)) AS key
  FROM documents
), s AS (
  SELECT source, sum(size) AS n, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1 AS weight FROM z GROUP BY source
), f AS (
  SELECT 0 AS step, source, n, weight, false AS stopped FROM s
  UNION ALL
  SELECT step + 1, source, n, weight, stopped OR 3 * n < weight * level FROM (
    SELECT *, (sum(n) OVER () - sum(CASE WHEN stopped THEN 3 * n ELSE 0 END) OVER ()) / sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER () AS level FROM f
  ) WHERE step < 40
), g AS (
  SELECT source, n, CASE WHEN stopped THEN CAST(3 * n AS DOUBLE) ELSE weight *
    ((sum(n) OVER () - sum(CASE WHEN stopped THEN 3 * n ELSE 0 END) OVER ()) / sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER ()) END AS target
  FROM f WHERE step = 40
), e AS (SELECT *, CASE WHEN n > 0 THEN CAST(floor(target / n) AS BIGINT) ELSE 0 END AS epochs FROM g),
o AS (
  SELECT doc_id, size, n, target, epochs, target - epochs * n AS rest, sum(size) OVER (PARTITION BY z.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM z JOIN e ON z.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target,
  CAST((epochs + CASE WHEN rest > 0 AND upto - size / 2 < rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken,
  CAST(epochs + CASE WHEN rest > 0 AND upto - size / 2 < rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM o
"""

_WORDS = r"list_filter(regexp_split_to_array(%s, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')" % _LOWER

OP7 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
q AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i+9], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)
), k AS (SELECT DISTINCT k FROM q),
v AS (
  SELECT doc_id, k, i, array_to_string(w[i:i+k-1], ' ') AS x
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k)
), m AS (SELECT doc_id, i, k, item_id FROM v JOIN q USING (k, x)),
h AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def _level(k: int, levels: int = 4) -> str:
    """One level of the template tree: shapes of level k - 1 with their parents' purity in, with their own out."""
    segment = f"coalesce(shape[{k + 1}], '')" if k < levels - 1 else f"array_to_string(shape[{levels}:], '/')"
    return f"""
a{k} AS (SELECT host, shape, urls, allowed, labelled, prior, template AS parent, {segment} AS segment FROM s{k}),
n{k} AS (
  SELECT *, CASE WHEN count(*) OVER w > 16 AND urls < CAST(0.05 AS DOUBLE) * sum(urls) OVER w AND segment <> '' THEN '*' ELSE segment END AS general
  FROM (SELECT host, parent, segment, sum(urls) AS urls, sum(allowed) AS allowed, sum(labelled) AS labelled, max(prior) AS prior FROM a{k} GROUP BY ALL) WINDOW w AS (PARTITION BY host, parent)
), g{k} AS (
  SELECT *, (allowed + 8 * prior) / (labelled + 8) AS share FROM (SELECT host, parent, general, sum(allowed) AS allowed, sum(labelled) AS labelled, max(prior) AS prior FROM n{k} GROUP BY ALL)
), o{k} AS (SELECT *, lag(allowed) OVER w AS ab, lag(labelled) OVER w AS lb FROM g{k} WINDOW w AS (PARTITION BY host, parent ORDER BY share, general)),
d{k} AS (
  SELECT *, CASE WHEN lb IS NULL THEN 1 WHEN labelled > 0 AND lb > 0 THEN
      CASE WHEN (allowed / labelled - ab / lb) * (allowed / labelled - ab / lb) > CAST(3.8415999999999997 AS DOUBLE) * (((allowed + ab) / (labelled + lb)) * (1 - (allowed + ab) / (labelled + lb)) * (1 / labelled + 1 / lb)) THEN 1 ELSE 0 END
    WHEN (labelled > 0) <> (lb > 0) THEN 1 ELSE 0 END AS apart FROM o{k}
), b{k} AS (SELECT *, sum(apart) OVER (PARTITION BY host, parent ORDER BY share, general ROWS UNBOUNDED PRECEDING) AS branch FROM d{k}),
p{k} AS (SELECT host, parent, general, (sum(allowed) OVER w + 8 * prior) / (sum(labelled) OVER w + 8) AS purity FROM b{k} WINDOW w AS (PARTITION BY host, parent, branch)),
s{k + 1} AS (
  SELECT a.host, a.shape, a.urls, a.allowed, a.labelled, purity AS prior, a.parent || '/' || n.general AS template
  FROM a{k} a JOIN n{k} n ON a.host = n.host AND a.parent = n.parent AND a.segment = n.segment JOIN p{k} p ON p.host = n.host AND p.parent = n.parent AND p.general = n.general
)"""


OP10 = rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT *, CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule,
    string_split(regexp_replace(regexp_replace(path, '^/+', ''), '[0-9]+', '0', 'g'), '/') AS shape
  FROM h
), v AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM r),
c AS (SELECT host, shape, CAST(count(*) AS DOUBLE) AS urls, CAST(count(*) FILTER (ruled = 'allow') AS DOUBLE) AS allowed, CAST(count(ruled) AS DOUBLE) AS labelled FROM v GROUP BY ALL),
e AS (SELECT (coalesce(sum(allowed), 0) + 8) / (coalesce(sum(labelled), 0) + 8) AS overall FROM c),
s0 AS (SELECT *, (sum(allowed) OVER w + 8 * (SELECT overall FROM e)) / (sum(labelled) OVER w + 8) AS prior, '' AS template FROM c WINDOW w AS (PARTITION BY host)),
{",".join(_level(k) for k in range(4))}
SELECT page_id, v.host, path, rule, coalesce(ruled, CASE WHEN prior < 0.2 THEN 'block' ELSE 'allow' END) AS verdict, rtrim(template, '/') AS template, round(prior, 6) AS purity
FROM v JOIN s4 ON v.host = s4.host AND v.shape = s4.shape
"""


def _pii(no: int, kind: str, pattern: str) -> str:
    return f"""
  SELECT doc_id, t, {no} AS no, '{kind}' AS kind, unnest(regexp_extract_all(t, '{pattern}')) AS m,
    unnest(regexp_split_to_array(t, '{pattern}')[:len(regexp_extract_all(t, '{pattern}'))]) AS p,
    unnest(range(len(regexp_extract_all(t, '{pattern}')))) AS nth
  FROM t"""


_PII_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", 0.7, "mail email contact write reach", "example noreply"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR TRY_CAST(x AS HUGEINT) > 255)) = 0", 0.5, "ip address host server login", "version release section"),
    ("card", r"[0-9]([\x20-]?[0-9])+", "length(d) BETWEEN 14 AND 19 AND luhn % 10 = 0", 0.5, "card credit visa mastercard karte carte tarjeta", None),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 10 AND 15", 0.5, "phone call tel mobile telefon", None),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", "length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND rest = 1", 0.6, "iban account konto compte cuenta bank", None),
    ("ssn", "[0-9-]+", "regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND m[1:3] NOT IN ('000', '666') AND m[1:3] < '900' AND m[5:6] <> '00' AND m[8:11] <> '0000'", 0.4, "ssn social security insurance", None),
)


def _list(words: str | None) -> str:
    return "[" + ", ".join(f"'{w}'" for w in (words or "order invoice tracking serial part isbn version ticket").split()) + "]"


OP9 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS ({" UNION ALL ".join(_pii(n, k[0], k[1]) for n, k in enumerate(_PII_KINDS))}),
b AS (
  SELECT doc_id, t, no, kind, m, regexp_replace(m, '[^0-9]', '', 'g') AS d,
    CAST(sum(length(p) + length(m)) OVER (PARTITION BY doc_id, no ORDER BY nth) AS BIGINT) AS stop FROM a
), c AS (
  SELECT *, stop - length(m) AS start,
    list_sum(list_transform(range(1, length(d) + 1), lambda i: CAST(d[length(d) + 1 - i] AS INT) * (2 - i % 2) - CASE WHEN i % 2 = 0 AND CAST(d[length(d) + 1 - i] AS INT) > 4 THEN 9 ELSE 0 END)) AS luhn,
    CASE WHEN no = 4 THEN list_reduce(list_prepend(0, list_transform(string_split(array_to_string(list_transform(string_split(replace(m, ' ', '')[5:] || m[1:4], ''),
      lambda x: CASE WHEN x >= 'A' THEN CAST(ascii(x) - 55 AS VARCHAR) ELSE x END), ''), ''), lambda x: CAST(x AS INT))), lambda x, y: (x * 10 + y) % 97) END AS rest,
    regexp_extract_all(lower(t[greatest(stop - length(m) - 47, 1):stop - length(m)] || ' ' || t[stop + 1:stop + 48]), '[a-z]+') AS near
  FROM b
), e AS (
  SELECT doc_id, no, kind, start, stop,
    CASE no {" ".join(f"WHEN {n} THEN {k[3]} + CASE WHEN list_has_any(near, {_list(k[4])}) THEN 0.3 ELSE 0 END - CASE WHEN list_has_any(near, {_list(k[5])}) THEN 0.3 ELSE 0 END" for n, k in enumerate(_PII_KINDS))} END AS score
  FROM c WHERE CASE no {" ".join(f"WHEN {n} THEN {k[2]}" for n, k in enumerate(_PII_KINDS))} END
), f AS (
  SELECT doc_id, count(*) FILTER (no = 0) AS n_email, count(*) FILTER (no = 1) AS n_ip, count(*) FILTER (no = 2) AS n_card, count(*) FILTER (no = 3) AS n_phone,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no) FILTER (no < 4) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no) AS spans,
    string_agg(format('{{:.2f}}', CAST(score AS DOUBLE)), ',' ORDER BY start, no) AS scores
  FROM e WHERE no < 4 OR score >= 0.6 GROUP BY doc_id
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM documents LEFT JOIN f USING (doc_id)
"""
