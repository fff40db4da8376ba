"""SQL for those registered queries that SQL can express, written for DuckDB."""

from __future__ import annotations

from helixmill.llm.license_scan import COPYRIGHT_LINE, MAYBE_NOTICE, SPELLINGS, STEMS, known_texts
from helixmill.llm.pii import BASE_KINDS, CONTEXT, CONTEXT_CHARS, EXTRA_KINDS, IBAN
from helixmill.llm.quality_rules import CLASS_REFERENCES, MAX_CLASS_DISTANCE, MAX_COMMON_DISTANCE, MAX_REPEAT_PERCENT, MAX_UNCASED_PERCENT, MIN_CHARS_FOR_CLASSES, MIN_WORDS, MIN_WORDS_FOR_COMMON, WORD_REFERENCES
from helixmill.llm.source_divergence import MIN_DOCS, SCALE, SMOOTHING, TOP
from helixmill.llm.suffix_dedup import PASSAGE, WIDTH
from helixmill.llm.url_filter import BASE_RULES, LOWER, PATTERN_RULES, UPPER

quoted = lambda x: "'" + x.replace("'", "''") + "'"
low = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"

PLAIN_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(low("coalesce(text, '')"))
OP1 = f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, unnest(range(0, n - {WIDTH} + 1)) AS p, h FROM d WHERE n >= {WIDTH}),
w AS (SELECT doc_id, p, md5(substr(h, CAST(2 * p + 1 AS BIGINT), {2 * WIDTH})) AS w FROM p),
often AS (SELECT w FROM w GROUP BY w HAVING count(*) > 1),
again AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM w SEMI JOIN often USING (w)),
island AS (SELECT doc_id, p, sum(CASE WHEN gap IS NULL OR gap > {WIDTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM again),
run AS (SELECT doc_id, k, min(p) AS a, max(p) + {WIDTH} AS b FROM island GROUP BY doc_id, k),
gone AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM run GROUP BY doc_id),
cut AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS b FROM run UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(n) FROM d LEFT JOIN run ON run.doc_id = d.doc_id GROUP BY d.doc_id),
kept AS (SELECT cut.doc_id, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY a, b) AS h FROM cut JOIN d ON d.doc_id = cut.doc_id GROUP BY cut.doc_id),
sw AS (SELECT doc_id, {PLAIN_WORDS} AS words FROM documents),
sp AS (SELECT doc_id, words, unnest(range(1, len(words) - {PASSAGE} + 2)) AS p FROM sw WHERE len(words) >= {PASSAGE}),
ss AS (SELECT doc_id, p, md5(array_to_string(list_slice(words, p, p + {PASSAGE} - 1), ' ')) AS w FROM sp),
common AS (SELECT w FROM ss GROUP BY w HAVING count(DISTINCT doc_id) > 1),
sn AS (SELECT doc_id, count(DISTINCT x) AS n_shared_words FROM (SELECT doc_id, unnest(range(p, p + {PASSAGE})) AS x FROM ss SEMI JOIN common USING (w)) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256, coalesce(n_shared_words, 0) AS n_shared_words
FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN sn ON sn.doc_id = d.doc_id"""

OP8 = f"""WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {PLAIN_WORDS} AS words FROM benchmark),
iw AS (SELECT item, least(len(words), 10) AS l, words, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS q FROM i WHERE len(words) > 0),
windows AS (SELECT item, l, q, array_to_string(list_slice(words, q, q + l - 1), ' ') AS w FROM iw),
d AS (SELECT doc_id, {PLAIN_WORDS} AS words FROM documents),
dp AS (SELECT doc_id, l, words, unnest(range(1, len(words) - l + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT l FROM windows) WHERE len(words) >= l),
dw AS (SELECT doc_id, l, p, array_to_string(list_slice(words, p, p + l - 1), ' ') AS w FROM dp),
met AS (SELECT doc_id, item, q, p, dw.l FROM dw JOIN windows ON windows.l = dw.l AND windows.w = dw.w),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS x FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id),
steps AS (SELECT doc_id, item, p - q AS diagonal, p, l, p - row_number() OVER (PARTITION BY doc_id, item, p - q ORDER BY p) AS k FROM met),
longest AS (SELECT doc_id, max(size) AS longest_match FROM (SELECT doc_id, max(p) - min(p) + max(l) AS size FROM steps GROUP BY doc_id, item, diagonal, k) GROUP BY doc_id)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest_match, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id LEFT JOIN longest ON longest.doc_id = d.doc_id"""

HOST, PATH = (f"coalesce({x}, '')" for x in (low(r"regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)"), r"regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"))
OP10 = f"""WITH rules AS (SELECT * FROM (VALUES {', '.join(f"('{r.name}', '{r.name.partition('/')[0]}', '/{r.name.partition('/')[2]}', '{r.action}')" for r in BASE_RULES)}) v(rule, rule_host, rule_path, action)),
u AS (SELECT page_id, {HOST} AS host, {PATH} AS path FROM pages),
fit AS (SELECT page_id, rule, action FROM u JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) = 1)
SELECT u.page_id, host, path, rule, coalesce(action, CASE WHEN {' OR '.join(f'regexp_matches(host || path, {quoted(r.pattern)})' for r in PATTERN_RULES)} THEN 'block' ELSE 'allow' END) AS verdict FROM u LEFT JOIN fit ON fit.page_id = u.page_id"""


DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
LUHN = f"list_sum(list_transform(range(length({DIGITS})), lambda i: (CAST(substr(reverse({DIGITS}), i + 1, 1) AS INTEGER) * (1 + i % 2)) // 10 + (CAST(substr(reverse({DIGITS}), i + 1, 1) AS INTEGER) * (1 + i % 2)) % 10)) % 10 = 0"
TURNED = "substr(replace(x, ' ', ''), 5) || substr(replace(x, ' ', ''), 1, 4)"
MOD97 = f"list_reduce(list_transform(string_split({TURNED}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda a, v: (a * CASE WHEN v < 10 THEN 10 ELSE 100 END + v) % 97, 0) = 1"
#: A kind's leftmost matches (runs of a class are whole, so they need no look around), and what confirms one, x.
PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || right(ltrim(p, '0'), 3) AS INTEGER) > 255)) = 0"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({DIGITS}) BETWEEN 13 AND 19 AND {LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({DIGITS}) BETWEEN 9 AND 15"),
    "iban": (rf"\b{IBAN}\b", MOD97),
    "secret": (r"[A-Za-z0-9_/+=-]{20,}", "regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]')"),
    "ssn": (r"[0-9-]+", "regexp_full_match(x, '[0-9]{3}-[0-9]{2}-[0-9]{4}')"),
}


def spans_sql(number: int, kind: str) -> str:
    pattern, confirmed = PII[kind]
    near = f"substr(t, greatest(a - {CONTEXT_CHARS}, 0) + 1, least(a, {CONTEXT_CHARS})) || ' ' || substr(t, a + length(x) + 1, {CONTEXT_CHARS})"
    needs = f" AND regexp_matches({near}, {quoted(CONTEXT[kind])})" if kind in ("secret", "ssn") else ""
    return f"""m{number} AS (SELECT doc_id, t, regexp_extract_all(t, {quoted(pattern)}) AS f, string_split_regex(t, {quoted(pattern)}) AS s FROM d WHERE regexp_matches(t, {quoted(pattern)})),
p{number} AS (SELECT doc_id, t, f[k] AS x, CAST(list_sum(list_transform(s[1:k], lambda y: length(y))) + coalesce(list_sum(list_transform(f[1:k - 1], lambda y: length(y))), 0) AS BIGINT) AS a FROM (SELECT *, unnest(range(1, len(f) + 1)) AS k FROM m{number})),
k{number} AS (SELECT doc_id, {number} AS n, '{kind}' AS kind, CAST(a AS BIGINT) AS a, CAST(a + length(x) AS BIGINT) AS b FROM p{number} WHERE {confirmed}{needs})"""


KINDS = BASE_KINDS + EXTRA_KINDS
KIND_STEPS = ",\n".join(spans_sql(i, k) for i, k in enumerate(KINDS))
OP6 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{KIND_STEPS},
spans AS ({' UNION ALL '.join(f'SELECT * FROM k{i}' for i in range(len(KINDS)))}),
own AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)}, count(*) AS n_spans, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY n, a) AS spans, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY n, a) FILTER (n < {len(BASE_KINDS)}) AS base FROM spans GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans FROM d LEFT JOIN own ON own.doc_id = d.doc_id"""


def canonical_sql(text: str) -> str:
    bare = f"regexp_replace({text}, {quoted(COPYRIGHT_LINE)}, ' ', 'g')"
    out = f"trim(regexp_replace(lower({bare}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for other, kept in STEMS:
        out = f"replace({out}, '{other}', '{kept}')"
    for other, kept in SPELLINGS:
        out = f"regexp_replace({out}, '\\b{other}\\b', '{kept}', 'g')"
    return out


def digest_sql(text: str) -> str:
    return f"(SELECT CASE WHEN c <> '' THEN sha256(c) END FROM (SELECT {canonical_sql(text)} AS c))"


KNOWN_ROWS = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in known_texts())
OP9 = f"""WITH known AS (SELECT sha256(c) AS digest, min(name) AS license FROM (SELECT name, {canonical_sql('text')} AS c FROM (VALUES {KNOWN_ROWS}) v(name, text)) GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS text, {canonical_sql("coalesce(text, '')")} AS c FROM documents),
whole AS (SELECT doc_id, CASE WHEN c <> '' THEN sha256(c) END AS license_digest FROM d),
lines AS (SELECT doc_id, {canonical_sql('line')} AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, {quoted(MAYBE_NOTICE)})),
found AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names FROM lines JOIN known ON digest = sha256(c) WHERE c <> '' GROUP BY doc_id)
SELECT whole.doc_id, license_digest, license, coalesce(n, 0) AS n_notices, coalesce(names, '') AS notice_licenses FROM whole LEFT JOIN known ON digest = license_digest LEFT JOIN found ON found.doc_id = whole.doc_id"""


def divergence_sql(p: list[str], q: list[float]) -> str:
    """Jensen-Shannon distance of share expressions to fixed shares."""
    terms = []
    for x, y in zip(p, q, strict=True):
        m = f"(({x} + {y!r}) / 2)"
        terms.append(f"(CASE WHEN {x} > 0 THEN {x} * log2({x} / {m}) ELSE 0 END + {y!r} * log2({y!r} / {m}))")
    return f"sqrt(greatest(({' + '.join(terms)}) / 2, 0.0))"


SPACE = r"[\x20\x09-\x0D]+"
COMMON = sorted({w for ref in WORD_REFERENCES.values() for w in ref})
CLASSES = ("a", "u", "g", "s", "m")
shares = [f"c_{c}" for c in CLASSES]
word_refs = [([f"w_{COMMON.index(w)}" for w in ref] + [f"greatest(1 - ({' + '.join(f'w_{COMMON.index(w)}' for w in ref)}), 0.0)"], [*ref.values(), 1 - sum(ref.values())]) for ref in WORD_REFERENCES.values()]
OP7 = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{SPACE}'), lambda x: x <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5),
win AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 4), ' ') AS win FROM p),
again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
rep AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS x FROM again) GROUP BY doc_id),
lw AS (SELECT doc_id, lower(rtrim(unnest(words), '.,;:!?')) AS x FROM w),
tally AS (SELECT doc_id, {', '.join(f"count(*) FILTER (x = '{c}') AS k_{i}" for i, c in enumerate(COMMON))} FROM lw GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n, length(t) AS n_chars, length(regexp_replace(t, '{SPACE}', '', 'g')) AS word_chars,
length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols, length(t) - length(regexp_replace(t, '[\\p{{Lo}}\\p{{M}}]+', '', 'g')) AS n_uncased, len(lines) - len(list_distinct(lines)) AS n_dup, coalesce(rep.n, 0) AS n_rep,
(length(t) - length(regexp_replace(t, '\\p{{Ll}}+', '', 'g'))) / greatest(length(t), 1) AS c_a, (length(t) - length(regexp_replace(t, '\\p{{Lu}}+', '', 'g'))) / greatest(length(t), 1) AS c_u,
(length(t) - length(regexp_replace(t, '[0-9]+', '', 'g'))) / greatest(length(t), 1) AS c_g, (length(t) - length(regexp_replace(t, '{SPACE}', '', 'g'))) / greatest(length(t), 1) AS c_s,
(length(t) - length(regexp_replace(t, '[.,;:!?''"()-]+', '', 'g'))) / greatest(length(t), 1) AS c_m,
{', '.join(f'coalesce(k_{i}, 0) / greatest(len(words), 1) AS w_{i}' for i in range(len(COMMON)))}
FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN tally ON tally.doc_id = w.doc_id),
q AS (SELECT *, greatest(1 - ({' + '.join(shares)}), 0.0) AS c_r FROM m),
j AS (SELECT *, least({', '.join(divergence_sql([*shares, 'c_r'], list(ref)) for ref in CLASS_REFERENCES.values())}) AS cd, least({', '.join(divergence_sql(p, q) for p, q in word_refs)}) AS wd, n < {MIN_WORDS} OR 100 * n_rep > {MAX_REPEAT_PERCENT} * n AS failed FROM q)
SELECT doc_id, n AS n_words, word_chars, n_symbols, n_dup AS n_dup_lines, n_rep AS n_repeat_words, failed AS base_failed,
NOT failed AND (100 * n_uncased > {MAX_UNCASED_PERCENT} * n_chars OR NOT (n_chars >= {MIN_CHARS_FOR_CLASSES} AND cd > {MAX_CLASS_DISTANCE}) AND NOT (n >= {MIN_WORDS_FOR_COMMON} AND wd > {MAX_COMMON_DISTANCE})) AS kept, round(cd, 6) AS class_distance, round(wd, 6) AS common_distance FROM j"""

SHARE = f"CAST(1 + CAST({{}} + {SMOOTHING} AS HUGEINT) * {SCALE} // ({{}} + {SMOOTHING} * v) AS BIGINT)"
OP11 = rf"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({low("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT row, lang, source, unnest(words) AS term FROM d),
own AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT row) >= {MIN_DOCS}),
langs AS (SELECT lang, coalesce(sum(lang_n), 0) AS lang_total, count(term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
g AS (SELECT lang, source, v, lang_total, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) JOIN langs USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM own SEMI JOIN kept USING (lang, term) GROUP BY ALL) USING (lang, source)),
cells AS (SELECT g.lang, g.source, term, n, {SHARE.format("coalesce(n, 0)", "total")} AS p, {SHARE.format("lang_n", "lang_total")} AS q FROM g JOIN kept USING (lang) LEFT JOIN own USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS t, CAST(sum(abs(x.p - y.p)) AS BIGINT) AS value FROM cells x JOIN cells y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f ON f.lang = a.lang AND s = a.source AND t = b.source),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pair
UNION ALL SELECT lang, source, 'term', term, p - q, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, encode(term)) FROM cells WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""

#: Right for pages whose markup inside the article is plain: paragraphs, headings, bold text, line breaks.
OP12 = r"""WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1) AS inside FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(inside, '</?(?:p|h[1-6]|div|ul|li|blockquote)(?: [^>]*)?>'), lambda x: trim(regexp_replace(
regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t"""

ORACLES = {"op12_html_extract": OP12, "op11_source_divergence": OP11, "op1_suffix_dedup": OP1, "op6_pii": OP6, "op7_quality_rules": OP7, "op8_decontaminate": OP8, "op9_license_scan": OP9, "op10_url_filter": OP10}
