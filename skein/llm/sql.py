"""DuckDB SQL that says what the queries return, worked out plainly: no index, no prefix, no hashing tricks."""

from __future__ import annotations

from skein.llm import license_scan, quality_rules, url_filter
from skein.llm.shared import LOWER, UPPER

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(_quoted(x) for x in xs) + "]"


NGRAM_JOIN = rf"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=LOW)} AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
d AS (SELECT DISTINCT doc_id, s FROM s), n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM d a JOIN d b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b FROM r JOIN both_ways ON a = reached)
SELECT r.doc_id, coalesce(max(n), 0) AS n_shingles, min(reached) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""


def _url_filter() -> str:
    compiled = [url_filter.compile_pattern(p) for p in url_filter.PATTERNS]
    hit = lambda p: f"regexp_matches({LOW.replace('text', 'url')}, {_quoted(p.regex)})"
    blocks = ", ".join(f"CASE WHEN {hit(p)} THEN {_quoted(p.text)} END" for p in compiled if not p.allow)
    allows = " OR ".join(hit(p) for p in compiled if p.allow) or "false"
    fits = " ".join(
        f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h}{p}'"
        for _, h, p in sorted(url_filter.HOST_RULES, key=lambda r: -len(r[1] + r[2]))
    )
    verdicts = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in url_filter.HOST_RULES)
    return rf"""WITH u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT page_id, host, path, CASE {fits} END AS rule, CASE WHEN NOT coalesce({allows}, false) THEN list_min(list_filter([{blocks}], lambda x: x IS NOT NULL)) END AS pattern FROM p)
SELECT page_id, host, path, rule, pattern, coalesce(CASE rule {verdicts} END, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict FROM m"""


def _license_scan() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    at = []
    for phrase, label in license_scan.PHRASES.items():
        ws = phrase.split()
        here = " AND ".join(f"coalesce(w[i + {k}], '') = '{x}'" for k, x in enumerate(ws))
        at.append(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {here}), lambda i: {{'at': i - 1, 'label': '{label}'}})")
    met = []
    for label, text in license_scan.TEMPLATES:
        ws = license_scan.template_words(text)
        need = license_scan.needed(len(ws), license_scan.THRESHOLD)
        common = f"len(list_intersect(s, {_list(ws)}))"
        met.append(f"CASE WHEN (r = 1 OR size <= {license_scan.SPAN * len(ws)}) AND {common} >= {need} THEN {{'label': '{label}', 'c': {common} / {len(ws)}.0}} END")
    vocabulary = sorted({w for _, text in license_scan.TEMPLATES for w in license_scan.template_words(text)})
    return rf"""WITH t AS (SELECT doc_id, {LOW} AS low FROM documents),
w AS (SELECT doc_id, regexp_extract_all(low, '{word}') AS w FROM t),
b AS (SELECT doc_id, len(w) AS n_words, list_concat({at[0]}, list_concat({at[1]}, {at[2]})) AS b FROM w),
l AS (SELECT doc_id, list_transform(string_split(low, chr(10)), lambda x: regexp_extract_all(x, '{word}')) AS ls FROM t),
v AS (SELECT doc_id, list_transform(ls, lambda x: list_intersect(x, {_list(vocabulary)})) AS vs, list_transform(ls, lambda x: len(x)) AS sizes FROM l),
i AS (SELECT doc_id, vs, sizes, r, unnest(range(1, greatest(1, len(vs) - r + 1) + 1)) AS i FROM v, (VALUES {", ".join(f"({r})" for r in license_scan.RUNS)}) x(r) WHERE r = 1 OR r < 2 * len(vs)),
k AS (SELECT doc_id, r, list_distinct(flatten(vs[i:i + r - 1])) AS s, list_sum(sizes[i:i + r - 1]) AS size FROM i),
m AS (SELECT doc_id, r, unnest([{", ".join(met)}]) AS m FROM k WHERE len(s) > 1),
g AS (SELECT doc_id, list(m.label) AS labels, max(m.c) AS c, count(*) FILTER (r = 1) AS n FROM m WHERE m IS NOT NULL GROUP BY doc_id),
j AS (SELECT b.doc_id, n_words, b, list_transform(b, lambda x: x.label) AS bl, list_transform(b, lambda x: x.at) AS ba, coalesce(labels, []) AS ml, c, coalesce(n, 0) AS n FROM b LEFT JOIN g ON g.doc_id = b.doc_id)
SELECT doc_id, n_words, len(b) AS n_base, list_min(ba) AS first_word, list_max(ba) AS last_word, array_to_string(list_sort(list_distinct(bl)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(bl, ml))), ',') AS labels, CASE WHEN len(b) > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0)::DOUBLE END AS score, n AS n_blocks FROM j"""


def _quality_rules() -> str:
    def js(p: list[str], q: list[float]) -> str:
        part = lambda a, b: f"(CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b!r})) ELSE 0 END + {b!r} * log2(2 * {b!r} / ({a} + {b!r})))"
        return f"sqrt(greatest(0, ({' + '.join(part(a, b) for a, b in zip(p, q, strict=True))}) / 2))"

    shares = [f"(({c}) / chars::DOUBLE)" for c in ("chars - others - capitals", "capitals", "digits", "spaces", "others - spaces - n_symbols - digits", "n_symbols")]
    classes = f"least({', '.join(js(shares, [x / sum(r) for x in r]) for r in quality_rules.CLASS_REFERENCES.values())})"
    refs = sorted(quality_rules.WORD_REFERENCES.items())
    known = sorted({w for _, r in refs for w in r})
    sizes = ", ".join(f"len(list_filter(hits, lambda x: x IN {tuple(r)!r})) AS n_{k}" for k, r in refs)
    best = "greatest(" + ", ".join(f"n_{k}" for k, _ in refs) + ")"
    words = " ".join(
        f"WHEN n_{k} = {best} THEN CASE WHEN n_{k} >= {quality_rules.MIN_COMMON} THEN {js([f'(len(list_filter(hits, lambda x: x = {_quoted(w)})) / n_{k}::DOUBLE)' for w in r], [v / sum(r.values()) for v in r.values()])} END" for k, r in refs
    )
    blank = r"'^[\x20\x09-\x0D]*\z'"
    return rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT *, {WORDS.format(text="text")} AS w, regexp_replace(text, '[\p{{L}}\p{{M}}]+', '', 'g') AS rest FROM t),
a AS (SELECT *, len(w) AS n_words, length(text) AS chars, length(rest) AS others, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS capitals, length(rest) - length(regexp_replace(rest, '[\x20\x09-\x0D]+', '', 'g')) AS spaces,
  length(regexp_replace(rest, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, length(regexp_replace(rest, '\P{{Nd}}+', '', 'g')) AS digits, list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, {blank})) AS ls, list_filter(list_transform(w, lambda x: trim(lower(x), {_quoted(quality_rules.PUNCTUATION)})), lambda x: x IN {tuple(known)!r}) AS hits FROM c),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: w[i:i + 7])) AS g FROM a WHERE len(w) >= 8),
d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS p FROM d, range(8) x(k)) GROUP BY doc_id),
f AS (SELECT a.*, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, {sizes} FROM a LEFT JOIN r ON r.doc_id = a.doc_id),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CASE WHEN chars >= {quality_rules.MIN_CHARS} THEN {classes} END AS cd, CASE {words} END AS wd FROM f)
SELECT doc_id, n_words, chars - spaces AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(cd, 0) <= {quality_rules.MAX_CLASS_DISTANCE} AND coalesce(wd, 0) <= {quality_rules.MAX_WORD_DISTANCE} AS kept FROM v"""


WARC = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to FROM p"""

#: Hex digits stand for bytes: two a byte.
SUFFIX_DEDUP = """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM t WHERE n >= 200)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
g AS (SELECT *, sum(CASE WHEN i <= prev + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM r)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, run),
e AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS nth FROM s),
k AS (SELECT e.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(CASE WHEN nth = 1 THEN left(h, 2 * a) ELSE '' END || substr(h, 2 * b + 1, 2 * (coalesce(next, n) - b)), '' ORDER BY a) AS h FROM e JOIN t ON t.doc_id = e.doc_id GROUP BY e.doc_id)
SELECT t.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, t.h))) AS kept_sha256 FROM t LEFT JOIN k ON k.doc_id = t.doc_id"""

FILL_IN_MIDDLE = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT doc_id, text, w, len(w) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT doc_id, text, w, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, text, n, form, array_to_string(list_slice(w, 1, a), '') AS p, array_to_string(list_slice(w, a + 1, b), '') AS m, array_to_string(list_slice(w, b + 1, n), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""


def _merkle() -> str:
    framed = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda n: "sha256(" + " || ".join(framed(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
    crc = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda x, c: xor(x >> 8, tab[(xor(x, c) & 255)::BIGINT + 1]))"
    above = "(SELECT g, l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM {t} WHERE n > 1 GROUP BY g, l, i // 2, n)"
    return f"""WITH RECURSIVE bits(c, k, x) AS (SELECT c::UBIGINT, 0, c::UBIGINT FROM range(256) r(c) UNION ALL SELECT c, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END FROM bits WHERE k < 8),
crcs AS (SELECT list(x ORDER BY c) AS tab FROM bits WHERE k = 8),
d AS (SELECT doc_id, lang AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, {leaf("n_chars")}) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, {leaf("n_chars")} AS leaf,
  CASE WHEN xor({crc}, 4294967295::UBIGINT) % 7 = 0 THEN {leaf("(n_chars + 1)")} ELSE {leaf("n_chars")} END AS start FROM documents, crcs),
v(g, l, i, h, n) AS (SELECT g, 0, i, leaf, n FROM d UNION ALL {above.format(t="v")}),
s AS (SELECT g, l AS top, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS j, count(*) OVER () AS n FROM v WHERE n = 1),
u(g, l, i, h, n) AS (SELECT 0, 0, j, subroot, n FROM s UNION ALL {above.format(t="u")}),
f(doc_id, i, g, l, pos, h, proof) AS (SELECT doc_id, i, g, 0, i, start, '' FROM d UNION ALL
  SELECT f.doc_id, f.i, f.g, f.l + 1, f.pos // 2, sha256(CASE WHEN f.pos % 2 = 1 THEN b.h || f.h ELSE f.h || coalesce(b.h, '') END), f.proof || coalesce(b.h, '')
  FROM f JOIN s ON s.g IS NOT DISTINCT FROM f.g AND f.l < s.top LEFT JOIN v b ON b.g IS NOT DISTINCT FROM f.g AND b.l = f.l AND b.i = xor(f.pos, 1)),
r(doc_id, i, g, l, pos, h, proof) AS (SELECT f.doc_id, f.i, f.g, 0, s.j, f.h, f.proof FROM f JOIN s ON s.g IS NOT DISTINCT FROM f.g AND f.l = s.top UNION ALL
  SELECT r.doc_id, r.i, r.g, r.l + 1, r.pos // 2, sha256(CASE WHEN r.pos % 2 = 1 THEN b.h || r.h ELSE r.h || coalesce(b.h, '') END), r.proof || coalesce(b.h, '')
  FROM r JOIN (SELECT l, h FROM u WHERE n = 1) x ON r.l < x.l LEFT JOIN u b ON b.l = r.l AND b.i = xor(r.pos, 1))
SELECT d.doc_id, d.leaf, s.subroot, x.h AS root, sha256(r.proof) AS proof_sha256, r.h AS folded_root, r.h = x.h AS verified
FROM d JOIN s ON s.g IS NOT DISTINCT FROM d.g JOIN (SELECT l, h FROM u WHERE n = 1) x ON true JOIN r ON r.g IS NOT DISTINCT FROM d.g AND r.i = d.i AND r.l = x.l"""


SQL = {
    "op2_ngram_join": NGRAM_JOIN,
    "op3_url_filter": _url_filter(),
    "op4_suffix_dedup": SUFFIX_DEDUP,
    "op5_license_scan": _license_scan(),
    "op8_quality_rules": _quality_rules(),
    "op10_warc": WARC,
    "op11_fill_in_middle": FILL_IN_MIDDLE,
    "op12_merkle_manifest": _merkle(),
}
