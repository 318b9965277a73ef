"""DuckDB SQL for the training-data queries that SQL can express, over whole tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
FOLDED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(sha, {5 * k + 1}, 5))::BIGINT >> {s}) % 32 + 1, 1)" for k in range(8) for s in (15, 10, 5, 0))

WARC = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
     d AS (SELECT page_id, payload_bytes, {_BASE32} AS payload_digest FROM p),
     m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM m
"""

_SHINGLES = """
{name}_w AS (SELECT {key} AS id, regexp_extract_all({folded}, '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
{name} AS (
    SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM {name}_w)"""

_DOCS = _SHINGLES.format(name="s", key="doc_id", table="documents", folded=FOLDED.format("coalesce(text, '')"))
_LOWER_DOCS = _SHINGLES.format(name="s", key="doc_id", table="documents", folded="lower(coalesce(text, ''))")
_ITEMS = _SHINGLES.format(name="b", key="item_id", table="benchmark", folded="lower(coalesce(text, ''))")

JACCARD = f"""
WITH RECURSIVE {_DOCS},
size AS (SELECT id, count(*) AS n FROM s GROUP BY id),
pair AS (SELECT x.id AS a, y.id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN size p ON p.id = a JOIN size q ON q.id = b WHERE 100 * o >= 80 * (p.n + q.n - o)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(id, now) AS (SELECT DISTINCT a, a FROM edge UNION SELECT reach.id, edge.b FROM reach JOIN edge ON edge.a = reach.now)
SELECT d.doc_id, coalesce(size.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(r.low, d.doc_id)) AS component_id
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN size ON size.id = d.doc_id
LEFT JOIN (SELECT id, min(now) AS low FROM reach GROUP BY id) r ON r.id = d.doc_id
"""

CONTAINMENT = f"""
WITH {_LOWER_DOCS}, {_ITEMS},
size AS (SELECT id, count(*) AS n FROM b GROUP BY id),
hit AS (SELECT s.id AS doc_id, b.id AS item, count(*) AS o FROM s JOIN b ON s.g = b.g GROUP BY 1, 2),
held AS (SELECT doc_id, item, o / n AS share FROM hit JOIN size ON size.id = item WHERE 1000 * o >= 800 * n),
listed AS (SELECT doc_id, count(*) AS n, string_agg(item::VARCHAR, ',' ORDER BY item) AS items, max(share) AS share FROM held GROUP BY doc_id)
SELECT d.doc_id, n IS NOT NULL AS contaminated, coalesce(n, 0)::BIGINT AS n_items, coalesce(items, '') AS items, round(coalesce(share, 0.0), 6)::DOUBLE AS containment
FROM documents d LEFT JOIN listed l ON l.doc_id = d.doc_id
"""

QUALITY = r"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
v AS (SELECT row_number() OVER () AS r, * FROM t),
win AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' '))) AS g FROM v),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (SELECT v.r, v.doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines
      FROM v LEFT JOIN cov ON cov.r = v.r),
e AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             1000000 * n_symbols // greatest(word_chars, 1) AS symbol_ppm, 1000000 * n_dup_lines // greatest(n_lines, 1) AS dup_ppm,
             1000000 * n_repeat_words // greatest(n_words, 1) AS repeat_ppm, 10000 * word_chars // greatest(n_words, 1) AS length_e4 FROM m),
y AS (SELECT r, lang, source, base_failed, unnest(['symbol_ppm', 'dup_ppm', 'repeat_ppm', 'length_e4']) AS metric, unnest([symbol_ppm, dup_ppm, repeat_ppm, length_e4]) AS v FROM e),
x AS (SELECT *, 1::BIGINT << greatest(length(bin(v)) - 7, 0) AS width FROM y WHERE NOT base_failed),
g AS (SELECT grouping(lang) + grouping(source) AS level, lang, source, metric, v - v % width AS low, width, count(*) AS c
      FROM x GROUP BY GROUPING SETS ((lang, source, metric, low, width), (lang, metric, low, width), (metric, low, width))),
o AS (SELECT *, sum(c) OVER (PARTITION BY level, lang, source, metric ORDER BY low) * 1000 AS upto, sum(c) OVER (PARTITION BY level, lang, source, metric) AS n FROM g),
q AS (SELECT level, lang, source, metric, n::BIGINT AS n, min(CASE WHEN upto >= n * 990 THEN low + width - 1 END) AS hi,
             CASE WHEN metric = 'length_e4' THEN min(CASE WHEN upto >= n * 10 THEN low END) ELSE -1 END AS lo FROM o GROUP BY level, lang, source, metric, n),
l AS (SELECT q.lang, q.metric, (q.n * q.hi + 100 * c.hi) // (q.n + 100) AS hi, (q.n * q.lo + 100 * c.lo) // (q.n + 100) AS lo
      FROM q JOIN q c ON c.level = 2 AND c.metric = q.metric WHERE q.level = 1),
s AS (SELECT q.lang, q.source, q.metric, (q.n * q.hi + 100 * l.hi) // (q.n + 100) AS hi, (q.n * q.lo + 100 * l.lo) // (q.n + 100) AS lo
      FROM q JOIN l ON l.metric = q.metric AND l.lang IS NOT DISTINCT FROM q.lang WHERE q.level = 0),
k AS (SELECT y.r, bool_and(v BETWEEN lo AND hi) AS within FROM y
      JOIN s ON s.metric = y.metric AND s.lang IS NOT DISTINCT FROM y.lang AND s.source IS NOT DISTINCT FROM y.source GROUP BY y.r)
SELECT e.doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(within, false) AS kept,
       symbol_ppm::BIGINT AS symbol_ppm, dup_ppm::BIGINT AS dup_ppm, repeat_ppm::BIGINT AS repeat_ppm, length_e4::BIGINT AS length_e4
FROM e LEFT JOIN k ON k.r = e.r
"""

_KEY = "('0x' || substr(md5(concat_ws('|', 0, {0})), 1, 15))::BIGINT"
_BLOCK_ORDER = _KEY.format("{0}, coalesce(source, '~'), block")
_DOC_ORDER = _KEY.format("{0}, coalesce(doc_id::VARCHAR, '~'), h")

MIXING = f"""
WITH RECURSIVE m AS (
    SELECT doc_id, source, md5(coalesce(text, '')) AS h, sum(greatest(len({WORDS.format("coalesce(text, '')")}), 1))::BIGINT AS n_tokens FROM documents GROUP BY ALL),
s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM m GROUP BY source),
spent AS (SELECT sum(tokens)::DOUBLE AS budget, max(tokens)::DOUBLE AS most FROM s),
bisected(step, lo, hi) AS (
    SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
    SELECT step + 1, CASE WHEN flat THEN mid ELSE lo END, CASE WHEN flat THEN hi ELSE mid END FROM (
        SELECT step, lo, hi, (lo + hi) / 2 AS mid, max(pow(tokens / most, (lo + hi) / 2 - 1)) / sum(pow(tokens / most, (lo + hi) / 2)) * (max(budget) / max(most)) > 2.0 * (1 + 1e-12) AS flat
        FROM bisected, s, spent WHERE step < 60 GROUP BY step, lo, hi)),
e AS (SELECT hi AS a FROM bisected WHERE step = 60),
w AS (SELECT source, tokens, pow(tokens::DOUBLE, a) / (SELECT sum(pow(tokens::DOUBLE, a)) FROM s, e) AS weight FROM s, e),
t AS (SELECT *, floor(weight * budget + 1e-6)::BIGINT AS target FROM w, spent),
d AS (SELECT m.*, weight, target // tokens AS passes, target % tokens AS rest,
             {_KEY.format("coalesce(doc_id::VARCHAR, '~'), h")} % ceil(tokens / 262144)::BIGINT AS block FROM m JOIN t ON m.source IS NOT DISTINCT FROM t.source),
o AS (SELECT *, {_BLOCK_ORDER.format("passes")} AS bo, {_DOC_ORDER.format("passes")} AS dd FROM d),
u AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY bo, block, dd, doc_id, h) AS upto FROM o),
r AS (SELECT *, unnest(range(0, passes + CASE WHEN upto <= rest THEN 1 ELSE 0 END)) AS epoch FROM u)
SELECT doc_id, source, n_tokens, round(weight, 9) AS weight, epoch, block,
       CASE WHEN epoch = passes THEN bo ELSE {_BLOCK_ORDER.format("epoch")} END AS block_order, CASE WHEN epoch = passes THEN dd ELSE {_DOC_ORDER.format("epoch")} END AS doc_order
FROM r
"""

_TURN = "PARTITION BY conv_id, perspective ORDER BY turn, name, body, head, own"
_BY = "ORDER BY turn, name, body, head, own"
_ESCAPED = "replace(replace({0}, '<|', '<' || chr(92) || '|'), '|>', '|' || chr(92) || '>')"

PERSPECTIVES = f"""
WITH t AS (SELECT conv_id, coalesce(turn, -1) AS turn, role AS speaker, {_ESCAPED.format("coalesce(text, '')")} || '<|end|>' || chr(10) AS body FROM conversations),
v AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker IS DISTINCT FROM 'system'),
s AS (SELECT t.*, perspective, floor(turn / 256)::BIGINT AS part, coalesce(speaker, '') AS name, speaker IS NOT DISTINCT FROM perspective AS own,
             CASE WHEN speaker IS NOT DISTINCT FROM perspective THEN '<|assistant|>' WHEN speaker = 'system' THEN '<|system|>'
                  ELSE '<|user:' || {_ESCAPED.format("coalesce(speaker, 'unknown')")} || '|>' END AS head FROM t JOIN v ON t.conv_id IS NOT DISTINCT FROM v.conv_id),
p AS (SELECT *, (sum(length(head) + length(body)) OVER ({_TURN} ROWS UNBOUNDED PRECEDING))::BIGINT AS upto, row_number() OVER ({_TURN}) AS place FROM s)
SELECT conv_id, perspective, part, (min(place) - 1)::BIGINT AS first_turn, count(*) AS n_turns, min(upto - length(body) - length(head))::BIGINT AS first_char,
       string_agg(head || body, '' {_BY}) AS text, coalesce(string_agg(CASE WHEN own THEN (upto - length(body)) || '+' || length(body) END, ' ' {_BY}), '') AS spans,
       sum(CASE WHEN own THEN length(body) ELSE 0 END)::BIGINT AS mask_chars
FROM p GROUP BY conv_id, perspective, part
"""


def _license_sql() -> str:
    from .license_scan import PHRASES, TEMPLATES, need, template_words

    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    places = [f"list_filter(range(0, greatest(len(w) - {len(p) - 1}, 0)), lambda i: {' AND '.join(f'w[i + {k + 1}] = {x!r}' for k, x in enumerate(p))})" for p in PHRASES.values()]
    base = " || ".join(f"CASE WHEN len({p}) > 0 THEN ['{label}'] ELSE [] END" for label, p in zip(PHRASES, places, strict=True))
    words = [template_words(text) for _, _, text in TEMPLATES]
    rows = ", ".join(f"({k}, '{label}', {need(len(set(t)), share)}, {len(t)}, {len(set(t))})" for k, ((label, share, _), t) in enumerate(zip(TEMPLATES, words, strict=True)))
    tokens = ", ".join(f"({k}, '{w}')" for k, t in enumerate(words) for w in sorted(set(t)))
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({FOLDED.format("coalesce(text, '')")}, {word}) AS w FROM documents),
template(k, label, least, stride, size) AS (VALUES {rows}),
token(k, word) AS (VALUES {tokens}),
p AS (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM t),
q AS (SELECT r, k, word, pos // stride AS q FROM p JOIN token USING (word) JOIN template USING (k)),
b AS (SELECT r, k, word, unnest([q, q - 1]) AS block FROM q),
m AS (SELECT r, k, block, count(DISTINCT word) AS n FROM b WHERE block >= 0 GROUP BY r, k, block),
f AS (SELECT r, list(label) AS more, max(n / size) AS best, count(*) AS n_blocks FROM m JOIN template USING (k) WHERE n >= least GROUP BY r),
x AS (SELECT r, doc_id, len(w) AS n, {" || ".join(places)} AS pos, {base} AS base FROM t)
SELECT doc_id, n::BIGINT AS n_words, len(pos)::BIGINT AS n_base, list_min(pos)::BIGINT AS first_word, list_max(pos)::BIGINT AS last_word,
       array_to_string(list_sort(list_distinct(base)), ',') AS base_labels, array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ',') AS labels,
       CASE WHEN len(pos) > 0 THEN 1.0 ELSE round(coalesce(best, 0.0), 6) END::DOUBLE AS score, coalesce(n_blocks, 0)::BIGINT AS n_blocks
FROM x LEFT JOIN f ON f.r = x.r
"""


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _FIELD.format("{0}") + ")"
#: crc32 bit by bit: a character's code enters at the first of its eight steps.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
            lambda a, b: CASE WHEN xor(a, b) % 2 = 1 THEN xor(xor(a, b) >> 1, 3988292384) ELSE xor(a, b) >> 1 END), 4294967295)"""
_SIDE = "coalesce(string_agg(h, '') OVER (PARTITION BY {0}, pos // 3 ORDER BY pos ROWS BETWEEN {1}), '')"
_SIDES = lambda by: _SIDE.format(by, "UNBOUNDED PRECEDING AND 1 PRECEDING") + " AS l, " + _SIDE.format(by, "1 FOLLOWING AND UNBOUNDED FOLLOWING") + " AS r"

MERKLE = f"""
WITH RECURSIVE c AS (SELECT *, {_CRC32} AS crc FROM documents),
d AS (SELECT doc_id, coalesce('s' || source, 'n') AS tree, {_LEAF.format("text")} AS leaf, CASE WHEN crc % 2 = 0 THEN {_LEAF.format("replace(text, chr(10), '')")} ELSE {_LEAF.format("text")} END AS copy FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
nodes(tree, level, pos, n, h) AS (
    SELECT tree, 0, pos, n, leaf FROM p UNION ALL
    SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 3, n),
sub AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, pos, n, h) AS (
    SELECT 0, pos, n, h FROM sub UNION ALL SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 3, n),
low AS (SELECT tree, level, pos, {_SIDES("tree, level")} FROM nodes WHERE n > 1),
high AS (SELECT level, pos, {_SIDES("level")} FROM tops WHERE n > 1),
way AS (
    SELECT p.tree, p.pos, level, l, r FROM p JOIN low ON low.tree = p.tree AND low.pos = p.pos // (3 ** level)::BIGINT UNION ALL
    SELECT p.tree, p.pos, 1000 + level, l, r FROM p JOIN sub ON sub.tree = p.tree JOIN high ON high.pos = sub.pos // (3 ** level)::BIGINT),
proof AS (SELECT tree, pos, sha256(string_agg(l || r, '' ORDER BY level)) AS proof_sha256, list(l || ',' || r ORDER BY level) AS steps FROM way GROUP BY tree, pos),
f AS (SELECT p.doc_id, p.leaf, sub.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
             list_reduce(list_prepend(copy, coalesce(steps, [])), lambda a, s: sha256(split_part(s, ',', 1) || a || split_part(s, ',', 2))) AS folded_root
      FROM p JOIN sub ON sub.tree = p.tree LEFT JOIN proof ON proof.tree = p.tree AND proof.pos = p.pos)
SELECT *, folded_root = root AS verified FROM f
"""

ORACLES: dict[str, str] = {"op3_quality_rules": QUALITY, "op4_decontamination": CONTAINMENT, "op5_perspectives": PERSPECTIVES, "op6_ngram_jaccard": JACCARD, "op8_license_scan": _license_sql(), "op9_source_mixing": MIXING, "op10_warc_revisits": WARC, "op12_merkle_manifest": MERKLE}
