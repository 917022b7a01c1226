"""DuckDB SQL for the queries that SQL can express.

The others are tested against brute force: token files and packing call a tokenizer, SimHash needs seeded
XXH64, pages need a parser, and the language, URL and disclosure models are not queries.
"""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = r"[^\x20\x09-\x0D]+"

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
item AS MATERIALIZED (SELECT item_id, {_WORDS} AS ws FROM benchmark),
pattern AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS words
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM item WHERE len(ws) > 0)),
place AS (
  SELECT rid, n, i, array_to_string(ws[i:i + n - 1], ' ') AS words
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM pattern))),
hit AS MATERIALIZED (SELECT rid, i, n, item_id FROM place JOIN pattern USING (n, words)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
named AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""

OP2 = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
line AS MATERIALIZED (
  SELECT rid, doc_id, pos, raw, trim(raw, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS t
  FROM (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos
        FROM d WHERE text IS NOT NULL)),
numbered AS MATERIALIZED (SELECT *, sum(CASE WHEN t <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY pos) - 1 AS k FROM line),
triple AS (
  SELECT rid, doc_id, k, t, lead(t, 1) OVER w AS t1, lead(t, 2) OVER w AS t2 FROM numbered WHERE t <> ''
  WINDOW w AS (PARTITION BY rid ORDER BY pos)),
later AS (
  SELECT rid, k FROM (SELECT rid, k, row_number() OVER (PARTITION BY t, t1, t2 ORDER BY doc_id, k) AS nth FROM triple WHERE t2 IS NOT NULL)
  WHERE nth > 1),
gone AS (SELECT DISTINCT rid, k + o AS k, TRUE AS cut FROM later, (VALUES (0), (1), (2)) AS v(o)),
per AS (
  SELECT rid, string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE cut IS NULL) AS kept,
    count(*) FILTER (WHERE t <> '') AS n_lines, count(*) FILTER (WHERE t <> '' AND cut) AS n_removed
  FROM numbered LEFT JOIN gone USING (rid, k) GROUP BY rid)
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text,
  CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN per USING (rid)
"""


def _spans(kinds: list[tuple[str, str]], source: str) -> str:
    """rid, kind, rank, start, stop, value of the matches of each kind in ``source`` (rid, text)."""
    each = []
    for rank, (kind, pattern) in enumerate(kinds):
        p = pattern.replace("'", "''")
        each.append(f"""
  SELECT rid, '{kind}' AS kind, {rank} AS rank, nth, value, gap,
    CAST(sum(gap + length(value)) OVER (PARTITION BY rid ORDER BY nth) AS BIGINT) AS stop
  FROM (SELECT rid, unnest(vs) AS value, unnest(list_transform(ps[:len(vs)], lambda x: length(x))) AS gap, unnest(range(len(vs))) AS nth
        FROM (SELECT rid, regexp_extract_all(text, '{p}') AS vs, string_split_regex(text, '{p}') AS ps FROM {source}
              WHERE regexp_matches(text, '{p}')))""")
    return " UNION ALL ".join(each)


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_SECRETS = [("assign", _ASSIGN), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+"), ("token", "[A-Za-z0-9_-]{20,}")]
_GROUP = _ASSIGN.replace("'", "''")

OP5 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS text FROM documents),
found AS MATERIALIZED (
  SELECT rid, kind, rank, stop - length(value) AS start, stop,
    CASE kind WHEN 'assign' THEN regexp_extract(value, '{_GROUP}', 1) ELSE value END AS value
  FROM ({_spans(_SECRETS, "d")})),
held AS MATERIALIZED (
  SELECT * FROM found WHERE CASE kind
    WHEN 'assign' THEN length(value) >= 6 WHEN 'access' THEN length(value) >= 20 WHEN 'hex' THEN length(value) >= 24
    ELSE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 10 END),
value AS (
  SELECT value, count(DISTINCT owner) AS n_owners, count(DISTINCT rid) AS n_repositories FROM held JOIN d USING (rid) GROUP BY value),
judged AS MATERIALIZED (
  SELECT h.*, n_owners <= 1 AND n_repositories <= 5 AS live FROM held h JOIN value USING (value)),
listed AS (
  SELECT * FROM judged j WHERE kind <> 'token' OR (live AND NOT EXISTS (
    SELECT 1 FROM judged b WHERE b.rid = j.rid AND b.kind <> 'token' AND b.start < j.stop AND j.start < b.stop))),
per AS (
  SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
    count(*) FILTER (WHERE kind = 'hex') AS n_hex, count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_copied,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE kind <> 'token') AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM listed GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
  CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  CAST(coalesce(n_live, 0) AS BIGINT) AS n_live, CAST(coalesce(n_copied, 0) AS BIGINT) AS n_copied
FROM d LEFT JOIN per USING (rid)
"""

#: The seven words after one, joined; null where the text ends before.
_NEXT_WORDS = " ".join(f"|| ' ' || lead(w, {k}) OVER o" for k in range(1, 8))

OP8 = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{BLANKS}') AS ws
  FROM documents),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{BLANKS}') GROUP BY rid),
word AS (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
span AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, words) AS times
  FROM (SELECT rid, i, w {_NEXT_WORDS} AS words FROM word WINDOW o AS (PARTITION BY rid ORDER BY i)) WHERE words IS NOT NULL),
repeated AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM span WHERE times > 1) GROUP BY rid),
measured AS MATERIALIZED (
  SELECT rid, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN lines USING (rid) LEFT JOIN repeated USING (rid)),
failed AS MATERIALIZED (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, [
    {{'rule': 'symbols', 'fails': 10 * n_symbols > word_chars, 'margin': 10 * n_symbols / word_chars}},
    {{'rule': 'repeated_lines', 'fails': 10 * n_dup_lines > 3 * n_lines, 'margin': 10 * n_dup_lines / (3 * n_lines)}},
    {{'rule': 'word_length', 'fails': word_chars < 2 * n_words OR word_chars > 15 * n_words,
      'margin': greatest(word_chars / (15 * n_words), if(word_chars > n_words, n_words / (word_chars - n_words), 1e6))}},
    {{'rule': 'repeated_words', 'fails': 100 * n_repeat_words > 15 * n_words, 'margin': 100 * n_repeat_words / (15 * n_words)}}] AS tests
  FROM measured),
host AS (
  SELECT source, t.rule, count(*) AS n, count(*) FILTER (WHERE t.fails) AS bad
  FROM (SELECT source, unnest(tests) AS t FROM failed) GROUP BY source, t.rule),
moment AS (
  SELECT rule, avg(1 / n) AS thin, count(*) AS hosts, avg(bad / n) AS mean, var_samp(bad / n) AS var FROM host GROUP BY rule),
prior AS (
  SELECT rule, mean, CASE WHEN thin < 1 AND hosts > 1 AND mean > 0 AND mean < 1
    THEN (var - drawn - 2 * drawn * sqrt(2 / (hosts - 1) + thin / (mean * (1 - mean) * hosts))) / (1 - thin) END AS own
  FROM (SELECT *, mean * (1 - mean) * thin AS drawn FROM moment)),
posterior AS (
  SELECT source, rule, mean, bad + mean * weight AS a, n - bad + (1 - mean) * weight AS b
  FROM host JOIN (SELECT *, CASE WHEN own > 0 THEN greatest(least(mean * (1 - mean) / own - 1, 1e6), 1e-3) ELSE 1e6 END AS weight FROM prior) USING (rule)),
normal AS (
  SELECT source, rule, mean, 3 * (one * (1 - 1 / (9 * b)) - two * (1 - 1 / (9 * a))) / sqrt(one * one / b + two * two / a) AS z
  FROM (SELECT *, cbrt(b * mean) AS one, cbrt(a * (1 - mean)) AS two FROM posterior)),
verdict AS MATERIALIZED (
  SELECT source, rule, CASE WHEN mean > 0 AND mean < 1 THEN round(1 / (1 + exp(least(1.5976 * z + 0.07056 * pow(z, 3), 700.0))), 9) ELSE 0.5 END AS chance
  FROM normal),
doc AS (
  SELECT rid, min(place) AS place FROM (SELECT rid, source, unnest(tests) AS t, unnest(range(4)) AS place FROM failed) f
  JOIN verdict v ON v.rule = f.t.rule AND v.source IS NOT DISTINCT FROM f.source WHERE f.t.fails AND f.t.margin * chance > 1 GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND place IS NULL AS kept, tests[place + 1].rule AS host_failed
FROM failed LEFT JOIN doc USING (rid)
"""

def _field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen(CAST({column} AS VARCHAR)) || ':' || {column} END"


def _tree(name: str, leaves: str) -> str:
    """Recursive table of the nodes (tree, level, i, n, h) above ``leaves`` (tree, i, n, h)."""
    return f"""
{name} AS (
  SELECT tree, 0 AS level, i, n, h FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY tree, level, i // 2, n)"""


#: CRC-32 of a decimal number's text, bit by bit.
_CRC = """xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))))"""

OP11 = f"""
WITH RECURSIVE
d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, lang, sha256(front || {_field("n_chars")} || back) AS h,
    CASE WHEN {_CRC} % 7 = 0 THEN sha256(front || {_field("(n_chars + 1)")} || back) END AS tampered
  FROM (SELECT *, {" || ".join(_field(c) for c in ("doc_id", "source", "lang"))} AS front, {_field("text")} AS back FROM documents)),
leaf AS MATERIALIZED (
  SELECT *, lang AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
{_tree("node", "leaf")},
top AS MATERIALIZED (
  SELECT 0 AS tree, tree AS lang, h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1),
{_tree("head", "top")},
step AS (
  SELECT rid, a.level, s.h, (leaf.i >> a.level) % 2 AS odd
  FROM leaf JOIN (SELECT DISTINCT tree, level FROM node WHERE n > 1) a ON a.tree IS NOT DISTINCT FROM leaf.lang
  LEFT JOIN node s ON s.tree IS NOT DISTINCT FROM leaf.lang AND s.level = a.level AND s.i = xor(leaf.i >> a.level, 1)
  UNION ALL
  SELECT rid, 1000 + a.level, s.h, (top.i >> a.level) % 2
  FROM leaf JOIN top ON top.lang IS NOT DISTINCT FROM leaf.lang CROSS JOIN (SELECT DISTINCT level FROM head WHERE n > 1) a
  LEFT JOIN head s ON s.level = a.level AND s.i = xor(top.i >> a.level, 1)),
path AS (
  SELECT rid, string_agg(h, '' ORDER BY level) AS proof,
    list(CASE WHEN h IS NULL THEN '-' WHEN odd = 1 THEN 'L' || h ELSE 'R' || h END ORDER BY level) AS steps
  FROM step GROUP BY rid),
folded AS (
  SELECT rid, leaf.doc_id, leaf.h AS leaf, top.h AS subroot, (SELECT h FROM head WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(tampered, leaf.h), coalesce(steps, [])),
      lambda x, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || x WHEN 'R' THEN x || s[2:] ELSE x END)) AS folded_root
  FROM leaf JOIN top ON top.lang IS NOT DISTINCT FROM leaf.lang LEFT JOIN path USING (rid))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ws FROM documents),
whole AS (SELECT count(*) AS docs, CAST(sum(len(ws)) AS BIGINT) AS total FROM d WHERE len(ws) > 0),
item AS MATERIALIZED (SELECT row_number() OVER () AS iid, item_id, ws FROM (SELECT DISTINCT item_id, text, {_TERMS} AS ws FROM benchmark WHERE text IS NOT NULL)),
asked AS MATERIALIZED (SELECT iid, w, count(*) AS q FROM (SELECT iid, unnest(ws) AS w FROM item) GROUP BY iid, w),
held AS MATERIALIZED (
  SELECT rid, w, count(*) AS tf FROM (SELECT rid, unnest(ws) AS w FROM d) WHERE w IN (SELECT w FROM asked) GROUP BY rid, w),
weighed AS (
  SELECT w, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS weight
  FROM (SELECT w, count(*) AS df FROM held GROUP BY w), whole),
sized AS (SELECT rid, doc_id, 100 - 25 + ((25 * len(ws) * docs) // total) AS m FROM d, whole WHERE len(ws) > 0),
scored AS (
  SELECT iid, rid, CAST(sum(q * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN held USING (w) JOIN weighed USING (w) JOIN sized USING (rid) GROUP BY iid, rid),
ranked AS (
  SELECT iid, doc_id, score, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS nth
  FROM scored JOIN d USING (rid) WHERE score > 0)
SELECT item_id, CAST(nth AS INTEGER) AS rank, doc_id, score FROM ranked JOIN item USING (iid) WHERE nth <= 20
"""

SQL: dict[str, str] = {
    "op1_decontamination": OP1,
    "op2_line_dedup": OP2,
    "op5_secrets": OP5,
    "op8_quality_rules": OP8,
    "op11_merkle_manifest": OP11,
    "op13_ranked_search": OP13,
}
