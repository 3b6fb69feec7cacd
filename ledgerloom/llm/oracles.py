"""DuckDB SQL of the operators that SQL can express."""

OP3 = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
worded AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    len(string_split(text, chr(10))) AS all_lines
  FROM base),
grams AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM worded WHERE len(w) >= 3)),
places AS (
  SELECT DISTINCT r, i + k AS p
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams), (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1),
repeats AS (SELECT r, count(*) AS n FROM places GROUP BY r),
counted AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, all_lines
  FROM worded LEFT JOIN repeats USING (r)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * all_lines AS soft_failed
  FROM counted),
hosts AS (SELECT source, count(*) AS n, sum((base_failed OR soft_failed)::INT) AS x FROM judged GROUP BY source),
sums AS (SELECT sum(x) / sum(n) AS m, sum(n) AS n, count(*) AS k, sum(x * x / n) AS nr2, sum(n * n) AS n2 FROM hosts),
fitted AS (
  SELECT m, greatest(0, (nr2 - n * m * m - (k - 1) * m * (1 - m)) / greatest(1e-9, n - n2 / n - (k - 1))) AS spread FROM sums),
prior AS (SELECT m, least(1e6, greatest(1, m * (1 - m) / greatest(spread, 1e-9) - 1)) AS s FROM fitted),
verdicts AS (SELECT source AS host, round((x + m * s) / (n + s), 9) > 0.5 AS rejected FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT soft_failed AND NOT rejected AS kept
FROM judged JOIN verdicts ON source IS NOT DISTINCT FROM host
"""

OP6 = r"""
WITH split AS (
  SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark)),
windows AS (
  SELECT DISTINCT id::VARCHAR AS item, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM split WHERE kind = 'b' AND len(w) > 0))),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM split, lengths WHERE kind = 'd' AND len(w) >= n)),
hits AS (SELECT id, item, p.n, i FROM places p JOIN windows w ON p.n = w.n AND p.g = w.g),
words AS (SELECT id, count(DISTINCT i + k) AS n FROM (SELECT *, unnest(range(0, n)) AS k FROM hits) GROUP BY id),
items AS (SELECT id, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS digest FROM (SELECT DISTINCT id, item FROM hits) GROUP BY id)
SELECT s.id AS doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  coalesce(digest, sha256('')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM split s LEFT JOIN words ON s.id = words.id LEFT JOIN items ON s.id = items.id WHERE kind = 'd'
"""

OP9 = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(5, len(w)) AS n FROM worded WHERE len(w) > 0))),
sized AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sized x ON a = x.doc_id JOIN sized y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
reached AS (SELECT doc_id AS d, doc_id AS c FROM worded UNION SELECT links.b, reached.c FROM reached JOIN links ON links.a = reached.d)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM worded w LEFT JOIN sized USING (doc_id) JOIN (SELECT d, min(c) AS c FROM reached GROUP BY d) m ON m.d = w.doc_id
"""

#: One row with the table of the crc32 polynomial, made by its rule, and the crc32 of an ASCII text.
CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc_table)"""


def crc32(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"CASE WHEN {text} = '' THEN 0 ELSE xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(crc_table[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8))) END"


def field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def tree(name: str, leaves: str) -> str:
    """All nodes of the trees over ``leaves`` (g, pos, digest), and their runs of siblings."""
    return f"""{name} AS (
  SELECT g, 0 AS lvl, pos, digest, count(*) OVER (PARTITION BY g) AS n FROM {leaves}
  UNION ALL
  SELECT g, lvl + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM {name} WHERE n > 1 GROUP BY g, lvl, pos // 8),
{name}_runs AS (SELECT g, lvl, pos // 8 AS run, list(digest ORDER BY pos) AS ds FROM {name} WHERE n > 1 GROUP BY g, lvl, pos // 8),
{name}_steps AS (SELECT l.g, l.pos, r.lvl, array_to_string(ds[:(l.pos >> (3 * r.lvl)) % 8], '') AS before, array_to_string(ds[(l.pos >> (3 * r.lvl)) % 8 + 2:], '') AS behind
  FROM {leaves} l JOIN {name}_runs r ON r.g = l.g AND r.run = l.pos >> (3 * r.lvl + 3))"""


OP11 = f"""
WITH RECURSIVE {CRC_TABLE},
texts AS (SELECT *, CASE WHEN ({crc32("coalesce(CAST(doc_id AS VARCHAR), '')")}) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM documents, crc),
digests AS (SELECT doc_id, coalesce('x' || lang, '') AS g,
  {", ".join(f"sha256({' || '.join(field(c) for c in ('CAST(doc_id AS VARCHAR)', 'source', 'lang', 'CAST(n_chars AS VARCHAR)', t))}) AS {n}" for t, n in (('text', 'digest'), ('other', 'checked')))} FROM texts),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos FROM digests),
{tree("nodes", "leaves")},
subroots AS (SELECT '' AS g, g AS member, digest, row_number() OVER (ORDER BY g) - 1 AS pos FROM nodes WHERE n = 1),
{tree("tops", "subroots")},
steps AS (
  SELECT g, pos, lvl, before, behind FROM nodes_steps
  UNION ALL SELECT l.g, l.pos, 1000 + t.lvl, t.before, t.behind FROM leaves l JOIN subroots s ON s.member = l.g JOIN tops_steps t ON t.pos = s.pos),
paths AS (SELECT g, pos, string_agg(before || behind, '' ORDER BY lvl) AS siblings, list(before || chr(1) || behind ORDER BY lvl) AS way FROM steps GROUP BY g, pos),
proved AS (
  SELECT l.*, s.digest AS subroot, (SELECT digest FROM tops WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
    list_reduce(list_prepend(checked, coalesce(way, [])), lambda d, w: sha256(string_split(w, chr(1))[1] || d || string_split(w, chr(1))[2])) AS folded_root
  FROM leaves l JOIN subroots s ON s.member = l.g LEFT JOIN paths p ON p.g = l.g AND p.pos = l.pos)
SELECT doc_id, digest AS leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM proved
"""


def plus(state: str, letters: str, cost: str) -> str:
    """A best prefix with more letters; null where there is none."""
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letters}'}} END"


def best(*options: str) -> str:
    return f"list_min(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))"


FREE = "k IN ('t', 'k')"
LATE = "CASE WHEN k = 't' THEN 3 ELSE 0 END"
keep = lambda initial, state: f"CASE WHEN {FREE} AND initial = '{initial}' THEN {plus(state, 'K', LATE)} END"
rename = lambda state: f"CASE WHEN {FREE} THEN {plus(state, 'R', f'3 + {LATE}')} END"
drop = lambda state: plus(state, "D", "4")

#: The repair by a table over (row, state) with cost and audit, instead of a search.
OP13 = f"""
WITH RECURSIVE {CRC_TABLE},
rows AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  ({crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")}) % 20 AS kind FROM conversations, crc),
damaged AS (
  SELECT coalesce('x' || conv_id, '') AS g, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    md5(length(role) || ':' || role || ':' || text) AS tie, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM rows WHERE kind <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, tie, copy) AS i, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS mark,
  CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'o' END AS initial FROM damaged),
marked AS (SELECT *, lag(initial) OVER (PARTITION BY g ORDER BY i) AS before,
  CASE WHEN mark = '' THEN 'b' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'd' WHEN mark IN ('.', '!', '?') THEN 'k' ELSE 't' END AS k FROM ordered),
counts AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE k = 'b') AS blank, count(*) FILTER (WHERE k = 'd') AS duplicate,
  count(*) FILTER (WHERE k = 't') AS truncated, count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM marked GROUP BY g),
search AS (
  SELECT g, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': ''}} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR) AS s1, {{'c': 3::BIGINT, 'a': 'I'}} AS s2, {{'c': 6::BIGINT, 'a': 'II'}} AS s3 FROM counts
  UNION ALL
  SELECT g, i, t0, t1, u2, {best('t3', plus('u2', 'I', '3'))} FROM (
    SELECT *, {best('t2', plus('t0', 'I', '3'), plus('t1', 'I', '3'), plus('t3', 'I', '3'))} AS u2 FROM (
      SELECT search.g, marked.i, {drop('s0')} AS t0, {best(drop('s1'), keep('s', 's0'))} AS t1,
        {best(drop('s2'), *[f(x) for x in ('s0', 's1', 's3') for f in (lambda x: keep('u', x), rename)])} AS t2, {best(drop('s3'), keep('a', 's2'), rename('s2'))} AS t3
      FROM search JOIN marked ON marked.g = search.g AND marked.i = search.i + 1))),
found AS (SELECT g, {best('s0', 's3')} AS f FROM search JOIN counts USING (g) WHERE search.i = counts.n),
letters AS (SELECT g, unnest(string_split(f.a, '')) AS letter, generate_subscripts(string_split(f.a, ''), 1) AS j FROM found WHERE f.a <> ''),
placed AS (SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER (PARTITION BY g ORDER BY j) AS i FROM letters),
emitted AS (SELECT p.g, p.j, p.letter, role, text, initial, row_number() OVER (PARTITION BY p.g ORDER BY p.j) AS e FROM placed p LEFT JOIN marked m ON m.g = p.g AND m.i = p.i AND p.letter <> 'I' WHERE p.letter <> 'D'),
named AS (SELECT *, CASE WHEN (e - max(CASE WHEN e = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY g)) % 2 = 1 THEN 'user' ELSE 'assistant' END AS fresh FROM emitted),
repaired AS (SELECT g, string_agg(CASE letter WHEN 'K' THEN role || ':' || text WHEN 'R' THEN fresh || ':' || text ELSE fresh || ':' END, chr(10) ORDER BY e) AS lines FROM named GROUP BY g)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(f.c, 0) AS cost, coalesce(f.a, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('x' || conv_id, '') AS g FROM conversations) c LEFT JOIN counts USING (g) LEFT JOIN found USING (g) LEFT JOIN repaired USING (g)
"""
