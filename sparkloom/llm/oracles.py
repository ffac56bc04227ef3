"""SQL of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

from .fill_in_middle import PLAIN_FROM, SEED, SPM_BELOW
from .fill_in_middle import Sentinels as Fim
from .quality_rules import BOILERPLATE, MARKS, SENTENCE_END, SENTENCE_INSIDE, SEPARATORS, SYMBOLS, Rules
from .secret_scans import RULES
from .sharding import SHARDS, SLOTS
from .spelling_variants import LEAST_COUNT, LEAST_LENGTH, RATIO, TYPOS

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quality_rules(r: Rules = Rules()) -> str:
    space = r"'[\x20\x09-\x0D]+'"
    count = lambda p: f"len(regexp_extract_all(l, {quoted(p)}))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, {space}), lambda x: x <> '') AS ws FROM d),
windows AS (SELECT doc_id, i, array_to_string(ws[i : i + {r.window - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {r.window - 2})) AS i FROM w)),
repeats AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM repeats, range({r.window}) AS x(k) GROUP BY doc_id),
lines AS (SELECT doc_id, l, list_filter(regexp_split_to_array(l, {space}), lambda x: x <> '') AS ws FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)),
judged AS (SELECT doc_id, l, len(array_to_string(ws, '')) AS chars, len(ws) AS n,
    (len(ws) <= {r.unpunctuated_words} OR regexp_matches(l, {quoted(SENTENCE_END)}) OR (len(ws) >= {r.prose_words} AND regexp_matches(l, {quoted(SENTENCE_INSIDE)})))
    AND NOT (regexp_matches(l, {quoted(MARKS)}) AND ({count(SYMBOLS)} > len(ws) * {r.symbol_share}::DOUBLE OR {count("!")} > len(ws) * {r.exclamation_share}::DOUBLE
        OR ({count(SEPARATORS)} >= {r.least_separators} AND {count(SEPARATORS)} > len(ws) * {r.separator_share}::DOUBLE)))
    AND NOT (len(ws) <= {r.boilerplate_words} AND regexp_matches(l, {quoted(BOILERPLATE)}))
    AND (len(ws) < {r.distinct_from} OR len(list_distinct(ws)) >= len(ws) * {r.least_distinct_share}::DOUBLE) AS ok FROM lines),
text_lines AS (SELECT doc_id, count(*) FILTER (WHERE n > 0) - count(DISTINCT CASE WHEN n > 0 THEN l END) AS dup, coalesce(sum(chars) FILTER (WHERE n > 0 AND ok), 0) AS clean FROM judged GROUP BY doc_id),
counted AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, {quoted(SYMBOLS)}))::BIGINT AS n_symbols,
    dup::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, clean FROM w JOIN text_lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
shares AS (SELECT *, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words AS base_failed, CASE WHEN word_chars > 0 THEN clean::DOUBLE / word_chars ELSE 0 END AS kept_share FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND kept_share >= {r.kept_share} AS kept, kept_share FROM shares"""


def sharding() -> str:
    """The table is filled by recursion: a list of owners, and for each turn the first free place of a shard's permutation."""
    number = lambda text: f"('0x' || substr(md5({text}), 1, 15))::BIGINT"
    names = ", ".join(f"({i}, {quoted(s)})" for i, s in enumerate(SHARDS))
    return f"""
WITH RECURSIVE shards(i, name) AS (VALUES {names}),
steps AS (SELECT i, {number("'offset/' || name")} % {SLOTS} AS o, {number("'step/' || name")} % {SLOTS - 1} + 1 AS s FROM shards),
plan AS (SELECT list(o ORDER BY i) AS os, list(s ORDER BY i) AS ss FROM steps),
fill(turn, owner, slot) AS (
  SELECT 0, list_transform(range({SLOTS}), lambda x: -1), -1 FROM plan
  UNION ALL
  SELECT turn + 1, owner[: slot] || [turn % {len(SHARDS)}] || owner[slot + 2 :], slot FROM (
    SELECT turn, owner, (os[turn % {len(SHARDS)} + 1] + ss[turn % {len(SHARDS)} + 1] * list_position(list_transform(range({SLOTS}),
      lambda j: owner[(os[turn % {len(SHARDS)} + 1] + ss[turn % {len(SHARDS)} + 1] * j) % {SLOTS} + 1]), -1) - ss[turn % {len(SHARDS)} + 1]) % {SLOTS} AS slot
    FROM fill, plan WHERE turn < {SLOTS})),
claims AS (SELECT slot, (turn - 1) % {len(SHARDS)} AS i FROM fill WHERE turn > 0)
SELECT doc_id, claims.slot::BIGINT AS slot, name AS shard FROM (SELECT doc_id, {number("coalesce(doc_id::VARCHAR, '')")} % {SLOTS} AS slot FROM documents) JOIN claims USING (slot) JOIN shards USING (i)"""


def secret_scans() -> str:
    parts = []
    for k, r in enumerate(RULES):
        found = quoted(f"(?s)(.*?)({r.pattern})")
        each = lambda g: f"unnest(regexp_extract_all(t, {found}, {g}))"
        parts.append(
            f"SELECT doc_id, {k} AS k, {quoted(r.kind)} AS kind, {each(1)} AS gap, {each(2)} AS hit, {each(r.group + 2)} AS val, {r.least} AS least, "
            f"unnest(range(len(regexp_extract_all(t, {found}, 1)))) AS nth FROM d"
        )
    base = sum(r.base for r in RULES)
    listed = lambda w: f"coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k){w}, '')"
    number = lambda k: f"count(*) FILTER (WHERE k = {k})::BIGINT"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({" UNION ALL ".join(parts)}),
placed AS (SELECT *, sum(len(gap) + len(hit)) OVER (PARTITION BY doc_id, k ORDER BY nth)::BIGINT AS b FROM hits),
spans AS (SELECT doc_id, k, kind, b - len(hit) AS a, b FROM placed WHERE len(val) >= least)
SELECT doc_id, {number(0)} AS n_assign, {number(1)} AS n_access, {number(2)} AS n_hex, sha256({listed(f" FILTER (WHERE k < {base})")}) AS base_sha256, {listed("")} AS spans
FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id"""


def fill_in_middle(r: Fim = Fim(), seed: int = SEED) -> str:
    p, s, m = map(quoted, r.marks)
    number = lambda k: f"('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), {8 * k + 1}, 8))::BIGINT"
    part = lambda a, b: f"array_to_string(us[{a} : {b}], '')"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {", ".join(f"{number(k)} AS h{k + 1}" for k in range(4))} FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us FROM d),
c AS (SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, {p}) OR contains(t, {s}) OR contains(t, {m}) OR h3 % 100 >= {PLAIN_FROM} THEN 'plain' WHEN h4 % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, {part(1, "a")} AS p, {part("a + 1", "b")} AS m, {part("b + 1", "n")} AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN {p} || p || {s} || s || {m} || m ELSE {s} || s || {p} || p || {m} || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def near_dedup(gram: int = 4, percent: int = 80) -> str:
    """Pairs by the shingles that they share; components by the reach of each document."""
    return rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS MATERIALIZED (SELECT DISTINCT r, array_to_string(ws[i : i + {gram - 1}], ' ') AS g FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - {gram - 2}, 2))) AS i FROM w WHERE len(ws) > 0)),
sizes AS MATERIALIZED (SELECT r, count(*) AS n FROM g GROUP BY r),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS common FROM g a JOIN g b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM shared JOIN sizes i ON x = i.r JOIN sizes j ON y = j.r WHERE 100 * common >= {percent} * (i.n + j.n - common)),
reach(r, o) AS (SELECT r, r FROM w UNION SELECT reach.r, e.y FROM reach JOIN (SELECT x, y FROM links UNION ALL SELECT y, x FROM links) e ON reach.o = e.x),
named AS (SELECT reach.r AS r, min(doc_id) AS component_id FROM reach JOIN w ON reach.o = w.r GROUP BY reach.r)
SELECT doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM w JOIN named USING (r) LEFT JOIN sizes USING (r)"""


def spelling_variants() -> str:
    """crc32 byte by byte from its table, itself made by a list; words by their deletions; roots by recursion."""
    bit = "CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END"
    step = "SELECT i, " + bit + " AS c FROM "
    table = "(SELECT i, i AS c FROM range(256) AS r(i))"
    for _ in range(8):
        table = f"({step}{table})"
    return rf"""
WITH RECURSIVE crc AS (SELECT list(c::BIGINT ORDER BY i) AS ts FROM {table}),
runs AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents) GROUP BY ALL),
hashed AS (SELECT w, n, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, octet_length(b) + 1), lambda i: ('0x' || hex(b[i : i]))::BIGINT)),
    lambda a, x: xor(a >> 8, ts[(xor(a, x) & 255) + 1]))) AS h FROM (SELECT w, n, encode(coalesce(doc_id::VARCHAR, '') || ':' || w) AS b, ts FROM runs, crc)),
words AS MATERIALIZED (SELECT w, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % {TYPOS} = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM hashed)
    WHERE length(w) >= {LEAST_LENGTH} GROUP BY w HAVING sum(n) >= {LEAST_COUNT}),
cuts AS MATERIALIZED (SELECT w, n, i, left(w, i) || substr(w, i + 2) AS d FROM (SELECT w, n, unnest(range(length(w))) AS i FROM words)),
pairs AS (SELECT a.w AS w, b.w AS v, b.n AS m FROM cuts a JOIN cuts b ON a.d = b.d AND a.i = b.i AND a.w <> b.w
    UNION SELECT a.w, b.w, b.n FROM cuts a JOIN words b ON a.d = b.w UNION SELECT b.w, a.w, a.n FROM cuts a JOIN words b ON a.d = b.w),
best AS (SELECT w, count(*) AS n_near, arg_min(v, (-m, v)) AS v, max(m) AS m FROM pairs GROUP BY w),
forms AS MATERIALIZED (SELECT words.w AS word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= {RATIO} * n THEN v END AS form, CASE WHEN m >= {RATIO} * n THEN m END::BIGINT AS form_n FROM words LEFT JOIN best USING (w)),
ways(word, head) AS (SELECT word, word FROM forms UNION ALL SELECT ways.word, f.form FROM ways JOIN forms f ON ways.head = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, ways.head AS root, f.n, f.n_near, f.form_n FROM forms f JOIN ways ON f.word = ways.word JOIN forms e ON ways.head = e.word WHERE e.form IS NULL"""
