"""Queries of scalar functions: text, time, numbers, nested values, JSON."""

from __future__ import annotations

from .registered import statement

statement("text_functions", """SELECT p_partkey, initcap(p_name) AS i, translate(p_type, 'AEIOU', 'aeiou') AS t, replace(p_brand, '#', '-') AS r, rpad(p_brand, 12, '.') AS p, instr(p_name, 'a') AS a,
    concat_ws('|', p_brand, p_type) AS c, repeat('ab', p_size % 3) AS b, left(p_name, 2) AS l, right(p_name, 2) AS e, length(p_name) AS n, sha2(p_name, 256) AS h, ascii(p_type) AS k FROM {part}""",
    """SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS i, translate(p_type, 'AEIOU', 'aeiou') AS t, replace(p_brand, '#', '-') AS r,
    rpad(p_brand, 12, '.') AS p, CAST(instr(p_name, 'a') AS INT) AS a, concat_ws('|', p_brand, p_type) AS c, repeat('ab', p_size % 3) AS b, left(p_name, 2) AS l, right(p_name, 2) AS e, CAST(length(p_name) AS INT) AS n,
    sha256(p_name) AS h, CAST(ascii(p_type) AS INT) AS k FROM part""")
statement("trims_micros", "SELECT o_orderkey, ltrim(concat('  ', o_orderpriority, ' ')) AS l, rtrim(concat(' ', o_orderpriority, '  ')) AS r, unix_micros(CAST(o_orderdate AS TIMESTAMP)) AS u FROM {orders}",
    "SELECT o_orderkey, ltrim('  ' || o_orderpriority || ' ') AS l, rtrim(' ' || o_orderpriority || '  ') AS r, epoch_us(o_orderdate) AS u FROM orders")
statement("regex_functions", "SELECT p_partkey, regexp_replace(p_brand, '[0-9]', 'x') AS r, p_name RLIKE '^[a-m]' AS m, regexp_count(p_name, '[aeiou]') AS n, split(p_name, ' ')[0] AS w FROM {part}",
    "SELECT p_partkey, regexp_replace(p_brand, '[0-9]', 'x', 'g') AS r, regexp_matches(p_name, '^[a-m]') AS m, CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS INT) AS n, string_split(p_name, ' ')[1] AS w FROM part")
statement("time_functions", """SELECT o_orderkey, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofweek(o_orderdate) - 1 AS w, weekofyear(o_orderdate) AS k, dayofyear(o_orderdate) AS y,
    datediff(o_orderdate, DATE'1995-01-01') AS n, add_months(CAST(o_orderdate AS DATE), 1) AS a, date_format(o_orderdate, 'yyyy/MM/dd') AS f, o_orderdate + INTERVAL 36 HOURS AS t,
    CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS b FROM {orders}""",
    """SELECT o_orderkey, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(dayofweek(o_orderdate) AS INT) AS w, CAST(weekofyear(o_orderdate) AS INT) AS k, CAST(dayofyear(o_orderdate) AS INT) AS y,
    CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS INT) AS n, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS a, strftime(o_orderdate, '%Y/%m/%d') AS f, o_orderdate + INTERVAL 36 HOURS AS t,
    CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS b FROM orders""")
statement("number_functions", """SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_extendedprice) AS DOUBLE) AS f, CAST(ceil(l_extendedprice) AS DOUBLE) AS c, round(l_quantity / 4) AS r, sqrt(l_quantity) AS q, ln(l_quantity) AS n,
    power(l_quantity, 2) AS p, sign(l_discount - 0.05D) AS s, log10(l_quantity) AS g, abs(l_tax - l_discount) AS a, l_partkey % 7 AS m, greatest(l_tax, l_discount) AS x, least(l_tax, l_discount) AS y, exp(l_tax) AS e FROM {lineitem}""",
    """SELECT l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice) AS f, ceil(l_extendedprice) AS c, round(l_quantity / 4) AS r, sqrt(l_quantity) AS q, ln(l_quantity) AS n,
    power(l_quantity, 2) AS p, CAST(sign(l_discount - CAST(0.05 AS DOUBLE)) AS DOUBLE) AS s, log10(l_quantity) AS g, abs(l_tax - l_discount) AS a, l_partkey % 7 AS m, greatest(l_tax, l_discount) AS x, least(l_tax, l_discount) AS y, exp(l_tax) AS e FROM lineitem""")
statement("safe_functions", "SELECT p_partkey, try_cast(p_brand AS INT) AS i, try_divide(p_retailprice, CAST(p_size % 3 AS DOUBLE)) AS d, try_cast(CAST(p_size AS STRING) AS BIGINT) AS b FROM {part}",
    "SELECT p_partkey, try_cast(p_brand AS INT) AS i, p_retailprice / nullif(CAST(p_size % 3 AS DOUBLE), 0) AS d, try_cast(CAST(p_size AS VARCHAR) AS BIGINT) AS b FROM part")
statement("array_functions", """SELECT vec_id, size(embedding) AS n, array_max(embedding) AS most, array_min(embedding) AS least, get(embedding, 5) AS sixth, size(slice(embedding, 3, 4)) AS k, array_contains(array(label, 3), 3) AS has,
    size(array_distinct(array(label, 3, label))) AS d, array_join(sequence(0, label), ',') AS s, array_join(flatten(array(array(label), array(1, 2))), '-') AS f FROM {embeddings}""",
    """SELECT vec_id, CAST(len(embedding) AS INT) AS n, list_max(embedding) AS most, list_min(embedding) AS least, embedding[6] AS sixth, CAST(len(embedding[3:6]) AS INT) AS k, list_contains([label, 3], 3) AS has,
    CAST(len(list_distinct([label, 3, label])) AS INT) AS d, array_to_string(range(0, label + 1), ',') AS s, array_to_string(flatten([[label], [1, 2]]), '-') AS f FROM embeddings""")
statement("array_lambdas", """SELECT vec_id, aggregate(embedding, 0D, (a, x) -> a + CAST(x AS DOUBLE)) AS total, size(filter(embedding, x -> x > 0)) AS n, exists(embedding, x -> x > 0.3) AS some, forall(embedding, x -> x < 0.9) AS every,
    aggregate(zip_with(embedding, reverse(embedding), (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (a, x) -> a + x) AS folded FROM {embeddings}""",
    """SELECT vec_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS total, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS n, list_max(embedding) > 0.3 AS some, list_max(embedding) < 0.9 AS every,
    list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * embedding[len(embedding) + 1 - i]::DOUBLE)) AS folded FROM embeddings""")
statement("word_counts", "SELECT w, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, explode(split(text, ' ')) AS w FROM {documents}) GROUP BY w",
    "SELECT w, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY w")
statement("places", "SELECT n_nationkey, pos, part FROM {nation} LATERAL VIEW posexplode(split(n_name, '_')) AS pos, part",
    "SELECT n_nationkey, CAST(generate_subscripts(string_split(n_name, '_'), 1) - 1 AS INT) AS pos, unnest(string_split(n_name, '_')) AS part FROM nation")
statement("maps_structs", "SELECT p_partkey, element_at(map('size', p_size, 'twice', p_size * 2), 'twice') AS m, named_struct('b', p_brand, 's', p_size).s AS s, size(map_keys(map(p_brand, 1, p_type, 2))) AS n FROM {part}",
    "SELECT p_partkey, p_size * 2 AS m, p_size AS s, CAST(2 AS INT) AS n FROM part")
statement("json_functions", "SELECT event_id, from_json(props, 'k INT').k AS f, variant_get(parse_json(props), '$.k', 'int') AS v, to_json(named_struct('u', user_id)) AS j FROM {events}",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS f, CAST(json_extract(props, '$.k') AS INT) AS v, chr(123) || '\"u\":' || user_id || chr(125) AS j FROM events")
