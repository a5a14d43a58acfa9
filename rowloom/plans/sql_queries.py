"""Queries in the engine's dialect, over whole tables, each with SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowloom.session import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: name -> (the dialect's text, the SQL of the same rows; None where they are one text)
TEXTS: dict[str, tuple[str, str | None]] = {}


def dialect(name: str, text: str, sql: str | None = None) -> None:
    TEXTS[name] = text, sql


def run(text: str, layer: int | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """A query's rows, or those of one layer of its plot."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        words = set(re.findall(r"\w+", text.lower()))
        for name in TABLES:
            if name in words:
                engine.register(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        return engine.sql(text) if layer is None else engine.plot(text).subplots[0][layer].df

    return query


_E = "events AS T PARTITION BY user_id ORDERED BY (ts, event_id)"
_W = "(PARTITION BY user_id ORDER BY ts, event_id)"

# Relational core

dialect("q_filter_project", "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity < 10 AND l_returnflag = 'R'")
dialect(
    "q_group_having",
    """SELECT l_returnflag, l_linestatus, SCALE(sum(l_quantity), 4) AS sum_qty, SCALE(avg(l_extendedprice), 4) AS avg_price, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, 2 HAVING count(*) > 10""",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10""",
)
for _how, _join in (("inner", "JOIN"), ("left", "LEFT OUTER JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL OUTER JOIN")):
    dialect(
        f"q_join_{_how}",
        f"""SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM (SELECT * FROM customer WHERE c_acctbal > 0) c
        {_join} (SELECT * FROM orders WHERE o_totalprice > 100000) o ON c.c_custkey = o.o_custkey""",
    )
dialect(
    "q_join_using",
    "SELECT k, n_name, c_name FROM (SELECT n_nationkey AS k, n_name FROM nation) a JOIN (SELECT c_nationkey AS k, c_name FROM customer) b USING (k)",
)
dialect("q_join_natural", "SELECT * FROM (SELECT n_regionkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b")
dialect("q_join_theta", "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_size > 48 AND s_acctbal > p_retailprice * 5")
dialect("sql_join_cross", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey <> n_regionkey")
dialect("sql_join_self", "SELECT a.n_name AS first, b.n_name AS second FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
dialect("q_semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
dialect("q_anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
dialect("q_in_subquery", "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name < 'B')")
dialect("sql_not_in_subquery", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
dialect("sql_in_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice IN (SELECT max(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
dialect("sql_scalar_correlated", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
dialect("q_quantified_all", "SELECT o_orderkey FROM orders WHERE o_totalprice > ALL (SELECT s_acctbal * 20 FROM supplier)")
dialect("q_quantified_any", "SELECT o_orderkey FROM orders WHERE o_totalprice < ANY (SELECT s_acctbal FROM supplier)")
dialect("sql_differs_from_all", "SELECT c_custkey FROM customer WHERE c_nationkey <> ALL (SELECT s_nationkey FROM supplier)")
dialect("sql_equals_any", "SELECT p_partkey FROM part WHERE p_size = ANY (SELECT n_nationkey FROM nation) OR p_size >= SOME (48, 49)", "SELECT p_partkey FROM part WHERE p_size IN (SELECT n_nationkey FROM nation) OR p_size >= 48")
dialect("q_scalar_subquery", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
for _kind in ("UNION", "INTERSECT", "EXCEPT"):
    for _all in ("", " ALL"):
        dialect(f"q_{_kind.lower()}{_all.lower().replace(' ', '_')}", f"SELECT c_nationkey AS k FROM customer {_kind}{_all} SELECT s_nationkey FROM supplier")
dialect(
    "sql_compound_order",
    """SELECT n_nationkey AS k, n_name AS x FROM nation UNION ALL SELECT s_suppkey, s_name FROM supplier EXCEPT SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1
    INTERSECT SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 12 ORDER BY x DESC, k LIMIT 40 OFFSET 3""",
)
dialect("sql_compound_parts", "(SELECT c_custkey AS k FROM customer ORDER BY c_acctbal DESC, k LIMIT 5) UNION ALL (SELECT s_suppkey FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 5)")
dialect("q_distinct", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
dialect("q_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
dialect("q_topk_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey FETCH FIRST 20 ROWS ONLY OFFSET 5", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
dialect(
    "q_null_order",
    """SELECT e.user_id, e.event_id, E.row_number() AS up, D.down AS down FROM
    (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS x FROM events) AS E PARTITION BY user_id ORDERED BY (x, event_id)
    JOIN (SELECT event_id AS id, F.row_number() AS down FROM (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS x FROM events) AS F
    PARTITION BY user_id ORDERED BY (x DESC, event_id)) AS D ON E.event_id = D.id""",
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY x ASC NULLS LAST, event_id) AS up, row_number() OVER (PARTITION BY user_id ORDER BY x DESC NULLS FIRST, event_id) AS down
    FROM (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS x FROM events)""",
)
dialect("q_values", "VALUES (1, 'a'), (2, 'b'), (3, NULL) AS t(v1, v2)", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(v1, v2)")
dialect("sql_sequence", "SELECT count(*) AS n FROM SEQUENCE(1000)", "SELECT count(*) AS n FROM range(1000)")
dialect("q_empty_aggregate", "SELECT count(*) AS n, sum(l_quantity) AS s FROM lineitem WHERE l_quantity < 0")
dialect("sql_star_except", "SELECT n.* EXCEPT (n_regionkey), r_name FROM nation n JOIN region r ON n_regionkey = r_regionkey", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
dialect("sql_group_alias", "SELECT o_orderstatus || '/' || o_orderpriority AS kind, count(DISTINCT o_custkey) AS n, max(o_totalprice) AS top FROM orders GROUP BY kind ORDER BY n DESC, kind")
dialect(
    "sql_string_agg",
    "SELECT user_id, string_agg(event_type, '>') AS path, count(*) AS n FROM events AS T ORDERED BY (ts DESC, event_id) GROUP BY user_id",
    "SELECT user_id, string_agg(event_type, '>' ORDER BY ts DESC, event_id) AS path, count(*) AS n FROM events GROUP BY user_id",
)
dialect("sql_string_agg_distinct", "SELECT user_id, string_agg(DISTINCT event_type, '|') AS kinds FROM events GROUP BY user_id", "SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")

# Expressions

dialect(
    "sql_logic",
    """SELECT o_orderkey, x IS NULL AS a, x NOTNULL AS b, (x > 100000) IS TRUE AS c, NOT (x > 100000 AND o_orderstatus = 'F') AS d, x > 100000 OR o_orderstatus = 'O' AS e, x IS DISTINCT FROM 5 AS f
    FROM (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS x FROM orders) s WHERE x IS NOT NULL OR o_orderstatus IN ('F', 'O')""",
    """SELECT o_orderkey, x IS NULL AS a, x IS NOT NULL AS b, CASE WHEN x IS NULL THEN NULL ELSE x > 100000 END AS c, NOT (x > 100000 AND o_orderstatus = 'F') AS d, x > 100000 OR o_orderstatus = 'O' AS e, x IS DISTINCT FROM 5 AS f
    FROM (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS x FROM orders) s WHERE x IS NOT NULL OR o_orderstatus IN ('F', 'O')""",
)
dialect(
    "sql_predicates",
    """SELECT o_orderkey, o_totalprice BETWEEN SYMMETRIC 200000 AND 100000 AS sym, o_orderpriority SIMILAR TO '[1-3].*' AS sim, o_orderpriority LIKE '%URG%' AS lk, o_orderpriority ILIKE '%urg%' AS ilk,
    o_orderkey > ALL (5, 9) AS allq, o_orderpriority NOT LIKE '%$_%' ESCAPE '$' AS nl, o_totalprice NOT BETWEEN 1000 AND 200000 AS nb FROM orders""",
    """SELECT o_orderkey, o_totalprice BETWEEN 100000 AND 200000 AS sym, regexp_full_match(o_orderpriority, '[1-3].*') AS sim, o_orderpriority LIKE '%URG%' AS lk, o_orderpriority ILIKE '%urg%' AS ilk,
    o_orderkey > 9 AS allq, o_orderpriority NOT LIKE '%$_%' ESCAPE '$' AS nl, o_totalprice NOT BETWEEN 1000 AND 200000 AS nb FROM orders""",
)
dialect(
    "sql_arithmetic",
    "SELECT p_partkey, p_size / 7 AS dv, p_size % 7 AS md, -p_size + 3 AS ng, p_size ^ 2 AS sq, p_retailprice / 4 AS q, FLOOR(p_size) AS fi, DIV(p_partkey, 3) AS d3, FLOOR(p_retailprice) AS fl, TRUNC(3 - p_size) AS tr FROM part",
    "SELECT p_partkey, p_size // 7 AS dv, p_size % 7 AS md, -p_size + 3 AS ng, CAST(p_size AS DOUBLE) ^ 2 AS sq, p_retailprice / 4 AS q, p_size AS fi, p_partkey // 3 AS d3, floor(p_retailprice) AS fl, 3 - p_size AS tr FROM part",
)
dialect(
    "sql_strings",
    """SELECT p_partkey, p_brand || '-' || p_size AS c, CHAR_LENGTH(p_name) AS n, UPPER(SUBSTRING(p_name, 2, 3)) AS s3, STRPOS(p_name, 'a') AS ps, REPLACEFIRST(p_name, '([aeiou])(.)', '<$2$1>') AS rf,
    REPLACEALL(p_name, '[aeiou]', '_') AS ra, SUBSTRING(p_name, '[a-f]{2,}') AS rx, TRIM('  ' || p_brand || ' ') AS tm FROM part""",
    """SELECT p_partkey, p_brand || '-' || p_size AS c, CAST(length(p_name) AS INTEGER) AS n, upper(substring(p_name, 2, 3)) AS s3, CAST(strpos(p_name, 'a') AS INTEGER) AS ps, regexp_replace(p_name, '([aeiou])(.)', '<\\2\\1>') AS rf,
    regexp_replace(p_name, '[aeiou]', '_', 'g') AS ra, nullif(regexp_extract(p_name, '[a-f]{2,}'), '') AS rx, p_brand AS tm FROM part""",
)
dialect(
    "sql_dates",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) + 3 AS d3, CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS dd, DATE_PART('MONTH', o_orderdate) AS m, DATE_PART('HOUR', o_orderdate + 90000) AS h,
    DATE_PART('WEEK_OF_MONTH', o_orderdate) AS wm, TIMESTAMP_DIFF(o_orderdate, TIMESTAMP '1995-01-01 00:00:00') AS df FROM orders""",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) + 3 AS d3, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * 86400000 AS dd, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(hour(o_orderdate + INTERVAL 90 SECOND) % 12 AS INTEGER) AS h,
    CAST((dayofmonth(o_orderdate) + dayofweek(date_trunc('month', o_orderdate)) - 1) // 7 + 1 AS INTEGER) AS wm, epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1995-01-01') AS df FROM orders""",
)
dialect(
    "sql_times",
    """SELECT event_id, CAST(TIME_ADD(TIME '23:59:50', event_id % 30 * 1000) AS VARCHAR) AS t, TIME_DIFF(TIME '10:11:12', TIME '10:00:00') + event_id AS d, DATE_PART('MINUTE', TIME '10:11:12') AS mi FROM events""",
    """SELECT event_id, CAST(TIME '23:59:50' + to_seconds(event_id % 30) AS VARCHAR) AS t, 672000 + event_id AS d, CAST(11 AS INTEGER) AS mi FROM events""",
)
dialect("sql_casts", "SELECT event_id, CAST(value AS INT) AS i, (event_id % 2 = 0)::VARCHAR AS b, CAST(ts AS DATE) AS d, CAST('TRUE' AS BOOLEAN) AS t FROM events WHERE value >= 0", "SELECT event_id, CAST(floor(value + 0.5) AS INTEGER) AS i, CAST(event_id % 2 = 0 AS VARCHAR) AS b, CAST(ts AS DATE) AS d, true AS t FROM events WHERE value >= 0")
dialect("sql_case", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS a, CASE WHEN o_totalprice > 200000 THEN 'big' END AS b, COALESCE(NULLIF(o_orderstatus, 'F'), '-') AS c FROM orders")

# Aggregates

dialect(
    "sql_statistics",
    """SELECT l_returnflag, SCALE(VAR_POP(l_quantity), 4) AS vp, SCALE(STDDEV(l_quantity), 4) AS ss, SCALE(SKEW(l_quantity), 4) AS sk, SCALE(KURTOSIS(l_quantity), 4) AS ks, SCALE(CORR(l_extendedprice, l_quantity), 4) AS co,
    SCALE(REGR_SLOPE(l_tax, l_quantity), 6) AS sl, EVERY(l_quantity > 0) AS ba, BOOL_OR(l_quantity > 49) AS bo, count(DISTINCT l_suppkey) AS cd, SCALE(AVG(l_quantity, l_tax + 1), 4) AS wa FROM lineitem GROUP BY l_returnflag""",
    """SELECT l_returnflag, round(var_pop(l_quantity), 4) AS vp, round(stddev_samp(l_quantity), 4) AS ss, round(skewness(l_quantity), 4) AS sk, round(kurtosis(l_quantity), 4) AS ks, round(corr(l_extendedprice, l_quantity), 4) AS co,
    round(regr_slope(l_tax, l_quantity), 6) AS sl, bool_and(l_quantity > 0) AS ba, bool_or(l_quantity > 49) AS bo, count(DISTINCT l_suppkey) AS cd, round(sum(l_quantity * (l_tax + 1)) / sum(l_tax + 1), 4) AS wa FROM lineitem GROUP BY l_returnflag""",
)

# Sequences

dialect(
    "sql_running",
    f"SELECT event_id, SCALE(T.sum(value), 6) AS s, T.count(*) AS n, T.max(value) AS m, T.row_number() AS rn, T.lag(value, 2, -1.0) AS l2, T.nth_value(event_type, 4, 'none') AS f4 FROM {_E}",
    f"""SELECT event_id, round(sum(value) OVER {_W}, 6) AS s, count(*) OVER {_W} AS n, max(value) OVER {_W} AS m, row_number() OVER {_W} AS rn, lag(value, 2, -1.0) OVER {_W} AS l2,
    coalesce(CASE WHEN row_number() OVER {_W} >= 4 THEN nth_value(event_type, 4) OVER {_W} END, 'none') AS f4 FROM events""",
)
dialect(
    "sql_index",
    f"SELECT event_id, T[0].value AS first, T[2].value AS third, T[-1].value AS prev, T.value AS own FROM {_E}",
    f"SELECT event_id, first_value(value) OVER {_W} AS first, CASE WHEN row_number() OVER {_W} >= 3 THEN nth_value(value, 3) OVER {_W} END AS third, lag(value, 1) OVER {_W} AS prev, value AS own FROM events",
)
_X = "(SELECT event_id, user_id, ts, CASE WHEN event_type <> 'error' THEN value END AS x FROM events)"
dialect(
    "sql_moving",
    f"SELECT event_id, SCALE(T.movavg(x, 5), 6) AS mv, SCALE(T.movstddev(x, 5), 6) AS sd FROM {_X} AS T PARTITION BY user_id ORDERED BY (ts, event_id)",
    f"""SELECT event_id, CASE WHEN c > 0 THEN round(avg(x) OVER w, 6) END AS mv, CASE WHEN c > 0 THEN round(stddev_samp(x) OVER w, 6) END AS sd
    FROM (SELECT event_id, user_id, x, count(x) OVER {_W} AS c FROM {_X}) WINDOW w AS (PARTITION BY user_id ORDER BY c RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
dialect(
    "sql_expmovavg",
    f"SELECT event_id, SCALE(T.expmovavg(value, 0.3), 6) AS ema FROM {_E}",
    """WITH RECURSIVE n AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    s AS (SELECT event_id, user_id, k, value AS a FROM n WHERE k = 1 UNION ALL SELECT n.event_id, n.user_id, n.k, 0.7 * s.a + 0.3 * n.value FROM s JOIN n ON n.user_id = s.user_id AND n.k = s.k + 1)
    SELECT event_id, round(a, 6) AS ema FROM s""",
)
dialect(
    "sql_rank",
    "SELECT event_id, T.rank(event_type) AS rk, T.dense_rank(event_type) AS dr FROM events AS T PARTITION BY user_id ORDERED BY (event_type)",
    "SELECT event_id, rank() OVER (PARTITION BY user_id ORDER BY event_type) AS rk, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS dr FROM events",
)
dialect(
    "sql_arg",
    "SELECT o_orderkey, o_custkey FROM orders PARTITION BY o_custkey ARG (MAX(o_orderpriority), MIN(o_totalprice))",
    """SELECT o_orderkey, o_custkey FROM (SELECT *, max(o_orderpriority) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_orderpriority = m
    UNION ALL SELECT o_orderkey, o_custkey FROM (SELECT *, min(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_totalprice = m""",
)
dialect(
    "sql_pivot",
    "SELECT user_id, clicks, views FROM events PARTITION BY user_id PIVOT COUNT(value) FOR event_type IN (click AS clicks, LABEL(view, signup) AS views)",
    "SELECT user_id, count(CASE WHEN event_type = 'click' THEN value END) AS clicks, count(CASE WHEN event_type IN ('view', 'signup') THEN value END) AS views FROM events GROUP BY user_id",
)
dialect(
    "sql_unpivot",
    "SELECT v, k, l_orderkey FROM (SELECT l_orderkey, l_quantity, l_tax FROM lineitem) t UNPIVOT v FOR k IN (l_quantity, l_tax AS 'tax')",
    "SELECT l_quantity AS v, 'L_QUANTITY' AS k, l_orderkey FROM lineitem UNION ALL SELECT l_tax, 'tax', l_orderkey FROM lineitem",
)
dialect(
    "sql_align_zip",
    """SELECT A.user_id AS u, left_id, right_id FROM (SELECT user_id, ts, event_id AS left_id FROM events WHERE event_type = 'click') AS A PARTITION BY user_id ORDERED BY (ts, left_id)
    ALIGN (SELECT user_id, ts AS t2, event_id AS right_id FROM events WHERE event_type = 'view') AS B PARTITION BY user_id ORDERED BY (t2, right_id)""".replace("A.user_id AS u", "user_id AS u"),
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS k FROM events)
    SELECT a.user_id AS u, a.event_id AS left_id, b.event_id AS right_id FROM n a JOIN n b ON a.user_id = b.user_id AND a.k = b.k AND a.event_type = 'click' AND b.event_type = 'view'""",
)
_LETTERS = "string_agg(CASE event_type WHEN 'view' THEN 'v' WHEN 'click' THEN 'c' WHEN 'purchase' THEN 'p' WHEN 'signup' THEN 's' ELSE 'e' END, '' ORDER BY ts, event_id)"
dialect(
    "sql_match",
    'SELECT T.user_id AS u, VIEW.count(*) AS views, CLICK.count(*) AS clicks, PATH(\'-\') AS p FROM events AS T PARTITION BY user_id ORDERED BY (ts, event_id) MATCH "VIEW+ CLICK" ON event_type GROUP BY user_id, match_id'.replace("T.user_id AS u", "max(user_id) AS u"),
    f"""SELECT u, CAST(length(m) - 1 AS BIGINT) AS views, CAST(1 AS BIGINT) AS clicks, repeat('VIEW-', CAST(length(m) - 1 AS INTEGER)) || 'CLICK' AS p
    FROM (SELECT user_id AS u, unnest(regexp_extract_all(s, 'v+c')) AS m FROM (SELECT user_id, {_LETTERS} AS s FROM events GROUP BY user_id))""",
)
dialect(
    "sql_typeinfer",
    "SELECT a + 1 AS a, b, c FROM (SELECT CAST(event_id AS VARCHAR) AS a, CAST(value AS VARCHAR) AS b, event_type AS c FROM events) t TYPEINFER",
    "SELECT event_id + 1 AS a, value AS b, event_type AS c FROM events",
)
dialect(
    "sql_text_parse",
    """SELECT event_id, k FROM events TEXT std.PARSE('"k": *([0-9]+)') IN props TO k""",
    """SELECT event_id, CASE WHEN regexp_matches(props, '"k": *([0-9]+)') THEN regexp_extract(props, '"k": *([0-9]+)', 1) END AS k FROM events""",
)
dialect(
    "sql_split",
    """SELECT out_lo, out_hi, o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS lo, CAST(o_orderdate AS DATE) + (o_orderkey % 30 + 1) AS hi FROM orders) t
    PARTITION BY o_custkey SPLIT (lo, hi) INTO (out_lo, out_hi)""",
    """WITH i AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS lo, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 + 1 AS INTEGER) AS hi FROM orders),
    b AS (SELECT DISTINCT o_custkey, pt FROM (SELECT o_custkey, lo AS pt FROM i UNION ALL SELECT o_custkey, hi FROM i)), p AS (SELECT o_custkey, pt AS out_lo, lead(pt) OVER (PARTITION BY o_custkey ORDER BY pt) AS out_hi FROM b)
    SELECT out_lo, out_hi, i.o_custkey, o_orderkey FROM i JOIN p ON p.o_custkey = i.o_custkey AND out_lo >= lo AND out_hi <= hi""",
)

#: name -> (a query with its plot, the layer whose rows are asked for, the SQL of these rows)
PLOTS = {
    "sql_plot_bins": (
        "SELECT * FROM lineitem PLOT (GEOM = POINT(X = l_quantity, Y = l_tax), GROUP = l_returnflag, STAT = BIN(BINWIDTH = 8, MIN = 0)) FACET (ROWS = l_linestatus)",
        0,
        """SELECT l_linestatus AS facet_row, l_returnflag AS "group", floor(l_quantity / 8) * 8.0 AS xmin, floor(l_quantity / 8) * 8.0 + 8 AS xmax, count(*) AS freq, count(*) AS tooltip
        FROM lineitem GROUP BY l_linestatus, l_returnflag, floor(l_quantity / 8)""",
    ),
    "sql_plot_stack": (
        """SELECT event_type, user_id % 10 AS part, COUNT(*) AS n FROM events GROUP BY event_type, user_id % 10
        PLOT (GEOM = BAR(X = part, Y = n), FILL = event_type, GROUP = event_type, MARK(n > 100, FILL = 'red'), POSITION = STACK ORDER BY event_type)""",
        0,
        """SELECT part AS x, n AS y, event_type AS "group", event_type AS fill, n > 100 AS mark0,
        CAST(coalesce(sum(n) OVER (PARTITION BY part ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS below,
        CAST(row_number() OVER (PARTITION BY part ORDER BY event_type) - 1 AS INTEGER) AS stackindex
        FROM (SELECT event_type, user_id % 10 AS part, count(*) AS n FROM events GROUP BY 1, 2)""",
    ),
}

QUERIES = {name: run(text) for name, (text, _) in TEXTS.items()} | {name: run(text, layer) for name, (text, layer, _) in PLOTS.items()}
SQL = {name: sql or text for name, (text, sql) in TEXTS.items()} | {name: sql for name, (_, _, sql) in PLOTS.items()}
