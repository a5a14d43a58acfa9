"""One query for each operator, over whole tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import aggregate as A
from rowloom.functions import casts
from rowloom.functions import scalar as S
from rowloom.operators import align, infer, match, ml, sequence, text, transform
from rowloom.plans import sql_queries
from rowloom.rel import Rel, ascending
from rowloom.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = dict(sql_queries.QUERIES)
SQL: dict[str, str] = dict(sql_queries.SQL)


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(column: Column, digits: int = 6) -> Column:
    """Rounded, since engines add doubles in different orders."""
    return F.round(column, digits)


def by_user(spark: SparkSession, sf_dir: str) -> Rel:
    return Rel(read(spark, sf_dir, "events")).partition_by("user_id").ordered_by("ts", "event_id")


# Relational core; most of it is in sql_queries.py, in the dialect


@query("""SELECT coalesce(l_returnflag, '-') AS f, coalesce(l_linestatus, '-') AS s, count(*) AS n, grouping(l_returnflag) + 2 * grouping(l_linestatus) AS g
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def q_cube(spark, d):
    g = (F.grouping("l_returnflag") + 2 * F.grouping("l_linestatus")).cast("bigint")
    found = read(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), g.alias("g"))
    return found.select(F.coalesce("l_returnflag", F.lit("-")).alias("f"), F.coalesce("l_linestatus", F.lit("-")).alias("s"), "n", "g")


# Predicates, scalar functions, casts


@query("""SELECT o_orderkey, (o_totalprice BETWEEN 200000 AND 100000 OR o_totalprice BETWEEN 100000 AND 200000) AS sym, regexp_full_match(o_orderpriority, '[1-3].*') AS sim,
  o_orderstatus IS DISTINCT FROM 'F' AS dist, o_orderpriority LIKE '%URG%' AS lk, o_orderpriority ILIKE '%urg%' AS ilk, (o_orderkey > 5 AND o_orderkey > 9) AS allq FROM orders""")
def q_predicates(spark, d):
    p, pr = F.col("o_totalprice"), F.col("o_orderpriority")
    return read(spark, d, "orders").select(
        "o_orderkey", S.between_symmetric(p, F.lit(200000), F.lit(100000)).alias("sym"), S.similar_to(pr, "[1-3].*").alias("sim"), S.distinct_from(F.col("o_orderstatus"), F.lit("F")).alias("dist"),
        pr.like("%URG%").alias("lk"), pr.ilike("%urg%").alias("ilk"), S.quantified(F.col("o_orderkey"), lambda a, b: a > b, [F.lit(5), F.lit(9)], True).alias("allq"),
    )


@query("""SELECT p_partkey, abs(p_size - 25) AS a, floor(p_retailprice) AS fl, ceil(p_retailprice) AS ce, trunc(p_retailprice - 1200) AS tr, round(pow(p_size, 2), 6) AS po, round(sqrt(p_size), 6) AS sq,
  CAST(sign(p_size - 25) AS SMALLINT) AS sg, p_size // 7 AS dv, p_size % 7 AS md, round(ln(p_size), 6) AS l, round(log10(p_size), 6) AS l10, round(sin(p_size), 6) AS sn, round(atan2(p_size, 3), 6) AS at, round(exp(p_size / 50.0), 6) AS ex FROM part""")
def q_math(spark, d):
    s, p, f = F.col("p_size"), F.col("p_retailprice"), S.scalar
    return read(spark, d, "part").select(
        "p_partkey", f("ABS", s - 25).alias("a"), f("FLOOR", p).alias("fl"), f("CEIL", p).alias("ce"), f("TRUNC", p - 1200).alias("tr"), r(f("POWER", s, F.lit(2))).alias("po"), r(f("SQRT", s)).alias("sq"),
        f("SIGN", s - 25).alias("sg"), f("DIV", s, F.lit(7)).cast("int").alias("dv"), f("MOD", s, F.lit(7)).alias("md"), r(f("LN", s)).alias("l"), r(f("LOG10", s)).alias("l10"), r(f("SIN", s)).alias("sn"), r(f("ATAN2", s.cast("double"), F.lit(3.0))).alias("at"), r(f("EXP", s / 50.0)).alias("ex"),
    )


@query("""SELECT p_partkey, p_brand || '-' || p_size AS c, length(p_name) AS n, lower(p_name) AS lo, upper(p_name) AS up, substring(p_name, 2, 3) AS s3, substring(p_name, 3) AS s, strpos(p_name, 'a') AS ps,
  replace(p_name, 'a', 'XX') AS rp, regexp_replace(p_name, '[aeiou]', '_', 'g') AS ra, regexp_replace(p_name, '[aeiou]', '_') AS rf, nullif(regexp_extract(p_name, '[a-f]{2,}'), '') AS rx FROM part""")
def q_strings(spark, d):
    n, f = F.col("p_name"), S.scalar
    return read(spark, d, "part").select(
        "p_partkey", f("CONCAT", F.col("p_brand"), F.lit("-"), F.col("p_size")).alias("c"), f("CHAR_LENGTH", n).cast("bigint").alias("n"), f("LOWER", n).alias("lo"), f("UPPER", n).alias("up"), f("SUBSTRING", n, F.lit(2), F.lit(3)).alias("s3"), f("SUBSTRING", n, F.lit(3)).alias("s"),
        f("STRPOS", n, F.lit("a")).cast("bigint").alias("ps"), f("REPLACE", n, F.lit("a"), F.lit("XX")).alias("rp"), f("REPLACEALL", n, F.lit("[aeiou]"), F.lit("_")).alias("ra"), f("REPLACEFIRST", n, F.lit("[aeiou]"), F.lit("_")).alias("rf"), f("SUBSTRING_REGEX", n, F.lit("[a-f]{2,}")).alias("rx"),
    )


@query("""SELECT o_orderkey, coalesce(x, -1) AS co, nullif(o_orderstatus, 'F') AS nu, CASE WHEN x IS NULL THEN NULL ELSE greatest(x, 150000) END AS gr, CASE WHEN x IS NULL THEN NULL ELSE least(x, 150000) END AS le,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS ca FROM (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS x FROM orders)""")
def q_conditional(spark, d):
    x, st = F.col("x"), F.col("o_orderstatus")
    df = read(spark, d, "orders").withColumn("x", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")))
    return df.select("o_orderkey", F.coalesce(x, F.lit(-1.0)).alias("co"), S.scalar("NULLIF", st, F.lit("F")).alias("nu"), S.scalar("GREATEST", x, F.lit(150000.0)).alias("gr"), S.scalar("LEAST", x, F.lit(150000.0)).alias("le"), F.when(st == "F", 1).when(st == "O", 2).otherwise(3).alias("ca"))


@query("""SELECT o_orderkey, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(dayofmonth(o_orderdate) AS INTEGER) AS dm,
  CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS dw, CAST(dayofyear(o_orderdate) AS INTEGER) AS dy, CAST(o_orderdate AS DATE) + 3 AS d3, epoch_ms(o_orderdate) AS ms, epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1995-01-01') AS df,
  date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * 86400000 AS dd, o_orderdate + INTERVAL 90 MINUTE AS t90, monthname(o_orderdate) AS mn FROM orders""")
def q_dates(spark, d):
    t, f = F.col("o_orderdate"), S.scalar
    day, start = t.cast("date"), F.lit("1995-01-01").cast("date")
    return read(spark, d, "orders").select(
        "o_orderkey", S.date_part("QUARTER", t).alias("q"), S.date_part("MONTH", t).alias("m"), S.date_part("YEAR", t).alias("y"), S.date_part("DAY_OF_MONTH", t).alias("dm"), S.date_part("DAY_OF_WEEK", t).alias("dw"), S.date_part("DAY_OF_YEAR", t).alias("dy"), f("DATE_ADD", day, F.lit(3)).alias("d3"), f("TIMESTAMP_UNIX", t).alias("ms"),
        f("TIMESTAMP_DIFF", t, start).alias("df"), f("DATE_DIFF", day, start).alias("dd"), f("TIMESTAMP_ADD", t, f("MINUTES", F.lit(90))).alias("t90"), S.date_partstr("MONTH", t).alias("mn"),
    )


@query("""SELECT event_id, make_date(2024, 2, CAST(event_id % 28 + 1 AS INTEGER)) AS md, strptime('2024-03-05 10:11:12', '%Y-%m-%d %H:%M:%S') AS ts, CAST(strptime('05/03/2024', '%d/%m/%Y') AS DATE) AS dt, (event_id % 7) * 3600000 AS h
FROM events""")
def q_date_construction(spark, d):
    e, f = F.col("event_id"), S.scalar
    return read(spark, d, "events").select("event_id", f("TODATE_PARTS", F.lit(2024), F.lit("february"), (e % 28 + 1).cast("int")).alias("md"), f("TOTIMESTAMP", F.lit("2024-03-05 10:11:12"), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"), f("TODATE", F.lit("05/03/2024"), F.lit("dd/MM/yyyy")).alias("dt"), f("HOURS", e % 7).alias("h"))


@query("SELECT event_id, CAST(floor(value + 0.5) AS INTEGER) AS i, CAST(value AS VARCHAR) IS NOT NULL AS s, event_id % 2 = 0 AS b, CAST(ts AS DATE) AS d FROM events WHERE value >= 0")
def q_casts(spark, d):
    v = F.col("value")
    truth = F.when(F.col("event_id") % 2 == 0, "TRUE").otherwise("false")
    return read(spark, d, "events").where("value >= 0").select("event_id", casts.cast(v, "int", "double").alias("i"), v.cast("string").isNotNull().alias("s"), casts.cast(truth, "boolean", "string").alias("b"), F.col("ts").cast("date").alias("d"))


# Aggregates

_STATS = {"vp": "var_pop", "vs": "var_samp", "sp": "stddev_pop", "ss": "stddev_samp", "sk": "skewness", "ks": "kurtosis", "kp": "kurtosis_pop"}


@query("SELECT l_returnflag, " + ", ".join(f"round({f}(l_extendedprice), 4) AS {n}" for n, f in _STATS.items()) + ", count(DISTINCT l_suppkey) AS cd, min(l_tax) AS mi, max(l_tax) AS ma, bool_and(l_quantity > 0) AS ba, bool_or(l_quantity > 49) AS bo FROM lineitem GROUP BY l_returnflag")
def q_statistics(spark, d):
    x, a = F.col("l_extendedprice"), A.aggregate
    names = {"vp": "VAR_POP", "vs": "VARIANCE", "sp": "STDDEV_POP", "ss": "STDDEV", "sk": "SKEW", "ks": "KURTOSIS", "kp": "KURTOSIS_POP"}
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(*[r(a(f, x), 4).alias(n) for n, f in names.items()], a("COUNT", F.col("l_suppkey"), distinct=True).alias("cd"), a("MIN", F.col("l_tax")).alias("mi"), a("MAX", F.col("l_tax")).alias("ma"), a("EVERY", F.col("l_quantity") > 0).alias("ba"), a("BOOL_OR", F.col("l_quantity") > 49).alias("bo"))


_PAIRS = {"corr": 1, "covar_pop": 1e4, "covar_samp": 1e4, "regr_avgx": 1, "regr_avgy": 1e3, "regr_slope": 1e3, "regr_intercept": 1e3, "regr_r2": 1, "regr_sxx": 1e7, "regr_syy": 1e14, "regr_sxy": 1e10}  # scales, as sums of doubles differ in their last digits


@query("SELECT l_linestatus, regr_count(l_extendedprice, l_quantity) AS n, " + ", ".join(f"round({f}(l_extendedprice, l_quantity) / {k}, 4) AS {f}_" for f, k in _PAIRS.items()) + " FROM lineitem GROUP BY l_linestatus")
def q_regression(spark, d):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return read(spark, d, "lineitem").groupBy("l_linestatus").agg(A.aggregate("REGR_COUNT", y, x).cast("bigint").alias("n"), *[r(A.aggregate(f, y, x) / k, 4).alias(f"{f}_") for f, k in _PAIRS.items()])


@query("""WITH m AS (SELECT l_returnflag, sum(l_quantity) AS w, sum(l_quantity * y) / sum(l_quantity) AS a FROM (SELECT *, l_extendedprice / 1000 AS y FROM lineitem) GROUP BY 1)
SELECT l_returnflag, round(any_value(a), 5) AS avg_, round(sum(l_quantity * (l_extendedprice / 1000 - a) ^ 2) / any_value(w), 5) AS var_, round(sqrt(sum(l_quantity * (l_extendedprice / 1000 - a) ^ 2) / any_value(w)), 5) AS sd,
  round((sum(l_quantity * (l_extendedprice / 1000 - a) ^ 3) / any_value(w)) / (sum(l_quantity * (l_extendedprice / 1000 - a) ^ 2) / any_value(w)) ^ 1.5, 5) AS skew,
  round((sum(l_quantity * (l_extendedprice / 1000 - a) ^ 4) / any_value(w)) / (sum(l_quantity * (l_extendedprice / 1000 - a) ^ 2) / any_value(w)) ^ 2 - 3, 5) AS kurt FROM lineitem JOIN m USING (l_returnflag) GROUP BY l_returnflag""")
def q_weighted(spark, d):
    y, w = F.col("l_extendedprice") / 1000, F.col("l_quantity")
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(*[r(A.aggregate(f, y, w), 5).alias(n) for n, f in {"avg_": "AVG", "var_": "VARIANCE", "sd": "STDDEV", "skew": "SKEW", "kurt": "KURTOSIS"}.items()])


@query("SELECT user_id, string_agg(event_type, ', ' ORDER BY ts, event_id) AS path FROM events GROUP BY user_id")
def q_string_agg(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(A.string_agg(F.col("event_type"), [F.col("ts"), F.col("event_id")]).alias("path"))


# Sequences

_W = "(PARTITION BY user_id ORDER BY ts, event_id)"


@query(f"SELECT event_id, round(sum(value) OVER {_W}, 6) AS s, count(*) OVER {_W} AS n, max(value) OVER {_W} AS m FROM events")
def q_running(spark, d):
    return sequence.running(by_user(spark, d), s=F.sum("value"), n=F.count(F.lit(1)), m=F.max("value")).select("event_id", r(F.col("s")).alias("s"), "n", "m")


@query(f"SELECT event_id, first_value(value) OVER {_W} AS first, CASE WHEN row_number() OVER {_W} >= 3 THEN nth_value(value, 3) OVER {_W} END AS third, lag(value, 1) OVER {_W} AS prev, lag(value, 2, -1.0) OVER {_W} AS prev2, coalesce(CASE WHEN row_number() OVER {_W} >= 4 THEN nth_value(event_type, 4) OVER {_W} END, 'none') AS fourth FROM events")
def q_index(spark, d):
    rel = by_user(spark, d)
    return rel.df.select("event_id", sequence.at(rel, "value", 0).alias("first"), sequence.at(rel, "value", 2).alias("third"), sequence.at(rel, "value", -1).alias("prev"), sequence.lag(rel, F.col("value"), 2, -1.0).alias("prev2"), sequence.nth_value(rel, "event_type", 4, F.lit("none")).alias("fourth"))


@query("SELECT event_id, rank() OVER (PARTITION BY user_id ORDER BY event_type) AS rk, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS dr FROM events")
def q_rank(spark, d):
    rel = by_user(spark, d)
    rank, dense = sequence.ranked(rel, ascending("event_type"))
    return rel.df.select("event_id", rank.alias("rk"), dense.alias("dr"))


_KNOWN = f"(SELECT event_id, user_id, x, count(x) OVER {_W} AS c FROM (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS x FROM events))"


@query(f"SELECT a.event_id, CASE WHEN a.c > 0 THEN round(avg(x) OVER (PARTITION BY user_id ORDER BY c RANGE BETWEEN 4 PRECEDING AND CURRENT ROW), 6) END AS mv FROM {_KNOWN} a")
def q_movavg(spark, d):
    rel = by_user(spark, d)
    rel = rel.having(rel.df.withColumn("x", F.when(F.col("event_type") != "error", F.col("value"))))
    return sequence.movavg(rel, "x", 5, "mv").select("event_id", r(F.col("mv")).alias("mv"))


@query(f"SELECT a.event_id, CASE WHEN a.c > 0 THEN round(stddev_samp(x) OVER (PARTITION BY user_id ORDER BY c RANGE BETWEEN 4 PRECEDING AND CURRENT ROW), 6) END AS sd FROM {_KNOWN} a")
def q_movstddev(spark, d):
    rel = by_user(spark, d)
    rel = rel.having(rel.df.withColumn("x", F.when(F.col("event_type") != "error", F.col("value"))))
    return sequence.movstddev(rel, "x", 5, "sd").select("event_id", r(F.col("sd")).alias("sd"))


@query("""WITH RECURSIVE n AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT event_id, user_id, k, value AS a FROM n WHERE k = 1 UNION ALL SELECT n.event_id, n.user_id, n.k, 0.7 * s.a + 0.3 * n.value FROM s JOIN n ON n.user_id = s.user_id AND n.k = s.k + 1)
SELECT event_id, round(a, 6) AS ema FROM s""")
def q_expmovavg(spark, d):
    return sequence.expmovavg(by_user(spark, d), "value", 0.3, "ema").select("event_id", r(F.col("ema")).alias("ema"))


@query("""SELECT o_orderkey, o_custkey, 'MAX' AS kind FROM (SELECT *, max(o_orderpriority) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_orderpriority = m
UNION ALL SELECT o_orderkey, o_custkey, 'MIN' FROM (SELECT *, min(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_totalprice = m""")
def q_arg(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    rel = Rel(o).partition_by("o_custkey")
    top = sequence.arg(rel, ("MAX", F.col("o_orderpriority"))).withColumn("kind", F.lit("MAX"))
    return top.unionAll(sequence.arg(rel, ("MIN", F.col("o_totalprice"))).withColumn("kind", F.lit("MIN"))).select("o_orderkey", "o_custkey", "kind")


@query("""SELECT user_id, round(sum(CASE WHEN event_type = 'click' THEN value END), 6) AS clicks, round(sum(CASE WHEN event_type IN ('view', 'signup') THEN value END), 6) AS VIEW_SIGNUP FROM events GROUP BY user_id""")
def q_pivot(spark, d):
    rel = Rel(read(spark, d, "events")).partition_by("user_id")
    return sequence.pivot(rel, lambda x: r(F.sum(x)), F.col("value"), "event_type", [(["click"], "clicks"), (["view", "signup"], None)])


@query("SELECT * FROM (SELECT l_quantity AS v, 'L_QUANTITY' AS k, l_orderkey FROM lineitem UNION ALL SELECT l_tax, 'tax', l_orderkey FROM lineitem)")
def q_unpivot(spark, d):
    return sequence.unpivot(read(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_tax"), "v", "k", [("l_quantity", None), ("l_tax", "tax")])


@query("""WITH i AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS lo, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 + 1 AS INTEGER) AS hi FROM orders),
b AS (SELECT DISTINCT o_custkey, pt FROM (SELECT o_custkey, lo AS pt FROM i UNION ALL SELECT o_custkey, hi FROM i)), p AS (SELECT o_custkey, pt AS out_lo, lead(pt) OVER (PARTITION BY o_custkey ORDER BY pt) AS out_hi FROM b)
SELECT out_lo, out_hi, i.o_custkey, o_orderkey FROM i JOIN p ON p.o_custkey = i.o_custkey AND out_lo >= lo AND out_hi <= hi""")
def q_split(spark, d):
    day = F.col("o_orderdate").cast("date")
    df = read(spark, d, "orders").select("o_custkey", "o_orderkey", day.alias("lo"), F.date_add(day, (F.col("o_orderkey") % 30 + 1).cast("int")).alias("hi"))
    return sequence.split(Rel(df).partition_by("o_custkey"), "lo", "hi", "out_lo", "out_hi").select("out_lo", "out_hi", "o_custkey", "o_orderkey")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS k FROM events)
SELECT a.user_id, a.event_id AS left_id, b.event_id AS right_id FROM n a JOIN n b ON a.user_id = b.user_id AND a.k = b.k AND a.event_type = 'click' AND b.event_type = 'view'""")
def q_align_zip(spark, d):
    e = read(spark, d, "events")
    a, b = (Rel(e.where(F.col("event_type") == kind).select("user_id", "ts", F.col("event_id").alias(name))).partition_by("user_id").ordered_by("ts", name) for kind, name in (("click", "left_id"), ("view", "right_id")))
    return align.zip_rows(a, b).select("user_id", "left_id", "right_id")


@query()
def q_align_dtw(spark, d):
    e = read(spark, d, "events")
    a, b = (Rel(e.where(F.col("event_type") == kind).select("user_id", F.col("ts").alias(f"t{i}"), F.col("value").alias(f"v{i}"))).partition_by("user_id").ordered_by(f"t{i}") for i, kind in enumerate(("click", "view")))
    return align.align(a, b, ("v0", "v1"), margin=3).select("user_id", "t0", "v0", "t1", "v1")


_LETTERS = {"view": "v", "click": "c", "purchase": "p", "signup": "s", "error": "e"}
_RUNS = """WITH t AS (SELECT user_id, string_agg(CASE event_type WHEN 'view' THEN 'v' WHEN 'click' THEN 'c' WHEN 'purchase' THEN 'p' WHEN 'signup' THEN 's' ELSE 'e' END, '' ORDER BY ts, event_id) AS s FROM events GROUP BY user_id)
SELECT user_id, m AS matched FROM (SELECT user_id, unnest(regexp_extract_all(s, '(v+c|c+p)')) AS m FROM t)"""


@query("""WITH t AS (SELECT user_id, string_agg(CASE event_type WHEN 'view' THEN 'v' WHEN 'click' THEN 'c' WHEN 'purchase' THEN 'p' WHEN 'signup' THEN 's' ELSE 'e' END, '' ORDER BY ts, event_id) AS s FROM events GROUP BY user_id)
SELECT user_id, len(regexp_extract_all(s, 'v+c')) AS n, CAST(len(array_to_string(regexp_extract_all(s, 'v+c'), '')) AS BIGINT) AS n_rows FROM t WHERE len(regexp_extract_all(s, 'v+c')) > 0""")
def q_match(spark, d):
    found = match.match_rows(by_user(spark, d), "VIEW+ CLICK", F.col("event_type"))
    return found.groupBy("user_id").agg(F.max("match_id").cast("bigint").alias("n"), F.count(F.lit(1)).alias("n_rows"))


@query(_RUNS)
def q_match_text(spark, d):
    letter = F.create_map(*[F.lit(x) for pair in _LETTERS.items() for x in pair])[F.col("event_type")]
    return match.match_text(by_user(spark, d), "(v+c|c+p)", letter)


@query("""WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
a AS (SELECT user_id, min(k) AS lo FROM n WHERE value < 40 GROUP BY 1), b AS (SELECT n.user_id, any_value(lo) AS lo, max(k) AS hi FROM n JOIN a USING (user_id) WHERE value > 60 AND k > lo GROUP BY 1)
SELECT user_id, CAST(1 AS INTEGER) AS match_id, count(*) AS n, round(sum(value), 6) AS total, count(CASE WHEN value > 60 THEN 1 END) AS highs FROM n JOIN b USING (user_id) WHERE k BETWEEN lo AND hi GROUP BY user_id""")
def q_match_labels(spark, d):
    rel = by_user(spark, d)
    df = match.label_column(rel, [("high", F.col("value") > 60), ("low", F.col("value") < 40), ("any", F.lit(True))])
    return match.match_summary(rel.having(df), "low any* high", F.col("_labels"), n=lambda: F.count(F.lit(1)), total=lambda: r(F.sum("value")), highs=lambda: F.count(F.when(F.array_contains("_labels", "HIGH"), 1)))


@query("SELECT user_id, string_agg(upper(event_type), '>' ORDER BY ts, event_id) AS path FROM events GROUP BY user_id")
def q_path(spark, d):
    rel = by_user(spark, d)
    return sequence.path(rel.having(rel.df.withColumn("label", F.upper("event_type"))), "label", ">", "path")


# Types, text, transforms


@query("SELECT l_orderkey AS a, l_quantity AS b, l_returnflag AS c, CAST(l_shipdate AS DATE) AS e FROM lineitem")
def q_typeinfer(spark, d):
    df = read(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("a"), F.col("l_quantity").cast("string").alias("b"), F.col("l_returnflag").alias("c"), F.col("l_shipdate").cast("date").cast("string").alias("e"))
    return infer.infer_types(df).select(F.col("a").cast("bigint"), "b", "c", "e")


@query("SELECT event_id, CASE WHEN regexp_matches(props, '\"k\": *([0-9]+)') THEN regexp_extract(props, '\"k\": *([0-9]+)', 1) END AS k FROM events")
def q_text_parse(spark, d):
    return text.parse(read(spark, d, "events"), r'"k": *([0-9]+)', "props", ["k"]).select("event_id", "k")


@query("""SELECT event_type, round(m + b * 12.5, 6) AS xmin, round(m + b * 12.5 + 12.5, 6) AS xmax, count(*) AS freq
FROM (SELECT e.event_type, m, floor((value - m) / 12.5) AS b FROM events e JOIN (SELECT event_type, min(value) AS m FROM events GROUP BY 1) x ON x.event_type = e.event_type) GROUP BY event_type, m, b""")
def q_bin(spark, d):
    return transform.bins(read(spark, d, "events"), "value", 12.5, ("event_type",)).select("event_type", r(F.col("xmin")).alias("xmin"), r(F.col("xmax")).alias("xmax"), "freq")


@query("""SELECT i * 5.0 AS xmin, i * 5.0 + 5 AS xmax, j * 0.02 AS ymin, freq, round(freq / max(freq) OVER (), 6) AS nfreq FROM (
SELECT floor(l_quantity / 5) AS i, floor(l_tax / 0.02) AS j, count(*) AS freq FROM lineitem GROUP BY 1, 2)""")
def q_bin2d(spark, d):
    return transform.bins2d(read(spark, d, "lineitem"), "l_quantity", "l_tax", (5.0, 0.02)).select("xmin", "xmax", "ymin", "freq", r(F.col("nfreq")).alias("nfreq"))


@query(f"SELECT event_id, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS below, row_number() OVER {_W} - 1 AS stackindex FROM events")
def q_stack(spark, d):
    return transform.stack(by_user(spark, d), "value").select("event_id", r(F.col("below")).alias("below"), F.col("stackindex").cast("bigint").alias("stackindex"))


@query(f"SELECT event_id, round((row_number() OVER {_W} - 1 + 0.7) / (count(*) OVER (PARTITION BY user_id) + 0.4), 6) AS dodge FROM events")
def q_dodge(spark, d):
    return transform.dodge(by_user(spark, d)).select("event_id", r(F.col("dodge")).alias("dodge"))


@query()
def q_jitter(spark, d):
    return transform.jitter(read(spark, d, "events"), "value", seed=3).select("event_id", "value")


@query()
def q_loess(spark, d):
    e = read(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")
    return transform.loess(e, "t", "value", ("user_id",))


@query(f"SELECT user_id, ts, event_id, value, round(sum(value) OVER {_W}, 6) AS total FROM events")
def q_transform_join(spark, d):
    found = transform.join_transform(by_user(spark, d).having(read(spark, d, "events").select("user_id", "ts", "event_id", "value")), ["value"], lambda pdf: [(float(x),) for x in pdf["value"].cumsum()], {"total": "double"})
    return found.withColumn("total", r(F.col("total")))


# Learning


def _features(spark, d):
    return read(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_returnflag")


@query()
def q_classified(spark, d):
    df = _features(spark, d)
    return ml.classify(df, ml.train_classifier(df, "l_returnflag", maxDepth=3), "predicted").groupBy("predicted").count()


@query()
def q_clustered(spark, d):
    df = _features(spark, d).select("l_quantity", "l_discount")
    return ml.cluster(df, ml.train_clusterer(df, 3), "cluster").groupBy("cluster").count()


@query()
def q_imputed(spark, d):
    df = _features(spark, d).withColumn("l_returnflag", F.when(F.col("l_quantity") > 5, F.col("l_returnflag")))
    return ml.impute(df, "l_returnflag", ml.train_classifier(df, "l_returnflag", maxDepth=3), "guessed").groupBy("l_returnflag", "guessed").count()


# Streams


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY 1, 2")
def q_stream_tumbling(spark, d):
    schema = read(spark, d, "events").schema
    stream = _stream(spark, d, schema)
    found = windows.windowed(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", [F.count(F.lit(1)).alias("n"), F.sum("value").alias("s")], ("event_type",))
    return windows.run_to_end(spark, found).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", r(F.col("s"), 4).alias("s"))


def _stream(spark, d, schema):
    return spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def q_sessions(spark, d):
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = windows.sessions(e, "ts", "6 hours", [F.count(F.lit(1)).alias("n")], ("user_id",))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})
