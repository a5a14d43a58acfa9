from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rowloom.operators import align, infer, match, ml, relational, sequence, transform
from rowloom.plans.parser import parse
from rowloom.rel import Rel
from rowloom.session import Engine


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.register("prices", spark.createDataFrame([("a", 1, 10.0), ("a", 2, 12.0), ("a", 3, None), ("a", 4, 11.0), ("b", 1, 5.0), ("b", 2, 7.0)], "k string, t int, price double"))
    e.register("labels_", spark.createDataFrame([(1, i, x) for i, x in enumerate("AABAB")], "g int, t int, l string"))
    return e


def rows(df):
    return [tuple(r) for r in df.collect()]


def run(engine, text):
    return rows(engine.sql(text))


def test_values(engine):
    df = engine.sql("values (1), (2) as X(A)")
    assert (df.columns, rows(df)) == (["A"], [(1,), (2,)])
    assert run(engine, """select "b'ar" as foo""") == [("b'ar",)]


@pytest.mark.parametrize(
    "text",
    [
        "CREATE TABLE shelf(id BIGINT PRIMARY KEY, label VARCHAR(20) NOT NULL)",
        "CREATE TABLE book(isbn CHAR(13) PRIMARY KEY REFERENCES shelf(id), price DECIMAL(8, 2) NULL)",
        "CREATE TEMP TABLE loan(book CHAR(13), since DATE, PRIMARY KEY(book, since), FOREIGN KEY(book) REFERENCES book)",
        "CREATE CLASSIFIER genre(kind) USING SELECT kind, pages FROM book",
        "CREATE TABLE a(n INT); CREATE TABLE b(n INT REFERENCES a REFERENCES shelf)",
    ],
)
def test_statements_that_parse(text):
    parse(text)


@pytest.mark.parametrize("keys", ["id INT PRIMARY KEY, code INT PRIMARY KEY", "id INT PRIMARY KEY, code INT, PRIMARY KEY(code)", "id INT, code INT, PRIMARY KEY(id), PRIMARY KEY(code)"])
def test_one_primary_key(keys):
    with pytest.raises(ValueError, match="primary keys"):
        parse(f"CREATE TABLE shelf({keys})")


@pytest.mark.parametrize("text", ["UP", "UP+", "UP? DOWN*", "(UP|DOWN)+ FLAT", "^UP.(FLAT|DOWN)$", "(UP DOWN)+.FLAT?", "UP|(DOWN FLAT)*"])
def test_row_expressions_that_parse(text):
    match.parse(text)


def test_select(engine):
    assert run(engine, "SELECT k, SUM(price) AS s, count(*) n FROM prices GROUP BY k HAVING count(*) > 2 ORDER BY k") == [("a", 33.0, 4)]
    assert run(engine, "SELECT t + 1 AS u FROM prices WHERE k = 'b' ORDER BY u DESC LIMIT 1") == [(3,)]
    assert sorted(run(engine, "SELECT DISTINCT ON (k) k, price FROM prices ORDER BY price DESC")) == [("a", None), ("b", 7.0)]
    assert run(engine, "SELECT price FROM prices WHERE k = 'a' ORDER BY price") == [(10.0,), (11.0,), (12.0,), (None,)]
    assert run(engine, "SELECT price FROM prices WHERE k = 'a' ORDER BY price DESC FETCH FIRST 2 ROWS ONLY") == [(None,), (12.0,)]
    assert run(engine, "SELECT 7 / 2 AS a, 2 ^ 3 AS b, CAST(2.5 AS INT) AS c, 'x' || 'y' AS d, 3 BETWEEN SYMMETRIC 5 AND 1 AS e, 5 > ALL (1, 2) AS f, 'abc' SIMILAR TO 'a.*' AS g, DATE '2020-01-31' + 1 AS h, DATE '2020-01-02' - DATE '2020-01-01' AS i")[0][:7] == (3, 8.0, 3, "xy", True, True, True)
    assert run(engine, "SELECT DATE '2020-01-02' - DATE '2020-01-01' AS i") == [(86400000,)]
    assert run(engine, "SELECT p.k, q.t FROM prices p JOIN prices q ON p.k = q.k AND p.t = q.t + 1 WHERE p.k = 'b'") == [("b", 1)]
    assert run(engine, "SELECT k FROM prices WHERE price > (SELECT avg(price) FROM prices) ORDER BY k, t")[0] == ("a",)
    assert run(engine, "SELECT k FROM prices WHERE k IN (SELECT k FROM prices WHERE price < 6) ORDER BY t") == [("b",), ("b",)]
    assert run(engine, "SELECT k FROM prices WHERE price >= ALL (SELECT price FROM prices WHERE price IS NOT NULL)") == [("a",)]
    assert sorted(run(engine, "SELECT k FROM prices UNION SELECT 'c'")) == [("a",), ("b",), ("c",)]
    assert run(engine, "VALUES (1), (1) EXCEPT VALUES (1)") == []


def test_sequences(engine):
    ordered = "prices AS T PARTITION BY k ORDERED BY (t)"
    assert run(engine, f"SELECT k, T[-1].price AS p, T[0].price AS f, T.sum(price) AS s FROM {ordered} ORDER BY k, s") [:1] == [("a", None, 10.0, 10.0)]
    found = run(engine, f"SELECT k, t, T.movavg(price, 2) AS m, T.expmovavg(price, 0.5) AS e, T.row_number() AS n FROM {ordered} ORDER BY k, t")
    assert [(r[2], r[3]) for r in found[:4]] == [(10.0, 10.0), (11.0, 11.0), (11.0, 11.0), (11.5, 11.0)]
    assert sorted(run(engine, "SELECT k, t FROM prices PARTITION BY k ARG MAX(price)")) == [("a", 2), ("b", 2)]
    assert sorted(run(engine, "SELECT k, x, yz FROM prices PARTITION BY k PIVOT SUM(price) FOR t IN (1 AS x, LABEL(2, 4) AS yz)")) == [("a", 10.0, 23.0), ("b", 5.0, 7.0)]
    assert sorted(run(engine, "SELECT A.count(*) AS n, B.t AS last FROM labels_ PARTITION BY g ORDERED BY (t) MATCH \"A B\" ON l")) == [(1, 2), (1, 4)]


def test_split(spark):
    df = spark.createDataFrame([("a", 1, 10), ("b", 3, 5), ("c", 4, 12), ("d", 20, 22)], "r string, lo int, hi int").selectExpr("1 AS p", "*")
    found = sorted((x.a, x.b, x.r) for x in sequence.split(Rel(df, partition=("p",)), "lo", "hi", "a", "b").collect())
    assert found == [(1, 3, "a"), (3, 4, "a"), (3, 4, "b"), (4, 5, "a"), (4, 5, "b"), (4, 5, "c"), (5, 10, "a"), (5, 10, "c"), (10, 12, "c"), (20, 22, "d")]
    with pytest.raises(Exception, match="not below"):
        sequence.split(Rel(df.withColumn("hi", df.lo), partition=("p",)), "lo", "hi", "a", "b").collect()


def test_warping():
    path = align.warp(lambda i, j: abs([1, 2, 3, 3][i] - [1, 1, 2, 3][j]), 4, 4)
    assert sum(abs([1, 2, 3, 3][i] - [1, 1, 2, 3][j]) for i, j in path) == 0
    assert align.warp(lambda i, j: abs([9, 1, 2, 3][i] - [1, 2, 3][j]), 4, 3, 1) == [(1, 0), (2, 1), (3, 2)]


def test_match_policy():
    labels = [{x} for x in "AABAB"]
    assert match.spans(match.parse("^A+$"), labels) == []
    assert match.spans(match.parse("^A+"), labels) == [(0, 0), (0, 1)]
    assert match.spans(match.parse("A.B"), labels) == [(1, 2), (3, 4)]


def test_moving_averages(spark):
    rel = Rel(spark.createDataFrame([(1, i, x) for i, x in enumerate([1.0, None, 3.0, 5.0, 9.0])], "g int, t int, x double")).partition_by("g").ordered_by("t")
    assert [r.m for r in sequence.movavg(rel, "x", 2, "m").orderBy("t").collect()] == [1, 1, 2, 4, 7]
    assert [r.m for r in sequence.expmovavg(rel, "x", 0.5, "m").orderBy("t").collect()] == [1, 1, 2, 3.5, 6.25]


def test_reshaping(spark):
    df = spark.createDataFrame([(1, 10, None)], "id int, p int, q int")
    assert rows(sequence.unpivot(df, "val", "key", [("p", None), ("q", "Q2")])) == [(10, "P", 1), (None, "Q2", 1)]
    ties = Rel(spark.createDataFrame([(1, 5), (2, 7), (3, 7), (4, None)], "k int, v int"))
    assert [r.k for r in sequence.arg(ties.partition_by(), ("MIN", ties.df.v), ("MAX", ties.df.v)).collect()] == [1, 2, 3]


@pytest.mark.parametrize(("values", "kind", "nulls"), [(["1", "2", "x"], "string", []), (["1", "3000000000"], "bigint", []), (["1", "2.5"], "double", []), (["NA", "4"], "int", ["NA"]), (["2020-01-01"], "date", [])])
def test_typeinfer(spark, values, kind, nulls):
    assert infer.infer_types(spark.createDataFrame([(v,) for v in values], "x string"), nulls=nulls).dtypes == [("x", kind)]


@pytest.mark.parametrize(("values", "kind"), [(["10:30", "23:59:59.5"], "time(6)"), (["1", "x"], "string"), (["1", "2"], "int")])
def test_typeinfer_in_a_session_without_an_engine(spark, values, kind):
    spark.conf.set("spark.sql.timeType.enabled", "false")
    try:
        found = infer.infer_types(spark.createDataFrame([(v,) for v in values], "x string"))
        assert (found.dtypes, found.count()) == ([("x", kind)], len(values))
    finally:
        spark.conf.set("spark.sql.timeType.enabled", "true")


def test_loess_follows_a_line():
    import numpy as np

    x = np.arange(20.0)
    assert np.allclose(transform.loess_fit(x, 3 * x + 1), 3 * x + 1)


def test_tables(engine, tmp_path):
    engine.execute("CREATE TABLE made_up AS SELECT k, t FROM prices")
    try:
        engine.execute("INSERT INTO made_up VALUES ('z', 9); UPDATE made_up SET t = t + 1 WHERE k = 'b'; DELETE FROM made_up WHERE k = 'a'")
        assert sorted(run(engine, "SELECT * FROM made_up")) == [("b", 2), ("b", 3), ("z", 9)]
    finally:
        engine.execute("DROP TABLE made_up")
    engine.execute(f"CREATE EXTERNAL PARQUET('{tmp_path}/x') AS SELECT k FROM prices WHERE t = 1")
    assert sorted(run(engine, f"SELECT k FROM EXTERNAL PARQUET('{tmp_path}/x')")) == [("a",), ("b",)]
    assert run(engine, "SELECT count(*) AS n FROM SEQUENCE(5)") == [(5,)]


def test_learners(engine, spark):
    engine.register("points", spark.createDataFrame([(float(i), "hi" if i > 20 else "lo") for i in range(40)], "x double, c string"))
    engine.execute("CREATE CLASSIFIER judge(c) USING SELECT x, c FROM points")
    assert sorted(run(engine, "SELECT x, guess FROM points CLASSIFIED WITH judge(guess) WHERE x IN (1, 30)")) == [(1.0, "lo"), (30.0, "hi")]


def test_joins_without_equal_keys_are_spread_over_blocks(engine, spark, monkeypatch):
    engine.register("wide", spark.createDataFrame([(i, i % 7) for i in range(60)] + [(None, 3)], "x int, y int").coalesce(1))
    engine.register("slim", spark.createDataFrame([(i, i % 5) for i in range(0, 90, 3)] + [(None, 1)], "u int, v int").coalesce(1))
    text = "SELECT w.x, s.u FROM wide w JOIN slim s ON w.y > 2 AND w.x < s.u"
    expected = sorted((x, u) for x in range(60) if x % 7 > 2 for u in range(0, 90, 3) if x < u)
    twice = "SELECT a.x, b.x AS z, s.u FROM wide a JOIN wide b ON a.x < b.x AND b.x < 9 JOIN slim s ON s.u < a.x"
    three = sorted((x, z, u) for z in range(9) for x in range(z) for u in range(0, 90, 3) if u < x)
    assert sorted(run(engine, text)) == expected
    for block, most in ((200, 10_000), (64, 6)):
        monkeypatch.setattr(relational, "BLOCK_BYTES", block)
        monkeypatch.setattr(relational, "MOST_BLOCKS", most)
        assert sorted(run(engine, text)) == expected
        assert engine.sql(text).rdd.getNumPartitions() >= 4
        assert sorted(run(engine, twice)) == three
        assert "_block" not in engine.sql("SELECT w.x FROM wide w JOIN slim s ON w.x = s.u AND w.y < s.v")._jdf.queryExecution().toString()


def test_clusterer_takes_equal_rows_as_one_point(spark, monkeypatch):
    seen = []

    class Watched(ml.KMeans):
        def fit(self, dataset):
            seen.append((dataset.count(), dataset.rdd.getNumPartitions()))
            return super().fit(dataset)

    monkeypatch.setitem(ml.CLUSTERERS, "KMEANS", Watched)
    df = spark.createDataFrame([(float(x), "ab"[x % 2]) for x in range(12)] * 50 + [(0.0, "a")] * 400, "x double, c string")
    centers = [[list(v) for v in ml.train_clusterer(df.repartition(n), 3).model.stages[-1].clusterCenters()] for n in (1, 3, 7)]
    assert seen == [(12, 1)] * 3
    assert centers[0] == centers[1] == centers[2]
    heavy = spark.createDataFrame([(0.0,)] * 9 + [(5.0,), (100.0,)], "x double")
    assert sorted(v[0] for v in ml.train_clusterer(heavy, 2).model.stages[-1].clusterCenters()) == pytest.approx([0.5, 100.0])
    monkeypatch.setattr(ml, "POINTS_IN_A_TASK", 5)
    assert sorted(r["count"] for r in ml.cluster(df, ml.train_clusterer(df, 12), "k").groupBy("k").count().collect()) == [50] * 11 + [450]
    assert seen[-1] == (12, 3)


def test_compounds_are_ordered_and_cut_as_a_whole(engine):
    assert run(engine, "SELECT t FROM prices WHERE k = 'a' UNION SELECT 9 ORDER BY t DESC LIMIT 2") == [(9,), (4,)]
    assert run(engine, "VALUES (3), (1) UNION ALL VALUES (2) ORDER BY 1") == [(1,), (2,), (3,)]
    assert run(engine, "VALUES (1), (2) EXCEPT VALUES (2) UNION VALUES (2) ORDER BY 1") == [(1,), (2,)]
    assert run(engine, "VALUES (2) UNION VALUES (1) EXCEPT VALUES (1) ORDER BY 1") == [(2,)]
    assert run(engine, "VALUES (1) UNION VALUES (2) INTERSECT VALUES (2) ORDER BY 1") == [(1,), (2,)]
    assert run(engine, "(SELECT t FROM prices WHERE k = 'a' ORDER BY t DESC LIMIT 1) UNION ALL (SELECT t FROM prices WHERE k = 'b' ORDER BY t LIMIT 1) ORDER BY t") == [(1,), (4,)]


def test_subqueries_see_the_query_around_them(engine):
    assert run(engine, "SELECT k, t FROM prices p WHERE price = (SELECT max(q.price) FROM prices q WHERE q.k = p.k) ORDER BY k") == [("a", 2), ("b", 2)]
    assert run(engine, "SELECT DISTINCT k FROM prices p WHERE EXISTS (SELECT 1 FROM labels_ WHERE labels_.t = p.t AND p.t > 2)") == [("a",)]
    assert run(engine, "SELECT t FROM labels_ WHERE t <> ALL (SELECT t FROM prices) ORDER BY t") == [(0,)]
    assert run(engine, "SELECT t FROM labels_ WHERE t = ANY (SELECT t FROM prices WHERE k = 'b') ORDER BY t") == [(1,), (2,)]
    assert run(engine, "SELECT t FROM labels_ WHERE t <> ALL (SELECT CASE WHEN t > 1 THEN t END FROM prices)") == []


def test_order_reaches_string_agg_and_paths(engine, spark):
    engine.register("letters", spark.createDataFrame([(1, 1, "z"), (1, 2, "m"), (1, 3, "b"), (1, 4, None)], "g int, t int, p string"))
    assert run(engine, "SELECT string_agg(p, '-') AS s FROM letters ORDERED BY (t) GROUP BY g") == [("z-m-b",)]
    assert run(engine, "SELECT string_agg(p, '-') AS s FROM letters ORDERED BY (t DESC) GROUP BY g") == [("b-m-z",)]
    assert sorted(run(engine, "SELECT PATH('/') AS p, A.PATH('/') AS a FROM labels_ PARTITION BY g ORDERED BY (t) MATCH \"A+ B\" ON l")) == [("A/A/B", "A/A"), ("A/B", "A")]


def test_functions_keep_whole_numbers(engine):
    big = 2**53 + 1
    assert run(engine, f"SELECT FLOOR(CAST('{big}' AS BIGINT)) AS a, CEIL(7) AS b, TRUNC(-7) AS c, DIV(CAST('{big}' AS BIGINT), 2) AS d, FLOOR(-2.5) AS e") == [(big, 7, -7, big // 2, -3.0)]
    assert run(engine, "SELECT REPLACEFIRST('ab-cd', '([a-c])(.)', '<$2$1>') AS a, REPLACEFIRST('xyz', 'q', 'r') AS b") == [("<ba>-cd", "xyz")]


def test_times(engine, spark):
    import datetime

    at = datetime.time
    assert run(engine, "SELECT TIME '10:11:12' AS a, TIME_ADD(TIME '23:59:59', 2000) AS b, TIME_DIFF(TIME '10:00:00', TIME '09:59:00') AS c, DATE_PART('SECOND', TIME '10:11:12') AS d") == [(at(10, 11, 12), at(0, 0, 1), 60000, 12)]
    df = spark.createDataFrame([("10:11", "1", "2020-01-01", "1e3"), ("23:59:59", "20000000000", "2020-01-01 10:00:00", "7"), (None, None, None, "x")], "a string, b string, c string, d string")
    assert infer.infer_types(df).dtypes == [("a", "time(6)"), ("b", "bigint"), ("c", "date"), ("d", "string")]


def test_moving_averages_in_sql_range_over_frames(engine):
    df = engine.sql("SELECT k, t, T.movavg(price, 2) AS m, T.movstddev(price, 3) AS s FROM prices AS T PARTITION BY k ORDERED BY (t)")
    plan = df._jdf.queryExecution().toString()
    assert "collect_list" not in plan
    assert "collect_list" not in engine.sql("SELECT T.expmovavg(price, 0.5) AS e FROM prices AS T PARTITION BY k ORDERED BY (t)")._jdf.queryExecution().toString()
    assert [(r.t, r.m) for r in df.where("k = 'a'").orderBy("t").collect()] == [(1, 10.0), (2, 11.0), (3, 11.0), (4, 11.5)]


def test_admin_statements(engine):
    other = Engine(engine.spark)
    other.execute("ADD LOCATION shelf AS H2MEM('x'); SET DEFAULT LOCATION = shelf")
    try:
        other.execute("CREATE TABLE boxes(a INT, b VARCHAR); SET CACHE LOCATION shelf")
        assert [tuple(r) for r in other.execute("LIST LOCATIONS")[0].collect()] == [("SHELF", "H2MEM", "x", "CACHE DEFAULT")]
        assert [(r.name, r.type) for r in other.execute("DESCRIBE TABLE shelf.boxes")[0].collect()] == [("a", "int"), ("b", "string")]
        assert [tuple(r) for r in other.execute("LIST REMAINING TABLES shelf")[0].collect()] == [("shelf", "boxes")]
        plans = other.execute("EXPLAIN SCRIPT ON; VALUES (1); EXPLAIN SCRIPT OFF; VALUES (1)")
        assert plans[1].columns == ["plan"]
        assert [tuple(r) for r in plans[3].collect()] == [(1,)]
        with pytest.raises(ValueError, match="no location"):
            other.execute("SET DEFAULT LOCATION = nowhere")
        other.execute("DROP SCHEMA; CREATE SCHEMA")
        assert other.execute("LIST LOCATIONS")[0].count() == 0
    finally:
        engine.spark.sql("USE default")
        engine.spark.sql("DROP DATABASE IF EXISTS shelf CASCADE")


def test_compare_all_of_equality(spark):
    from rowloom.operators.relational import compare_all

    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    values = lambda *v: spark.createDataFrame([(x,) for x in v], "y int")
    assert rows(compare_all(df, "x", "=", values(1, None), every=False)) == [(1,)]
    assert rows(compare_all(df, "x", "<>", values(1))) == [(2,)]
    assert rows(compare_all(df, "x", "<>", values(1, None))) == []
    assert len(rows(compare_all(df, "x", "<>", values()))) == 3
    assert rows(compare_all(df, "x", "<>", values(1, 1), every=False)) == [(2,)]


def test_arg_without_a_partition_is_an_aggregate(spark):
    df = spark.createDataFrame([(1, 5), (2, 7), (3, 7), (4, None)], "k int, v int")
    found = sequence.arg(Rel(df), ("MAX", df.v))
    assert sorted(r.k for r in found.collect()) == [2, 3]
    assert "Window" not in found._jdf.queryExecution().toString()
    assert rows(sequence.arg(Rel(df.where("false")), ("MIN", df.v))) == []


def test_running_average_over_a_stream(spark, tmp_path):
    from rowloom.streaming import windows

    held = [("a", 1, 1.0), ("a", 2, None), ("a", 3, 3.0), ("b", 1, 2.0)]
    spark.createDataFrame(held, "k string, s int, x double").selectExpr("k", "timestamp_seconds(s) AS t", "x").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, t timestamp, x double").parquet(f"{tmp_path}/in")
    found = windows.run_to_end(spark, windows.running_average(stream, "k", "t", "x", 0.5), "append").orderBy("k", "t").collect()
    assert [(r.k, r.average) for r in found] == [("a", 1.0), ("a", 1.0), ("a", 2.0), ("b", 2.0)]


def plain_warp(a, b, margin):
    """The cheapest alignment cost by trying all paths (both ends fixed)."""
    n, m = len(a), len(b)
    best = {}

    def cost(i, j):
        if i < 0 or j < 0 or abs(i - j) > margin:
            return float("inf")
        if (i, j) not in best:
            before = 0 if i == j == 0 else min(cost(i - 1, j), cost(i, j - 1), cost(i - 1, j - 1))
            best[i, j] = before + abs(a[i] - b[j])
        return best[i, j]

    return cost(n - 1, m - 1)


@pytest.mark.parametrize("margin", [1, 3, 20])
def test_warping_is_as_cheap_as_any_path(margin):
    import random

    rng = random.Random(margin)
    for _ in range(20):
        n = rng.randint(1, 9)
        a, b = ([rng.randint(0, 9) for _ in range(n)] for _ in "ab")
        path = align.warp(lambda i, j: abs(a[i] - b[j]), n, n, margin)
        assert sum(abs(a[i] - b[j]) for i, j in path) == plain_warp(a, b, margin)
        assert path[0] == (0, 0)
        assert path[-1] == (n - 1, n - 1)
        assert all((k - i, x - j) in ((0, 1), (1, 0), (1, 1)) for (i, j), (k, x) in zip(path, path[1:]))


def test_catalog_functions(engine):
    query = "SELECT PG_GET_USERBYID(0), PG_CATALOG.PG_TABLE_IS_VISIBLE(12), PG_GET_EXPR('x', 1), FORMAT_TYPE(20), FORMAT_TYPE(25, 3), FORMAT_TYPE(9)"
    assert run(engine, query) == [("rowloom", True, None, "bigint", "string", None)]


def test_bars(spark):
    rel = Rel(spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("b", 1, 5.0)], "k string, t int, v double"), ("t",), ("k",))
    side = {(r.k, r.t): (round(r.dodge, 6), round(r.barwidth, 6)) for r in transform.position("DODGE_BAR", rel, padding=0.4, outer_padding=0.2).collect()}
    assert side == {("a", 1): (0.1, 0.3), ("a", 2): (0.6, 0.3), ("b", 1): (0.2, 0.6)}
    high = {(r.k, r.t): (r.below, r.left, r.barwidth) for r in transform.position("stack_bar", rel, "v", padding=0.2).collect()}
    assert high == {("a", 1): (0.0, 0.1, 0.8), ("a", 2): (2.0, 0.1, 0.8), ("b", 1): (0.0, 0.1, 0.8)}
    assert transform.position("OFFSET", rel).count() == 3


def test_stats_by_name(spark):
    df = spark.createDataFrame([("a", 1.0, 10.0, 1.0), ("a", 1.5, 11.0, 1.0), ("a", 4.0, 14.0, 1.0), ("b", 7.0, 1.0, 1.0), ("b", None, 2.0, 1.0)], "k string, x double, y double, w double")
    assert sorted(rows(transform.stat("hist", df, "x", binwidth=2))) == [(1.0, 3.0, 2), (3.0, 5.0, 1), (7.0, 9.0, 1)]
    assert sorted(rows(transform.stat("BIN2D", df, "x", "y", ("k",), binwidth=2))) == [
        ("a", 1.0, 3.0, 10.0, 12.0, 2, 1.0),
        ("a", 3.0, 5.0, 14.0, 16.0, 1, 0.5),
        ("b", 7.0, 9.0, 1.0, 3.0, 1, 1.0),
    ]
    even, weighed = (sorted(rows(transform.stat("LOESS", df, "x", "y", ("k",), bandwidth=1.0, weight=w))) for w in (None, "w"))
    assert even == weighed and [r[:2] for r in even] == [("a", 1.0), ("a", 1.5), ("a", 4.0), ("b", 7.0)]
    for bad in ({}, {"binwidth": 0}):
        with pytest.raises(ValueError):
            transform.stat("BIN", df, "x", **bad)


def test_learners_are_saved_and_loaded(engine, spark, tmp_path):
    engine.register("marks", spark.createDataFrame([(float(i), i > 20) for i in range(40)], "x double, c boolean"))
    engine.execute("CREATE CLASSIFIER first(c) USING SELECT x, c FROM marks")
    engine.save_learner("first", str(tmp_path / "held"))
    engine.load_learner("second", str(tmp_path / "held"))
    assert sorted(run(engine, "SELECT x, guess FROM marks CLASSIFIED WITH second(guess) WHERE x IN (1, 30)")) == [(1.0, False), (30.0, True)]


def test_connection(spark):
    import datetime

    from rowloom import dbapi

    with dbapi.connect(spark) as connection:
        cursor = connection.cursor()
        cursor.execute("SELECT ? AS a, ? AS b, '?' AS c, ? AS d, ? AS e -- why?\n", ["it's \\ here", -2, 1e-7, datetime.date(2024, 2, 29)])
        assert [d[0] for d in cursor.description] == ["a", "b", "c", "d", "e"]
        assert cursor.fetchall() == [("it's \\ here", -2, "?", 1e-7, datetime.date(2024, 2, 29))]
        cursor.execute("SELECT n FROM SEQUENCE(10) ORDER BY n")
        assert (cursor.fetchone(), cursor.fetchmany(2), len(list(cursor)), cursor.fetchone()) == ((0,), [(1,), (2,)], 7, None)
        for text, values in (("SELECT ?", []), ("SELECT nothing FROM nowhere", [])):
            with pytest.raises(dbapi.Error):
                cursor.execute(text, values)


def test_shell(spark, tmp_path):
    import io

    from rowloom.shell import Shell

    (tmp_path / "script.sql").write_text("FORMAT CSV; VALUES (1, 'a;b'), (2, NULL);")
    out = io.StringIO()
    shell = Shell(Engine(spark), out)
    shell.run(f"ECHO ON; SOURCE '{tmp_path}/script.sql'; ECHO OFF; FORMAT TABLE; TIME SELECT 'x;' AS long_name")
    said = out.getvalue().replace("\r\n", "\n").splitlines()
    assert said[0] == "VALUES (1, 'a;b'), (2, NULL);" and said[2:4] == ["1,a;b", "2,"]
    assert said[4:7] == ["long_name", "x;", "(1 rows)"] and said[7].startswith("Time: ")
    with pytest.raises(ValueError):
        shell.run("FORMAT CSV NOTHING")
    old = shell.engine
    shell.run("RESET")
    assert shell.engine is not old


@pytest.mark.parametrize("margin", [None, 1, 3])
def test_alignment_by_a_given_distance_is_that_of_numbers(spark, margin):
    rng = random.Random(8)
    sides = [[(k, t, float(rng.randint(0, 6))) for k, n in enumerate(sizes) for t in range(n)] for sizes in ((7, 1, 5, 9), (4, 1, 8, 9))]
    left, right = (Rel(spark.createDataFrame(rows, f"k int, {c}t int, {c}v double"), order=(F.col(f"{c}t"),), partition=("k",)) for rows, c in zip(sides, "ab", strict=True))
    found = [align.align(left, right, ("av", "bv"), margin, d) for d in (None, lambda x, y: F.abs(x - y))]
    plain, given = (sorted(df.select("k", "_step", "at", "bt").collect()) for df in found)
    assert plain == given and len(plain) >= 18
