"""What a batch stores, shuffles and holds must not outgrow its input."""

from collections import Counter

import pytest

from rivulet.engine import Engine
from rivulet.functions import zset as Z
from rivulet.plans.nodes import Grouping, Table as T


def bag(df):
    return Counter(tuple(map(str, r)) for r in df.collect())


def stored(e):
    """Rows and columns of what a batch stores for its own use, as it comes."""
    out, fixed = [], e.store.fixed

    def keep(df):
        df = fixed(df)
        out.append((df.count(), df.columns))
        return df

    e.store.fixed = keep
    return out


ROLLS = {"rollup": [("a", "b"), ("a",), ()], "cube": [("a", "b"), ("a",), ("b",), ()], "grouping sets": [("a", "b"), ("b",)], "apart": [("a",), ("b",), ("a", "b")]}
TEXT = {"rollup": "ROLLUP (a, b)", "cube": "CUBE (a, b)", "grouping sets": "GROUPING SETS ((a, b), (b))", "apart": "GROUPING SETS ((a), (b), (a, b))"}


@pytest.mark.parametrize("name", ROLLS)
def test_grouping_sets_store_gathered_rows(spark, name):
    df = spark.range(4000).selectExpr("nullif(id % 3, 1) AS a", "CAST(id % 2 AS STRING) AS b", "CAST(id % 5 AS INT) AS x", "repeat('wide', 5) AS pad", "id")
    e = Engine(spark)
    e.track("t", df.where("id % 10 <> 0"))
    e.create_view("v", Grouping(T("t"), ["a", "b"], ROLLS[name], {"n": "count(1)", "some": "count(nullif(x, 2))", "hi": "max(x)"}))
    kept = stored(e)
    e.apply_batch({"t": Z.plus(Z.weighted(df.where("id % 10 = 0")), Z.weighted(df.where("id % 10 = 7 OR a <=> 0 AND x = 4"), -1))})
    left = df.where("NOT (id % 10 = 7 OR a <=> 0 AND x = 4)")
    left.createOrReplaceTempView("rolled")
    assert bag(e.query("v")) == bag(spark.sql(f"SELECT a, b, count(1), count(nullif(x, 2)), max(x), grouping_id(a, b) FROM rolled GROUP BY {TEXT[name]}"))
    assert sum(n for n, _ in kept) < 200 and not any("pad" in c for _, c in kept)


def test_rows_of_great_weight(spark):
    z = spark.createDataFrame([("a", 10_000), ("b", 1), ("c", Z.RUN), ("d", -1)], "k string, __w long")
    assert {r[0]: r[1] for r in Z.rows(z).groupBy("k").count().collect()} == {"a": 10_000, "b": 1, "c": Z.RUN}


def test_percentiles_are_found_by_counting(spark):
    df = spark.range(3000).selectExpr("nullif(id % 4, 2) AS g", "CASE WHEN id % 4 = 3 OR id % 11 = 0 THEN NULL ELSE CAST(id * 7919 % 1009 AS INT) END AS x", "'pad' AS pad")
    aggs = {"md": "median(x)", "q": "percentile_cont(0.9) WITHIN GROUP (ORDER BY x)", "d": "cast(percentile_disc(0.25) WITHIN GROUP (ORDER BY x) AS bigint)", "n": "count(x)"}
    e = Engine(spark)
    e.track("t", df)
    e.create_view("v", T("t").group(["g"], **aggs, far="mad(x)"))
    e.create_view("w", T("t").group([], md="median(x)", far="mad(x)"))
    e.create_view("none", T("t").where("x < 0").group([], md="median(x)"))
    plan = e.plans["v"].full(e.snapshot())._jdf.queryExecution().executedPlan().toString().lower()
    assert "percentile(" not in plan and "median(" not in plan and "percentile_disc(" not in plan and "percentile_cont(" not in plan
    gone = df.where("x % 3 = 0 OR g = 1 AND x > 100").limit(400)
    gone = spark.createDataFrame(gone.collect(), gone.schema)
    e.apply_batch({"t": Z.weighted(gone, -1)})
    df.exceptAll(gone).createOrReplaceTempView("ranked")
    sql = "(SELECT {g} median(abs(x - m)) FROM (SELECT *, median(x) OVER ({p}) AS m FROM ranked) {by})"
    far = {str(r[0]): str(r[1]) for r in spark.sql(sql.format(g="g,", p="PARTITION BY g", by="GROUP BY g")).collect()}
    want = {str(r[0]): (*map(str, r[1:]), far[str(r[0])]) for r in spark.sql(f"SELECT g, {', '.join(aggs.values())} FROM ranked GROUP BY g").collect()}
    assert {str(r[0]): tuple(map(str, r[1:])) for r in e.query("v").collect()} == want
    assert bag(e.query("w")) == bag(spark.sql(f"SELECT (SELECT median(x) FROM ranked), {sql.format(g='', p='', by='')}"))
    assert bag(e.query("none")) == Counter({("None",): 1})
