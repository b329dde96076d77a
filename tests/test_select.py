"""Exact quantiles and running sums of large groups, against the built-in forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import evaluate, matrix, select


def table(spark, n=5000, seed=3):
    r = random.Random(seed)
    value = lambda g: r.choice([None, 0.0, 1.5, float(r.randrange(40)), r.gauss(0, 1)]) if g != "c" else r.random()
    rows = [(g := r.choice(["a", "a", "b", None, "c"]), value(g), r.choice([1.0, 2.0])) for _ in range(n)]
    rows += [("one", 4.0, 1.0), ("two", 1.0, 1.0), ("two", 2.0, 1.0), ("none", None, 1.0), ("nan", math.nan, 1.0), ("nan", 1.0, 1.0), ("nan", 2.0, None), ("inf", math.inf, 1.0), ("inf", -math.inf, 1.0), ("inf", 3.0, 1.0)]
    return spark.createDataFrame(rows, "g string, v double, w double").repartition(5)


def same(a, b):
    return a == b or a is not None and b is not None and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-12))


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_are_exact(spark, accuracy):
    df = table(spark)
    wanted = {"median": ("v", 0.5), "p99": ("v", 0.99), "low": ("v", 0.0), "high": ("v", 1.0), "third": ("v", 1 / 3), "of_w": ("w", 0.5)}
    got = {r["g"]: r.asDict() for r in select.quantiles(df, ["g"], wanted, accuracy).collect()}
    want = {r["g"]: r.asDict() for r in df.groupBy("g").agg(*[F.percentile(c, F.lit(q)).alias(n) for n, (c, q) in wanted.items()]).collect()}
    assert got.keys() == want.keys() and None in got
    for g in want:
        assert all(same(got[g][n], want[g][n]) for n in wanted), (g, got[g], want[g])
    whole = select.quantiles(df.filter("g <> 'nan' and g <> 'inf'"), [], {"m": ("v", 0.5)}, accuracy).collect()
    assert same(whole[0]["m"], df.filter("g <> 'nan' and g <> 'inf'").agg(F.median("v")).first()[0])
    assert select.quantiles(df.limit(0), ["g"], {"m": ("v", 0.5)}).count() == 0


def test_quantiles_of_ten_million_distinct_values(spark):
    # One group, all values distinct: what is put in order is bounded by the sketch's accuracy.
    n = 10_000_001
    df = spark.range(n).select(F.lit("g").alias("g"), ((F.col("id") * 7_368_787 % n) / 2.0).alias("v"))
    got = select.quantiles(df, ["g"], {"median": ("v", 0.5), "p99": ("v", 0.99)}).first()
    assert got["median"] == (n - 1) / 4 and got["p99"] == pytest.approx((n - 1) * 0.99 / 2, abs=1e-6)


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_running_sums(spark, ranges):
    r = random.Random(5)
    rows = {(r.choice(["a", "b", None]), r.choice([None, math.inf, *map(float, range(300))])): (r.randrange(5), r.randrange(5)) for _ in range(700)}
    df = spark.createDataFrame([(*k, *v) for k, v in rows.items()], "g string, t double, p long, n long").repartition(4)
    w = Window.partitionBy("g").orderBy(F.desc("t"))
    want = df.select(
        "*", *[F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"run_{c}") for c in "pn"], *[F.sum(c).over(Window.partitionBy("g")).alias(f"all_{c}") for c in "pn"], *[F.lead(c).over(w).alias(f"next_{c}") for c in "pn"]
    )
    got = select.running(df, ["g"], "t", ["p", "n"], ranges)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert select.running(df.limit(0), ["g"], "t", ["p", "n"]).count() == 0


def test_curves_of_a_large_dataset(spark):
    # A million distinct scores of one dataset in many tasks; the area by ranks.
    n = 1_000_000
    df = spark.range(n).select(F.lit("d").alias("dataset"), (F.col("id") * 7_368_787 % n).cast("double").alias("score"), F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("y"))
    plan = evaluate.cumulative(df, ["dataset"])
    assert "__range" in plan._jdf.queryExecution().optimizedPlan().toString()
    got = evaluate.auc(df, ["dataset"]).first()
    i = np.arange(n, dtype=np.int64)
    score = i * 7_368_787 % n
    y = np.array([r["y"] for r in df.select("y").toLocalIterator()]) if n <= 10_000 else df.select("y").toPandas()["y"].to_numpy()
    rank = score + 1.0
    pos = y.sum()
    assert got["n_samples"] == n and got["auc"] == pytest.approx((rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (n - pos)), abs=1e-12)


def test_worst_five_and_missing_statistics(spark):
    d = spark.createDataFrame([("x_sum", "A", f"k{i}", float(i // 2)) for i in range(12)] + [("n", "A", "k0", 1.0)], "stat string, mask_type string, cell_type string, diff double")
    got = [tuple(r) for r in matrix.worst(d).filter("stat = 'x_sum'").orderBy("rank").collect()]
    assert got == [("x_sum", k, "A", c, v) for k, (c, v) in enumerate([("k10", 5.0), ("k11", 5.0), ("k8", 4.0), ("k9", 4.0), ("k6", 3.0)], 1)]
    assert matrix.worst(d).filter("stat = 'n'").count() == 1
    dims = spark.createDataFrame([("A", "k", 0)], "mask_type string, cell_type string, row_ord int")
    full = dict.fromkeys(matrix.STATS, 1.0)
    for lost in matrix.STATS:
        wide = spark.createDataFrame([("A", "k", *[None if s == lost else v for s, v in full.items()])], "mask_type string, cell_type string, " + ", ".join(f"{s} double" for s in matrix.STATS))
        with pytest.raises(Exception, match=rf"no features: A::k \({lost}\)"):
            matrix.in_order(wide, dims, "A").collect()
