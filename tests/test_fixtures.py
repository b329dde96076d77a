"""Hand-computed cases of the coverage operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.numeric import ZeroInflatedPoisson, betainc, correlation_p_value, rint_to, t_cdf
from tessera.operators import bias, binning, correlate, evaluate, matrix, megabins, model, outliers
from tessera.operators.insert_size import Fit, minimize
from tessera.sources import tables

READS = "chrom string, start long, end long, mapq int, proper_pair boolean, is_read1 boolean, tlen double"


def reads(spark, mapq=20, tlens=(150.0, 170.0, 200.0)):
    rows = [("c", s, e, mapq, True, True, t) for (s, e), t in zip([(3, 13), (10, 20), (28, 35)], tlens)]
    return spark.createDataFrame(rows, READS)


def spine(spark, n):
    return spark.createDataFrame([("c", i) for i in range(n)], "chrom string, idx long")


def by_idx(df, col):
    return [r[col] for r in df.orderBy("idx").collect()]


def test_coverage(spark):
    out = binning.on_spine(spine(spark, 4), binning.coverage(reads(spark), 10))
    assert by_idx(out, "cov") == pytest.approx([0.7, 1.3, 0.2, 0.5])
    assert by_idx(binning.on_spine(spine(spark, 4), binning.coverage(reads(spark, 19), 10)), "cov") == [0.0] * 4


def test_weighted_length(spark):
    out = {r["idx"]: r["mean_len"] for r in binning.mean_lengths(reads(spark), 10).collect()}
    assert [out[i] for i in range(4)] == pytest.approx([150, 165.384615384, 200, 200])
    kept = binning.fragments(reads(spark, tlens=(99.0, -100.0, 220.0))).select("frag_len").collect()
    assert sorted(r[0] for r in kept) == [100.0, 220.0]
    assert binning.fragments(reads(spark, tlens=(221.0, 99.9, 500.0))).count() == 0


def test_bucket_means(spark):
    xy = [(0.5, 1.0), (1.0, 2.0), (1.5, 4.0), (2.0, None), (4.0, 6.0), (5.0, 9.0)]
    df = spark.createDataFrame([("c", x, y) for x, y in xy], "chrom string, x double, y double")
    means = lambda **k: [r["mean"] for r in binning.bucket_means(df, "x", "y", [0, 1, 2, 3, 4], **k).orderBy("bucket").collect()]
    assert means() == [1.0, 3.0, None, 6.0]
    assert means(nan_extremes=True) == [None, 3.0, None, None]
    assert means(nan_extremes="min") == [None, 3.0, None, 6.0]
    with pytest.raises(ValueError):
        means(nan_extremes="both")


def curve(spark, values):
    return spark.createDataFrame([("c", i, v) for i, v in enumerate(values)], "chrom string, bucket int, v double")


def test_smoothing(spark):
    out = [r["v"] for r in bias.smooth(curve(spark, [1.0] * 6), "v", bias.kernel()).orderBy("bucket").collect()]
    assert out == pytest.approx([0.70130997, 0.94551132, 1, 1, 0.94551132, 0.70130997])
    assert bias.kernel() == pytest.approx([0.05448868, 0.24420134, 0.40261995, 0.24420134, 0.05448868])
    holed = [1.0, 2.0, 3.0, None, 5.0, 6.0]
    out = [r["v"] for r in bias.smooth(curve(spark, holed), "v", bias.kernel()).orderBy("bucket").collect()]
    assert out[1:] == holed[1:] and out[0] != holed[0]
    assert [r["v"] for r in bias.smooth(curve(spark, [1.0, 2.0]), "v", bias.kernel()).orderBy("bucket").collect()] == [1.0, 2.0]


def stats(spark, pairs):
    df = spark.createDataFrame([("m", x, y) for x, y in pairs], "k string, x double, y double")
    sums = correlate.dense_sums(df, ["k"])
    return correlate.features(sums).head()


def test_pearson(spark):
    r = stats(spark, [(1.0, 1.0), (2.0, 0.0), (3.0, 1.0), (4.0, 0.0)])
    got = [r[c] for c in ("n", "x_sum", "y_sum", "x_squared_sum", "y_squared_sum", "xy_sum")]
    assert got == [4, 10, 2, 30, 2, 4]
    assert (r["pearson_r"], r["p_value"], r["fraction_within"], r["cosine_similarity"]) == pytest.approx((-0.4472136, 0.5527864, 1, 0.5163978))
    flat = stats(spark, [(1.0, 2.0), (2.0, 2.0), (5.0, 2.0)])
    assert (flat["pearson_r"], flat["p_value"]) == (0, 1)
    one = stats(spark, [(1.0, 2.0)])
    assert one["p_value"] == 1 and one["n"] == 0 and one["x_sum"] == 0
    assert stats(spark, [(None, 1.0), (1.0, 1.0), (2.0, 2.0)])["n"] == 2


def test_zip(spark):
    m = ZeroInflatedPoisson().update([0, 0, 0, 0, 1, 1, 2, 2, 3, 1])
    assert (m.n, m.mean, m.nonzero) == (10, 1.0, 6)
    assert m.clip_at(0.01) == 4 and m.clip_at(1 / 263e6) == 11
    assert ZeroInflatedPoisson().update([0, 0]).clip_at(0.5) == 0
    assert m.pmf(0) == pytest.approx(0.4 + 0.6 * math.exp(-1))
    assert m.cdf(3) == pytest.approx(sum(m.pmf(k) for k in range(4)))
    both = ZeroInflatedPoisson().update([0, 0, 0, 0, 1]).update([1, 2, 2, 3, 1])
    assert both.parameters() == pytest.approx(m.parameters())
    assert ZeroInflatedPoisson.from_parameters(**m.parameters()).pmf(2) == m.pmf(2)
    for bad in (-1, 1.5, True):
        with pytest.raises(ValueError):
            m.pmf(bad)
    with pytest.raises(ValueError):
        m.update([-3])
    bins = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate([0, 0, 0, 0, 1, 1, 2, 2, 3, 1])], "chrom string, idx long, cov double")
    assert outliers.thresholds(outliers.zip_stats(bins), 0.01).head()["k"] == 4
    limits = spark.createDataFrame([("c", 2)], "chrom string, k long")
    out = outliers.clip(bins, limits)
    assert by_idx(out, "cov_clip")[-2:] == [2.0, 1.0] and by_idx(out, "cov_raw")[-2:] == [None, 1.0]


def test_zip_of_large_means(spark):
    # At a mean of 1,087 the chance of a small count is no double above 0, though nearly everything lies beyond it.
    m = ZeroInflatedPoisson(100, 1087.3, 100)
    assert m.tail(10) == 1.0 and m.tail(1086) == pytest.approx(1 - m.cdf(1086))
    assert m.clip_at(1 / 263e6) == 1283 and ZeroInflatedPoisson(100, 20_000.0, 50).clip_at(1 / 263e6) == 20_805
    bins = spark.createDataFrame([("c", i, 2_000.0 + i % 3) for i in range(99)] + [("c", 99, 9e5)], "chrom string, idx long, cov double")
    k = outliers.thresholds(outliers.zip_stats(bins)).head()["k"]
    out = by_idx(outliers.clip(bins, outliers.thresholds(outliers.zip_stats(bins))), "cov_clip")
    assert out[:3] == [2000.0, 2001.0, 2002.0] and out[99] == k > 10_990


def test_weights(spark):
    df = spark.createDataFrame([("A",), ("A",), ("A",), ("B",)], "dataset string")
    w = sorted(r["weight"] for r in evaluate.balanced_weights(df).collect())
    assert w == pytest.approx([2 / 3, 2 / 3, 2 / 3, 2.0])


def test_one_se(spark):
    grid = spark.createDataFrame([(0.05, 0.987, 0.740, 0.010), (0.1, 0.988, 0.750, 0.012), (0.2, 0.987, 0.752, 0.005), (0.04, 0.990, 0.748, 0.010)], "C double, variance double, mean_score double, se double")
    r = evaluate.one_se(grid, "C", "variance").head()
    assert (r["C"], r["variance"]) == (0.2, 0.987)


def test_roc(spark):
    s = spark.createDataFrame(list(zip([1, 1, 0, 1, 0], [0.9, 0.8, 0.7, 0.6, 0.2])), "y int, score double")
    assert evaluate.auc(s).head()["auc"] == pytest.approx(5 / 6)
    j = evaluate.max_j(s).head()
    assert (j["threshold"], j["j"]) == (0.8, pytest.approx(2 / 3))
    assert evaluate.high_specificity(s).head()["threshold"] == 0.8
    c = evaluate.confusion(s, F.lit(0.8)).head()
    assert (c["tp"], c["fp"], c["tn"], c["fn"]) == (2, 0, 2, 1)
    worst = spark.createDataFrame([(0, 0.9), (1, 0.1)], "y int, score double")
    assert evaluate.max_j(worst).head()["threshold"] == float("inf")


@pytest.mark.parametrize("n", [41, 38, 6, 2, 1])
def test_megabin_blocks_equal_tilings(spark, n):
    rng = np.random.default_rng(n)
    rows = [("c", i, None if rng.random() < 0.1 else float(rng.integers(0, 9))) for i in range(n)]
    df = spark.createDataFrame(rows, "chrom string, idx long, cov double")
    mean = lambda d: {r["idx"]: sum(r["means"]) / len(r["means"]) if r["means"] else None for r in d.collect()}
    tiles = megabins.tilings(df, 1, 20, 4, "cov").filter("mega is not null")
    per = tiles.groupBy("chrom", "tiling", "mega").agg(F.avg("cov").alias("m"))
    slow = tiles.join(per, ["chrom", "tiling", "mega"]).groupBy("idx").agg(F.collect_list("m").alias("means"))
    assert mean(megabins.tile_means(df, 1, 20, 4)) == pytest.approx(mean(slow))


def test_megabins_by_hand(spark):
    df = spark.createDataFrame([("c", i, float(i + 1)) for i in range(6)], "chrom string, idx long, cov double")
    assert by_idx(megabins.normalize(df, 1, 4, 2), "cov_norm") == pytest.approx([0.5, 1, 0.857143, 1.142857, 1, 1.2], abs=1e-6)
    with pytest.raises(ValueError):
        megabins.normalize(df, 1, 4, 2, scale=None)


def test_exclude(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "idx long")
    gone = binning.excluded(ids(1, 2), ids(2, 5))
    assert by_idx(binning.without(spine(spark, 7), gone), "idx") == [0, 3, 4, 6]
    assert by_idx(binning.only(spine(spark, 7), gone), "idx") == [1, 2, 5]


def test_rounding(spark):
    df = spark.createDataFrame([(x,) for x in (0.575, 0.145, 1.115, 0.285)], "x double")
    assert [r[0] for r in df.select(rint_to(F.col("x"), 2)).collect()] == [0.57, 0.14, 1.12, 0.28]


def test_rebin_positional(spark):
    df = spine(spark, 12).filter("idx <> 3").withColumn("m", F.lit(1.0))
    assert [r["m"] for r in binning.rebin_positional(df, "m", ["chrom"]).orderBy("grp").collect()] == [10.0, 1.0]


def test_apply_factors(spark):
    bins = spark.createDataFrame([("c", 0, 0.5, 2.0), ("c", 1, 1.5, 4.0), ("c", 2, 2.5, 6.0), ("c", 3, None, 1.0)], "chrom string, idx long, x double, cov double")
    f = spark.createDataFrame([("c", 0, 1.0), ("c", 1, None), ("c", 2, 2.0)], "chrom string, bucket int, factor double")
    out = by_idx(bias.apply_factors(bins, f, "x", "cov", [0, 1, 2, 3], "out"), "out")
    assert out[0] == pytest.approx(3, rel=1e-6) and out[1] is None and out[2] == pytest.approx(4.5, rel=1e-6) and out[3] is None


def test_bed(spark):
    lines = ["c\t15\t30", "c\t95\t105", "c\t95\t120", "#", "", "c\t1", "c\tx\t2"]
    bed = tables.parse_bed(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert bed.count() == 3
    assert by_idx(binning.bed_bins(bed, 100, 10), "idx") == [1, 2, 3, 9, 10]


def test_standardize(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "pearson_r double")
    out = sorted(r[0] for r in correlate.standardize(df)[0].collect())
    assert out == pytest.approx([-1.2247449, 0, 1.2247449])
    same = correlate.standardize(spark.createDataFrame([(2.0,), (2.0,)], "pearson_r double"))[0]
    assert [r[0] for r in same.collect()] == [0.0, 0.0]


def test_special_functions():
    for r in (-0.9, -0.3, 0.2, 0.77):
        assert correlation_p_value(r, 4) == pytest.approx(1 - abs(r))
        assert correlation_p_value(r, 3) == pytest.approx(1 - 2 / math.pi * math.asin(abs(r)))
        assert correlation_p_value(r, 6) == pytest.approx(1 - (3 * abs(r) - abs(r) ** 3) / 2)
    assert correlation_p_value(1.0, 9) == 0 and correlation_p_value(0.5, 2) == 1
    # Large n: two-sided normal tail.
    assert correlation_p_value(1e-4, 2.6e8) == pytest.approx(math.erfc(1e-4 * math.sqrt(2.6e8) / math.sqrt(2)), rel=1e-4)
    assert betainc(2, 3, 0.4) == pytest.approx(0.5248)
    z = 1.3
    th = math.atan(z / math.sqrt(5))
    assert t_cdf(z, 5, 0, 1) == pytest.approx(0.5 + (th + (math.cos(th) + 2 / 3 * math.cos(th) ** 3) * math.sin(th)) / math.pi)


def test_sparse_sums_equal_dense(spark):
    rng = np.random.default_rng(2)
    bins = [(m, c, i, None if rng.random() < 0.2 else float(rng.random())) for m in "AB" for c in "xy" for i in range(15)]
    masks = [(m, k, c, i, round(float(rng.random()), 2) + 0.01) for m in "AB" for k in ("k1", "k2") for c in "xy" for i in range(15) if rng.random() < 0.3 and (k, c) != ("k2", "y")]
    man = [(m, k, c) for m in "AB" for k in ("k1", "k2", "k3") for c in "xy" if (k, c) != ("k2", "y")]
    b = spark.createDataFrame(bins, "mask_type string, chrom string, idx long, x double")
    k = spark.createDataFrame(masks, "mask_type string, cell_type string, chrom string, idx long, overlap double")
    a = spark.createDataFrame(man, "mask_type string, cell_type string, chrom string")
    fast = {tuple(r[:2]): r[2:] for r in correlate.sparse_sums(b, k, a, "x").collect()}
    full = a.join(b, ["mask_type", "chrom"]).join(k, ["mask_type", "cell_type", "chrom", "idx"], "left").withColumn("y", F.coalesce(F.col("overlap").cast("float").cast("double"), F.lit(0.0)))
    slow = {tuple(r[:2]): r[2:] for r in correlate.dense_sums(full, ["mask_type", "cell_type"]).collect()}
    assert fast.keys() == slow.keys() and len(fast) == 6
    for key in fast:
        assert fast[key] == pytest.approx(slow[key])


def test_matrix_round_trip(spark):
    rows = [("A", "k1", *[float(i) for i in range(10)]), ("B", "k2", *[float(i + 1) for i in range(10)])]
    wide = spark.createDataFrame(rows, "mask_type string, cell_type string, " + ", ".join(f"{s} double" for s in correlate.STATS))
    back = matrix.wide_form(correlate.long_form(wide))
    assert sorted(map(tuple, back.select(wide.columns).collect())) == sorted(map(tuple, wide.collect()))
    d = matrix.diffs(wide, back)
    assert d.filter("diff <> 0").count() == 0
    with pytest.raises(Exception, match="different keys"):
        matrix.diffs(wide, back.limit(1)).collect()
    dims = spark.createDataFrame([("A", "k1", 0), ("B", "k2", 0)], "mask_type string, cell_type string, row_ord int")
    assert [r["cell_type"] for r in matrix.in_order(wide, dims, "B").orderBy("col_idx").collect()] == ["k2", "k1"]


def test_insert_size_fit_recovers_parameters():
    edges = [float(x) for x in range(100, 221, 5)]
    blank = Fit([0], [True], [1.0], [1], [100.0], edges)
    truth = blank.mixture(np.array([1.0, 2, 3]), np.array([0.2, 0.5, 0.3]), 2.0, -0.3, 160.0)
    x = np.array([minimize(lambda p: float(((p - [3, -2]) ** 2 * [1, 10]).sum()), np.zeros(2))])
    assert x[0] == pytest.approx([3, -2], abs=1e-4)
    got = minimize(lambda p: float(np.mean((blank.mixture(np.array([1.0, 2, 3]), np.array([0.2, 0.5, 0.3]), abs(p[0]), p[1], p[2]) - truth) ** 2)), np.array([3.0, -0.5, 163.0]))
    assert got == pytest.approx([2.0, -0.3, 160.0], rel=0.05)


def test_row_scale_and_model(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(120):
        y = int(i % 2)
        v = rng.normal(size=6) + np.array([3.0 * y, 0, 0, 0, 0, -3.0 * y])
        rows.append((i, f"ds{i % 3}", y, [*map(float, v), 7.0]))
    df = spark.createDataFrame(rows, "sample_id long, dataset string, y int, features array<double>")
    scaled = np.array([r["features"] for r in model.row_scale(df).collect()])
    assert scaled.mean(1) == pytest.approx(np.zeros(120), abs=1e-12) and scaled.std(1) == pytest.approx(np.ones(120))
    assert sorted(r["pos"] for r in model.kept_features(df).collect()) == list(range(6))
    m = model.train(df, 0.95, 1.0)
    assert evaluate.auc(m.predict(df).select("y", "score")).head()["auc"] > 0.9
    assert m.summary()["nonzero"] >= 1
    out = model.leave_one_out(df, [0.95], [1.0], never_held=("ds2",))
    assert {r[0] for r in out.select("dataset").distinct().collect()} == {"ds0", "ds1"}


def test_model_equals_its_definition(spark, tmp_path):
    # Scaling, components and shares by NumPy; the coefficients by the conditions of an L1 optimum.
    rng = np.random.default_rng(7)
    raw = rng.normal(size=(90, 5)) @ rng.normal(size=(5, 5)) + 3
    y, ds = (raw[:, 0] + rng.normal(size=90) > 3).astype(int), [f"ds{i % 3 if i < 70 else 0}" for i in range(90)]
    df = spark.createDataFrame([(i, ds[i], int(y[i]), [*map(float, raw[i]), 4.0]) for i in range(90)], "sample_id long, dataset string, y int, features array<double>").coalesce(2)
    m = model.train(df, 0.9, 0.5)
    x = raw - raw.mean(1, keepdims=True)
    x = x / raw.std(1, keepdims=True)
    x = (x - x.mean(0)) / x.std(0)
    value, vector = np.linalg.eigh(np.cov(x.T))
    order = np.argsort(-value)
    share = np.cumsum(value[order]) / value.sum()
    k = int((share < 0.9).sum()) + 1
    assert m.components == k and m.select.selectedFeatures == [0, 1, 2, 3, 4]
    z = x @ vector[:, order[:k]]
    z = z / z.std(0)
    got = np.array([r["x"].toArray() for r in m.prepare(df).orderBy("sample_id").collect()])
    assert np.abs(got) == pytest.approx(np.abs(z), abs=1e-8)
    w = np.array([r["weight"] for r in evaluate.balanced_weights(df, "dataset").orderBy("sample_id").collect()])
    beta, bias_ = np.array(m.coefficients()), float(m.classifier.intercept)
    p = 1 / (1 + np.exp(-(got @ beta + bias_)))
    slope, limit = got.T @ (w * (y - p)), w.sum() / (0.5 * 90)
    assert abs((w * (y - p)).sum()) < 0.05
    for s, b in zip(slope, beta):
        assert (s == pytest.approx(limit * np.sign(b), abs=0.05)) if b else abs(s) <= limit + 0.05
    m.save(str(tmp_path / "model"))
    again = model.CohortModel.load(str(tmp_path / "model"))
    a, b = ([r["score"] for r in x.predict(df).orderBy("sample_id").collect()] for x in (m, again))
    assert a == b and (again.variance, again.strength, again.components) == (0.9, 0.5, k)
    model.write_results(m.predict(df), str(tmp_path / "results"))
    assert {r["dataset"] for r in spark.read.option("header", True).csv(str(tmp_path / "results")).collect()} == set(ds)


def test_mixture_equals_numeric_density():
    # The mixture's curve against densities written out from the gamma function.
    fit = Fit([0], [True], [1.0], [1], [100.0], [float(x) for x in range(100, 221, 10)])
    from tessera.operators import insert_size as isz

    def t(x, df, m, s):
        c = math.gamma((df + 1) / 2) / (math.gamma(df / 2) * math.sqrt(df * math.pi) * s)
        return c * (1 + ((x - m) / s) ** 2 / df) ** (-(df + 1) / 2)

    steps = np.linspace(100, 220, 20_001)
    scale, skew, mean, depths, shares = 1.7, -0.6, 163.0, np.array([1.0, 3.0]), np.array([0.6, 0.3])
    mass = np.trapezoid([t(v, isz.DF, mean, isz.SIGMA * scale) for v in steps], steps)
    total = np.zeros(len(fit.mid))
    for d, share in zip(depths, shares):
        s = isz.SIGMA * scale / math.sqrt(d)
        pdf = np.array([t(v, isz.DF, mean, s) * (1 + math.erf(skew * (v - mean) / (s * math.sqrt(2)))) for v in fit.mid])
        total += share * pdf / np.trapezoid(pdf, fit.mid) / (mass * s)
    assert fit.mixture(depths, shares, scale, skew, mean) == pytest.approx(total / total.mean(), rel=1e-5)


def test_gc_bins_past_the_end(spark):
    df = spark.createDataFrame([("a", "GCAT"), ("b", "GCATG"), ("c", ""), ("d", None)], "k string, s string")
    got = sorted(map(tuple, binning.gc_per_bin(df, "k", "s", 2).collect()))
    assert got == [("a", 0, 1.0), ("a", 1, 0.0), ("a", 2, 0.0), ("b", 0, 1.0), ("b", 1, 0.0), ("b", 2, 1.0), ("c", 0, 0.0)]
    bins = spark.createDataFrame([("c", i, i / 10) for i in range(20)], "chrom string, idx long, gc double")
    assert binning.at_bin_size(bins, "gc", 10).count() == 20 and binning.at_bin_size(bins, "gc", 100).count() == 2
    with pytest.raises(ValueError, match="bins of 50"):
        binning.at_bin_size(bins, "gc", 50)


def test_guarded_means(spark):
    df = spark.createDataFrame([(300.0, 2.0), (5.0, 0.0), (0.0, 0.0), (1.0, 3.0)], "total double, cov double")
    assert [r["mean_len"] for r in binning.guarded_means(df, "total", "cov").collect()] == [150.0, 5.0, 0.0, 0.3333333]


def test_rebin_by_blocks(spark):
    rows = [("c", i * i % 97 * 3, float(i)) for i in range(97)] + [("d", 5, 1.0)]
    rows = list({(c, i): (c, i, v) for c, i, v in rows}.values())
    df = spark.createDataFrame(rows, "chrom string, idx long, cov double")
    want = sorted(map(tuple, binning.rebin_positional(df, "cov", ["chrom"]).collect()))
    for block in (1, 7, 50):
        assert sorted(map(tuple, binning.rebin_positional(df, "cov", ["chrom"], block=block).collect())) == want
    mine = [v for c, i, v in sorted(rows) if c == "c"]
    assert [v for c, g, v in want if c == "c"] == [sum(mine[k : k + 10]) for k in range(0, len(mine), 10)]


def test_keys_without_mask_type(spark):
    long = spark.createDataFrame([("x_sum_k1", 1.0), ("x_sum_DNase::k1", 2.0), ("y_sum_k1", 3.0), ("x_sum_ATAC::a::b", 4.0), ("n_k2", 5.0)], "feature string, value double")
    got = {(r["mask_type"], r["cell_type"]): (r["x_sum"], r["y_sum"], r["n"]) for r in matrix.wide_form(long).collect()}
    assert got == {("DNase", "k1"): (2.0, 3.0, None), ("ATAC", "a::b"): (4.0, None, None), ("DNase", "k2"): (None, None, 5.0)}


def test_grid_shares_fits(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"ds{i % 3}", i % 2, [*map(float, rng.normal(size=4) + [2.0 * (i % 2), 0, 0, 0])]) for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id long, dataset string, y int, features array<double>")
    points = [(p, c) for p in (0.5, 0.99, 0.995) for c in (0.1, 1.0)]
    got = model.train_grid(df, points)
    assert [(m.variance, m.strength) for m in got] == points and len({m.components for m in got}) == 2
    for m in (got[0], got[3], got[5]):
        assert m.coefficients() == pytest.approx(model.train(df, m.variance, m.strength).coefficients(), abs=1e-9)
