"""Capped megabins from sorted runs, count models as streams, the consensus as a cell type, labels and comparisons."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.numeric import ZeroInflatedPoisson
from tessera.operators import correlate, matrix, megabins, model, outliers
from tessera.sources import files, tables
from tessera.streaming.running import CountModels


@pytest.mark.parametrize("n", [1, 5, 23, 38, 41, 200])
@pytest.mark.parametrize("each", [2, 64])
def test_capped_megabins_equal_tilings(spark, n, each):
    r = random.Random(n)
    rows = [(c, i, None if r.random() < 0.1 else r.gauss(5, 3)) for c in "ab" for i in range(3, 3 + n) if r.random() < 0.9 or i in (3, 2 + n)]
    df = spark.createDataFrame(rows, "chrom string, idx long, cov double")
    tiles = megabins.tilings(df, 1, 20, 4, "cov").filter("mega is not null")
    per = tiles.groupBy("chrom", "tiling", "mega").agg(F.percentile("cov", F.lit(0.8)).alias("cap"))
    slow = tiles.join(per, ["chrom", "tiling", "mega"]).withColumn("v", F.when(F.col("cov").isNotNull(), F.least("cov", "cap")))
    slow = slow.join(slow.groupBy("chrom", "tiling", "mega").agg(F.avg("v").alias("m")), ["chrom", "tiling", "mega"])
    want = {(x["chrom"], x["idx"]): sorted(m for m in x["ms"]) for x in slow.groupBy("chrom", "idx").agg(F.collect_list("m").alias("ms")).collect()}
    means = megabins._capped_means(df, 1, 20, 4, "cov", 0.8, each)
    rows_ = megabins.with_ends(df, 1).withColumn("b", F.expr("(start - lo) div 4")).join(means, ["chrom", "b"])
    got = {(x["chrom"], x["idx"]): sorted(x["means"]) for x in rows_.collect()}
    assert got.keys() == {(c, i) for c, i, _ in rows}
    if n == 1:  # a tiling that begins at the only row has no megabin; the others have that row's value as well
        got, want = ({k: sorted(set(v)) for k, v in x.items()} for x in (got, want))
    assert all(got[k] == pytest.approx(want.get(k, [])) for k in got)


def test_count_models_go_on_after_a_stop(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.choice("xy"), None if r.random() < 0.1 else r.choice([0.0, 0.4, 1.5, 2.5, 7.2, -1.0])) for _ in range(600)] + [("z", 3.0)]
    df = spark.createDataFrame(rows, "chrom string, cov double").repartition(6)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    df.limit(250).write.parquet(source)
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    CountModels(out, state).update(stream())
    first = spark.read.parquet(source)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select("chrom", "n", "mu", "nonzero").collect()))
    assert same(CountModels(out, state).parameters(spark), outliers.zip_stats(first))
    spark.createDataFrame(rows[:77], df.schema).write.mode("append").parquet(source)
    models = CountModels(out, state)  # as a new process would
    models.update(stream())
    now = models.parameters(spark)
    assert same(now, outliers.zip_stats(spark.read.parquet(source)))
    models.update(stream())  # nothing new
    assert same(models.parameters(spark), now)
    assert outliers.thresholds(now).count() == now.count()


def test_count_model_iterates_fits_and_forgets():
    m = ZeroInflatedPoisson().update([0, 0, 1, 3]).update([2, 0])
    ks = list(itertools.islice(m, 6))
    assert [k for k, *_ in ks] == list(range(6)) and all(p == pytest.approx(m.pmf(k)) and c == pytest.approx(m.cdf(k)) for k, p, c in ks)
    assert next(m.counts(4)) == pytest.approx((4, m.pmf(4), m.cdf(4)))
    assert m.fit([5, 5]).parameters() == {"n": 2, "mu": 5.0, "n_non_zero": 2} and m.n == 6
    m.reset()
    assert m.parameters() == {"n": 0, "mu": 0.0, "n_non_zero": 0}
    with pytest.raises(ValueError, match="no values"):
        next(iter(m))
    with pytest.raises(ValueError, match="0 or more"):
        next(m.fit([1]).counts(-1))


def test_wanted_cells_keep_the_dimension_s_order(spark):
    dims = spark.createDataFrame([("A", "k2", 0), ("A", "consensus", 1), ("A", "k1", 2), ("B", "k3", 0)], "mask_type string, cell_type string, row_ord int")
    rows = lambda c: [tuple(r)[:2] for r in matrix.wanted_cells(dims, c).orderBy("mask_type", "row_ord").collect()]
    assert rows(None) == [("A", "k2"), ("A", "consensus"), ("A", "k1"), ("B", "k3")]
    assert rows({"A": ["k1", " k2 ", "", "absent"]}) == [("A", "k2"), ("A", "k1")]
    assert rows({"A": ["absent"], "B": None}) == [("B", "k3")] and rows({}) == []


def test_consensus_is_a_cell_type(spark):
    bins = spark.createDataFrame([("x", i, float(i % 5) if i != 3 else None) for i in range(12)] + [("y", 0, 1.0)], "chrom string, idx long, cov double")
    none = spark.createDataFrame([("A", "x", 2, 0.9), ("A", "x", 3, 0.8), ("A", "x", 7, 1.0)], "mask_type string, chrom string, idx long, overlap double")
    (got,) = correlate.consensus_sums(bins, none, "cov").collect()
    x = np.array([float(i % 5) for i in range(12) if i != 3])
    y = np.array([float(np.float32({2: 0.9, 7: 1.0}.get(i, 0))) for i in range(12) if i != 3])
    assert tuple(got)[:3] == ("A", "consensus", 11) and list(got)[3:] == pytest.approx([x.sum(), (x * x).sum(), y.sum(), (y * y).sum(), (x * y).sum()])


def test_labels_and_comparison_of_models(spark, tmp_path):
    rng = np.random.default_rng(3)
    for name, n in (("a", 40), ("b", 30)):
        (tmp_path / name).mkdir()
        status = ["Cancer" if i % 2 else "Control" if i % 4 else "" for i in range(n)]
        np.save(tmp_path / name / "feature_dataset.npy", np.stack([rng.normal(size=(n, 4)) + np.array([[2.0 * (s == "Cancer"), 0, 0, 0] for s in status]), np.zeros((n, 4))], axis=1))
        (tmp_path / name / "meta_data.csv").write_text("Sample ID,Cancer Status\n" + "".join(f"{name}{i},{s}\n" for i, s in enumerate(status)))
    rows = tables.with_labels(files.read_panel(spark, {x: str(tmp_path / x) for x in "ab"}))
    assert rows.columns == ["sample_id", "dataset", "y", "features"] and rows.count() == 70
    assert {(r["sample_id"], r["y"]) for r in rows.collect()} == {(f"{d}{i}", i % 2) for d, n in (("a", 40), ("b", 30)) for i in range(n)}
    assert tables.with_labels(files.read_panel(spark, {"a": str(tmp_path / "a")}), "absent").agg(F.sum("y")).first()[0] == 0
    few, many = model.train(rows, 0.9, 0.1), model.train(rows, 0.99, 5.0)
    got = {r["model"]: r for r in model.compare({"few": few, "many": many}, rows).collect()}
    for name, m in (("few", few), ("many", many)):
        assert {k: got[name][k] for k in ("nonzero", "min", "max", "intercept")} == pytest.approx(m.summary())
        assert got[name]["mean_score"] == pytest.approx(np.mean([r["score"] for r in m.predict(rows).collect()]))
    assert got["few"]["nonzero"] <= got["many"]["nonzero"]
