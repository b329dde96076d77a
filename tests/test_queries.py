"""Every registered query of the engine against its SQL on the smallest tables, and sinks and sources."""

import math

import duckdb
import numpy as np
import pytest

from tessera.operators import correlate
from tessera.plans import queries as Q
from tessera.sources import files, tables

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
QUERIES, ORACLE = Q.queries(), Q.oracle_sql()
NO_BINS_LEFT = ["q_diff_examples", "q_diff_stats", "q_diff_value_counts", "q_top_diffs", "q_worst_diffs", "q_features_with_consensus", "q_matrix_reorder"]


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    return None if math.isnan(float(v)) else float(f"{float(v) + 0.0:.8g}")


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in [*TABLES, "labels"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    rel = db.execute(ORACLE[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(plain(r[names.index(c)]) for c in df.columns) for r in rel.fetchall()), key=key)
    assert sorted((tuple(plain(x) for x in r) for r in df.collect()), key=key) == want


@pytest.fixture(scope="module")
def covered(sf, tmp_path_factory):
    """The smallest tables, in which the consensus of mask type O covers every bin: its masks have no bin left."""
    d, con = tmp_path_factory.mktemp("covered"), duckdb.connect()
    for t in ("events", "orders"):
        (d / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    more = "SELECT l.* REPLACE (b AS l_orderkey, p AS l_partkey, 10 AS l_suppkey, 'O' AS l_linestatus, (8 + b % 3) / 100 AS l_discount) FROM (SELECT * FROM li LIMIT 1) l, range(721) r(b), range(5) q(p)"
    con.execute(f"CREATE VIEW li AS SELECT * FROM '{sf}/lineitem.parquet'")
    con.execute(f"COPY (SELECT * FROM li UNION ALL {more}) TO '{d}/lineitem.parquet' (FORMAT parquet)")
    for t in ("events", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return str(d), con


@pytest.mark.parametrize("name", NO_BINS_LEFT)
def test_masks_without_a_bin_left(spark, covered, name):
    d, con = covered
    test_equals_sql(spark, d, con, name)


@pytest.mark.parametrize("name", ["q_insert_size_factors", "q_insert_size_corrected", "q_pvalue"])
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_files(spark, sf, tmp_path):
    feats = Q.P.features(spark, sf, p_values=False)
    tables.write_long_csv(correlate.long_form(feats), str(tmp_path / "long"))
    assert spark.read.option("header", True).csv(str(tmp_path / "long")).count() == 9 * feats.count()
    tables.write_matrix(feats, str(tmp_path / "wide"))
    tables.write_params(correlate.standardize(feats)[1], str(tmp_path / "params"))
    assert set(spark.read.json(str(tmp_path / "params")).columns) == {"mean", "std"}
    (tmp_path / "cells.csv").write_text("idx,cell_type\n4,b\n2,consensus\n")
    assert [r["cell_type"] for r in tables.read_cell_types(spark, str(tmp_path / "cells.csv")).orderBy("row_ord").collect()] == ["b", "consensus"]
    (tmp_path / "a.csv").write_text("Sample ID,Stage\ns1,II\n")
    (tmp_path / "b.csv").write_text("Sample ID\ns2\n")
    rows = {r["dataset"]: r["Stage"] for r in tables.read_cohorts(spark, {"a": str(tmp_path / "a.csv"), "b": str(tmp_path / "b.csv")}).collect()}
    assert rows == {"a": "II", "b": None}


def npz(path, length, at, values, kind="csr", width=1):
    path.parent.mkdir(parents=True, exist_ok=True)
    at, values = np.array(at), np.array(values, float)
    arrays = {"row": at, "col": np.zeros(len(at), int)} if kind == "coo" else {"indices": at, "indptr": np.array([0, len(at)])}
    if kind == "csr":
        arrays = {"indices": np.zeros(len(at), int), "indptr": np.searchsorted(at, np.arange(length + 1))}
    np.savez(path, format=np.array(kind), shape=np.array([length, width]), data=values, **arrays)


def test_array_files(spark, tmp_path):
    for kind, cell in (("csr", "liver"), ("csc", "lung"), ("coo", "skin")):
        npz(tmp_path / "m" / cell / "chr1.npz", 9, [1, 4, 7], [0.123, 0.004, 1.0], kind)
    npz(tmp_path / "m" / "liver" / "chr2.npz", 9, [0], [0.5])
    got = sorted(map(tuple, files.read_masks(spark, str(tmp_path / "m"), "DNase", ["liver", "skin", "absent"], "chr1").collect()))
    assert got == [("DNase", c, "chr1", i, v) for c in ("liver", "skin") for i, v in ((1, 0.12), (7, 1.0))]
    bins = spark.createDataFrame([("chr1", 1), ("chr1", 4), ("chr1", 5), ("chr2", 0)], "chrom string, idx long")
    vector = files.read_sparse_vectors(spark, str(tmp_path / "m" / "liver"), 7)
    assert sorted(map(tuple, files.gather(bins, vector, "v").collect())) == [("chr1", 1, 0.123), ("chr1", 4, 0.004), ("chr1", 5, 0.0), ("chr2", 0, 0.5)]
    npz(tmp_path / "bad" / "chr1.npz", 9, [1], [1.0], "coo", 2)
    with pytest.raises(Exception, match="shape"):
        files.read_sparse_vectors(spark, str(tmp_path / "bad")).collect()
    np.savez(tmp_path / "x1.npz", chr1=np.array([3, 5]), chr2=np.array([1]))
    np.savez(tmp_path / "x2.npz", chr1=np.array([5, 9]))
    (tmp_path / "x3.npz").write_bytes(b"no archive")
    paths = [str(tmp_path / f"x{i}.npz") for i in (1, 2, 3, 4)]
    assert sorted(map(tuple, files.read_indices(spark, paths).collect())) == [("chr1", 3), ("chr1", 5), ("chr1", 9), ("chr2", 1)]
    assert files.read_indices(spark, []).count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_indices(spark, paths[3:], skip_bad=False)


def test_sequence_bins_and_panels(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">chr1 first\nGCat\nNN\n>chr2\nACG\n")
    seqs = files.read_fasta(spark, str(tmp_path / "g.fa"))
    assert sorted(map(tuple, seqs.collect())) == [("chr1", "GCatNN"), ("chr2", "ACG")]
    assert [tuple(r) for r in files.fasta_range(seqs, "chr1", 1, 4).collect()] == [("chr1", "Cat")]
    spark.createDataFrame([(7, 0.456), (8, math.nan)], "idx long, GC double").write.parquet(str(tmp_path / "bins"))
    assert sorted(map(tuple, tables.read_bins(spark, str(tmp_path / "bins")).collect())) == [(7, 0.46), (8, None)]
    spark.createDataFrame([("chr1", 5, 9), ("chr1", 20, 30), ("chr2", 5, 9)], "chrom string, start long, end long").write.parquet(str(tmp_path / "reads"))
    region = tables.read_reads(spark, str(tmp_path / "reads"), "chr1", 8, 20)
    assert [tuple(r) for r in region.collect()] == [("chr1", 5, 9)]
    assert "EqualTo(chrom,chr1)" in region._jdf.queryExecution().executedPlan().toString()
    for name, n in (("a", 3), ("b", 2)):
        (tmp_path / name).mkdir()
        np.save(tmp_path / name / "feature_dataset.npy", np.arange(n * 2 * 2, dtype=float).reshape(n, 2, 2))
        (tmp_path / name / "meta_data.csv").write_text("id,status\n" + "".join(f"{name}{i},{'Cancer' if i else ''}\n" for i in range(n)))
    got = files.read_panel(spark, {x: str(tmp_path / x) for x in "ab"}, 1).orderBy("dataset", "row").collect()
    assert [(r["dataset"], r["row"], r["features"], r["meta"]["id"], r["meta"]["status"]) for r in got][:2] == [("a", 0, [2.0, 3.0], "a0", None), ("a", 1, [6.0, 7.0], "a1", "Cancer")]
    assert len(got) == 5
    (tmp_path / "b" / "meta_data.csv").write_text("id\nb0\n")
    with pytest.raises(Exception, match="different numbers"):
        files.read_panel(spark, {"b": str(tmp_path / "b")}).collect()
    assert files.choose(spark, str(tmp_path / "a"), None, True) == str(tmp_path / "a")
    with pytest.raises(ValueError, match="no path"):
        files.choose(spark, str(tmp_path / "a"), None, False)
    with pytest.raises(FileNotFoundError):
        files.choose(spark, None, str(tmp_path / "nowhere"), False)


def test_plans_read_bins_once(spark, sf):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert plan(Q.q_flagship(spark, sf)).count("Scan parquet") <= 12
    p = plan(Q.megabins.with_ends(Q.P.aligned(spark, sf), 60))
    assert "Window" not in p


def test_filters_reach_the_scan(spark, sf):
    plan = Q.binning.good_reads(tables.reads(spark, sf)).select("chrom")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "user_id" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
