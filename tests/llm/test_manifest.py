"""The Merkle manifest and the whitening of embeddings, against brute force."""

import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle, queries, whitening


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves):
    """Root, and for each leaf its siblings (left, right), level by level."""
    at, paths, level = list(range(len(leaves))), [[] for _ in leaves], list(leaves)
    while len(level) > 1:
        for i in range(len(leaves)):
            k = at[i] // 3 * 3
            run = level[k : k + 3]
            j = at[i] - k
            paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            at[i] //= 3
        level = [h(*level[k : k + 3]) for k in range(0, len(level), 3)]
    return level[0], paths


def brute_manifest(rows):
    """rows of (id, group, value): (id, leaf, subroot, root, proof) of each."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for i, g, v in rows:
        groups.setdefault(g, []).append((i is not None, i, h(field(i), field(g), field(v))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0], r[1] or 0, r[2]))
        trees[g] = brute_tree([r[2] for r in groups[g]])
    root, tops = brute_tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        out += [(i, leaf, trees[g][0], root, p + top) for (_, i, leaf), p in zip(groups[g], trees[g][1])]
    return out


def made(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("g", F.lit(1)).withColumn("leaf", F.lit("x"))
    out = merkle.manifest(df, merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("text")), keep={"of": F.col("text")})
    assert out.columns == ["doc_id", "leaf", "of", "subroot", "root", "proof"]
    return out


def same(out, rows):
    got = sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["proof"]]) for r in out.collect()), key=str)
    assert got == sorted(brute_manifest(rows), key=str)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_manifest(spark, parts):
    # Null ids and groups, ties and whole rows that repeat, groups of 1 to 400, empty and long texts.
    r = random.Random(4)
    rows = [(i, r.choice(["a", "a", "a", "b", "é", "", None, f"one{i}"]), r.choice(["", None, "t\n", "x" * 1_000_000 if i == 5 else "y"])) for i in range(600)]
    rows += [(None, "a", "u"), (None, "a", "u"), (None, None, None)] + [(7, "a", "same")] * 50 + [(7, "a", f"v{k}") for k in range(5)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out = made(spark, rows)
        same(out, rows)
        ok = out.select((merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok"), "of").distinct().collect()
        assert {x["ok"] for x in ok} == {True}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_manifest_small_tables(spark):
    for n in (0, 1, 2, 3, 4, 9, 10):
        rows = [(i, "s", "t") for i in range(n)]
        if n:
            same(made(spark, rows), rows)
        else:
            assert made(spark, rows).count() == 0


def test_manifest_over_several_bands(spark):
    # 45,000 leaves of one group: blocks of 3^9 within partitions, cut ones, and a second band above.
    rows = [(i, "hot" if i % 9 else f"s{i % 5}", str(i)) for i in range(45_000)]
    same(made(spark, rows), rows)


def test_nodes_that_are_missing_are_an_error():
    with pytest.raises(ValueError, match=r"\[1\] of level 0"):
        merkle.finish([(0, 0, "a"), (0, 2, "b")], 5, 0)


def test_tampering_is_seen(spark, sf):
    out = queries.op12_merkle(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id")
    bad = out.filter((merkle.id_crc() % 2 == 0) & F.contains("text", F.lit("\n")))
    assert bad.count() == out.filter("NOT verified").count() > 0
    assert bad.filter("verified").count() == 0


# Whitening


def vectors(spark, seed=2, n=300, dim=7):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) @ rng.normal(size=(dim, dim))
    rows = [(i, x.tolist(), "p") for i, x in enumerate(v.astype(np.float32).astype(float))]
    rows += [(None, rows[0][1], "p"), (3, rows[3][1], "q"), (3, rows[3][1], "q")]
    odd = [(900, None, "p"), (901, [1.0, None] + [0.0] * (dim - 2), "p"), (902, [float("nan")] * dim, None), (903, [float("inf")] * dim, "p"), (904, [], "p")]
    return rows, spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, whitened string").repartition(5)


def test_whitening(spark):
    rows, df = vectors(spark)
    x = np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    e, v = np.linalg.eigh(np.cov(x.T, bias=True))
    e, v = e[::-1], v[:, ::-1]
    want = (x - s / n) @ v / np.sqrt(e)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    got = whitening.whiten(df).collect()
    assert len(got) == n and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    assert np.allclose(got[0]["explained"], e / e.sum(), rtol=1e-9)
    of = {}
    for (i, *_), w, d in zip(rows, want, deviation):
        of[i] = (w, d)
    sign = None
    for r in got:
        w, d = of[r["vec_id"]]
        assert r["deviation"] == d
        sign = np.sign(np.array(r["whitened"]) * w) if sign is None else sign
        assert np.allclose(np.array(r["whitened"]) * sign, w, atol=1e-8)
    long = whitening.by_component(whitening.whiten(df, components=2)).collect()
    assert sorted({r["component"] for r in long}) == [1, 2] and len(long) == 2 * n


def test_whitening_of_odd_tables(spark):
    _, df = vectors(spark)
    assert whitening.whiten(df.filter("vec_id >= 900")).count() == 0
    assert whitening.by_component(whitening.whiten(df.limit(0))).count() == 0
    # One distinct vector: nothing varies, no component can be whitened; a long deviation that doesn't fit is null.
    one = spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 2.0])], "vec_id long, embedding array<double>")
    assert [(r["deviation"], r["whitened"]) for r in whitening.whiten(one).collect()] == [(0, []), (0, [])]
    far = spark.createDataFrame([(1, [0.0, 1e30]), (2, [0.0, -1e30]), (3, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(far).collect()}
    assert got[1] is None and got[3] == (3 * 64 - 64) ** 2
    with pytest.raises(ValueError, match="one length"):
        whitening.whiten(spark.createDataFrame([(1, [0.5]), (2, [0.5, 2.0])], "vec_id long, embedding array<double>"))


def test_jacobi_keeps_small_eigenvalues():
    # A graded matrix: eigenvalues from 1 to 1e-24, each to relative accuracy.
    rng = np.random.default_rng(1)
    d = 10.0 ** -np.arange(0, 13)
    b = rng.normal(size=(13, 13)) * 0.05 + np.eye(13)
    a = d[:, None] * (b @ b.T) * d
    e, v = whitening.jacobi(a)
    assert (np.diff(e) <= 0).all() and np.allclose(v.T @ v, np.eye(13), atol=1e-13)
    scaled = [np.linalg.norm(a @ v[:, i] - e[i] * v[:, i]) / e[i] for i in range(3)]
    assert max(scaled) < 1e-12
    det = np.linalg.slogdet(b @ b.T)[1] + 2 * np.log(d).sum()
    assert abs(np.log(e).sum() - det) < 1e-9
