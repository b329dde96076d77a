"""Files by ranges: BAM through its index, FASTA through its index, arrays and masks without opening what isn't asked for."""

import io
import math
import random
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import binning, correlate
from tessera.sources import arrays, bam, fasta, files, tables

READ = "chrom string, start long, end long, mapq int, proper_pair boolean, is_read1 boolean, tlen long"
PLAIN = [c.split()[0] for c in READ.split(", ")]


# BAM


@pytest.fixture(scope="module")
def reads():
    r = random.Random(1)
    out = []
    for _ in range(6000):
        start = r.randrange(0, 3_000_000)
        end = None if r.random() < 0.02 else start + r.randrange(0, 400) + (200_000 if r.random() < 0.003 else 0)
        out.append((r.choice(["chr1", "chr2", "chrX"]), start, end, r.randrange(0, 60), r.random() < 0.8, r.random() < 0.5, r.randrange(-500, 500)))
    return out + [("chr1", 2_999_000, 2_999_100, 30, True, True, 1)] * 40 + [(None, -1, None, 0, False, False, 0)] * 5


@pytest.fixture(scope="module")
def bam_folder(spark, reads, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bam") / "x")
    assert bam.write_bam(spark.createDataFrame(reads, READ), path) == len(reads)
    return path


def key(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("step", ["1000", "30000", "100000000"])
def test_bam_round_trip(spark, reads, bam_folder, step):
    got = bam.read_bam(spark, bam_folder, rangeBytes=step, batchBytes="70000")
    assert key(got.select(*PLAIN).collect()) == key(reads)
    assert got.filter("end IS NULL AND (flag & 4) = 0").count() == 0


@pytest.mark.parametrize("region", [("chr2", 1_000_000, 1_050_000), ("chrX", 0, 1), ("chr1", 2_999_050, None), ("chr1", None, 40_000), ("chr1", 16_384, 16_385), ("chr9", 0, 10), ("chr2", 2_999_999, 5_000_000)])
def test_bam_region(spark, reads, bam_folder, region):
    chrom, start, end = region
    want = [r for r in reads if r[0] == chrom and (end is None or r[1] < end) and (start is None or r[2] is not None and r[2] > start)]
    got = bam.read_bam(spark, bam_folder, *region)
    assert key(got.select(*PLAIN).collect()) == key(want)
    # As the Parquet loader has it.
    parquet = spark.createDataFrame(reads, READ)
    path = bam_folder + "-parquet"
    parquet.write.mode("ignore").parquet(path)
    assert key(tables.read_reads(spark, path, *region).collect()) == key(want)


def test_bam_region_reads_its_blocks_only(spark, tmp_path):
    rows = [("chr1", i * 50, i * 50 + 40, 30, True, True, 40) for i in range(60_000)]
    path = str(tmp_path / "b")
    bam.write_bam(spark.createDataFrame(rows, READ).coalesce(1), path)
    whole, some = bam.BamReader({"path": path}), bam.BamReader({"path": path})
    list(some.pushFilters([bam.EqualTo(("chrom",), "chr1"), bam.LessThan(("start",), 1_000_000), bam.GreaterThan(("end",), 990_000)]))
    assert (some.chrom, some.low, some.high) == ("chr1", 990_000, 1_000_000)

    def cost(reader):
        blocks, got = 0, 0
        for part in reader.partitions():
            for begin, end in part.chunks:
                blocks += (end >> 16) - (begin >> 16)
            got += sum(b.num_rows for b in reader.read(part))
        return blocks, got

    (all_bytes, n), (few_bytes, m) = cost(whole), cost(some)
    assert n == len(rows) and 200 <= m < n / 10 and few_bytes < all_bytes / 10
    assert len(bam.BamReader({"path": path, "rangebytes": "10000"}).partitions()) >= 8


def test_bam_coverage(spark, reads, bam_folder):
    rows = spark.createDataFrame(reads, READ)
    for f in (binning.coverage, binning.start_counts, binning.mean_lengths):
        value = f(rows, 100).columns[-1]
        got, want = ({tuple(r)[:2]: r[value] for r in f(x, 100).collect()} for x in (bam.read_bam(spark, bam_folder), rows))
        assert got.keys() == want.keys() and all(a == b or abs(a - b) < 1e-9 for a, b in ((got[k], want[k]) for k in got))


def test_bam_alignments_and_broken_files(spark, tmp_path):
    # Records with names, letters and several operations: only those on the reference count.
    def record(pos, ops, flag=0, name=b"read", seq=7):
        cigar = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(c)) for n, c in ops)
        body = struct.pack("<iiBBHHHiiii", 0, pos, len(name) + 1, 9, 4681, len(ops), flag, seq, -1, -1, -7) + name + b"\0" + cigar + bytes((seq + 1) // 2 + seq) + b"NMC\x01"
        return struct.pack("<i", len(body)) + body

    data = b"".join([record(5, [(3, "S"), (4, "M"), (2, "I"), (3, "D"), (10, "N"), (1, "="), (1, "X"), (2, "H")]), record(6, []), record(7, [(5, "M")], flag=4), record(8, [(9, "M")], name=b"x" * 200, seq=0)])
    starts, at = bam.record_starts(data, len(data))
    got = bam.decode(data, starts)
    assert at == len(data) and got["start"].tolist() == [5, 6, 7, 8] and got["end"].tolist() == [24, -1, -1, 17] and set(got["tlen"].tolist()) == {-7}
    assert bam.record_starts(data[:-1], len(data))[0] == starts[:3]
    # Every cut of the bytes into batches gives the same records.
    w = bam._Writer(io.BytesIO(), ["c"], [1000])
    w.held = bytearray(data)
    w.flush()
    out, first = w.f.getvalue(), None
    names, lengths, first = bam.read_header(io.BytesIO(out))
    assert (names, lengths) == (["c"], [1000])
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.bam").write_bytes(out[:-5])
    with pytest.raises(ValueError, match="cut off|check sum"):
        list(bam.BamReader({"path": ""}).records(open(tmp_path / "bad" / "a.bam", "rb"), first, len(out) << 16))
    with pytest.raises(ValueError, match="no block"):
        bam.read_header(io.BytesIO(b"no bam file at all, but long enough"))
    assert bam.write_bam(spark.createDataFrame([], READ), str(tmp_path / "none")) == 0
    assert bam.read_bam(spark, str(tmp_path / "none")).count() == 0


def test_binning_of_places():
    rng = np.random.default_rng(2)
    start = rng.integers(0, bam.LARGEST - 10_000_000, 500)
    end = start + rng.integers(1, 9_000_000, 500)
    for s, e, b in zip(start.tolist(), end.tolist(), bam.bin_of(start, end).tolist()):
        assert any(b in w for w in bam.bins_over(s, e)) and any(b in w for w in bam.bins_over(e - 1, e))


# FASTA


def sequences():
    r = random.Random(3)
    say = lambda n: "".join(r.choice("ACGTacgtN") for _ in range(n))
    return {"chr1": say(1000), "chr2": "", "long": say(70_001), "chrM": say(60), "one": "G", "wide": say(180)}


def write(path, seqs, line=60, newline="\n"):
    with open(path, "w", newline="") as f:
        for i, (name, seq) in enumerate(seqs.items()):
            f.write(f">{name} some >words, a->b{newline}" + "".join(seq[k : k + line] + newline for k in range(0, len(seq), line)))


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_fasta_index_in_any_ranges(tmp_path, newline):
    seqs = sequences()
    path = tmp_path / "g.fa"
    write(path, seqs, newline=newline)
    size = path.stat().st_size
    data = path.read_bytes()
    for step in (1, 7, 61, 997, 1 << 20):
        if step == 1 and size > 5000:
            seqs_, data_ = {"a": "ACGT" * 40, "b": "", "c": "AC"}, None
            write(tmp_path / "s.fa", seqs_, newline=newline)
            data_ = (tmp_path / "s.fa").read_bytes()
        else:
            seqs_, data_ = seqs, data
        f = io.BytesIO(data_)
        found = [x for a in range(0, len(data_), step) for x in fasta.scan(f, a, min(len(data_), a + step), len(data_), 50 if step < 100 else 1 << 20)]
        entries = fasta.merge(found)
        assert [(e.name, e.length) for e in entries] == [(n, len(s)) for n, s in seqs_.items()]
        for e in entries:
            s = data_[e.place(0) : e.place(e.length)].translate(None, b"\r\n").decode()
            assert s == seqs_[e.name]
            assert not e.length or e.bases == min(60, e.length) and e.width == e.bases + len(newline)


def test_fasta_ranges(spark, tmp_path):
    seqs = sequences()
    write(tmp_path / "g.fa", seqs)
    assert fasta.index_fasta(spark, str(tmp_path), step=5000) == 1 and fasta.index_fasta(spark, str(tmp_path)) == 0
    how = {"chunkLetters": "997", "rangeLetters": "3000"}
    rows = fasta.read_sequences(spark, str(tmp_path), **how)
    got = rows.collect()
    assert max(len(r["seq"]) for r in got) == 997 and rows.rdd.getNumPartitions() > 20
    whole = {n: "".join(r["seq"] for r in sorted(got, key=lambda r: r["start"]) if r["chrom"] == n) for n in seqs}
    assert whole == seqs and {(r["chrom"], r["length"]) for r in got} == {(n, len(s)) for n, s in seqs.items()}
    for chrom, lo, hi in (("long", 990, 5005), ("long", 0, 1), ("long", 69_990, 10**6), ("chr1", None, 30), ("chr1", 997, None)):
        part = sorted(fasta.read_sequences(spark, str(tmp_path), chrom, lo, hi, **how).collect(), key=lambda r: r["start"])
        assert "".join(r["seq"] for r in part) == seqs[chrom][lo:hi] and part[0]["start"] == (lo or 0)
    reader = fasta.FastaReader({"path": str(tmp_path), "chunkletters": "997", "rangeletters": "3000"})
    list(reader.pushFilters([fasta.EqualTo(("chrom",), "long"), fasta.LessThan(("start",), 5005), fasta.GreaterThan(("end",), 990)]))
    assert sum(b - a for p in reader.partitions() for _, a, b in p.ranges) == 6 * 997
    # Bins that cross chunks, against whole sequences.
    frame = spark.createDataFrame(list(seqs.items()), "chrom string, seq string")
    for width in (1, 60, 100, 997, 80_000):
        a = {(r["chrom"], r["idx"]): r["gc"] for r in fasta.gc_of_chunks(rows, width).collect()}
        b = {(r["chrom"], r["idx"]): r["gc"] for r in binning.gc_per_bin(frame, "chrom", "seq", width).collect()}
        assert a.keys() == b.keys() and all(math.isclose(a[k], b[k]) for k in a)
        assert len(a) == sum(len(s) // width + 1 for s in seqs.values())


def test_fasta_of_unlike_lines_is_an_error(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">a\nACGT\nAC\nACGT\n")
    with pytest.raises(ValueError, match="unlike length"):
        fasta.index_fasta(spark, str(tmp_path / "g.fa"))
    for text in (">a\nAC\nACGT\n", ">a\nACGT\nACG\nACGT\nA\n", ">a\nACGT\n\nACGT\n", ">b\nAC\n>a\nACGT\nACGT\nAC\nACGTA\n"):
        for step in (1, 2, 3, 5, 100):
            data = text.encode()
            with pytest.raises(ValueError, match="a has lines of unlike"):
                fasta.merge([x for a in range(0, len(data), step) for x in fasta.scan(io.BytesIO(data), a, min(len(data), a + step), len(data))])
    (tmp_path / "h.fa").write_text("ACGT\n>a\nAC\n")
    with pytest.raises(ValueError, match="before the first header"):
        fasta.index_fasta(spark, str(tmp_path / "h.fa"))


def test_header_with_an_arrow(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">chr1 a->b\nGC\n>chr2\nA>C\n")
    assert sorted(map(tuple, files.read_fasta(spark, str(tmp_path / "g.fa")).collect())) == [("chr1", "GC"), ("chr2", "A>C")]


def test_gc_takes_linear_time(spark):
    # Ten million letters: quick if each letter is passed once, hours if each bin starts from the first.
    df = spark.range(1).select(F.lit("c").alias("chrom"), F.repeat(F.lit("ACGGT"), 2_000_000).alias("seq"))
    began = time.time()
    assert binning.gc_per_bin(df, "chrom", "seq", 100).agg(F.count("*"), F.round(F.avg("gc") * 100_001 / 100_000, 9)).first() == (100_001, 0.6)
    assert time.time() - began < 20


# Arrays and masks


def test_array_rows(spark, tmp_path):
    x = np.random.default_rng(1).random((101, 3, 40)).astype(np.float32)
    np.save(tmp_path / "x.npy", x)
    rows = arrays.read_rows(spark, str(tmp_path / "x.npy"), 1, rangeBytes="5000")
    got = sorted(rows.collect())
    assert rows.rdd.getNumPartitions() > 10 and [r["row"] for r in got] == list(range(101))
    assert np.array_equal(np.array([r["features"] for r in got]), x[:, 1].astype(float))
    np.save(tmp_path / "f.npy", np.asfortranarray(x))
    with pytest.raises(Exception, match="column by column"):
        arrays.read_rows(spark, str(tmp_path / "f.npy")).collect()
    with pytest.raises(Exception, match="expected"):
        arrays.read_rows(spark, str(tmp_path / "x.npy"), 3).collect()
    np.save(tmp_path / "e.npy", x[:0])
    assert arrays.read_rows(spark, str(tmp_path / "e.npy")).count() == 0


def test_masks_of_other_cells_are_not_opened(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [("A", cell, c, int(i), float(v)) for cell in ("k1", "k2", "k3") for c in ("x", "y") if (cell, c) != ("k3", "y") for i, v in zip(rng.permutation(15)[:6], np.round(rng.random(6), 2) + 0.01)]
    masks = spark.createDataFrame(rows, "mask_type string, cell_type string, chrom string, idx long, overlap double")
    assert arrays.write_masks(masks, str(tmp_path), 15) == 5
    # A file that isn't wanted could not be read.
    (tmp_path / "A" / "k2" / "x.npz").write_bytes(b"broken")
    (tmp_path / "A" / "k1" / "z.npz").write_bytes(b"broken")
    got = files.read_masks(spark, str(tmp_path / "A"), "A", ["k1", "k3", "absent"], "x")
    assert sorted(got.collect()) == sorted(r for r in masks.withColumn("overlap", F.round("overlap", 2)).collect() if r["cell_type"] != "k2" and r["chrom"] == "x")
    assert len(got.inputFiles()) == 2 and files.read_masks(spark, str(tmp_path / "A"), "A", ["absent"]).count() == 0
    with pytest.raises(Exception, match="k2|zip|pickle"):
        files.read_masks(spark, str(tmp_path / "A"), "A", ["k2"]).collect()


def test_sums_of_mask_files_equal_dense_sums(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [("A", cell, c, i, round(float(rng.random()), 2) + 0.01) for cell in ("k1", "k2") for c in "xy" for i in range(40) if rng.random() < 0.3]
    masks = spark.createDataFrame(rows, "mask_type string, cell_type string, chrom string, idx long, overlap double")
    arrays.write_masks(masks, str(tmp_path), 40)
    bins = spark.createDataFrame([("A", c, i, float(rng.random()) if i % 7 else None) for c in "xy" for i in range(40)], "mask_type string, chrom string, idx long, x double")
    manifest = masks.select("mask_type", "cell_type", "chrom").distinct()
    dense = bins.join(manifest, ["mask_type", "chrom"]).join(masks, ["mask_type", "cell_type", "chrom", "idx"], "left").withColumn("y", F.coalesce(F.round("overlap", 2).cast("float").cast("double"), F.lit(0.0)))
    want = {r["cell_type"]: list(r)[1:] for r in correlate.dense_sums(dense, ["cell_type"]).collect()}
    got = {r["cell_type"]: list(r)[2:] for r in correlate.sparse_sums(bins, files.read_masks(spark, str(tmp_path / "A"), "A"), manifest, "x").collect()}
    assert got.keys() == want.keys() == {"k1", "k2"}
    assert all(np.allclose(got[k], want[k]) for k in got)


def test_mask_sets_are_few_files_and_give_their_masks_back(spark, tmp_path):
    rng = np.random.default_rng(9)
    names = [f"k{i}" for i in range(300)] + ["é cell/1", "漢"]
    rows = [(t, cell, c, int(i), float(v)) for t in "AB" for cell in names for c in ("x", "y") for i, v in zip(rng.permutation(15)[:6], np.round(rng.random(6), 2) + 0.01)]
    masks = spark.createDataFrame(rows, "mask_type string, cell_type string, chrom string, idx long, overlap double").repartition(7)
    n = arrays.write_mask_sets(masks, str(tmp_path / "whole"), 15)
    # Not a file for each of 302 cell types, two mask types and two chromosomes.
    assert set(n) == {"A", "B"} and sum(n.values()) == len(list((tmp_path / "whole").rglob("*.npz"))) <= 4 * 8
    arrays.write_mask_sets(masks, str(tmp_path / "cut"), 15, most=100)
    want = sorted(masks.withColumn("overlap", F.round("overlap", 2)).collect())
    for name in ("whole", "cut"):
        got = files.read_mask_sets(spark, str(tmp_path / name), "A").unionByName(files.read_mask_sets(spark, str(tmp_path / name), "B"))
        assert sorted(got.collect()) == want
    assert sorted(files.read_mask_sets(spark, str(tmp_path / "cut"), "B", "y").collect()) == [r for r in want if (r["mask_type"], r["chrom"]) == ("B", "y")]
    assert arrays.write_mask_sets(masks.limit(0), str(tmp_path / "none"), 15) == {}


def test_the_query_of_mask_files_writes_few_of_them(spark, sf, monkeypatch):
    from tessera.plans import queries

    files_of = []
    write = arrays.write_mask_sets
    monkeypatch.setattr(arrays, "write_mask_sets", lambda *a: files_of.append(write(*a)) or files_of[-1])
    got = sorted(map(tuple, queries._queries["q_mask_files_sums"](spark, sf).collect()))
    assert got == sorted(map(tuple, queries._queries["q_pearson_sums_sparse"](spark, sf).collect()))
    assert len(got) >= 10 and sum(files_of[0].values()) <= 4 * 2 * 5
