"""The training-data operators against brute force, on small tables with every odd case."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, media, mixing, near_dedup, queries, sequences, substring_dedup, suffix_dedup, token_files, toxicity
from tessera.llm.exact_dedup import exact_dedup, keep_exact

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, copies int, size double, comp int"


def texts(seed=1, n=60):
    r = random.Random(seed)
    say = lambda k: " ".join(r.choice(WORDS) for _ in range(k))
    shared, line = say(30), "This file is under a licence, see the notice that comes with it for all its terms and conditions of use."
    out = [None, "", " \t\n", "one", "One", "a" * 350, "naïve 漢字 text　with marks!? <|endoftext|> end", say(4000)]
    for i in range(n):
        t = say(r.randrange(5, 90))
        if i % 3 == 0:
            t += " " + shared + " " + say(5)
        if i % 4 == 0:
            t = line + "\n" + t
        if i % 5 == 0 and len(out) > 9:
            w = out[-1].split(" ")
            w[r.randrange(len(w))] = "changed"
            t = " ".join(w)
        out.append(t)
        if i % 7 == 0:
            out += [t] * r.randrange(1, 6)
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = []
    for i, t in enumerate(texts()):
        out.append((i * 3 + 1, t, r.choice(["en", "de", None]), r.choice(["b", "a", "", None, "é"]), len(t or ""), "x", 1, 2.0, 3))
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


# Exact dedup


def test_exact_dedup(docs, rows, empty):
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    got = {r["doc_id"]: r for r in exact_dedup(docs).collect()}
    assert len(got) == len(rows)
    for t, ids in groups.items():
        for i in ids:
            assert tuple(got[i])[1:] == (max(ids), len(ids), i == max(ids), sha(t))
    kept = keep_exact(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(max(v) for v in groups.values())
    assert exact_dedup(empty).count() == 0 and keep_exact(empty).count() == 0


def test_exact_dedup_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, "t"), (4, "t"), (4, "t"), (None, "u"), (7, None), (8, "")], "doc_id long, text string")
    got = sorted(map(tuple, exact_dedup(df).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    assert got == sorted([(None, 4, 3, False), (4, 4, 3, True), (4, 4, 3, True), (None, None, 1, True), (7, 8, 2, False), (8, 8, 2, True)], key=str)
    assert sorted(map(tuple, keep_exact(df).collect()), key=str) == sorted([(4, "t"), (None, "u"), (8, "")], key=str)


def test_exact_dedup_of_hot_groups(docs, rows):
    got = sorted(map(tuple, exact_dedup(docs, most=1).collect()))
    assert got == sorted(map(tuple, exact_dedup(docs).collect()))


def test_clashing_names(spark):
    names = ["doc_id", "text", "source", "digest", "keep", "__d", "copies", "copy", "id", "of", "__id", "__digest"]
    df = spark.createDataFrame([(i, f"t{i % 3} x y", "s", *"abcdefghi") for i in range(6)], f"doc_id long, {', '.join(n + ' string' for n in names[1:])}")
    for f in (keep_exact, mixing.mixed, near_dedup.keep_representatives):
        out = f(df)
        assert out.columns == names and out.count() == (6 if f is mixing.mixed else 3), f
        assert {tuple(r)[3:] for r in out.collect()} == {tuple("abcdefghi")}
    assert exact_dedup(df).count() == 6


def test_shared_folder_must_be_named():
    from types import SimpleNamespace

    from tessera.llm import store

    conf = SimpleNamespace(get=lambda k, d=None: d, set=lambda k, v: None)
    for master, ok in (("local[4]", True), ("local", True), ("local[*]", True), ("local-cluster[3,2,900]", False), ("yarn", False)):
        spark = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
        if ok:
            assert store.shared_dir(spark).startswith("file:///")
        else:
            with pytest.raises(ValueError, match="checkpoint.dir"):
                store.shared_dir(spark)


# Near dedup


def brute_components(rows, n, percent=80):
    def grams(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}

    sets = {r[0]: grams(r[1]) for r in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(docs, rows, n):
    got = {r[0]: tuple(r[1:]) for r in near_dedup.near_duplicates(docs, n=n).collect()}
    want = brute_components(rows, n)
    assert got == want and any(not v[2] for v in want.values())
    if n == 5:
        kept = near_dedup.keep_representatives(docs)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, v in want.items() if v[2])


def test_near_duplicates_chain_and_family(spark, empty):
    # A family around one text whose members are not all alike, and a chain of small changes.
    r = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    out, chain = [], list(base)
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(2, 14)):
            w[r.randrange(120)] = f"x{r.randrange(10**6)}"
        out.append((i, " ".join(w)))
        chain[i] = f"y{i}"
        out.append((1000 + i, " ".join(chain)))
    got = {x[0]: tuple(x[1:]) for x in near_dedup.near_duplicates(spark.createDataFrame(out, "doc_id long, text string"), n=2).collect()}
    assert got == brute_components(out, 2)
    assert near_dedup.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (None, None)], "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.near_duplicates(odd, n=2).collect()), key=str) == sorted([(None, 2, None, True), (5, 2, 5, True), (5, 2, 5, True), (None, 0, None, True)], key=str)


def test_near_dedup_broadcasts_counted_ids_alone(docs, monkeypatch):
    # Spark takes the tables of this size, and an exploded one 48 times as large as it thinks, for small enough to broadcast.
    plans, store = [], near_dedup.stage_table
    keep = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(near_dedup, "stage_table", lambda df, name: (keep(df), store(df, name))[1])
    parts, components = [], near_dedup.components
    monkeypatch.setattr(near_dedup, "components", lambda e: (parts.append(1), components(e, 5))[1])
    keep(near_dedup.keep_representatives(docs))
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line]
    assert len(parts) > 2 and sum("SortMergeJoin" in line for line in joins) > 20
    assert all("LeftSemi" in line or "LeftAnti" in line for line in joins if "BroadcastHashJoin" in line)
    beyond = near_dedup.known_texts(docs, docs.select("doc_id").distinct(), "doc_id", most=3)
    assert "BroadcastHashJoin" not in beyond._jdf.queryExecution().executedPlan().toString()


def test_pipeline_stages_shuffle_what_grows(docs):
    for stage in (keep_exact, mixing.mixed):
        lines = stage(docs)._jdf.queryExecution().executedPlan().toString().splitlines()
        assert any("SortMergeJoin" in x for x in lines) and not any("BroadcastHashJoin" in x for x in lines)


OPEN = "k int, v long, rep long, comp long, main long, others long, mains long, n long, sig array<long>"


@pytest.mark.parametrize("most", [3, 10_000])
@pytest.mark.parametrize("size", [1, 2, 4, 1000])
def test_candidates_span_batches(spark, most, size):
    # One bucket of two main rows and nine others, whose larger ids come first: every pair of components, however batches cut it.
    sig = list(range(near_dedup.CHUNKS))
    rows = [(0, 7, i, 1 if i < 3 else i, 1, 9, 2, 10, sig) for i in range(11, 0, -1)]
    df = spark.createDataFrame(rows, OPEN).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    try:
        got = near_dedup.candidates(df, 80, 1, size).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pairs = sorted(tuple(sorted((r["y"], int(x)))) for r in got for part in r["xs"] for x in np.frombuffer(part, "<i8"))
    assert pairs == [(i, j) for i in range(1, 12) for j in range(i + 1, 12) if j > 2]


def test_unlike_places(spark):
    rng = np.random.default_rng(5)
    a = rng.choice(np.array([0, 1, 0x7FFF, 0x8000, 0xFFFF], np.uint16), (300, 12, 4))
    b = np.where(rng.random(a.shape) < 0.5, a, rng.integers(0, 1 << 16, a.shape).astype(np.uint16))
    packed = [(x.reshape(-1).view(np.int64).tolist(), y.reshape(-1).view(np.int64).tolist()) for x, y in zip(a, b, strict=True)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(packed)], "i long, a array<long>, b array<long>")
    unlike = near_dedup._unlike(F.col("a"), F.col("b"))
    got = [r["d"] for r in rows.select("i", unlike.alias("d")).orderBy("i").collect()]
    assert got == (a != b).sum((1, 2)).tolist()
    # The driver holds this expression in several plans of each turn: a chunk is named twice in it, not sixteen times.
    assert len(str(unlike)) < 4_000


def test_one_bucket_of_many_unlike_classes(spark):
    # 20,000 classes in one bucket, none like another but for 50 pairs: found, and no cell is large.
    rng = np.random.default_rng(5)
    sig = rng.integers(0, 1 << 62, (20_000, near_dedup.CHUNKS))
    sig[:, 0] = 77
    sig[10_050:10_100] = sig[50:100]
    rows = [(0, 7, i, i, 0, 19_999, 1, 10, s) for i, s in enumerate(sig.tolist())]
    df = spark.createDataFrame(rows, OPEN)
    per = near_dedup.cells(df, 1000).groupBy("i", "j").count().collect()
    assert len(per) == 20 * 21 // 2 + 20 and max(r["count"] for r in per) < 2400
    got = near_dedup.candidates(df, 80, 1).collect()
    assert sorted((r["y"], int(x)) for r in got for part in r["xs"] for x in np.frombuffer(part, "<i8")) == [(i + 10_000, i) for i in range(50, 100)]


@pytest.mark.parametrize("share", [10_000, 7])
def test_components(spark, share):
    r = random.Random(8)
    pairs = [(i, i + 1) for i in range(0, 30)] + [(100, r.randrange(101, 160)) for _ in range(40)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    parent = {v: v for p in pairs for v in p}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["v"]: r["root"] for r in near_dedup.components(spark.createDataFrame(pairs, "a long, b long"), share).collect()}
    assert {v: got.get(v, v) for v in parent} == {v: find(v) for v in parent}


def test_pigeonhole():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, (12, 4), dtype=np.int64)
        b = a.copy()
        for p in rng.permutation(48)[:23]:
            b[p // 4, p % 4] ^= 1
        assert any((a[c] != b[c]).sum() <= 1 for c in range(12))


# Repeats


def brute_words(rows, n=13):
    first, out = {}, {}
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
    for i, t in sorted((r[0], r[1]) for r in rows):
        w = split(t)
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - n + 1):
            if first.setdefault(tuple(w[s : s + n]), i) < i:
                gone[s : s + n] = True
        out[i] = (len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def brute_bytes(rows, n=100):
    seen, out = set(), {}
    for i, t in sorted((r[0], r[1]) for r in rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - n + 1):
            if b[s : s + n] in seen:
                gone[s : s + n] = True
            seen.add(b[s : s + n])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


def test_substring_dedup(docs, rows, empty):
    for how in ({}, {"hot_seeds": 3}):
        got = {r[0]: tuple(r[1:]) for r in substring_dedup.remove_repeats(docs, **how).collect()}
        assert got == brute_words(rows) and any(v[1] for v in got.values())
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup(docs, rows, empty):
    got = {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == brute_bytes(rows) and any(v[1] for v in got.values())
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_repeats_with_null_and_repeated_ids(spark):
    t = " ".join(WORDS) * 3
    df = spark.createDataFrame([(None, t), (2, t), (2, t), (9, t)], "doc_id long, text string")
    assert sorted((r[0], r[2]) for r in substring_dedup.remove_repeats(df).filter("doc_id is not null").collect()) == [(2, 0), (2, 0), (9, len(t.split()))]
    gone = {r[0]: r[2] for r in suffix_dedup.remove_repeats(df).filter("doc_id is not null").collect()}
    assert gone[9] == len(t) and gone[2] < len(t)


@pytest.mark.parametrize("how", [{"hot_rows": 3, "hot_entries": 3}, {"task_suffixes": 900, "batch_suffixes": 150}])
def test_suffix_dedup_split(docs, rows, how):
    # Hot anchors split over tasks; many batches and levels.
    got = {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in suffix_dedup.remove_repeats(docs, **how).collect()}
    assert got == brute_bytes(rows)


def test_repeats_in_very_long_texts(spark):
    r = random.Random(12)
    say = lambda k: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 9))) for _ in range(k))
    part = say(400)
    long = say(90_000)
    data = [(1, long[:300_000] + part + long[300_000:]), (2, part + say(100_000)), (3, say(50) + " " + long[262_000:262_400]), (4, "e" * 300)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = {x[0]: (x[1], x[2], x[3], bytes(x[4])) for x in suffix_dedup.remove_repeats(df).collect()}
    assert got == brute_bytes(data) and got[4][1] > 0
    assert {x[0]: tuple(x[1:]) for x in substring_dedup.remove_repeats(df).collect()} == brute_words(data)


@pytest.mark.parametrize("size", [7, 50, 500])
def test_levels_in_any_order(size):
    rng = np.random.default_rng(4)
    n = 500
    text = rng.integers(97, 99, 700).astype(np.uint8)
    pos, doc, at = rng.integers(0, 690, n), rng.integers(0, 40, n), np.arange(n)
    rows = [(text[p : p + 8].tobytes(), int(d), int(a)) for p, d, a in zip(pos, doc, at)]
    first = {}
    for s, d, a in sorted(rows, key=lambda x: x[1:]):
        first.setdefault(s, (d, a))
    levels, late = suffix_dedup.SuffixLevels(8), []
    for i in range(0, n, size):
        j = slice(i, i + size)
        for d, a in levels.add(levels.array(text, pos[j], doc[j], at[j], at[j])):
            late += zip(d.tolist(), a.tolist())
    sizes = [len(x[0]) for x in levels.levels]
    assert all(b * 2 < a for a, b in zip(sizes, sizes[1:]))
    assert all((x[0][1:] > x[0][:-1]).all() for x in levels.levels)
    assert sorted(late) == sorted((d, a) for s, d, a in rows if (d, a) != first[s])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=13, max_size=120))
def test_every_window_has_its_anchor(symbols):
    s = sequences.mix(np.array(symbols, np.uint64) + np.uint64(5))
    shape = sequences.Shape(13, 5)
    at, lo, hi = sequences.anchors(sequences.Hashes(s), len(s), shape)
    covered = [w for a, b in zip(lo, hi) for w in range(a, b + 1)]
    assert covered == list(range(len(s) - 12))
    assert all(a <= p <= a + 8 and b <= p for p, a, b in zip(at, lo, hi)) or all(b <= p <= b + 8 for p, b in zip(at, hi))
    h = sequences.Hashes(s)
    for p, a, b in zip(at, lo, hi):
        for w in range(a, b + 1):
            keys = h.of(np.arange(w, w + 9), np.arange(w, w + 9) + 5) & np.uint64(0xFFFFFFFFFFE00000)
            assert w + int(keys.argmin()) == p


# Toxicity


def toxic_docs(spark, n=400):
    r = random.Random(2)
    out, labels = [(10_000, None), (10_001, "")], []
    for i in range(n):
        w = [r.choice(WORDS) for _ in range(r.randrange(8, 60))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["Nasty,", "vile", "VILE!", "horrid"])
        out.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(out, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, empty):
    docs, labels = toxic_docs(spark)
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 50 and all(got[i]["predicted"] == truth[i] for i in held)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[10_000]["predicted"] == 0
    texts_ = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i in (x for x in held if truth[x]):
        words = [w for s in got[i]["spans"] for w in texts_[i][s["start"] : s["end"]].split()]
        assert words and all(w.strip(",!").lower() in ("nasty", "vile", "horrid") for w in words)
    clean = toxicity.keep_clean(docs, model)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, r in got.items() if not r["predicted"]}
    none = toxicity.train(docs, labels.filter("toxic = 0"))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(empty, model).count() == 0


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    trans = (0.0, -1.2, 0.4, 0.9)
    t = np.array(trans).reshape(2, 2)
    lengths = np.array([4, 1, 0, 3])
    e = rng.normal(size=8)
    got, at = toxicity.marginals(e, lengths, trans), 0
    for n in lengths:
        w = np.zeros((n, 2))
        for path in range(2**n):
            s = [(path >> k) & 1 for k in range(n)]
            p = np.exp(sum(e[at + k] * s[k] for k in range(n)) + sum(t[s[k - 1], s[k]] for k in range(1, n)))
            for k in range(n):
                w[k, s[k]] += p
        assert got[at : at + n] == pytest.approx(np.log(w[:, 1] / w[:, 0]) if n else [])
        at += n


# Media


def test_media(spark, docs, rows, empty):
    got = {r["doc_id"]: r for r in media.media_features(docs).collect()}
    assert len(got) == len(rows)
    for r in rows:
        raw = (r[1] or "").encode()
        pad = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        g = got[r[0]]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(pad), sha(pad), zlib.crc32(pad[-64:]))
    assert len({(r["payload_sha256"], r["n_bytes"], r["media_sha256"], r["feature"]) for r in got.values()}) == len({r[1] or "" for r in rows})
    assert media.media_features(empty).count() == 0


def test_archive_ranges_and_retries(spark, docs, tmp_path, monkeypatch):
    media.write_archives(docs, str(tmp_path))
    whole = media.read_archives(spark, str(tmp_path)).count()
    assert media.read_archives(spark, str(tmp_path), rangeBytes="700", batchBytes="1000").count() == whole == docs.count()
    reader = media.ArchiveReader({"path": str(tmp_path), "rangebytes": "1000"})
    real, calls = media.from_image, {"n": 0}

    def flaky(image):
        calls["n"] += 1
        if calls["n"] % 2:
            raise ValueError("torn read")
        return real(image)

    monkeypatch.setattr(media, "from_image", flaky)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == whole
    monkeypatch.setattr(media, "from_image", lambda image: real(image[:-9]))
    with pytest.raises(OSError, match="tries"):
        list(reader.read(reader.partitions()[0]))


def test_image_round_trip():
    for t in (None, "", "x" * 64, "é" * 1000):
        p, n = media.payload_of(t)
        assert media.from_image(media.to_image(p, n)) == (p, n)


# Tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path(bpe.VOCABULARY))


def test_bpe(docs, rows, empty, library):
    lexicon = bpe.build_lexicon(docs, words=50)
    got = {r["doc_id"]: r for r in bpe.encode(docs, lexicon).collect()}
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        assert got[r[0]]["ids"] == ids and got[r[0]]["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(empty, bpe.build_lexicon(empty)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\tab'stéA1_!.\u0085　漢😀", max_size=60))
def test_units_encode_alone(library, text):
    e = _encoder(bpe.VOCABULARY)
    assert list(memoryview(e(text)).cast("i")) == library.encode(text, add_special_tokens=False).ids
    f = token_files.library_encoder(bpe.VOCABULARY)
    assert list(memoryview(f(text)).cast("I")) == library.encode(text, add_special_tokens=False).ids
    assert "".join(bpe.units(text)) == text


_encoders = {}


def _encoder(name):
    return _encoders.setdefault(name, bpe.Encoder(bpe.Merges(name), None))


def test_long_words_and_lexicon(library, tmp_path):
    m = bpe.Merges()
    for w in ("z" * 3000, "ab" * 700, "Überraschungsmoment" * 9):
        assert m.encode(w.encode()) == library.encode(w, add_special_tokens=False).ids
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["tap", "taps", "top", "tops", "stop", "s", "überall"])}
    data = bpe.Lexicon.compile(words)
    (tmp_path / "lex").write_bytes(data)
    lex = bpe.Lexicon(str(tmp_path / "lex"))
    assert all(lex.find(w) == ids for w, ids in words.items())
    assert lex.find(b"ta") is None and lex.find(b"") is None and lex.find(b"topsy") is None
    suffixes = {w.decode()[i:] for w in words for i in range(len(w)) if w.isascii()}
    assert struct.unpack_from("<I", data, 8)[0] <= 2 * len(suffixes)  # endings are shared


def test_token_files(spark, docs, rows, empty, library):
    got = {r["doc_id"]: r for r in token_files.token_files(docs, file_ids=3000, block_docs=7).collect()}
    at = 0
    for r in sorted(rows):
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        g = got[r[0]]
        assert (g["start"], g["n_tokens"], bytes(g["ids"])) == (at, len(ids), ids.tobytes())
        at += len(ids)
    assert token_files.token_files(empty).count() == 0
    odd = spark.createDataFrame([(None, "a"), (3, "b c"), (3, "b c"), (-2, None)], "doc_id long, text string")
    assert [tuple(r) for r in token_files.token_files(odd).orderBy("start").select("doc_id", "n_tokens").collect()] == [(None, 2), (-2, 1), (3, 3), (3, 3)]


def test_token_files_of_long_documents(spark, library):
    # Blocks end by bytes, offsets pass 2^32 bits, files are as many as asked for, and even.
    r = random.Random(6)
    data = [(i, " ".join(r.choice(WORDS) for _ in range(30 if i % 50 else 20_000))) for i in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x for x in token_files.token_files(df, file_ids=2000, block_bytes=3000, max_files=20).collect()}
    at = 0
    for i, t in data:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], bytes(got[i]["ids"])) == (at, len(ids), ids.tobytes())
        at += len(ids)
    lengths = token_files.code_lengths(np.array([3, 2, 1]))
    bits, marks = token_files.pack(np.array([0, 1, 2, 0], np.uint32), np.array([3, 1]), lengths, token_files.codes(lengths))

    class Sink(token_files._Writer):
        def __init__(self):
            self.n, self.at, self.places, self.data = 0, 0, [], []

        def put(self, data):
            self.data.append(bytes(data))

    class Huge(bytes):
        def __len__(self):
            return 1 << 30  # as if the first document had 8 * 2^30 bits

    import pyarrow as pa

    class Batch:
        def column(self, k):
            return [pa.array([1, 2]), pa.array([3, 1]), None, pa.array(marks)][k] if k != 2 else type("C", (), {"to_pylist": lambda self: [Huge(bits[0]), bits[1]]})()

    sink = Sink()
    sink.block(Batch())
    assert np.frombuffer(sink.data[2][16:], "<u8").tolist() == [0, 1 << 33]


def test_token_files_are_even(spark):
    df = spark.range(0, 60_000, 1, 8).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    path = token_files.new_path(spark, "even")
    sizes = [n for _, n in token_files.write_files(df, path, file_ids=800)]
    assert 290 < len(sizes) <= 300 and max(sizes) < 3 * 800 and sum(sizes) == 240_000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2000), min_size=1, max_size=300), st.integers(9, 20))
def test_huffman(counts, limit):
    c = np.array(counts)
    lengths = token_files.code_lengths(c, limit)
    assert ((lengths > 0) == (c > 0)).all() and lengths.max(initial=0) <= limit
    used = np.flatnonzero(lengths)
    if len(used) > 1:
        assert sum(2.0 ** -int(x) for x in lengths[used]) == 1
    if not len(used):
        return
    ids = np.random.default_rng(len(counts)).choice(used, 900).astype(np.uint32)
    sizes = np.array([300, 1, 599])
    bits, marks = token_files.pack(ids, sizes, lengths, token_files.codes(lengths))
    table, at = token_files.Table(lengths), 0
    for b, m, n in zip(bits, marks, sizes):
        starts = np.frombuffer(m, "<u8")
        parts = np.array([min(256, n - 256 * k) for k in range(len(starts))])
        assert (table.decode(b, starts, parts) == ids[at : at + n]).all() and (table.decode(b, starts, parts, 50) == ids[at : at + n]).all()
        at += n


def test_huffman_is_optimal_without_limit():
    import heapq

    c = np.random.default_rng(3).integers(1, 5000, 200)
    heap = [(int(x), i) for i, x in enumerate(c)]
    heapq.heapify(heap)
    cost, n = 0, 200
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        n += 1
        heapq.heappush(heap, (a[0] + b[0], n))
    assert int((c * token_files.code_lengths(c, 24)).sum()) == cost


# Mixing


def test_mixing(docs, rows, empty):
    got = {r["doc_id"]: r for r in mixing.mix(docs, block_docs=4).collect()}
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size[r[0]] for r in rows if r[3] == s) for s in sources]
    want = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))])
    assert sum(want) == pytest.approx(sum(sizes)) and all(w <= 3 * s + 1e-9 for w, s in zip(want, sizes))
    for k, s in enumerate(sources):
        mine = [r[0] for r in rows if r[3] == s]
        assert all(got[i]["size"] == size[i] and got[i]["source_size"] == sizes[k] and got[i]["target"] == pytest.approx(want[k]) for i in mine)
        taken = sum(len(got[i]["copies"]) * size[i] for i in mine)
        assert abs(taken - want[k]) <= max(size[i] for i in mine)
        # Nothing that was passed over in the block taken in part fits better than what was left.
        full = int(want[k] // sizes[k]) if sizes[k] else 0
        assert all(len(got[i]["copies"]) in (full, full + 1) for i in mine)
        assert all(len(got[i]["copies"]) <= 3 for i in mine)
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(docs.repartition(3), block_docs=4).collect()}
    assert again == {i: r["copies"] for i, r in got.items()}
    out = mixing.mixed(docs, block_docs=4)
    assert out.columns == docs.columns and out.count() == sum(len(r["copies"]) for r in got.values())
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_splitting_tree():
    def table(found, shards, sources):
        tree = np.zeros((shards, sources), int)
        for s, k, n in found:
            tree[s, k] += n
        return tree

    tree = table(mixing.splitting_tree([100, 7, 0, 33], 6, 1), 6, 4)
    assert tree.sum(0).tolist() == [100, 7, 0, 33] and (tree >= 0).all()
    assert max(tree.sum(1)) - min(tree.sum(1)) <= 2
    totals = np.array([50, 0, 1, 9, 40, 40])
    assert table(mixing.splitting_tree([100, 7, 0, 33], 6, 1, totals), 6, 4).sum(1).tolist() == totals.tolist()
    # Draws have the mean and variance of a multivariate hypergeometric one: 4 of 12 blocks for the first shard.
    first = np.array([table(mixing.splitting_tree([6, 4, 2], 3, seed), 3, 3)[0] for seed in range(3000)])
    assert np.allclose(first.mean(0), [2, 4 / 3, 2 / 3], atol=0.06)
    assert np.allclose(first.var(0), [4 * p * (1 - p) * 8 / 11 for p in (1 / 2, 1 / 3, 1 / 6)], atol=0.06)
    assert mixing.targets([10, 10], [5, 1]) == pytest.approx([50 / 3, 10 / 3])
    assert mixing.targets([1, 100], [5, 1]) == pytest.approx([3, 98])
    assert mixing.targets([], []) == [] and mixing.targets([0, 5], [5, 2]) == pytest.approx([0, 5])


def test_mixing_with_repeated_and_null_ids(spark):
    # Equal rows get equal copies, rows of one id and unlike texts their own; reruns agree in any order of the input.
    r = random.Random(4)
    rows = [(i % 40 if i % 9 else None, " ".join(["w"] * r.choice([1, 2, 30])), "a" if i % 3 else "b", i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    runs = [sorted(map(str, mixing.mix(x, block_docs=8).collect())) for x in (df, df.repartition(7), df.orderBy(F.desc("n")))]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 400
    copies = {}
    for x in mixing.mix(df, block_docs=8).collect():
        copies.setdefault((x["doc_id"], x["source"], x["size"]), set()).add(str(x["copies"]))
    assert all(len(v) == 1 for v in copies.values())
    taken = sum(len(x["copies"]) for x in mixing.mix(df, block_docs=8).collect())
    assert mixing.mixed(df, block_docs=8).count() == taken
    hot = spark.range(60_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("two words").alias("text"), F.lit("s").alias("source"))
    assert mixing.mix(hot).select("doc_id", F.size("copies").alias("n")).groupBy("doc_id", "n").count().collect() == [(1, 1, 60_000)]


def test_mixing_passes_over_long_documents(spark):
    # A document far too long doesn't end the filling: the sources come within a word of their targets.
    rows = [(i, " ".join(["w"] * (5000 if i % 30 == 0 else 1)), "a" if i < 300 else "b") for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_docs=400).collect()
    for s in "ab":
        mine = [r for r in got if r["source"] == s]
        over = sum(r["size"] * len(r["copies"]) for r in mine) - mine[0]["target"]
        assert abs(over) <= 2500
    rows = [(i, " ".join(["w"] * (5000 if i % 300 == 0 else 9)), "a" if i < 300 else "b") for i in range(600)]
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_docs=400, cycle=(1.0, 1.3)).groupBy("source").agg(F.sum(F.col("size") * F.size("copies")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 2505


def test_mixing_of_many_sources(spark):
    # 200,000 sources: no total of one comes to the driver. The same as the short way, source by source.
    n = 200_000
    df = spark.range(n * 2).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.pmod(F.xxhash64("id"), F.lit(50)) + 1).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % n).alias("source"))
    got = mixing.mix(df.unionByName(spark.createDataFrame([(-1, "one two", None)], "doc_id long, text string, source string")))
    out = got.agg(F.count("*"), F.sum("size"), F.sum(F.col("size") * F.size("copies")), F.max(F.size("copies"))).first()
    per = got.groupBy("source").agg(F.first("target").alias("target"), F.first("source_size").alias("size"), F.sum(F.col("size") * F.size("copies")).alias("taken"))
    rows = sorted(per.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    want = mixing.targets([r["size"] for r in rows], [(5, 2, 1)[i % 3] for i in range(len(rows))])
    assert out[0] == 2 * n + 1 and len(rows) == n + 1
    assert np.allclose([r["target"] for r in rows], want) and sum(want) == pytest.approx(out[1])
    assert out[3] <= 3 and all(abs(r["taken"] - r["target"]) <= 50 for r in rows)


@pytest.mark.parametrize("few", [0, 100])
def test_mixing_is_the_same_either_way(docs, few):
    a, b = ({r["doc_id"]: tuple(r)[:5] for r in mixing.mix(docs, block_docs=4, few_sources=k).collect()} for k in (few, 10_000))
    assert {k: v[:4] for k, v in a.items()} == {k: v[:4] for k, v in b.items()} and [v[4] for v in a.values()] == pytest.approx([b[k][4] for k in a])


# Languages


def test_six_hundred_languages(spark):
    # Each language has words of its own; no number of languages is too many.
    r = random.Random(9)
    def words(k):
        q = random.Random(k)
        return ["".join(q.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(6)]

    data = [(i, " ".join(r.choice(words(i % 600)) for _ in range(40)), f"l{i % 600:03d}") for i in range(2400)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    found = langid.train(df, dict_bytes=512)
    assert len(found) == 600 and max(map(len, found.values())) <= 512
    some = langid.identify(df.filter("doc_id % 60 = 7"), found).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([x["lang_pred"] == x["lang"] for x in some]) > 0.9


def test_languages_with_odd_rows(spark):
    # Null and repeated ids, a text of a megabyte, ties between dictionaries, clashing names.
    de, en = "der schöne Hund und das Wasser nicht über die Brücke gegangen", "the other thing with water of the bridge and then nothing else"
    df = spark.createDataFrame([(None, de, "de", 1.0), (1, en, "en", 1.0), (1, en, "en", 1.0), (2, (en + " ") * 20_000, "en", 1.0)], "doc_id long, text string, lang string, score double")
    found = langid.train(df)
    got = sorted(((x["doc_id"], x["lang_pred"]) for x in langid.identify(df, found).collect()), key=str)
    assert got == [(1, "en"), (1, "en"), (2, "en"), (None, "de")]
    same = {"x": found["en"], "b": found["en"]}
    assert {x["lang_pred"] for x in langid.identify(df, same).collect()} == {"b"}




def test_languages(spark, empty):
    r = random.Random(5)
    bags = {"en": "the of and with thing other water".split(), "de": "der die und nicht wasser schön über".split(), "es": "el la que niño agua corazón".split()}
    data = [(i, " ".join(r.choice(bags[k]) for _ in range(r.randrange(8, 80))), k) for i, k in enumerate(r.choice(list(bags)) for _ in range(300))]
    data += [(900, None, "en"), (901, "", "en"), (902, "12 ! ?", None), (903, "the water and the thing of other", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    dicts = langid.train(langid.learners(docs))
    assert list(dicts) == ["de", "en", "es"] and all(len(v) <= 32_768 for v in dicts.values())
    got = {x["doc_id"]: x for x in langid.identify(docs, dicts).collect()}
    held = [d for d in data[:300] if zlib.crc32(str(d[0]).encode()) % 5 == 0]
    assert np.mean([got[i]["lang_pred"] == k for i, _, k in held]) > 0.95
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"]
    assert all(0 <= x["score"] <= 1 for x in got.values()) and got[900]["rejected"]
    assert langid.train(empty) == {} and langid.identify(empty, {}).count() == 0
    assert {x["lang_pred"] for x in langid.identify(docs, {}).collect()} == {"und"}


# The queries


def test_contract_columns(spark, sf):
    want = {
        "op1_toxicity": "doc_id held_out score predicted", "op2_media_columns": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
        "op3_substring_dedup": "doc_id n_words n_removed kept_sha256", "op4_exact_dedup": "doc_id keep_id group_size kept text_sha256",
        "op5_near_dedup": "doc_id n_shingles component_id kept", "op6_token_files": "doc_id start n_tokens ids_crc32", "op7_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op8_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256", "op9_mixing": "doc_id size source_size target taken", "op10_language_id": "doc_id held_out lang_pred score",
        "op11_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op12_merkle": "doc_id leaf subroot root proof_sha256 folded_root verified",
        "op13_whitening": "vec_id component n deviation whitened explained identity_error",
    }
    keys = {"op11_packing": (200, "doc_id"), "op13_whitening": (500, "vec_id")}
    assert set(queries.queries()) == set(want)
    for name, cols in want.items():
        df = queries.queries()[name](spark, sf)
        assert df.columns[: len(cols.split())] == cols.split(), name
        n, key = keys.get(name, (200, "doc_id"))
        assert df.select(key).distinct().count() == n and (name in keys or df.count() == n), name


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = queries.queries()[name](spark, sf)
    rel = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in rel.description]
    want = sorted(tuple(r[names.index(c)] for c in df.columns) for r in rel.fetchall())
    assert sorted(map(tuple, df.collect())) == want


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now, cols = docs, docs.columns
    for name, stage in p.STAGES[:-1]:
        before, now = now, stage(spark, now, sf).cache()
        assert now.columns == cols
        old, new = [{r["doc_id"]: r["text"] for r in d.collect()} for d in (before, now)]
        assert new.items() <= old.items()
        if name == "exact dedup":
            assert sorted(new.values()) == sorted(set(old.values()))
        if name == "near dedup":
            assert set(new) == {i for i, v in brute_components(list(old.items()), 5).items() if v[2]}
        if name == "mixing":
            assert max(r["count"] for r in now.groupBy("doc_id").count().collect()) <= 3
    out = p.STAGES[-1][1](spark, now, sf)
    assert out.count() == now.count() and out.filter("n_tokens <> size(ids)").count() == 0
    again = {tuple(r) for r in p.run(spark, sf).select("doc_id", "n_tokens").distinct().collect()}
    assert again == {tuple(r) for r in out.select("doc_id", "n_tokens").distinct().collect()}


def test_frequent_words_counts_all(spark):
    # "b" is second in every task but the commonest of all; units beyond a task's commonest count too.
    texts = [f"a{i} a{i} a{i} b b".replace("0", "x").replace("1", "y").replace("2", "z") for i in range(3)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want = bpe.Counter(w for t in texts for u in bpe.units(t) for w in bpe._WORDS.findall(u))
    got = bpe.frequent_words(df, words=100, local=1)
    assert got == [w for w, _ in sorted(want.items(), key=lambda x: (-x[1], x[0]))]
