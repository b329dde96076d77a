"""Packing by lexical retrieval: round trips of every id, windows, the order of neighbours, against plain loops."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import packing


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary_path(packing.VOCABULARY))


def texts():
    r = random.Random(6)
    topics = [[f"{c}{v}{d}" for c in "bdfgklmnprst" for v in "aeiou" for d in tail] for tail in ("nor", "lit", "sek", "wum")]
    out = [None, "", " \t\n ", "One", "naïve 漢字 é　Ω\x85it's WE'LL <|endoftext|>x <|ENDOFTEXT|> a\x1fb\x0bc\r\nd", "word" * 9000, " ".join(r.choice(topics[0]) for _ in range(20_000))]
    for i in range(300):
        out.append(" ".join(r.choice(topics[i % 4]) for _ in range(r.randrange(1, 400))))
        if i % 10 == 0:
            out += [out[-1]] * 4
    return out


def check(rows, library, data, window):
    """Every id of every document once, in sequences without gaps; lengths are the window or powers of two."""
    want = {}
    for i, t in data:
        want.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    docs, sequences = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        docs.setdefault(r["doc_id"], []).append((r["start"], ids, r["doc_tokens"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(docs) == set(want)
    for i, parts in docs.items():
        if len(want[i]) == 1:
            parts.sort()
            assert [s for s, _, _ in parts] == [sum(len(x) for _, x, _ in parts[:k]) for k in range(len(parts))]
            assert sum((x for _, x, _ in parts), []) == want[i][0] and {n for *_, n in parts} == {len(want[i][0])}
        else:
            assert Counter(x for _, ids, _ in parts for x in ids) == Counter(x for ids in want[i] for x in ids)
    for s in sequences.values():
        s.sort()
        n = sum(x for _, x in s)
        assert [o for o, _ in s] == [sum(x for _, x in s[:k]) for k in range(len(s))]
        assert n == window or n & (n - 1) == 0 and n < window
    return sequences


@pytest.mark.parametrize("how", [{}, {"shard_tokens": 3000, "window": 512}])
def test_pack(spark, library, how):
    data = [(i, t) for i, t in enumerate(texts())] + [(None, "of no id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(*d, "x") for d in data], "doc_id long, text string, ids string").repartition(3)
    out = packing.pack(df, **how)
    assert out.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    window = how.get("window", packing.WINDOW)
    sequences = check(out.collect(), library, data, window)
    full = [s for s in sequences.values() if sum(x for _, x in s) == window]
    assert len(sequences) - len(full) <= 12 * 4
    assert packing.pack(df.limit(0)).count() == 0


def test_short_and_single_tables(spark, library):
    for data in ([(1, None)], [(1, "a"), (2, "a"), (2, "a")]):
        check(packing.pack(spark.createDataFrame(data, "doc_id long, text string")).collect(), library, data, packing.WINDOW)


def test_units_encode_as_whole_texts(library):
    f = packing.word_encoder(packing.VOCABULARY, "<u2", most=50)
    r = random.Random(2)
    chars = ["a", "B", "é", "é", "'s", "'", " ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "　", "1", "23", "!", "Σ", "ς", "İ", "漢", "<|endoftext|>", "<|", "́", "퟿", "​", " "]
    latin = [chr(c) for c in range(33, 0x250)]
    for _ in range(20_000):
        t = "".join(r.choice(chars + latin) for _ in range(r.randrange(0, 14)))
        assert np.frombuffer(f(t), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_every_character_alone_and_within_a_word(library):
    f = packing.word_encoder(packing.VOCABULARY, "<u2")
    for c in map(chr, [*range(1, 0x600), *range(0x1E00, 0x2200)]):
        for t in (c, f"a{c}b", f"A1{c}'S"):
            assert np.frombuffer(f(t), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def bm25(ids, idf, mean, seed):
    out = []
    for x in ids:
        tf = Counter(x.tolist())
        out.append(math.fsum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t in set(ids[seed].tolist()) if t in tf))
    return np.array(out)


def test_windows_are_filled_by_score():
    # The same greedy rule with plain loops and scores of all pairs.
    rng = np.random.default_rng(3)
    ids = [rng.integers(40 * (i % 3), 40 * (i % 3) + 60, rng.integers(1, 70)).astype("<u2") for i in range(120)]
    idf, mean, window = rng.random(200) + 0.1, 33.0, 128
    full, rest = packing.fill(ids, idf, mean, window)
    left, begun, want = [len(x) for x in ids], [0] * len(ids), []
    while sum(left) >= window:
        seed = next(i for i, n in enumerate(left) if n)
        row, room = [(seed, begun[seed], left[seed])], window - left[seed]
        left[seed] = 0
        score = bm25(ids, idf, mean, seed)
        for i in sorted((i for i, n in enumerate(left) if n), key=lambda i: (-round(score[i], 9), i)):
            if not room:
                break
            n = min(room, left[i])
            row.append((i, begun[i], n))
            begun[i], left[i], room = begun[i] + n, left[i] - n, room - n
        want.append(row)
    assert full == want
    assert rest == [(i, begun[i], n) for i, n in enumerate(left) if n]


def test_neighbours_are_of_the_seed_s_kind():
    # Four vocabularies: nearly all windows hold documents of one.
    rng = np.random.default_rng(5)
    ids = [rng.integers(500 * (i % 4), 500 * (i % 4) + 500, 100).astype("<u2") for i in range(400)]
    full, _ = packing.fill(ids, np.ones(2000), 100.0, 1024)
    pure = [len({i % 4 for i, *_ in row}) == 1 for row in full]
    assert np.mean(pure) > 0.85


def test_rest_becomes_powers_of_two():
    rows = packing.powers([(0, 3, 700), (1, 0, 1), (2, 5, 300)])
    assert [sum(n for *_, n in r) for r in rows] == [512, 256, 128, 64, 32, 8, 1]
    assert [p for r in rows for p in r][:3] == [(0, 3, 512), (0, 515, 188), (1, 0, 1)]
    assert packing.powers([]) == []
