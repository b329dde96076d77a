import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import batches, bpe, packing, token_files

CHARS = ["a", "Bc", "é", "'s", "'", " ", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "1", "23", "!", "Σ", "İ", "漢", "<|endoftext|>", "<|", "́", "​", "­", "ž", "ǅ", "😀"]


def mixed(n: int, seed: int) -> list[str | None]:
    r = random.Random(seed)
    return [None, "", " ", "  ", " a", "a ", "a  b", "\n", *("".join(r.choice(CHARS) for _ in range(r.randrange(0, 14))) for _ in range(n))]


@pytest.fixture(scope="module")
def byte_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path(bpe.VOCABULARY))


def of(data, at, kind):
    return [data[a:b].view(kind).tolist() for a, b in zip(at, at[1:])]  # noqa: B905


def test_batches_of_texts_encode_as_whole_texts(byte_library):
    texts = mixed(20_000, 4)
    f = token_files.LibraryEncoder(bpe.VOCABULARY, 200)  # most units are found anew
    got = of(*f.batch(pa.array(texts).slice(1), b"\2\0\0\0"), "<u4")
    assert len(got) == len(texts) - 1
    for t, ids in zip(texts[1:], got, strict=True):
        assert ids == [*byte_library.encode(t, add_special_tokens=False).ids, 2], repr(t)
    assert of(*f.batch(pa.array([None, "a"], pa.string()), b"\2\0\0\0"), "<u4")[0] == [2]
    data, at = f.batch(pa.array([], pa.string()))
    assert len(data) == 0 and at.tolist() == [0]


def test_a_batch_looks_up_each_unit_once():
    asked = []

    def units(found):
        asked.extend(found)
        return [u.encode() for u in found]

    texts = pa.array(["x y y", None, "y z|", "q  y"])
    data, at = batches.by_units(texts, units, lambda t: b"<" + t.encode() + b">", ["|"], lambda h: h.upper().encode(), bpe.ODD, b".")
    assert [bytes(data[a:b]) for a, b in zip(at, at[1:])] == [b"Xyy.", b".", b"<y z|>.", b"<q  y>."]  # noqa: B905
    assert sorted(asked) == ["", "y", "z|"]


def test_words_of_units_are_kept(byte_library):
    # The same word with other marks, and after a line's end, doesn't go to the library again.
    f = token_files.LibraryEncoder(bpe.VOCABULARY, 100)
    f("so uniten uniten, uniten.\nUniten")
    words = f.words
    assert {" uniten", ",", ".", "\n", "Uniten"} <= set(words)
    n = len(words)
    assert np.frombuffer(f("so uniten. uniten\nUniten uniten"), "<u4").tolist() == byte_library.encode("so uniten. uniten\nUniten uniten", add_special_tokens=False).ids
    assert len(words) == n


def test_batches_of_packing_encode_as_whole_texts():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.vocabulary_path(packing.VOCABULARY))
    texts = mixed(20_000, 5)
    got = of(*packing.WordEncoder(packing.VOCABULARY, "<u2", 200).batch(pa.array(texts).slice(1), b"\2\0"), "<u2")
    for t, ids in zip(texts[1:], got, strict=True):
        assert ids == [*library.encode(t, add_special_tokens=False).ids, 2], repr(t)


def test_pieces_and_their_largest_ids():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 40, n) for n in (1, 1, 2, 3, 10, 11, 25, 1, 60, 7)]
    i, start = packing.cut(np.array([len(d) for d in docs]), 10)
    parts = [d[s : s + 10] for d in docs for s in range(0, len(d), 10)]
    assert [docs[k][s : s + 10].tolist() for k, s in zip(i, start, strict=True)] == [p.tolist() for p in parts]
    top, distinct = packing.largest(np.concatenate(docs), np.array([len(p) for p in parts]), i)
    assert np.array(top).T.tolist() == [[*sorted(set(p.tolist()), reverse=True)[:3], 0, 0][:3] for p in parts]
    assert sorted(distinct.tolist()) == sorted(x for d in docs for x in set(d.tolist()))


def test_batches_of_bpe_encode_and_decode_as_whole_texts(byte_library):
    texts = mixed(20_000, 6)
    e = bpe.Encoder(bpe.Merges(), None, 200)
    data, at = e.batch(pa.array(texts).slice(1))
    want = [byte_library.encode(t, add_special_tokens=False).ids for t in texts[1:]]
    assert of(data, at, "<i4") == want
    assert e.decode_all(data.view("<i4"), at // 4) == [byte_library.decode(ids, skip_special_tokens=False) for ids in want]
    data, at = e.batch(pa.array([None, ""], pa.string()))
    assert e.decode_all(data.view("<i4"), at // 4) == ["", ""]


def test_words_are_counted_by_batches(spark):
    texts = mixed(3000, 7)
    count = {}
    for t in texts:
        for u in bpe.units(t or ""):
            for w in bpe.WORDS(u):
                count[w] = count.get(w, 0) + 1
    got = bpe.frequent_words(spark.createDataFrame([(t,) for t in texts], "text string"), words=40, local=20)
    assert got == sorted(count, key=lambda w: (-count[w], w))[:40]
