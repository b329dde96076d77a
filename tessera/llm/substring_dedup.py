"""Substring dedup by words: seeds are winnowed anchors, extended both ways to maximal repeats."""

from __future__ import annotations


import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.sequences import Shape, WordSymbols, covered, mask_of, sample, sift, split_hot
from tessera.llm.store import drop_table, stage_table


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 13, seed: int = 5, hot_seeds: int = 50_000) -> DataFrame:
    """Per row of *docs*: id, n_words, n_removed, kept (the words that stay, joined by one blank).

    Words are runs of anything but blank, tab, newline, VT, FF and CR, unchanged. A word goes if a window
    of *words* consecutive words covers it whose words also start in a document of smaller id; the input
    decides, not what is left. Seeds, runs of *seed* words, meet on their anchor and are extended: to the whole
    context that their windows cover, where with a smaller document of equal context all of it repeats; else by
    half a window to either side, where a side on which nothing agrees can't be crossed by a repeat; and the
    seeds then left, window by window. Pairs of documents are never listed: every repeat is found against the
    smallest document that has it. An anchor with more than *hot_seeds* entries is split over many tasks.

    A null or empty text has no words. A null id is smaller than none and compared with none. Rows that
    repeat an id must repeat its text; they are treated alike. An empty table gives no rows.
    """
    shape = Shape(words, seed)
    rows = stage_table(sample(docs, id_col, text_col, shape, WordSymbols, False), "seeds")
    found = stage_table(sift(split_hot(rows, hot_seeds), shape, False), "repeats")
    drop_table(rows)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            n, gone, kept = [], [], []
            for t, s, e in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                w = (t or "").encode("utf-8", "replace").split()
                mask = mask_of(len(w), s, e)
                n.append(len(w))
                gone.append(int(mask.sum()))
                kept.append(b" ".join(x for x, m in zip(w, mask.tolist(), strict=True) if not m).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return covered(docs, found, id_col, text_col, shape, WordSymbols, False).mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")
