"""Stage tables in the folder all executors share, and the word rules."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.stage import drop_table, freed_shuffles, new_path, shared_dir, stage_table  # noqa: F401

#: Words of the contracts: runs of anything but blank, tab, newline, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """*names*, with underscores added until no column of *df* is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batch, column: int, rows: int, most: int):
    """Parts of a record batch: at most *rows* rows whose *column* has about *most* bytes, one row at least."""
    size = np.fromiter((len(x or "") for x in batch.column(column).to_pylist()), np.int64, batch.num_rows)
    lo = 0
    while lo < len(size):
        n = int(np.searchsorted(np.cumsum(size[lo : lo + rows]), most, side="right"))
        yield batch.slice(lo, max(1, n))
        lo += max(1, n)


def id_crc(col: str = "doc_id"):
    """crc32 of the id written as decimal text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def known_texts(docs: DataFrame, ids: DataFrame, id_col: str, most: int = 500_000) -> DataFrame:
    """Rows of *docs* whose id is in *ids* (distinct, a stage table). The ids are broadcast when a count has
    shown that there are at most *most* (8 bytes each); beyond that both sides are shuffled."""
    return docs.join(F.broadcast(ids) if ids.count() <= most else shuffled(ids), id_col, "left_semi")


def shuffled(df: DataFrame) -> DataFrame:
    """*df*, which the join that it is a side of doesn't broadcast, nor its other side. Spark sizes tables by their files, a
    row of an explode as one of its input and an array as one entry: tables that grow with the input pass its limit unseen."""
    return df.hint("merge")


def frugal(run):
    """*run* of a mapInArrow whose worker gives freed memory back to the system at its end. Workers outlive their tasks,
    and what one stage held for its words would else stay beside what the next one holds."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped
