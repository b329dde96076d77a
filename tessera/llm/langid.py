"""Language identification by compression with per-language zstandard dictionaries."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.store import id_crc, stage_table

_LETTER = re.compile(r"[^\W\d_]")
_REST = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower case letters; every run of anything else is one blank."""
    return _REST.sub(" ", text.lower())


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_each: int = 100, dict_bytes: int = 32_768) -> dict[str, bytes]:
    """A raw-content dictionary of at most *dict_bytes* for each language, from at most *docs_each* of its
    documents: those of up to 16 KB first, by a hash of the id (a bounded sample, whatever the order of the
    input); of each, what can find a place in the dictionary. Rows without text, letters or language teach nothing;
    rows that repeat id and text teach once.

    Dictionaries are put together in tasks. They alone come to the driver: *dict_bytes* for each language, however
    many there are."""
    keys = ["lang", "long", "h", "th"]
    some = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), (F.octet_length(text_col) > 16384).alias("long"), F.xxhash64(id_col).alias("h"), F.xxhash64(text_col).alias("th"), F.substring(text_col, 1, 4 * dict_bytes).alias("t")
    )
    # The first by hash alone are found, in 64 parts of a language and then in all; then their texts are fetched.
    part = some.select(*keys, F.pmod("h", F.lit(64)).alias("part"))
    for by in (["lang", "part"], ["lang"]):
        part = part.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("long", "h", "th"))).filter(F.col("n") <= docs_each)
    first = stage_table(part.select(*keys).distinct(), "learners")
    small = F.broadcast if first.count() <= 500_000 else lambda df: df  # 25 bytes each
    some = some.join(small(first), keys).dropDuplicates(keys)

    def run(table: pa.Table) -> pa.Table:
        texts = [r[-1] for r in sorted(zip(*(table[c].to_pylist() for c in ("long", "h", "th", "t")), strict=True))]
        content = b" ".join(plain(t).encode("utf-8", "replace") for t in texts)[:dict_bytes]
        return pa.table({"lang": pa.array([table["lang"][0].as_py()]), "content": pa.array([content], pa.binary())})

    found = some.groupBy("lang").applyInArrow(run, "lang string, content binary").collect()
    return {r["lang"]: bytes(r["content"]) for r in sorted(found, key=lambda r: r["lang"])}


class Classifier:
    """Sizes of a text under each dictionary; the smallest wins."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 5, chunk: int = 1024, most: float = 0.1):
        import zstandard as z

        self.names, self.chunk, self.most = list(dictionaries), chunk, most
        self.of = []
        for content in dictionaries.values():
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.of.append(z.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False).compress)

    def predict(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        if not text or not self.names or not _LETTER.search(text):
            return "und", 0.0, True
        data, n = plain(text).encode("utf-8", "replace"), self.chunk
        # Every part is coded on its own, so that a long text can't become its own dictionary, and its
        # gain counts up to a bound: a passage that happens to be in a dictionary doesn't outweigh the rest.
        gain = [0.0] * len(self.of)
        for i in range(0, len(data), n):
            part = data[i : i + n]
            sizes = [len(f(part)) for f in self.of]
            usual = sum(sizes) / len(sizes)
            for k, size in enumerate(sizes):
                gain[k] += len(part) * min(self.most, (usual - size) / usual)
        order = sorted(range(len(gain)), key=lambda i: (-gain[i], self.names[i]))
        gap = (gain[order[0]] - gain[order[1]]) / max(1, len(data)) if len(order) > 1 else self.most
        return self.names[order[0]], min(1.0, gap / self.most), gap < margin * self.most


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = 0.05) -> DataFrame:
    """Per row of *docs*: id, lang_pred, score, rejected.

    Each part of 1024 bytes is coded with every dictionary; the gains over the mean size, bounded, add up.
    The score is the best language's lead over the next (0 to 1). ``rejected`` marks leads below *margin*, where the caller should not trust lang_pred. A text that is
    null or has no letter is ``und`` (score 0, rejected). Equal sizes: the first language by name. Whole
    texts are read; rows that repeat are judged each, and other columns may have any name. An empty table gives no
    rows; without dictionaries every text is ``und``.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        c = Classifier(sent.value)
        for b in batches:
            got = [c.predict(t, margin) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double, rejected boolean")


def learners(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that labels may be learned from: crc32(id as text) mod 5 is not 0."""
    return docs.filter(id_crc(id_col) % 5 != 0)
