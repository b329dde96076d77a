"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (toxicity.id_crc() % 4 == 2).alias("held_out"), "score", "predicted", "expected", "spans")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.media import media_features

    return media_features(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.substring_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), n=2)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_files import token_files

    return token_files(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import bpe

    docs = table(spark, sf_dir, "documents")
    out = bpe.encode(docs, bpe.build_lexicon(docs))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.suffix_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).alias("taken"), F.transform("copies", lambda c: c["shard"]).alias("shards")
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import langid

    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), langid.train(langid.learners(docs)))
    return out.select("doc_id", (langid.id_crc() % 5 == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack

    out = pack(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import merkle

    docs, columns = table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars"]
    text = F.col("text")
    tampered = F.when(merkle.id_crc() % 2 == 0, F.replace(text, F.lit("\n"))).otherwise(text)
    changed = merkle.leaf_digest(*map(F.col, columns), tampered)
    out = merkle.manifest(docs, merkle.leaf_digest(*map(F.col, columns), text), keep={"changed": changed})
    out = out.withColumn("folded_root", merkle.fold(F.col("changed"), F.col("proof")))
    digest = merkle.proof_digest(F.col("proof")).alias("proof_sha256")
    return out.select("doc_id", "leaf", "subroot", "root", digest, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import whitening

    return whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings")))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


ORACLE_SQL = {
    "op3_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        starts AS (SELECT doc_id, words, unnest(generate_series(1, len(words) - 12)) AS s FROM w WHERE len(words) >= 13),
        keyed AS (SELECT doc_id, s, array_to_string(words[s:s + 12], ' ') AS k FROM starts),
        late AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY k) AS f FROM keyed) WHERE f < doc_id),
        gone AS (SELECT DISTINCT doc_id, s + i AS p FROM late, generate_series(0, 12) AS g(i)),
        marks AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
        SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
               sha256(CASE WHEN ps IS NULL THEN array_to_string(words, ' ')
                           ELSE coalesce(array_to_string(list_select(words, list_filter(generate_series(1, len(words)), lambda i: NOT list_contains(ps, i))), ' '), '') END) AS kept_sha256
        FROM w LEFT JOIN marks USING (doc_id)""",
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op12_merkle": r"""
        WITH RECURSIVE
        crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], list_transform(range(8), lambda x: 0::BIGINT)),
                                            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS ct),
        marked AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: ascii(x)::BIGINT)),
                                 lambda c, b: xor(c >> 8, ct[(xor(c, b) & 255) + 1]))) % 2 = 0 AS tamper FROM documents, crc_table),
        heads AS (SELECT doc_id, source, text, tamper, coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-')
                         || coalesce(strlen(source)::VARCHAR || ':' || source, '-') || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-')
                         || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head FROM marked),
        leaves AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
                          sha256(head || coalesce(strlen(t)::VARCHAR || ':' || t, '-')) AS changed
                   FROM (SELECT *, CASE WHEN tamper THEN replace(text, chr(10), '') ELSE text END AS t FROM heads)),
        placed AS (SELECT *, row_number() OVER same AS row_no, row_number() OVER same - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
                   FROM leaves WINDOW same AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)),
        low(source, lev, pos, h, n) AS (
            SELECT source, 0, pos, leaf, n FROM placed
            UNION ALL
            SELECT source, lev + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY source, lev, pos // 3, n),
        tops AS (SELECT source, h, lev, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
        high(lev, pos, h, n) AS (
            SELECT 0, pos, h, n FROM tops
            UNION ALL
            SELECT lev + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM high WHERE n > 1 GROUP BY lev, pos // 3, n),
        walk(source, pos0, lev, pos, n) AS (
            SELECT source, pos, 0, pos, n FROM placed
            UNION ALL
            SELECT source, pos0, lev + 1, pos // 3, (n + 2) // 3 FROM walk WHERE n > 1),
        climb(source, pos0, step, up, pos, n) AS (
            SELECT w.source, pos0, above, 0, t.pos, t.n FROM (SELECT source, pos0, max(lev) + 1 AS above FROM walk GROUP BY source, pos0) w
            JOIN tops t ON w.source IS NOT DISTINCT FROM t.source
            UNION ALL
            SELECT source, pos0, step + 1, up + 1, pos // 3, (n + 2) // 3 FROM climb WHERE n > 1),
        sides AS (
            SELECT w.source, w.pos0, w.lev AS step, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < w.pos), '') AS l,
                   coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > w.pos), '') AS r
            FROM walk w JOIN low s ON w.source IS NOT DISTINCT FROM s.source AND s.lev = w.lev AND s.pos // 3 = w.pos // 3
            WHERE w.n > 1 GROUP BY ALL
            UNION ALL
            SELECT w.source, w.pos0, w.step, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < w.pos), ''),
                   coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > w.pos), '')
            FROM climb w JOIN high s ON s.lev = w.up AND s.pos // 3 = w.pos // 3
            WHERE w.n > 1 GROUP BY ALL),
        steps AS (SELECT source, pos0, l, r, row_number() OVER (PARTITION BY source, pos0 ORDER BY step) AS k FROM sides),
        folded(source, pos0, k, h) AS (
            SELECT source, pos, 0, changed FROM placed
            UNION ALL
            SELECT f.source, f.pos0, f.k + 1, sha256(s.l || f.h || s.r) FROM folded f JOIN steps s ON f.source IS NOT DISTINCT FROM s.source AND f.pos0 = s.pos0 AND s.k = f.k + 1),
        last AS (SELECT source, pos0, arg_max(h, k) AS folded_root FROM folded GROUP BY source, pos0),
        proofs AS (SELECT source, pos0, string_agg(l || r, '' ORDER BY k) AS proof FROM steps GROUP BY source, pos0)
        SELECT p.doc_id, p.leaf, t.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root, sha256(coalesce(q.proof, '')) AS proof_sha256,
               a.folded_root, a.folded_root = (SELECT h FROM high WHERE n = 1) AS verified
        FROM placed p JOIN tops t ON p.source IS NOT DISTINCT FROM t.source
        JOIN last a ON p.source IS NOT DISTINCT FROM a.source AND p.pos = a.pos0
        LEFT JOIN proofs q ON p.source IS NOT DISTINCT FROM q.source AND p.pos = q.pos0""",
}
