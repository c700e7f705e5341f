"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import brown, decontaminate, lines, mixing, neardup, packing, prefixes, quality, rules, secrets, tokens, toxicity, whitening
from quillspark.llm.labelled import remainder


def read(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """The whole table; one that is read by fewer tasks than there are cores is dealt over all of them if `spread`."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def op1_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    found = toxicity.passages(docs, model)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))


def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_token_counts(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    with open(model_path, "rb") as f:  # a file of the driver's installation, not of the tables
        vocabulary = tokens.prove(f.read())
    return tokens.count_tokens(read(spark, sf_dir, "documents"), vocabulary)


def op5_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op7_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_brown_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = brown.score_all(read(spark, sf_dir, "documents"), remainder("doc_id", 5) != 1)
    return scored.select("doc_id", (remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _is(kind: int):
    return lambda s: s["kind"] == kind


def op10_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    n = {k: F.size(F.filter("spans", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(secrets.KINDS)}
    return found.select("doc_id", n["assign"], n["access"], n["hex"], F.sha2(secrets.joined(F.col("spans"), 2), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(read(spark, sf_dir, "conversations"))


def op12_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_order_packing(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("byte_bpe_50k.json")
    with open(model_path, encoding="utf-8") as f:  # a file of the driver's installation, not of the tables
        pieces = packing.pack(read(spark, sf_dir, "documents", spread=False), f.read())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxic_segments,
        op2_compression_quality,
        op3_pareto_mixing,
        op4_token_counts,
        op5_divergence_rules,
        op6_dart_minhash,
        op7_line_windows,
        op8_latent_decontamination,
        op9_brown_model,
        op10_markov_secrets,
        op11_prefix_trie,
        op12_qdwh_whitening,
        op13_order_packing,
    )
}
ORACLES = {"op3_pareto_mixing": mixing.ORACLE_SQL, "op5_divergence_rules": rules.ORACLE_SQL, "op7_line_windows": lines.ORACLE_SQL, "op10_markov_secrets": secrets.ORACLE_SQL, "op11_prefix_trie": prefixes.ORACLE_SQL}
