"""The corpus operators as queries over the tables of a folder, with the parameters of production runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, conversations, fingerprints, jaccard, langid, mixing, oracles, packing, paths, quality, ranking, urls, warc, wavelet
from .common import crc_of

#: Rules of the URL filter's query.
URL_RULES = [urls.Rule("block", "net"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The file of the public byte-level tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.valid_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return ann.nearest(vectors, F.col("vec_id") % 50 == 0, 5)


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(crc_of(F.col("doc_id")), F.lit(3)) == 1
    model = quality.train_classifier(docs, quality_labels(spark, sf_dir), ~held_out)
    scored = quality.score_documents(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), keep_ids=False)


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_documents(wavelet.write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), 2))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(crc_of(F.col("doc_id")), F.lit(4)) == 2
    model = langid.train_languages(docs, ~held_out)
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    return conversations.prefix_trie(table(spark, sf_dir, "conversations")).select(*columns)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op13_chosen_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.near_duplicate_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_nearest, op2_quality, op3_near_duplicates, op4_packing, op5_urls, op6_token_shards, op7_mixing, op8_fingerprints, op9_language, op10_warc, op11_prefix_trie, op12_ranked_search, op13_chosen_paths]
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op11_prefix_trie": oracles.OP11, "op12_ranked_search": oracles.OP12}
