"""A corpus pipeline of five stages, each over all documents that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonearm.llm import jaccard, langid, mixing, packing, quality
from tonearm.llm.common import materialize
from tonearm.llm.queries import quality_labels, table, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: How far from a guess (1 of all languages) to certainty a language's score lies at least for a document to stay.
LEAST_SURE = 0.2
#: Words whose ids a Python process keeps while packing: few, since idle processes of all stages stay beside each other for a while.
KEPT_WORDS = 50_000
#: Stands for a null id where near duplicates are looked for: after all others.
NO_ID = (1 << 63) - 1


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay whose probability of quality 1 is a half or more. The model learns from the
    labelled documents of this stage's input; a table without labels of both kinds keeps all where label 1 prevails."""
    model = quality.train_classifier(docs.select("doc_id", "text"), quality_labels(spark, sf_dir), F.lit(True))
    scored = quality.score_documents(docs.select(*COLUMNS), model, score="quality_score")
    return scored.where("quality_score >= 0.5").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter (null texts too) or whose language is not recognised: with four languages, at a score under 0.4."""
    model = langid.train_languages(docs.select("doc_id", "text", "lang"), F.lit(True))
    found = langid.identify(docs.select(*COLUMNS), model)
    if model is None:
        return found.select(*COLUMNS)
    guess = 1 / len(model.languages)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("lang_score") >= guess + LEAST_SURE * (1 - guess))).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row stays: of the smallest id and, where an id has several texts, the smallest key.

    Rows with a null id come last in their class; those without a text too are no copy of any and stay.
    """
    bare = F.col("doc_id").isNull() & F.col("text").isNull()
    named = docs.where(~bare).select(*COLUMNS).withColumn("at", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    classes = jaccard.keyed_classes(named.select("at", "text"), id_col="at")
    first = classes.groupBy("class_key").agg(F.min(F.struct("doc_id", "key")).alias("f")).select(F.col("f.doc_id").alias("at"), "f.key")
    kept = named.withColumn("key", jaccard.text_key(F.col("at"), F.col("text"))).join(first, ["at", "key"])
    kept = kept.groupBy("at", "key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")  # of copies under one id the smallest row, in any layout
    return kept.select(*COLUMNS).unionByName(docs.where(bare).select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay as often as the mix takes them: not at all, once, or as repeated rows.

    Rows that repeat an id, a source and a text are taken equally often, but for those of one text a source at most, among which
    its words reach their target; only these are told apart by their place among each other. Null and empty texts are never
    such a text, since they have no words. An empty table gives no rows.
    """
    key = ("doc_id", "source", "size", "text_key")
    mixed = mixing.mix(docs.select("doc_id", "text", "source"))
    per = mixed.groupBy(*key).agg(F.min("copies").alias("least"), F.max("copies").alias("most"), F.count("*").alias("n"), F.sum("copies").alias("all"))
    # copies of a text are two neighbouring numbers at most, so their sum tells how many rows have the larger one
    per = per.where("most > 0").select(*[F.col(k).alias(f"m_{k}") for k in key], "least", (F.col("all") - F.col("n") * F.col("least")).alias("more"))
    rows = docs.select(*COLUMNS, mixing.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_key"))
    met = [F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in key]
    rows = rows.join(per, met)
    even = rows.where("more = 0").withColumn("copies", F.col("least"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("lang", "n_chars"))
    split = rows.where("more > 0").withColumn("copies", F.col("least") + (place <= F.col("more")).cast("int"))
    taken = even.unionByName(split).where("copies > 0")
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path(), keep_ids=False, kept_words=KEPT_WORDS)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Only mixing could be written in SQL; the tests hold each stage against a plain version or its operator's own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
