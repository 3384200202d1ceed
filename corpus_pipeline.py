"""A corpus cleaning pipeline out of the operators in ``millrace.llm``.

Each stage takes (session, documents, data folder) and returns documents again, the last one
the mix.  Stages are written as Parquet in the shared folder and read again, so that a lost
executor never costs more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, jaccard, mixing, quality, suffix
from millrace.llm.queries import MIX_WEIGHTS
from millrace.session import release_staged, small_batches, stage_table, staged_paths, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a passage that is removed where it stands more than once.
PASSAGE_WORDS = 50


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of at least a half)."""
    small_batches(spark)
    model = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.score(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest id; of repeated rows one."""
    small_batches(spark)
    keepers = jaccard.join_similar(docs.select("doc_id", "text")).where("keeper").select(F.col("doc_id").alias("_doc"), F.col("tx").alias("_tx"))
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("_tx"))
    same = keyed["doc_id"].eqNullSafe(keepers["_doc"]) & (keyed["_tx"] == keepers["_tx"])
    return keyed.join(keepers, same, "left_semi").dropDuplicates(["doc_id", "_tx"]).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of 50 words that stand anywhere else too."""
    small_batches(spark)
    kept = suffix.remove_repeats(docs.select(*COLUMNS), length=PASSAGE_WORDS, by_words=True)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    small_batches(spark)
    found = decontaminate.find_contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where("not contaminated").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: for every document its source's target and the words that the mix takes of it."""
    mixed = mixing.mix(docs, MIX_WEIGHTS)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mix", mix_sources),
]

#: SQL can't express the classifier and the suffix sort; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = staged_paths()
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release_staged(keep=[docs.staged_at, *(p for p in before if "/pipeline-" not in p)])
    return STAGES[-1][1](spark, docs, sf_dir)
