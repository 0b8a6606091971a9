"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept.

1. language ID drops texts without a recognised language;
2. near-duplicates keep one document of each group;
3. personal data in the texts is replaced by its kind in brackets;
4. the sources are mixed to target weights: documents are dropped or repeated;
5. every text of the mix is encoded into sampled segmentations.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm import common, dedup, langid, mixing, pii, segment

#: Least posterior of the predicted language.
LEAST_SCORE = 0.5
#: Whole texts that a Python worker of language ID and of segmentation gets at once, a few megabytes in the worker and in the executor beside it. The stages are lazy, so the session keeps the setting.
LANGUAGE_ROWS, ENCODED_ROWS = 2000, 1000
#: Words of a shingle in the near-duplicate stage.
SHINGLE_WORDS = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs, common.id_remainder(F.col("doc_id"), 4) != 2)
    common.limit_batches(spark, LANGUAGE_ROWS)
    judged = langid.predict(docs, model, keep=docs.columns)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, at five words. Rows that repeat an id and its text are one; a null id is kept."""
    common.rest(spark)
    groups = common.checkpoint(dedup.near_duplicates(docs, words=SHINGLE_WORDS))
    # the ids that go or repeat are few, so Spark may find joins that spare the texts a shuffle
    gone = groups.where("doc <> component").select(F.col("doc").alias("_gone")).distinct()
    twice = groups.where("doc = component").groupBy(F.col("doc").alias("_twice")).agg(F.count("*").alias("n")).where("n > 1").select("_twice")
    kept = docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    once = kept.join(twice, F.col("doc_id") == F.col("_twice"), "left_anti")
    return once.unionByName(kept.join(twice, F.col("doc_id") == F.col("_twice"), "left_semi").dropDuplicates(["doc_id", "text"]))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.rest(spark)
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard by shard, each in its own shuffled order. A shard is dealt to as many tasks as the session's shuffles have for it."""
    common.rest(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // mixing.SHARDS)
    rows = mixing.mix(docs).repartition("mix_shard", F.col("mix_order") % parts)
    return rows.sortWithinPartitions("mix_shard", "mix_order", "mix_copy").select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.limit_batches(spark, ENCODED_ROWS)
    common.rest(spark)
    return segment.sample(docs, pieces="ids")


STAGES = [("language_id", language), ("near_dedup", near_duplicates), ("personal_data", personal_data), ("mixing", mixed), ("segmentation", encoded)]

#: Language ID, the estimated classifier and the sampler are no SQL; their operators are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
