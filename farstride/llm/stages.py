"""Pipeline stages: each applies one operator's decisions to a table of documents and returns the documents' columns.

Rows with a null doc_id have no decision by id and stay; a stage over an empty table returns it empty.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decontaminate, jaccard, langid, mixing, sharding
from .common import Scratch, table, unused


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id isn't among the stored ids; few ids are broadcast, more are joined by a shuffle."""
    few = ids.count() <= jaccard.BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti").select(*docs.columns)


def stored(ids: DataFrame, own: Scratch) -> DataFrame:
    """ids saved once; what the operator kept to find them goes."""
    saved = Scratch(ids.sparkSession).save(ids.select("doc_id").distinct(), "ids")
    own.clear()
    return saved


def language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language, however many share the text; those without (no text, no letter) go."""
    model = langid.train(docs)
    if not model[0]:  # nothing to learn from: only texts without a letter are rejected
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = unused(docs, "found")
    told = docs.withColumn(found, langid.predictor(spark, model)(F.col("text")))
    return told.filter(F.col(f"{found}.lang_pred") != "und").select(*docs.columns)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group that links connect, once: of rows that share that doc_id, the one whose text's SHA-256 is smallest (of equal texts, the one whose columns' hash is)."""
    scratch = Scratch(spark)
    groups = jaccard.jaccard_components(docs, scratch=scratch)
    kept = without(docs, stored(groups.filter(F.col("doc_id") != F.col("component_id")), scratch))
    again = kept.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id")
    again = Scratch(spark).save(again, "again")
    if again.isEmpty():
        return kept
    order = F.struct(F.sha2(F.coalesce("text", F.lit("")), 256), F.xxhash64(*docs.columns))
    one = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("row"))
    return without(kept, again).unionByName(one.select("row.*"))


def decontaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    scratch = Scratch(spark)
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), scratch=scratch)
    return without(docs, stored(found, scratch))


def mixed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says."""
    whole = docs.select("doc_id", "text", F.struct(*(F.col(c) for c in docs.columns)).alias("whole"))
    rated = mixing.mix_documents(whole, table(spark, sf_dir, "labels"), columns=["doc_id", "whole"])
    return rated.select("whole", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("whole.*")


def sharded(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot; columns of their own named like the results (size, text_crc32, law, shard, slot, grown_shard) are replaced."""
    return sharding.shard(docs)
