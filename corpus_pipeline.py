"""From documents to token ids, in five stages that each work on all that the one before kept.

Documents that the quality classifier rejects go; one document of each group
of near-duplicates stays; byte strings that repeat are cut out of the rest;
sources are mixed to their target weights, a document being left out, kept or
repeated; and what remains is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm import mixing, ngram_join, quality_gbt, sentencepiece_nbest, suffix_dedup
from canvass.llm.common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of its learning folds, does not reject."""
    return quality_gbt.keep_good(docs, quality_gbt.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group linked by a Jaccard of 0.8 on word 5-grams."""
    return ngram_join.keep_one(docs)


#: Bytes of a string that is cut out where it occurs more than once: about 50 words of four letters.
REPEATED = 240


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the strings of REPEATED bytes that occur more than once; n_chars follows."""
    cut = suffix_dedup.remove_repeats(docs, length=REPEATED, gram=REPEATED // 2, texts=True)
    kinds = {f.name: f.dataType for f in docs.schema}
    new = {"text": F.col("kept")}
    if "n_chars" in kinds:
        new["n_chars"] = F.length("kept").cast(kinds["n_chars"])
    return cut.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; of equal rows, as often as it takes all of them together."""
    scratch = Scratch(spark, "mixture")
    keyed = docs.select(F.struct(F.col("doc_id"), F.xxhash64(*docs.columns).alias("uid")).alias("key"), F.struct(*docs.columns).alias("row"))
    thin = keyed.select("key", "row.source", mixing.word_count(F.col("row.text")).alias("words"))
    mixed = mixing.mix(thin, F.col("words"), F.array("source"), key="key").filter("taken > 0")
    copies = mixed.groupBy(F.col("key.doc_id").alias("i"), F.col("key.uid").alias("u")).agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("copies"), F.count("*").alias("rows"))
    copies = scratch.cut(copies, "copies")
    taken = keyed.join(copies, keyed["key.doc_id"].eqNullSafe(copies["i"]) & (keyed["key.uid"] == copies["u"]))
    if not copies.filter("rows > 1").isEmpty():
        # equal rows stand for each other: one of them is repeated for all
        taken = taken.filter("rows = 1").union(taken.filter("rows > 1").dropDuplicates(["key"]))
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document, with the N best segmentations put together and decoded again."""
    return sentencepiece_nbest.digest(docs, sentencepiece_nbest.model_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mixture", mixture), ("encoding", encoding)]

#: Trees, components and segmentations are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; what each returns is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.cut(docs, name)
    return docs
