"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

In every stage: any column may be null; columns besides doc_id, text, lang, source and n_chars may have any names, the operators' own
ones included, and are kept as they are; an empty table gives an empty result with the same columns. Rows that are equal stay
separate rows unless the stage says otherwise.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volumetra.llm import langid, linededup, mixing, nearcopies, packing
from volumetra.llm.common import cut, fresh, narrowed, prepare

LEAST_SHARE = 0.5  # of a document's words in its language
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def shielded(docs: DataFrame) -> tuple[DataFrame, list]:
    """docs with its further columns under numbers for names, and the columns that bring the names back."""
    names = [c if c in KNOWN else f"#{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(f"`{a}`").alias(b) for a, b in zip(names, docs.columns, strict=True)]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language of their own go: null or empty text, no letters, or no label with half of the words. If no row has
    a label to learn from, all go. Equal texts are judged alike."""
    model = langid.train(langid.sample(docs, langid.held_out()))
    slim, back = shielded(docs)
    return langid.identify(slim, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(back)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are cut out; documents of which nothing is left go. Null text stays null. Copies come in
    the order of doc_id, a null one first, then of the text's hash; rows with one doc_id and text are cut alike."""
    slim, back = shielded(docs)
    out = linededup.dedup(slim).where((F.col("n_removed") < F.col("n_lines")) | (F.col("n_lines") == 0))
    out = out.withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(back)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates stays: texts joined over a Jaccard similarity of
    0.8 or more of their sets of five-word shingles. SimHash prints of those sets within 2 bits are linked by the operator's deletion variants, each link is
    checked by its exact similarity, and links between prints that differ more are added by an exact join. Of rows with one doc_id one stays per group, ties going to the smallest hash of the
    text; a null doc_id comes last. Null and empty texts are equal texts without words, one group."""
    row, hash_ = fresh(docs, "row"), fresh(docs, "hash")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    total, ids = docs.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    if whole and total == ids:  # doc_id numbers the rows, so whole documents need not be written
        tagged = docs.withColumn(row, F.col("doc_id").cast("long"))
        groups = nearcopies.groups(tagged.select(F.col(row).alias("row"), "text"))
        gone = cut(groups.where(F.col("row") != F.col("component")).select(F.col("row").alias(row)))
        return narrowed(tagged, gone, row, "left_anti").select(columns)
    tagged = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = nearcopies.groups(tagged.select(F.col(row).alias("row"), "text")).withColumnRenamed("row", row)
    ids = tagged.select(row, "doc_id", F.xxhash64("text").alias(hash_)).join(groups, row)
    kept = ids.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", hash_, row)).alias("least")).select(F.col(f"least.{row}"))
    return tagged.join(kept, row, "left_semi").select(columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents enter as often as the mixture takes them: not at all, once or twice. A null source is a source of its own; null or empty
    text has size 0. Rows that repeat doc_id and text are taken or left together."""
    slim, back = shielded(docs)
    mixed = mixing.mix(slim).where("_copies > 0")
    return mixed.withColumn("#again", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(back)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, with the sequence and offset of each. Null text is empty: its end token alone."""
    slim, _ = shielded(docs)
    return packing.pack(packing.pieces(slim, with_ids=False)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Classification, fingerprints and tokens have no SQL form; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. Results between stages are tables in the shared checkpoint folder, each removed when the next is written; the
    last one stays for the caller."""
    prepare(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get() + f"/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            at = spark._jvm.org.apache.hadoop.fs.Path(before)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        before = path
    return docs
