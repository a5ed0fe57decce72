"""A training corpus from documents: language, exact and near copies, benchmark leaks, packing.

Every stage reads what its predecessor kept and, but for the last, returns the columns of documents, whatever others there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shorelark.llm.decontaminate import decontaminate
from shorelark.llm.exact_dedup import exact_dedup
from shorelark.llm.language_id import UNKNOWN, held_out, label, train
from shorelark.llm.packing import pack
from shorelark.llm.simhash import near_copies
from shorelark.session import cut_lineage, scratch_path

#: A document stays if at least this share of its letters is of one language.
LEAST_SCORE = 0.5

ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows that ``gone`` (doc_id, rid) doesn't name; of rows without an id or with a repeated one, rid tells which."""
    i, r = _free(docs, "gone_id"), _free(docs, "gone_rid")
    named = gone.select(F.col("doc_id").alias(i), F.col("rid").alias(r)).distinct()
    rid = F.xxhash64(docs["doc_id"], F.coalesce(docs["text"], F.lit("")))
    return docs.join(named, (rid == F.col(r)) & docs["doc_id"].eqNullSafe(F.col(i)), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts of which no language has half the letters."""
    found = label(docs, train(docs, ~held_out()))
    return _without(docs, found.filter((F.col("lang_pred") == UNKNOWN) | (F.col("score") < LEAST_SCORE)))


def _one_row_each(docs: DataFrame, gone: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows that ``gone`` (doc_id, rid) doesn't name, and of rows that ``repeated`` names one for each name."""
    if repeated.isEmpty():
        return _without(docs, gone)
    i, r, text = _free(docs, "one_id"), _free(docs, "one_rid"), _free(docs, "one_text")
    named = repeated.select(F.col("doc_id").alias(i), F.col("rid").alias(r)).distinct()
    keyed = docs.withColumn(text, F.coalesce(docs["text"], F.lit("")))
    same = (F.xxhash64("doc_id", text) == F.col(r)) & F.col("doc_id").eqNullSafe(F.col(i))
    one = keyed.join(named, same, "left_semi").dropDuplicates(["doc_id", text]).select(docs.columns)
    return _without(docs, gone.select("doc_id", "rid").unionAll(repeated.select("doc_id", "rid"))).unionByName(one)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, of the largest id; any one where several rows have that id, or none has an id."""
    copies = cut_lineage(exact_dedup(docs).filter("group_size > 1").select("doc_id", "rid", "kept"))
    repeated = cut_lineage(copies.filter("kept").groupBy("doc_id", "rid").count().filter("count > 1"))
    return _one_row_each(docs, copies.filter(~F.col("kept")), repeated)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, of the smallest id (none is larger than any), then the smallest rid.

    Two texts are near copies if their sets of five-word shingles are 0.8 alike or more. Pairs come from the anchors of their
    SimHash fingerprints first; alike sets whose fingerprints are further apart come from prefixes of the sets. Each pair is
    checked on the whole sets.
    """
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    rows = cut_lineage(near_copies(docs).select("group", place.alias("place")))
    first = rows.groupBy("group").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    several = cut_lineage(rows.join(first, "group"))
    gone = several.filter(F.col("place") > F.col("first")).select("place.doc_id", "place.rid")
    repeated = several.filter(F.col("place") == F.col("first")).groupBy("place.doc_id", "place.rid").count().filter("count > 1")
    return _one_row_each(docs, gone, cut_lineage(repeated))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return _without(docs, decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("n_hit > 0"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("benchmark_decontamination", benchmark_leaks),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
