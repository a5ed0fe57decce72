"""Exact duplicates by skew-safe combining.

Copies are merged three times, and each time the whole text is part of the key, so equal digests alone never merge
two documents: inside a map task (Spark's partial aggregation), inside a salted digest group, and over the salts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shorelark.llm.common import identified, looked_up
from shorelark.session import cut_lineage

SALTS = 16


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, rid. The largest id of equal texts stays.

    A null text is an empty text. A null id loses against any other; where all ids of a group are null, keep_id is
    null and all are kept. Rows that repeat an id and its text count each in group_size and get equal answers. Other
    columns are not read. An empty table gives an empty result. Texts of any length are compared whole. Digests that
    several texts share (possible only with a weak ``digest``) are answered by joining on the text itself.
    """
    keyed = identified(docs, id_col, text_col).withColumn("digest", digest(F.col("text")))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt")
    salted = keyed.groupBy("digest", "text", salt).agg(F.max("doc_id").alias("top"), F.count("*").alias("n"))
    whole = salted.groupBy("digest", "text").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))
    groups = cut_lineage(
        whole.groupBy("digest").agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
        .filter("texts > 1 or group_size > 1")
    )
    shared = groups.filter("texts > 1").select("digest")
    clash = not shared.isEmpty()
    plain = keyed.join(shared, "digest", "left_anti") if clash else keyed
    out = looked_up(plain.select("doc_id", "rid", "digest", F.sha2("text", 256).alias("text_sha256")),
                    groups.filter("texts = 1").drop("texts"), "digest", "doc_id", salts)
    out = out.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
    if clash:
        by_text = keyed.join(shared, "digest", "left_semi").join(whole, ["digest", "text"])
        out = out.unionByName(by_text.select("doc_id", "rid", "digest", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"))
    return out.select(
        "doc_id", "keep_id", F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "rid",
    )
