"""From raw documents to packed training sequences, stage by stage.

Every stage works on all that the one before it kept. All but the last return the columns of `documents`. There is no
ORACLE_SQL: SQL can't express the language model or the packing; tests hold each stage against a brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.llm.decontaminate import contamination
from limpid.llm.jaccard import jaccard_components
from limpid.llm.langid import UNKNOWN, identify, learn
from limpid.llm.linededup import dedup_lines
from limpid.llm.packing import pack
from limpid.llm.queries import TOKENIZER, table
from limpid.llm.spark import exact, free_name, id_key, scratch, shared_dir

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in which no language is found: null ones and those without a letter. Learns from `documents`."""
    samples = learn(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    if not samples:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    names = {c: free_name(docs, f"own_{c}") for c in ("lang_pred", "score") if c in docs.columns}
    out = identify(docs.withColumnsRenamed(names), samples).filter(F.col("lang_pred") != UNKNOWN).drop("lang_pred", "score")
    return out.withColumnsRenamed({v: k for k, v in names.items()}).select(*map(exact, docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes recurring lines out of texts. A text that loses all its lines stays, as an empty one."""
    out = dedup_lines(docs)
    text = F.when(F.col("text").isNotNull(), F.col("kept"))
    changed = {"text": text, "n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType)}
    return out.select(*[changed.get(c, exact(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group linked by five-word shingles at a similarity of 0.8
    or more. Of rows with the same id one stays, that whose text comes first; of rows without an id, one of each text."""
    groups = jaccard_components(docs.select("doc_id", "text"), width=5, percent=80)
    key, n = free_name(docs, "near_doc"), free_name(docs, "near_n")
    gone = groups.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(id_key("doc_id").alias(key)).distinct()
    kept = docs.withColumn(key, id_key("doc_id")).join(gone.hint("shuffle_hash"), key, "left_anti")
    if groups.groupBy("doc_id").count().filter("count > 1").head(1):
        # An aggregate, not a window: map tasks begin it, however many rows one id has.
        digest = F.sha2(F.coalesce("text", F.lit("")), 256)
        own = F.when(F.col("doc_id").isNull(), F.coalesce(F.sha2("text", 256), F.lit(""))).alias(n)
        first = F.min_by(F.struct(*[exact(c) for c in docs.columns]), F.struct(F.col("text").isNull(), digest))
        kept = kept.groupBy(key, own).agg(first.alias(n + "_")).select(F.col(n + "_")).select(f"`{n}_`.*")
    return kept.select(*map(exact, docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a whole shorter item."""
    out = contamination(docs, table(spark, sf_dir, "benchmark")).filter(F.col("n_hit") == 0)
    return out.select(*map(exact, docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return pack(docs.select("doc_id", "text"), **TOKENIZER)


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminated), ("best-fit packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what a stage keeps is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):  # what a stage's operator wrote is deleted when the stage's result is
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
