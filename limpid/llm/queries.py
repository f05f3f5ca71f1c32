"""Queries of the corpus operators over the tables of a folder."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.llm.ann import nearest
from limpid.llm.audit import audit_filters
from limpid.llm.decontaminate import contamination
from limpid.llm.jaccard import jaccard_components
from limpid.llm.langid import fold_of, identify, learn
from limpid.llm.licenses import license_names, scan_licenses
from limpid.llm.linededup import dedup_lines
from limpid.llm.ngramlm import score_texts
from limpid.llm.packing import pack
from limpid.llm.phrases import remove_repeats
from limpid.llm.runs import collapse_runs
from limpid.llm.secrets import BASE, scan_secrets, spans
from limpid.llm.topk import top_products

TOKENIZER = {"path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    base = F.filter("findings", lambda x: x["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(spans(base), 256).alias("base_sha256"),
        spans(F.col("findings")).alias("spans"),
        F.size(F.filter("findings", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("findings", lambda x: ~x["live"])).cast("long").alias("n_copied"),
        F.coalesce(F.array_max(F.transform("findings", lambda x: x["n_repos"])), F.lit(0)).alias("most_repos"),
        F.coalesce(F.array_max(F.transform("findings", lambda x: x["n_owners"])), F.lit(0)).alias("most_owners"),
    )


def op2_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), **TOKENIZER)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = learn(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text", (fold_of("doc_id", 5) == 0).alias("held_out")), samples).drop("text")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    places = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string")))
    return out.select("doc_id", "n_words", F.size("licenses").cast("long").alias("n_found"), license_names().alias("licenses"), F.array_join(places, ",").alias("spans"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    names = F.array_join("hit_items", ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


#: The filters of the audit: too short, too few different words, too many capitals, marks that prose doesn't hold.
AUDITED = {
    "A": lambda d: len(d.words) < 100,
    "B": lambda d: 100 * len(set(d.words)) < 80 * len(d.words),
    "C": lambda d: 100 * d.count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") > 10 * len(d),
    "D": lambda d: d.count(b"#$%&*|") > 0,
}


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"), AUDITED, "E")


def op12_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def planted_runs(docs: DataFrame) -> DataFrame:
    """docs, the texts of about a tenth of them turned periodic from some word on, by a checksum of their id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    words = docs.withColumn("w", F.when((h % 10 == 0) & (trimmed != ""), F.split(trimmed, "[ \\t-\\r]+")))
    n = F.size("w").cast("long")
    from_ = (g % n).cast("int")
    period = (1 + F.floor((n - from_) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice("w", from_ + 1, period), F.ceil((n - from_) / period).cast("int")))
    turned = F.array_join(F.concat(F.slice("w", F.lit(1), from_), F.slice(again, F.lit(1), (n - from_).cast("int"))), " ")
    return words.withColumn("text", F.when(F.col("w").isNotNull(), turned).otherwise(F.col("text"))).drop("w")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = collapse_runs(planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n")))
    found = out.select("doc_id", "runs", "kept", longest.alias("x")).withColumns({"start": -F.col("x.start"), "length": F.col("x.length"), "period": -F.col("x.period")})
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "start",
        "length",
        "period",
        F.floor(1000 * F.col("length") / F.col("period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_secrets, op2_repeated_phrases, op3_jaccard_join, op4_best_fit_packing, op5_nearest, op6_lm_scores, op7_language, op8_licenses, op9_decontamination, op10_line_dedup, op11_filter_audit, op12_top_products, op13_periodic_runs, pipeline)}
