"""One query per operator, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import classifier
from holdfast.llm.chat import formatted, read_back
from holdfast.llm.decontaminate import contaminated
from holdfast.llm.licenses import license_scan
from holdfast.llm.lm import scores
from holdfast.llm.mixing import mixed_sizes
from holdfast.llm.near_dup import near_duplicates
from holdfast.llm.oracle import OP5, OP8, OP9, OP10, OP13
from holdfast.llm.quality import quality
from holdfast.llm.secrets import secrets, trained
from holdfast.llm.trie import continued, nodes, prefixes, turns
from holdfast.llm.urls import Rule, judged
from holdfast.llm.warc import archived
from holdfast.llm.whitening import whitened


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(column: str, by: int):
    """The unsigned CRC-32 of a number as text, modulo `by`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the licenses that its paragraphs state."""
    return license_scan(_table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its secrets: those of the patterns and those of the network."""
    docs = _table(spark, sf_dir, "documents")
    return secrets(docs, trained(docs))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its statistics and the verdict of base rules and learned list."""
    judged = quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select(F.col("row.doc_id").alias("doc_id"), *judged.drop("row").columns)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, as it is or with other slots, and the item."""
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


# The rules that the url query applies.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the rule or the reputation that decides its url."""
    pages, labels = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels")
    return judged(pages, labels, RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its log probability under a model of four fifths of them."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return scores(_table(spark, sf_dir, "documents"), held_out)


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of near duplicates that it belongs to."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words that the mix takes of it."""
    sizes = mixed_sizes(_table(spark, sf_dir, "documents"))
    return sizes.select("doc_id", "size", "source_size", "target", "taken")


# Fixed value: a text that holds marks of several chat templates.
TRICKY = "\\### Assistant: </turn> ok"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as its formatted windows say when they are read back."""
    said = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ours = F.array(
        *(
            F.struct(F.lit(n).cast("bigint").alias("turn"), F.lit(role).alias("role"))
            for n, role in enumerate(("user", "assistant"))
        )
    )
    one = spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), F.inline(ours))
    windowed = formatted(said.unionByName(one.withColumn("text", F.lit(TRICKY))))
    return read_back(windowed)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the index of the archive says that was written and read back."""
    return archived(_table(spark, sf_dir, "pages")).select(
        F.col("id").alias("page_id"),
        F.col("size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score, learned from the labels of two thirds of them."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.coalesce(_remainder("id", 3) == 1, F.lit(False))
    weights = classifier.trained(docs, labels, usable=~held_out)
    return classifier.scored(docs, weights).select(
        "doc_id",
        F.coalesce(_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on each of the first eight principal components, scaled to one."""
    found = whitened(_table(spark, sf_dir, "embeddings"))
    parts = found.select("*", F.posexplode("whitened").alias("place", "value"))
    return parts.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        "n",
        F.col("deviation").try_cast("bigint").alias("deviation"),
        F.col("value").alias("whitened"),
        F.col("explained")[F.col("place")].alias("explained"),
        "identity_error",
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of conversations that begin like the one at their hundred."""
    own = turns(_table(spark, sf_dir, "conversations"))
    base = F.col("conv") - F.col("conv") % 100
    return nodes(prefixes(continued(own, base, _remainder("conv", 6), most=6)))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_secrets": op2_secrets,
    "op3_quality": op3_quality,
    "op4_decontaminate": op4_decontaminate,
    "op5_url_filter": op5_url_filter,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_near_dup": op7_near_dup,
    "op8_mixing": op8_mixing,
    "op9_chat": op9_chat,
    "op10_warc": op10_warc,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_whitening": op12_whitening,
    "op13_prefix_trie": op13_prefix_trie,
}

LLM_ORACLE: dict[str, str] = {
    "op5_url_filter": OP5,
    "op8_mixing": OP8,
    "op9_chat": OP9,
    "op10_warc": OP10,
    "op13_prefix_trie": OP13,
}
