"""The queries of the operators, as registered for the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bin_completion,
    feature_weights,
    hd_language,
    kn_toxicity,
    patience_lines,
    routed_search,
    shard_shuffle,
    subword_quality,
    suffix_contamination,
    suffix_tree_lm,
    tile_join,
    token_alignment,
    url_trees,
)
from .frames import fold, table

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [
    url_trees.Rule("allow", "org", "/"),
    url_trees.Rule("block", "example.org", "/es/"),
    url_trees.Rule("block", "example.org", "/en/1"),
    url_trees.Rule("allow", "com", "/fr/"),
    url_trees.Rule("block", "com", "/de/"),
]
SHARDS = 16


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    left = fold("doc_id", 5)
    model = kn_toxicity.train(docs, labels, "doc_id", "text", "toxic", left != 0, left == 1)
    scored = kn_toxicity.score(docs, ["doc_id"], "text", model)
    return scored.select("doc_id", (left == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_trees.judge(table(spark, sf_dir, "pages"), ["page_id"], "url", URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    left = fold("doc_id", 4)
    found = hd_language.train_and_identify(docs, ["doc_id"], "text", "lang", left != 2)
    return found.select("doc_id", (left == 2).alias("held_out"), "lang_pred", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    left = fold("doc_id", 5)
    model = subword_quality.train(docs, labels, "doc_id", "text", "quality", left != 0)
    scored = subword_quality.score(docs, ["doc_id"], "text", model)
    return scored.select("doc_id", (left == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    dealt = shard_shuffle.shards(docs, SHARDS, size)
    text = F.col("record.text")
    return dealt.select(
        F.col("record.doc_id").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_url_filters": op2_url_filters,
    "op3_language_id": op3_language_id,
    "op5_quality": op5_quality,
    "op8_sharding": op8_sharding,
}


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = suffix_contamination.scan(docs, ["doc_id"], "text", benchmark, "item_id", "text")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        suffix_contamination.contaminated().alias("contaminated"),
    )


QUERIES["op7_decontamination"] = op7_decontamination


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    packed = bin_completion.pack_documents(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES["op10_packing"] = op10_packing


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = patience_lines.deduplicate(docs, "doc_id", "text")
    runs = F.coalesce(F.col("_llm_runs"), F.array().cast("array<int>"))
    ends = F.filter(runs, lambda _, i: i % 2 == 1)
    starts = F.filter(runs, lambda _, i: i % 2 == 0)
    removed = F.aggregate(F.zip_with(starts, ends, lambda a, b: b - a + 1), F.lit(0), lambda s, x: s + x)
    return cleaned.select("doc_id", "text", F.size(starts).alias("n_blocks"), removed.alias("n_removed"))


QUERIES["op4_line_dedup"] = op4_line_dedup


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tile_join.join(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("row", "doc_id")


QUERIES["op6_jaccard_join"] = op6_jaccard_join


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed_search.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20)


QUERIES["op9_nearest"] = op9_nearest


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    aligned = token_alignment.align_corpus(table(spark, sf_dir, "documents"), ["doc_id"], "text", *paths)
    return aligned.withColumnRenamed("groups", "groups_sha256")


QUERIES["op11_alignment"] = op11_alignment


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    drawn = feature_weights.resample(docs, "doc_id", "text", benchmark, "text", percent=5, least_words=20)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES["op12_resampling"] = op12_resampling


def op13_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 10) == 0
    model = suffix_tree_lm.train(docs.where(~held_out), "text")
    scored = suffix_tree_lm.score(docs, ["doc_id"], "text", model)
    tokens = F.lit(model.vocabulary.tokens).cast("long")
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", tokens.alias("train_tokens"), "base_score", "score")


QUERIES["op13_suffix_tree"] = op13_suffix_tree
