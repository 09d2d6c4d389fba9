"""The registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from stratal.llm import alignment, decontamination, itemsets, jaccard_join, main_text, packing, quality, repetition, sharding, token_output, toxicity, url_lists, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_repetition(spark, sf_dir):
    return repetition.repetition_rules(_read(spark, sf_dir, "documents")).drop("spans")


def op2_temporal_list_join(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return url_lists.judge(url_lists.captures_of(pages), url_lists.demonstration_entries(pages))


def op3_boosted_tree_extraction(spark, sf_dir):
    return main_text.main_text(_read(spark, sf_dir, "pages"))


def op4_extendible_hashing(spark, sf_dir):
    return sharding.extendible_shards(_read(spark, sf_dir, "documents"))


def op5_token_output(spark, sf_dir):
    return token_output.ids_digest(token_output.token_output(_read(spark, sf_dir, "documents")))


def op6_random_indexing_quality(spark, sf_dir):
    return quality.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_universe_partition_jaccard(spark, sf_dir):
    return jaccard_join.jaccard_join(_read(spark, sf_dir, "documents"))


def op8_naive_bayes_toxicity(spark, sf_dir):
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_greedy_string_tiling(spark, sf_dir):
    return decontamination.tile(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_best_fit_packing(spark, sf_dir):
    return packing.pack(_read(spark, sf_dir, "documents"))


def op11_minimal_generator_itemsets(spark, sf_dir):
    return itemsets.digest(itemsets.closed_itemsets(_read(spark, sf_dir, "sale_lines")))


def op12_zstandard_warc(spark, sf_dir):
    return warc.warc_roundtrip(_read(spark, sf_dir, "pages"))


def op13_tokenizer_alignment(spark, sf_dir):
    return alignment.align_tokenizers(_read(spark, sf_dir, "documents"))[0]


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_temporal_list_join": url_lists.SQL, "op4_extendible_hashing": sharding.SQL, "op11_minimal_generator_itemsets": itemsets.SQL, "op12_zstandard_warc": warc.SQL}
