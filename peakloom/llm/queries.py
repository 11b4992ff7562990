"""The registered queries of the operators, with the SQL that checks them where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm import (
    block_ann,
    infill,
    packing,
    pu_quality,
    risk_rules,
    secret_scan,
    sentencepiece_codec,
    simhash,
    suffix_tree,
    turn_repair,
    url_filter,
    warc,
    winnowing,
)
from peakloom.llm.common import load, settle
from peakloom.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(load(spark, sf_dir, "pages"))


@query
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(load(spark, sf_dir, "documents"))


@query
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    both = sentencepiece_codec.decode(sentencepiece_codec.encode(load(spark, sf_dir, "documents").select("doc_id", "text"), model), model)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"))


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.score_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share; asks for it as a checkpoint does."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        settle(spark.range(1))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.write_archives(load(spark, sf_dir, "pages"), path)
    merged = warc.capture_places(warc.merge_runs(warc.capture_runs(spark, path)))
    return merged.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "warc_date", "capture_place"
    )


@query
def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(load(spark, sf_dir, "documents")))


@query
def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_ann.search(load(spark, sf_dir, "embeddings"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = risk_rules.quality_rules(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", *risk_rules.MEASURES, "base_failed", "kept")


@query
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.overlaps(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


@query
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations")
    return turn_repair.digest(turn_repair.edit_script(turn_repair.damage(turns)), turns)


@query
def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(infill.restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )
