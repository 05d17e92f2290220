"""The queries of this subpackage: thin (spark, sf_dir) adapters and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, clustering, decontam, html, license, linededup, quality, secrets, sharding, simhash, spelling, warc
from .oracle import ORACLE_SQL  # noqa: F401


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bpe_digests(round_trip: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of `bpe.decode` output."""
    return round_trip.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )


def bpe_rows(round_trip: DataFrame) -> DataFrame:
    """`bpe_digests`, with the ids themselves."""
    return bpe_digests(round_trip, "ids")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, encoded and decoded: the digests of both. Null text counts as empty; repeated rows stay; an empty table is empty."""
    return bpe_digests(bpe.decode(bpe.encode(_read(spark, sf_dir, "documents"))))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of each document by its id. Null ids share one slot; repeated rows stay."""
    return sharding.assign_shards(_read(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page, by the templates induced from all pages. Null HTML has the text ''; repeated rows stay."""
    found = html.extract_text(_read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, calls and results of all conversations, linked, ordered, checked and serialised. Repeated turns stay."""
    return chat.link_tool_calls(_read(spark, sf_dir, "conversations"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses that each document holds. Null text holds none; repeated rows stay."""
    found = license.scan_licenses(_read(spark, sf_dir, "documents"))
    names = F.transform("found", lambda x: x["license"])
    return found.select("doc_id", F.size("found").cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document. Null text has fingerprint zero, linked like any other; repeated rows stay."""
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of the secrets of each document. Null text has none; repeated rows stay."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    found = secrets.scan_secrets(_read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
    )


def op8_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, as read back from the bundles written. Null HTML is an empty payload; repeated rows stay."""
    _, records = warc.archive(_read(spark, sf_dir, "pages"))
    id_type = records.schema["page_id"].dataType
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that benchmark windows cover. Null text has no words; repeated rows stay."""
    found = decontam.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


def op10_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and verdict of each document. Null text has no words and fails; a null source is a host; repeated rows stay."""
    found = quality.quality_rules(_read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of each vector after five rounds, and digests of the centroids. Vectors that are not whole are left out; repeated rows stay."""
    found, centroids = clustering.cluster(_read(spark, sf_dir, "embeddings"))
    marks = spark.createDataFrame(list(enumerate(clustering.digests(centroids))), "cluster int, centroid_sha256 string")
    return found.join(F.broadcast(marks), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a cluster


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the lines that others repeat. Null text is one empty line; repeated rows stay."""
    found = linededup.dedup_lines(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with the spelling they are variants of. Null text has no words; repeated rows count each."""
    return spelling.spelling_variants(_read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe_round_trip, op2_sharding, op3_html_extraction, op4_chat_formatting, op5_license_scan,
        op6_simhash_near_dedup, op7_secret_scan, op8_warc_bundles, op9_winnowing, op10_host_quality,
        op11_centroid_clustering, op12_line_dedup, op13_spelling_variants,
    )
}
