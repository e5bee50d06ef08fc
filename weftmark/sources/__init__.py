"""Readers and writers of raw pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmark.functions import encoding as E
from weftmark.operators.nodes import html_nodes


def decoded(df: DataFrame, bytes_col: str, out: str = "html", encoding_out: str = "encoding") -> DataFrame:
    """Detect each value's encoding and decode it, byte-order mark dropped."""
    named = df.withColumn(encoding_out, E.sniff_encoding(F.col(bytes_col)))
    return named.withColumn(out, E.decode_bytes(E.strip_bom(F.col(bytes_col)), F.col(encoding_out))["text"])


def read_pages(df: DataFrame, bytes_col: str, id_col: str) -> DataFrame:
    """Bytes to nodes: detect, decode, parse."""
    return html_nodes(decoded(df, bytes_col).select(F.col(id_col), "html"), id_col, "html")


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, path, html) of files: binary source, so splits stay whole."""
    files = spark.read.format("binaryFile").load(path)
    return decoded(files.select(F.xxhash64("path").alias("page_id"), "path", "content"), "content").drop("content")


def write_nodes(nodes: DataFrame, path: str, buckets: int | None = None) -> None:
    """Node table as Parquet; rows of a document stay together and tags are sorted inside files, for pruning."""
    out = nodes if buckets is None else nodes.repartition(buckets, "doc_id")
    out.sortWithinPartitions("doc_id", "node_id").write.mode("overwrite").parquet(path)
