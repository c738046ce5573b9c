"""Content-addressed blobs: every distinct body once, links to cases, quotas, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookout.operators.budget import skipping


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, sha256, size, content of the files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), "content")


def stored(bodies: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """sha256, size, content of bodies not stored yet, each once."""
    new = bodies.where("content is not null").select("sha256", "size", "content").dropDuplicates(["sha256"])
    return new if existing is None else new.join(existing.select("sha256").distinct(), "sha256", "left_anti")


def accepted_links(links: DataFrame, per_case_bytes: int) -> DataFrame:
    """Links (case_id, sha256, size, at) in order of arrival that fit into their case's bytes; a body counts once per case."""
    first = links.groupBy("case_id", "sha256").agg(F.min("at").alias("at"), F.max("size").alias("size"))
    return skipping(first, ["case_id"], ["at", "sha256"], "size", per_case_bytes)


def usage(links: DataFrame, domains: DataFrame) -> DataFrame:
    """Per domain: links, distinct bodies and their bytes. domains: case_id, domain."""
    per = links.join(domains, "case_id").groupBy("domain", "sha256").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("domain").agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("bodies"), F.sum("size").alias("bytes"))


def orphans(blobs: DataFrame, links: DataFrame) -> DataFrame:
    return blobs.join(links.select("sha256").distinct(), "sha256", "left_anti")
