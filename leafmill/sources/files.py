"""Files, archives and includes as tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sources.registry import SUFFIXES, format_of


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, format (by suffix), text: decoded as UTF-8 where it is valid, else as Latin-1; a byte order mark and CRs go."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    known = F.create_map(*[x for k, v in SUFFIXES.items() for x in (F.lit(k), F.lit(v))])
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)\z", 1))
    return raw.select("path", F.coalesce(F.try_element_at(known, suffix), F.lit("markdown")).alias("format"), F.replace(F.regexp_replace(text, "^﻿", ""), F.lit("\r"), F.lit("")).alias("text"))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def archive_members(files: DataFrame) -> DataFrame:
    """path, member, content: what ZIP archives (path, content) hold."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if not name.endswith("/"):
                            yield pa.RecordBatch.from_pydict({"path": [path], "member": [name], "content": [z.read(name)]})

    return files.select("path", "content").mapInArrow(members, "path string, member string, content binary")


def with_includes(files: DataFrame, pattern: str = r"(?m)^\.\. include:: (\S+)\s*$", depth: int = 8) -> DataFrame:
    """files (path, text) with includes of one another replaced, a level of includes a join; deeper ones stay as they are."""
    out = files.select("path", "text")
    for _ in range(depth):
        wanted = out.select("path", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("name")).distinct()
        if wanted.isEmpty():
            break
        folder = F.regexp_extract("path", r"^(.*/)?", 1)
        pieces = wanted.select("path", "name", F.concat(folder, "name").alias("target"))
        body = files.select(F.col("path").alias("b_path"), F.col("text").alias("body"))
        found = pieces.join(body, pieces["target"] == body["b_path"], "left").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("name", F.coalesce("body", F.lit(""))))).alias("bodies"))
        found = found.withColumnRenamed("path", "f_path")
        lines = F.split("text", "\n")
        name = lambda x: F.regexp_extract(x, pattern, 1)
        new = F.array_join(F.transform(lines, lambda x: F.coalesce(F.when(name(x) != "", F.try_element_at("bodies", name(x))), x)), "\n")
        out = out.join(found, out["path"] == found["f_path"], "left").select("path", F.when(F.col("bodies").isNull(), F.col("text")).otherwise(new).alias("text"))
    return out


__all__ = ["archive_members", "binary_files", "format_of", "text_files", "with_includes"]
