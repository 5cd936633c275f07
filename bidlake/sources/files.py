"""Files in and out: uploaded documents, plain text, open data and stored blobs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlake.functions.validation import upload_error
from bidlake.schemas import BLOCK

Parser = Callable[[str, bytes], list[dict]]

_PARSED_BLOCK = T.StructType([T.StructField("page_number", T.IntegerType()), *BLOCK.fields])
_BLOCK_FIELDS = tuple(BLOCK.fieldNames())
PARSED_FILE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("blocks", T.ArrayType(_PARSED_BLOCK)),
    T.StructField("error", T.StringType()),
])


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, filename, length, content) of binary files under a folder.

    Empty files have nothing to split and do not appear; ``parse_files`` refuses them when they
    arrive as rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length", "content")


def parse_files(files: DataFrame, parser: Parser) -> DataFrame:
    """Blocks per accepted file by a pluggable parser ``(filename, bytes) -> [block, …]``.

    A refused file or one whose parser fails keeps its row with ``error`` set and no blocks; the
    others go on. The content column is read for accepted files only.
    """
    checked = files.withColumn("error", upload_error("filename", "length"))
    checked = checked.withColumn("content", F.when(F.col("error").isNull(), F.col("content")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            blocks, errors = [], []
            for name, content, error in zip(batch.filename, batch.content, batch.error):
                found = None
                if error is None:
                    try:
                        found = [{"page_number": int(b.get("page_number") or 1), **{f: b.get(f) for f in _BLOCK_FIELDS}}
                                 for b in parser(name, content)]
                    except Exception as problem:  # one bad file must not end the job
                        error = f"{type(problem).__name__}: {problem}"
                blocks.append(found)
                errors.append(error)
            yield pd.DataFrame({"path": batch.path, "filename": batch.filename, "length": batch.length,
                                "blocks": blocks, "error": errors})

    return checked.mapInPandas(run, PARSED_FILE)


def failed(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error is not null").select("path", "filename", "error")


def retry_failed(files: DataFrame, parsed: DataFrame, parser: Parser) -> DataFrame:
    """Keep the good rows and parse the failed files again."""
    again = files.join(failed(parsed).select("path"), "path", "left_semi")
    return parsed.filter("error is null").unionByName(parse_files(again, parser))


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_open_data(spark: SparkSession, path: str, schema: T.StructType, kind: str = "csv") -> DataFrame:
    """Open-data tenders from CSV (with header) or JSON lines, with a given schema."""
    if kind == "csv":
        return spark.read.schema(schema).option("header", "true").csv(path)
    if kind == "json":
        return spark.read.schema(schema).json(path)
    raise ValueError("kind must be 'csv' or 'json'")


def put_blobs(rows: DataFrame, root: str, version: int | None = None) -> None:
    """Append (storage_path, content) to a blob table, spread by path hash.

    ``version`` (default: the time of the call in nanoseconds) orders puts of one path; a put that
    is repeated leaves an older version behind, which readers pass over. Buckets are gathered
    before the write, so that tasks do not each write a file to every bucket.
    """
    stored = rows.select(
        "storage_path", "content", F.lit(time.time_ns() if version is None else version).cast("long").alias("version"),
        F.pmod(F.xxhash64("storage_path"), F.lit(256)).alias("bucket"))
    stored.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(root)


def get_blob(spark: SparkSession, root: str, storage_path: str) -> DataFrame:
    """The newest content stored at a path; only its bucket is listed and read."""
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(storage_path)), F.lit(256)).alias("b")).first().b
    stored = spark.read.parquet(root)
    return stored.filter((F.col("bucket") == bucket) & (F.col("storage_path") == storage_path)).orderBy(
        F.desc("version")).limit(1).select("storage_path", "content")
