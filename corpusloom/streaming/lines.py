"""Row-local detectors over a stream of files. They keep no state, so a stream gives the findings that a batch would."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.findings import union_findings
from ..operators.lines import lines
from ..operators.links import broken_urls
from ..operators.readability import placeholders

FILES = "unit_id string, relative_path string, kind string, text string"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of Parquet files with the columns of `files`."""
    return spark.readStream.schema(FILES).parquet(path)


def stream_placeholders(files: DataFrame) -> DataFrame:
    return placeholders(lines(files))


def write_findings(files: DataFrame, path: str, checkpoint: str):
    """Appends the findings of each micro-batch to `path`; started with what is there, it ends by itself."""

    def one(batch: DataFrame, number: int) -> None:
        rows = lines(batch)
        union_findings([placeholders(rows), broken_urls(rows)]).write.mode("append").parquet(path)

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
