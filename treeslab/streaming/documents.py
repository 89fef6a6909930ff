"""Documents as they arrive: a folder is watched, and each new file becomes rows of the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from treeslab.operators.validate import validate
from treeslab.sources.documents import from_texts


def incoming(spark: SparkSession, path: str, files_each: int = 100) -> DataFrame:
    """A stream of file_id and text."""
    stream = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_each).text(path)
    return stream.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("file_id"), F.col("value").alias("text"))


def ingest(spark: SparkSession, path: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the valid documents' tables to Parquet under target, and what is wrong with others to target/rejected.

    Each batch is written by its number, so a batch that is run again after a failure replaces itself.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        checked = validate(rows).persist()
        good = from_texts(rows.join(checked.where("valid"), "file_id", "left_semi"))
        for name in ("files", "groups", "links", "datasets", "datatypes", "attributes"):
            getattr(good, name).write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")
        checked.where("not valid").write.mode("overwrite").parquet(f"{target}/rejected/batch={number}")
        checked.unpersist()
        rows.unpersist()

    out = incoming(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
