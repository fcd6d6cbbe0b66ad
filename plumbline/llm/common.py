"""What the operators of this subpackage share: tables, the shared folder, cutting lineage, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans.storage import by_core, cut, fresh_path, shared_dir

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "by_core", "cut", "fresh_path", "own_names", "shared_dir", "shuffle_parts", "small_batches", "table"]

#: Rows and bytes of one Arrow batch handed to Python; a batch ends where it reaches either.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; the path may belong to any store that Spark's readers know."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that Spark hands to Python: the session's settings, which a plan reads when it runs.

    Every operator asks for the same bounds; a session that has lower ones keeps them.
    """
    for key, most, parse in (("maxRecordsPerBatch", BATCH_ROWS, int), ("maxBytesPerBatch", BATCH_BYTES, _bytes)):
        key = "spark.sql.execution.arrow." + key
        if not 0 < parse(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def _bytes(text: str) -> int:
    number = text.lower().rstrip("b")
    return int(number.rstrip("kmg")) << {"k": 10, "m": 20, "g": 30}.get(number[-1:], 0)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def own_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own, like ``names``, that no column of ``df`` has in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
