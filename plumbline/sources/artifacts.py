"""Artifacts as sources: packets, results and reports that commands wrote before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import contracts
from plumbline.operators import validate as V
from plumbline.plans.registry import Policy
from plumbline.plans.storage import cut


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, value): the lines of a file that aren't blank, numbered as in the file.

    Each split numbers its own lines; the counts of the splits before it, a row for each, are added.
    """
    own = Window.partitionBy("at").orderBy("k")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"))
    splits = lines.groupBy("at").agg(F.count("*").alias("n"))
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    placed = lines.withColumn("i", F.row_number().over(own)).join(splits, "at")
    return placed.where(F.trim("value") != "").select((F.col("first") + F.col("i")).cast("long").alias("row_id"), "value")


def packets(spark: SparkSession, path: str, policy: Policy | None = None) -> DataFrame:
    """(row_id, packet_id, kind, packet, instructions, error) of a packet file; rows without a kind are sections'."""
    rows = contracts.packets(json_lines(spark, path), policy)
    return rows.select("row_id", "packet_id", "kind", F.col("value").alias("packet"), "instructions", "error")


def report(spark: SparkSession, path: str, policy: Policy | None = None) -> tuple[dict, DataFrame]:
    """(summary, records) of a report that holds; ValueError tells the first fault of one that doesn't."""
    rows = spark.read.text(path, wholetext=True).withColumn("report", F.lit(path))
    every = cut(contracts.records(rows), "records")
    bad = contracts.summary_errors(rows, every).first()
    if bad is None or bad["error"]:
        raise ValueError(bad["error"] if bad else "not a report")
    order = F.array_position(F.array(*[F.lit(x) for x in contracts.LISTS]), F.col("part"))
    fault = contracts.record_errors(every, policy).where("error is not null").orderBy(order, "position").first()
    if fault:
        raise ValueError(f"{fault['part']}[{fault['position']}]: {fault['error']}")
    names = [x for x in (*contracts.LISTS[:3], "invariants", *contracts.SEVERITIES)]
    told = rows.select(F.from_json("value", "summary struct<" + ", ".join(f"{x}: long" for x in names) + ">")["summary"].alias("s")).first()["s"]
    return {k: v or 0 for k, v in told.asDict().items()}, every


def identities(every: DataFrame) -> DataFrame:
    """(packet_id, kind) of the packets that a report can have: linked sections and bound invariants."""
    of = lambda part, name: (F.when(F.col("part") == part, V.text(F.col("v"), f"$.{name}")))
    edges = every.where("part = 'edges'").select(F.concat_ws("#", of("edges", "spec_path"), of("edges", "section_id")).alias("packet_id"), F.lit("section").alias("kind"))
    bound = every.where("part = 'binds'").select(of("binds", "invariant_id").alias("id"))
    declared = every.where("part = 'invariants'").select(of("invariants", "invariant_id").alias("id")).join(bound, "id", "left_semi")
    return edges.distinct().union(declared.select(F.concat(F.lit(V.INVARIANT_PREFIX), "id"), F.lit("invariant")).distinct())
