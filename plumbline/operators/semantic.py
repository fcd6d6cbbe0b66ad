"""A model over packets: one row for each, whatever the model does.

``adapter`` makes the model in each worker: a function without arguments that returns a function from prompt to
answer. Partitions are the concurrency; packets carry their place, so order is restored where it matters.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import validate as V

Adapter = Callable[[], Callable[[str], str]]
_FENCE = re.compile(r"\A\s*```[A-Za-z]*\s*\n(.*?)\n?\s*```\s*\Z", re.S)


def prompt(instructions: str, packet: dict) -> str:
    return f"{instructions}\n\n{json.dumps(packet)}\n"


def unfenced(answer: str) -> str:
    """The answer without a code fence around all of it."""
    m = _FENCE.match(answer)
    return m[1] if m else answer.strip()


def answers(packets: DataFrame, adapter: Adapter) -> DataFrame:
    """(packet_id, value, failure) of ``packets`` (packet_id, packet as JSON text, instructions).

    An answer is told under the packet's own id, kind and hash; one for another packet is a failure, and so is an
    exception of the model.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = adapter()
        for b in batches:
            ids, values, failures = b.column(0).to_pylist(), [], []
            for id_, text, how in zip(*(c.to_pylist() for c in b.columns), strict=True):
                packet = json.loads(text)
                try:
                    row = json.loads(unfenced(model(prompt(how, packet))))
                    if not isinstance(row, dict):
                        raise ValueError("the answer is no JSON object")
                    if row.get("packet_id", id_) != id_:
                        raise ValueError(f"the answer is for {row['packet_id']}")
                    row |= {"packet_id": id_, "kind": packet["kind"]}
                    row.pop("content_hash", None)
                    if packet["kind"] == "invariant":
                        row["content_hash"] = packet["content_hash"]
                    values.append(json.dumps(row))
                    failures.append(None)
                except Exception as x:  # noqa: BLE001  a model may fail in any way; the others go on
                    values.append(None)
                    failures.append(f"{type(x).__name__}: {x}"[:500])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(values, pa.string()), pa.array(failures, pa.string())], names=["packet_id", "value", "failure"])

    return packets.select("packet_id", "packet", "instructions").mapInArrow(run, "packet_id string, value string, failure string")


def analyze(packets: DataFrame, shown: DataFrame, adapter: Adapter) -> DataFrame:
    """One judged row for each packet: invalid or failed answers become ambiguous ones with ``error``.

    An invariant that is found ok without evidence in a binding test is only weakly bound. ``shown`` has
    (packet_id, kind, shown), and may have ``tests``, the ranges of binding tests.
    """
    told = answers(packets, adapter).withColumnRenamed("packet_id", "asked")
    valid = V.results(told.where("failure is null"), shown.select("packet_id", "kind", "shown"))
    every = valid.select("asked", "error", "kind", "content_hash", "classification", "confidence", "rationale", "evidence", "summary")
    failed = told.where("failure is not null").select("asked", F.col("failure").alias("error"), *[F.lit(None).cast(dict(every.dtypes)[c]).alias(c) for c in every.columns[2:]])
    rows = every.unionByName(failed).withColumnRenamed("asked", "packet_id")
    rows = rows.drop("kind").join(shown.select("packet_id", "kind", *(["tests"] if "tests" in shown.columns else [])), "packet_id")
    if "tests" in shown.columns:
        cited = F.exists("evidence", lambda e: V.is_shown(e["path"], e["line"], F.col("tests")))
        weak = (F.col("kind") == "invariant") & (F.col("classification") == "ok") & ~F.coalesce(cited, F.lit(False))
        rows = rows.withColumn("classification", F.when(weak & F.col("error").isNull(), "weak_binding").otherwise(F.col("classification"))).drop("tests")
    bad = F.col("error").isNotNull()
    return rows.select(
        "packet_id", "kind", "content_hash", F.when(bad, "ambiguous").otherwise(F.col("classification")).alias("classification"), F.when(~bad, F.col("confidence")).alias("confidence"),
        F.when(bad, F.concat(F.lit("no usable answer: "), "error")).otherwise(F.col("rationale")).alias("rationale"),
        F.when(bad, F.expr("array()").cast("array<struct<path:string,line:bigint>>")).otherwise(F.col("evidence")).alias("evidence"), F.when(bad, "no usable answer").otherwise(F.col("summary")).alias("summary"), "error",
    )


def all_failed(rows: DataFrame) -> bool:
    """Whether there are rows and every one is an error."""
    r = rows.agg(F.count("*").alias("n"), F.count("error").alias("bad")).first()
    return r["n"] > 0 and r["n"] == r["bad"]
