"""Validation at the trust boundary: rows of JSON text in, the first rule that each breaks out.

Types are exact: a boolean is no number, ``1.0`` and ``"1"`` are no integers, a blank text is absent. Parsing to
a variant tells a value's JSON type, which casting would hide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import grammar as G

#: What a result may say of a packet.
CLASSES = {
    "section": ["ok", "confirmed_mismatch", "probable_mismatch", "missing_trace", "ambiguous"],
    "invariant": ["ok", "weak_binding", "confirmed_mismatch", "probable_mismatch", "ambiguous"],
}
INVARIANT_PREFIX = "invariant::"


def exact_long(value: Column, name: str) -> Column:
    """The integer field of a JSON object, or null if it is anything else."""
    return F.from_json(value, f"`{name}` long")[name]


def json_kind(v: Column, path: str) -> Column:
    """The JSON type at a path of a variant: STRING, BIGINT, DECIMAL..., DOUBLE, BOOLEAN, VOID, ARRAY..., OBJECT...; null if absent."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def text(v: Column, path: str) -> Column:
    return F.when(json_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def filled(c: Column) -> Column:
    return F.coalesce(F.length(G.strip(c)) > 0, F.lit(False))


def first_error(rules: list[tuple[Column, str]]) -> Column:
    """The message of the first rule that is broken (its column is true), or null."""
    return F.coalesce(*[F.when(bad, F.lit(message)) for bad, message in rules])


def is_shown(path: Column, line: Column, ranges: Column) -> Column:
    """Whether a line lies in one of the ranges (path, start, end) of its path; a path without any can't be cited."""
    return F.exists(ranges, lambda r: (r["path"] == path) & line.between(r["start"], r["end"]))


def results(rows: DataFrame, shown: DataFrame | None, value: str = "value") -> DataFrame:
    """``rows`` with the fields of each result and ``error``, null for valid ones.

    ``shown`` has (packet_id, kind, shown): the packets that exist and the ranges that each shows, or is None if
    packets aren't known. A row without a kind is a section's of an older form.
    """
    v = F.try_parse_json(F.col(value))
    obj = rows.withColumn("__v", v)
    j = F.col("__v")
    pid, kind = text(j, "$.packet_id"), json_kind(j, "$.kind")
    obj = obj.withColumn("packet_id", pid).withColumn("__k", kind).withColumn("kind", F.when(F.col("__k").isNull(), "section").otherwise(text(j, "$.kind")))
    if shown is not None:
        obj = obj.join(shown.select("packet_id", F.col("kind").alias("__kind"), F.col("shown").alias("__shown")), "packet_id", "left")
    whole = F.coalesce(F.schema_of_variant(j).startswith("OBJECT"), F.lit(False))
    inv = F.coalesce(F.col("packet_id").startswith(INVARIANT_PREFIX), F.lit(False))
    has_hash = json_kind(j, "$.content_hash").isNotNull()
    hash_, cls = text(j, "$.content_hash"), text(j, "$.classification")
    ck = json_kind(j, "$.confidence")
    number = ck.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)")
    conf = F.when(number, F.try_variant_get(j, "$.confidence", "double"))
    rk, ek = json_kind(j, "$.rationale"), json_kind(j, "$.evidence")
    given = F.from_json(F.col(value), "evidence array<struct<path:string,line:long>>")["evidence"]
    raw = F.try_variant_get(j, "$.evidence", "array<variant>")
    of = lambda x, p: F.schema_of_variant(F.try_variant_get(x, p, "variant"))
    bad_item = F.exists(raw, lambda x: ~F.coalesce((of(x, "$.path") == "STRING") & of(x, "$.line").rlike("^(BIGINT|INT|SMALLINT|TINYINT)"), F.lit(False)))
    bad_item = bad_item | F.exists(given, lambda x: ~F.coalesce(filled(x["path"]) & (x["line"] >= 1), F.lit(False)))
    known = CLASSES["section"], CLASSES["invariant"]
    rules = [
        (~whole, "not a JSON object"),
        (~filled(F.col("packet_id")), "packet_id is missing"),
        (F.col("__k").isNull() & has_hash, "an older row has no content_hash"),
        (F.col("__k").isNull() & inv, "an invariant's row names its kind"),
        (~F.coalesce(F.col("kind").isin("section", "invariant"), F.lit(False)), "unknown kind"),
        ((F.col("kind") == "section") & has_hash, "a section's row has no content_hash"),
        ((F.col("kind") == "section") & inv, "the packet is an invariant's"),
        ((F.col("kind") == "invariant") & ~(inv & G.valid_id(F.substring(F.col("packet_id"), len(INVARIANT_PREFIX) + 1, 1 << 20))), "the packet is no invariant's"),
        ((F.col("kind") == "invariant") & ~F.coalesce(hash_.rlike(r"^[0-9a-f]{64}\z"), F.lit(False)), "content_hash is not a SHA-256"),
    ]
    if shown is not None:
        rules += [(F.col("__kind").isNull(), "unknown packet_id"), (F.col("__kind") != F.col("kind"), "the packet is of another kind")]
    rules += [
        (~F.coalesce(F.when(F.col("kind") == "section", cls.isin(known[0])).otherwise(cls.isin(known[1])), F.lit(False)), "unknown classification"),
        (~filled(text(j, "$.summary")), "summary is missing"),
        (ck.isNotNull() & (ck != "VOID") & ~F.coalesce(conf.between(0, 1), F.lit(False)), "confidence is not a number from 0 to 1"),
        (rk.isNotNull() & ~rk.isin("STRING", "VOID"), "rationale is not a text"),
        (conf.isNull() & ~filled(text(j, "$.rationale")), "neither confidence nor rationale"),
        (~F.coalesce(ek.startswith("ARRAY"), F.lit(False)), "evidence is not a list"),
        (F.coalesce(bad_item, F.lit(False)), "evidence is not of paths and lines"),
    ]
    if shown is not None:
        rules.append((F.coalesce(F.exists(given, lambda x: ~F.coalesce(is_shown(x["path"], x["line"], F.col("__shown")), F.lit(False))), F.lit(False)), "evidence is not shown"))
    return obj.select(
        *rows.columns, first_error(rules).alias("error"), "packet_id", "kind", F.when(F.col("kind") == "invariant", hash_).alias("content_hash"), cls.alias("classification"),
        conf.alias("confidence"), F.coalesce(text(j, "$.rationale"), F.lit("")).alias("rationale"), given.alias("evidence"), text(j, "$.summary").alias("summary"),
    )


def class_counts(rows: DataFrame, words: dict[str, list[str]] | None = None) -> DataFrame:
    """(kind, classification, n) for every word of the vocabulary, zeros included, with its ``place``."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(k, w, i) for k, ws in (words or CLASSES).items() for i, w in enumerate(ws)], "kind string, classification string, place int")
    n = rows.groupBy("kind", "classification").agg(F.count("*").alias("n"))
    return every.join(n, ["kind", "classification"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def shown_ranges(packets: DataFrame) -> DataFrame:
    """(packet_id, kind, shown) of section packets: the lines that their text and owners' snippets show."""
    of = lambda path, start, body: F.struct(path.alias("path"), start.cast("long").alias("start"), (start + F.size(F.split(body, "\n")) - 1).cast("long").alias("end"))
    owners = F.transform(F.filter("owners", lambda o: o["snippet"] != ""), lambda o: of(o["path"], o["start_line"], o["snippet"]))
    own = F.array(of(F.col("spec_path"), F.col("section_start_line"), F.col("section_text")))
    return packets.select("packet_id", "kind", F.concat(own, F.coalesce(owners, F.slice(own, 1, 0))).alias("shown"))


def shown_invariant_ranges(packets: DataFrame) -> DataFrame:
    """The same of invariant packets: targets and binding tests, and the declaration's line."""
    of = lambda o: F.struct(o["path"].alias("path"), o["start_line"].alias("start"), (o["start_line"] + F.size(F.split(o["snippet"], "\n")) - 1).cast("long").alias("end"))
    every = F.filter(F.concat("targets", "binding_tests"), lambda o: o["snippet"] != "")
    own = F.array(F.struct(F.col("declaration.path").alias("path"), F.col("declaration.line").cast("long").alias("start"), F.col("declaration.line").cast("long").alias("end")))
    return packets.select("packet_id", "kind", F.concat(own, F.transform(every, of)).alias("shown"))
