"""A trace corpus rendered from relational tables, deterministically.

Parts, suppliers and nations are sections; orders are lines of code that cite them, written as text and read
back by the reference extractor; parts map to files; suppliers declare invariants and customers bind tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import grammar as G
from plumbline.functions.line_refs import extract_refs
from plumbline.operators.resolve import Corpus, Profile

PROFILE = Profile(spec_roots=["docs/specs"], code_roots=["src", "lib", "tests"], test_roots=["tests"], planned_globs=["docs/specs/A-*.md"], exploratory_globs=["docs/specs/Supp*.md"])

SUPPLIERS, PLANNED = "docs/specs/Suppliers.md", "docs/specs/A-planned.md"


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _ord(path: Column, seq: Column, root: int = 0) -> Column:
    return F.struct(F.lit(root).alias("root"), path.alias("path"), seq.cast("long").alias("seq")).alias("ord")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    def shaped(df: DataFrame, path: Column, prefix: str, key: str, title: Column) -> DataFrame:
        line = F.col(key).cast("long") * 10 + 1
        return df.select(
            path.alias("path"), _text(prefix, F.col(key)).alias("section_id"), title.alias("title"), line.alias("line"),
            G.slug(_text(title, " [", prefix, F.col(key), "]")).alias("anchor"), F.lit("heading").alias("kind"), _ord(path, line),
        )

    part = _read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_name")
    supplier = _read(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    nation = _read(spark, sf_dir, "nation", "n_nationkey", "n_name")
    of_part = _text("docs/specs/", F.replace(F.col("p_brand"), F.lit("#"), F.lit("-")), ".md")
    return (
        shaped(part, of_part, "PRT-", "p_partkey", F.col("p_name"))
        .unionByName(shaped(supplier, F.lit(SUPPLIERS), "PRT-", "s_suppkey", F.col("s_name")))
        .unionByName(shaped(nation, F.lit(PLANNED), "NAT-", "n_nationkey", F.col("n_name")))
    )


def spec_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(spark, sf_dir).select("path").distinct()


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(spark, sf_dir).select("path", "anchor")


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of text for each order; what it cites follows from the keys."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    a = F.pmod(c, F.lit(90))
    forms = [
        _text("Spec: ", SUPPLIERS, " [PRT-", F.pmod(c, F.lit(150)), "]"),
        _text("Spec: [PRT-", c, "]"),
        _text("see [PRT-", c, ", PRT-", c + 1, "]"),
        _text(SUPPLIERS, " [PRT-", a, "]-[PRT-", a + F.pmod(c, F.lit(3)) + 1, "]"),
        _text("also [PRT-", c + 2, "]-[PRT-", c, "]"),
        _text("docs/specs/Gone-", F.pmod(c, F.lit(5)), ".md [PRT-1]"),
        _text("as in ", PLANNED),
        _text("shift window[N-1] by [ZZZ-", c, "] and [NAT-", F.pmod(c, F.lit(30)), "]"),
    ]
    m = F.pmod(k, F.lit(8))
    raw = F.coalesce(*[F.when(m == i, f) for i, f in enumerate(forms)])
    return _read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(
        _text("src/m", F.pmod(c, F.lit(50)), ".py").alias("path"), _text("load_", k).alias("owner_symbol"), (F.pmod(k, F.lit(200)) + 1).cast("long").alias("line"),
        raw.alias("raw"), F.when(m < 2, "asserted").otherwise("comment").alias("ref_context"),
    )


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_refs(code_lines(spark, sf_dir))
    return found.withColumn("ord", _ord(F.col("path"), F.substring_index("owner_symbol", "_", -1).cast("long")))


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    target = F.when(F.pmod(k, F.lit(6)) == 0, _text("src/m", size, ".py::load_", F.pmod(k, F.lit(40)))).when(F.pmod(k, F.lit(3)) == 0, _text("src/m", size, ".py")).when(F.pmod(k, F.lit(3)) == 1, _text("m", size, ".py"))
    path = _text("docs/specs/", F.replace(F.col("p_brand"), F.lit("#"), F.lit("-")), ".md")
    rows = _read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size").withColumn("target", target).where("target is not null")
    t = F.col("target")
    return rows.select(
        path.alias("spec_path"), _text("PRT-", k).alias("section_id"), (k * 10 + 2).cast("long").alias("line"), "target",
        G.token_kind(t).alias("kind"), G.token_path(t).alias("target_path"), G.token_symbol(t).alias("target_symbol"), _ord(path, k * 10 + 2),
    )


def scan_files(spark: SparkSession) -> DataFrame:
    """60 files; the table has a fixed size."""
    return spark.range(50).select(_text("src/m", F.col("id"), ".py").alias("path")).union(spark.range(10).select(_text("lib/m", F.col("id"), ".py").alias("path")))


def symbols(spark: SparkSession) -> DataFrame:
    return spark.range(50 * 30).select(_text("src/m", F.floor(F.col("id") / 30), ".py").alias("path"), _text("load_", F.pmod(F.col("id"), F.lit(30))).alias("symbol"))


def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each supplier, and one more, in code, for the first of each nation."""
    s = _read(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    key, tier = F.col("s_suppkey"), F.when(F.col("s_acctbal") >= 0, "required").otherwise("draft")
    none = F.lit(None).cast("string")
    spec = s.select(
        _text("INV.S.", key).alias("invariant_id"), F.col("s_name").alias("statement"), tier.alias("tier"), F.lit("spec").alias("declaration_kind"), F.lit(SUPPLIERS).alias("path"),
        (key * 10 + 3).cast("long").alias("line"), none.alias("owner_symbol"), _text("PRT-", key).alias("section_id"), _ord(F.lit(SUPPLIERS), key * 10 + 3),
    )
    least = s.groupBy("s_nationkey").agg(F.min_by(F.struct("s_suppkey", "s_name"), "s_suppkey").alias("r")).select("s_nationkey", "r.*")
    path = _text("src/m", F.col("s_nationkey"), ".py")
    code = least.select(
        _text("INV.S.", key).alias("invariant_id"), F.col("s_name").alias("statement"), F.lit("required").alias("tier"), F.lit("code").alias("declaration_kind"), path.alias("path"),
        F.lit(1).cast("long").alias("line"), F.lit("<module>").alias("owner_symbol"), none.alias("section_id"), _ord(path, F.lit(1), 1),
    )
    return spec.unionByName(code)


def binds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each customer; ids beyond the suppliers are declared nowhere, customers of nation 7 bind outside tests.

    Nobody binds an id whose number leaves 3 when divided by 7: those customers bind the id before it.
    """
    c = _read(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    path = F.when(nation == 7, "src/not_a_test.py").otherwise(_text("tests/test_", nation, ".py"))
    line = (F.pmod(key, F.lit(400)) + 1).cast("long")
    bound = F.pmod(key, F.lit(200))
    bound = bound - F.when(F.pmod(bound, F.lit(7)) == 3, 1).otherwise(0)
    return c.select(
        _text("INV.S.", bound).alias("invariant_id"), path.alias("test_path"), _text("test_", F.pmod(key, F.lit(4))).alias("test_symbol"),
        line.alias("marker_line"), line.alias("start_line"), (line + 5).alias("end_line"), _ord(path, key),
    )


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    files = scan_files(spark)
    return Corpus(
        sections(spark, sf_dir), anchors(spark, sf_dir), mappings(spark, sf_dir), refs(spark, sf_dir), invariants(spark, sf_dir), binds(spark, sf_dir),
        spec_files(spark, sf_dir), files, files, files.where(F.col("path").startswith("src/")), symbols(spark),
    )
