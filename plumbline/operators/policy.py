"""Levels of findings: the policy as joins with its expanded rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.registry import Policy, registry_table, rules_table


def rank() -> Column:
    """Errors first, then warnings, then the rest."""
    return F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)


def levels(findings: DataFrame, policy: Policy) -> DataFrame:
    """``findings`` with ``level``: that of the last rule that selects (code, context), else the default.

    The rules, a few for each code, become one row for each (code, context) before they are joined; their
    number is the registry's and never grows with findings.
    """
    spark = findings.sparkSession
    last = rules_table(spark, policy).groupBy("code", "context").agg(F.max_by("level", "rule_ord").alias("level"))
    met = findings.withColumn("__c", F.coalesce("context", F.lit("")))
    last = last.select(F.col("code").alias("__code"), F.col("context").alias("__context"), "level")
    met = met.join(F.broadcast(last), (F.col("code") == F.col("__code")) & (F.col("__c") == F.col("__context")), "left")
    return met.drop("__c", "__code", "__context").withColumn("level", F.coalesce("level", F.lit(policy.default_level)))


def apply(findings: DataFrame, policy: Policy) -> tuple[DataFrame, DataFrame]:
    """(issues, off): findings with severity, default_severity and short_code; those set to off apart, at their default level."""
    spark = findings.sparkSession
    base = Policy(policy.registry)  # what the defaults alone would say
    set_ = levels(findings, policy)
    default = levels(set_.withColumnRenamed("level", "set"), base).withColumnRenamed("level", "default_severity")
    met = default.join(F.broadcast(registry_table(spark, policy)), "code", "left")
    kept = [c for c in findings.columns]
    issues = met.where("set <> 'off'").select(*kept, F.col("set").alias("severity"), "default_severity", "short_code")
    off = met.where("set = 'off'").select(*kept, F.lit(policy.default_level).alias("severity"), "default_severity", "short_code")
    return issues, off


def report_order() -> list[Column]:
    """Severity, path, line (none as 0), code, message; the rest only makes the order total."""
    line = F.coalesce("line", F.lit(0))
    return [rank(), F.col("path"), line, F.col("code"), F.col("message"), F.col("section_id").asc_nulls_first(), F.col("symbol").asc_nulls_first(), F.col("invariant_id").asc_nulls_first()]


def histogram(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code", "severity").agg(F.count("*").alias("n"))


def summary(sections: DataFrame, refs: DataFrame, mappings: DataFrame, invariants: DataFrame, issues: DataFrame) -> DataFrame:
    """The seven counts of a report, one row."""
    each = [df.select(F.lit(name).alias("name"), F.lit(1).alias("x")) for name, df in (("spec_sections", sections), ("code_refs", refs), ("spec_mappings", mappings), ("invariants", invariants))]
    plural = F.concat(F.col("severity"), F.lit("s"))
    each.append(issues.select(plural.alias("name"), F.lit(1).alias("x")))
    n = reduce(DataFrame.union, each).groupBy("name").agg(F.count("x").alias("n"))
    names = ["spec_sections", "code_refs", "spec_mappings", "invariants", "errors", "warnings", "infos"]
    return n.agg(*[F.coalesce(F.max(F.when(F.col("name") == x, F.col("n"))), F.lit(0)).alias(x) for x in names])


def failing(issues: DataFrame, policy: Policy, warnings_as_errors: bool = False) -> bool:
    """Whether a finding is of a level that fails the check."""
    bad = list(policy.fail_on) + (["warning"] if warnings_as_errors else [])
    return not issues.where(F.col("severity").isin(bad)).isEmpty()
