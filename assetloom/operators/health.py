"""Health of a catalog: issues as one long table, statistics, facets, reasons and constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issues(found: list[tuple[DataFrame, str, str, Column]]) -> DataFrame:
    """INT-01, PRJ-06: (severity, code, subject) of each finding."""
    parts = [df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), subject.cast("string").alias("subject")) for df, severity, code, subject in found]
    return reduce(DataFrame.unionByName, parts)


def issue_counts(rows: DataFrame) -> DataFrame:
    """AGG-04."""
    return rows.groupBy("severity", "code").agg(F.count("*").alias("n"))


def is_ok(rows: DataFrame) -> DataFrame:
    """AGG-04, AGG-26, INT-02: one row, true unless an error is there."""
    return rows.agg((F.count_if(F.col("severity") == "error") == 0).alias("ok"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("severity") == "info").alias("infos"))


def status(exists: Column, size: Column, expected_size: Column, changed: Column, expected_changed: Column, drift: bool = True) -> Column:
    """SCL-67: tests in order; null or zero expectations of the time are not tested, nor is it for documents' outputs as drift."""
    late = F.coalesce(expected_changed, F.lit(0)) != 0
    return F.when(~exists, "missing").when(size != expected_size, "modified").when(late & (changed != expected_changed), "metadata_drift" if drift else "modified").otherwise("available")


def reasons(tests: list[tuple[Column, str]]) -> Column:
    """FLT-06, FLT-22, SCL-69: the names of the tests that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in tests]))


def references(parents: DataFrame, children: DataFrame, key: str, reference: str) -> DataFrame:
    """AGG-03: children of each parent, 0 without any."""
    n = children.groupBy(F.col(reference).alias(key)).agg(F.count("*").alias("_n"))
    return parents.join(n, key, "left").withColumn("n_references", F.coalesce("_n", F.lit(0))).drop("_n")


def violations(child: DataFrame, parent: DataFrame, key: str, reference: str, name: str) -> DataFrame:
    """INT-03: references without a parent, counted under the constraint's name."""
    orphans = child.select(F.col(key).alias("k")).join(parent.select(F.col(reference).alias("k")), "k", "left_anti")
    return orphans.agg(F.count("*").alias("n")).select(F.lit(name).alias("constraint_name"), "n")


def repeated_keys(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """INT-03: keys that more than one row has."""
    return rows.groupBy(*keys).agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("n")).select(F.lit(name).alias("constraint_name"), "n")


def search(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """FLT-03, FLT-04: rows of which any column holds the text, in any case."""
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower())))
