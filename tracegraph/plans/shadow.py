"""Derived indexes against written ones, cell by cell. Nothing is written; a check that can't be made is a finding, never a pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns
from ..functions import markdown as md
from ..operators import findings as fd


@dataclass(frozen=True)
class Column:
    """name in the index; kind as compare_cell has it, or underivable; field of the record."""

    name: str
    kind: str
    field: str = ""


@dataclass(frozen=True)
class Spec:
    path: str
    key: str
    header: tuple[str, ...]
    columns: tuple[Column, ...]
    exclude: tuple[str, ...] = ()
    stage: str = "shadow"


def set_field(records: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """records (id, ...) with the sorted targets of their edges (id, target) joined by commas; empty without one."""
    sets = edges.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("target")), ", ").alias(name))
    return records.join(sets, "id", "left").withColumn(name, F.coalesce(name, F.lit("")))


def _cells(spec: Spec):
    """Body to the rows of the tables that have the spec's header."""

    @columns.arrow("struct<tables:int,rows:array<struct<line:int,key:string,struck:boolean,short:boolean,cells:map<string,string>>>>")
    def run(bodies):
        import pandas as pd

        out = []
        for body in bodies:
            tables = [t for t in md.tables(body) if all(md.column_index(t, h) >= 0 for h in spec.header)]
            rows = []
            for t in tables:
                key = md.column_index(t, spec.key)
                at = {c.name: md.column_index(t, c.name) for c in spec.columns if c.kind != "underivable"}
                for cells, line in t["rows"]:
                    raw = md.cell(cells, key)
                    rows.append({"line": line, "key": md.normal_cell(raw), "struck": md.struck(raw), "short": len(cells) < len(t["header"]), "cells": {n: md.cell(cells, k) for n, k in at.items() if k >= 0}})
            out.append((len(tables), rows))
        return pd.DataFrame(out, columns=["tables", "rows"])

    return run


def check(docs: DataFrame, records: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """(findings, outcomes (column, outcome, n)) of one spec; docs (path, body), records (id, path, fields...)."""
    spark = docs.sparkSession
    note = lambda rule, detail: spark.createDataFrame([(rule, spec.path, "shadow", detail)], fd.SCHEMA)
    none = spark.createDataFrame([], "column string, outcome string, n long")
    if spec.stage != "shadow":
        return note("shadow.stage-not-shadow", spec.stage), none
    read = docs.where(F.col("path") == spec.path).select(_cells(spec)(F.col("body")).alias("x")).select("x.tables", "x.rows").first()
    if read is None:
        return note("shadow.document-absent", ""), none
    if not read["tables"]:
        return note("shadow.table-absent", ", ".join(spec.header)), none
    rows = spark.createDataFrame(read["rows"], "line int, key string, struck boolean, short boolean, cells map<string,string>")  # one document
    parts = []
    held = records
    for prefix in spec.exclude:
        held = held.where(~F.col("path").startswith(prefix))
    if spec.exclude:
        left_out = records.count() - held.count()
        parts.append(note("shadow.scope-excludes", f"{left_out} record(s) under {', '.join(spec.exclude)}"))
    parts += [note(f"shadow.column-underivable:{c.name}", "") for c in spec.columns if c.kind == "underivable"]
    subject = F.concat(F.lit(f"{spec.path} -> "), F.col("key"))
    parts.append(fd.findings(rows.where("short"), "shadow.row-truncated", F.concat(F.lit(f"{spec.path}:"), F.col("line").cast("string")), "shadow"))
    rows = rows.where("key <> ''")
    parts.append(fd.findings(rows.where("struck"), "shadow.row-struck-through", subject, "shadow"))
    known = held.select(F.col("id").alias("key"), *[F.col(c.field) for c in spec.columns if c.kind != "underivable"])
    parts.append(fd.findings(rows.join(known.select("key"), "key", "left_anti"), "shadow.row-without-record", subject, "shadow"))
    parts.append(fd.findings(rows.join(known.select("key"), "key", "left_semi").groupBy("key").count().where("count > 1"), "shadow.row-duplicated", subject, "shadow"))
    parts.append(fd.findings(known.join(rows.select("key"), "key", "left_anti"), "shadow.record-absent-from-index", subject, "shadow"))
    both = rows.join(known, "key")
    compared = []
    for c in (c for c in spec.columns if c.kind != "underivable"):
        own = both.where(F.map_contains_key("cells", c.name))
        compared.append(own.select("key", F.lit(c.name).alias("column"), columns.compare_cell(c.kind)(F.col("cells")[c.name], F.coalesce(F.col(c.field).cast("string"), F.lit(""))).alias("outcome")))
    every = fd.union(compared)
    off = every.where(~F.col("outcome").isin("agree", "agree-casefold", "agree-set"))
    parts.append(fd.findings(off, F.concat(F.lit("shadow.cell."), F.col("outcome"), F.lit(":"), F.col("column")), F.concat_ws(" ", subject, F.col("column")), "shadow"))
    return fd.union(parts), every.groupBy("column", "outcome").agg(F.count("*").alias("n"))


AGREE = ("agree", "agree-casefold", "agree-set")


def agreement(outcomes: DataFrame, by: str = "column") -> DataFrame:
    """(by, cells, agreement): the share, in percent, of the cells of outcomes (by, outcome, n) that agree; without a cell there is none."""
    cells = F.sum("n").alias("cells")
    return outcomes.groupBy(by).agg(cells, F.round(F.lit(100.0) * F.sum(F.when(F.col("outcome").isin(*AGREE), F.col("n")).otherwise(0)) / F.sum("n"), 1).alias("agreement"))
