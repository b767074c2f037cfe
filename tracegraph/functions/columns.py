"""Text functions as columns. What built-in expressions can say stays in the JVM; state machines run as Arrow-batched functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import markdown as md
from . import reviews


def arrow(schema: str):
    """An Arrow-batched function of columns, made when it is first applied, as a schema text needs a session.

    It isn't moved or copied by the optimizer, which would run it a second time for a filter on empty lists, before a small table is spread.
    """

    def wrap(f: Callable) -> Callable[..., Column]:
        return wraps(f)(lambda *cols: F.pandas_udf(f, schema).asNondeterministic()(*cols))

    return wrap


def structs(rows: list[list[dict]], kind: pa.StructType) -> pa.Array:
    """Lists of records as one Arrow array, column by column; Spark would turn every record of a batch by itself."""
    flat = [x for own in rows for x in own]
    ends = [0]
    for own in rows:
        ends.append(ends[-1] + len(own))
    records = pa.StructArray.from_arrays([pa.array([x[f.name] for x in flat], f.type) for f in kind], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), records)


def first_line(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"(?m)^# (.*)$", 1))


def truncated(text: Column, n: int) -> Column:
    """The first n characters, by code points."""
    return F.substring(text, 1, n)


def normal_cell(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, r"\[([^\[\]]*)\]\([^()]*\)", "$1"), r"\*\*|~~|`", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def leading_int(text: Column) -> Column:
    found = F.regexp_extract(normal_cell(text), r"^([\d,]*\d[\d,]*)", 1)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit("")).try_cast("long"))


def placeholder(text: Column) -> Column:
    return F.lower(F.trim(text)).isin(*sorted(md.PLACEHOLDERS))


def split_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(normal_cell(text), r"[,;\n]"), lambda x: F.trim(x)), lambda x: ~placeholder(x))


def ledger_entries(value: Column) -> Column:
    """array<struct<ord, entry, date>>."""
    return F.transform(F.split(value, r"\[Prior:"), lambda x, k: F.struct(k.alias("ord"), x.alias("entry"), F.regexp_extract(x, r"^\s*(\d{4}-\d\d-\d\d)?", 1).alias("date")))


def version_less(a: Column, b: Column) -> Column:
    number = lambda x, k: F.split_part(x, F.lit("."), F.lit(k)).try_cast("int")
    return (number(a, 1) < number(b, 1)) | ((number(a, 1) == number(b, 1)) & (number(a, 2) < number(b, 2)))


def cut_last(text: Column, sep: str) -> Column:
    """struct<before, after> around the last separator."""
    n = F.substring_index(text, sep, -1)
    return F.struct(F.when(F.contains(text, F.lit(sep)), F.substring(text, F.lit(1), F.length(text) - F.length(n) - len(sep))).otherwise(text).alias("before"), F.when(F.contains(text, F.lit(sep)), n).otherwise("").alias("after"))


def commas(text: Column) -> Column:
    return F.coalesce(F.replace(text, F.lit(","), F.lit("")).try_cast("long"), F.lit(0))


def level(text: Column) -> Column:
    out = F.lit("")
    for name, words in reviews.LEVELS.items():
        out = F.when(F.lower(F.trim(text)).isin(*words), name).otherwise(out)
    return out


def sub_kind(name: Column) -> Column:
    """struct<kind, sub_id>."""
    kind = F.when(name.startswith("AC-"), "ac").when(name.startswith("EC-"), "ec").when(name.startswith("PC"), "pc").when(name.startswith("T-"), "t_task").otherwise("")
    return F.struct(kind.alias("kind"), F.when(kind == "pc", F.concat(F.lit("PC-"), F.regexp_replace(name, "^PC-*", ""))).otherwise(name).alias("sub_id"))


def pin_policy(kind: Column) -> Column:
    return F.when(kind.rlike("|".join(reviews.PINNED_KINDS)), "pinned").otherwise("floating")


@arrow("string")
def mask_code(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: None if s is None else md.mask_code(s))


@arrow("array<struct<ord:int,depth:int,heading:string,body:string>>")
def sections(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda s: None if s is None else [dict(zip(("ord", "depth", "heading", "body"), x)) for x in md.sections(s)])


@arrow("array<struct<heading:string,header:array<string>,line:int,rows:array<struct<cells:array<string>,line:int>>>>")
def tables(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda s: None if s is None else [t | {"rows": [{"cells": c, "line": n} for c, n in t["rows"]]} for t in md.tables(s)])


@arrow("array<struct<key:string,is_list:boolean,scalar:string,items:array<string>>>")
def frontmatter(texts: pd.Series) -> pd.Series:
    def one(s):
        if s is None:
            return None
        f = md.frontmatter(s)
        return [{"key": k, "is_list": isinstance(v, list), "scalar": f.one(k), "items": f.many(k)} for k, v in f.values.items()]

    return texts.map(one)


@arrow("array<struct<finding_id:string,severity:string,source:string,category:string,statement:string,location:string,form:string,owned:boolean,line:int>>")
def review_findings(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda s: None if s is None else reviews.review_findings(s)[0])


def compare_cell(kind: str):
    """(authored, derived) -> outcome for one kind of column."""

    @arrow("string")
    def run(authored: pd.Series, derived: pd.Series) -> pd.Series:
        return pd.Series([md.compare_cell(kind, a or "", d or "") for a, d in zip(authored, derived)], dtype=object)

    return run
