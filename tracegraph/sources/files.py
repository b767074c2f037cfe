"""Small state files: baselines, retry states, record streams, and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASELINE = "rule string, subject string, class string, detail string, waiver string"
BASELINE_FIELDS = [c.split()[0] for c in BASELINE.split(", ")]
HEADER = {"note", "generated", "corpus_path", "corpus_ref", "corpus_fingerprint", "counts"}  #: of a baseline document, and the version of what wrote it
STATE = "ref string, attempts int, last_run int, last_error string"


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """The findings of a baseline: a JSON document with a list of findings, or JSON lines; a field that it shouldn't have is refused, as a misspelt waiver would be lost."""
    known = {c.split()[0] for c in BASELINE.split(", ")}
    whole = spark.read.option("multiLine", True).json(path)
    if "findings" in whole.columns:
        odd = {c for c in whole.columns if not c.endswith("_version")} - HEADER - {"findings"}
        rows = whole.select(F.explode("findings").alias("f"))
        fields = set(rows.schema["f"].dataType.names) if rows.schema["f"].dataType.typeName() == "struct" else set()
        odd |= fields - known
        found = rows.select(*[(F.col(f"f.{c}") if c in fields else F.lit(None)).cast("string").alias(c) for c in BASELINE_FIELDS])
    else:
        odd = set(spark.read.json(path).columns) - known
        found = spark.read.schema(BASELINE).option("mode", "FAILFAST").json(path)
    if odd:
        raise ValueError(f"{path}: unknown fields {sorted(odd)}")
    return found


def retry_state(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of states, over as many lines as it likes."""
    return spark.read.schema(STATE).option("mode", "FAILFAST").option("multiLine", True).json(path)


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of JSON records, one a line; bad ones stop the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, order: list[str], limit: int | None = None) -> None:
    """Ordered CSV with a header; the limit is the report's."""
    out = df.orderBy(*order)
    (out.limit(limit) if limit else out).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def render_check(rendered: DataFrame, present: DataFrame) -> DataFrame:
    """(path, status) of rendered (path, body) against present files: missing, extra or edited by hand."""
    a = rendered.select("path", F.sha2("body", 256).alias("want"))
    b = present.select("path", F.sha2("body", 256).alias("have"))
    status = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").otherwise("edited")
    return a.join(b, "path", "full_outer").where("NOT (want <=> have)").select("path", status.alias("status"))
