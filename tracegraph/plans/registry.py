"""The type registry: what kinds of documents there are, what fields they need, and the gate over a tree.

A registry is a dictionary (read from YAML or JSON by the caller): types, aliases, unresolved, enums, links, defaults. It is small by nature and
becomes literal expressions and broadcast tables; documents stay distributed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns
from ..operators import findings as fd


@dataclass(frozen=True)
class Kind:
    """A document type."""

    required: tuple[str, ...] = ()
    retired: bool = False
    retired_fields: tuple[str, ...] = ()
    sections: tuple[str, ...] = ()
    enums: dict[str, str] = field(default_factory=dict)  #: field to enum
    stage: str = "shadow"
    key_source: str = ""
    key: tuple[str, ...] = ()


@dataclass(frozen=True)
class Enum:
    """Legal values, and old ones with what they became. An open one is not checked."""

    values: frozenset[str] = frozenset()
    migrated: dict[str, str] = field(default_factory=dict)
    open: bool = False


@dataclass(frozen=True)
class Registry:
    types: dict[str, Kind]
    aliases: dict[str, str] = field(default_factory=dict)
    alias_fields: dict[str, dict[str, str]] = field(default_factory=dict)  #: alias to the fields that its name stood for
    unresolved: frozenset[str] = frozenset()
    enums: dict[str, Enum] = field(default_factory=dict)
    pins: dict[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()

    def resolve(self, name: str) -> tuple[str, str]:
        """(type, status): canonical, alias, alias-target-missing, unresolved or unknown."""
        if name in self.types:
            return name, "canonical"
        if name in self.aliases:
            to = self.aliases[name]
            return (to, "alias") if to in self.types else ("", "alias-target-missing")
        return "", "unresolved" if name in self.unresolved else "unknown"

    def implied(self, name: str) -> dict[str, str]:
        """Fields that an alias fixes, so that renaming a document to its type loses nothing."""
        return self.alias_fields.get(name, {})

    def required_for(self, name: str) -> list[str]:
        """Fields a type needs; version, time and what its file name carries are left out."""
        kind = self.types[name]
        carried = set(kind.key) if kind.key_source == "filename" else set()
        return sorted({*self.required, *kind.required} - {"version", "timestamp"} - carried)

    def check_enum(self, enum: str, value: str) -> str:
        """ok, migratable, illegal or unchecked."""
        e = self.enums.get(enum)
        if e is None or e.open:
            return "unchecked"
        return "ok" if value in e.values else "migratable" if value in e.migrated else "illegal"

    def pin(self, link: str) -> str:
        return self.pins.get(link, "as_of")


def load(path: str) -> Registry:
    """A registry of a YAML or JSON file, or of the files of a folder taken together.

    types: name to required, retired, retired_fields, sections, enums, stage, key_source and key; aliases: name to a type, or to its canonical type and the
    fields to set; enums: name to values, migrated and open; further unresolved, pins and required. A key that isn't one of these is refused.
    """
    from pathlib import Path

    found: dict = {}
    files = sorted(p for p in ([Path(path)] if Path(path).is_file() else Path(path).iterdir()) if p.suffix in (".yaml", ".yml", ".json"))
    if not files:
        raise ValueError(f"{path} holds no registry")
    for p in files:
        if p.suffix == ".json":
            import json

            part = json.loads(p.read_text())
        else:
            import yaml

            part = yaml.safe_load(p.read_text()) or {}
        for key, value in part.items():
            if isinstance(value, dict):
                found.setdefault(key, {}).update(value)
            else:
                found.setdefault(key, []).extend(value)
    odd = set(found) - {"types", "aliases", "unresolved", "enums", "pins", "required"}
    if odd:
        raise ValueError(f"{path}: unknown keys {sorted(odd)}")
    tuples = lambda x: {k: tuple(v) if isinstance(v, list) else v for k, v in (x or {}).items()}
    aliases = {a: to if isinstance(to, dict) else {"canonical": to} for a, to in found.get("aliases", {}).items()}
    enums = {k: Enum(frozenset(v.get("values", ())), v.get("migrated", {}), v.get("open", False)) for k, v in found.get("enums", {}).items()}
    return Registry({k: Kind(**tuples(v)) for k, v in found.get("types", {}).items()}, {a: to["canonical"] for a, to in aliases.items()}, {a: to["set"] for a, to in aliases.items() if to.get("set")}, frozenset(found.get("unresolved", ())), enums, found.get("pins", {}), tuple(found.get("required", ())))


def gate(docs: DataFrame, registry: Registry) -> DataFrame:
    """Findings over documents (path, body, fields) that have a document_type. An absent field is missing, a present one without a value empty.

    docs without a typed document give one finding, as an empty corpus must not look clean.
    """
    spark = docs.sparkSession
    typed = docs.select("path", "body", "fields", F.col("fields")["document_type"]["scalar"].alias("type")).where("coalesce(type, '') <> ''")
    known = sorted({*registry.types, *registry.aliases, *registry.unresolved})
    resolved = spark.createDataFrame([(n, *registry.resolve(n)) for n in known], "type string, kind string, status string")
    own = typed.join(F.broadcast(resolved), "type", "left").withColumns({"kind": F.coalesce("kind", F.lit("")), "status": F.coalesce("status", F.lit("unknown"))})
    subject = F.concat_ws(" -> ", "path", "type")
    parts = [
        fd.findings(own.where("status IN ('unknown', 'unresolved')"), "type.unknown", subject, "type"),
        fd.findings(own.where("status = 'alias-target-missing'"), "registry.alias-target-missing", subject, "integrity"),
        fd.findings(own.where(F.col("kind").isin([k for k, v in registry.types.items() if v.retired])), "type.retired", subject, "type"),
    ]
    rules = [(k, f, "required") for k in registry.types for f in registry.required_for(k)] + [(k, f, "retired") for k, v in registry.types.items() for f in v.retired_fields]
    fields = own.join(F.broadcast(spark.createDataFrame(rules, "kind string, field string, rule string")), "kind").withColumn("f", F.col("fields")[F.col("field")])
    bare = F.col("f").isNotNull() & (F.col("f.scalar") == "") & (F.size("f.items") == 0)
    what = F.when((F.col("rule") == "required") & F.col("f").isNull(), "field.missing").when((F.col("rule") == "required") & bare, "field.empty").when((F.col("rule") == "retired") & F.col("f").isNotNull(), "field.retired")
    parts.append(fd.findings(fields.withColumn("what", what).where("what IS NOT NULL"), F.concat_ws(":", "what", "field"), F.col("path"), "type"))
    checks = [(k, f, v, registry.check_enum(e, v)) for k, kind in registry.types.items() for f, e in kind.enums.items() for v in [*registry.enums.get(e, Enum()).values, *registry.enums.get(e, Enum()).migrated]]
    watched = [(k, f) for k, kind in registry.types.items() for f, e in kind.enums.items() if e in registry.enums and not registry.enums[e].open]
    if watched:
        v = own.join(F.broadcast(spark.createDataFrame(watched, "kind string, field string")), "kind").select("path", "kind", "field", F.col("fields")[F.col("field")]["scalar"].alias("value")).where("value <> ''")
        v = v.join(F.broadcast(spark.createDataFrame(checks, "kind string, field string, value string, verdict string")), ["kind", "field", "value"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("illegal")))
        parts.append(fd.findings(v.where("verdict <> 'ok'"), F.concat(F.lit("enum."), F.col("verdict"), F.lit(":"), F.col("field")), F.concat_ws(" -> ", "path", "value"), "type"))
    cut = own.select("path", "kind", "body", columns.sections(F.col("body")).alias("s"))
    wanted = [(k, h) for k, kind in registry.types.items() for h in kind.sections]
    if wanted:
        missing = cut.join(F.broadcast(spark.createDataFrame(wanted, "kind string, heading string")), "kind").where(~F.exists("s", lambda x: F.lower(x["heading"]) == F.lower(F.col("heading"))))
        parts.append(fd.findings(missing, F.concat(F.lit("section.missing:"), F.col("heading")), F.col("path"), "type"))
    parts.append(fd.findings(cut.where(F.array_join("s.body", "") != F.col("body")), "invariant.section-partition-lossy", F.col("path"), "integrity"))
    none = typed.agg(F.count("*").alias("n")).where("n = 0")
    return fd.union([*parts, fd.findings(none, "registry.corpus-empty", F.lit("no typed document"), "integrity")])
