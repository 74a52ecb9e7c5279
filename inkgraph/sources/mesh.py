"""Coverage data in text forms, parsed with native expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMPTY = "no meshes"


def parse_anchors(lines: DataFrame) -> DataFrame:
    """(mesh, path, start_line, end_line) from lines (value) ``mesh<TAB>path<TAB>start-end``; a mesh's name may hold tabs.

    Blank lines and the line that says there are none are skipped; any other line fails the query.
    """
    rule = r"^(.*)\t([^\t]*)\t([0-9]+)-([0-9]+)$"
    rows = lines.where((F.trim("value") != "") & (F.trim("value") != EMPTY))
    value = F.when(F.col("value").rlike(rule), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("bad coverage row: "), F.col("value"))))
    part = lambda i: F.regexp_extract("v", rule, i)
    return rows.select(value.alias("v")).select(part(1).alias("mesh"), part(2).alias("path"), part(3).cast("int").alias("start_line"), part(4).cast("int").alias("end_line"))


_SPAN = "struct<path:string,extent:struct<start:int,end:int>>"
_FINDINGS = f"struct<findings:array<struct<status:struct<code:string>,mesh:string,anchored:{_SPAN},moved_to:{_SPAN}>>>"


def parse_drift(documents: DataFrame) -> DataFrame:
    """(code, mesh, path, start_line, end_line, new_path, new_start, new_end) from JSON documents (value)."""
    found = documents.select(F.explode(F.from_json("value", _FINDINGS)["findings"]).alias("f"))
    at = lambda c, p: [F.col(f"f.{c}.path").alias(p[0]), F.col(f"f.{c}.extent.start").alias(p[1]), F.col(f"f.{c}.extent.end").alias(p[2])]
    return found.select(F.col("f.status.code").alias("code"), "f.mesh", *at("anchored", ("path", "start_line", "end_line")), *at("moved_to", ("new_path", "new_start", "new_end")))


def parse_renames(lines: DataFrame) -> DataFrame:
    """(old, new) from lines (value) ``R100<TAB>old<TAB>new``."""
    parts = F.split("value", "\t")
    return lines.where(F.col("value").rlike("^R[0-9]*\t[^\t]+\t[^\t]+$")).select(parts[1].alias("old"), parts[2].alias("new"))


def read_log(source: DataFrame) -> DataFrame:
    """Log events from JSON lines (value): timestamp_ms, invocation_id, pid, event, duration_ms, status, meta (JSON)."""
    schema = "struct<timestamp_ms:long,invocation_id:string,pid:int,event:string,duration_ms:double,status:string>"
    return source.select(F.from_json("value", schema).alias("e"), F.get_json_object("value", "$.meta").alias("meta")).select("e.*", "meta")
