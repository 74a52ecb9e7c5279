"""Frontmatter: the YAML block at the head of a page.

The block is found with native expressions.  YAML itself needs a parser, so one
Arrow UDF turns a batch of blocks into structs; it sees the block alone, never
the body.
"""

from __future__ import annotations

from typing import Any

import pyarrow as pa
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Fixed: titles that would clash with commands.
RESERVED_TITLES = ["check", "pin", "stale", "links", "list", "summary", "print"]

#: Fixed messages of the validation errors.
MESSAGES = {
    "missing_title": "Add a `title` field.",
    "empty_title": "`title` must be a non-empty string.",
    "invalid_title": "`title` must be a string.",
    "invalid_aliases": "`aliases` must be an array of non-empty strings.",
    "invalid_tags": "`tags` must be an array of non-empty strings.",
    "invalid_keywords": "`keywords` must be an array of non-empty strings.",
    "missing_summary": "Add a `summary` field — a one-line description of the page.",
    "empty_summary": "`summary` must be a non-empty string.",
    "invalid_summary": "`summary` must be a string.",
    "yaml": "Fix the YAML syntax error: {}",
    "reserved_title": "`{}` is a reserved command name. Choose a different title.",
}

SCHEMA = "title string, summary string, aliases array<string>, tags array<string>, keywords array<string>, error string, message string"
_TYPE = pa.struct([("title", pa.string()), ("summary", pa.string()), ("aliases", pa.list_(pa.string())), ("tags", pa.list_(pa.string())), ("keywords", pa.list_(pa.string())), ("error", pa.string()), ("message", pa.string())])


def yaml_block(content: Column | str) -> Column:
    """Text between the fences, or null: line breaks before the first fence are skipped and either line end will do."""
    # an empty block is told from a missing one by the first pattern
    fenced = col(content).rlike(r"^\n*---\r?\n(?s:.*?)(?m:^---\r?$)")
    return F.when(fenced, F.regexp_extract(col(content), r"^\n*---\r?\n((?s:.*?))(?m:^---\r?$)", 1))


def markdown_body(content: Column | str) -> Column:
    """What follows the block, by a stricter rule: the page must start with the fence and a bare line break; else the whole page."""
    rule = r"^---\n((?s:.*?))\n---\r?\n"
    return F.when(col(content).rlike(rule), F.regexp_replace(col(content), rule, "")).otherwise(col(content))


class _Loader(yaml.SafeLoader):
    """YAML 1.2 scalars: dates and the words yes, no, on, off stay strings."""


_Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t not in ("tag:yaml.org,2002:timestamp", "tag:yaml.org,2002:bool")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
for _first in "tTfF":
    _Loader.yaml_implicit_resolvers.setdefault(_first, []).append(("tag:yaml.org,2002:bool", __import__("re").compile("^(?:true|True|TRUE|false|False|FALSE)$")))


def _fail(error: str, *args: str) -> dict[str, Any]:
    return {"error": error, "message": MESSAGES[error].format(*args)}


def parse_block(block: str | None) -> dict[str, Any] | None:
    """Fields of a block, or its first error; None without a block."""
    if block is None:
        return None
    try:
        raw = yaml.load(block, _Loader)
    except (yaml.YAMLError, ValueError) as e:
        return _fail("yaml", " ".join(str(e).split()))
    if raw is None:
        raw = {}
    if not isinstance(raw, dict):
        return _fail("yaml", "expected a mapping")
    for name in ("title", "summary"):
        value = raw.get(name)
        if value is None:
            error = f"missing_{name}"
        elif not isinstance(value, str):
            error = f"invalid_{name}"
        elif not value:
            error = f"empty_{name}"
        else:
            error = ""
        if name == "title":
            if error:
                return _fail(error)
            if value.lower() in RESERVED_TITLES:
                return _fail("reserved_title", value)
            for many in ("aliases", "tags", "keywords"):
                given = raw.get(many)
                if given is not None and not (isinstance(given, list) and all(isinstance(x, str) and x for x in given)):
                    return _fail(f"invalid_{many}")
        elif error:
            return _fail(error)
    return {"title": raw["title"], "summary": raw["summary"], **{k: raw.get(k) or [] for k in ("aliases", "tags", "keywords")}}


def parse_frontmatter(content: Column | str) -> Column:
    """Struct of title, summary, aliases, tags, keywords, error and message; null without a block.

    Errors come in the order title, reserved title, aliases, tags, keywords, summary.
    """

    @F.arrow_udf(SCHEMA)
    def parse(block: pa.Array) -> pa.Array:
        return pa.array([parse_block(x) for x in block.to_pylist()], _TYPE)

    return parse(yaml_block(content))


def is_member(frontmatter: Column) -> Column:
    """Whether a parsed page belongs to the corpus."""
    return frontmatter.isNotNull() & frontmatter["error"].isNull()


def proposal_error(content: Column | str) -> Column:
    """Class of a page that no proposals are made for: its title is there but empty, or the block never ends; null if fine."""
    text = F.regexp_replace(col(content), "^\n+", "")
    opened = text.rlike(r"^---\r?\n")
    title = F.regexp_extract(yaml_block(content), r"(?m)^title:[ \t]*(.*?)[ \t]*\r?$", 1)
    has_title = yaml_block(content).rlike(r"(?m)^title:")
    return F.when(col(content).isNull(), "unreadable").when(opened & yaml_block(content).isNull(), "malformed").when(has_title & F.regexp_replace(title, r"^(['\"])(.*)\1$", "$2").isin("", "''", '""'), "empty_title")


def field_of(content: Column | str, name: str) -> Column:
    """A ``name: value`` line of the block, without YAML: as editors and hooks read it."""
    value = F.regexp_extract(yaml_block(content), rf"(?m)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1)
    return F.nullif(F.regexp_replace(value, r"^(['\"])(.*)\1$", "$2"), F.lit(""))
