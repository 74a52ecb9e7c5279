"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record is a variant of any layout: a list of messages, a prompt with its
answer, an instruction with its input, or a single turn.  The nested paths of
its fields, as far as any layout knows them, are sorted and hashed; the hash
selects the layout, a declarative mapping from fields to turns.  Fields that no
layout knows do not count.  Turns are written in a template that marks their
bounds; control strings inside roles and texts are escaped reversibly.  A mask
has the spans of the text to learn from, in code points of the output.

A record whose fingerprint is of no layout has a null layout and no turns, and
``unmapped`` counts such records by their paths.  Null text or role: empty.
Turns of a conversation come by their order column (nulls first), then by their
place in the record, then by role and text, so repeated rows and ties have a
defined order; each is a turn.  Rows without a conversation's id are one
conversation.  Empty tables give no rows.  ``formatted_turns`` has a row for
each turn, whatever a conversation's length; ``conversations`` has a string for
each conversation, which must fit into a row (2 GB).
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
#: Fixed: names of roles in layouts that have names of their own.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Levels of nesting that are looked at.
DEPTH = 4


@dataclass(frozen=True)
class Layout:
    """``each``: a list of turns with the fields ``role`` and ``text``; or ``role`` and ``text`` of the record itself; or ``fields``: (role, path) in order.

    Of ``optional`` fields any may be missing.  Texts of one role that follow each other in ``fields`` are one turn.
    """

    name: str
    each: str | None = None
    role: str | None = None
    text: str | None = None
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()

    @property
    def required(self) -> tuple[str, ...]:
        if self.fields:
            return tuple(p for _, p in self.fields if p not in self.optional)
        prefix = f"{self.each}[]." if self.each else ""
        return prefix + self.role, prefix + self.text

    def fingerprints(self) -> list[str]:
        """Of all sets of paths that the layout stands for."""
        subsets = itertools.chain.from_iterable(itertools.combinations(self.optional, n) for n in range(len(self.optional) + 1))
        return [hashlib.sha256("\n".join(sorted({*self.required, *s})).encode()).hexdigest() for s in subsets]


LAYOUTS = (
    Layout("messages", each="messages", role="role", text="content"),
    Layout("exchange", each="conversations", role="from", text="value"),
    Layout("turn", role="role", text="text"),
    Layout("prompt", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("completion", fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Layout("instruction", fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Layout("question", fields=(("user", "question"), ("assistant", "answer"))),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def field_paths(record: Column, prefix: Column | None = None, depth: int = DEPTH) -> Column:
    """Paths of the fields of a variant: names joined by dots, ``[]`` for the elements of a list."""
    end = (F.array() if prefix is None else F.array(prefix)).cast("array<string>")
    if not depth:
        return end
    name = lambda e: e["key"] if prefix is None else F.concat(prefix, F.lit("."), e["key"])
    listed = F.lit("[]") if prefix is None else F.concat(prefix, F.lit("[]"))
    inner = lambda fields: F.flatten(F.transform(F.map_entries(fields), lambda e: field_paths(e["value"], name(e), depth - 1)))
    each = lambda elements: F.array_distinct(F.flatten(F.transform(elements, lambda e: field_paths(e, listed, depth - 1))))
    elements = _let(F.try_variant_get(record, "$", "array<variant>"), lambda a: F.when(F.size(a) > 0, each(a)).otherwise(end))
    return _let(F.try_variant_get(record, "$", "map<string,variant>"), lambda m: F.when(F.size(m) > 0, inner(m)).otherwise(elements))


def known_paths(layouts: tuple[Layout, ...]) -> list[str]:
    return sorted({p for x in layouts for p in (*x.required, *x.optional)})


def fingerprint(paths: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of those paths that any layout knows."""
    return F.sha2(F.array_join(F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, known_paths(layouts))))), "\n"), 256)


def layout_of(print_: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Name of the layout of a fingerprint, or null; of two layouts with the same one the first."""
    names = {p: x.name for x in reversed(layouts) for p in x.fingerprints()}
    return F.get(F.filter(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(n).alias("n")) for p, n in names.items()]), lambda x: x["p"] == print_), F.lit(0))["n"]


def _path(name: str) -> str:
    return f"$.{name}"


def _turns(record: Column, layout: Layout) -> Column:
    """The turns of a record by a layout: array of (role, text)."""
    text = lambda v, name: F.coalesce(F.try_variant_get(v, _path(name), "string"), F.lit(""))
    turn = lambda role, body: F.struct(role.alias("role"), body.alias("text"))
    if layout.each:
        renamed = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
        role = lambda v: text(v, layout.role) if layout.role == "role" else F.coalesce(F.try_element_at(renamed, text(v, layout.role)), text(v, layout.role))
        return F.transform(F.try_variant_get(record, _path(layout.each), "array<variant>"), lambda v: turn(role(v), text(v, layout.text)))
    if layout.text:
        return F.array(turn(text(record, layout.role), text(record, layout.text)))
    turns = []
    for role, fields in itertools.groupby(layout.fields, key=lambda f: f[0]):
        paths = [p for _, p in fields]
        body = F.array_join(F.filter(F.array(*[text(record, p) for p in paths]), lambda x: x != ""), "\n\n")
        there = [F.lit(True) if p not in layout.optional else F.try_variant_get(record, _path(p), "variant").isNotNull() for p in paths]
        turns.append(F.when(F.greatest(*there) if len(there) > 1 else there[0], turn(F.lit(role), body)))
    return F.filter(F.array(*turns), lambda x: x.isNotNull())


def canonical(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with the columns layout (null if there is none), turns (array of role and text) and paths, for the variant column ``record``."""
    out = records.withColumn("paths", F.coalesce(field_paths(F.col(record)), F.array().cast("array<string>")))
    out = out.withColumn("layout", layout_of(fingerprint(F.col("paths"), layouts), layouts))
    turns = F.array().cast("array<struct<role:string,text:string>>")
    for x in layouts:
        turns = F.when(F.col("layout") == x.name, _turns(F.col(record), x)).otherwise(turns)
    return out.withColumn("turns", turns)


def unmapped(found: DataFrame) -> DataFrame:
    """(paths, records) of what ``canonical`` has no layout for."""
    return found.where(F.col("layout").isNull()).groupBy(F.array_sort("paths").alias("paths")).agg(F.count("*").alias("records"))


# Any run of backslashes between "<" and "|" gets one more, so no control string can stand in an escaped text.


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Also without line breaks, which end a role."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def formatted_turns(found: DataFrame, key: str, order: str, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(key, n, segment, at, loss): the output of each turn, its place in the conversation's output, and the span to learn from or null.

    ``found`` is of ``canonical``; the segments of a conversation, in the order of n, are its output.
    """
    # an outer explode, as the filter of an inner one would make the turns twice
    rows = found.select(F.col(key).alias("key"), F.col(order).alias("order"), F.posexplode_outer("turns").alias("place", "turn")).where("place is not null").select("key", "order", "place", "turn.role", "turn.text")
    role, body = escape_role(F.col("role")), escape(F.col("text"))
    rows = rows.withColumn("head", F.concat(F.lit(START), role, F.lit("\n"))).withColumn("body", body)
    rows = rows.withColumn("segment", F.concat("head", "body", F.lit(END + "\n")))
    by = Window.partitionBy("key").orderBy(F.asc_nulls_first("order"), "place", "role", "text")
    rows = rows.withColumn("n", F.row_number().over(by)).withColumn("at", F.coalesce(F.sum(F.length("segment")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = F.col("at") + F.length("head")
    loss = F.when(F.col("role").isin(*learn), F.struct(start.alias("start"), (start + F.length("body")).alias("end")))
    return rows.select("key", "n", "segment", "at", loss.alias("loss"))


def conversations(turns: DataFrame) -> DataFrame:
    """(key, formatted, loss_mask): one output for each conversation, and the spans to learn from."""
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("n", "segment"))), lambda x: x["segment"])
    return turns.groupBy("key").agg(F.array_join(pieces, "").alias("formatted"), F.sort_array(F.collect_list("loss")).alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(key, n, role, text, learned): the turns in the output of ``conversations``, and the text under the mask or null."""
    parts = F.split("formatted", r"<\|im_start\|>", -1)
    rows = formatted.select("key", F.posexplode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("n", "part"))
    before = Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("part") + len(START)).over(before), F.lit(0)) + len(START))
    rows = rows.withColumn("head", F.substring_index("part", "\n", 1)).withColumn("start", F.col("at") + F.length("head") + 1)
    spans = formatted.select(F.col("key").alias("span_key"), F.inline("loss_mask")).withColumnRenamed("start", "span_start")
    rows = rows.join(spans, F.col("key").eqNullSafe(F.col("span_key")) & (F.col("start") == F.col("span_start")), "left")
    text = F.substring("part", F.length("head") + 2, F.length("part") - F.length("head") - len(END) - 2)
    learned = F.substring("part", F.col("span_start") - F.col("at") + 1, F.col("end") - F.col("span_start"))
    return rows.select("key", "n", unescape_role(F.col("head")).alias("role"), unescape(text).alias("text"), F.when(F.col("end").isNotNull(), unescape(learned)).alias("learned"))


def digests(formatted: DataFrame, key: str) -> DataFrame:
    """For each conversation its turns and the text under its mask, read back from the output, as digests."""
    turns = F.sort_array(F.collect_list(F.struct("n", "role", "text", "learned")))
    rows = read_back(formatted).groupBy("key").agg(turns.alias("turns"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("turns", lambda x: F.coalesce(x["learned"], F.lit(""))), "")
    read = rows.select(F.col("key").alias("read_key"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), learned.alias("learned"))
    out = formatted.select("key", F.length("formatted").cast("long").alias("formatted_chars")).join(read, F.col("key").eqNullSafe(F.col("read_key")))
    return out.select(F.col("key").alias(key), "n_turns", "turns_sha256", F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


def rows_as_records(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, record) of a table with a row for each turn."""
    return rows.select("conv_id", "turn", F.to_variant_object(F.struct("role", "text")).alias("record"))
