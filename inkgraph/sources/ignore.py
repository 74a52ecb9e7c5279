"""Ignore rules of a tree of files, as joins: rules by directory and order, the last match wins, ignored directories are pruned.

Rules have dir (the directory of the file that they stand in; empty at the top), ord (their place in it) and
pattern.  Blank patterns and those that start with ``#`` are none.  ``!`` takes back; a slash at the end means
directories alone; a slash elsewhere ties a pattern to ``dir``, else it may match at any depth below it.  ``*`` and
``?`` stop at slashes, ``**`` does not; ``[...]`` is a set and a backslash takes the next character as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def compiled(rules: DataFrame) -> DataFrame:
    """(dir, depth, ord, again, dirs_only, regex) of the rules that say something."""
    rows = rules.withColumn("p", F.regexp_replace("pattern", r"(?<!\\)[ \t\r]+$", "")).where("p is not null and p <> '' and not startswith(p, '#')")
    rows = rows.withColumn("again", F.col("p").startswith("!")).withColumn("p", F.regexp_replace("p", "^!", ""))
    rows = rows.withColumn("dirs_only", F.col("p").endswith("/")).withColumn("p", F.regexp_replace("p", "/+$", ""))
    rows = rows.withColumn("tied", F.contains("p", F.lit("/"))).withColumn("p", F.regexp_replace("p", "^/", "")).where("p <> ''")
    body = F.regexp_replace("p", r"\\(.)", "\x01$1")  # what follows is taken as it is
    body = F.regexp_replace(body, r"(?<!\x01)\[!", "[^")
    for find, mark in ((r"(?<!\x01)(^|/)\*\*/", "$1\x02"), (r"/\*\*$", "/\x03"), (r"(?<!\x01)\*+", "\x04"), (r"(?<!\x01)\?", "\x05")):
        body = F.regexp_replace(body, find, mark)
    body = F.regexp_replace(body, r"\x01(.)", r"\\Q$1\\E")
    body = F.regexp_replace(body, r"(?<!\\Q)([.+$(){}|])", r"\\$1")
    for mark, regex in (("\x02", "(?:.*/)?"), ("\x03", ".+"), ("\x04", "[^/]*"), ("\x05", "[^/]")):
        body = F.replace(body, F.lit(mark), F.lit(regex))
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    return rows.select("dir", depth.alias("depth"), "ord", "again", "dirs_only", F.concat(F.when(F.col("tied"), "^").otherwise("^(?:.*/)?"), body, F.lit("$")).alias("regex"))


def _above(path: str) -> Column:
    """The directories that a path is in, from the top."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def matched(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, is_dir) of the nodes that their last matching rule ignores; directories above are not looked at.

    Rules of deeper directories come after those above them.
    """
    rows = nodes.select("path", "is_dir", F.explode(_above("path")).alias("dir")).join(compiled(rules), "dir")
    rows = rows.withColumn("rest", F.when(F.col("dir") == "", F.col("path")).otherwise(F.expr("substring(path, length(dir) + 2)")))
    rows = rows.where((~F.col("dirs_only") | F.col("is_dir")) & F.expr("rest rlike regex"))
    last = rows.groupBy("path", "is_dir").agg(F.max(F.struct("depth", "ord", "again")).alias("last"))
    return last.where(~F.col("last.again")).select("path", "is_dir")


def walk(files: DataFrame, rules: DataFrame) -> DataFrame:
    """The files (path, others) that no rule ignores; what is below an ignored directory cannot be taken back.

    Each directory is judged once, and a file is joined to the ignored ones among those above it.
    """
    paths = files.select("path").distinct()
    dirs = paths.select(F.explode(_above("path")).alias("path")).where("path <> ''").distinct()
    gone = matched(dirs.withColumn("is_dir", F.lit(True)), rules).select(F.col("path").alias("dir"))
    below = paths.select("path", F.explode(_above("path")).alias("dir")).join(gone, "dir", "left_semi").select("path")
    ignored = matched(paths.withColumn("is_dir", F.lit(False)), rules).select("path").unionByName(below)
    return files.join(ignored.distinct(), "path", "left_anti")


def rules_of(files: DataFrame, name: str = ".gitignore") -> DataFrame:
    """(dir, ord, pattern) of the rule files among files (path, content)."""
    rows = files.where((F.col("path") == name) | F.col("path").endswith(f"/{name}"))
    return rows.select(T.parent("path").alias("dir"), F.posexplode(F.split("content", "\n", -1)).alias("ord", "pattern"))
