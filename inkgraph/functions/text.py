"""Scalar text functions, all native Spark expressions.

White space is Unicode white space and letters are Unicode alphabetic, as
Spark's own ``trim`` knows the blank alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A character that is no letter and no number, in Java's syntax.
NOT_ALNUM = r"[^\p{IsAlphabetic}\p{N}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def key_of(c: Column | str) -> Column:
    """The form in which titles, aliases and tags are compared."""
    return F.lower(col(c))


def terms(c: Column | str) -> Column:
    """Lower-cased runs of letters and numbers, as an array."""
    return F.filter(F.split(F.lower(col(c)), NOT_ALNUM + "+"), lambda t: t != "")


def github_slug(c: Column | str) -> Column:
    """Heading slug: letters, numbers and dashes; blanks become dashes, dashes at the ends go."""
    kept = F.regexp_replace(F.lower(col(c)), r"[^\p{IsAlphabetic}\p{N}\- \t]", "")
    return F.regexp_replace(F.translate(kept, " \t", "--"), "^-+|-+$", "")


def render_slug(c: Column | str) -> Column:
    """Heading id of the HTML view: underscores stay and dashes at the ends stay."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"[^\w\s-]", ""), r"\s+", "-")


def kebab(c: Column | str) -> Column:
    """ASCII letters and digits in lower case, all else a single dash; a leading ``1. `` or ``2) `` is dropped."""
    plain = F.regexp_replace(col(c), r"(?U)^\s*[0-9]+[.)] ", "")
    return F.lower(F.regexp_replace(F.regexp_replace(plain, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))


def strip_links(c: Column | str) -> Column:
    """``[text](target)`` becomes ``text``."""
    return F.regexp_replace(col(c), r"\[([^\]]+)\]\([^)]*\)", "$1")


def lines(c: Column | str) -> Column:
    """Lines without their ends; no empty line after a final line break."""
    parts = F.transform(F.split(col(c), "\n", -1), lambda x: F.regexp_replace(x, "\r$", ""))
    return F.when((col(c) == "") | col(c).endswith("\n"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_count(c: Column | str) -> Column:
    text = col(c)
    return F.size(F.split(text, "\n", -1)) - F.when((text == "") | text.endswith("\n"), 1).otherwise(0)


def title_case(c: Column | str) -> Column:
    """``broken_link`` becomes ``Broken Link``."""
    return F.initcap(F.replace(col(c), F.lit("_"), F.lit(" ")))


def normal_path(c: Column | str) -> Column:
    """A path without ``.``, empty and ``..`` parts; ``..`` at the top is dropped."""
    parts = F.filter(F.split(col(c), "/"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")
    return F.array_join(F.aggregate(parts, empty, lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p)))), "/")


def parent(c: Column | str) -> Column:
    """Directory of a path; empty at the top."""
    return F.regexp_extract(col(c), r"^(.*)/[^/]*$", 1)


def resolve_path(link: Column | str, page: Column | str) -> Column:
    """The repository path of a link on a page: from the top if it starts with a slash, else from the page's directory."""
    return F.when(col(link).startswith("/"), normal_path(link)).otherwise(normal_path(F.concat_ws("/", parent(page), col(link))))


def is_bare(path: Column | str) -> Column:
    """Neither absolute nor explicitly relative."""
    return ~(col(path).startswith("/") | col(path).rlike(r"^\.\.?(/|$)"))


def looks_like_path(c: Column | str) -> Column:
    return col(c).contains("/") | col(c).endswith(".md")


def match_fraction(tokens: list[str], *texts: Column | str) -> Column:
    """Share of the tokens that occur in the texts taken together."""
    if not tokens:
        return F.lit(0.0)
    whole = F.lower(F.concat_ws("\n", *[col(t) for t in texts]))
    return sum((F.when(F.contains(whole, F.lit(t)), 1).otherwise(0) for t in tokens), F.lit(0)) / float(len(tokens))


def relative_href(target: Column | str, page: Column | str) -> Column:
    """Relative path from a page's directory to a target; ``./`` unless it climbs."""
    to, base = F.split(col(target), "/"), F.when(parent(page) == "", F.array().cast("array<string>")).otherwise(F.split(parent(page), "/"))
    shared = F.aggregate(F.sequence(F.lit(0), F.size(base)), F.lit(0), lambda n, i: F.when((n == i) & F.coalesce(F.get(to, i) == F.get(base, i), F.lit(False)) & (i < F.size(to) - 1), n + 1).otherwise(n))
    rel = F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(base) - shared), F.slice(to, shared + 1, F.size(to))), "/")
    return F.when(rel.startswith(".."), rel).otherwise(F.concat(F.lit("./"), rel))


def rewritten_href(href: Column | str, target: Column | str, page: Column | str) -> Column:
    """An href that points at ``target`` in the style of the old one, with its fragment."""
    path = F.when(col(href).startswith("/"), F.concat(F.lit("/"), col(target))).otherwise(relative_href(target, page))
    return F.when(F.contains(col(href), F.lit("#")), F.concat(path, F.regexp_extract(col(href), r"^[^#]*(#.*)$", 1))).otherwise(path)
