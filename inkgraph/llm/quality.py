"""Quality rules by distribution divergence, in DataFrame functions only.

Each text is counted once: words, repeated lines and word windows, a histogram
of character classes and one of the common words of its language.  The
references are the summed histograms of all texts of a language that pass the
base rules.  A text is rejected if its Jensen-Shannon distance to the
reference is over a threshold; a histogram with too few entries is not judged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Frequent function words of the languages that have a word reference.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to a in is that it for on was with as be by this at are from".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur".split(),
}
#: Name of the reference for texts of all other languages; it has no word histogram.
OTHER = "other"

#: A histogram of fewer entries is not judged; the distances leave room for the noise of short texts.
CHAR_DISTANCE, MIN_CHARS = 0.30, 200
WORD_DISTANCE, MIN_COMMON_WORDS = 0.40, 100

CLASSES = ["space", "upper", "digit", "symbol", "punctuation", "letter"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _kept_chars(text: Column, pattern: str) -> Column:
    """Number of characters of the class ``[pattern]``."""
    return F.length(F.regexp_replace(text, f"[^{pattern}]+", ""))


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""
    n = F.size(words)
    window = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    places = F.sequence(F.lit(0), n - 3)

    def marked(s: Column) -> Column:
        near = lambda x, j: F.coalesce(F.get(s, j)["w"] == x["w"], F.lit(False))
        found = F.filter(s, lambda x, j: near(x, j - 1) | near(x, j + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    exact = _let(F.sort_array(F.transform(places, lambda i: F.struct(window(i).alias("w"), i.alias("i")))), marked)
    hashes = F.transform(places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    unique = _let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))  # distinct hashes: distinct windows
    return F.when(n < 4, 0).when(unique, 0).otherwise(exact)


def features(docs: DataFrame) -> DataFrame:
    """Counts and histograms of each row of ``docs``; null text has none."""
    profile = F.when(F.col("lang").isin(list(COMMON_WORDS)), F.col("lang")).otherwise(OTHER)
    listed = F.coalesce(*[F.when(F.col("profile") == k, F.array(*map(F.lit, v))) for k, v in COMMON_WORDS.items()], F.array().cast("array<string>"))
    out = docs.select("doc_id", profile.alias("profile"), F.coalesce("text", F.lit("")).alias("t"))
    out = out.withColumns({"listed": listed, "words": F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), ""), "letters": F.array_remove(F.split(F.lower("t"), r"[^\p{L}]+"), "")})
    out = out.withColumn("common", F.filter("letters", lambda w: F.array_contains(F.col("listed"), w)))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    chars, symbols = _kept_chars(F.col("t"), r"\x20\x09-\x0D"), _kept_chars(F.col("t"), r"#*$%&|<>")
    out = out.select(
        "doc_id",
        "profile",
        F.size("words").cast("long").alias("n_words"),
        F.length("t").cast("long").alias("n_chars"),
        chars.cast("long").alias("n_space"),
        symbols.cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        _kept_chars(F.col("t"), "A-Z").cast("long").alias("n_upper"),
        _kept_chars(F.col("t"), "0-9").cast("long").alias("n_digit"),
        _kept_chars(F.col("t"), r"!\"'()+,\-./:;=?@\[\\\]^_`{}~").cast("long").alias("n_punctuation"),
        F.size("letters").cast("long").alias("n_letter_words"),
        F.transform("listed", lambda c: (F.size("common") - F.size(F.array_remove(F.col("common"), c))).cast("long")).alias("common_counts"),
    )
    word_chars = F.col("n_chars") - F.col("n_space")
    letter = word_chars - F.col("n_upper") - F.col("n_digit") - F.col("n_symbols") - F.col("n_punctuation")
    out = out.withColumns({
        "word_chars": word_chars,
        "char_counts": F.array("n_space", "n_upper", "n_digit", "n_symbols", "n_punctuation", letter),
        "word_counts": F.concat("common_counts", F.array(F.col("n_letter_words") - F.aggregate("common_counts", F.lit(0).cast("long"), lambda a, b: a + b))),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })
    return out.drop("n_upper", "n_digit", "n_punctuation", "common_counts", "n_space")


def references(counted: DataFrame) -> DataFrame:
    """Summed histograms of the texts that pass the base rules: one row for each profile, of which there are ``len(COMMON_WORDS) + 1``."""
    slots = max(len(w) for w in COMMON_WORDS.values()) + 1
    total = lambda name, n: F.array(*[F.coalesce(F.sum(F.get(name, F.lit(i))), F.lit(0)) for i in range(n)]).alias(f"ref_{name}")
    return counted.where(~F.col("base_failed")).groupBy("profile").agg(total("char_counts", len(CLASSES)), total("word_counts", slots))


def jensen_shannon(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms; null if either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def of(sums: Column) -> Column:
        pair = F.zip_with(counts, F.slice(reference, F.lit(1), F.size(counts)), lambda a, b: F.struct((a / sums[0]).alias("p"), (b / sums[1]).alias("q")))
        terms = F.transform(pair, lambda x: part(x["p"], (x["p"] + x["q"]) / 2) + part(x["q"], (x["p"] + x["q"]) / 2))
        return F.when((sums[0] > 0) & (sums[1] > 0), F.sqrt(F.greatest(F.lit(0.0), total(terms) / 2)))

    return _let(F.array(total(counts), total(reference)), of)


def judge(docs: DataFrame, char_distance: float = CHAR_DISTANCE, min_chars: int = MIN_CHARS, word_distance: float = WORD_DISTANCE, min_common_words: int = MIN_COMMON_WORDS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, lang) with its counts, distances and verdict.

    Null text counts as empty and fails the base rules; a null or unlisted language is compared
    with the texts of all such languages by character classes alone.  Repeated rows are judged
    alike; an empty table gives an empty result; other columns are not looked at.  Texts are read
    once; only counts are written and joined.
    """
    counted = written(features(docs), "quality")
    out = counted.join(F.broadcast(references(counted)), "profile", "left")
    chars = F.when(F.col("n_chars") >= min_chars, jensen_shannon(F.col("char_counts"), F.col("ref_char_counts")))
    words = F.when((F.col("n_letter_words") >= min_common_words) & (F.size("word_counts") > 1), jensen_shannon(F.col("word_counts"), F.col("ref_word_counts")))
    out = out.withColumns({"char_distance": F.round(chars, 6), "word_distance": F.round(words, 6)})
    far = (F.coalesce("char_distance", F.lit(0.0)) > char_distance) | (F.coalesce("word_distance", F.lit(0.0)) > word_distance)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "char_distance", "word_distance")
