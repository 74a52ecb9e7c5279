"""License scans by diagonal voting, in DataFrame functions only.

Every rolling word k-gram of every text is hashed and joined to the positions
of the same k-gram in short notice templates.  A hit votes for a diagonal
(place in the text minus place in the template).  Votes are summed by text,
template and diagonal, neighbouring diagonals (a word added or left out) are
merged, and a merged span counts if it covers enough of its template.

Templates are a parameter of fixed size and are broadcast; texts are never
shuffled, only hits are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that count wherever their words stand consecutively.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

#: Notices found also with a few words changed.
TEMPLATES = [
    ("agpl", "under the terms of the gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "licensed under the creative commons attribution license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "dedicated to the public domain under cc0"),
    ("gpl", "licensed under the gnu general public license version"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("lgpl", "licensed under the gnu lesser general public license version"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
]

K = 2
#: Diagonals at most so far apart belong to one span.
GAP = 2
#: Words by which a span may be longer than its template.
DRIFT = 6
#: Share of a template's words that a span must cover.
COVERAGE = 0.75


def lowered(text: Column) -> Column:
    """A-Z lower-cased, nothing else changed.

    ``lower`` maps two other characters onto ASCII letters; texts that hold them take the slower way.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.rlike("[İK]"), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def _templates(spark: SparkSession, base: list, templates: list, k: int) -> DataFrame:
    rows, number = [], 0
    for exact, group in ((True, base), (False, templates)):
        for label, text in group:
            words = text.split()
            if len(words) < k:
                raise ValueError(f"a phrase needs {k} words: {text}")
            rows += [(number, label, exact, len(words), i, words[i : i + k]) for i in range(len(words) - k + 1)]
            number += 1
    schema = "template int, label string, exact boolean, t_words int, t_pos int, t_gram array<string>"
    return spark.createDataFrame(rows, schema).withColumn("gram_hash", F.xxhash64(*[F.col("t_gram")[j] for j in range(k)]))


def find_spans(docs: DataFrame, base: list | None = None, templates: list | None = None, k: int = K, gap: int = GAP, coverage: float = COVERAGE, drift: int = DRIFT) -> DataFrame:
    """Verified spans: doc_id, text_hash, label, exact, start_word, end_word (exclusive), covered (0 to 1).

    Diagonals of a span are at most ``gap`` apart and ``drift`` in all, and it is at most ``drift`` words
    longer than its template, so words that are strewn among others are no span.

    Rows of ``docs`` that repeat an id and a text give each span once.
    """
    base, templates = BASE if base is None else base, TEMPLATES if templates is None else templates
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.array_remove(F.split(lowered(text), NOT_WORD), "").alias("w"))
    shifted = [F.col("w")] + [F.slice("w", j + 1, F.greatest(F.size("w") - j, F.lit(0))) for j in range(1, k)]
    grams = words.select("doc_id", "text_hash", F.posexplode(F.arrays_zip(*[s.alias(f"g{j}") for j, s in enumerate(shifted)])).alias("pos", "g"))
    grams = grams.select("doc_id", "text_hash", "pos", "g", F.xxhash64(*[F.col("g")[f"g{j}"] for j in range(k)]).alias("gram_hash"))
    same = [F.col("g")[f"g{j}"] == F.col("t_gram")[j] for j in range(k)]
    hits = grams.join(F.broadcast(_templates(docs.sparkSession, base, templates, k)), "gram_hash")
    for check in same:  # equal hashes, then equal words
        hits = hits.where(check)
    key = ["doc_id", "text_hash", "template", "label", "exact", "t_words"]
    votes = hits.groupBy(*key, (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(F.collect_set("t_pos").alias("at"))
    order = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > gap, F.lit(True)) | F.col("exact")
    spans = votes.withColumn("chain", F.sum(far.cast("int")).over(order))
    # a chain of neighbours may drift on and on, so it is cut where it leaves its first diagonal by more than DRIFT
    first = F.min("diagonal").over(Window.partitionBy("doc_id", "text_hash", "template", "chain"))
    spans = spans.withColumn("island", F.struct("chain", F.floor((F.col("diagonal") - first) / (drift + 1)).alias("cut")))
    spans = spans.groupBy(*key, "island").agg(
        F.flatten(F.collect_list("at")).alias("at"),
        F.min(F.col("diagonal") + F.array_min("at")).alias("start_word"),
        F.max(F.col("diagonal") + F.array_max("at") + k).alias("end_word"),
    )
    # verified: enough of the template's words, and no more foreign words between them than the drift allows
    seen = F.size(F.array_distinct(F.flatten(F.transform("at", lambda t: F.sequence(t, t + F.lit(k - 1))))))
    spans = spans.withColumn("covered", seen / F.col("t_words")).where(F.col("end_word") - F.col("start_word") <= F.col("t_words") + drift)
    return spans.where(F.when(F.col("exact"), F.col("covered") >= 1.0).otherwise(F.col("covered") >= coverage)).select("doc_id", "text_hash", "label", "exact", "start_word", "end_word", "covered")


def scan_licenses(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs`` with its word count, base places and labels.

    Null text counts as empty; a text without a place has no first or last word, empty labels and score 0.
    Other columns of ``docs`` are not looked at, whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.regexp_count(lowered(text), F.lit(WORD)).cast("long").alias("n_words"))
    places = find_spans(docs, **options).groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(
        F.count(F.when(F.col("exact"), 1)).alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("start_word"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("start_word"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("covered").alias("score"),
    )
    out = rows.join(places, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
