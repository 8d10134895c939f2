"""License texts in documents: an exact set-similarity join of word blocks with templates."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainlake.llm.common import id_and_text

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """A phrase, the label it gives, and the share of its distinct words that a block needs.

    With ``base`` the words must also stand consecutively and in order.
    """

    label: str
    phrase: str
    threshold: float = 0.8
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.phrase.split()


# The base phrases, and the wording of common notices.
TEMPLATES = (
    Template("mit", "under the mit license", 1.0, True),
    Template("apache-2", "apache license version 2", 1.0, True),
    Template("cc-by-nc", "cc by nc", 1.0, True),
    Template("gpl-3", "licensed under the gnu general public license version 3"),
    Template("mit", "released under the mit license"),
    Template("apache-2", "licensed under the apache license version 2 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files to deal in the software without restriction",
    ),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def vocabulary_counts(docs: DataFrame, templates: tuple[Template, ...]) -> dict[str, int]:
    """How often each word of the templates occurs in all documents. Only the words of the
    templates are counted, so the result is as small as the templates."""
    vocabulary = sorted({w for t in templates for w in t.words})
    known = F.filter(words_of(F.col("text")), lambda w: w.isin(vocabulary))
    counted = docs.select(F.explode(known).alias("word")).groupBy("word").count()
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["count"] for r in counted.collect()}


def needed(template: Template) -> int:
    """Distinct words that a block must share with the template."""
    return max(1, math.ceil(template.threshold * len(set(template.words)) - 1e-9))


def prefix(template: Template, counts: dict[str, int]) -> list[str]:
    """The rarest words, as many as every block that meets the threshold must share one of."""
    ordered = sorted(set(template.words), key=lambda w: (counts.get(w, 0), w))
    return ordered[: len(ordered) - needed(template) + 1]


def scan_licenses(
    docs: DataFrame,
    templates: tuple[Template, ...] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score``.

    A block is a run of words as long as the template, or shorter at the end of the text. The
    join finds every block holding at least ``threshold`` of the template's distinct words:

    * words are ordered by their frequency in all documents, rarest first;
    * prefix filter: such a block has one of the template's rarest ``n - needed + 1`` words, so
      only those words are looked up, by an equi-join with the templates' prefixes;
    * length filter: a block with fewer words than needed is not looked at;
    * positional filter: blocks start no further before the word than the template is long,
      and those that hold a rarer word of the prefix are left to that word.

    Base templates are then compared word by word in order. ``score`` is the largest share of a
    template's words found in one block, 0 if none met its threshold. A null text is empty and
    gives zeros, null places and empty labels; repeated rows are answered one by one; an empty
    table gives an empty result; other columns are ignored.

    Texts stay in their tasks. The one shuffle moves a few numbers for each row and hit.
    """
    rows = id_and_text(docs, id_col, text_col)
    counts = vocabulary_counts(rows, templates)
    reach = max(len(t.words) for t in templates) - 1
    index = [(w, no, at) for no, t in enumerate(templates) for at, w in enumerate(prefix(t, counts))]
    anchors = sorted({w for w, _, _ in index})

    split = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), words_of(F.col("text")).alias("words"))
    places = F.filter(F.transform("words", lambda w, i: F.when(w.isin(anchors), i)), lambda i: i.isNotNull())
    found = split.select("doc_id", "row", F.size("words").cast("long").alias("n_words"), "words", places.alias("places"))
    near = F.transform(
        "places",
        lambda i: F.struct(
            i.alias("at"),
            F.element_at(F.col("words"), i + 1).alias("word"),
            F.slice("words", F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach + 1)).alias("around"),
            F.greatest(i - reach, F.lit(0)).alias("offset"),
        ),
    )
    hits = found.select("doc_id", "row", "n_words", F.explode_outer(near).alias("hit")).select("doc_id", "row", "n_words", "hit.*")

    spark = docs.sparkSession
    catalogue = spark.createDataFrame(
        [(w, t.label, t.base, t.words, sorted(set(t.words)), prefix(t, counts)[:at], needed(t)) for w, no, at in index for t in [templates[no]]],
        "word string, label string, base boolean, phrase array<string>, tokens array<string>, rarer array<string>, needed int",
    )
    pairs = hits.join(F.broadcast(catalogue), "word", "left")
    length = F.size("phrase")
    starts = F.when(
        F.col("label").isNotNull(),
        F.sequence(F.greatest(F.col("at") - length + 1, F.col("offset")), F.col("at")),
    )

    def block(start: Column) -> Column:
        return F.slice("around", start - F.col("offset") + 1, length)

    def share(start: Column) -> Column:
        words = block(start)
        fits = (F.size(words) >= F.col("needed")) & ~F.arrays_overlap(words, F.col("rarer"))
        return F.when(fits, F.size(F.array_intersect(words, F.col("tokens")))).otherwise(0)

    scored = pairs.select(
        "doc_id",
        "row",
        "n_words",
        "label",
        F.coalesce("base", F.lit(False)).alias("base"),
        F.filter(starts, lambda s: F.col("base") & (block(s) == F.col("phrase"))).alias("exact"),
        F.array_max(F.transform(starts, share)).alias("shared"),
        "needed",
        F.size("tokens").alias("n_tokens"),
    )
    n_exact = F.coalesce(F.when(F.col("base"), F.size("exact")), F.lit(0))
    met = F.coalesce(F.when(F.col("base"), n_exact > 0).otherwise(F.col("shared") >= F.col("needed")), F.lit(False))
    grouped = scored.groupBy("row", "doc_id", "n_words").agg(
        F.sum(n_exact).cast("long").alias("n_base"),
        F.min(F.when(F.col("base"), F.array_min("exact"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.array_max("exact"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(n_exact > 0, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(met, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(met, F.when(F.col("base"), F.lit(1.0)).otherwise(F.col("shared") / F.col("n_tokens")))), F.lit(0.0)).alias("score"),
    )
    return grouped.drop("row")
