"""License scans by an exact set-similarity join of text blocks with license templates, in DataFrame operations alone.

A block is a line of a document, a template a short license notice; both are sets of words.  A block matches a template
if it holds at least THRESHOLD of the template's words (containment).  The join is exact:

* global order: the words of all templates are ordered by the number of documents that have them, rarest first, counted
  over the whole corpus;
* prefix filter: with t words in a template and a = ceil(THRESHOLD * t) needed, one of its t - a + 1 rarest must be in
  the block, so only blocks with such a word become candidates, by an equi-join on that word;
* length filter: a block with fewer than a of the templates' words can't match;
* positional filter: where the first shared word stands at i in the template's and j in the block's ordered words, at
  most 1 + min(t - i, b - j) words can be shared; what is left is verified by the intersection.

Templates are constants of bounded number, so their side of the join and the word order are small whatever the corpus.

Beside it, `phrases` counts the places of fixed phrases.  Defined results: a null or empty text has no words, no labels
and score 0; repeated rows and null doc_ids are rows of their own; other columns don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Phrases of words and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# License notices and their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Shared under CC BY-NC 4.0."),
    ("all-rights-reserved", "Copyright. All rights reserved."),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same but for the line feed.
_BREAK_IN_LINE = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def template_words(text: str) -> frozenset[str]:
    return frozenset("".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split())


def _lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def spaced(text: Column) -> Column:
    """The words of a text, each between single spaces; one space if there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), _lower(text), F.lit(" ")), _BREAK, " ")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def phrases(words: Column) -> list[Column]:
    """n_words, n_base, first_word, last_word and base_labels (an array) of a text that `spaced` made."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        # Words may be shared by no two places of a phrase, spaces are: doubled, each place has its own.
        mark = f" {phrase} "
        doubled = F.replace(words, F.lit(" "), F.lit("  "))
        own = F.lit(mark.replace(" ", "  ")[1:-1])
        n = F.when(F.contains(words, F.lit(mark)), (F.length(doubled) - F.length(F.replace(doubled, own, F.lit("")))) / F.length(own)).otherwise(0)
        counts.append(n.cast("long"))
        firsts.append(F.when(n > 0, _spaces(F.substring_index(words, mark, 1))))
        after = F.substring_index(words, mark, -1)
        lasts.append(F.when(n > 0, _spaces(words) - 1 - _spaces(after) - len(phrase.split())))
        labels.append(F.when(n > 0, label))
    return [
        F.greatest(_spaces(words) - 1, F.lit(0)).cast("long").alias("n_words"),
        sum(counts[1:], counts[0]).alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base_labels"),
    ]


def word_order(docs: DataFrame, templates=TEMPLATES) -> list[str]:
    """The templates' words, those that the fewest documents have first: a count for each word, over all documents."""
    universe = sorted(set().union(*(template_words(t) for _, t in templates)))
    own = F.array_intersect(F.split(spaced(F.col("text").cast("string")), " "), F.array(*map(F.lit, universe)))
    counts = dict(docs.select(F.explode(own).alias("w")).groupBy("w").count().collect())  # a row a word of the templates
    return sorted(universe, key=lambda w: (counts.get(w, 0), w))


def matches(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """text_key, label and score (the containment) of every pair of a text's line and a template at the threshold."""
    spark = docs.sparkSession
    order = word_order(docs, templates)
    place = {w: k for k, w in enumerate(order)}
    sides, firsts = [], set()
    for k, (label, text) in enumerate(templates):
        own = sorted(place[w] for w in template_words(text))
        need = max(1, math.ceil(threshold * len(own) - 1e-9))
        prefix = own[: len(own) - need + 1]
        firsts |= {order[p] for p in prefix}
        sides += [(p, i, k, label, own, need) for i, p in enumerate(prefix)]
    names = ("place", "i", "template", "label", "own", "need")
    lits = [F.struct(*(F.lit(v).alias(n) for n, v in zip(names, s, strict=True))) for s in sides]
    side = spark.range(1).select(F.inline(F.array(*lits)))
    least = min(s[-1] for s in sides)
    # Only texts with a word of some prefix have candidates; then their lines, as ordered sets of the templates' words.
    text = F.col("text").cast("string")
    some = F.regexp_like(spaced(text), F.lit(f" (?:{'|'.join(sorted(firsts))}) "))
    lined = F.regexp_replace(_lower(text), _BREAK_IN_LINE, " ")
    # A line at a time as rows; equal texts are looked at once.
    texts = docs.filter(some).select(text_key(text).alias("text_key"), F.explode(F.split(lined, "\n")).alias("line"))
    places = F.map_from_arrays(F.array(*map(F.lit, order)), F.array(*map(F.lit, range(len(order)))))
    shared = F.array_intersect(F.split("line", " "), F.array(*map(F.lit, order)))
    blocks = texts.select("text_key", F.array_sort(F.transform(shared, lambda w: F.element_at(places, w))).alias("block")).filter(F.size("block") >= least).distinct()
    tokens = blocks.select("text_key", "block", F.posexplode("block").alias("j", "place"))
    found = tokens.join(side, "place").filter(F.size("block") >= F.col("need"))
    overlap = F.size(F.array_intersect("block", "own"))
    # The pair counts at its first shared word alone, where the positional filter holds.
    first = F.element_at(F.array_intersect("own", "block"), 1) == F.col("place")
    bound = 1 + F.least(F.size("own") - F.col("i") - 1, F.size("block") - F.col("j") - 1) >= F.col("need")
    return found.filter(bound).filter(first & (overlap >= F.col("need"))).select("text_key", "label", (overlap / F.size("own")).alias("score"))


def text_key(text: Column) -> Column:
    """128 bits that equal texts share."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """doc_id, the counts of `phrases`, base_labels, labels (the join's too) and score (the best containment) of every row."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text_key(text).alias("text_key"), spaced(text).alias("words")).select("doc_id", "text_key", *phrases(F.col("words")))
    found = matches(docs, threshold, templates).groupBy("text_key").agg(F.collect_set("label").alias("found"), F.max("score").alias("best"))
    joined = rows.join(found, "text_key", "left")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("found", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"),
    )
