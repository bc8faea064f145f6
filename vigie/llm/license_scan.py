"""Licence scan by an exact set-similarity join, in DataFrame operations only.

Every line of every text is a block. For notices that wrap over lines, so is on
request (``wrapped``) every stretch of as many words as a template has, anywhere
in the text, for that template. A template is a set of words; a block
meets it when it holds at least ``threshold`` of the template's words. The join
follows the prefix-filter scheme:

* Words are ordered globally, rarest first, by the number of blocks that hold
  them. Only template words can add to an overlap, so only they are counted.
* Prefix filter: to miss fewer than needed, a block must hold one of a
  template's ``|T| - need + 1`` rarest words.
* Length filter: the block must hold ``need`` template words at all.
* Positional filter: from the first common word on, what is left of block and
  template must still reach ``need``.
* The pairs that pass are verified on their whole sets.

The join is unrolled: each block meets each template in one expression, and the
filters guard the verification. The plan grows with the templates' number and
words, which suits short notices, not a library of full licence texts.

Phrases are templates whose words must stand consecutively; their places are
found by scanning the whole text.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import NON_ALNUM, ascii_lower, numbered

# Phrase -> label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# The method's own templates, label -> usual wording of a notice.
TEMPLATES = {
    "notice-apache-2": "licensed under the apache license version 2 0",
    "notice-gpl-3": "this work is licensed under the gnu general public license version 3",
    "notice-mit": "released under the mit license",
    "notice-cc-by-nc": "licensed under cc by nc 4 0",
    "all-rights-reserved": "all rights reserved",
    "bsd-conditions": "redistribution and use in source and binary forms with or without modification are permitted "
    "provided that the following conditions are met",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
    "associated documentation files",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "public-domain": "this work has been released into the public domain",
}
THRESHOLD = 0.8


def words_of(text: Column) -> Column:
    """The text's words, one space around each: `` a b c ``; one space if there is none."""
    return F.regexp_replace(F.concat(F.lit(" "), ascii_lower(text), F.lit(" ")), NON_ALNUM, " ")


def spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def need(template: set[str], threshold: float) -> int:
    return max(1, math.ceil(threshold * len(template) - 1e-9))


def word_order(blocks: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary, rarest word first, by the blocks that hold it; one row per template word comes back."""
    counted = blocks.select(F.explode("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    seen = dict(counted.collect())
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def block_matches(blocks: DataFrame, templates: dict[str, set[str]], threshold: float) -> DataFrame:
    """(every column of ``blocks``, label, overlap share) of the blocks that meet a template.

    ``blocks`` has ``held``: the distinct template words of the block, and
    ``window_of``: the only template that it may meet, NULL for any.
    """
    vocabulary = sorted(set().union(*templates.values()))
    order = word_order(blocks, vocabulary)
    rank = {w: i for i, w in enumerate(order)}
    # The block's words in global order; its length is known from here on.
    ranked = blocks.withColumn("ranks", F.array_sort(F.transform("held", lambda w: reduce(
        lambda e, k: F.when(w == k, F.lit(rank[k])).otherwise(e), vocabulary, F.lit(-1)))))
    found = []
    for label, template in sorted(templates.items()):
        ids = sorted(rank[w] for w in template)
        least = need(template, threshold)
        prefix = ids[: len(ids) - least + 1]
        held = F.col("ranks")
        # first prefix word of the template that the block holds: its places in both orders
        first = F.array_min(F.array_intersect(held, F.array(*[F.lit(i) for i in prefix])))
        left_in_block = F.size(held) - F.array_position(held, first).cast("int") + 1
        left_in_template = F.lit(len(ids) + 1) - F.array_position(F.array(*[F.lit(i) for i in ids]), first).cast("int")
        candidate = (
            (F.col("window_of").isNull() | (F.col("window_of") == label))
            & (F.size(held) >= least)
            & F.arrays_overlap(held, F.array(*[F.lit(i) for i in prefix]))
            & (F.least(left_in_block, left_in_template) >= least)
        )
        overlap = F.size(F.array_intersect(held, F.array(*[F.lit(i) for i in ids])))
        met = F.when(candidate, F.when(overlap >= least, overlap / F.lit(float(len(ids)))))
        found.append(F.struct(F.lit(label).alias("label"), met.alias("share")))
    return (
        ranked.withColumn("hit", F.explode(F.filter(F.array(*found), lambda x: x["share"].isNotNull())))
        .select(*blocks.columns, F.col("hit.label").alias("label"), F.col("hit.share").alias("share"))
    )


def license_blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
                   threshold: float = THRESHOLD, wrapped: bool = False) -> DataFrame:
    """(``id_col``, block, held, window_of, label, share): every line that meets a template, by its number from 0.

    With ``wrapped`` also every window that does, across line ends: ``block`` is
    then its first word's number from 0, and ``window_of`` is its template.
    """
    templates = TEMPLATES if templates is None else templates
    sets = {k: set(v.split()) for k, v in templates.items()}
    vocabulary = F.array(*[F.lit(w) for w in sorted(set().union(*sets.values()))])
    least = min(need(t, threshold) for t in sets.values())
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(words_by_line(F.col(text_col)), "\n")).alias("block", "line"))
    blocks = lines.select("id", "block", F.array_intersect(F.split("line", " "), vocabulary).alias("held")).where(F.size("held") >= least)
    blocks = blocks.withColumn("window_of", F.lit(None).cast("string"))
    if wrapped:
        blocks = blocks.unionByName(word_windows(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), templates, threshold))
    return block_matches(blocks, sets, threshold).withColumnRenamed("id", id_col)


def word_windows(texts: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """(id, block, held, window_of): the windows of a template's length that hold enough of its words.

    A window is taken where a template word begins it: any other holds no more
    than the one from its first template word on. Only texts that hold enough
    of a template's words as a whole are searched for it.
    """
    sets = {k: set(v.split()) for k, v in templates.items()}
    vocabulary = F.array(*[F.lit(w) for w in sorted(set().union(*sets.values()))])
    known = F.array(*[
        F.struct(F.lit(k).alias("label"), F.lit(len(v.split())).alias("length"), F.lit(need(sets[k], threshold)).alias("least"),
                 F.array(*[F.lit(w) for w in sorted(sets[k])]).alias("words")) for k, v in sorted(templates.items())])
    # Each explode of one element keeps what it holds from being computed again by the filters and projections above it.
    words = texts.select("id", F.explode(F.array(F.split(F.trim(words_of(F.col("text"))), " "))).alias("words"))
    own = words.select("id", "words", F.explode(F.array(F.array_intersect("words", vocabulary))).alias("own"))
    met = own.select("id", "words", F.explode(F.filter(known, lambda t: F.size(F.array_intersect("own", t["words"])) >= t["least"])).alias("t"))
    places = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains("t.words", w), i)), lambda i: i.isNotNull())
    windows = F.transform(places, lambda i: F.struct(
        i.alias("block"), F.array_intersect(F.slice("words", i + 1, F.col("t.length")), F.col("t.words")).alias("held")))
    found = met.select("id", F.col("t.label").alias("window_of"), F.col("t.least").alias("least"), F.explode(windows).alias("b"))
    return found.where(F.size("b.held") >= F.col("least")).select("id", "b.block", "b.held", "window_of")


def words_by_line(text: Column) -> Column:
    """As ``words_of``, keeping line breaks between blocks."""
    return F.regexp_replace(ascii_lower(text), r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None,
                 threshold: float = THRESHOLD, wrapped: bool = False) -> DataFrame:
    """One row per input row: ``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts all places of the phrases, ``first_word`` and
    ``last_word`` are the smallest and largest word at which one starts (NULL
    without any). ``labels`` adds the templates that some line meets
    or, with ``wrapped``, some window of a template's length in words; both label lists are distinct, sorted and comma-joined, empty without any.
    ``score`` is 1 where a phrase stands, else the best share of a template
    that such a block holds (at least ``threshold``), else 0. NULL counts as the
    empty text. Rows that repeat an id, or have none, are judged each on its
    own, told apart by their place in the table. Other columns are ignored, whatever their names.
    """
    phrases = PHRASES if phrases is None else phrases
    any_phrase = "|".join(sorted(phrases, key=len, reverse=True))
    own = numbered(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "place")
    rows = own.select("place", "id", words_of(F.coalesce(F.col("text"), F.lit(""))).alias("w"))
    # Places are searched only in texts that hold a phrase at all.
    has = F.rlike("w", F.lit(f" (?:{any_phrase})(?= )"))
    first = F.when(has, spaces(F.regexp_extract("w", rf"(?s)^(.*?) (?:{any_phrase}) ", 1)))
    last = F.when(has, spaces(F.regexp_extract("w", rf"(?s)^(.*) (?:{any_phrase}) ", 1)))
    labels = F.array_distinct(F.array_compact(F.array(*[
        F.when(F.contains("w", F.lit(f" {p} ")), F.lit(label)) for p, label in sorted(phrases.items())])))
    base = rows.select(
        "place", "id",
        F.greatest(spaces(F.col("w")) - 1, F.lit(0)).cast("long").alias("n_words"),
        F.when(has, F.regexp_count("w", F.lit(f" (?:{any_phrase})(?= )"))).otherwise(0).cast("long").alias("n_base"),
        first.cast("long").alias("first_word"),
        last.cast("long").alias("last_word"),
        F.when(has, labels).otherwise(F.array().cast("array<string>")).alias("base"),
    )
    met = license_blocks(own, "place", "text", templates, threshold, wrapped).groupBy(F.col("place").alias("met_id")).agg(
        F.collect_set("label").alias("met"), F.max("share").alias("share"))  # as many labels as there are templates, at most
    none = F.array().cast("array<string>")
    return base.join(met, F.col("place") == F.col("met_id"), "left").select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("met", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
