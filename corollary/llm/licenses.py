"""Licence notices: an exact set-similarity join of text blocks with templates, by containment.

A word is ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case. A block is what stands
between ends of sentences (one of ``.!?;:`` before white space) and blank lines; it is compared as a set of
words. A template is a set of words too. A block meets a template T if it has at least need = ceil(percent *
|T| / 100) of T's words. All such pairs are found:

* the words of all templates are put in one order, rarest in all documents first (one count over all
  documents, summed before it is shuffled);
* a block with need of T's words has one of the first |T| - need + 1 of them (prefix filter), so only those
  are in the index that the blocks' words are joined with; a pair is taken at the first of its words that a
  block has, so once;
* the block must have need words of any template at all (length filter), and as many from the joined word on
  in the common order (positional filter);
* the rest is decided by the whole intersection.

Words that are in no template have no part in an intersection with one, so a block's length and places are
those among the templates' words: a tighter bound than its full length.

The index holds templates only. It is broadcast and its order stands in the plan for at most LARGEST words of
templates at a time; larger sets of templates are dealt in parts of that size, a pass over the documents
each. No document and no block meets another one, so copies and hot sources are plain rows.

Besides, ``scanned`` counts fixed phrases (words that stand consecutively), with the places of the first and
the last; overlapping ones count each.

A null text counts as empty; texts without words have no places and no labels, and score 0. Rows with one id
are read each by itself, repeated rows give repeated rows, a null id is an id like others. Templates without
words are left out, equal ones are told each. Empty tables give no rows. Of the columns, only id and text are
read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_END = r"[.!?;:]+[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*\n"
PERCENT = 90
#: Words of templates in one pass.
LARGEST = 1 << 14

# Phrases with their labels, and well-known notices of public licences with theirs.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "distributed under the terms of the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "licensed under the bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by-nd", "licensed under cc by nd"),
    ("cc-by", "licensed under a creative commons attribution license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial license"),
    ("proprietary", "no part of this publication may be reproduced stored in a retrieval system or transmitted in any form or by any means without the prior permission of the publisher"),
]


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else; texts of ASCII alone take the short way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def spaced(low: Column) -> Column:
    """The words of a text in lower case, with one space between."""
    return F.trim(F.regexp_replace(low, GAP, " "))


def words_of(text: str) -> list[str]:
    """A template's words, as a list without repeats."""
    low = text.translate(str.maketrans(UPPER, LOWER))
    return list(dict.fromkeys(w for w in re.split(GAP, low) if w))


def needed(size: int, percent: int) -> int:
    return -(-percent * size // 100)


def _parts(templates: list[tuple[int, str, list[str]]], largest: int) -> Iterator[list[tuple[int, str, list[str]]]]:
    """The templates in runs of at most ``largest`` words; one that is longer stands alone."""
    part, size = [], 0
    for t in templates:
        if part and size + len(t[2]) > largest:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t[2])
    if part:
        yield part


def _met(blocks: DataFrame, docs: DataFrame, templates: list[tuple[int, str, list[str]]], percent: int) -> DataFrame:
    """The pairs of blocks with these templates."""
    spark = docs.sparkSession
    every = sorted({w for t in templates for w in t[2]})
    tokens = docs.select(F.explode(F.split(spaced(lowered(F.col("text"))), " ")).alias("token"))
    known = F.broadcast(spark.createDataFrame([(w,) for w in every], "token string"))
    count = {r.token: r["count"] for r in tokens.join(known, "token").groupBy("token").count().collect()}  # words of templates
    order = sorted(every, key=lambda w: (count.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for number, label, words in templates:
        words = sorted(words, key=rank.__getitem__)
        need = needed(len(words), percent)
        index += [(w, number, label, i, need, words) for i, w in enumerate(words[: len(words) - need + 1], 1)]
    table = spark.createDataFrame(index, "token string, template int, label string, place int, need int, template_words array<string>")
    hits = blocks.select("*", F.posexplode("words").alias("pos", "token")).join(F.broadcast(table), "token")
    # each word of a block once
    hits = hits.where(F.array_position("words", F.col("token")) == F.col("pos") + 1)
    mine = F.array_intersect(F.array(*map(F.lit, order)), F.col("words"))  # in the common order
    hits = hits.withColumn("mine", mine).where(F.size("mine") >= F.col("need"))
    hits = hits.where(F.size("mine") - F.array_position("mine", F.col("token")) + 1 >= F.col("need"))
    both = F.array_intersect("template_words", "words")
    hits = hits.withColumn("both", both).where((F.size("both") >= F.col("need")) & (F.element_at("both", 1) == F.col("token")))
    size = F.size("template_words")
    return hits.select(*(c for c in blocks.columns if c != "words"), "template", "label", F.size("both").alias("overlap"), size.alias("template_size"), (F.size("both") / size).alias("containment"))


def _as_list(templates: list[tuple[str, str]]) -> list[tuple[int, str, list[str]]]:
    out = [(i, label, words_of(text)) for i, (label, text) in enumerate(templates)]
    return [t for t in out if t[2]]


def found(df: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", largest: int = LARGEST) -> DataFrame:
    """doc_id, key (of id and text), block (from 0), block_text (in lower case), template (its place in the
    list), label, overlap, template_size, containment: every block with ``percent`` of a template's words."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be over 0 and at most 100")
    docs = _docs(df, id_col, text_col)
    pieces = docs.select("doc_id", "key", F.posexplode(F.split(lowered(F.col("text")), BLOCK_END)).alias("block", "block_text"))
    blocks = pieces.withColumn("words", F.split(spaced(F.col("block_text")), " "))
    parts = [_met(blocks, docs, part, percent) for part in _parts(_as_list(templates), largest)]
    if not parts:
        raise ValueError("no template has a word")
    return reduce(DataFrame.unionByName, parts)


def _docs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("key"))


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def scanned(df: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of df: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.
    The score is 1 where a phrase stands, else the largest containment of a block that meets a template, else 0."""
    docs = _docs(df, id_col, text_col).withColumn("line", spaced(lowered(F.col("text")))).drop("text")
    docs = docs.withColumn("n_words", F.when(F.col("line") == "", F.lit(0).cast("long")).otherwise(_spaces(F.col("line")) + 1)).withColumn("line", F.concat(F.lit(" "), "line", F.lit(" ")))
    line, counts, firsts, lasts, labels = F.col("line"), [], [], [], []
    for phrase, label in phrases.items():
        here = f" {phrase} "
        there = line.contains(here)
        # a place shares its spaces with its neighbours, so the last one is only looked at
        counts.append(F.when(there, F.regexp_count(line, F.lit(f" {re.escape(phrase)}(?= )")).cast("long")).otherwise(0))
        firsts.append(F.when(there, _spaces(F.substring_index(line, here, 1))))
        lasts.append(F.when(there, F.col("n_words") - _spaces(F.substring_index(line, here, -1)) - len(phrase.split())))
        labels.append(F.when(there, F.lit(label)))
    told = F.array_distinct(F.array_sort(F.array_compact(F.array(*labels))))
    least, most = (f(*x) if len(x) > 1 else x[0] for f, x in ((F.least, firsts), (F.greatest, lasts)))
    base = docs.select("doc_id", "key", "n_words", reduce(Column.__add__, counts).alias("n_base"), least.alias("first_word"), most.alias("last_word"), told.alias("base"))
    met = found(df, templates, percent, id_col, text_col).groupBy(F.col("doc_id").alias("id"), "key").agg(F.collect_set("label").alias("own"), F.max("containment").alias("best"))
    both = base.join(met, (base.key == met.key) & base.doc_id.eqNullSafe(met.id), "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("own", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
