"""License scan: phrases, and an exact set-similarity join of lines with license templates.

A line matches a template if it contains at least ``THRESHOLD`` of the template's words. Template words are ordered
by how many documents have them, rarest first. A line that matches must have one of the first |T| - need + 1 words of
that order (prefix filter), at least ``need`` words (length filter), and from the first prefix word it has enough words
of the order left to reach ``need`` (positional filter); what passes is compared word by word. So of all lines only
those with a rare license word are ever split, and no match is missed. All is DataFrame functions on rows, without a
shuffle but for the count of the templates' words.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.85

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Sentences of public license notices, in the words of the scan, and their labels.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("proprietary", "all rights reserved"),
)

#: What separates words: everything of ASCII but digits and letters.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def spaced(text: Column) -> Column:
    """The words of a text, each with one space before and one after it, so that phrases don't share spaces."""
    inner = F.trim(F.regexp_replace(lowered(text), BREAKS, "  "))
    return F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def words_before(norm: Column, at: Column) -> Column:
    """Words of a spaced text before a place in it (from 1)."""
    head = F.substring(norm, F.lit(1), at)
    return F.floor(F.length(F.regexp_replace(head, "[^ ]", "")) / 2).cast("long")


def phrase_places(norm: Column) -> dict[str, Column]:
    """n_base, first_word, last_word and the labels of the phrases, over a spaced text."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        sought = " " + phrase.replace(" ", "  ") + " "
        there = F.contains(norm, F.lit(sought))
        counts.append(F.when(there, (F.length(norm) - F.length(F.replace(norm, F.lit(sought), F.lit("")))) / len(sought)).otherwise(F.lit(0.0)))
        firsts.append(F.when(there, words_before(norm, F.instr(norm, sought))))
        back = F.instr(F.reverse(norm), sought[::-1])
        lasts.append(F.when(there, words_before(norm, F.length(norm) - back - len(sought) + 2)))
        labels.append(F.when(there, F.lit(label)))
    return {"n_base": reduce(Column.__add__, counts).cast("long"), "first_word": F.least(*firsts), "last_word": F.greatest(*lasts), "labels": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))}


def word_order(docs: DataFrame) -> list[str]:
    """The templates' words by the number of documents that have them, rarest first."""
    every = sorted({w for _, text in TEMPLATES for w in text.split()})
    found = docs.select(F.explode(F.array_intersect(F.split(spaced(F.col("text").cast("string")), " +"), F.array(*map(F.lit, every)))).alias("word"))
    counts = {row["word"]: row["n"] for row in found.groupBy("word").agg(F.count("*").alias("n")).collect()}  # no more rows than template words
    return sorted(every, key=lambda w: (counts.get(w, 0), w))


def prefixes(order: list[str], threshold: float) -> list[tuple[list[str], int]]:
    """Each template's words, rarest first, and how many of them a line must have."""
    rank = {w: k for k, w in enumerate(order)}
    sets = [sorted(set(text.split()), key=rank.get) for _, text in TEMPLATES]
    return [(words, math.ceil(threshold * len(words) - 1e-9)) for words in sets]


def matches(text: Column, norm: Column, order: list[str], threshold: float) -> Column:
    """An array of (line from 0, template, label, containment) for every match of a line of ``text`` with a template.

    norm: the spaced text, where the prefix words are looked for before any line is split.
    """
    sets = prefixes(order, threshold)
    rare = sorted({w for words, need in sets for w in words[: len(words) - need + 1]})
    some = lambda spaces: reduce(Column.__or__, (F.contains(spaces, F.lit(f" {w} ")) for w in rare))
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line"), spaced(x).alias("norm")))
    near = F.filter(lines, lambda x: some(x["norm"]))
    worded = F.transform(near, lambda x: F.struct(x["line"].alias("line"), F.array_distinct(F.filter(F.split(x["norm"], " +"), lambda w: w != "")).alias("words")))

    def of_line(x: Column) -> Column:
        options = []
        for k, (own, need) in enumerate(sets):
            there = [F.array_contains(x["words"], w) for w in own[: len(own) - need + 1]]
            left = F.coalesce(*(F.when(has, F.lit(len(own) - at)) for at, has in enumerate(there)), F.lit(0))
            common = F.size(F.array_intersect(x["words"], F.array(*map(F.lit, own))))
            found = F.struct(x["line"].alias("line"), F.lit(k).alias("template"), F.lit(TEMPLATES[k][0]).alias("label"), (common / len(own)).alias("containment"))
            options.append(F.when((F.size(x["words"]) >= need) & (left >= need), F.when(common >= need, found)))
        return F.array_compact(F.array(*options))

    none = F.array().cast("array<struct<line:int,template:int,label:string,containment:double>>")
    return F.when(some(norm), F.flatten(F.transform(worded, of_line))).otherwise(none)


def template_matches(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, line (from 0), template number, label and containment of every match of a line with a template."""
    order = word_order(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), spaced(text).alias("norm"))
    found = rows.select("doc_id", matches(F.col("text"), F.col("norm"), order, threshold).alias("matches"))
    return found.select("doc_id", F.explode("matches").alias("match")).select("doc_id", "match.*")


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row.

    score: 1 with a phrase, else the largest containment of a matching template, else 0. Null texts are empty ones.
    Rows with one doc_id are judged by their own texts; only doc_id and text are read. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = word_order(docs)
    rows = docs.select("doc_id", text.alias("text"), spaced(text).alias("norm"))
    n_words = F.floor((F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit("")))) / 2).cast("long")
    found = matches(F.col("text"), F.col("norm"), order, threshold).alias("matches")
    seen = rows.select("doc_id", n_words.alias("n_words"), *(v.alias(k) for k, v in phrase_places(F.col("norm")).items()), found)
    labels = F.array_sort(F.array_union("labels", F.transform("matches", lambda x: x["label"])))
    score = F.when(F.size("labels") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda x: x["containment"])), F.lit(0.0)))
    return seen.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
