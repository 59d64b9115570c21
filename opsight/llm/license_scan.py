"""License scan as an exact set-similarity join, with DataFrame functions alone.

Every template is a set of words; a block of text (a line, or a paragraph of wrapped
lines) carries a template's label if it holds at least the threshold share of the
set. Template words are ordered by how many documents of the corpus have them, rarest
first. A block can only reach the share if it has one of the first
|T| - ceil(t |T|) + 1 words of that order (prefix filter), has enough words (length
filter), and has enough shared words left after the first one (positional filter);
what passes is counted exactly. The templates and their order are a few hundred
words, a fixed bound, and stand in the plan as literals; no row leaves its task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of a template's words that a block must have.
THRESHOLD = 0.8
#: A block may have so many times the words of the template: long ones count as well as short ones.
MOST_TIMES = math.inf

# Phrases whose places are counted, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Sentences by which common licenses are recognised.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "apache-2": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc0": "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain worldwide",
    # Names in one-line notices. Up to four words, so that at the threshold all of them must be there: with more, one
    # license would pass for its neighbour. A family's name is part of the names of its members, hence a label of its own.
    "gpl-family": "GNU General Public License",
    "gpl-short": "licensed under the GPL",
    "lgpl-notice": "Lesser General Public License",
    "lgpl-short": "licensed under the LGPL",
    "agpl-notice": "Affero General Public License",
    "agpl-short": "licensed under the AGPL",
    "mpl-notice": "Mozilla Public License",
    "mpl-short": "licensed under the MPL",
    "bsd-notice": "under the BSD License",
    "bsd-2-notice": "BSD 2 Clause License",
    "bsd-3-notice": "BSD 3 Clause License",
    "cc-family": "Creative Commons Attribution License",
    "cc-short": "licensed under CC BY",
    "cc-by-sa-notice": "Creative Commons Attribution ShareAlike",
    "cc-by-nc-notice": "Creative Commons Attribution NonCommercial",
    "cc-by-nd-notice": "Creative Commons Attribution NoDerivatives",
}

# Fixed value: what separates words once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_words(text: str) -> list[str]:
    words = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text).split()
    return sorted(set(words))


def lowered(text: Column) -> Column:
    """A-Z in lower case. The two letters outside ASCII whose lower case is an ASCII letter are put out of the way."""
    return F.lower(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("κ")), F.lit("İ"), F.lit("κ")))


def spaced(text: Column) -> Column:
    """The words of lower-case text with one space before and after each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, SEPARATORS, " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def word_count(padded: Column) -> Column:
    return F.when(padded == "  ", F.lit(0).cast("long")).otherwise(_spaces(padded) - 1)


def phrase_places(padded: Column, n_words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """How often a phrase stands in the text, and the numbers of the first and last place's first word."""
    words = phrase.split(" ")
    size = len(words)
    if any(words[:i] == words[-i:] for i in range(1, size)):
        raise ValueError(f"the phrase {phrase!r} can overlap itself")
    has = F.contains(padded, F.lit(f" {phrase} "))
    cut = F.split(padded, rf"\Q {phrase}\E(?= )")
    n = F.when(has, F.size(cut) - 1).otherwise(0).cast("long")
    first = F.when(has, _spaces(F.element_at(cut, 1)))
    last = F.when(has, n_words - size - _spaces(F.element_at(cut, -1)) + 1)
    return n, first, last


def word_order(docs: DataFrame, text: str, words: list[str]) -> list[str]:
    """The given words by the number of texts that have them, rarest first; ties by name."""
    asked = F.array(*map(F.lit, words))
    own = F.explode(F.array_intersect(F.split(spaced(lowered(F.col(text))), " "), asked))
    counts = {r[0]: r[1] for r in docs.select(own.alias("word")).groupBy("word").count().collect()}  # one row per template word
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def _template_hits(ranks: Column, n: Column, sets: Mapping[str, list[int]], threshold: float) -> list[Column]:
    """For each template a struct (label, share), null if one of the filters or the exact count rules the block out."""
    out = []
    for label, own in sets.items():
        size = len(own)
        least = math.ceil(threshold * size - 1e-9)
        whole, prefix = F.array(*map(F.lit, own)), F.array(*map(F.lit, own[: size - least + 1]))
        shared = F.array_intersect(whole, ranks)
        head = F.element_at(shared, 1)
        left = F.least(F.lit(size) - F.array_position(whole, head), F.size(ranks) - F.array_position(ranks, head))
        passes = F.when(n >= least, F.when(F.arrays_overlap(ranks, prefix), F.when(1 + left >= least, F.size(shared) >= least)))
        out.append(F.when(passes, F.struct(F.lit(label).alias("label"), (F.size(shared) / F.lit(size)).alias("share"))))
    return out


def scan(docs: DataFrame, text: str = "text", phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES,
         threshold: float = THRESHOLD) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels (arrays) and score for every whole text.

    score is 1 with a phrase, else the largest share a block has of a template it
    meets, else 0. A null or empty text has no words, no labels and score 0.
    Repeated rows keep one result each; columns of these names are replaced.
    """
    words = {label: template_words(t) for label, t in templates.items()}
    order = word_order(docs, text, sorted(set().union(*words.values())) or [""])
    rank = {w: i for i, w in enumerate(order)}
    sets = {label: sorted(rank[w] for w in own) for label, own in words.items() if own}
    rare = sorted({i for own in sets.values() for i in own[: len(own) - math.ceil(threshold * len(own) - 1e-9) + 1]})
    rare_words = F.array(*(F.lit(order[i]) for i in rare)) if rare else F.array().cast("array<string>")
    all_words = F.array(*map(F.lit, order))

    low = docs.withColumn("__low", lowered(F.col(text)))
    own = low.withColumn("__words", spaced(F.col("__low")))
    own = own.withColumn("n_words", word_count(F.col("__words")))
    places = [phrase_places(F.col("__words"), F.col("n_words"), p) for p in phrases]
    own = own.withColumns({f"__{k}{i}": c for i, p in enumerate(places) for k, c in zip(("n", "f", "l"), p, strict=True)})
    each = range(len(places))
    some = lambda f, k: f(*(F.col(f"__{k}{i}") for i in each)) if len(places) > 1 else F.col(f"__{k}0")
    base = F.array_distinct(F.array_sort(F.array_compact(F.array(*(F.when(F.col(f"__n{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values()))))))

    def block_hits(blocks: Column) -> Column:
        def one(block: Column) -> Column:
            held = F.array_distinct(F.split(F.trim(F.regexp_replace(block, SEPARATORS, " ")), " "))
            # positions in the global order, ascending
            ranks = F.array_sort(F.transform(F.array_intersect(held, all_words), lambda w: (F.array_position(all_words, w) - 1).cast("int")))
            info = F.struct(ranks.alias("r"), F.size(held).alias("n"))
            return F.flatten(F.transform(F.array(info), lambda x: F.array_compact(F.array(*_template_hits(x["r"], x["n"], sets, threshold)))))

        return F.flatten(F.transform(blocks, one))

    nothing = F.array().cast("array<struct<label:string,share:double>>")
    may = F.arrays_overlap(F.split("__words", " "), rare_words)
    lines, paragraphs = F.split("__low", r"\r?\n"), F.split("__low", r"\r?\n[ \t]*\r?\n")
    hits = F.when(may, F.concat(block_hits(lines), block_hits(paragraphs))).otherwise(nothing) if sets else nothing
    own = own.withColumn("__hits", hits)
    labels = F.array_sort(F.array_distinct(F.concat(base, F.transform("__hits", lambda h: h["label"]))))
    drop = ["n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    own = own.withColumns({
        "n_base": sum((F.col(f"__n{i}") for i in each), F.lit(0).cast("long")),
        "first_word": some(F.least, "f"), "last_word": some(F.greatest, "l"), "base_labels": base, "labels": labels,
        "score": F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("__hits", lambda h: h["share"])), F.lit(0.0))),
    })
    return own.select(*(c for c in docs.columns if c not in (*drop, "n_words")), "n_words", *drop)
