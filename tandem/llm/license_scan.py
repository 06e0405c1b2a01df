"""License scans: base phrases, and an exact set-similarity join of text blocks with templates.

A block is a window of the text's words, wherever lines break. A template of n words, of which t are different, is found in a
block of at most n / ``threshold`` words (its longest, so that a sentence that happens to hold the words far apart is
none) that holds at least k = ceil(``threshold`` * t) of the t. Words are ordered by global frequency, rarest first, counted over all
documents. A template has as prefix its t - k + 1 rarest words: a block without any of
these cannot reach k, so only windows around a prefix word are formed. A block is looked at only if it has at least k template words
(length), shares a prefix word, and still can reach k from the places at which the
first shared word stands in both ordered sets (position); what is left is verified by
counting. The templates are a fixed, small parameter, so the join needs no shuffle: each
document is read once, and its row is complete where it was read.

Edge cases: null and empty texts give zero counts, null positions, empty labels and
score 0; very long texts are scanned whole; of windows that tie the label counts once; equal rows give equal rows; columns other
than the id and the text may have any names and are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: What stands between words of a text in which A-Z are lower-cased. Splitting at these few
#: ranges takes a third of the time of finding all that is outside them.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The two letters beyond A-Z whose lower case holds ASCII, and a letter that has none.
_KELVIN, _DOTTED, _OTHER = "\u212a", "\u0130", "\u00df"

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

TEMPLATES = {
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "apache": "licensed under the apache license version 2 0",
    "gpl": "this work is licensed under the gnu general public license version 3",
    "gpl-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
THRESHOLD = 0.9


def folded(text: Column) -> Column:
    """Lower case for finding ASCII words: as if A-Z alone were lower-cased, since no other letter
    turns into ASCII and all remain parts of words. Words outside ASCII change, but they match nothing."""
    return F.lower(F.replace(F.replace(text, F.lit(_KELVIN), F.lit(_OTHER)), F.lit(_DOTTED), F.lit(_OTHER)))


def pieces(text: Column) -> Column:
    """The words of a folded text; the first and the last may be empty, as what stands beside a gap."""
    return F.split(text, _GAP)


def _array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def token_frequencies(docs: DataFrame, tokens, text_col: str = "text") -> dict[str, int]:
    """In how many documents each of ``tokens`` stands; at most ``len(tokens)`` rows reach the driver."""
    words = pieces(folded(F.coalesce(F.col(text_col), F.lit(""))))
    found = docs.select(F.explode(F.array_intersect(_array(sorted(tokens)), words)).alias("token")).groupBy("token").count()
    return {r["token"]: r["count"] for r in found.collect()}


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    n = len(parts)

    def at(i: Column) -> Column:
        hit = F.get(words, i) == F.lit(parts[0])
        for k in range(1, n):
            hit = hit & (F.get(words, i + k) == F.lit(parts[k]))
        return hit

    every = F.sequence(F.lit(0), F.size(words) - n)
    return F.when(F.size(words) >= n, F.filter(every, at)).otherwise(F.array().cast("array<int>"))


def _base_hits(words: Column, base: Mapping[str, str]) -> Column:
    """Struct of the phrases' places: n, first, last, labels."""
    places = F.array(*[F.struct(F.lit(label).alias("label"), _places(words, phrase).alias("at")) for phrase, label in base.items()])

    def summed(p: Column) -> Column:
        flat = F.flatten(F.transform(p, lambda x: x["at"]))
        return F.struct(
            F.size(flat).cast("long").alias("n"),
            F.array_min(flat).cast("long").alias("first"),
            F.array_max(flat).cast("long").alias("last"),
            F.transform(F.filter(p, lambda x: F.size(x["at"]) > 0), lambda x: x["label"]).alias("labels"),
        )

    return let(places, summed)


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: Mapping[str, str] = BASE,
    templates: Mapping[str, str] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document.

    ``score`` is the highest containment among the blocks that reach the threshold, 1 where
    a base phrase stands, else 0.
    """
    lists = {k: v.split() for k, v in templates.items()}
    sets = {k: set(v) for k, v in lists.items()}
    seen = token_frequencies(docs, set().union(*sets.values()), text_col)
    ranked = sorted(set().union(*sets.values()), key=lambda w: (seen.get(w, 0), w))
    shapes = []
    for label, words in sets.items():
        need = max(1, math.ceil(threshold * len(words) - 1e-9))
        own = [w for w in ranked if w in words]
        shapes.append((label, own, own[: len(own) - need + 1], need, math.floor(len(lists[label]) / threshold + 1e-9)))
    postings = F.array(
        *[
            F.struct(F.lit(label).alias("label"), _array(own).alias("words"), _array(prefix).alias("prefix"), F.lit(need).alias("need"), F.lit(most).alias("most"))
            for label, own, prefix, need, most in shapes
        ]
    )
    in_rank_order = _array(ranked)
    # The prefix filter looks at the whole text first: without any prefix word in it no block can match.
    prefixes = _array(sorted({p for shape in shapes for p in shape[2]}))

    def reach(t: Column, block: Column) -> Column:
        """What template t can still reach, from the first prefix word that the block shares."""
        first = F.array_intersect(t["prefix"], block)[0]
        return F.least(F.size(t["words"]) - F.array_position(t["words"], first), F.size(block) - F.array_position(block, first)) + 1

    def best(t: Column, w: Column, anchors: Column) -> Column:
        """The most words of template t in a block of words w; 0 below the threshold. A block that reaches it
        holds a prefix word, and may as well begin at its first template word."""
        around = F.transform(F.filter(anchors, lambda i: F.array_contains(t["prefix"], F.get(w, i))), lambda i: F.sequence(F.greatest(F.lit(0), i - t["most"] + 1), i))
        begins = F.filter(F.array_distinct(F.flatten(around)), lambda i: F.array_contains(t["words"], F.get(w, i)))
        blocks = F.transform(begins, lambda i: F.array_intersect(in_rank_order, F.slice(w, i + 1, t["most"])))
        likely = F.filter(blocks, lambda x: (F.size(x) >= t["need"]) & F.arrays_overlap(t["prefix"], x) & F.coalesce(reach(t, x) >= t["need"], F.lit(False)))
        return F.coalesce(F.array_max(F.filter(F.transform(likely, lambda x: F.size(F.array_intersect(t["words"], x))), lambda n: n >= t["need"])), F.lit(0))

    def matches(w: Column) -> Column:
        def at(anchors: Column) -> Column:
            found = F.transform(postings, lambda t: F.struct(t["label"].alias("label"), best(t, w, anchors).alias("n"), F.size(t["words"]).alias("of")))
            return F.filter(found, lambda m: m["n"] > 0)

        return let(F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.array_contains(prefixes, F.get(w, i))), at)

    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"), F.array().cast("array<string>").alias("labels"))
    no_match = F.array().cast("array<struct<label:string,n:int,of:int>>")

    def of_words(t: Column, p: Column) -> Column:
        empty = (p[0] == "").cast("int") + ((F.size(p) > 1) & (F.element_at(p, -1) == "")).cast("int")
        words = F.filter(p, lambda w: w != "")
        return F.struct(
            (F.size(p) - empty).cast("long").alias("n_words"),
            # Every base phrase ends in one of these words.
            F.when(F.arrays_overlap(p, _array(sorted({x.split()[-1] for x in base}))), let(words, lambda w: _base_hits(w, base))).otherwise(nothing).alias("base"),
            F.when(F.arrays_overlap(p, prefixes), let(words, matches)).otherwise(no_match).alias("found"),
        )

    text = folded(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), let(text, lambda t: let(pieces(t), lambda p: of_words(t, p))).alias("x")).select("doc_id", "x.*")
    joined = lambda a: F.concat_ws(",", F.array_sort(F.array_distinct(a)))
    best = F.coalesce(F.array_max(F.transform("found", lambda m: m["n"] / m["of"])), F.lit(0.0))
    return rows.select(
        "doc_id",
        "n_words",
        F.col("base.n").alias("n_base"),
        F.col("base.first").alias("first_word"),
        F.col("base.last").alias("last_word"),
        joined(F.col("base.labels")).alias("base_labels"),
        joined(F.concat("base.labels", F.transform("found", lambda m: m["label"]))).alias("labels"),
        F.when(F.col("base.n") > 0, 1.0).otherwise(best).alias("score"),
    )
