"""License scan by a positional index of rare words, in DataFrame functions only.

Every template is filed under its rarest word (highest inverse document frequency in the scanned corpus).
The places of such words in a file give, by relative position, the places where a template may start; a place
counts when enough of the template's words stand where they should and all its mandatory phrases do.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.llm.common import LOWER, UPPER

#: What is no part of a word.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    #: Share of the words that must stand at their places.
    least: float = 1.0
    #: Phrases of the template that must be there whole.
    need: tuple[str, ...] = ()


#: Phrases that are reported as they are.
BASE = (Template("cc-by", "cc by"), Template("gpl", "general public license"), Template("reserved", "all rights reserved"))
#: Notices in common use, matched with some words changed.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", 0.75, ("apache license",)),
    Template("gpl-notice", "this work is licensed under the gnu general public license version 3", 0.75, ("general public license",)),
    Template("lgpl", "gnu lesser general public license", 0.8, ("lesser general public",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", 0.6, ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", 0.6, ("cc by sa",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", 0.6, ("cc by nd",)),
    Template("mpl", "subject to the terms of the mozilla public license v 2 0", 0.6, ("mozilla public license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", 0.8, ("permission is hereby granted", "free of charge")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 0.8, ("source and binary forms",)),
    Template("public-domain", "released into the public domain", 0.6, ("public domain",)),
)


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null and empty texts have none."""
    flat = F.trim(F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), GAP, " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def word_weights(words: DataFrame, column: str, known: list[str]) -> dict[str, float]:
    """Inverse document frequency of the templates' words; as many rows as they have words reach the driver."""
    n = words.count()
    found = words.select(F.explode(F.array_intersect(F.col(column), F.array(*map(F.lit, known)))).alias("w")).groupBy("w").count()
    seen = {r["w"]: r["count"] for r in found.collect()}
    return {w: math.log((n + 1) / (seen.get(w, 0) + 1)) + 1e-9 for w in known}


def _literal(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _index(templates: tuple[Template, ...], weight: dict[str, float], base: int) -> Column:
    """The index as an array of entries: key word, its place, the template, its mandatory phrases."""
    entries = []
    for k, t in enumerate(templates):
        words = t.words.split()
        place = max(range(len(words)), key=lambda i: (weight[words[i]], -i))
        need = []
        for phrase in t.need:
            p = phrase.split()
            at = next(i for i in range(len(words)) if words[i : i + len(p)] == p)
            need.append(F.struct(F.lit(at).alias("at"), _literal(p).alias("words")))
        entries.append(
            F.struct(
                F.lit(words[place]).alias("key"), F.lit(place).alias("place"), F.lit(t.label).alias("label"), F.lit(k < base).alias("base"),
                _literal(words).alias("words"), F.array(*[F.lit(weight[w]) for w in words]).alias("weights"), F.lit(t.least).alias("least"),
                (F.array(*need) if need else F.array().cast("array<struct<at:int,words:array<string>>>")).alias("need"),
            )
        )
    return F.array(*entries)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[Template, ...] = BASE, notices: tuple[Template, ...] = NOTICES) -> DataFrame:
    """The id, n_words and matches: array of (label, base, start, share of the template's weight found).

    Two scans (frequencies, matches), no row is shuffled. Null or empty texts have no words and no matches;
    a null id stays null; repeated rows are scanned one by one; other columns are not read.
    """
    templates = (*base, *notices)
    source = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("w"))
    known = sorted({w for t in templates for w in t.words.split()})
    weight = word_weights(source, "w", known)
    index = _index(templates, weight, len(base))
    keys = sorted({max(t.words.split(), key=lambda w: weight[w]) for t in templates})
    rare = F.filter(F.transform(F.col("w"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda h: h["x"].isin(keys))
    placed = source.select(
        "id", "w", F.size("w").alias("n"), F.when(F.arrays_overlap("w", _literal(keys)), rare).alias("hits")
    )

    def aligned(c: Column) -> Column:
        here = F.slice(F.col("w"), c["start"] + 1, F.size(c["e"]["words"]))
        same = F.zip_with(here, c["e"]["words"], lambda a, b: F.when(a == b, 1).otherwise(0))
        hit = F.aggregate(F.zip_with(same, c["e"]["weights"], lambda s, x: s * x), F.lit(0.0), lambda a, b: a + b)
        total = F.aggregate(c["e"]["weights"], F.lit(0.0), lambda a, b: a + b)
        return F.struct(
            c["e"]["label"].alias("label"), c["e"]["base"].alias("base"), c["start"].cast("long").alias("start"), (hit / total).alias("share"),
            (F.aggregate(same, F.lit(0), lambda a, b: a + b) >= c["e"]["least"] * F.size(c["e"]["words"])).alias("enough"),
            F.forall(c["e"]["need"], lambda k: F.slice(F.col("w"), c["start"] + 1 + k["at"], F.size(k["words"])) == k["words"]).alias("whole"),
        )

    starts = F.flatten(
        F.transform(
            F.col("hits"),
            lambda h: F.transform(F.filter(index, lambda e: e["key"] == h["x"]), lambda e: F.struct((h["i"] - e["place"]).alias("start"), e.alias("e"))),
        )
    )
    inside = F.filter(starts, lambda c: (c["start"] >= 0) & (c["start"] + F.size(c["e"]["words"]) <= F.col("n")))
    found = F.filter(F.transform(inside, aligned), lambda m: m["enough"] & m["whole"])
    matches = F.when(F.col("hits").isNotNull(), F.transform(found, lambda m: F.struct(m["label"].alias("label"), m["base"].alias("base"), m["start"].alias("start"), m["share"].alias("share"))))
    return placed.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_words"), matches.alias("matches"))


def summary(matches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per file from ``scan``: places of base phrases, labels, and the best match as score (0 if none)."""
    m = F.coalesce(F.col("matches"), F.array().cast(matches.schema["matches"].dataType))
    base = F.filter(m, lambda x: x["base"])
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    return matches.select(
        id_col, "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["start"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(m).alias("labels"),
        F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform(m, lambda x: x["share"])), F.lit(0.0))).alias("score"),
    )
