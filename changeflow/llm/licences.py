"""Licence notices by a positional index of rare words, in DataFrame expressions alone.

Every file is indexed once: its number of words, and which words of known licence notices it
holds. How many files hold a word gives its inverse document frequency. A notice can only stand
where all words of its mandatory key phrase stand, so the phrase's two rarest words are looked up
first: where both stand at the right distance, the phrase is verified word by word, and the notice
is laid over the text at that place. The share of the notice's rarity found there is its score.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.common import saved, table

# Labels, key phrases and wording of common public licence notices.
BASE = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
#: Label, mandatory key phrase, and the notice that holds it.
NOTICES = (
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge",
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction"),
    ("apache-2", "apache license version 2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial",
     "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "creative commons attribution 4", "licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "gnu general public license version 3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "gnu general public license version 2", "licensed under the gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license", "licensed under the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms",
     "redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met"),
    ("mpl-2", "mozilla public license",
     "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
#: What is no word, in the original text: all of ASCII but letters and digits.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of a notice's rarity that must stand around its key phrase for its label.
SHARE = 0.5


def _words(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def _strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _starts(words: Column, phrase: list[str], first: int, second: int) -> Column:
    """Places where a phrase stands: its two given words are looked up before the rest is compared."""
    places = F.sequence(F.lit(1), F.size(words) - len(phrase) + 1)
    places = F.when(F.size(words) >= len(phrase), places).otherwise(F.array().cast("array<int>"))
    return F.filter(
        places,
        lambda i: (F.get(words, i - 1 + first) == phrase[first])
        & (F.get(words, i - 1 + second) == phrase[second])
        & (F.slice(words, i, len(phrase)) == _strings(phrase)),
    )


def _rarest(phrase: list[str], idf: dict[str, float]) -> tuple[int, int]:
    order = sorted(range(len(phrase)), key=lambda k: (-idf[phrase[k]], k))
    return order[0], order[1]


def _place(label: str) -> Callable[[Column], Column]:
    return lambda i: F.struct(F.lit(label).alias("label"), (i - 1).cast("long").alias("start"))


def _laid(words: Column, notice: list[str], inside: int, idf: dict[str, float]) -> Callable[[Column], Column]:
    """Share of a notice's rarity that stands in place if its key phrase, ``inside`` it, starts at i."""
    total = sum(idf[w] for w in notice)

    def share(i: Column) -> Column:
        out = F.lit(0.0)
        for j, word in enumerate(notice):
            at = i - 1 - inside + j
            out += F.when((at >= 0) & (F.get(words, at) == word), F.lit(idf[word])).otherwise(F.lit(0.0))
        return F.least(F.round(out / total, 9), F.lit(1.0))

    return share


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """``(id, n_words, places, labels, score)`` per row.

    ``places`` lists ``(label, start)`` of the base phrases, starts in words from 0; ``labels``
    holds the distinct labels of base phrases and notices in order; ``score`` is the best notice's
    share (0 without one). Null and empty texts have no words. Repeated rows and null ids stay
    rows of their own; no rows give no rows.
    """
    vocabulary = sorted({w for _, phrase, notice in NOTICES for w in f"{phrase} {notice}".split()} | {w for p in BASE.values() for w in p.split()})
    phrases = [p.split() for p in dict.fromkeys([*BASE.values(), *(p for _, p, _ in NOTICES)])]
    lowered = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    indexed = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), lowered.alias("low"))
        .select("id", "text", _words(F.col("low")).alias("words"))
        .select(
            "id",
            "text",
            F.size("words").cast("long").alias("n_words"),
            F.array_intersect(_strings(vocabulary), "words").alias("known"),
        )
    )
    possible = F.lit(False)
    for phrase in phrases:
        needed = sorted(set(phrase))
        possible |= F.size(F.array_intersect("known", _strings(needed))) == len(needed)
    indexed = indexed.select("id", "n_words", "known", F.when(possible, F.col("text")).alias("text"))
    indexed = saved(indexed, "licences")

    # One row per licence word at most comes back: the vocabulary bounds it.
    files = indexed.count()
    held = {r[0]: r[1] for r in indexed.select(F.explode("known").alias("word")).groupBy("word").count().collect()}
    idf = {w: math.log(1 + files / (1 + held.get(w, 0))) for w in vocabulary}

    words = F.col("words")
    found = indexed.select(
        "id", "n_words", _words(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)).alias("words")
    )
    columns = []
    for k, (label, phrase) in enumerate(BASE.items()):
        cut = phrase.split()
        starts = _starts(words, cut, *_rarest(cut, idf))
        columns.append(F.transform(starts, _place(label)).alias(f"base{k}"))
    for k, (_, phrase, notice) in enumerate(NOTICES):
        cut, whole = phrase.split(), notice.split()
        inside = next(i for i in range(len(whole)) if whole[i : i + len(cut)] == cut)
        starts = _starts(words, cut, *_rarest(cut, idf))
        columns.append(F.coalesce(F.array_max(F.transform(starts, _laid(words, whole, inside, idf))), F.lit(0.0)).alias(f"notice{k}"))
    laid_out = found.select("id", "n_words", *columns)
    places = F.concat(*[f"base{k}" for k in range(len(BASE))])
    labels = [F.when(F.size(f"base{k}") > 0, F.lit(label)) for k, label in enumerate(BASE)]
    labels += [F.when(F.col(f"notice{k}") >= share, F.lit(label)) for k, (label, _, _) in enumerate(NOTICES)]
    return laid_out.select(
        "id",
        "n_words",
        places.alias("places"),
        F.sort_array(F.array_distinct(F.array_compact(F.array(*labels)))).alias("labels"),
        F.greatest(*[f"notice{k}" for k in range(len(NOTICES))]).alias("score"),
    )


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["start"])).alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(F.transform("places", lambda p: p["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
