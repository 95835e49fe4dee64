"""Licence scans by a positional index of rare words, with DataFrame functions only.

A template is a short licence notice. The index holds, of each template, the RARE words of highest IDF (over the
templates) of its mandatory key phrase, and posts each word to (template, position), a list for the first rare words and
one for the second; the posts are literal maps, so neither plan nor work on a word grows with the templates that lack it.
A file's words are looked up in the posts once, each post implies a start of its template, and the starts of the two
lists are intersected: only places remain where a template's rare words stand at the right distance. There the key
phrase must stand word for word. As all rare words are of the key phrase, each place of it is found, however the rest of
the notice is worded; the score is the largest share of a template's words that stand there. Places of base phrases are
found the same way, as templates of their own. Texts that lack the rarest word of every phrase are not cut into words.

Words are runs of ASCII letters and digits and of non-ASCII characters, after lower-casing A to Z. A null text is empty:
no words, null places, no labels, score 0. Very long texts are scanned whole; an empty table gives an empty one. Rows
don't meet, so repeated rows need no care; columns that have the name of a new one give way. Work on a file grows with
its words and the posts of those that it has.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import count_words, prefix

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing.
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RARE = 2
#: Phrase and label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label, notice, mandatory key phrase.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "copy modify and or distribute this software"),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1", "gnu lesser general public license version 2 1"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("artistic-2.0", "released under the artistic license 2 0", "artistic license 2 0"),
    ("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    ("cc0-1.0", "released under the creative commons zero v1 0 universal license", "creative commons zero"),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("wtfpl", "do what the fuck you want to public license", "do what the fuck you want to"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "in no event will the authors be held liable"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]


def index(templates: list[tuple[str, str, str]] = TEMPLATES, rare: int = RARE) -> list[dict]:
    """Templates with the rare words of their key phrases and the positions of these; IDF from the templates, ties to the earlier word."""
    split = [notice.split() for _, notice, _ in templates]
    among = Counter(w for words in split for w in set(words))
    out = []
    for (label, _, phrase), words in zip(templates, split):
        idf = {w: math.log((1 + len(templates)) / among[w]) for w in words}
        key = phrase.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        best = sorted(dict.fromkeys(key), key=lambda w: (-idf[w], key.index(w)))[:rare]
        out.append({"label": label, "words": words, "rare": [(w, at + key.index(w)) for w in best], "key": key, "at": at})
    return out


def cover(own: list[dict]) -> dict[str, set[tuple[str, ...]]]:
    """Few words of which each key phrase has one, and the rare words of the phrases that each stands for: a text without all of a phrase's words has no place of it."""
    left, out = list(own), {}
    while left:
        often = Counter(w for t in left for w in set(t["key"]))
        word = max(often, key=lambda w: (often[w], len(w), w))
        out[word] = {tuple(w for w, _ in t["rare"]) for t in left if word in t["key"]}
        left = [t for t in left if word not in t["key"]]
    return out


def postings(own: list[dict], nth: int) -> Column:
    """A literal map from each template's nth rare word (the last, if it has fewer) to its posts (template, position)."""
    found: dict[str, list[tuple[int, int]]] = {}
    for t, template in enumerate(own):
        word, at = template["rare"][min(nth, len(template["rare"]) - 1)]
        found.setdefault(word, []).append((t, at))
    post = lambda t, at: F.struct(F.lit(t).alias("t"), F.lit(at).alias("at"))
    return F.create_map(*[x for word, posts in found.items() for x in (F.lit(word), F.array(*[post(*p) for p in posts]))])


def scan(df: DataFrame, text: str = "text", templates: list[tuple[str, str, str]] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """df with n_words, n_base, first_word, last_word, base_labels, labels and score."""
    own = index([(label, phrase, phrase) for phrase, label in base.items()] + templates)
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kept = [F.col(c) for c in df.columns if c not in new]
    p = prefix(*df.columns, *new)
    whole = F.coalesce(F.col(text), F.lit(""))
    # lower-casing all letters may only add to what a text holds, and is cheap; A to Z alone are lowered where words are cut
    low = df.select(*kept, whole.alias(f"{p}text"), F.lower(whole).alias(f"{p}low"))
    has = lambda w: F.contains(F.col(f"{p}low"), F.lit(w))
    any_of = lambda some: reduce(operator.or_, some)
    hint = any_of([has(w) & any_of([has(rare[0]) & has(rare[-1]) for rare in sorted(pairs)]) for w, pairs in cover(own).items()])
    none = F.array().cast("array<string>")
    cut = F.regexp_extract_all(F.translate(f"{p}text", UPPER, LOWER), F.lit(WORD), F.lit(0))
    split = low.select(*kept, count_words(F.col(f"{p}text"), SEPARATORS, ANY_CASE).alias(f"{p}n"), F.when(hint, cut).otherwise(none).alias(f"{p}words"))
    words = F.col(f"{p}words")
    sought = sorted({w for t in own for w, _ in t["rare"]})
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(sought))

    def starts(nth: int) -> Column:
        posts = postings(own, nth)
        each = lambda x: F.transform(F.coalesce(F.element_at(posts, x["w"]), F.array().cast("array<struct<t:int,at:int>>")), lambda y: F.struct(y["t"].alias("t"), (x["i"] - y["at"]).alias("s")))
        return F.flatten(F.transform(F.col(f"{p}hits"), each))

    key = F.array(*[F.array(*map(F.lit, t["key"])) for t in own])
    notice = F.array(*[F.array(*map(F.lit, t["words"])) for t in own])
    at = F.array(*[F.lit(t["at"]) for t in own])
    of = lambda table, x: F.get(table, x["t"])
    first = lambda x: x["s"] + of(at, x)
    stands = lambda x: (first(x) >= 0) & (F.slice(words, F.greatest(first(x), F.lit(0)) + 1, F.size(of(key, x))) == of(key, x))
    both = starts(0)
    for nth in range(1, RARE):
        both = F.array_intersect(both, starts(nth))
    placed = split.withColumn(f"{p}hits", hits).withColumn(f"{p}at", F.filter(both, stands))
    n = len(base)
    every = F.transform(F.filter(f"{p}at", lambda x: x["t"] < n), lambda x: x["s"])
    share = lambda x: F.size(F.filter(F.transform(of(notice, x), lambda w, i: w.eqNullSafe(F.get(words, x["s"] + i))), lambda y: y)) / F.size(of(notice, x))
    names = F.array(*[F.lit(t["label"]) for t in own])
    labels = lambda some: F.array_join(F.array_sort(F.array_distinct(F.transform(some, lambda x: of(names, x)))), ",")
    return placed.select(
        *kept,
        F.col(f"{p}n").cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        labels(F.filter(f"{p}at", lambda x: x["t"] < n)).alias("base_labels"),
        labels(F.col(f"{p}at")).alias("labels"),
        F.when(F.size(every) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(f"{p}at", share)), F.lit(0.0))).alias("score"),
    )
