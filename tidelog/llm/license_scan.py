"""License scans: phrases by place, and notices by an exact set-similarity join.

Text blocks are matched with license templates by containment: the share of the template's
distinct words that the block holds. For a template of n words, every run of up to
``STRETCH`` n consecutive words of a text is a block, however its lines are broken. Words are
ordered by their frequency over the whole corpus, rarest first. A block that reaches the
threshold must hold one of the template's rarest ``|T| - ceil(t |T|) + 1`` words (prefix
filter), has at least ``ceil(t |T|)`` distinct words (length filter), and of the words it shares
the rarest must stand early enough that the rest can still suffice (positional filter). What
passes is verified by counting over a sliding window, so the result is that of comparing every
block with every template. Templates go to the tasks in batches of bounded size, one pass each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

THRESHOLD = 0.8
#: A block has at most so many times the words of the template.
STRETCH = 1.25
#: Templates whose index is sent to all tasks at once; more take more passes.
BATCH = 1000

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices and the labels they stand for.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]

# Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z: digits, letters and all that isn't ASCII.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<first:long,last:long,template:int,containment:double>>"


def license_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_CLEAN).split() if text else []


@dataclass(frozen=True)
class Index:
    first: int  # number of the first template
    sets: list[frozenset[bytes]]
    longest: list[int]  # words of a block at most
    needed: list[int]
    rank: dict[bytes, int]
    prefix: dict[bytes, list[tuple[int, int]]]


def build_index(templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float, first: int = 0) -> Index:
    listed = [license_words(t) for _, t in templates]
    sets = [frozenset(words) for words in listed]
    needed = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in sets]
    every = sorted(set().union(*sets), key=lambda w: (frequency.get(w, 0), w)) if sets else []
    rank = {w: i for i, w in enumerate(every)}
    prefix: dict[bytes, list[tuple[int, int]]] = {}
    for k, (words, n) in enumerate(zip(sets, needed)):
        for place, w in enumerate(sorted(words, key=rank.__getitem__)[: len(words) - n + 1]):
            prefix.setdefault(w, []).append((k, place))
    return Index(first, sets, [math.ceil(STRETCH * len(words)) for words in listed], needed, rank, prefix)


def candidates(text: list[bytes], index: Index) -> list[int]:
    """Templates that some block of the text may contain to the threshold, by the three filters."""
    words = set(text)
    known = sorted((w for w in words if w in index.rank), key=index.rank.__getitem__)
    done, out = set(), []
    for at, w in enumerate(known):
        for k, place in index.prefix.get(w, ()):
            if k in done or len(words) < index.needed[k]:
                continue
            done.add(k)  # w is the rarest word that text and template share: others before it failed
            if min(len(index.sets[k]) - place, len(known) - at) >= index.needed[k]:
                out.append(k)
    return out


def blocks(text: list[bytes], words: frozenset[bytes], needed: int, longest: int) -> list[tuple[int, int, float]]:
    """(first word, last word, containment) of blocks that hold ``needed`` of ``words``: of those that
    overlap, the first with the most."""
    at = [i for i, w in enumerate(text) if w in words]
    held: Counter = Counter()
    out: list[tuple[int, int, float]] = []
    left = 0
    for right, last in enumerate(at):
        held[text[last]] += 1
        while last - at[left] >= longest or held[text[at[left]]] > 1:
            # a word that stands again, or is too far back, only makes the block longer
            w = text[at[left]]
            held[w] -= 1
            if not held[w]:
                del held[w]
            left += 1
        if len(held) >= needed:
            share = len(held) / len(words)
            if out and at[left] <= out[-1][1]:
                if share > out[-1][2]:
                    out[-1] = (at[left], last, share)
            else:
                out.append((at[left], last, share))
    return out


def word_frequencies(docs: DataFrame, words: set[bytes]) -> dict[bytes, int]:
    """In how many documents each of these words occurs, over all documents."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for frame in frames:
            for text in frame["text"]:
                total.update(words.intersection(license_words(text)))
        yield pd.DataFrame({"word": list(total), "n": list(total.values())})

    found = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(count, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in found.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """A row per row of ``docs``: word count, phrase places, labels, score and matched blocks (words
    from 0, template's number, containment).

    ``score`` is 1 where a phrase stands, else the largest containment found, else 0. Null and
    empty texts have no words and no labels. Null ids and repeated rows come out as they came in;
    an empty table gives an empty table. Extra columns are left out.
    """
    templates = TEMPLATES if templates is None else templates
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.withColumn("matches", F.array().cast(MATCHES))
    for first in range(0, len(templates), BATCH):
        batch = templates[first : first + BATCH]
        frequency = word_frequencies(docs, set().union(*[license_words(t) for _, t in batch]))
        found = _with_matches(found, build_index(batch, frequency, threshold, first))
    phrases = [(b" " + p.encode() + b" ", label) for p, label in PHRASES.items()]
    labels_of = [label for label, _ in templates]

    def one(text: str | None, matched) -> tuple:
        words = license_words(text)
        joined = b" " + b" ".join(words) + b" "
        places, base = [], set()
        for phrase, label in phrases:
            at, word, seen = joined.find(phrase), 0, 0
            while at >= 0:
                word, seen = word + joined.count(b" ", seen, at), at
                places.append(word)
                base.add(label)
                at = joined.find(phrase, at + 1)
        labels = base | {labels_of[m["template"]] for m in matched}
        score = 1.0 if base else max((m["containment"] for m in matched), default=0.0)
        return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = pd.DataFrame([one(t, m) for t, m in zip(frame["text"], frame["matches"])], columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
            out["first_word"], out["last_word"] = out["first_word"].astype("Int64"), out["last_word"].astype("Int64")
            out.insert(0, "doc_id", pd.array([None if pd.isna(x) else int(x) for x in frame["doc_id"]], dtype="Int64"))
            out["matches"] = frame["matches"].tolist()
            yield out

    return found.mapInPandas(run, RESULT)


MATCHES = "array<struct<first:bigint,last:bigint,template:int,containment:double>>"


def _with_matches(docs: DataFrame, index: Index) -> DataFrame:
    """Adds the blocks that this batch's templates match to the column ``matches``."""
    first = frozenset(index.prefix)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text, before in zip(frame["text"], frame["matches"]):
                words = license_words(text)
                new = [] if first.isdisjoint(words) else [
                    {"first": a, "last": b, "template": index.first + k, "containment": c}
                    for k in candidates(words, index) for a, b, c in blocks(words, index.sets[k], index.needed[k], index.longest[k])
                ]
                out.append([*before, *new])
            yield frame.assign(matches=pd.Series(out, index=frame.index, dtype=object))

    return docs.mapInPandas(run, "doc_id string, text string, matches " + MATCHES)
