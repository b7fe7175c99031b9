"""Licence scans by a positional index of the templates' words (operator 8).

Licence texts are templates. A template's words are indexed with their places, and each word's inverse
document frequency is counted over all documents. Every word is indexed, however many documents have it. In
each document that has all mandatory phrases of a template, all of the template's words are looked up;
every posting they meet says where the template would have to begin, and postings that agree on the
beginning are intersected. An alignment counts when enough of the template's IDF weight stands in its
place and all of the template's mandatory phrases stand near theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .licence_texts import TEXTS
from .words import ALNUM, LOWER, Chunk, chunks

#: Phrases of which each place counts, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Opening words and usual notices; label, text, mandatory phrases. Whole texts stand in licence_texts.
TEMPLATES = [
    ("mit", "Released under the MIT License.", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ["permission is hereby granted free of charge"]),
    ("apache", "Licensed under the Apache License, Version 2.0.", ["apache license"]),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", ["gnu general public license"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ["free software", "gnu general public license"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ["gnu affero general public license"]),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["mozilla public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ["cc by nc"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", ["cc by sa"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ["creative commons attribution"]),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ["released into the public domain"]),
    *TEXTS,
]

#: The least share of a template's IDF weight in its place, and how far a mandatory phrase may be from its place.
LEAST, SLACK = 0.6, 4
#: Words of templates that are compared with the text at one time.
_ALIGNED = 400_000


class Index(NamedTuple):
    """The templates' words as hashes: template t has words[first[t]:first[t + 1]], as places in vocabulary."""

    labels: list[str]
    vocabulary: np.ndarray
    words: np.ndarray
    first: np.ndarray
    phrases: list[list[tuple[np.ndarray, int]]]  # of each template the hashes and the place of each mandatory phrase


def _hashes(texts: list[str]) -> list[np.ndarray]:
    (c,) = chunks(pa.array(texts, pa.string()), ALNUM, LOWER, limit=1 << 62)
    return np.split(c.hashes(), c.first[1:-1])


def places_of(hashes: np.ndarray, phrase: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Where the phrase's words stand consecutively inside one text."""
    at = np.flatnonzero(hashes == phrase[0])
    at = at[at + len(phrase) <= last[at]]
    for j, h in enumerate(phrase[1:], 1):
        at = at[hashes[at + j] == h]
    return at


def build_index(templates: list[tuple[str, str, list[str]]]) -> Index:
    words = _hashes([t for _, t, _ in templates])
    vocabulary = np.unique(np.concatenate(words))
    phrases = []
    for own, (label, _, mandatory) in zip(words, templates, strict=True):
        found = []
        for phrase in _hashes(mandatory):
            at = places_of(own, phrase, np.full(len(own), len(own)))
            if not len(at):
                raise ValueError(f"a template of {label} has not its mandatory phrase")
            found.append((phrase, int(at[0])))
        phrases.append(found)
    first = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    return Index([x for x, _, _ in templates], vocabulary, np.searchsorted(vocabulary, np.concatenate(words)), first, phrases)


def _known(index: Index, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of words that templates have, and which words they are."""
    word = np.minimum(np.searchsorted(index.vocabulary, hashes), len(index.vocabulary) - 1)
    at = np.flatnonzero(index.vocabulary[word] == hashes)
    return at, word[at]


def _frequencies(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """In how many texts each template word stands; word -1 has the number of texts."""
    counts, texts = np.zeros(len(index.vocabulary), np.int64), 0
    for batch in batches:
        for c in chunks(batch.column(0), ALNUM, LOWER):
            at, word = _known(index, c.hashes())
            text = np.searchsorted(c.first, at, "right") - 1
            counts += np.bincount(np.unique(text * len(counts) + word) % len(counts), minlength=len(counts))
            texts += c.rows.stop - c.rows.start
    yield pa.RecordBatch.from_pydict({"word": pa.array(np.arange(-1, len(counts)), pa.int32()), "n": np.concatenate([[texts], counts])})


def _stand(c: Chunk, found: np.ndarray, size: int, text: np.ndarray, near: np.ndarray, slack: int) -> np.ndarray:
    """Whether one of a phrase's places (sorted) is inside the text and at most ``slack`` from ``near``."""
    low, high = np.maximum(c.first[text], near - slack), np.minimum(c.first[text + 1] - size, near + slack)
    return np.searchsorted(found, low, "left") < np.searchsorted(found, high, "right")


def alignments(c: Chunk, hashes: np.ndarray, index: Index, idf: np.ndarray, least: float, slack: int) -> dict[int, tuple[set[str], float]]:
    """Labels and best score of each text that has a verified alignment."""
    out: dict[int, tuple[set[str], float]] = {}
    at, word = _known(index, hashes)
    text, last = np.searchsorted(c.first, at, "right") - 1, c.last()
    n = len(c.first) - 1
    for tpl, label in enumerate(index.labels):
        # Without all of its mandatory phrases a text can't have the template.
        found = [places_of(hashes, phrase, last) for phrase, _ in index.phrases[tpl]]
        has = np.ones(n, bool)
        for places in found:
            one = np.zeros(n, bool)
            one[np.searchsorted(c.first, places, "right") - 1] = True
            has &= one
        if not has.any():
            continue
        want = index.words[index.first[tpl] : index.first[tpl + 1]]
        weight, total = idf[want], float(idf[want].sum())
        # Postings of all its words in those texts: where would the template begin?
        order = np.argsort(want, kind="stable")
        mine = has[text] & np.isin(word, want)
        begin, end = np.searchsorted(want[order], word[mine], "left"), np.searchsorted(want[order], word[mine], "right")
        size = end - begin
        posting = order[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]
        span = len(hashes) + len(want)
        keys = np.repeat(text[mine], size) * span + np.repeat(at[mine], size) - posting + len(want)
        near = np.ones(len(keys), bool)
        for places, (phrase, where) in zip(found, index.phrases[tpl], strict=True):
            near &= _stand(c, places, len(phrase), keys // span, keys % span - len(want) + where, slack)
        keys, inverse = np.unique(keys[near], return_inverse=True)
        votes = np.bincount(inverse, weights=weight[posting[near]], minlength=len(keys))
        # Words in place weigh half of the score, so with fewer votes it can't reach the least one.
        keys = keys[votes >= (2 * least - 1) * total - 1e-9]
        step = max(1, _ALIGNED // len(want))
        for k in range(0, len(keys), step):
            t, s = keys[k : k + step] // span, keys[k : k + step] % span - len(want)
            moved = np.zeros((len(t), len(want)), bool)
            for shift in range(-slack, slack + 1):
                place = (s + shift)[:, None] + np.arange(len(want))
                inside = (place >= c.first[t][:, None]) & (place < c.first[t + 1][:, None])
                same = inside & (hashes[np.clip(place, 0, len(hashes) - 1)] == index.vocabulary[want])
                moved |= same
                if shift == 0:
                    placed = same @ weight
            # Words in place count twice as much as words that an insertion or omission has moved a little.
            score = (placed + moved @ weight) / (2 * total)
            for own, x in zip(t[score >= least].tolist(), score[score >= least].tolist(), strict=True):
                labels, best = out.get(own, (set(), 0.0))
                out[own] = (labels | {label}, max(best, min(x, 1.0)))
    return out


def _scan(batches: Iterator[pa.RecordBatch], index: Index, idf: np.ndarray, phrases: list[tuple[np.ndarray, str]], least: float, slack: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column(1), ALNUM, LOWER):
            hashes, last, n = c.hashes(), c.last(), c.rows.stop - c.rows.start
            found = [places_of(hashes, p, last) for p, _ in phrases]
            at = np.concatenate(found)
            text = np.searchsorted(c.first, at, "right") - 1
            own = at - c.first[text]
            first, final = np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
            np.minimum.at(first, text, own)
            np.maximum.at(final, text, own)
            base: list[set[str]] = [set() for _ in range(n)]
            for places, (_, label) in zip(found, phrases, strict=True):
                for t in np.unique(np.searchsorted(c.first, places, "right") - 1).tolist():
                    base[t].add(label)
            aligned = alignments(c, hashes, index, idf, least, slack)
            none = final < 0
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0).slice(c.rows.start, n), "n_words": c.counts, "n_base": np.bincount(text, minlength=n).astype(np.int64),
                "first_word": pa.array(first, mask=none), "last_word": pa.array(final, mask=none),
                "base_labels": [",".join(sorted(x)) for x in base],
                "labels": [",".join(sorted(x | aligned[t][0] if t in aligned else x)) for t, x in enumerate(base)],
                "score": np.array([aligned[t][1] if t in aligned else 0.0 for t in range(n)]),
            })


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str, list[str]]] = TEMPLATES, least: float = LEAST, slack: int = SLACK) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, the phrases' places and labels, all labels and a score.

    A null text counts as empty: no words, no places (first_word and last_word null), labels '' and
    score 0. Labels are distinct and sorted. Document frequencies are counted over all rows, repeated
    ones too; the driver gets one count for each template word.
    """
    index = build_index(templates)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = own.select("text").mapInArrow(lambda it: _frequencies(it, index), "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    by_word = {r.word: r.n for r in counts.collect()}
    total = by_word.get(-1, 0)
    df = np.array([by_word.get(i, 0) for i in range(len(index.vocabulary))], np.float64)
    # Smoothed: a word that all rows have still weighs something against one that none has.
    idf = np.log((total + 1) / (df + 1)) + 1
    wanted = list(zip(_hashes(list(phrases)), phrases.values(), strict=True))
    return own.mapInArrow(
        lambda it: _scan(it, index, idf, wanted, least, slack), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
