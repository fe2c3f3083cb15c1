"""Operator 5: licence scan with a positional index of rare licence words.

Index: the words of the licence texts and notices, with their document frequencies over the whole corpus (one pass, a
table of a few hundred rows), and postings that name templates and positions. A text matches a template if
``LEAST`` of the template's IDF weight stands in place; words rarer than some bound must then be among the matches,
as the commoner ones together weigh less. Only words above that bound get postings, so leaving out the rest loses no match.

Scan: a file's words with postings are its highest-IDF licence words; a file without any is done. A template's first
mandatory phrase gives the places where it may stand; such a place is kept if a posting of the file's rare words agrees
with it on the relative position, and if the other mandatory phrases stand at theirs. Then all words of the
template are looked up around their places. The further a word is from the phrase, the more inserted or missing words
it allows for (``DRIFT`` and one more for every ``STRETCH`` words).

The base phrases are found exactly: every place where a phrase's words stand consecutively.

The score is the share of a template's IDF weight that stands in place, the best over the file. A base phrase alone has the
share that it makes of the shortest template that holds it.

Defined cases: null text is empty (no words, no labels, score 0); repeated rows are scanned alike; other columns are
ignored; an empty table gives no rows. All places of a text of any length are verified, by array operations.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanweave.llm.common import find_words, hash_words, slices, text_bytes
from spanweave.llm.licence_texts import LICENCES

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Short licence notices, a mandatory phrase, and the label they give.
NOTICES = [
    ("this work is licensed under the gnu general public license version 3", "gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license", "gpl"),
    ("licensed under the gnu lesser general public license", "lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "in compliance with the license", "apache-2.0"),
    ("released under the mit license", "mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge", "mit"),
    ("licensed under cc by nc 4 0", "cc by nc", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc by sa", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc by nd", "cc-by-nd"),
    ("licensed under cc by 4 0", "cc by 4 0", "cc-by-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all rights reserved", "all-rights-reserved"),
]
DRIFT = 2
STRETCH = 16
LEAST = 0.6

#: Bytes that separate words: every ASCII byte but digits and a-z (A-Z count as a-z); other bytes are letters.
APART = np.zeros(256, bool)
APART[:0x80] = True
APART[0x30:0x3A] = False
APART[0x61:0x7B] = False
APART[0x41:0x5B] = False


def _hash(words: list[str]) -> np.ndarray:
    raw = "".join(words).encode()
    ends = np.cumsum([len(w.encode()) for w in words])
    return hash_words(np.frombuffer(raw, np.uint8), np.concatenate([[0], ends[:-1]]), ends)


def words_of(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


#: (label, mandatory phrases, text) as words.
TEMPLATES = [(label, [words_of(p) for p in phrases], words_of(text))
             for label, phrases, text in [*((label, (phrase,), text) for text, phrase, label in NOTICES), *LICENCES]]


def vocabulary() -> list[str]:
    return sorted({w for _, _, words in TEMPLATES for w in words} | {w for p in BASE for w in p.split()})


def _known(data, offsets, vocab_hash, vocab_order):
    """(words per row, row, position in its row, vocabulary number) of the licence words."""
    starts, ends, at = find_words(data, offsets, APART)
    h = hash_words(data, starts, ends)
    place = np.searchsorted(vocab_hash, h)
    place[place == len(vocab_hash)] = 0
    hit = np.flatnonzero(vocab_hash[place] == h)
    row = np.searchsorted(at, hit, side="right") - 1
    return np.diff(at), row, hit - at[row], vocab_order[place[hit]]


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[dict[str, int], int]:
    """How many documents hold each licence word, and how many documents there are."""
    words = vocabulary()
    hashes = _hash(words)
    order = np.argsort(hashes)
    hashes = hashes[order]

    def run(batches):
        total, n = np.zeros(len(words), np.int64), 0
        for batch in slices(batches):
            _, row, _, word = _known(*text_bytes(batch.column(0)), hashes, order)
            seen = np.unique(row * len(words) + word)
            total += np.bincount(seen % len(words), minlength=len(words))
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(words))), pa.array(np.concatenate([[n], total]))],
                                         names=["word", "n"])

    rows = docs.select(text_col).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    count = {r["word"]: r["n"] for r in rows}
    return {w: count.get(k, 0) for k, w in enumerate(words)}, count.get(-1, 0)


def _within(text: list, part: list) -> int:
    """First place of ``part`` in ``text``, -1 if there is none."""
    return next((k for k in range(len(text) - len(part) + 1) if text[k:k + len(part)] == part), -1)


class Template:
    """A licence text as vocabulary numbers: its phrases with their places, and the words that get postings."""

    def __init__(self, label: str, words: list[int], phrases: list[list[int]], idf: np.ndarray):
        self.label, self.words = label, np.array(words)
        self.phrases = [(_within(words, p), p) for p in phrases]
        self.origin = self.phrases[0][0]
        self.slack = DRIFT + np.abs(np.arange(len(words)) - self.origin) // STRETCH
        self.weight = idf[self.words]
        self.least = LEAST * self.weight.sum()
        rising = np.sort(self.weight)
        bound = rising[np.searchsorted(np.cumsum(rising), self.least)]
        self.rare = np.flatnonzero(self.weight >= bound)


class Index:
    """Templates with IDF weights and postings, and the base phrases."""

    def __init__(self, df: dict[str, int], docs: int):
        self.words = vocabulary()
        number = {w: k for k, w in enumerate(self.words)}
        idf = np.array([math.log((docs + 1) / (df[w] + 1)) + 1e-3 for w in self.words])
        self.templates = [Template(label, [number[w] for w in words], [[number[w] for w in p] for p in phrases], idf)
                          for label, phrases, words in TEMPLATES]
        self.rare = np.zeros(len(self.words), bool)
        for t in self.templates:
            self.rare[t.words[t.rare]] = True
        self.base = [([number[w] for w in phrase.split()], label) for phrase, label in BASE.items()]
        self.base_score = {}
        for ids, label in self.base:
            whole = min((t.weight.sum() for t in self.templates if _within(t.words.tolist(), ids) >= 0), default=math.inf)
            self.base_score[label] = min(1.0, float(idf[ids].sum() / whole))
        self.gap = 2 * max(len(t.words) + int(t.slack.max()) for t in self.templates)
        self.hashes = _hash(self.words)
        self.order = np.argsort(self.hashes)
        self.hashes = self.hashes[self.order]


class Places:
    """Where the licence words of a batch stand. Rows are set apart by more than a template's length, so that no
    match reaches from one into the next."""

    def __init__(self, word: np.ndarray, at: np.ndarray, size: int):
        order = np.argsort(word, kind="stable")
        self.at, self.cut = at[order], np.searchsorted(word[order], np.arange(size + 1))

    def of(self, word: int) -> np.ndarray:
        return self.at[self.cut[word]:self.cut[word + 1]]

    def near(self, word: int, at: np.ndarray, slack: int) -> np.ndarray:
        """Whether ``word`` stands within ``slack`` of each place."""
        found = self.of(word)
        return np.searchsorted(found, at - slack) < np.searchsorted(found, at + slack, side="right")

    def phrase(self, ids: list[int]) -> np.ndarray:
        """Every place where the words stand consecutively."""
        at = self.of(ids[0])
        for k in range(1, len(ids)):
            at = at[self.near(ids[k], at + k, 0)]
        return at

    def template(self, t: Template) -> tuple[np.ndarray, np.ndarray]:
        """(places of the first phrase, share of the IDF weight in place) where the template stands."""
        at = self.phrase(t.phrases[0][1])
        if len(at):
            agree = np.zeros(len(at), bool)
            for q in t.rare.tolist():
                agree |= self.near(t.words[q], at + (q - t.origin), t.slack[q])
            at = at[agree]
        for q, ids in t.phrases[1:]:
            found = self.phrase(ids) if len(at) else at
            low = np.searchsorted(found, at + (q - t.origin) - t.slack[q])
            at = at[low < np.searchsorted(found, at + (q - t.origin) + t.slack[q], side="right")]
        weight = np.zeros(len(at))
        if len(at):
            for q, w in enumerate(t.words.tolist()):
                weight += t.weight[q] * self.near(w, at + (q - t.origin), t.slack[q])
        keep = weight >= t.least - 1e-9
        return at[keep], weight[keep] / t.weight.sum()


def _scan(index: Index, n: np.ndarray, row: np.ndarray, pos: np.ndarray, word: np.ndarray) -> list[np.ndarray | list]:
    """Columns of a batch from its licence words: base counts and places, base labels, labels, scores."""
    rows = len(n)
    start = np.concatenate([[0], np.cumsum(n + index.gap)[:-1]]) if rows else n
    base = Places(word, start[row] + pos, len(index.words))
    looked = np.bincount(row[index.rare[word]], minlength=rows) > 0
    kept = looked[row]
    known = Places(word[kept], start[row[kept]] + pos[kept], len(index.words))
    n_base, first, last = np.zeros(rows, np.int64), np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
    base_of: list[set] = [set() for _ in range(rows)]
    more_of: list[set] = [set() for _ in range(rows)]
    score = np.zeros(rows)

    def row_of(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(start, at, side="right") - 1
    for ids, label in index.base:
        at = base.phrase(ids)
        r = row_of(at)
        np.add.at(n_base, r, 1)
        np.minimum.at(first, r, at - start[r])
        np.maximum.at(last, r, at - start[r])
        np.maximum.at(score, r, index.base_score[label])
        for k in np.unique(r).tolist():
            base_of[k].add(label)
    for t in index.templates:
        at, share = known.template(t)
        r = row_of(at)
        np.maximum.at(score, r, np.minimum(share, 1.0))
        for k in np.unique(r).tolist():
            more_of[k].add(t.label)
    none = n_base == 0
    return [pa.array(n), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none),
            pa.array([",".join(sorted(x)) for x in base_of], pa.string()),
            pa.array([",".join(sorted(x | y)) for x, y in zip(base_of, more_of)], pa.string()), pa.array(score)]


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: word count, base places and labels, all labels, and the score."""
    index = Index(*document_frequencies(docs, text_col))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches):
        for batch in slices(batches):
            found = _known(*text_bytes(batch.column(1)), index.hashes, index.order)
            yield pa.RecordBatch.from_arrays([batch.column(0), *_scan(index, *found)], names=["id", *names])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n_words bigint, n_base bigint, "
                               "first_word bigint, last_word bigint, base_labels string, labels string, score double"
                          ).withColumnRenamed("id", id_col)


def op5_licence_scan(spark, sf_dir: str) -> DataFrame:
    from spanweave.llm.common import table
    return scan_licences(table(spark, sf_dir, "documents"))
