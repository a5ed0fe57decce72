"""License scans by patience alignment.

Words that occur once in a stretch of text and once in a template anchor an alignment; the longest increasing subsequence of
the anchors is kept, and the gaps between them are aligned the same way. Coverage is the share of the template's words
that are matched.

A stretch that covers a share c of a template of n words misses at most n - c n of them, so it holds one of the template's
n - c n + 1 rarest words. Only stretches around those are aligned; how rare a word is, is counted over all documents.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shorelark.llm.common import byte_texts

#: Notices that licenses ask authors to place.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MIT-short": "Released under the MIT License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "all-rights-reserved": "All rights reserved.",
}
LEAST_COVERAGE = 0.8
WORD = re.compile(rb"[0-9a-z\x80-\xff]+(?:[.-][0-9a-z\x80-\xff]+)*")


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters and digits, joined by single inner dots and hyphens; A-Z in lower case."""
    return WORD.findall(text.lower())


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence that rises in the second number, of pairs that rise in the first."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tails, y)
        tails[k:k + 1] = [y]
        at[k:k + 1] = [i]
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """Matched (place in text, place in template), rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        mine, theirs = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(template[c:d], c) if theirs[w] == 1}
        anchors = rising([(i, place[w]) for i, w in enumerate(text[a:b], a) if mine[w] == 1 and w in place])
        if anchors:
            out += anchors
            ends = [(a - 1, c - 1), *anchors, (b, d)]
            todo += [(i + 1, j, k + 1, m) for (i, k), (j, m) in zip(ends[:-1], ends[1:], strict=True)]
    return sorted(out)


def best_stretches(words: list[bytes], places: dict[bytes, list[int]], template: list[bytes], keys: list[tuple[bytes, int]], least: float) -> list[tuple[int, int, float]]:
    """(first word, number of words, coverage) of the stretches that cover the template, from left to right."""
    n = len(template)
    slack = n // 4 + 2
    starts = sorted({(p - t, p) for w, t in keys for p in places.get(w, ())})
    found: list[tuple[int, int, float]] = []
    upto = 0
    for start, _ in starts:
        a, b = max(upto, start - slack), min(len(words), start + n + slack)
        if b - a < least * n:
            continue
        matched = patience(words[a:b], template)
        if len(matched) >= least * n:
            first, last = a + matched[0][0], a + matched[-1][0]
            found.append((first, last - first + 1, len(matched) / n))
            upto = last + 1
    return found


def scan(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_COVERAGE,
) -> DataFrame:
    """One row per found stretch: doc_id, license, start_word, n_words, coverage.

    A null or empty text has no words, a template without words is never found; several stretches of a text and several
    templates over one stretch are all told. Rows that repeat an id or text are scanned each. Texts are read whole;
    other columns are not read; an empty table gives an empty result. Templates are a parameter of the driver's.
    """
    cut = {name: w for name, text in templates.items() if (w := words_of(text.encode()))}
    vocabulary = frozenset(w for ws in cut.values() for w in ws)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in byte_texts(batch.column("text")):
                counts.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    counts = rows.select("text").mapInArrow(known, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    often = {bytes(r.word): r.n for r in counts.collect()}  # words of templates only
    keys = {}
    for name, ws in cut.items():
        wanted = len(ws) - math.ceil(least * len(ws)) + 1
        rare = sorted(range(len(ws)), key=lambda i: (often.get(ws[i], 0), ws[i], i))[:wanted]
        keys[name] = [(ws[i], i) for i in rare]
    sought = frozenset(w for ks in keys.values() for w, _ in ks)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, text in enumerate(byte_texts(batch.column("text"))):
                words = words_of(text)
                if sought.isdisjoint(words):
                    continue
                places: dict[bytes, list[int]] = {}
                for i, w in enumerate(words):
                    if w in sought:
                        places.setdefault(w, []).append(i)
                for name, template in cut.items():
                    out += [(row, name, *s) for s in best_stretches(words, places, template, keys[name], least)]
            row, name, start, n, coverage = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(name, pa.string()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(coverage, pa.float64()),
            ], names=["doc_id", "license", "start_word", "n_words", "coverage"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scanned, f"doc_id {kind}, license string, start_word long, n_words long, coverage double")
