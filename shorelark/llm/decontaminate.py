"""Benchmark decontamination by winnowing.

Fingerprints are hashes of short word k-grams; of every window of consecutive k-grams the smallest hash is kept, so any
shared span of ``window`` words has a kept hash in common. Kept hashes of documents are joined with those of the
benchmark; around the hits whole windows are hashed with 128 bits and joined again, which extends a hit to every
benchmark window that covers it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shorelark.llm.common import beside, identified, mixed, powers, runs, signed
from shorelark.session import cut_lineage

GRAM = 5
WINDOW = 10
#: By byte: A-Z in lower case, other ASCII but digits and letters as blanks; bytes above ASCII belong to words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
HASH_BYTES = 1 << 20
SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def _slices(data: bytes) -> Iterator[bytes]:
    """Cuts at blanks into slices of about HASH_BYTES."""
    at = 0
    while at < len(data):
        stop = data.find(b" ", at + HASH_BYTES)
        stop = len(data) if stop < 0 else stop
        yield data[at:stop]
        at = stop


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(two hashes of each word, shape (2, words); number of words of each text)."""
    table = mixed(np.arange(1, 257, dtype=np.uint64))
    found, counts = [], []
    texts = [t.translate(WORD_BYTES) for t in texts]
    for part in _slices(b" ".join(texts)):
        raw = np.frombuffer(part, np.uint8)
        edge = np.diff(np.concatenate([[False], raw != 32, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(starts):
            continue
        sizes = ends - starts
        letters = raw[raw != 32]
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        place = np.arange(len(letters)) - np.repeat(first, sizes)
        values = table[letters]
        hashes = []
        for seed in SEEDS:
            weighted = values * powers(seed, int(sizes.max()))[place]
            hashes.append(mixed(np.add.reduceat(weighted, first) + sizes.astype(np.uint64)))
        found.append(np.stack(hashes))
    for t in texts:
        counts.append(len(t.split()))
    return (np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.uint64)), np.array(counts, np.int64)


def grams(words: np.ndarray, size: int, lane: int) -> np.ndarray:
    """Hashes of every ``size`` consecutive words (of one lane), boundaries of texts not looked at."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            total = mixed(total * SEEDS[lane] + words[i:i + n])
    return total


class Texts:
    """Words of some texts with the kept fingerprints and the windows of each."""

    def __init__(self, texts: list[bytes], gram: int = GRAM, window: int = WINDOW):
        self.words, self.counts = word_hashes(texts)
        self.gram, self.window = gram, window
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.of = np.repeat(np.arange(len(texts)), self.counts)

    def inside(self, size: int) -> np.ndarray:
        """By start: whether ``size`` words from there lie in one text."""
        n = max(0, len(self.of) - size + 1)
        return self.of[:n] == self.of[size - 1:size - 1 + n]

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of the k-grams that are smallest in a window (all of equal ones)."""
        g = grams(self.words[0], self.gram, 0)
        wide = self.window - self.gram + 1
        if len(g) < wide:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        ok = self.inside(self.window)
        views = np.lib.stride_tricks.sliding_window_view(g, wide)
        least = views.min(axis=1)
        keep = np.zeros(len(g), bool)
        for i in range(wide):
            keep[i:len(g) - wide + 1 + i] |= ok & (views[:, i] == least)
        at = np.flatnonzero(keep)
        return at, g[at]

    def exact(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of all ``size``-grams inside texts."""
        at = np.flatnonzero(self.inside(size))
        return at, grams(self.words[0], size, 0)[at]

    def around(self, at: np.ndarray) -> np.ndarray:
        """Starts of the windows, inside their text, that hold the k-grams at the given starts."""
        wide = self.window - self.gram + 1
        starts = np.unique((at[:, None] - np.arange(wide)).ravel())
        ok = self.inside(self.window)
        starts = starts[(starts >= 0) & (starts < len(ok))]
        return starts[ok[starts]]


def _fingerprints(rows: DataFrame, key: str, short: list[int], own_length: bool) -> DataFrame:
    """(key columns, fp): kept hashes of every text, and hashes of all its ``short``-grams.

    With ``own_length`` a text shorter than a window gives the one gram that it is.
    """
    kind = rows.schema[key].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in runs(batches):
            t = Texts(texts)
            hits = [t.kept()]
            for size in short:
                at, fp = t.exact(size)
                if own_length:
                    mine = t.counts[t.of[at]] == size
                    at, fp = at[mine], fp[mine]
                hits.append((at, fp))
            at, fp = (np.concatenate(c) for c in zip(*hits, strict=True))
            pairs = np.unique(np.stack([t.of[at].astype(np.uint64), fp]), axis=1) if len(at) else np.zeros((2, 0), np.uint64)
            row = pa.array(pairs[0].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(row), batch.column("rid").take(row), signed(pairs[1])], names=[key, "rid", "fp"])

    return rows.mapInArrow(found, f"{key} {kind}, rid long, fp long")


def _windows(batches: Iterator[pa.RecordBatch], short: list[int], hits: bool) -> Iterator[pa.RecordBatch]:
    """Per row its number of words and windows (start, size, two hashes): around its hits, or all of a benchmark item."""
    for batch, texts in runs(batches):
        t = Texts(texts)
        wanted = batch.column("fps").to_pylist() if hits else None
        picked: list[tuple[np.ndarray, int]] = []
        if hits:
            some = [np.array(w or [], np.int64).view(np.uint64) for w in wanted]
            row = np.repeat(np.arange(len(some)), [len(s) for s in some]).astype(np.uint64)
            asked = set(zip(row.tolist(), np.concatenate([*some, np.zeros(0, np.uint64)]).tolist(), strict=True))
            values = np.unique(np.concatenate([*some, np.zeros(0, np.uint64)]))

            def chosen(at: np.ndarray, fp: np.ndarray) -> np.ndarray:
                near = np.isin(fp, values)
                at, fp = at[near], fp[near]
                return at[[(r, f) in asked for r, f in zip(t.of[at].tolist(), fp.tolist(), strict=True)]] if len(at) else at

            picked.append((t.around(chosen(*t.kept())), t.window))
            picked += [(chosen(*t.exact(size)), size) for size in short]
        else:
            picked.append((np.flatnonzero(t.inside(t.window)), t.window))
            picked += [(at[t.counts[t.of[at]] == size], size) for size in short for at, _ in [t.exact(size)]]
        at = np.concatenate([a for a, _ in picked])
        size = np.repeat([s for _, s in picked], [len(a) for a, _ in picked])
        h = np.zeros((2, len(at)), np.uint64)
        for s in np.unique(size).tolist():
            of = size == s
            for lane in (0, 1):
                h[lane, of] = grams(t.words[lane], s, lane)[at[of]]
        order = np.argsort(t.of[at], kind="stable")
        at, size, h = at[order], size[order], h[:, order]
        row = t.of[at]
        struct = pa.StructArray.from_arrays(
            [pa.array(at - t.starts[row]), pa.array(size.astype(np.int64)), signed(h[0].copy()), signed(h[1].copy())], names=["at", "size", "h1", "h2"]
        )
        offsets = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column("rid"), pa.array(t.counts), pa.ListArray.from_arrays(pa.array(offsets), struct)], names=[batch.schema.names[0], "rid", "n_words", "windows"]
        )


WINDOWS = "rid long, n_words long, windows array<struct<at: long, size: long, h1: long, h2: long>>"


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per document row: doc_id, rid, n_words, n_hit, items (as sorted strings), spans (at, size of hit windows).

    A benchmark item gives every window of ten of its words, or, with fewer words, itself; a document word inside an
    occurrence of a window is hit. A null text has no words; an item without words gives nothing. Repeated items count
    once; rows that repeat an id and text get equal answers. A null item id is left out of items, but its hits count.
    Empty tables give no rows, or rows without hits. Texts are read whole; other columns are not read.
    """
    rows = identified(docs, id_col, text_col)
    bench = identified(benchmark, item_col, item_text_col).withColumnRenamed("doc_id", "item")
    doc_type, item_type = rows.schema["doc_id"].dataType.simpleString(), bench.schema["item"].dataType.simpleString()
    every = list(range(1, WINDOW))
    items = cut_lineage(bench.mapInArrow(lambda b: _windows(b, every, False), f"item {item_type}, {WINDOWS}"))
    short = sorted(r.n_words for r in items.filter((F.col("n_words") > 0) & (F.col("n_words") < WINDOW)).select("n_words").distinct().collect())  # nine at most
    asked = _fingerprints(bench, "item", short, True).select("fp").distinct()
    hits = _fingerprints(rows, "doc_id", short, False).join(asked, "fp").groupBy("doc_id", "rid").agg(F.collect_set("fp").alias("fps"))
    around = beside(rows, hits).select("doc_id", "rid", "text", "fps")
    windows = cut_lineage(around.mapInArrow(lambda b: _windows(b, short, True), f"doc_id {doc_type}, {WINDOWS}"))
    theirs = items.select(F.col("item").cast("string").alias("item"), F.explode("windows").alias("w")).select("item", "w.h1", "w.h2", "w.size").distinct()
    mine = windows.select("doc_id", "rid", F.explode("windows").alias("w")).select("doc_id", "rid", "w.*").distinct()
    found = mine.join(theirs, ["h1", "h2", "size"]).groupBy("doc_id", "rid").agg(
        F.array_sort(F.collect_set("item")).alias("items"), F.array_sort(F.collect_set(F.struct("at", "size"))).alias("spans")
    )
    nothing = F.array().cast("array<struct<at: long, size: long>>")
    spans = F.coalesce("spans", nothing)
    ends = F.aggregate(
        spans, F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("end")),
        lambda acc, s: F.struct(
            (acc["hit"] + F.greatest(F.lit(0), s["at"] + s["size"] - F.greatest(acc["end"], s["at"]))).alias("hit"),
            F.greatest(acc["end"], s["at"] + s["size"]).alias("end"),
        ),
    )
    return beside(windows.select("doc_id", "rid", "n_words"), found).select(
        "doc_id", "rid", "n_words", ends["hit"].alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), spans.alias("spans"),
    )
