"""Repeated lines, found with two Bloom filters.

One pass over the documents builds, in every task, a filter of line keys seen once and one of keys seen again; merged,
they keep ``once = a or b`` and ``twice = a's twice or b's twice or (a and b)``. Only lines that pass the second filter
are shuffled, as text, to be counted exactly and to find the document that keeps them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shorelark.llm.common import beside, identified, looked_up, runs
from shorelark.session import cut_lineage

BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bits of a filter: what is broadcast is an eighth of it in bytes, whatever the input.
FILTER_BITS = 1 << 26
SEGMENTS = 64
SALTS = 16


def line_keys(text: bytes, least: int) -> list[bytes | None]:
    """By line: its key, or None if that has fewer than ``least`` code points."""
    keys = []
    for line in text.split(b"\n"):
        key = line.strip(BLANK).lower()  # of bytes: A-Z only
        keys.append(key if len(key) >= least and (key.isascii() or len(key.decode()) >= least) else None)
    return keys


def distinct_keys(text: bytes, least: int) -> list[bytes]:
    return [k for k in dict.fromkeys(line_keys(text, least)) if k is not None]


def places(keys: list[bytes], bits: int) -> np.ndarray:
    """Two filter positions of each key, from halves of one 64-bit hash."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
    return np.stack([h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)])


class Filter:
    """A bit array in bytes, eight positions a byte."""

    def __init__(self, bits: int, data: bytes | None = None):
        self.data = np.zeros(bits // 8, np.uint8) if data is None else np.frombuffer(data, np.uint8)

    def add(self, at: np.ndarray) -> None:
        np.bitwise_or.at(self.data, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))

    def has(self, at: np.ndarray) -> np.ndarray:
        return (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def repeated_filter(rows: DataFrame, least: int, bits: int) -> bytes:
    """The merged filter of keys that at least two documents may hold: ``bits`` / 8 bytes."""
    segment_bytes = bits // 8 // SEGMENTS

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Filter(bits), Filter(bits)
        for _, texts in runs(batches):
            found = places([k for t in texts for k in distinct_keys(t, least)], bits)
            if not found.size:
                continue
            found, counts = np.unique(found, axis=1, return_counts=True)
            again = (counts > 1) | (once.has(found[0]) & once.has(found[1]))
            twice.add(found[:, again].ravel())
            once.add(found.ravel())
        for s in range(SEGMENTS):
            a, b = (f.data[s * segment_bytes:(s + 1) * segment_bytes] for f in (once, twice))
            if a.any():
                yield pa.RecordBatch.from_pydict({"segment": [s], "once": [zlib.compress(a, 1)], "twice": [zlib.compress(b, 1)]})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for s, a, b in zip(*(batch.column(c).to_pylist() for c in ("segment", "once", "twice")), strict=True):
                once, twice = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                if s not in state:
                    state[s] = [once.copy(), twice.copy()]
                else:
                    state[s][1] |= twice | (state[s][0] & once)
                    state[s][0] |= once
        for s, (_, twice) in state.items():
            yield pa.RecordBatch.from_pydict({"segment": [s], "twice": [zlib.compress(twice, 1)]})

    parts = rows.select("text").mapInArrow(local, "segment long, once binary, twice binary").repartition("segment")
    out = bytearray(bits // 8)
    for s, twice in parts.mapInArrow(merged, "segment long, twice binary").collect():
        out[s * segment_bytes:(s + 1) * segment_bytes] = zlib.decompress(bytes(twice))
    return bytes(out)


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5,
    filter_bits: int = FILTER_BITS, salts: int = SALTS,
) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_text (the lines that stay, joined by newlines).

    A key (the line without blanks at its ends, A-Z in lower case) of at least ``least_chars`` code points that at least
    ``least_docs`` rows hold loses its lines in all rows but those with the largest doc_id among them. A null text is
    an empty one, which is one empty line. A null id loses against any other; rows that all have null ids keep the
    line. Rows that repeat an id count each and stay alike. Other columns are not read; an empty table gives an empty
    result. A filter that is too small for the input passes more lines to the exact count and changes no result.
    """
    rows = identified(docs, id_col, text_col)
    repeated = rows.sparkSession.sparkContext.broadcast(repeated_filter(rows, least_chars, filter_bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = Filter(filter_bits, repeated.value)
        for batch, texts in runs(batches):
            keys = [distinct_keys(t, least_chars) for t in texts]
            flat = [k for ks in keys for k in ks]
            at = places(flat, filter_bits)
            hit = twice.has(at[0]) & twice.has(at[1]) if flat else np.zeros(0, bool)
            row = np.repeat(np.arange(len(texts)), [len(ks) for ks in keys])[hit]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(row)), batch.column("rid").take(pa.array(row)),
                pa.array([k for k, h in zip(flat, hit.tolist(), strict=True) if h], pa.binary()).cast(pa.string()),
            ], names=["doc_id", "rid", "key"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    suspected = rows.mapInArrow(suspects, f"doc_id {id_type}, rid long, key string")
    confirmed = cut_lineage(
        suspected.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n") >= least_docs).select("key", "keeper")
    )
    lost = looked_up(suspected, confirmed.withColumn("confirmed", F.lit(True)), "key", "rid", salts)
    lost = lost.filter(F.col("confirmed") & ~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = lost.groupBy("doc_id", "rid").agg(F.collect_set("key").alias("drops"))
    joined = beside(rows, drops).select("doc_id", "text", "drops")

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in runs(batches):
            n_lines, n_dropped, kept = [], [], []
            for text, drop in zip(texts, batch.column("drops").to_pylist(), strict=True):
                lines = text.split(b"\n")
                stay = lines
                if drop:
                    gone = {d.encode() for d in drop}
                    stay = [x for x, k in zip(lines, line_keys(text, least_chars), strict=True) if k is None or k not in gone]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay) if drop else text)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ], names=["doc_id", "n_lines", "n_dropped", "kept_text"])

    return joined.mapInArrow(rebuilt, f"doc_id {id_type}, n_lines long, n_dropped long, kept_text string")
