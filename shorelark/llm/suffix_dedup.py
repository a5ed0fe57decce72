"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

A suffix's bucket says which string of length L it starts with. The bucket of length 2 L is named by the buckets at its
start and L bytes later, so names are reused from level to level, up to the length sought.

Between tasks names are 64-bit hashes of the pair. Suffixes are first thinned out: of all buckets of length ``GRAM`` in a
window of the length sought, the smallest name is the window's anchor, so equal windows have equal anchors at equal
places. Neighbouring windows with one anchor form a stretch. Equal stretches (by two hashes) settle each other: all but
the first are repeats. Stretches whose anchor occurs with different surroundings are sent, as bytes, to one place per
anchor; there buckets are refined by sorting, with exact names, until they tell all windows apart. Where very many
surroundings share an anchor, their windows are dealt out one by one, by two hashes.

Records are dealt to shards, as many as the bytes of the input ask for, and a task settles one shard after the other, in
pieces. Stretches with different surroundings are sorted by anchor, so a task refines a few anchors at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shorelark.llm.common import beside, byte_texts, identified, mixed, powers, runs, signed
from shorelark.session import scratch_path

LENGTH = 100
GRAM = 32
#: Bytes of text for each shard; about one in 35 starts a stretch.
SHARD_BYTES = 2 << 20
#: Stretches a task gathers before it settles those among them and passes the rest on.
GATHERED = 1 << 19
#: Anchors with so many different surroundings are dealt out window by window.
CROWD = 8192
#: Bytes of surroundings that a task refines at a time, and the anchor that goes beyond.
REFINED = 1 << 19
#: Bytes of text and rows that numpy looks at at a time.
RUN, ROWS = 1 << 18, 256
#: Anchors found in at least HOT of about SAMPLE documents are dealt out window by window. This only spreads the work.
SAMPLE, HOT = 4000, 20
NO_ID, NEVER = np.iinfo(np.int64).min, np.iinfo(np.int64).max
K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
RECORD = np.dtype([("h", "u8"), ("g", "u8"), ("doc", "i8"), ("rid", "i8"), ("lo", "i4"), ("more", "u1")])
SPAN = np.dtype([("doc", "i8"), ("rid", "i8"), ("start", "i8"), ("stop", "i8")])


def named(names: np.ndarray, later: int, k: int = 0) -> np.ndarray:
    """Names of longer strings from the names at their start and ``later`` bytes on."""
    return mixed(mixed(names[:-later] * K[k]) + names[later:])


def gram_names(raw: np.ndarray) -> np.ndarray:
    four = raw[:-3].astype(np.uint64)
    for i in range(1, 4):
        four |= raw[i:len(raw) - 3 + i].astype(np.uint64) << np.uint64(8 * i)
    names, size = mixed(four), 4
    while size < GRAM:
        names, size = named(names, size), 2 * size
    return names


class Powers:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = powers(K[0], n), powers(pow(int(K[0]), -1, 1 << 64), n)
        return cls.up[:n], cls.down[:n]


def smallest(names: np.ndarray, wide: int) -> np.ndarray:
    """By start of a window of ``wide`` names: where its smallest is, the first of equal ones."""
    value, at, size = names, np.arange(len(names), dtype=np.int32), 1
    while size < wide:
        step = min(size, wide - size)
        a, b = value[:-step], value[step:]
        later = b < a
        value, at, size = np.where(later, b, a), np.where(later, at[step:], at[:-step]), size + step
    return at


def stretches(texts: list[bytes], doc: np.ndarray, rid: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Records of all windows of the texts: stretches, or single windows where the anchor is hot."""
    raw = np.frombuffer(b"".join(texts) + bytes(LENGTH + GRAM), np.uint8)
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - LENGTH + 1, 0)
    if not counts.sum():
        return np.zeros(0, RECORD)
    text = np.repeat(np.arange(len(texts)), counts)
    window = begins[text] + np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    names = gram_names(raw)
    anchor = smallest(names, LENGTH - GRAM + 1)[window]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    more = np.diff(np.concatenate([first, [len(window)]])) - 1
    lo, at, of = window[first], anchor[first], text[first]
    up, down = Powers.upto(len(names) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(names * up[:len(names)], dtype=np.uint64)])
    span = (total[lo + more + LENGTH - GRAM + 1] - total[lo]) * down[lo]
    out = np.zeros(len(lo), RECORD)
    out["h"], out["more"], out["lo"], out["doc"], out["rid"] = names[at], more, lo - begins[of], doc[of], rid[of]
    out["g"] = mixed(span + (at - lo).astype(np.uint64) * K[1] + more.astype(np.uint64) * K[2])
    if len(hot) and (is_hot := np.isin(out["h"], hot)).any():
        n = more[is_hot] + 1
        each = out[is_hot].repeat(n)
        place = np.repeat(lo[is_hot], n) + (np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n))
        each["lo"] += (place - np.repeat(lo[is_hot], n)).astype(np.int32)
        each["more"] = 0
        long = named(names, 32)
        each["h"] = mixed(long[place] * K[1] + long[place + LENGTH - 64])
        each["g"] = mixed(mixed(mixed(names[place] * K[2] + names[place + 32]) * K[2] + names[place + 64]) * K[2] + names[place + LENGTH - GRAM])
        out = np.concatenate([out[~is_hot], each])
    return out


def joined_spans(doc: np.ndarray, rid: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Spans of each document, overlapping and touching ones joined."""
    out = np.zeros(len(doc), SPAN)
    out["doc"], out["rid"], out["start"], out["stop"] = doc, rid, start, stop
    if not len(out):
        return out
    out = out[np.lexsort((out["start"], out["rid"], out["doc"]))]
    change = np.concatenate([[True], (out["doc"][1:] != out["doc"][:-1]) | (out["rid"][1:] != out["rid"][:-1])])
    number = np.cumsum(change)
    high = int(out["stop"].max()) + 2
    reach = np.maximum.accumulate(number * high + out["stop"])
    new = np.concatenate([[True], number[1:] * high + out["start"][1:] > reach[:-1]])
    heads = np.flatnonzero(new)
    merged = out[heads]
    merged["stop"] = reach[np.concatenate([heads[1:], [len(out)]]) - 1] - number[heads] * high
    return merged


def settled(records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first records of each class of equal stretches, spans of the later ones, how many classes share the first's anchor)."""
    h = records["h"].copy()
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    tied = np.zeros(len(h), bool)
    tied[1:] |= same
    tied[:-1] |= same
    if not tied.any():
        return records, np.zeros(0, SPAN), np.ones(len(records), np.int64)
    lone, r = records[order[~tied]], records[order[tied]]
    r = r[np.lexsort((r["lo"], r["rid"], r["doc"], r["g"], r["h"]))]
    anchor = np.concatenate([[True], r["h"][1:] != r["h"][:-1]])
    new = anchor | np.concatenate([[True], r["g"][1:] != r["g"][:-1]])
    heads = np.flatnonzero(new)
    head = heads[np.cumsum(new) - 1]
    later = np.zeros(len(r), bool)
    for name in ("doc", "rid", "lo"):
        later |= r[name] != r[name][head]
    x = r[later]
    of = np.cumsum(anchor)[heads] - 1
    start = x["lo"].astype(np.int64)
    spans = joined_spans(x["doc"], x["rid"], start, start + x["more"] + LENGTH)
    return np.concatenate([lone, r[heads]]), spans, np.concatenate([np.ones(len(lone), np.int64), np.bincount(of)[of]])


def combined(pieces: Iterator[np.ndarray], most: int, crowd: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(spans to remove, stretches to look at more closely, which of them window by window) of a shard's records, ``most`` at a time.

    What equals a record held is dropped at once. Stretches of a crowded anchor are not held, and all go window by window.
    """
    held, n, limit, crowded = [], 0, most, np.zeros(0, np.uint64)
    for piece in chain(pieces, [None]):
        if piece is not None:
            held.append(piece)
            n += len(piece)
            if n < limit:
                continue
        first, spans, classes = settled(np.concatenate(held))
        apart = (classes >= crowd) | np.isin(first["h"], crowded)
        go = apart if piece is not None else apart | (classes > 1)
        crowded = np.union1d(crowded, first["h"][apart])
        yield spans, first[go], apart[go]
        held = [first[~go]]
        n = len(held[0])
        limit = max(most, 2 * n)


# ---- tasks -----------------------------------------------------------------

def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(batch.column("doc_id").fill_null(NO_ID)), np.asarray(batch.column("rid"))


def _nullable(doc: np.ndarray) -> pa.Array:
    return pa.array(doc, mask=doc == NO_ID)


def _binary(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of the records between one edge and the next."""
    offsets = edges.astype(np.int32) * np.int32(data.dtype.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Small runs; only a few rows of a batch are copied at a time."""
    return runs((b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)), most=RUN)


def _shared_out(records: np.ndarray, shards: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Keys and blobs: of records by shard, and of spans that are settled here already (from ``shards`` on)."""
    first, spans, _ = settled(records)
    shard = (first["h"] % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard)
    shard = shard[order]
    at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    yield shard[at], _binary(first[order], np.concatenate([at, [len(shard)]]))
    if len(spans):
        yield np.array([shards + int(spans["rid"][0] % shards)]), _binary(spans, np.array([0, len(spans)]))


def _gather(batches: Iterator[pa.RecordBatch], hot: np.ndarray, shards: int, gathered: int) -> Iterator[pa.RecordBatch]:
    parts: list[np.ndarray] = []
    n = 0
    for batch, texts in chain(_runs(batches), [(None, None)]):
        if batch is not None:
            parts.append(stretches(texts, *_ids(batch), hot))
            n += len(parts[-1])
        if n >= (gathered if batch is not None else 1):
            for keys, blobs in _shared_out(np.concatenate(parts), shards):
                yield pa.RecordBatch.from_arrays([pa.array(keys), blobs], names=["shard", "blob"])
            parts, n = [], 0


def _pieces(batches: Iterator[pa.RecordBatch], key: str, column: str) -> Iterator[tuple[int, bytes]]:
    """Keys and the joined bytes of rows in a row that have them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, blob = np.asarray(batch.column(key)), batch.column(column).cast(pa.large_binary())
        at = np.frombuffer(blob.buffers()[1], np.int64)[blob.offset:blob.offset + len(blob) + 1]
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(keys[a]), blob.buffers()[2][int(at[a]):int(at[b])].to_pybytes()


def _rows(spans: np.ndarray, asked: np.ndarray, apart: np.ndarray) -> pa.RecordBatch:
    """Spans to remove (ask null), and stretches (start, number of further windows) to look at more closely."""
    return pa.RecordBatch.from_arrays([
        _nullable(np.concatenate([spans["doc"], asked["doc"]])), pa.array(np.concatenate([spans["rid"], asked["rid"]])),
        pa.array(np.concatenate([np.zeros(len(spans), np.int64), asked["h"].view(np.int64)]), mask=np.arange(len(spans) + len(asked)) < len(spans)),
        pa.array(np.concatenate([spans["start"], asked["lo"].astype(np.int64)])), pa.array(np.concatenate([spans["stop"], asked["more"].astype(np.int64)])),
        pa.array(np.concatenate([np.zeros(len(spans), bool), apart])),
    ], names=["doc_id", "rid", "ask", "a", "b", "apart"])


def _compare(batches: Iterator[pa.RecordBatch], shards: int, most: int, crowd: int) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, RECORD)
    for shard, pairs in groupby(_pieces(batches, "shard", "blob"), lambda pair: pair[0]):
        if shard >= shards:
            yield from (_rows(np.frombuffer(blob, SPAN), none, np.zeros(0, bool)) for _, blob in pairs)
        else:
            yield from (_rows(*x) for x in combined((np.frombuffer(blob, RECORD) for _, blob in pairs), most, crowd))


def _contexts(batches: Iterator[pa.RecordBatch], shards: int, gathered: int) -> Iterator[pa.RecordBatch]:
    """The stretches that are asked for: their bytes with their anchor, or records of their windows with the shard (apart)."""
    names = ["apart", "h", "doc_id", "rid", "lo", "bytes"]
    parts: list[np.ndarray] = []
    n = 0
    for batch, texts in chain(_runs(batches), [(None, None)]):
        if batch is not None:
            asks = batch.column("asks")
            flat, each = asks.flatten(), np.diff(np.asarray(asks.offsets))
            h, lo, more = (np.asarray(flat.field(c)) for c in ("ask", "a", "b"))
            apart = flat.field("apart").to_numpy(zero_copy_only=False).astype(bool)
            row = np.repeat(np.arange(len(texts)), each)
            bytes_ = [texts[i][a:a + m + LENGTH] for i, a, m in zip(row.tolist(), lo.tolist(), more.tolist(), strict=True)]
            near, far = np.flatnonzero(~apart), np.flatnonzero(apart)
            for at in range(0, len(near), 20_000):
                part = near[at:at + 20_000]
                i = pa.array(row[part])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.zeros(len(part), bool)), pa.array(h[part]), batch.column("doc_id").take(i), batch.column("rid").take(i), pa.array(lo[part]),
                    pa.array([bytes_[j] for j in part.tolist()], pa.binary()),
                ], names=names)
            if len(far):
                windows = stretches([bytes_[j] for j in far.tolist()], far, far, np.unique(h[far].view(np.uint64)))
                of = windows["doc"].copy()
                windows["lo"] += lo[of].astype(np.int32)
                windows["doc"], windows["rid"] = (x[row[of]] for x in _ids(batch))
                parts.append(windows)
                n += len(windows)
        if n >= (gathered if batch is not None else 1):
            for keys, blobs in _shared_out(np.concatenate(parts), shards):
                none = pa.array(np.zeros(len(keys), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(keys), bool)), pa.array(keys), none, none, none, blobs], names=names)
            parts, n = [], 0


def refined(raw: np.ndarray, wanted: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Exact bucket numbers of the strings of ``length`` at the wanted places of ``raw``.

    Buckets of length 4 are the bytes themselves; longer ones are numbered by sorting pairs of bucket numbers, of a
    suffix and of the suffix at the later offset. A bucket of one suffix is final and keeps its number.
    """
    four = sum(raw[i:len(raw) - 3 + i].astype(np.uint64) << np.uint64(8 * i) for i in range(4))
    _, bucket, count = np.unique(four, return_inverse=True, return_counts=True)
    size = 4
    while size < length:
        step = min(size, length - size)
        n = len(bucket) - step
        lone = count[bucket] == 1
        open_ = np.flatnonzero(~lone[:n])
        _, number, new_count = np.unique((bucket[open_].astype(np.uint64) << np.uint64(32)) | bucket[open_ + step].astype(np.uint64), return_inverse=True, return_counts=True)
        closed = np.flatnonzero(lone[:n])
        bucket = np.zeros(n, np.int64)
        bucket[open_] = number
        bucket[closed] = len(new_count) + np.arange(len(closed))
        count = np.concatenate([new_count, np.ones(len(closed), np.int64)])
        size += step
    return bucket[wanted]


def _repeats(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Repeated windows among the stretches of some anchors."""
    table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    doc, rid = _ids(table)
    lo, parts = np.asarray(table.column("lo")), byte_texts(table.column("bytes"))
    sizes = np.array([len(b) for b in parts])
    n = sizes - LENGTH + 1
    begins = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(parts)), n)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    bucket = refined(np.frombuffer(b"".join(parts) + bytes(LENGTH), np.uint8), begins[of] + inner)
    start = lo[of] + inner
    order = np.lexsort((start, rid[of], doc[of], bucket))
    b, d, r, s = bucket[order], doc[of][order], rid[of][order], start[order]
    new = np.concatenate([[True], b[1:] != b[:-1]])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (d != d[head]) | (r != r[head]) | (s != s[head])
    return _spans(joined_spans(d[later], r[later], s[later], s[later] + LENGTH))


def _spans(spans: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_nullable(spans["doc"]), pa.array(spans["rid"]), pa.array(spans["start"]), pa.array(spans["stop"])], names=["doc_id", "rid", "a", "b"])


def _whole_anchors(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    """Rows sorted by anchor, in lists of about ``size`` bytes that end between two anchors."""
    held, n, last = [], 0, None
    for batch in batches:
        h = np.asarray(batch.column("h"))
        ends = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(batch.column("bytes")), np.int64))])
        at = 0
        for cut in np.flatnonzero(np.concatenate([[bool(held) and h[0] != last], h[1:] != h[:-1]])).tolist():
            if n + ends[cut] - ends[at] >= size:
                yield [*held, batch.slice(at, cut - at)]
                held, n, at = [], 0, cut
        held.append(batch.slice(at))
        n += ends[-1] - ends[at]
        last = h[-1]
    if held:
        yield held


def _refine(batches: Iterator[pa.RecordBatch], shards: int, most: int, size: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows, from rows sorted by apart and h: of a few anchors at a time, then of the windows that were dealt out one by one."""
    def halves() -> Iterator[tuple[bool, pa.RecordBatch]]:
        for batch in batches:
            near = batch.num_rows - pc.sum(batch.column("apart").cast(pa.int64())).as_py() if batch.num_rows else 0
            yield from ((apart, part) for apart, part in ((False, batch.slice(0, near)), (True, batch.slice(near))) if part.num_rows)

    for apart, group in groupby(halves(), lambda half: half[0]):
        rows = (part for _, part in group)
        if not apart:
            yield from map(_repeats, _whole_anchors(rows, size))
            continue
        for shard, pairs in groupby(_pieces(rows, "h", "bytes"), lambda pair: pair[0]):
            if shard >= shards:
                yield from (_spans(np.frombuffer(blob, SPAN)) for _, blob in pairs)
            else:
                yield from (_spans(x[0]) for x in combined((np.frombuffer(blob, RECORD) for _, blob in pairs), most, NEVER))


def hot_anchors(rows: DataFrame, total: int) -> np.ndarray:
    """Anchors that many documents of a bounded random sample have. They decide how work is dealt, not its result."""
    none = np.zeros(0, np.uint64)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _runs(batches):
            found = stretches(texts, *_ids(batch), none)
            yield pa.RecordBatch.from_arrays([signed(np.unique(found[["h", "doc", "rid"]])["h"].copy())], names=["h"])

    sample = rows.sample(min(1.0, SAMPLE / max(total, 1)), seed=1).mapInArrow(names, "h long")
    found = sample.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT).select("h").toArrow()
    return np.asarray(found.column("h").combine_chunks(), np.int64).view(np.uint64)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (start and length of removed runs), kept (the bytes that stay).

    A byte goes if a string of LENGTH bytes over it also starts earlier, in a document with a smaller id or before in its
    own; nothing matches across documents. Ids are integers; a null id is smaller than any other, and documents with equal ids
    are ordered by a hash of their text. Rows that repeat an id and text are one document and get equal answers. A null
    text is an empty one. Texts are read whole; other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = identified(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "rid", "text")
    total, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    shards, most, crowd, refined_size = (size or 0) // SHARD_BYTES + 1, GATHERED, CROWD, REFINED
    hot = hot_anchors(rows, total)
    dealt = rows.mapInArrow(lambda b: _gather(b, hot, shards, most), "shard long, blob binary").repartition("shard").sortWithinPartitions("shard")
    path = scratch_path(spark, "repeats")
    dealt.mapInArrow(lambda b: _compare(b, shards, most, crowd), "doc_id long, rid long, ask long, a long, b long, apart boolean").write.parquet(path)
    found = spark.read.parquet(path)
    asks = found.filter("ask is not null").groupBy("doc_id", "rid").agg(F.collect_list(F.struct("ask", "a", "b", "apart")).alias("asks"))
    asked = beside(rows, asks).filter("asks is not null")
    contexts = asked.mapInArrow(lambda b: _contexts(b, shards, most), "apart boolean, h long, doc_id long, rid long, lo long, bytes binary")
    sorted_ = contexts.repartition("h").sortWithinPartitions("apart", "h")
    more = sorted_.mapInArrow(lambda b: _refine(b, shards, most, refined_size), "doc_id long, rid long, a long, b long")
    spans = found.filter("ask is null").select("doc_id", "rid", "a", "b").unionAll(more)
    spans = spans.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("a", "b")).alias("found"))

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _runs(batches):
            sizes, runs_, kept = [], [], []
            for text, found in zip(texts, batch.column("found").to_pylist(), strict=True):
                joined: list[list[int]] = []
                for a, b in sorted((x["a"], x["b"]) for x in found or ()):
                    if joined and a <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], b)
                    else:
                        joined.append([a, b])
                edges = [0, *(e for run in joined for e in run), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                sizes.append(len(text))
                runs_.append([{"start": a, "length": b - a} for a, b in joined])
            span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs_, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    schema = "doc_id long, n_bytes long, spans array<struct<start: long, length: long>>, kept binary"
    return beside(rows, spans).select("doc_id", "text", "found").mapInArrow(removed, schema)
