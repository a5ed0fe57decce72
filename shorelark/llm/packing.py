"""Order-preserving packing of token ids into sequences of bounded length.

Documents keep their order. Every token position may end a sequence, at a price: nothing at the end of a document,
little at the end of a sentence, more elsewhere. A dynamic programme over the positions chooses the cuts that
minimise padding plus prices. The best start for an end lies in a window that only moves forward, so a monotone
queue gives each transition in constant time.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shorelark.llm.common import runs
from shorelark.llm.tokens import Encoder, vocabulary

SENTENCE_MARKS = ".!?\n"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_cuts(cuts: np.ndarray, price: np.ndarray, capacity: int) -> list[int]:
    """Ends of sequences over positions 0..cuts[-1]: the cheapest choice from ``cuts`` (rising, gaps <= capacity).

    Cost of a sequence: capacity minus its length (its padding) plus the price of its end. The last cut is an end.
    """
    n = len(cuts)
    ends, prices = cuts.tolist(), price.tolist()
    value, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, -1)])  # (cost so far + position, position, its number)
    for j in range(n):
        end = ends[j]
        while end - queue[0][1] > capacity:
            queue.popleft()
        least, _, i = queue[0]
        value[j] = cost = least + capacity - end + prices[j]
        back[j] = i
        key = cost + end
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, end, j))
    out, j = [], n - 1
    while j >= 0:
        out.append(ends[j])
        j = back[j]
    return out[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, capacity: int, prices: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a sequence may end, and their prices; hard cuts only where a window has no better place."""
    kind = np.zeros(len(ids) + 1, np.int8)  # 1 after a sentence, 2 after a document, 3 elsewhere
    kind[1:] = sentence_end[ids]
    kind[doc_ends] = 2
    edges = np.concatenate([[0], np.flatnonzero(kind)])
    wide = np.flatnonzero(np.diff(edges) > capacity // 16)
    for i in wide:  # long stretches without a boundary: a grid of hard cuts inside them
        kind[np.arange(edges[i], edges[i + 1], capacity // 16)[1:]] = 3
    cuts = np.flatnonzero(kind)
    price = np.array([0, prices[0], 0, prices[1]])[kind[cuts]]
    return cuts, price


def powers(left: int, price: float, capacity: int) -> list[int]:
    """Lengths for the rest of a partition: powers of two need no padding, where they are worth their cuts."""
    out = []
    while left:
        top = 1 << (left.bit_length() - 1)
        if capacity - left <= price * left.bit_count():
            top = left
        out.append(top)
        left -= top
    return out


class _Packer:
    """Packs the documents of one task in blocks; the open end of a block goes into the next."""

    def __init__(self, task: int, sentence_end: np.ndarray, capacity: int, prices: tuple[float, float]):
        self.sequence, self.sentence_end, self.capacity, self.prices = task << 32, sentence_end, capacity, prices
        self.docs: list[tuple[int | None, int, int]] = []  # (id, ids of it that are out already, all its ids)
        self.ids = np.zeros(0, "<u4")

    def add(self, doc_id: int | None, ids: np.ndarray, parts: list[np.ndarray]) -> None:
        self.docs.append((doc_id, 0, len(ids)))
        parts.append(ids)

    def pack(self, parts: list[np.ndarray], last: bool) -> list[tuple]:
        ids = np.concatenate([self.ids, *parts])
        if not len(ids):
            return []
        doc_ends = np.cumsum([n - done for _, done, n in self.docs])
        cuts, price = candidates(ids, doc_ends, self.sentence_end, self.capacity, self.prices)
        ends = best_cuts(cuts, price, self.capacity)
        if not last:
            ends = ends[:-1]
        elif (begin := ends[-2] if len(ends) > 1 else 0) < ends[-1]:
            ends[-1:] = (begin + np.cumsum(powers(ends[-1] - begin, self.prices[1], self.capacity))).tolist()
        rows = self._pieces(ids, doc_ends, ends)
        upto = ends[-1] if ends else 0
        self.ids = ids[upto:]
        self.docs = [(d, max(done, n - (e - upto)), n) for (d, done, n), e in zip(self.docs, doc_ends.tolist(), strict=True) if e > upto]
        return rows

    def _pieces(self, ids: np.ndarray, doc_ends: np.ndarray, ends: list[int]) -> list[tuple]:
        rows, at, k = [], 0, 0
        ends_of = doc_ends.tolist()
        for end in ends:
            begin = at
            while at < end:
                doc_id, _, n = self.docs[k]
                stop = min(end, ends_of[k])
                crc = zlib.crc32(ids[at:stop])
                rows.append((doc_id, n - (ends_of[k] - at), stop - at, crc, n, self.sequence, at - begin))
                at = stop
                k += at == ends_of[k]
            self.sequence += 1
        return rows


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1,
    prices: tuple[float, float] = (4.0, 24.0), tokenizer: str | None = None, block_tokens: int = 1 << 20,
) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``prices`` are padding tokens that a cut after a sentence or inside one may save at least. Documents stay in the
    order of the table within a task; nothing is shuffled, and a task holds about ``block_tokens`` ids at a time (or
    one document). A null or empty text is a document of its end id alone; null and repeated ids are carried along,
    each row being a document; an empty table gives no rows. Only a task's last sequence may be far from full: it is
    cut into powers of two where that saves more padding than the cuts cost. sequence_id is unique, not gapless.
    """
    path = tokenizer or vocabulary()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = Encoder.at(path)
        sentence_end = encoder.ending(SENTENCE_MARKS)
        sentence_end = np.concatenate([sentence_end, np.zeros(max(0, end_id + 1 - len(sentence_end)), bool)])
        end = np.array([end_id], "<u4").tobytes()
        task = _Packer(TaskContext.get().partitionId(), sentence_end, capacity, prices)
        parts: list[np.ndarray] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch, texts in runs(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                task.add(doc_id, np.frombuffer(encoder.encode(text.decode()) + end, "<u4"), parts)
            if sum(map(len, parts)) >= block_tokens:
                yield out(task.pack(parts, last=False))
                parts = []
        yield out(task.pack(parts, last=True))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(packed, SCHEMA)
