"""Language identification of whole, possibly mixed texts.

A text is cut into words. The scripts of a word's letters narrow the languages it may have; each of those scores the word
by the byte n-grams it was trained on. Viterbi then labels the words, switching language at a price, so that spans of a
language come out whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shorelark.llm.common import identified, mixed, runs

UNKNOWN = "und"
#: The classifier is fitted on at most so many labelled rows per language, those with the smallest hash of their id.
TRAIN_ROWS = 2000
BUCKETS = 1 << 17
SLOTS = 1 << 16
#: Bytes of text scored at a time: some hundred bytes of arrays for each.
RUN = 1 << 19
SIZES = (2, 3, 4)
SWITCH = 12.0
#: A language is a candidate for a script if at least this share of its training letters is of it.
SCRIPT_SHARE = 0.001

#: First code points of script ranges (Unicode blocks), in order; a range ends where the next begins.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Other"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Latin"),
    (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"), (0x323B0, "Other"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_FIRST = np.array([a for a, _ in SCRIPTS])
_NUMBER = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS], np.int8)


def _letter_table() -> np.ndarray:
    """By code point: its script's number if it is a letter, or -1."""
    points = np.arange(0x323B0)
    letters = np.fromiter((unicodedata.category(chr(p))[0] in "LM" if not 0xD800 <= p < 0xE000 else False for p in points), bool, len(points))
    return np.where(letters, _NUMBER[np.searchsorted(_FIRST, points, "right") - 1], -1).astype(np.int8)


class Words:
    """Words (runs of letters) of some texts: number of letters, script, and n-gram buckets of their bytes."""

    table: np.ndarray | None = None

    def __init__(self, texts: list[bytes]):
        if Words.table is None:
            Words.table = _letter_table()
        raw = "\n".join(t.decode().lower() for t in texts) + "\n"
        points = np.frombuffer(raw.encode("utf-32-le"), np.uint32)
        script = np.where(points < len(Words.table), Words.table[np.minimum(points, len(Words.table) - 1)], -1)
        letter = script >= 0
        edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.letters = ends - starts
        lines = np.cumsum([len(t.decode().lower()) + 1 for t in texts])
        self.text = np.searchsorted(lines, starts, "right")
        self.start = starts - np.concatenate([[0], lines[:-1]])[self.text]
        self.script = script[starts].astype(np.int64) if len(starts) else np.zeros(0, np.int64)
        self.points = np.where(letter, points, 32).astype(np.uint64)
        self.starts = starts

    def buckets(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, bucket) of its n-grams of code points, one blank on either side included."""
        padded = np.concatenate([[np.uint64(32)], self.points])
        n = np.maximum(self.letters + 3 - size, 0)
        word = np.repeat(np.arange(len(n)), n)
        at = self.starts[word] + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
        key = np.full(len(at), size, np.uint64)
        for i in range(size):
            key = key * np.uint64(0x100000001B3) + padded[at + i]
        return word, (mixed(key) & np.uint64(BUCKETS - 1)).astype(np.int64)


class Model:
    """Log probabilities (n-gram size, bucket, language) less their mean over languages, and candidates by script."""

    def __init__(self, languages: list[str], scores: np.ndarray, candidates: np.ndarray):
        self.languages, self.scores, self.candidates = languages, scores, candidates

    def word_scores(self, words: Words) -> np.ndarray:
        out = np.zeros((len(words.letters), len(self.languages)), np.float32)
        for k, size in enumerate(SIZES):
            word, bucket = words.buckets(size)
            if len(word):
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                out[word[first]] += np.add.reduceat(self.scores[k][bucket], first, axis=0)
        return np.where(self.candidates[words.script], out, np.float32(-1e4))


def best_path(scores: np.ndarray, begins: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """Viterbi labels of the rows of ``scores``; texts (begin, size) of similar size step together."""
    labels = np.zeros(len(scores), np.int16)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    for at in range(0, len(order), 256):
        group = order[at:at + 256]
        begin, size = begins[group], sizes[group]
        steps, wide = int(size[0]), scores.shape[1]
        live = np.searchsorted(-size, -np.arange(steps), "left")  # texts longer than step t come first
        value = scores[begin].copy()
        stay = np.ones((steps, len(group), wide), bool)
        came = np.zeros((steps, len(group)), np.int16)
        came[0] = value.argmax(axis=1)
        for t in range(1, steps):
            n = live[t]
            v = value[:n]
            top = came[t - 1, :n]
            jump = v[np.arange(n), top] - switch
            stay[t, :n] = v >= jump[:, None]
            v = np.maximum(v, jump[:, None]) + scores[begin[:n] + t]
            value[:n] = v
            came[t, :n] = v.argmax(axis=1)
        last = came[size - 1, np.arange(len(group))]
        state = last.copy()
        for t in range(steps - 1, -1, -1):
            n = live[t]
            labels[begin[:n] + t] = state[:n]
            if t:
                rows = np.arange(n)
                state[:n] = np.where(stay[t, rows, state[:n]], state[:n], came[t - 1, :n])
    return labels


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = TRAIN_ROWS) -> Model:
    """A model of the labelled rows for which ``usable`` holds: whole texts of at most ``most_rows`` rows a language.

    The rows of a language are those with the smallest hash of their id (by slot, then whole). Counting is distributed; what reaches the
    driver is a count for each n-gram bucket and script of a language.
    """
    rows = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    # where a language's smallest hashes end is found in a histogram, so that only about the rows wanted are ranked
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    upto = F.sum("n").over(W.partitionBy("lang").orderBy("slot"))
    full = rows.groupBy("lang", slot.alias("slot")).agg(F.count("*").alias("n")).withColumn("upto", upto)
    last = full.groupBy("lang").agg(F.coalesce(F.min(F.when(F.col("upto") >= most_rows, F.col("slot"))), F.lit(SLOTS)).alias("slot"))
    ends = [(F.col("lang") == r.lang) & (slot <= r.slot) for r in last.collect()]  # one a language
    by_hash = W.partitionBy("lang").orderBy(slot, F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    near = rows.filter(reduce(lambda x, y: x | y, ends, F.lit(False)))
    sample = near.withColumn("_n", F.row_number().over(by_hash)).filter(F.col("_n") <= most_rows).select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in runs(batches, most=RUN):
            labels = batch.column("lang").to_pylist()
            words = Words(texts)
            names = sorted(set(labels))
            number = np.array([names.index(x) for x in labels])[words.text] if len(words.text) else np.zeros(0, int)
            for k in range(len(SIZES) + 1):
                if k < len(SIZES):
                    word, bucket = words.buckets(SIZES[k])
                    at, n = np.unique(number[word] * BUCKETS + bucket, return_counts=True)
                else:
                    at, where = np.unique(number * BUCKETS + words.script, return_inverse=True)
                    n = np.bincount(where, words.letters, len(at)).astype(np.int64)
                if len(at):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([names[i] for i in at // BUCKETS]), pa.array(np.full(len(at), k)), pa.array(at % BUCKETS), pa.array(n),
                    ], names=["lang", "kind", "bucket", "n"])

    counts = sample.mapInArrow(counted, "lang string, kind long, bucket long, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counts.column("lang").to_pylist()))
    table = np.zeros((len(SIZES) + 1, BUCKETS, len(languages)), np.float32)
    lang = np.array([languages.index(x) for x in counts.column("lang").to_pylist()], int)
    table[counts.column("kind").to_numpy(), counts.column("bucket").to_numpy(), lang] = counts.column("n").to_numpy()
    scores = np.log(table[:-1] + 0.5) - np.log(table[:-1].sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    scores -= scores.mean(axis=2, keepdims=True) if languages else 0
    letters = table[-1][:len(SCRIPT_NAMES)]
    candidates = letters >= np.maximum(SCRIPT_SHARE * letters.sum(axis=0, keepdims=True), 1)
    candidates[~candidates.any(axis=1)] = True  # a script nobody was trained on: all are candidates
    return Model(languages, scores.astype(np.float32), candidates)


def label(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """One row per input row: doc_id, rid, lang_pred, score, spans (start and length in code points of the lower-cased text, lang).

    lang_pred is the language with most letters (the first by name of equal ones), score the share of letters in its spans. A null
    text, a text without letters, or a model without languages gives ``und``, score 0 and no spans. Texts are read
    whole; null and repeated ids are carried along; other columns are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers, whatever the input
    rows = identified(docs, id_col, text_col)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN])
        for batch, texts in runs(batches, most=2 * RUN):
            words = Words(texts)
            n = len(texts)
            sizes = np.bincount(words.text, minlength=n)
            pred, score = np.full(n, len(names) - 1), np.zeros(n)
            at = np.zeros(0, np.int64)
            path = np.zeros(0, np.int64)
            if model.languages and len(words.text):
                begins = np.cumsum(sizes) - sizes
                path = best_path(model.word_scores(words), begins, sizes, switch).astype(np.int64)
                wide = len(model.languages)
                share = np.bincount(words.text * wide + path, words.letters, n * wide).reshape(n, wide)
                some = sizes > 0
                pred[some] = share[some].argmax(axis=1)
                score[some] = share[some].max(axis=1) / share[some].sum(axis=1)
                at = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (words.text[1:] != words.text[:-1])]))
            ends = np.concatenate([at[1:], [len(path)]]) - 1 if len(at) else at
            span = pa.StructArray.from_arrays([
                pa.array(words.start[at]), pa.array(words.start[ends] + words.letters[ends] - words.start[at]), pa.array(names[path[at]].tolist(), pa.string()),
            ], names=["start", "length", "lang"])
            offsets = np.searchsorted(words.text[at], np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("rid"), pa.array(names[pred].tolist(), pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets), span),
            ], names=["doc_id", "rid", "lang_pred", "score", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(labelled, f"doc_id {kind}, rid long, lang_pred string, score double, spans array<struct<start: long, length: long, lang: string>>")


def held_out(id_col: str = "doc_id") -> Column:
    """A quarter of the ids, by CRC-32 of their decimal text; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
