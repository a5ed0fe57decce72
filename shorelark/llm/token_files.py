"""Token ids of documents as flat binary files, in ascending id order, and their memory-mapped reader.

A part has three files: ``.ids`` (unsigned 16-bit, or 32-bit for a larger vocabulary), ``.offsets`` (unsigned 64-bit,
one more than documents, from the part's start) and ``.docs`` (64-bit ids; nulls come first and are counted in the
manifest). A part's base, the number of ids in the parts before it, is a prefix sum over the parts' counts.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shorelark.llm.common import identified, runs
from shorelark.llm.tokens import Encoder, vocabulary
from shorelark.session import cut_lineage

LITTLE = {2: "<u2", 4: "<u4"}


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, so that files may lie in any store the cluster shares."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


def _name(root: str, part: int, kind: str) -> str:
    return f"{root}/part-{part:06d}.{kind}"


def write_token_files(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, tokenizer: str | None = None,
) -> None:
    """Writes the ids of every whole text and an end id, documents in ascending id order (nulls first).

    A null text is an empty one, so its document is the end id alone. Rows with equal ids follow each other in the order
    of their text's hash. An empty table gives a manifest without documents. A task streams its range of documents
    and renames its files when they are whole, so a repeated attempt replaces them by the same bytes.
    """
    vocab_path = tokenizer or vocabulary()

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        encoder = Encoder.at(vocab_path)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        files, root = store(path)
        files.create_dir(root, recursive=True)
        names = {k: (f"{_name(root, part, k)}.{attempt}", _name(root, part, k)) for k in ("ids", "offsets", "docs")}
        out = {k: files.open_output_stream(a) for k, (a, _) in names.items()}
        total = n = nulls = 0
        out["offsets"].write(np.zeros(1, "<u8").tobytes())
        for batch, texts in runs(batches):
            ids = [encoder.encode(t.decode()) + end for t in texts]
            sizes = np.array([len(x) // 4 for x in ids], np.uint64)
            out["ids"].write(np.frombuffer(b"".join(ids), "<u4").astype(LITTLE[width]).tobytes())
            out["offsets"].write((np.cumsum(sizes) + np.uint64(total)).astype("<u8").tobytes())
            column = batch.column("doc_id")
            out["docs"].write(np.asarray(column.fill_null(0)).astype("<i8").tobytes())
            total, n, nulls = total + int(sizes.sum()), n + len(texts), nulls + column.null_count
        for k, (a, b) in names.items():
            out[k].close()
            files.move(a, b)
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [n], "tokens": [total], "nulls": [nulls], "width": [width]})

    rows = identified(docs, id_col, text_col)
    ordered = rows.repartitionByRange("doc_id", "rid").sortWithinPartitions("doc_id", "rid").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = sorted(cut_lineage(ordered.mapInArrow(written, "part long, docs long, tokens long, nulls long, width long")).collect())
    bases = np.concatenate([[0], np.cumsum([p.tokens for p in parts], dtype=np.uint64)]).tolist()
    manifest = [p.asDict() | {"base": int(base)} for p, base in zip(parts, bases)]  # noqa: B905  one row a part
    files, root = store(path)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())


def _array(files: pafs.FileSystem, name: str, kind: str) -> np.ndarray:
    if not files.get_file_info(name).size:
        return np.zeros(0, kind)
    if isinstance(files, pafs.LocalFileSystem):
        return np.memmap(name, kind, "r")
    with files.open_input_file(name) as f:
        return np.frombuffer(f.read(), kind)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian 32-bit integers)."""
    files, root = store(path)
    with files.open_input_file(f"{root}/manifest.json") as f:
        manifest = {p["part"]: p for p in json.loads(f.read())}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(path)
        for batch in batches:
            for part in (manifest[k] for k in batch.column("id").to_pylist() if k in manifest):
                ids = _array(files, _name(root, part["part"], "ids"), LITTLE[part["width"]])
                offsets = _array(files, _name(root, part["part"], "offsets"), "<u8").astype(np.int64)
                docs = _array(files, _name(root, part["part"], "docs"), "<i8")
                for at in range(0, part["docs"], 5000):
                    stop = min(at + 5000, part["docs"])
                    crc = [zlib.crc32(ids[offsets[i]:offsets[i + 1]].astype("<u4")) for i in range(at, stop)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.asarray(docs[at:stop]), mask=np.arange(at, stop) < part["nulls"]),
                        pa.array(offsets[at:stop] + part["base"]), pa.array(np.diff(offsets[at:stop + 1])), pa.array(crc, pa.int64()),
                    ], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    top = max(manifest, default=-1) + 1
    return spark.range(0, top, 1, max(1, top)).mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")
