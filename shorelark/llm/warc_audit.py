"""Fixity audit of web archives by Merkle trees.

Pages are written as WARC files, each record a gzip member of its own, with an index of offsets. A record's leaf is the
SHA-256 of its stored bytes. FAN neighbours in offset order make a node, hashed from their offset ranges and hashes; nodes
of a file lead to its root, files to the root of the replica. Two replicas are compared from the roots, and only branches
that differ are followed down to their records.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shorelark.llm.common import runs
from shorelark.llm.token_files import store
from shorelark.session import cut_lineage, scratch_path

FAN = 16
#: A task's files are numbered from task * FILES on.
FILES = 1 << 20
FILE_BYTES = 1 << 30
RECORDS_PER_BATCH = 2000
INDEX = "file long, record long, offset long, length long, page_id {}, payload_bytes long, payload_sha256 string, hash binary"


def record(url: str | None, payload: bytes, date: str) -> tuple[bytes, str]:
    """A WARC resource record as a gzip member, and the payload's digest; the same input gives the same bytes."""
    digest = hashlib.sha256(payload).hexdigest()
    uri = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    name = uuid.UUID(bytes=hashlib.sha256(f"{uri}\n{digest}".encode()).digest()[:16], version=4)
    fields = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}"]
    fields += [] if uri is None else [f"WARC-Target-URI: {uri}"]
    fields += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return gzip.compress("\r\n".join(fields).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n", 6, mtime=0), digest


def warc_name(root: str, file: int) -> str:
    return f"{root}/{file:012d}.warc.gz"


def _saved(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read again."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Writes all pages in ascending id order (nulls first) and returns the index, one row per page.

    A null page is an empty payload, a null url leaves its header out; pages with equal ids are ordered by url and text. An empty
    table gives no files and an empty index. Other columns are not read. Files are renamed when they are whole.
    """
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in runs(batches, "html"):
            found = [record(url, html, date) for url, html in zip(batch.column("url").to_pylist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id"), batch.column("tie"), pa.array([d for d, _ in found], pa.binary()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([x for _, x in found], pa.string()),
            ], names=["page_id", "tie", "data", "payload_bytes", "payload_sha256"])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        files, root = store(path)
        files.create_dir(root, recursive=True)
        file, out, offset, n, names, rows = context.partitionId() * FILES, None, 0, 0, [], []

        def index() -> pa.RecordBatch:
            kinds = [pa.int64()] * 4 + [id_arrow, pa.int64(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])

        id_arrow = None
        for batch in batches:
            id_arrow = batch.column("page_id").type
            columns = (batch.column(c).to_pylist() for c in ("page_id", "data", "payload_bytes", "payload_sha256"))
            for page, data, size, digest in zip(*columns, strict=True):
                if out is not None and offset + len(data) > FILE_BYTES:
                    out.close()
                    file, out, offset, n = file + 1, None, 0, 0
                if out is None:
                    names.append((f"{warc_name(root, file)}.{context.taskAttemptId()}", warc_name(root, file)))
                    out = files.open_output_stream(names[-1][0], compression=None)
                out.write(data)
                rows.append((file, n, offset, len(data), page, size, digest, hashlib.sha256(data).digest()))
                offset, n = offset + len(data), n + 1
            if len(rows) >= RECORDS_PER_BATCH:
                yield index()
                rows.clear()
        if out is not None:
            out.close()
        for a, b in names:
            files.move(a, b)
        if rows:
            yield index()

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    # records are made before they are dealt out, so that they are shuffled compressed
    made = rows.withColumn("tie", F.xxhash64("url", "html")).mapInArrow(packed, f"page_id {kind}, tie long, data binary, payload_bytes long, payload_sha256 string")
    ordered = made.repartitionByRange("page_id", "tie").sortWithinPartitions("page_id", "tie")
    return _saved(ordered.mapInArrow(written, INDEX.format(kind)), "warc-index")


def _ranges(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """The stored bytes of index rows, batch by batch; None where the file is missing, fewer bytes where it is cut off."""
    files, root = store(path)
    now, stream = None, None
    for batch in batches:
        found: list[bytes | None] = []
        for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
            if file != now:
                if stream:
                    stream.close()
                now = file
                name = warc_name(root, file)
                stream = files.open_input_file(name) if files.get_file_info(name).is_file else None
            if stream is None:
                found.append(None)
            else:
                left = max(0, min(length, stream.size() - offset))
                stream.seek(min(offset, stream.size()))
                found.append(stream.read(left))
        yield batch, found
    if stream:
        stream.close()


def _in_files(index: DataFrame, *more: str) -> DataFrame:
    """Index rows, those of a file together and in its order."""
    return index.select("file", "record", "offset", "length", *more).repartition("file").sortWithinPartitions("file", "record")


def copy_archive(index: DataFrame, source: str, target: str, spoil: Column | None = None) -> None:
    """Copies the indexed records to another archive. Records for which ``spoil`` holds get a byte changed, to rehearse an audit."""
    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, root = store(target)
        files.create_dir(root, recursive=True)
        now, out, names = None, None, []
        for batch, records in _ranges(batches, source):
            for file, bad, data in zip(batch.column("file").to_pylist(), batch.column("bad").to_pylist(), records, strict=True):
                if file != now:
                    if out:
                        out.close()
                    now = file
                    names.append((f"{warc_name(root, file)}.{TaskContext.get().taskAttemptId()}", warc_name(root, file)))
                    out = files.open_output_stream(names[-1][0], compression=None)
                data = data or b""
                if bad and data:
                    at = len(data) // 2
                    data = data[:at] + bytes([data[at] ^ 1]) + data[at + 1:]
                out.write(data)
        if out:
            out.close()
        for a, b in names:
            files.move(a, b)
        yield pa.RecordBatch.from_pydict({"files": pa.array([len(names)], pa.int64())})

    rows = _in_files(index.withColumn("bad", F.coalesce(spoil, F.lit(False)) if spoil is not None else F.lit(False)), "bad")
    rows.mapInArrow(copied, "files long").agg(F.sum("files")).collect()


def leaves(index: DataFrame, path: str) -> DataFrame:
    """file, record, offset, length and the hash of the bytes an archive stores there (null if its file is missing)."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, records in _ranges(batches, path):
            hashes = pa.array([None if r is None else hashlib.sha256(r).digest() for r in records], pa.binary())
            yield batch.append_column("hash", hashes)

    return _saved(_in_files(index).mapInArrow(hashed, "file long, record long, offset long, length long, hash binary"), "warc-leaves")


# ---- trees -----------------------------------------------------------------

def tree(leaf: DataFrame, most_records: int, most_file: int) -> list[DataFrame]:
    """Nodes (replica, file, node, hash, up_file, up_node) by level, from the records to the roots.

    Every level is made from the stored one below it, so plans stay small and a lost executor costs one level.
    """
    zero = F.lit(0).cast("long")
    level = leaf.select("replica", "file", F.col("record").alias("node"), F.sha2(F.concat_ws(":", "offset", "length", F.hex("hash")), 256).alias("hash"))
    ups: list[tuple[Column, Column]] = []
    span = 1
    while span <= most_records:
        ups.append((F.col("file"), F.floor(F.col("node") / FAN)))
        span *= FAN
    ups.append((F.floor(F.col("file") / FILES), zero))  # the files of a task
    most = most_file // FILES
    while most:
        ups.append((F.floor(F.col("file") / FAN), zero))
        most //= FAN
    levels = []
    for up_file, up_node in ups:
        level = cut_lineage(level.withColumn("up_file", up_file.cast("long")).withColumn("up_node", up_node.cast("long")))
        levels.append(level)
        children = F.array_sort(F.collect_list(F.struct("file", "node", "hash")))
        level = level.groupBy("replica", "up_file", "up_node").agg(children.alias("c")).select(
            "replica", F.col("up_file").alias("file"), F.col("up_node").alias("node"), F.sha2(F.to_json("c"), 256).alias("hash"), zero.alias("up_file"), zero.alias("up_node")
        )
    return [*levels, cut_lineage(level)]


def audit(index: DataFrame, replica: DataFrame) -> DataFrame:
    """file and record of every indexed record whose bytes differ in the replica, missing ones included.

    ``index`` and ``replica`` have file, record, offset, length and hash; the index tells which records there are. Equal roots end
    the audit; otherwise only the children of nodes that differ are compared.
    """
    top = index.agg(F.coalesce(F.max("record"), F.lit(0)), F.coalesce(F.max("file"), F.lit(0))).first()
    columns = ("file", "record", "offset", "length", "hash")
    both = index.select(F.lit(0).alias("replica"), *columns).unionAll(replica.select(F.lit(1).alias("replica"), *columns))
    open_ = None
    for level in reversed(tree(both, *top)):
        if open_ is not None:
            level = level.join(open_, (level["up_file"] == open_["of_file"]) & (level["up_node"] == open_["of_node"]), "left_semi")
        mine = level.filter("replica = 0").select("file", "node", "hash")
        theirs = level.filter("replica = 1").select(F.col("file").alias("b_file"), F.col("node").alias("b_node"), F.col("hash").alias("b_hash"))
        differing = mine.join(theirs, (F.col("file") == F.col("b_file")) & (F.col("node") == F.col("b_node")), "left").filter(~F.col("hash").eqNullSafe(F.col("b_hash")))
        open_ = cut_lineage(differing.select(F.col("file").alias("of_file"), F.col("node").alias("of_node")))
        if open_.isEmpty():
            break
    return open_.select(F.col("of_file").alias("file"), F.col("of_node").alias("record"))
