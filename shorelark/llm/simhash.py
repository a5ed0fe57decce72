"""SimHash near-duplicates by anchor-point covering.

Of two fingerprints with at most three differing bits, one of the two 32-bit halves differs in at most one. On a half
the anchors are the words of a covering code: a Hamming code on 31 bits (every word is within one bit of a code word)
times the free last bit, so the covering radius is one. A fingerprint goes to every anchor within radius plus one of
its half; the partner's nearest anchor is among them. Fingerprints are compared per anchor only.

``near_copies`` takes its first candidates from the anchors, and the rest from prefixes of the sets of shingles; it compares
all of them on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shorelark.llm.common import byte_texts, components, identified, looked_up, runs
from shorelark.session import cut_lineage

SALTS = 16
MOST_BITS = 3
#: Near copies have at least so many hundredths of their shingles in common.
LEAST_ALIKE = 80
#: Rows in which frequent shingles are counted, about, and how many of these are told apart. Neither changes a result.
SAMPLE, FREQUENT = 8000, 100_000
#: Shingles that so many rows of the sample have are crowded: no task gathers all rows of one.
CROWDED = 8
#: Members of a key of more sets bring with them what tells most pairs apart where they meet; there are few pairs of the other keys.
FEW = 16
#: Members of a key that one task compares with all of them, about.
DEALT = 512
#: Numbers of 64 bits in the smallest sketch.
FOLD = 16
#: Rows whose texts are held at a time, as bytes and as shingles.
TEXTS = 500
#: Ids of texts that are sent to every task; more are joined.
SENT = 1_000_000
#: Anchors with more fingerprints are split by the bits of the other half before they are compared.
CROWD = 2000
VOTE_ROWS = 1 << 15


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the word shingles; of the whole sequence if it is shorter, none without words."""
    parts = text.lower().split()  # of bytes: A-Z, and the six ASCII blanks
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[:len(parts) - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; 0 without hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), VOTE_ROWS):
        block = hashes[at:at + VOTE_ROWS].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, rid and fp, the fingerprint as a signed 64-bit integer."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [majority(shingle_hashes(text, words)) for text in byte_texts(batch.column("text"))]
            fps = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), fps], names=["doc_id", "rid", "fp"])

    rows = identified(docs, id_col, text_col)
    return rows.mapInArrow(hashed, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, rid long, fp long")


# ---- anchors ---------------------------------------------------------------

#: By syndrome 1..31: the flips that lead to code words within two bits: its own bit, or one of 15 pairs.
FLIPS = np.zeros((32, 16), np.uint64)
for _s in range(1, 32):
    FLIPS[_s] = [1 << (_s - 1)] + [(1 << (_i - 1)) | (1 << ((_i ^ _s) - 1)) for _i in range(1, 32) if _i < _i ^ _s]
LAST = np.uint64(1 << 31)


def syndrome(x: np.ndarray) -> np.ndarray:
    """Of the low 31 bits under the Hamming code: the number of the bit to flip, 0 for a code word."""
    out = np.zeros(len(x), np.int64)
    for bit in range(5):
        mask = np.uint64(sum(1 << (i - 1) for i in range(1, 32) if i >> bit & 1))
        out |= (np.bitwise_count(x & mask).astype(np.int64) & 1) << bit
    return out


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fp, anchor, nearest): every anchor of both halves within two bits; anchors of the halves differ."""
    out = []
    for half in (0, 1):
        x = (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        s = syndrome(x)
        near = np.where(s > 0, x ^ FLIPS[s, 0], x)
        tag = np.uint64(half << 32)
        every = np.arange(len(fp))
        out += [(every, near | tag, np.ones(len(fp), bool)), (every, (near ^ LAST) | tag, np.zeros(len(fp), bool))]
        off = np.flatnonzero(s)
        far = (x[off, None] ^ FLIPS[s[off], 1:]).ravel() | tag
        out.append((np.repeat(off, 15), far, np.zeros(len(far), bool)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def blocks(anchor: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, key): an anchor's fingerprints by the four bytes of the other half, of which one has to agree."""
    other = np.where(anchor >> np.uint64(32) == 0, fp >> np.uint64(32), fp & np.uint64(0xFFFFFFFF))
    keys = [(anchor << np.uint64(10)) | np.uint64(j << 8) | ((other >> np.uint64(8 * j)) & np.uint64(255)) for j in range(4)]
    return np.tile(np.arange(len(fp)), 4), np.concatenate(keys)


def forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all fingerprints which chains of at most three differing bits connect: a tree each."""
    left, links = fp, []
    while len(left) > 1:
        open_, left = [left[0]], left[1:]
        while open_ and len(left):
            at = open_.pop()
            near = np.bitwise_count(left ^ at) <= MOST_BITS
            if near.any():
                links += [(at, x) for x in left[near]]
                open_ += list(left[near])
                left = left[~near]
    return links


def links_of_runs(batches: Iterator[pa.RecordBatch], crowd: int | None) -> Iterator[pa.RecordBatch]:
    """Links (a, b) among the rows of each key; batches are sorted by key. Rows (key, a, null) of crowded keys pass on."""
    def out(a, b=None, key=None) -> pa.RecordBatch:
        a = np.asarray(a, np.uint64)
        b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(np.asarray(b, np.uint64).view(np.int64))
        key = pa.nulls(len(a), pa.int64()) if key is None else pa.array(np.full(len(a), key).view(np.int64))
        return pa.RecordBatch.from_arrays([key, pa.array(a.view(np.int64)), b], names=["key", "a", "b"])

    def compared(key: np.ndarray, fp: np.ndarray, near: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        sizes = np.diff(edges)
        small = np.repeat(sizes <= 16, sizes)
        k, f, q = key[small], fp[small], near[small]
        for lag in range(1, min(16, len(k))):
            same = k[lag:] == k[:-lag]
            if not same.any():
                break
            same &= (q[lag:] | q[:-lag]) & (np.bitwise_count(f[lag:] ^ f[:-lag]) <= MOST_BITS)
            if same.any():
                yield out(f[:-lag][same], f[lag:][same])
        for i in np.flatnonzero(sizes > 16):
            group = fp[edges[i]:edges[i + 1]]
            if links := forest(group):
                yield out(*np.array(links, np.uint64).T)

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows of the last key so far
    size, crowded = 0, None
    for batch in batches:
        key, fp = (batch.column(c).to_numpy().view(np.uint64) for c in ("key", "fp"))
        near = batch.column("near").to_numpy(zero_copy_only=False)
        if not len(key):
            continue
        if crowded is not None:
            same = int(np.searchsorted(key, crowded, "right"))
            if same:
                yield out(fp[:same], key=crowded)
            if same == len(key):
                continue
            key, fp, near, crowded = key[same:], fp[same:], near[same:], None
        held.append((key, fp, near))
        size += len(key)
        if held[0][0][0] == key[-1]:  # one key only
            if crowd and size > crowd:
                for k, f, _ in held:
                    yield out(f, key=k[0])
                held, size, crowded = [], 0, key[-1]
            continue
        key, fp, near = (np.concatenate(c) for c in zip(*held, strict=True))
        upto = int(np.searchsorted(key, key[-1], "left"))
        yield from whole(key[:upto], fp[:upto], near[:upto], compared, out, crowd)
        held, size = [(key[upto:], fp[upto:], near[upto:])], len(key) - upto
    if held:
        yield from whole(*(np.concatenate(c) for c in zip(*held, strict=True)), compared, out, crowd)


def whole(key, fp, near, compared, out, crowd):
    """Complete keys: crowded ones pass on, the others are compared."""
    if crowd:
        values, starts, sizes = np.unique(key, return_index=True, return_counts=True)
        keep = np.ones(len(key), bool)
        for i in np.flatnonzero(sizes > crowd):
            part = slice(starts[i], starts[i] + sizes[i])
            keep[part] = False
            yield out(fp[part], key=values[i])
        key, fp, near = key[keep], fp[keep], near[keep]
    if len(key):
        yield from compared(key, fp, near)


def _compared(keyed: DataFrame, crowd: int | None) -> DataFrame:
    dealt = keyed.repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(lambda batches: links_of_runs(batches, crowd), "key long, a long, b long")


def near_links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) within three bits of each other."""
    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(fp), 2000):
                part = fp[at:at + 2000]
                i, key, near = anchors(part)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part[i].view(np.int64)), pa.array(near)], names=["key", "fp", "near"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp = (batch.column(c).to_numpy().view(np.uint64) for c in ("key", "a"))
            i, keys = blocks(key, fp)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fp[i].view(np.int64)), pa.array(np.ones(len(i), bool))], names=["key", "fp", "near"])

    schema = "key long, fp long, near boolean"
    first = cut_lineage(_compared(distinct.mapInArrow(anchored, schema), crowd))
    links = first.filter("b is not null").select("a", "b")
    crowded = first.filter("b is null").select("key", "a")
    if crowded.isEmpty():
        return links
    return links.unionAll(_compared(crowded.mapInArrow(split, schema), None).select("a", "b"))


def component_ids(rows: DataFrame, node: str, links: DataFrame, salts: int) -> DataFrame:
    """The rows with component_id, the smallest doc_id that the links reach from the row's node, and root, null without links."""
    nodes = cut_lineage(rows.groupBy(node).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(links)
    linked = nodes.join(roots, nodes[node] == roots["node"], "left").select(nodes[node], "least", "n", "root")
    reach = linked.filter("root is not null").groupBy("root").agg(F.min("least").alias("reached"))
    answers = linked.filter("root is not null or n > 1").join(reach, "root", "left").select(node, "root", F.coalesce("reached", "least").alias("component_id"), F.lit(True).alias("found"))
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id"))
    return looked_up(rows, answers, node, "rid", salts).withColumn("component_id", component).drop("found")


def simhash_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, salts: int = SALTS, crowd: int = CROWD,
) -> DataFrame:
    """One row per input row: doc_id, rid, fingerprint (16 hex digits), component_id (smallest id reachable).

    Fingerprints with at most three differing bits are linked. A null text is an empty one; texts without words have
    fingerprint zero and are linked like any other. A null id is larger than any other: component_id is null only
    where all ids of a component are null. Rows that repeat an id or a text get equal answers. Texts are read whole;
    other columns are not read; an empty table gives an empty result.
    """
    rows = cut_lineage(fingerprints(docs, words, id_col, text_col))
    found = component_ids(rows, "fp", near_links(rows.select("fp").distinct(), crowd=crowd), salts)
    return found.select("doc_id", "rid", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near copies -----------------------------------------------------------

def shingle_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[int]]]:
    """Slices of the batches with the distinct shingles of their texts, ascending, and a hash of each such set."""
    slices = (batch.slice(at, TEXTS) for batch in batches for at in range(0, batch.num_rows, TEXTS))
    for part, texts in runs(slices):
        sets = [np.unique(shingle_hashes(text, words)) for text in texts]
        yield part, sets, [xxhash.xxh64_intdigest(s.tobytes()) for s in sets]


def lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)))


def frequent(given: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a bounded sample of the rows, ascending, and how often they are."""
    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets, _ in shingle_sets(batches, words):
            for s in sets:
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], names=["key"])

    sample = given.filter(F.pmod("rid", F.lit(max(1, given.count() // SAMPLE))) == 0)
    counts = sample.select("text").mapInArrow(exploded, "key long").groupBy("key").count().filter("count > 1")
    top = counts.orderBy(F.desc("count"), "key").limit(FREQUENT).collect()
    keys, n = np.array([r["key"] for r in top], np.int64).view(np.uint64), np.array([r["count"] for r in top], np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


def prefixes(given: DataFrame, words: int, least: int) -> DataFrame:
    """doc_id, rid, node (hash of the set of shingles), n (its size), fp (its fingerprint), bits (its sketch) and keys, the set's first
    shingles in the order from rare to frequent, of which the first ``rare`` are not crowded: two sets that are ``least``
    hundredths alike have one of these in common.

    A sketch has two bits or more for each shingle, their number a power of two, and tells of each bit whether an odd number
    of shingles have it as remainder. Its halves, xor-ed, are the sketch of half the size.
    """
    hot, often = frequent(given, words)

    def cut(s: np.ndarray) -> tuple[np.ndarray, int]:
        if not len(s):
            return s, 0
        at = np.minimum(np.searchsorted(hot, s), max(0, len(hot) - 1))
        rank = np.where(hot[at] == s, often[at], 0) if len(hot) else np.zeros(len(s), np.int64)
        order = np.lexsort((s, rank))[:len(s) + least * len(s) // -100 + 1]
        return s[order], int((rank[order] < CROWDED).sum())

    def sketch(s: np.ndarray) -> np.ndarray:
        size = max(64 * FOLD, 64 << (len(s) // 32).bit_length())
        odd = np.bincount((s % np.uint64(size)).astype(np.int64), minlength=size) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.uint64)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets, nodes in shingle_sets(batches, words):
            first = [cut(s) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("rid"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64)), lists([sketch(s) for s in sets]), lists([k for k, _ in first]),
                pa.array([n for _, n in first], pa.int32()),
            ], names=["doc_id", "rid", "node", "n", "fp", "bits", "keys", "rare"])

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(keyed, f"doc_id {kind}, rid long, node long, n long, fp long, bits array<long>, keys array<long>, rare int")


def fitting(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) of which sizes and sketches don't prove that they are less than ``least`` hundredths alike. A bit that
    differs between sketches is an element, at least, that the sets don't share."""
    def halved(bits: Column, size: Column) -> Column:
        return F.when(F.size(bits) > size, F.zip_with(F.slice(bits, 1, size), F.slice(bits, size + 1, size), lambda p, q: p.bitwiseXOR(q))).otherwise(bits)

    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(end), F.struct("n", "bits").alias(f"_{end}")), end)
    n, m = F.col("_a.n"), F.col("_b.n")
    pairs = pairs.filter(F.least(n, m) * 100 >= F.greatest(n, m) * least)
    size = F.least(F.size("_a.bits"), F.size("_b.bits"))
    differ = F.zip_with(halved(F.col("_a.bits"), size), halved(F.col("_b.bits"), size), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    odd = F.aggregate(differ, F.lit(0), lambda total, x: total + x)
    return pairs.filter(alike(F.floor((n + m - odd) / 2), n, m, least)).select("a", "b")


def shared_keys(keyed: DataFrame) -> DataFrame:
    """(key, node, n, pos) of the keys that several sets have: rare ones are gathered, crowded ones counted and joined."""
    each = Window.partitionBy("key")
    rare = keyed.filter("pos < rare").withColumn("several", F.min("node").over(each) < F.max("node").over(each)).filter("several")
    crowded = keyed.filter("pos >= rare")
    several = crowded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("key")
    both = rare.drop("several").unionByName(crowded.join(several, "key", "left_semi"))
    return both.select("key", "node", "n", "pos").dropDuplicates(["key", "node"])


def ends(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def by_fingerprint(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect all sets (node, fp) whose fingerprints the anchors link."""
    first = cut_lineage(sets.groupBy("fp").agg(F.min("node").alias("x")))
    across = near_links(first.select("fp")).join(first.withColumnRenamed("fp", "a"), "a").join(first.select(F.col("fp").alias("b"), F.col("x").alias("y")), "b")
    same = sets.select("fp", F.col("node").alias("y")).join(first, "fp").filter("x <> y")
    return same.select(*ends("x", "y")).union(across.select(*ends("x", "y"))).distinct()


def by_prefix(members: DataFrame, sets: DataFrame, sweep: int | None, least: int) -> DataFrame:
    """Pairs (a, b) of a key's members (key, node, n, pos, root) that have different roots and that sizes and places of the key
    don't prove less than ``least`` hundredths alike: of neighbours in a random order, or all without ``sweep``.

    Without ``sweep`` a key's members meet by bands of their sizes, so those of too different sizes never do. Two sets that
    share many keys are a pair at the first of these; at the others they are told by an earlier key that both have. What
    they may have in common before a key is what they share with sets of other roots, not all that comes before it. Where
    many sets meet, small sketches are compared there and then, so pairs that these tell apart are never written.
    """
    row = F.struct("node", "n", "pos", "root")
    told = F.lit(True)
    if sweep is not None:
        along = Window.partitionBy("key").orderBy(F.xxhash64("node", F.lit(sweep)), "node")
        beside = F.array(*(F.lead(row, k).over(along) for k in range(1, 5)))
        met = members.select(row.alias("x"), beside.alias("all")).select("x", F.explode("all").alias("y")).filter("x.root <> y.root")
    else:
        # keys of one passage have the same members (told by two sums of their hashes): one of these keys is enough
        sums = [F.sum(F.xxhash64("node", F.lit(k)).cast("decimal(38,0)")).alias(f"sum{k}") for k in (1, 2)]
        kinds = members.groupBy("key").agg(F.count("*").alias("size"), F.max("n").alias("most"), *sums)
        enough = kinds.groupBy("size", "most", "sum1", "sum2").agg(F.min("key").alias("key")).select("key", "size", "most")
        along = Window.partitionBy("node").orderBy("pos")
        marked = members.join(enough, "key", "left").withColumn("kept", F.when(F.col("size").isNotNull(), F.col("key")))
        earlier = [F.expr(f"lag(kept, {k}) ignore nulls over (partition by node order by pos)") for k in (1, 2, 3)]
        earlier.append(F.first("kept", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
        placed = marked.withColumn("shared", F.row_number().over(along) - 1).withColumn("before", F.array_compact(F.array(*earlier)))
        placed = placed.filter("size is not null").join(sets.select("node", folded("bits").alias("fold")), "node")
        many = F.col("size") > FEW
        row = F.struct("node", "n", "pos", "root", "shared", F.when(many, F.col("before")).alias("before"), F.when(many, F.col("fold")).alias("fold"))
        # sizes of sets that are alike lie in one band or in two that follow each other; members of a large key are dealt out
        def band(n: str) -> Column:
            return F.floor(F.log(F.col(n).cast("double")) / math.log(101 / least)).cast("int")

        banded = placed.withColumn("band", band("n")).withColumn("up", F.sequence(F.lit(0), F.when(band("most") > F.col("band"), 1).otherwise(0)))
        banded = banded.withColumn("parts", F.ceil(F.col("size") / DEALT).cast("int")).withColumn("x", row)
        part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")
        left = banded.select("key", "band", part, "x", F.explode("up").alias("up"))
        left = left.select("key", (F.col("band") + F.col("up")).alias("band"), "part", "up", "x")
        right = banded.select("key", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("x").alias("y"))
        met = left.join(right, ["key", "band", "part"]).filter("x.root < y.root or (up = 1 and x.root <> y.root)")
        n, m = F.col("x.n"), F.col("y.n")
        common = F.least("x.shared", "y.shared") + F.least(n - F.col("x.pos"), m - F.col("y.pos"))
        odd = sum((F.bit_count(F.col("x.fold")[k].bitwiseXOR(F.col("y.fold")[k])) for k in range(FOLD)), F.lit(0))
        told = alike(common, n, m, least) & ~F.coalesce(F.arrays_overlap("x.before", "y.before"), F.lit(False))
        told &= F.coalesce(alike((n + m - odd) / 2, n, m, least), F.lit(True))
    n, m = F.col("x.n"), F.col("y.n")
    common = F.least("x.pos", "y.pos") + F.least(n - F.col("x.pos"), m - F.col("y.pos"))
    fits = (F.least(n, m) * 100 >= F.greatest(n, m) * least) & alike(common, n, m, least)
    return met.filter(fits & told).select(*ends("x.node", "y.node")).distinct()


def folded(bits: str) -> Column:
    """The sketch of the smallest size."""
    return F.expr(f"transform(sequence(0, {FOLD - 1}), i -> aggregate(sequence(i, size({bits}) - 1, {FOLD}), 0L, (x, j) -> x ^ {bits}[j]))")


def alike(common: Column, n: Column, m: Column, least: int) -> Column:
    """Whether sets of n and m with so many common elements are at least ``least`` hundredths alike."""
    return common * (100 + least) >= (n + m) * least


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: int = LEAST_ALIKE, sweeps: int = 1, salts: int = SALTS,
) -> DataFrame:
    """One row per input row: doc_id, rid, component_id (smallest id reachable) and group over near copies.

    Rows have the same group if, and only if, they are connected; ids that are null or repeated don't tell that.

    Two texts are linked if, and only if, the Jaccard similarity of their sets of word shingles is ``least`` hundredths
    or more; shingles are compared by 64-bit hashes. The first candidates are those that the anchors of their fingerprints
    bring together. Fingerprints of alike sets may differ in more than three bits, so all sets that share a shingle of their
    prefixes are candidates too, whatever the number of sets that do; that completes the answer. Each candidate is checked on
    the whole sets. Pairs whose ends are already connected are passed over: ``sweeps`` check neighbours in a random order, then
    every pair is checked that is still unconnected.
    Texts without words are copies of each other. Nulls, repeats, empty tables and other columns as in ``simhash_dedup``.
    """
    given = identified(docs, id_col, text_col)
    rows = cut_lineage(prefixes(given, words, least))
    sets = cut_lineage(rows.groupBy("node", "n", "fp", "bits").agg(F.min("rid").alias("rid")))  # each set once
    shared = cut_lineage(shared_keys(rows.select("node", "n", "rare", F.posexplode("keys").alias("pos", "key"))))
    rows = cut_lineage(rows.select("doc_id", "rid", "node"))  # the keys' checkpoint can go

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found, nodes in shingle_sets(batches, words):
            yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), lists(found)], names=["node", "of"])

    def compared(todo: DataFrame) -> DataFrame:
        """Whether the ends of each pair are alike; whole sets are built for ends only."""
        todo = cut_lineage(fitting(todo, sets, least))
        named = todo.select(F.col("a").alias("node")).union(todo.select("b")).distinct()
        rids = sets.join(named, "node", "left_semi").select("rid")
        texts = given.join(F.broadcast(rids) if named.count() <= SENT else rids, "rid", "left_semi").select("text")
        built = texts.mapInArrow(whole_sets, "node long, of array<long>").dropDuplicates(["node"])
        both = todo.join(built.select(F.col("node").alias("a"), F.col("of").alias("x")), "a").join(built.select(F.col("node").alias("b"), F.col("of").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        return cut_lineage(both.select("a", "b", alike(common, F.size("x"), F.size("y"), least).alias("linked")))

    checked = compared(by_fingerprint(sets))
    for sweep in [*range(sweeps), None]:
        roots = components(checked.filter("linked").select("a", "b"))
        found = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        apart = found.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
        members = cut_lineage(found.join(apart, "key", "left_semi"))
        todo = by_prefix(members, sets, sweep, least).join(checked.select("a", "b"), ["a", "b"], "left_anti")
        checked = checked.unionAll(compared(todo))
    links = checked.filter("linked").select("a", "b")
    return component_ids(rows, "node", links, salts).select("doc_id", "rid", "component_id", F.coalesce("root", "node").alias("group"))
