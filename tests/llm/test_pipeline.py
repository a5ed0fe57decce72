"""The pipeline on a small corpus with planted copies and leaks, and the registered queries next to plain versions."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from shorelark.session import scratch_path
from tests.llm import helpers as h

SMALL = "/root/testdata/sf0.001"
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def corpus(spark):
    """Folder of documents and benchmark, and the ids that should stay."""
    rng = random.Random(9)
    item = h.prose(900, 30)
    rows, stay = [], set()
    for i in range(60):
        rows.append((i, h.prose(i, 200), "en" if i % 2 else "de"))
        stay.add(i)
    for i in range(5):  # exact copies: the largest id stays
        rows += [(100 + 10 * i + k, f"{h.prose(500 + i, 80)}", "en") for k in range(3)]
        stay.add(100 + 10 * i + 2)
    for i in range(5):  # near copies: the smallest id stays
        words = h.prose(600 + i, 400).split()
        rows.append((200 + 10 * i, " ".join(words), "de"))
        words[rng.randrange(400)] = "changed"
        rows.append((200 + 10 * i + 1, " ".join(words), "de"))
        stay.add(200 + 10 * i)
    rows += [(300, f"{h.prose(700, 50)} {' '.join(item.split()[4:16])} {h.prose(701, 50)}", "en"), (301, item, "en"), (302, f"{h.prose(702, 50)} {' '.join(item.split()[:9])}", "en")]
    stay.add(302)
    rows += [(400, None, "en"), (401, "", None), (402, "123 456 !!", "en"), (None, "A text that has no id at all.", "en"), (None, h.prose(500, 80), "en")]
    stay.add(None)
    path = scratch_path(spark, "corpus")
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, stay, {i: t for i, t, _ in rows}


def test_stages_keep_what_they_should(spark, corpus):
    path, stay, texts = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = scratch_path(spark, name)
        stage(spark, docs, path).write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == [93, 90, 79, 74, 72]
    assert {r.doc_id for r in docs.select("doc_id").collect()} == stay
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert Counter(r.doc_id for r in pieces).keys() == stay


def test_run_is_the_stages(spark, corpus):
    path, stay, texts = corpus
    got = corpus_pipeline.run(spark, path)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == stay
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(got.columns)


def test_an_empty_corpus(spark):
    path = scratch_path(spark, "nothing")
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def test_op1(spark):
    rows = documents(spark)
    fps = [h.simhash(t) for _, t in rows]
    roots = h.smallest_reachable(len(rows), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min(i, least.get(r, i))
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op1_simhash_dedup"](spark, SMALL).collect()}
    assert got == {(i, format(f, "016x"), least[r]) for (i, _), f, r in zip(rows, fps, roots, strict=True)}


def test_op2(spark):
    want = h.repeats(dict(sorted(documents(spark))))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op2_suffix_dedup"](spark, SMALL).collect()}
    assert got == want


def test_op3(spark):
    """Lines that are a notice are found, in every document that has one."""
    from shorelark.llm.licenses import TEMPLATES

    found = {(r.doc_id, r.license) for r in QUERIES["op3_license_scan"](spark, SMALL).collect()}
    want = {(i, name) for i, t in documents(spark) for name, line in TEMPLATES.items() if line in (t or "").split("\n")}
    assert want and want <= found


def test_op4(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = {}
    for i, t in documents(spark):
        n, hit, found = h.leaks(t, items)
        want[i] = (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in QUERIES["op4_decontaminate"](spark, SMALL).collect()}
    assert got == want


def test_op5_learns_only_from_the_rest(spark):
    """Labels of held-out documents change no prediction."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    from shorelark.llm.language_id import held_out

    path = scratch_path(spark, "relabelled")
    docs.withColumn("lang", F.when(held_out(), F.lit("zz")).otherwise(F.col("lang"))).write.parquet(f"{path}/documents.parquet")
    first, second = ({r.doc_id: tuple(r) for r in QUERIES["op5_language_id"](spark, d).collect()} for d in (SMALL, path))
    assert first == second and len(first) == docs.count() and any(r[1] for r in first.values())


@pytest.mark.parametrize("name, end", [("op6_token_files", 2), ("op10_packing", 1)])
def test_op6_and_op10(spark, name, end):
    from tokenizers import Tokenizer

    from shorelark.llm.tokens import vocabulary

    tokenizer = Tokenizer.from_file(vocabulary())
    tokenizer.encode_special_tokens = True
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, end] for i, t in documents(spark)}
    rows = QUERIES[name](spark, SMALL).collect()
    if name.startswith("op6"):
        at = 0
        for r in sorted(rows, key=lambda r: r.doc_id):
            assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), h.crc(ids[r.doc_id]))
            at += r.n_tokens
        return
    fill, done = {}, Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0) and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == h.crc(ids[r.doc_id][r.start:r.start + r.length])
        fill[r.sequence_id] = r.offset + r.length
        done[r.doc_id] += r.length
    assert done == {i: len(x) for i, x in ids.items()} and max(fill.values()) <= 2048
    padding = sum(2048 - n for n in fill.values() if n.bit_count() > 1)
    assert padding < 0.03 * sum(fill.values())


def test_one_row_of_each_group_stays(spark):
    """Null and repeated ids, and rows that are repeated whole."""
    a, b, c = (h.prose(800 + k, 300) for k in range(3))
    rows = [(1, a), (None, a + " end"), (1, a + " fin"), (1, b), (None, b + " end"), (None, c), (None, c), (None, c + " end"), (2, h.prose(810, 90)), (2, h.prose(810, 90))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    once = corpus_pipeline.exact(spark, docs, "")
    assert Counter(r.text for r in once.collect()) == Counter({t: 1 for _, t in rows})
    kept = Counter((r.doc_id, r.text[:200]) for r in corpus_pipeline.near(spark, docs, "").collect())
    assert kept == Counter([(1, a[:200]), (1, b[:200]), (None, c[:200]), (2, h.prose(810, 90)[:200])])


def test_helper_columns_do_not_clash(spark):
    text = h.prose(820, 60)
    rows = [(1, text, "a", "b", 3), (2, text, "c", "d", 4), (2, text, "c", "d", 4), (3, h.prose(821, 60), "e", "f", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, one_text string, gone_id string, one_rid bigint").withColumn("gone_rid", F.lit(1)).withColumn("one_id", F.lit(2))
    for stage in (corpus_pipeline.exact, corpus_pipeline.near):
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "one_text", "gone_id", "one_rid", "gone_rid", "one_id"]
        assert sorted((r.doc_id, r.one_text) for r in docs.collect()) == [(2, "c"), (3, "e")]
