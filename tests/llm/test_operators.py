"""Operators on awkward small tables, against plain versions."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shorelark.llm import common
from shorelark.llm import suffix_dedup as suffixes
from shorelark.llm.common import components
from shorelark.llm.decontaminate import decontaminate
from shorelark.llm.exact_dedup import exact_dedup
from shorelark.llm.language_id import UNKNOWN, Model, Words, best_path, held_out, label, train
from shorelark.llm.licenses import TEMPLATES, patience, rising, scan, words_of as license_words
from shorelark.llm.line_dedup import line_dedup
from shorelark.llm.packing import best_cuts, pack
from shorelark.llm.simhash import anchors, blocks, forest, near_copies, simhash_dedup
from shorelark.llm.token_files import read_token_files, write_token_files
from shorelark.llm import tokens
from shorelark.llm.tokens import Encoder, vocabulary
from shorelark.llm.warc_audit import audit, copy_archive, leaves, record, write_archive
from shorelark.session import scratch_path
from tests.llm import helpers as h

DOCS = h.awkward()


@pytest.fixture(scope="module")
def docs(spark):
    return h.table(spark, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://a.example/{i}" if i % 7 else None, h.prose(i, 20 * (i % 50) + 1) if i % 11 else None, 1) for i in range(300)]
    return spark.createDataFrame([*rows, rows[3], (None, None, None, 2), (None, "u\r\nX: 1", "p", 2)], "page_id bigint, url string, html string, file int")


def test_empty_tables(spark, empty, pages):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    path = scratch_path(spark, "none")
    write_token_files(empty, path)
    model = train(empty, F.lit(True))
    none = [
        simhash_dedup(empty), near_copies(empty), suffixes.suffix_dedup(empty), scan(empty), decontaminate(empty, bench), label(empty, model),
        read_token_files(spark, path), exact_dedup(empty), line_dedup(empty), pack(empty), write_archive(pages.limit(0), scratch_path(spark, "none")),
    ]
    assert [df.count() for df in none] == [0] * len(none)
    index = none[-1]
    assert audit(index, leaves(index, scratch_path(spark, "none"))).count() == 0


# ---- near duplicates -------------------------------------------------------

def test_simhash_links_like_all_pairs(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [h.simhash(t) for _, t in rows]
    roots = h.smallest_reachable(len(rows), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = Counter((i, format(f, "016x"), least.get(r)) for (i, _), f, r in zip(rows, fps, roots, strict=True))
    for crowd in (2000, 2):
        got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup(docs, crowd=crowd).collect())
        assert got == want


def test_anchors_cover_three_bits():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 64, 400, np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    both = np.concatenate([a, b])
    index, key, near = anchors(both)
    of = [set(key[index == i].tolist()) for i in range(800)]
    nearest = [set(key[(index == i) & near].tolist()) for i in range(800)]
    assert all(nearest[i] & of[i + 400] and nearest[i + 400] & of[i] for i in range(400))
    index, key = blocks(np.full(800, 5, np.uint64), both)
    other = both >> np.uint64(32)
    of = [set(key[index == i].tolist()) for i in range(800)]
    assert all(of[i] & of[i + 400] for i in range(400) if np.bitwise_count(other[i] ^ other[i + 400]) <= 3)


def test_crowded_anchor_of_many_fingerprints(spark):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 1 << 62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (150, 2))})
    links = forest(np.array(fps, np.uint64))
    assert len(links) == len(fps) - 1
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint").repartition(4)
    from shorelark.llm.simhash import near_links

    for crowd in (2000, 5):
        assert components(near_links(df, crowd=crowd)).select("root").distinct().count() == 1


def test_near_copies_of_edited_texts(spark):
    rng = random.Random(3)
    rows = []
    for g in range(30):
        words = h.prose(100 + g, 300).split()
        rows.append((10 * g, " ".join(words), "en"))
        edited = words[:]
        edited[rng.randrange(300)] = "changed"
        rows.append((10 * g + 1, " ".join(edited), "en"))
    found = {r.doc_id: r.component_id for r in near_copies(h.table(spark, rows)).collect()}
    assert all(found[10 * g] == 10 * g for g in range(30))
    assert sum(found[10 * g + 1] == 10 * g for g in range(30)) >= 27


@pytest.mark.parametrize("most", [50, 2_000_000])
def test_components_of_a_chain(spark, monkeypatch, most):
    monkeypatch.setattr(common, "LINKS_PER_TASK", most)
    df = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 501), (7, 7)], "a bigint, b bigint").repartition(5)
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


# ---- repeated bytes --------------------------------------------------------

def in_order(rows):
    """Distinct (id, text) in the order of the operator: null ids first, then ids, then the hash of the text."""
    return sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))


@pytest.mark.parametrize("settings", [{}, {"GATHERED": 1, "HOT": 1}, {"SAMPLE": 0}])
def test_suffix_dedup_like_all_windows(spark, docs, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(suffixes, name, value)
    part = h.prose(5, 40)
    rows = [(r.doc_id, r.text) for r in docs.filter("length(text) < 20000 or text is null").collect()]
    rows += [(100 + i, h.prose(200 + i, 30) + part[i % 9:150 + 5 * i] + h.prose(300 + i, 10)) for i in range(25)] + [(200, part * 4), (201, "ab" * 400)]
    df = h.table(spark, [(i, t, None) for i, t in rows]).repartition(4)
    rids = {(r.doc_id, r.text): r.rid for r in df.select("doc_id", "text", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("rid")).collect()}
    want = h.repeats({(i, t): t for i, t, _ in in_order([(i, t, rids[i, t]) for i, t in rows])})
    got = [(r.doc_id, r.n_bytes, sum(s.length for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffixes.suffix_dedup(df).collect()]
    assert Counter(got) == Counter((i, *want[i, t]) for i, t in rows)


@pytest.mark.parametrize("settings", [{"CROWD": 2}, {"SHARD_BYTES": 500, "CROWD": 3, "GATHERED": 40, "REFINED": 1}, {"CROWD": 4, "GATHERED": 7}])
def test_suffix_dedup_in_small_pieces(spark, monkeypatch, settings):
    """Anchors whose stretches are held no longer, dealt out window by window, or refined alone, in any number of shards."""
    for name, value in settings.items():
        monkeypatch.setattr(suffixes, name, value)
    monkeypatch.setattr(suffixes, "SAMPLE", 0)
    part, line = h.prose(50, 60), h.prose(51, 12)[:80]
    rows = [(i % 60, h.prose(400 + i, 12) + part[3 * i % 11:170 + 5 * (i % 30)] + h.prose(500 + i % 40, 9)) for i in range(70)]
    rows += [(None, line + h.prose(600 + i % 5, 5) + line) for i in range(12)] + [(100 + i, line[i % 7:] + h.prose(700 + i % 9, 8)) for i in range(40)] + [(200, part * 3), (201, part * 3), (202, None)]
    df = h.table(spark, [(i, t, None) for i, t in rows]).repartition(4)
    rids = {(r.doc_id, r.text): r.rid for r in df.select("doc_id", "text", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("rid")).collect()}
    want = h.repeats({(i, t): t for i, t, _ in in_order([(i, t, rids[i, t]) for i, t in rows])})
    got = [(r.doc_id, r.n_bytes, sum(s.length for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffixes.suffix_dedup(df).collect()]
    assert Counter(got) == Counter((i, *want[i, t]) for i, t in rows)


def peak_mb(job) -> float:
    """Most MB that Python and numpy hold at once during a job."""
    tracemalloc.start()
    try:
        job()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_surroundings_are_refined_a_few_anchors_at_a_time():
    rng = np.random.default_rng(1)
    n, size = 300, 150
    raw = rng.integers(97, 123, (100 * n, size), np.uint8)
    raw[:, 60:92] = np.repeat(raw[::n, 60:92], n, 0)
    raw[1::n] = raw[::n]
    data = [r.tobytes() for r in raw]
    columns = {"apart": np.zeros(len(raw), bool), "h": np.arange(len(raw)) // n, "doc_id": np.arange(len(raw)), "rid": np.zeros(len(raw), np.int64), "lo": np.full(len(raw), 5)}
    batch = pa.RecordBatch.from_pydict(columns | {"bytes": pa.array(data, pa.binary())})
    found = []
    most = peak_mb(lambda: found.extend(suffixes._refine(iter([batch.slice(at, 7000) for at in range(0, len(raw), 7000)]), 1, 1000, suffixes.REFINED)))
    assert [x for b in found for x in zip(b["doc_id"].to_pylist(), b["a"].to_pylist(), b["b"].to_pylist(), strict=True)] == [(i, 5, 5 + size) for i in range(1, len(raw), n)]
    assert most < 100


def test_a_shard_is_settled_in_pieces():
    """Equal stretches and crowded anchors are not held until the shard ends."""
    def pieces():
        for k in range(60):
            out = np.zeros(20_000, suffixes.RECORD)
            out["doc"], out["h"] = 60 - k, np.arange(20_000) % 10_000 + 7
            out["g"], out["lo"] = out["h"], 200 * (np.arange(20_000) // 10_000)
            out["h"][:2000], out["g"][:2000] = 3, k * 2000 + np.arange(2000)
            yield out

    spans, asked = [], []

    def job():
        for s, a, apart in suffixes.combined(pieces(), 50_000, 3000):
            spans.append(len(s))
            asked.append(a["h"][apart].copy())
            assert apart.all()

    assert peak_mb(job) < 40
    asked = np.concatenate(asked)
    assert len(asked) == 120_000 and (asked == 3).all()
    assert sum(spans) > 0


def test_buckets_tell_windows_apart():
    rng = np.random.default_rng(0)
    raw = np.concatenate([rng.integers(97, 99, 1500), np.zeros(100)]).astype(np.uint8)
    raw[900:1200] = raw[100:400]
    at = np.arange(0, 1400)
    bucket = suffixes.refined(raw, at)
    groups = {}
    for p, b in zip(at.tolist(), bucket.tolist(), strict=True):
        groups.setdefault(b, set()).add(raw[p:p + 100].tobytes())
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({raw[p:p + 100].tobytes() for p in at})


# ---- licenses --------------------------------------------------------------

def test_patience_and_rising():
    assert rising([(0, 5), (1, 1), (2, 2), (3, 9), (4, 3)]) == [(1, 1), (2, 2), (4, 3)]
    text, template = "x a b c y d e a z".split(), "a b c d e".split()
    assert patience(text, template) == [(1, 0), (2, 1), (3, 2), (5, 3), (6, 4)]
    assert patience([], template) == [] and patience("p q".split(), template) == []
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 12))] for _ in range(2))
        found = patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x < u and y < v for (x, y), (u, v) in zip(found[:-1], found[1:], strict=True))


def test_license_scan(spark, docs):
    notice = TEMPLATES["Apache-2.0-notice"]
    dropped = " ".join(w for i, w in enumerate(notice.split()) if i % 8)
    rows = [
        (1, f"{h.prose(1, 50)}\nReleased under the MIT License.\n{h.prose(2, 50)} Released under the mit LICENSE.", None), (2, f"{h.prose(3, 9)} {dropped}", None),
        (3, "Licensed under\nCC BY-NC 4.0.", None), (4, "A license, under the version", None), (5, None, None), (None, "All rights reserved.", None), (6, h.prose(8, 20000) + " All rights  reserved", None),
    ]
    got = {(r.doc_id, r.license): r for r in scan(h.table(spark, rows)).collect()}
    assert Counter(r.license for r in scan(h.table(spark, rows)).collect() if r.doc_id == 1) == {"MIT-short": 2}
    assert {k for k in got if k[0] != 1} >= {(2, "Apache-2.0-notice"), (3, "CC-BY-NC-4.0"), (None, "all-rights-reserved"), (6, "all-rights-reserved")}
    assert not any(k[0] in (4, 5) for k in got) and got[2, "Apache-2.0-notice"].coverage < 1
    assert scan(docs, {"none": "", "odd": "zzz"}).count() == 0


def test_license_keys_miss_nothing(spark):
    """Stretches found around rare words are those that an alignment at every place finds."""
    rng = random.Random(4)
    template = "permission is granted to any person to use the files of the work in any form".split()
    rows = []
    for i in range(60):
        body = [w for w in template if rng.random() < 0.9]
        rows.append((i, " ".join([*h.prose(i, 20).split(), *body, *h.prose(i + 99, 20).split()]), None))
    found = {r.doc_id for r in scan(h.table(spark, rows), {"t": " ".join(template)}).collect()}
    n, slack = len(template), len(template) // 4 + 2
    names = [w.encode() for w in template]
    for i, text, _ in rows:
        words = license_words(text.encode())
        every = any(len(patience(words[max(0, a - slack):a + n + slack], names)) >= 0.8 * n for a in range(len(words)))
        assert (i in found) <= every
        if len([w for w in words if w in set(names)]) >= n - 1:
            assert i in found


# ---- benchmark -------------------------------------------------------------

def test_decontaminate_like_all_windows(spark, docs):
    long = h.prose(50, 40)
    items = [(1, long), (2, h.prose(51, 10)), (3, h.prose(52, 4)), (4, None), (5, "!!"), (6, h.prose(52, 4)), (10, h.prose(53, 12)), (1, long)]
    words = long.split()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [
        (100, " ".join(["pre", *words[5:15], "post"])), (101, " ".join(words[:9])), (102, "X " + h.prose(51, 10).upper().replace("ß", "ß") + " Y"), (103, h.prose(52, 4) + " " + h.prose(52, 4)),
        (104, "-".join(words[3:30])), (105, " ".join(words[:12] + ["gap"] + words[10:30])), (106, h.prose(53, 11)), (100, " ".join(words)),
    ]
    df = h.table(spark, [(i, t, None) for i, t in rows]).repartition(3)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, rid int")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate(df, bench).collect())
    want = Counter()
    for i, t in rows:
        n, hit, found = h.leaks(t, items)
        want[i, n, hit, tuple(found)] += 1
    assert got == want
    assert sum(n for (_, _, hit, _), n in got.items() if hit) >= 5


# ---- languages -------------------------------------------------------------

def test_languages(spark):
    rng = random.Random(5)
    made = {"aa": "bodugi kelo mana".split(), "bb": "stranz kropft schalm".split(), "ru": "привет мир слово".split()}

    def text(lang, n):
        return " ".join("".join(rng.sample(rng.choice(made[lang]), 3)) if rng.random() < 0.3 else rng.choice(made[lang]) for _ in range(n))

    rows = [(i, text(lang, 40), lang) for i, lang in enumerate(list(made) * 40)]
    model = train(h.table(spark, rows), F.col("doc_id") >= 0)
    assert model.languages == sorted(made)
    mixed = text("aa", 30) + ". " + text("bb", 50)
    more = [(900, mixed, None), (901, None, None), (902, "12 !", None), (903, text("ru", 3), None), (None, text("aa", 2000), None), (904, "漢字", None), (900, mixed, None)]
    got = label(h.table(spark, more), model).collect()
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (900, 901, 902, 903, None)] == ["bb", UNKNOWN, UNKNOWN, "ru", "aa"] and len(got) == len(more)
    assert [s.lang for s in by[900].spans] == ["aa", "bb"] and 0.5 < by[900].score < 1 and by[901].score == 0
    low = mixed.lower()
    first, second = by[900].spans
    assert low[first.start:first.start + first.length] == mixed.split(". ")[0] and first.start + first.length <= second.start
    assert by[904].lang_pred in made  # no script evidence: all languages stay candidates
    assert label(h.table(spark, more), Model([], model.scores[:, :, :0], model.candidates[:, :0])).filter("lang_pred = 'und'").count() == len(more)


def test_viterbi_like_all_paths():
    rng = np.random.default_rng(3)
    sizes = np.array([5, 0, 1, 6, 5])
    begins = np.cumsum(sizes) - sizes
    scores = rng.normal(0, 3, (sizes.sum(), 3))
    got = best_path(scores, begins, sizes, 2.0)
    import itertools

    for b, n in zip(begins, sizes, strict=True):
        part = scores[b:b + n]
        best = max(itertools.product(range(3), repeat=int(n)), key=lambda p: sum(part[i, x] for i, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p[:-1], p[1:], strict=True)))
        assert tuple(got[b:b + n]) == best


def test_words_and_held_out(spark):
    words = Words(["ab İc 1d".encode(), b"", "слово".encode()])
    assert words.text.tolist() == [0, 0, 0, 2] and words.start.tolist()[0] == 0
    import zlib

    got = {r.doc_id: r.o for r in spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id bigint").withColumn("o", held_out()).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)} | {None: False}


def test_letters_of_the_tertiary_plane():
    words = Words(["\U00030000\U0003134a \U000323af a".encode()])
    assert words.letters.tolist() == [2, 1, 1] and words.script[0] == words.script[1] == Words(["漢".encode()]).script[0]


def test_held_out_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = label(documents, train(documents, ~held_out())).join(documents.select("doc_id", "lang"), "doc_id").filter(held_out())
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


# ---- tokens ----------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    return t


def test_encoder_like_the_library(tokenizer):
    rng = random.Random(6)
    odd = ["  a", "a  ", " \n\n b\t", "don't I'll 'S", "x  y", "\x1c\x1d e", "été ², ½ १२ 漢字", "", "\n", "   ", "a\r\n  b", "...!?", "A.B,c;", "é \U0001f600‍ x", "word...", "it's.", "<|endoftext|>"]
    texts = odd + ["".join(rng.choice([" ", " ", "\n", "a", "B", "é", ".", "'", "s", "1", " ", "漢", "\x1f"]) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    encoder = Encoder.at(vocabulary())
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_long_texts_in_stretches_and_forgotten_pieces(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "STRETCH", 40)
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    encoder = Encoder(vocabulary())
    for t in ("one two  three\nfour, five. " * 30, "x" * 300 + " y" * 90, "Ünïcode 字 don't 3.14 ...  " * 20, "\n \t" * 60, "a\u3000b c" * 40):
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
    assert len(encoder.cache) < 100


def encoded(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def test_token_files_round_trip(spark, docs, tokenizer):
    path = scratch_path(spark, "tokens")
    write_token_files(docs, path)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read_token_files(spark, path).collect())
    want = Counter((i, len(e := encoded(tokenizer, t, 2)), h.crc(e)) for i, t, _ in DOCS)
    assert Counter((i, n, c) for _, i, n, c in got) == want
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    ids = [i for _, i, _, _ in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_packing(spark, docs, tokenizer):
    rows = sorted((r for r in pack(docs, block_tokens=500).collect()), key=lambda r: (r.sequence_id, r.offset))
    fill = {}
    for r in rows:
        assert r.offset == fill.get(r.sequence_id, 0) and r.length > 0
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048
    pieces = Counter()
    for i, t, _ in DOCS:
        ids = encoded(tokenizer, t, 1)
        pieces[i, len(ids)] += len(ids)
    got = Counter()
    for r in rows:
        got[r.doc_id, r.doc_tokens] += r.length
    assert got == pieces
    whole = {(i, len(encoded(tokenizer, t, 1))): encoded(tokenizer, t, 1) for i, t, _ in DOCS}
    for r in rows:
        if (r.doc_id, r.doc_tokens) not in ((15, 1),):
            ids = whole[r.doc_id, r.doc_tokens][r.start:r.start + r.length]
            assert len(ids) == r.length
            if r.doc_id in (6, 7, 8, 9, 10):
                assert r.ids_crc32 == h.crc(ids)
    big = h.table(spark, [(i, h.prose(i, 400), None) for i in range(300)]).coalesce(1)
    sizes = Counter()
    for r in pack(big).collect():
        sizes[r.sequence_id] += r.length
    padding = sum(0 if n.bit_count() == 1 else 2048 - n for n in sizes.values())
    assert padding < 0.02 * sum(sizes.values())


def test_cuts_like_all_choices():
    import itertools

    rng = random.Random(7)
    for _ in range(40):
        cuts = np.cumsum([rng.randint(1, 6) for _ in range(8)])
        price = np.array([rng.choice([0, 2, 5]) for _ in range(8)], float)
        ends = best_cuts(cuts, price, 12)

        def cost(chosen):
            sizes = np.diff([0, *chosen])
            return sum(12 - sizes) + sum(price[cuts.tolist().index(c)] for c in chosen) if max(sizes) <= 12 else 1e9

        every = [cost([*c, int(cuts[-1])]) for k in range(8) for c in itertools.combinations(cuts[:-1].tolist(), k)]
        assert cost(ends) == min(every)


# ---- exact copies and lines ------------------------------------------------

@pytest.mark.parametrize("digest", [None, lambda t: F.lit(b"same"), lambda t: F.length(t).cast("string").cast("binary")])
def test_exact_dedup(docs, digest):
    groups = {}
    for i, t, _ in DOCS:
        groups.setdefault(t or "", []).append(i)
    want = Counter()
    for i, t, _ in DOCS:
        same = groups[t or ""]
        keep = max((x for x in same if x is not None), default=None)
        want[i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    out = (exact_dedup(docs, digest=digest) if digest else exact_dedup(docs)).drop("rid")
    assert Counter(tuple(r) for r in out.collect()) == want


@pytest.mark.parametrize("bits", [1 << 26, 1 << 12])
def test_line_dedup(spark, bits):
    common, rare = h.prose(1, 12), h.prose(2, 12)
    assert len(common) >= 40
    rows = [(i, f"{h.prose(i, 5)}\n \t{common.upper() if i % 2 and common.isascii() else common} \r\n{rare if i < 3 else ''}\n{common}") for i in range(8)]
    rows += [(None, common), (None, None), (5, common), (20, ""), (21, "x" * 39), (22, "é" * 40), (23, "é" * 40), (24, "é" * 40), (25, "é" * 40), (26, "É" * 40), (27, "é" * 40 + "\n\n" + "é" * 40)]
    got = Counter(tuple(r) for r in line_dedup(h.table(spark, [(i, t, None) for i, t in rows]), filter_bits=bits).collect())
    assert got == Counter(h.deduplicated_lines(rows))


# ---- archives --------------------------------------------------------------

def test_archive_audit(spark, pages):
    first, second = scratch_path(spark, "warc"), scratch_path(spark, "warc")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files
    try:
        index = write_archive(pages, first)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert index.count() == 303 and index.filter("payload_bytes = 0").count() == pages.filter("coalesce(html, '') = ''").count()
    assert audit(index, leaves(index, first)).count() == 0
    spoilt = (F.col("page_id") % 50 == 7) & (F.col("payload_bytes") > 0)
    copy_archive(index, first, second, spoil=spoilt)
    found = audit(index, leaves(index, second)).join(index, ["file", "record"])
    assert Counter(r.page_id for r in found.collect()) == Counter(r.page_id for r in index.filter(spoilt).collect())
    # a file that is cut off, and one that is gone
    from shorelark.llm.token_files import store
    from shorelark.llm.warc_audit import warc_name

    files, root = store(second)
    names = sorted(r.file for r in index.select("file").distinct().collect())
    files.delete_file(warc_name(root, names[0]))
    with files.open_input_file(warc_name(root, names[1])) as f:
        head = f.read(f.size() - 1)
    with files.open_output_stream(warc_name(root, names[1]), compression=None) as f:
        f.write(head)
    found = {(r.file, r.record) for r in audit(index, leaves(index, second)).collect()}
    sizes = {r.file: r.n for r in index.groupBy("file").agg(F.count("*").alias("n")).collect()}
    assert {(names[0], k) for k in range(sizes[names[0]])} <= found and (names[1], sizes[names[1]] - 1) in found


def test_records_read_back():
    import gzip

    data, digest = record("http://a/ü", b"<p>x</p>", "2024-01-01T00:00:00Z")
    head, body = gzip.decompress(data).split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.0\r\nWARC-Type: resource") and body == b"<p>x</p>\r\n\r\n"
    assert f"sha256:{digest}".encode() in head and record("http://a/ü", b"<p>x</p>", "2024-01-01T00:00:00Z")[0] == data
