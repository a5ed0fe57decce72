"""Small tables with every awkward case, and plain versions of what the operators compute."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import xxhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rid string, kept int, fp string, `key` int, start string"
LENGTH = 100


def table(spark, rows, extra=("x", 1, "y", 2, "z")):
    """documents with further columns whose names the operators use inside."""
    full = [(i, t, lang, None, None, *extra) for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choice(["th", "er", "on", "an", "re", "ß", "é", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w.title() + "." if rng.random() < 0.1 else w for w in words)


def awkward() -> list[tuple]:
    long = prose(1, 30_000)
    shared = prose(2, 60)
    return [
        (1, "The same text.", "en"), (2, "The same text.", "en"), (2, "The same text.", "en"), (3, None, "en"), (4, "", None), (5, " \t\n ", "en"),
        (None, "The same text.", "en"), (None, None, None), (None, "Only here, without an id.", "en"), (6, long, "en"), (7, long + " end", "en"),
        (8, shared + "\n" + prose(3, 40), "de"), (9, prose(4, 30) + "\n" + shared, "de"), (10, "x" * 5000, "en"), (11, "Ünïcödé ÀÉ words 漢字 слово", "fr"),
        (12, "one", "en"), (13, "12 34 !!", None), (14, "\n\n\n", "en"), (15, shared, "de"), (15, shared + "!", "de"), (16, "a  b   c   d\x1ce\x85f <|endoftext|> g", "en"),
    ]


def spaced(text) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def simhash(text, words=3) -> int:
    w = spaced(text)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i:i + words]), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def smallest_reachable(n: int, linked) -> list[int]:
    """By index: the indexes that chains of links reach."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                root[find(a)] = find(b)
    return [find(x) for x in range(n)]


def repeats(docs: dict, length=LENGTH) -> dict:
    """By document: bytes, bytes removed, runs and hash of the rest; documents are given in order."""
    seen, out = set(), {}
    for key, text in docs.items():
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            window = data[p:p + length]
            if window in seen:
                gone[p:p + length] = b"\x01" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        starts = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[key] = (len(data), sum(gone), starts, hashlib.sha256(kept).hexdigest())
    return out


def words_of(text) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def leaks(text, items, window=10):
    """Words, hit words and found items of a text."""
    words, hit, found = words_of(text), set(), set()
    for item, item_text in items:
        iw = words_of(item_text)
        n = min(window, len(iw))
        grams = {tuple(iw[k:k + n]) for k in range(len(iw) - n + 1)} if n else set()
        for k in range(len(words) - n + 1):
            if grams and tuple(words[k:k + n]) in grams:
                hit |= set(range(k, k + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def deduplicated_lines(rows: list[tuple], least_chars=40, least_docs=5):
    blank = " \t\n\x0b\x0c\r"

    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(blank))

    held = {}
    for n, (doc, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least_chars:
                held.setdefault(k, []).append((doc is not None, doc or 0, n))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = []
        for line in lines:
            who = held.get(key(line), ())
            keeper = max(who)[:2] if len(who) >= least_docs else None
            if keeper is None or keeper == (doc is not None, doc or 0):
                stay.append(line)
        out.append((doc, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def crc(ids) -> int:
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
