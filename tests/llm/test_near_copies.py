"""Near copies against the exact similarity of all pairs."""

from __future__ import annotations

import random

import pytest

from shorelark.llm import simhash
from shorelark.llm.simhash import near_copies
from tests.llm import helpers as h


def shingles(text, words=5) -> set:
    w = h.spaced(text)
    return {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))}


def similarity(a: set, b: set) -> float:
    return len(a & b) / len(a | b)


def edited(seed: int, n: int, changes: int) -> tuple[str, str]:
    words = h.prose(seed, n).split()
    other = words[:]
    for k in range(changes):
        other[(2 * k + 1) * n // (2 * changes)] = f"changed{k}"
    return " ".join(words), " ".join(other)


def planted() -> list[tuple]:
    """Pairs at about 0.7, 0.75, 0.8, 0.85 and 0.9, a pair at exactly 0.8 and one at 7 / 9."""
    rows = []
    for g in range(50):
        rows += [(10 * g + k, t, "en") for k, t in enumerate(edited(1000 + g, 300, (3, 5, 6, 7, 8, 9, 10)[g % 7]))]
    words = h.prose(7, 40).split()
    rows += [(900, " ".join(words[:13]), "en"), (901, " ".join(words[1:14]), "en"), (910, " ".join(words[20:32]), "en"), (911, " ".join(words[21:33]), "en")]
    return rows


def crowd() -> list[tuple]:
    """Texts that share most of their shingles with many others, at 0.6 to 0.9, in chains of edits."""
    rng = random.Random(8)
    words = h.prose(42, 120).split()
    rows = []
    for i in range(120):
        words[rng.randrange(120)] = f"edit{i}"
        if i % 40 == 39:
            words[5::20] = [f"more{i}-{k}" for k in range(6)]
        rows.append((2000 + i, " ".join(words), "en"))
    return rows


def answers(spark, rows, **settings):
    return {r.doc_id: r.component_id for r in near_copies(h.table(spark, rows).repartition(3), **settings).collect()}


def expected(rows) -> dict:
    sets = [shingles(t) for _, t, _ in rows]
    roots = h.smallest_reachable(len(rows), lambda a, b: 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]))
    least = {}
    for (i, _, _), r in zip(rows, roots, strict=True):
        least[r] = min(i, least.get(r, i))
    return {i: least[r] for (i, _, _), r in zip(rows, roots, strict=True)}


def test_near_copies_like_all_pairs(spark):
    rows = planted()
    near = [similarity(shingles(a[1]), shingles(b[1])) for a, b in zip(rows[::2], rows[1::2], strict=True)]
    assert sum(0.7 <= s < 0.8 for s in near) > 10 and sum(0.8 <= s < 0.9 for s in near) > 10 and 0.8 in near
    got = answers(spark, rows)
    assert got == expected(rows) and got[901] == 900 and got[911] == 911


@pytest.mark.parametrize("sweeps", [0, 1])
def test_a_crowd_changes_no_pair(spark, sweeps):
    rows, more = planted(), crowd()
    got = answers(spark, rows + more, sweeps=sweeps)
    assert got == expected(rows) | expected(more) and len({got[i] for i, _, _ in more}) > 1


def unlike() -> list[tuple]:
    """Edits of one text, which is not there itself: each is alike to that one, hardly any to another."""
    rng = random.Random(9)
    base = h.prose(43, 150).split()
    rows = []
    for i in range(300):
        words = base[:]
        for k, at in enumerate(rng.sample(range(10, 140), 3)):
            words[at] = f"own{i}-{k}"
        rows.append((5000 + i, " ".join(words), "en"))
    return rows


def test_a_crowd_of_unlike_texts_makes_few_pairs(spark, monkeypatch):
    rows, met = unlike(), []

    def counted(members, *given, by_prefix=simhash.by_prefix):
        pairs = by_prefix(members, *given)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(simhash, "by_prefix", counted)
    assert answers(spark, rows, sweeps=0) == expected(rows)
    assert met[-1] < 2 * len(rows)


def test_pairs_of_many_keys_are_all_found(spark):
    """Sets 1 and 2 have all keys, others every third: each pair with a key in common is there, though it meets at one of many only."""
    shared = [(k, node, 2000, k, node) for k in range(0, 400, 2) for node in (1, 2, *range(10 + k % 3, 40, 3))]
    members = spark.createDataFrame(shared, "key long, node long, n long, pos int, root long")
    sets = spark.createDataFrame([(node, [0] * 16) for node in range(50)], "node long, bits array<long>")
    got = {(r.a, r.b) for r in simhash.by_prefix(members, sets, None, 80).collect()}
    together = {tuple(sorted((a, b))) for k in range(3) for g in [(1, 2, *range(10 + k, 40, 3))] for a in g for b in g if a != b}
    assert got == together
