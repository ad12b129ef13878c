"""Ranked search against a plain loop and its SQL, with bundles, blocks and owners made small."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from cases import documents, odd_documents, words

from weftspan.llm import lexical

PATTERN = re.compile(lexical.PATTERN)


def terms(text):
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(rows, items, best=10):
    docs = [(doc_id, Counter(t), len(t)) for doc_id, t in ((r[0], terms(r[1])) for r in rows) if t]
    n, length = len(docs), sum(d[2] for d in docs)
    df = Counter(t for d in docs for t in d[1])
    found = []
    for item_id, text in items:
        scores = []
        for doc_id, counts, held in docs:
            score = 0
            for t in terms(text):
                if tf := counts[t]:
                    weight = math.floor(1000 * math.log((2.0 * n + 2) / (2 * df[t] + 1)))
                    score += weight * (1_000_000_000 * tf // (1000 * tf + 8 * (25 + 75 * held * n // length)))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        found += [(item_id, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:best], 1)]
    return sorted(found, key=str)


def benchmark(spark, items, clash=False):
    frame = spark.createDataFrame(items, "item_id long, text string")
    return frame.selectExpr("*", "'x' as doc_id", "'x' as _item", "'x' as rank") if clash else frame


def got(spark, rows, items, clash=False, **more):
    found = lexical.search(documents(spark, rows, clash=clash), benchmark(spark, items, clash), **more)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def odd_items(rng):
    return [
        (1, " ".join(words(rng, 30))), (2, None), (3, ""), (4, "nothing at all matches qqqzzz"),
        (5, "one two ONE"), (6, "naïve ünïcode 漢字 it s"), (7, "same same same"), (1, "one w5x w6x w7x"), (None, "w8x first line"),
    ]


def test_cases(spark):
    rng = random.Random(5)
    rows, items = odd_documents(), odd_items(rng)
    assert got(spark, rows, items, clash=True) == plain_search(rows, items)
    assert got(spark, [], items) == [] and got(spark, rows, []) == [] and got(spark, [(1, None, None, None, None)], items) == []
    assert got(spark, rows, items, best=2) == plain_search(rows, items, 2)


@pytest.mark.parametrize("seed", [1, 2])
def test_many_bundles_and_blocks(spark, monkeypatch, seed):
    """Skewed words, groups of copies, ties beyond the last place."""
    monkeypatch.setattr(lexical, "BUNDLE_ITEMS", 4)
    monkeypatch.setattr(lexical, "BLOCK_DOCUMENTS", 30)
    monkeypatch.setattr(lexical, "OWNER_SHARES", (60, 20, 5))
    rng = random.Random(seed)

    def text(n):
        return " ".join(f"w{int(1.5 ** rng.uniform(0, 16))}" for _ in range(n))

    rows = [(i, text(rng.randrange(3, 60)), "en", "a", 1) for i in range(300)]
    copy = text(40)
    rows += [(1000 + i, copy, "en", "a", 1) for i in range(40)] + rows[:5]
    items = [(i, text(rng.randrange(1, 40))) for i in range(12)] + [(50, copy)]
    assert got(spark, rows, items) == plain_search(rows, items)


def test_sql(spark):
    rng = random.Random(9)
    rows, items = odd_documents(), odd_items(rng)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    found = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({lexical.search_sql()})").fetchall()
    assert sorted(found, key=str) == plain_search(rows, items)


def test_put_down_documents_cannot_return():
    """A document is put down only if it can't reach the last place, and an
    unseen one is taken up only while it might."""
    empty = np.zeros(0, np.int64)
    terms_ = np.array([0]), np.array([7]), np.array([10])
    postings = np.array([7, 7, 7]), np.array([1, 2, 3]), np.array([5, 3, 1])
    places, rows, scores, _, best = lexical.add_contributions((empty, empty, empty), terms_, ([0], [50], [20], [0]), postings, 1)
    assert rows.tolist() == [1, 2] and scores.tolist() == [50, 30] and best.tolist() == [50]
    carried = np.array([0]), np.array([2]), np.array([60])
    places, rows, scores, _, best = lexical.add_contributions(carried, terms_, ([0], [50], [0], [60]), postings, 1)
    assert rows.tolist() == [2] and scores.tolist() == [90]
