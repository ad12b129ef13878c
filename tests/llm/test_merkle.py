"""Merkle manifest against trees built in plain Python, with odd rows and request choices."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from cases import documents, odd_documents
from pyspark.sql import functions as F

from weftspan.llm import merkle, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, low=False):
    doc_id, text, lang, source, n_chars = row
    if low and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_siblings(levels, at):
    found = []
    for nodes in levels[:-1]:
        begin = at // 8 * 8
        found.append(("".join(nodes[begin:at]), "".join(nodes[at + 1 : begin + 8])))
        at //= 8
    return found


def plain_rows(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[g] = plain_levels([plain_leaf(r) for r in groups[g]])
    top = plain_levels([trees[g][-1][0] for g in names])
    found = []
    for place, g in enumerate(names):
        for at, row in enumerate(groups[g]):
            path = plain_siblings(trees[g], at) + plain_siblings(top, place)
            node = plain_leaf(row, row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0)
            for before, after in path:
                node = sha(before + node + after)
            proof = sha("".join(a + b for a, b in path))
            found.append((row[0], plain_leaf(row), trees[g][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(found, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def answers(spark, monkeypatch, frame):
    monkeypatch.setattr(queries, "table", lambda *_: frame)
    return sorted((tuple(r) for r in queries.op13_merkle(spark, "").select(*COLUMNS).collect()), key=str)


def many(n, langs):
    return [(i, f"Text {i} É", langs[i % len(langs)], "s", i) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        odd_documents(),
        [],
        [(5, "ONE", None, None, None)],
        many(65, ["en", "ÿ", "z", None]),
        many(600, ["en"]),
        many(40, [f"l{i}" for i in range(20)]),
        [(7, "same row", "en", "s", 1)] * 70 + many(9, ["en"]),
    ],
    ids=["odd", "none", "one", "levels", "one group", "many groups", "copies"],
)
def test_registered_query(spark, monkeypatch, rows):
    assert answers(spark, monkeypatch, documents(spark, rows, clash=bool(rows))) == plain_rows(rows)


def test_some_requests(spark):
    rows = many(300, ["en", "de"])
    leaves = documents(spark, rows, clash=True).select("doc_id", "lang", merkle.row_digest().alias("leaf"))
    manifest = merkle.build(leaves, "lang", "doc_id", ["doc_id"])
    asked = manifest.leaves.filter(F.col("doc_id").isin(0, 17, 18, 299))
    got = merkle.proofs(manifest, asked).withColumn("folded", merkle.folded(F.col("leaf"))).collect()
    assert {r["doc_id"] for r in got} == {0, 17, 18, 299} and len(got) == 4
    assert {r["folded"] for r in got} == {manifest.root}
    assert all(len(r["segments"]) == 4 for r in got)


def test_changed_leaf_does_not_fold_to_the_root(spark):
    rows = many(30, ["en"])
    leaves = documents(spark, rows).select("doc_id", "lang", merkle.row_digest().alias("leaf"))
    got = merkle.proofs(merkle.build(leaves, "lang", "doc_id", ["doc_id"]))
    assert got.filter(merkle.folded(F.sha2(F.concat("leaf", F.lit("x")), 256)) == F.col("root")).count() == 0
