"""Small tables for the tests, and plain versions of what operators compute."""

import random
import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}x" for _ in range(n)]


def odd_documents(rng=None):
    """Nulls, empty and long texts, repeated rows and copies."""
    rng = rng or random.Random(3)
    base = " ".join(words(rng, 60))
    rows = [
        (1, base, "en", "a", len(base)),
        (2, base, "en", "a", len(base)),
        (3, base + " tail", None, None, None),
        (4, None, "en", "b", None),
        (5, "", "fr", "b", 0),
        (6, "12 34 !!", "fr", "b", 8),
        (7, "one two", None, "c", 7),
        (8, "one two", "en", "c", 7),
        (None, "a row without a number " + base, "en", "c", 5),
        (9, " ".join(words(rng, 9_000)), "en", "d", 1),
        (10, "first line of ten words that stands in two texts\n\nsecond " + base, "de", "d", 1),
        (11, "First line of ten words that stands in two texts \nother", "de", "d", 1),
        (12, "naïve Ünïcode ½ 漢字 <|endoftext|> it's, don't!!\tx y", "de", "d", 1),
        (13, " ".join(["same"] * 50), "de", "d", 1),
    ]
    return rows + [rows[0], rows[3]]


def documents(spark, rows=None, clash=False):
    frame = spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA)
    if clash:
        names = "score ids start _id _hash _copy _removed _text _hit keys id class_id held_out lang_pred frame".split()
        for name in names:
            frame = frame.selectExpr("*", f"concat('keep', cast(doc_id as string)) as `{name}`")
    return frame


def plain_shingles(text, n=5):
    found = re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(found[i : i + n]) for i in range(max(1, len(found) - n + 1))} if found else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def groups(pairs, nodes):
    """Least member of each node's component."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
