"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An
n-gram's vector binds its letters: the elementwise product of their vectors,
each rotated by its place. A text's vector bundles (adds) those of its n-grams;
a language's prototype bundles those of its training texts, each scaled to unit
length so that a long text has no more say than a short one. A text gets the
language whose prototype has the largest cosine with its vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspan.llm.batches import pieces
from weftspan.llm.hashing import mix

DIMENSIONS = 1024
GRAM = 3
TRAINING_DOCUMENTS = 20_000
KNOWN_GRAMS = 60_000
MAX_LANGUAGES = 10_000
NO_LANGUAGE = "und"


def letter_codes(text: str) -> np.ndarray:
    """Lower-case letters as code points; each stretch of others is one 0."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_is_letter()[points], points, 0)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep]


_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


class Grams:
    """Vectors of n-grams, made on first use and kept up to ``KNOWN_GRAMS``."""

    def __init__(self, dimensions: int, n: int):
        self.dimensions, self.n = dimensions, n
        self.letters: dict[int, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.row: dict[int, int] = {}
        self.table = np.empty((1024, self.dimensions), np.float32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > 20_000:
                self.letters.clear()
            words = self.dimensions // 64
            seeds = np.arange(words, dtype=np.uint64) + np.uint64(code) * np.uint64(words) + np.uint64(1)
            bits = np.unpackbits(mix(mix(seeds)).view(np.uint8))
            self.letters[code] = bits.astype(np.int8) * 2 - 1
        return self.letters[code]

    def rows(self, grams: np.ndarray) -> np.ndarray:
        found = [self.row.get(g, -1) for g in grams.tolist()]
        if -1 in found and len(self.row) + len(found) > KNOWN_GRAMS:
            self.clear()
            found = [-1] * len(found)
        for at, g in enumerate(grams.tolist()):
            if found[at] < 0:
                found[at] = self.row[g] = len(self.row)
                while found[at] >= len(self.table):
                    self.table = np.concatenate([self.table, np.empty_like(self.table)])
                vector = np.ones(self.dimensions, np.int8)
                for place in range(self.n):
                    code = (g >> (21 * (self.n - 1 - place))) & 0x1FFFFF
                    vector = vector * np.roll(self.letter(code), place)
                self.table[found[at]] = vector
        return np.array(found)

    def bundle(self, text: str) -> np.ndarray | None:
        """Vector of a text; None if it has no letter."""
        codes = letter_codes(f" {text} ").astype(np.int64)
        if not codes.any():
            return None
        codes = np.pad(codes, (0, max(0, self.n - len(codes))))
        grams = np.zeros(len(codes) - self.n + 1, np.int64)
        for place in range(self.n):
            grams = (grams << 21) | codes[place : place + len(grams)]
        total = np.zeros(self.dimensions, np.float32)
        kinds, counts = np.unique(grams, return_counts=True)
        for begin in range(0, len(kinds), KNOWN_GRAMS // 2):
            part = slice(begin, begin + KNOWN_GRAMS // 2)
            rows = self.rows(kinds[part])
            total += counts[part].astype(np.float32) @ self.table[rows]
        return total


_grams: dict[tuple[int, int], Grams] = {}


def _grams_of(dimensions: int, n: int) -> Grams:
    return _grams.setdefault((dimensions, n), Grams(dimensions, n))


@dataclass
class Profiles:
    """Languages in order and their unit prototypes, one row each."""

    names: list[str]
    vectors: np.ndarray
    dimensions: int
    n: int

    def classify(self, text: str) -> tuple[str, float]:
        bundle = _grams_of(self.dimensions, self.n).bundle(text) if self.names else None
        norm = float(np.linalg.norm(bundle)) if bundle is not None else 0.0
        if not norm:
            return NO_LANGUAGE, 0.0
        cosines = self.vectors @ (bundle / norm)
        best = int(np.argmax(cosines))
        return self.names[best], float(min(1.0, max(0.0, cosines[best])))


def bounded(rows: DataFrame, key: Column, bound: int) -> DataFrame:
    """All rows if there are at most ``bound``, else about so many of them,
    chosen by a digest of ``key`` alone."""
    total = rows.count()
    if total <= bound:
        return rows
    return rows.filter(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) < int(bound / total * (1 << 30)))


def learn(labelled: DataFrame, dimensions: int = DIMENSIONS, n: int = GRAM, bound: int = TRAINING_DOCUMENTS) -> Profiles:
    """Prototypes from (doc_id, text, lang).

    At most about ``bound`` documents are used, chosen by doc_id. Rows with a
    null lang, or with a text that has no letter, teach nothing. Each task adds
    up its texts by language; sums of one vector per task and language are then
    added by Spark. The driver receives one vector per language, of which it
    takes at most ``MAX_LANGUAGES``; more is an error.
    """
    rows = bounded(labelled.filter(F.col("lang").isNotNull()).select("doc_id", "lang", "text"), F.col("doc_id"), bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums = _grams_of(dimensions, n), {}
        for part, texts in pieces(batches, "text"):
            for lang, text in zip(part.column(0).to_pylist(), texts, strict=True):
                vector = grams.bundle(text.decode())
                norm = float(np.linalg.norm(vector)) if vector is not None else 0.0
                if norm:
                    sums[lang] = sums.get(lang, 0.0) + vector.astype(np.float64) / norm
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()])], names=["lang", "vector"]
            )

    parts = rows.select("lang", "text").mapInArrow(run, "lang string, vector array<double>")
    cells = parts.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    found = cells.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("cells"))
    got = found.limit(MAX_LANGUAGES + 1).collect()
    if len(got) > MAX_LANGUAGES:
        raise ValueError("too many languages; is lang a language column?")
    got = sorted(got, key=lambda r: r["lang"])
    vectors = np.array([[c["x"] for c in r["cells"]] for r in got], np.float32).reshape(len(got), dimensions)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Profiles([r["lang"] for r in got], vectors / np.maximum(norms, 1e-12), dimensions, n)


def predict(docs: DataFrame, profiles: Profiles, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, ``lang_pred`` and ``score`` (cosine, at least 0) of each row.

    A null text, or one without a letter, gets ``und`` and 0, as does every text
    if nothing was learned. Ties go to the language first in order. A text of any length
    is read whole; rows that repeat each get a row; an empty table gives none. Of the
    columns only ``keys`` and ``text`` are read; a key may have any name but those of the
    result.
    """
    rows = docs.select(*keys, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "_text"):
            found = [profiles.classify(t.decode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*keys, "lang_pred", "score"],
            )

    kinds = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")
