"""The attention model against plain loops and numeric gradients; base scores against
counting; odd texts; and accuracy on rows that were not learned from."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, odd_documents
from pyspark.sql import functions as F

from weftspan.llm import attention as A
from weftspan.llm import queries, scoring
from weftspan.llm.tokens import default_tokenizer, encoder_of


def small_model(seed=0, kinds=30, unseen=1000):
    rng = np.random.default_rng(seed)
    s = A.symbols(np.arange(kinds) * 3, rng.integers(1, 500, kinds), unseen)
    p = {n: v.astype(np.float64) for n, v in A.start(s).items()}
    for name in ("class", "member", "query", "key", "value"):
        p[name] += rng.normal(0, 0.3, p[name].shape)
    return rng, s, p


def plain_log_probability(p, s, indices, first):
    """Of each symbol, one place at a time, over the whole vocabulary."""
    row = [s.pad] * A.CONTEXT + [first, *indices]
    found = []
    for at, target in enumerate(indices):
        here = A.CONTEXT + at
        begin = A.CONTEXT + at // A.SCORED * A.SCORED - A.CONTEXT
        seen = [j for j in range(begin, here + 1) if row[j] != s.pad]
        e = p["embedding"]
        q = e[row[here]] @ p["query"]
        weights = np.array([q @ (e[row[j]] @ p["key"]) / A.WIDTH**0.5 + p["bias"][here - j] for j in seen])
        weights = np.exp(weights - weights.max())
        weights /= weights.sum()
        r = e[row[here]] + sum(w * (e[row[j]] @ p["value"]) for w, j in zip(weights, seen))
        h = r + np.maximum(r @ p["up"] + p["up_bias"], 0) @ p["down"]
        of_class = np.exp(h @ p["class"] + p["class_bias"])
        of_class /= of_class.sum()
        chances = np.zeros(s.other)
        for k in range(len(of_class)):
            begin, end = s.bounds[k], s.bounds[k + 1]
            within = np.exp(p["member"][begin:end] @ h + p["member_bias"][begin:end])
            chances[begin:end] = of_class[k] * within / within.sum()
        chances *= 1 - s.novel
        assert abs(chances.sum() + s.novel - 1) < 1e-9
        found.append(math.log(chances[target] if target < s.other else s.novel / s.unknown))
    return found


def test_windows_score_each_symbol_once():
    rng, s, p = small_model()
    texts = [s.codes[rng.integers(0, 30, n)] for n in (1, 31, 32, 33, 200)]
    texts[3][5] = 1  # unknown
    scorer = A.Scorer(p, s)
    got = scoring.text_scores(scorer, iter(texts), len(texts), 0)
    want = [sum(plain_log_probability(p, s, s.indices(t).tolist(), 0)) / math.log(10) for t in texts]
    assert np.allclose(got, want, rtol=1e-5)
    assert scoring.text_scores(scorer, iter([]), 0, 0).tolist() == []


def test_later_symbols_do_not_matter():
    rng, s, p = small_model(1)
    text = rng.integers(0, 30, 100)
    changed = text.copy()
    changed[60:] = rng.integers(0, 30, 40)
    one, two = (A.Scorer(p, s).places(A.windows(t, s, 0)).ravel()[:60] for t in (text, changed))
    assert np.allclose(one, two) and not np.allclose(A.Scorer(p, s).places(A.windows(changed, s, 0)).ravel()[60:100], A.Scorer(p, s).places(A.windows(text, s, 0)).ravel()[60:100])


def test_gradients():
    rng, s, p = small_model(2)
    batch = np.concatenate([A.windows(rng.integers(0, 31, n), s, 0) for n in (70, 20, 33)])
    _, gradient = A.loss_and_gradients(p, s, batch)
    for name, values in p.items():
        for _ in range(5):
            at = tuple(rng.integers(0, k) for k in values.shape)
            if name == "embedding" and at[0] >= s.other:
                continue
            own, step = values[at], 1e-5
            values[at] = own + step
            up = A.loss_and_gradients(p, s, batch)[0]
            values[at] = own - step
            down = A.loss_and_gradients(p, s, batch)[0]
            values[at] = own
            assert gradient[name][at] == pytest.approx((up - down) / 2 / step, rel=1e-3, abs=3e-6), (name, at)


def test_start_is_the_share_of_counts():
    s = A.symbols(np.array([5, 9, 11]), np.array([1, 6, 3]), 100)
    p = A.start(s)
    first = A.Scorer({**p, "down": p["down"] * 0}, s).places(A.windows(s.indices(np.array([9, 5, 11, 7])), s, s.other)).ravel()[:4]
    known = 1 - s.novel
    assert np.allclose(np.exp(first), [known * 0.6, known * 0.1, known * 0.3, s.novel / 97], atol=1e-6)


def base_of(rows, trained):
    """(n_tokens, n_known, train_tokens, base score) of each text, by counting."""

    def tokens(text):
        return [*re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), None]

    counts = Counter(t for (doc_id, text, *_), own in zip(rows, trained) if own for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    return [
        (len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6))
        for t in (tokens(r[1]) for r in rows)
    ]


@pytest.mark.parametrize("common", [10, 1_000_000])
def test_base_scores(spark, monkeypatch, common):
    """With most words met in the join, and with all sent to the tasks."""
    monkeypatch.setattr(scoring, "COMMON", common)
    rows = odd_documents(random.Random(2))
    docs = documents(spark, rows, clash=True).withColumn("train", F.col("doc_id") % 3 != 0).withColumn("held", F.col("doc_id") == 2)
    got = scoring.score(docs, "train", "held").collect()
    want = base_of(rows, [r[0] is not None and r[0] % 3 != 0 for r in rows])
    assert sorted(want) == sorted((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    assert all(r["score"] < 0 for r in got) and {r["doc_id"] for r in got if r["held_out"]} == {2}
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[1] == pytest.approx(by_id[2], abs=1e-3) and by_id[4] == pytest.approx(by_id[5], abs=1e-3)


def test_nothing_to_learn_from(spark):
    docs = documents(spark).withColumn("no", F.lit(False))
    got = scoring.score(docs, "no", "no").collect()
    assert {r["train_tokens"] for r in got} == {0} and {r["base_score"] for r in got} == {0.0}
    encoder = encoder_of(default_tokenizer())
    for r, text in ((r, dict((d[0], d[1]) for d in odd_documents())[r["doc_id"]]) for r in got):
        ids = len(encoder.encode((text or "").encode())) // encoder.type.itemsize
        assert r["score"] == pytest.approx(-ids * math.log10(2 * 49408), rel=1e-6)
    assert scoring.score(docs.limit(0), "no", "no").count() == 0


def test_codes_give_back_words():
    encoder = encoder_of(default_tokenizer())
    ids, starts = scoring._pieces(encoder, "don't stop, ab c".encode())
    codes = scoring.codes_of(ids, starts, encoder.type)
    assert (codes & 1).sum() == 5 and codes[-1] == 5  # four words and the end
    one, two = (scoring.codes_of(*scoring._pieces(encoder, t), encoder.type).tolist() for t in (b"a .", b"a."))
    assert one != two


def test_held_out_texts_are_likelier_than_their_base(spark):
    got = queries.op11_scoring(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


@pytest.mark.parametrize("parts", [1, 3])
def test_every_window_is_learned_from(monkeypatch, parts):
    """The rounds together get each window of each row, once if they take parts of them."""
    monkeypatch.setattr(scoring, "HELD_WINDOWS", 7)
    rng, s, _ = small_model(3)
    kind = encoder_of(default_tokenizer()).type
    ids = [rng.integers(0, 15, n).astype(kind) for n in (1, 40, 700, 5000)]
    starts = [np.packbits(rng.integers(0, 2, len(i)).astype(bool)).tobytes() for i in ids]
    rows = pa.RecordBatch.from_arrays([pa.array([5, 6, 8589934592, 8]), pa.array([i.tobytes() for i in ids]), pa.array(starts)], names=["_row", "ids", "starts"])
    first = int(s.indices(np.array([2 * scoring.END_ID + 1]))[0])
    want = np.concatenate([A.windows(s.indices(scoring.codes_of(i.tobytes(), b, kind)), s, first) for i, b in zip(ids, starts)])
    got = [list(scoring.windows_to_learn(iter([rows]), s, kind, turn, parts)) for turn in range(parts)]
    assert all(len(part) <= 7 for turn in got for part in turn)
    together = np.concatenate([part for turn in got for part in turn])
    assert sorted(map(bytes, together)) == sorted(map(bytes, np.ascontiguousarray(want)))


def test_training_reads_all_of_a_large_corpus(spark, monkeypatch):
    """Windows gone through by all tasks of all rounds, of a corpus beyond the least size."""
    monkeypatch.setattr(scoring, "LEAST_WINDOWS", 20)
    monkeypatch.setattr(scoring, "SHARD_WINDOWS", 60)
    docs = documents(spark, [(i, f"w{i} and w{i % 7} " * 60, "en", "x", 0) for i in range(40)])
    rows = docs.select(F.col("doc_id").alias("_key"), F.lit(True).alias("_train"), F.lit(False).alias("_held_out"), F.col("text").alias("_text"))
    path = default_tokenizer()
    base, _ = scoring.base_counts(rows, scoring.word_counts(rows))
    encoded = scoring.encode(rows, base, path)
    s = scoring.symbol_counts(encoded, path)
    kind = encoder_of(path).type
    many = sum(-(-(len(r["ids"]) // np.dtype(kind).itemsize) // A.SCORED) for r in encoded.select("ids").collect())
    gone = 0
    own = scoring._trainer

    def counted(p, *rest):
        run = own(p, *rest)
        nonlocal gone
        found = encoded.select("_row", "ids", "starts").mapInArrow(run, "shard long, chunk int, n double, total binary")
        gone += found.filter("chunk = 0").agg(F.sum("n")).first()[0]
        return run

    monkeypatch.setattr(scoring, "_trainer", counted)
    scoring.train(encoded, s, path)
    assert many > 60 and gone == many


def test_small_classes_are_worked_on_together(monkeypatch):
    """Fewer products than classes, and the same scores and gradients as class by class."""
    rng, together, p = small_model(4, kinds=400, unseen=2000)
    monkeypatch.setattr(A, "RUN_MEMBERS", 0)
    apart = A.symbols(together.codes, together.counts, 2000)
    assert len(apart.runs) > 10 and len(together.runs) < len(apart.runs) / 2
    assert together.bounds.tolist() == apart.bounds.tolist()
    batch = np.concatenate([A.windows(rng.integers(0, 401, n), together, 0) for n in (700, 20, 33)])
    one, two = (A.loss_and_gradients(p, s, batch) for s in (together, apart))
    assert one[0] == pytest.approx(two[0]) and all(np.allclose(one[1][n], two[1][n], atol=1e-9) for n in p)
    assert np.allclose(A.Scorer(p, together).places(batch), A.Scorer(p, apart).places(batch), atol=1e-5)


@pytest.mark.parametrize("many", [5, 5000])
def test_sums_by_symbol_and_tall_products(many):
    rng = np.random.default_rng(5)
    x, y, at = rng.normal(size=(700, 3)), rng.normal(size=(700, 4)), rng.integers(0, many, 700)
    want = np.zeros((many, 3))
    np.add.at(want, at, x)
    assert np.allclose(A._by_symbol(at, x, many), want) and np.allclose(A._tall(x, y), x.T @ y) and np.allclose(A._tall(x[:9], y[:9]), x[:9].T @ y[:9])


def test_each_word_of_a_piece_is_looked_up_once():
    encoder, asked = encoder_of(default_tokenizer()), Counter()

    class Counting:
        type = encoder.type

        def __len__(self):
            return len(encoder)

        def __getitem__(self, word):
            asked[word] += 1
            return encoder[word]

    texts = [t.encode() for t in ("The cat, the hat and THE cat", "", " \t", "the\x0bcat's Ärger", "a <|endoftext|> The the")]
    words = scoring.words_of(texts)
    kinds, kind = np.unique(words.hash, return_inverse=True)
    got = scoring._all_pieces(Counting(), texts, words, kind, len(kinds))
    assert got == [scoring._pieces(encoder, t) for t in texts]
    assert asked[b"the"] == 1 + 1 and asked[b"cat"] == 1  # the last text keeps its case, and is encoded alone
    doc, own, times = scoring._counted(words.doc, kind, len(kinds))
    want = Counter((at, w) for at, t in enumerate(texts) for w in t.lower().split())
    assert sorted(want.values()) == sorted(times.tolist()) and np.bincount(doc, times, 5).tolist() == [7, 0, 0, 3, 4]


@pytest.mark.parametrize("group", [1, 300, 1 << 18])
def test_windows_of_many_texts_are_cut_at_once(monkeypatch, group):
    """The same codes, and the same windows in the same round, as text by text."""
    monkeypatch.setattr(scoring, "GROUP_SYMBOLS", group)
    rng, s, _ = small_model(6)
    kind = encoder_of(default_tokenizer()).type
    ids = [rng.integers(0, 15, n).astype(kind) for n in (1, 7, 8, 32, 33, 900, 64)]
    starts = [np.packbits(rng.integers(0, 2, len(i)).astype(bool)).tobytes() for i in ids]
    numbers = [3, 8589934592, 5, 6, 7, 8, 9]
    rows = pa.RecordBatch.from_arrays([pa.array(numbers), pa.array([i.tobytes() for i in ids]), pa.array(starts)], names=["_row", "ids", "starts"])
    groups = list(scoring.codes_in_groups(rows.column(1), rows.column(2), kind))
    codes = [scoring.codes_of(i.tobytes(), b, kind) for i, b in zip(ids, starts)]
    assert len(groups) == {1: 7, 300: 3, 1 << 18: 1}[group]
    assert np.concatenate([g[1] for g in groups]).tolist() == np.concatenate(codes).tolist()
    first = int(s.indices(np.array([2 * scoring.END_ID + 1]))[0])
    for turn in range(3):
        want = []
        for number, c in zip(numbers, codes):
            cut = A.windows(s.indices(c), s, first)
            seed = scoring.mix(np.array([number], np.int64).view(np.uint64) + np.uint64(1))
            want.append(cut[scoring.mix(seed + np.arange(len(cut)).astype(np.uint64)) % np.uint64(3) == turn])
        got = np.concatenate([np.zeros((0, A.WINDOW), np.int32), *scoring.windows_to_learn(iter([rows]), s, kind, turn, 3)])
        assert got.tolist() == np.concatenate(want).tolist()


def test_keys_are_narrower_than_values():
    _, _, p = small_model()
    assert p["query"].shape == p["key"].shape and 2 * p["key"].shape[1] <= p["value"].shape[1]


def test_a_step_goes_through_parameters_in_parts(monkeypatch):
    rng, s, p = small_model(7)
    batch = A.windows(rng.integers(0, 31, 400), s, 0)
    moved = []
    for most in (5, 1 << 20):
        monkeypatch.setattr(A, "MOVED_AT_ONCE", most)
        fit = A.Fit({n: v.astype(np.float32) for n, v in p.items()}, s, 0.01, 3)
        for _ in range(3):
            fit.step(batch)
        moved.append(A.pack(fit.p))
    assert np.array_equal(*moved) and np.array_equal(fit.flat, moved[1])
    assert A.loss_and_gradients(fit.p, s, batch)[0] < A.loss_and_gradients(p, s, batch)[0]
