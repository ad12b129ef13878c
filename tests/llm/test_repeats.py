"""Near copies, fuzzy lines, repeated passages and the pipeline against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, groups, jaccard, odd_documents, plain_shingles, words
from pyspark.sql import functions as F

import corpus_pipeline
from weftspan.llm import batches, jaccard_join, line_dedup, passages, queries, similar
from weftspan.llm.components import components

FOLDER = "/root/testdata/sf0.001"


def near_rows(seed=6, families=12, size=9):
    """Families of copies with a few words replaced, and single texts."""
    rng, rows = random.Random(seed), []
    for _ in range(families):
        base = words(rng, rng.randrange(6, 120), 5_000)
        for _ in range(size):
            text = [*base]
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = f"n{rng.randrange(10**6)}"
            rows.append(" ".join(text))
    rows += [" ".join(words(rng, 40, 5_000)) for _ in range(30)]
    rng.shuffle(rows)
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(rows)]


def check_classes(rows, got, key=lambda r: (r[0], r[1])):
    sets = {key(r): plain_shingles(r[1]) for r in rows}
    kinds = {}
    for k, s in sets.items():
        if s:
            kinds.setdefault(frozenset(s), []).append(k)
    least = {s: min((i is not None, i or 0) for i, _ in members) for s, members in kinds.items()}
    names = list(kinds)
    pairs = [(a, b) for a in range(len(names)) for b in range(a) if jaccard(names[a], names[b]) >= 0.8]
    root = groups(pairs, range(len(names)))
    first = {}
    for n, s in enumerate(names):
        first[root[n]] = min(first.get(root[n], (True, 1 << 60)), least[s])
    number = {s: n for n, s in enumerate(names)}
    for r in got:
        for k in [k for k in sets if k[0] == r["doc_id"]]:
            s = frozenset(sets[k])
            if not s:
                want = (r["doc_id"], r["doc_id"], 0)
            else:
                n = number[s]
                want = (first[root[n]], least[s], sum(n in p for p in pairs))
                want = tuple(x[1] if x[0] else None for x in want[:2]) + want[2:]
            assert (r["class_id"], r["set_id"], r["n_links"]) == want, (k[0], want)


def test_near_duplicates_of_families(spark):
    rows = near_rows()
    got = jaccard_join.near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    check_classes(rows, got)


def test_near_duplicate_cases(spark):
    docs = documents(spark, clash=True)
    got = jaccard_join.near_duplicates(docs).collect()
    assert len(got) == len(odd_documents())
    check_classes(odd_documents(), got)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 4, 5, 6, 7, 9, 11, 12, 13]
    assert jaccard_join.near_duplicates(documents(spark, [])).count() == 0
    assert jaccard_join.keep_one(documents(spark, [])).count() == 0


def test_large_buckets_are_split_and_parted(spark, monkeypatch):
    """The ways for buckets beyond the limit find the groups of a full comparison."""
    monkeypatch.setattr(similar, "LIMIT", 12)
    monkeypatch.setattr(similar, "PART", 12)
    monkeypatch.setattr(similar, "PIVOTS", 6)
    rows = near_rows(8, 3, 30)
    got = {r["doc_id"]: r["class_id"] for r in jaccard_join.near_duplicates(documents(spark, rows)).collect()}
    sets = [plain_shingles(r[1]) for r in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8]
    want = groups(pairs, range(len(rows)))
    assert sum(got[n] == want[n] for n in want) >= 0.97 * len(want)
    assert all(want[got[n]] == want[n] for n in want)


def planted(n, rng):
    """Lists of items of which 85 in 100 are common to all, each second one near the one before (J 0.85 and more)."""
    sets = []
    for at in range(0, n, 2):
        own = [int(x) for x in rng.integers(1_000, 1 << 40, 15)]
        sets += [[*range(85), *own], [*range(85), *own[:8], *(int(x) for x in rng.integers(1 << 41, 1 << 42, 7))]]
    return sets


def test_line_buckets_above_the_limit_lose_no_pair(spark):
    """All in one bucket, unrelated sets below the threshold: a pair is tied wherever its two were dealt to."""
    n = similar.LIMIT + 400
    sets = planted(n, np.random.default_rng(4))
    ids = [x.to_bytes(4, "big") * 4 for x in range(n)]
    items = spark.createDataFrame(list(zip(ids, sets, strict=True)), "id binary, items array<long>")
    links, _ = similar.similar_links(items.selectExpr("id", "array(7L) as keys"), lambda wanted: items, 0.8)
    got = {tuple(sorted((int.from_bytes(r["u"][:4], "big"), int.from_bytes(r["v"][:4], "big")))) for r in links.collect()}
    assert got == {(a, a + 1) for a in range(0, n, 2)}


def test_line_buckets_above_the_limit_keep_dense_groups(spark, monkeypatch):
    """A component that fills blocks alone still meets all sets outside of it."""
    monkeypatch.setattr(similar, "LIMIT", 40)
    monkeypatch.setattr(similar, "PART", 20)
    monkeypatch.setattr(similar, "PIVOTS", 2)
    sets = [[*range(95), 1_000 + n] for n in range(90)]
    sets += [[*range(85 - 3 * k), *range(2_000, 2_000 + 3 * k), *range(3_000 + 100 * k, 3_010 + 100 * k)] for k in range(4)] + planted(60, np.random.default_rng(5))
    ids = [x.to_bytes(4, "big") * 4 for x in range(len(sets))]
    items = spark.createDataFrame(list(zip(ids, sets, strict=True)), "id binary, items array<long>")
    links, _ = similar.similar_links(items.selectExpr("id", "array(7L, 8L) as keys"), lambda wanted: items, 0.8)
    got = groups([tuple(int.from_bytes(r[c][:4], "big") for c in "uv") for r in links.collect()], range(len(sets)))
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if jaccard(set(sets[a]), set(sets[b])) >= 0.8]
    assert got == groups(pairs, range(len(sets)))


@pytest.mark.parametrize(("shared", "blocks"), [(84, 100), (84, 2), (40, 2)])
def test_near_pairs_of_a_hot_source(spark, monkeypatch, shared, blocks):
    """Texts that share most shingles stay below the threshold, and the pairs among them
    (J 0.82) are found: in blocks, in nodes that no split shrinks, and in split nodes."""
    monkeypatch.setattr(similar, "LIMIT", 20)
    monkeypatch.setattr(similar, "PART", 10)
    monkeypatch.setattr(similar, "PIVOTS", 2)
    monkeypatch.setattr(similar, "SPLIT_BLOCKS", blocks)
    rng = random.Random(12)
    base, rows = words(rng, shared, 10**6), []
    for n in range(0, 240, 2):
        text = base + words(rng, 100 - shared, 10**6)
        rows += [(n, " ".join(text), "en", "s", 1), (n + 1, " ".join(text[:-9] + words(rng, 9, 10**6)), "en", "s", 1)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.near_duplicates(documents(spark, rows)).collect()}
    sets = [plain_shingles(r[1]) for r in rows]
    assert all((jaccard(sets[a], sets[b]) >= 0.8) == (a // 2 == b // 2) for a in range(240) for b in range(a))
    hits = sum(got[n] == (n - n % 2, 1) for n in got)
    assert hits >= 238 and all(c in (n, n - n % 2) for n, (c, _) in got.items())


def test_one_split_keeps_near_pairs_together(spark):
    rng = np.random.default_rng(6)
    rows = []
    for n in range(1_000):
        a = rng.integers(-(2**31), 2**31, 64)
        b = np.where(rng.random(64) < 0.8, a, rng.integers(-(2**31), 2**31, 64))
        rows += [(n, bytes([0]), a.tolist()), (n, bytes([1]), b.tolist())]  # each pair a node of its own
    frame = spark.createDataFrame(rows, "key long, id binary, sketch array<int>")
    split = jaccard_join._split(0.8, 0.999)(frame, 1).distinct()
    together = split.groupBy("parent", "key").count().filter("count = 2").select("parent").distinct().count()
    assert together >= 993


def test_link_counts_in_blocks(spark):
    rng = np.random.default_rng(2)
    sets = [sorted(set(rng.integers(0, 40, 30).tolist())) for _ in range(60)]
    frame = spark.createDataFrame([(bytes([n]), s) for n, s in enumerate(sets)], "id binary, items array<long>")
    roots = frame.selectExpr("id", "cast('r' as binary) as root")
    got = {r["id"][0]: r["n_links"] for r in similar.link_counts(roots, frame, 0.5, block=7).collect()}
    assert got == {n: sum(jaccard(set(s), set(t)) >= 0.5 for m, t in enumerate(sets) if m != n) for n, s in enumerate(sets)}


@pytest.mark.parametrize("shape", ["path", "random", "hub", "none"])
def test_components(spark, shape):
    rng = random.Random(9)
    pairs = {
        "path": [(i, i + 1) for i in range(40)], "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
        "hub": [(99, i) for i in range(50)], "none": [],
    }[shape]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    nodes = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == groups([p for p in pairs if p[0] != p[1]], nodes)


def char_set(line, n=8):
    line = line.lower().strip()
    return {line[i : i + n] for i in range(max(1, len(line) - n + 1))}


def plain_lines(rows):
    """doc_id -> (lines, removed places); rows that repeat doc_id and text count once."""
    found = []
    for row in sorted(set((r[0] is not None, r[0] or 0, r[1] or "") for r in rows)):
        found += [((row[0], row[1]), n, char_set(x)) for n, x in enumerate(row[2].split("\n")) if x.strip()]
    pairs = [(a, b) for a in range(len(found)) for b in range(a) if jaccard(found[a][2], found[b][2]) >= 0.8]
    root, out = groups(pairs, range(len(found))), {}
    for n, (doc, place, _) in enumerate(found):
        total, removed = out.setdefault(doc, [0, []])
        out[doc][0] = total + 1
        if root[n] != n:
            removed.append(place)
    return out


def test_line_cases(spark):
    rng = random.Random(10)
    rows = []
    for n in range(40):
        lines = [" ".join(words(rng, rng.randrange(1, 14), 60)) for _ in range(4)] + ["the same line in all of these", "", "  ", f"nearly the same long line in all of these texts, number {n % 3}"]
        rng.shuffle(lines)
        rows.append((n + 100, "\n".join(lines), "en", "s", 3))
    rows += odd_documents()
    docs, want = documents(spark, rows, clash=True), plain_lines(rows)
    got = line_dedup.line_report(docs).collect()
    assert len(got) == len(want)
    for r in got:
        key = (r["doc_id"] != line_dedup.NO_ID, 0 if r["doc_id"] == line_dedup.NO_ID else r["doc_id"])
        assert (r["n_lines"], r["removed"]) == (want[key][0], want[key][1]), key
    cleaned = line_dedup.dedup_lines(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in cleaned.collect():
        gone = want.get((r["doc_id"] is not None, r["doc_id"] or 0), (0, []))[1]
        text = texts[r["doc_id"]]
        assert r["text"] == (text and "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone))
        assert not gone or r["n_chars"] == len(r["text"])
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0 and line_dedup.line_report(documents(spark, [])).count() == 0


def plain_passages(rows, window=20):
    seen, out = set(), {}
    for _, doc, text in sorted(set((r[0] is not None, r[0] or 0, r[1] or "") for r in rows)):
        own = re.findall(r"[^\x20\x09-\x0D]+", text)
        gone = [False] * len(own)
        for i in range(len(own) - window + 1):
            key = tuple(own[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out[doc] = (len(own), sum(gone), " ".join(w for w, g in zip(own, gone, strict=True) if not g))
    return out


def test_passage_cases(spark):
    rng = random.Random(11)
    shared = [words(rng, 45, 10_000) for _ in range(5)]
    rows = []
    for n in range(60):
        a, b = sorted(rng.sample(range(46), 2))
        rows.append((n + 100, " \n".join([*words(rng, rng.randrange(30), 10_000), *rng.choice(shared)[a:b], *words(rng, 5, 10_000)]), "en", "s", 1))
    rows += odd_documents() + [(300, " ".join(["a", "b"] * 40), "en", "s", 1), (301, "x\x1cy z " * 30, "en", "s", 1)]
    want = plain_passages(rows)
    got = passages.remove_repeats(documents(spark, rows, clash=True)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept"]) == want[r["doc_id"] or 0], r["doc_id"]
    assert passages.remove_repeats(documents(spark, [])).count() == 0


def hot_phrase_rows(rng, n=240):
    """A phrase that a third of the documents hold, each among words of its own, with
    passages around it that some share."""
    vocabulary = [f"v{i}" for i in range(3_000)]
    drawn = [rng.sample(vocabulary, 8) for _ in range(3_000)]
    least = min(drawn, key=lambda w: passages.Anchors([" ".join(w + ["x"] * 12).encode()], 20, 8).words.grams(8)[1][0])
    ends = [words(rng, 15, 10_000) for _ in range(6)]
    rows = []
    for i in range(n):
        own = [words(rng, rng.randrange(12, 30), 10_000) for _ in range(2)]
        if i % 3 == 0:
            own = [own[0], rng.choice(ends) if i % 2 else [], least, rng.choice(ends) if i % 4 else own[1][:20], own[1]]
        rows.append((i, " ".join(w for part in own for w in part), "en", "s", 1))
    return rows


def test_hot_anchor_is_cut_to_windows(spark, monkeypatch):
    rows = hot_phrase_rows(random.Random(5))
    monkeypatch.setattr(passages, "SHARD_SEGMENTS", 20)
    docs = documents(spark, rows)
    plan = passages.plan_of(docs)
    assert plan.hot is not None
    found = passages.segments(docs, plan, True).collect()
    kinds = {}
    for r in found:
        kinds.setdefault(r["anchor"], set()).add(bytes(r["words"]))
    assert max(map(len, kinds.values())) <= 20 and any(r["windows"] == 1 for r in found)
    want = plain_passages(rows)
    assert sum(gone for _, gone, _ in want.values()) > 500
    got = passages.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept"]) == want[r["doc_id"]], r["doc_id"]


def test_registered_queries(spark):
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, FOLDER, "documents").collect()]
    check_classes(rows, queries.op8_jaccard_join(spark, FOLDER).collect())
    want = plain_passages(rows)
    for r in queries.op9_passages(spark, FOLDER).collect():
        assert (r["n_words"], r["n_removed"]) == want[r["doc_id"]][:2]
        assert r["kept_sha256"] == hashlib.sha256(want[r["doc_id"]][2].encode()).hexdigest()
    lines = plain_lines(rows)
    for r in queries.op10_line_dedup(spark, FOLDER).collect():
        assert (r["n_lines"], r["removed_lines"]) == tuple(lines.get((True, r["doc_id"]), [0, []]))


def test_pipeline(spark):
    """Each stage on what the one before kept, and all columns as they were."""
    docs = queries.table(spark, FOLDER, "documents").cache()
    rows, columns = [tuple(r) for r in docs.collect()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        got = out.collect()
        if name == "toxicity":
            assert 0.5 * len(rows) < len(got) < len(rows) and {tuple(r) for r in got} <= set(rows)
        elif name == "line_dedup":
            gone = plain_lines(rows)
            for r in got:
                before = next(x for x in rows if x[0] == r["doc_id"])[1].split("\n")
                assert r["text"].split("\n") == ([x for i, x in enumerate(before) if i not in gone[(True, r["doc_id"])][1]] or [""])
        elif name == "jaccard_join":
            classes = jaccard_join.near_duplicates(docs).collect()
            assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in classes if r["doc_id"] == r["class_id"])
        elif name == "decontamination":
            assert {tuple(r) for r in got} <= set(rows) and len(got) > 0.8 * len(rows)
        else:
            assert sum(r["length"] for r in got) == sum({r["doc_id"]: r["doc_tokens"] for r in got}.values())
            assert {r["doc_id"] for r in got} == {r[0] for r in rows}
            break
        assert out.columns == columns
        rows = [tuple(r) for r in got]
        docs = spark.createDataFrame(rows, docs.schema).cache()
    assert corpus_pipeline.run(spark, FOLDER).count() == len(got)


def test_stages_on_odd_rows(spark):
    docs = documents(spark, clash=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    left = {r["doc_id"] for r in docs.collect()}
    assert {4, 5, 6, 9, 12, 13} <= left
    assert corpus_pipeline.packed(spark, docs, FOLDER).count() >= docs.count()
    none = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, FOLDER).count() == 0


def test_passes_over_texts_take_small_batches(spark, monkeypatch):
    """Spans are found with bounded batches; the session keeps its own bound, also on error."""
    seen, own, before = [], passages.materialise, spark.conf.get(batches.BATCH_ROWS)

    def noted(df, name):
        sizes = df.sparkSession.range(3000).coalesce(1).mapInArrow(lambda parts: (pa.record_batch({"n": [b.num_rows]}) for b in parts), "n long")
        seen.append((name, sizes.agg(F.max("n")).first()[0]))
        return own(df, name)

    monkeypatch.setattr(passages, "materialise", noted)
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "a b")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in passages.remove_repeats(docs).collect()}
    assert got == {1: 0, 2: 30, 3: 0}
    assert {"anchors", "spans"} <= {n for n, _ in seen} and all(size <= batches.TEXT_ROWS for _, size in seen)
    with pytest.raises(ValueError), batches.text_batches(spark, 5):
        assert spark.conf.get(batches.BATCH_ROWS) == "5"
        raise ValueError
    assert spark.conf.get(batches.BATCH_ROWS) == before


@pytest.mark.parametrize("most", [1, 60, 1 << 17])
def test_buckets_are_made_sets_of_together(monkeypatch, most):
    """Many small buckets take one call, a large limit or none gives the same ties."""
    monkeypatch.setattr(similar, "BUCKETS_AT_ONCE", most)
    monkeypatch.setattr(similar, "_spread", lambda rows, *keys: rows)
    rng = random.Random(3)
    rows = [(b, bytes([b, n]), " ".join(rng.choice(("one line", "of", "words")) for _ in range(3 + b % 4))) for b in range(30) for n in range(1 + b % 4)]
    calls, got = [], []

    class Rows:
        """Stands for the rows of a task, which are at hand."""

        def __getattr__(self, name):
            return lambda *args: self

        def mapInArrow(self, run, schema):
            cut = [rows[a : a + 7] for a in range(0, len(rows), 7)]
            made = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), (pa.int64(), pa.binary(), pa.string()))], names=["bucket", "id", "items"]) for part in cut]
            got.extend(tuple(r.values()) for b in run(iter(made)) for r in b.to_pylist())

    def expand(items):
        calls.append(len(items))
        return line_dedup._shingle_sets(items)

    similar._compared(Rows(), Rows(), 0.8, expand)
    want = []
    for b in range(30):
        ids, texts = zip(*[(i, t) for own, i, t in rows if own == b])
        sets = [np.unique(line_dedup.Lines([t.encode()]).shingles) for t in texts]
        if len(ids) > 1:
            want += [(ids[x], ids[y]) for x, y in similar.stars(similar.similar(sets, 0.8), list(ids))]
    assert sorted(got) == sorted(want) and want
    assert len(calls) == 1 if most > 10_000 else len(calls) > 3
