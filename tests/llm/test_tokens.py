"""Token ids, records and packing against the tokenizers library itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from cases import documents, odd_documents
from tokenizers import Tokenizer

from weftspan.llm import packing, queries, records
from weftspan.llm.tokens import END_ID, WordEncoder, default_tokenizer, encoder_of, widened

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_tokenizer())


def whole(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, END_ID]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_give_the_ids_of_the_whole_text(library):
    encoder = encoder_of(default_tokenizer())
    rng = random.Random(1)
    letters = "aBé ß.,'!<|>\n\t \x1c1½Σςİ漢-́"
    texts = [t[1] or "" for t in odd_documents()] + ["".join(rng.choice(letters) for _ in range(40)) for _ in range(300)]
    texts += ["it's we'll.don't", "a<|startoftext|>b<|", "x.́ y", "ﬁne ǅ ªº", "ABC!! abc,.; É,"]
    for text in texts:
        ids = np.frombuffer(widened(encoder.encode(text.encode()), encoder.type), "<u4").tolist()
        assert ids == whole(library, text), text


def test_records_round_trip(spark, tmp_path, library):
    docs = documents(spark, clash=True)
    records.write_records(docs.select("doc_id", "text"), str(tmp_path / "r"))
    got = records.read_records(spark, str(tmp_path / "r")).orderBy("start").collect()
    rows = sorted(odd_documents(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    assert len(got) == len(rows)
    for g, row in zip(got, rows, strict=True):
        want = whole(library, row[1])
        assert (g["doc_id"], g["start"]) == (row[0], start)
        assert np.frombuffer(g["ids"], "<u4").tolist() == want
        start += len(want)
    index = records.read_index(spark, str(tmp_path / "r"))
    some = records.read_records(spark, str(tmp_path / "r"), index.filter("doc_id in (5, 9)")).collect()
    assert sorted(r["doc_id"] for r in some) == [5, 9]


def test_a_changed_byte_is_found():
    data = records.frame(7, b"\x01\x00\x02\x00") + b"\n"
    assert records.open_frame(data, 0) == (7, b"\x01\x00\x02\x00", len(data))
    for at in range(len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            records.open_frame(bytes(broken), 0)


def test_empty_table(spark, tmp_path):
    none = documents(spark, [])
    records.write_records(none, str(tmp_path / "r"))
    assert records.read_records(spark, str(tmp_path / "r")).count() == 0
    assert packing.pack(none).count() == 0


def check_packing(rows, want, capacity):
    """``want``: (doc_id, ids) of every document."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    held = defaultdict(int)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity
        held["tokens"], held["room"] = held["tokens"] + at, held["room"] + capacity
    for doc_id, ids in want:
        pieces = sorted(by_doc[doc_id], key=lambda r: r["start"])
        assert sum(r["length"] for r in pieces) % len(ids) == 0
        for r in pieces:
            assert r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]]) and r["doc_tokens"] == len(ids)
    return held


def test_packing_cases(spark, library):
    rows = packing.pack(documents(spark, clash=True), capacity=256, group_documents=5).selectExpr("*", "crc32(ids) as ids_crc32").collect()
    check_packing(rows, [(r[0], whole(library, r[1])) for r in odd_documents()], 256)
    assert sum(r["length"] for r in rows) == sum(len(whole(library, r[1])) for r in odd_documents())


def test_one_doc_id_for_all_rows(spark, library, tmp_path, monkeypatch):
    """Groups and files stay even where every row has the same doc_id, or is the same."""
    rows = [(7, f"word{i % 50} again", "en", "a", 1) for i in range(400)]
    packed = packing.pack(documents(spark, rows), capacity=64, group_documents=40).collect()
    assert sum(r["length"] for r in packed) == sum(len(whole(library, r[1])) for r in rows)
    groups = defaultdict(int)
    for r in packed:
        groups[r["sequence_id"] % 10] += 1
    assert len(groups) == 10 and max(groups.values()) < 90
    monkeypatch.setattr(records, "FILE_BYTES", 500)
    records.write_records(documents(spark, rows), str(tmp_path / "r"))
    files = defaultdict(int)
    for r in records.read_index(spark, str(tmp_path / "r")).collect():
        files[r["file"]] += 1
    assert len(files) > 6 and max(files.values()) < 200 and sum(files.values()) == 400
    starts = sorted((r["start"], len(r["ids"]) // 4) for r in records.read_records(spark, str(tmp_path / "r")).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_first_fit_is_the_plain_one():
    rng = random.Random(5)
    for _ in range(60):
        sizes = sorted((rng.randrange(1, 101) for _ in range(rng.randrange(1, 90))), reverse=True)
        room, want = [], []
        for size in sizes:
            at = next((i for i, r in enumerate(room) if r >= size), len(room))
            if at == len(room):
                room.append(100)
            want.append((at, 100 - room[at]))
            room[at] -= size
        assert list(zip(*packing.first_fit_decreasing(sizes, 100), strict=True)) == want


def test_registered_queries(spark, library):
    docs = {r["doc_id"]: whole(library, r["text"]) for r in queries.table(spark, FOLDER, "documents").collect()}
    rows = queries.op2_packing(spark, FOLDER).collect()
    held = check_packing(rows, docs.items(), packing.CAPACITY)
    assert held["tokens"] == sum(map(len, docs.values())) and held["tokens"] > 0.97 * held["room"]
    start = 0
    got = {r["doc_id"]: r for r in queries.op3_token_records(spark, FOLDER).collect()}
    for doc_id in sorted(docs):
        r = got[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(docs[doc_id]), crc(docs[doc_id]))
        start += len(docs[doc_id])


def test_plain_ascii_words_are_not_translated():
    """They stand for themselves; what is translated are letters beyond them."""
    encoder, asked = WordEncoder(default_tokenizer()), []

    class Shown(dict):
        def __getitem__(self, key):
            asked.append(key)
            return dict.__getitem__(self, key)

    encoder.shown = Shown(encoder.shown)
    words = ["house", "houses.", "été", "i", "x1"]
    got = [np.frombuffer(encoder[w.encode()], encoder.type).tolist() for w in words]
    assert got == [encoder.library.encode(w, add_special_tokens=False).ids for w in words]
    assert set(asked) == set("été".encode())
