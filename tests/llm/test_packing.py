import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from tessera.llm import packing as P
from tessera.llm import queries as Q

VOCABULARY = path("word_bpe_49k.json")


def plain_best_fit(lengths, window):
    """Rooms of all windows after packing, each piece by a look at every open window."""
    rooms = []
    for n in lengths:
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            i = min(fits, key=lambda i: rooms[i])
        else:
            rooms.append(window)
            i = len(rooms) - 1
        rooms[i] -= n
    return sorted(rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 37), max_size=120))
def test_best_fit_is_the_plain_one(lengths):
    lengths = sorted(lengths, reverse=True)
    into, offsets = P.best_fit(lengths, 37)
    used = {}
    for w, o, n in zip(into, offsets, lengths, strict=True):
        assert used.get(w, 0) == o
        used[w] = o + n
    assert sorted(37 - u for u in used.values()) == plain_best_fit(lengths, 37)


def check_rows(rows, ids, window):
    """Each id in one piece, checksums right, sequences without gaps and within the window. rows of documents with ids of their own."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for doc, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[doc])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[doc][at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[doc])
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return len(by_sequence)


def encoded(texts):
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in texts.items()}


def test_query_holds_every_token_once(spark):
    d = "/root/testdata/sf0.01"
    ids = encoded({r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()})
    n = check_rows(Q.QUERIES["op11_pack"](spark, d).collect(), ids, 4096)
    total = sum(map(len, ids.values()))
    assert n <= -(-total // 4096) + 1


def test_many_groups_and_cut_documents(spark):
    texts = {i: " ".join(f"word{j % (i + 3)}" for j in range(i * 7 % 95)) for i in range(400)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = P.pack(df, VOCABULARY, window=64, group=2048).collect()
    assert len({r.sequence_id >> 32 for r in rows}) > 3
    ids = encoded(texts)
    n = check_rows(rows, ids, 64)
    assert n * 64 <= 1.1 * sum(map(len, ids.values()))
    assert {(r.start, r.length) for r in rows if r.doc_id == 13} == {(a, min(64, len(ids[13]) - a)) for a in range(0, len(ids[13]), 64)}


@pytest.mark.parametrize("text", ["Café CAFÉ İstanbul H̱ Kelvin ΣΣ don't DON'T it's'", "a b c\x0bd\x85e", "x" * 5000 + " " + "!?" * 300,
                                  "<|endoftext|> <|startoftext|>", "́ lone", "中文 ไทย", "한글 한", "  \n\t "])
def test_words_by_themselves_give_the_tokens_of_the_text(text):
    got = np.frombuffer(next(P.Words.of(VOCABULARY).encode([text.encode()])), "<u4").tolist()
    assert [*got, 2] == encoded({0: text})[0]


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "one two", 7), (3, "one two", 7), (None, "three", 7), (None, None, 7), (9, "long " * 9000, 7)], "doc_id long, text string, sequence_id int")
    rows = P.pack(df, VOCABULARY).collect()
    assert sorted((r.doc_id or 0, r.start, r.length, r.doc_tokens) for r in rows) == [(0, 0, 1, 1), (0, 0, 2, 2), (1, 0, 1, 1), (2, 0, 1, 1), (3, 0, 3, 3), (3, 0, 3, 3),
                                                                                     (9, 0, 4096, 9001), (9, 4096, 4096, 9001), (9, 8192, 809, 9001)]
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert P.pack(df.limit(0), VOCABULARY).collect() == []


class Counted:
    """A tokenizer that keeps what it was given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.given += [w for t in texts for w in t.split() if w != P.GAP]
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_each_stem_goes_to_the_tokenizer_once(monkeypatch):
    """With marks after it or without, and again when more words than are remembered came since, as long as it is used."""
    words = P.Words(VOCABULARY)
    words.tokenizer = Counted(words.tokenizer)
    monkeypatch.setattr(P, "REMEMBERED", 40)
    texts = [f"tessera tessera, (tessera). tessera!! new{i}. other{i}" for i in range(100)]
    got = [np.frombuffer(next(words.encode([t.encode()])), "<u4").tolist() for t in texts]
    assert [[*g, 2] for g in got] == list(encoded(dict(enumerate(texts))).values())
    assert words.tokenizer.given.count("tessera") == 1 and words.tokenizer.given.count("(tessera") == 1 and not {"tessera,", "tessera!!", "new7."} & set(words.tokenizer.given)
    assert len(words.known) + len(words.older) < 120


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZé'sdtrv1½²…!?,.-̸́<|> \n \x1c\x85σΣİ中"), max_size=40), max_size=6))
def test_marks_and_gaps_stand_apart(texts):
    words = P.Words.of(VOCABULARY)
    got = [[*np.frombuffer(ids, "<u4").tolist(), 2] for ids in words.encode([t.encode() for t in texts])]
    assert got == list(encoded(dict(enumerate(texts))).values())


def test_overlong_words_with_marks():
    texts = {0: "y" * 63 + ". " + "y" * 63 + "!! " + "z" * 70 + ", " + "q" + "." * 80 + " ½" * 3 + " 1½, ½" + "k" * 90}
    got = list(P.Words(VOCABULARY).encode([texts[0].encode()] * 2))
    assert [[*np.frombuffer(g, "<u4").tolist(), 2] for g in got] == [encoded(texts)[0]] * 2
