import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.cases import awkward_texts, table
from vecloom.llm.packing import SEQUENCE, WordCache, first_fit_decreasing, pack_documents, pack_lengths, word_tokenizer

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def path():
    return public.path("word_bpe_49k.json")


def test_first_fit_decreasing_is_first_fit():
    draw = random.Random(2)
    for _ in range(50):
        sizes = [draw.randrange(1, 100) for _ in range(draw.randrange(0, 60))]
        bins, room = [], []
        for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            at = next((k for k, r in enumerate(room) if r >= sizes[item]), len(room))
            if at == len(room):
                room.append(100)
                bins.append([])
            room[at] -= sizes[item]
            bins[at].append(item)
        assert first_fit_decreasing(sizes, 100) == bins


@pytest.mark.parametrize("lengths", [[], [1], [4096], [4097, 1, 4095], [9000, 3, 3, 3], [2500] * 9, [1] * 5000])
def test_sequences_cover_every_document_once_without_padding(lengths):
    seen = defaultdict(list)
    for pieces in pack_lengths(lengths):
        total = sum(p[2] for p in pieces)
        assert total == SEQUENCE or total & (total - 1) == 0
        for doc, start, length in pieces:
            seen[doc].append((start, length))
    for doc, length in enumerate(lengths):
        at = 0
        for start, size in sorted(seen[doc]):
            assert start == at and size > 0
            at += size
        assert at == length


def test_words_give_the_ids_of_the_whole_text(path):
    whole = tokenizers.Tokenizer.from_file(path)
    texts = [t or "" for _, t in awkward_texts()] + [
        "it's 'LL don't. x'… a\x1cb\x85c <|endoftext|>. <|ENDOFTEXT|>! É. é. İ. ΑΣ. 5. 5a! «q». ﬁ, Å; ½. x̸= ==≠"
    ]
    encode = word_tokenizer(path)()
    assert encode.last_ids.any()
    cache = WordCache(encode, "<u4", encode.last_ids)
    for text, ids in zip(texts, cache.ids([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_plain_words_need_no_search_for_their_stem(path, monkeypatch):
    encode = word_tokenizer(path)()
    cache = WordCache(encode, "<u4", encode.last_ids)
    searched = []
    plain = WordCache.stem
    monkeypatch.setattr(WordCache, "stem", staticmethod(lambda word: searched.append(word) or plain(word)))
    texts = ["Plain words, many; of THEM.\n", "", " ,  ", "odd'un x1 <|endoftext|> été, (braced) end!", "Plain", "them,"]
    got = [np.frombuffer(ids, "<u4").tolist() for ids in cache.ids([t.encode() for t in texts])]
    assert got == encode(texts)
    assert not {b"Plain", b"words,", b"many;", b"of", b"THEM.", b"end!", b"them,"} & set(searched)


def test_packing_round_trip(spark, path):
    rows = awkward_texts()
    whole = tokenizers.Tokenizer.from_file(path)
    pieces = pack_documents(table(spark, rows), word_tokenizer(path), group_docs=20, id_bytes=2).collect()
    texts = defaultdict(list)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
        assert len(p.ids) == p.length
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == SEQUENCE or at & (at - 1) == 0
    for p in sorted(pieces, key=lambda p: (p.start,)):
        texts[p.doc_id].append(p)
    want = defaultdict(int)
    for i, text in rows:
        want[i] += len(whole.encode(text or "", add_special_tokens=False).ids) + 1
    assert {i: sum(p.length for p in own) for i, own in texts.items()} == dict(want)
    only = {i: t for i, t in rows if i is not None and [r[0] for r in rows].count(i) == 1}
    for i, text in only.items():
        ids = [x for p in texts[i] for x in p.ids]
        assert ids == whole.encode(text or "", add_special_tokens=False).ids + [2]
        assert {p.doc_tokens for p in texts[i]} == {len(ids)}


def test_packing_nothing(spark, path):
    assert pack_documents(table(spark, awkward_texts()).limit(0), word_tokenizer(path)).collect() == []
