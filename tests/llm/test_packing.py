import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trajlake.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def odd_texts(seed, n):
    r = random.Random(seed)
    bits = [*"abcDEFIH'sstdll \n\t.,<|>1٣éÉ̱́̇  Σςßöz\x1c\x85​字", "<|endoftext|>", "<|startoftext|>", "'ll", " I'm ", "don't"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(60))) for _ in range(n)]


def test_ids_are_the_tokenizers(tokenizer):
    texts = [None, "", " ", *odd_texts(1, 4000), "word " * 30000, "x" * 5000]
    words, at = packing.Words(PATH, 1), 0
    for part in (texts[:50], texts[50:2000], texts[2000:]):
        ids, size = words.texts(pa.array(part, pa.string()))
        at = 0
        for text, n in zip(part, size, strict=True):
            assert ids[at : at + n].tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], text
            at += n
        assert at == len(ids)


def test_known_words_are_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "KNOWN", 40)
    words = packing.Words(PATH, 1)
    for text in ("a b c", " ".join(f"w{i}x" for i in range(100)), "a b c"):
        assert words.texts(pa.array([text]))[0].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
    assert len(words.keys) == 3


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    texts = [None, "", " \n", *odd_texts(2, 60), "go on " * 2000] + [" ".join(f"w{r.randrange(900)}" for _ in range(r.randrange(1, 700))) for _ in range(30)]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (5, texts[5]), (5, texts[5])]


@pytest.mark.parametrize("size", [2048, 10])
def test_pack(spark, tokenizer, rows, size):
    docs = spark.createDataFrame([(*x, 9, "s") for x in rows], "doc_id long, text string, start int, ids string").repartition(5)
    pieces = packing.pack(docs, size=size)
    found = pieces.withColumn("crc", F.crc32("ids")).collect()
    want = sorted(([k, *tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for k, t in rows), key=str)
    total = sum(len(w) - 1 for w in want)

    streams, whole = {}, {}
    for p in sorted(found, key=lambda p: (p.sequence_id, p.offset)):
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length and p.crc == zlib.crc32(bytes(p.ids))
        seq = streams.setdefault(p.sequence_id, [])
        assert len(seq) == p.offset  # gapless
        seq += ids
        whole[p.sequence_id] = p.sequence_tokens
        assert p.length > 0
    assert {k: len(s) for k, s in streams.items()} == whole and set(streams) == set(range(len(streams)))
    full = [n for n in whole.values() if n == size]
    rest = sorted(n for n in whole.values() if n != size)
    assert len(full) == total // size and sum(rest) == total % size and all(n & (n - 1) == 0 for n in rest) and len(set(rest)) == len(rest)

    ends = [i for k in sorted(streams) for i in streams[k]]  # the stream falls into documents at their ends
    back, held = [], []
    for p in sorted(found, key=lambda p: (p.sequence_id, p.offset)):
        if p.start == 0:
            held = [p.doc_id]
        assert p.start == len(held) - 1
        held += np.frombuffer(p.ids, "<u4").tolist()
        if p.start + p.length == p.doc_tokens:
            back.append(held)
    assert sorted(back, key=str) == want and len(ends) == total

    made = {r.sequence_id: r for r in packing.sequences(pieces).collect()}
    assert {k: list(r.ids) for k, r in made.items()} == streams
    for k, r in made.items():
        assert [x.offset for x in r.pieces] == sorted(p.offset for p in found if p.sequence_id == k)


def test_no_documents_and_empty_ones(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none).count() == 0 and packing.sequences(packing.pack(none)).count() == 0
    found = packing.pack(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start, r.length, r.doc_tokens, r.sequence_tokens) for r in found) == [(1, 0, 1, 1, 2), (2, 0, 1, 1, 2)]
