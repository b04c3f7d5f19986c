import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from voxloom.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = ["", " ", "  a  b ", "\x00a", "\n\t", "▁x", "a▁b", "<s>", "<0x41>", "﻿", "日本𓀀", "é", " " * 77, "x" * 5000, "a" * 4097, "über " * 900]


@pytest.fixture(scope="module")
def model():
    return pieces.loaded(open(PATH, "rb").read())


def texts():
    rng = random.Random(5)
    for _ in range(3000):
        yield "".join(rng.choice(" ▁abctheing\n\t0é日本𓀀ßü=-&<>s  \x00　") for _ in range(rng.randint(0, 40)))
    for _ in range(200):
        yield " ".join(rng.choice(["the", "running", " " * rng.randint(1, 40), "aaaa" * rng.randint(1, 20), "Über!!"]) for _ in range(12))


def test_encode_and_decode_equal_the_library(model):
    for text in [*ODD, *texts()]:
        ids = LIBRARY.encode(text)
        assert model.encode(text) == ids
        assert model.decode(ids) == LIBRARY.decode(ids)


def test_decode_of_any_ids(model):
    rng = random.Random(6)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259)]) for _ in range(9)]
        assert model.decode(ids) == LIBRARY.decode(ids)


def test_backtracking_equals_merging(model):
    rng = random.Random(7)
    for _ in range(3000):
        text = "▁" + "".join(rng.choice("abctheings") for _ in range(rng.randint(0, 30)))
        assert model.backtracked(text) == model.merged(text)


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "Hello  wörld\n"), (3, "Hello  wörld\n"), (None, "x" * 9000)]
    docs = spark.createDataFrame([(i, t, "en", 7) for i, t in rows], "doc_id long, text string, lang string, n_tokens int")
    out = pieces.encode_documents(docs, PATH).collect()
    assert len(out) == 5
    for r, (i, t) in zip(sorted(out, key=lambda r: (r.doc_id is None, r.doc_id)), rows, strict=True):
        ids = LIBRARY.encode(t or "")
        assert (r.doc_id, r.n_tokens, r.ids) == (i, len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
    assert pieces.encode_documents(docs.limit(0), PATH).count() == 0
