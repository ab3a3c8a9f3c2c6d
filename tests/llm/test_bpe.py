import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from rasterjobs.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_equal_the_library(library):
    pairs, draw = bpe.load(PATH, P.PATTERN), random.Random(5)
    alphabets = ["ab", "the ", "ñéüß", "0123", " \n\t", "aA<|end|>'s", "\U0001f600é中", "\x00\x7f~!"]
    texts = ["", " ", "a" * 5000, "hello  world\n\n x", "<|endoftext|>", "\n" * 300]
    for _ in range(1500):
        letters = "".join(draw.sample(alphabets, draw.randint(1, 4)))
        texts.append("".join(draw.choice(letters) for _ in range(draw.randint(1, 60))))
    packed = [pairs.encode(text) for text in texts]
    for text, ids in zip(texts, packed, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text
    assert bpe.decoder(PATH).decode([*packed, None]).to_pylist() == [*(t.encode() for t in texts), b""]
    with pytest.raises(ValueError):
        bpe.decoder(PATH).decode([np.array([1 << 20], "<u4").tobytes()])


def test_adjacent_tokens_fit_if_merging_gives_them_back():
    pairs, draw = bpe.load(PATH, P.PATTERN), random.Random(7)
    known = sorted(pairs.shorter)
    for k in range(20_000):
        pool = known[:700] if k % 2 else known
        a, b = draw.choice(pool), draw.choice(pool)
        merged = pairs.merged(pairs.token[a] + pairs.token[b])
        assert pairs.compatible(a, b) == (merged == [pairs.token[a], pairs.token[b]]), (a, b)


def test_generations_of_the_cache_and_a_long_text(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 50)
    pairs, draw = bpe.BytePairs(PATH, P.PATTERN), random.Random(9)
    text = " ".join("".join(draw.choice("etaoinshr") for _ in range(draw.randint(1, 9))) for _ in range(60_000))
    assert np.frombuffer(pairs.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    assert len(pairs) <= 50 and len(pairs.older) <= 50


def test_query_columns_and_null(spark, library):
    docs = spark.createDataFrame(
        [(1, "Hello wörld", "x"), (2, None, "y"), (3, "", None), (1, "Hello wörld", "x"), (None, "z" * 70, "q")],
        "doc_id long, text string, ids string",
    )
    out = bpe.encode(docs, PATH, P.PATTERN)
    rows = {(r.doc_id, r.n_tokens): r for r in bpe.unpacked(bpe.decode(out, PATH)).collect()}
    assert bytes(rows[2, 0].decoded) == b"" and rows[3, 0].ids == []
    n = len(library.encode_ordinary("Hello wörld"))
    assert rows[1, n].ids == library.encode_ordinary("Hello wörld")
    assert bytes(rows[None, len(library.encode_ordinary("z" * 70))].decoded) == b"z" * 70
    assert out.count() == 5
    both = bpe.encode(docs, PATH, P.PATTERN, back=True)
    assert sorted(bytes(r.decoded) for r in both.collect()) == sorted((r.text or "").encode() for r in docs.collect())
    assert bpe.encode(docs.limit(0), PATH, P.PATTERN).count() == 0
