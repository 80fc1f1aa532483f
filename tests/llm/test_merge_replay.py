"""Merge replay against the tokenizer library, on its own vocabulary and on random ones, and on awkward rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from bitloom.llm import merge_replay
from bitloom.llm.merge_replay import Encoder, Vocabulary, rank_file, replay, replayed_alone

TEXTS = [
    None, "", " ", "\n", "it's  we'll 're''s\t\n x", "<|endoftext|>", "É́ ß ŉ 東京 ١٢ ½ ℕ", "😀\U00020000\U0001f9ff 　 x", "\x00\x85\x1f",
    "a" * 5000, "ab" * 3000, " " * 4000 + "x", "!?" * 2000, "ꟊ Ა 𞤀 ʼ’s",
]


@pytest.fixture(scope="module")
def library():
    ranks = Vocabulary.read(rank_file()).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equal_to_the_library(spark, library) -> None:
    rnd = random.Random(2)
    texts = TEXTS + ["".join(rnd.choice(["the", "ing", "'s", "'", " ", "  ", "\n", "é", "7", "zq", "͸", "é", "aaaa"]) for _ in range(rnd.randrange(80))) for _ in range(300)]
    rows = [(i % 290 if i % 7 else None, t, 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens int, decoded int")
    got = merge_replay.decode(merge_replay.encode(docs.repartition(3), rank_file()), rank_file()).collect()
    want = [(i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, *_ in rows]
    assert sorted([(r.doc_id or -1, bytes(r.tokens), bytes(r.decoded)) for r in got]) == sorted((i or -1, a, b) for i, a, b in want)


def test_long_texts_are_cut_between_pieces(library, monkeypatch) -> None:
    monkeypatch.setattr(merge_replay, "CHUNK", 50)
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(["word", "'s", " ", "\n\n", "x" * 70, "  ", "9", "."]) for _ in range(n)) for n in (0, 1, 400, 3, 250)]
    assert [g.tolist() for g in Encoder(Vocabulary.read(rank_file())).encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_random_vocabularies() -> None:
    """Ranks in no sensible order: joins may make pairs of a lesser rank, and whole pieces may be tokens no merge reaches."""
    for seed in range(60):
        rnd = random.Random(seed)
        longer = list(dict.fromkeys(bytes(rnd.choices(b"abc", k=rnd.randint(2, 5))) for _ in range(60)))
        rnd.shuffle(longer)
        ranks = {t: i for i, t in enumerate([*(bytes([b]) for b in range(256)), *longer])}
        library = tiktoken.Encoding("random", pat_str=r"[a-z]+", mergeable_ranks=ranks, special_tokens={})
        pieces = list({"".join(rnd.choices("abc", k=rnd.randint(1, 30))) for _ in range(200)})
        data = np.frombuffer("".join(pieces).encode(), np.uint8)
        size = np.array([len(p) for p in pieces])
        ids, counts = replay(Vocabulary(ranks), data, np.cumsum(size) - size)
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [library.encode_ordinary(p) for p in pieces]


def test_one_piece_alone(library) -> None:
    vocabulary = Vocabulary.read(rank_file())
    for text in ("a", "strawberries", "a" * 333, "xyz" * 2000):
        assert replayed_alone(vocabulary, np.frombuffer(text.encode(), np.uint8)).tolist() == library.encode_ordinary(text)


def test_decode_of_unsound_rows(spark) -> None:
    rows = [(1, None), (2, b""), (3, np.array([64, 10**9], "<u4").tobytes()), (4, np.array([64], "<u4").tobytes())]
    got = {r.doc_id: r.decoded for r in merge_replay.decode(spark.createDataFrame(rows, "doc_id long, tokens binary"), rank_file()).collect()}
    assert (got[1], got[3]) == (None, None) and bytes(got[2]) == b"" and len(got[4]) == 1


def test_query_and_empty_table(spark, library, tmp_path) -> None:
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in merge_replay.op11_merge_replay(spark, str(tmp_path)).collect():
        ids = np.array(library.encode_ordinary(TEXTS[r.doc_id] or ""), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
    assert merge_replay.encode(spark.createDataFrame([], "doc_id long, text string"), rank_file()).count() == 0
