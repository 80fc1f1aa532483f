"""The manifest against trees folded by hand, and on awkward rows."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import pytest

from bitloom.llm import merkle_manifest as M

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, place int"


def H(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def brute(rows: list[tuple]) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof, folded, verified) of each row, from whole levels held in lists."""
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf_of = lambda d, t, lang, s, n: H(*map(show, (d, s, lang, n, t)))

    def levels(hashes: list[str]) -> list[list[str]]:
        out = [hashes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    def climb(tree: list[list[str]], at: int, value: str) -> tuple[str, str]:
        proof = ""
        for level in tree[:-1]:
            run = level[at // 2 * 2 : at // 2 * 2 + 2]
            proof += "".join(h for i, h in enumerate(run) if i != at % 2)
            run[at % 2] = value
            value, at = H(*run), at // 2
        return proof, value

    by: dict = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0], leaf_of(*r), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = levels([x[1] for x in by[lang]])
    top = levels([trees[x][-1][0] for x in langs])
    out = []
    for i, lang in enumerate(langs):
        for at, (doc_id, leaf, (d, t, _, s, n)) in enumerate(by[lang]):
            hit = doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            proof, folded = climb(trees[lang], at, leaf_of(d, t, lang, s, n + 1) if hit else leaf)
            more, folded = climb(top, i, folded)
            out.append((doc_id, leaf, trees[lang][-1][0], top[-1][0], H(proof + more), folded, folded == top[-1][0]))
    return out


def corpus(sizes: dict, seed: int = 1) -> list[tuple]:
    rnd = random.Random(seed)
    rows = [(rnd.randrange(10**6), rnd.choice(["", "é x", "word " * rnd.randrange(30), None]), lang, rnd.choice(["s", None, ""]), rnd.choice([3, None, 99, -1])) for lang, n in sizes.items() for _ in range(n)]
    return rows + rows[: len(rows) // 9]


def run(spark, tmp_path, rows: list[tuple]) -> list[tuple]:
    spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    cols = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return [tuple(r[c] for c in cols) for r in M.op13_merkle_manifest(spark, str(tmp_path)).collect()]


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 1, "a": 2}, {"a": 16, "b": 17, "é": 33, "": 5, "z": 300, "y": 64, None: 40}, {f"l{i}": 1 + i % 3 for i in range(70)}])
def test_against_brute_force(spark, tmp_path, sizes) -> None:
    rows = [*corpus(sizes), (None, "t", next(iter(sizes)), None, 5), (None, None, next(iter(sizes)), None, None)]
    got, want = run(spark, tmp_path, rows), brute(rows)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {g[6] for g in got} == {True, False} or len(got) < 20


@pytest.mark.parametrize("lane", [64, 4096])
def test_lanes(spark, tmp_path, monkeypatch, lane) -> None:
    """Rows high up are stored for many lanes, a few lanes at a time; results stay."""
    monkeypatch.setattr(M, "LANE", lane)
    monkeypatch.setattr(M, "COPIES", 3)
    rows = corpus({"a": 9000, "b": 65, None: 5}, 3)
    assert sorted(run(spark, tmp_path, rows), key=repr) == sorted(brute(rows), key=repr)


def test_empty_table_and_huge_number(spark, tmp_path) -> None:
    assert run(spark, tmp_path / "none", []) == []
    rows = [(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 0), "t", "a", "s", 2**63 - 1)]
    assert run(spark, tmp_path / "huge", rows) == brute(rows)
