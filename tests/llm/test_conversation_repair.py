"""Conversation repair against edit-by-edit dynamic programming, and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache
from itertools import pairwise

from bitloom.llm import conversation_repair as C

ROWS = "conv_id long, turn long, role string, text string, audit string, place int"


def brute(conversations: list[tuple]) -> dict:
    """The contract, row by row: edits are tried one at a time, from the last row back."""
    by: dict = {c[0]: [] for c in conversations}
    for conv, turn, role, text in conversations:
        show = lambda v: " " if v is None else str(v)
        kind, role, text = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20, show(role), show(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            by[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in rows:
            letters = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else "")
            seen.add((role, text))

        @cache
        def best(i: int, state: str, inserted: int, rows=tuple(rows), faults=tuple(faults)) -> tuple:
            wanted = "assistant" if state == "u" else "user"
            options = []
            if i == len(rows) and state in ("", "a"):
                options.append((0, "", ()))
            if inserted < 3:
                c, s, r = best(i, wanted[0], inserted + 1)
                options.append((3 + c, "I" + s, ((wanted, ""), *r)))
            if i < len(rows):
                _, role, text = rows[i]
                c, s, r = best(i + 1, state, 0)
                options.append((4 + c, "D" + s, r))
                if faults[i] not in ("blank", "duplicate"):
                    late = 3 if faults[i] == "truncated" else 0
                    for edit, cost, name in [("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")]:
                        if name[:1] == wanted[0] or (name[:1] == "s" and state == ""):
                            c, s, r = best(i + 1, name[0], 0)
                            options.append((cost + late + c, edit + s, ((name, text), *r)))
            return min(options, default=(10**9, "", ()))

        cost, audit, fixed = best(0, "", 0) if rows else (0, "", ())
        turns = [t for t, _, _ in rows if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairwise(rows))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in fixed))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def made(seed: int, n: int, longest: int = 12) -> list[tuple]:
    rnd = random.Random(seed)
    out = [(None, None, None, None), (None, 3, "user", "x."), (7, None, "tool", ""), (8, 1, "", "a?"), (9, 5, "system", "only.")]
    for conv in range(10, 10 + n):
        turns = [rnd.choice([None, t, t, t, t, t + 1]) for t in range(rnd.randint(1, longest))]
        texts = ["Yes.", "No", "Well! \n", " \t", "ok?", None, "é.", ".", "", *(f"{rnd.randrange(9)}." for _ in range(9))]
        out += [(conv, t, rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", None]), rnd.choice(texts)) for t in turns]
    return out


def rows_of(found) -> dict:
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found.collect()}


def run(spark, tmp_path, conversations: list[tuple]) -> dict:
    spark.createDataFrame([(*c, "x", 1) for c in conversations], ROWS).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    return rows_of(C.op12_conversation_repair(spark, str(tmp_path)))


def test_against_brute_force(spark, tmp_path) -> None:
    rows = made(1, 250)
    assert run(spark, tmp_path, rows) == brute(rows)


def test_blocks_and_rules_do_not_change_results(spark, tmp_path, monkeypatch) -> None:
    """Blocks of five rows: conversations of many blocks, and one that holds a third of all rows."""
    monkeypatch.setattr(C, "BLOCK", 5)
    rows = made(2, 60)
    rnd = random.Random(4)
    rows += [(5000, t, rnd.choice(["user", "assistant", "assistant"]), f"t{t % 90}" + rnd.choice([".", ""])) for t in range(200)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_no_rows(spark, tmp_path) -> None:
    assert run(spark, tmp_path, []) == {}


def test_dropped_conversation_stays(spark, tmp_path) -> None:
    gone = next((c, t) for c in range(100, 400) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    got = run(spark, tmp_path, [(*gone, "user", "a.")])
    assert got == {gone[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_products_are_associative_and_ropes_spell_the_audit() -> None:
    rnd = random.Random(6)
    for _ in range(200):
        symbols = "".join(rnd.choices("suaoSUAOD", k=rnd.randint(2, 14)))
        plain = C.Grammar([])
        rules, short = [], symbols
        for i in range(4):
            if len(short) < 2:
                break
            at = rnd.randrange(len(short) - 1)
            pair = short[at : at + 2]
            rules.append((chr(0xE000 + i), pair))
            short = short.replace(pair, rules[-1][0])
        assert sorted(C.Grammar(rules).paths(short)) == sorted(plain.paths(symbols))


def test_rules_come_from_repeated_pairs(spark) -> None:
    grammar = C.re_pair(spark.createDataFrame([("suauaua",), ("uauaua",), ("suaua",), ("o",)], "plain string"), "plain", 8)
    assert grammar.rules[0][1] in ("ua", "au") and len(grammar.rules) > 1
    assert all(len(pair) == 2 for _, pair in grammar.rules)
