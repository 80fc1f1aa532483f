"""Dictionary coding, stamps, orientations, substitutions, guarded probes, repointing and update-mode streams."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from bitloom.functions import trie
from bitloom.operators import decode, graph, match, refs, stamps, substitute


def coded(spark, texts: list, spellings: list[str], blank: int | None = None) -> list:
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    rows = df.select("i", trie.greedy_codes(F.col("t"), spellings, blank).alias("c")).withColumn("back", trie.codes_text(F.col("c"), spellings)).orderBy("i").collect()
    return [(r.c, r.back) for r in rows]


def test_codes_of_spellings_and_characters_cannot_meet(spark) -> None:
    spellings = [f"w{i}q" for i in range(1200)]
    ((codes, back),) = coded(spark, ["w1097qa"], spellings)
    assert codes == [1097, -1 - ord("a")] and back == "w1097qa"


def test_fifty_thousand_spellings_round_trip(spark) -> None:
    rnd = random.Random(1)
    spellings = list(dict.fromkeys("".join(rnd.choices("abcdeé東😀 \n", k=rnd.randint(1, 6))) for _ in range(52_000)))[:50_000]
    texts = [None, "", "\n", "zzz😀\x00", *("".join(rnd.choices("abcdeé東😀 \nxyz", k=rnd.randint(1, 400))) for _ in range(200))]
    first, longest = {s: i for i, s in reversed(list(enumerate(spellings)))}, max(map(len, spellings))
    for text, (codes, back) in zip(texts, coded(spark, texts, spellings), strict=True):
        if text is None:
            assert codes is None and back is None
            continue
        want, i = [], 0
        while i < len(text):
            n = next((n for n in range(longest, 0, -1) if text[i : i + n] in first and i + n <= len(text)), 0)
            want.append(first[text[i : i + n]] if n else -1 - ord(text[i]))
            i += n or 1
        assert codes == want and back == text


def test_awkward_dictionaries(spark) -> None:
    assert coded(spark, ["aab"], []) == [([-98, -98, -99], "aab")]
    assert coded(spark, ["aab"], ["", "a", "a"]) == [([1, 1, -99], "aab")]
    assert coded(spark, ["aab"], ["aa"], blank=7)[0][0] == [0, 7]
    shown = spark.createDataFrame([([0, 5, -98, -2_000_000, None],)], "c array<int>").select(trie.codes_text(F.col("c"), ["x"]).alias("t")).first().t
    assert shown == "x[$5]a[$FFE17B80]"


def test_offsets_past_any_blob_fail_their_row_alone(spark) -> None:
    big = 3_000_000_000
    rows = [(0, b"abcdef", 1, 2), (1, b"abcdef", big, 1), (2, b"abcdef", 0, big), (3, b"abcdef", 2**63 - 1, 2**63 - 1), (4, b"abcdef", -1, None), (5, b"abcdef", 6, None), (6, None, 0, None), (7, b"abcdef", None, 1), (8, b"abcdef", 2, -1)]
    df = spark.createDataFrame(rows, "i int, blob binary, o long, n long")
    out = decode.staged(df, "blob", "p", F.col("o"), F.col("n"), F.lit(None).cast("string"), F.lit(None).cast("string"), {})
    got = {r.i: (None if r.output is None else bytes(r.output), r.message) for r in out.collect()}
    past = (None, "region past the end")
    assert got == {0: (b"bc", None), 1: past, 2: past, 3: past, 4: past, 5: (b"", None), 6: (None, "no content"), 7: past, 8: past}


# The stamped map below must give just these cells.
def test_sparse_stamps(spark) -> None:
    index = [0, 15, 2, 15, 15, 15, 15, 15, 8, 15, 10, 15, 15, 15, 15, 15]
    cells = spark.createDataFrame(list(enumerate(index)), "pos long, index long")
    drawn = lambda stamp: [r.source for r in stamps.expand_stamps(cells, "pos", "index", 4, *stamp, 4).orderBy("pos").collect()]
    assert drawn((2, 2)) == list(range(16))
    assert drawn((1, 1)) == index


@pytest.mark.parametrize(("n", "columns", "stamp"), [(16, 4, (2, 2)), (7, 3, (2, 3)), (1, 5, (3, 1)), (5, 5, (1, 1)), (0, 4, (2, 2))])
def test_dense_stamps_fill_their_last_row(spark, n, columns, stamp) -> None:
    across, down = stamp
    cells = spark.createDataFrame([(i, 100 * i) for i in range(n)], "pos long, index long")
    got = {r.pos: (r.entry, r.source) for r in stamps.expand_stamps(cells, "pos", "index", columns, across, down, 10, dense=True).collect()}
    width, want = columns * across, {}
    for p in range(-(-n // columns) * down * width):
        at = p // width // down * columns + p % width // across
        want[p] = (at, 100 * at + p % width % across + p // width % down * 10) if at < n else (None, None)
    assert got == want


def test_orientations_ride_along(spark) -> None:
    pairs = lambda *rows: spark.createDataFrame(list(rows), "virtual long, actual long")
    turns = lambda *rows: spark.createDataFrame(list(rows), "id long, flags int")
    none = spark.createDataFrame([], "id long, flags int")
    ids = lambda df: sorted(map(tuple, df.collect()))
    flipped = graph.oriented(none, turns((3, 1)))
    assert ids(flipped) == [(3, 1)]
    assert ids(graph.oriented(flipped, turns((3, 1)))) == []
    assert ids(graph.oriented(flipped, turns((3, 2)))) == [(3, 3)]
    moved = graph.compose(spark.createDataFrame([], "virtual long, actual long"), spark.createDataFrame([(3, 20), (20, 3)], "to long, source long"))
    shown = {r.slot: (r.actual, r.flags) for r in graph.shown(moved, flipped, spark.createDataFrame([(3,), (20,), (5,)], "slot long"), "slot").collect()}
    assert shown == {3: (20, 0), 20: (3, 1), 5: (5, 0)}
    assert ids(graph.bounded_orientations(turns((2, 1), (40, 1)), 10)) == [(2, 1)]
    assert ids(graph.bounded(pairs((1, 2), (2, 1), (3, 40), (40, 3)), 10)) == [(1, 2), (2, 1)]
    held = none
    for _ in range(4):  # quarter turns: transpose, then mirror
        held = graph.oriented(held, turns((7, 5)))
    assert ids(held) == []


def test_turning_a_block_turns_its_ids(spark) -> None:
    """A row of three mirrored: the middle one stays in place and is turned too; twice is nothing."""
    empty, none = spark.createDataFrame([], "virtual long, actual long"), spark.createDataFrame([], "id long, flags int")
    moves = spark.createDataFrame([(0, 2), (1, 1), (2, 0)], "to long, source long")
    mapping, turned = graph.turned_block(empty, none, moves, 1)
    assert sorted(map(tuple, mapping.collect())) == [(0, 2), (2, 0)] and sorted(map(tuple, turned.collect())) == [(0, 1), (1, 1), (2, 1)]
    mapping, turned = graph.turned_block(mapping, turned, moves, 1)
    assert mapping.isEmpty() and turned.isEmpty()


def test_substitution_and_its_inverse(spark) -> None:
    rnd = random.Random(3)
    rows = [(k, p, rnd.randrange(256)) for k, n in (("a", 33), (None, 8), ("b", 1)) for p in range(n)]
    df = spark.createDataFrame(rows, "k string, p long, v int").withColumn("k", F.coalesce("k", F.lit("none")))
    for unit in (1, 2):
        size = 256**unit
        shuffled = [rnd.sample(range(size), size) for _ in range(2)]
        tables = spark.createDataFrame([(s, v, to) for s in (0, 1) for v, to in enumerate(shuffled[s])], "sel int, v int, to int")
        assert substitute.unsound_tables(tables, size).isEmpty()
        done = substitute.substitute(df, ["k"], "p", "v", tables, [2], unit)
        assert sorted((r.k, r.p, r.v) for r in done.collect()) == sorted((k or "none", p, v) for k, p, v in rows)
        if unit == 1:
            assert all(r.to == shuffled[r.p >> 2 & 1][r.v] for r in done.collect())
        else:
            assert {(r.k, r.p): r.to == r.v for r in done.collect()}["a", 32]  # a tail below a unit passes
        back = substitute.substitute(done.select("k", "p", F.col("to").alias("v")), ["k"], "p", "v", substitute.inverse(tables), [2], unit)
        assert sorted((r.k, r.p, r.to) for r in back.collect()) == sorted((k or "none", p, v) for k, p, v in rows)
    bad = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 0, 0), (2, 0, 5), (2, 1, 0)], "sel int, v int, to int")
    assert {r.sel: r.problem for r in substitute.unsound_tables(bad, 2).collect()} == {0: "two values become one", 1: "not one row a value", 2: "a value outside"}


def test_probes_take_defaults_and_say_so(spark) -> None:
    reg = decode.Registry()
    reg.add_optional("s", "quiet")
    reg.add_optional("s", "good", size=lambda p: p.get("n", 4))
    reg.add_optional("s", "bad", size=lambda p: p["no"])
    reg.add_optional("s", "huge", size=lambda p: 2**40)
    rows = [(0, "quiet", "{}"), (1, "good", '{"n": 9}'), (2, "good", None), (3, "bad", "{}"), (4, "huge", "{}"), (5, "none", "{}"), (6, "good", "[1]"), (7, "good", "{"), (8, None, None)]
    df = spark.createDataFrame(rows, "i int, codec string, params string")
    found, notices = decode.probed(df, reg, "s", {"size": (int, 1, "int")})
    assert {r.i: r["size"] for r in found.collect()} == {0: 1, 1: 9, 2: 4, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1}
    assert sorted((r.codec or "", r.method) for r in notices.collect()) == [("", "size"), ("bad", "size"), ("good", "size"), ("good", "size"), ("huge", "size"), ("none", "size")]


# As relocating a shared file has to go.
def test_every_reference_moves_for_itself(spark) -> None:
    rows = [
        (0, "file", "old.sfc", "/d/old.sfc", "/d/old.sfc", None), (1, "slice", "gfx", "/d/old.sfc", "/d/old.sfc", ["/d/a", "/d/old.sfc", "/d/a"]),
        (2, "file", "other.sfc", "/d/other.sfc", "/d/other.sfc", []), (3, "file", "mine", "/d/old.sfc", None, ["/d/b", None]),
    ]
    df = spark.createDataFrame(rows, "id int, kind string, name string, path string, palette string, extra array<string>")
    mapping = spark.createDataFrame([("/d/old.sfc", "/d/moved.sfc")], "old string, new string")
    out = {r.id: tuple(r)[2:] for r in refs.repoint_all(df, "id", mapping, ["path", "palette"], ["extra"], ("name", "path", F.col("kind") == "file")).collect()}
    new = "/d/moved.sfc"
    assert out == {
        0: ("moved.sfc", new, new, None, True), 1: ("gfx", new, new, ["/d/a", new, "/d/a"], True),
        2: ("other.sfc", "/d/other.sfc", "/d/other.sfc", [], False), 3: ("mine", new, None, ["/d/b", None], True),
    }


def test_children_follow_their_file(spark) -> None:
    rows = [(0, True, "a.bin", "/a.bin", []), (1, False, "a.bin", "/a.bin", ["/z"]), (2, True, "typed", "/b.bin", []), (3, False, "s", "/b.bin", []), (4, False, "t", "/c.bin", ["/q"])]
    df = spark.createDataFrame(rows, "id int, file boolean, name string, path string, extra array<string>")
    moves = spark.createDataFrame([(0, ["/n.bin", "/m.bin"]), (2, ["/k.bin"]), (4, ["/no.bin"]), (3, [])], "id int, paths array<string>")
    out = {r.id: (r.name, r.path, r.extra, r.touched) for r in refs.retarget(df, moves, "id", "path", "extra", "name", F.col("file")).collect()}
    assert out == {0: ("n.bin", "/n.bin", ["/m.bin"], True), 1: ("a.bin", "/n.bin", ["/m.bin"], True), 2: ("typed", "/k.bin", [], True), 3: ("s", "/k.bin", [], True), 4: ("t", "/c.bin", ["/q"], False)}


def test_a_batch_writes_the_keys_it_changed(spark, tmp_path) -> None:
    from bitloom.streaming import runs as S

    put = lambda rows: spark.createDataFrame(rows, "k long, s long, a string, r long").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    now = lambda: {r.k: r.dirty for r in S.dirty_state(S.file_stream(spark, str(tmp_path / "log")), "k", "s", "a", "r", str(tmp_path / "place")).collect()}
    put([(k, 1, "edit", 5) for k in range(100)])
    assert now() == dict.fromkeys(range(100), True)
    put([(k, 2, "save", 5) for k in range(10)])
    assert now() == {k: k >= 10 for k in range(100)}
    sizes = sorted(spark.read.parquet(str(p)).count() for p in (tmp_path / "place" / "out").iterdir())
    assert sizes == [10, 100]
    # a batch that broke off before it had written anything takes nothing from the others
    assert now() == {k: k >= 10 for k in range(100)}


def test_nearest_of_a_table_is_nearest(spark) -> None:
    rnd = random.Random(9)
    values = [None, 0, 0x00FFFFFF, 0xFF000000, 0xFFFFFFFF, *(0xFF000000 | rnd.randrange(1 << 24) for _ in range(150))]
    df = spark.createDataFrame([(v,) for v in values], "argb long")
    many = [0xFF000000 | rnd.randrange(1 << 24) for _ in range(900)]
    def redmean(a: int, b: int) -> int:
        (r, g, z), (p, q, w) = [[c >> k & 255 for k in (16, 8, 0)] for c in (a, b)]
        mean = (r + p) >> 1
        return ((mean + 512) * (r - p) ** 2 >> 8) + 4 * (g - q) ** 2 + ((767 - mean) * (z - w) ** 2 >> 8)

    def manhattan(a: int, b: int) -> int:
        return sum(abs((a >> k & 255) - (b >> k & 255)) for k in (16, 8, 0))

    for candidates, metric, floor, plain in (([0, *many], match.redmean, match.redmean_floor, redmean), ([0xFF010101 + i for i in range(300)] * 2, match.manhattan, lambda n: n, manhattan), ([0, 5], match.redmean, match.redmean_floor, redmean)):
        solid = [i for i, c in enumerate(candidates) if c >> 24] or list(range(len(candidates)))
        table = spark.createDataFrame(list(enumerate(candidates)), "idx int, color long").repartition(3)
        got = {r.argb: (r.idx, r.exact) for r in match.nearest_of(df, "argb", table, metric, floor).collect() if r.argb is not None}
        for v in filter(lambda v: v is not None, values):
            d, i = min((plain(v, candidates[i]), i) for i in solid)
            assert got[v] == ((i, d == 0) if v >> 24 else (0, candidates[0] >> 24 == 0))
    empty = spark.createDataFrame([], "idx int, color long")
    assert match.nearest_of(df, "argb", empty).where("idx <> 0 or exact").isEmpty()
