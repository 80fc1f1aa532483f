"""Hand vectors and laws of single operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from bitloom.functions import bits, layout, orient, text, trie
from bitloom.operators import decode, graph, intervals, match, quality, runs


def spans(spark, rows):
    return spark.createDataFrame([(0, s, s + n, r) for s, n, r in rows], "set_id long, start long, end long, row long")


def as_regions(df):
    return [(r["start"], r["end"] - r["start"], r["row"]) for r in df.orderBy("start").collect()]


# The vectors of overwriting, subtracting, normalizing and nearest colours below must give just these results.
@pytest.mark.parametrize(
    ("write", "want"),
    [
        ((120, 20), [(100, 20, 1), (120, 20, 9), (140, 60, 1)]), ((80, 40), [(80, 40, 9), (120, 80, 1)]),
        ((180, 40), [(100, 80, 1), (180, 40, 9)]), ((60, 40), [(60, 40, 9), (100, 100, 1)]),
    ],
)
def test_overwrite(spark, write, want) -> None:
    log = spark.createDataFrame([(0, 100, 200, 1, 0), (0, *(write[0], sum(write)), 9, 1)], "set_id long, start long, end long, row long, seq long")
    assert as_regions(intervals.overwrite_spans(log, ["set_id"], parts=2)) == want


@pytest.mark.parametrize(("cut", "want"), [((120, 20), [(100, 120), (140, 200)]), ((50, 200), []), ((0, 50), [(100, 200)])])
def test_subtract(spark, cut, want) -> None:
    got = intervals.subtract_spans(spans(spark, [(100, 100, 1)]), spans(spark, [(*cut, 1)]), ["set_id"])
    assert [(r.start, r.end) for r in got.orderBy("start").collect()] == want


def test_normalize(spark) -> None:
    one = lambda rows: as_regions(intervals.normalize_spans(spans(spark, rows), ["set_id"]))
    assert one([(0, 32, 3), (32, 32, 3)]) == [(0, 64, 3)]
    assert one([(32, 32, 3), (0, 48, 3)]) == [(0, 64, 3)]
    assert one([(0, 32, 1), (32, 32, 2)]) == [(0, 32, 1), (32, 32, 2)]
    assert one([(0, 0, 1)]) == []


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_intervals_against_painting(spark, parts) -> None:
    """Random sets of several keys, painted place by place."""
    rnd = random.Random(parts)
    rows = list({(rnd.choice([-1, 1, 2]), s, s + rnd.choice([rnd.randrange(0, 12), rnd.randrange(0, 12), 90]), rnd.randrange(3), q) for q, s in enumerate(rnd.choices(range(-30, 160), k=90))})
    df = spark.createDataFrame(rows, "set_id long, start long, end long, row long, seq long").repartition(3)
    df = df.withColumn("set_id", F.nullif("set_id", F.lit(-1)))
    null = lambda v: -1 if v is None else v
    key = lambda rs: sorted((null(r.set_id), r.start, r.end, *( [r["row"]] if "row" in r else [])) for r in rs)

    def painted(cells: dict) -> list:
        out: list = []
        for (k, p), v in sorted(cells.items()):
            if out and out[-1][0] == k and out[-1][2] == p and out[-1][3] == v:
                out[-1][2] = p + 1
            else:
                out.append([k, p, p + 1, v])
        return [tuple(x) for x in out]

    last, first, any_, odd = {}, {}, {}, {}
    for k, a, z, v, _ in sorted(rows, key=lambda r: r[4]):
        last.update({(k, p): v for p in range(a, z)})
        any_.update({(k, p): 0 for p in range(a, z)})
        if v == 1:
            odd.update({(k, p): 0 for p in range(a, z)})
    reach: dict = {}
    for k, a, z, v, _ in sorted((r for r in rows if r[2] > r[1]), key=lambda r: r[:4]):
        start = max(a, reach.get(k, a))
        first.update({(k, p): v for p in range(start, z)})
        reach[k] = max(reach.get(k, z), z)
    assert key(intervals.overwrite_spans(df, ["set_id"], parts=parts).collect()) == painted(last)
    assert key(intervals.normalize_spans(df, ["set_id"], parts=parts).collect()) == painted(first)
    assert key(intervals.merge_spans(df, ["set_id"], parts=parts).drop("n").collect()) == [x[:3] for x in painted(any_)]
    rest = {c: 0 for c in any_ if c not in odd}
    assert key(intervals.subtract_spans(df, df.where("row = 1"), ["set_id"], parts=parts).collect()) == [x[:3] for x in painted(rest)]
    order = ["start", "end", "row", "seq"]
    pairs = [(x, y) for x, y in zip(sorted(r[:5] for r in rows), sorted(r[:5] for r in rows)[1:]) if x[0] == y[0] and y[1] < x[2]]
    got = intervals.overlaps(df, ["set_id"], order, parts=parts).collect()
    assert sorted((null(r.set_id), r.start, r.end, r["row"], r.seq, r.next_start, r.next_end) for r in got) == sorted((*x, y[1], y[2]) for x, y in pairs)
    laid = sorted((r.seq, r.at) for r in intervals.assembled(df.where("set_id = 1").withColumn("n", F.col("end") - F.col("start")).withColumnRenamed("start", "s0"), ["set_id"], "seq", "n", parts=parts).withColumnRenamed("start", "at").collect())
    total, want = 0, []
    for r in sorted((r for r in rows if r[0] == 1), key=lambda r: r[4]):
        want.append((r[4], total))
        total += r[2] - r[1]
    assert laid == want


def test_merge_in_ranges_is_merge(spark) -> None:
    rnd = random.Random(1)
    rows = [(rnd.randrange(1000), rnd.randrange(0, 30), 0) for _ in range(300)]
    plain = intervals.merge_spans(spans(spark, rows), ["set_id"]).collect()
    assert sorted(plain) == sorted(intervals.merge_spans(spans(spark, rows), ["set_id"], parts=16).collect())
    again = intervals.merge_spans(intervals.merge_spans(spans(spark, rows), ["set_id"]).drop("n"), ["set_id"])
    assert {(r.start, r.end) for r in again.collect()} == {(r.start, r.end) for r in plain}


def test_nearest(spark) -> None:
    near = lambda v, c: tuple(match.nearest(spark.createDataFrame([(v,)], "argb long"), "argb", c).select("idx", "exact").first())
    opaque = [0xFF000000, 0xFFFE0000, 0xFFFF0000]
    assert near(0xFFFF0000, opaque) == (2, True)
    assert near(0xFFFD0000, opaque) == (1, False)
    assert near(0x00FFFFFF, [0, 0xFFFFFFFF, 0xFFFF0000]) == (0, True)
    assert near(0x40FF0000, [0, 0xFFFFFFFF, 0xFFFF0000]) == (2, True)
    assert near(0xFF000000, [0, 0xFFFFFFFF, 0xFF000000]) == (2, True)
    assert near(1, []) == (0, False)


def test_run_length_round_trip(spark) -> None:
    rnd = random.Random(2)
    rows = [(k, i, rnd.choice("aab")) for k in range(3) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, i long, v string")
    coded = runs.runs(df, ["k"], ["i"], "v")
    back = runs.expand_runs(runs.run_packets(coded, ["k"], "v", 3, 2), ["k"], "v")
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_bit_fields_and_permutations(spark) -> None:
    fields = bits.parse_layout("aabb-baa")
    row = spark.range(256).select("id", *[bits.unpack_field(F.col("id"), b).alias(c) for c, b in fields.items()])
    back = row.withColumn("p", bits.pack_fields({c: F.col(c) for c in fields}, fields))
    assert back.where("p <> (id & 247)").count() == 0
    moved = spark.range(64).select(bits.permute_bits(F.col("id"), [2, 0, 1]).alias("m"))
    assert moved.distinct().count() == 64


def test_orientations_form_a_group(spark) -> None:
    pairs = spark.range(64).select((F.col("id") % 8).alias("a"), F.floor(F.col("id") / 8).alias("b"))
    composed = pairs.withColumn("c", orient.compose(F.col("b"), F.col("a")))
    assert composed.groupBy("a").agg(F.countDistinct("c").alias("n")).where("n <> 8").count() == 0
    assert composed.withColumn("i", orient.compose(orient.invert(F.col("a")), F.col("a"))).where("i <> 0").count() == 0


def test_block_layout_inverse(spark) -> None:
    for blocks in (layout.Blocks(16, 4, 2, layout.COLUMNS_FIRST), layout.Blocks(16, 4, 3, layout.ROW_INTERLEAVE), layout.Blocks(10, 4, 2)):
        x, y = blocks.position(F.col("id"))
        assert spark.range(500).withColumn("s", blocks.slot(x, y)).where("s is null or s <> id").count() == 0


def test_regions_of_winding_paths(spark) -> None:
    """A serpentine has as many rounds of straight propagation as turns; here it is one region, whatever the rounds."""
    n = 24
    cells = [(y * n + x, x, y, int(y % 2 == 0 or x == (n - 1 if y % 4 == 1 else 0))) for y in range(n) for x in range(n)]
    got = graph.regions(spark.createDataFrame(cells, "pos long, x long, y long, v long"))
    path = {r.region for r in got.join(spark.createDataFrame(cells, "pos long, x long, y long, v long"), "pos").where("v = 1").collect()}
    assert path == {0}


def test_cycles_with_tails_and_dangling(spark) -> None:
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 1), (3, 3), (4, 9), (5, 0)], "n long, t long")
    got = {r.node: (r.on_cycle, r.label) for r in graph.cycle_labels(links, "n", "t").collect()}
    assert got == {0: (False, None), 1: (True, 1), 2: (True, 1), 3: (True, 3), 4: (False, None), 5: (False, None)}


def test_lz_readers() -> None:
    out, used, done = decode.read_sized_lz(bytes([0x10, 6, 0, 0, 0x40]) + b"a" + bytes([0x20, 0]))
    assert (out, used, done) == (b"aaaaaa", 8, True)
    out, used, done = decode.read_ring_lz(bytes([4, 0, 0, 0, 0x01]) + b"z" + bytes([0xEE, 0xF0]))
    assert (out, used, done) == (b"zzzz", 8, True)
    assert decode.read_fill_rle(b"\x03a\x82bc\xff") == (b"aaabc", 6, True)
    assert decode.read_fill_rle(b"\x03a\x82b")[2] is False


def test_registry_refuses_a_second_id() -> None:
    reg = decode.Registry()
    reg.add("decompress", "x", decode.read_fill_rle)
    with pytest.raises(ValueError):
        reg.add("decompress", "x", decode.read_fill_rle)


def test_failed_rows_keep_their_place(spark) -> None:
    df = spark.createDataFrame([(1, b"\x03a\xff"), (2, b"\x03"), (3, None)], "k long, blob binary")
    got = {r.k: (bytes(r.output) if r.output is not None else None, r.stage) for r in decode.decode(df, "blob", "fill-rle").collect()}
    assert got == {1: (b"aaa", None), 2: (None, "decompress"), 3: (None, "container")}


def test_names_keys_and_codes(spark) -> None:
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    assert one(text.safe_name(F.lit("..a b?.png."))) == "a_b_.png"
    assert one(text.safe_name(F.lit("..."))) == "export"
    assert one(text.path_key(F.lit("C:\\A//b/./c/"))) == "c:/a/b/c"
    assert one(text.path_key(F.lit("x/../../y/.."), F.lit("/Base/Dir"))) == "/base"
    assert one(text.stored_path(F.lit("/base/Dir/a/../b"), F.lit("/Base/dir"))) == "b" and one(text.stored_path(F.lit("../b"), F.lit("/Base/dir"))) == "/Base/b"
    words = ["th", "the", "e"]
    codes = trie.greedy_codes(F.lit("thex𝒳"), words)
    assert one(codes) == [1, -121, -1 - ord("𝒳")]
    assert one(trie.codes_text(codes, words)) == "thex𝒳"
    assert one(text.commands_text(F.array(*[F.lit(c) for c in (1, 7, 2, 3, 7, 4)]), {7: ("go", 2)})) == "<1>[go $2 $3][go $4]"
    names = spark.createDataFrame([("a10",), ("a9",), ("A2",), ("b",)], "n string")
    assert [r.n for r in names.orderBy(text.natural_key(F.col("n"))).collect()] == ["A2", "a9", "a10", "b"]


def test_digit_runs_of_any_length_sort_as_numbers(spark) -> None:
    names = ["a" + "1" * 21, "a" + "1" * 25, "a" + "0" * 30 + "9", "a" + "2" * 24, "a10b2", "a10b11"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(text.natural_key(F.col("n"))).collect()]
    assert got == ["a" + "0" * 30 + "9", "a10b2", "a10b11", "a" + "1" * 21, "a" + "2" * 24, "a" + "1" * 25]


def test_code_lines_past_an_int(spark) -> None:
    one = lambda line: spark.range(1).select(text.parse_code_line(F.lit(line)).alias("c")).first().c
    assert tuple(one("FFFFFFFF=x")) == (0xFFFFFFFF, "x", 0) and tuple(one("80000000=[a, 3]")) == (1 << 31, "[a]", 3)
    assert one("1=[a, 99999999999]") is None and one("123456789=x") is None


def test_hex_of_sixteen_digits(spark) -> None:
    one = lambda t: spark.range(1).select(bits.parse_hex(F.lit(t)).alias("c")).first().c
    assert one("7FFFFFFFFFFFFFFF") == (1 << 63) - 1 and one("0x0000000000000000000001f") == 31 and one("$0") == 0
    assert one("8000000000000000") is None and one("12345678123456789") is None and one("xyz") is None


def test_long_alias_chains_and_ties(spark) -> None:
    chain = spark.range(70_000).select(F.col("id").alias("old"), (F.col("id") + 1).alias("new"))
    assert [r.last for r in graph.chain_ends(chain, "old", "new").where("old in (0, 35000)").collect()] == [70_000, 70_000]
    ties = spark.createDataFrame([(1, 5), (1, 3), (1, 4), (3, 9)], "old long, new long")
    for n in (1, 4):
        assert {r.old: r.last for r in graph.chain_ends(ties.repartition(n), "old", "new").collect()} == {1: 9, 3: 9}


def test_fill_keeps_to_its_bounds(spark) -> None:
    rnd = random.Random(3)
    cells = [(y * 12 + x, x, y, rnd.randrange(2)) for y in range(12) for x in range(12)]
    value = {(x, y): v for _, x, y, v in cells}
    grid = spark.createDataFrame(cells, "pos long, x long, y long, v long")
    for seed, bounds in ((50, None), (50, (1, 2, 7, 6)), (3, (1, 2, 7, 6)), (999, None)):
        x0, y0, w, h = bounds or (0, 0, 12, 12)
        inside = lambda c: c in value and x0 <= c[0] < x0 + w and y0 <= c[1] < y0 + h
        start = (seed % 12, seed // 12)
        todo, seen = [start] if inside(start) else [], set()
        while todo:
            c = todo.pop()
            if c in seen:
                continue
            seen.add(c)
            todo += [n for n in ((c[0] + 1, c[1]), (c[0] - 1, c[1]), (c[0], c[1] + 1), (c[0], c[1] - 1)) if inside(n) and value[n] == value[start]]
        assert sorted(r.pos for r in graph.fill(grid, seed, bounds=bounds).collect()) == sorted(y * 12 + x for x, y in seen)


def test_readers_refuse_what_no_stream_holds() -> None:
    assert decode.read_sized_lz(bytes([0x10, 3, 0, 0, 0x80, 0, 5]))[2] is False  # a reference before the start
    assert decode.read_sized_lz(bytes([0x1F, 1, 0, 0, 0]) + b"a") == (b"a", 6, True)  # the low nibble is free
    assert decode.read_sized_lz(bytes([0x20, 1, 0, 0, 0]) + b"a")[2] is False
    assert decode.read_ring_lz(bytes([3, 0, 0, 0, 0, 0, 0]))[:1] == (b"\0\0\0",)  # the ring holds zeros
    size = 5_000_000
    groups = b"\0" + b"abcdefgh"
    whole = bytes([0x10]) + size.to_bytes(3, "little") + groups * (size // 8)
    out, used, done = decode.read_sized_lz(whole)
    assert (len(out), used, done) == (size, len(whole), True)
    assert decode.read_address_rle(b"\x7f\x00\x20\x03a\x80\x82bc\xff") == (b"aaabc", 10, True)
    assert decode.read_fill_rle(b"\x7fa\xff") == (b"a" * 127, 3, True)


def test_run_scan_finds_what_the_readers_read() -> None:
    rnd = random.Random(6)
    for name in ("fill-rle", "address-rle"):
        for _ in range(60):
            blob = bytes(rnd.choices([0xFF, 0x7F, 0x80, 0x81, 0x83, 1, 2, 0, 65], k=rnd.randint(0, 60)))
            want = []
            for at in range(len(blob)):
                out, used, done = decode.READERS[name](blob[at : at + 20])
                if done and out:
                    want.append((at, used, len(out)))
            assert decode.SCANS[name](blob, 20) == want


def test_streams_take_up_only_what_is_new(spark, tmp_path) -> None:
    from bitloom.streaming import runs as S

    folder = f"file://{tmp_path}/in"
    add = lambda rows: spark.sql("SELECT * FROM VALUES " + ", ".join(f"({u}L, {q}L, '{a}', {r}L, timestamp'{t}')" for u, q, a, r, t in rows) + " AS t(user, seq, action, rev, ts)").coalesce(1).write.mode("append").parquet(folder)
    add([(1, 1, "edit", 5, "2024-01-01 00:00:00"), (2, 2, "edit", 7, "2024-01-01 01:00:00")])
    stream = lambda: S.file_stream(spark, folder)
    detect = lambda rows: rows.select("user", "seq")
    place = lambda n: f"file://{tmp_path}/{n}"
    dirty = lambda: {r.user: r.dirty for r in S.dirty_state(stream(), "user", "seq", "action", "rev", place("dirty")).collect()}
    closed = lambda: sorted((r.user, str(r.start), r.n) for r in S.sessions(stream(), "user", "ts", "2 hours", "1 hour", "append", place("runs")).collect())
    assert S.intake(stream(), detect, place("in-out")).count() == 2 and dirty() == {1: True, 2: True} and closed() == []
    add([(1, 3, "save", 5, "2024-01-01 00:30:00"), (3, 4, "save", 1, "2024-01-01 12:00:00")])
    before = set((tmp_path / "in-out" / "out").iterdir())
    assert S.intake(stream(), detect, place("in-out")).count() == 4 and len(set((tmp_path / "in-out" / "out").iterdir()) - before) == 1
    assert dirty() == {1: False, 2: True, 3: False}
    closed()
    add([(2, 5, "edit", 9, "2024-01-01 01:30:00"), (3, 6, "edit", 1, "2024-01-02 12:00:00")])
    # user 2's row is later than the watermark by now: left out, its run stays as it was given
    assert closed() == [(1, "2024-01-01 00:00:00", 2), (2, "2024-01-01 01:00:00", 1), (3, "2024-01-01 12:00:00", 1)]


def test_binary_scan_gives_what_the_files_hold(spark, tmp_path) -> None:
    from bitloom.sources import corpus

    for name, body in (("a.bin", b"abcdef"), ("b.bin", b""), ("c.txt", b"no")):
        (tmp_path / name).write_bytes(body)
    files = corpus.scan(spark, f"file://{tmp_path}", "*.bin", with_empty=True)
    got = {r.path.rsplit("/", 1)[1]: (r.length, bytes(r.head)) for r in files.collect()}
    assert got == {"a.bin": (6, b"abcdef"), "b.bin": (0, b"")}
    lost = corpus.with_missing(spark.createDataFrame([("nowhere",)], "path string"), files).first()
    assert (lost.length, bytes(lost.head)) == (-1, b"")


def test_findings_are_in_order_over_all_files(spark, tmp_path) -> None:
    from bitloom.sources import corpus

    rows = [(f"B{i % 7}", ["warning", "error", "info"][i % 3], f"/{i % 40}/x", i % 40, "", "m", "") for i in range(300)]
    found = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'entry' else 'string'}" for c in quality.COLUMNS)).repartition(5)
    corpus.write_findings(found, f"file://{tmp_path}/json")
    corpus.write_summary(found, f"file://{tmp_path}/text")
    import json

    lines = [json.loads(x) for f in sorted((tmp_path / "json").glob("part-*")) for x in f.read_text().splitlines()]
    assert [(corpus.SEVERITIES.index(x["severity"]), x["entry"], x["code"]) for x in lines] == sorted((corpus.SEVERITIES.index(s), e, c) for c, s, _, e, *_ in rows)
    text_lines = [x for f in sorted((tmp_path / "text").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x for x in text_lines if x[0] != " "] == [f"entries[{i}]" for i in range(40)] and len(text_lines) == 340


def test_rules_on_empty_tables(spark) -> None:
    none = spark.createDataFrame([], "id long, v string")
    assert quality.enumeration(none, "X", "id", "v", ["a"], "a").count() == 0
    assert intervals.merge_spans(spans(spark, []), ["set_id"], parts=8).count() == 0
