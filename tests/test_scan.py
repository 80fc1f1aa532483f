"""Scans over a total order: one key over many ranges, spans and boxes of any size, null keys."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from bitloom.operators import aggs, intervals, match, runs, scan
from bitloom.sources import shared


def test_one_key_lies_in_every_range(spark) -> None:
    d = scan.laid(spark.range(200_000).withColumn("k", F.lit("hot")).unionByName(spark.range(3).withColumn("k", F.lit(None).cast("string"))), ["k"], ["id"], 8)
    rows = {r[scan.PART]: r["count"] for r in d.where("k = 'hot'").groupBy(scan.PART).count().collect()}
    assert len(rows) == 8 and max(rows.values()) < 60_000
    assert d.where(scan.MANY).select("k").distinct().collect() == [("hot",)]
    summed = scan.running(d, ["k"], ["id"], F.col("id"), "s").where("id in (3, 199999)").collect()
    assert sorted(r.s for r in summed) == [3, 199_999 * 199_998 // 2]


@pytest.mark.parametrize("parts", [1, 5, 30])
def test_runs_are_those_of_a_loop(spark, parts) -> None:
    """One hot key, a null key and small ones; values are null at times."""
    rnd = random.Random(parts)
    rows = [(k, i, rnd.choice([None, 1, 1, 1, 2])) for k, n in (("hot", 800), (None, 40), ("a", 1), ("b", 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(4)
    want = []
    for k, group in itertools.groupby(rows, lambda r: r[0]):
        for n, (v, run) in enumerate(itertools.groupby(group, lambda r: r[2])):
            run = list(run)
            want.append((k, n, v, len(run), run[0][1]))
    coded = runs.runs(df, ["k"], ["i"], "v", ("i",), parts)
    assert sorted(map(tuple, coded.collect()), key=repr) == sorted(want, key=repr)
    back = runs.expand_runs(runs.run_packets(coded, ["k"], "v", 7, 2), ["k"], "v", parts)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)
    lines = {(r.k, r.i): r.line for r in runs.split_lines(df, ["k"], "i", F.col("v") == 2, parts).collect()}
    seen: dict = {}
    for k, i, v in rows:
        assert lines[k, i] == seen.get(k, 0)
        seen[k] = seen.get(k, 0) + (v == 2)
    stretches = runs.line_stretches(runs.split_lines(df.withColumn("t", F.col("i").cast("string")), ["k"], "i", F.lit(False), parts), ["k"], "i", "t", 100, parts)
    assert " ".join(r.body for r in stretches.where("k = 'hot'").orderBy("stretch").collect()) == " ".join(map(str, range(800)))


def test_terminators_and_trims_of_null_keys(spark) -> None:
    df = spark.createDataFrame([(None, 0, "a"), (None, 1, "end"), (None, 2, "b"), (1, 0, "c"), (2, 0, "end")], "k long, i long, v string")
    groups = spark.createDataFrame([(None,), (1,), (2,), (3,)], "k long")
    got = runs.until_terminator(df, ["k"], "i", F.col("v") == "end", groups).collect()
    assert sorted(((r.k, r.v) for r in got), key=repr) == sorted([(None, "a"), (1, "c"), (2, None), (3, None)], key=repr)
    kept = aggs.trim_trailing(df, ["k"], "i", F.col("v") == "end")
    assert sorted(((r.k, r.i) for r in kept.collect()), key=repr) == sorted([(None, 0), (None, 1), (1, 0), (2, 0)], key=repr)


@pytest.mark.parametrize("parts", [1, 6])
def test_long_spans_cost_no_rows(spark, parts) -> None:
    """A write of 4e12 places below and above many short ones, and points asked of it; the set is null."""
    wide = 4 * 10**12
    log = [(None, 0, wide, "below", 0), *((None, 1000 * i, 1000 * i + 10, f"s{i}", 1 + i) for i in range(1, 200)), (None, 50_000, wide // 2, "above", 10_000), (7, 5, 6, "x", 1)]
    d = spark.createDataFrame(log, "k long, start long, end long, row string, seq long").repartition(3)
    got = sorted((r.start, r.end, r["row"]) for r in intervals.overwrite_spans(d, ["k"], parts=parts).where("k is null").collect())
    want, at = [], 0
    for i in range(1, 50):
        want += [(at, 1000 * i, "below"), (1000 * i, 1000 * i + 10, f"s{i}")]
        at = 1000 * i + 10
    assert got == [*want, (at, 50_000, "below"), (50_000, wide // 2, "above"), (wide // 2, wide, "below")]
    regions = spark.createDataFrame([(None, *g) for g in got], "k long, start long, end long, row string")
    points = spark.createDataFrame([(None, -1), (None, 0), (None, 3005), (None, wide - 1), (None, wide), (7, 5), (None, None), (None, 0)], "k long, p long")
    found = intervals.value_at(points, regions, ["k"], "p")
    assert sorted(((r.k, r.p, r["row"]) for r in found.collect()), key=repr) == sorted(
        [(None, -1, None), (None, 0, "below"), (None, 3005, "s3"), (None, wide - 1, "below"), (None, wide, None), (7, 5, None), (None, None, None), (None, 0, "below")], key=repr
    )


def test_equal_seq_takes_the_greater_value(spark) -> None:
    for rows in ([(0, 0, 9, 1, 5), (0, 3, 6, 2, 5)], [(0, 0, 9, 2, 5), (0, 3, 6, 1, 5), (0, 0, 9, None, 5)]):
        d = spark.createDataFrame(rows, "k long, start long, end long, row long, seq long")
        got = sorted((r.start, r.end, r["row"]) for r in intervals.overwrite_spans(d, ["k"]).collect())
        assert got == ([(0, 3, 1), (3, 6, 2), (6, 9, 1)] if rows[0][3] == 1 else [(0, 9, 2)])


def test_aligned_powers_of_two(spark) -> None:
    pairs = spark.range(40).select(F.col("id").alias("a")).join(spark.range(41).select(F.col("id").alias("b")), F.col("a") <= F.col("b"))
    for r in pairs.select("a", "b", intervals._aligned(F.col("a").cast("int"), F.col("b").cast("int")).alias("t")).collect():
        places = sorted(p for t in r.t for p in range(t["at"] << t["level"], (t["at"] + 1) << t["level"]))
        assert places == list(range(r.a, r.b))
        assert len(r.t) <= 12


def test_large_boxes_are_a_handful_of_rows(spark) -> None:
    boxes = [(0, -50_000, -50_000, 100_000, 100_000), (1, 3, 3, 1, 1), (2, 0, 0, 100_000, 1), (3, 5, -7, 2, 300), (4, 0, 0, 0, 5)]
    points = [(0, 3, 3), (1, 0, 0), (2, 49_999, 49_999), (3, 50_000, 0), (4, 6, 292), (5, -50_000, -50_000), (6, 99_999, 0)]
    got = match.hits(spark.createDataFrame(points, "id long, px long, py long"), spark.createDataFrame(boxes, "box long, x long, y long, w long, h long"), "px", "py")
    want = [(i, b) for i, px, py in points for b, x, y, w, h in boxes if x <= px < x + w and y <= py < y + h]
    assert sorted((r.id, r.box) for r in got.collect()) == sorted(want)


def test_clear_deletes_what_this_process_left(spark) -> None:
    held = shared.stored(spark.range(3))
    other = shared.stored(spark.range(4))
    shared.discard(other)
    assert held.count() == 3 and shared.clear(spark) >= 1 and shared.clear(spark) == 0
    place = spark._jvm.org.apache.hadoop.fs.Path(held._stored_at)
    assert not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
