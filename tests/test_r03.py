"""What the third round of findings asked for: plans and layouts that do not grow with the input."""

from __future__ import annotations

import math
import time

import numpy as np
import pyarrow as pa
import pytest
from oracle import spark_rows, sql_rows
from pyspark.sql import functions as F

from bitloom.functions import bits, trie
from bitloom.llm import substring_dedup
from bitloom.operators import decode, graph, intervals, match, quality, runs, scan, substitute
from bitloom.plans.queries import ORACLE_SQL, QUERIES
from bitloom.sources import corpus, shared
from bitloom.sources.shared import stored

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_of_arrays_are_those_of_rows(spark) -> None:
    arrays = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [255]), (3, [0, 0])], "k int, vs array<int>")
    tables = spark.range(2 * 65536).select((F.col("id") / 65536).cast("int").alias("sel"), (F.col("id") % 65536).cast("int").alias("v")).withColumn("to", (F.col("v") * 5 + 3 + F.col("sel")) % 65536)
    words = substitute.substitute_words(substitute.words_of(arrays, ["k"], "vs", 2), tables, [1], 2)
    rows = substitute.substitute(arrays.select("k", F.posexplode("vs").alias("p", "v")), ["k"], "p", "v", tables, [1], unit=2)
    got = {}
    for r in words.collect():
        for i in range(r.n):
            got[r.k, r.first + i] = (r.sel, r.word >> 8 * (1 - i) & 255, r.new >> 8 * (1 - i) & 255)
    assert got == {(r.k, r.p): (r.sel, r.v, r.to) for r in rows.collect()}


def test_substitution_undone_shuffles_documents_only(spark) -> None:
    assert plan_of(QUERIES["f8_substitution_undone"](spark, SF)).count("hashpartitioning") == 1


def test_many_candidates_are_not_broadcast(spark) -> None:
    assert "Broadcast" not in plan_of(QUERIES["j8_many_candidates"](spark, SF))


def test_first_hits_are_those_of_all_hits(spark) -> None:
    boxes = spark.createDataFrame([(5, 0, 0, 9, 9), (3, 0, 0, 9, 9), (1, 1, 0, 9, 9), (2, 40, 40, 1, 1)], "box long, x long, y long, w long, h long")
    points = spark.createDataFrame([(1, 4, 4), (2, 4, 4), (3, 0, 1), (4, 40, 40), (5, 99, 99), (6, None, 1)], "p long, px long, py long")
    draws = (F.col("px") - F.col("x")) % 2 == 0
    first = match.first_hits(points, boxes, "px", "py", draws, "box")
    every = match.first_hit(match.hits(points, boxes, "px", "py"), "p", draws, "box")
    got = sorted((r.p, r.box) for r in first.collect())
    assert got == sorted((r.p, r.box) for r in every.collect()) == [(1, 3), (2, 3), (3, 3), (4, 2)]
    assert "Window" not in plan_of(QUERIES["j19_rectangle_hit"](spark, SF))


def test_line_split_gives_whole_lines(spark) -> None:
    """one row a line, however long, as the query's first SQL had it."""
    assert "stretch" not in ORACLE_SQL["w11_line_split"]
    assert spark_rows(QUERIES["w11_line_split"](spark, SF)) == sql_rows(ORACLE_SQL["w11_line_split"], SF)
    lines = spark.range(100).select(F.lit(1).alias("k"), F.lit(0).alias("line"), "id", F.col("id").cast("string").alias("b"))
    assert runs.whole_lines(lines, ["k"], "id", "b", width=7).collect()[0].body == " ".join(map(str, range(100)))


def test_ranges_grow_with_the_rows(spark, monkeypatch) -> None:
    monkeypatch.setattr(scan, "RANGE_ROWS", 10)
    d = scan.laid(spark.range(400).select((F.col("id") % 2).alias("k"), "id"), ["k"], ["id"])
    sizes = [r["count"] for r in d.groupBy(scan.PART).count().collect()]
    assert len(sizes) > 30 and max(sizes) < 40  # four shuffle partitions of a hundred rows before
    assert d.rdd.getNumPartitions() == 41


def test_cycle_rounds_are_merged_and_end_early(spark, monkeypatch) -> None:
    made = []
    monkeypatch.setattr(graph, "stored", lambda df, *a: (made.append(plan_of(df)), stored(df, *a))[1])
    # a tail of 40 into a loop of three, a loop of one, an end
    links = [(i, i + 1) for i in range(40)] + [(40, 41), (41, 42), (42, 40), (50, 50), (60, 61)]
    got = {r.node: r.label for r in graph.cycle_labels(spark.createDataFrame(links, "n long, t long"), "n", "t").collect()}
    assert {n: v for n, v in got.items() if v is not None} == {40: 40, 41: 40, 42: 40, 50: 50} and len(got) == 45
    made.clear()
    pairs = spark.range(1000).select("id", F.col("id").bitwiseXOR(1).alias("t"))
    assert graph.cycle_labels(pairs, "id", "t").where("on_cycle and label = node - node % 2").count() == 1000
    assert len(made) <= 5 and "Broadcast" not in "".join(made)  # ten rounds before


def test_planes_by_lookup(spark) -> None:
    s = "".join(chr(65 + 7 * i % 60) for i in range(16))
    got = spark.createDataFrame([(s,)], "s string").select(bits.plane_pixels(F.col("s"), [0, 8], 8, 8).alias("p"))
    assert got.first().p == "".join(str((ord(s[i // 8]) >> 7 - i % 8 & 1) + 2 * (ord(s[i // 8 + 8]) >> 7 - i % 8 & 1)) for i in range(64))
    assert "transform" not in plan_of(QUERIES["f15_bit_plane_unpack"](spark, SF))


def test_permutation_windows_have_tasks_by_rows(spark, monkeypatch) -> None:
    monkeypatch.setattr(scan, "RANGE_ROWS", 10)
    d = spark.range(400).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 50).alias("s"), (F.col("id") % 70).alias("t"))
    assert ", 41)" in plan_of(quality.permutation(d, "B", "id", "g", "s", "t"))


def test_workers_read_slices_of_batches() -> None:
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["a"])
    cut = list(decode._slices(iter([batch])))
    assert max(b.num_rows for b in cut) <= decode.SLICE and pa.Table.from_batches(cut).column(0).to_pylist() == list(range(1000))


def test_large_files_give_their_heads_only(spark, tmp_path, monkeypatch) -> None:
    """no task reads a file over WHOLE bytes."""
    monkeypatch.setattr(corpus, "WHOLE", 1000)
    bodies = {"a b%20.bin": bytes(range(256)) * 8, "small.bin": b"\xffxyz", "edge.bin": b"e" * 1000, "c.gz": b"\x1f\x8b" + b"\0" * 3000}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    for head in (4, 1500, corpus.HEAD):
        got = {r.path.rsplit("/", 1)[1]: (r.length, bytes(r.head)) for r in corpus.scan(spark, f"file://{tmp_path}", head=head).collect()}
        assert got == {n: (len(b), b[:head]) for n, b in bodies.items()}
    assert "LessThanOrEqual(length,1000)" in plan_of(corpus.scan(spark, f"file://{tmp_path}"))
    assert {bytes(r.head) for r in corpus.scan(spark, f"file://{tmp_path}", head=0).collect()} == {b""}


def test_codes_are_worked_on_some_rows_at_a_time(spark, monkeypatch) -> None:
    """F16: rows of a batch never become Python objects all at once."""
    monkeypatch.setattr(trie, "CHUNK", 10)
    assert list(trie._chunks(np.array([4, 6, 1, 30, 0, 0, 11, 10]))) == [(0, 2), (2, 3), (3, 4), (4, 6), (6, 7), (7, 8)] and not list(trie._chunks(np.zeros(0, int)))
    texts = ["the hen", None, "", "x" * 40, "in 𝄞 é", *(f"there {i}" for i in range(50))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    codes = trie.greedy_codes(F.col("t"), ["th", "he", "in", "the"])
    got = {r.i: (r.c, r.back) for r in rows.select("i", codes.alias("c"), trie.codes_text(codes, ["th", "he", "in", "the"]).alias("back")).collect()}
    assert [got[i][1] for i in range(len(texts))] == texts and got[0][0] == [3, -33, 1, -111] and got[1][0] is None and got[2][0] == []


def test_rules_neither_sort_nor_hold_a_join_of_the_whole(spark, monkeypatch) -> None:
    """children and pairs stream past hashed parents and lists; lists are grouped in tasks by rows."""
    monkeypatch.setattr(scan, "RANGE_ROWS", 1000)
    for q in ("q8_parent_precedes_child", "q14_permutation_validity"):
        assert "SortMergeJoin" not in plan_of(QUERIES[q](spark, SF))
    plan = plan_of(QUERIES["q9_lists_agree"](spark, SF))
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan
    for q in ("q8_parent_precedes_child", "q9_lists_agree", "q14_permutation_validity", "q1_rule_runner"):
        assert spark_rows(QUERIES[q](spark, SF)) == sql_rows(ORACLE_SQL[q], SF)


def test_points_meet_regions_in_ranges(spark) -> None:
    """no join of points with regions, whatever is small on disk."""
    regions = [(None if k == 3 else k, s, s + n, s * 10 + k) for k in range(4) for s, n in ((0, 3), (3, 1), (10, 0), (10, 500), (900, 1))]
    points = [(i, None if i % 5 == 3 else i % 5, None if i % 50 == 7 else i / 2 - 5) for i in range(2000)]
    made = spark.createDataFrame(regions, "k int, start long, end long, row long")
    asked = spark.createDataFrame(points, "i long, k long, p double")
    want = {(i, k, p): next((v for kk, s, e, v in regions if p is not None and kk == k and s <= math.floor(p) < e), -1) for i, k, p in points}
    for parts in (1, 3, 40):
        found = intervals.value_at(asked, made, ["k"], "p", default=-1, parts=parts)
        assert {(r.i, r.k, r.p): r.row for r in found.collect()} == want and found.columns == ["i", "k", "p", "row"]
    assert "Generate" not in plan_of(found) and "SortMergeJoin" not in plan_of(found)


def test_writes_are_swept_once(spark, monkeypatch) -> None:
    """the log is made once, and swept once in tasks by rows."""
    monkeypatch.setattr(scan, "RANGE_ROWS", 1000)
    made = []
    monkeypatch.setattr(intervals, "stored", lambda df, name: (made.append((name, plan_of(df))), stored(df, name))[1])
    out = QUERIES["w5_overwrite_intervals"](spark, SF)
    assert [name for name, _ in made] == ["writes", "swept"] and "MapInArrow" not in plan_of(out) and "REPARTITION_BY_NUM" in made[1][1]
    assert spark_rows(out) == sql_rows(ORACLE_SQL["w5_overwrite_intervals"], SF)


def test_marks_are_dropped_with_what_was_parsed(spark) -> None:
    """Of what the parse stores, only counts and digests stand beside the rounds."""
    before = set(shared._made)
    substring_dedup.repeated_passages(spark.read.parquet(f"{SF}/documents.parquet"))
    assert not [p for p in shared._made if p not in before and "marks" in spark.read.parquet(p).columns]


def test_shuffle_files_go_with_the_write_that_made_them(spark) -> None:
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files() -> set[str]:
        found = disk.getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = files(), spark.conf.get(setting)
    ids = spark.range(20_000)
    summed = stored(ids.groupBy((F.col("id") % 1000).alias("k")).agg(F.sum("id").alias("s")))
    joined = stored(ids.repartition(3, "id").join(spark.range(5_000).hint("merge"), "id"))
    left, until = files() - before, time.monotonic() + 5
    while left and time.monotonic() < until:  # Spark deletes them in the background
        time.sleep(0.1)
        left = files() - before
    assert not left
    assert summed.count() == 1000 and joined.count() == 5_000
    with pytest.raises(Exception, match="stop here"):
        stored(ids.select(F.raise_error(F.lit("stop here")).cast("long").alias("x")))
    assert spark.conf.get(setting) == was
    shared.discard(summed, joined)
