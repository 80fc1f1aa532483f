"""Each stage of the pipeline judged on its own input by brute force."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline
from test_llm import SPACE, leaks, near_truth

from bitloom.llm.common import stored

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages(spark) -> None:
    given = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        given = stored(stage(spark, given, SF), name.replace(" ", "-"))
        kept.append(given)
    first, near, cut, clean, packed = kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r[0] for r in rows(first)}
    marks = [labels[i] == (i in ids) for i in labels]
    assert sum(marks) / len(marks) > 0.95
    assert {i for i, _ in rows(near)} == {c for _, _, c in near_truth(rows(first))}
    seen: dict[tuple, int] = {}
    want = {}
    for i, text in rows(near):
        w = SPACE.findall(text or "")
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if seen.setdefault(tuple(w[p : p + 50]), i) < i:
                gone[p : p + 50] = [True] * 50
        if not w or not all(gone):
            want[i] = [a for a, b in zip(w, gone, strict=True) if not b]
    assert {i: SPACE.findall(t or "") for i, t in rows(cut)} == want
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {i: n - hit for i, n, hit, _ in leaks(rows(cut), items)}
    after = leaks(rows(clean), items)
    assert all(n == before[i] for i, n, _, _ in after) and sum(hit for _, _, hit, _ in after) == 0
    assert all(before[i] == 0 for i in before.keys() - {r[0] for r in after})
    assert {r.doc_id for r in packed.collect()} == {i for i, _ in rows(clean)}
    assert all(f.columns == COLUMNS for f in kept[:-1])
    assert all(r.n_chars == len(r.text) for r in clean.collect())


def test_stages_on_awkward_tables(spark, tmp_path) -> None:
    """Empty tables, null and repeated rows, null ids and clashing columns pass every stage."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, ref string, spans string, component string, y string, quality_score double, k int"
    long = " ".join(f"w{i % 37}" for i in range(400))
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (4, long), (5, long + " end"), (None, long), (None, None), (6, "x"), (7, "plain words of a short text that is kept")]
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").coalesce(1).write.parquet(f"file://{tmp_path}/{name}.parquet")
    for given in (spark.createDataFrame([], kind), spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "r", "s", "c", "y", 0.5, 1) for i, t in rows], kind)):
        n = given.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, given, f"file://{tmp_path}"), name.replace(" ", "-"))
            if name == "packing":
                assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in given.collect()}
                break
            assert out.columns == given.columns and out.count() <= n
            if name != "quality classifier":
                given = out
        if n:
            ids = [r.doc_id for r in given.collect()]
            assert {None, 1, 2, 3, 6, 7} <= set(ids) and 5 not in ids
