"""What the fourth round of findings asked for."""

from __future__ import annotations

import random

from oracle import TABLES, spark_rows, sql_rows
from pyspark.sql import functions as F

from bitloom.operators import decode
from bitloom.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def tables_with(path, **changed) -> str:
    """The smallest tables with some of them replaced."""
    for t in TABLES:
        if t not in changed:
            (path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
            continue
        changed[t].coalesce(1).write.parquet(str(path / "t" / t))
        (part,) = (path / "t" / t).glob("*.parquet")
        part.rename(path / f"{t}.parquet")
    return str(path)


def test_checksum_of_empty_texts(spark, tmp_path) -> None:
    """an empty text has a row, a missing one has none."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    k = F.col("doc_id")
    d = tables_with(tmp_path, documents=docs.withColumn("text", F.when(k % 10 == 3, "").when(k % 10 != 4, F.col("text"))))
    for name, rows in (("a8_modular_checksum", 180), ("a8_stored_checksum", 160)):
        got = spark_rows(QUERIES[name](spark, d))
        assert got == sql_rows(ORACLE_SQL[name], d)
        assert len(got[1]) == rows


def test_walks_find_what_the_readers_read() -> None:
    """at every place, however long, and with references that only some of the streams over them can hold."""
    rnd = random.Random(4)
    runs = [bytes([c]) for c in b"\xff\x7f\x80\x81\x83\x01\x02\x00\x41\xc8"]
    kinds = {
        "sized-lz": [b"\x10\x30\x00\x00", b"\x1f\x90\x00\x00", b"\x10\x05\x00\x00", b"\x00", b"\x00\x00", b"\x01", b"\x02", b"\x08", b"\x20\x09", b"\x41"],
        "ring-lz": [b"\x30\x00\x00\x00", b"\x00", b"\x00", b"\x01", b"\x03", b"\x09", b"\x28", b"\xc8", b"\xff", b"\x7f", b"\xf0"], "fill-rle": runs, "address-rle": runs,
    }
    for name, pieces in kinds.items():
        longest = 0
        for n in (*range(60), 300, 400, 500):
            blob = b"".join(rnd.choices(pieces, k=n)) + (b"\xff" if n > 60 else b"")
            read = [(at, used, len(out)) for at in range(len(blob)) for out, used, done in [decode.READERS[name](blob[at:])] if done and out]
            assert list(decode.WALKS[name](blob))[::-1] == read
            assert decode.SCANS[name](blob, 20) == [hit for hit in read if hit[1] <= 20]
            longest = max([longest, *(used for _, used, _ in read)])
        assert longest > 20


def test_streams_of_any_length_are_found(spark) -> None:
    """a structure is found however long it is, at its place in a blob of any length."""
    n = 200_000
    flags = b"\x00" + b"abcdefgh"
    streams = [
        ("sized-lz", b"\x10" + n.to_bytes(3, "little") + flags * (n // 8), n), ("ring-lz", n.to_bytes(4, "little") + b"\xff" + (b"abcdefgh" + b"\xff") * (n // 8 - 1) + b"abcdefgh", n),
        ("fill-rle", b"\x80" + b"z" * 256 + b"\xfe" + b"y" * 126 + b"\x01a" * 9000 + b"\xff", 256 + 126 + 9000), ("address-rle", b"\x7f\x00\x00" + b"\x01a" * 9000 + b"\xff", 9000),
    ]
    blobs = spark.createDataFrame([(i, b"A" * 70_001 + s) for i, (_, s, _) in enumerate(streams)], "k int, blob binary")
    found = {(r.k, r.codec, r.offset, r.consumed, r.size) for r in decode.find_structures(blobs, "k", "blob", list(decode.READERS)).where("offset = 70001").collect()}
    assert {(i, name, 70_001, len(s), size) for i, (name, s, size) in enumerate(streams)} <= found
    assert decode.find_structures(blobs, "k", "blob", list(decode.READERS), 4096).where("consumed > 4096").count() == 0


def test_every_reader_gives_every_hit(spark, tmp_path) -> None:
    """hits outside the planted places and those of the fourth reader, on texts that hold heads of streams themselves."""
    rnd = random.Random(5)
    letters = [*"\x00\x00\x01\x02\x03\x10\x11\x1f\x7f@A \x80\xe9", "\u20ac"]
    rows = [(k, "".join(rnd.choices(letters[6 if k % 3 else 0 :], k=rnd.choice([0, 1, 3, 4, 40, 200]))) if k % 97 else None) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    d = tables_with(tmp_path, documents=docs)
    got = spark_rows(QUERIES["u3_every_reader"](spark, d))
    assert got == sql_rows(ORACLE_SQL["u3_every_reader"], d)
    at = {c: [r[got[0].index("codec")] for r in got[1]].count(c) for c in decode.READERS}
    planted = {"sized-lz": 80, "ring-lz": 80, "address-rle": 16, "fill-rle": 0}
    assert all(at[c] > planted[c] for c in at)
