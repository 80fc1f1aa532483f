"""Each operator against brute force, a round trip or held-out accuracy, and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bitloom.llm import decontaminate, language_id, media, near_dedup, packing, quality, substring_dedup, token_counts, toxicity, url_filters
from bitloom.llm.components import components

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}
EDGE = [None, "", " \n\t ", "one", "a b c d", "É è x " * 30, "word " * 400, "\x00 \x1f\x85", "😀 \U00020000 <|endoftext|> '", "x" * 5000]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int, n: int = 120) -> list[tuple]:
    """Random texts with copies, near copies, shared passages, repeated lines and awkward rows."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choices(string.ascii_letters, k=rnd.randint(1, 6))) for _ in range(60)]
    passages = [" ".join(rnd.choices(words, k=70)) for _ in range(4)]
    out: list[tuple] = [(i, t, None, None, None) for i, t in enumerate(EDGE)]
    texts: list[str] = []
    for i in range(len(EDGE), n):
        kind = rnd.random()
        if texts and kind < 0.15:
            text = rnd.choice(texts)
        elif texts and kind < 0.45:
            w = rnd.choice(texts).split(" ")
            for _ in range(rnd.randint(1, 1 + len(w) // 25)):
                w[rnd.randrange(len(w))] = "edit" + str(rnd.randrange(10**6))
            text = " ".join(w)
        else:
            text = " ".join(rnd.choices(words, k=rnd.randint(1, 150))) + rnd.choice([" ", "\n", "  "]) + (rnd.choice(passages) if kind > 0.7 else "")
            text += "\n" + "same line over " * (40 if kind > 0.95 else 0)
        texts.append(text)
        out.append((rnd.choice([i, i * 1000]), text, "en", "s", len(text)))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(1), DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_substring_dedup(spark, docs) -> None:
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(docs, 50).collect()}
    seen: dict[tuple, int] = {}
    for doc_id, text, *_ in sorted(corpus(1), key=lambda r: r[0]):
        w = SPACE.findall(text or "")
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if seen.setdefault(tuple(w[p : p + 50]), doc_id) < doc_id:
                gone[p : p + 50] = [True] * 50
        kept = " ".join(a for a, b in zip(w, gone, strict=True) if not b)
        r = got[doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
        if r.kept_text is not None:
            assert " ".join(SPACE.findall(r.kept_text)) == kept


def test_sieve_symbols_are_local() -> None:
    """Inside a certificate the same symbols arise in any surroundings."""
    rnd = np.random.default_rng(3)
    core = rnd.integers(0, 5, 200).astype(np.uint64)
    seen = []
    for pad in (0, 1, 17):
        whole = np.concatenate([rnd.integers(0, 5, pad).astype(np.uint64), core, rnd.integers(0, 5, 9).astype(np.uint64)])
        s, count = substring_dedup.sieve_symbols(whole, np.array([0, len(whole)]))
        assert count.sum() == len(whole)
        seen.append({(int(n), int(b) - pad, int(e) - pad) for n, b, e in zip(s.name, s.begin, s.end, strict=True) if b >= pad and e <= pad + 200})
    assert seen[0] and seen[1] >= {s for s in seen[2] if s[1] > 0 and s[2] < 200} - {s for s in seen[2] if s not in seen[0]}
    assert len(seen[0] & seen[1] & seen[2]) > 20


def test_rounds_name_equal_stretches_alike_across_partitions(spark) -> None:
    """A passage of 120 words in five documents of four partitions: the same global names over the same words, and nothing else lives."""
    rnd = random.Random(8)
    passage = [f"p{i}" if i % 9 else "same" for i in range(60)] + ["a", "b"] * 15 + ["r"] * 30
    rows, at = [], {}
    for i in range(12):
        own = [f"d{i}w{k}" for k in range(rnd.randint(60, 90))]
        here = passage if i in (1, 4, 6, 7, 10) else []
        at[i] = len(own)
        rows.append((i, i, " ".join(own + here + [f"e{i}x{k}" for k in range(60)])))
    frame = spark.createDataFrame(rows, "doc_id long, ref long, text string").repartition(4)
    whole = frame.withColumn("alive", F.array(F.struct(F.lit(0).alias("first"), (F.size(F.split("text", " ")) - 50).alias("last"))))
    state = {r.doc_id: r for r in substring_dedup.recompress(whole, 50).collect()}
    assert set(state) == {1, 4, 6, 7, 10}
    every = [{(n, b - at[i], e - at[i]) for n, b, e in zip(r.names, r.begins, r.ends, strict=True) if n} for i, r in state.items()]
    made = [{x for x in m if x[1] >= 0 and x[2] <= len(passage)} for m in every]
    assert len(made[0]) > 1 and all(m == made[0] for m in made)
    assert max(n >> substring_dedup.ROUND_BITS for n, _, _ in made[0]) >= 3
    (a,) = state[1].alive  # a few windows at the edges live on: no named pair lies across the edge
    assert -15 <= a.first - at[1] <= 0 and 70 <= a.last - at[1] <= 85


def test_names_are_one_to_one(spark) -> None:
    asked = spark.createDataFrame([(1, 0, -5, -9), (2, 0, -5, -9), (3, 0, -5, -9), (1, 0, -9, -5), (4, 0, -9, -5), (1, 0, 7, 7), (1, 1, 7, 7)], "doc_id long, ref long, left long, right long")
    got = {(r.left, r.right): r.name for r in substring_dedup.names(asked.repartition(3), 2).collect()}
    assert set(got) == {(-5, -9), (-9, -5)} and len(set(got.values())) == 2 and all(v >> substring_dedup.ROUND_BITS == 2 for v in got.values())


def test_top_symbols_reach_spark(spark) -> None:
    rnd = random.Random(5)
    long = [" ".join(rnd.choices("abcdefgh", k=k)) for k in (120, 51, 300)]
    texts = ["", "x", long[0], None, long[1], long[0].replace(" ", "\n "), long[2] + " z", long[2], "x"]
    parsed = {r.doc_id: r for r in substring_dedup.parse(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), 50).collect()}
    alike = lambda i, j: parsed[i].top == parsed[j].top
    assert alike(0, 3) and alike(1, 8) and alike(2, 5) and len({r.top for r in parsed.values()}) == 6
    assert all(parsed[i].marks for i in (2, 4, 7)) and not parsed[0].marks


def test_very_long_and_periodic_texts_of_substring_dedup(spark) -> None:
    rnd = random.Random(6)
    long = " ".join(rnd.choices(["a", "b", "c", "dd"], k=60_000))
    piece = " ".join(long.split(" ")[20_000:20_090])
    rows = [(1, long), (2, "x " * 60 + piece + " y" * 60), (3, "la " * 30_000), (4, "z " + "la " * 70), (5, "ab cd " * 20_000), (6, "q ab " + "cd ab " * 40)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 90, 3: 0, 4: 70, 5: 0, 6: 81}


def test_awkward_rows_of_substring_dedup(spark, nothing) -> None:
    assert substring_dedup.repeated_passages(nothing).count() == 0
    long = " ".join(f"w{i}" for i in range(80))
    rows = spark.createDataFrame([(None, long, 1), (5, long, 2), (5, long, 2), (3, long, 3), (5, "short", 4)], "doc_id long, text string, ref int")
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring_dedup.repeated_passages(rows).collect())
    assert got == [(-1, 80, 0), (3, 80, 0), (5, 1, 0), (5, 80, 80), (5, 80, 80)]
    kept = sorted((r.doc_id or -1) for r in substring_dedup.without_passages(rows).collect())
    assert kept == [-1, 3, 5]


def leaks(docs_rows, items):
    grams: dict[tuple, set[str]] = {}
    for item, text in items:
        w = ALNUM.findall((text or "").translate(FOLD))
        for p in range(max(1, len(w) - 9) if w else 0):
            grams.setdefault(tuple(w[p : p + 10]), set()).add(str(item) if item is not None else "null")
    out = []
    for doc_id, text, *_ in docs_rows:
        w = ALNUM.findall((text or "").translate(FOLD))
        hit, names = [False] * len(w), set()
        for g, owners in grams.items():
            for p in range(len(w) - len(g) + 1):
                if tuple(w[p : p + len(g)]) == g:
                    hit[p : p + len(g)] = [True] * len(g)
                    names |= owners
        out.append((doc_id, len(w), sum(hit), sorted(names)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
def test_decontamination(spark, block_bytes) -> None:
    rows = corpus(2, 60)
    rnd = random.Random(5)
    items = [(i, " ".join((rnd.choice(rows[12:])[1]).split()[:25])) for i in range(6)] + [(7, "Same, LINE"), (8, None), (9, "?!"), (None, "over same line over same line over same line over same")]
    found = decontaminate.find_leaks(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).collect()
    got = sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), list(r["items"])) for r in found), key=str)
    assert got == leaks(rows, items)
    for r in found:
        w = ALNUM.findall((r.text or "").translate(FOLD))
        left = [x for i, x in enumerate(w) if not any(s.start <= i < s.end for s in r.spans)]
        assert r.clean_text is None if r.text is None else ALNUM.findall(r.clean_text.translate(FOLD)) == left


def test_a_benchmark_of_many_blocks_indexes_each_shard_once(spark, monkeypatch, nothing) -> None:
    calls = {"index_texts": 0, "search_index": 0}
    for name in calls:
        real = getattr(decontaminate, name)

        def counted(*args, name=name, real=real):
            calls[name] += 1
            return real(*args)

        monkeypatch.setattr(decontaminate, name, counted)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 200)
    rnd = random.Random(8)
    # one text makes up a third of the rows, and repeats of items fill no block of their own
    rows = [r[:2] for r in corpus(4, 60)] + [(1000 + i, " ".join(f"w{k}" for k in range(40))) for i in range(30)] + [(None, None), (2000, "")]
    items = [(i, " ".join((rnd.choice(rows[12:60])[1] or "x").split()[:25])) for i in range(8)] + [(90, " ".join(f"W{k}" for k in range(5, 18)))] * 5 + [(91, "w38 w39")]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(df, bench, block_bytes=200).collect()
    assert calls["index_texts"] == 1 and calls["search_index"] > 2
    assert sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), list(r["items"])) for r in found), key=str) == leaks(rows, items)
    assert all(r.clean_text.split() == [f"w{k}" for k in [*range(5), *range(18, 38)]] for r in found if r.doc_id and 1000 <= r.doc_id < 2000)
    assert decontaminate.find_leaks(nothing, bench, block_bytes=100).count() == 0
    wordless = spark.createDataFrame([(1, "?!" * 100), (2, "..." * 90)], bench.schema)
    assert decontaminate.find_leaks(df, wordless, block_bytes=50).where("size(spans) > 0 or size(items) > 0").count() == 0


def test_stored_index_is_the_index() -> None:
    rng = np.random.default_rng(3)
    text = rng.integers(1, 9, 3000)
    text[rng.choice(3000, 40, replace=False)] = 0
    text[-1] = 0
    made = decontaminate.FMIndex(text, 8)
    again = decontaminate.FMIndex.of_parts(made.parts(), 8)
    coded, last, sizes = rng.integers(1, 9, 200), np.arange(4, 200), np.full(196, 3)
    low, high = made.search(coded, last, sizes)
    assert all(np.array_equal(a, b) for a, b in zip((low, high), again.search(coded, last, sizes), strict=True)) and (high > low).any()
    assert np.array_equal(made.locate(np.arange(3000)), again.locate(np.arange(3000)))


def test_a_block_of_phrases_is_small(spark) -> None:
    import pickle

    rnd = random.Random(7)
    texts = [" ".join(rnd.choices(string.ascii_letters, k=40_000)), " ".join("".join(rnd.choices(string.ascii_lowercase, k=5)) for _ in range(40_000))]
    for text in texts:
        assert len(pickle.dumps(decontaminate.Phrases.of([(1, text), (2, text[:500])], 10))) <= 6 * len(text) + 2000


def test_decontamination_of_a_very_long_text(spark) -> None:
    rnd = random.Random(2)
    long = [f"w{rnd.randint(0, 400)}" for _ in range(120_000)]
    items = [(1, " ".join(long[70_000:70_030])), (2, " ".join(long[5:13]))]
    r = decontaminate.find_leaks(spark.createDataFrame([(1, " ".join(long))], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).first()
    assert (r.n_words, [tuple(s) for s in r.spans], list(r["items"])) == (120_000, [(5, 13), (70_000, 70_030)], ["1", "2"])


def test_benchmark_of_wordless_items(spark) -> None:
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for items in ([], [(1, None)], [(1, "?!")]):
        assert [list(r["items"]) for r in decontaminate.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()] == [[]]


def test_fm_index_finds_all_and_places_them() -> None:
    rnd = np.random.default_rng(1)
    text = rnd.integers(1, 4, 500)
    text[[99, 100, 300, 499]] = 0
    index = decontaminate.FMIndex(text, 3)
    for size in (1, 2, 5):
        phrases = rnd.integers(1, 4, (40, size))
        low, high = index.search(phrases.ravel(), np.arange(40) * size + size - 1, np.full(40, size))
        for p, a, b in zip(phrases, low, high, strict=True):
            want = [i for i in range(500 - size + 1) if (text[i : i + size] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_token_counts_at_every_prefix() -> None:
    counter = token_counts.PrefixCounter(token_counts.word_bpe_file())
    rnd = random.Random(4)
    texts = [t for t in EDGE if t] + ["it's they'll 're", "Σας ΣΑΣ İ", "日本語 ǅ ﷺ", *("".join(rnd.choices("ab 'stre\n!1é中lv<|>", k=rnd.randint(1, 50))) for _ in range(150))]
    count = lambda t: len(counter.tokenizer.encode(t, add_special_tokens=False).ids)
    for text, table in zip(texts, counter.count(texts), strict=True):
        assert (int(table[-1]) if len(table) else 0) == count(text)
        if token_counts.normal(text) == text and len(text) < 200:
            assert table.tolist() == [count(text[: k + 1]) for k in range(len(text))]


def test_token_count_rows_and_budget(spark, docs, nothing) -> None:
    kept = token_counts.prefix_token_counts(docs, token_counts.word_bpe_file(), limit=20)
    rows = token_counts.within_budget(kept, 5).collect()
    assert len(rows) == len(corpus(1))
    for r in rows:
        assert r.n_tokens == (r.prefix_counts[-1] if r.prefix_counts else 0) and r.over_limit == (r.n_tokens > 20)
        fits = [k + 1 for k, c in enumerate(r.prefix_counts) if c <= 5]
        assert r.budget_chars == (fits[-1] if fits else 0)
    assert token_counts.prefix_token_counts(nothing, token_counts.word_bpe_file()).count() == 0


def test_packing_round_trip(spark, docs, nothing) -> None:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.byte_bpe_file())
    pieces = packing.pack(docs, packing.byte_bpe_file(), seq_len=64).collect()
    by: dict[int, list] = {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
    for doc_id, text, *_ in corpus(1):
        mine = sorted(by[doc_id], key=lambda p: p.start)
        assert [i for p in mine for i in p.ids] == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert all(p.length & (p.length - 1) == 0 and p.length <= 64 and p.offset == 0 and p.bucket == p.length.bit_length() - 1 for p in mine)
        assert all(p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and p.doc_tokens == mine[-1].start + mine[-1].length for p in mine)
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    batches: dict[int, set[int]] = {}
    for p in pieces:
        batches.setdefault(p.batch_id, set()).add(p.bucket)
    assert all(len(b) == 1 for b in batches.values())
    assert packing.pack(nothing, packing.byte_bpe_file()).count() == 0


def test_one_text_with_more_pieces_than_the_pool_holds() -> None:
    from bitloom.llm.textscan import Pool, mix

    pool = Pool(most=6, bits=3)
    keys = mix(np.arange(1, 41, dtype=np.uint64))
    for part in np.split(keys, 4):
        pool.add(part, [np.array([k & 1023, 7], np.int32) for k in part.tolist()])
    assert pool.find(keys).tolist() == list(range(40)) and pool.find(mix(keys)).max() == -1
    assert pool.gather(np.array([35, 0]))[0].tolist() == [int(keys[35]) & 1023, 7, int(keys[0]) & 1023, 7]

    rnd = random.Random(9)
    texts = [" ".join(str(rnd.randrange(10**6)) for _ in range(200)), " ".join("".join(rnd.choices("abcdefgh", k=7)) for _ in range(200)), "few words here"]
    encoder, counter = packing.Encoder(packing.byte_bpe_file()), token_counts.PrefixCounter(token_counts.word_bpe_file())
    encoder.pool = Pool(most=48, bits=6)
    counter.pool = Pool(most=48, bits=6)
    # one call a text, as for texts that fill a chunk; the short text empties the grown table
    for text in texts:
        assert next(iter(encoder.encode([text]))).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert next(iter(counter.count([text])))[-1] == len(counter.tokenizer.encode(text, add_special_tokens=False).ids)
    assert encoder.pool.bits == counter.pool.bits == 6


def near_truth(rows):
    sets = {}
    for doc_id, text, *_ in rows:
        w = SPACE.findall((text or "").translate(FOLD))
        sets[doc_id] = {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def test_near_duplicates(spark, docs) -> None:
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect())
    assert got == near_truth(corpus(1))


def test_awkward_rows_of_near_duplicates(spark, nothing) -> None:
    assert near_dedup.near_duplicates(nothing).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "A B C D E F"), (9, None), (8, " ")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(rows).collect())
    assert got == [(-1, 2, None, None), (2, 2, 2, True), (4, 2, 2, False), (4, 2, 2, False), (8, 0, 8, True), (9, 0, 9, True)]


def test_collision_corrected_estimate() -> None:
    rnd = np.random.default_rng(6)
    errors = []
    for share in (0.5, 0.75, 0.9):
        for _ in range(20):
            both = rnd.integers(1 << 63, size=int(400 * share), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, rnd.integers(1 << 63, size=(400 - len(both)) // 2, dtype=np.uint64)])) for _ in range(2))
            x = near_dedup.signature(a)[3].view(np.uint64) ^ near_dedup.signature(b)[3].view(np.uint64)
            apart = sum(bin(int((v | v >> np.uint64(1)) & np.uint64(0x5555555555555555))).count("1") for v in x)
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(((near_dedup.HASHES - apart) / near_dedup.HASHES - 0.25) / 0.75 - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_rows_of_one_id_with_unlike_texts(spark) -> None:
    """A doc_id is linked with whatever any of its texts is linked with, in any partitioning."""
    rnd = random.Random(4)
    a, b = (rnd.choices(string.ascii_lowercase, k=80) for _ in range(2))
    text = lambda w, extra="": " ".join([*w, extra]).strip()
    rows = [(5, text(a)), (5, text(b)), (3, text(a, "more")), (7, text(b, "more")), (9, text(b)), (8, text(rnd.choices(string.digits, k=80)))]
    for order in (rows, rows[::-1]):
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(3)).collect()}
        assert got == {5: 3, 3: 3, 7: 3, 9: 3, 8: 8}


def test_template_bucket_of_unlike_texts(spark) -> None:
    """Texts that share a template but are no duplicates stay apart, and true links among them are found."""
    rnd = random.Random(14)
    template = [rnd.choice(string.ascii_lowercase) + str(i) for i in range(150)]
    rows = [(i, " ".join(template + [f"u{i}x{k}" for k in range(100)])) for i in range(150)]
    rows += [(1000 + i, rows[i * 3][1] + " tail end") for i in range(40)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == near_truth(rows)


def test_unlike_pages_of_a_template_send_no_pairs(spark, monkeypatch) -> None:
    """Pages of similarity 0.728, below the threshold, and a few above it: what leaves the squares grows with the pages, not their pairs."""
    template = [f"t{i}" for i in range(170)]
    pages = 400
    rows = [(i, " ".join(template + [f"u{i}x{k}" for k in range(31)])) for i in range(pages)]
    rows += [(1000 + i, " ".join(template + [f"u{i * 9}x{k}" for k in range(26)] + [f"v{i}x{k}" for k in range(5)])) for i in range(20)]
    sent = []
    whole = near_dedup.in_squares

    def counted(dealt, percent, exact):
        out = near_dedup.stored(whole(dealt, percent, exact))
        sent.append((exact, dealt.count(), out.count()))
        return out

    monkeypatch.setattr(near_dedup, "in_squares", counted)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == near_truth(rows)
    (_, dealt, likely), (_, full, links) = sent
    assert likely <= dealt <= near_dedup.BANDS * len(rows) and full <= dealt and links <= 20 * near_dedup.BANDS


def test_squares_find_every_link_that_joins(spark) -> None:
    """Squares of any size give links that join what all likely pairs would join, and no more links than that in one square."""
    rnd = np.random.default_rng(2)
    sets = []
    for i in range(60):
        base = np.random.default_rng(100 + i % 6).integers(1 << 62, size=120, dtype=np.uint64)
        base[: int(rnd.integers(0, 14))] = rnd.integers(1 << 62, size=1, dtype=np.uint64)
        sets.append(np.unique(base))
    fine = []
    for s in sets:
        low = (near_dedup._FINE_FACTOR * (s >> np.uint64(32)).astype(np.uint32) + near_dedup._FINE_OFFSET).min(axis=1)
        bits = (low * np.uint32(0x9E3779B1) >> np.uint32(31)).astype(np.uint64).reshape(near_dedup.FINE_LONGS, 64)
        fine.append(np.bitwise_or.reduce(bits << np.arange(64, dtype=np.uint64), axis=1).tobytes())
    # band 0 is shared by all, band 1 by all ids that 3 does not divide, the others by none
    bands = [[7, 8 if i % 3 else 1000 + i, *(10000 + 100 * i + k for k in range(near_dedup.BANDS - 2))] for i in range(60)]
    sketch = spark.createDataFrame([(i, len(s), fine[i], s.tobytes(), bands[i]) for i, s in enumerate(sets)], "cid long, n long, fine binary, shingles binary, bands array<long>")
    component = lambda i: 0 if i % 10 == 0 else i
    part = spark.createDataFrame([(key, i, component(i), 0) for key in (7, 8) for i in range(60) if key == 7 or i % 3], "key long, cid long, component long, main long")
    given = [(0, i) for i in range(0, 60, 10)]
    true = [(i, j) for i in range(60) for j in range(i) if 100 * near_dedup._shared(sets[i], sets[j]) >= 75 * len(np.union1d(sets[i], sets[j]))]

    def groups(edges):
        root = list(range(60))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in edges:
            x, y = sorted((find(x), find(y)))
            root[y] = x
        return [find(i) for i in range(60)]

    for square, shingles in ((2048, 1 << 21), (7, 1 << 21), (2048, 900)):
        links = [tuple(r) for r in near_dedup.links_in_buckets(part, sketch, 75, square, shingles).collect()]
        assert groups(given + links) == groups(given + true) and set(links) <= {p for x, y in true for p in ((x, y), (y, x))}
        if square == 2048 and shingles > 900:
            assert len(links) <= 60


def test_recall_of_bands_and_estimates_near_the_threshold() -> None:
    """Pairs of similarity 0.75 to 0.80: nearly all share a band, and no estimate rules them out."""
    rnd = np.random.default_rng(12)
    missed = n = 0
    for _ in range(400):
        union = rnd.integers(1 << 63, size=int(rnd.integers(40, 400)) * 4, dtype=np.uint64)
        both = int(np.ceil(len(union) * rnd.uniform(0.75, 0.80)))
        half = (len(union) - both) // 2
        p, q = np.sort(union[: both + half]), np.sort(np.concatenate([union[:both], union[both + half :]]))
        assert 100 * near_dedup._shared(p, q) >= 75 * len(union)
        (_, _, ka, pa_), (_, _, kb, pb) = near_dedup.signature(p), near_dedup.signature(q)
        x = pa_.view(np.uint64) ^ pb.view(np.uint64)
        apart = int(np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum())
        close = ((near_dedup.HASHES - apart) / near_dedup.HASHES - 0.25) / 0.75 >= 0.75 - near_dedup.MARGIN
        missed += not (np.any(ka == kb) and close)
        n += 1
    assert n == 400 and missed <= 2


def test_components_of_long_paths(spark) -> None:
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == got[100] == 100
    assert components(edges.where("a < 0")).count() == 0


def test_media_round_trip(spark, docs, nothing) -> None:
    rows = {r.doc_id: r for r in media.text_media(docs).collect()}
    for doc_id, text, *_ in corpus(1):
        raw, r = (text or "").encode(), rows[doc_id]
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert media.samples(bytes(r.media)) == payload and r.n_bytes == len(raw) and r.payload_bytes == len(payload)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
    assert media.text_media(nothing).count() == 0


def png() -> bytes:
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_sniffing_carves_and_corrects(spark) -> None:
    gif = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0]) + b"\x2c" + bytes(9) + b"\x02\x02\x4c\x01\x00\x3b"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd" + b"data\xff\x00more" + b"\xff\xd9"
    broken = png()[:-1] + b"x"
    rows = [(1, png() + b"junk" + gif, "image/jpeg"), (2, b"xx" + jpeg + b"yy", None), (3, broken, "image/png"), (4, None, None), (5, b"", "text/plain"), (6, media.to_wave(b"abc"), "audio/wav")]
    got = {r.k: r for r in media.sniff_media(spark.createDataFrame(rows, "k int, content binary, declared string"), "content", "declared").collect()}
    assert got[1].true_type == "image/png" and got[1].corrected and [(c.type, c.offset, c.length) for c in got[1].carved] == [("image/png", 0, len(png())), ("image/gif", len(png()) + 4, len(gif))]
    assert [(c.type, c.offset, bytes(c.content)) for c in got[2].carved] == [("image/jpeg", 2, jpeg)]
    assert not got[3].carved and got[3].corrected and not got[4].carved and not got[5].carved
    assert got[6].true_type == "audio/wav" and not got[6].corrected


def plain_gif(b: bytes, at: int) -> int:
    """The GIF at a place, walked without any memory."""
    if at + 13 > len(b):
        return 0
    i = at + 13 + (3 * 2 ** ((b[at + 10] & 7) + 1) if b[at + 10] >= 128 else 0)
    while i < len(b):
        if b[i] == 0x3B:
            return i + 1 - at
        if b[i] == 0x21:
            i += 2
        elif b[i] == 0x2C and i + 10 < len(b):
            i += 11 + (3 * 2 ** ((b[i + 9] & 7) + 1) if b[i + 9] >= 128 else 0)
        else:
            return 0
        while i < len(b) and b[i]:
            i += b[i] + 1
        i += 1
    return 0


def test_sniffing_is_linear_and_right_on_many_headers() -> None:
    import time

    rnd = random.Random(3)
    for _ in range(300):
        parts = [b"GIF89a" + bytes(rnd.choices([0, 1, 2, 0x21, 0x2C, 0x3B, 0x80], k=rnd.randint(5, 30))) for _ in range(rnd.randint(1, 8))]
        blob = b"".join(parts)
        got = {f.offset: f.length for f in media.sniff(blob, media.automaton(), nested=True) if f.kind == "image/gif"}
        want = {i: plain_gif(blob, i) for i in range(len(blob)) if blob.startswith(b"GIF89a", i)}
        assert got == {i: n for i, n in want.items() if n}
    hostile = [b"GIF89a" + bytes(7) + b"!\x01\x01\x01", b"\xff\xd8\xff\xda\0\2\xff\0", b"OggS\0\2" + bytes(20) + b"\1\x01"]
    for unit in hostile:
        begun = time.time()
        media.sniff(unit * (20_000_000 // len(unit)), media.automaton(), nested=True)
        assert time.time() - begun < 150, unit


def plain_riff(b: bytes, at: int) -> int:
    size = int.from_bytes(b[at + 4 : at + 8], "little") + 8
    i, names = at + 12, set()
    if at + size > len(b) or b[at + 8 : at + 12] not in (b"WAVE", b"WEBP"):
        return 0
    while i + 8 <= at + size:
        n = int.from_bytes(b[i + 4 : i + 8], "little")
        names.add(b[i : i + 4])
        i += 8 + n + n % 2
    good = i == at + size and names and (b[at + 8 : at + 12] == b"WEBP" or {b"fmt ", b"data"} <= names)
    return size if good else 0


def test_riff_headers_that_share_chunks() -> None:
    """The forest of chunks agrees with a walk for each header."""
    rnd = random.Random(8)
    for _ in range(400):
        heads, parts = rnd.randint(1, 6), []
        for _ in range(rnd.randint(0, 12)):
            n = rnd.randint(0, 5)
            parts.append(rnd.choice([b"fmt ", b"data", b"junk"]) + n.to_bytes(4, "little") + bytes(n + n % 2))
        tail = b"".join(parts)
        cuts = [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
        blob = b""
        for h in range(heads):
            rest = 20 * (heads - h - 1)
            size = 12 + rest + rnd.choice(cuts) + rnd.choice([0, 0, 0, 2])
            blob += b"RIFF" + size.to_bytes(4, "little") + rnd.choice([b"WAVE", b"WEBP"]) + b"junk" + (rest + rnd.choice(cuts[:2])).to_bytes(4, "little")
        blob += tail
        got = {f.offset: f.length for f in media.sniff(blob, media.automaton(), nested=True) if f.kind in ("audio/wav", "image/webp")}
        want = {i: plain_riff(blob, i) for i in range(len(blob)) if blob.startswith(b"RIFF", i)}
        assert got == {i: n for i, n in want.items() if n}


def test_sums_of_ranges_from_sums_of_beginnings() -> None:
    blob = random.Random(9).randbytes(700_000)
    seen = media.Seen(len(blob))
    seen.summed = 5 * len(blob)
    for a, b in ((0, len(blob)), (1, 70_000), (4096, 8192 + (1 << 16)), (12_345, 654_321)):
        assert seen.crc(blob, a, b) == zlib.crc32(blob[a:b])
    assert seen.sums is not None


def test_png_headers_that_share_an_end() -> None:
    chunk = lambda name, body: len(body).to_bytes(4, "big") + name + body + zlib.crc32(name + body).to_bytes(4, "big")
    magic, end = b"\x89PNG\r\n\x1a\n", chunk(b"IEND", b"")
    one = magic + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", b"inner") + end
    outer = magic + chunk(b"IHDR", bytes(13)) + chunk(b"tEXt", one[:-12]) + end
    broken = magic + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", b"x")[:-1] + b"?" + end
    blob = outer + broken + one
    got = [(f.offset, f.length) for f in media.sniff(blob, media.automaton(), nested=True)]
    inner = outer.index(magic, 1)
    assert got == [(0, len(outer)), (len(outer) + len(broken), len(one))] and inner > 0
    # an end that two headers lead to, the second one from within a chunk of the first
    shared = magic + chunk(b"IHDR", bytes(13)) + chunk(b"tEXt", b"ab" + one[:33]) + chunk(b"IDAT", b"y") + end
    assert [(f.offset, f.length) for f in media.sniff(shared, media.automaton(), nested=True)] == [(0, len(shared))]


@pytest.mark.parametrize("kind", ["riff", "png"])
def test_riff_and_png_are_linear_in_headers(kind) -> None:
    """Twenty megabytes of headers that all lead into the same chunks."""
    import time

    if kind == "riff":
        n = 20_000_000 // 28
        heads = b"".join(b"RIFF" + (28 * n - 20 * i - 8).to_bytes(4, "little") + b"WAVEjunk" + (20 * (n - i - 1)).to_bytes(4, "little") for i in range(n))
        blob, found = heads + b"abcd\0\0\0\0" * n, 0
    else:
        head = b"IHDR" + bytes(13)
        unit = b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4, "big") + head + zlib.crc32(head).to_bytes(4, "big")
        n = 20_000_000 // 45
        blob, found = b"".join(unit + (45 * (n - i - 1)).to_bytes(4, "big") + b"IDAT" + b"\0\0\0\0" for i in range(n)), 0
    begun = time.time()
    assert len(media.sniff(blob, media.automaton(), nested=True)) == found
    assert time.time() - begun < 150



def test_very_long_and_hostile_text_as_media(spark) -> None:
    texts = ["GIF89a!" * 60_000, "x" * 3_000_000, "RIFF WAVE BM OggS " * 1000]
    got = {r.doc_id: r for r in media.text_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep_media=False).collect()}
    for i, t in enumerate(texts):
        payload = t.encode() + bytes(-len(t) % 64)
        assert got[i].payload_sha256 == hashlib.sha256(payload).hexdigest() and got[i].true_type == "audio/wav" and got[i].corrected


def test_language_of_texts(spark, nothing) -> None:
    rnd = random.Random(8)
    make = {"aa": ["lami", "sola", "nami", "rola"], "bb": ["krst", "vlks", "trnk", "zmrd"], "cc": ["übär", "größ", "schö", "wäss"]}
    rows = [(i, " ".join("".join(rnd.choices(make[lang], k=2)) for _ in range(20)), lang) for i, lang in enumerate(list(make) * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    protos = language_id.learn(df.where("doc_id < 60"), dims=512)
    got = {r.doc_id: r for r in language_id.predict(df, protos, dims=512).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows if i >= 60)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? 😀"), (4, "Lami SOLA")], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.predict(odd, protos, dims=512).orderBy("doc_id").collect()] == ["und", "und", "und", "aa"]
    assert language_id.learn(nothing) == {} and {r.lang_pred for r in language_id.predict(odd, {}).collect()} == {"und"}


def test_bundle_is_sum_of_bound_trigrams() -> None:
    made, letters = language_id.bundles(["ab1", "b"], 256, 3)
    vec = lambda c: language_id.letter_vectors(np.array([ord(c)]), 256, 3)[0].astype(int)
    tri = lambda s: np.roll(vec(s[0]), 2) * np.roll(vec(s[1]), 1) * vec(s[2])
    assert (made[0] == tri(" ab") + tri("ab ")).all() and (made[1] == tri(" b ")).all() and letters.tolist() == [2, 1]


def classified(spark, op, label):
    sf = "/root/testdata/sf0.1"
    p = op(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = p[p.held_out]
    y, rank = held[label].to_numpy(), held.score.rank().to_numpy()
    n1, n0 = y.sum(), (y == 0).sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0), (held.predicted == y).mean()


def test_quality_on_held_out_documents(spark) -> None:
    auc, accuracy = classified(spark, quality.op7_quality_classifier, "quality")
    assert auc > 0.98 and accuracy > 0.97


def test_toxicity_on_held_out_documents(spark) -> None:
    auc, accuracy = classified(spark, toxicity.op4_toxicity, "toxic")
    assert auc > 0.94 and accuracy > 0.95


def small_net(seed: int) -> toxicity.Net:
    rng = np.random.default_rng(seed)
    net = toxicity.Net.fresh(seed, language_id.as_matrix({}))
    net.filters = [f.astype(np.float64) for f in net.filters]
    net.bias = rng.normal(size=toxicity.N_POOLED) * 0.3
    net.out = rng.normal(size=toxicity.N_POOLED)
    net.shift = 0.2
    return net


def test_convolution_against_plain_loops() -> None:
    net, rng = small_net(3), np.random.default_rng(4)
    sizes = [0, 1, 3, 0, 40, 300]
    offs = np.concatenate([[0], np.cumsum(sizes)])
    vectors = rng.normal(size=(offs[-1], toxicity.DIMS))
    got = net.pooled(vectors, offs)
    for r, n in enumerate(sizes):
        v = vectors[offs[r] : offs[r + 1]]
        want = []
        for w, f in zip(toxicity.WIDTHS, net.filters, strict=True):
            if not n:
                want.append(np.zeros(toxicity.FILTERS))
            elif w in toxicity.PLACED:
                want.append(np.max([sum(v[i + p] @ f[p] for p in range(w) if i + p < n) for i in range(n)], axis=0))
            else:
                wide = min(w, n)
                want.append(np.max([v[i : i + wide].sum(axis=0) @ f[0] / np.sqrt(w) for i in range(n - wide + 1)], axis=0))
        assert np.allclose(got[r], np.concatenate(want))
    assert np.allclose(net.logits(got), [sum(max(a + b, 0) * o for a, b, o in zip(row, net.bias, net.out, strict=True)) + net.shift for row in got])


def test_gradients_against_differences() -> None:
    net, rng = small_net(5), np.random.default_rng(6)
    offs = np.array([0, 7, 7, 40, 320])
    vectors, y, weight = rng.normal(size=(320, toxicity.DIMS)), np.array([1.0, 0, 1, 0]), np.array([2.0, 1, 2, 1])
    loss, g_vectors, g_filters, g_bias, g_out, g_shift = toxicity.gradients(net, vectors, offs, y, weight)
    z = net.logits(net.pooled(vectors, offs))
    assert np.isclose(loss, np.mean(weight * -(y * np.log(1 / (1 + np.exp(-z))) + (1 - y) * np.log(1 / (1 + np.exp(z))))))
    for value, gradient in [(vectors, g_vectors), *zip(net.filters, g_filters, strict=True), (net.bias, g_bias), (net.out, g_out)]:
        for _ in range(6):
            at = tuple(int(rng.integers(n)) for n in value.shape)
            kept, ends = value[at], []
            for d in (1e-6, -1e-6):
                value[at] = kept + d
                ends.append(toxicity.gradients(net, vectors, offs, y, weight)[0])
            value[at] = kept
            assert np.isclose((ends[0] - ends[1]) / 2e-6, gradient[at], rtol=1e-3, atol=1e-6)
    net.shift += 1e-6
    assert np.isclose((toxicity.gradients(net, vectors, offs, y, weight)[0] - loss) / 1e-6, g_shift, rtol=1e-3, atol=1e-5)


def test_normal_equations_met_over_partitions(spark) -> None:
    """The weights from summed equations are those of one ridge regression over all rows."""
    rnd = random.Random(12)
    rows = [(i, " ".join(rnd.choices(["alpha", "beta!", "GAMMA", "d3lta", "eps,", "zz"], weights=[1 + 4 * (i % 2), 1, 1, 1 + 3 * (i % 3), 1, 1], k=30)), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int").repartition(5)
    model = quality.fit(df, n_features=24)
    fold = {r.doc_id: r.f for r in df.select("doc_id", F.expr("pmod(xxhash64(doc_id, 13), 5) = 0").alias("f")).collect()}
    stats = quality.statistics(pa.array([t for _, t, _ in rows]))
    assert np.allclose(model.centre, stats.mean(axis=0)) and np.allclose(model.scale, np.maximum(stats.std(axis=0), 1e-6))
    use = np.array([not fold[i] for i, _, _ in rows])
    x, y = model.features(stats[use]), np.array([v for _, _, v in rows])[use]
    assert np.allclose(model.weights, np.linalg.solve(x.T @ x + 1e-2 * np.eye(25), x.T @ y), rtol=1e-6, atol=1e-8)


def test_rare_language_is_learned(spark) -> None:
    rnd = random.Random(10)
    rows = [(i, " ".join("".join(rnd.choices(["lami", "sola"] if i else ["krst", "vlks"], k=2)) for _ in range(20)), "aa" if i else "zz") for i in range(300)]
    protos = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6))
    assert set(protos) == {"aa", "zz"}
    odd = spark.createDataFrame([(1, "krstvlks vlkskrst krstkrst")], "doc_id long, text string")
    assert language_id.predict(odd, protos).first().lang_pred == "zz"


def test_very_long_texts_of_classifiers(spark) -> None:
    long = "some word here, " * 200_000
    df = spark.createDataFrame([(1, long), (2, "BAD!! $$$ " * 3)], "doc_id long, text string")
    sample = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(["some word here,", "BAD!! $$$"] * 20)], "doc_id long, text string, y int")
    for scored, name in ((quality.score(df, quality.fit(sample)), "quality_score"), (toxicity.score(df, toxicity.fit(sample)), "toxic_score")):
        got = {r.doc_id: r[name] for r in scored.collect()}
        assert 0 <= got[1] < got[2] <= 1


def test_samples_keep_their_bounds(spark) -> None:
    from bitloom.llm.common import labelled_sample

    docs = spark.createDataFrame([(i, "x" * 100 if i else "y" * 100_000, "en") for i in range(2000)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, toxic int")
    drawn = lambda **bound: labelled_sample(docs, labels, "toxic", 5, 0, extra=("lang",), **bound)
    assert 1500 < drawn(max_rows=5000).count() < 1700 and 400 < drawn(max_rows=500).count() < 600
    small = drawn(max_rows=5000, max_bytes=50_000).agg(F.sum(F.length("text")), F.max(F.length("text"))).first()
    assert 40_000 < small[0] < 60_000 and small[1] == 100
    # one label of ten thousand, and one id with most of the rows
    rare = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2500 == 7).cast("int").alias("toxic"))
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("z" * 50).alias("text"), F.lit("en").alias("lang"))
    many = many.union(spark.range(30_000).select(F.lit(7), F.concat(F.lit("y" * 50), F.col("id").cast("string")), F.lit("en")))
    for bound in ({"max_rows": 800}, {"max_rows": 800, "max_bytes": 40_000}):
        got = labelled_sample(many, rare, "toxic", 5, 0, extra=("lang",), **bound).groupBy("y").agg(F.count_distinct("doc_id").alias("ids"), F.count("*").alias("rows")).collect()
        got = {r["y"]: (r["ids"], r["rows"]) for r in got}
        ids = [i for i in range(7, 20_000, 2500) if zlib.crc32(str(i).encode()) % 5]
        assert got[1][0] == len(ids) and 600 < got[0][0] < 1000
        assert "max_bytes" not in bound or got[1][1] == len(ids)
    none = labelled_sample(many.where("doc_id < 0"), rare, "toxic", 5, 0, max_rows=800, max_bytes=40_000)
    assert none.count() == 0 and labelled_sample(many, rare.where("toxic > 1"), "toxic", 5, 0, max_rows=800).count() == 0


def test_classifiers_on_awkward_rows(spark, nothing, docs) -> None:
    sample = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(["good words here", "BAD!! $$$", "fine text too", "%%% ###"] * 10)], "doc_id long, text string, y int")
    model, net = quality.fit(sample), toxicity.fit(sample)
    for scored, name in ((quality.score(docs, model), "quality_score"), (toxicity.score(docs, net), "toxic_score")):
        assert scored.where(f"{name} is null or {name} < 0 or {name} > 1").count() == 0 and scored.count() == len(corpus(1))
    assert toxicity.fit(sample.where("y = 1")) == 1.0 and toxicity.fit(sample.where("y > 5")) == 0.5
    flat = quality.fit(sample.where("y = 1"))
    assert quality.score(docs, flat).where("quality_score <> 1").count() == 0
    assert quality.score(nothing, flat).count() == 0 and toxicity.score(nothing, 0.5).count() == 0


def test_isotonic_blocks() -> None:
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 3, 1, 4]), np.array([4.0, 4, 4, 4]))
    assert x.tolist() == [1, 2.5, 4] and y.tolist() == [0, 0.5, 1]


def test_url_filters_on_awkward_rows(spark) -> None:
    day = lambda s: f"date '{s}'"
    captures = spark.sql(f"SELECT * FROM VALUES (1L, 'http://A.b.com:80/x/y', {day('2024-03-05')}), (2L, NULL, {day('2024-03-05')}), (3L, 'http://a.b.com/x', NULL), (4L, 'no host', {day('2024-03-05')}), (5L, 'http://a.b.com', {day('2024-05-01')}), (5L, 'http://a.b.com', {day('2024-05-01')}) AS t(capture_id, url, fetch_date)")
    entries = spark.sql(f"SELECT * FROM VALUES ('l', 'b.com', {day('2024-03-01')}, 'add', 'c1'), ('l', 'b.com', {day('2024-05-01')}, 'remove', 'c1'), ('m', 'a.b.com/x', {day('2024-01-01')}, 'add', 'c2'), ('allow', 'a.b.com', {day('2024-04-01')}, 'add', 'c3'), (NULL, 'b.com', {day('2024-01-01')}, 'add', 'c4'), ('l', 'b.com', {day('2024-03-01')}, 'other', 'c5') AS t(list, pattern, entry_date, action, category)")
    got = sorted((r.capture_id, r.n_active, r.categories, r.allowed, r.blocked) for r in url_filters.judge(captures, entries).collect())
    assert got == [(1, 2, "c1,c2", False, True), (2, 0, "", False, False), (3, 0, "", False, False), (4, 0, "", False, False), (5, 1, "c3", True, False), (5, 1, "c3", True, False)]
    assert url_filters.judge(captures.where("false"), entries).count() == 0
    assert url_filters.judge(captures, entries.where("false")).where("n_active > 0").count() == 0


def test_one_host_with_half_of_the_captures_and_clashing_columns(spark) -> None:
    """Against a plain loop over entries; the hot host has many segments and dates."""
    import datetime as dt

    rnd = random.Random(9)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    hosts = ["big.example.com"] * 40 + [f"h{i}.example.com" for i in range(20)] + [f"x{i}.org" for i in range(20)]
    captures = [(i, f"https://{rnd.choice(hosts)}/{rnd.choice('abcde')}{rnd.randint(0, 30)}/p", day(rnd.randint(0, 120)), "clash") for i in range(600)]
    names = ["com", "example.com", "big.example.com", "big.example.com/a1", "org", "x3.org", "h1.example.com/b2"]
    entries = list({(rnd.choice(["l", "m", "allow"]), n, day(rnd.randint(0, 120)), rnd.choice(["add", "add", "remove"]), f"c{rnd.randint(0, 3)}", "z") for n in names for _ in range(9)})
    logs: dict[tuple, dict] = {}
    for name, pattern, d, action, category, _ in entries:
        held = logs.setdefault((name, pattern), {})
        held[d] = max(held.get(d, ("", "")), (action, category))
    want = []
    for i, url, d, _ in captures:
        host, seg = url.split("/")[2:4]
        tails = [".".join(host.split(".")[k:]) for k in range(host.count(".") + 1)]
        active = []
        for (name, pattern), log in logs.items():
            if pattern in tails + [f"{t}/{seg}" for t in tails]:
                past = [e for e in sorted(log) if e <= d]
                if past and log[past[-1]][0] == "add":
                    active.append((name, log[past[-1]][1]))
        allowed = any(n == "allow" for n, _ in active)
        want.append((i, len(active), ",".join(sorted({c for _, c in active})), allowed, bool(active) and not allowed and any(n != "allow" for n, _ in active)))
    got = url_filters.judge(spark.createDataFrame(captures, "capture_id long, url string, fetch_date date, key string"), spark.createDataFrame(entries, "list string, pattern string, entry_date date, action string, category string, month string"))
    assert sorted((r.capture_id, r.n_active, r.categories, r.allowed, r.blocked) for r in got.collect()) == want


def test_clashing_and_extra_columns(spark, docs) -> None:
    wide = docs.select("*", *[F.lit("x").alias(c) for c in ("spans", "items", "n_words", "clean_text", "quality_score", "toxic_score", "k", "key", "cid", "id", "component", "ref", "owner")])
    bench = spark.createDataFrame([(1, "same line over same line over same line over same")], "item_id long, text string")
    n = len(corpus(1))
    for block_bytes in (4 << 20, 20):
        both = bench.union(spark.createDataFrame([(2, "a b c d e f g h i j k l")], bench.schema))
        found = decontaminate.find_leaks(wide, both, block_bytes=block_bytes)
        assert found.count() == n and found.where("size(spans) > 0").count() > 0 and found.columns[-4:] == ["n_words", "spans", "items", "clean_text"]
    assert near_dedup.near_duplicates(wide).count() == n and substring_dedup.repeated_passages(wide).count() == n
    assert substring_dedup.without_passages(wide).columns == wide.columns
    assert quality.score(wide, quality.fit(spark.createDataFrame([], "doc_id long, text string, y int"))).count() == n
    for out in (packing.pack(wide, packing.byte_bpe_file()), token_counts.prefix_token_counts(wide, token_counts.word_bpe_file()), media.text_media(wide)):
        assert out.select("doc_id").distinct().count() == n


def test_pieces_are_binary() -> None:
    assert packing.binary_lengths(2500, 1024) == [1024, 1024, 256, 128, 64, 4] and packing.binary_lengths(1, 1024) == [1]


def test_oracles(spark) -> None:
    from oracle import spark_rows, sql_rows

    from bitloom.llm.registry import ORACLE_SQL, QUERIES

    for name, sql in ORACLE_SQL.items():
        assert spark_rows(QUERIES[name](spark, "/root/testdata/sf0.001")) == sql_rows(sql, "/root/testdata/sf0.001"), name


def test_text_buffers_of_slices() -> None:
    from bitloom.llm.textscan import SPACES, text_buffer, words

    data, offs = text_buffer(pa.array(["a b", None, "", " c ", "d"]).slice(1))
    found = words(data, offs, SPACES, fold=False)
    assert np.diff(found.offs).tolist() == [0, 0, 1, 1]
