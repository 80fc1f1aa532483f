"""Near-duplicate detection by b-bit MinHash.

Documents with equal shingle sets form a class; classes are compared. A class has `HASHES` minima;
their bands make candidates, their low two bits, packed into five longs, estimate the similarity of
candidates: of m agreeing bit pairs, a quarter of the disagreeing minima agree by chance, so
J = (m / HASHES - 1/4) / (3/4). Candidates whose estimate is not far below the threshold are
confirmed on their full shingle sets; confirmed links make components.

A bucket of candidates never emits its pairs. First each member is compared with the least and
the greatest member of its buckets, and what is confirmed becomes a component. Then members outside
a bucket's main component are compared with the members of other components in that bucket, which
leaves out nothing but pairs that are already connected. This works on a finer sketch of 2,048
one-bit minima: a bucket is dealt out in squares of at most `SQUARE` members, or `SQUARE_SHINGLES`
shingles, on either side. A first pass compares a square's pairs by bit counts and names the members
that have a likely partner in it; a second one brings the full sets of these together, counts
likely pairs exactly within the task, and lets a link leave only if it joins two components there.
So no pass sends more rows than it was dealt, however many pairs lie just below the threshold.

Defined results: null, empty and blank texts have no shingles and link with nothing; a text of
fewer than five words is one shingle; a null doc_id is never linked (component null); rows that
share a doc_id are one document, linked with whatever any of its texts is linked with; ties go to
the least doc_id; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.common import discard, stored, table
from bitloom.llm.components import components
from bitloom.llm.textscan import SPACES, U64, join_hash, mix, slices, text_buffer, windows, words

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
LONGS = HASHES // 32
#: The estimate's standard deviation at 0.75 is 0.041; candidates within 3.6 of them are confirmed.
MARGIN = 0.15

_RNG = np.random.default_rng(20)
_FACTOR = (_RNG.integers(1 << 32, size=HASHES, dtype=np.uint32) | np.uint32(1))[:, None]
_OFFSET = _RNG.integers(1 << 32, size=HASHES, dtype=np.uint32)[:, None]


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offs = text_buffer(column)
    for a, b in slices(offs):
        found = words(data, offs[a : b + 1], SPACES, fold=True)
        joined = windows(found.hash, width)
        for first, last in zip(found.offs[:-1].tolist(), found.offs[1:].tolist(), strict=True):
            n = last - first
            if n >= width:
                yield np.unique(joined[first : last - width + 1])
            elif n:
                yield windows(found.hash[first:last], n) ^ mix(np.array([n], U64))
            else:
                yield np.zeros(0, U64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima of a shingle set, in blocks so that a long text needs no large matrix."""
    low = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    narrow = (shingles >> U64(32)).astype(np.uint32)
    for i in range(0, len(narrow), 4096):
        np.minimum(low, (_FACTOR * narrow[i : i + 4096] + _OFFSET).min(axis=1), out=low)
    return low


def signature(shingles: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(two sums that name the set, band keys, packed low bits)."""
    low = minima(shingles)
    key = np.arange(BANDS, dtype=U64)
    for r in range(ROWS):
        key = join_hash(key, low[r::ROWS].astype(U64))
    bits = (low * np.uint32(0x9E3779B1) >> np.uint32(30)).astype(U64).reshape(LONGS, 32)
    packed = np.bitwise_or.reduce(bits << (np.arange(32, dtype=U64) * U64(2)), axis=1)
    names = mix(shingles).sum(dtype=U64), mix(shingles ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64)
    return int(names[0].astype(np.int64)), int(names[1].astype(np.int64)), key.astype(np.int64), packed.astype(np.int64)


FINE_LONGS = 32
#: The fine estimate's standard deviation at 0.75 is 0.0146; pairs within 3.3 of them are confirmed.
FINE_MARGIN = 0.048
_FINE_FACTOR = (_RNG.integers(1 << 32, size=FINE_LONGS * 64, dtype=np.uint32) | np.uint32(1))[:, None]
_FINE_OFFSET = _RNG.integers(1 << 32, size=FINE_LONGS * 64, dtype=np.uint32)[:, None]


def fine_sketches(texts: DataFrame, width: int) -> DataFrame:
    """(cid, fine, shingles): one bit of each of 2,048 further minima and the full set, for the documents that need them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fine, whole, at = [], [], 0
            for i, shingles in enumerate(shingle_sets(b.column(1), width)):
                low = np.full(FINE_LONGS * 64, np.iinfo(np.uint32).max, np.uint32)
                narrow = (shingles >> U64(32)).astype(np.uint32)
                for x in range(0, len(narrow), 512):
                    np.minimum(low, (_FINE_FACTOR * narrow[x : x + 512] + _FINE_OFFSET).min(axis=1), out=low)
                bits = (low * np.uint32(0x9E3779B1) >> np.uint32(31)).astype(U64).reshape(FINE_LONGS, 64)
                fine.append(np.bitwise_or.reduce(bits << np.arange(64, dtype=U64), axis=1).tobytes())
                whole.append(shingles.tobytes())
                if sum(map(len, whole)) > 1 << 24 or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(fine)), pa.array(fine, pa.binary()), pa.array(whole, pa.binary())], names=["cid", "fine", "shingles"])
                    fine, whole, at = [], [], i + 1

    return texts.select("cid", "text").mapInArrow(run, "cid long, fine binary, shingles binary")


_SIGNED = "doc_id long, ref long, n_shingles long, set_a long, set_b long, bands array<long>, packed array<long>"


def signatures(docs: DataFrame, width: int = 5) -> DataFrame:
    """Signature row of each document, with a hash of its text; documents without shingles have null names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, set_a, set_b, bands, packed = [], [], [], [], []
            for s in shingle_sets(b.column(2), width):
                n.append(len(s))
                a, c, k, p = signature(s) if len(s) else (None, None, None, None)
                set_a.append(a)
                set_b.append(c)
                bands.append(k)
                packed.append(p)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(set_a, pa.int64()), pa.array(set_b, pa.int64()), pa.array(bands, longs), pa.array(packed, longs)],
                names=["doc_id", "ref", "n_shingles", "set_a", "set_b", "bands", "packed"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("ref"), "text").mapInArrow(run, _SIGNED)


def estimate(p: str, q: str) -> Column:
    """Collision-corrected similarity of two packed signatures."""
    pairs = F.lit(0x5555555555555555)
    apart = F.lit(0)
    for i in range(LONGS):
        x = F.col(p)[i].bitwiseXOR(F.col(q)[i])
        apart = apart + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(pairs))
    return ((HASHES - apart) / HASHES - 0.25) / 0.75


def _close(percent: int) -> Column:
    """Sizes allow the threshold and the estimate is not far below it; sides a and b carry n and packed."""
    sizes = (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
    return sizes & (estimate("a_packed", "b_packed") >= percent / 100 - MARGIN)


def _shared(p: np.ndarray, q: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(p) > len(q):
        p, q = q, p
    return int(np.count_nonzero(q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p)) if len(p) else 0


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = 75, width: int = 5, block: int = 128, block_shingles: int = 1 << 20) -> DataFrame:
    """Pairs (a, b) of (cluster, a, b) whose full shingle sets reach the threshold; texts: (cid, n, text).

    Pairs are dealt out in blocks: a task's key is a cluster and a block of its left and right
    documents, so a text travels once for each block it has pairs in, and whatever the cluster's
    size a key holds about `block` texts, or `block_shingles` shingles of them, on either side.
    """
    pairs = stored(pairs, "pairs")
    size = texts.select("cid", "n")
    side = lambda c: pairs.select("cluster", F.col(c).alias("cid")).distinct().join(size, "cid").groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / block_shingles)).alias(f"n{c}"))
    sized = stored(side("a").join(side("b"), "cluster"), "clusters")
    blocks = F.struct("cluster", F.pmod(F.xxhash64("a"), "na").alias("ka"), F.pmod(F.xxhash64("b"), "nb").alias("kb")).alias("k")
    keyed = stored(pairs.join(sized, "cluster").select(blocks, "a", "b").distinct(), "dealt")
    need = keyed.select("k", F.col("a").alias("cid")).union(keyed.select("k", F.col("b").alias("cid"))).distinct()
    given = need.join(texts, "cid").select("k", F.lit(0).alias("kind"), F.col("cid").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    rows = given.union(keyed.select("k", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("string").alias("text")))
    dealt = rows.repartition("k").sortWithinPartitions("k", "kind").select(F.xxhash64("k.cluster", "k.ka", "k.kb").alias("k"), "kind", "a", "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, {}
        for batch in batches:
            k, kind, a, b = (batch.column(i).to_pylist() for i in range(4))
            made = shingle_sets(batch.column(4), width)
            left, right = [], []
            for key, is_pair, x, y, shingles in zip(k, kind, a, b, made, strict=True):
                if key != now:
                    now, sets = key, {}
                if not is_pair:
                    sets[x] = shingles
                elif x in sets and y in sets:
                    p, q = sets[x], sets[y]
                    both = _shared(p, q)
                    if 100 * both >= percent * (len(p) + len(q) - both):
                        left.append(x)
                        right.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    links = stored(dealt.mapInArrow(run, "a long, b long"), "links")
    discard(pairs, sized, keyed)
    return links


#: Members and shingles on either side of a square, and pairs compared at once within a task.
SQUARE, SQUARE_SHINGLES, AT_ONCE = 2048, 1 << 21, 1 << 15
#: A member is at the left of its squares, at the right, or at both sides of a bucket's only square.
_LEFT, _RIGHT = 1, 2
_PLACE = "key long, ka long, kb long, cid long"


def dealt_squares(members: DataFrame, square: int = SQUARE, shingles: int = SQUARE_SHINGLES) -> DataFrame:
    """(key, ka, kb, side, cid, component, in_main, n): the squares that each member takes part in.

    members: (key, cid, component, main, n). Left are the members outside the main component of
    their bucket, right are all. A bucket of N members, M of them outside its main component, moves
    M * N / square rows.
    """
    blocks = lambda where: F.ceil(F.greatest(F.count_if(where) / square, F.sum(F.when(where, F.col("n"))) / shingles))
    size = stored(members.groupBy("key").agg(blocks(F.lit(True)).alias("nb"), blocks(F.col("component") != F.col("main")).alias("na")), "squares")
    row = members.select("key", "cid", "component", (F.col("component") == F.col("main")).alias("in_main"), "n").join(size, "key")
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    alone = (F.col("na") == 1) & (F.col("nb") == 1)
    left = row.where(~alone & ~F.col("in_main")).select("*", F.pmod(F.xxhash64("cid"), "na").alias("ka"), F.explode(every("nb")).alias("kb"), F.lit(_LEFT).alias("side"))
    role = F.when(alone & ~F.col("in_main"), _LEFT | _RIGHT).otherwise(_RIGHT).alias("side")
    right = row.select("*", F.explode(every("na")).alias("ka"), F.pmod(F.xxhash64("cid"), "nb").alias("kb"), role)
    return left.unionByName(right).select("key", "ka", "kb", "side", "cid", "component", "in_main", "n")


def _exact(i: np.ndarray, j: np.ndarray, flat: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets i and j; flat holds the elements of all sets by number, i ascends."""
    out = np.zeros(len(i), np.int64)
    mark = np.zeros(int(flat.max(initial=-1)) + 1, np.int8)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(i)) + 1, [len(i)]])
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = flat[offs[i[lo]] : offs[i[lo] + 1]]
        mark[own] = 1
        at, size = offs[j[lo:hi]], offs[j[lo:hi] + 1] - offs[j[lo:hi]]
        ends = np.cumsum(size)
        begins = ends - size
        both = mark[flat[np.arange(ends[-1]) + np.repeat(at - begins, size)]]
        out[lo:hi] = np.add.reduceat(both, begins, dtype=np.int64)
        mark[own] = 0
    return out


def in_squares(dealt: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Pairs of different components within squares, each pair in the first bucket that it shares.

    dealt: a row of dealt_squares() with fine and bands, and with the full set as shingles if exact.
    Without `exact`: (key, ka, kb, cid) of members with a likely partner there. With it: (a, b) of
    confirmed links, of which a task lets only those leave that join components it has not joined yet.
    """
    columns = ["k", "key", "ka", "kb", "side", "cid", "component", "in_main", "n", "fine", "bands", *(["shingles"] if exact else [])]
    rows = dealt.repartition("key", "ka", "kb").withColumn("k", F.xxhash64("key", "ka", "kb")).select(*columns).sortWithinPartitions("k")

    def compare(t: pa.Table) -> pa.RecordBatch:
        k, key, ka, kb, side, cid, component, in_main, n = (t.column(c).to_numpy() for c in range(9))
        fine = np.frombuffer(b"".join(t.column(9).to_pylist()), U64).reshape(-1, FINE_LONGS)
        bands = t.column(10).combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        band = np.argmax(bands == key[:, None], axis=1)
        part = np.unique(component, return_inverse=True)[1]
        left, right = np.flatnonzero(side & _LEFT), np.flatnonzero(side & _RIGHT)
        left, right = left[np.argsort(k[left], kind="stable")], right[np.argsort(k[right], kind="stable")]
        low, high = np.searchsorted(k[right], k[left], "left"), np.searchsorted(k[right], k[left], "right")
        count = high - low
        done = np.concatenate([[0], np.cumsum(count)])
        flat = offs = None
        likely = np.zeros(len(k), bool)
        links: list[tuple[int, int]] = []
        at = 0
        while at < len(left):
            stop = max(at + 1, int(np.searchsorted(done, done[at] + AT_ONCE, "right")) - 1)
            c = count[at:stop]
            i = np.repeat(left[at:stop], c)
            j = right[np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[at:stop], c)]
            at = stop
            apart = (part[i] != part[j]) & (in_main[j] | (cid[i] < cid[j])) & (key[i] == key[j])
            apart &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            i, j = i[apart], j[apart]
            for here in (x + np.arange(min(4096, len(i) - x)) for x in range(0, len(i), 4096)):
                p, q = i[here], j[here]
                # half of the disagreeing minima agree by chance
                near = 1 - 2 * np.bitwise_count(fine[p] ^ fine[q]).sum(axis=1, dtype=np.int64) / (FINE_LONGS * 64) >= percent / 100 - FINE_MARGIN
                p, q = p[near], q[near]
                first = np.argmax(bands[p] == bands[q], axis=1) == band[p]
                p, q = p[first], q[first]
                if not exact:
                    likely[p] = likely[q] = True
                    continue
                open_ = part[p] != part[q]  # an earlier block may have joined them
                p, q = p[open_], q[open_]
                if not len(p):
                    continue
                if flat is None:
                    sets = t.column(11)
                    offs = np.concatenate([[0], np.cumsum(pc.binary_length(sets).to_numpy() // 8)])
                    flat = np.unique(np.frombuffer(b"".join(sets.to_pylist()), U64), return_inverse=True)[1]
                order = np.argsort(p, kind="stable")
                p, q = p[order], q[order]
                both = _exact(p, q, flat, offs)
                linked = 100 * both >= percent * (n[p] + n[q] - both)
                for x, y in zip(p[linked].tolist(), q[linked].tolist(), strict=True):
                    if part[x] != part[y]:
                        part[part == part[y]] = part[x]
                        links.append((int(cid[x]), int(cid[y])))
        if exact:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])
        return pa.RecordBatch.from_arrays([pa.array(x[likely]) for x in (key, ka, kb, cid)], names=["key", "ka", "kb", "cid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            k = b.column(0).to_numpy()
            if not len(k):
                continue
            if held and k[-1] == held[0].column(0)[0].as_py():
                held.append(b)
                continue
            cut = int(np.searchsorted(k, k[-1]))  # the last square may go on in the next batch
            whole = pa.Table.from_batches([*held, b.slice(0, cut)])
            if whole.num_rows:
                yield compare(whole)
            held = [b.slice(cut)]
        if held:
            yield compare(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "a long, b long" if exact else _PLACE)


def links_in_buckets(part: DataFrame, sketch: DataFrame, percent: int, square: int = SQUARE, shingles: int = SQUARE_SHINGLES) -> DataFrame:
    """(a, b): links that join the components still apart in a bucket, at most one for each two components a square sees.

    part: (key, cid, component, main), see still_apart; sketch: (cid, n, fine, shingles, bands).
    """
    dealt = stored(dealt_squares(part.join(sketch.select("cid", "n"), "cid"), square, shingles), "dealt")
    light = sketch.select("cid", "fine", "bands")
    likely = stored(in_squares(dealt.join(light, "cid"), percent, exact=False).distinct(), "likely")
    full = dealt.join(likely, ["key", "ka", "kb", "cid"]).join(sketch.drop("n"), "cid")
    links = stored(in_squares(full, percent, exact=True).distinct(), "links")
    discard(dealt, likely)
    return links


def still_apart(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, cid, component, main): members of buckets in more than one component; main is the one most of a bucket is in."""
    placed = shared.select("key", F.col("cid").alias("id")).join(labels, "id", "left").select("key", F.col("id").alias("cid"), F.coalesce("component", "id").alias("component"))
    tally = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = tally.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    main = stored(main, "main")
    out = stored(placed.join(main, "key").select("key", "cid", "component", "main"), "apart")
    discard(main)
    return out


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs."""
    signed = stored(signatures(docs, width), "signatures")
    named = signed.where("set_a is not null and doc_id is not null")
    alike = named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("doc_id"), F.min_by("ref", "doc_id").alias("ref"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "packed")])
    # a class has an id of its own: rows of one doc_id may be of several classes
    classes = stored(alike.withColumnRenamed("n_shingles", "n").withColumn("cid", F.monotonically_increasing_id()), "classes")
    sketch = classes.select("cid", "n", "packed")
    keys = classes.select("cid", F.explode("bands").alias("key"))
    # written first, so that the join below shuffles both sides and a hot key can be split
    bucket = stored(keys.groupBy("key").agg(F.min("cid").alias("least"), F.max("cid").alias("greatest")).where("least < greatest"), "shared-keys")
    shared = stored(keys.join(bucket, "key").select("key", "cid", "least", "greatest"), "buckets")
    some = classes.select("cid", "doc_id", "ref", "n").join(shared.select("cid").distinct(), "cid")
    texts = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("ref"), "text").join(some, ["doc_id", "ref"]).select("cid", "n", "text").dropDuplicates(["cid"]), "texts")

    left = sketch.select(F.col("cid").alias("a"), F.col("n").alias("a_n"), F.col("packed").alias("a_packed"))
    right = sketch.select(F.col("cid").alias("b"), F.col("n").alias("b_n"), F.col("packed").alias("b_packed"))
    ends = shared.select(F.col("cid").alias("a"), F.col("least").alias("b")).union(shared.select(F.col("cid").alias("a"), F.col("greatest").alias("b"))).where("a <> b").distinct()
    likely = ends.join(left, "a").join(right, "b").where(_close(percent)).select("a", "b", (F.col("a") > F.col("b")).alias("down"), estimate("a_packed", "b_packed").alias("e"))
    best = likely.groupBy("a", "down").agg(F.max_by("b", F.struct("e", "b")).alias("b")).select(F.col("b").alias("cluster"), "a", "b")
    first = confirm(best, texts, percent, width)
    joined = components(first)
    part = still_apart(shared, joined)
    fine = stored(fine_sketches(texts.join(part.select("cid").distinct(), "cid"), width).join(classes.select("cid", "n", "bands"), "cid"), "sketches")
    second = links_in_buckets(part, fine, percent)

    rows = named.join(classes.select("set_a", "set_b", "cid"), ["set_a", "set_b"]).select("doc_id", "cid").distinct()
    several = rows.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a < b").select("doc_id", "a")
    one_doc = rows.join(several, "doc_id").select("a", F.col("cid").alias("b")).where("a < b")
    placed = components(first.union(second).union(one_doc))
    whole = classes.select("set_a", "set_b", "doc_id", "cid").join(placed.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = whole.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    label = whole.join(least, "component").select("set_a", "set_b", "component_id")
    own = signed.join(label, ["set_a", "set_b"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    out = stored(own.withColumn("kept", F.col("doc_id") == F.col("component_id")), "near-duplicates")
    discard(signed, classes, bucket, shared, texts, first, joined, part, fine, second, placed)
    return out


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS t FROM d UNION SELECT r.doc_id, u.y FROM r JOIN u ON u.x = r.t),
c AS (SELECT doc_id, min(t) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
