"""Near-duplicate join: MinHash candidates, Bayesian pruning, exact Jaccard.

Texts are sets of shingles: hashes (64 bits) of every five consecutive words, words being runs of
characters other than white space (0x20, 0x09-0x0D); a text of one to four words has one shingle of
all its words. Two texts are linked if the Jaccard similarity of their sets is at least the threshold.

1. Equal texts are one class (by digest); the rest works on classes.
2. Each class has MinHash values, cut to 16 bits; runs of four of these (bands) that agree make candidates. With 20
   bands a pair of similarity 0.8 is missed with probability (1 - 0.8**4)**20 = 2.7e-5, one of 0.9 with 5e-10.
3. Candidates meet in their band's bucket. Values are compared 16 at a time, and a
   pair goes when the posterior probability that its similarity reaches the threshold, given the agreements
   so far and a flat prior, is below the tolerance (1e-5). A pair that shares several bands counts in
   the first only. Large buckets are dealt out as pairs of blocks of bounded size, so no task gets an
   unbounded group; the comparisons are made in memory and no row is emitted for a pair.
4. Members that have a surviving pair meet again with their shingles, and survivors are verified
   exactly. What comes out has a row for each member: its number of linked documents, and
   an edge to a linked class that spans the links found there.
5. Connected components over those edges give each document its class.

Null or odd input: a null text has no shingle and isn't linked with anything, not even another null;
a text without words (empty, white space) is linked with equal texts only. Equal rows are copies of each
other. Documents without id take part; the class id is the smallest id of the component (null if it has
none). Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import U64, chunks, fresh, give_back, mix, partitions_for, run_hashes, stage_table, text_buffers, within, word_hashes, words
from millrace.llm.components import components

K, THRESHOLD, TOLERANCE = 5, 0.8, 1e-5
BANDS, ROWS, STEP = 20, 4, 16
#: A block of a bucket has about so many members at most, and so many bytes of shingles.
BLOCK_ROWS, BLOCK_BYTES = 1024, 12 << 20

_MULTIPLIERS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64) * U64(0xA24BAED4963EE407)) | U64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the rows end to end (repeats kept), and the n + 1 places where each row's start."""
    first, last, firsts = words(data, offsets)
    hashes = word_hashes(data, first, last)
    count = np.diff(firsts)
    if len(hashes) >= k:
        own = run_hashes(hashes, k)[within(firsts, k)]
    else:
        own = np.zeros(0, U64)
    sizes = np.maximum(count - k + 1, 0)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        at = np.concatenate([[0], np.cumsum(sizes)])[short]
        whole = np.array([run_hashes(hashes[firsts[r] : firsts[r + 1]], int(count[r]))[0] for r in short], U64)
        own = np.insert(own, at, mix(whole + count[short].astype(U64)))
        sizes[short] = 1
    return own, np.concatenate([[0], np.cumsum(sizes)])


def minhash(own: np.ndarray, places: np.ndarray) -> np.ndarray:
    """rows x values; rows without shingles have the largest value."""
    n = len(places) - 1
    out = np.full((n, BANDS * ROWS), U64(2**64 - 1))
    some = np.flatnonzero(np.diff(places) > 0)
    if len(some):
        heads = places[some]
        for a in range(0, len(some), 256):  # few rows at a time, so that they stay in the cache
            rows, to = some[a : a + 256], places[some[min(a + 256, len(some)) - 1] + 1]
            part, at = own[heads[a] : to], heads[a : a + 256] - heads[a]
            for j in range(BANDS * ROWS):
                out[rows, j] = np.minimum.reduceat(part * _MULTIPLIERS[j], at)
    return out


def signature(values: np.ndarray) -> np.ndarray:
    """16 bits of each MinHash value: what buckets are made from and pairs are compared by."""
    return (mix(values) >> U64(48)).astype("<u2")


def band_keys(sig: np.ndarray) -> np.ndarray:
    """rows x bands, with the band's number mixed in. Within a band, keys are equal exactly where its four signature values are."""
    out = np.zeros((len(sig), BANDS), U64)
    for j in range(ROWS):
        out = (out << U64(16)) | sig.reshape(len(sig), BANDS, ROWS)[:, :, j]
    return mix(out ^ (np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)))


@cache
def least_agreements(threshold: float, tolerance: float, n: int) -> int:
    """Fewest agreements of n for which P(similarity >= threshold | agreements) reaches the tolerance.

    With a flat prior the posterior is Beta(m + 1, n - m + 1), whose tail is a binomial sum.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def survivors(sig: np.ndarray, band: np.ndarray, p: np.ndarray, q: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs p, q (row numbers of sig) that aren't pruned and whose first common band is theirs.

    sig is what band_keys made the buckets from, so a common band here is a bucket in which the pair meets.
    """
    agree = np.zeros(len(p), np.int16)
    for a in range(0, BANDS * ROWS, STEP):
        for x in range(0, len(p), 1 << 16):
            y = slice(x, x + (1 << 16))
            same = sig[p[y], a : a + STEP] == sig[q[y], a : a + STEP]
            agree[y] += same.sum(1, dtype=np.int16)
        keep = agree >= least_agreements(threshold, tolerance, a + STEP)
        p, q, agree = p[keep], q[keep], agree[keep]
    first = np.zeros(len(p), np.int16)
    for x in range(0, len(p), 1 << 14):
        y = slice(x, x + (1 << 14))
        full = (sig[p[y]] == sig[q[y]]).reshape(-1, BANDS, ROWS).all(2)
        first[y] = full.argmax(1)
    own = first == band[p] if len(p) else np.zeros(0, bool)
    return p[own], q[own]


def _pairs_in(group: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a group, a bounded number at a time. group: sorted numbers; side: 0 both, 1 left, 2 right.

    In a pair of blocks (sides 1 and 2) only rows of different sides make pairs.
    """
    n = len(group)
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    size = np.diff(edges)
    small = np.repeat(size <= 64, size)
    for d in range(1, min(64, int(size.max(initial=0)))):
        p = np.flatnonzero(small[: n - d] & (group[: n - d] == group[d:]))
        if not len(p):
            break
        q = p + d
        ok = (side[p] == 0) | (side[p] != side[q])
        yield p[ok], q[ok]
    for g in np.flatnonzero(size > 64):
        rows = np.arange(edges[g], edges[g + 1])
        if side[rows[0]] == 0:
            for i in range(0, len(rows), 128):
                left = rows[i : i + 128]
                p, q = np.repeat(left, len(rows) - i), np.tile(rows[i:], len(left))
                yield p[p < q], q[p < q]
        else:
            left, right = rows[side[rows] == 1], rows[side[rows] == 2]
            for i in range(0, len(left), 128):
                if len(right):
                    yield np.repeat(left[i : i + 128], len(right)), np.tile(right, len(left[i : i + 128]))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of rows sorted by task, cut so that no task is split. A task is bounded."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        tasks = b.column("task").to_numpy(zero_copy_only=False)
        cut = len(tasks) - int(np.argmax(tasks[::-1] != tasks[-1])) if (tasks != tasks[-1]).any() else 0
        if held and held[-1].column("task")[-1].as_py() != tasks[0].item():
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column, kind, width: int) -> np.ndarray:
    data, _ = text_buffers(column)
    return np.frombuffer(data.tobytes(), kind).reshape(-1, width)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = text_buffers(b.column("text"))
        for x, y in chunks(offsets):
            part = data[offsets[x] : offsets[y]]
            at = offsets[x : y + 1] - offsets[x]
            own, places = shingles(part, at)
            values = minhash(own, places)
            sig = signature(values)
            keys = band_keys(sig).astype(np.int64)
            rows = y - x
            digest = [hashlib.md5(part[at[i] : at[i + 1]]).digest() for i in range(rows)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(x, rows), pa.array(digest, pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary()), lists, pa.array(np.diff(places), pa.int64())],
                names=["doc_id", "digest", "sig", "bands", "n_sh"],
            )
    give_back()


def _flag(threshold: float, tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            task, side, band = (t.column(c).to_numpy() for c in ("task", "side", "band"))
            sig = _matrix(t.column("sig"), "<u2", BANDS * ROWS)
            hit = np.zeros(len(t), bool)
            for p, q in _pairs_in(task, side):
                p, q = survivors(sig, band, p, q, threshold, tolerance)
                hit[p] = hit[q] = True
            if hit.any():
                mine = t.filter(pa.array(hit)).select(["task", "side", "band", "node"]).combine_chunks()
                yield from mine.to_batches(max_chunksize=8192)

    return run


def _overlaps(sets: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets."""
    used = np.unique(np.concatenate([p, q]))
    if len(p) <= 4 * len(used) or len(used) < 64:
        out = np.zeros(len(p), np.int64)
        for i, (a, b) in enumerate(zip(p.tolist(), q.tolist())):
            x, y = sets[a], sets[b]
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            out[i] = int((y[at] == x).sum())
        return out
    # many pairs among few sets: products of blocks of the sets' incidence matrix, counted in whole floats
    size = np.array([len(sets[i]) for i in used])
    values, back, often = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(used)), size)
    shared = often[back] > 1
    number = (np.cumsum(often > 1) - 1)[back]
    row, number = row[shared], number[shared]
    order = np.argsort(number, kind="stable")
    row, number = row[order], number[order]
    at_p, at_q = np.searchsorted(used, p), np.searchsorted(used, q)
    total = np.zeros((len(used), len(used)), np.float32)
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, 2048):
        x, y = np.searchsorted(number, [a, a + 2048])
        block = np.zeros((len(used), 2048), np.float32)
        block[row[x:y], number[x:y] - a] = 1
        total += block @ block.T
    return total[at_p, at_q].astype(np.int64)


def _verify(threshold: float, tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            task, side, band, node, weight = (t.column(c).to_numpy() for c in ("task", "side", "band", "node", "n"))
            sig = _matrix(t.column("sig"), "<u2", BANDS * ROWS)
            data, at = text_buffers(t.column("shingles"))
            flat = np.frombuffer(data.tobytes(), "<u8")
            sets = [flat[x // 8 : y // 8] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            size = np.array([len(s) for s in sets])
            links = np.zeros(len(t), np.int64)
            up = np.arange(len(t))  # of each member, a linked one with a smaller number, up to a root

            def root(i: int) -> int:
                while up[i] != i:
                    up[i] = up[up[i]]
                    i = up[i]
                return i

            for p, q in _pairs_in(task, side):
                p, q = survivors(sig, band, p, q, threshold, tolerance)
                if not len(p):
                    continue
                both = _overlaps(sets, p, q)
                ok = both >= threshold * (size[p] + size[q] - both) - 1e-9
                p, q = p[ok], q[ok]
                np.add.at(links, p, weight[q])
                np.add.at(links, q, weight[p])
                for a, b in zip(p.tolist(), q.tolist()):
                    a, b = root(a), root(b)
                    if a != b:
                        up[max(a, b)] = min(a, b)
            some = np.flatnonzero(links > 0)
            if len(some):
                heads = np.array([node[root(int(i))] for i in some], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node[some], pa.int64()), pa.array(heads, pa.int64()), pa.array(links[some], pa.int64())], names=["node", "head", "links"])
        give_back()

    return run


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = text_buffers(b.column("text"))
        sets = []
        for x, y in chunks(offsets):
            own, places = shingles(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
            sets += [np.unique(own[places[i] : places[i + 1]]).astype("<u8").tobytes() for i in range(y - x)]
        names = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(sets, pa.binary())], names=[*names, "shingles"])
    give_back()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """A row for each row of docs: doc_id, digest, class_id, n_links (other documents it is linked with), is_first.

    is_first: the one document that stands for its class: that with the smallest digest and id among
    those of the smallest id; exactly one row of each class if ids differ.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    some = rows.where("text is not null")
    signed = some.mapInArrow(_signatures, "doc_id long, digest binary, sig binary, bands array<long>, n_sh long")
    classes = signed.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("n_sh").alias("n_sh"))
    nodes = stage_table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    bands = nodes.where("n_sh > 0").select("node", "n_sh", F.posexplode("bands").alias("band", "key"))
    # a table of its own, so that a hot bucket's members may be split over tasks in the join
    full = stage_table(bands.groupBy("key").agg(F.count("*").alias("m"), F.sum("n_sh").alias("sh")).where("m > 1"), "buckets")
    parts = F.ceil(F.greatest(F.col("m") / BLOCK_ROWS, F.col("sh") * 8 / BLOCK_BYTES)).cast("int")
    full = full.select("key", F.when(parts > 1, parts + 1).otherwise(1).alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    met = bands.join(full, "key").select("node", F.col("band").cast("int").alias("band"), "key", "parts", own.alias("own"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select(
        "node",
        "band",
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("task"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    stats = nodes.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_sh"), F.lit(0)).alias("sh")).first()
    tasks = partitions_for(spark, 160 * BANDS * stats["n"] // 4)
    grouped = met.join(nodes.select("node", "sig"), "node").repartition(tasks, "task").sortWithinPartitions("task")
    flagged = stage_table(grouped.select("task", "side", "band", "node", "sig").mapInArrow(_flag(threshold, tolerance), "task long, side int, band int, node long"), "flagged")

    wanted = nodes.join(flagged.select("node").distinct(), "node", "left_semi").select("digest", "node", "sig", "n")
    texts = some.withColumn("digest", F.unhex(F.md5("text"))).join(wanted, "digest").groupBy("node", "sig", "n").agg(F.first("text").alias("text"))
    sets = texts.mapInArrow(_shingle_sets, "node long, sig binary, n long, shingles binary")
    tasks = partitions_for(spark, 8 * stats["sh"])
    again = flagged.join(sets, "node").repartition(tasks, "task").sortWithinPartitions("task")
    links = stage_table(again.select("task", "side", "band", "node", "n", "sig", "shingles").mapInArrow(_verify(threshold, tolerance), "node long, head long, links long"), "links")

    roots = components(links.select(F.col("node").alias("a"), F.col("head").alias("b")).where("a <> b").distinct())
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    linked = stage_table(nodes.select("node", "digest", "first_id").join(roots, "node"), "linked")
    tops = stage_table(linked.groupBy("root").agg(F.min("first_id").alias("class_id"), F.min(F.struct(F.col("first_id").isNull().alias("x"), "first_id", "digest"))["digest"].alias("top")), "tops")
    placed = linked.join(tops, "root").select("node", "class_id", (F.col("top") == F.col("digest")).alias("leads"))
    named = nodes.select("node", "digest", "n", "first_id").join(placed, "node", "left").join(counts, "node", "left")
    named = named.select(
        "digest",
        F.when(F.col("leads").isNull(), F.col("first_id")).otherwise(F.col("class_id")).alias("class_id"),
        "n",
        "first_id",
        F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("leads", F.lit(True)).alias("leads"),
    )
    ids = rows.select("doc_id", F.unhex(F.md5("text")).alias("digest"))
    out = ids.join(named, "digest", "left")
    alone = F.col("digest").isNull()
    return out.select(
        "doc_id",
        "digest",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("links") + F.col("n") - 1).cast("long").alias("n_links"),
        F.when(alone, F.lit(True)).otherwise(F.col("leads") & F.col("doc_id").eqNullSafe(F.col("first_id"))).alias("is_first"),
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each class of near duplicates. Null texts all stay.

    Of rows with the same id and text one stays.
    """
    ident, digest = fresh(docs, "_id"), fresh(docs, "_digest")
    found = stage_table(near_duplicates(docs, doc_id, text).where("is_first and digest is not null").select(F.col("doc_id").alias(ident), F.col("digest").alias(digest)), "first")
    distinct = found.distinct()
    whole = docs.where(F.col(f"`{text}`").isNotNull())
    kept = whole.join(distinct, F.col(f"`{doc_id}`").eqNullSafe(F.col(ident)) & (F.unhex(F.md5(f"`{text}`")) == F.col(digest)), "left_semi")
    names = [F.col(f"`{c}`") for c in docs.columns]
    kept = kept.select(*names)
    if found.count() != distinct.count():  # rows with equal id and text: only then do texts have to be compared once more
        kept = kept.dropDuplicates([doc_id, text])
    return kept.unionByName(docs.where(F.col(f"`{text}`").isNull()).select(*names))
