"""Exact substring deduplication with difference-cover anchors.

A window is W (20) consecutive words of a document; words are runs of characters other than white space
(0x20, 0x09-0x0D), unchanged. A word goes if a window covers it whose word sequence also starts earlier
(smaller id, or same document and earlier start), judged on the input.

Not every window is compared. A difference cover D of the residues modulo P has, for any two positions
i and j, a shift d < P with (i + d) mod P and (j + d) mod P both in D. So it is enough to hash runs of
W - P + 1 words that start at positions in D modulo P (4 of 13): two equal windows anywhere share
an aligned equal anchor. Then

1. anchors are counted by hash; those that occur more than once go back to their documents;
2. around them, the full windows are hashed (the extension) with 128 bits, from two kinds of hash of their words' 64-bit
   hashes, and each hash's earliest place is found: among 1e13 windows (100 TB) two different ones are equal in all
   bits with a probability of about 1e-13;
3. windows that aren't the earliest go back to their documents and mark their words.

Texts that are equal to an earlier document's are settled by their digest first. Hashes travel as packed
arrays, a row for each batch and hash range, with one entry for a hash in a batch: a passage that all
documents share sends one entry a batch, so no key gathers its occurrences in one task, and a hash range's size follows
from the number of ranges, which grows with the input.

Null or odd input: a null text has no words (zero words, hash of the empty text); a text of fewer than W words keeps all.
Rows with equal id and text, and rows without id, are ordered by an arbitrary row number after
all ids: one of equal rows counts as the earlier one. Extra columns are kept by dedup_text, ignored by spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.bpe import ragged
from millrace.llm.common import U64, chunks, give_back, mix, partitions_for, run_hashes, span_hashes, stage_table, text_buffers, text_bytes, within, word_hashes, words

WINDOW, PERIOD, COVER = 20, 13, (0, 1, 3, 9)  # every residue modulo 13 is a difference of two of these
#: Bytes of packed hashes that a range's task gets, about.
RANGE_BYTES = 12 << 20
#: Bytes of text whose hashes are packed together.
PACK_BYTES = 16 << 20


class _Packed:
    """Entries (hash, more bits of it, document, place) of many documents, dealt out by ranges of hashes."""

    def __init__(self, ranges: int):
        self.ranges = ranges
        self.docs: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, docs: np.ndarray, row: np.ndarray, place: np.ndarray, hashes: np.ndarray, more: np.ndarray) -> None:
        """docs: ids of some rows; row: number among them of each entry; more: bits beside the hashes (none for anchors)."""
        self.docs.append(docs)
        self.parts.append((hashes, more, row + self.rows, place))
        self.rows += len(docs)

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Entries in order of hash, document id and place; the first of each hash; and how many it has."""
        docs = np.concatenate(self.docs) if self.docs else np.zeros(0, np.int64)
        h, more, row, place = (np.concatenate([p[i] for p in self.parts]) if self.parts else np.zeros(0, np.int64) for i in range(4))
        self.__init__(self.ranges)
        order = np.lexsort((place, docs[row], more, h) if len(more) else (place, docs[row], h)) if len(h) else np.zeros(0, np.int64)
        h, doc, place = h[order].astype(U64), docs[row][order] if len(h) else docs, place[order]
        more = more[order] if len(more) else more
        head = np.flatnonzero(_new(h, more))
        return h, more, doc, place, head, np.diff(np.concatenate([head, [len(h)]]))


def _new(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Where another hash begins, of hashes in order. more: their further bits, or nothing."""
    if not len(h):
        return np.zeros(0, bool)
    return np.concatenate([[True], (h[1:] != h[:-1]) | (more[1:] != more[:-1] if len(more) else False)])


def _dealt(h: np.ndarray, more: np.ndarray, doc: np.ndarray, place: np.ndarray, many: np.ndarray, ranges: int, kind: str) -> pa.RecordBatch:
    """A row for each range of hashes: its entries as arrays, in order of documents, which compresses well.

    kind: of the hashes that are kept. Anchors keep 32 bits beside the range: a chance match only
    makes a window that the next step tells apart by all its 128 bits.
    """
    part = ((h >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int64)
    order = np.lexsort((place, doc, part))
    h, doc, place, many, part = h[order], doc[order], place[order], many[order], part[order]
    more = more[order] if len(more) else more
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    ends = np.concatenate([edges[1:], [len(part)]])
    low = h & U64(0xFFFFFFFF) if kind == "<u4" else h
    cells = [pa.array([a[x:y].astype(k).tobytes() for x, y in zip(edges, ends)], pa.binary()) for a, k in ((low, kind), (more, "<u8"), (doc, "<i8"), (place, "<i4"), (many, "u1"))]
    return pa.RecordBatch.from_arrays([pa.array(part[edges], pa.int64()), cells[0], cells[1], pa.nulls(len(edges), pa.int64()), cells[3], cells[2], cells[4]], names=_ROW)


def _marks(doc: np.ndarray, place: np.ndarray, blocks: int, part: int = -1) -> pa.RecordBatch:
    """A row for each block of documents: the marked documents and places as arrays. A document's block is its id's hash."""
    block = (mix(doc.astype(U64)) % U64(blocks)).astype(np.int64)
    order = np.lexsort((place, doc, block))
    doc, place, block = doc[order], place[order], block[order]
    edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(doc) else np.zeros(0, np.int64)
    ends = np.concatenate([edges[1:], [len(doc)]])
    docs, places = (pa.array([a[x:y].astype(k).tobytes() for x, y in zip(edges, ends)], pa.binary()) for a, k in ((doc, "<i8"), (place, "<i4")))
    empty = pa.nulls(len(edges), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(edges), part), pa.int64()), empty, empty, pa.array(block[edges], pa.int64()), places, docs, empty], names=_ROW)


_ROW = ["part", "h", "more", "block", "place", "doc", "many"]
_ROW_DDL = "part long, h binary, more binary, block long, place binary, doc binary, many binary"
_MARKED = ["block", "doc", "place"]


def _entries(batches: Iterator[pa.RecordBatch], ranges: int, window: int, period: int, cover: tuple[int, ...], anchors: bool) -> Iterator[pa.RecordBatch]:
    """Rows for the ranges, and marks that are known within a batch, which pass through any range."""
    span = window - period + 1 if anchors else window
    packed, held = _Packed(ranges), 0

    def flush() -> Iterator[pa.RecordBatch]:
        h, more, doc, place, head, count = packed.take()
        if not len(h):
            return
        known = np.repeat(count > 1, count)
        if not anchors:
            known[head] = False  # a window that is the batch's earliest may be the earliest of all
        if known.any():
            yield _marks(doc[known], place[known], ranges, int(h[0] % U64(ranges)))
        yield _dealt(h[head], more if anchors else more[head], doc[head], place[head], count > 1, ranges, "<u4" if anchors else "<u8")

    for b in batches:
        data, offsets = text_buffers(b.column("text"))
        docs = b.column("row").to_numpy(zero_copy_only=False)
        near, near_at = (None, None) if anchors else text_buffers(b.column("marks"))
        for x, y in chunks(offsets):
            first, last, firsts = words(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
            at = within(firsts, span)
            row = np.searchsorted(firsts, at, side="right") - 1
            if anchors:
                ok = np.isin((at - firsts[row]) % period, cover) & (np.diff(firsts)[row] >= window)
            else:
                # windows that hold a repeated anchor within their first period's places
                ok = np.zeros(int(firsts[-1]) + 1, np.int32)
                hits = np.frombuffer(near[near_at[x] : near_at[y]].tobytes(), "<i4").astype(np.int64)
                hit_row = np.repeat(np.arange(y - x), np.diff(near_at[x : y + 1]) // 4)
                to = firsts[:-1][hit_row] + hits
                np.add.at(ok, np.maximum(to - period + 1, firsts[:-1][hit_row]), 1)
                np.add.at(ok, to + 1, -1)
                ok = np.cumsum(ok)[at] > 0
            if ok.any():
                own = word_hashes(data[offsets[x] : offsets[y]], first, last)
                more = np.zeros(0, U64) if anchors else span_hashes(mix(own), at[ok], at[ok] + span)
                packed.add(docs[x:y], row[ok], (at - firsts[row])[ok], run_hashes(own, span)[at[ok]], more)
            held += int(offsets[y] - offsets[x])
            if held >= PACK_BYTES:
                yield from flush()
                held = 0
    yield from flush()
    give_back()


def _repeated(anchors: bool, blocks: int):
    """Of one range's rows: anchors that occur in more than one batch or entry; or windows that aren't the earliest."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        known = t.filter(t.column("h").is_null()).select(_MARKED)
        t = t.filter(t.column("h").is_valid())
        h, more, doc, place, many = (np.frombuffer(b"".join(t.column(c).to_pylist()), k) for c, k in (("h", "<u4" if anchors else "<u8"), ("more", "<u8"), ("doc", "<i8"), ("place", "<i4"), ("many", "u1")))
        order = np.lexsort((place, doc, h) if anchors else (place, doc, more, h))
        h, doc, place, many = h[order], doc[order], place[order], many[order]
        first = _new(h, more if anchors else more[order])
        head = np.flatnonzero(first)
        count = np.diff(np.concatenate([head, [len(h)]]))
        # anchors: entries that repeat in their batch have their marks already
        pick = np.repeat(count > 1, count) & (many == 0) if anchors else ~first
        return pa.concat_tables([known, pa.Table.from_batches([_marks(doc[pick], place[pick], blocks)]).select(_MARKED)])

    return run


def _unpack(key: tuple, t: pa.Table) -> pa.Table:
    """A row for each marked document of a block: its places in order, as an array."""
    doc, place = (np.frombuffer(b"".join(t.column(c).to_pylist()), k) for c, k in (("doc", "<i8"), ("place", "<i4")))
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    ends = np.concatenate([edges[1:], [len(doc)]])
    return pa.table({"row": pa.array(doc[edges], pa.int64()), "marks": pa.array([place[x:y].tobytes() for x, y in zip(edges, ends)], pa.binary())})


def _gathered(entries: DataFrame, anchors: bool, blocks: int) -> DataFrame:
    """row, marks: the marked places of each document that has some. Ranges and blocks are as many as the input's size asks for."""
    marks = entries.groupBy("part").applyInArrow(_repeated(anchors, blocks), "block long, doc binary, place binary")
    return marks.groupBy("block").applyInArrow(_unpack, "row long, marks binary")


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            near, near_at = text_buffers(b.column("marks"))
            every = b.column("copy").to_numpy(zero_copy_only=False)
            total, removed, kept = [], [], []
            for x, y in chunks(offsets):
                part = data[offsets[x] : offsets[y]]
                first, last, firsts = words(part, offsets[x : y + 1] - offsets[x])
                cover = np.zeros(len(first) + 1, np.int32)
                starts = np.frombuffer(near[near_at[x] : near_at[y]].tobytes(), "<i4").astype(np.int64)
                own = firsts[:-1][np.repeat(np.arange(y - x), np.diff(near_at[x : y + 1]) // 4)] + starts
                np.add.at(cover, own, 1)
                np.add.at(cover, own + window, -1)
                gone = np.cumsum(cover)[: len(first)] > 0
                count = np.diff(firsts)
                gone |= np.repeat(every[x:y] & (count >= window), count)
                stay = np.flatnonzero(~gone)
                size = last[stay] - first[stay]
                # the kept words' bytes with a space after each
                places = ragged(first[stay], size + 1)
                ends = np.cumsum(size + 1)
                line = np.concatenate([part, np.zeros(1, np.uint8)])[places]
                line[ends - 1] = 0x20
                bounds = np.concatenate([[0], ends])[np.searchsorted(stay, firsts)]
                blob = line.tobytes()
                kept += [blob[p : max(p, q - 1)] for p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                total.append(count)
                removed.append(count - np.diff(np.searchsorted(stay, firsts)))
            names = [c for c in b.schema.names if c not in ("text", "marks", "copy")]
            n = np.concatenate(total) if total else np.zeros(0, np.int64)
            r = np.concatenate(removed) if removed else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                names=[*names, "n_words", "n_removed", "kept", "kept_sha256"],
            )
        give_back()

    return run


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by single spaces), kept_sha256; a row for each row of docs.

    carry: further columns of docs that are wanted, returned as c0, c1 and so on.
    """
    if not {(a - b) % period for a in cover for b in cover} == set(range(period)) or window < period:
        raise ValueError("cover must be a difference cover of the residues modulo period, and window at least period")
    more = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").alias(m) for c, m in zip(carry, more)])
    rows = rows.withColumn("digest", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    stats = rows.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d"), F.coalesce(F.sum(text_bytes(F.col("text"))), F.lit(0)).alias("size")).first()
    # ids that repeat or are missing: rows get numbers in the order of ids
    numbered = rows.withColumn("row", F.col("doc_id")) if stats["n"] == stats["d"] else _numbered(rows)
    firsts = numbered.groupBy("digest").agg(F.min("row").alias("row"))
    copies = stage_table(numbered.select("row", "digest").join(firsts, ["row", "digest"], "left_anti").select("row"), "copies")
    # both joins below deal out the same two columns by row, so texts are shuffled once; the rest joins them as slim rows
    heads = numbered.select("row", "text")

    args = (window, period, tuple(cover))
    ranges = partitions_for(docs.sparkSession, stats["size"] * 4 // 5, RANGE_BYTES)
    anchors = heads.mapInArrow(lambda it: _entries(it, ranges, *args, True), _ROW_DDL)
    near = _gathered(anchors, True, ranges).join(copies, "row", "left_anti")
    around = heads.join(near, "row").select("row", "text", "marks")
    windows = around.mapInArrow(lambda it: _entries(it, ranges, *args, False), _ROW_DDL)
    late = _gathered(windows, False, ranges)
    rest = numbered.select("row", "doc_id", *more).join(copies.withColumn("copy", F.lit(True)), "row", "left")
    whole = heads.join(late, "row", "left").join(rest, "row")
    marked = whole.select("doc_id", *more, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("marks", F.lit(b"")).alias("marks"), F.coalesce("copy", F.lit(False)).alias("copy"))
    made = [T.StructField(n, k) for n, k in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.StringType()), ("kept_sha256", T.StringType()))]
    return marked.mapInArrow(_kept(window), T.StructType([*marked.select("doc_id", *more).schema.fields, *made]))


def dedup_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the words that stay as their text. A document that loses all its words goes; others stay, unchanged if nothing goes."""
    carry = [c for c in docs.columns if c != doc_id]
    found = dedup(docs, doc_id, text, carry=tuple(carry)).where("n_removed = 0 or n_removed < n_words")
    names = {c: f"c{i}" for i, c in enumerate(carry)} | {doc_id: "doc_id"}
    new = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(names[text]))
    return found.select(*[(new if c == text else F.col(names[c]).cast(docs.schema[c].dataType)).alias(c) for c in docs.columns])


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with distinct numbers that rise with doc_id (null last), as a table of its own."""
    placed = stage_table(rows.orderBy(F.col("doc_id").asc_nulls_last(), "digest").withColumn("at", F.monotonically_increasing_id()), "numbered")
    return placed.withColumnRenamed("at", "row")
