"""Packing token ids into fixed-length rows: best fit decreasing with a segment tree over capacities.

A document longer than a row is split losslessly into pieces of full rows and a rest. Pieces of a
group (consecutive documents of a partition, up to a bounded number of ids) are taken from
long to short; a segment tree over the values 1..capacity counts the open rows with that
room left, and finds the least room that still holds the piece. So nothing is shuffled: a group
never leaves its task, and its size is bounded whatever the table's size is.

A packed row has: ids as little-endian unsigned 32-bit values padded to capacity, the cumulative lengths
of its segments (from 0 to the ids used), where positions start anew (all but the last of those),
and for each segment its document, the number of the input row that it came from, its first id's place in that document,
and the document's number of segments. So `unpacked` gives a row for each input row.

Null or odd input: a document without ids (null or empty text) has no segment: the first row of its group names it in
empty_ids and empty_rows (a group of nothing else gives one row without ids), and `unpacked` gives it an empty array. Repeated
rows and rows without id are told apart by their row numbers; a null id stays null. Empty tables give no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bpe import encoder, lookup_column
from millrace.llm.common import give_back

CAPACITY = 2048
#: Ids that a group holds at most, but for the last document's own.
GROUP_IDS = 4 << 20

SCHEMA = (
    "ids binary, used int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_rows array<long>, "
    "doc_offsets array<long>, doc_segments array<int>, empty_ids array<long>, empty_rows array<long>, ids_sha256 string"
)


class Capacities:
    """Segment tree over room 0..capacity: which rooms have open rows, and the least that is at least as asked."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (room, row) of the least room >= need."""
        i = need + self.size
        count = self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up until a right neighbour has rows
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        row = self.rows[room].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return room, row


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Numbers of the pieces in each row. Ties of size keep their order."""
    tree, rows = Capacities(capacity), []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = tree.take(sizes[k])
        if found is None:
            room, row = capacity, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(k)
        if room > sizes[k]:
            tree.add(room - sizes[k], row)
    return rows


def pack_group(docs: list, numbers: list, flat: np.ndarray, at: np.ndarray, capacity: int, pad: int) -> pa.RecordBatch:
    """docs, numbers: documents' ids and row numbers; flat: their token ids end to end; at: n + 1 places."""
    pieces: list[tuple[int, int, int, int]] = []  # document, place in flat, size, place in document
    parts = []
    for d, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        parts.append(-(-(y - x) // capacity))
        pieces += [(d, p, min(capacity, y - p), p - x) for p in range(x, y, capacity)]
    rows = best_fit_decreasing([p[2] for p in pieces], capacity)
    bare = [d for d, n in enumerate(parts) if not n]
    if bare and not rows:
        rows = [[]]
    out: list[list] = [[] for _ in range(11)]
    matrix = np.full((len(rows), capacity), pad, "<u4")
    for r, own in enumerate(rows):
        ends = [0]
        for k in own:
            _, p, n, _ = pieces[k]
            matrix[r, ends[-1] : ends[-1] + n] = flat[p : p + n]
            ends.append(ends[-1] + n)
        blob = matrix[r].tobytes()
        from_doc = [pieces[k][0] for k in own]
        nothing_in = bare if r == 0 else []
        values = (
            *(blob, ends[-1], ends, ends[:-1], [docs[d] for d in from_doc], [numbers[d] for d in from_doc], [pieces[k][3] for k in own], [parts[d] for d in from_doc]),
            *([docs[d] for d in nothing_in], [numbers[d] for d in nothing_in], hashlib.sha256(blob).hexdigest()),
        )
        for column, value in zip(out, values):
            column.append(value)
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    kinds = [pa.binary(), pa.int32(), ints, ints, longs, longs, longs, ints, longs, longs, pa.string()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, group_ids: int = GROUP_IDS, pad: int = 0) -> DataFrame:
    """Packed rows of all documents' token ids (vocabulary file: path). `used` says where padding begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        held: list[tuple[list, list, np.ndarray, np.ndarray]] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, total
            names, numbers = ([d for x in held for d in x[i]] for i in (0, 1))
            flat = np.concatenate([x[2] for x in held])
            at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[3]) for x in held]))])
            held, total = [], 0
            found = pack_group(names, numbers, flat, at, capacity, pad)
            for k in range(0, len(found), 1024):
                yield found.slice(k, 1024)

        for b in batches:
            ids, numbers = b.column(0).to_pylist(), b.column(2).to_pylist()
            for a, z, flat, at in lookup_column(enc, b.column(1)):
                row = a
                while row < z:
                    to = max(row + 1, a + int(np.searchsorted(at, at[row - a] + max(1, group_ids - total), side="right")) - 1)
                    to = min(to, z)
                    x, y = at[row - a], at[to - a]
                    held.append((ids[row:to], numbers[row:to], flat[x:y].copy(), at[row - a : to - a + 1] - x))
                    total += int(y - x)
                    row = to
                    if total >= group_ids:
                        yield from flush()
        if held:
            yield from flush()
        give_back()

    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("number"))
    return own.mapInArrow(run, SCHEMA)


def matrix_of(row) -> np.ndarray:
    """The ids of one packed row, padding included."""
    return np.frombuffer(row["ids"], "<u4")


def unpacked(packed: DataFrame) -> DataFrame:
    """doc_row, doc_id and ids of each input row, put together from its segments: the inverse of pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, numbers, places, pieces = [], [], [], []
            for r in b.to_pylist():
                ids, ends = np.frombuffer(r["ids"], "<u4"), r["cu_seqlens"]
                docs += r["doc_ids"] + r["empty_ids"]
                numbers += r["doc_rows"] + r["empty_rows"]
                places += r["doc_offsets"] + [0] * len(r["empty_ids"])
                pieces += [ids[x:y].astype(np.int32) for x, y in zip(ends, ends[1:])] + [np.zeros(0, np.int32)] * len(r["empty_ids"])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(numbers, pa.int64()), pa.array(places, pa.int64()), pa.array(pieces, pa.list_(pa.int32()))], names=["doc_id", "doc_row", "place", "piece"])

    parts = packed.mapInArrow(run, "doc_id long, doc_row long, place long, piece array<int>")
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda x: x["piece"]))
    return parts.groupBy("doc_row").agg(F.first("doc_id").alias("doc_id"), whole.alias("ids"))


def write_packed(packed: DataFrame, folder: str) -> None:
    """Packed rows as Parquet files; each file holds whole rows."""
    packed.write.mode("overwrite").parquet(folder)
