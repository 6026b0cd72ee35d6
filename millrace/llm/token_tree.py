"""Edit-aware token counts: a segment tree over runs of pre-tokens for each document.

A leaf is a run of pre-tokens of about LEAF characters. Leaves are cut only before white space that
follows something else: no pre-token lies across such a place and none depends on what is beyond it, so a
text's count is the sum over its leaves. The tree keeps characters and tokens of each subtree.

An edit (place, characters deleted, text inserted, in order, on the text as it is then) finds its first and last leaf by
descending the tree, takes a neighbour in as long as the region's border isn't such a place any more (boundary context),
cuts the region anew, and updates the sums on the leaves' paths. Only the regions' leaves are encoded again, those of
many documents together.

Null or odd input: a null text counts as empty: one leaf with no characters. Places beyond the text's end mean its end, negative
ones its start; deletions stop at the end; null edits change nothing. A text without white space is one leaf.
Repeated rows each have their own tree. Extra columns pass through, but for those made here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.bpe import WHITE, Encoder, encoder, texts_of
from millrace.llm.common import give_back

LEAF = 512
_SPACES = "".join(map(chr, WHITE))
_CUT = re.compile(f"(?<=[^{re.escape(_SPACES)}])(?=[{re.escape(_SPACES)}])")


def split_leaves(text: str, leaf: int = LEAF) -> list[str]:
    """Runs of about leaf characters or more; together they are text; at least one."""
    out, at = [], 0
    while True:
        found = _CUT.search(text, at + leaf)
        if found is None:
            out.append(text[at:])
            return out
        out.append(text[at : found.start()])
        at = found.start()


def may_cut(left: str, right: str) -> bool:
    """Whether a leaf may end with left and the next start with right (both not empty)."""
    return left[-1] not in _SPACES and right[0] in _SPACES


class Tree:
    """Leaves' texts, and sums of characters and tokens in heap order: node i is over nodes 2i and 2i + 1."""

    def __init__(self, leaves: list[str], tokens: list[int]):
        self.fill(leaves, tokens)
        self.dirty: set[int] = set()
        self.encoded = 0

    def fill(self, leaves: list[str], tokens: list[int]) -> None:
        self.leaves = leaves
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        pad = [0] * (self.size - len(leaves))
        self.chars = [0] * self.size + [len(x) for x in leaves] + pad
        self.tokens = [0] * self.size + list(tokens) + pad
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and its place there; the end of text is in the last leaf that isn't empty."""
        if place >= self.chars[1]:
            i = len(self.leaves) - 1
            while i and not self.leaves[i]:
                i -= 1
            return i, len(self.leaves[i])
        i = 1
        while i < self.size:
            i *= 2
            if place >= self.chars[i]:
                place -= self.chars[i]
                i += 1
        return i - self.size, place

    def put(self, leaf: int, chars: int | None = None, tokens: int | None = None) -> None:
        """Set a leaf's numbers and add the change to all sums above it."""
        i = leaf + self.size
        more_chars = 0 if chars is None else chars - self.chars[i]
        more_tokens = 0 if tokens is None else tokens - self.tokens[i]
        while i:
            self.chars[i] += more_chars
            self.tokens[i] += more_tokens
            i >>= 1

    def edit(self, place: int, delete: int, insert: str, leaf: int = LEAF) -> None:
        total = self.chars[1]
        place = min(max(place, 0), total)
        end = min(place + max(delete, 0), total)
        (a, x), (b, y) = self.find(place), self.find(end)
        region = self.leaves[a][:x] + insert + self.leaves[b][y:]
        while True:
            left = next((i for i in range(a - 1, -1, -1) if self.leaves[i]), None)
            if left is None or (region and may_cut(self.leaves[left], region)):
                break
            a, region = left, self.leaves[left] + region
        while True:
            right = next((i for i in range(b + 1, len(self.leaves)) if self.leaves[i]), None)
            if right is None or (region and may_cut(region, self.leaves[right])):
                break
            b, region = right, region + self.leaves[right]
        own = split_leaves(region, leaf)
        room = b - a + 1
        if len(own) <= room:  # the leaves' places suffice: only their paths change
            for i in range(room):
                text = own[i] if i < len(own) else ""
                self.leaves[a + i] = text
                self.put(a + i, len(text), 0)
                self.dirty.add(a + i)
            return
        shift = len(own) - room
        tokens = self.tokens[self.size : self.size + len(self.leaves)]
        self.dirty = {i + shift if i > b else i for i in self.dirty if not a <= i <= b} | set(range(a, a + len(own)))
        self.fill(self.leaves[:a] + own + self.leaves[b + 1 :], tokens[:a] + [0] * len(own) + tokens[b + 1 :])


def encode_dirty(trees: list[Tree], enc: Encoder) -> None:
    """Counts the tokens of all leaves that changed, of all trees together."""
    places = [(t, i) for t in trees for i in sorted(t.dirty)]
    counts = token_counts([t.leaves[i] for t, i in places], enc)
    for (t, i), n in zip(places, counts):
        t.put(i, tokens=n)
        t.encoded += len(t.leaves[i])
    for t in trees:
        t.dirty = set()


def token_counts(texts: list[str], enc: Encoder) -> list[int]:
    out: list[int] = []
    for _, _, _, at in enc.lookup(texts):
        out += np.diff(at).tolist()
    return out


_MADE = {"leaf_chars": T.ArrayType(T.IntegerType(), False), "leaf_tokens": T.ArrayType(T.IntegerType(), False), "n_tokens": T.LongType()}


def _with(df: DataFrame, made: dict[str, T.DataType]) -> tuple[DataFrame, T.StructType]:
    base = df.drop(*[c for c in made if c in df.columns])
    return base, T.StructType([*base.schema.fields, *(T.StructField(k, v) for k, v in made.items())])


def _slices(texts: list[str], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    row = 0
    while row < len(texts):
        to, held = row, 0
        while to < len(texts) and (to == row or held + len(texts[to]) <= most):
            held += len(texts[to])
            to += 1
        yield row, to
        row = to


def _planted(texts: list[str], enc: Encoder, leaf: int) -> list[Tree]:
    """A tree of each text; the leaves of all of them are encoded together."""
    leaves = [split_leaves(t, leaf) for t in texts]
    counts = token_counts([s for own in leaves for s in own], enc)
    ends = np.cumsum([len(own) for own in leaves]).tolist()
    return [Tree(own, counts[end - len(own) : end]) for own, end in zip(leaves, ends)]


def _edited(trees: list[Tree], edits: list, enc: Encoder, leaf: int) -> None:
    for tree, changes in zip(trees, edits):
        for change in changes or []:
            if change is not None:
                tree.edit(change["place"] or 0, change["delete"] or 0, change["insert"] or "", leaf)
    encode_dirty(trees, enc)


_COUNTED = {"tokens_before": T.LongType(), "tokens_after": T.LongType(), "chars_after": T.LongType(), "encoded_chars": T.LongType(), "n_leaves": T.IntegerType()}


def count_edited(docs: DataFrame, path: str, text: str = "text", edits: str = "edits", leaf: int = LEAF) -> DataFrame:
    """docs without text and edits, with counts before and after their edits: build and apply_edits in one pass, when neither the trees nor the new texts are wanted."""
    base = docs.drop(*[c for c in _COUNTED if c in docs.columns])
    kept = [f for f in base.schema.fields if f.name not in (text, edits)]
    schema = T.StructType([*kept, *(T.StructField(k, v) for k, v in _COUNTED.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for x, y in _slices(texts_of(whole.column(text))):
                b = whole.slice(x, y - x)
                own = _planted(texts_of(b.column(text)), enc, leaf)
                before = [t.tokens[1] for t in own]
                _edited(own, b.column(edits).to_pylist(), enc, leaf)
                made = [before, [t.tokens[1] for t in own], [t.chars[1] for t in own], [t.encoded for t in own]]
                columns = [*[b.column(f.name) for f in kept], *[pa.array(m, pa.int64()) for m in made], pa.array([len(t.leaves) for t in own], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])
        give_back()

    return base.mapInArrow(run, schema)


def build(docs: DataFrame, path: str, text: str = "text", leaf: int = LEAF) -> DataFrame:
    """docs with their trees' leaves (leaf_chars, leaf_tokens) and n_tokens. The sums above follow from the leaves."""
    base, schema = _with(docs, _MADE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = texts_of(b.column(text))
            for x, y in _slices(texts):
                leaves = [split_leaves(t, leaf) for t in texts[x:y]]
                counts = np.array(token_counts([s for own in leaves for s in own], enc), np.int32)
                at = np.concatenate([[0], np.cumsum([len(own) for own in leaves])])
                sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                sizes = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array([len(s) for own in leaves for s in own], pa.int32()))
                tokens = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(counts, pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.slice(x, y - x).columns, sizes, tokens, pa.array(np.diff(sums[at]), pa.int64())], names=[f.name for f in schema.fields])

    return base.mapInArrow(run, schema)


def apply_edits(trees: DataFrame, path: str, text: str = "text", edits: str = "edits", leaf: int = LEAF) -> DataFrame:
    """trees (from build, with edits: array of struct<place, delete, insert>) after their edits: text and tree changed.

    Adds encoded_chars, the characters that had to be encoded again.
    """
    columns = [c for c in trees.columns if c != "encoded_chars"]
    schema = T.StructType([*[trees.schema[c] for c in columns], T.StructField("encoded_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for x, y in _slices(texts_of(whole.column(text))):
                b = whole.slice(x, y - x)
                own: list[Tree] = []
                for t, sizes, tokens in zip(texts_of(b.column(text)), b.column("leaf_chars").to_pylist(), b.column("leaf_tokens").to_pylist()):
                    ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                    own.append(Tree([t[p:q] for p, q in zip(ends, ends[1:])], tokens))
                _edited(own, b.column(edits).to_pylist(), enc, leaf)
                made = {
                    text: pa.array(["".join(t.leaves) for t in own], pa.string()),
                    "leaf_chars": pa.array([[len(s) for s in t.leaves] for t in own], pa.list_(pa.int32())),
                    "leaf_tokens": pa.array([t.tokens[t.size : t.size + len(t.leaves)] for t in own], pa.list_(pa.int32())),
                    "n_tokens": pa.array([t.tokens[1] for t in own], pa.int64()),
                    "encoded_chars": pa.array([t.encoded for t in own], pa.int64()),
                }
                yield pa.RecordBatch.from_arrays([made.get(f.name, b.column(f.name) if f.name in columns else None) for f in schema.fields], names=[f.name for f in schema.fields])

    return trees.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)
