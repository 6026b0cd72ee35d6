"""Byte-level BPE by a pair occurrence index.

Texts are cut into pre-tokens with numpy (classes of code points, then the places where a class
changes), equal pre-tokens are found by a hash of 64 bits and confirmed by another of 64 bits (one that
agrees in the first alone is encoded by itself), and the distinct new ones of a partition's block are
encoded together: an index maps each mergeable pair to all its positions in the block; ranks
that have positions are taken in ascending order, each merges all its positions at
once, and the pairs that this makes or breaks go to their own ranks' lists. A merge only makes
pairs of higher rank than its own, as a token is in the vocabulary before it can be part of a
pair, so every rank is taken once.

Results for a pre-token are kept in a table of bounded size (a cache, no part of the result). Blocks are bounded too, so
that a worker's memory depends neither on its partition's size nor on the batches that it gets.
Decoding goes from ids to bytes and to text, replacing what isn't UTF-8, as a byte-level decoder does.

Null or odd input: null counts as an empty text, with no ids. Special tokens in a text become
their one id, as in the library, the leftmost first, of several at one place the longest. A vocabulary file that asks for something
else than this (a normalizer, a prefix space, stripping special tokens, ...) is refused. Lone runs of thousands of letters are one pre-token and merge like others.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from millrace.llm.common import U64, chunks, give_back, mix, span_hashes, text_buffers

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: The code points that \s stands for in the library's pattern.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The endings that the pattern cuts off after an apostrophe.
SHORT, LONG = "stmd", ("re", "ve", "ll")
#: Distinct pre-tokens that a worker keeps; characters cut and given back at once; characters whose new pre-tokens are merged
#: at once (a longer text is taken alone); bytes of these whose first pairs are put in order at once.
KEEP, CUT_CHARS, BLOCK_CHARS, MERGE_BYTES = 1_000_000, 1 << 20, 8 << 20, 1 << 19


@cache
def _classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = LETTER
        elif c.isnumeric() or c.isdigit():
            import unicodedata

            out[i] = NUMBER if unicodedata.category(c)[0] == "N" else LETTER if unicodedata.category(c)[0] == "L" else OTHER
    out[WHITE] = SPACE
    return out


def cut(text: str, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of text, and where pre-tokens start. breaks: where texts start, within text; each is cut by itself."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    if not n:
        return code, np.zeros(0, np.int64)
    kind = _classes()[code]
    own = np.zeros(n + 1, bool)
    own[breaks[breaks < n]] = True
    own[0] = own[n] = True
    start = own.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # the last space before something else goes with it, if it is U+0020; otherwise it stands alone
    after = np.flatnonzero(start[1:n] & ~own[1:n] & (kind[:-1] == SPACE)) + 1
    plain = code[after - 1] == 0x20
    start[after - 1] = True
    start[after[plain]] = False
    # an apostrophe that starts a pre-token, with one of the short endings right after it
    p = np.flatnonzero(code[:-1] == 0x27)
    p = p[start[p] & start[p + 1] & ~own[p + 1] & (kind[p + 1] == LETTER)]
    if len(p):
        start[p[np.isin(code[p + 1], [ord(c) for c in SHORT])] + 2] = True
        start[p[np.isin(code[p + 1], [ord(c) for c in SHORT])] + 1] = False
        q = p[p + 2 < n]
        q = q[~own[q + 2] & (kind[q + 2] == LETTER)]
        for a, b in LONG:
            hit = q[(code[q + 1] == ord(a)) & (code[q + 2] == ord(b))]
            start[hit + 3] = True
            start[hit + 1] = False
    return code, np.flatnonzero(start[:n])


class _Special(str):
    """A special token found in a text."""


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all spans end to end."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(total)


def distinct(at: np.ndarray) -> np.ndarray:
    at = np.sort(at)
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at


class _New:
    """Pre-tokens of a block that aren't in the table yet, and those whose hash stands for another one (alone)."""

    def __init__(self) -> None:
        self.count = 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.seen = self.seen_other = np.zeros(0, U64)
        self.alone: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.seen):
            return np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.seen, hashes), len(self.seen) - 1)
        return self.seen[at] == hashes

    def other_of(self, hashes: np.ndarray) -> np.ndarray:
        """The other hash of each, 0 for those that aren't here."""
        if not len(self.seen):
            return np.zeros(len(hashes), U64)
        at = np.minimum(np.searchsorted(self.seen, hashes), len(self.seen) - 1)
        return np.where(self.seen[at] == hashes, self.seen_other[at], U64(0))

    def add(self, hashes: np.ndarray, others: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> None:
        """hashes: in order."""
        if not len(hashes):
            return
        place = np.searchsorted(self.seen, hashes)
        self.seen, self.seen_other = np.insert(self.seen, place, hashes), np.insert(self.seen_other, place, others)
        self.parts.append((hashes, np.arange(self.count, self.count + len(hashes)), others, codes, sizes))
        self.count += len(hashes)

    def add_alone(self, run: int, places: np.ndarray, others: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> None:
        if not len(places):
            return
        self.alone[run] = places, np.arange(self.count, self.count + len(places))
        none = np.zeros(0, np.int64)
        self.parts.append((none.astype(U64), none, others, codes, sizes))
        self.count += len(places)

    def take_codes(self) -> np.ndarray:
        """The code points of all, which aren't kept here any longer."""
        out = self.codes
        self.parts = [(*p[:3], p[3][:0], p[4]) for p in self.parts]
        return out

    def __getattr__(self, name: str) -> np.ndarray:
        names = ("hashes", "words", "others", "codes", "sizes")
        if name not in names:
            raise AttributeError(name)
        return np.concatenate([p[names.index(name)] for p in self.parts])


class Encoder:
    """Merges of one vocabulary, and the table of pre-tokens that this worker has met."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        refuse_unsupported(spec)
        to_byte = {c: b for b, c in byte_letters().items()}
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        self.width = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.left, self.right = keys // self.width, keys % self.width
        self.ranks = np.argsort(keys, kind="stable").astype(np.int64)
        self.keys = keys[self.ranks]
        self.first = np.zeros(256, np.int64)
        self.bytes_of: list[bytes] = [b""] * self.width
        for piece, i in vocab.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in piece)
            if len(piece) == 1:
                self.first[to_byte[piece]] = i
        self.shown: list[str] = [str(i) for i in range(self.width)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.special_in = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.byte_ranks = self.rank(np.repeat(self.first, 256), np.tile(self.first, 256)).astype(np.int32).reshape(256, 256)
        self.first = self.first.astype(np.int32)
        self.forget()

    def _special_key(self, content: str) -> np.uint64:
        return mix(np.array([self.special[content]], U64) + (U64(1) << U64(63)))[0]

    def forget(self) -> None:
        """Empty the table but for the special tokens: hashes in order, each one's word, and the words' other hash and ids."""
        self.known = np.zeros(0, U64)
        self.word = np.zeros(0, np.int64)
        self.other = np.zeros(0, U64)
        self.flat = np.zeros(0, np.int32)
        self.off = np.zeros(1, np.int64)
        for content, i in self.special.items():
            key = np.array([self._special_key(content)], U64)
            self._store(key, np.array([len(self.off) - 1]), key, np.array([i], np.int64), np.array([0, 1]))

    def _store(self, hashes: np.ndarray, words: np.ndarray, others: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        """hashes: in order, and not in the table; words: their numbers among all; others, ids, at: of all new words in order of their numbers."""
        place = np.searchsorted(self.known, hashes)
        self.known, self.word = np.insert(self.known, place, hashes), np.insert(self.word, place, words)
        self.other = np.concatenate([self.other, others])
        self.off = np.concatenate([self.off, self.off[-1] + at[1:]])
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word of each hash, or -1."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.word[at], -1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge_all(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, given as bytes end to end with the n + 1 places where they start; and where their ids start."""
        n = int(begin[-1])
        place = np.int32 if n < 1 << 31 else np.int64
        sym = self.first[data]
        nxt, prv = np.arange(1, n + 1, dtype=place), np.arange(-1, n - 1, dtype=place)
        full = np.diff(begin) > 0
        nxt[begin[1:][full] - 1] = -1
        prv[begin[:-1][full]] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray, r: np.ndarray) -> None:
            """Add positions to the lists of their pairs' ranks."""
            has = r >= 0
            at, r = at[has], r[has]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            edges = (np.flatnonzero(r[1:] != r[:-1]) + 1).tolist()
            heads = r[[0, *edges]].tolist()
            for one, x, y in zip(heads, [0, *edges], [*edges, len(at)]):
                if one in index:
                    index[one].append(at[x:y])
                else:
                    index[one] = [at[x:y]]
                    heapq.heappush(active, one)

        for x in range(0, n, MERGE_BYTES):
            inner = (np.flatnonzero(nxt[x : x + MERGE_BYTES] >= 0) + x).astype(place)
            note(inner, self.byte_ranks[data[inner], data[inner + 1]])
        while active:
            rank = heapq.heappop(active)
            found = index.pop(rank)
            at = distinct(np.concatenate(found))
            a, b = self.left[rank], self.right[rank]
            at = at[alive[at] & (sym[at] == a) & (nxt[at] >= 0)]
            at = at[sym[nxt[at]] == b]
            if not len(at):
                continue
            if a == b and len(at) > 1:  # in a run of the same token, every other pair from the left
                chained = np.concatenate([[False], nxt[at[:-1]] == at[1:]])
                head = np.flatnonzero(~chained)
                depth = np.arange(len(at)) - np.repeat(head, np.diff(np.concatenate([head, [len(at)]])))
                at = at[depth % 2 == 0]
            gone = nxt[at]
            sym[at] = self.made[rank]
            alive[gone] = False
            after = nxt[gone]
            nxt[at] = after
            some = after >= 0
            prv[after[some]] = at[some]
            before = prv[at]
            touched = np.concatenate([before[before >= 0], at[some]])
            note(touched, self.rank(sym[touched].astype(np.int64), sym[nxt[touched]]))
        ends = np.concatenate([[0], np.cumsum(alive)])
        return sym[alive], ends[begin]

    def lookup(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For runs of texts: first and last text, their ids end to end, and the n + 1 places where each text's start.

        Pre-tokens are cut and hashed for a run of texts at a time; of a block of runs only hashes and new pre-tokens are kept.
        """
        row = 0
        while row < len(texts):
            if len(self.off) > KEEP:
                self.forget()
            runs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
            new = _New()
            held = 0
            while row < len(texts) and held < BLOCK_CHARS:
                to, chars = row, 0
                pieces: list[str] = []
                per_text: list[int] = []
                while to < len(texts) and (to == row or chars + len(texts[to]) < CUT_CHARS):
                    pieces += (own := self._pieces(texts[to]))
                    per_text.append(len(own))
                    chars += len(texts[to])
                    to += 1
                h, other, per_piece, code, first, size = self._hash(pieces)
                # all that follows looks up distinct hashes in order; which gives the number among them of each pre-token's
                at = np.argsort(h)
                ordered = h[at]
                head = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(h)]
                which = np.empty(len(h), np.int32)
                which[at] = np.cumsum(head) - 1
                unique, at = ordered[head], at[head]
                words = self.numbers(unique)
                fresh = (words < 0) & ~new.has(unique)
                at = at[fresh]
                new.add(unique[fresh], other[at], code[ragged(first[at], size[at])], size[at])
                # two pre-tokens with one hash: the second gets a word of its own, which the table doesn't find
                expected = new.other_of(unique)
                expected[words >= 0] = self.other[words[words >= 0]]
                odd = np.flatnonzero(expected[which] != other)
                new.add_alone(len(runs), odd, other[odd], code[ragged(first[odd], size[odd])], size[odd])
                runs.append((row, to, unique, which, np.concatenate([[0], np.cumsum(per_piece)])[np.cumsum([0, *per_text])]))
                row, held = to, held + chars
            base = len(self.off) - 1
            if new.count:
                order = np.argsort(new.hashes)
                self._store(new.hashes[order], new.words[order] + base, new.others, *self._encoded(new.take_codes(), new.sizes))
            for number, (start, end, unique, which, starts) in enumerate(runs):
                words = self.numbers(unique)[which]
                places, alone = new.alone.get(number, (np.zeros(0, np.int64),) * 2)
                words[places] = base + alone
                count = self.off[words + 1] - self.off[words]
                place = np.concatenate([[0], np.cumsum(count)])
                yield start, end, self.flat[ragged(self.off[words], count)], place[starts]

    def _pieces(self, text: str) -> list[str]:
        """The text between special tokens, and those."""
        if self.special_in is None:
            return [text]
        out: list[str] = []
        done = 0
        for found in self.special_in.finditer(text):
            out += [text[done : found.start()], _Special(found.group())]
            done = found.end()
        return [*out, text[done:]] if out else [text]

    def _hash(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Both hashes of each pre-token; how many each piece has; the code points, and each pre-token's first and number of them."""
        plain = ["" if isinstance(p, _Special) else p for p in pieces]
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in plain])]).astype(np.int64)
        code, start = cut("".join(plain), bounds[:-1])
        size = np.diff(np.concatenate([start, [len(code)]])).astype(np.int64) if len(start) else np.zeros(0, np.int64)
        values = mix(code.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(41))
        h = span_hashes(values, start, start + size)
        other = span_hashes(code.astype(U64) * U64(0xD6E8FEB86659FD93), start, start + size)
        firsts = np.searchsorted(start, bounds, side="left")
        counts = np.diff(firsts)
        marks = [i for i, p in enumerate(pieces) if isinstance(p, _Special)]
        if marks:
            at = firsts[marks]
            keys = np.array([self._special_key(str(pieces[i])) for i in marks], U64)
            h, other = np.insert(h, at, keys), np.insert(other, at, keys)
            start, size = np.insert(start, at, 0), np.insert(size, at, 0)
            counts[marks] = 1
        return h, other, counts, code, start, size

    def _encoded(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, given as code points end to end and how many each has; and where each one's ids start."""
        data = np.frombuffer(codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        place = np.concatenate([[0], np.cumsum(width)])
        begin = place[np.concatenate([[0], np.cumsum(sizes)])]
        return self.merge_all(data, begin)


def refuse_unsupported(spec: dict) -> None:
    """Raises for a vocabulary file whose results this encoder wouldn't give."""
    model, cutter = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [f"model.{k}" for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += ["normalizer"] if spec.get("normalizer") else []
    odd += ["pre_tokenizer"] if cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True) else []
    odd += [f"{t['content']}: {k}" for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip") if t.get(k)]
    if model.get("type", "BPE") != "BPE" or odd:
        raise ValueError(f"not a byte-level BPE file that is supported: {', '.join(odd) or model.get('type')}")


@cache
def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


@cache
def encoder(path: str) -> Encoder:
    """One a worker and vocabulary."""
    return Encoder(path)


def lookup_column(enc: Encoder, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """What lookup gives, for a column: only a block's texts at a time are strings, and what a block took goes back to the system."""
    for x, y in chunks(text_buffers(column)[1], BLOCK_CHARS):
        for a, z, flat, at in enc.lookup(texts_of(column.slice(x, y - x))):
            yield x + a, x + z, flat, at
        give_back()


def texts_of(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]
