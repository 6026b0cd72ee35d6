"""Language identification: averaged hashed subword embeddings with a linear softmax.

A document's letters, lower-cased, give subwords: runs of 2 to 4 letters within a word, with
a mark at the word's start and end. Each subword is hashed to a bucket with an embedding; the
mean of a document's embeddings goes through a linear softmax. Embeddings and softmax are
trained together by stochastic gradient descent in numpy; then a part of the sample that
training didn't see sets the softmax's temperature and two bounds. A document is rejected if

* its score (which few subwords pull towards 1 / languages, as by PRIOR more that say nothing) is below the middle between 1 / languages and what almost all held-out rows reach that are predicted right, or
* its subwords are unusual: the mean logarithm of their frequency in training, pulled to that of held-out rows as
  by PRIOR more subwords, is below what almost all of these rows reach, or below the middle between that and what sampled
  texts reach whose letters were exchanged (text in no learned language), if that is less.

The training sample is bounded, in rows (sample_rows) and in subwords (sample_grams, so that long documents can't fill the driver
either); its documents count whole. Rows of one key (of equal texts, if no key is given) are one row of the sample, and are
made one before anything goes to the driver. If there are more labels than sample_rows, the most frequent ones are learned. Prediction needs
one integer score a bucket and language: embedding times softmax, in fixed point, so that sums don't
depend on how documents are batched.

Null or odd input: a null text, or one with no letter, gets `und`, score 0, rejected. Rows
without label or id aren't learned from but are predicted. No labelled row at all: all get `und`, score 0.
Repeated rows get equal results. Extra columns pass through, but for those made here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import U64, chunks, fresh, give_back, text_buffers

ORDERS = (2, 3, 4)
UNKNOWN = "und"
#: Fixed point of the scores, in parts of one.
SCALE = 1 << 14
#: Few subwords prove neither a language nor another one: so many of usual frequency, and of no language, are added to a document's.
PRIOR = 20
#: Share of training's subword frequencies that is spread over all buckets.
SPREAD = 0.05
_SPACE = 32


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 1600  #: at most so many labelled rows are learned from, in equal parts by language
    sample_grams: int = 4_000_000  #: and at most so many characters times orders, which bounds their subwords (but one document a language, its shortest, if none fits)
    bits: int = 16
    dim: int = 16
    epochs: int = 6
    rate: float = 2.0
    calibration_part: int = 5  #: one in so many sampled rows calibrates
    reject_share: float = 0.002  #: of calibration rows that are predicted right, at most this share is rejected
    smooth: float = 0.5  #: so many of the calibration rows count as predicted wrong, which keeps the temperature finite
    seed: int = 7


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # int32, buckets x languages
    temperature: float
    threshold: float
    usual: np.ndarray  # int32, a bucket's log frequency over the uniform one, in fixed point
    mean: float  # of held-out rows
    least: float
    settings: Settings = field(default_factory=Settings)


@cache
def _lower() -> np.ndarray:
    """Code point -> its lower-case letter, or space if it isn't a letter."""
    out = np.full(0x110000, _SPACE, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


def _letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the rows with single spaces between words; one space before, between and after rows.

    Row r's words lie after position marks[r] up to marks[r + 1]; both are spaces.
    """
    inner = np.insert(data, offsets[1:-1], 10) if len(offsets) > 2 else data
    at = offsets + np.arange(len(offsets))
    at[-1] -= 1 if len(offsets) > 1 else 0
    text = np.concatenate([[10], inner, [10]]).astype(np.uint8)
    codes = np.frombuffer(text.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum((text & 0xC0) != 0x80)  # characters up to each byte
    marks = starts[np.concatenate([at[:-1], [len(text) - 1]])] - 1 if len(offsets) > 1 else np.zeros(1, np.int64)
    codes = _lower()[codes]
    space = codes == _SPACE
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[marks] = True
    place = np.cumsum(keep) - 1
    return codes[keep], place[marks]


def _grams(codes: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the places where a subword starts, and its bucket. No subword has a space inside."""
    wide = codes.astype(U64)
    space = codes == _SPACE
    for n in ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        ok = np.ones(m, bool)
        for j in range(1, n - 1):
            ok &= ~space[j : j + m]
        if n == 2:
            ok &= ~(space[:m] & space[1 : 1 + m])
        h = wide[:m].copy()
        for j in range(1, n):
            h = h * U64(0x9E3779B1) + wide[j : j + m]
        h *= U64(0xD6E8FEB86659FD93 + 2 * n)
        at = np.flatnonzero(ok)
        yield at, (h[at] >> U64(64 - bits)).astype(np.int64)


def _rows_of(at: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Numbers of the first subword of each row; the last is their count. A subword's row is that of its second place."""
    return np.searchsorted(at + 1, marks + 1, side="left")


def _exchanged(codes: np.ndarray) -> np.ndarray:
    """Letters exchanged within each 32 code points; spaces stay."""
    swap = np.random.default_rng(3).permutation(32).astype(np.uint32)
    return np.where(codes == _SPACE, codes, (codes & ~np.uint32(31)) | swap[codes & np.uint32(31)])


def _features(bits: int, part: int):
    def counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit = [h for _, h in _grams(codes, bits)]
        ids, n = np.unique(np.concatenate(hit), return_counts=True) if hit else (np.zeros(0, np.int64),) * 2
        return ids.astype(np.int32), n.astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            keys = b.column("key").to_pylist()
            none = (np.zeros(0, np.int32),) * 2
            out = []
            for r in range(len(b)):
                one = data[offsets[r] : offsets[r + 1]]
                codes, _ = _letters(one, np.array([0, len(one)]))
                out.append((*counts(codes), *(counts(_exchanged(codes)) if keys[r] % part == 0 else none)))
            made = [pa.array([x[i].tobytes() for x in out], pa.binary()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("key"), *made], names=["lang", "key", "ids", "n", "other_ids", "other_n"])

    return run


def sample(docs: DataFrame, text: str, lang: str, key: Column, settings: Settings) -> list:
    """Subword counts of the sampled documents, made by the executors. Which rows are taken depends on key alone."""
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.xxhash64(key).alias("key")).where("text is not null and lang is not null")
    found = rows.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("key", 0.02).alias("keys"))
    # as many labels as the sample has rows, at most
    counts = {r["lang"]: r["keys"] for r in found.orderBy(F.col("rows").desc(), "lang").limit(settings.sample_rows).collect()}
    if not counts:
        return []
    each = max(1, settings.sample_rows // len(counts))
    # twice the bound by chance of the hash, then the smallest hashes: a hot language is never sorted whole
    parts = 1 << 30
    limits = docs.sparkSession.createDataFrame([(name, min(parts, int(parts * (2 * each + 20) / max(1, n)))) for name, n in counts.items()], "lang string, most long")
    few = rows.join(F.broadcast(limits), "lang").where(F.pmod("key", F.lit(parts)) < F.col("most"))
    sizes = few.groupBy("lang", "key").agg(F.max(F.char_length("text")).alias("chars")).collect()
    chosen, room = [], settings.sample_grams // len(counts)
    for name in sorted(counts):
        own = sorted((r for r in sizes if r["lang"] == name), key=lambda r: r["key"])
        left, took = room, len(chosen)
        for r in own[:each]:
            grams = min(len(ORDERS) * r["chars"], 1 << settings.bits)
            if grams <= left:
                left -= grams
                chosen.append((name, r["key"]))
        if own and len(chosen) == took:  # none fits: a language is learned from its shortest then
            chosen.append((name, min(own, key=lambda r: (r["chars"], r["key"]))["key"]))
    picked = docs.sparkSession.createDataFrame(chosen, "lang string, key long")
    one = few.join(F.broadcast(picked), ["lang", "key"]).groupBy("lang", "key").agg(F.min("text").alias("text"))
    got = one.mapInArrow(_features(settings.bits, settings.calibration_part), "lang string, key long, ids binary, n binary, other_ids binary, other_n binary").collect()
    return sorted(got, key=lambda r: (r["lang"], r["key"]))


def train(rows: list, settings: Settings) -> Model | None:
    """Stochastic gradient descent on the sampled rows' subword counts, then calibration."""
    if not rows:
        return None
    langs = sorted({r["lang"] for r in rows})
    cases, whole, others = [], [], []
    for r in rows:
        if r["other_ids"]:
            others.append((np.frombuffer(r["other_ids"], np.int32), np.frombuffer(r["other_n"], np.int32)))
        ids, n = np.frombuffer(r["ids"], np.int32), np.frombuffer(r["n"], np.int32)
        if len(ids):
            cases.append((ids, (n / n.sum()).astype(np.float32), langs.index(r["lang"])))
            whole.append((ids, n))
    rng = np.random.default_rng(settings.seed)
    order = rng.permutation(len(cases))
    held = {int(i) for k, i in enumerate(order) if k % settings.calibration_part == 0} if len(cases) >= 10 * settings.calibration_part else set()
    learn = [i for i in range(len(cases)) if i not in held]
    emb = rng.normal(0, 0.1, (1 << settings.bits, settings.dim)).astype(np.float32)
    out = rng.normal(0, 0.1, (settings.dim, len(langs))).astype(np.float32)
    total, done = max(1, settings.epochs * len(learn)), 0
    for _ in range(settings.epochs):
        for i in rng.permutation(learn):
            ids, w, y = cases[int(i)]
            rate = settings.rate * (1 - done / total)
            done += 1
            mean = w @ emb[ids]
            z = mean @ out
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            step = out @ p
            out -= rate * np.outer(mean, p)
            # counts differ by orders of size between short and long texts; the square root evens the steps
            emb[ids] -= rate * np.outer(np.sqrt(w) * w.sum(), step).astype(np.float32) * 0.5
    scores = np.rint((emb @ out) * SCALE).astype(np.int32)
    tested = sorted(held) or learn
    test = [cases[i] for i in tested]
    z = np.array([w.astype(np.float64) @ scores[ids] / SCALE * _weight(int(whole[i][1].sum())) for i, (ids, w, _) in zip(tested, test)]).reshape(-1, len(langs))
    y = np.array([c for _, _, c in test], int)
    temperature = calibrated(z, y, settings.smooth)
    p = _softmax(z / temperature)
    right = p.argmax(1) == y if len(y) else np.zeros(0, bool)

    often = np.zeros((len(langs), 1 << settings.bits))
    for i in learn:
        ids, w, c = cases[i]
        often[c, ids] += w
    often = (often / np.maximum(often.sum(1, keepdims=True), 1e-12)).mean(0)
    usual = np.rint(np.log((1 - SPREAD) * often * (1 << settings.bits) + SPREAD) * SCALE).astype(np.int32)
    sums = [(int((usual[ids].astype(np.int64) * n).sum()), int(n.sum())) for ids, n in (whole[i] for i in tested)]
    mean = float(np.mean([x / (n * SCALE) for x, n in sums])) if sums else 0.0
    threshold, least = 0.0, -np.inf
    if right.any():
        # of the values in order, so that no more than the share lies below, and none where rows are few
        reached = float(np.quantile(np.round(p.max(1), 6)[right], settings.reject_share, method="lower"))
        threshold = (reached + 1 / len(langs)) / 2
        known = np.array([_pulled(x, n, mean) for x, n in sums])[right]
        reached = float(np.quantile(known, settings.reject_share, method="lower"))
        far = [_pulled(int((usual[ids].astype(np.int64) * n).sum()), int(n.sum()), mean) for ids, n in others] or [float(usual.min()) / SCALE]
        least = min(reached, (reached + float(np.median(far))) / 2)
    return Model(langs, scores, temperature, threshold, usual, mean, least, settings)


#: Temperatures that calibration tries.
TEMPERATURES = np.exp(np.linspace(np.log(1e-4), np.log(1e3), 161))


def calibrated(z: np.ndarray, y: np.ndarray, smooth: float) -> float:
    """The temperature with the least cross entropy against labels of which smooth rows, spread over all, are wrong.

    Without that, rows that are all predicted right would ask for a temperature of 0, and every score would be 1.
    """
    if not len(y) or z.shape[1] < 2:
        return 1.0
    wrong = min(0.5, smooth / (len(y) + 2 * smooth))
    want = np.full(z.shape, wrong / (z.shape[1] - 1))
    want[np.arange(len(y)), y] = 1 - wrong
    loss = []
    for t in TEMPERATURES:
        scaled = z / t
        top = scaled.max(1, keepdims=True)
        loss.append(float((want * (np.log(np.exp(scaled - top).sum(1, keepdims=True)) + top - scaled)).sum(1).mean()))
    return float(TEMPERATURES[int(np.argmin(loss))])


def _weight(count):
    """Of a text's scores: few subwords say little, so that a lone letter has no language for certain."""
    return count / (count + PRIOR)


def _pulled(total, count, mean: float):
    """Mean of count values with total in fixed point, and PRIOR times the given mean."""
    return (total / SCALE + PRIOR * mean) / (count + PRIOR)


def _softmax(z: np.ndarray) -> np.ndarray:
    if not z.size:
        return z
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def score_rows(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language number (-1: no letter) and score of each row, and whether it is rejected."""
    n, k = len(offsets) - 1, len(model.langs)
    pick, top, out = np.full(n, -1, np.int64), np.zeros(n), np.ones(n, bool)
    for a, b in chunks(offsets):
        codes, marks = _letters(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        sums, usual, count = np.zeros((b - a, k), np.int64), np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
        for at, bucket in _grams(codes, model.settings.bits):
            rows = _rows_of(at, marks)
            count += np.diff(rows)
            total = np.zeros(len(at) + 1, np.int64)
            for j in range(k):
                np.cumsum(model.scores[bucket, j], out=total[1:])
                sums[:, j] += total[rows[1:]] - total[rows[:-1]]
            np.cumsum(model.usual[bucket], out=total[1:])
            usual += total[rows[1:]] - total[rows[:-1]]
        some = count > 0
        z = sums[some] / (count[some, None] * SCALE * model.temperature) * _weight(count[some, None])
        p = _softmax(z)
        if some.any():
            pick[a:b][some] = p.argmax(1)
            top[a:b][some] = np.clip(np.round(p.max(1), 6), 0, 1)
            out[a:b][some] = (top[a:b][some] < model.threshold) | (_pulled(usual[some], count[some], model.mean) < model.least)
    return pick, top, out


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", learn: Column | None = None, key: Column | None = None, settings: Settings | None = None) -> DataFrame:
    """docs with lang_pred, score and rejected.

    learn: which rows may be learned from (all with a label, if None). key: what the choice of
    the sample hashes (the text, if None). The model fits once, when this is called.
    """
    settings = settings or Settings()
    pool = docs if learn is None else docs.where(learn)
    model = train(sample(pool, text, lang, F.col(f"`{text}`") if key is None else key, settings), settings)
    made = ["lang_pred", "score", "rejected"]
    base = docs.drop(*[c for c in made if c in docs.columns and c not in (text, lang)])
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffers(b.column(text))
            if model is None:
                pick, top, out = np.full(len(b), -1), np.zeros(len(b)), np.ones(len(b), bool)
            else:
                pick, top, out = score_rows(data, offsets, model)
            names = [UNKNOWN, *(model.langs if model else [])]
            lang_pred = pa.array([names[i + 1] for i in pick.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, lang_pred, pa.array(top, pa.float64()), pa.array(out, pa.bool_())], names=[f.name for f in schema.fields])
        give_back()

    return base.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def keep_known(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """docs without those that identify rejects, with unchanged columns."""
    flag, pred, score = fresh(docs, "rejected"), fresh(docs, "lang_pred"), fresh(docs, "score")
    if (flag, pred, score) != ("rejected", "lang_pred", "score"):
        safe = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(docs.columns)])
        names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
        found = identify(safe, names["text"], names["lang"], settings=settings).where("not rejected")
        return found.select(*[F.col(names[c]).alias(c) for c in docs.columns])
    return identify(docs, settings=settings).where("not rejected").select(*[F.col(f"`{c}`") for c in docs.columns])
