"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact similarity.

DataFrame functions only. Words are runs of letters and digits, lower-cased; a text is compared by
runs of five words (of all its words, if an item has fewer). The weight of a run is how often it occurs.
A document holds an item if one of its windows of the item's number of words has a weighted Jaccard similarity of
the threshold or more with it: sum of the smaller weights over sum of the larger ones.

1. A window that shares no run with an item has similarity 0 with it, and one of w runs reaches the threshold t with an item
   of m runs only if t * (w + m) / (1 + t) of its runs or more occur in the item. All windows with so many are made that
   start between the least and the greatest start at which one of the item's runs is aligned in both: outside of
   these bounds a window gains nothing, as what it leaves behind when moved towards them isn't a run of the item. So no
   best window is lost here, also where words were inserted, left out or cut off at an end.
2. Each window and item gets a 64-bit SimHash of its weighted runs. The bits are cut into radius + 1 blocks; fingerprints within
   the radius agree in one block at least, so an equi-join on (item, block, bits) finds all of
   them, and the full distance is tested after it.
3. What is left is verified exactly from the weights.

SimHash of all windows of every item length, made before anything else, would do the same with far more work: the sums of one length
over running frames cost about 3900 CPU seconds a GB of text in DataFrame functions, and 29 lengths occur in a benchmark of 40 items. So
step 1 comes first here; fingerprints and blocks take what it leaves.

At similarity 0.8 two fingerprints differ in 9.7 bits of 64 on average (standard deviation 2.9);
radius 22 loses about one such pair in 100,000, and none that is nearly equal.

Null or odd input: null texts, and texts without letters or digits, match nothing. A document shorter than an item is one
window. Items with equal words share one search and all report. Equal documents are searched once (by digest) and all report.
Rows without id report with a null id. No items or no documents: no rows. Extra columns are ignored by matches, kept by keep_clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import broadcast_if_small, drop_staged, fresh, semi_join, stage_table

K, THRESHOLD, RADIUS, BITS = 5, 0.8, 22, 64
#: Runs that a counter of 16 bits can count.
LANE_RUNS = 65_535
#: Bytes of a digest in a broadcast, with overhead.
DIGEST_BYTES = 64
#: Item runs are broadcast up to this size (24 bytes each and overhead), joined by shuffle beyond.
BROADCAST_BYTES, RUN_BYTES = 8 << 20, 64


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def let(value: Column, then) -> Column:
    """then(value), with value computed once: a lambda variable stands for it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def runs_of(words: Column, k: int) -> Column:
    """Hashes of every k consecutive words; none if there are fewer."""

    def of(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)]))

    return let(words, of)


def simhash(runs: Column) -> Column:
    """64 bits: bit b is set if more than half of the runs' hashes have it.

    Sixteen sums hold four counters of 16 bits each, of at most LANE_RUNS runs; such parts' counters are added up as 64 longs.
    """
    mask = F.lit(0x0001000100010001)
    nothing = F.lit(0).cast("long")
    zero = F.array_repeat(nothing, 16)

    def counters(part: Column) -> Column:
        sums = F.aggregate(part, zero, lambda acc, h: F.transform(acc, lambda a, j: a + _shift(h, j).bitwiseAND(mask)))
        lane = lambda s, at: F.transform(s, lambda a: F.shiftrightunsigned(a, at).bitwiseAND(F.lit(0xFFFF)))
        return let(sums, lambda s: F.concat(*[lane(s, at) for at in range(0, BITS, 16)]))

    def bits(r: Column) -> Column:
        parts = F.sequence(F.lit(0), F.floor(F.greatest(F.size(r) - 1, F.lit(0)) / LANE_RUNS).cast("int"))
        total = F.aggregate(parts, F.array_repeat(nothing, BITS), lambda acc, i: F.zip_with(acc, counters(F.slice(r, i * LANE_RUNS + 1, LANE_RUNS)), lambda a, b: a + b))
        return F.aggregate(F.transform(total, lambda n, b: F.when(n > F.size(r) / 2, _left(b)).otherwise(nothing)), nothing, lambda a, x: a.bitwiseOR(x))

    return let(runs, bits)


def _shift(h: Column, j: Column) -> Column:
    return F.call_function("shiftrightunsigned", h, j)


def _left(j: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), j)


def starts_of() -> Column:
    """Starts from low to high of windows of n_runs runs that hold at least so many (least) of places, which are in order.

    A window counts at the first of places that it holds, so each start comes once.
    """
    last = lambda i: F.get("places", i + F.col("least") - 1)
    none = F.array().cast("array<int>")

    def of(place: Column, i: Column) -> Column:
        a = F.greatest(F.col("low"), F.get("places", i - 1) + 1, last(i) - F.col("n_runs") + 1)
        b = F.least(F.col("high"), place)
        return F.when(last(i).isNotNull() & (a <= b), F.sequence(a, b)).otherwise(none)

    return F.flatten(F.transform("places", of))


def blocks(bits: Column, radius: int) -> Column:
    """(number, bits) of each of radius + 1 blocks."""
    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
    cells = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(bits, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    return F.explode(F.array(*cells))


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = K, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity (of the best window), distance, word (where it starts), digest (of the document's text)."""
    best, named = text_matches(docs, items, text, item_id, item_text, k, threshold, radius)
    ids = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.unhex(F.md5(F.col(f"`{text}`"))).alias("digest"))
    # both are tables of their own, so a hot text's rows may be split over tasks where they are joined by shuffle
    return ids.join(broadcast_if_small(best, 2 * DIGEST_BYTES), "digest").join(named.select("item", "item_id"), "item").select("doc_id", "item_id", "similarity", "distance", "word", "digest")


def text_matches(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = K, threshold: float = THRESHOLD, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """Matches of distinct texts and items (digest, item, similarity, distance, word), and the items' names (item_id, item)."""
    named = items.select(F.col(f"`{item_id}`").alias("item_id"), words_of(F.col(f"`{item_text}`")).alias("words")).where("size(words) > 0")
    named = stage_table(named.withColumn("item", F.md5(F.array_join("words", " "))), "items")
    # a row for each distinct item: its size in words, run length, runs
    size = F.size("words")
    runs = F.when(size >= k, runs_of(F.col("words"), k))
    for n in range(1, k):
        runs = F.when(size == n, runs_of(F.col("words"), n)).otherwise(runs)
    own = named.dropDuplicates(["item"]).select("item", size.alias("size"), F.least(size, F.lit(k)).alias("k"), runs.alias("runs"))
    own = stage_table(own.withColumn("bits", simhash(F.col("runs"))), "item-runs")
    about = own.agg(F.sort_array(F.collect_set("k")).alias("ks"), F.coalesce(F.sum(F.size("runs")), F.lit(0)).alias("n")).first()
    places = own.select("item", "size", "k", F.posexplode("runs").alias("at", "run")).groupBy("item", "size", "k", "run").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    if about["n"] * RUN_BYTES <= BROADCAST_BYTES:
        places = F.broadcast(places)

    texts = docs.select(F.col(f"`{text}`").alias("text")).where("text is not null")
    texts = texts.select(F.unhex(F.md5("text")).alias("digest"), "text")
    seeds = None
    for n in about["ks"] or [k]:  # one run length, unless an item has fewer words
        every = texts.select("digest", let(words_of(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), runs_of(w, n).alias("runs"))).alias("s"))
        every = every.select("digest", F.col("s.n").alias("n"), F.posexplode_outer("s.runs").alias("place", "run"))  # outer: no filter on the runs, which would make them twice
        found = every.join(places.where(F.col("k") == n), "run")
        aligned = [F.greatest(F.lit(0), F.least(F.col("place") - F.col(at), F.col("n") - F.col("size"))) for at in ("last_at", "first_at")]
        found = found.select("digest", "item", "size", "k", "n", "place", aligned[0].alias("low"), aligned[1].alias("high"))
        seeds = found if seeds is None else seeds.union(found)
    seeds = seeds.groupBy("digest", "item", "size", "k", "n").agg(F.sort_array(F.collect_set("place")).alias("places"), F.min("low").alias("low"), F.max("high").alias("high"))
    seeds = seeds.withColumn("n_runs", F.least("size", "n") - F.col("k") + 1)
    least = F.ceil(threshold * (F.col("n_runs") + F.col("size") - F.col("k") + 1) / (1 + threshold) - 1e-9).cast("int")
    seeds = seeds.withColumn("least", F.greatest(F.lit(1), least))
    seeds = stage_table(seeds.select("digest", "item", "k", "n_runs", starts_of().alias("starts")).where("size(starts) > 0"), "seeds")

    digests = stage_table(seeds.select("digest").distinct(), "digests")
    wanted = semi_join(texts, digests, "digest", DIGEST_BYTES).groupBy("digest").agg(F.first("text").alias("text"))
    cut = wanted.select("digest", words_of(F.col("text")).alias("words")).join(seeds, "digest")
    own_runs = F.when(F.col("k") == k, runs_of(F.col("words"), k))
    for n in range(1, k):
        own_runs = F.when(F.col("k") == n, runs_of(F.col("words"), n)).otherwise(own_runs)
    cut = cut.select("digest", "item", "n_runs", own_runs.alias("all"), "starts").select("digest", "item", "n_runs", "all", F.explode_outer("starts").alias("start"))
    windows = cut.select("digest", "item", "start", F.slice("all", F.col("start") + 1, F.col("n_runs")).alias("runs"))
    windows = stage_table(windows.withColumn("bits", simhash(F.col("runs"))), "windows")

    left = windows.select("digest", "item", "start", "bits", blocks(F.col("bits"), radius).alias("b")).select("digest", "item", "start", "bits", "b.block", "b.value")
    right = own.select("item", F.col("bits").alias("item_bits"), blocks(F.col("bits"), radius).alias("b")).select("item", "item_bits", "b.block", "b.value")
    near = left.join(right, ["item", "block", "value"])
    near = near.groupBy("digest", "item", "start").agg(F.first(F.bit_count(F.col("bits").bitwiseXOR(F.col("item_bits")))).alias("distance")).where(F.col("distance") <= radius)

    had = windows.join(near, ["digest", "item", "start"]).select("digest", "item", "start", "distance", F.size("runs").alias("n"), F.explode("runs").alias("run"))
    had = had.groupBy("digest", "item", "start", "distance", "n", "run").agg(F.count("*").alias("times"))
    asked = own.select("item", F.size("runs").alias("item_n"), F.explode("runs").alias("run")).groupBy("item", "item_n", "run").agg(F.count("*").alias("item_times"))
    both = had.join(asked, ["item", "run"]).groupBy("digest", "item", "start", "distance", "n", "item_n").agg(F.sum(F.least("times", "item_times")).alias("both"))
    scored = both.withColumn("similarity", F.col("both") / (F.col("n") + F.col("item_n") - F.col("both"))).where(F.col("similarity") >= threshold)
    best = scored.groupBy("digest", "item").agg(F.max(F.struct("similarity", -F.col("distance"), -F.col("start"))).alias("x"))
    best = stage_table(best.select("digest", "item", F.col("x.similarity").alias("similarity"), (-F.col("x.col2")).alias("distance"), (-F.col("x.col3")).alias("word")), "matches")
    drop_staged(own, seeds, digests, windows)
    return best, named.select("item_id", "item")


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """docs that hold no item, with unchanged columns."""
    best, _ = text_matches(docs, items, text)
    key = fresh(docs, "_digest")
    bad = stage_table(best.select(F.col("digest").alias(key)).distinct(), "bad")
    marked = docs.withColumn(key, F.coalesce(F.unhex(F.md5(F.col(f"`{text}`"))), F.lit(b"")))
    return marked.join(broadcast_if_small(bad, DIGEST_BYTES), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
