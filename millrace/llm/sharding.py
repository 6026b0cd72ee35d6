"""Sharding by balanced label propagation.

Documents that share a link (here: an equal text) should lie in one shard. Linked documents start in the shard of
their first link's hash; in each round a link counts its members by shard (partial sums, so a hot link costs no
more than others) and names the shards it wants: those with most of its members that have room for it, one if it
fits into one, as few as possible otherwise. Members elsewhere, and those over a shard's quota, ask to move
there; a shard accepts as many as its quota has room for, by whole links where it can. Rounds go on until few moves
are left. Then what is still over a quota and the unlinked documents fill the room that is left, which makes the law exact:

`rows`: the numbers of documents of any two shards differ by one at most.

Null or odd input: a null text has size 8, crc32 0 and no link; equal rows are linked, and each has its own slot.
Null ids stay null and are placed like others. Fewer documents than shards: some shards are empty. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import drop_staged, stage_table, text_bytes

SHARDS, ROUNDS = 24, 8
#: Rows that are numbered in one task, about; linked rows of a shard are numbered in so many parts by link, and each of these in so many at least.
RUN_ROWS = 50_000
LINK_RUNS, NODE_RUNS = 16, 16
#: Finer parts in which a shard's arrivals are accepted.
LINK_PARTS, NODE_PARTS = 64, 64


def number(df: DataFrame, group: list[str], part: Column, name: str, order: tuple[str, ...] = ("node",)) -> DataFrame:
    """A gapless number from 0 within each group. Only rows of one part are sorted together; parts are counted first."""
    df = df.withColumn("_part", part)
    counts = df.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*group, "_part").orderBy(*order)
    placed = df.withColumn("_at", F.row_number().over(within) - 1)
    return placed.join(offsets, [*group, "_part"]).withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_before", "_at")


def _accepted(asks: DataFrame, room: list[int]) -> DataFrame:
    """As many of the asks as there is room, whole parts of links first, then parts of the nodes of one more part.

    Two small counts (shards x parts) go to the driver.
    """
    asks = asks.withColumn("lp", F.pmod(F.xxhash64("link"), F.lit(LINK_PARTS)).cast("int")).withColumn("np", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(NODE_PARTS)).cast("int"))
    counts: dict[int, dict[int, dict[int, int]]] = {}
    for r in asks.groupBy("target", "lp", "np").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["target"], {}).setdefault(r["lp"], {})[r["np"]] = r["n"]
    ok = F.lit(False)
    for target, by_link in counts.items():
        left, whole, some = room[target], [], None
        for lp in sorted(by_link):
            n = sum(by_link[lp].values())
            if n <= left:
                whole.append(lp)
                left -= n
            elif some is None:
                some = lp
        take = F.col("lp").isin(whole) if whole else F.lit(False)
        if some is not None:
            nodes = []
            for p in sorted(by_link[some]):
                if by_link[some][p] <= left:
                    nodes.append(p)
                    left -= by_link[some][p]
            if nodes:
                take = take | ((F.col("lp") == some) & F.col("np").isin(nodes))
        ok = ok | ((F.col("target") == target) & take)
    return asks.where(ok).select("node", "target")


def propagate(members: DataFrame, quotas: list[int], rounds: int = ROUNDS, settle: float = 0.001) -> DataFrame:
    """members: node, link (a node may have several). Returns node, link, label: one label a node, within the quotas but for the start."""
    shards = len(quotas)
    labels = stage_table(members.groupBy("node").agg(F.min("link").alias("link")).select("node", F.pmod(F.xxhash64("link"), F.lit(shards)).cast("int").alias("label")), "labels")
    total = labels.count()
    single = members.count() == total
    for _ in range(rounds):
        load = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
        room = [max(0, quotas[s] - load.get(s, 0)) for s in range(shards)]
        share = [min(1.0, quotas[s] / max(1, load.get(s, 0))) for s in range(shards)]  # of those there, how many can stay
        placed = members.join(labels, "node")
        tally = placed.groupBy("link").agg(F.array(*[F.sum((F.col("label") == s).cast("long")) for s in range(shards)]).alias("had"), F.count("*").alias("size"))
        # best shards first: (members there, a tie by hash), and how many of the link each could hold
        places = F.array(*[F.struct((-F.col("had")[s]).alias("n"), F.xxhash64("link", F.lit(s)).alias("h"), F.lit(s).alias("s"), F.floor(F.col("had")[s] * F.lit(share[s]) + F.lit(room[s])).alias("can")) for s in range(shards)])
        usable = F.filter(F.array_sort(places), lambda p: p["can"] > 0)
        held = F.aggregate(usable, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("m")), lambda a, p: F.when(a["sum"] >= F.col("size"), a).otherwise(F.struct((a["sum"] + p["can"]).alias("sum"), (a["m"] + 1).alias("m"))))
        # a table of its own: in the join below a hot link's members may then be split over tasks
        wants = tally.select("link", F.transform(F.slice(usable, 1, F.greatest(held["m"], F.lit(1))), lambda p: F.struct(p["s"].alias("s"), (-p["n"]).alias("n"))).alias("want"))
        wants = stage_table(wants, "wants")
        stays = F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 20)) < F.element_at(F.array(*[F.lit(int(x * (1 << 20))) for x in share]), F.col("label") + 1)
        asks = placed.join(wants, "link").select("node", "link", "label", F.filter("want", lambda w: w["s"] != F.col("label")).alias("others"), F.exists("want", lambda w: w["s"] == F.col("label")).alias("home"), stays.alias("stays"))
        pick = F.get("others", F.pmod(F.xxhash64("node", F.lit(2)), F.greatest(F.size("others"), F.lit(1))).cast("int"))
        asks = asks.select("node", "link", "label", F.when(F.col("home") & F.col("stays"), F.col("label")).otherwise(F.coalesce(pick["s"], F.col("label"))).alias("target"), F.coalesce(pick["n"], F.lit(0)).alias("n"))
        if not single:
            # of several links' wishes, the shard with most neighbours
            asks = asks.groupBy("node", "label", "target").agg(F.sum("n").alias("n"), F.min("link").alias("link"))
            asks = asks.groupBy("node", "label").agg(F.max(F.struct("n", F.col("target"), F.col("link"))).alias("x")).select("node", "label", "x.link", "x.target")
        moving = stage_table(asks.where("target <> label").select("node", "link", "target"), "asks")
        moves = stage_table(_accepted(moving, room), "moves")
        last, labels = labels, stage_table(labels.join(moves, "node", "left").select("node", F.coalesce("target", "label").alias("label")), "labels")
        moved = moves.count()
        drop_staged(last, wants, moving, moves)
        if moved <= settle * total:
            break
    return members.join(labels, "node").select("node", "link", "label")


def cut_share(placed: DataFrame) -> DataFrame:
    """pairs, cut: pairs of linked documents, and how many lie in different shards, from counts alone. placed: link, label."""
    own = placed.groupBy("link", "label").agg(F.count("*").alias("n")).groupBy("link").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("inside"))
    return own.agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("pairs"), F.sum(F.col("m") * (F.col("m") - 1) / 2 - F.col("inside")).alias("cut"))


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; a row for each row of docs."""
    t = F.col(f"`{text}`")
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), (text_bytes(t) + 8).alias("size"), F.coalesce(F.crc32(t), F.lit(0)).cast("long").alias("text_crc32"), F.unhex(F.md5(t)).alias("digest"))
    slim = stage_table(slim.withColumn("node", F.monotonically_increasing_id()), "slim")
    total = slim.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    groups = stage_table(slim.where("digest is not null").groupBy("digest").agg(F.count("*").alias("m"), F.min("node").alias("link")).where("m > 1"), "groups")
    members = stage_table(slim.join(groups, "digest").select("node", "link"), "members")
    drop_staged(groups)
    linked = propagate(members, quotas, rounds).select("node", "link", "label")
    runs = max(NODE_RUNS, total // (shards * LINK_RUNS * RUN_ROWS))
    spread = F.pmod(F.xxhash64("link"), F.lit(LINK_RUNS)) * runs + F.pmod(F.xxhash64("node"), F.lit(runs))
    # the start may have put more into a shard than its quota: what is over is dealt out with the rest
    over = number(linked, ["label"], spread, "at", ("link", "node"))
    quota = F.element_at(F.array(*[F.lit(q) for q in quotas]), F.col("label") + 1)
    kept = stage_table(over.where(F.col("at") < quota).select("node", F.col("label").alias("shard")), "kept")
    load = {r["shard"]: r["count"] for r in kept.groupBy("shard").count().collect()}
    parts = max(1, total // RUN_ROWS)
    rest = slim.select("node").join(kept, "node", "left_anti").join(linked.select("node", "link"), "node", "left").withColumn("g", F.lit(0))
    by_node = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(parts))
    free = number(rest, ["g"], F.when(F.col("link").isNull(), F.lit(1 << 60) + by_node).otherwise(F.pmod(F.xxhash64("link"), F.lit(64)) * parts + by_node), "at", ("link", "node"))
    shard = F.lit(None).cast("int")
    edge = 0
    cases = []
    for s in range(shards):
        start, edge = edge, edge + quotas[s] - load.get(s, 0)
        if edge > start:
            cases.append((edge, s))
    for to, s in reversed(cases):
        shard = F.when(F.col("at") < to, F.lit(s)).otherwise(shard)
    every = stage_table(kept.union(free.select("node", shard.alias("shard"))), "placed")
    slots = number(every, ["shard"], F.pmod(F.xxhash64("node", F.lit(4)), F.lit(max(1, parts // shards))), "slot")
    return slim.join(slots, "node").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("digest"))


def layout(sharded: DataFrame, folder: str) -> None:
    """Writes rows partitioned by shard; a shard's files hold its slots."""
    sharded.write.mode("overwrite").partitionBy("shard").parquet(folder)
