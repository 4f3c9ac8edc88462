"""Shards of equal row counts that keep linked documents together.

Documents with equal texts are linked. Balanced label propagation: every
document starts in a shard by its hash; in each round, a group's documents that
are in shards with fewer of its documents ask to move to the shard, of those with
room, where most of their neighbours are. Rounds go on until nobody asks; every
move adds links within shards, so that comes to an end.
Documents of one group in one shard are interchangeable, so a round works on one
row per group with its counts by shard, however large the group. Requests to a
shard are sorted into a bounded number of priority buckets, most links gained
first, and granted, by a join with the buckets' running sums, while the shard's
quota lasts; within the bucket that crosses the quota they are granted in order. Documents
without links fill the shards up afterwards, so that counts differ by at most
one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledger_spark.staging import stage

# Rounds after which propagation is an error; it ends by itself before.
ROUNDS = 1000
# Priorities of requests: powers of two of the links a move gains, and hashes.
GAINS, HASHES = 63, 64
# Buckets of the final numbering for each shard; their counts are summed in one task.
BUCKETS = 1024
# Groups with over one part in so many of all rows are matched by broadcast.
HOT_PART = 1000


def _rows(docs: DataFrame, shards: int) -> DataFrame:
    text = F.col("text").cast("binary")
    key = F.unhex(F.md5(text))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("bigint").alias("text_crc32"),
        key.alias("key"),
        F.pmod(F.xxhash64("doc_id", key), F.lit(shards)).cast("int").alias("start"),
    )


def _groups(rows: DataFrame, shards: int) -> DataFrame:
    """Linked groups: ``key`` and ``held``, the number of their documents in each shard."""
    counts = [F.count(F.when(F.col("start") == s, 1)).alias(f"n{s}") for s in range(shards)]
    found = rows.filter("key IS NOT NULL").groupBy("key").agg(*counts, F.count("*").alias("total")).filter("total > 1")
    return found.select("key", F.array(*[f"n{s}" for s in range(shards)]).alias("held"), "total")


def _loads(groups: DataFrame, shards: int) -> list[int]:
    sums = groups.agg(*[F.coalesce(F.sum(F.col("held")[s]), F.lit(0)) for s in range(shards)]).first()
    return [int(n) for n in sums]


def _requests(groups: DataFrame, room: list[int]) -> DataFrame:
    """Where each group wants its documents, how many would move, and with which priority.

    The wanted shard holds most of the group among the shards with room. Only
    documents in shards that hold less of the group (of equal ones, in later
    shards) ask, so that a group larger than the wanted shard's room fills it
    and goes on to its next-best shard in the next round.
    """
    shards = len(room)
    options = [
        F.struct(F.col("held")[s].alias("n"), F.lit(-s).alias("s"), F.lit(room[s]).cast("bigint").alias("room"))
        for s in range(shards)
        if room[s] > 0
    ]
    best = F.array_max(F.array(*options))
    found = groups.withColumn("best", best).select(
        "key", "held", (-F.col("best.s")).alias("to"), F.col("best.n").alias("there"), F.col("best.room").alias("room")
    )
    behind = _total(_behind(F.col("held"), F.col("to"), F.col("there")))
    found = found.withColumn("ask", F.least(behind, F.col("room")))
    found = found.filter((F.col("there") > 0) & (F.col("ask") > 0))
    bucket = (GAINS - 1 - F.floor(F.log2("there"))) * HASHES + F.pmod(F.xxhash64("key"), F.lit(HASHES))
    return found.withColumn("bucket", bucket.cast("int"))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, n: a + n)


def _behind(held: Column, to: Column, there: Column) -> Column:
    """Counts of the shards from which documents may move to shard ``to``; zero for the others."""
    return F.transform(held, lambda n, s: F.when((n < there) | ((n == there) & (s > to)), n).otherwise(F.lit(0).cast("bigint")))


def _granted(requests: DataFrame) -> DataFrame:
    """Requests in the order of their buckets until the room is used up; the last may be granted in part.

    There are at most shards x ``GAINS`` x ``HASHES`` sums, so they are
    broadcast. One bucket of each shard is sorted.
    """
    sums = requests.groupBy("to", "bucket").agg(F.sum("ask").alias("asked"), F.max("room").alias("most"))
    running = F.sum("asked").over(Window.partitionBy("to").orderBy("bucket"))
    sums = sums.withColumn("running", running).withColumn("before", F.col("running") - F.col("asked")).filter("before < most")
    sums = sums.select("to", "bucket", "before", (F.col("running") <= F.col("most")).alias("whole"))
    open_requests = requests.join(F.broadcast(sums), ["to", "bucket"])
    edge = open_requests.filter("NOT whole")
    ahead = F.sum("ask").over(Window.partitionBy("to").orderBy(F.xxhash64("key"), "key")) - F.col("ask") + F.col("before")
    left = F.col("room") - F.col("ahead")
    edge = edge.withColumn("ahead", ahead).filter(left > 0).withColumn("ask", F.least(F.col("ask"), left))
    names = ["key", "to", "ask", "there"]
    return open_requests.filter("whole").select(*names).union(edge.select(*names))


def _moved(held: Column, to: Column, ask: Column, there: Column) -> Column:
    """Counts by shard after ``ask`` documents went to shard ``to``, taken evenly from those behind it."""
    behind = _behind(held, to, there)
    away = _total(behind)
    # shares of the running counts, so that exactly ``ask`` are taken
    share = lambda upto: F.floor(_total(F.slice(behind, F.lit(1), upto)) * ask / away).cast("bigint")
    left = F.transform(held, lambda n, s: n - F.least(n, share(s + 1) - share(s)))
    taken = _total(held) - _total(left)
    return F.transform(left, lambda n, s: F.when(s == to, n + taken).otherwise(n).cast("bigint"))


def propagate(groups: DataFrame, capacity: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Counts by shard of every group when no document asks to move any more."""
    groups = stage(groups, "groups")
    for _ in range(rounds):
        room = [max(0, c - n) for c, n in zip(capacity, _loads(groups, len(capacity)))]
        if max(room) < 1:
            return groups
        granted = _granted(_requests(groups, room))
        moved = groups.join(granted, "key", "left")
        held = _moved(F.col("held"), F.col("to"), F.col("ask"), F.col("there"))
        held = F.when(F.col("to").isNull(), F.col("held")).otherwise(held)
        moved = stage(moved.select("key", held.alias("held"), "total", F.col("to").isNotNull().alias("changed")), "groups")
        groups = moved.select("key", "held", "total")
        if moved.filter("changed").isEmpty():
            return groups
    raise RuntimeError(f"label propagation still moves documents after {rounds} rounds")


def _placed(rows: DataFrame, groups: DataFrame, total: int, shards: int) -> DataFrame:
    """Rows with the shard of their group, null where a row has no links.

    A group that is in several shards deals its documents by the hash of their
    id, in the proportion of its counts. At most ``HOT_PART`` groups can be
    hot; they are broadcast, and their many rows are not moved.
    """
    running = F.transform(
        "held",
        lambda n, s: F.aggregate(F.slice("held", F.lit(1), s + 1), F.lit(0).cast("bigint"), lambda a, b: a + b) / F.col("total"),
    )
    plan = groups.select("key", running.alias("upto"), "total")
    hot = stage(plan.filter(F.col("total") * HOT_PART > total).select("key", "upto"), "hot")
    cold = plan.filter(F.col("total") * HOT_PART <= total).select("key", "upto")
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) / (1 << 20)
    shard = F.when(F.col("upto").isNotNull(), F.size(F.filter("upto", lambda u: u <= part)))
    shard = F.least(shard, F.lit(shards - 1)).cast("int")
    names = ["doc_id", "size", "text_crc32"]
    alone = rows.filter("key IS NULL").select(*names, F.lit(None).cast("int").alias("shard"))
    known = rows.filter("key IS NOT NULL")
    heavy = known.join(F.broadcast(hot), "key").select(*names, shard.alias("shard"))
    other = known.join(F.broadcast(hot.select("key")), "key", "left_anti")
    light = other.join(cold, "key", "left").select(*names, shard.alias("shard"))
    return alone.union(heavy).union(light)


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = ROUNDS) -> DataFrame:
    """Put every row of ``docs`` into one of ``shards`` shards; counts differ by one at most.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Gives
    ``doc_id``, ``size`` (bytes of the text plus one; null: one), ``text_crc32``
    (null: 0), ``law`` ("rows"), ``shard``, ``slot`` (numbers the rows of a shard
    from 0 without gaps), ``grown_shard`` (null for this law) and ``linked``
    (whether the row has a copy). Null texts have no links. Rows that repeat, or
    have no doc_id, are placed each; an empty table gives no rows.
    """
    rows = stage(_rows(docs, shards), "rows")
    total = rows.count()
    target = [total // shards + (s < total % shards) for s in range(shards)]
    groups = propagate(_groups(rows, shards), target, rounds)
    placed = _placed(rows, groups, total, shards).withColumn("class", F.coalesce("shard", F.lit(shards)))
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(BUCKETS))
    placed = stage(placed.withColumn("bucket", bucket.cast("int")), "placed")

    # at most (shards + 1) x BUCKETS counts: one task sums them up
    counts = placed.groupBy("class", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("class", "bucket")) - F.col("n")
    before = stage(counts.select("class", "bucket", "n", before.alias("before")), "before")
    firsts = {r["class"]: (r["first"], r["n"]) for r in before.groupBy("class").agg(F.min("before").alias("first"), F.sum("n").alias("n")).collect()}

    inside = F.row_number().over(Window.partitionBy("class", "bucket").orderBy("doc_id", "text_crc32")) - 1
    ranked = placed.withColumn("inside", inside).join(F.broadcast(before.drop("n")), ["class", "bucket"])
    first = _by_class("class", [firsts.get(c, (0, 0))[0] for c in range(shards + 1)])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("inside") - first)

    # rows within their shard's target keep its first slots; the others fill what is missing
    linked = [firsts.get(s, (0, 0))[1] for s in range(shards)]
    kept = [min(n, t) for n, t in zip(linked, target)]
    free = firsts.get(shards, (0, 0))[1]
    offsets = [free + sum(linked[:s]) - sum(kept[:s]) - kept[s] for s in range(shards)] + [0]
    missing = [sum(target[:s]) - sum(kept[:s]) for s in range(shards)]
    stays = (F.col("class") < shards) & (F.col("rank") < _by_class("class", [*kept, 0]))
    ranked = ranked.withColumn("filler", F.when(~stays, F.col("rank") + _by_class("class", offsets)))
    shard = F.when(F.col("filler").isNull(), F.col("class")).otherwise(
        F.size(F.filter(F.array(*[F.lit(m) for m in missing]), lambda m: m <= F.col("filler"))) - 1
    )
    ranked = ranked.withColumn("to", shard.cast("int"))
    slot = F.when(F.col("filler").isNull(), F.col("rank")).otherwise(
        _by_class("to", kept) + F.col("filler") - _by_class("to", missing)
    )
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("to").alias("shard"),
        slot.cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("shard").isNotNull().alias("linked"),
    )


def _by_class(column: str, values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])[F.col(column)]
