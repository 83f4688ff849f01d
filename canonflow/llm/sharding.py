"""Sharding by balanced label propagation, in DataFrame functions alone.

Documents with equal texts are linked.  Every document starts in the shard of
its doc_id's hash.  In a round, each linked document asks for the shard where
its neighbours have most bytes, and moves if that shard's quota admits it;
requests are admitted whole bins at a time, in the order of a hash, from sums
per (shard, bin).  Afterwards, shards that hold more linked bytes than their
part give bins back, and those units, documents without links and large
documents are dealt, largest first, to the emptiest shard.

What meets in one task or is broadcast has a fixed bound: BINS sums per shard,
and `units()` rows to deal, none of which grows with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import keep

BINS = 512
#: Bins of small documents that are dealt as one unit each.
SMALL_BINS = 4096
#: A document of more than this part of a shard is a unit of its own: at most 24,000 for 24 shards.
LARGE = 1000


def hashed(column: Column, salt: int, n: int) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(n)).cast("int")


def admitted(moves: DataFrame, room: DataFrame) -> DataFrame:
    """(shard, bin) of requests that fit. moves: shard, bin, bytes, BINS rows a shard at most; room: shard, room."""
    so_far = F.sum("bytes").over(Window.partitionBy("shard").orderBy("bin"))
    return moves.withColumn("so_far", so_far).join(F.broadcast(room), "shard").where("so_far <= room").select("shard", "bin")


def shard_documents(documents: DataFrame, shards: int = 24, rounds: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes of the text, plus 8), text_crc32, shard, slot (gapless from 0 in the shard).

    A null text has no bytes and counts as equal to the empty text. Rows with equal or null doc_ids are rows of their own, each
    with its slot. Copies stay together as far as a shard's even part of all bytes allows; a larger group is spread. Sizes of
    shards differ by about a thousandth of a shard, or by the smallest document where all are larger. An empty table gives an
    empty result. Other columns are not read.
    """
    text = F.coalesce(documents[text_column].cast("string"), F.lit(""))
    docs = documents.select(documents[id_column].cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("g"), F.xxhash64(F.lit(7), text).alias("g2"))
    docs = keep(docs.select("doc_id", "size", "crc", F.struct("g", "g2", "size", "crc").alias("g")), "rows")
    # written alone, so that joins with it can split a hot group's rows
    groups = keep(docs.groupBy("g").agg(F.count("*").alias("n"), F.sum("size").alias("group_bytes")), "groups")
    total = groups.agg(F.sum("group_bytes")).first()[0] or 0
    part = -(-total // shards)
    linked = groups.where("n > 1").select("g", "group_bytes")
    # a group above a fiftieth of a shard asks for places copy by copy, others as one
    whole = F.col("group_bytes") * 50 <= part
    # copies of the same bin and first shard are one row, before they meet the rest of their group
    members = docs.groupBy("g", hashed(F.col("doc_id"), 1, BINS).alias("own"), hashed(F.col("doc_id"), 2, shards).alias("shard")).agg(F.sum("size").alias("size"))
    members = members.join(linked, "g").select("size", "g", F.when(whole, hashed(F.col("g"), 1, BINS)).otherwise(F.col("own")).alias("bin"), "shard")
    atoms = keep(members.groupBy("g", "bin", "shard").agg(F.sum("size").alias("bytes")).withColumn("from", F.col("shard")), "atoms")
    every = documents.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    for _ in range(rounds):
        votes = atoms.groupBy("g", "shard").agg(F.sum("bytes").alias("bytes"))
        best = votes.groupBy("g").agg(F.max_by("shard", F.struct("bytes", F.xxhash64("g", "shard"))).alias("to"))
        asked = atoms.join(best, "g")
        moves = asked.where("to <> shard").groupBy(F.col("to").alias("shard"), "bin").agg(F.sum("bytes").alias("bytes"))
        load = atoms.groupBy("shard").agg(F.sum("bytes").alias("load"))
        room = every.join(F.broadcast(load), "shard", "left").select("shard", (F.lit(part) - F.coalesce("load", F.lit(0))).alias("room"))
        goes = F.broadcast(admitted(moves, room).select(F.col("shard").alias("to"), "bin", F.lit(True).alias("goes")))
        atoms = keep(asked.join(goes, ["to", "bin"], "left").select("g", "bin", F.when(F.coalesce("goes", F.lit(False)), F.col("to")).otherwise(F.col("shard")).cast("int").alias("shard"), "bytes", "from"), "atoms")
    # full shards give back what lies above their part, BINS bins a shard
    own = F.pmod(F.xxhash64("g", "bin"), F.lit(BINS)).cast("int")
    held = atoms.withColumn("own", own).groupBy("shard", "own").agg(F.sum("bytes").alias("bytes"))
    held = keep(held.withColumn("so_far", F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.col("bytes").desc(), "own"))).select("shard", "own", "bytes", (F.col("so_far") <= part).alias("stays")), "held")
    single = groups.where("n = 1").select("g", F.col("g")["size"].alias("size"))
    large = F.col("size") * LARGE > part
    unit = F.when(large, F.xxhash64("g", F.lit(3))).otherwise(hashed(F.col("g"), 4, SMALL_BINS).cast("long"))
    singles = single.withColumn("unit", unit).groupBy("unit").agg(F.sum("size").alias("bytes"))
    back = held.where("NOT stays").select(F.xxhash64("shard", "own", F.lit(5)).alias("unit"), "bytes")
    load = held.where("stays").groupBy("shard").agg(F.sum("bytes").alias("load"))
    dealt = keep(deal(singles.union(back), every.join(F.broadcast(load), "shard", "left").select("shard", F.coalesce("load", F.lit(0).cast("long")).alias("load")), shards), "dealt")
    # where each (group, bin, first shard) ends
    given = held.where("NOT stays").select("shard", "own", F.xxhash64("shard", "own", F.lit(5)).alias("unit")).join(F.broadcast(dealt), "unit").select("shard", "own", F.col("to").alias("moved"))
    ends = atoms.withColumn("own", own).join(F.broadcast(given), ["shard", "own"], "left").select("g", "bin", "from", F.coalesce("moved", "shard").alias("shard"))
    ends = ends.groupBy("g", "bin", "from").agg(F.min("shard").alias("shard"))
    placed = docs.join(linked, "g", "left").withColumn("bin", F.when(whole, hashed(F.col("g"), 1, BINS)).otherwise(hashed(F.col("doc_id"), 1, BINS))).withColumn("from", hashed(F.col("doc_id"), 2, shards))
    placed = placed.withColumn("unit", unit)
    many = placed.where("group_bytes IS NOT NULL").join(ends, ["g", "bin", "from"]).select("doc_id", "size", "crc", "shard")
    one = placed.where("group_bytes IS NULL").join(F.broadcast(dealt), "unit").select("doc_id", "size", "crc", F.col("to").alias("shard"))
    return slots(keep(many.unionByName(one), "placed"))


def deal(units: DataFrame, load: DataFrame, shards: int) -> DataFrame:
    """(unit, to): units (unit, bytes), largest first, each to the emptiest shard. One row holds them; their number is bounded (LARGE, SMALL_BINS, BINS)."""
    unit, held = F.struct(F.col("bytes").cast("long").alias("bytes"), F.col("unit").cast("long").alias("unit")), F.struct(F.col("shard").cast("int").alias("shard"), F.col("load").cast("long").alias("load"))
    both = units.select(unit.alias("u"), F.lit(None).cast("struct<shard:int,load:bigint>").alias("l")).union(load.select(F.lit(None).cast("struct<bytes:bigint,unit:bigint>").alias("u"), held.alias("l")))
    gathered = both.agg(F.reverse(F.array_sort(F.collect_list("u"))).alias("units"), F.array_sort(F.collect_list("l")).alias("loads"))
    rows = gathered.select("units", F.transform("loads", lambda x: x["load"]).alias("loads"))
    out = "array<struct<unit:bigint,to:int>>"

    def step(acc: Column, x: Column) -> Column:
        at = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        # the shard is settled by its first place of the smallest load; transform sees it through a one-element array
        return F.element_at(F.transform(F.array(at), lambda k: F.struct(F.transform(acc["loads"], lambda v, i: F.when(i == k, v + x["bytes"]).otherwise(v)).alias("loads"), F.struct(x["unit"].alias("unit"), k.alias("to")).alias("last"))), 1)

    # the greedy runs block by block, so that the list of results is copied once per block, not once per unit
    block = 256
    starts = F.when(F.size("units") > 0, F.sequence(F.lit(1), F.size("units"), F.lit(block))).otherwise(F.array().cast("array<int>"))

    def add(acc: Column, x: Column) -> Column:
        done = step(acc, x)
        return F.element_at(F.transform(F.array(done), lambda d: F.struct(d["loads"].alias("loads"), F.concat(acc["out"], F.array(d["last"])).cast(out).alias("out"))), 1)

    def blocks(acc: Column, at: Column) -> Column:
        start = F.struct(acc["loads"].alias("loads"), F.array().cast(out).alias("out"))
        part = F.aggregate(F.slice(F.col("units"), at, F.lit(block)), start, add)
        return F.element_at(F.transform(F.array(part), lambda p: F.struct(p["loads"].alias("loads"), F.concat(acc["out"], p["out"]).cast(out).alias("out"))), 1)

    start = F.struct(F.col("loads"), F.array().cast(out).alias("out"))
    return rows.select(F.explode(F.aggregate(starts, start, blocks, lambda acc: acc["out"])).alias("u")).select("u.*").distinct()


def slots(placed: DataFrame) -> DataFrame:
    """Numbers the rows of each shard: places within (shard, bin), after the sums of the shard's earlier bins. 64 bins a shard for each million rows."""
    rows = placed.count()
    bins = max(1, min(16384, rows // 20_000))
    placed = placed.withColumn("bin", F.pmod(F.xxhash64("doc_id", "crc", F.lit(9)), F.lit(bins)).cast("int"))
    sizes = placed.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    before = sizes.select("shard", "bin", (F.sum("n").over(Window.partitionBy("shard").orderBy("bin")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("doc_id", "crc", "size"))
    out = placed.withColumn("place", place).join(before, ["shard", "bin"])
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("before") + F.col("place") - 1).alias("slot"))
