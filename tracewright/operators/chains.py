"""Chains and rings of member ways, by list ranking.

A member way can be gone along in two directions (darts). Where exactly two members end at a node, the way on is plain, so a dart has
a next one; pointer doubling gives every dart its distance to the end of its stretch, and on rings that to the member of the smallest order. So a
stretch of any length costs rounds by the logarithm of it. What is left to decide are branches: there stretches, not members, are put
together one after the other, as the members' order says.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import cut


def _darts(members: DataFrame) -> DataFrame:
    """rel_id, dart, to (the next dart, or null) of members (rel_id, num, a, z): dart 2 * num goes from a to z, 2 * num + 1 back."""
    darts = members.select("rel_id", F.explode(F.array(F.struct((2 * F.col("num")).alias("dart"), F.col("a").alias("from"), F.col("z").alias("to")), F.struct((2 * F.col("num") + 1).alias("dart"), F.col("z").alias("from"), F.col("a").alias("to")))).alias("d")).select("rel_id", "d.*")
    # a node where two different members end: the darts that leave it are two, and each goes on from the other's reverse
    plain = darts.groupBy("rel_id", "from").agg(F.count(F.lit(1)).alias("n"), F.min("dart").alias("one"), F.max("dart").alias("two")).filter("n = 2 and floor(one / 2) <> floor(two / 2)")
    reverse = lambda c: F.col(c).bitwiseXOR(F.lit(1).cast("long"))
    turns = plain.select("rel_id", F.explode(F.array(F.struct(reverse("one").alias("dart"), F.col("two").alias("next")), F.struct(reverse("two").alias("dart"), F.col("one").alias("next")))).alias("t")).select("rel_id", "t.*")
    return darts.join(turns, ["rel_id", "dart"], "left").select("rel_id", "dart", "from", F.col("to").alias("node"), F.col("next").alias("to"))


def _ranked(darts: DataFrame, most: int) -> DataFrame:
    """darts with last (the end of its stretch; null on rings), steps to it, least (the smallest dart on the ring) and its distance.

    One round doubles how far every dart sees. least is by member number, so of a ring's two directions that in which the member of the
    smallest number goes forward has an even one.
    """
    number = F.floor(F.col("dart") / 2)
    see = cut(darts.select("rel_id", "dart", "to", F.lit(1).cast("long").alias("steps"), F.col("dart").alias("last"), F.struct(number.alias("num"), F.lit(0).cast("long").alias("at"), F.col("dart").alias("dart")).alias("least")), "sight")
    reach = 1
    while reach <= most and not see.filter("to is not null").isEmpty():
        ahead = see.select("rel_id", F.col("dart").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("steps2"), F.col("last").alias("last2"), F.col("least").alias("least2"))
        far = F.struct(F.col("least2.num").alias("num"), (F.col("least2.at") + F.col("steps")).alias("at"), F.col("least2.dart").alias("dart"))
        met = see.join(ahead, ["rel_id", "to"], "left")
        see = cut(met.select("rel_id", "dart", F.col("to2").alias("to"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.coalesce("last2", "last").alias("last"), F.least("least", F.when(F.col("steps2").isNotNull(), far)).alias("least")), "sight")
        reach *= 2
    return see.select("rel_id", "dart", F.when(F.col("to").isNull(), F.col("last")).alias("last"), F.when(F.col("to").isNull(), F.col("steps")).alias("steps"), "least")


def stretches(members: DataFrame) -> DataFrame:
    """rel_id, num, back, stretch, rank, ring of members (rel_id, num, a, z): each in its stretch between branches or loose ends, or in its ring.

    A stretch goes the way in which its member of the smallest number (that is its name) goes forward; a ring begins with it.
    """
    darts = cut(_darts(members), "darts")
    most = members.groupBy("rel_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    see = cut(_ranked(darts, most), "ranked")
    own = (F.col("dart") % 2 == 1).alias("back"), F.floor(F.col("dart") / 2).alias("num")
    open_ = see.filter("last is not null")
    heads = open_.groupBy("rel_id", "last").agg(F.min("dart").alias("least"), F.max("steps").alias("long"))
    lines = open_.drop("least").join(heads.filter("least % 2 = 0"), ["rel_id", "last"]).select("rel_id", own[1], own[0], F.floor(F.col("least") / 2).alias("stretch"), (F.col("long") - F.col("steps")).alias("rank"), F.lit(False).alias("ring"))
    rings = see.filter("last is null and least.dart % 2 = 0")
    round_ = rings.groupBy("rel_id", "least.num").agg(F.count(F.lit(1)).alias("long")).withColumnRenamed("num", "stretch")
    rings = rings.select("rel_id", own[1], own[0], F.col("least.num").alias("stretch"), F.col("least.at").alias("at")).join(round_, ["rel_id", "stretch"])
    return lines.unionByName(rings.select("rel_id", "num", "back", "stretch", ((F.col("long") - F.col("at")) % F.col("long")).alias("rank"), F.lit(True).alias("ring")))


def _put_together(part):
    """Chains of one relation's stretches: from the smallest number on, forward then backward, at each node by the smallest free member that ends there.

    Stretches have their end nodes (head, tail), the members there (first, final), how many they have (long), their smallest (stretch) and
    its rank. Pieces of them come out: chain (its smallest member), piece, from and upto (ranks), turned.
    """
    import pandas as pd

    waiting, free, spans = {}, {}, {}

    def offer(key, head, tail, first, final, low, high):
        free[key] = (head, tail)
        spans[key] = (low, high)
        heapq.heappush(waiting.setdefault(head, []), (first, 0, key))
        heapq.heappush(waiting.setdefault(tail, []), (final, 1, key))

    rows = {r.stretch: r for r in part.itertuples()}
    for r in rows.values():
        offer((r.stretch, 0), r.head, r.tail, r.first, r.final, 0, r.long)

    def smallest(node):
        heap = waiting.get(node, [])
        while heap and heap[0][2] not in free:
            heapq.heappop(heap)
        return heapq.heappop(heap)[1:] if heap else None

    out = []
    for name in sorted(rows):
        if (name, 0) not in free:
            continue
        r = rows[name]
        head, tail = free.pop((name, 0))
        low = 0
        if r.rank_of:  # begun in the middle: what lies before is a stretch of its own
            low = r.rank_of
            offer((name, 1), head, r.begins, r.first, r.before, 0, low)
            head = r.begins
        pieces = [(name, low, r.long, False)]
        for forward in (True, False):
            while head != tail:
                found = smallest(tail if forward else head)
                if found is None:
                    break
                side, key = found
                a, z = free.pop(key)
                if forward:
                    pieces.append((key[0], *spans[key], side == 1))
                    tail = a if side == 1 else z
                else:
                    pieces.insert(0, (key[0], *spans[key], side == 0))
                    head = z if side == 0 else a
        at = 0
        for piece in pieces:
            out.append((int(r.rel_id), name, *piece, at))
            at += piece[2] - piece[1]
    return pd.DataFrame(out, columns=["rel_id", "chain", "stretch", "low", "high", "turned", "offset"])


def merge_way_chains(members: DataFrame) -> DataFrame:
    """Rings of a relation's outer ways. members: rel_id, ord, way_id, nodes (array). Returns rel_id, new_id (-1, -2, ...), members, nodes, closed.

    Open members are chained at shared end nodes; at a branch the free member of the smallest ord goes on, forward first, then backward;
    closed members pass as they are, before the others. Members without nodes are left out. Stretches between branches are ranked in
    parallel; a relation's stretches that touch a branch are put together by one task.
    """
    rows = members.select("rel_id", "ord", "way_id", "nodes").filter(F.size("nodes") > 0)
    rows = cut(rows.withColumn("num", (F.row_number().over(W.partitionBy("rel_id").orderBy("ord", "way_id")) - 1).cast("long")).withColumn("a", F.element_at("nodes", 1)).withColumn("z", F.element_at("nodes", -1)), "members")
    closed = rows.filter((F.col("a") == F.col("z")) & (F.size("nodes") > 1))
    open_ = rows.filter((F.col("a") != F.col("z")) | (F.size("nodes") == 1))
    part = cut(stretches(open_.select("rel_id", "num", "a", "z")), "stretches")
    ways = part.join(open_.select("rel_id", "num", "a", "z"), ["rel_id", "num"])
    begin, end = F.when(F.col("back"), F.col("z")).otherwise(F.col("a")), F.when(F.col("back"), F.col("a")).otherwise(F.col("z"))
    least = F.min(F.struct("num", "rank", begin.alias("begins")))
    sides = ways.filter("not ring").groupBy("rel_id", "stretch").agg(F.min(F.struct("rank", begin.alias("node"), "num")).alias("h"), F.max(F.struct("rank", end.alias("node"), "num")).alias("t"), F.count(F.lit(1)).alias("long"), least.alias("l"))
    before = ways.select("rel_id", "stretch", F.col("rank").alias("before_rank"), F.col("num").alias("before"))
    sides = sides.join(before, ["rel_id", "stretch"]).filter("before_rank = greatest(l.rank - 1, 0)")
    sides = cut(sides.select("rel_id", "stretch", F.col("h.node").alias("head"), F.col("t.node").alias("tail"), F.col("h.num").alias("first"), F.col("t.num").alias("final"), "long", F.col("l.rank").alias("rank_of"), F.col("l.begins").alias("begins"), "before"), "sides")
    ends = sides.select("rel_id", F.explode(F.array("head", "tail")).alias("node")).groupBy("rel_id", "node").agg((F.count(F.lit(1)) > 1).alias("meets"))
    touching = sides.select("rel_id", "stretch", F.explode(F.array("head", "tail")).alias("node")).join(ends.filter("meets"), ["rel_id", "node"]).select("rel_id", "stretch").distinct()
    joined = sides.join(touching, ["rel_id", "stretch"], "left_semi").groupBy("rel_id").applyInPandas(_put_together, "rel_id long, chain long, stretch long, low long, high long, turned boolean, offset long")
    whole = part.join(touching, ["rel_id", "stretch"], "left_anti").select("rel_id", "num", "back", F.col("stretch").alias("chain"), F.col("rank").alias("place"))
    turned = part.join(joined, ["rel_id", "stretch"]).filter("rank >= low and rank < high")
    place = F.col("offset") + F.when(F.col("turned"), F.col("high") - 1 - F.col("rank")).otherwise(F.col("rank") - F.col("low"))
    pieces = turned.select("rel_id", "num", (F.col("back") != F.col("turned")).alias("back"), "chain", place.alias("place"))
    alone = closed.select("rel_id", "num", F.lit(False).alias("back"), F.col("num").alias("chain"), F.lit(0).cast("long").alias("place"), F.lit(0).alias("rank"))
    chains = whole.unionByName(pieces).withColumn("rank", F.lit(1)).unionByName(alone).join(rows.select("rel_id", "num", "way_id", "nodes"), ["rel_id", "num"])
    nodes = F.when(F.col("back"), F.reverse("nodes")).otherwise(F.col("nodes"))
    got = chains.groupBy("rel_id", "rank", "chain").agg(F.sort_array(F.collect_list(F.struct("place", "way_id", F.when(F.col("place") == 0, nodes).otherwise(F.slice(nodes, F.lit(2), F.size("nodes"))).alias("nodes")))).alias("m"))
    line = F.flatten(F.transform("m", lambda x: x["nodes"]))
    new_id = -F.row_number().over(W.partitionBy("rel_id").orderBy("rank", "chain")).cast("long")
    got = got.select("rel_id", new_id.alias("new_id"), F.transform("m", lambda x: x["way_id"]).alias("members"), line.alias("nodes"))
    return got.withColumn("closed", (F.size("nodes") > 1) & (F.element_at("nodes", 1) == F.element_at("nodes", -1)))
