"""Ring assembly by list ranking against the plain greedy rule."""

import random

from pyspark.sql import functions as F

from tracewright.operators.aggregates import merge_way_chains

SCHEMA = "rel_id long, ord int, way_id long, nodes array<long>"


def plain_chains(members):
    """One relation's chains, member by member: (members, nodes) in order, closed members first."""
    todo = [(w, list(n)) for _, w, n in sorted(members) if n]
    out = [([w], n) for w, n in todo if n[0] == n[-1] and len(n) > 1]
    todo = [(w, n) for w, n in todo if not (n[0] == n[-1] and len(n) > 1)]
    while todo:
        first, chain = todo.pop(0)
        used = [first]
        for forward in (True, False):
            while chain[0] != chain[-1]:
                end = chain[-1] if forward else chain[0]
                at = next((i for i, (_, n) in enumerate(todo) if end in (n[0], n[-1])), None)
                if at is None:
                    break
                w, n = todo.pop(at)
                if forward:
                    used, chain = [*used, w], chain + (n if n[0] == end else n[::-1])[1:]
                else:
                    used, chain = [w, *used], (n if n[-1] == end else n[::-1])[:-1] + chain
        out.append((used, chain))
    return out


def test_against_the_plain_rule(spark):
    r, rows = random.Random(5), []
    for rel in range(250):  # branches of all kinds, members of one node, closed and empty ones
        k = r.choice([3, 5, 8, 14, 30])
        for o in range(r.randint(1, 22)):
            nodes = [r.randint(0, k) for _ in range(r.choice([0, 1, 2, 2, 2, 2, 3, 4]))]
            rows.append((rel, o * 3 + 1, 1000 * rel + o, nodes + nodes[:1] if r.random() < 0.05 else nodes))
    for rel in range(250, 280):  # chains and rings, dealt and turned
        n, ring = r.randint(2, 30), r.random() < 0.5
        pairs = [(i, (i + 1) % n if ring else i + 1) for i in range(n)]
        r.shuffle(pairs)
        rows += [(rel, o, 1000 * rel + o, [a, 1000 + o, b][:: r.choice([1, -1])]) for o, (a, b) in enumerate(pairs)]
    got = {(x.rel_id, x.new_id): (list(x.members), list(x.nodes), x.closed) for x in merge_way_chains(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    want = {}
    for rel in range(280):
        for i, (used, nodes) in enumerate(plain_chains([x[1:] for x in rows if x[0] == rel])):
            want[rel, -1 - i] = (used, nodes, nodes[0] == nodes[-1] and len(nodes) > 1)
    assert got == want


def test_a_ring_of_many_members(spark):
    n = 100_000
    ends = F.array(F.col("id"), (F.col("id") + 1) % n)
    ring = spark.range(n).select(F.lit(1).cast("long").alias("rel_id"), (F.col("id") * 7919 % n).cast("int").alias("ord"), F.col("id").alias("way_id"), F.when(F.xxhash64("id") % 2 == 0, ends).otherwise(F.reverse(ends)).alias("nodes"))
    (one,) = merge_way_chains(ring).collect()
    assert one.closed and len(one.nodes) == n + 1 and one.members[0] == 0 and all((b - a) % n in (1, n - 1) for a, b in zip(one.members, one.members[1:], strict=False))


def test_no_members(spark):
    assert merge_way_chains(spark.createDataFrame([], SCHEMA)).count() == 0
    assert merge_way_chains(spark.createDataFrame([(1, 0, 5, []), (1, 1, 6, None)], SCHEMA)).count() == 0
