"""Mixing sources to target weights by a low-discrepancy schedule.

A source's documents are shuffled by a hash and laid end to end on a tape of words, which is cut into blocks of equal size. The
golden-ratio sequence, mapped through the cumulative shares of the sources, gives each slot of the mix a source; a source's n-th
slot takes its n-th block. Where the sequence gives a source a slot too many, that slot goes to a source that got one too few, so
every source gets exactly its blocks; the last is cut to its target. A tape goes round at most twice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, named

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = (math.sqrt(5) - 1) / 2
#: Slots ranked together; tape positions are summed in 16**3 ranges of the shuffling hash.
SLOTS_PER_CHUNK = 1 << 16
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """sizes (source, source_size): adds weight and target. One row a source.

    Weights repeat over the sources by code point, null last. Targets share `share` times all words by weight, stop at `most`
    times the source's size, and the excess goes to the others by weight until none is above: the sources that stop are those of
    the smallest size per weight.
    """
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(ordered) - 1) % len(weights) + 1)
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    w = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * most)
    budget = F.sum("source_size").over(W.partitionBy()) * F.lit(share)
    # what a unit of weight gets if all before stop, and this and the later ones don't
    level = (budget - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(after)
    w = w.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    return w.withColumn("level", F.max("level").over(W.partitionBy())).select("source", "source_size", "weight", F.when(F.col("level").isNull() | (F.col("level") * F.col("weight") > F.col("cap")), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """slot, queue, block: the blocks of the mix in order. targets: queue, blocks (how many it gives), one row a source."""
    spark = targets.sparkSession
    shares = targets.filter("blocks > 0").withColumn("upper", F.sum("blocks").over(W.orderBy("queue"))).withColumn("lower", F.col("upper") - F.col("blocks"))
    total = shares.agg(F.max("upper")).first()[0] or 0
    bounds = [(r.queue, r.lower, r.upper) for r in shares.orderBy("queue").toLocalIterator()]  # one row a source
    point = F.col("slot") * F.lit(GOLDEN)
    at = (point - F.floor(point)) * F.lit(float(total))
    table = F.array(*(F.struct(F.lit(float(u)).alias("upper"), F.lit(q).alias("queue")) for q, _, u in bounds)) if bounds else F.array(F.struct(F.lit(0.0).alias("upper"), F.lit("").alias("queue")))
    queue = F.coalesce(F.get(F.filter(table, lambda b: b["upper"] > F.col("at")), 0)["queue"], F.lit(bounds[-1][0] if bounds else ""))
    slots = spark.range(total).withColumnRenamed("id", "slot").withColumn("at", at).select("slot", queue.alias("queue"), F.floor(F.col("slot") / SLOTS_PER_CHUNK).alias("chunk"))
    counts = slots.groupBy("queue", "chunk").count()
    before = counts.select("queue", "chunk", (F.sum("count").over(W.partitionBy("queue").orderBy("chunk")) - F.col("count")).alias("before"))
    ranked = slots.join(before, ["queue", "chunk"]).withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy("queue", "chunk").orderBy("slot")) - 1)
    ranked = cut(ranked.join(targets.select("queue", "blocks"), "queue").select("slot", "queue", "rank", "blocks"), "slots")
    good = ranked.filter("rank < blocks").select("slot", "queue", F.col("rank").alias("block"))
    # a few slots a source: those over its blocks, and the blocks that got no slot
    over = ranked.filter("rank >= blocks").select("slot", F.row_number().over(W.orderBy("slot")).alias("k"))
    given = ranked.groupBy("queue").agg(F.count("*").alias("given"))
    short = targets.join(given, "queue", "left").withColumn("given", F.coalesce("given", F.lit(0))).filter("given < blocks")
    short = short.select("queue", F.explode(F.sequence(F.col("given"), F.col("blocks") - 1)).alias("block"))
    short = short.select("queue", "block", F.row_number().over(W.orderBy("block", "queue")).alias("k"))
    return good.unionByName(over.join(short, "k").select("slot", "queue", "block"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, block: int = 1024, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(rows, pieces). rows: doc_id, same (md5 of the text), queue, size, source, source_size, target, start, one per row of docs. pieces: slot, queue, start, pass, first_word, words.

    A piece is a run of a document's words in a slot of the mix; (queue, start) names the document, whose place on its source's
    tape starts there. Every source's words add up to its target, rounded; a document is used at most `most` (2) times, as a
    tape goes round. Reruns agree: order is by md5 of seed and doc_id, then by id and text. A null text has no words; a null
    source is a source of its own, last; null and repeated doc_id values are rows like others. Other columns are ignored.
    An empty table, or one without words, gives no pieces.
    """
    if most != 2:
        raise ValueError("tapes go round twice")
    rows = docs.select(named("doc_id").alias("doc_id"), named("source").alias("source"), word_count(named("text")).alias("size"), F.md5(F.coalesce(named("text"), F.lit(""))).alias("same"))
    rows = rows.withColumn("queue", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("order", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = cut(rows.withColumn("range", F.substring("order", 1, RANGE_DIGITS)), "sizes")
    ranges = rows.groupBy("queue", "range").agg(F.sum("size").alias("in_range"))
    ranges = cut(ranges.withColumn("before", F.sum("in_range").over(W.partitionBy("queue").orderBy("range")) - F.col("in_range")), "ranges")
    sources = rows.groupBy("queue").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = cut(source_targets(sources, weights, share, most).select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("queue"), "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("words")), "targets")
    targets = targets.withColumn("blocks", F.ceil(F.col("words") / block))
    inside = W.partitionBy("queue", "range").orderBy("order", "doc_id", "same")
    placed = rows.join(ranges.select("queue", "range", "before"), ["queue", "range"]).withColumn("start", F.col("before") + F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    placed = cut(placed.join(targets, "queue").select("doc_id", "same", "queue", "size", "source", "source_size", "target", "start", "words"), "tape")
    turns = placed.filter("size > 0").select("queue", "start", "size", "words", F.explode(F.array(F.lit(0), F.lit(1))).alias("pass"), "source_size")
    turns = turns.withColumn("from", F.col("start") + F.col("pass") * F.col("source_size")).withColumn("to", F.least(F.col("from") + F.col("size"), F.col("words"))).filter("from < to")
    cuts = turns.withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    low, high = F.greatest(F.col("from"), F.col("block") * block), F.least(F.col("to"), (F.col("block") + 1) * block)
    cuts = cuts.select("queue", "block", "start", "pass", (low - F.col("from")).alias("first_word"), (high - low).alias("words"))
    return placed.drop("words"), schedule(targets, block).join(cuts, ["queue", "block"]).select("slot", "queue", "start", "pass", "first_word", "words")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot, n_slots of every row, from mix(): how many words the mix takes, its first slot that holds some of them (null: none) and its slots' number."""
    rows, pieces = mix(docs, **options)
    sums = pieces.groupBy("queue", "start").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_slots")).withColumn("some", F.lit(True))
    joined = rows.withColumn("some", F.col("size") > 0).join(cut(sums, "taken"), ["queue", "start", "some"], "left")
    none = [F.coalesce(c, F.lit(0)).alias(c) for c in ("taken", "n_slots")]
    return joined.select("doc_id", "size", "source_size", "target", none[0], "first_slot", none[1])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them, in its order: a row for each time that a document is used, with the words that are taken of it then.

    Rows go by the first slot of each use, range by range of slots, so any prefix of the written files holds the sources by their
    shares. Words taken of a document in one turn of the tape are a run from its start; a text used whole stays as it is, a cut one ends
    with the run's last word. Documents that the mix doesn't use go. Rows of the same doc_id (or none) and text stand for each
    other: each has its own turns, with the other columns of any one of them. Null texts have no words and go; an empty table
    gives an empty result; columns of docs keep their names, whatever these are.
    """
    rows, pieces = mix(docs, **options)
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "same")
    turns = pieces.groupBy("queue", "start", "pass").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    turns = cut(rows.filter("size > 0").select(key.alias("key"), "queue", "start", "size").join(turns, ["queue", "start"]).select("key", "size", "words", "slot"), "turns")
    own = F.concat(F.coalesce(named("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(named("text"), F.lit(""))))
    whole = docs.select(own.alias("key"), F.struct(*(named(c) for c in docs.columns)).alias("row")).dropDuplicates(["key"])  # no name of docs clashes with ours
    joined = whole.join(turns, "key").repartitionByRange("slot", "key").sortWithinPartitions("slot", "key")
    before = F.col("row.`text`")
    # the place after the run's last word: words and blanks alternate
    words = F.slice(F.regexp_extract_all(before, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1), F.lit(1), F.col("words").cast("int"))
    text = F.when(F.col("words") >= F.col("size"), before).otherwise(F.array_join(words, ""))
    return joined.select(*(text.alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
