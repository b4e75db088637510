"""Secrets in text: pattern rules, and character Markov models of random strings against ordinary identifiers.

Everything here is DataFrame and SQL functions. Two first-order models over printable ASCII give each candidate string the
log-likelihood ratio of its character pairs, random against ordinary; a high ratio adds a span to those of the rules.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, named

#: Kind, pattern, group whose length counts, least length. Patterns with a plain run and a least length say it themselves.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (("assign", ASSIGN, 1, 12), ("access", r"AKIA[A-Z0-9]{14,}", 0, 18), ("hex", r"[0-9a-f]{16,}", 0, 16))
#: Strings that the models judge: runs of 16 or more of these characters, whole and by their parts.
LEAST = 16
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
#: What parts words, for the models.
NOT_CANDIDATE = "[^A-Za-z0-9+/_=-]+"
#: Parts of a run, each with the signs that follow it; signs may also stand in front.
SIGNS = "=/_-"
PART = r"[A-Za-z0-9+]+[=/_-]*|[=/_-]+"
#: Signs by which identifiers join words.
JOINS = "_-/"
#: Random strings that the models learn from.
RANDOM_ROWS = 20_000
LOW, SIZE = 33, 94  # printable ASCII without the blank
SPAN = "struct<start:int,kind_order:int,end:int,kind:string,value:string>"


def found(text: Column, kind: str, order: int, pattern: str, group: int = 0, least: int = 1) -> Column:
    """The pattern's leftmost non-overlapping matches as an array of SPAN (code points, end exclusive), less those whose group is short.

    The gaps that split() leaves and the matches alternate, so their lengths give the places.
    """
    p = F.lit(pattern)
    none = F.from_json(F.lit("[]"), f"array<{SPAN}>")
    gaps, hits, values = F.transform(F.split(text, pattern, -1), F.length), F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(state: Column, row: Column) -> Column:
        begin = state["at"] + row["0"]
        end = begin + F.length(row["1"])
        span = F.struct(begin.alias("start"), F.lit(order).alias("kind_order"), end.alias("end"), F.lit(kind).alias("kind"), row["2"].alias("value"))
        keep = F.length(row["2"]) >= least
        return F.struct(F.coalesce(end, begin).alias("at"), F.when(keep, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    rows = F.arrays_zip(gaps, hits, values)
    renamed = F.transform(rows, lambda r: F.struct(r["0"].alias("0"), r["1"].alias("1"), r["2"].alias("2")))
    return F.when(F.regexp(text, p), F.aggregate(renamed, start, step, lambda s: s["out"])).otherwise(none)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and candidates (arrays of spans) of every text: what the rules find, and the other long strings, for the models.

    Of a run that spans of the rules cover in part, what they leave is a candidate where it is long enough.
    """
    text = F.coalesce(named("text"), F.lit(""))
    rows = docs.select(named("doc_id").alias("doc_id"), text.alias("text"))
    base = F.concat(*(found(F.col("text"), kind, i, pattern, group, least) for i, (kind, pattern, group, least) in enumerate(RULES)))
    rows = rows.select("doc_id", base.alias("base"), found(F.col("text"), "markov", len(RULES), CANDIDATE).alias("long"))
    apart = F.flatten(F.transform("long", lambda c: uncovered(c, F.col("base"))))
    return rows.select("doc_id", "base", apart.alias("candidates"))


def part_of(c: Column, start: Column, end: Column) -> Column:
    """The span of a candidate's characters from start to end, places in the text."""
    value = F.substring(c["value"], start - c["start"] + 1, end - start)
    return F.struct(start.alias("start"), c["kind_order"].alias("kind_order"), end.alias("end"), c["kind"].alias("kind"), value.alias("value"))


def uncovered(c: Column, base: Column) -> Column:
    """What base leaves of a candidate, as an array of spans of LEAST characters or more."""
    within = F.array_sort(F.filter(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    gaps = F.from_json(F.lit("[]"), "array<struct<start:int,end:int>>")

    def step(state: Column, b: Column) -> Column:
        gap = F.struct(state["at"].alias("start"), b["start"].alias("end"))
        out = F.when(b["start"] - state["at"] >= LEAST, F.concat(state["out"], F.array(gap))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], b["end"]).alias("at"), out.alias("out"))

    def last(state: Column) -> Column:
        gap = F.struct(state["at"].alias("start"), c["end"].alias("end"))
        return F.when(c["end"] - state["at"] >= LEAST, F.concat(state["out"], F.array(gap))).otherwise(state["out"])

    left = F.aggregate(within, F.struct(c["start"].alias("at"), gaps.alias("out")), step, last)
    return F.when(F.size(within) == 0, F.array(c)).otherwise(F.transform(left, lambda g: part_of(c, g["start"], g["end"])))


def _pairs(value: Column) -> Column:
    """All pairs of neighbouring characters of a short value."""
    return F.transform(F.sequence(F.lit(1), F.length(value) - 1), lambda i: F.substring(value, i, F.lit(2)))


def _empty() -> list[list[float]]:
    return [[0.0] * SIZE for _ in range(SIZE)]


def _logs(table: list[list[float]], smoothing: float, backing: float, drawn: float) -> list[float]:
    """Logs of the chance of a character after another: its share of the pairs seen, drawn towards its share of all characters by
    `backing` pairs' weight or by the share `drawn`, whichever is more, so that pairs hardly seen count alike at every size."""
    share = [sum(row[c] for row in table) for c in range(SIZE)]
    whole = sum(share)
    share = [(1 - drawn) * (s + smoothing) / (whole + SIZE * smoothing) + drawn / SIZE for s in share]
    out = []
    for row in table:
        seen = sum(row)
        to = max(drawn, backing / (seen + backing))
        out += [math.log((1 - to) * (row[c] / seen if seen else 0.0) + to * share[c]) for c in range(SIZE)]
    return out


def ratios(random: list[list[float]], ordinary: list[list[float]], smoothing: float = 0.5, backing: float = 10.0, drawn: float = 0.05) -> list[float]:
    """The log-likelihood ratio of each pair of characters, at LOW-based places of an array of SIZE**2; all 0 if a table is empty."""
    if not all(any(map(any, table)) for table in (random, ordinary)):
        return [0.0] * SIZE**2
    return [a - b for a, b in zip(_logs(random, smoothing, backing, drawn), _logs(ordinary, smoothing, backing, drawn), strict=True)]


def train(samples: DataFrame) -> list[float]:
    """ratios() of labelled samples (value, is_random).

    Counts are made in Spark; what the driver gets is a row a pair, SIZE**2 at most. Values that are null, or with under two
    characters, teach nothing. Without samples of both kinds every ratio is 0.
    """
    printable = samples.filter(F.regexp("value", F.lit(r"^[\x21-\x7E]{2,}$")))
    count = {True: _empty(), False: _empty()}
    for r in printable.select("is_random", F.explode(_pairs(F.col("value"))).alias("pair")).groupBy("is_random", "pair").count().toLocalIterator():
        if r.is_random is not None:
            count[r.is_random][ord(r.pair[0]) - LOW][ord(r.pair[1]) - LOW] += r["count"]
    return ratios(count[True], count[False])


def random_strings(spark: SparkSession, rows: int = RANDOM_ROWS) -> DataFrame:
    """value: digests of 0, 1, 2, ... in base 64, every other with the signs of URLs."""
    text = F.rtrim(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256))), F.lit("="))
    return spark.range(rows).select(F.when(F.col("id") % 2 == 0, text).otherwise(F.translate(text, "+/", "-_")).alias("value"))


def labelled_samples(docs: DataFrame, rows: int = RANDOM_ROWS) -> DataFrame:
    """value, is_random, n: the labelled strings that the models learn from.

    Random ones are random_strings(). Ordinary ones are the words of all of docs that are too short to be candidates, n times each,
    and, once each, the longer ones that come again and that no rule finds. A long word that comes once may be a secret: it has no
    label and teaches nothing.
    """
    words = docs.select(F.explode(F.split(F.coalesce(named("text"), F.lit("")), NOT_CANDIDATE)).alias("value")).filter("value <> ''").groupBy("value").agg(F.count("*").alias("n"))
    short, ruled = F.length("value") < LEAST, F.lit(False)
    for _, pattern, _, _ in RULES:
        ruled |= F.regexp("value", F.lit(pattern))
    words = words.filter(short | ((F.col("n") > 1) & ~ruled)).withColumn("n", F.when(short, F.col("n")).otherwise(1))
    random = random_strings(docs.sparkSession, rows).select("value", F.lit(True).alias("is_random"), F.lit(1).cast("long").alias("n"))
    return random.unionByName(words.select("value", F.lit(False).alias("is_random"), "n"))


def pair_counts(samples: DataFrame) -> DataFrame:
    """is_random, pair, n: neighbouring characters in labelled samples; ordinary words have a blank at either end, as they make identifiers. A frequent word is taken apart once."""
    value = F.when(F.col("is_random"), F.col("value")).otherwise(F.concat(F.lit(" "), "value", F.lit(" ")))
    return samples.filter((F.length("value") > 1) | ~F.col("is_random")).select("is_random", F.explode(_pairs(value)).alias("pair"), "n").groupBy("is_random", "pair").agg(F.sum("n").alias("n"))


def word_pairs(docs: DataFrame) -> DataFrame:
    """pair, n of the words of docs."""
    return pair_counts(labelled_samples(docs)).filter(~F.col("is_random")).select("pair", "n")


def identifiers(pairs: Iterable[tuple[str, int]]) -> list[list[float]]:
    """Pair counts of the identifiers that words make, from word_pairs(): as they are, in capitals, with a capital first letter,
    and joined by a sign, by a capital or by nothing; of decimal numbers, as one word in a hundred; and of one character repeated,
    as in ruled lines."""
    table, first, last = _empty(), [0.0] * SIZE, [0.0] * SIZE
    big = [ord(chr(c + LOW).upper()) - LOW for c in range(SIZE)]
    for (a, b), n in pairs:
        x, y = ord(a) - LOW, ord(b) - LOW
        if x < 0:
            first[y] += n
        elif y < 0:
            last[x] += n
        else:
            for i, j in {(x, y), (big[x], big[y]), (big[x], y)}:
                table[i][j] += n
    whole = sum(first)
    digits = range(ord("0") - LOW, ord("9") - LOW + 1)
    for c in digits:
        first[c] += whole / 1000
        last[c] += whole / 1000
        for d in digits:
            table[c][d] += whole / 10_000
    for c in range(SIZE):
        for sign in (ord(s) - LOW for s in JOINS):
            for x in {c, big[c]}:
                table[x][sign] += last[c] / len(JOINS)
                table[sign][x] += first[c] / len(JOINS)
        for d in range(SIZE):
            if whole and last[c] and first[d]:
                for i, j in ((c, d), (c, big[d]), (big[c], big[d])):
                    table[i][j] += last[c] * first[d] / whole / 3
    for c in range(SIZE):
        table[c][c] += 0.05 * sum(table[c]) + (whole > 0)
    return table


def model_of(samples: DataFrame) -> list[float]:
    """ratios() of labelled_samples(): the random strings against the identifiers that the ordinary words make. The driver gets a row a pair, twice SIZE**2 at most."""
    random, words = _empty(), []
    for r in pair_counts(samples).toLocalIterator():
        if r.is_random:
            random[ord(r.pair[0]) - LOW][ord(r.pair[1]) - LOW] += r.n
        else:
            words.append((r.pair, r.n))
    return ratios(random, identifiers(words))


def train_on(docs: DataFrame) -> list[float]:
    """The model of labelled_samples(docs): all of docs."""
    return model_of(labelled_samples(docs))


#: Every fifth sample, by its hash, is held out where the models are measured.
FOLDS = 5


def held_out_counts(docs: DataFrame, least_per_pair: float = 1.0, rows: int = RANDOM_ROWS) -> DataFrame:
    """is_random, strings, found: how many held-out strings the models judge random, trained on the samples of the other folds.

    Held-out random strings are the held-out samples; held-out ordinary ones are identifiers of LEAST characters or more that three
    held-out words make, joined by a sign, and the labelled words that are as long themselves.
    """
    held = F.pmod(F.xxhash64("value"), F.lit(FOLDS)) == 0
    samples = cut(labelled_samples(docs, rows).withColumn("held", held), "samples")
    model = model_of(samples.filter("not held"))
    words = samples.filter("held and not is_random")
    order = W.partitionBy(F.pmod(F.xxhash64(F.lit(1), "value"), F.lit(256))).orderBy(F.xxhash64(F.lit(2), "value"), "value")
    sign = F.element_at(F.array(*(F.lit(x) for x in JOINS)), (F.pmod(F.xxhash64(F.lit(3), "value"), F.lit(len(JOINS))) + 1).cast("int"))
    joined = words.filter(F.length("value") < LEAST).select(F.concat("value", sign, F.lead("value").over(order), sign, F.lead("value", 2).over(order)).alias("value"))
    ordinary = joined.unionByName(words.select("value")).filter(F.length("value") >= LEAST).distinct()
    strings = samples.filter("held and is_random").select("value", "is_random").unionByName(ordinary.select("value", F.lit(False).alias("is_random")))
    whole = F.struct(F.lit(0).alias("start"), F.lit(len(RULES)).alias("kind_order"), F.length("value").alias("end"), F.lit("markov").alias("kind"), F.col("value").alias("value"))
    judged_random = F.size(judged(whole, model, least_per_pair)) > 0
    return strings.groupBy("is_random").agg(F.count("*").alias("strings"), F.count_if(judged_random).alias("found"))


def log_likelihood_ratio(value: Column, model: list[float]) -> Column:
    """The sum over the value's pairs of characters; value holds printable ASCII only."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")  # folded into a constant

    def place(i: Column) -> Column:
        return (F.ascii(F.substring(value, i, F.lit(1))) - LOW) * SIZE + F.ascii(F.substring(value, i + 1, F.lit(1))) - LOW

    return F.aggregate(F.sequence(F.lit(1), F.length(value) - 1), F.lit(0.0), lambda acc, i: acc + F.get(table, place(i)))


def random_parts(c: Column, model: list[float], least: float) -> Column:
    """The stretches of whole parts of a candidate, LEAST characters or more, whose ratio a pair is `least` or more, as spans.

    A part scores its ratio less `least` a pair, the signs between parts score nothing. A stretch starts anew where the score fell
    to 0 and ends at its highest score; a part that is random by itself counts even outside those.
    """

    def score(p: Column) -> Column:
        core = F.rtrim(p, F.lit(SIGNS))
        length = F.length(core)
        excess = F.when(length > 1, log_likelihood_ratio(core, model) - least * (length - 1)).otherwise(0.0)
        return F.struct(F.length(p).alias("whole"), length.alias("core"), excess.alias("excess"))

    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int>>")

    def step(s: Column, p: Column) -> Column:
        anew = s["sum"] <= 0
        start, total, end = F.when(anew, s["at"]).otherwise(s["start"]), F.when(anew, 0.0).otherwise(s["sum"]) + p["excess"], s["at"] + p["core"]
        top = F.when(anew, -1.0).otherwise(s["top"])
        better = (p["core"] > 0) & (end - start >= LEAST) & (total >= 0) & (total >= top)
        alone = (p["core"] >= LEAST) & (p["excess"] >= 0)
        done = F.when(anew & (s["top"] >= 0), F.concat(s["out"], F.array(s["best"]))).otherwise(s["out"])
        return F.struct(
            (s["at"] + p["whole"]).alias("at"), start.alias("start"), total.alias("sum"), F.when(better, total).otherwise(top).alias("top"),
            F.when(better, F.struct(start.alias("start"), end.alias("end"))).otherwise(s["best"]).alias("best"), done.alias("out"),
            F.when(alone, F.concat(s["alone"], F.array(F.struct(s["at"].alias("start"), end.alias("end"))))).otherwise(s["alone"]).alias("alone"),
        )

    def last(s: Column) -> Column:
        return F.struct(F.when(s["top"] >= 0, F.concat(s["out"], F.array(s["best"]))).otherwise(s["out"]).alias("out"), s["alone"].alias("alone"))

    zero = F.struct(c["start"].alias("at"), c["start"].alias("start"), F.lit(0.0).alias("sum"), F.lit(-1.0).alias("top"), F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")).alias("best"), none.alias("out"), none.alias("alone"))
    both = F.aggregate(F.transform(F.regexp_extract_all(c["value"], F.lit(PART), F.lit(0)), score), zero, step, last)
    # a list of one lets a lambda name the result, so that it is worked out once
    spans = F.transform(F.array(both), lambda x: F.concat(x["out"], F.filter(x["alone"], lambda a: ~F.exists(x["out"], lambda b: (b["start"] <= a["start"]) & (a["end"] <= b["end"])))))
    return F.transform(F.flatten(spans), lambda g: part_of(c, g["start"], g["end"]))


def judged(c: Column, model: list[float], least: float) -> Column:
    """The random spans of a candidate: itself if its ratio a pair is `least` or more, else its random_parts()."""
    enough = log_likelihood_ratio(c["value"], model) >= least * (F.length(c["value"]) - 1)
    return F.when(enough, F.array(c)).otherwise(random_parts(c, model, least))


def find_secrets(docs: DataFrame, least_per_pair: float = 1.0, samples: DataFrame | None = None) -> DataFrame:
    """doc_id and spans (an array of start, end, kind, value in order of start and kind) of every row of docs.

    The rules' spans always stay. A long string, or what they leave of it, is added, as kind 'markov', if its ratio a pair is
    least_per_pair or more; if the whole isn't, its random_parts() are. samples (value, is_random) train the models; without it they are
    train_on(docs)'s, from labelled_samples(): all words of docs, no sample.
    A null or empty text has no span; null and repeated doc_id values pass through row by row; other columns are ignored; an
    empty table gives an empty result.
    """
    rows = cut(scan(docs), "spans")
    model = train_on(docs) if samples is None else train(samples)
    added = F.flatten(F.transform("candidates", lambda c: judged(c, model, least_per_pair)))
    return rows.select("doc_id", F.array_sort(F.concat("base", added)).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(found_in: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the rules' spans and all spans as text, of find_secrets()."""

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found_in.select("doc_id", *(of(kind) for kind, *_ in RULES), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
