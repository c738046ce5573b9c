"""Mixing sources to target shares of tokens, as a curriculum whose weights change over training.

Every source s of a mix has a weight schedule w_s(t) over training time t in [0, 1], piecewise linear between knots and
scaled so that its integral is the source's share. It may be given as a table (mix, source, at, weight); without rows it is
a line from nearer the uniform mixture to beyond the target (``ramp`` 0: constant). Of the tokens that a source supplies
in all, its integral up to t is due by time t. Inverting that demand at the tokens that come before a document in its
source's order gives the document's training position; sorting by position interleaves the sources as scheduled.

The size T of a mix is ``total`` if given. Else it is the largest at which the sources that are too small, used as often
as their caps allow, miss their shares by ``slack`` of the mix at most in all: one tiny source doesn't set the size, and
the shares stay near the targets. ``slack`` 0 makes the scarcest source set it, so that every share is met. A source that
falls short is used up to its cap, and the reached share says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookout.llm import bpe
from lookout.session import broadcast_if_small, materialize, spread

#: Rows per bucket of a source's order that the number of buckets, a power of two, aims at.
BUCKET_ROWS, LEAST_BITS = 20_000, 4
#: The part of a mix that too small sources may leave unfilled in all.
SLACK = 0.1


def clean_targets(targets: DataFrame) -> DataFrame:
    """mix, source, share, max_repeats of the rows with a positive share and a cap of at least 1.

    Null, NaN, zero and negative shares and null names ask for nothing; a null cap is 1; of repeated rows of a source the
    largest share and cap hold.
    """
    share = F.col("target_share").cast("double")
    good = targets.where(F.col("mix").isNotNull() & F.col("source").isNotNull() & share.isNotNull() & ~F.isnan(share) & (share > 0))
    grouped = good.groupBy("mix", "source").agg(F.max(share).alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).cast("long").alias("max_repeats"))
    return grouped.where("max_repeats >= 1")


def token_counts(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **vocabulary) -> DataFrame:
    """doc_id, source, n_tokens of the documents that a mix can use, written once: those with tokens and a wanted source."""
    wanted, _ = broadcast_if_small(clean_targets(targets).select(F.col("source").alias("_wanted")).distinct())
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"))
    usable = spread(narrow).join(wanted, F.col("source") == F.col("_wanted"), "left_semi")
    return materialize(bpe.with_counts(usable, keep=("doc_id", "source"), **vocabulary).where("n_tokens > 0"), "token-counts")


def _ordered(counts: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens, before: the tokens that come earlier in the source's order; source, available).

    The order is that of a hash of the id. Its top bits cut a source into even buckets, so a source that holds a third of
    all rows has as many partitions as its size asks for: bucket sums first, then running sums within buckets.
    """
    rows = counts.count()
    bits = min(31, max(LEAST_BITS, (rows // BUCKET_ROWS).bit_length() + 1))
    hashed = counts.withColumn("_h", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))).withColumn("_bucket", F.shiftrightunsigned("_h", 64 - bits).cast("int"))
    sums = materialize(hashed.groupBy("source", "_bucket").agg(F.sum("n_tokens").alias("_tokens")), "bucket-sums")
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("_source"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_tokens").over(earlier), F.lit(0)).alias("_offset"))
    offsets, _ = broadcast_if_small(offsets)
    within = Window.partitionBy("source", "_bucket").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = hashed.withColumn("_upto", F.sum("n_tokens").over(within))
    placed = placed.join(offsets, (F.col("source") == F.col("_source")) & (F.col("_bucket") == F.col("_b")))
    return placed.select("doc_id", "source", "n_tokens", (F.col("_offset") + F.col("_upto") - F.col("n_tokens")).alias("before")), sums.groupBy("source").agg(F.sum("_tokens").alias("available"))


def _knots(schedule: DataFrame | None, shares: DataFrame, ramp: float) -> DataFrame:
    """_mix, _source, knots (array of (at, weight) from 0 to 1 in order): as given, else the line of the source's share.

    Rows of the schedule with nulls, NaN, negative weights or times outside [0, 1] don't count; of two weights at a time
    the larger does. Before the first knot and after the last the weight stays. Weights that are all 0 are no schedule.
    """
    per_mix = Window.partitionBy("mix")
    even = shares.withColumn("_even", F.lit(1.0) / F.count(F.lit(1)).over(per_mix))
    # The steepest slope that keeps every weight of the mix from becoming negative.
    room = F.min(F.when(F.col("share") != F.col("_even"), F.col("share") / F.abs(F.col("share") - F.col("_even")))).over(per_mix)
    slope = (F.col("share") - F.col("_even")) * F.least(F.lit(1.0), F.coalesce(room, F.lit(1.0))) * F.lit(float(ramp))
    knot = lambda t, w: F.struct(t.cast("double").alias("at"), w.cast("double").alias("weight"))
    lines = even.select("mix", "source", F.array(knot(F.lit(0), F.col("share") - slope), knot(F.lit(1), F.col("share") + slope)).alias("_line"))
    if schedule is None:
        return lines.select(F.col("mix").alias("_mix"), F.col("source").alias("_source"), F.col("_line").alias("knots"))
    good = schedule.select("mix", "source", F.col("at").cast("double").alias("at"), F.col("weight").cast("double").alias("weight"))
    good = good.where("mix is not null and source is not null and at between 0 and 1 and weight >= 0 and not isnan(weight)").groupBy("mix", "source", "at").agg(F.max("weight").alias("weight"))
    given = good.groupBy("mix", "source").agg(F.array_sort(F.collect_list(F.struct("at", "weight"))).alias("_given"), F.max("weight").alias("_top")).where("_top > 0").drop("_top")
    first, last = F.element_at("_given", 1), F.element_at("_given", -1)
    whole = F.concat(F.filter(F.array(knot(F.lit(0), first["weight"])), lambda _: first["at"] > 0), F.col("_given"), F.filter(F.array(knot(F.lit(1), last["weight"])), lambda _: last["at"] < 1))
    joined = lines.join(given, ["mix", "source"], "left")
    return joined.select(F.col("mix").alias("_mix"), F.col("source").alias("_source"), F.coalesce(F.when(F.col("_given").isNotNull(), whole), F.col("_line")).alias("knots"))


def _segments(knots: Column) -> Column:
    """The pieces of a schedule: start t0, weight w0, slope s, and the parts c0 and c1 of the whole integral before and after."""
    pieces = F.transform(F.sequence(F.lit(1), F.size(knots) - 1), lambda i: F.struct(F.element_at(knots, i).alias("a"), F.element_at(knots, i + 1).alias("b")))
    pieces = F.filter(pieces, lambda x: x["b"]["at"] > x["a"]["at"])
    area = lambda x: (x["a"]["weight"] + x["b"]["weight"]) / 2 * (x["b"]["at"] - x["a"]["at"])
    whole = F.aggregate(pieces, F.lit(0.0), lambda acc, x: acc + area(x))
    kind = "array<struct<t0:double,w0:double,s:double,c0:double,c1:double>>"

    def add(acc: Column, x: Column) -> Column:
        before = F.when(F.size(acc) > 0, F.element_at(acc, -1)["c1"]).otherwise(F.lit(0.0))
        slope = (x["b"]["weight"] - x["a"]["weight"]) / (x["b"]["at"] - x["a"]["at"]) / whole
        return F.concat(acc, F.array(F.struct(x["a"]["at"].alias("t0"), (x["a"]["weight"] / whole).alias("w0"), slope.alias("s"), before.alias("c0"), (before + area(x) / whole).alias("c1"))))

    return F.aggregate(pieces, F.array().cast(kind), add)


def plan(targets: DataFrame, available: DataFrame, ramp: float = 1.0, total: int | None = None, slack: float = SLACK, schedule: DataFrame | None = None) -> DataFrame:
    """Per mix and source with documents: share (rescaled to the sources that have any), total (T), demand (tokens that the source supplies) and segments of its schedule."""
    joined = clean_targets(targets).join(available, "source")
    share = joined.withColumn("share", F.col("share") / F.sum("share").over(Window.partitionBy("mix"))).withColumn("_most", F.col("available") * F.col("max_repeats"))
    # Sources in the order in which they fall short as T grows. If the first k of them hold S of the shares and C tokens at
    # their caps, they miss S - C / T; so T is the least C / (S - slack) over all k with S above the slack.
    upto = Window.partitionBy("mix").orderBy(F.col("_most") / F.col("share"), "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = share.withColumn("_S", F.sum("share").over(upto)).withColumn("_C", F.sum("_most").over(upto))
    size = F.min(F.when(F.col("_S") > slack + 1e-12, F.col("_C") / (F.col("_S") - F.lit(float(slack))))).over(Window.partitionBy("mix")) if total is None else F.lit(float(total))
    sized = summed.withColumn("total", size).withColumn("demand", F.least(F.col("share") * F.col("total"), F.col("_most").cast("double")))
    knots = _knots(schedule, share.select("mix", "source", "share"), ramp)
    out = sized.join(knots, (F.col("mix") == F.col("_mix")) & (F.col("source") == F.col("_source")))
    return out.select("mix", "source", "share", "max_repeats", "available", "total", "demand", _segments(F.col("knots")).alias("segments"))


def position(part: Column, segments: Column) -> Column:
    """The time by which ``part`` of all that the source supplies is due: the inverse of its schedule's integral."""
    y = F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0))
    s = F.coalesce(F.element_at(F.filter(segments, lambda x: (y < x["c1"]) & (x["c1"] > x["c0"])), 1), F.element_at(F.filter(segments, lambda x: x["c1"] > x["c0"]), -1))
    rest = F.greatest(y - s["c0"], F.lit(0.0))
    root = F.sqrt(F.greatest(F.lit(0.0), s["w0"] * s["w0"] + s["s"] * rest * 2))
    return F.least(F.lit(1.0), s["t0"] + F.when(rest <= 0, F.lit(0.0)).otherwise(rest * 2 / (s["w0"] + root)))


def selection(counts: DataFrame, targets: DataFrame, seed: int = 7, **sizing) -> DataFrame:
    """mix, position, source, doc_id, repeat (0 for a document's first use), n_tokens; not sorted.

    A source's order is run through again and again until its demand is met: a document is used while the tokens before
    it are short of the demand, so a source exceeds it by less than one document, and no document is used more often than
    the cap. Rows that repeat a doc_id are documents of their own. ``sizing``: ramp, total, slack, schedule of :func:`plan`.
    """
    ordered, available = _ordered(counts, seed)
    wanted = plan(targets, available, **sizing).withColumnRenamed("source", "_source")
    wanted, _ = broadcast_if_small(materialize(wanted, "mix-plan"))
    rows = ordered.join(wanted, F.col("source") == F.col("_source"))
    uses = F.least(F.col("max_repeats"), F.ceil((F.col("demand") - F.col("before")) / F.col("available") - F.lit(1e-12))).cast("int")
    used = rows.withColumn("_uses", uses).where("_uses > 0").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("_uses") - 1)))
    part = (F.col("before") + F.col("repeat") * F.col("available")) / F.col("demand")
    return used.select("mix", position(part, F.col("segments")).alias("position"), "source", "doc_id", "repeat", "n_tokens")


def mixed(docs: DataFrame, targets: DataFrame, seed: int = 7, vocabulary: dict | None = None, **sizing) -> DataFrame:
    """The selection of every mix, range-sorted by mix and position."""
    return selection(token_counts(docs, targets, **(vocabulary or {})), targets, seed, **sizing).orderBy("mix", "position", "source", "doc_id", "repeat")


def reached(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Per row of mix_targets that names a mix and source: target_share as given, and the tokens, share, documents and most repeats of a selection."""
    got = chosen.groupBy("mix", "source").agg(F.sum("n_tokens").alias("tokens"), F.count_if(F.col("repeat") == 0).alias("documents"), F.count(F.lit(1)).alias("uses"), (F.max("repeat") + 1).alias("most_uses"))
    got = got.withColumn("reached_share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy("mix")))
    asked = targets.where("mix is not null and source is not null").groupBy("mix", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    return asked.join(got, ["mix", "source"], "left").na.fill(0, ["tokens", "documents", "uses", "most_uses"]).na.fill(0.0, ["reached_share"])


def shares(docs: DataFrame, targets: DataFrame, seed: int = 7, vocabulary: dict | None = None, **sizing) -> DataFrame:
    """:func:`reached` of the selection."""
    return reached(selection(token_counts(docs, targets, **(vocabulary or {})), targets, seed, **sizing), targets)


def checks(docs: DataFrame, targets: DataFrame, seed: int = 7, vocabulary: dict | None = None, slack: float = SLACK) -> DataFrame:
    """Per mix and source that a selection can use: whether its rules hold.

    caps_kept: no document is used more often than the cap. supplied: the source has its share of T, to less than one
    document, or all its documents are used as often as the cap allows. near_target: what a source lacks of its share
    (rescaled to sources with documents) is within the slack. in_time: by the middle of training the source has supplied
    its schedule's half, to less than one document.
    """
    counts = token_counts(docs, targets, **(vocabulary or {}))
    chosen = materialize(selection(counts, targets, seed, slack=slack), "mix-selection")
    have = counts.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.max("n_tokens").alias("_longest"), F.count(F.lit(1)).alias("_docs"))
    wanted = plan(targets, have.select("source", "available"), slack=slack).join(have.select("source", "_longest", "_docs"), "source")
    got = chosen.groupBy("mix", "source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.max("repeat").alias("_repeat"), F.sum(F.when(F.col("position") < 0.5, F.col("n_tokens")).otherwise(0)).alias("_early"))
    got = got.withColumn("_whole", F.sum("tokens").over(Window.partitionBy("mix")))
    line = F.element_at("segments", 1)  # the built-in schedule has one piece
    due = line["w0"] / 2 + line["s"] / 8
    over = F.col("tokens") - F.col("share") * F.col("total")
    return wanted.join(got, ["mix", "source"], "left").select(
        "mix",
        "source",
        (F.col("_repeat") < F.col("max_repeats")).alias("caps_kept"),
        (((over > -1e-6) & (over < F.col("_longest"))) | (F.col("uses") == F.col("_docs") * F.col("max_repeats"))).alias("supplied"),
        (F.col("share") - F.col("tokens") / F.col("_whole") < F.lit(slack) + F.col("_longest") / F.col("_whole")).alias("near_target"),
        (F.abs(F.col("_early") - F.col("demand") * due) <= F.col("_longest")).alias("in_time"),
    )
