"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a pseudo-random order (md5 of a
seed and the document id).  A document's virtual finish time is the source's
cumulative words up to and including it divided by the source's target; a
source whose target exceeds its size starts its queue over.  The takes are
range-sorted by virtual finish time over all sources and truncated where
their running sum would exceed the budget, which is the sum of all sizes.

No step sees a whole source in one task: the order's range is cut into equal
slices, as many as the documents need at ``ROWS_PER_SLICE``; running sums are
local to a slice, plus the totals of the slices before it.  The cut is found
by sums over a grid of finish times, as fine, and by sorting the one cell it
falls into; it is a single finish time with its ties' order, so that a
document knows from its own row how often it is taken.

Defined cases: a null text has size 0 and takes 0; a null source is a source
of its own, ordered last; repeated rows are separate documents; rows with a
null id queue like others, ordered by where they stand; an empty table gives
an empty result; other columns are ignored (:func:`mix`) or carried
(:func:`mixed_documents`), clashing names too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitescope.llm.common import materialize

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
ROWS_PER_SLICE = 1 << 15
SEED = "wfq"


def word_count(text) -> F.Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]"), "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)`` rows.

    Sources by code point, null last, take the weights in turn.  The share of
    a source is capped at ``max_repeats`` times its size and the excess goes
    to the others by weight: sources are capped in ascending order of
    cap / weight, and the first ``k`` are capped where the next one's ratio
    reaches the level that is left for it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    per = per.withColumn("weight", w)
    by_ratio = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats))).withColumn("ratio", F.col("cap") / F.col("weight"))
    whole = Window.partitionBy()
    per = per.withColumn(
        "level",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest),
    )
    # the level of the first source that is not capped holds for all after it
    per = per.withColumn("free", F.col("ratio") > F.col("level"))
    per = per.withColumn("final", F.min(F.when(F.col("free"), F.struct("ratio", "level"))).over(whole)["level"])
    target = F.when(F.col("final").isNull() | (F.col("ratio") <= F.col("final")), F.col("cap")).otherwise(F.col("weight") * F.col("final"))
    return per.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", carry: bool = False,
        weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: key, size, source_size, target, takes
    (how often the mix takes it) and taken (words); ``carry`` adds the row itself
    as the struct ``doc``."""
    whole_row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if carry else []
    name = F.col(f"`{source}`")
    # a queue's name: never null, in the order of the sources
    queue_of = F.coalesce(F.concat(F.lit("s"), name.cast("string")), F.lit("t"))
    sized = docs.select(
        F.monotonically_increasing_id().alias("uid"), *whole_row, F.col(f"`{key}`").alias("key"), name.alias("source"),
        queue_of.alias("queue"), word_count(F.col(f"`{text}`")).alias("size"),
    )
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("key").cast("string"), F.concat(F.lit("null:"), F.col("uid").cast("string")))).cast("binary"))
    sized = materialize(sized.withColumn("h", order), "mix-sized")
    targets = materialize(source_targets(sized.select("source", "size"), weights, max_repeats), "mix-targets")
    facts = sized.agg(F.count("*"), F.sum("size")).first()
    n, budget = facts[0], facts[1] or 0
    slices = max(16, -(-n // ROWS_PER_SLICE))
    # the first 48 bits of the order, as a share of all
    part = F.floor(F.conv(F.substring("h", 1, 12), 16, 10).cast("double") * (slices / float(1 << 48))).cast("int")
    small = sized.select("uid", *([] if carry else ["key"]), "queue", "size", "h", part.alias("slice"))

    # cumulative words in queue order: totals of the slices before, then inside the slice
    inside = Window.partitionBy("queue", "slice").orderBy("h", "size", "uid").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("queue").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ahead = small.groupBy("queue", "slice").agg(F.sum("size").alias("n"))
    ahead = ahead.select("queue", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    per = targets.select(F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t")).alias("queue"), "source_size", "target")
    queue = small.withColumn("within", F.sum("size").over(inside)).join(ahead.join(per, "queue"), ["queue", "slice"])
    queue = materialize(queue.withColumn("cum", F.col("ahead") + F.col("within")).drop("slice", "ahead", "within"), "mix-queue")

    # a take for each pass over the queue that can finish near time 1
    rounds = F.least(F.lit(max_repeats), F.ceil(F.try_divide("target", "source_size")).cast("int"))
    passes = F.when((F.col("size") > 0) & (F.col("target") > 0), F.sequence(F.lit(0), rounds - 1)).otherwise(F.array().cast("array<int>"))

    def finish(p):
        return (F.col("cum") + p * F.col("source_size")) / F.col("target")

    takes = queue.select("uid", "queue", "size", "h", "cum", "source_size", "target", F.explode(passes).alias("pass"))
    takes = takes.select("uid", "queue", "size", "h", "pass", finish(F.col("pass")).alias("vft"))
    takes = takes.withColumn("cell", F.floor(F.col("vft") * F.lit(slices)))
    upto = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    # a row for each cell: as few as the slices
    cells = takes.groupBy("cell").agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(upto))
    cells = cells.where(F.col("upto") > F.lit(budget))
    cut = cells.agg(F.min(F.struct("cell", (F.col("upto") - F.col("n")).alias("spent")))).first()[0]
    rank = ("vft", "queue", "h", "uid", "pass")
    last = None
    if cut:
        # the last take of the mix, in the cell in which the budget ends; before the cell's first, all of an earlier cell
        inner = Window.orderBy(*rank).rowsBetween(Window.unboundedPreceding, 0)
        run = takes.where(F.col("cell") == F.lit(cut["cell"])).withColumn("run", F.lit(cut["spent"]) + F.sum("size").over(inner))
        last = run.where(F.col("run") <= F.lit(budget)).agg(F.max(F.struct(*rank))).first()[0]

    def taken(p):
        if not cut:
            return F.lit(True)
        cell = F.floor(finish(p) * F.lit(slices))
        earlier = cell < F.lit(cut["cell"])
        if last is None:
            return earlier
        at = F.struct(finish(p).alias("vft"), F.col("queue"), F.col("h"), F.col("uid"), p.cast("int").alias("pass"))
        end = F.struct(*[F.lit(last[c]).alias(c) for c in rank])
        return earlier | ((cell == F.lit(cut["cell"])) & (at <= end))

    out = queue.withColumn("takes", F.size(F.filter(passes, taken)))
    result = [F.col("size"), "source_size", "target", F.col("takes").cast("int").alias("takes"), (F.col("size") * F.col("takes")).alias("taken")]
    if not carry:
        return out.select(F.col("key").alias("mix_key"), *result)
    out = out.select("uid", *result).drop("size")
    return sized.select("uid", "doc", "key", "size").join(out, "uid").select("doc", F.col("key").alias("mix_key"), "size", "source_size", "target", "takes", "taken")


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` as the mix takes them: a row for each take, columns unchanged."""
    out = mix(docs, carry=True, **kw).where("takes > 0")
    return out.select("doc", F.explode(F.sequence(F.lit(1), F.col("takes"))).alias("take")).select("doc.*")
