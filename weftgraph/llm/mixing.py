"""Mixing sources to target weights along a curriculum that varies with training time.

DataFrame functions only. Each source has a schedule: its weight at points of training time in
[0, 1], linear between them. The integral of a schedule is the source's weight in the whole mix
and gives its target in words; the share of the target demanded by time t is the schedule's
running integral over its total. A document's training position is the time at which its source
has demanded the words before it, so the inverse of that running integral; sorting by position
by range gives the training order.

Documents of a source come in order of the md5 of their id. Prefix sums go over totals of hash
ranges, so no source is ever one task's rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.storage import written

WORD = r"[^\x20\x09-\x0D]+"
#: Schedules by a source's place in order, repeating: (time, weight) points; integrals 5, 2 and 1.
SCHEDULES = (((0.0, 6.0), (1.0, 4.0)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.0), (1.0, 2.0)))


def integral(schedule: Sequence[tuple[float, float]]) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key() -> Column:
    return F.xxhash64("doc_id", "source", "text")


def position(share: Column, which: Column, schedules: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """The time by which a schedule has demanded this share of its total; which: the schedule's index."""
    out = F.lit(None).cast("double")
    for k, points in enumerate(schedules):
        total, done, at = integral(points), 0.0, F.lit(float(points[-1][0]))
        pieces = []
        for (t0, w0), (t1, w1) in zip(points, points[1:]):
            area = (t1 - t0) * (w0 + w1) / 2
            pieces.append((done / total, (done + area) / total, t0, t1, w0, w1))
            done += area
        for low, high, t0, t1, w0, w1 in reversed(pieces):
            need = F.greatest(share - low, F.lit(0.0)) * total
            slope = (w1 - w0) / (t1 - t0)
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * need, F.lit(0.0)))
            step = F.when(root + w0 > 0, 2 * need / (root + w0)).otherwise(0.0)
            at = F.when(share < high, F.least(t0 + step, F.lit(t1))).otherwise(at)
        out = F.when(which == k, at).otherwise(out)
    return out


def targets(sizes: DataFrame, schedules: Sequence = SCHEDULES, limit: int = 3) -> DataFrame:
    """Each source's target: its weight's share of all words, at most limit times its size.

    sizes: source, source_size. What capped sources leave goes to the others by weight until none
    is above its cap: sources are capped in order of size by weight, and the first level at which
    the next source stays under its cap holds for all that follow. One row for each source.
    """
    weights = [integral(s) for s in schedules]
    # Only one row for each source comes here, so an unpartitioned window is small.
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("schedule") + 1).cast("int"))
    ranked = sizes.withColumn("schedule", (place % len(weights)).cast("int")).withColumn("weight", weight)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    earlier = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - limit * F.coalesce(F.sum("source_size").over(earlier), F.lit(0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    tried = ranked.select("*", left.cast("double").alias("left"), weight_left.alias("weight_left"))
    fits = F.col("left") * F.col("weight") <= limit * F.col("source_size") * F.col("weight_left")
    level = F.min_by(F.struct("left", "weight_left"), F.when(fits, F.col("source_size") / F.col("weight"))).over(every)
    tried = tried.withColumn("level", level)
    target = F.when(
        F.col("level").isNull() | (F.col("weight_left") > F.col("level.weight_left")), (limit * F.col("source_size")).cast("double")
    ).otherwise(F.col("level.left") * F.col("weight") / F.col("level.weight_left"))
    return tried.select("source", "source_size", "schedule", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix_plan(docs: DataFrame, schedules: Sequence = SCHEDULES, limit: int = 3, per_range: int = 4096) -> DataFrame:
    """What the mix takes of each document.

    docs: doc_id, text, source; other columns are kept out. Every row is a document, repeated ids
    too. per_range: about how many documents, at most, of one range of hashes; prefix sums go over
    the ranges' totals, so ranges grow in number with the documents, not in size. A null or empty text
    has size 0 and takes nothing; a null source is a source, the last. Each source goes through
    its documents as often as its target asks, at most limit times; the last pass ends inside a
    document, so a source's words are its target to the word. Returns doc_id, row_key (a hash of
    id, source and text), source, size, source_size, target, passes: array of struct(copy, words, position),
    taken. No rows give no rows.
    """
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row_key().alias("row_key"))
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = written(sized.withColumn("h", h), "mix-sizes")
    digits = 2
    while 16**digits * per_range < sized.count():
        digits += 1
    sized = sized.withColumn("part", F.substring("h", 1, digits))
    totals = sized.groupBy("source", "part").agg(F.sum("size").alias("words"))
    goal = targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")), schedules, limit)
    running = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    known = totals.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), F.col("part").alias("p"), "before", "source_size", "schedule", "target"
    )
    inside = Window.partitionBy("source", "part").orderBy("h", "doc_id", "size", "row_key")
    docs_in = sized.withColumn("inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    joined = docs_in.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")), "left")
    start = F.col("before") + F.col("inside")
    words_target = F.round("target").cast("long")

    def one(copy: Column) -> Column:
        begins = copy * F.col("source_size") + start
        words = F.greatest(F.lit(0), F.least(F.col("size"), words_target - begins))
        share = F.when(F.col("target") > 0, begins / F.col("target")).otherwise(F.lit(0.0))
        return F.struct(
            copy.alias("copy"), words.cast("long").alias("words"), position(share, F.col("schedule"), schedules).alias("position")
        )

    passes = F.filter(F.array(*[one(F.lit(k)) for k in range(limit)]), lambda p: p["words"] > 0)
    planned = joined.withColumn("passes", passes)
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return planned.select("doc_id", "row_key", "source", "size", "source_size", "target", "passes", taken.alias("taken"))


def in_training_order(plan: DataFrame) -> DataFrame:
    """A plan's documents, sorted by range of the position of their first pass; those without a pass come last.

    first_position and last_position: of the first and the last pass; null without one.
    """
    found = plan.withColumns(
        {"first_position": F.get("passes", F.lit(0))["position"], "last_position": F.get("passes", F.size("passes") - 1)["position"]}
    )
    keys = [F.col("first_position").asc_nulls_last(), F.col("row_key")]
    return found.repartitionByRange(*keys).sortWithinPartitions(*keys)


def first_words(text: Column, n: Column) -> Column:
    """The first n words, joined by single spaces."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), n.cast("int")), " ")


def mix(docs: DataFrame, schedules: Sequence = SCHEDULES, limit: int = 3) -> DataFrame:
    """The mixed documents in training order: docs' own columns, a row for each pass over a document.

    A document that the last pass ends in is cut after its words taken there, joined by single
    spaces; every other row has its whole text. Rows equal in id, source and text pool their passes.
    Rows are sorted by range of their position. n_chars, if there, is that of the text returned.
    """
    names = docs.columns
    plan = mix_plan(docs, schedules, limit).where(F.size("passes") > 0)
    plan = plan.groupBy(F.col("row_key").alias("_k"), F.coalesce("doc_id", F.lit(-1)).alias("_d")).agg(
        F.flatten(F.collect_list("passes")).alias("_passes"), F.first("size").alias("_size")
    )
    keyed = docs.withColumn("_key", row_key()).withColumn("_id", F.coalesce("doc_id", F.lit(-1)))
    once = F.row_number().over(Window.partitionBy("_key", "_id").orderBy(F.lit(1)))
    keyed = keyed.withColumn("_nth", once).where("_nth = 1")
    taken = keyed.join(plan, (F.col("_key") == F.col("_k")) & (F.col("_id") == F.col("_d")))
    taken = taken.withColumn("_pass", F.explode("_passes"))
    text = F.when(F.col("_pass.words") < F.col("_size"), first_words(F.col("text"), F.col("_pass.words"))).otherwise(F.col("text"))
    out = taken.withColumn("text", text).withColumn("_at", F.col("_pass.position"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.repartitionByRange("_at", "_key").sortWithinPartitions("_at", "_key").select(*names)
