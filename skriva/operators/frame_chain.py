"""Frames sampled from videos of any length, without a row or a task that holds a video."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Scene change, seconds between frames, frames (fixed values).
SCENE, FLOOR, FRAMES, MOST_FRAMES = 0.4, 30.0, 40, 200


def sample_frames(frames: DataFrame, by: str, write: Callable[[DataFrame], DataFrame], scene: float = SCENE, floor: float = FLOOR, most: int = FRAMES) -> DataFrame:
    """by, t of the frames kept: the first, then each with a scene change or so long after the last kept; the first so many.

    A scene change is kept whatever came before, so it begins a chain of its own, as the first frame does. Within a chain a
    frame points to the first frame that is a floor later: times are cut into buckets of one floor, so it lies in the next
    bucket (a range search there) or begins the first one after that. Pointers are doubled, so what is reached from the
    beginnings takes the logarithm of most in joins. Of two neighbouring buckets at least one holds a kept frame, so a
    video's first 2 * most - 1 hold all that is asked for, and only their frames are searched.

    Times count in microseconds. A frame without a time is left out, one without a scene value is no scene change; videos
    without a name are one. Frames of one time are in order of their scene values, and equal rows are frames each.
    write puts a table between two rounds in the shared folder and reads it back.
    """
    most, step = max(1, min(most, MOST_FRAMES)), round(floor * 1_000_000)
    hit = F.lit(True) if step <= 0 else F.coalesce(F.col("scene") >= scene, F.lit(False))
    step = max(step, 1)
    usable = frames.filter(F.col("t").isNotNull() & ~F.isnan(F.col("t").cast("double")))
    rows = usable.select(F.struct(F.col(by).alias("name")).alias("v"), "t", F.round(F.col("t") * 1_000_000).cast("long").alias("at"), hit.alias("hit"))
    rows = rows.withColumn("bucket", F.expr(f"(at - pmod(at, {step}L)) div {step}L"))

    video = Window.partitionBy("v").orderBy("bucket")
    buckets = rows.groupBy("v", "bucket").agg(F.count_if("hit").alias("hits"))
    before = F.coalesce(F.sum("hits").over(video.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.withColumn("rank", F.row_number().over(video)).filter(F.col("rank") < 2 * most).withColumn("before", before)
    after = F.array(*[F.struct(F.lead("bucket", k).over(video).alias("bucket"), F.lead("before", k).over(video).alias("before")) for k in (1, 2)])
    buckets = buckets.withColumn("after", F.get(F.filter(after, lambda x: x["bucket"] > F.col("bucket") + 1), F.lit(0))).filter(F.col("before") < most)

    inside = Window.partitionBy("v", "bucket").orderBy("t", "hit")
    placed = rows.join(buckets, ["v", "bucket"]).withColumn("n", F.row_number().over(inside))
    seen = F.col("before") + F.sum(F.col("hit").cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = write(placed.select("v", "bucket", "n", "t", "at", "hit", "rank", seen.alias("seen"), F.col("after.bucket").alias("later")))

    node = F.struct("bucket", "n", "t")
    begin = placed.filter("hit or rank = 1 and n = 1").select("v", node.alias("node"))
    target = F.struct(node.alias("node"), (F.col("seen") - F.col("hit").cast("long")).alias("seen"), "hit")
    none = F.lit(None)
    # a frame asks in the next bucket, and the first frame of the bucket after that answers where none is late enough
    frame = placed.select("v", "bucket", F.col("at").alias("key"), F.lit(1).alias("kind"), "n", target.alias("target"), none.cast("struct<bucket:long,n:int,t:double>").alias("source"), none.cast("long").alias("seen"), none.cast("long").alias("later"))
    asks = placed.select("v", (F.col("bucket") + 1).alias("bucket"), (F.col("at") + step).alias("key"), F.lit(0).alias("kind"), "n", none.cast(frame.schema["target"].dataType).alias("target"), node.alias("source"), "seen", "later")
    down = Window.partitionBy("v", "bucket").orderBy(F.desc("key"), F.desc("kind"), F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    asked = frame.union(asks).withColumn("found", F.last("target", ignorenulls=True).over(down)).filter("kind = 0")
    first = placed.filter("n = 1").select("v", F.col("bucket").alias("later"), target.alias("beyond"))
    pointers = asked.filter("found is not null").select("v", "source", "seen", "found").union(
        asked.filter("found is null and later is not null").join(first, ["v", "later"]).select("v", "source", "seen", "beyond")
    )
    # a chain ends at the next scene change, which begins its own
    pointers = write(pointers.filter("not found.hit and found.seen = seen").select("v", F.col("source"), F.col("found.node").alias("node")))

    reached, jump = begin, 1
    while jump < most:
        more = reached.select("v", F.col("node").alias("source")).join(pointers, ["v", "source"]).select("v", "node")
        reached = write(reached.union(more))
        jump *= 2
        if jump < most:
            ends = pointers.select("v", F.col("source").alias("node"), F.col("node").alias("to"))
            pointers = write(pointers.join(ends, ["v", "node"]).select("v", "source", F.col("to").alias("node")))
            if pointers.isEmpty():
                break
    order = F.row_number().over(Window.partitionBy("v").orderBy("node"))
    return reached.withColumn("__n", order).filter(F.col("__n") <= most).select(F.col("v.name").alias(by), F.col("node.t").alias("t"))
