"""Request rates, stuck files and sessions over event tables."""

from pyspark.sql import DataFrame, Window, functions as F

# Fixed values.
ANONYMOUS_PER_MINUTE = 50
USER_PER_MINUTE = 100
WINDOW_SECONDS = 60
STUCK_SECONDS = 120
SESSION_SECONDS = 30 * 60

#: rolling counts are taken in pieces of this many seconds
PIECE_SECONDS = 3600


def rolling_rate(events: DataFrame, limit: int = USER_PER_MINUTE, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Per user and second: the events in it, those in the minute up to it, and whether
    that is too many.

    A user may cause a large share of all events.  They are first counted per second, and
    time is cut into pieces: a second also visits the next piece when it lies within the
    window of it; windows run inside ``(user, piece)`` and only seconds in their own piece
    are kept.  So a window never sees more rows than two pieces have seconds.
    """
    width = max(PIECE_SECONDS, seconds)
    second = F.unix_seconds(F.col("ts").cast("timestamp")).alias("second")
    counted = events.select("user_id", second).groupBy("user_id", "second") \
        .agg(F.count(F.lit(1)).alias("events"))
    own = F.floor(F.col("second") / width)
    reach = F.floor((F.col("second") + (seconds - 1)) / width)
    rows = counted.withColumn("own", own).withColumn("piece", F.explode(F.sequence(own, reach)))
    frame = Window.partitionBy("user_id", "piece").orderBy("second").rangeBetween(-(seconds - 1), 0)
    return (rows.withColumn("requests", F.sum("events").over(frame))
            .filter(F.col("piece") == F.col("own"))
            .select("user_id", "second", "events", "requests", (F.col("requests") > limit).alias("over_limit")))


def rate_limit_violations(events: DataFrame, limit: int = USER_PER_MINUTE,
                          seconds: int = WINDOW_SECONDS) -> DataFrame:
    return rolling_rate(events, limit, seconds).filter("over_limit").drop("over_limit")


def file_status(events: DataFrame) -> DataFrame:
    """The latest status of every file."""
    last = F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id")).alias("last")
    return events.groupBy("file_id").agg(last, F.count(F.lit(1)).alias("changes")) \
        .select("file_id", "last.status", "last.ts", "changes")


def stuck_files(events: DataFrame, now, seconds: int = STUCK_SECONDS) -> DataFrame:
    """Files whose last status is ``analyzing`` and too old."""
    age = F.unix_seconds(now) - F.unix_seconds(F.col("ts"))
    return file_status(events).withColumn("age_seconds", age) \
        .filter((F.col("status") == "analyzing") & (F.col("age_seconds") > seconds)) \
        .select("file_id", "age_seconds", "changes")


def sessions(events: DataFrame, gap: int = SESSION_SECONDS) -> DataFrame:
    """Sessions of a user, separated by a gap of at least ``gap`` seconds.

    Events within half a gap always share a session, so they are first reduced to one row
    per user and half-gap slot; the window then sees at most one row per slot, however
    active a user is.
    """
    second = F.unix_micros(F.col("ts").cast("timestamp"))
    width = gap * 1_000_000
    slots = events.select("user_id", second.alias("at")) \
        .groupBy("user_id", F.floor(F.col("at") / (width // 2)).alias("slot")) \
        .agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("events"))
    order = Window.partitionBy("user_id").orderBy("slot")
    before = F.lag("last").over(order)
    opens = F.when(before.isNull() | (F.col("first") - before >= width), 1).otherwise(0)
    numbered = slots.withColumn("opens", opens).withColumn("session", F.sum("opens").over(order))
    return numbered.groupBy("user_id", "session").agg(
        F.min("first").alias("started"), F.max("last").alias("ended"), F.sum("events").alias("events"))
