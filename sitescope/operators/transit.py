"""Timetables and sampled journeys."""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(hms: Column) -> Column:
    """HH:MM:SS, hours above 23 allowed, as seconds."""
    p = F.split(hms, ":")
    return p[0].cast("int") * 3600 + p[1].cast("int") * 60 + p[2].cast("int")


def epoch_ms(day: Column, minute: Column, zone: str = "Europe/Helsinki") -> Column:
    """Milliseconds since 1970 of a local wall time, whatever the session's zone."""
    at = F.make_timestamp(F.year(day), F.month(day), F.day(day), F.floor(minute / 60).cast("int"), (minute % 60).cast("int"), F.lit(0), F.lit(zone))
    return F.unix_millis(at)


def sample_labels(first: int = 7 * 60, last: int = 8 * 60) -> Column:
    """HH:MM of each minute, both ends included."""
    return F.transform(F.sequence(F.lit(first), F.lit(last)), lambda m: F.format_string("%02d:%02d", F.floor(m / 60), m % 60))


def active_services(calendar: DataFrame, exceptions: DataFrame, day: str) -> DataFrame:
    """Services that run on a day (YYYYMMDD): by weekday and range, with
    exceptions 1 added and 2 taken away."""
    d = F.to_date(F.lit(day), "yyyyMMdd")
    flags = [F.when(F.date_format(d, "EEEE") == name.capitalize(), F.col(name).cast("int")) for name in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")]
    base = calendar.where((F.coalesce(*flags) == 1) & F.lit(day).between(F.col("start_date"), F.col("end_date"))).select("service_id")
    that = exceptions.where(F.col("date") == day)
    more, less = (that.where(F.col("exception_type").cast("int") == k).select("service_id") for k in (1, 2))
    return base.unionByName(more).distinct().join(less, "service_id", "left_anti")


def connections(stop_times: DataFrame, trips: DataFrame, services: DataFrame) -> DataFrame:
    """Consecutive stops of the trips that run: departure and arrival seconds."""
    running = trips.join(services, "service_id", "left_semi").select("trip_id")
    s = stop_times.join(running, "trip_id", "left_semi")
    w = Window.partitionBy("trip_id").orderBy(F.col("stop_sequence").cast("int"))
    s = s.withColumns({"from_stop": F.lag("stop_id").over(w), "departure": F.lag(seconds(F.col("departure_time"))).over(w), "arrival": seconds(F.col("arrival_time"))})
    return s.where("from_stop IS NOT NULL").select("trip_id", "from_stop", "departure", F.col("stop_id").alias("to_stop"), "arrival")


def profiles(conns: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target group the useful (stop, departure, arrival) of a
    connection scan, latest departures first; one task for each group."""

    def scan(t_targets: pa.Table, t_conns: pa.Table) -> pa.Table:
        if not t_targets.num_rows:
            return pa.table({"grp": pa.array([], pa.int64()), "stop": pa.array([], pa.string()), "departure": pa.array([], pa.int64()), "arrival": pa.array([], pa.int64())})
        goal = set(t_targets.column("stop").to_pylist())
        rows = sorted(zip(*(t_conns.column(c).to_pylist() for c in ("departure", "arrival", "from_stop", "to_stop")), strict=True), key=lambda r: (-r[0], r[1], r[2], r[3]))
        kept: dict[str, tuple[list[int], list[int]]] = {}  # negative departures ascending, arrivals

        def arrive(stop: str, at: int) -> int | None:
            if stop in goal:
                return at
            if stop not in kept:
                return None
            deps, arrs = kept[stop]
            k = bisect_left(deps, -at + 1)
            return min(arrs[:k], default=None) if k else None

        for dep, arr, a, b in rows:
            end = arrive(b, arr)
            if end is None or a in goal:
                continue
            known = arrive(a, dep)
            if known is None or end < known:
                deps, arrs = kept.setdefault(a, ([], []))
                deps.append(-dep)
                arrs.append(end)
        out = [(s, -d, e) for s, (ds, es) in kept.items() for d, e in zip(ds, es, strict=True)]
        g = t_targets.column("grp")[0].as_py()
        return pa.table({"grp": pa.array([g] * len(out), pa.int64()), "stop": pa.array([o[0] for o in out], pa.string()), "departure": pa.array([o[1] for o in out], pa.int64()), "arrival": pa.array([o[2] for o in out], pa.int64())})

    every = targets.select(F.col("grp").alias("of")).distinct().join(conns.select(F.col("departure").cast("long").alias("departure"), F.col("arrival").cast("long").alias("arrival"), "from_stop", "to_stop"))
    return targets.groupBy("grp").cogroup(every.groupBy("of")).applyInArrow(scan, "grp long, stop string, departure long, arrival long")


def fastest_minutes(profile: DataFrame, access: DataFrame, goals: DataFrame, leave: int) -> DataFrame:
    """(grp, origin, minutes): best over the access stops (origin, stop,
    walk_s) of the first useful departure; a goal stop is there at once."""
    a = access.withColumn("at", F.lit(leave) + F.col("walk_s"))
    ride = a.join(profile, "stop").where("departure >= at").select("grp", "origin", "arrival")
    walk = a.join(goals, "stop").select("grp", "origin", F.col("at").alias("arrival"))
    return ride.unionByName(walk).groupBy("grp", "origin").agg(((F.min("arrival") - leave) / 60).alias("minutes"))


def asof_forward(left: DataFrame, right: DataFrame, by: list[str], at: str, time: str, value: str) -> DataFrame:
    """The value of the first right row at or after each left row's time: one
    sorted pass over the union, no join of all pairs."""
    l_ = left.withColumns({"_t": F.col(at), "_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)}).select(*left.columns, "_t", "_side", "_v")
    r_ = right.select(*by, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in by], F.col(time).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    r_ = r_.select(*left.columns, "_t", "_side", "_v")
    w = Window.partitionBy(*by).orderBy(F.col("_t").desc(), F.col("_side"), F.col("_v").desc()).rowsBetween(Window.unboundedPreceding, 0)
    u = l_.unionByName(r_).withColumns({"next_time": F.last(F.when(F.col("_side") == 0, F.col("_t")), True).over(w), "next_value": F.last("_v", True).over(w)})
    return u.where("_side = 1").drop("_t", "_side", "_v")


def worst_of_best(df: DataFrame, keys: list[str], minutes: str) -> DataFrame:
    n = F.count(minutes)
    return df.groupBy(*keys).agg(F.max(minutes).alias("value"), F.when(n == 0, "unknown").when(n < F.count("*"), "partial").otherwise("known").alias("state"), (n / F.count("*")).alias("coverage"))


def minute_samples(origins: DataFrame, itineraries: DataFrame, first: int, n: int, wait: int) -> DataFrame:
    """For each origin and minute the best itinerary that starts within
    ``wait`` minutes, by (end, boardings, first walk, walk); the duration
    counts from the minute.  Minutes without one stay, without a duration.

    A range join: each itinerary is dealt to the minutes it serves.
    """
    lo = F.greatest(F.lit(first), F.ceil(F.col("start_min")).cast("int") - wait)
    hi = F.least(F.lit(first + n - 1), F.floor(F.col("start_min")).cast("int"))
    hits = itineraries.where(lo <= hi).withColumn("minute", F.explode(F.sequence(lo, hi)))
    best = hits.groupBy("origin", "minute").agg(F.min(F.struct("end_min", "boardings", F.coalesce("first_walk", F.lit(float("inf"))).alias("first"), "walk")).alias("b"))
    every = origins.select("origin", F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))).alias("minute"))
    return every.join(best, ["origin", "minute"], "left").select("origin", "minute", (F.col("b.end_min") - F.col("minute")).alias("duration"), F.col("b.boardings").alias("boardings"))


def leading_walk(legs: Column) -> Column:
    """Metres of the legs before the first that isn't on foot; null without one."""
    first = F.array_position(F.transform(legs, lambda x: (x["mode"] != "WALK").cast("int")), 1)
    before = F.slice(legs, F.lit(1), F.greatest(first - 1, F.lit(0)).cast("int"))
    return F.when(first > 0, F.aggregate(before, F.lit(0.0), lambda a, x: a + x["distance"]))
