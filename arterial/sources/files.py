"""Readers and writers: raw vectors, map tables, speed files and text exports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Element types of raw little-endian vectors, and the Spark type of each.
ELEMENTS = {"i8": "byte", "u8": "short", "i16": "short", "u16": "int", "i32": "int", "u32": "long", "i64": "long", "u64": "decimal(20,0)", "f32": "float", "f64": "double"}


def decode(raw: bytes, kind: str) -> np.ndarray:
    """The elements of a raw vector; a length that isn't a multiple of the element's is an error."""
    dtype = np.dtype(f"<{kind[0]}{int(kind[1:]) // 8}")
    if len(raw) % dtype.itemsize:
        raise ValueError(f"{len(raw)} bytes are no whole number of {kind}")
    return np.frombuffer(raw, dtype)


def encode(values, kind: str) -> bytes:
    return np.asarray(values).astype(f"<{kind[0]}{int(kind[1:]) // 8}").tobytes()


def read_vector(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``i, value`` of each vector file under ``path`` (with ``file``). A file is decoded in one task, in slices."""
    wide = "decimal" in ELEMENTS[kind]

    def work(frames):
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                v = decode(raw, kind)
                for at in range(0, len(v), 1 << 20):
                    part = v[at : at + (1 << 20)]
                    value = [int(x) for x in part] if wide else part
                    yield pd.DataFrame({"file": name, "i": np.arange(at, at + len(part)), "value": value})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(work, f"file string, i long, value {ELEMENTS[kind]}")


LINK = T.StructType([T.StructField(c, T.LongType()) for c in ("link_id", "ref_node", "nonref_node")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tab-separated rows without header or quotes."""
    return spark.read.schema(schema).csv(path, sep="\t", quote="")


def read_text_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Text graphs ``tail head k (dep tt)*k`` in seconds below a header of four numbers, as arcs with functions in milliseconds."""
    words = F.split(F.trim("value"), " +")
    rows = spark.read.text(path).select(words.alias("w")).where("size(w) > 4 OR (size(w) = 3 AND w[2] = '0')")
    dep = F.expr("transform(sequence(0, CAST(w[2] AS INT) - 1), i -> named_struct('dep', CAST(w[3 + 2 * i] AS BIGINT) * 1000, 'tt', CAST(w[4 + 2 * i] AS BIGINT) * 1000))")
    return rows.where("CAST(w[2] AS INT) > 0").select(F.expr("CAST(w[0] AS BIGINT)").alias("tail"), F.expr("CAST(w[1] AS BIGINT)").alias("head"), dep.alias("ttf"))


def dimacs_arcs(arcs: DataFrame) -> DataFrame:
    """``a tail head weight`` lines with ids from 1."""
    return arcs.select(F.concat_ws(" ", F.lit("a"), F.col("tail") + 1, F.col("head") + 1, "weight").alias("value"))


def dimacs_nodes(nodes: DataFrame) -> DataFrame:
    """``v node longitude latitude`` lines with ids from 1, millionths of a degree cut off."""
    micro = lambda c: F.expr(f"CAST({c} * 1000000 AS BIGINT)")
    return nodes.select(F.concat_ws(" ", F.lit("v"), F.col("node") + 1, micro("lng"), micro("lat")).alias("value"))


def live_times(speeds: DataFrame, arcs: DataFrame) -> DataFrame:
    """``arc_id, live_tt`` from ``speeds(tail, head, speed, seq)`` and arcs with ``dist``: 3600 * dist / speed, the last row and the first arc."""
    last = speeds.groupBy("tail", "head").agg(F.max(F.struct("seq", "speed")).alias("s")).select("tail", "head", "s.speed")
    first = arcs.groupBy("tail", "head").agg(F.min(F.struct("arc_id", "dist")).alias("m")).select("tail", "head", "m.arc_id", "m.dist")
    return first.join(last, ["tail", "head"]).where("speed > 0").selectExpr("arc_id", "3600 * dist div speed AS live_tt")


def live_array(speeds: DataFrame, arcs: DataFrame, duration: int = 3_600_000) -> DataFrame:
    """``arc_id, weight, duration`` for the arcs with a live speed only; each holds for an hour."""
    return live_times(speeds, arcs).select("arc_id", F.col("live_tt").alias("weight"), F.lit(duration).cast("long").alias("duration"))


def link_rows(arcs: DataFrame) -> DataFrame:
    """``tail, head, length, link_id, direction`` of the arcs of :func:`road_graph`; direction 1 leads from the link's reference node."""
    return arcs.select("tail", "head", "length", "link_id", F.col("from_ref").cast("int").alias("direction"))


def day_buckets(points: DataFrame, minutes: int = 15, least: int = 3) -> DataFrame:
    """Mean ``value`` for each ``key`` and bucket of the day of ``ts_ms``; buckets of fewer than ``least`` rows go.

    Values of up to 14 decimals are summed up as decimals, so the order of the rows doesn't matter; a bucket with others has the mean of doubles.
    """
    bucket = F.expr(f"(ts_ms div {minutes * 60000}) % {24 * 60 // minutes}").alias("bucket")
    rows = points.select("key", bucket, "value", F.expr("try_cast(value AS DECIMAL(28, 14))").alias("exact"))
    plain = F.bool_and(F.col("exact").cast("double").eqNullSafe(F.col("value")))
    mean = F.when(plain, F.sum("exact").cast("double") / F.nullif(F.count("exact"), F.lit(0))).otherwise(F.avg("value"))
    return rows.groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("n"), mean.alias("mean")).where(F.col("n") >= least)


def live_triples(rows: DataFrame, t_live: int, period: int = 86_400_000) -> DataFrame:
    """``arc_id, live, until`` of ``rows(arc_id, weight, duration, seq)`` that last less than a period; the last one of an arc counts."""
    short = rows.where(F.col("duration") < period).groupBy("arc_id").agg(F.max(F.struct("seq", "weight", "duration")).alias("u"))
    return short.select("arc_id", F.col("u.weight").alias("live"), (F.col("u.duration") + t_live).alias("until"))


def live_counters(rows: DataFrame, infinity: int, period: int = 86_400_000) -> DataFrame:
    """One row: how many live rows there are, block, count, last too long, and block for too long."""
    blocked, long = F.col("weight") >= infinity, F.col("duration") >= period
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(blocked).alias("blocked"),
        F.count_if(~long).alias("applied"),
        F.count_if(long).alias("long_term"),
        F.count_if(blocked & long).alias("blocked_long_term"),
    )


def incidents(rows: DataFrame, arcs: DataFrame, infinity: int) -> DataFrame:
    """``arc_id, weight, duration`` (ms, at most 2^32 - 1) from ``rows(tail, head, speed, distance, duration_s)``; speed 0 blocks.

    Nodes without an arc between them are ignored; of parallel arcs the first is meant.
    """
    first = arcs.groupBy("tail", "head").agg(F.min("arc_id").alias("arc_id"))
    weight = F.when(F.col("speed") == 0, F.lit(infinity)).otherwise(F.expr("3600L * distance div nullif(speed, 0)"))
    out = rows.join(first, ["tail", "head"])
    return out.select("arc_id", weight.alias("weight"), F.least(F.expr("duration_s * 1000L"), F.lit((1 << 32) - 1)).alias("duration"))


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``from;to;speed;distance;duration`` by position, below a header."""
    schema = "tail long, head long, speed long, distance long, duration_s long"
    return spark.read.schema(schema).csv(path, sep=";", header=True, quote="", enforceSchema=True)


def smoothed_speeds(rows: DataFrame, v_max: str = "v_max") -> DataFrame:
    """``rows`` (with ``speeds``, 288 values of five minutes) with ``profile``, an array of (at, speed) that changes at each point.

    From 23:00 to 05:00 the greatest speed holds; none is below 5; each is the mean of seven in a circle,
    rounded down, and at most ``v_max``.
    """
    # arrays of one element bind what later steps name, so each step is computed once and not for each of its uses
    bound = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    calm = "transform(speeds, (x, i) -> greatest(5L, CAST(IF(i >= 276 OR i < 60, top_, x) AS BIGINT)))"
    mean = f"transform(calm_, (x, i) -> least(aggregate(sequence(-3, 3), 0L, (s, o) -> s + calm_[pmod(i + o, size(calm_))]) div 7, CAST({v_max} AS BIGINT)))"
    changes = "filter(transform(mean_, (x, i) -> IF(i > 0 AND mean_[greatest(i - 1, 0)] = x, NULL, named_struct('at', i * 300000L, 'speed', x))), p -> p IS NOT NULL)"
    profile = bound("array_max(speeds)", "top_", bound(calm, "calm_", bound(mean, "mean_", changes)))
    return rows.withColumn("profile", F.expr(profile))


def speed_functions(rows: DataFrame) -> DataFrame:
    """``arc_id, ttf`` from ``rows(arc_id, length, profile)``: travel times of a length (m) under speeds (km/h) that change."""
    from ..functions import plf

    def work(frames):
        for frame in frames:
            made = []
            for length, profile in zip(frame["length"].tolist(), frame["profile"], strict=True):
                dep, tt = plf.from_speeds(np.array([x["at"] for x in profile]), np.array([x["speed"] for x in profile]), length)
                made.append([{"dep": int(d), "tt": int(t)} for d, t in zip(dep, tt, strict=True)])
            yield pd.DataFrame({"arc_id": frame["arc_id"], "ttf": made})

    return rows.select("arc_id", "length", "profile").mapInPandas(work, "arc_id long, ttf array<struct<dep: long, tt: long>>")


def scrubbed_speeds(lines: DataFrame, skip: int = 0) -> DataFrame:
    """Comma-separated lines ``from,to,speed...`` (with ``seq``): ``from_id, to_id, speeds``; constant rows go, the last of a pair counts."""
    words = lines.select("seq", F.split("value", ",").alias("w"))
    rows = words.select("seq", F.col("w")[0].cast("long").alias("from_id"), F.col("w")[1].cast("long").alias("to_id"), F.expr(f"transform(slice(w, {3 + skip}, size(w)), x -> CAST(x AS BIGINT))").alias("speeds"))
    changing = rows.where("size(array_distinct(speeds)) > 1")
    return changing.groupBy("from_id", "to_id").agg(F.max_by("speeds", "seq").alias("speeds"))


def _hundredths(x: str) -> str:
    """``x`` / 100 as text without needless zeros."""
    rest = f"({x}) % 100"
    return f"concat(CAST(({x}) div 100 AS STRING), CASE WHEN {rest} = 0 THEN '' WHEN {rest} % 10 = 0 THEN concat('.', {rest} div 10) ELSE concat('.', lpad(CAST({rest} AS STRING), 2, '0')) END)"


def profile_lines(arcs: DataFrame) -> DataFrame:
    """``arc_id, value``: lines ``tail head k (dep tt)*k`` in tenths of seconds from functions in milliseconds."""
    points = f"transform(ttf, p -> concat({_hundredths('p.dep')}, ' ', {_hundredths('p.tt')}))"
    return arcs.selectExpr("arc_id", f"concat_ws(' ', tail, head, size(ttf), array_join({points}, ' ')) AS value")


def upscaled(lines: DataFrame, factor: int = 10) -> DataFrame:
    """Lines of a text graph with all numbers of the functions times ``factor``; the header's last number too."""
    number = f"CAST(x AS DECIMAL(30, 6)) * {factor}"
    # a whole number has no point; others end without zeros
    text = f"rtrim('.', rtrim('0', CAST({number} AS STRING)))"
    w = F.split(F.trim("value"), r"\s+")
    header = F.expr("size(w) = 4 AND pmod(size(w) - 3, 2) = 1")
    out = lines.withColumn("w", w)
    scaled = F.expr(f"concat_ws(' ', slice(w, 1, 3), transform(slice(w, 4, size(w)), x -> {text}))")
    return out.withColumn("value", F.when(header, F.expr("concat(value, '0')") if factor == 10 else scaled).otherwise(scaled)).drop("w")


def query_lines(trips: DataFrame) -> DataFrame:
    """``from departure to`` lines."""
    return trips.select(F.concat_ws(" ", "source", "departure", "target").alias("value"))


#: Metres; fixed value.
EARTH_RADIUS = 6378137.0


def geo_length(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    """Length in metres of the arc between two points (degrees) on a sphere."""
    half = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2)"
    return f"2 * {EARTH_RADIUS}D * asin(sqrt({half}))"


def road_graph(nodes: DataFrame, links: DataFrame, nav: DataFrame, box: tuple[int, int, int, int], speed: str) -> tuple[DataFrame, DataFrame]:
    """(arcs, nodes) of map tables inside ``box`` (least and greatest latitude, then longitude; in the units of the table).

    ``nodes(node_id, lat, lng)`` in 1/100000 degree, ``links(link_id, ref_node, nonref_node[, length])``,
    ``nav(link_id, direction, road_class)``; ``speed``: m/s, an expression over ``nav``. Links without nav
    row or with an end outside go. Nodes and arcs get dense ids in the order of the source's: arcs by tail,
    link and direction. Arcs carry ``link_id, from_ref, length, weight`` (ms).
    """
    from ..operators.graph import dense_ids

    inside = nodes.where(F.col("lat").between(*box[:2]) & F.col("lng").between(*box[2:]))
    a = inside.select(F.col("node_id").alias("ref_node"), (F.col("lat") / 100000).alias("lat1"), (F.col("lng") / 100000).alias("lng1"))
    b = inside.select(F.col("node_id").alias("nonref_node"), (F.col("lat") / 100000).alias("lat2"), (F.col("lng") / 100000).alias("lng2"))
    own = links.join(a, "ref_node").join(b, "nonref_node").join(nav, "link_id")
    direct = F.expr(geo_length("lat1", "lng1", "lat2", "lng2"))
    own = own.withColumn("length", F.coalesce("length", direct) if "length" in links.columns else direct)
    ways = F.explode(F.expr("CASE direction WHEN 'F' THEN array(true) WHEN 'T' THEN array(false) ELSE array(true, false) END")).alias("from_ref")
    arcs = own.select("link_id", "ref_node", "nonref_node", "length", "road_class", F.expr(speed).alias("mps"), ways)
    used = dense_ids(arcs.select(F.explode(F.array("ref_node", "nonref_node")).alias("key")), "key")
    tail, head = (F.when(F.col("from_ref") == flag, F.col("ref_node")).otherwise(F.col("nonref_node")) for flag in (True, False))
    arcs = arcs.withColumn("t", tail).withColumn("h", head)
    arcs = arcs.join(used.select(F.col("key").alias("t"), F.col("dense_id").alias("tail")), "t").join(used.select(F.col("key").alias("h"), F.col("dense_id").alias("head")), "h")
    # ids from the sorted keys: a struct orders by its fields
    arcs = arcs.withColumn("key", F.struct("tail", "link_id", F.expr("NOT from_ref").alias("back")))
    ids = dense_ids(arcs.select("key"), "key", lead="key.tail").withColumnRenamed("dense_id", "arc_id")
    out = arcs.join(ids, "key").selectExpr("arc_id", "tail", "head", "CAST(round(1000 * length / mps) AS BIGINT) AS weight", "length", "link_id", "from_ref", "road_class")
    kept = used.join(nodes, F.col("key") == F.col("node_id")).selectExpr("dense_id AS node", "node_id", "lat / 100000 AS lat", "lng / 100000 AS lng")
    return out, kept
