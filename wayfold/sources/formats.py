"""Readers and writers of the recording tool chain's files, as DataFrames.

Unless said otherwise a reader passes over blank lines, gives an empty DataFrame for an empty file, and
fails on a broken line rather than dropping it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Names that loggers give to time and axis columns, in order of preference, and units of time.
TIME_COLUMNS = ["time", "timestamp", "time_ns", "t_ns", "host_timestamp", "seconds_elapsed", "elapsed", "time_s", "t"]
AXIS_GROUPS = [("x", "y", "z"), ("gyrox", "gyroy", "gyroz"), ("gyroscopex", "gyroscopey", "gyroscopez"), ("wx", "wy", "wz"), ("rotationratex", "rotationratey", "rotationratez"), ("gyro_x", "gyro_y", "gyro_z")]
UNITS = [("s", 1e9), ("ms", 1e6), ("us", 1e3), ("ns", 1.0)]
LEAST_RATE, MOST_RATE, LEAST_USUAL, MOST_USUAL = 1.0, 2000.0, 20.0, 1000.0


# JSON lines
def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Typed JSON lines.  A line that isn't JSON of the schema, or has a field that the schema lacks, is an error."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).filter(F.trim("value") != "")
    row = F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    keys = F.json_object_keys("value")
    strange = F.array_except(keys, F.array(*[F.lit(f.name) for f in kind.fields]))
    fault = F.when(keys.isNull() | row.isNull(), F.concat(F.lit("not a record: "), "value")).when(F.size(strange) > 0, F.concat(F.lit("unknown field "), strange[0], F.lit(": "), "value"))
    checked = F.when(fault.isNull(), row).otherwise(F.raise_error(fault).cast(kind))
    return lines.select(checked.alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


# Metrics: an append-only log
def append_metric(spark: SparkSession, path: str, task: str, metric: str, value: float, split: str | None = None, run_dir: str = "", notes: str = "", commit: str = "") -> None:
    """One row of the metric log, with the time in UTC."""
    row = [(task, metric, float(value), split, run_dir, notes, commit)]
    df = spark.createDataFrame(row, "task string, metric string, value double, split string, run_dir string, notes string, git string")
    append_jsonl(df.withColumn("ts", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")), path)


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metric log; empty if there is none.  Rows need a task, metric, value and time."""
    schema = "task string, metric string, value double, split string, run_dir string, notes string, git string, ts string"
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        return spark.createDataFrame([], schema)
    df = read_jsonl(spark, path, schema)
    lacking = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("task", "metric", "value", "ts")]))
    return df.withColumn("metric", F.when(F.size(lacking) > 0, F.raise_error(F.concat(F.lit("metric row lacks "), lacking[0])).cast("string")).otherwise(F.col("metric")))


# Files
def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of the files under a path (each below 2 GB, as Spark's binary reader asks)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


# Frame probes
def probe_frames(df: DataFrame, payload: str) -> DataFrame:
    """``frame, t_ns`` of each probe document: the best estimate of the time, else the container's; frames
    without a usable one are passed over.  Rounded half to even to whole ns."""
    kind = "struct<frames: array<struct<best_effort_timestamp_time: string, pts_time: string>>>"
    seen = df.select(*[c for c in df.columns if c != payload], F.posexplode(F.from_json(payload, kind)["frames"]).alias("frame", "f"))
    best = F.when(F.col("f.best_effort_timestamp_time").isNotNull(), F.col("f.best_effort_timestamp_time")).otherwise(F.col("f.pts_time"))
    return seen.withColumn("t_ns", F.bround(best.try_cast("double") * 1e9).cast("bigint")).drop("f").filter("t_ns IS NOT NULL")


# Inertial logs
def header_name(name: str) -> str:
    """A column name without case and anything but letters, digits and underscores."""
    return "".join(c for c in name.lower() if c.isascii() and (c.isalnum() or c == "_"))


def time_unit(df: DataFrame, t: str) -> DataFrame:
    """``unit, to_ns``: the unit under which the rate of samples is plausible, a usual rate first, then the larger
    unit's smaller factor; no row if none is, or time doesn't advance."""
    a = df.agg(F.count(t).alias("n"), (F.max(t) - F.min(t)).alias("span"))
    units = F.array(*[F.struct(F.lit(u).alias("unit"), F.lit(f).alias("to_ns")) for u, f in UNITS])
    rated = a.select("n", "span", F.inline(units)).withColumn("rate", F.try_divide((F.col("n") - 1).cast("double"), F.col("span") * F.col("to_ns") / 1e9)).filter(F.col("rate").between(LEAST_RATE, MOST_RATE))
    unusual = ~F.col("rate").between(LEAST_USUAL, MOST_USUAL)
    return rated.agg(F.min(F.struct(unusual.alias("a"), "to_ns", "unit")).alias("m")).filter("m IS NOT NULL").select("m.unit", "m.to_ns")


def read_imu(spark: SparkSession, path: str, sensor: str = "gyro") -> DataFrame:
    """``t_ns, x, y, z`` of a CSV log, sorted by time: wide (time and three axes) or long (with a column that
    names the sensor).  Rows with a value that is no number are passed over; an unreadable header is an error."""
    raw = spark.read.option("header", "true").csv(path)
    names = {header_name(c): c for c in raw.columns}
    t = next((names[c] for c in TIME_COLUMNS if c in names), None)
    axes = next((g for g in AXIS_GROUPS if all(c in names for c in g)), None)
    if t is None or axes is None:
        raise ValueError(f"no time or axis columns among {raw.columns}")
    kind = next((names[c] for c in ("sensor", "name", "type") if c in names), None)
    if kind is not None:
        raw = raw.filter(F.lower(F.col(f"`{kind}`")).contains(sensor))
    values = raw.select(F.col(f"`{t}`").try_cast("double").alias("t"), *[F.col(f"`{names[a]}`").try_cast("double").alias(n) for a, n in zip(axes, "xyz")]).dropna()
    unit = time_unit(values, "t").first()
    if unit is None:
        raise ValueError("no unit of time gives a plausible rate")
    return values.select((F.col("t") * unit["to_ns"]).cast("bigint").alias("t_ns"), "x", "y", "z").orderBy("t_ns")


# Points
def read_gold_points(spark: SparkSession, path: str) -> DataFrame:
    """``x, y, z, label`` of ASCII lines: three coordinates first, a whole-numbered label last; ``#`` comments."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> '' AND NOT startswith(line, '#')")
    parts = lines.select("line", F.split("line", r"\s+").alias("p"))
    label = F.element_at("p", -1).try_cast("double")
    fault = (F.size("p") < 4) | label.isNull() | (label != F.floor(label))
    good = F.when(F.coalesce(fault, F.lit(True)), F.raise_error(F.concat(F.lit("not a labelled point: "), "line")).cast("int")).otherwise(label.cast("int"))
    return parts.select(*[F.get("p", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")], good.alias("label"))


def ply_vertex_counts(spark: SparkSession, path: str) -> DataFrame:
    """``path, n_vertices`` from the headers of PLY files; null if there is none."""
    head = F.decode(F.substring("content", 1, 8192), "ISO-8859-1")
    return spark.read.format("binaryFile").load(path).select("path", F.regexp_extract(head, r"element vertex (\d+)", 1).try_cast("bigint").alias("n_vertices"))


# Structure-from-motion models as text
def read_sfm_cameras(spark: SparkSession, path: str) -> DataFrame:
    """``camera_id, model, width, height, params``."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter("trim(value) <> '' AND NOT startswith(ltrim(value), '#')").select(p.alias("p"))
    return rows.select(F.expr("cast(p[0] AS int)").alias("camera_id"), F.expr("p[1]").alias("model"), F.expr("cast(p[2] AS int)").alias("width"), F.expr("cast(p[3] AS int)").alias("height"), F.expr("cast(slice(p, 5, size(p)) AS array<double>)").alias("params"))


def read_sfm_points(spark: SparkSession, path: str) -> DataFrame:
    """``point3D_id, xyz, rgb, error, track``: the track pairs image and observation."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter("trim(value) <> '' AND NOT startswith(ltrim(value), '#')").select(p.alias("p"))
    track = F.expr("transform(sequence(0, (size(p) - 8) div 2 - 1), i -> struct(cast(get(p, 8 + 2 * i) AS int) AS image_id, cast(get(p, 9 + 2 * i) AS int) AS idx))")
    return rows.select(
        F.expr("cast(p[0] AS bigint)").alias("point3D_id"), F.expr("cast(slice(p, 2, 3) AS array<double>)").alias("xyz"), F.expr("cast(slice(p, 5, 3) AS array<int>)").alias("rgb"),
        F.expr("cast(p[7] AS double)").alias("error"), F.when(F.expr("size(p) >= 10"), track).alias("track"),
    )


def read_sfm_images(spark: SparkSession, path: str) -> DataFrame:
    """``image_id, qvec, tvec, camera_id, name, observations``: an image is two lines, the second (which may be
    blank) with its observations.  A file is read whole, as one row: pairs of lines can't be split."""
    text = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n"), lambda x: ~F.startswith(F.ltrim(x), F.lit("#")))
    pairs = text.select(lines.alias("l")).select(F.explode(F.expr("transform(sequence(0, greatest(size(l) - 1, 0), 2), i -> struct(get(l, i) AS a, coalesce(get(l, i + 1), '') AS b))")).alias("x")).filter("trim(coalesce(x.a, '')) <> ''")
    rows = pairs.select(F.split(F.trim("x.a"), r"\s+").alias("p"), F.filter(F.split(F.trim("x.b"), r"\s+"), lambda y: y != "").alias("o"))
    seen = F.expr("transform(sequence(0, size(o) div 3 - 1), i -> struct(cast(get(o, 3 * i) AS double) AS x, cast(get(o, 3 * i + 1) AS double) AS y, cast(get(o, 3 * i + 2) AS bigint) AS point3D_id))")
    return rows.select(
        F.expr("cast(p[0] AS int)").alias("image_id"), F.expr("cast(slice(p, 2, 4) AS array<double>)").alias("qvec"), F.expr("cast(slice(p, 6, 3) AS array<double>)").alias("tvec"),
        F.expr("cast(p[8] AS int)").alias("camera_id"), F.expr("p[9]").alias("name"), F.when(F.size("o") >= 3, seen).otherwise(F.array()).alias("observations"),
    )


def reprojection_error(points: DataFrame) -> DataFrame:
    """``error_px, n``: mean error of SfM points weighted by the length of their tracks, at least 1."""
    w = F.greatest(F.coalesce(F.size("track"), F.lit(0)), F.lit(1))
    return points.agg(F.try_divide(F.sum(F.col("error") * w), F.sum(w)).alias("error_px"), F.count("*").alias("n"))


def write_sfm_model(cameras: DataFrame, images: DataFrame, points: DataFrame, folder: str) -> None:
    """The three text tables of a model (``cameras``, ``images``, ``points3D``), each a folder of part files.

    An image is one row of two lines, so no part file splits it.  Observations and tracks may be empty.
    """
    def line(*parts: Column) -> Column:
        return F.concat_ws(" ", *[F.concat_ws(" ", F.transform(p, lambda x: x.cast("string"))) if kind == "array" else p.cast("string") for p, kind in parts])

    plain = lambda c: (F.col(c), "value")
    listed = lambda c: (F.col(c), "array")
    cameras.select(line(plain("camera_id"), plain("model"), plain("width"), plain("height"), listed("params")).alias("value")).write.text(f"{folder}/cameras.txt")
    seen = F.concat_ws(" ", F.transform("observations", lambda o: F.concat_ws(" ", o["x"].cast("string"), o["y"].cast("string"), o["point3D_id"].cast("string"))))
    images.select(F.concat(line(plain("image_id"), listed("qvec"), listed("tvec"), plain("camera_id"), plain("name")), F.lit("\n"), seen).alias("value")).write.text(f"{folder}/images.txt")
    track = F.concat_ws(" ", F.transform("track", lambda t: F.concat_ws(" ", t["image_id"].cast("string"), t["idx"].cast("string"))))
    points.select(F.concat_ws(" ", line(plain("point3D_id"), listed("xyz"), listed("rgb"), plain("error")), F.when(track != "", track)).alias("value")).write.text(f"{folder}/points3D.txt")


def read_sfm_model(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cameras, images and points of a model written as text."""
    return read_sfm_cameras(spark, f"{folder}/cameras.txt"), read_sfm_images(spark, f"{folder}/images.txt"), read_sfm_points(spark, f"{folder}/points3D.txt")


# Parameters of camera models, in order.
CAMERA_MODELS = {"SIMPLE_PINHOLE": ["f", "cx", "cy"], "PINHOLE": ["fx", "fy", "cx", "cy"], "SIMPLE_RADIAL": ["f", "cx", "cy", "k"], "RADIAL": ["f", "cx", "cy", "k1", "k2"], "OPENCV": ["fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2"]}


def camera_parameters(model: Column, params: Column) -> dict[str, Column]:
    """``fx, fy, cx, cy, k1, k2, p1, p2`` of a camera by its model; distortion that a model lacks is 0; all null for an
    unknown model or a wrong number of parameters."""
    out = {n: F.lit(None).cast("double") for n in ("fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2")}
    for name, given in CAMERA_MODELS.items():
        fits = (model == name) & (F.size(params) == len(given))
        for n in out:
            source = next((g for g in (n, "f" if n in ("fx", "fy") else n, "k" if n == "k1" else n) if g in given), None)
            out[n] = F.when(fits, F.get(params, F.lit(given.index(source))) if source else F.lit(0.0)).otherwise(out[n])
    return out


# Documents and frame indexes
def write_json(df: DataFrame, path: str) -> None:
    """One row as one JSON document with sorted keys (one part file); more rows are an error."""
    one = df.select(*sorted(df.columns)).agg(F.count("*").alias("n"), F.first(F.struct(*sorted(df.columns))).alias("r"))
    checked = F.when(F.col("n") == 1, F.to_json("r", {"pretty": "true", "ignoreNullFields": "false"})).otherwise(F.raise_error(F.lit("a document is one row")).cast("string"))
    one.select(checked.alias("value")).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON document over several lines, as one row; a broken one is an error."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def read_frames_index(spark: SparkSession, path: str) -> DataFrame:
    """``file, t_ns, frame_index`` of a frame index as JSON lines, in order of time; a frame without a time, or two at one
    time, is an error."""
    rows = read_jsonl(spark, path, "file string, t_ns bigint, frame_index bigint")
    n = F.expr("count(*) OVER (PARTITION BY t_ns)")
    fault = F.when(F.col("t_ns").isNull(), "frame without a time").when(n > 1, "two frames at one time")
    return rows.withColumn("t_ns", F.when(fault.isNull(), F.col("t_ns")).otherwise(F.raise_error(fault).cast("bigint"))).orderBy("t_ns")


def write_gold_points(points: DataFrame, path: str) -> None:
    """Lines ``x y z label``."""
    points.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("x", "y", "z")], F.col("label").cast("int").cast("string"))).write.mode("overwrite").text(path)


def pixels_of_raster(rows: DataFrame, raster: str, keep: list[str]) -> DataFrame:
    """``keep..., row, col, value``: pixels of rasters stored as ``width&height&channels&`` and float32 values, column by
    column (one raster a row; a null or short one is an error of that row, told by a null ``row``)."""
    head = F.split(F.decode(F.substring(raster, 1, 64), "ISO-8859-1"), "&")
    w, h = (F.get(head, F.lit(i)).try_cast("int") for i in (0, 1))
    start = sum((F.length(F.get(head, F.lit(i))) + 1 for i in (1, 2)), F.length(F.get(head, F.lit(0))) + 1)
    n = rows.select(*keep, w.alias("_w"), h.alias("_h"), F.hex(raster).alias("_hex"), start.alias("_start"))
    whole = F.length("_hex") >= 2 * (F.col("_start") + 4 * F.col("_w") * F.col("_h"))
    at = F.explode_outer(F.when(whole & (F.col("_w") > 0) & (F.col("_h") > 0), F.sequence(F.lit(0), F.col("_w") * F.col("_h") - 1)))
    each = n.select(*keep, "_w", "_h", "_hex", "_start", at.alias("_i"))
    byte = lambda k: F.conv(F.substring("_hex", 2 * (F.col("_start") + 4 * F.col("_i") + k) + 1, F.lit(2)), 16, 10).cast("bigint")
    bits = byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216
    return each.withColumn("_bits", bits).select(*keep, (F.floor(F.col("_i") / F.col("_w"))).cast("int").alias("row"), (F.col("_i") % F.col("_w")).cast("int").alias("col"), float32(F.col("_bits")).alias("value"))


def float32(bits: Column) -> Column:
    """The number of a float32's bits; infinite or not a number where all bits of its exponent are set."""
    sign = F.when(bits >= 2147483648, -1.0).otherwise(1.0)
    exponent, fraction = F.floor(bits / 8388608) % 256, bits % 8388608
    special = F.when(fraction == 0, sign * float("inf")).otherwise(F.lit(float("nan")))
    normal = sign * (1 + fraction / 8388608) * F.pow(F.lit(2.0), exponent - 127)
    return F.when(exponent == 255, special).when(exponent == 0, sign * fraction * F.lit(2.0**-149)).otherwise(normal)


# Manifests and registries
def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with ``rows`` in place of those of the same key, or added."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def moved_splits(table: DataFrame, rows: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that ``rows`` would move to another split than ``table`` has: must be empty before an upsert."""
    return rows.select(key, F.col(split).alias("_new")).join(table.select(key, F.col(split).alias("_old")), key).filter("_new <> _old").select(key, F.col("_old").alias("from"), F.col("_new").alias("to"))


# Classes of licences and what each allows.
PERMISSIVE = ["CC-BY-4.0", "CC0-1.0", "Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause"]
NONCOMMERCIAL = ["CC-BY-NC-4.0", "CC-BY-NC-SA-4.0"]
USES = {"permissive": ["rehearsal", "private_eval", "publish_results", "train", "publish_media"], "noncommercial": ["rehearsal", "private_eval", "publish_results"], "conflicting": ["rehearsal", "private_eval"], "unverified": [], "none": []}
UNDOCUMENTED_REMOVES = ["publish_media"]


def license_class(name: Column, status: Column) -> Column:
    """The class of a clear licence; otherwise its status is its class."""
    known = F.when(name.isin(*PERMISSIVE), "permissive").when(name.isin(*NONCOMMERCIAL), "noncommercial")
    return F.when(status == "clear", F.coalesce(known, F.lit("unverified"))).otherwise(status)


def required_use(kind: Column, provenance: Column, use: str, name: Column) -> Column:
    """``name`` where the use is allowed; an error that says so where it isn't.  An unknown use is an error at once."""
    if use not in USES["permissive"]:
        raise ValueError(f"unknown use {use!r}")
    return F.when(F.array_contains(allowed_uses(kind, provenance), use), name).otherwise(F.raise_error(F.concat(name, F.lit(f": {use} is not allowed"))).cast("string"))


def allowed_uses(kind: Column, provenance: Column) -> Column:
    table = F.create_map(*[x for k, v in USES.items() for x in (F.lit(k), F.array(*[F.lit(u) for u in v]).cast("array<string>"))])
    uses = F.coalesce(F.try_element_at(table, kind), F.array().cast("array<string>"))
    return F.when(provenance == "undocumented", F.array_except(uses, F.array(*[F.lit(u) for u in UNDOCUMENTED_REMOVES]))).otherwise(uses)
