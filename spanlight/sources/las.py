"""LAS point files (record formats 0 to 3 and 6 to 8).

A file is read by ranges of records: headers are read first, by many tasks, and give the ranges; each range is then one row of a plan, and a
task reads just its bytes. So a file may have any size, files whose header's box misses the wanted one aren't opened again, and records can be asked for by number.
Files are opened through pyarrow's file systems; for a store that only Spark can open, ``whole`` takes them as binary columns (up to 2 GB each).
Every task writes files of format 2, scale 1e-4; the class goes to user data as well as to the classification field.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed values of the format: offsets of the class and of colour within a record, by record format.
RECORD = {0: (15, None), 1: (15, None), 2: (15, 20), 3: (15, 28), 6: (16, None), 7: (16, 30), 8: (16, 30)}
HEADER, SCALE = 227, 1e-4
GEO_KEYS, EPSG_KEY = 34735, 3072
SCHEMA = "file string, point_id long, x double, y double, z double, label int, user_data int, r int, g int, b int, epsg int"
BLOCK = 200_000
#: Records of a range.
RANGE = 2_000_000


def scan_date(year: Column, day_of_year: Column) -> Column:
    return F.date_add(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), (day_of_year - 1).cast("int"))


def header_of(data: bytes) -> dict:
    """Numbers of a file's header and its EPSG code, if a geo-key names one."""
    if data[:4] != b"LASF":
        raise ValueError("no LAS file")
    day, year, size, offset, n_vlr, fmt, length, count = struct.unpack_from("<HHHIIBHI", data, 90)
    numbers = struct.unpack_from("<12d", data, 131)
    if fmt & 63 not in RECORD:
        raise ValueError(f"point records of format {fmt & 63} aren't supported")
    if fmt & 63 > 5:
        count = struct.unpack_from("<Q", data, 247)[0]
    at, epsg = size, None
    for _ in range(n_vlr):
        record_id, n = struct.unpack_from("<HH", data, at + 18)
        if record_id == GEO_KEYS:
            keys = np.frombuffer(data, "<u2", n // 2, at + 54).reshape(-1, 4)
            for key, where, _, value in keys[1:].tolist():
                if key == EPSG_KEY and where == 0:
                    epsg = value
        at += 54 + n
    return {"day": day, "year": year, "offset": offset, "format": fmt & 63, "length": length, "count": count, "scale": numbers[:3], "shift": numbers[3:6], "box": numbers[6:], "epsg": epsg, "software": data[58:90].split(b"\0")[0].decode("ascii", "replace")}


def record_arrays(raw: np.ndarray, h: dict, first: int) -> dict:
    """Columns of records (a row of bytes each), the first of which has number ``first``. The class of formats 0 to 3 shares its byte with three flags."""
    label, colour = RECORD[h["format"]]
    xyz = raw[:, :12].copy().view("<i4") * np.array(h["scale"]) + np.array(h["shift"])
    classes = raw[:, label] & 31 if h["format"] < 6 else raw[:, label]
    out = {"point_id": np.arange(first, first + len(raw)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "label": classes.astype(np.int32), "user_data": raw[:, 17].astype(np.int32)}
    rgb = raw[:, colour : colour + 6].copy().view("<u2").astype(np.int32) if colour else np.zeros((len(raw), 3), np.int32)
    rgb = np.where(rgb > 255, rgb // 256, rgb)
    return out | {"r": rgb[:, 0], "g": rgb[:, 1], "b": rgb[:, 2], "epsg": h["epsg"]}


def decode(data: bytes):
    """Blocks of points of one file, as dicts of arrays."""
    h = header_of(data)
    raw = np.frombuffer(data, np.uint8, h["count"] * h["length"], h["offset"]).reshape(-1, h["length"])
    for at in range(0, len(raw), BLOCK):
        yield record_arrays(raw[at : at + BLOCK], h, at)


def point_batch(file: str, block: dict) -> pa.RecordBatch:
    n = len(block["x"])
    columns = [pa.array([file] * n), *[pa.array(block[k]) for k in ("point_id", "x", "y", "z", "label", "user_data", "r", "g", "b")], pa.array([block["epsg"]] * n, pa.int32())]
    return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, TYPES)], names=NAMES)


def opened(path: str):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri("file://" + path.removeprefix("file:").replace("//", "/") if path.startswith(("file:", "/")) else path)
    return store.open_input_file(name)


def read_header(path: str) -> dict:
    """The header of a file, from the bytes before its records alone."""
    with opened(path) as f:
        data = f.read(1 << 16)
        if len(data) > 227 and (offset := struct.unpack_from("<I", data, 96)[0]) > len(data):
            data += f.read(offset - len(data))
        h = header_of(data)
        if (size := f.size()) < h["offset"] + h["count"] * h["length"]:
            raise ValueError(f"{path} has {size} bytes, too few for {h['count']} records")
    return h


def headers(spark: SparkSession, path: str) -> DataFrame:
    """file, n (points), first_byte, record_bytes, format, epsg, software, and the box x1 ... z2 of all .las files under a path; no records are read."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.las").load(path).select("path")

    def run(batches):
        for batch in batches:
            rows = []
            for file in batch.column("path").to_pylist():
                h = read_header(file)
                x2, x1, y2, y1, z2, z1 = h["box"]
                rows.append({"file": file, "n": h["count"], "first_byte": h["offset"], "record_bytes": h["length"], "format": h["format"], "epsg": h["epsg"], "software": h["software"], "x1": x1, "y1": y1, "z1": z1, "x2": x2, "y2": y2, "z2": z2})
            yield pa.RecordBatch.from_pylist(rows, schema=HEADER_ARROW)

    return names.mapInArrow(run, HEADER_SCHEMA)


HEADER_SCHEMA = "file string, n long, first_byte long, record_bytes int, format int, epsg int, software string, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double"
HEADER_ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]]) for c in HEADER_SCHEMA.split(", ")])


def ranges(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, records: tuple[int, int] | None = None, size: int = RANGE) -> DataFrame:
    """file, first, count, bytes: ranges of up to ``size`` records of the files whose box (x1, y1, x2, y2) meets the given one, of record numbers in
    [records[0], records[1]) of each file."""
    found = headers(spark, path).where("n > 0")
    if box is not None:
        found = found.where((F.col("x1") <= box[2] + SCALE) & (F.col("x2") >= box[0] - SCALE) & (F.col("y1") <= box[3] + SCALE) & (F.col("y2") >= box[1] - SCALE))
    low, high = (F.lit(records[0]), F.least(F.lit(records[1]), "n")) if records else (F.lit(0), F.col("n"))
    found = found.withColumns({"_low": low.cast("long"), "_high": high.cast("long")}).where("_low < _high")
    each = found.select("file", "record_bytes", "_high", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1, F.lit(size).cast("long"))).alias("first"))
    count = F.least(F.lit(size).cast("long"), F.col("_high") - F.col("first"))
    return each.select("file", "first", count.alias("count"), (count * F.col("record_bytes")).alias("bytes"))


def read_las(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, records: tuple[int, int] | None = None, size: int = RANGE, whole: bool = False) -> DataFrame:
    """Points of all .las files under a path, in a box of x and y, or of some record numbers, if given; point_id is the place in the file."""
    if whole:
        points = read_whole(spark, path)
        points = points if records is None else points.where(F.col("point_id").between(records[0], records[1] - 1))
    else:
        plan = ranges(spark, path, box, records, size).select("file", "first", "count")

        def run(batches):
            for batch in batches:
                for file, first, count in zip(*(c.to_pylist() for c in batch.columns)):
                    h = read_header(file)
                    with opened(file) as f:
                        f.seek(h["offset"] + first * h["length"])
                        for at in range(first, first + count, BLOCK):
                            data = f.read(min(BLOCK, first + count - at) * h["length"])
                            yield point_batch(file, record_arrays(np.frombuffer(data, np.uint8).reshape(-1, h["length"]), h, at))

        points = plan.repartition(max(1, min(plan.count(), 100_000))).mapInArrow(run, SCHEMA)
    return points if box is None else points.where(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """Points of all .las files, each read by one task as a binary column, from any store that Spark can open."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.las").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for block in decode(content):
                    yield point_batch(file, block)

    return files.mapInArrow(run, SCHEMA)


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [{"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32()}[c.split()[1]] for c in SCHEMA.split(", ")]


def encode(x, y, z, label, rgb, epsg: int | None = None, year: int = 2024, day: int = 1) -> bytes:
    """A file of format 2."""
    n = len(x)
    keys = b"" if epsg is None else struct.pack("<2s16sHH32s", b"\0\0", b"LASF_Projection", GEO_KEYS, 16, b"") + struct.pack("<8H", 1, 1, 0, 1, EPSG_KEY, 0, 1, epsg)
    xyz = np.stack([x, y, z], 1) if n else np.zeros((0, 3))
    low, high = (xyz.min(0), xyz.max(0)) if n else (np.zeros(3), np.zeros(3))
    shift = np.floor(low)
    out = np.zeros((n, 26), np.uint8)
    out[:, :12] = np.rint((xyz - shift) / SCALE).astype("<i4").view(np.uint8).reshape(n, 12)
    out[:, 14], out[:, 15], out[:, 17] = 9, label, label
    out[:, 20:26] = (np.asarray(rgb).reshape(n, 3).astype("<u2") * 256).view(np.uint8).reshape(n, 6)
    head = struct.pack("<4sHHIHH8sBB32s32sHHHIIBHI5I", b"LASF", 0, 0, 0, 0, 0, b"", 1, 2, b"", b"spanlight", day, year, HEADER, HEADER + len(keys), int(bool(keys)), 2, 26, n, n, 0, 0, 0, 0)
    head += struct.pack("<12d", SCALE, SCALE, SCALE, *shift, *[v for pair in zip(high, low) for v in pair])
    return head + keys + out.tobytes()


def write_las(df: DataFrame, path: str, epsg: int | None = None) -> None:
    """Writes x, y, z, label, r, g, b as .las files, one for each block of a partition, through pyarrow's file systems."""

    def run(batches):
        from itertools import chain

        held, n, block = [], 0, 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                n += batch.num_rows
            if held and (batch is None or n >= BLOCK):
                t = pa.Table.from_batches(held)
                a = {k: t.column(k).to_numpy() for k in ("x", "y", "z", "label", "r", "g", "b")}
                data = encode(a["x"], a["y"], a["z"], a["label"], np.stack([a["r"], a["g"], a["b"]], 1), epsg)
                yield saved(data, block, path, "las")
                held, n, block = [], 0, block + 1

    files = df.select("x", "y", "z", F.col("label").cast("int").alias("label"), "r", "g", "b").mapInArrow(run, "bytes long")
    files.write.format("noop").mode("overwrite").save()


def saved(data: bytes, block: int, path: str, kind: str) -> pa.RecordBatch:
    """Stores a file in the task that made it, so a task holds one at a time; a row with its size. Files are named by partition and block, so another attempt of a task
    takes the place of the first one; each appears whole, by renaming."""
    from pyarrow import fs
    from pyspark import TaskContext

    task = TaskContext.get()
    store, base = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
    store.create_dir(base, recursive=True)
    name = f"{base}/part-{task.partitionId():06d}-{block:06d}.{kind}"
    with store.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp") as out:
        out.write(data)
    store.move(f"{name}.{task.taskAttemptId()}.tmp", name)
    return pa.RecordBatch.from_arrays([pa.array([len(data)], pa.int64())], names=["bytes"])


def read_points(spark: SparkSession, path: str, voxel_size: float | None = None) -> DataFrame:
    """Points of all files, or the centroids of the voxels that hold any."""
    from ..operators.aggregates import voxel

    points = read_las(spark, path)
    if voxel_size is None:
        return points
    return points.groupBy(*voxel(voxel_size)).agg(*[F.avg(c).alias(c) for c in "xyz"]).select("x", "y", "z")
