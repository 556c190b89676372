import struct

import numpy as np
import pandas as pd
import pytest

from spanlight.sources import files, las


def test_options_of_an_ini_file():
    o = files.Options.read("[Options]\ncell = 2.5\nkeep_noise = no\nkinds=ground\nother=1\n[Else]\ncell=9")
    assert (o.cell, o.keep_noise, o.kinds, o.low_height) == (2.5, False, "ground", 20.0) and files.Options.read("") == files.Options()


def test_first_target_of_a_class_and_empty_clusters(spark, tmp_path):
    (tmp_path / "m.xml").write_text('<Map><Item Type="1" To="5"/><Item Type="1" To="3"/><Item Type="2" To="7"/></Map>')
    assert {tuple(r) for r in files.class_map(spark, str(tmp_path / "m.xml")).collect()} == {(1, 3), (2, 7)}
    (tmp_path / "c.xml").write_text('<C><Cluster Id="4" ClassifyType="1">0_1; 0_2;</Cluster><Cluster Id="5" ClassifyType="2"/></C>'.replace("; ", ";"))
    assert {tuple(r) for r in files.cluster_catalogue(spark, str(tmp_path / "c.xml")).collect()} == {(4, 1, "0_1"), (4, 1, "0_2")}


def test_roads(spark, tmp_path):
    (tmp_path / "r.txt").write_text("1\tLINESTRING (0 0, 2 1,4 -1)\n2\tPOINT (1 1)\n3\tLINESTRING (5 5)\n")
    roads = {r["id"]: r for r in files.read_roads(spark, str(tmp_path / "r.txt")).collect()}
    assert (roads[1]["x1"], roads[1]["y1"], roads[1]["x2"], roads[1]["y2"]) == (0, -1, 4, 1) and not roads[2]["vertices"]
    assert [tuple(r) for r in files.road_segments(files.read_roads(spark, str(tmp_path / "r.txt"))).collect()] == [(1, 0, 0, 2, 1), (1, 2, 1, 4, -1)]


def test_newer_record_formats_and_unknown_ones():
    old = las.encode(np.array([1.0, 2.0]), np.array([3.0, 4.0]), np.array([5.0, 6.0]), np.array([7, 8]), np.zeros((2, 3), int))
    head = bytearray(375)
    head[:227] = old[:227]
    struct.pack_into("<HI", head, 94, 375, 375)
    head[104] = 7
    struct.pack_into("<HI", head, 105, 36, 0)
    struct.pack_into("<Q", head, 247, 2)
    records = bytearray(72)
    for i, (x, label) in enumerate(((0, 7), (10_000, 8))):
        struct.pack_into("<3i", records, 36 * i, x, 0, 0)
        records[36 * i + 16], records[36 * i + 31] = label, 9
    (block,) = las.decode(bytes(head + records))
    assert list(block["label"]) == [7, 8] and list(block["x"]) == [1.0, 2.0] and list(block["r"]) == [9, 9]
    head[104] = 9
    with pytest.raises(ValueError):
        las.header_of(bytes(head))


def test_a_task_that_runs_again_leaves_its_points_once(spark, tmp_path):
    points = spark.createDataFrame([(float(i), 0.0, 0.0, 1, 0, 0, 0) for i in range(10)], "x double, y double, z double, label int, r int, g int, b int")
    las.write_las(points, str(tmp_path))
    las.write_las(points, str(tmp_path))
    assert las.read_las(spark, str(tmp_path)).count() == 10 and las.headers(spark, str(tmp_path)).selectExpr("sum(n)").first()[0] == 10


def test_records_by_ranges_boxes_and_numbers(spark, tmp_path):
    for part, x in (("a", 0.0), ("b", 1000.0)):
        n = 2500
        data = bytearray(las.encode(np.arange(n) * 0.1 + x, np.arange(n) * 0.01, np.zeros(n), np.arange(n) % 20, np.zeros((n, 3), int), epsg=32650))
        if part == "a":
            data[struct.unpack_from("<I", data, 96)[0] + 15] |= 0xA0  # flags beside the class of the first record
        (tmp_path / f"{part}.las").write_bytes(data)
    path = str(tmp_path)
    everything = las.read_las(spark, path, size=400)
    assert everything.rdd.getNumPartitions() == 14 and everything.count() == 5000
    assert sorted(map(tuple, everything.collect())) == sorted(map(tuple, las.read_las(spark, path, whole=True).collect()))
    assert everything.where("point_id = 0").agg({"label": "max"}).first()[0] == 0 and everything.agg({"label": "max"}).first()[0] == 19
    box = (10.0, 0.0, 20.05, 9.0)
    assert las.ranges(spark, path, box).selectExpr("count(*)", "sum(bytes)").first() == (1, 2500 * 26)  # the other file isn't opened again
    assert [round(r["x"], 1) for r in las.read_las(spark, path, box).orderBy("x").collect()] == [round(10 + 0.1 * i, 1) for i in range(101)]
    assert las.read_las(spark, path, records=(2490, 9999)).count() == 20 and las.read_las(spark, path, records=(9, 9)).count() == 0
    assert {tuple(r) for r in las.headers(spark, path).select("n", "format", "epsg", "x1").collect()} == {(2500, 2, 32650, 0.0), (2500, 2, 32650, 1000.0)}


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    n = 100_000_000
    head = bytearray(las.encode(np.array([1.0]), np.array([2.0]), np.array([3.0]), np.array([4]), np.zeros((1, 3), int)))
    struct.pack_into("<I", head, 107, n)
    offset = struct.unpack_from("<I", head, 96)[0]
    record = bytes(head[offset:])
    with open(tmp_path / "large.las", "wb") as f:
        f.write(head)
        f.truncate(offset + 26 * n)  # holes, not bytes on disk
        f.seek(offset + 26 * (n - 1))
        f.write(record)
    path = str(tmp_path)
    plan = las.ranges(spark, path)
    assert plan.selectExpr("count(*)", "sum(count)", "max(bytes)").first() == (50, n, 2_000_000 * 26) and las.headers(spark, path).first()["n"] == n
    tail = las.read_las(spark, path, records=(n - 3, n)).orderBy("point_id").collect()
    assert [r["point_id"] for r in tail] == [n - 3, n - 2, n - 1] and (tail[-1]["x"], tail[-1]["label"]) == (1.0, 4)
    with open(tmp_path / "large.las", "r+b") as f:
        f.truncate(offset + 26)
    with pytest.raises(Exception, match="too few"):
        las.headers(spark, path).collect()


def scanned(df):
    """Files and rows that the scan of an executed query gave out."""
    stack, found = [df._jdf.queryExecution().executedPlan()], []
    while stack:
        node = stack.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            stack.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan"):
            found.append(tuple(node.metrics().apply(k).value() for k in ("numFiles", "numOutputRows")))
        stack += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_a_polygon_reads_few_files_and_row_groups(spark, tmp_path):
    from pyspark.sql import functions as F

    from spanlight.functions import geometry as g
    from spanlight.sources import layout

    n = 400_000
    r = np.random.default_rng(3)
    points = spark.createDataFrame(pd.DataFrame({"x": r.uniform(5e5, 5e5 + 1000, n), "y": r.uniform(4e6, 4e6 + 1000, n), "z": r.normal(size=n)}))
    points = points.unionByName(spark.createDataFrame([(5e5 + 3, 4e6 + 3, 0.0)] * 1000 + [(None, 4e6, 1.0)], "x double, y double, z double"))
    path = str(tmp_path / "stored")
    layout.write_layout(points, path, file_points=8_000, group_bytes=1 << 14)
    assert layout.read_layout(spark, path).count() == n + 1001 and layout.catalogue(spark, path).agg(F.sum("n")).first()[0] == n + 1001
    ring = [(5e5 + 400, 4e6 + 400), (5e5 + 500, 4e6 + 410), (5e5 + 490, 4e6 + 510), (5e5 + 410, 4e6 + 500)]  # about 1 % of the area
    found = layout.read_layout(spark, path, ring)
    rows = found.collect()
    want = points.where(g.in_polygon(F.col("x"), F.col("y"), ring))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want.collect())) and len(rows) > 3000
    ((files, out),) = scanned(found)
    assert files <= 5 and out < 0.05 * n
    assert layout.read_layout(spark, path, box=(5e5, 4e6, 5e5 + 5, 4e6 + 5)).where("z = 0").count() == 1000
    assert layout.read_layout(spark, path, [(0, 0), (1, 0), (0, 1)]).count() == 0
    layout.write_layout(points.limit(0), str(tmp_path / "none"))
    assert layout.read_layout(spark, str(tmp_path / "none"), ring).count() == 0
