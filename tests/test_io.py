"""Sources and sinks on real files, streaming jobs, document parsing."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from moundlake.functions import formats
from moundlake.operators import compare, report
from moundlake.plans.match import compare_surveys
from moundlake.sinks import exports
from moundlake.sinks.versions import VersionedTables
from moundlake.sources import documents, folders, messages, points
from moundlake.streaming import jobs
from tests.conftest import grid_frame


def write_las(path, xyz, cls, version=(1, 2), fmt=0):
    """A small uncompressed LAS file after the public header layout."""
    scale, shift = (0.001,) * 3, (500000.0, 5000000.0, 0.0)
    size, length = (375, 30) if version == (1, 4) else (227, 20)
    head = bytearray(size)
    head[:4] = b"LASF"
    head[24], head[25] = version
    struct.pack_into("<HIIBHI", head, 94, size, size, 0, fmt, length, 0 if version == (1, 4) else len(xyz))
    struct.pack_into("<3d", head, 131, *scale)
    struct.pack_into("<3d", head, 155, *shift)
    lo, hi = xyz.min(axis=0), xyz.max(axis=0)
    struct.pack_into("<6d", head, 179, hi[0], lo[0], hi[1], lo[1], hi[2], lo[2])
    if version == (1, 4):
        struct.pack_into("<Q", head, 247, len(xyz))
    with open(path, "wb") as f:
        f.write(head)
        for p, k in zip(xyz, cls, strict=True):
            rec = bytearray(length)
            struct.pack_into("<3i", rec, 0, *[round((v - o) / s) for v, o, s in zip(p, shift, scale, strict=True)])
            rec[15 if fmt < 6 else 16] = k
            f.write(rec)


@pytest.mark.parametrize("version,fmt", [((1, 2), 0), ((1, 4), 6)])
def test_las_source_reads_all_record_ranges(spark, tmp_path, version, fmt):
    rng = np.random.default_rng(1)
    xyz = np.round(rng.random((1000, 3)) * 100 + [500000, 5000000, 90], 3)
    cls = rng.integers(0, 4, 1000)
    for name in ("a.las", "b.las"):
        write_las(tmp_path / name, xyz, cls, version, fmt)
    df = points.read_las(spark, str(tmp_path / "*.las"), records_per_split=300, first_id=5)
    rows = df.where("survey_id = 6").orderBy("point_index").collect()
    assert np.allclose([[r["x"], r["y"], r["z"]] for r in rows], xyz, atol=1e-6)
    assert [r["classification"] for r in rows] == cls.tolist()
    assert points.metadata(df).count() == 2
    heads = points.las_headers(spark, str(tmp_path)).orderBy("path").collect()
    assert [(h["survey_id"], h["count"], h["format"], h["error"]) for h in heads] == [(1, 1000, fmt, None), (2, 1000, fmt, None)]


def test_las_files_written_and_read_back(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(s, float(x), float(y), float(z), int(c)) for s in (3, 4) for (x, y, z), c in zip(
        np.round(rng.random((500, 3)) * 50 + [600_000, 4_900_000, 80], 3), rng.integers(0, 3, 500), strict=True)]
    df = spark.createDataFrame(rows, "survey_id long, x double, y double, z double, classification int")
    done = points.write_las(df.where("survey_id = 3"), str(tmp_path / "out"), epsg=25832, records_per_file=200).collect()
    done += points.write_las(df.where("survey_id = 4"), str(tmp_path / "out"), records_per_file=10_000).collect()
    assert sum(r["points"] for r in done) == 1000 and len({r["path"] for r in done}) == len(done) >= 4
    folder = str(tmp_path / "out")
    back = points.read_las(spark, folder, records_per_split=70)
    key = ["x", "y", "z", "classification"]
    rounded = lambda d: sorted((round(r[0], 3), round(r[1], 3), round(r[2], 3), r[3]) for r in d.select(*key).collect())
    assert rounded(back) == rounded(df)
    crs = {r["survey_id"]: r["crs"] for r in points.header_crs(points.las_headers(spark, folder)).collect()}
    heads = points.las_headers(spark, folder).collect()
    assert {crs[h["survey_id"]] for h in heads if "00000003" in h["path"]} == {"EPSG:25832"} and all(crs[h["survey_id"]] is None for h in heads if "00000004" in h["path"])
    low = min(h["min_z"] for h in heads)
    assert low == pytest.approx(min(r[3] for r in rows), abs=1e-6)


def test_crs_records_and_broken_las_files(spark, tmp_path):
    write_las(tmp_path / "a.las", np.array([[500001.0, 5000002.0, 3.0]]), np.array([2]))
    plain = (tmp_path / "a.las").read_bytes()
    wkt = b'PROJCS["UTM 32N"]\0'
    record = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 2112, len(wkt), b"") + wkt
    head = bytearray(plain[:227])
    struct.pack_into("<II", head, 96, 227 + len(record), 1)
    (tmp_path / "b.las").write_bytes(bytes(head) + record + plain[227:])
    (tmp_path / "c.las").write_bytes(b"not a cloud")
    (tmp_path / "d.las").write_bytes(plain[:107] + bytes(4) + plain[111:227])
    head[104] |= 0x80
    (tmp_path / "e.las").write_bytes(bytes(head) + record + plain[227:])
    (tmp_path / "f.las").write_bytes(bytes(plain[:96]) + struct.pack("<II", 227, 9) + plain[104:227])
    heads = {h["path"][-5]: h for h in points.las_headers(spark, str(tmp_path)).collect()}
    assert heads["a"]["error"] is None and heads["a"]["wkt"] is None and heads["b"]["wkt"] == 'PROJCS["UTM 32N"]'
    assert heads["c"]["error"] == "not a readable LAS file" and heads["d"]["error"] == "point cloud is empty"
    assert "compressed" in heads["e"]["error"] and "cut off" in heads["f"]["error"]
    assert points.read_las(spark, str(tmp_path / "[abd].las")).count() == 2
    with pytest.raises(Exception, match="not a readable LAS file"):
        points.read_las(spark, str(tmp_path / "[ac].las")).count()


def test_parquet_points_push_their_bounds(spark, tmp_path):
    rows = [(1, float(i), float(i), 1.0) for i in range(100)]
    spark.createDataFrame(rows, "survey_id long, x double, y double, z double").write.parquet(str(tmp_path / "p"))
    df = points.within(points.read_points(spark, str(tmp_path / "p")), 10, 0, 20, 15)
    assert df.count() == 6 and df.select(F.max("classification")).first()[0] == 0
    assert "PushedFilters: [IsNotNull(x), IsNotNull(y), GreaterThanOrEqual(x,10.0)" in df._jdf.queryExecution().executedPlan().toString()


def test_empty_clouds_get_an_error_row(spark):
    surveys = spark.createDataFrame([(1,), (2,)], "survey_id long")
    pts = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 2)], "survey_id long, x double, y double, z double, classification int")
    got = {r["survey_id"]: r["error"] for r in points.require_points(points.metadata(pts), surveys).collect()}
    assert got[1] is None and got[2] == "point cloud is empty"


def heap_rows(spark):
    ring = [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]]
    rows = [
        (s, h, f"Cumulo {h}", ring, 10.0 * h, 4.0, 5.0, 2.0, 1.0, 100.0, 1.0, 1.0, 0.0, 0.0, 2.0, 2.0,
         "sabbia" if h == 1 else None, 0.5, False, h == 3, "2026-04-20")
        for s in (1, 2) for h in (1, 2, 3)
    ]
    return spark.createDataFrame(rows, "survey_id long, heap_id long, label string, rings array<array<array<double>>>, volume_m3 double, "
        "planimetric_area_m2 double, surface_area_m2 double, max_height_m double, mean_height_m double, base_elevation_m double, "
        "centroid_e double, centroid_n double, bbox_min_e double, bbox_min_n double, bbox_max_e double, bbox_max_n double, "
        "material_category string, material_confidence double, is_manually_confirmed boolean, is_excluded boolean, survey_date string")


def test_csv_file_has_mark_separator_and_headers(spark, tmp_path):
    exports.write_csv(heap_rows(spark), str(tmp_path / "csv"))
    files = [f.read_bytes() for f in (tmp_path / "csv" / "survey_id=1").glob("*.csv")]
    assert all(t.startswith(b"\xef\xbb\xbfID;Volume_m3;Area_planimetrica_m2") for t in files)
    lines = [line for t in files for line in t.splitlines()[1:]]
    assert len(lines) == 3 and all(line.count(b";") == 14 for line in lines)
    assert any(line.startswith(b"1;10.000;4.000;5.000;2.00;1.00;100.00;1.000000") for line in lines)


def test_geojson_lines_skip_excluded_heaps(spark, tmp_path):
    exports.write_geojson_lines(heap_rows(spark), str(tmp_path / "geo"))
    lines = [json.loads(t) for f in (tmp_path / "geo" / "survey_id=2").glob("*.txt") for t in f.read_text().splitlines()]
    assert sorted(f["properties"]["id"] for f in lines) == [1, 2]
    assert lines[0]["geometry"]["type"] == "Polygon" and len(lines[0]["geometry"]["coordinates"][0]) == 5


def test_replacing_one_survey_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "t")
    table = heap_rows(spark).select("survey_id", "heap_id", "volume_m3")
    exports.replace_surveys(table, path)
    exports.replace_surveys(table.where("survey_id = 1 and heap_id = 1").withColumn("volume_m3", F.lit(99.0)), path)
    got = spark.read.parquet(path)
    assert got.where("survey_id = 2").count() == 3
    assert [r["volume_m3"] for r in got.where("survey_id = 1").collect()] == [99.0]


def test_cell_table_prunes_surveys(spark, tmp_path):
    cells, _ = grid_frame(spark, [np.ones((4, 4)), np.ones((3, 3))])
    exports.write_cells(cells, str(tmp_path / "c"))
    one = spark.read.parquet(str(tmp_path / "c")).where("survey_id = 2")
    assert one.count() == 9
    assert "PartitionFilters: [isnotnull(survey_id" in one._jdf.queryExecution().executedPlan().toString()


def test_results_document_round_trip(spark, tmp_path):
    heaps = heap_rows(spark).select("survey_id", "heap_id", "volume_m3")
    summary = spark.createDataFrame([(1, 100.0, "manual"), (2, 101.0, "percentile"), (3, 1.0, "manual")], "survey_id long, base_elevation double, base_elevation_method string")
    docs = exports.results_documents(heaps, summary)
    for row in docs.collect():
        (tmp_path / f"{row['survey_id']}.json").write_text(json.dumps(json.loads(row["document"]), indent=2))
    back = documents.read_results(spark, str(tmp_path))
    assert back.count() == 3
    assert sorted(len(r["heap_metrics"]) for r in back.collect()) == [0, 3, 3]


def test_folder_listing_from_disk(spark, tmp_path):
    for rel in (folders.DSM_FALLBACK, folders.ORTHO, folders.CLOUD):
        f = tmp_path / "job1" / rel
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x" * 10)
    (tmp_path / "job2" / "map").mkdir(parents=True)
    (tmp_path / "job2" / "map" / "dsm.tif").write_bytes(b"x")
    got = {r["folder"]: r for r in folders.scan_folders(folders.list_files(spark, str(tmp_path))).collect()}
    assert got["job1"]["dsm_path"] == folders.DSM_FALLBACK and got["job1"]["error"] is None
    assert len(got["job1"]["warnings"]) == 2 and got["job1"]["survey_date"] is not None
    assert got["job2"]["error"] == "orthophoto not found"


def test_comparison_with_empty_sides(spark):
    ring = [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]]
    heaps = spark.createDataFrame([(1, 1, ring, 10.0, 4.0, 2.0), (2, 5, ring, 13.0, 4.0, 3.0)],
        "survey_id long, heap_id long, rings array<array<array<double>>>, volume_m3 double, planimetric_area_m2 double, max_height_m double")
    pairs = spark.createDataFrame([(1, 1, 2), (2, 1, 9), (3, 9, 2), (4, 8, 9)], "pair_id long, survey_a long, survey_b long")
    got = {r["pair_id"]: r for r in compare_surveys(heaps, pairs).summary.collect()}
    assert got[1]["grown"] == 1 and got[1]["total_delta_volume_percent"] == 30.0
    assert got[2]["removed"] == 1 and got[2]["total_delta_volume"] == -10.0 and got[2]["total_delta_volume_percent"] == -100.0
    assert got[3]["added"] == 1 and got[3]["total_delta_volume"] == 13.0 and got[3]["total_delta_volume_percent"] == 100.0
    assert got[4]["total_delta_volume"] == 0 and got[4]["total_delta_volume_percent"] == 0


def test_two_heaps_inside_one_are_ambiguous(spark):
    def sq(x1, y1, x2, y2):
        return [[[float(x), float(y)] for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1))]]

    heaps = spark.createDataFrame([(1, 1, sq(0, 0, 5, 10), 10.0, 50.0, 2.0), (1, 2, sq(5, 0, 10, 10), 10.0, 50.0, 2.0), (2, 7, sq(0, 0, 10, 10), 21.0, 100.0, 2.0)],
        "survey_id long, heap_id long, rings array<array<array<double>>>, volume_m3 double, planimetric_area_m2 double, max_height_m double")
    pairs = spark.createDataFrame([(1, 1, 2)], "pair_id long, survey_a long, survey_b long")
    c = compare_surveys(heaps, pairs, iou_threshold=0.2)
    row = c.matched.first()
    assert c.matched.count() == 1 and row["state"] == "ambiguous" and len(row["b_candidates"]) == 1
    assert c.removed.count() == 1 and c.added.count() == 0


def test_message_lines(spark):
    lines = ['﻿{"type":"progress","percent":5,"message":"a"}', "", "  ", "oops", '{"percent":1}', '{"type":"debug"}', "[1]", '{"type":"error","code":"X"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, value string")
    got = [(r["type"], r["message"]) for r in messages.parse_messages(df).orderBy("i").collect()]
    assert [t for t, _ in got] == ["progress", "warning", "warning", "warning", "warning", "error"]
    assert got[1][1] == "Non-JSON line: oops" and got[3][1].startswith("Unknown type 'debug'")


def points_of(spark, n, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(1 + k % 2, 1000 + float(x), 2000 + float(y), round(float(z), 3), 2) for k, (x, y, z) in enumerate(rng.random((n, 3)) * [10, 10, 5])]
    return spark.createDataFrame(rows, "survey_id long, x double, y double, z double, classification int")


def whole_surface(df, g):
    from moundlake.operators.surface import surface_cells

    return sorted(tuple(r) for r in surface_cells(df, g).collect())


def test_streaming_ingest_equals_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "BAND_ROWS", 4)
    _, g = grid_frame(spark, [np.zeros((10, 10)), np.zeros((10, 10))])
    df = points_of(spark, 400)
    df.repartition(10).write.parquet(str(tmp_path / "in"))
    table = str(tmp_path / "table")

    def run():
        stream = jobs.point_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
        q = jobs.ingest(stream, g, table, str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None

    run()
    assert sorted(tuple(r) for r in jobs.ingested_surface(spark, table).select("survey_id", "r", "c", "v").collect()) == whole_surface(df, g)
    assert jobs.ingested(spark, table).agg(F.sum("points")).first()[0] == 400
    # ten batches leave two versions of at most 2 surveys x 3 bands
    assert len(list((tmp_path / "table/manifest").glob("version=*"))) == 2
    assert len(list((tmp_path / "table/heights").glob("version=*/survey_id=*/part=*"))) <= 2 * 6
    # a later batch touches one band; only that one is refreshed
    tables = VersionedTables(spark, table)
    before = tables.versions()[-1]
    extra = spark.createDataFrame([(1, 1000.5, 2009.5, 99.0, 2)], df.schema)
    jobs.merge_batch(tables, extra, 1000, g)
    fresh = jobs.ingested_surface(spark, table, since=before).collect()
    assert fresh and {(r["survey_id"], r["r"] // 4) for r in fresh} == {(1, 0)}
    jobs.merge_batch(tables, extra, 1000, g)  # replayed
    assert sorted(tuple(r) for r in jobs.ingested_surface(spark, table).select("survey_id", "r", "c", "v").collect()) == whole_surface(df.union(extra), g)


def test_replayed_and_empty_batches(spark, tmp_path):
    _, g = grid_frame(spark, [np.zeros((10, 10)), np.zeros((10, 10))])
    tables, df = VersionedTables(spark, str(tmp_path)), points_of(spark, 60)
    assert jobs.ingested(spark, str(tmp_path)).count() == 0 and tables.mark() is None
    for batch_id in (0, 1, 2, 2, 1, 3, 4):
        part = df.where(F.floor(F.col("x") * 1000) % 3 == batch_id)  # 3 and 4 are empty
        jobs.merge_batch(tables, part, batch_id, g)
    assert tables.mark() == 4 and whole_surface(df, g) == sorted(tuple(r) for r in jobs.ingested_surface(spark, str(tmp_path)).select("survey_id", "r", "c", "v").collect())


def test_two_tables_change_together_or_not_at_all(spark, tmp_path):
    tables = VersionedTables(spark, str(tmp_path))
    heaps = spark.createDataFrame([(s, 0, h, 10.0) for s in (1, 2) for h in (1, 2)], "survey_id long, part int, heap_id long, volume_m3 double")
    bases = spark.createDataFrame([(1, 0, 100.0), (2, 0, 200.0)], "survey_id long, part int, base double")
    tables.commit({"heaps": heaps, "surveys": bases})
    new_heaps, new_bases = heaps.where("survey_id = 1").withColumn("volume_m3", F.lit(7.0)), bases.where("survey_id = 1").withColumn("base", F.lit(101.0))

    @F.udf("double")
    def fails(v):
        raise RuntimeError("disk full")

    with pytest.raises(Exception, match="disk full"):
        tables.commit({"heaps": new_heaps, "surveys": new_bases.withColumn("base", fails("base"))})
    state = lambda: (
        sorted((r["survey_id"], r["heap_id"], r["volume_m3"]) for r in tables.read("heaps").collect()),
        sorted((r["survey_id"], r["base"]) for r in tables.read("surveys").collect()),
    )
    assert state() == ([(1, 1, 10.0), (1, 2, 10.0), (2, 1, 10.0), (2, 2, 10.0)], [(1, 100.0), (2, 200.0)])
    tables.commit({"heaps": new_heaps, "surveys": new_bases})
    assert state() == ([(1, 1, 7.0), (1, 2, 7.0), (2, 1, 10.0), (2, 2, 10.0)], [(1, 101.0), (2, 200.0)])


def test_streaming_monitor_counts_warnings(spark, tmp_path):
    spark.createDataFrame(
        [("r1", f"2026-01-01 0{h}:10:00", t) for h, t in ((0, "oops"), (1, '{"type":"progress","percent":3}'), (7, '{"type":"error"}'))],
        "run_id string, ts string, value string",
    ).write.json(str(tmp_path / "log"))
    lines = spark.readStream.schema("run_id string, ts timestamp, value string").json(str(tmp_path / "log"))
    q = jobs.warning_windows(jobs.monitor(lines)).writeStream.outputMode("complete").format("memory").queryName("warned").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((str(r["window_start"]), r["type"], r["messages"]) for r in spark.table("warned").collect())
    assert got == [("2026-01-01 00:00:00", "warning", 1), ("2026-01-01 06:00:00", "error", 1)]


def test_italian_formats(spark):
    row = spark.range(1).select(
        formats.italian_number(F.lit(1234567.5), 2).alias("a"), formats.italian_number(F.lit(1234), 0).alias("b"),
        formats.italian_date(F.to_date(F.lit("2026-04-20"))).alias("c"), formats.percent_text(F.lit(3.0)).alias("d"),
    ).first()
    assert tuple(row) == ("1.234.567,50", "1.234", "20/04/2026", "")


def test_config_defaults_and_errors(spark):
    df = spark.createDataFrame([(1, None), (2, '{"height_threshold": 0.8, "vlm": 1}'), (3, "{oops"), (4, "[1]")], "survey_id long, config string")
    got = {r["survey_id"]: r for r in documents.parse_config(df).collect()}
    assert got[1]["height_threshold"] == 0.5 and got[1]["morpho_kernel_size"] == 50 and got[1]["manual_base_elevation"] is None
    assert got[2]["height_threshold"] == 0.8 and got[2]["error"] is None
    assert got[3]["error"] and got[4]["error"] and got[3]["height_threshold"] is None


def test_an_empty_export_is_an_error(spark):
    with pytest.raises(ValueError):
        report.guard_not_empty(report.exportable(heap_rows(spark).where("heap_id = 3")), "no heap to export")


def test_config_of_wrong_types_gives_error_rows(spark):
    from moundlake.sources.documents import parse_config

    texts = ['{"height_threshold": "abc"}', '{"morpho_kernel_size": 2.5}', '{"height_threshold": 1, "use_ground_classification": "yes"}', '{"height_threshold": null}', "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "survey_id long, config string")
    got = {r["survey_id"]: r for r in parse_config(df).collect()}
    assert [got[i]["error"] for i in range(6)] == [
        "wrong type: height_threshold", "wrong type: morpho_kernel_size", "wrong type: use_ground_classification", None, None, None]
    assert got[0]["height_threshold"] is None and got[3]["height_threshold"] == 0.5


def test_enrich_falls_through_by_type(spark):
    from moundlake.operators.report import enrich

    kind = "survey_id long, heap_id long, label string, volume_m3 double, n int, ok boolean"
    edited = spark.createDataFrame([(1, 1, "", 0.0, 0, False), (1, 2, "a", 2.0, None, None)], kind)
    measured = spark.createDataFrame([(1, 1, "m", 1.0, 5, True), (1, 2, "b", 3.0, 6, None)], kind)
    rows = {r["heap_id"]: tuple(r)[2:] for r in enrich(edited, measured, ["label", "volume_m3", "n", "ok"]).collect()}
    assert rows == {1: ("m", 1.0, 5, True), 2: ("a", 2.0, 6, False)}


def test_files_of_a_commit_grow_with_the_partitions_only(spark, tmp_path):
    """However many tasks hold rows of a partition, its rows come together before they are written."""
    rows = spark.range(4_000, numPartitions=16).selectExpr("id % 3 AS survey_id", "CAST(id % 2 AS int) AS part", "id AS x")
    tables = VersionedTables(spark, str(tmp_path / "tables"))
    tables.commit({"heights": rows})
    assert len(list((tmp_path / "tables" / "heights").rglob("part-*.parquet"))) == 6
    assert tables.read("heights").agg({"x": "sum"}).first()[0] == 4_000 * 3_999 // 2
