"""File formats and streams."""

from __future__ import annotations

import datetime as dt
import struct
import tracemalloc
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliofield.sources import las, laz, tables
from heliofield.streaming import loggers


def test_las_round_trip_with_pushdown(spark, tmp_path):
    las.register(spark)
    rows = [(i * 0.25, 100.0 - i, i * 0.001, i % 7) for i in range(1000)]
    path = str(tmp_path / "cloud")
    spark.createDataFrame(rows, "x double, y double, z double, cls int").repartition(3).write.format("las").mode("append").save(path)
    back = spark.read.format("las").option("points_per_partition", "100").load(path)
    assert back.count() == 1000 and back.select("pid").distinct().count() == 1000
    got = sorted((round(r.x, 3), round(r.y, 3), round(r.z, 3), r.cls) for r in back.where(F.col("cls").isin(2, 6) & (F.col("x") <= 100.0)).collect())
    assert got == sorted((round(x, 3), round(y, 3), round(z, 3), c) for x, y, z, c in rows if c in (2, 6) and x <= 100.0)


def test_las_written_like_another(spark, tmp_path):
    las.register(spark)
    rows = [(500000.125 + i * 0.01, 6900000.5 - i, i * 0.25, 2) for i in range(50)]
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    spark.createDataFrame(rows, "x double, y double, z double, cls int").coalesce(1).write.format("las").option("scale", "0.005").mode("append").save(one)
    part = spark.read.format("las").load(one).where("pid % 2 = 1")
    part.select("x", "y", "z", "cls").coalesce(1).write.format("las").option("like", one).mode("append").save(two)
    heads = [las.parse_header(open(las._files(p)[1][0], "rb").read(375)) for p in (one, two)]
    assert heads[0].scales == heads[1].scales == (0.005,) * 3 and heads[0].offsets == heads[1].offsets and heads[1].count == 25
    assert sorted((r.x, r.y, r.z) for r in spark.read.format("las").load(two).collect()) == sorted((r.x, r.y, r.z) for r in part.collect())


def test_polygon_text():
    assert tables.polygon_of("POLYGON ((0 0, 4 0, 4 3, 0 0))") == [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0)]
    for bad in ("POINT (1 2)", "POLYGON ((0 0, 1 1, 0 0))", "POLYGON ((0 0, 1 1, 2 0, 3 3))"):
        with pytest.raises(ValueError, match="polygon"):
            tables.polygon_of(bad)


def test_unknown_files_are_refused(spark, tmp_path):
    las.register(spark)
    with pytest.raises(ValueError, match="not a LAS"):
        las.parse_header(b"nope" * 100)
    with pytest.raises(FileNotFoundError):
        las._files(str(tmp_path / "none"))
    path = str(tmp_path / "cloud")
    spark.createDataFrame([(1.0, 2.0, 3.0, 2)], "x double, y double, z double, cls int").coalesce(1).write.format("las").mode("append").save(path)
    with pytest.raises(Exception, match="not compressed"):
        spark.read.format("las").option("backend", "laz").load(path).count()
    with pytest.raises(ValueError, match="format 6"):
        laz.layout_of(6, 30)


def cloud_file(path, point_format, n, seed=1, compressed=False, extra=0, chunk=700, variable=False, table_last=False):
    """A file with all fields filled, two variable records and version 1.2; the records."""
    rng = np.random.default_rng(seed)
    r = np.zeros(n, [("p", "<i4", 3), ("i", "<u2"), ("b", "u1"), ("c", "u1"), ("a", "i1"), ("u", "u1"), ("s", "<u2")])
    r["p"] = np.cumsum(rng.integers(-300, 300, (n, 3)), 0) + 1000
    if n > 60:
        r["p"][50], r["p"][51] = (2**31 - 1, -(2**31), 0), (-(2**31), 2**31 - 1, -(2**31))
    k = rng.integers(1, 6, n)
    r["b"] = (k << 3 | (rng.integers(0, 8, n) % k + 1)) | rng.integers(0, 4, n) << 6
    r["i"], r["u"], r["s"] = rng.integers(0, 65536, n) * (rng.random(n) < 0.5), rng.integers(0, 256, n) * (rng.random(n) < 0.2), rng.integers(0, 65536, n) * (rng.random(n) < 0.1)
    r["c"], r["a"] = rng.choice([2, 3, 6], n) | rng.choice([0, 32, 128], n), rng.integers(-128, 128, n)
    parts = [r.view(np.uint8).reshape(n, 20)]
    if point_format in (1, 3):
        t = np.cumsum(rng.choice([0, 1e-5, 2e-5, 3e-3, -1e-5, 100.0, -50], n, p=[0.2, 0.4, 0.2, 0.1, 0.05, 0.03, 0.02])) + 3e5
        parts.append(t.view(np.uint8).reshape(n, 8))
    if point_format in (2, 3):
        c = rng.integers(0, 65536, (n, 3)).astype("<u2")
        grey = rng.random(n) < 0.3
        c[grey] = c[grey][:, :1]
        parts.append(c.view(np.uint8).reshape(n, 6))
    if extra:
        parts.append(rng.integers(0, 256, (n, extra), dtype=np.uint8))
    records = np.ascontiguousarray(np.concatenate(parts, 1))
    size = records.shape[1]
    own = [struct.pack("<H16sHH32s", 0, b"someone", k, 5, b"d") + b"12345" for k in (7, 8)]
    layout = laz.layout_of(point_format, size, 0 if variable else chunk)
    if compressed:
        body = laz.layout_body(layout)
        own.insert(1, struct.pack("<H16sHH32s", 0, laz.USER, laz.RECORD, len(body), b"") + body)
    head = bytearray(227)
    head[0:4], head[24], head[25], head[26:30] = b"LASF", 1, 2, b"GEAR"
    start = 227 + sum(map(len, own))
    struct.pack_into("<HIIBHI", head, 94, 227, start, len(own), point_format | 0x80 * compressed, size, n)
    struct.pack_into("<6d", head, 131, 0.01, 0.02, 0.005, 1000.0, -50.0, 7.0)
    data = records.tobytes()
    if compressed:
        cuts = [0, *sorted(rng.choice(np.arange(1, n), min(n - 1, 5), replace=False).tolist()), n] if variable else [*range(0, n, chunk), n]
        pieces = [laz.encode_chunk(records[a:b], layout) for a, b in zip(cuts, cuts[1:], strict=False)]
        at = start + 8 + sum(map(len, pieces))
        table = laz.chunk_table([(b - a, len(p)) for a, b, p in zip(cuts, cuts[1:], pieces, strict=False)], variable)
        data = struct.pack("<q", -1 if table_last else at) + b"".join(pieces) + table + (struct.pack("<q", at) if table_last else b"")
    with open(path, "wb") as out:
        out.write(bytes(head) + b"".join(own) + data)
    return records


@pytest.mark.parametrize(("point_format", "extra"), [(0, 0), (1, 0), (2, 0), (3, 0), (3, 5)])
@pytest.mark.parametrize("n", [1, 2, 3000])
def test_chunks_round_trip(tmp_path, point_format, extra, n):
    records = cloud_file(tmp_path / "a.las", point_format, n, extra=extra)
    layout = laz.layout_of(point_format, records.shape[1])
    packed = laz.encode_chunk(records, layout)
    assert (laz.decode_chunk(packed, n, layout) == records).all()
    assert n < 3000 or len(packed) < 0.6 * records.size


def test_arithmetic_codes_round_trip():
    rng = np.random.default_rng(4)
    values = [(int(v), int(c)) for v, c in zip(rng.integers(-(2**31), 2**31, 3000) >> rng.integers(0, 31, 3000), rng.integers(0, 3, 3000), strict=True)] + [(2**31 - 1, 0), (-(2**31), 1), (0, 2)]
    out, number, last = laz.Encoder(), laz.Number(32, 3), 0
    for v, c in values:
        number.code(out, c, last, v)
        last = v
    for n in (1, 8, 19, 20, 32):
        out.bits(n, 2**n - 2)
    back, number, last = laz.Decoder(out.done()), laz.Number(32, 3), 0
    for v, c in values:
        last = number.code(back, c, last, None)
        assert last == v
    assert [back.bits(n) for n in (1, 8, 19, 20, 32)] == [2**n - 2 for n in (1, 8, 19, 20, 32)]


def test_symbol_codes_carry():
    """Nearly certain last symbols drive the base to runs of 255 that a carry must pass."""
    for seed in range(20):
        rng = np.random.default_rng(seed)
        symbols = np.where(rng.random(4000) < 0.995, 5, rng.integers(0, 6, 4000)).tolist()
        out, model = laz.Encoder(), laz.Symbols(6)
        for s in symbols:
            out.symbol(model, s)
        back, model = laz.Decoder(out.done()), laz.Symbols(6)
        assert [back.symbol(model) for _ in symbols] == symbols


@pytest.mark.parametrize(("variable", "table_last"), [(False, False), (True, False), (False, True)])
def test_compressed_files_are_read_by_chunks(spark, tmp_path, variable, table_last, monkeypatch):
    las.register(spark)
    records = cloud_file(tmp_path / "a.laz", 3, 5000, compressed=True, variable=variable, table_last=table_last)
    cloud = spark.read.format("las").option("points_per_partition", "1500").option("record", "true").load(str(tmp_path))
    got = sorted((r.pid, bytes(r.record), r.cls) for r in cloud.collect())
    assert [g[0] for g in got] == list(range(5000)) and b"".join(g[1] for g in got) == records.tobytes()
    assert [g[2] for g in got] == (records[:, 15] & 31).tolist()
    few = cloud.where("cls = 6 and x > 990").select("pid", "x").collect()
    x = np.ascontiguousarray(records[:, :4]).view("<i4")[:, 0] * 0.01 + 1000
    assert {r.pid for r in few} == set(np.flatnonzero((records[:, 15] & 31 == 6) & (x > 990)).tolist())
    reader = las.LasReader({"path": str(tmp_path), "points_per_partition": "1500"})
    parts = reader.partitions()
    assert len(parts) > 2 and [p.first for p in parts[1:]] == [p.last for p in parts[:-1]]
    read = [c[2:] for p in parts for c in p.chunks]
    assert all(a[1] == b[0] for a, b in zip(read, read[1:], strict=False))  # every byte once
    reader.filters = [las.EqualTo(("cls",), 6)]
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == int((records[:, 15] & 31 == 6).sum())


def test_a_damaged_table_is_told(tmp_path):
    records = cloud_file(tmp_path / "a.laz", 0, 2000, compressed=True)
    layout = laz.layout_of(0, 20, 700)
    with pytest.raises(ValueError, match="all points"):
        laz.chunk_places(laz.chunk_table([(700, 10), (700, 10)]), 0, len(records), layout)


@pytest.mark.parametrize("compressed", [False, True])
def test_only_the_class_changes(spark, tmp_path, compressed):
    """Two tiles become one file that keeps header text, variable records, format and all bytes but class and counts."""
    las.register(spark)
    tiles, out = tmp_path / "tiles", str(tmp_path / "out")
    tiles.mkdir()
    one, two = (cloud_file(tiles / f"{k}.las", 3, n, seed=k, compressed=k == 2, extra=3) for k, n in ((1, 4000), (2, 2500)))
    cloud = spark.read.format("las").option("record", "true").load(str(tiles))
    changed = cloud.withColumn("cls", F.when(F.col("cls") == 2, 9).otherwise(F.col("cls")).cast("int"))
    changed.coalesce(1).sortWithinPartitions("pid").write.format("las").option("like", str(tiles)).option("compressed", str(compressed)).option("chunk", "999").mode("append").save(out)
    found = las._files(out)[1]
    assert len(found) == 1 and found[0].endswith(".laz" if compressed else ".las")
    with open(found[0], "rb") as f:
        raw = f.read()
    h = las.parse_header(raw[:375])
    kept = [v for v in las.variable_records(raw, h) if v[0] != laz.USER]
    assert (h.count, h.point_format, h.size, h.version, raw[26:30], [v[:2] for v in kept]) == (6500, 3, 37, "1.2", b"GEAR", [(b"someone", 7), (b"someone", 8)]) and all(v[2].endswith(b"12345") for v in kept)
    want = np.concatenate((one, two))
    back = sorted((r.pid, bytes(r.record)) for r in spark.read.format("las").option("record", "true").load(out).collect())
    stored = np.frombuffer(b"".join(r for _, r in back), np.uint8).reshape(-1, 37)
    cls = want[:, 15] & 31
    want[:, 15] = (want[:, 15] & 0xE0) | np.where(cls == 2, 9, cls)
    assert (stored == want).all()
    high = np.ascontiguousarray(want[:, :12]).view("<i4").max(0) * np.array(h.scales) + np.array(h.offsets)
    assert struct.unpack_from("<6d", raw, 179)[::2] == pytest.approx(tuple(high))
    assert list(struct.unpack_from("<5I", raw, 111)) == np.bincount(want[:, 14] & 7, minlength=8)[1:6].tolist()


def test_unfinished_writes_are_not_read(spark, tmp_path):
    las.register(spark)
    path = str(tmp_path / "cloud")
    rows = spark.createDataFrame([(float(i), 0.0, 0.0, 2) for i in range(10)], "x double, y double, z double, cls int")
    rows.coalesce(1).write.format("las").mode("append").save(path)
    with pytest.raises(Exception, match="fit"):
        rows.withColumn("x", F.when(F.col("x") == 9, 1e12).otherwise(F.col("x"))).repartition(3).write.format("las").mode("append").save(path)
    left = sorted(str(p.relative_to(path)) for p in (tmp_path / "cloud").rglob("*") if p.is_file())
    assert len(left) == 1 and spark.read.format("las").load(path).count() == 10
    (tmp_path / "cloud" / "_temporary-dead").mkdir()
    (tmp_path / "cloud" / "_temporary-dead" / "part-0.las").write_bytes(b"half")
    assert spark.read.format("las").load(path).count() == 10
    rows.limit(4).coalesce(1).write.format("las").mode("overwrite").save(path)
    assert spark.read.format("las").load(path).count() == 4


def test_column_choice():
    assert tables.pick_column(["a", "Energy x", "Energy y"], "Energy") == "Energy x" and tables.pick_column(["a", "b"], 1) == "b"
    with pytest.raises(ValueError, match="columns"):
        tables.pick_column(["a"], "Energy")


def test_inverter_csv(spark, tmp_path):
    (tmp_path / "log.csv").write_text("Date and time,Other,Energy Part\n[dd.MM.yyyy HH:mm],[x],[Wh]\n01.06.2021 10:00,1, 12.5 \n01.06.2021 10:05,2,n/a\n")
    got = tables.read_inverter(spark, str(tmp_path / "log.csv"), "Energy").orderBy("t").collect()
    assert [(r.t, r.e) for r in got] == [(dt.datetime(2021, 6, 1, 10, 0), 12.5), (dt.datetime(2021, 6, 1, 10, 5), None)]
    assert tables.read_inverter_all(spark, str(tmp_path / "log.csv")).columns == ["t", "Other", "Energy Part"]


def test_workbook(spark, tmp_path):
    sheet = '<worksheet xmlns="m"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>time</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    assert [r.cells for r in tables.read_workbooks(spark, str(tmp_path / "a.xlsx")).collect()] == [["time", None, "2.5"]]


def book(path, sheets, relations=True, shared=()):
    """A workbook of (name, part, rows) sheets; cells are numbers, or indexes of shared strings as ("s", k)."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for _, part, rows in sheets:
            with z.open(f"xl/{part}", "w") as out:
                out.write(b'<?xml version="1.0"?><worksheet xmlns="m"><cols><col/></cols><sheetData>')
                for i, row in enumerate(rows):
                    cells = "".join(f'<c r="{"ABCDEF"[k]}{i + 1}"' + (f' t="s"><v>{v[1]}</v></c>' if isinstance(v, tuple) else f"><v>{v}</v></c>") for k, v in enumerate(row) if v is not None)
                    out.write(f'<row r="{i + 1}">{cells}</row>'.encode())
                out.write(b"</sheetData><pageMargins/></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", '<sst xmlns="m">' + "".join(f"<si>{x}</si>" for x in shared) + "</sst>")
        if relations:
            z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="o"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, (n, _, _) in enumerate(sheets)) + "</sheets></workbook>")
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p">' + "".join(f'<Relationship Id="rId{k}" Target="{"/xl/" if k else ""}{p}"/>' for k, (_, p, _) in enumerate(sheets)) + "</Relationships>")


def test_sheets_are_found_by_relations(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    book(path, [("Log", "worksheets/data7.xml", [[1, None, ("s", 1)], [2]]), ("Notes", "other/x.xml", [[("s", 0), 5]])], shared=("<t>plain</t>", "<r><t>of </t></r><r><t>runs é</t></r>"))
    assert [(r.row, r.cells) for r in tables.read_workbooks(spark, path).orderBy("row").collect()] == [(0, ["1", None, "of runs é"]), (1, ["2"])]
    assert [r.cells for r in tables.read_workbooks(spark, path, "Notes").collect()] == [["plain", "5"]]
    with pytest.raises(Exception, match="Log"):
        tables.read_workbooks(spark, path, "None").count()
    bare = str(tmp_path / "b.xlsx")
    book(bare, [("", "worksheets/sheet3.xml", [[4]])], relations=False)
    assert [r.cells for r in tables.read_workbooks(spark, bare).collect()] == [["4"]]


def test_long_sheets_are_read_in_batches(tmp_path):
    n = 200_000
    path = tmp_path / "long.xlsx"
    book(path, [("Log", "worksheets/sheet1.xml", ([("s", k % 50_000), k, k * 0.5] for k in range(n)))], shared=[f"<t>text {k}</t>" for k in range(50_000)])
    raw = path.read_bytes()
    tracemalloc.start()
    seen = 0
    for row in tables._sheet(raw):
        assert seen % 5000 or row == [f"text {seen % 50_000}", str(seen), str(seen * 0.5)]
        seen += 1
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert seen == n and peak < 12 << 20


def test_inverter_workbook(spark, tmp_path):
    cell = lambda at, v: f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
    lines = [("Date and time", "Other", "Energy MPP2"), ("[dd.MM.yyyy HH:mm]", "[x]", "[Wh]"), ("01.06.2021 10:00", "1", " 12.5 "), ("44348.5", "2", "n/a"), ("", "3", "4")]
    body = "".join(f'<row r="{i + 1}">{"".join(cell(f"{c}{i + 1}", v) for c, v in zip("ABC", row, strict=True))}</row>' for i, row in enumerate(lines))
    with zipfile.ZipFile(tmp_path / "log.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="m"><sheetData>{body}</sheetData></worksheet>')
    want = [(dt.datetime(2021, 6, 1, 10, 0), 12.5), (dt.datetime(2021, 6, 1, 12, 0), None)]
    assert [(r.t, r.e) for r in tables.read_inverter_workbook(spark, str(tmp_path / "log.xlsx"), "MPP2").orderBy("t").collect()] == want
    assert [(r.t, r.e) for r in tables.read_inverter_workbook(spark, str(tmp_path / "log.xlsx")).orderBy("t").collect()] == want
    every = tables.read_inverter_workbook_all(spark, str(tmp_path / "log.xlsx"))
    assert every.columns == ["t", "Other", "Energy MPP2"] and every.count() == 2


def test_cached_weather(spark, tmp_path):
    (tmp_path / "w.csv").write_text("timestamp,dni,dhi,ghi,T,wind,albedo\n2021-06-01 00:00:00,1.234,2,3,1,5,0.9\n2021-06-01 00:05:00,1,2,3,1,5,0.9\n")
    got = tables.read_cached_weather(spark, str(tmp_path / "w.csv")).orderBy("ts").first()
    assert (got.dni, got.albedo) == (1.23, 0.425)
    assert tables.read_cached_weather(spark, str(tmp_path / "w.csv"), False).first().albedo == 0.9
    (tmp_path / "x.csv").write_text("timestamp,dni,dhi,ghi,T,wind,albedo\n2021-06-02 00:00:00,1,2,3,20,5,0.9\n")
    both = tables.read_cached_weather(spark, str(tmp_path / "*.csv")).orderBy("ts").collect()
    assert [r.albedo for r in both] == [0.425, 0.425, 0.2]  # each day has a mean of its own


def test_streams(spark, tmp_path):
    start = dt.datetime(2021, 6, 1)
    src = tmp_path / "in"
    for k, minutes in enumerate(([0, 5, 7], [12, 100, 101], [5, 180, 400])):
        spark.createDataFrame([("a", start + dt.timedelta(minutes=m), float(m)) for m in minutes], "dev string, ts timestamp, v double").coalesce(1).write.mode("append").parquet(str(src))
        if k == 0:
            stream = lambda: spark.readStream.schema("dev string, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = loggers.gaps(stream(), "ts", "dev").writeStream.format("memory").queryName("found_gaps").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select gap_min from found_gaps").collect()
    assert sum(r.gap_min for r in got) >= 300 and all(r.gap_min > 60.5 for r in got)
    q = loggers.five_minute_means(stream(), "ts", "v", "dev", "1 minute").writeStream.format("memory").queryName("means").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    means = {r.ts: (r.mean, r.n) for r in spark.sql("select * from means").collect()}
    assert means[start] == (0.0, 1) or start in means


def test_compressed_clouds_are_written_by_many_tasks_where_the_table_is_one_row_group(spark, tmp_path, monkeypatch):
    from heliofield.plans import files

    monkeypatch.setattr(files, "_place", lambda s, name: str(tmp_path / name))
    rows = sorted(map(tuple, files.laz_round_trip(spark, "/root/testdata/sf0.001").collect()))
    assert len(list((tmp_path / "laz").glob("*.laz"))) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = {r.cls: tuple(r) for r in files.las_merge_kept(spark, "/root/testdata/sf0.001").collect()}
    assert len(list((tmp_path / "tiles").glob("*.laz"))) == 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [merged[3], merged[6]] == rows
