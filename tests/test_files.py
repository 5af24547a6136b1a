"""File sources and sinks on a folder built by the test itself: PNGs made
with zlib + struct, .npy / .npz from numpy, a zip from the standard
library; a corrupt PNG, a hidden file, a non-image file, an empty folder, a
Fortran-order array and a truncated npz member."""

from __future__ import annotations

import io
import json
import os
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlake.sinks import files as K
from pairlake.sources import files as SRC
from pairlake.sources.archives import read_npz_rows, read_zip_manifest, read_zip_members
from pairlake.streaming.collector import run_append_to_parquet


def png_bytes(w: int, h: int, rgb=(10, 20, 30)) -> bytes:
    raw = b"".join(b"\x00" + bytes(rgb) * w for _ in range(h))

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data) & 0xFFFFFFFF)
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "cats").mkdir()
    (root / "dogs" / "deep").mkdir(parents=True)
    (root / "empty").mkdir()
    (root / "skipme").mkdir()
    (root / "cats" / "a.png").write_bytes(png_bytes(4, 2, (255, 0, 0)))
    (root / "cats" / "b.PNG").write_bytes(png_bytes(3, 3))
    (root / "dogs" / "deep" / "c.png").write_bytes(png_bytes(2, 2))
    (root / "dogs" / "notes.txt").write_text("not an image")
    (root / "skipme" / "d.png").write_bytes(png_bytes(2, 2))
    (root / ".hidden.png").write_bytes(png_bytes(1, 1))
    (root / "root.png").write_bytes(png_bytes(1, 1))
    np.save(root / "dogs" / "t.npy", np.arange(24, dtype=np.float32).reshape(2, 3, 4))
    np.save(root / "dogs" / "f.npy", np.asfortranarray(np.arange(6, dtype=np.float64).reshape(2, 3)))
    return root


def test_list_files_prunes_ignored_names(spark, tree):
    got = {r["path"] for r in SRC.list_files(spark, str(tree), ignore=("skip*", "*.txt")).collect()}
    assert "cats/a.png" in got and "dogs/deep/c.png" in got and "root.png" in got
    assert not any(p.startswith("skipme/") for p in got) and "dogs/notes.txt" not in got
    assert ".hidden.png" in got
    inv = spark.createDataFrame([(f"file://{tree}/.hidden.png", 10, None), (f"file://{tree}/cats/a.png", 10, None)],
                                "path string, length long, modificationTime timestamp")
    kept = {r["path"] for r in SRC.list_files(spark, str(tree), inventory=inv).collect()}
    assert kept == {".hidden.png", "cats/a.png"}


def test_ignored_folders_are_never_listed(spark, tmp_path, monkeypatch):
    names = ["a/b/c/1.png", "a/b/_meta/2.png", ".git/x/3.png", "keep/skip1/deep/4.png", "keep/5.txt", "_6.png", "keep/skipped.png",
             "odd [x]/7 %20.png", "keep/é.png"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"x" * len(n))
    (tmp_path / "empty/er").mkdir(parents=True)
    got = {r["path"]: (r["length"], r["uri"]) for r in SRC.list_files(spark, str(tmp_path)).collect()}
    assert got == {n: (len(n), f"file://{tmp_path}/{n}") for n in names}
    listed = spark.sparkContext.accumulator(0)
    base = SRC._list_level

    def counted(root, ignore):
        run = base(root, ignore)

        def each(batches):
            for batch in batches:
                listed.add(batch.num_rows)
                yield from run([batch])
        return each
    monkeypatch.setattr(SRC, "_list_level", counted)
    few = SRC.list_files(spark, f"file:{tmp_path}", ignore=("skip*", ".*", "[_]*", "empty"))
    assert sorted(r["path"] for r in few.collect()) == sorted(["a/b/c/1.png", "keep/5.txt", "odd [x]/7 %20.png", "keep/é.png"])
    assert listed.value == 6  # the root, a, a/b, a/b/c, keep, odd [x]
    with pytest.raises(FileNotFoundError):
        SRC.list_files(spark, str(tmp_path / "none"))
    assert SRC.list_files(spark, str(tmp_path / "empty")).collect() == []


def test_read_images_rgb_and_errors(spark, tree, tmp_path):
    imgs = {os.path.basename(r["path"]): r for r in SRC.read_images(spark, str(tree / "cats")).collect()}
    a = imgs["a.png"]
    assert (a["width"], a["height"], a["n_channels"]) == (4, 2, 3)
    assert bytes(a["data"][:3]) == bytes([255, 0, 0])  # RGB, not BGR
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "ok.png").write_bytes(png_bytes(2, 2))
    (bad / "broken.png").write_bytes(b"\x89PNG garbage")
    assert SRC.read_images(spark, str(bad), on_error="drop").count() == 1
    with pytest.raises(Exception):
        SRC.read_images(spark, str(bad), on_error="fail").collect()


def test_read_images_keeps_no_file_list_on_the_driver(spark, tmp_path):
    for i in range(300):
        f = tmp_path / f"c{i % 3}" / f"{i:03d}.png"
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(png_bytes(1, 1, (i % 256, 7, 9)))
    imgs = SRC.read_images(spark, str(tmp_path))
    assert imgs.inputFiles() == []  # Spark's image source answers with every file
    assert imgs.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism  # and has a task for a few files each
    got = {r["path"].removeprefix(f"file://{tmp_path}/"): bytes(r["data"]) for r in imgs.collect()}
    assert got == {f"c{i % 3}/{i:03d}.png": bytes([i % 256, 7, 9]) for i in range(300)}


def test_read_images_reads_what_the_image_source_reads(spark, tmp_path):
    bmp = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 62, 0, 0, 54, 40, 2, 1, 1, 24, 0, 8, 0, 0, 0, 0) + bytes(range(1, 9))
    seen = {"a b/é %20x.png", "x.PNG", "_b=1.png", "_metadata/in.png", "_k=1/_x=2.png", "q?*[x].png", "deep/er/#h.jpeg", "nl\n.png",
            "dots..png", "two.bmp"}
    hidden = {"_a.png", ".c.png", "_metadata.png", "_h/in.png", ".h/in.png", "y._COPYING_/in.png", "a.png.bak", "png", "none.png"}
    for n in seen | hidden:
        f = tmp_path / "in" / n
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"" if n == "none.png" else bmp if n == "two.bmp" else png_bytes(2, 1, (1, 2, 3)))
    (tmp_path / "in" / "ln.png").symlink_to(tmp_path / "in" / "x.PNG")
    (tmp_path / "in" / "gone.png").symlink_to(tmp_path / "gone")
    (tmp_path / "in" / "empty").mkdir()
    ext = "*.{png,PNG,jpeg,bmp}"
    for root in (tmp_path / "in", f"file:{tmp_path}/in/", tmp_path / "in" / "a b", tmp_path / "in" / "_h", tmp_path / "in" / "empty",
                 tmp_path / "in" / "x.PNG", tmp_path / "in" / "d*"):
        src = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", ext).load(str(root))
        want = sorted((r["origin"], r["height"], r["width"], r["nChannels"], r["mode"]) for r in src.select("image.*").collect())
        rows = SRC.read_images(spark, str(root)).collect()
        assert sorted((r["path"], r["height"], r["width"], r["n_channels"], r["mode"]) for r in rows) == want, root
        assert {bytes(r["data"]) for r in rows if "bmp" not in r["path"]} <= {bytes([1, 2, 3] * 2)}
    rows = {r["path"].rsplit("/", 1)[1]: bytes(r["data"]) for r in SRC.read_images(spark, str(tmp_path / "in")).collect()}
    assert len(rows) == len(seen) + 1 and rows["two.bmp"] == bytes([3, 2, 1, 6, 5, 4])
    (tmp_path / "in" / "deep" / "broken.png").write_bytes(b"\x89PNG garbage")
    assert SRC.read_images(spark, str(tmp_path / "in"), on_error="drop").count() == len(seen) + 1
    with pytest.raises(Exception, match="cannot decode image .*broken.png"):
        SRC.read_images(spark, str(tmp_path / "in")).collect()


def test_read_npy_c_and_fortran(spark, tree):
    got = {os.path.basename(r["path"]): r for r in SRC.read_npy(spark, str(tree / "dogs")).collect()}
    assert got["t.npy"]["shape"] == [2, 3, 4] and got["t.npy"]["data"] == list(range(24))
    assert got["f.npy"]["data"] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]


def _zip(path, members, compress=zipfile.ZIP_STORED):
    with zipfile.ZipFile(path, "w", compression=compress) as z:
        for name, data in members.items():
            z.writestr(name, data)


def test_zip_members_sorted_sliced_and_manifest(spark, tmp_path):
    members = {f"d{i % 3}/img{i:03d}.png": png_bytes(1, 1) for i in range(25)}
    members["notes.txt"] = b"x"
    members["dataset.json"] = json.dumps({"labels": [["d0/img000.png", 1], ["d0/img000.png", 4]]}).encode()
    p = tmp_path / "set.zip"
    _zip(p, members)
    rows = read_zip_members(spark, str(p), partitions=4).collect()
    names = sorted(n for n in members if n.endswith(".png"))
    assert sorted((r["index"], r["member"]) for r in rows) == list(enumerate(names))
    man = {r["fname"]: r["label"] for r in read_zip_manifest(spark, str(p)).collect()}
    assert man == {"d0/img000.png": 4}
    assert SRC.open_dataset(spark, str(p)).count() == 25


def test_npz_rows_stored_compressed_and_truncated(spark, tmp_path):
    arr = np.arange(7 * 5, dtype=np.float32).reshape(7, 5)
    stored = tmp_path / "s.npz"
    np.savez(stored, arr_0=arr)
    rows = read_npz_rows(spark, str(stored), rows_per_partition=2).collect()
    assert [r["row_index"] for r in sorted(rows, key=lambda r: r["row_index"])] == list(range(7))
    assert np.allclose(np.array([r["data"] for r in sorted(rows, key=lambda r: r["row_index"])]), arr)
    comp = tmp_path / "c.npz"
    np.savez_compressed(comp, arr_0=np.asfortranarray(arr))
    rows = read_npz_rows(spark, str(comp)).collect()
    assert np.allclose(np.array([r["data"] for r in sorted(rows, key=lambda r: r["row_index"])]), arr)
    with pytest.raises(Exception):
        read_npz_rows(spark, str(stored), name="missing").collect()
    buf = io.BytesIO()
    np.save(buf, arr)
    trunc = tmp_path / "t.npz"
    _zip(trunc, {"arr_0.npy": buf.getvalue()[:-30]})
    with pytest.raises(Exception):
        read_npz_rows(spark, str(trunc)).collect()


def test_archives_share_bytes_evenly(spark, tmp_path):
    """One huge and many small archives, stored and deflated."""
    rng = np.random.default_rng(3)
    want = {}
    for k in range(9):
        members = {f"m{i:03d}.PNG": rng.integers(0, 50, rng.integers(0, 900 if k else 9000), dtype=np.uint8).tobytes()
                   for i in range(200 if k == 0 else 6)}
        _zip(tmp_path / f"a{k}.zip", members | {"skip.txt": b"x"}, zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED)
        want |= {(f"a{k}.zip", i, n): c for i, (n, c) in enumerate(sorted(members.items()))}
    df = read_zip_members(spark, str(tmp_path), partitions=6)
    got = {(r["archive"].split("/")[-1], r["index"], r["member"]): bytes(r["content"]) for r in df.collect()}
    assert got == want
    sizes = [r[1] for r in df.groupBy(F.spark_partition_id()).agg(F.sum("size")).collect()]
    assert len(sizes) == 6 and max(sizes) < 1.3 * sum(sizes) / 6
    assert read_zip_members(spark, str(tmp_path / "a1.zip"), partitions=50).count() == 6


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("packed", [False, True])
def test_npz_rows_in_pieces(spark, tmp_path, monkeypatch, order, packed):
    from pairlake.sources import archives
    monkeypatch.setattr(archives, "BATCH_BYTES", 100)
    arrays = [np.asarray(np.arange(n * 12, dtype=np.float64).reshape(n, 3, 4) + 1000 * n, order=order) for n in (50, 3, 1)]
    arrays += [np.arange(20, dtype=np.int16), np.zeros((0, 5), np.float32)]
    for k, a in enumerate(arrays):
        (np.savez_compressed if packed else np.savez)(tmp_path / f"p{k}.npz", arr_0=a, other=a)
    rows = read_npz_rows(spark, str(tmp_path), rows_per_partition=7).collect()
    assert len(rows) == 50 + 3 + 1 + 20
    for r in rows:
        a = arrays[int(r["archive"][-5])]
        assert r["shape"] == list(a.shape[1:]) and r["data"] == a[r["row_index"]].astype(np.float32).ravel().tolist()
    raw = read_npz_rows(spark, str(tmp_path / "p0.npz"), as_binary=True).filter("row_index = 9").first()["data"]
    assert bytes(raw) == np.ascontiguousarray(arrays[0][9]).tobytes()


def test_npz_header_of_any_length(spark, tmp_path):
    """Headers longer than 4,096 bytes, stored and compressed."""
    fields = [(f"a_long_field_name_{i:04d}", "<f4") for i in range(400)]
    a = np.zeros(6, dtype=fields)
    np.savez_compressed(tmp_path / "h.npz", arr_0=a)
    with pytest.raises(Exception, match="structured|descr|field|records"):
        read_npz_rows(spark, str(tmp_path / "h.npz")).collect()
    body = np.arange(8, dtype=np.float32).reshape(4, 2)
    text = repr({"descr": "<f4", "fortran_order": False, "shape": (4, 2)}).ljust(9000).encode() + b"\n"
    member = b"\x93NUMPY\x02\x00" + len(text).to_bytes(4, "little") + text + body.tobytes()
    for k, method in enumerate((zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED)):
        _zip(tmp_path / f"l{k}.npz", {"arr_0.npy": member}, method)
        rows = sorted(read_npz_rows(spark, str(tmp_path / f"l{k}.npz")).collect(), key=lambda r: r["row_index"])
        assert [r["data"] for r in rows] == body.tolist()


def test_class_manifest_and_captions_documents(spark, tmp_path):
    m = tmp_path / "dataset.json"
    m.write_text(json.dumps({"labels": [["a.png", 1], ["b.png", 2], ["a.png", 3]]}))
    assert {r["fname"]: r["label"] for r in SRC.read_class_manifest(spark, str(m)).collect()} == {"a.png": 3, "b.png": 2}
    n = tmp_path / "none.json"
    n.write_text(json.dumps({"labels": None}))
    assert SRC.read_class_manifest(spark, str(n)).count() == 0
    c = tmp_path / "labels.json"
    c.write_text(json.dumps([{"id": "x/1", "en": "a"}, {"id": "x/2", "en": "b"}, {"id": "x/1", "en": "c"}]))
    assert {r["id"]: r["caption"] for r in SRC.read_captions(spark, str(c)).collect()} == {"x/1": "c", "x/2": "b"}
    with pytest.raises(FileNotFoundError):
        SRC.read_captions(spark, str(tmp_path / "missing.json"))


def test_json_documents_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    rows = [(i // 3, json.dumps({"id": f"x/{i}", "en": "é, \n]" * (i % 7)})) for i in range(2000)]
    df = spark.createDataFrame(rows, "pos long, record string").repartition(5)
    frame, plain = type(df), type(df).repartition

    def spread(self, n, *cols):
        assert n != 1, "all rows in one task"
        return plain(self, n, *cols)
    monkeypatch.setattr(frame, "repartition", spread)
    for key in (None, "labels"):
        path = tmp_path / f"{key}.json"
        assert K.write_json_document(df, str(path), "record", "pos", key) == 2000
        back = json.loads(path.read_text())
        back = back if key is None else back[key]
        assert [int(r["id"][2:]) // 3 for r in back] == [p for p, _ in rows]
        assert sorted(json.dumps(r) for r in back) == sorted(r for _, r in rows)
        assert K.write_json_document(df.limit(0), str(tmp_path / "none.json"), "record", "pos", key) == 0
        assert json.loads((tmp_path / "none.json").read_text()) == ([] if key is None else {key: []})
        assert [p.name for p in tmp_path.iterdir() if not p.name.endswith((".json", ".crc"))] == []


def test_large_partitions_are_written_to_several_archives(spark, tmp_path, monkeypatch):
    from pairlake.sinks import blobs
    from pairlake.sources.archives import read_npz_rows, read_zip_members
    monkeypatch.setattr(blobs, "ARCHIVE_BYTES", 10_000, raising=False)
    monkeypatch.setattr(blobs, "ARCHIVE_ROWS", 40, raising=False)
    df = spark.range(0, 100, 1, 1).select("id", F.format_string("m%03d.png", "id").alias("name"),
                                          F.encode(F.expr("repeat(string(id), 150)"), "utf-8").alias("content"),
                                          F.array(F.col("id").cast("float"), F.lit(0.5).cast("float")).alias("x"))
    z, n = str(tmp_path / "z"), str(tmp_path / "n")
    zips = blobs.write_archives(df, z, "zip", "name", "content").collect()
    assert len(zips) > 2 and sum(r["rows"] for r in zips) == 100 and max(r["rows"] for r in zips) <= 40
    got = {r["member"]: (r["size"], bytes(r["content"])) for r in read_zip_members(spark, z).collect()}
    want = [str(i).encode() * 150 for i in range(100)]
    assert got == {f"m{i:03d}.png": (len(c), c) for i, c in enumerate(want)}
    npzs = blobs.write_archives(df, n, "npz", "id", matrix="x", key="id").collect()
    assert [r["rows"] for r in npzs] == [40, 40, 20]
    assert sorted(list(r["data"]) for r in read_npz_rows(spark, n).collect()) == [[float(i), 0.5] for i in range(100)]
    assert np.load(f"{n}/{sorted(r['archive'] for r in npzs)[0]}")["ids"].tolist() == list(range(40))


def test_write_dataset_and_pack(spark, tmp_path):
    df = spark.range(0, 2500).withColumnRenamed("id", "index")
    dest = str(tmp_path / "out")
    K.write_dataset(df, dest)
    back = spark.read.parquet(dest)
    assert back.count() == 2500 and back.filter("member = '00002/img00002345.png'").count() == 1
    with pytest.raises(Exception):
        K.write_dataset(df, dest)
    with pytest.raises(ValueError):
        K.write_dataset(df, "")
    s = spark.range(0, 12).select(F.col("id").alias("sample_index"), F.array(F.lit(2), F.lit(2)).alias("shape"))
    K.pack_samples(s, 10, str(tmp_path / "pack"))
    assert spark.read.parquet(str(tmp_path / "pack")).count() == 10
    with pytest.raises(ValueError):
        K.pack_samples_frame(s.filter("sample_index != 3"), 10)


def test_reports_roundtrip(spark, tmp_path):
    from pairlake.operators.catalog import format_eval_report
    m = spark.createDataFrame([("r1", 215.8, 3.94, 6.14, 0.8265, 0.5309)],
                              "run_id string, inception_score double, fid double, sfid double, precision double, "
                              "recall double")
    root = tmp_path / "reports"
    root.mkdir()
    lines = [r["line"] for r in sorted(format_eval_report(m).collect(), key=lambda r: r["line_no"])]
    (root / "2504000002.51.01.0cfg_cond_true.txt").write_text("\n".join(lines) + "\n")
    r = SRC.read_eval_reports(spark, str(root)).first()
    assert r["fid"] == 3.94 and r["recall"] == 0.5309 and r["cfg_cond"] is True
    K.append_eval_report(m, str(tmp_path / "tbl"), "r1", {"cfg": 2.5})
    K.append_eval_report(m, str(tmp_path / "tbl"), "r2", {"cfg": 4.0})
    assert spark.read.parquet(str(tmp_path / "tbl")).count() == 2


def test_latent_stats_cache_is_keyed_by_fingerprint(spark, tree, tmp_path):
    files = SRC.list_files(spark, str(tree))
    calls = []

    def compute():
        calls.append(1)
        return spark.createDataFrame([(0, 10, 0.5, 1.0)], "channel int, n long, mean double, std double")
    path = str(tmp_path / "stats")
    SRC.read_latent_stats(spark, path, files, compute)
    SRC.read_latent_stats(spark, path, files, compute)
    assert len(calls) == 1
    SRC.read_latent_stats(spark, path, files.filter("path != 'root.png'"), compute)
    assert len(calls) == 2


def test_stream_metric_sink(spark, tmp_path):
    from pairlake.streaming.collector import events_stream
    s = events_stream(spark, "/root/testdata/sf0.001")
    rows = s.select(F.col("event_id").alias("step"), F.col("event_type").alias("metric"), "value")
    out = run_append_to_parquet(rows, "metric-sink")
    assert out.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_keep_previous_stream_across_micro_batches(spark, tmp_path):
    """Two files split inside a round: the round's moments accumulate in the
    state across micro-batches and match the batch twin on closed rounds."""
    import time as _time

    from pairlake.operators import stats as ST
    from pairlake.streaming.keep_previous import run_keep_previous
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select(
        "ts", F.col("event_type").alias("name"), "value")
    cut = F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")
    src = tmp_path / "src"
    ev.filter(F.col("ts") < cut).coalesce(1).write.parquet(str(src / "a"))
    _time.sleep(1.1)
    ev.filter(F.col("ts") >= cut).coalesce(1).write.parquet(str(src / "b"))
    files = sorted(str(p) for p in src.rglob("*.parquet"))
    flat = tmp_path / "flat"
    flat.mkdir()
    for i, f in enumerate(files):
        (flat / f"part-{i}.parquet").write_bytes(open(f, "rb").read())
        _time.sleep(1.1)
    stream = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(str(flat)))
    out = run_keep_previous(stream)
    got = {(r["name"], r["round_start"]): (r["num"], r["sum"]) for r in out.collect()}
    day = F.floor(F.unix_seconds(F.to_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(" 00:00:00Z")),
                                                "yyyy-MM-dd HH:mm:ssX")) / 86400).cast("long") * 86400
    deltas = ST.stat_deltas(ev.withColumn("round", day))
    twin = {(r["name"], r["round"]): (r["num"], r["sum"]) for r in ST.keep_previous(deltas, step=86400).collect()}
    assert got and set(got) == set(twin) and out.count() == len(got)
    for key, (n, s) in got.items():
        assert n == twin[key][0] and abs(s - twin[key][1]) < 1e-6


def test_keep_previous_stream_late_null_and_silent(spark, tmp_path):
    """Rounds close as the watermark passes; late reports of closed rounds are
    dropped, of open ones counted; silent rounds repeat, null names are a name."""
    import datetime as dt
    import time as _time

    from pairlake.streaming.keep_previous import run_keep_previous
    schema, nan = "ts timestamp_ntz, name string, value double", float("nan")

    def at(day, hour):
        return dt.datetime(2024, 1, day, hour)
    batches = [
        [(at(1, 5), "a", 1.0), (at(1, 6), "a", nan), (at(1, 7), "nan", nan), (at(1, 8), None, 5.0), (None, "a", 9.0)],
        [(at(3, 2), "b", 2.0)],                                    # closes the 1st and the 2nd
        [(at(1, 9), "a", 100.0), (at(3, 1), "a", 4.0)],            # too late; late, but its round is open
        [(at(5, 3), "nan", nan)],
    ]
    flat = tmp_path / "flat"
    flat.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        (flat / f"part-{i}.parquet").write_bytes(next((tmp_path / f"b{i}").glob("*.parquet")).read_bytes())
        _time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(flat))
    day1 = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    got = {}
    for r in run_keep_previous(stream).collect():
        got.setdefault(r["name"], {})[(r["round_start"] - day1) // 86400 + 1] = (r["num"], r["sum"])
    assert got == {"a": {1: (1, 1.0), 2: (1, 1.0), 3: (1, 4.0), 4: (1, 4.0), 5: (1, 4.0)},
                   "b": {3: (1, 2.0), 4: (1, 2.0), 5: (1, 2.0)}, None: {d: (1, 5.0) for d in range(1, 6)}}


def test_committed_sink_keeps_one_copy_of_an_epoch(spark, tmp_path):
    import pyarrow as pa

    from pairlake.sinks.committed import CommittedWriter, read_committed, run_committed
    schema = spark.createDataFrame([], "step long, metric string").schema
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a", None])], ["step", "metric"])
    w = CommittedWriter(f"file:{tmp_path}/s/out", schema)
    first = [w.write(iter([batch, batch])), w.write(iter([])), None]
    lost = w.write(iter([batch]))  # a task whose message never arrives
    w.commit(first, 0)
    w.commit([w.write(iter([batch])), w.write(iter([batch]))], 0)  # replayed after a restart
    w.abort([w.write(iter([batch])), None], 1)
    w.commit([w.write(iter([batch]))], 1)
    w.commit([], 2)
    assert sorted(r["step"] for r in read_committed(spark, f"{tmp_path}/s", schema).collect()) == [1, 1, 1, 2, 2, 2]
    assert len(list((tmp_path / "s/out/data").iterdir())) == 3 and (tmp_path / "s/out/data" / lost.file).exists()

    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run_committed(stream, f"{tmp_path}/t")
    assert read_committed(spark, f"{tmp_path}/t", stream.schema).count() == 0
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        run_committed(stream, f"{tmp_path}/t")
    assert sorted(r[0] for r in read_committed(spark, f"{tmp_path}/t", stream.schema).collect()) == list(range(30))


def test_stream_stats_drops_rows_behind_the_watermark(spark, tmp_path):
    """A report for a window that was already emitted and evicted (its end is
    behind the watermark) is dropped, the documented late-data rule; reports
    of windows still open are counted."""
    import datetime as dt
    import time as _time

    from pairlake.streaming.collector import stream_stats
    schema = "ts timestamp_ntz, name string, value double"
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0)
    batches = [
        [(t0 + dt.timedelta(hours=h), "loss", 1.0) for h in range(0, 40, 2)],     # Jan 1 10:00 .. Jan 3 00:00
        [(dt.datetime(2024, 1, 3, 5, 0, 0), "loss", 3.0)],                         # closes the Jan 1 window
        [(dt.datetime(2024, 1, 1, 12, 0, 0), "loss", 100.0),                       # late: Jan 1 already emitted
         (dt.datetime(2024, 1, 3, 6, 0, 0), "loss", 3.0)],
    ]
    flat = tmp_path / "flat"
    flat.mkdir()
    for i, rows in enumerate(batches):
        out_dir = tmp_path / f"b{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(out_dir))
        (flat / f"part-{i}.parquet").write_bytes(next(out_dir.glob("*.parquet")).read_bytes())
        _time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(flat))
    out = {r["window_start"]: (r["num"], r["mean"]) for r in run_append_to_parquet(stream_stats(stream), "late").collect()}
    jan1 = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    jan2 = jan1 + 86400
    starts = {int(k.replace(tzinfo=dt.timezone.utc).timestamp()) if hasattr(k, "year") else k: v for k, v in out.items()}
    assert starts[jan1] == (7, 1.0)      # the late 100.0 never reached the emitted Jan 1 window
    assert starts[jan2] == (12, 1.0)
