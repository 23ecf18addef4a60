import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from motespark.common import checkpoint_ready, free_name, small_side
from motespark.functions import scalar as sc
from motespark.operators.locate import batch
from motespark.sources.frames import decode, pixel_table, read_frames
from motespark.sources.framestore import FrameStore
from motespark.streaming.linker import link_stream

P = "movie bigint, frame bigint, x double, y double"


def test_store(spark, tmp_path, rows):
    a = spark.createDataFrame([(0, 1.0), (0, 2.0)], "frame bigint, x double")
    b = spark.createDataFrame([(1, 3.0)], "frame bigint, x double")
    with FrameStore(spark, str(tmp_path / "s")) as s:
        s.put(a)
        s.put(b)
        assert len(s) == 2 and s.max_frame == 1 and s.frames == [0, 1]
        assert rows(s[0], "x") == [(1.0,), (2.0,)] and s.dump(1).count() == 2 and s.dump().count() == 3
        s.put(b.withColumn("x", F.lit(9.0)))
        assert rows(s.get(1), "x") == [(9.0,)] and len(list(s)) == 2
        with pytest.warns(UserWarning):
            s.put(a.limit(0))
        with pytest.raises(ValueError):
            s.put(a.union(b))
        with pytest.raises(KeyError):
            s.get(5)
        s.record_meta({"diameter": 9})
        assert s.dump().count() == 3
    more = FrameStore(spark, str(tmp_path / "t"), mode="append")
    more.put(a)
    more.put(a)
    assert more.get(0).count() == 4


def test_read_frames(spark, tmp_path):
    im = np.zeros((12, 10), dtype=np.uint8)
    im[5, 4] = 200
    np.save(tmp_path / "img_7.npy", im)
    (tmp_path / "img_8.pgm").write_bytes(b"P5\n# c\n10 12\n255\n" + im.tobytes())
    f = read_frames(spark, str(tmp_path))
    assert sorted((r.frame, tuple(r.shape)) for r in f.collect()) == [(7, (12, 10)), (8, (12, 10))]
    px = pixel_table(f)
    assert px.where("v = 200").count() == 2 and px.count() == 240
    assert batch(f, 3, separation=3).count() <= 2


@pytest.mark.parametrize("kind", ["png", "tiff"])
@pytest.mark.parametrize("bits", [8, 16, 24])
def test_image_formats(spark, tmp_path, kind, bits):
    """Images written by the JVM's own encoders come back as they were."""
    rng = np.random.default_rng(bits)
    im = (np.add.outer(np.arange(9), 3 * np.arange(7)) * 5 + rng.integers(0, 9, (9, 7))).astype(np.int64)
    im = im * 200 if bits == 16 else im
    jvm = spark._jvm
    kinds = jvm.java.awt.image.BufferedImage
    img = kinds(7, 9, {8: kinds.TYPE_BYTE_GRAY, 16: kinds.TYPE_USHORT_GRAY, 24: kinds.TYPE_INT_RGB}[bits])
    for y in range(9):
        for x in range(7):
            for band in range(3 if bits == 24 else 1):
                img.getRaster().setSample(x, y, band, int(im[y, x]) // (band + 1))
    file = tmp_path / f"img_3.{kind}"
    assert jvm.javax.imageio.ImageIO.write(img, kind, jvm.java.io.File(str(file)))
    got = decode(file.read_bytes())
    assert len(got) == 1 and got[0].dtype == (np.uint16 if bits == 16 else np.uint8)
    want = im if bits < 24 else np.rint(im * 0.2125 + (im // 2) * 0.7154 + (im // 3) * 0.0721)
    assert (got[0] == want).all()
    row = read_frames(spark, str(tmp_path)).first()
    assert row.frame == 3 and tuple(row.shape) == (9, 7)


def test_image_files_by_hand(spark, tmp_path):
    """Every line filter of PNG, pages and deflated strips of TIFF; and what isn't an image."""
    rng = np.random.default_rng(1)
    im = rng.integers(0, 256, (6, 5), dtype=np.uint8)

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    left, up = np.pad(im, ((0, 0), (1, 0)))[:, :-1].astype(int), np.pad(im, ((1, 0), (0, 0)))[:-1].astype(int)
    corner = np.pad(im, ((1, 0), (1, 0)))[:-1, :-1].astype(int)
    p = left + up - corner
    near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
    rules = [0 * left, left, up, (left + up) // 2, near, near]
    lines = b"".join(bytes([min(y, 4)]) + (im[y].astype(int) - rules[y][y]).astype(np.uint8).tobytes() for y in range(6))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (decode(png)[0] == im).all()

    pages, body = [im.astype("<f4"), (im * 2.5).astype("<f4")], b""
    at = 8
    for k, page in enumerate(pages):
        strip = zlib.compress(page.tobytes())
        tags = [(256, 3, 5), (257, 3, 6), (258, 3, 32), (259, 3, 8), (273, 4, at), (277, 3, 1), (278, 3, 6), (279, 4, len(strip)), (339, 3, 3)]
        entry = at + len(strip)
        after = entry + 2 + 12 * len(tags) + 4
        head = struct.pack("<I", entry) if k == 0 else b""
        body += strip + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, f, 1, v) for t, f, v in tags)
        following = after + len(zlib.compress(pages[1].tobytes()))
        body += struct.pack("<I", following if k == 0 else 0)
        first, at = (head if k == 0 else first), after
    got = decode(b"II*\0" + first + body)
    assert len(got) == 2 and all((a == b).all() for a, b in zip(got, pages))
    (tmp_path / "stack_4.tif").write_bytes(b"II*\0" + first + body)
    assert sorted(r.frame for r in read_frames(spark, str(tmp_path)).collect()) == [4, 5]
    with pytest.raises(ValueError):
        decode(b"GIF89a")


def test_stream(spark, tmp_path):
    def write(n, data):
        spark.createDataFrame(data, P).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    write(0, [(1, f, float(f), 0.0) for f in range(3)] + [(2, 0, 0.0, 0.0)])
    stream = spark.readStream.schema(P).parquet(str(tmp_path / "in"))
    out = link_stream(stream, ["movie"], 5.0, wait=36000)
    go = lambda: out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(once=True).start().awaitTermination(180)
    go()
    write(1, [(1, 3, 3.0, 0.0), (1, 4, 4.0, 0.0), (1, 0, 50.0, 50.0), (2, 1, 40.0, 0.0), (2, 2, 40.0, 0.0)])
    go()
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values(["movie", "frame"])
    one = got[got.movie == 1]
    assert one.frame.tolist() == [0, 1, 2, 3] and one.particle.nunique() == 1 and one.late.max() == 1
    assert got[got.movie == 2].particle.tolist() == [0, 1]


def test_scalar(spark):
    r = spark.createDataFrame([("0:37", "a12b"), ("2:05", "zz"), ("01:02:03", "7"), ("x", None), (None, "1")], "t string, s string")
    got = r.select(sc.lazy_timestamp(F.col("t")).alias("t"), sc.extract(r"(\d+)", F.col("s"), 1, "int").alias("n"), sc.seconds(sc.time_interval(F.col("t"))).alias("i")).collect()
    assert [(g.t, g.n, g.i) for g in got] == [("00:00:37", 12, None), ("00:02:05", None, None), ("01:02:03", 7, 3723.0), (None, None, None), (None, 1, None)]
    assert r.where("t is null or t <> 'x'").select(sc.lazy_timestamp(F.col("t"), strict=True)).count() == 4
    with pytest.raises(Exception, match="no time of day"):
        r.select(sc.lazy_timestamp(F.col("t"), strict=True)).collect()
    e = spark.createDataFrame([(-1000.0,), (0.0,), (float("nan"),), (None,)], "x double").select(sc.safe_exp(F.col("x")).alias("e")).collect()
    assert e[0].e == 0 and e[1].e == 1 and e[2].e != e[2].e and e[3].e is None
    fit = sc.fit_powerlaw(spark.createDataFrame([(float(x), 3.0 * x**2) for x in range(1, 6)], "x double, y double"), "x", "y").first()
    assert fit.n == pytest.approx(2) and fit.A == pytest.approx(3)
    w = sc.random_walk(spark.range(50).toDF("t"), "t", seed=1)
    assert w.count() == 50 and sc.validate_tuple(3, 2) == (3, 3) and sc.is_isotropic((1, 1))
    with pytest.raises(ValueError):
        sc.validate_tuple((1, 2, 3), 2)


def test_common(spark):
    checkpoint_ready(spark)
    assert spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    df = spark.range(5)
    assert free_name(df, "ID") != "ID" and small_side(df, 2) is df and small_side(df, 5).count() == 5


def test_api(spark):
    from motespark import api

    assert {"emsd", "link", "locate", "FrameStore", "rolling"} <= set(api.__all__)
    assert api.dependencies()["pyspark"] and api.performance_report(spark)["spark.master"].startswith("local")
