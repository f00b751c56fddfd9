import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from foliant.sources import files, sinks
from foliant.streaming import ingest


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def png(width, height, rgb):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + bytes(rgb) * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def tree(tmp_path):
    root = tmp_path / "raw"
    for label in ("cv", "email", "skip"):
        (root / label / "sub").mkdir(parents=True)
    (root / "cv" / "a.TXT").write_bytes(b"a\xffb " + b"x" * 30)
    (root / "cv" / "sub" / "b.docx").write_bytes(docx("one", "two"))
    (root / "cv" / "c.pdf").write_bytes(b"%PDF")
    (root / "cv" / "d.xyz").write_bytes(b"no")
    (root / "email" / "e.html").write_text("<script>x</script><p>hello &amp; bye</p>", encoding="utf-8")
    (root / "email" / "f.docx").write_bytes(b"broken")
    (root / "skip" / "g.txt").write_text("skipped")
    return str(root)


def test_scan_and_extract(spark, tmp_path):
    root = tree(tmp_path)
    nested = tmp_path / "x" / "raw" / "x" / "raw" / "cv" / "raw"
    nested.mkdir(parents=True)
    (nested / "a.txt").write_text("below folders of the root's name")
    again = files.scan_tree(spark, str(tmp_path / "x" / "raw" / "x" / "raw") + "/", ["cv", "none"]).collect()
    assert [(r.label, r.extension) for r in again] == [("cv", ".txt")]
    found = files.scan_tree(spark, root, ["cv", "email"])
    assert {r.path.rsplit("/", 1)[1] for r in found.select("path").collect()} == {"a.TXT", "b.docx", "c.pdf", "e.html", "f.docx"}
    assert files.scan_tree(spark, root, ["cv"], None).count() == 4
    assert files.scan_tree(spark, root + "-none", ["cv"]).count() == 0
    out = {r.path.rsplit("/", 1)[1]: r for r in files.extract_texts(found).collect()}
    assert out["a.TXT"].text == "ab " + "x" * 30 and out["a.TXT"].error is None and not out["a.TXT"].short
    assert out["b.docx"].text == "one two" and out["e.html"].text == "hello &amp; bye"
    assert "no extractor" in out["c.pdf"].error and out["f.docx"].error and out["f.docx"].short
    own = {r.path.rsplit("/", 1)[1]: r.text for r in files.extract_texts(found, {".pdf": lambda b: "a pdf"}).collect()}
    assert own["c.pdf"] == "a pdf"
    assert files.scan_external(spark, root, ["cv"]).select("sha256").first()[0] is not None
    up = files.extract_texts(files.from_bytes(spark, "x.html", b"<b>hi</b>")).first()
    assert up.text == "hi" and up.short


def test_each_file_is_read_once(spark, tmp_path):
    """The second reader gets what is too short and not native; its errors are the row's."""
    calls = str(tmp_path / "calls")

    def embedded(content):
        with open(calls, "a") as f:
            f.write("embedded\n")
        return content.decode()

    def image(path, content):
        with open(calls, "a") as f:
            f.write("image\n")
        if path.startswith("bad"):
            raise OSError("unreadable")
        return f"from the image of {path}, {len(content)} bytes"

    rows = [("a.pdf", ".pdf", b"long enough to be a text of its own"), ("b.pdf", ".pdf", b"short"), ("bad.pdf", ".pdf", b""), ("c.txt", ".txt", b"tiny"), ("d.txt", ".txt", b"\xff" + b"invalid bytes but long enough"), ("e.bin", ".bin", b"xyz"), ("n.pdf", ".pdf", None)]
    df = spark.createDataFrame(rows, "path string, extension string, content binary").coalesce(1)
    out = {r.path: r for r in files.extract_texts(df, {".pdf": embedded}, fallback=image).collect()}
    assert (out["a.pdf"].source, out["a.pdf"].short) == ("embedded", False)
    assert (out["b.pdf"].source, out["b.pdf"].text, out["b.pdf"].short) == ("fallback", "from the image of b.pdf, 5 bytes", True)
    assert out["bad.pdf"].error == "OSError: unreadable" and out["bad.pdf"].text == ""
    assert (out["c.txt"].source, out["c.txt"].text, out["c.txt"].short) == ("native", "tiny", True)
    assert out["d.txt"].text == "invalid bytes but long enough" and out["d.txt"].error is None
    assert out["e.bin"].error == "ValueError: no extractor for .bin" and out["e.bin"].source == "fallback"
    assert out["n.pdf"].text == "from the image of n.pdf, 0 bytes"
    assert open(calls).read().split() .count("embedded") == 4


def test_csv_types_are_inferred(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,share,name,ok,day\n1,0.5,\"a, b\nc\",true,2024-01-02\n2,,x,false,2024-01-03\n", encoding="utf-8-sig")
    df = files.read_csv(spark, str(tmp_path / "x.csv"))
    assert dict(df.dtypes) == {"id": "int", "share": "double", "name": "string", "ok": "boolean", "day": "date"}
    assert df.orderBy("id").first().name == "a, b\nc" and files.read_csv(spark, str(tmp_path / "none.csv")) is None
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "x.csv"), required=["nope"])


def test_images(spark, tmp_path):
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "x.png").write_bytes(png(4, 2, (255, 0, 0)))
    got = files.image_features(files.read_images(spark, str(tmp_path / "i")), size=2, mean=(0, 0, 0), std=(1, 1, 1)).first()
    assert got.features == [1.0] * 4 + [0.0] * 8
    w = files.resize_weights(4, 2)
    assert w.shape == (2, 4) and abs(w.sum() - 2) < 1e-12 and abs(w[0] @ [0, 1, 2, 3] - 0.7142857142857143) < 1e-12
    assert (files.resize_weights(3, 3) == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]).all()


def test_csv_and_sinks(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_bytes('\ufeffid,label\n1,"a ""b""\nc"\n2,\n'.encode())
    got = files.read_csv(spark, str(p), "id string, label string", ["id"]).orderBy("id").collect()
    assert got[0].label == 'a "b"\nc' and got[1].label is None
    assert files.read_csv(spark, str(tmp_path / "none.csv"), "id string") is None
    df = spark.createDataFrame([("m", 1, '{"a":1}', "r"), ("n", 2, "{}", "s")], "model string, model_idx int, json string, report string")
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).count() == 2
    sinks.write_text(df, str(tmp_path / "t"), "report")
    sinks.write_csv(df, str(tmp_path / "c"), single=True)
    assert spark.read.csv(str(tmp_path / "c"), header=True, escape='"').count() == 2
    sinks.write_splits(df.withColumn("split", F.lit("train")), str(tmp_path / "s"))
    sinks.write_labels(["b", "a"], str(tmp_path / "l"), spark)
    assert '"label_to_index":{"b":0,"a":1}' in spark.read.text(str(tmp_path / "l")).first()[0]
    metrics = files.read_metrics(spark, str(tmp_path / "nope.json"), ["a"])
    assert metrics is None
    (tmp_path / "x.json").write_text('{"accuracy": 0.5, "seconds_per_sample": 2.0, "per_class": {"a": {"f1": 1.0}}}')
    assert files.read_metrics(spark, str(tmp_path / "x.json"), ["a"]).first().seconds_per_document == 2.0


def test_stream_equals_batch(spark, tmp_path):
    src, dst, at = (str(tmp_path / n) for n in ("in", "out", "at"))
    rows = [(i, "a" if i % 2 else "b", "text number %d and more words" % (i % 5)) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, label string, text string")
    df.repartition(3).write.parquet(src)
    q = ingest.write_stream(ingest.prepared(ingest.stream_documents(spark, src, "id int, label string, text string")), dst, at)
    q.awaitTermination(60)
    want = {tuple(r) for r in ingest.prepared(df).select("id", "sha256", "issue").collect()}
    assert {tuple(r) for r in spark.read.parquet(dst).select("id", "sha256", "issue").collect()} == want


def test_stream_operators(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a", "x"), ("2024-01-01 00:01:00", "a", "x"), ("2024-01-01 00:02:00", "b", "long enough to be a usable text")]
    df = spark.createDataFrame(rows, "t string, label string, text string").withColumn("t", F.col("t").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = ingest.prepared(ingest.stream_documents(spark, str(tmp_path / "in"), "t timestamp, label string, text string"))
    for name, made, want in (("first", ingest.first_copies(stream, "t"), 2), ("counts", ingest.quality_counts(stream, "t", "label"), 0)):
        q = ingest.write_stream(made, str(tmp_path / name), str(tmp_path / f"{name}-at"))
        q.awaitTermination(60)
        assert spark.read.schema(made.schema).parquet(str(tmp_path / name)).count() >= want
