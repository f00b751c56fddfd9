"""Document collections from file trees, and the tables around them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import IMAGE_TYPES, MIN_CHARS, TEXT_TYPES, clean_text, extension, path_order, strip_html
from foliant.operators.tables import require_columns

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"
#: A function from a file's bytes to its text, by extension; what isn't here fails row by row.
Extractors = dict[str, Callable[[bytes], str]]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as file sources name it, with its scheme."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def scan_tree(spark: SparkSession, root: str, labels: list[str], types: tuple[str, ...] | None = TEXT_TYPES, missing: str = "empty", content: bool = True) -> DataFrame:
    """Files below root/label: path, label, extension, length and content, with the place in path order left to the caller.

    types None: any file. Only the labels' folders are listed; a label without a folder has no rows; a missing root gives an empty
    table or raises (missing="raise"). Files that can't be read are skipped. The content column isn't read where it isn't selected.
    """
    if missing == "raise" and not exists(spark, root):
        raise FileNotFoundError(root)
    folders = [f"{root.rstrip('/')}/{x}" for x in labels]
    folders = [f for f in folders if exists(spark, f)]
    if not folders:
        return spark.createDataFrame([], "path string, label string, extension string, length bigint" + (", content binary" if content else ""))
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)
    above = len(qualified(spark, root.rstrip("/"))) + 1
    label = F.substring_index(F.substring(F.col("path"), above + 1, 1 << 30), "/", 1)
    out = reader.load(folders).select("path", label.alias("label"), extension(F.col("path")).alias("extension"), "length", *(["content"] if content else []))
    return out if types is None else out.where(F.col("extension").isin(*types))


def scan_external(spark: SparkSession, root: str, labels: list[str]) -> DataFrame:
    """PDF and image files with their hash; a missing root raises."""
    return scan_tree(spark, root, labels, IMAGE_TYPES, "raise").withColumn("sha256", F.sha2("content", 256))


def in_path_order(df: DataFrame, path: str = "path") -> DataFrame:
    return df.orderBy(path_order(F.col(path)))


def read_csv(spark: SparkSession, path: str, schema: str | None = None, required: list[str] | None = None, share: float = 1.0) -> DataFrame | None:
    """A CSV with a header; a byte order mark and quoted line breaks are understood. None where there is no such file. Without a schema the
    columns' types (whole numbers, doubles, dates, timestamps, booleans, else text) are inferred in a pass of their own over a share of the rows."""
    if not exists(spark, path):
        return None
    typed = {"inferSchema": True, "samplingRatio": share} if schema is None else {"schema": schema}
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8", **typed)
    return require_columns(df, required) if required else df


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    return spark.read.json(path, schema=schema, multiLine=True) if exists(spark, path) else None


def read_metrics(spark: SparkSession, path: str, classes: list[str]) -> DataFrame | None:
    """A metrics document; seconds_per_sample is read as seconds_per_document."""
    per = "struct<precision:double,recall:double,f1:double,support:bigint>"
    schema = f"accuracy double, macro_precision double, macro_recall double, macro_f1 double, loss double, seconds_per_document double, seconds_per_sample double, per_class map<string,{per}>"
    df = read_json(spark, path, schema)
    return None if df is None else df.withColumn("seconds_per_document", F.coalesce("seconds_per_document", "seconds_per_sample")).drop("seconds_per_sample")


def from_bytes(spark: SparkSession, name: str, content: bytes) -> DataFrame:
    """One uploaded file as a one-row table, without a temporary file."""
    return spark.createDataFrame([(name, bytearray(content))], "path string, content binary").withColumn("extension", extension(F.col("path")))


def decode_lossy(content: bytes) -> str:
    return content.decode("utf-8", "ignore")


def docx_text(content: bytes) -> str:
    """The texts of the body's paragraphs, one to a line; tables, headers and footers aren't read."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    lines = []
    for p in body.findall(f"{w}p") if body is not None else []:
        parts = []
        for node in p.iter():
            if node.tag == f"{w}t":
                parts.append(node.text or "")
            elif node.tag in (f"{w}tab",):
                parts.append("\t")
            elif node.tag in (f"{w}br", f"{w}cr"):
                parts.append("\n")
        lines.append("".join(parts))
    return "\n".join(lines)


def extract_texts(files: DataFrame, extractors: Extractors | None = None, least: int = MIN_CHARS, fallback: Callable[[str, bytes], str] | None = None) -> DataFrame:
    """Adds text, error, short and source to files (path, extension, content), reading each file once.

    Text and HTML with valid UTF-8 are decoded in the JVM, and their bytes aren't sent to Python. The other bytes are read there, in the same pass in Arrow batches: invalid bytes are
    dropped, DOCX is read with the standard library, and PDF, images and the rest need an extractor, without which the row gets
    an error and an empty text. fallback, as a reader of images would be, gets path and bytes of the rows whose text is too short and not native; source says
    whose text it is, and short whether the first reader's was too short. An error of the fallback is the row's.
    """
    known: Extractors = {".txt": decode_lossy, ".html": decode_lossy, ".htm": decode_lossy, ".docx": docx_text, **(extractors or {})}
    others = [c for c in files.columns if c != "content"]
    native = F.coalesce(F.col("extension").isin(".txt", ".html", ".htm") & F.is_valid_utf8(F.col("content").cast("string")), F.lit(False))

    def read(path: str, kind: str, content: bytes) -> tuple[str, str | None, bool, str]:
        text, error = "", None
        try:
            if kind not in known:
                raise ValueError(f"no extractor for {kind or 'files without extension'}")
            text = known[kind](content)
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
        short = len(" ".join(text.replace("\0", " ").split())) < least
        if not short or fallback is None:
            return text, error, short, "embedded"
        try:
            return fallback(path, content), error, short, "fallback"
        except Exception as e:
            return text, f"{type(e).__name__}: {e}", short, "fallback"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(raw, None, False, "native") if content is None else read(path, kind, bytes(content)) for path, kind, raw, content in zip(b["path"], b["extension"], b["raw"], b["content"], strict=True)]
            raw, error, short, source = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
            yield b.drop(columns=["content", "raw"]).assign(raw=raw, error=error, first_short=short, source=source)

    sent = files.select(*others, F.when(native, F.col("content").cast("string")).alias("raw"), F.when(~native, F.coalesce("content", F.lit("").cast("binary"))).alias("content"))
    schema = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in others) + ", raw string, error string, first_short boolean, source string"
    out = sent.mapInPandas(run, schema)
    text = F.when(F.col("extension").isin(".html", ".htm") & (F.col("source") != "fallback"), strip_html(F.col("raw"))).otherwise(clean_text(F.col("raw")))
    short = F.when(F.col("source") == "fallback", F.col("first_short")).otherwise(F.length("text") < least)
    return out.withColumn("text", text).withColumn("short", short).drop("raw", "first_short")


def with_fallback(df: DataFrame, embedded: str, ocr: Callable[[DataFrame], DataFrame], least: int = MIN_CHARS) -> DataFrame:
    """OCR, as a function of a table, on those rows only whose embedded text is too short; the two branches are united by name. df is read by both,
    so give a written table; where the second reader is a function of bytes, ``extract_texts(fallback=...)`` needs one pass alone."""
    enough = F.length(clean_text(F.col(embedded))) >= least
    return df.where(enough).unionByName(ocr(df.where(~enough)))


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Images by Spark's own reader; the bytes are BGR, three to a pixel."""
    return spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(root).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")


def resize_weights(length: int, size: int) -> np.ndarray:
    """[size, length]: each output pixel as a weighted mean of input pixels, linear in their distance; wider where pixels are lost."""
    scale = length / size
    reach = max(scale, 1.0)
    near = np.clip(1 - np.abs((np.arange(length) + 0.5)[None, :] - ((np.arange(size) + 0.5) * scale)[:, None]) / reach, 0, None)
    return near / near.sum(axis=1, keepdims=True)


def image_features(images: DataFrame, size: int = 224, mean: tuple[float, ...] = (0.485, 0.456, 0.406), std: tuple[float, ...] = (0.229, 0.224, 0.225)) -> DataFrame:
    """Red, green and blue planes of size x size by bilinear resizing, scaled to 0..1 and normalised by channel, as a list of doubles.

    The defaults are the fixed values of the usual image models.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, w, c, data in zip(b["height"], b["width"], b["nChannels"], b["data"], strict=True):
                x = np.frombuffer(data, np.uint8).reshape(h, w, c)
                x = (np.repeat(x, 3, axis=2) if c == 1 else x[:, :, 2::-1]) / 255.0
                planes = resize_weights(h, size) @ x.transpose(2, 0, 1) @ resize_weights(w, size).T
                out.append(((planes - np.array(mean)[:, None, None]) / np.array(std)[:, None, None]).ravel().tolist())
            yield pd.DataFrame({"origin": b["origin"], "features": out})

    return images.mapInPandas(run, "origin string, features array<double>")
