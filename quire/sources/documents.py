"""Reading document files: kinds by content, load errors as data, pages where a reader is registered."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.params import Documents, Routing
from quire.session import ship
from quire.sources import pdf, tiff

IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "webp", "tif", "tiff", "bmp")
#: The first bytes of each kind, in hexadecimal.
MAGIC = (("255044462D", "pdf"), ("89504E470D0A1A0A", "image"), ("FFD8FF", "image"), ("474946383761", "image"), ("474946383961", "image"), ("424D", "image"), ("49492A00", "image"), ("4D4D002A", "image"))
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "tif": "image/tiff", "tiff": "image/tiff", "bmp": "image/bmp", "pdf": "application/pdf"}
PAGES = "doc string, page_number bigint, width int, height int, dpi int, embedded_text string, image binary, error string"


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^/]\.([^./]*)$", 1))


def sniffed(content: Column, name: Column) -> Column:
    """``pdf``, ``image`` or ``unknown``: by content, and by extension only if the content says nothing."""
    head = F.hex(F.substring(content, 1, 12))
    kind = F.when(F.lit(False), "")
    for magic, k in MAGIC:
        kind = kind.when(head.startswith(magic), k)
    kind = kind.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image")
    return kind.when(extension(name) == "pdf", "pdf").when(extension(name).isin(*IMAGE_EXTENSIONS), "image").otherwise("unknown")


def load_error(content: Column, name: Column, rule: Documents = Documents()) -> Column:
    """Why a file can't be loaded (null: it can): empty, too large, or of no known kind."""
    size = F.coalesce(F.octet_length(content), F.lit(0))
    mb = size / (1024.0 * 1024.0)
    suffix = F.when(extension(name) == "", "(no extension)").otherwise(F.concat(F.lit("."), F.regexp_extract(name, r"[^/]\.([^./]*)$", 1)))
    return (
        F.when(size == 0, "The uploaded file is empty.")
        .when(mb > rule.max_file_mb, F.concat(F.lit("The file is "), F.format_string("%.1f", mb), F.lit(f" MB, above the {rule.max_file_mb:.0f} MB limit.")))
        .when(sniffed(content, name) == "unknown", F.concat(suffix, F.lit(" files are not supported. Supported types: PNG, JPG, WEBP, TIFF and PDF.")))
    )


#: The five kinds of load errors and what a user is told.
ERROR_TEXTS = {
    "unsupported": "That file type is not supported yet.",
    "corrupt": "The file appears to be damaged and could not be opened.",
    "too_large": "The file is larger than the configured limit.",
    "empty": "The document contains no pages to process.",
    "render": "The PDF could not be converted to images.",
}


def error_kind(content: Column, name: Column, pages: Column | None = None, reader_error: Column | None = None, rule: Documents = Documents()) -> Column:
    """The kind of load error (a key of ERROR_TEXTS, null: none): what the file shows, then what its reader said, then a document without pages."""
    size = F.coalesce(F.octet_length(content), F.lit(0))
    kind = sniffed(content, name)
    found = F.when(size == 0, "empty").when(size > rule.max_file_mb * 1024 * 1024, "too_large").when(kind == "unknown", "unsupported")
    if reader_error is not None:
        found = found.when(reader_error.isNotNull(), F.when(kind == "pdf", "render").otherwise("corrupt"))
    return found if pages is None else found.when(pages == 0, "empty")


def page_summary(pages: DataFrame) -> DataFrame:
    """What may be logged of a page: sizes and counts, never its text or image."""
    has = lambda c, t: F.col(c) if c in pages.columns else F.lit(None).cast(t)
    layer = F.coalesce("embedded_text", F.lit(""))
    image = has("image", "binary")
    return pages.select("doc", F.col("page_number").alias("page"), has("width", "int").alias("width"), has("height", "int").alias("height"), has("dpi", "int").alias("dpi"), F.octet_length(image).cast("bigint").alias("size_bytes"), layer.rlike(r"\S").alias("has_text_layer"), F.length(layer).cast("bigint").alias("embedded_text_chars"), image.isNotNull().alias("rendered"))


def mime_type(name: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for p in MIME.items() for x in p))
    return F.coalesce(pairs[extension(name)], F.lit("application/octet-stream"))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """All supported files under ``path`` with their contents: path, content, size_bytes, modified."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    supported = extension(F.col("path")).isin("pdf", *IMAGE_EXTENSIONS)
    return found.filter(supported).select("path", "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def described(found: DataFrame, rule: Documents = Documents()) -> DataFrame:
    """One row per file: name, kind, MIME type, size, checksum and load error; contents dropped."""
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(
        F.col("path").alias("doc"), name.alias("filename"), sniffed(F.col("content"), name).alias("kind"), mime_type(name).alias("mime_type"), "size_bytes", F.sha2("content", 256).alias("checksum"), load_error(F.col("content"), name, rule).alias("load_error")
    )


#: kind -> reader: (name, content, rule) -> iterator of page dicts with the columns of PAGES.
READERS: dict[str, Callable[[str, bytes, Documents], Iterator[dict]]] = {"pdf": pdf.read_pages}


def register_reader(kind: str, reader: Callable[[str, bytes, Documents], Iterator[dict]]) -> None:
    """Make files of a kind readable, or read another way: with a library that renders pages, say."""
    READERS[kind] = reader


def loaded_pages(found: DataFrame, rule: Documents = Documents()) -> DataFrame:
    """Pages of all loadable files through the registered readers; a file that fails is one row with its error."""
    ship(found.sparkSession)
    readers = dict(READERS)
    names = [c.split()[0] for c in PAGES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, kind, content in zip(batch["path"], batch["kind"], batch["content"], strict=True):
                try:
                    rows = list(readers[kind](path, bytes(content), rule))
                except KeyError:
                    rows = [{"error": f"no reader for {kind} files is registered"}]
                except Exception as e:  # noqa: BLE001 - one bad file is one bad row
                    rows = [{"error": f"could not be read: {e}"}]
                frame = pd.DataFrame([{n: r.get(n) for n in names} | {"doc": path} for r in rows], columns=names)
                yield frame.astype({c: "Int32" for c in ("width", "height", "dpi")} | {"page_number": "Int64"})

    kinds = found.withColumn("kind", sniffed(F.col("content"), F.col("path"))).filter(load_error(F.col("content"), F.col("path"), rule).isNull())
    return kinds.select("path", "kind", "content").mapInPandas(run, PAGES)


def pages_under(spark: SparkSession, path: str, rule: Documents = Documents()) -> DataFrame:
    """Pages of all PDF files and images under ``path``: PAGES' columns and ``ink`` (null: not measured)."""
    found = files(spark, path).withColumn("kind", sniffed(F.col("content"), F.col("path")))
    read = loaded_pages(found.filter("kind <> 'image'").drop("kind"), rule).withColumn("ink", F.lit(None).cast("double"))
    return read.unionByName(image_pages(spark, path, rule))


def image_pages(spark: SparkSession, path: str | list[str], rule: Documents = Documents(), routing: Routing = Routing()) -> DataFrame:
    """A page for every image under ``path``, decoded in the JVM: PAGES' columns (image: as PNG) and ``ink``.

    Images are flattened to red, green, blue and scaled down to the greatest dimension. One that
    can't be decoded is a row with an error and unknown ink. A TIFF file has a page for each frame.
    """
    ship(spark)
    kinds = ",".join(x for e in IMAGE_EXTENSIONS for x in (e, e.upper()))
    found = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{kinds}}}").option("dropInvalid", "false").load(path).select("image.*")
    # the image source names local files file:///, the binary one, as all other tables here, file:/
    found = found.withColumn("origin", F.regexp_replace("origin", "^file:///(?!/)", "file:/"))
    names = [*(c.split()[0] for c in PAGES.split(", ")), "ink"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for origin, height, width, channels, data in zip(batch["origin"], batch["height"], batch["width"], batch["nChannels"], batch["data"], strict=True):
                if height <= 0 or width <= 0 or channels not in (1, 3, 4):
                    rows.append({"doc": origin, "page_number": 1, "embedded_text": "", "error": ERROR_TEXTS["corrupt"]})
                    continue
                rows.append({"doc": origin, "page_number": 1, **page_of(np.frombuffer(data, np.uint8).reshape(height, width, channels), rule, routing)})
            frame = pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names)
            yield frame.astype({c: "Int32" for c in ("width", "height", "dpi")} | {"page_number": "Int64", "ink": "float64"})

    first = found.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, f"{PAGES}, ink double")
    return first.unionByName(further_frames(spark, path, rule, routing))


def page_of(pixels: np.ndarray, rule: Documents, routing: Routing) -> dict:
    """Columns of a page of decoded pixels (grey, blue-green-red or with opacity), scaled down to the greatest dimension."""
    pixels = flattened(pixels)
    height, width = pixels.shape[:2]
    if max(width, height) > rule.max_dimension:
        scale = rule.max_dimension / max(width, height)
        pixels = scaled(pixels, max(1, int(width * scale)), max(1, int(height * scale)))
    return {"width": pixels.shape[1], "height": pixels.shape[0], "embedded_text": "", "image": png(pixels), "ink": ink_of(pixels, routing.ink_threshold, routing.thumbnail)}


def further_frames(spark: SparkSession, path: str | list[str], rule: Documents = Documents(), routing: Routing = Routing()) -> DataFrame:
    """Pages of the frames after the first of TIFF files: a row a frame with its bytes alone, dealt out, then decoded.

    Grey, palette and colour frames of 1 or 8 bits in strips are read, plain, deflated or in packed
    runs; a frame of another kind, or a damaged one, is a row with its error, never left out. The
    first frames are those of Spark's own image source, which reads no others.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{tif,tiff,TIF,TIFF}").load(path).select("path", "content")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, content in zip(batch["path"], batch["content"], strict=True):
                number = 0
                try:
                    for number, tags in enumerate(tiff.frames(content), 1):
                        if number > 1:
                            yield pd.DataFrame([{"doc": doc, "frame": number, "tags": json.dumps(tags), "strips": tiff.strips(content, tags), "error": None}])
                except (struct.error, ValueError) as e:
                    # without a directory at all the first frame says so
                    if number:
                        yield pd.DataFrame([{"doc": doc, "frame": number + 1, "tags": None, "strips": None, "error": f"{ERROR_TEXTS['corrupt']} ({e})"}])

    names = [*(c.split()[0] for c in PAGES.split(", ")), "ink"]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                row = {"doc": r.doc, "page_number": r.frame, "embedded_text": "", "error": r.error}
                if r.tags is not None:
                    try:
                        row |= page_of(tiff.pixels({int(k): v for k, v in json.loads(r.tags).items()}, r.strips), rule, routing)
                    except (ValueError, KeyError, zlib.error) as e:
                        row["error"] = f"{ERROR_TEXTS['corrupt']} ({e})"
                frame = pd.DataFrame([{n: row.get(n) for n in names}], columns=names)
                yield frame.astype({c: "Int32" for c in ("width", "height", "dpi")} | {"page_number": "Int64", "ink": "float64"})

    each = found.mapInPandas(split, "doc string, frame bigint, tags string, strips array<binary>, error string")
    return each.repartition("doc", "frame").mapInPandas(decode, f"{PAGES}, ink double")


def png(pixels: np.ndarray) -> bytes:
    """Red, green, blue pixels as a PNG file."""
    height, width, _ = pixels.shape
    lines = np.zeros((height, 1 + 3 * width), np.uint8)  # each line begins with a zero: no filter
    lines[:, 1:] = pixels.reshape(height, -1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def flattened(pixels: np.ndarray) -> np.ndarray:
    """Red, green, blue of grey, blue-green-red, or the same with opacity (over white)."""
    if pixels.shape[2] == 1:
        return np.repeat(pixels, 3, axis=2)
    colours = pixels[:, :, 2::-1]
    if pixels.shape[2] == 3:
        return np.ascontiguousarray(colours)
    opacity = pixels[:, :, 3:].astype(np.float64) / 255
    return np.rint(colours * opacity + 255 * (1 - opacity)).astype(np.uint8)


def scaled(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """``pixels`` at another size; each new pixel is a mean weighted by a triangle as wide as the old pixels that it covers."""

    def weights(old: int, new: int) -> np.ndarray:
        step = old / new
        middle = (np.arange(new)[:, None] + 0.5) * step
        w = np.maximum(0, 1 - np.abs((np.arange(old)[None, :] + 0.5 - middle) / max(step, 1)))
        return w / w.sum(axis=1, keepdims=True)

    x = np.tensordot(weights(pixels.shape[0], height), pixels.astype(np.float64), (1, 0))
    x = np.tensordot(weights(pixels.shape[1], width), x, (1, 1)).swapaxes(0, 1)
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def ink_of(pixels: np.ndarray, threshold: int = 200, side: int = 200) -> float | None:
    """Share of dark pixels of a page in grey, scaled down to ``side``; None without pixels."""
    if not pixels.size:
        return None
    grey = np.rint(pixels.astype(np.float64) @ [0.299, 0.587, 0.114])
    factor = min(1.0, side / max(grey.shape))
    if factor < 1:
        grey = scaled(grey[:, :, None], max(1, round(grey.shape[1] * factor)), max(1, round(grey.shape[0] * factor)))[:, :, 0]
    return float((grey <= threshold).mean())


def base64_image(image: str) -> Column:
    return F.base64(F.col(image))


def document_text(pages: DataFrame) -> DataFrame:
    """Per document: pages, whether any layer has text, and the non-blank layers joined by blank lines."""
    some = F.col("embedded_text").isNotNull() & F.col("embedded_text").rlike(r"\S")
    parts = F.array_sort(F.collect_list(F.when(some, F.struct("page_number", "embedded_text"))))
    return pages.groupBy("doc").agg(F.count("*").alias("pages"), F.bool_or(some).alias("has_text_layer"), F.array_join(F.transform(parts, lambda p: p["embedded_text"]), "\n\n").alias("text"))
