"""Legacy archives: writing and reading ARC, converting it to WARC, writing and reading WARC.

An ARC file is a row of records, each a header line, the declared number of bytes, and a line end.
Its first record, ``filedesc://``, names the version and the fields of the header lines; version 1
has five, version 2 ten. The converter parses the lines by those names, takes each block by its
declared length, and synthesises what WARC wants and ARC lacks: a record id (a name-based UUID of
the record's place and contents), an ISO timestamp from the 14 digits, a record type, and digests.

Records are packed into rows of about ``FILE_BYTES``, one record at least, and Spark's text writer
makes a file of each row, so any store that Spark writes to can hold them and a file is bounded by
its bytes, however long single payloads are. Files are read whole, one a row.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import work_dir, written

#: Bytes of records that an archive file holds, about (before compression).
FILE_BYTES = 8 << 20
#: Repeated payloads' digests that are broadcast at most, about 150 bytes each; beyond, records are joined.
BROADCAST_DIGESTS = 100_000
#: Digests that more than such a share of all repeats have are broadcast where the others are too many.
HOT_SHARE = 64
#: Bytes of a gzipped file that are handed to a member at once.
MEMBER_BYTES = 1 << 14
#: Bytes of blocks that are handed to Spark at once, about.
BATCH_BYTES = 4 << 20
#: Equal payloads below this many bytes are kept as responses.
REVISIT_BYTES = 100

#: Fixed values of the formats: header fields of ARC versions 1 and 2, and the WARC terms used.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"

ARC_SCHEMA = "archive string, place long, url string, ip string, date string, content_type string, http_head string, payload string, is_http boolean"
WARC_SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, payload_digest string, http_head string, payload string, payload_bytes long, refers_to long, page_id long"


# --- ARC ----------------------------------------------------------------------------------------


def _packed(batches: Iterator[pa.RecordBatch], file_bytes: int, separator: bytes, lead) -> Iterator[pa.RecordBatch]:
    """Records, a row each, to files, a row each: ``lead(number)``, then records with separators between, up to about ``file_bytes``."""
    held, size, number = [], 0, 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array([separator.join([*lead(number), *held])], pa.binary()).cast(pa.string())], ["value"])

    for batch in batches:
        for record in batch.column(0):
            record = record.as_buffer().to_pybytes()
            if held and size + len(record) > file_bytes:
                yield out()
                held, size, number = [], 0, number + 1
            held.append(record)
            size += len(record)
    if held:
        yield out()


def _write(files: DataFrame, path: str, end: str) -> None:
    """A gzipped file of every row; archives are written once and read once here, so speed counts more than size."""
    files.write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 1).text(path)


def arc_files(pages: DataFrame, path: str, *, version: int = 1, captured: str = "20240101000000", file_bytes: int = FILE_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as gzipped ARC files of one ``version`` under ``path``.

    The block of a page is an HTTP response; its page_id travels in the header X-Page-Id. Null html
    is an empty payload, a null page_id has no such header, a null url is ``about:blank``; white
    space in a url is percent-encoded, since fields are cut at spaces. A file's description names it
    by task and number, so that reruns over the same table give the same archives.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    n = F.octet_length(payload)
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n.cast("string"), F.coalesce(F.concat(F.lit("\r\nX-Page-Id: "), F.col("page_id").cast("string")), F.lit("")), F.lit("\r\n\r\n")
    )
    url = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\s\x00-\x20]", "%20")
    url = F.when(url == "", "about:blank").otherwise(url)
    lead = [url, F.lit("0.0.0.0"), F.lit(captured), F.lit("text/html")] + ([F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), F.lit("-")] if version == 2 else [])
    record = F.concat(F.concat_ws(" ", *lead, (n + F.octet_length(head)).cast("string")), F.lit("\n"), head, payload)
    about = f"{version} 0 quire\n{' '.join(ARC_FIELDS[version])}\n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()

        def first(number: int) -> list[bytes]:
            name = f"{task:05d}-{number:05d}.arc"
            return [f"filedesc://{name} 0.0.0.0 {captured} text/plain {f'200 - - 0 {name} ' if version == 2 else ''}{len(about)}\n{about}".encode()]

        yield from _packed(batches, file_bytes, b"\n", first)

    _write(pages.select(record.alias("value")).mapInArrow(run, "value string"), path, "\n")


def inflated(data: bytes, strict: bool = True) -> bytes:
    """The contents of a plain file or of all members of a gzipped one.

    A member that is damaged or cut off is an error; without ``strict`` what could be read up to
    there is given. What follows the last member is left out.
    """
    if data[:2] != b"\x1f\x8b":
        return data
    whole, parts, at = memoryview(data), [], 0
    while data[at : at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof and at < len(data):  # a part at a time: what a member leaves of it is copied
            fed = whole[at : at + MEMBER_BYTES]
            try:
                parts.append(member.decompress(fed))
            except zlib.error:
                if strict:
                    raise
                return b"".join(parts)
            at += len(fed) - len(member.unused_data)
        if not member.eof and strict:
            raise ValueError("the last gzip member is cut off")
    return b"".join(parts)


def arc_records(data: bytes, strict: bool = True) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields by name, block) of each record; a description in front says which fields there are.

    A line that has more words than fields has them in its URL. A line that isn't a header or whose
    declared length isn't there is an error; without ``strict`` what follows up to the next line
    that is a header is left out.
    """
    at, fields, first = 0, None, True
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if not line.strip():
            at = end + 1
            continue
        words = line.split(" ")
        names = fields or (ARC_FIELDS[2] if len(words) >= 10 else ARC_FIELDS[1])
        size = int(words[-1]) if words[-1].isdigit() and len(words) >= len(names) else None
        if size is None or end + 1 + size > len(data):
            if strict:
                raise ValueError(f"no ARC record at byte {at}: {line[:100]!r}")
            at = end + 1
            continue
        cut = len(words) - len(names) + 1
        header = dict(zip(names, [" ".join(words[:cut]), *words[cut:]], strict=True))
        if not strict and not header["Archive-date"].isdigit():
            at = end + 1
            continue
        block = data[end + 1 : end + 1 + size]
        if first and header["URL"].startswith("filedesc:"):
            lines = block.decode("utf-8", "replace").split("\n")
            named = [x for x in lines if x.startswith("URL ")]
            version = int(lines[0].split(" ")[0]) if lines[0][:1].isdigit() else 1
            fields = named[0].strip().split(" ") if named else ARC_FIELDS.get(version, ARC_FIELDS[1])
        yield at, header, block
        first, at = False, end + 1 + size
        if data[at : at + 1] == b"\n":
            at += 1


def read_arc(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The records of all files under ``path``, in folders too, descriptions left out; a path that was never written fails as Spark does.

    Files are plain or gzipped, whatever their names, but for those that begin with a dot or an
    underscore, which Spark leaves out. A file that is no ARC file fails the read; without ``strict``
    it has no records. ``archive`` is the name that a file's description gives it, or its own.
    """

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, size = [], 0
                name = name.rsplit("/", 1)[-1]
                for n, (at, h, block) in enumerate(arc_records(inflated(data.as_py(), strict), strict)):
                    if not n and h["URL"].startswith("filedesc:"):
                        name = h["URL"].removeprefix("filedesc:").strip("/") or name
                        continue
                    http = block.startswith(b"HTTP/")
                    cut = block.find(b"\r\n\r\n") if http else -1
                    head, body = (block[: cut + 4], block[cut + 4 :]) if cut >= 0 else (b"", block)
                    rows.append((name, at, h["URL"], h["IP-address"], h["Archive-date"], h["Content-type"], head.decode("utf-8", "replace"), body.decode("utf-8", "replace"), http))
                    size += len(block)
                    if len(rows) == 512 or size > BATCH_BYTES:
                        yield _batch(rows, _ARC)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, _ARC)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, ARC_SCHEMA)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_ARC = pa.schema([("archive", pa.string()), ("place", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("http_head", pa.string()), ("payload", pa.string()), ("is_http", pa.bool_())])
_WARC = pa.schema(
    [("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("payload_digest", pa.string()), ("http_head", pa.string()), ("payload", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("page_id", pa.int64())]
)


# --- conversion ---------------------------------------------------------------------------------


def record_uuid(*parts: Column | str) -> Column:
    """``<urn:uuid:...>``: a name-based identifier (version 8 layout over SHA-256) of ``parts``."""
    h = F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256)
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-8"), cut(14, 3), F.lit("-a"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))


def arc_to_warc(arc: DataFrame, revisit_bytes: int = REVISIT_BYTES, broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """WARC fields for every ARC record (WARC_SCHEMA).

    Type: http blocks are responses, others resources. Of records with equal payloads of at least
    ``revisit_bytes`` bytes the one with the smallest page id (then record id; ids that are missing
    last) stays, the others are revisits of it, keep their HTTP head and lose the payload.

    A first pass over the archives groups digests and ids, by partial sums, so a payload that a
    third of the records share needs no large task; it leaves a table of the payloads that repeat.
    If this has up to ``broadcast_digests`` rows it is broadcast and payloads aren't shuffled.
    Otherwise the ids of the records that become revisits are found by a join without payloads,
    in which digests of more than a HOT_SHARE-th of all repeats, fewer than HOT_SHARE, are
    broadcast; records then meet their new types by id, evenly.
    """
    date = F.regexp_replace(F.rpad(F.coalesce("date", F.lit("")), 14, "0"), r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2}).*$", "$1-$2-$3T$4:$5:$6Z")
    page = F.expr("try_cast(nullif(regexp_extract(http_head, '(?m)^X-Page-Id: (-?[0-9]+)\\r?$', 1), '') as bigint)")
    rows = arc.select(
        record_uuid("archive", F.col("place"), F.col("url"), F.col("date")).alias("record_id"),
        F.when(F.col("is_http"), "response").otherwise("resource").alias("record_type"),
        F.col("url").alias("target_uri"),
        date.alias("warc_date"),
        F.sha2(F.col("payload").cast("binary"), 256).alias("payload_digest"),
        "http_head",
        "payload",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        page.alias("page_id"),
    )
    may = (F.col("payload_bytes") >= revisit_bytes) & (F.col("record_type") == "response")
    first = F.min(F.struct(F.col("page_id").isNull().alias("u"), "page_id", "record_id"))
    marks = rows.filter(may).select("record_id", "payload_digest", "page_id")
    firsts = written(marks.groupBy("payload_digest").agg(F.count("*").alias("n"), first.alias("first")).filter("n > 1").select("payload_digest", "n", F.col("first.record_id").alias("first_id"), F.col("first.page_id").alias("first_page")), "repeats")
    if firsts.count() <= broadcast_digests:
        out = rows.join(F.broadcast(firsts), "payload_digest", "left")
        revisit = may & (F.col("first_id") != F.col("record_id"))
    else:
        hot = F.col("n") > firsts.agg(F.sum("n")).first()[0] // HOT_SHARE
        few = F.broadcast(firsts.filter(hot))
        cold = marks.join(few.select("payload_digest"), "payload_digest", "left_anti").join(firsts.filter(~hot), "payload_digest")
        again = marks.join(few, "payload_digest").unionByName(cold).filter("record_id <> first_id").select("record_id", "first_id", "first_page")
        out = rows.join(again, "record_id", "left")
        revisit = F.col("first_id").isNotNull()
    revisit = F.coalesce(revisit, F.lit(False))
    return out.select(
        "record_id",
        F.when(revisit, "revisit").otherwise(F.col("record_type")).alias("record_type"),
        "target_uri",
        "warc_date",
        "payload_digest",
        "http_head",
        F.when(revisit, "").otherwise(F.col("payload")).alias("payload"),
        "payload_bytes",
        F.when(revisit, F.col("first_page")).alias("refers_to"),
        "page_id",
    )


# --- WARC ---------------------------------------------------------------------------------------


def warc_files(records: DataFrame, path: str, *, file_bytes: int = FILE_BYTES) -> None:
    """Write records (WARC_SCHEMA) as gzipped WARC files under ``path``."""
    block = F.concat("http_head", "payload")
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    revisit = F.col("record_type") == "revisit"
    kind = F.when(F.col("record_type") == "resource", "text/html").otherwise("application/http; msgtype=response")
    head = F.concat(
        F.lit(WARC_VERSION + "\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("warc_date")),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))),
        line("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        line("X-Refers-To-Page-Id", F.col("refers_to").cast("string")),
        line("X-Payload-Bytes", F.col("payload_bytes").cast("string")),
        line("Content-Type", kind),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    files = records.select(F.concat(head, block).alias("value")).mapInArrow(lambda batches: _packed(batches, file_bytes, RECORD_END.encode(), lambda _: []), "value string")
    _write(files, path, RECORD_END)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record, by declared lengths; what is no record is an error."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}: {data[at:at + 100]!r}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(header["content-length"])
        if end + 4 + n > len(data):
            raise ValueError(f"the WARC record at byte {at} is shorter than it says")
        yield header, data[end + 4 : end + 4 + n]
        at = end + 4 + n
        while data.startswith(b"\r\n", at):
            at += 2


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files under ``path``, in folders too (WARC_SCHEMA); they are plain or gzipped WARC files, whatever their names.

    The digest of a payload that is there is computed again; a record whose digest doesn't match
    fails the read. A revisit has the digest and the length of the payload that it refers to.
    """

    def run(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows, size = [], 0
                for h, block in warc_records(inflated(data.as_py())):
                    kind, digest = h["warc-type"], h.get("warc-payload-digest", "").removeprefix("sha256:")
                    cut = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -1
                    head, body = (block[: cut + 4], block[cut + 4 :]) if cut >= 0 else (b"", block)
                    fields = dict(x.partition(": ")[::2] for x in head.decode("utf-8", "replace").split("\r\n"))
                    if kind != "revisit" and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"payload digest of {h['warc-record-id']} doesn't match")
                    n = len(body) if kind != "revisit" else int(fields["Content-Length"])
                    refers, page = h.get("x-refers-to-page-id"), fields.get("X-Page-Id")
                    rows.append((h["warc-record-id"], kind, h.get("warc-target-uri"), h.get("warc-date"), digest, head.decode("utf-8", "replace"), body.decode("utf-8", "replace"), n, None if refers is None else int(refers), None if page is None else int(page)))
                    size += len(block)
                    if len(rows) == 512 or size > BATCH_BYTES:
                        yield _batch(rows, _WARC)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, _WARC)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, WARC_SCHEMA)


def archived(pages: DataFrame, *, version: int = 1) -> DataFrame:
    """Write ``pages`` as ARC, convert the archives to WARC, and return the WARC records read back.

    One record per row of ``pages``, repeats included; null html is an empty payload; an empty table
    gives no record. Columns beyond page_id, url and html are ignored.
    """
    spark = pages.sparkSession
    base = f"{work_dir(spark)}/archive-{uuid.uuid4().hex}"
    arc_files(pages.select("page_id", "url", "html"), f"{base}/arc", version=version)
    warc_files(arc_to_warc(read_arc(spark, f"{base}/arc")), f"{base}/warc")
    return read_warc(spark, f"{base}/warc")


