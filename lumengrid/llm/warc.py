"""WARC archives: writing captures, reading records, and assembling transactions.

Every capture is a request, a response (or a revisit of a response with the same payload) and a
metadata record; request and metadata name the response in WARC-Concurrent-To. Archives are gzip
files of Spark's text writer whose line separator is the end of a record, so that the commit protocol
keeps them whole when executors are lost. They are read as a stream of pieces between those
separators, put together again by Content-Length, with one record in memory at a time. Field names may have any
case and need no space after the colon, long fields may be folded. A record that its file ends in comes out with what there is of
it, and `intact` false.

Of captures with equal payloads of at least `least` bytes the one with the smallest id is the response.
Nulls: a null payload is empty; a null URL leaves out WARC-Target-URI; a null id is a value of its own.
Rows that repeat both id and payload are one capture, with the smallest URL; of equal payloads the smallest id
is the response. Very long payloads are one record, held in memory once. An empty table gives archives without
records and an empty result. Line breaks in URLs are percent-encoded. Only the three columns named are
read, so that others may have any name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumengrid.llm.common import BROADCAST_ROWS, join_split, materialise, small_batches

END = "\r\n\r\n"
#: Captures in one archive file at most.
CAPTURES_A_FILE = 20_000
#: Parts in which the rows of one payload are dealt.
SALTS = 16
RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("record_id", "type", "date", "target_uri", "concurrent_to", "refers_to", "content_type")]
    + [T.StructField("fields", T.MapType(T.StringType(), T.StringType()))]
    + [T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("intact", T.BooleanType()), T.StructField("payload", T.BinaryType())]
)


def base32_sha1(column: F.Column) -> F.Column:
    """Upper-case base32 of the SHA-1: each ten hexadecimal digits are eight base32 digits."""
    digest = F.sha1(column)
    parts = [F.lpad(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(kind: str, *parts: str | F.Column) -> F.Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("\0")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for k, (a, n) in enumerate([(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]) for x in ([F.lit("-")] if k else []) + [F.substring(h, a, n)]], F.lit(">"))


def _record(kind: F.Column | str, headers: list[tuple[str, F.Column]], block: F.Column) -> F.Column:
    """One record without its end; headers that are null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write(pages: DataFrame, path: str, id_column: str = "page_id", url: str = "url", html: str = "html", least: int = 0, date: str = "2020-01-01T00:00:00Z") -> None:
    """Write the captures of all rows as archives in the folder `path`."""
    df = pages.select(F.col(id_column).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    df = df.withColumn("digest", base32_sha1(F.col("html")))
    captures = df.groupBy("id", "digest").agg(F.count("*").alias("copies"), F.max(F.octet_length("html")).alias("size"))
    by_digest = captures.groupBy("digest").agg(F.min("id").alias("first"), F.sum("copies").alias("n"), F.max("copies").alias("copies"), F.max("size").alias("size"))
    shared = materialise(by_digest.where("n > 1").drop("n"))
    if shared.where("copies > 1").limit(1).count():  # one capture for rows that repeat id and payload
        df = df.groupBy("id", "digest").agg(F.min("url").alias("url"), F.first("html").alias("html"))
    repeated = shared.where(F.col("size") >= least).select("digest", "first")
    if (n := repeated.count()) > 0:
        if n <= BROADCAST_ROWS:
            df = df.join(F.broadcast(repeated), "digest", "left")
        else:  # one payload may be that of very many rows
            df = df.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
            repeated = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            df = df.join(repeated, ["digest", "salt"], "left").drop("salt")
    else:
        df = df.withColumn("first", F.lit(None).cast("long"))
    revisit = F.coalesce((F.octet_length("html") >= least) & (F.col("id") != F.col("first")), F.lit(False))
    df = df.withColumn("revisit", revisit).withColumn("own", _record_id("response", "id", "digest"))
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    when, uri = ("WARC-Date", F.lit(date)), ("WARC-Target-URI", target)
    host = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(target, F.lit("")), r"^[a-z]+://([^/?#]*)", 1), F.lit("")), F.lit("localhost"))
    request = _record(
        "request",
        [("WARC-Record-ID", _record_id("request", "id", "digest")), when, uri, ("WARC-Concurrent-To", F.col("own")), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)),
    )
    referred = F.when(F.col("revisit"), _record_id("response", "first", "digest"))
    response = _record(
        F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")),
        [
            ("WARC-Record-ID", F.col("own")), when, uri,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            ("WARC-Refers-To", referred),
            ("WARC-Profile", F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.concat(head, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html"))),
    )
    described = F.concat_ws("\r\n", F.concat(F.lit("captureId: "), F.col("id").cast("string")), F.concat(F.lit("payloadBytes: "), F.octet_length("html").cast("string")), F.lit(""))
    metadata = _record(
        "metadata",
        [("WARC-Record-ID", _record_id("metadata", "id", "digest")), when, uri, ("WARC-Concurrent-To", F.col("own")), ("Content-Type", F.lit("application/warc-fields"))],
        described,
    )
    records = df.select(F.concat_ws(END, request, response, metadata).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", CAPTURES_A_FILE).text(path)


def fields_of(lines: list[str]) -> list[tuple[str, str]]:
    """Names and values; a line that begins with white space goes on with the one before."""
    found: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and found:
            found[-1] = (found[-1][0], f"{found[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            found.append((name.strip(), value.strip()))
    return found


class RecordStream:
    """Puts records together from the pieces of one file between separators; each byte is copied a fixed number of times."""

    def __init__(self, payload: bool):
        self.payload = payload
        self.fields: dict[str, str] | None = None  # of the record whose block is being read, by name in lower case
        self.parts: list[bytes] = []
        self.have = 0
        self.need: int | None = 0  # None: the record has no length

    def add(self, piece: bytes) -> Iterator[tuple]:
        """Take the next piece, and give the records that are now complete."""
        if self.fields is not None:
            if self.need is None:
                raise ValueError(f"record without Content-Length: {self.fields.get('warc-record-id')}")
            self.have += len(piece) + len(END) * bool(self.parts)  # a separator is certain once a piece follows it
            self.parts.append(piece)
            if self.have < self.need:
                return
            whole = END.encode().join(self.parts)
            block, piece = whole[: self.need], whole[self.need :]
            yield self.record(self.fields, block)
            self.fields = None
        head = piece.lstrip(b"\r\n")
        if not head:
            return
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {lines[0][:60]!r}")
        self.fields = {name.lower(): value for name, value in fields_of(lines[1:])}
        length = self.fields.get("content-length", "")
        self.parts, self.have, self.need = [], 0, int(length) if length.isdecimal() else None
        if self.need == 0:
            yield self.record(self.fields, b"")
            self.fields = None

    def close(self) -> Iterator[tuple]:
        """The record that the file ends in, if it isn't complete."""
        if self.fields is not None:
            yield self.record(self.fields, END.encode().join(self.parts), cut=True)
            self.fields = None

    def record(self, f: dict[str, str], block: bytes, cut: bool = False) -> tuple:
        kind, content_type = f.get("warc-type"), f.get("content-type", "")
        extra, digest, intact, size, payload = None, None, None, None, None
        if content_type.startswith("application/warc-fields"):
            extra = list(dict(fields_of(block.decode("utf-8", "replace").split("\r\n"))).items())
        elif kind in ("response", "resource", "revisit"):
            payload = block.partition(END.encode())[2] if content_type.startswith("application/http") else block
            named = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
            if kind == "revisit":
                digest, payload = named, None
            else:
                digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                intact = named in (None, digest)
        intact = False if cut else intact
        named = [f.get(n) for n in ("warc-date", "warc-target-uri", "warc-concurrent-to", "warc-refers-to")]
        return f.get("warc-record-id"), kind, *named, content_type, extra, size, digest, intact, payload if self.payload else None


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record of the gzip archives in `path`; payloads are checked, and returned only if asked for."""
    small_batches(spark)
    pieces = spark.read.option("lineSep", END).text(path).select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file"))
    kinds = [pa.string()] * 7 + [pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, name = RecordStream(payload), None
        rows = lambda found: pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=RECORD.names)
        for batch in batches:
            found = []
            for piece, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file != name:
                    found += stream.close()
                    stream, name = RecordStream(payload), file
                found += stream.add(piece)
            if found:
                yield rows(found)
        if found := list(stream.close()):
            yield rows(found)

    return pieces.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, response, request and metadata (null where there is none).

    Of several requests or metadata records of one response the one with the smallest identifier is taken.
    """
    part = ["record_id", "date", "target_uri", "refers_to", "content_type", "fields", "payload_bytes", "payload_digest", "intact", "payload"]
    main = records.where(F.col("type").isin("response", "revisit", "resource")).select("record_id", F.struct("type", *part).alias("response"))
    others = records.where(F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    small = F.struct("record_id", "date", "target_uri", "content_type", F.map_entries("fields").alias("fields"))
    others = others.groupBy(F.col("concurrent_to").alias("record_id")).agg(
        F.min(F.when(F.col("type") == "request", small)).alias("request"), F.min(F.when(F.col("type") == "metadata", small)).alias("metadata")
    )
    whole = main.join(others, "record_id", "left")
    return whole.withColumn("metadata", F.col("metadata").withField("fields", F.map_from_entries("metadata.fields")))


def resolve_revisits(captures: DataFrame, key: F.Column) -> DataFrame:
    """Add refers_to: the key of the capture that a revisit refers to (null for others, and where there is none).

    Reads `captures` several times: best a materialised table. A column refers_to of its own is replaced.
    """
    captures = captures.drop("refers_to")
    to = F.col("response.refers_to")
    revisits = captures.where(to.isNotNull()).select("*", to.alias("__to"))
    others = captures.where(to.isNull()).select("*", key.alias("refers_to"))
    known = others.groupBy(F.col("record_id").alias("__to")).agg(F.min("refers_to").alias("refers_to"))
    found = join_split(revisits, known, ["__to"], "left").select(*captures.columns, "refers_to")
    return found.unionByName(others.withColumn("refers_to", F.lit(None).cast(known.schema["refers_to"].dataType)))
