"""Operator 12: web archives: a gzip member per record, read in sequence with digests verified.

Writing: every page becomes a record whose payload is its html in UTF-8. Of records with equal payloads of at least
``least`` bytes the one with the smallest page_id is a response; the others are revisits, which hold the head of the
response without the payload. Tasks write their rows to files of their own in the folder given, which all machines must
share; a manifest, written by Spark, lists the files of the attempts that counted, so that what a lost executor left
behind is never read.

Reading: a task a file. Members are inflated piece by piece, a record is framed by its Content-Length, and the digests
of block and payload are computed as the bytes go by. Only a payload that is asked for is held whole. What is wrong
with a record is said in ``problem``; after damage to the compressed bytes the rest of that file is not read, and its last
row says so.

Defined results: a null html is an empty payload; a very long one is one record; null page_ids come last in the order
and read back as null; of equal page_ids the smallest url comes first, and of rows that are wholly alike one is the
response; a null url is left out of the record; an empty table gives no record; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm.bpe import small_batches
from gridweave.llm.shared import checkpointed, hot_slots, partitions, spread_join

LEAST = 100  #: bytes of the smallest payload that is looked for among others
BLOCK = 1 << 18
ROLL_BYTES = 1 << 28  #: bytes after which a task begins a new file
COPIES = 10_000  #: repeated rows made by one row at a time
#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def planned(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html (null for revisits), digest, bytes, record_type, refers_to of every record to write."""
    html = F.coalesce(F.col("html"), F.lit(""))
    key = F.struct(F.isnull("page_id").alias("none"), F.col("page_id"), F.isnull("url").alias("no_url"), F.col("url"))
    d = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("bytes"), key.alias("key"))
    alike = d.where(F.col("bytes") >= least).groupBy("digest", "bytes", "key").agg(F.count("*").alias("copies"))
    groups = alike.groupBy("digest", "bytes").agg(F.sum("copies").alias("n"), F.min(F.struct("key", "copies")).alias("first")).where("n > 1")
    groups = checkpointed(groups.select("digest", "n", "bytes", F.col("first.key").alias("first"), F.col("first.copies").alias("copies")))
    rows = spread_join(d, groups.select("digest", "first", "copies"), ["digest"], hot_slots(groups, "digest"), "left")
    leads = F.coalesce(F.col("key") == F.col("first"), F.lit(True))
    refers, none = F.col("first.page_id"), F.lit(None).cast(pages.schema["page_id"].dataType)
    once = rows.where(~leads | F.coalesce(F.col("copies") == 1, F.lit(True)))
    out = once.select("page_id", "url", F.when(leads, F.col("html")).alias("html"), "digest", "bytes", F.when(leads, "response").otherwise("revisit").alias("record_type"), F.when(~leads, refers).alias("refers_to"))
    repeated = groups.where("copies > 1")
    if repeated.isEmpty():
        return out
    one = rows.where(leads & (F.col("copies") > 1)).dropDuplicates(["digest"]).select("page_id", "url", "html", "digest", "bytes", F.lit("response").alias("record_type"), none.alias("refers_to"))
    blocks = repeated.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))).alias("at"))
    rest = blocks.repartition(partitions(pages.sparkSession), "digest", "at").select("*", F.explode(F.sequence("at", F.least(F.col("at") + COPIES - 1, F.col("copies") - 1))))
    rest = rest.select("first.page_id", "first.url", F.lit(None).cast("string").alias("html"), "digest", "bytes", F.lit("revisit").alias("record_type"), refers.alias("refers_to"))
    return out.unionByName(one).unionByName(rest)


# -- writing -----------------------------------------------------------------------------------------
def urn(page_id: object) -> str:
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def page_of(uri: str | None) -> str | None:
    """The text of the page_id that ``urn`` was made from."""
    return unquote(uri[len("<urn:page:") : -1]) if uri and uri.startswith("<urn:page:") else None


def record(page_id: object, url: str | None, payload: bytes | memoryview, size: int, digest: str, kind: str, refers_to: object, level: int = 6) -> bytes:
    """One gzip member. ``size`` and ``digest`` are of the full payload, which a revisit leaves out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = hashlib.sha256(head)
    block.update(payload)
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}", *([] if url is None else [f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}"])]
    lines += [] if kind == "response" else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"]
    lines += [f"WARC-Block-Digest: sha256:{block.hexdigest()}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(head) + len(payload)}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return b"".join((z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + head), z.compress(payload), z.compress(b"\r\n\r\n"), z.flush()))


def write_archives(pages: DataFrame, out: str, least: int = LEAST) -> None:
    """Writes the records of ``pages`` to files in ``out``/data and their list to ``out``/manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(f"{out}/data")
        fs.create_dir(root, recursive=True)
        task, files, sink, done = TaskContext.get(), 0, None, []
        for batch in batches:
            ids, urls, htmls = batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html").cast(pa.large_binary())
            sizes, digests, kinds, refers = (batch.column(c).to_pylist() for c in ("bytes", "digest", "record_type", "refers_to"))
            for i, page_id in enumerate(ids):
                if sink is None:
                    path = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{files}.warc.gz"
                    sink, written, count = fs.open_output_stream(path, compression=None), 0, 0
                payload = memoryview(htmls[i].as_buffer()) if htmls[i].is_valid else b""
                member = record(page_id, urls[i], payload, sizes[i], digests[i], kinds[i], refers[i])
                sink.write(member)
                written, count = written + len(member), count + 1
                if written >= ROLL_BYTES:
                    sink.close()
                    done.append((path.rsplit("/", 1)[1], count, written))
                    sink, files = None, files + 1
        if sink is not None:
            sink.close()
            done.append((path.rsplit("/", 1)[1], count, written))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["file", "records", "bytes"])

    small_batches(planned(pages, least)).mapInArrow(run, "file string, records long, bytes long").write.parquet(f"{out}/manifest")


# -- reading -----------------------------------------------------------------------------------------
class Record:
    """A record that is fed with pieces of its bytes: head, block of Content-Length bytes, two line ends."""

    def __init__(self, keep: bool):
        self.keep, self.head, self.headers, self.http, self.tail = keep, b"", None, b"", b""
        self.left, self.size, self.in_payload, self.pieces, self.sums = 0, 0, False, [], None

    def feed(self, piece: bytes) -> None:
        if self.headers is None:
            self.head += piece
            at = self.head.find(b"\r\n\r\n")
            if at < 0:
                if len(self.head) > 1 << 20:
                    raise ValueError("no end of the headers within a megabyte")
                return
            self.headers, piece = fields(self.head[:at].decode("utf-8", "replace")), self.head[at + 4 :]
            self.left = int(self.headers["content-length"])
            self.sums = {name: (algorithm(self.headers[name]), hashlib.new(algorithm(self.headers[name]))) for name in ("warc-block-digest", "warc-payload-digest") if name in self.headers}
        inside, self.tail = piece[: self.left], self.tail + piece[self.left :]
        self.left -= len(inside)
        if "warc-block-digest" in self.sums:
            self.sums["warc-block-digest"][1].update(inside)
        if not self.in_payload and self.headers.get("content-type", "").startswith("application/http"):
            self.http += inside
            at = self.http.find(b"\r\n\r\n")
            if at < 0:
                return
            self.in_payload, inside, self.http = True, self.http[at + 4 :], self.http[:at]
        self.in_payload = True
        self.size += len(inside)
        if "warc-payload-digest" in self.sums:
            self.sums["warc-payload-digest"][1].update(inside)
        if self.keep:
            self.pieces.append(inside)

    def problem(self) -> str | None:
        """What is wrong with the record now that its member is at its end."""
        if self.headers is None:
            return "no headers"
        if self.left:
            return f"{self.left} bytes of the block are missing"
        if self.tail != b"\r\n\r\n":
            return "the record does not end with two line ends"
        for name, (kind, digest) in self.sums.items():
            if (name == "warc-block-digest" or self.headers.get("warc-type") != "revisit") and not same_digest(self.headers[name], kind, digest.digest()):
                return f"{name} differs"
        return None

    def payload_bytes(self) -> int | None:
        """Of the full payload: for a revisit what the head it holds says."""
        if self.headers.get("warc-type") != "revisit":
            return self.size
        length = fields(self.http.decode("latin-1")).get("content-length")
        return int(length) if length else None


def fields(text: str) -> dict[str, str]:
    """Header lines by lower-case name; a line that begins with white space goes on with the one before."""
    out: dict[str, str] = {}
    name = None
    for line in text.split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def algorithm(digest: str) -> str:
    return digest.split(":", 1)[0].lower().replace("-", "")


def same_digest(stated: str, kind: str, found: bytes) -> bool:
    """The digest stated, in hex or base 32, is that found."""
    value = stated.split(":", 1)[1].strip()
    return value.lower() == found.hex() or value.rstrip("=").upper() == base64.b32encode(found).decode().rstrip("=")


def read_records(raw: BinaryIO, keep: bool = False, block: int = BLOCK) -> Iterator[tuple[int, int, Record, str | None]]:
    """(offset, bytes of the member, record, problem) of each gzip member of a stream, in sequence."""
    offset, data = 0, raw.read(block)
    while data:
        z, one, used, problem = zlib.decompressobj(31), Record(keep), 0, None
        try:
            while not z.eof:
                before = len(data)
                piece = z.decompress(data, block)
                data = z.unused_data if z.eof else z.unconsumed_tail
                used += before - len(data)
                if piece and problem is None:
                    try:
                        one.feed(piece)
                    except (KeyError, ValueError) as wrong:  # the member can still be read past
                        problem = f"malformed record: {wrong}"
                if not z.eof and not data and not (data := raw.read(block)) and not piece:
                    raise zlib.error("the file ends within a member")
        except zlib.error as damage:
            yield offset, used, one, f"damaged: {damage}"
            return
        yield offset, used, one, problem or one.problem()
        offset += used
        data = data or raw.read(block)


READ = "file string, offset long, member_bytes long, record_type string, page string, url string, refers_to string, payload_bytes long, payload_digest string, problem string, payload binary"


def read_archives(spark: SparkSession, out: str, keep: bool = False) -> DataFrame:
    """The records of all files of the manifest; ``keep``: with payloads. The digest is as stated, without its algorithm."""
    files = spark.read.parquet(f"{out}/manifest").select("file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(f"{out}/data")
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None, buffer_size=BLOCK) as raw:
                    for offset, used, one, problem in read_records(raw, keep):
                        h = one.headers or {}
                        digest = h.get("warc-payload-digest", ":").split(":", 1)[1] or None
                        size = None if problem else one.payload_bytes()
                        payload = b"".join(one.pieces) if keep and not problem and h.get("warc-type") != "revisit" else None
                        rows.append((name, offset, used, h.get("warc-type"), page_of(h.get("warc-record-id")), h.get("warc-target-uri"), page_of(h.get("warc-refers-to")), size, digest, problem, payload))
                        held += len(payload or b"")
                        if len(rows) >= 5_000 or held > 32 << 20:
                            yield arrow(rows)
                            rows, held = [], 0
                if rows:
                    yield arrow(rows)

    return files.repartition(max(1, files.count()), "file").mapInArrow(run, READ)


def arrow(rows: list[tuple]) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    columns = [c.strip().split(" ") for c in READ.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(values, types[t]) for values, (_, t) in zip(zip(*rows, strict=True), columns, strict=True)], [n for n, _ in columns])


def sound(value: Column) -> Column:
    """``value``; an error where the record it comes from has a problem."""
    return F.when(F.col("problem").isNull(), value).otherwise(F.raise_error(F.concat_ws(" ", "file", F.col("offset").cast("string"), "problem")).cast("string"))


def page_records(read: DataFrame, page_id_type: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of sound records."""
    return read.select(F.col("page").cast(page_id_type).alias("page_id"), "payload_bytes", "payload_digest", sound(F.col("record_type")).alias("record_type"), F.col("refers_to").cast(page_id_type).alias("refers_to"))


ORACLE = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM f"""
