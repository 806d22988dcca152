"""WARC archives: writing, reading, segment reassembly and chunked transfer decoding.

Archives are gzip files that Spark's text writer makes, so any file system it knows
will do: a record is a row, and the line separator is the blank lines that end a record.
Reading is the same in reverse. A gzip file is read by one task from its start, so the
bytes between separators, joined again, are the file, and records are cut from it by
their declared lengths (payloads may hold separators). Files are as large as the
writer's partitions (``max_records`` per file at most).

Blocks over ``segment_bytes`` are written as a first record and continuations. Reading
groups those by the identifier of their origin, orders them by segment number, verifies
the numbers and the total length, and then decodes chunked framing. Only segments are
shuffled; a group is one record.

A record's identifier holds the row's id and its payload's digest, so rows that share an
id are told apart. A revisit states its payload's digest, and in the header of its HTTP
block the length, so that it can be read alone; ``resolve`` looks for its response.

Defined results: null payloads are empty ones. Of rows with equal payloads the one with
the largest id is a response and the others revisit it; rows repeated whole, id included,
are all what the first is. Null ids count as smaller than all others. Damaged records
(missing segments, wrong total, broken framing, wrong digest) are kept with intact = false.
Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwright.llm.common import sparing

GAP = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "kind string, record_id string, target_uri string, refers_to string, declared string, segment int, origin string, total long, n_segments int, block binary, payload binary, payload_bytes long, payload_digest string, intact boolean"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(piece := payload[k : k + size]), piece) for k in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """What chunked framing holds; None if it is broken. Extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if n == 0:
            return b"".join(out)
        if n < 0 or body[end + 2 + n : end + 4 + n] != b"\r\n":
            return None
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def head(kind: str, record_id: str, length: int, fields: list[tuple[str, str]], date: str) -> bytes:
    clean = [(k, v.replace("\r", " ").replace("\n", " ")) for k, v in fields]
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", *[f"{k}: {v}" for k, v in clean], f"Content-Length: {length}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + GAP


def records(record_id: str, url: str, payload: bytes, digest: str, refers_to: str | None, date: str, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page, without the blank lines that end each."""
    fields = [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + GAP
        yield head("revisit", record_id, len(block), [*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")], date) + block
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + GAP + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield head("response", record_id, len(block), fields, date) + block
        return
    starts = range(0, len(block), segment_bytes)
    for number, at in enumerate(starts, 1):
        part = block[at : at + segment_bytes]
        more = [("WARC-Segment-Number", str(number))]
        if number == 1:
            yield head("response", record_id, len(part), fields + more, date) + part
            continue
        more += [("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Target-URI", url)]
        if number == len(starts):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        yield head("continuation", f"{record_id}:{number}", len(part), more, date) + part


def identifier(id_: int | None, digest: str) -> str:
    """Of a page's record; ``page_of`` is the way back."""
    return f"urn:page:{'' if id_ is None else id_}:{digest}"


def page_of(record_id: Column) -> Column:
    return F.nullif(F.split_part(record_id, F.lit(":"), F.lit(3)), F.lit("")).cast("long")


def write(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment_bytes: int = 32_768, chunk_bytes: int = 8_192, date: str = "2020-01-01T00:00:00Z", max_records: int = 100_000) -> None:
    """Archives of ``df`` below ``path``: a response, or a revisit of an equal payload, per row."""
    pages = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    last = pages.groupBy("sha").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = pages.join(last, "sha", "left").select("id", "url", "payload", "sha", F.when(F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last")), F.col("last")).alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            held = 0
            for id_, url, payload, sha, last in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, held = [], 0
                digest = base64.b32encode(sha).decode()
                made = records(identifier(id_, digest), url or "", payload, digest, None if last is None else identifier(last, digest), date, segment_bytes, chunk_bytes)
                out += made
                held += sum(map(len, made))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    joined.mapInArrow(sparing(run), "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", GAP.decode()).option("compression", "gzip").option("maxRecordsPerFile", max_records).text(path)


def fields_of(header: bytes) -> dict[str, str]:
    out = {}
    for line in header.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        out[k.strip().lower()] = v.strip()
    return out


def bare(value: str | None) -> str | None:
    return value[1:-1] if value and value[0] == "<" and value[-1] == ">" else value


def cut_records(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(fields, block) of each record; a block cut short by the end of its file is None. ``pieces``: (file, bytes before a separator), in order."""
    file, held, size, need = None, [], 0, 1

    def drain(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        nonlocal held, size, need
        at = 0
        while True:
            while data[at : at + 2] == b"\r\n":
                at += 2
            end = data.find(GAP, at)
            if end < 0:
                need = len(data) - at + 1
                break
            fields = fields_of(data[at:end])
            n = int(fields.get("content-length", "0"))
            if end + 4 + n > len(data):
                need = end + 4 + n - at
                break
            yield fields, data[end + 4 : end + 4 + n]
            at = end + 4 + n
        held, size = [data[at:]], len(data) - at

    for name, piece in pieces:
        if name != file:
            if (left := b"".join(held).strip()) and GAP in left:
                yield fields_of(left.split(GAP)[0]), None
            file, held, size, need = name, [], 0, 1
        held += [piece, GAP]
        size += len(piece) + 4
        if size >= need:
            yield from drain(b"".join(held))
    if (left := b"".join(held).strip()) and GAP in left:
        yield fields_of(left.split(GAP)[0]), None


def opened(block: bytes | None, declared: str | None, kind: str) -> tuple[bytes | None, bool]:
    """(payload, whether it is whole and as declared) of an HTTP block."""
    if block is None or GAP not in block:
        return None, False
    top, body = block.split(GAP, 1)
    if b"transfer-encoding: chunked" in top.lower():
        body = unchunked(body)
        if body is None:
            return None, False
    return body, kind == "revisit" or declared is None or declared.removeprefix("sha1:") == base32_sha1(body)


def http_length(block: bytes | None) -> int | None:
    """What the header of an HTTP block says of its body's length."""
    found = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", (block or b"").split(GAP, 1)[0])
    return int(found[1]) if found else None


def row(fields: dict, kind: str, block: bytes | None, n_segments: int, keep: bool) -> dict:
    payload, intact = opened(block, fields["declared"], kind)
    revisit = kind == "revisit"
    if revisit:
        return fields | {"n_segments": n_segments, "block": None, "payload": None, "payload_bytes": http_length(block), "payload_digest": fields["declared"].removeprefix("sha1:") if fields["declared"] else None, "intact": intact}
    return fields | {"n_segments": n_segments, "block": None, "payload": payload if keep else None, "payload_bytes": None if payload is None else len(payload), "payload_digest": None if payload is None else base32_sha1(payload), "intact": intact}


def batch_of(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in RECORD.split(", "))])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def scan(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives below ``path``: whole ones decoded, segments with their blocks."""
    raw = spark.read.option("lineSep", GAP.decode()).text(path).select(F.input_file_name().alias("file"), F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (x for b in batches for x in zip(b.column("file").to_pylist(), b.column("value").to_pylist(), strict=True))
        rows, size = [], 0
        for f, block in cut_records(pieces):
            kind = f.get("warc-type", "")
            if kind not in ("response", "revisit", "continuation"):
                continue
            number = int(f["warc-segment-number"]) if "warc-segment-number" in f else None
            me = bare(f.get("warc-record-id"))
            shared = {"kind": kind, "record_id": me, "target_uri": f.get("warc-target-uri"), "refers_to": bare(f.get("warc-refers-to")), "declared": f.get("warc-payload-digest"), "segment": number, "origin": bare(f.get("warc-segment-origin-id", me)), "total": int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None}
            rows.append(row(shared, kind, block, 1, payloads) if number is None else shared | {"block": block})
            size += len(block or b"")
            if size > 4_000_000 or len(rows) >= 5_000:
                yield batch_of(rows)
                rows, size = [], 0
        yield batch_of(rows)

    return raw.mapInArrow(sparing(run), RECORD)


def reassemble(scanned: DataFrame, payloads: bool = False) -> DataFrame:
    """``scanned`` with the segments of each record put together. Equal segments of rows repeated whole are counted before they meet, so a group is one record however often it was written."""
    once = scanned.where("segment is not null").groupBy("origin", "target_uri", "segment").agg(F.count("*").alias("copies"), F.max(F.struct("kind", "declared", "total", "block")).alias("one"))
    parts = once.groupBy("origin", "target_uri").agg(F.sort_array(F.collect_list(F.struct("segment", "copies", "one"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1).to_pylist()[0]
                by = {x["segment"]: x["one"] for x in one["parts"]}
                copies = max(x["copies"] for x in one["parts"])
                first = by.get(1, {"kind": "response", "declared": None})
                total = next((x["total"] for x in by.values() if x["total"] is not None), None)
                whole = sorted(by) == [*range(1, len(by) + 1)] and all(x["copies"] == copies and x["one"]["block"] is not None for x in one["parts"])
                block = b"".join(by[n]["block"] for n in sorted(by)) if whole else None
                if block is not None and len(block) != total:
                    block = None
                shared = {"kind": first["kind"], "record_id": one["origin"], "target_uri": one["target_uri"], "refers_to": None, "declared": first["declared"], "segment": None, "origin": one["origin"], "total": total}
                yield batch_of([row(shared, first["kind"], block, len(by), payloads)]).append_column("copies", pa.array([copies], pa.int64()))

    read = parts.mapInArrow(sparing(run), f"{RECORD}, copies long").withColumn("copies", F.explode(F.expr("sequence(1L, copies)"))).drop("copies")
    return scanned.where("segment is null").unionByName(read).drop("segment", "block", "total", "origin", "declared")


def resolve(read: DataFrame, salts: int = 16) -> DataFrame:
    """``read`` with every revisit's response looked up: its length and digest stand where the revisit states none, and a revisit that refers to none, or states others, is not intact.

    Only revisits, and the responses that some revisit refers to, move; revisits of one response are dealt by ``salts``, so that no task gets all of a frequent one.
    """
    revisits = read.where("kind = 'revisit'").withColumn("salt", F.pmod(F.xxhash64("record_id", "target_uri"), F.lit(salts)).cast("int"))
    wanted = revisits.select(F.col("refers_to").alias("o_id")).distinct()
    origin = read.where("kind = 'response'").select(F.col("record_id").alias("o_id"), F.col("payload_bytes").alias("o_bytes"), F.col("payload_digest").alias("o_digest")).join(wanted, "o_id", "left_semi")
    origin = origin.groupBy("o_id").agg(F.max(F.struct("o_bytes", "o_digest")).alias("o")).select("o_id", "o.o_bytes", "o.o_digest", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("o_salt"))
    joined = revisits.join(origin, (F.col("refers_to") == F.col("o_id")) & (F.col("salt") == F.col("o_salt")), "left")
    same = F.col("o_id").isNotNull() & F.coalesce(F.col("payload_bytes") == F.col("o_bytes"), F.lit(True)) & F.coalesce(F.col("payload_digest") == F.col("o_digest"), F.lit(True))
    found = joined.withColumns({"payload_bytes": F.coalesce("payload_bytes", "o_bytes"), "payload_digest": F.coalesce("payload_digest", "o_digest"), "intact": F.col("intact") & same})
    return read.where("kind <> 'revisit'").unionByName(found.select(*read.columns))
