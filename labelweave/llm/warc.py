r"""WARC archives on Spark: write records with duplicate payloads as revisits, read them back, reassemble segments.

Writing uses Spark's text sink (its commit protocol, any file system it knows). A record's block is cut into segments of
at most `segment_chars` characters; later segments are `continuation` records with the origin's id and their number, and
the last one states the total length. The payload is framed with the chunked transfer coding. Chunks are cut wherever
a payload holds a record's version line, so the archive can be read in pieces at that line whatever the payloads say; a
reader that goes by Content-Length reads the same records. (The line has no border, which Hadoop's reader of custom
separators needs: one that begins with what it may follow, such as blank lines, is missed at buffer ends.)

Reading takes the archives as text with that separator, checks Content-Length, groups records by origin id, orders
them by segment number, verifies numbers and total length, and decodes the chunked framing.

Of records with equal payloads (SHA-256 and length) of at least 1000 bytes, that with the largest page id is the
response, and the others revisit it.

Defined results: a null html is an empty payload, a null url an empty target; rows with a null page id are responses
of their own; repeated rows of the response's own page id are responses too; a damaged record or a segment chain with
a gap, a wrong total or a broken framing comes back with `problem` set, never dropped; empty tables give no records.
Other columns of the input are not read. Compressed archives are not split, so `pages_per_file` bounds their size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm.common import slices
from labelweave.session import scratch_path

# The WARC version line, which begins every record and which readers split at.
VERSION = "WARC/1.1"
SEPARATOR = f"{VERSION}\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
LEAST_REVISIT_BYTES = 1000


def plan_records(pages: DataFrame) -> DataFrame:
    """Pages with `refers_to` (null: a response). Payloads travel once, by page id; the digests travel alone."""
    body = F.coalesce("html", F.lit(""))
    digests = pages.select("page_id", F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("size")).where(
        (F.col("size") >= LEAST_REVISIT_BYTES) & F.col("page_id").isNotNull())
    heads = digests.groupBy("digest", "size").agg(F.max("page_id").alias("head"), F.min("page_id").alias("least")).where("head > least")
    revisits = digests.join(heads, ["digest", "size"]).where("page_id < head").select("page_id", "digest", F.col("head").alias("refers_to"))
    # page ids may repeat with other payloads: the digest decides which of the rows is the copy
    return (pages.select("page_id", "url", body.alias("html")).withColumn("digest", F.sha2("html", 256))
            .join(revisits.distinct(), ["page_id", "digest"], "left"))


def chunked(payload: str, chunk_chars: int = 4096) -> str:
    """Chunked transfer coding of a text, cut inside every version, so that none meets the line end after a chunk or segment."""
    needle, out, at = VERSION, [], 0
    while at < len(payload):
        end = min(len(payload), at + chunk_chars)
        inside = payload.find(needle, at, end + len(needle))
        if 0 <= inside < end:
            end = inside + 4
        part = payload[at:end]
        out.append(f"{len(part.encode()):x}\r\n{part}\r\n")
        at = end
    return "".join(out) + "0\r\n\r\n"


def dechunk(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk without a size line")
        size = int(body[at:line].split(b";")[0], 16)
        start = line + 2
        if size == 0:
            return b"".join(out)
        if len(body) < start + size + 2 or body[start + size:start + size + 2] != b"\r\n":
            raise ValueError("chunk shorter than its size")
        out.append(body[start:start + size])
        at = start + size + 2


def _cuts(block: str, segment_chars: int) -> list[str]:
    return [block[i:i + segment_chars] for i in range(0, len(block), segment_chars)] or [""]


def _record(headers: list[tuple[str, object]], block: str) -> str:
    lines = [f"{k}: {v}" for k, v in headers if v is not None] + [f"Content-Length: {len(block.encode())}"]
    return VERSION + "\r\n" + "\r\n".join(lines) + "\r\n\r\n" + block + "\r\n\r\n"


def records_of(uid: str, page_id: int | None, url: str | None, html: str, refers_to: int | None, segment_chars: int) -> list[str]:
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A").replace(VERSION, VERSION.replace("/", "%2F"))
    payload = html.encode()
    origin = f"<urn:uuid:{uid}>"
    common = [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", url), ("WARC-Page-ID", page_id),
              ("WARC-Payload-Digest", "sha1:" + hashlib.sha1(payload).hexdigest()), ("WARC-Payload-Length", len(payload))]
    if refers_to is not None:
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", origin), *common, ("WARC-Profile", REVISIT_PROFILE),
                         ("WARC-Refers-To-Page-ID", refers_to), ("Content-Type", "application/http; msgtype=response")],
                        RESPONSE_HEAD.split("Transfer-Encoding")[0] + "\r\n")]
    parts = _cuts(RESPONSE_HEAD + chunked(html), segment_chars)
    total = sum(len(p.encode()) for p in parts)
    out = []
    for number, part in enumerate(parts, 1):
        last = number == len(parts) and number > 1
        own = ([("WARC-Type", "response"), ("WARC-Record-ID", origin), *common, ("Content-Type", "application/http; msgtype=response"),
                ("WARC-Segment-Number", 1 if len(parts) > 1 else None)] if number == 1 else
               [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uid}:{number}>"), ("WARC-Segment-Origin-ID", origin),
                ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", total if last else None)])
        out.append(_record(own, part))
    return out


def write_archives(planned: DataFrame, path: str, segment_chars: int = 65_536, pages_per_file: int = 50_000, compression: str = "gzip") -> None:
    """One text line per record: the sink's line feed is the last character of the record's end mark."""
    rows = planned.select(F.uuid().alias("uid"), "page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            records = [r for row in zip(*(c.to_pylist() for c in batch.columns)) for r in records_of(*row, segment_chars)]
            yield pa.RecordBatch.from_pydict({"value": pa.array([r[:-1] for r in records], pa.string())})

    (rows.mapInArrow(run, "value string").write.option("lineSep", "\n").option("compression", compression)
     .option("maxRecordsPerFile", pages_per_file).text(path))


_READ = ("origin string, number int, has_segments boolean, total long, record_type string, page_id long, refers_to long, payload_digest string, "
         "payload_length long, target_uri string, block binary, problem string")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives, continuations included, read in splits at the record separator."""
    fragments = spark.read.option("lineSep", SEPARATOR).text(path)

    def parse(text: str) -> dict:
        data = text.encode()
        head, _, block = data.partition(b"\r\n\r\n")
        h = dict(line.split(": ", 1) for line in head.decode().split("\r\n") if ": " in line)
        whole = lambda k: int(h[k]) if k in h else None
        length, problem = whole("Content-Length"), None
        if length is None or len(block) < length:
            problem = "shorter than Content-Length"
        elif block[length:].strip(b"\r\n"):
            problem = "longer than Content-Length"
        return {"origin": h.get("WARC-Segment-Origin-ID", h.get("WARC-Record-ID")), "number": whole("WARC-Segment-Number") or 1, "has_segments": "WARC-Segment-Number" in h,
                "total": whole("WARC-Segment-Total-Length"), "record_type": h.get("WARC-Type"), "page_id": whole("WARC-Page-ID"),
                "refers_to": whole("WARC-Refers-To-Page-ID"), "payload_digest": h.get("WARC-Payload-Digest"),
                "payload_length": whole("WARC-Payload-Length"), "target_uri": h.get("WARC-Target-URI"),
                "block": block[:length] if length is not None else block, "problem": problem}

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(_READ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            yield pa.RecordBatch.from_pylist([parse(t) for t in batch.column(0).to_pylist() if t.strip("\r\n")], schema=arrow)

    return fragments.mapInArrow(run, _READ)


def reassemble(records: DataFrame) -> DataFrame:
    """One row per page record: segments joined in order, checked, and decoded.

    Records in one piece take no shuffle; only those that continue are grouped, and a group is one record.
    """
    first = F.struct("record_type", "page_id", "refers_to", "payload_digest", "payload_length", "target_uri")
    alone = records.where("coalesce(record_type, '') not in ('continuation', 'warcinfo', 'request', 'metadata') and not has_segments")
    alone = alone.select("origin", first.alias("head"), "block", "problem")
    parts = F.array_sort(F.collect_list(F.struct("number", "total", "block", "problem")))
    chain = (records.where("record_type = 'continuation' or (record_type = 'response' and has_segments)").groupBy("origin")
             .agg(F.max(F.when(F.col("record_type") == "response", first)).alias("head"), parts.alias("parts")))
    joined = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["block"]))
    in_order = F.transform("parts", lambda p: p["number"]) == F.sequence(F.lit(1), F.size("parts"))
    chain = chain.select("origin", "head", joined.alias("block"), F.coalesce(
        F.when(F.col("head").isNull(), "no first segment"), F.when(~in_order, "segments missing or repeated"),
        F.when(F.coalesce(F.element_at("parts", -1)["total"], F.lit(-1)) != F.octet_length(joined), "wrong total length"),
        F.get(F.filter(F.transform("parts", lambda p: p["problem"]), lambda p: p.isNotNull()), F.lit(0))).alias("problem"))
    rows = alone.unionByName(chain).select("origin", "head.*", "block", "problem")

    out_schema = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, "
                  "payload binary, problem string")

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(out_schema))

    def decode(row: dict) -> dict:
        problem, payload = row["problem"], None
        stated = (row["payload_digest"] or "").removeprefix("sha1:")
        digest, size = stated, row["payload_length"]
        if row["record_type"] == "response" and problem is None:
            try:
                head, _, body = row["block"].partition(b"\r\n\r\n")
                payload = dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body
                digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
                if stated and digest != stated:
                    problem = "payload differs from its digest"
            except ValueError as e:
                problem = str(e)
        return {"page_id": row["page_id"], "payload_bytes": size, "payload_digest": digest, "record_type": row["record_type"],
                "refers_to": row["refers_to"], "target_uri": row["target_uri"], "payload": payload, "problem": problem}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            yield pa.RecordBatch.from_pylist([decode(r) for r in batch.to_pylist()], schema=arrow)

    return rows.mapInArrow(run, out_schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return reassemble(read_records(spark, path))


def archive_round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the archives of all pages to the shared folder and read them back."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(plan_records(pages), path, **options)
    return read_archives(spark, path)
