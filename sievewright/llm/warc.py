"""WARC archives of web pages: revisits, segmented records, chunked bodies; and their reassembly."""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, shared_dir, small, stored
from .files import located, task_number, write_file

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_DATE = "2020-01-01T00:00:00Z"
#: Tables of up to so many repeated digests (some 60 bytes each) are broadcast.
MOST_BROADCAST = 500_000


def record_kinds(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``pages`` with ``payload`` (UTF-8), ``digest`` (SHA-1), ``record_type`` and ``refers_to``.

    Of equal payloads of at least ``least`` bytes the one with the largest page_id is the response, the others revisit
    it. The choice is a partial aggregate over digests; its small result is joined back, so only rows are moved, and
    the copies of a frequent page may be split by AQE. A page with a null id never answers for one with an id; rows
    that repeat the chosen page's id and payload are responses too. Null html counts as empty, an empty table gives an
    empty result, and further columns of ``pages`` are not read.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    chosen = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("digest", "_first")
    chosen = small(stored(chosen, "warc-repeats"), MOST_BROADCAST)
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.join(chosen, "digest", "left").select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"))


def _urn(page_id: int | None, digest: str, segment: int = 1) -> str:
    """A record's identifier: of page and payload, so that rows with one page id, or none, keep their segments apart."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{segment}')}>"


def chunked(body: bytes, size: int) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(x), x) for k in range(0, len(body), size) if (x := body[k : k + size])) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].partition(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        at = end + 4 + size


def _record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", len(block))])
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def page_records(page_id, url, payload: bytes, digest: str, kind: str, refers_to, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The compressed records of a page: one, or a first segment and its continuations."""
    common = [("WARC-Date", _DATE), ("Content-Type", "application/http;msgtype=response")]
    url = (url or "").replace("\r", "").replace("\n", "")
    own = [("WARC-Record-ID", _urn(page_id, digest)), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Page-ID", "" if page_id is None else page_id)]
    if kind == "revisit":
        yield _record(kind, [*own, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", _urn(refers_to, digest)), ("WARC-Refers-To-Page", refers_to), *common], _HTTP + b"\r\n")
        return
    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    parts = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        yield _record(kind, [*own, *common], block)
        return
    yield _record(kind, [*own, ("WARC-Segment-Number", 1), *common], parts[0])
    for n, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if n == len(parts) else []
        fields = [("WARC-Record-ID", _urn(page_id, digest, n)), ("WARC-Segment-Origin-ID", _urn(page_id, digest)), ("WARC-Segment-Number", n), ("WARC-Page-ID", "" if page_id is None else page_id), *last]
        yield _record("continuation", [*fields, ("WARC-Date", _DATE)], part)


def write_archives(rows: DataFrame, segment_bytes: int = 16 << 10, chunk_bytes: int = 4 << 10, archive_bytes: int = 16 << 20) -> DataFrame:
    """Write what :func:`record_kinds` gives to archives in the shared folder; returns their stored list (``path``).

    An archive is a file of gzip members, one per record. It is closed at ``archive_bytes``, also between two segments
    of a page, so continuations may lie in another file than their origin. Null pages and addresses are written empty,
    null payloads do not occur here (:func:`record_kinds` makes them empty); no rows make no archive.
    """
    spark = prepare(rows.sparkSession)
    folder = shared_dir(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = task_number(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, size
            path = write_file(f"{folder}/part-{part:06d}-{seq:06d}", ".warc.gz", b"".join(held))
            held.clear()
            seq, size = seq + 1, 0
            return pa.RecordBatch.from_pydict({"path": [path]})

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
                for record in page_records(*row, segment_bytes, chunk_bytes):
                    held.append(record)
                    size += len(record)
                    if size >= archive_bytes:
                        yield flush()
        if held:
            yield flush()

    wanted = rows.select("page_id", "url", "payload", "digest", "record_type", "refers_to")
    return stored(wanted.mapInArrow(run, "path string"), "warc-list")


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]):
            raise ValueError("cut off record")
        yield fields, block


def _payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


_PARTS = "origin string, segment int, total long, page_id long, record_type string, refers_to long, digest string, block binary, complete boolean"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["origin", "segment", "total", "page_id", "record_type", "refers_to", "digest", "block", "complete"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]

    def table(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    number = lambda v: int(v) if v else None
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows, size = [], 0
            system, name = located(path)
            with system.open_input_file(name) as f, gzip.GzipFile(fileobj=io.BufferedReader(f, 1 << 20) if not isinstance(f, io.IOBase) else f) as stream:
                for fields, block in read_records(stream):
                    kind, page = fields["warc-type"], number(fields.get("warc-page-id"))
                    if kind == "continuation":
                        rows.append((fields["warc-segment-origin-id"], int(fields["warc-segment-number"]), number(fields.get("warc-segment-total-length")), page, None, None, None, block, False))
                    else:
                        whole = "warc-segment-number" not in fields
                        rows.append((fields["warc-record-id"], 1, None, page, kind, number(fields.get("warc-refers-to-page")), fields["warc-payload-digest"].partition(":")[2], block, whole))
                    size += len(block)
                    if size > 4 << 20:
                        yield table(rows)
                        rows, size = [], 0
            if rows:
                yield table(rows)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole blocks to payload length and digest; segments in order, their lengths against the total."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            parts, kind = r["parts"], next((p["record_type"] for p in r["parts"] if p["segment"] == 1), None)
            block, total = b"".join(p["block"] for p in parts), next((p["total"] for p in parts if p["total"] is not None), None)
            sound = [p["segment"] for p in parts] == list(range(1, len(parts) + 1)) and (len(parts) == 1 and parts[0]["complete"] or total == len(block))
            if not sound:
                raise ValueError(f"segments of {r['origin']} do not make up a record")
            payload = None if kind == "revisit" else _payload(block)
            digest = parts[0]["digest"] if payload is None else hashlib.sha1(payload).hexdigest()
            if digest != parts[0]["digest"]:
                raise ValueError(f"payload of {r['origin']} has another digest than its record states")
            rows.append((parts[0]["page_id"], kind, parts[0]["refers_to"], None if payload is None else len(payload), digest, payload))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def read_archives(listed: DataFrame) -> DataFrame:
    """Per record of the archives in ``listed``: ``page_id``, ``record_type``, ``refers_to``, ``payload_bytes``, ``payload_digest``, ``payload`` (for revisits the digest is that of the record, length and payload are null).

    Files are parsed once and their parts stored. Complete records go straight on; the segments of the others are
    grouped by their origin's identifier, ordered by number, checked against the total length and joined. Only the
    latter are exchanged. Rows that repeat page and payload write equal records, and as many come back. A broken
    record raises; an empty list gives an empty result.
    """
    spark = prepare(listed.sparkSession)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = stored(listed.select("path").repartition(partitions, "path").mapInArrow(_parse, _PARTS), "warc-parts")
    part = F.struct("segment", "total", "page_id", "record_type", "refers_to", "digest", "block", "complete")
    whole = parts.where("complete").select("origin", F.array(part).alias("parts"))
    # Repeated rows write the same origin twice: equal segments count once, and the copies come back with the first.
    # One exchange by origin serves both groupings.
    cut = parts.where("not complete").repartition("origin").groupBy("origin", "segment").agg(F.first(part).alias("_part"), F.count("*").alias("_n"))
    joined = cut.groupBy("origin").agg(F.array_sort(F.collect_list("_part")).alias("parts"), F.min("_n").alias("_n"))
    again = joined.select("origin", "parts", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).select("origin", "parts")
    return whole.unionByName(again).mapInArrow(_finish, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """``records`` without payloads, where revisits carry the length of the response they refer to.

    A revisit's response has the page it names and its digest; only revisits and the responses of pages are joined,
    and responses are pre-aggregated, so rows without a reference never meet. An empty table gives an empty result.
    """
    rows = stored(records.drop("payload"), "warc-records")
    names = "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    source = rows.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("_bytes"))
    again = rows.where("record_type = 'revisit'").join(source, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", F.col("_bytes"))
    return rows.where("record_type <> 'revisit'").select(*names).unionByName(again.select(*names))
