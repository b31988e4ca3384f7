"""Deterministic sharded WARC archives: writer, manifest and reader.

Records are range-sorted by page id over shards whose borders come from exact byte counts
of id ranges, so they depend on the rows alone and not on a sample, the session or how the rows
lie. A task writes its shard as files of single-record gzip members and starts a new file when
the compressed size passes a limit. Each file gets its final name by a rename once it is whole, and
the set of archives is what the manifest lists, which is itself committed last: a task that is
lost or runs twice leaves at most unlisted temporary files, which are deleted after the
commit. Headers, record ids and digests are made anew from the payload, with a fixed date, so
equal tables give equal bytes.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, pick, shared_dir, store, table

#: A payload of fewer bytes is never replaced by a reference to another record.
LEAST_SHARED = 100
#: Bytes that a shard should hold, records' heads included; more if there would be too many shards.
SHARD_BYTES = 32 << 20
MOST_SHARDS = 10_240
#: A shard goes on in another file after this share of its bytes, compressed.
ROLL_SHARE = 8
#: What a record has beside its payload, about.
_HEAD_BYTES = 600
#: Bits of the id by which ranges are counted, and by which a range that holds too much is counted anew.
_BITS, _MORE_BITS = 16, 8
DATE = "1970-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def record_id(page_id: int | None, digest: str, nth: int = 0) -> str:
    """The id of the ``nth`` record of a page id and payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}' + (f'#{nth}' if nth else ''))}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, nth: int = 0) -> bytes:
    """One uncompressed record; a revisit keeps the HTTP headers and no payload. A url with other
    characters than a URI's is also kept as it is, percent-quoted whole."""
    block = _HTTP % len(payload) + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest, nth)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if url is not None:
        uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")
        head.append("WARC-Target-URI: " + uri)
        if uri != url:
            head.append("X-Page-Url: " + quote(url, safe=""))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member without time or name."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + c.compress(data) + c.flush() + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


_TEMPORARY = "_temporary-"
_MANIFEST = "path string, records long, bytes long, sha256 string"


def _writer(folder: str, roll: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open_fs(folder)
        attempt = TaskContext.get().taskAttemptId()
        out, rows, no, shard, last, nth = None, [], 0, None, None, 0

        def close():
            nonlocal out
            out[0].close()
            final = f"shard-{shard:06d}-{no - 1:05d}.warc.gz"
            fs.move(out[1], posixpath.join(base, final))
            rows.append((final, out[2], out[3], out[4].hexdigest()))
            out = None

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    if out is not None:
                        close()
                    shard, no = row["shard"], 0
                if out is None:
                    temp = posixpath.join(base, f"{_TEMPORARY}{shard:06d}-{no:05d}-{attempt}")
                    out, no = [fs.open_output_stream(temp, compression=None), temp, 0, 0, hashlib.sha256()], no + 1
                same = (row["page_id"], row["digest"])
                nth, last = nth + 1 if same == last else 0, same
                data = gzip_member(record(row["page_id"], row["url"], (row["html"] or "").encode(), row["digest"], "response" if row["refers_to"] is None else "revisit", row["refers_to"], nth))
                out[0].write(data)
                out[2] += 1
                out[3] += len(data)
                out[4].update(data)
                if out[3] >= roll:
                    close()
        if out is not None:
            close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["path", "records", "bytes", "sha256"])

    return write


def _levels(bits: int) -> list[int]:
    """Shifts of a number of ``bits`` bits, from the coarsest ranges to single numbers."""
    shifts = [max(0, bits - _BITS)]
    while shifts[-1]:
        shifts.append(max(0, shifts[-1] - _MORE_BITS))
    return shifts


def _sharded(x: DataFrame, low: int | None, high: int | None, shard_bytes: int) -> tuple[DataFrame, int]:
    """``x (page_id, digest, size)`` with ``shard``, and the number of shards.

    Bytes are counted by ranges of ids, at most 2**16 of them; a range that holds more
    than a shard is counted anew by 2**8 ranges within, down to single ids and then to the first
    digits of the digest. The counts meet on the driver: at most 2**16 and 2**8 for
    each shard. Neighbouring ranges fill a shard together."""
    spark = x.sparkSession
    sign = 1 << 63
    bits = ((low + sign) ^ (high + sign)).bit_length() if low is not None else 1
    mask = (1 << bits) - 1
    number = F.col("page_id").bitwiseXOR(F.lit(-sign)).bitwiseAND(F.lit(mask - (1 << 64) if mask >= sign else mask))
    x = x.withColumn("_id", F.coalesce(number, F.lit(mask - (1 << 64) if mask >= sign else mask)))
    names, keys = [], []
    for shift in _levels(bits):
        keys.append(F.shiftrightunsigned("_id", shift))
    keys.append(F.conv(F.substring("digest", 1, 2), 16, 10).cast("long"))
    names = [f"_k{i}" for i in range(len(keys))]
    ids = x.select("page_id", "digest", "size", *[k.alias(n) for k, n in zip(keys, names, strict=True)])
    # A leaf is the path of keys to a range that is not divided further.
    leaves: dict[tuple, int] = {}
    heavy: list[tuple] | None = None
    for depth in range(len(keys)):
        some = ids
        if heavy is not None:
            some = ids.join(F.broadcast(_paths(spark, heavy, names[:depth])), names[:depth], "left_semi")
        found = some.groupBy(*names[: depth + 1]).agg(F.sum(F.col("size") + _HEAD_BYTES).alias("n")).toArrow()
        columns = [found.column(c).to_pylist() for c in (*names[: depth + 1], "n")]
        heavy = []
        for *path, n in zip(*columns, strict=True):
            if n > shard_bytes and depth + 1 < len(keys):
                heavy.append(tuple(path))
            else:
                leaves[tuple(path)] = n
        if not heavy:
            break
    shard, held, places = 0, 0, {}
    for path in sorted(leaves, key=lambda p: [k & (1 << 64) - 1 for k in p]):
        if held and held + leaves[path] > shard_bytes:
            shard, held = shard + 1, 0
        places[path] = shard
        held += leaves[path]
    x = x.select("*", *[k.alias(n) for k, n in zip(keys, names, strict=True)])
    picked = F.lit(None).cast("int")
    for depth in range(len(keys)):
        of = [(*p, s) for p, s in places.items() if len(p) == depth + 1]
        if of:
            # As many rows as there are ranges: bounded above.
            x = x.join(F.broadcast(_paths(spark, of, [*names[: depth + 1], f"_s{depth}"])), names[: depth + 1], "left")
            picked = F.coalesce(picked, F.col(f"_s{depth}").cast("int"))
    return x.withColumn("shard", picked).drop(*names, "_id"), shard + 1


def _paths(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]
    return spark.createDataFrame(pa.table(columns, names=names))


def write_archives(pages: DataFrame, folder: str, roll_bytes: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write one record per row of ``pages (page_id, url, html)``; returns the manifest.

    A null html is an empty payload, a null url leaves its header out. Of records
    with equal payloads of at least 100 bytes those with the smallest page_id are
    responses and the others revisit it; a null id is larger than all others (if
    all are null, all are responses). Rows of one page_id and payload stay in one shard, and only
    the first has the id that revisits refer to. Further columns are not read; an empty
    table gives an empty manifest. Nothing is read from the folder's listing: only files in the
    manifest count. Equal tables give equal files, however their rows lie and whatever the
    session; shards grow beyond ``shard_bytes`` where there would be more than 10,240, and files roll at an
    eighth of that, compressed, or at ``roll_bytes``."""
    spark = pages.sparkSession
    x = pick(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    x = x.withColumn("size", F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")).withColumn("digest", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))
    same = x.where(F.col("size") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    same = store(same.where("n > 1 and first is not null").select("digest", "first"), "equal-payloads")
    total, low, high = x.agg(F.sum(F.col("size") + _HEAD_BYTES), F.min("page_id"), F.max("page_id")).first()
    shard_bytes = max(shard_bytes, -(-(total or 0) // MOST_SHARDS))
    few = same.count()
    x = x.join(F.broadcast(same) if few <= 100_000 else same, "digest", "left")
    x = x.withColumn("refers_to", F.when((F.col("size") >= LEAST_SHARED) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    x, shards = _sharded(x, low, high, shard_bytes)
    x = x.select("shard", "page_id", "url", "html", "digest", "refers_to").repartitionById(shards, F.col("shard"))
    x = x.sortWithinPartitions("shard", F.asc_nulls_last("page_id"), "digest", "url")
    fs, base = _open_fs(folder)
    fs.create_dir(base, recursive=True)
    arrow_map(x, _writer(folder, roll_bytes or shard_bytes // ROLL_SHARE), _MANIFEST).write.parquet(f"{folder}/_manifest")
    for f in fs.get_file_info(_selector(base)):
        if f.base_name.startswith(_TEMPORARY):
            fs.delete_file(f.path)
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest")


def _selector(base: str):
    from pyarrow import fs

    return fs.FileSelector(base)


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or len(block) != int(fields["Content-Length"]):
        raise ValueError("a record is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def members(stream, size: int = 1 << 16) -> Iterator[bytes]:
    """The uncompressed gzip members of a stream, one at a time."""
    rest = b""
    while True:
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            if not rest:
                rest = stream.read(size)
                if not rest:
                    if parts or d.unconsumed_tail:
                        raise ValueError("a gzip member is cut off")
                    return
            parts.append(d.decompress(rest))
            rest = d.unused_data
        yield b"".join(parts)


_READ = "page_id long, url string, record_id string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open_fs(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                with fs.open_input_stream(posixpath.join(base, name), compression=None) as f:
                    for data in members(f):
                        w, http, payload = parse(data)
                        digest = w["WARC-Payload-Digest"].removeprefix("sha256:")
                        kind, n = w["WARC-Type"], int(http["Content-Length"])
                        if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != n):
                            raise ValueError(f"{name}: digest or length of {w['WARC-Record-ID']} is wrong")
                        page, refers = w.get("X-Page-Id"), w.get("X-Refers-To-Page-Id")
                        url = w.get("WARC-Target-URI") if "X-Page-Url" not in w else unquote(w["X-Page-Url"])
                        rows.append((page and int(page), url, w["WARC-Record-ID"], kind, refers and int(refers), digest, n, payload if kind == "response" else None))
                        held += len(payload)
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return read


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in _READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the archives in ``manifest``, digests and lengths checked on reading."""
    files = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return arrow_map(manifest.select("path").repartition(files, "path"), _reader(folder), _READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first_id IS NULL OR f.first_id = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first_id IS NULL OR f.first_id = p.page_id THEN NULL ELSE f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_bytes >= 100 AND p.payload_digest = f.payload_digest
"""
