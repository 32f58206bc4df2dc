"""WARC archives: writing, normalising whole-file gzip streams into one member per record, and reading by offset.

An archive compressed as a single gzip stream can only be read from its start. The normaliser inflates such a
stream once, piece by piece, writes every record as a gzip member of its own, and writes an index of offsets
beside it; readers then take any record alone. Archives go to the shared folder. Their names carry the task
attempt that wrote them, and only names in a committed manifest are read, so that lost executors and
repeated attempts leave unused files at worst.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialised, parallelism, scratch

ARCHIVE_BYTES = 64_000_000
READ_BYTES = 1_000_000
MIN_REVISIT_BYTES = 100
SALTS = 16
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "path string, index string, records long"


def with_record_types(df: DataFrame, *, id_col: str, url_col: str, payload_col: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """id, url, payload, n_bytes, digest, kind and refers_to of each row.

    Of equal payloads of at least min_bytes, the row with the smallest id is the response and others revisit
    it. Rows with a null id are responses, as are rows that share the smallest id. Hot payloads are counted
    before the exchange and spread over SALTS keys in the join.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    firsts = rows.where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(firsts, ["digest", "salt"], "left")
    revisit = F.col("id") > F.col("first")
    return rows.select("id", "url", "payload", "n_bytes", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("refers_to"))


def record(row: dict) -> bytes:
    """One WARC record. A revisit has no payload; its digest and length are those of the payload it stands for."""
    head = ["WARC/1.1", f"WARC-Type: {row['kind']}"]
    if row["id"] is not None:
        head.append(f"WARC-Record-ID: <urn:row:{row['id']}>")
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + quote(row["url"], safe="!#$%&'()*+,/:;=?@[]~"))
    head += ["WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{row['digest']}", f"WARC-Payload-Length: {row['n_bytes']}"]
    if row["kind"] == "revisit":
        head += [f"WARC-Refers-To: <urn:row:{row['refers_to']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        body = b""
    else:
        body = HTTP + row["payload"].encode("utf-8", "surrogatepass")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and whole bytes of the records of an inflated stream, holding one record and one piece at most."""
    held = bytearray()

    def until(ready) -> bool:
        while not ready():
            piece = next(stream, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while until(lambda: held.find(b"\r\n\r\n") >= 0):
        end = held.find(b"\r\n\r\n")
        lines = held[:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = end + 4 + int(headers["content-length"]) + 4
        if not until(lambda size=size: len(held) >= size):
            raise ValueError("the archive ends within a record")
        yield headers, bytes(held[:size])
        del held[:size]
    if held:
        raise ValueError("the archive ends within a record")


def inflate(file: BinaryIO) -> Iterator[bytes]:
    """The content of a gzip file, of one or more members, piece by piece."""
    z = zlib.decompressobj(31)
    data = file.read(READ_BYTES)
    while data:
        piece = z.decompress(data, READ_BYTES)
        if piece:
            yield piece
        data = z.unconsumed_tail
        if z.eof:
            data, z = z.unused_data, zlib.decompressobj(31)
        if not data:
            data = file.read(READ_BYTES)


def write_monolithic(rows: DataFrame, root: str, *, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows of with_record_types() as archives that are one gzip stream each; the committed manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(root)
        fs.create_dir(f"{base}/whole", recursive=True)
        task = TaskContext.get()
        file = z = None
        made: list[tuple[str, int]] = []
        size = n = 0
        for batch in batches:
            for i in range(batch.num_rows):
                if file is None:
                    path = f"{base}/whole/{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):05d}.warc.gz"
                    file, z, size, n = fs.open_output_stream(path, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                data = record(batch.slice(i, 1).to_pylist()[0])
                file.write(z.compress(data))
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    file.write(z.flush())
                    file.close()
                    made.append((path, n))
                    file = None
        if file is not None:
            file.write(z.flush())
            file.close()
            made.append((path, n))
        yield _manifest([(p, None, n) for p, n in made])

    return materialised(rows.mapInArrow(run, MANIFEST), "warc-whole")


def normalise(manifest: DataFrame, root: str) -> DataFrame:
    """Rewrite each archive of the manifest with a member per record and an index beside it; the new manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(root)
        fs.create_dir(f"{base}/members", recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            made = []
            for path in batch.column(0).to_pylist():
                name = f"{base}/members/{path.rsplit('/', 1)[1].removesuffix('.warc.gz')}-{attempt}"
                offset = n = 0
                with fs.open_input_stream(path, compression=None) as source, fs.open_output_stream(f"{name}.warc.gz", compression=None) as out, fs.open_output_stream(f"{name}.idx", compression=None) as index:
                    for headers, data in records(inflate(source)):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(data) + z.flush()
                        out.write(member)
                        entry = {"offset": offset, "length": len(member), "type": headers["warc-type"], "id": headers.get("warc-record-id"), "uri": headers.get("warc-target-uri")}
                        index.write(json.dumps(entry).encode() + b"\n")
                        offset, n = offset + len(member), n + 1
                made.append((f"{name}.warc.gz", f"{name}.idx", n))
            yield _manifest(made)

    spread = manifest.repartition(parallelism(manifest.sparkSession))
    return materialised(spread.mapInArrow(run, MANIFEST), "warc-members")


def read(manifest: DataFrame, root: str) -> DataFrame:
    """Every record of normalised archives, taken by its offset: id, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to, as strings where not numbers.

    A response's length and digest are taken from its payload; one that its header contradicts is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = FileSystem.from_uri(root)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_stream(row["index"], compression=None) as f:
                    entries = [json.loads(x) for x in f.read().splitlines()]
                with fs.open_input_file(row["path"]) as f:
                    found, size = [], 0
                    for e in entries:
                        f.seek(e["offset"])
                        [(headers, data)] = records(iter([zlib.decompress(f.read(e["length"]), 31)]))
                        found.append(_parsed(headers, data))
                        size += len(data)
                        if size >= READ_BYTES:
                            yield pa.RecordBatch.from_pylist(found, READ_SCHEMA)
                            found, size = [], 0
                    yield pa.RecordBatch.from_pylist(found, READ_SCHEMA)

    spread = manifest.repartition(parallelism(manifest.sparkSession))
    return spread.mapInArrow(run, "id string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string")


READ_SCHEMA = pa.schema([("id", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])


def round_trip(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES, root: str | None = None) -> DataFrame:
    """Write every row as a WARC record in monolithic archives, normalise those, and read the records back.

    Returns id_col, payload_bytes, payload_digest (lower-case hex SHA-256), record_type, refers_to and payload
    (binary; null for revisits), a row for each input row. A null payload is empty. Null and repeated ids,
    repeated rows, null addresses and other columns with any names are allowed; an empty table gives an
    empty result. The archives stay in `root` (by default a new path in the shared folder).
    """
    kind = df.schema[id_col].dataType
    root = root or scratch(df.sparkSession, "warc")
    typed = with_record_types(df, id_col=id_col, url_col=url_col, payload_col=payload_col, min_bytes=min_bytes)
    rows = read(normalise(write_monolithic(typed, root), root), root)
    return rows.select(F.col("id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "payload")


def _manifest(made: list[tuple]) -> pa.RecordBatch:
    paths, indexes, counts = zip(*made, strict=True) if made else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(indexes, pa.string()), pa.array(counts, pa.int64())], names=["path", "index", "records"])


def _bare(urn: str | None) -> str | None:
    return urn and urn.removeprefix("<urn:row:").removesuffix(">")


def _parsed(headers: dict[str, str], data: bytes) -> dict:
    kind, digest, size = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:"), int(headers["warc-payload-length"])
    payload = None
    if kind != "revisit":
        body = data[data.index(b"\r\n\r\n") + 4 : -4]
        payload = body[body.index(b"\r\n\r\n") + 4 :]
        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
            raise ValueError(f"the payload of {headers.get('warc-record-id')} isn't what its header says")
    return {"id": _bare(headers.get("warc-record-id")), "payload": payload, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _bare(headers.get("warc-refers-to"))}
