"""WARC archives with one Zstandard dictionary each.

An archive file is: a skippable frame (magic 0x184D2A5D) that holds the dictionary, a frame with the warcinfo
record, then one frame for each record, compressed with that dictionary, so that any record can be read alone
by offset. The dictionary is trained on the first records that the archive itself stores, up to
``train_bytes`` of payload: a bound on memory and time that changes only the compression, never the content.

Of records with equal payloads, that with the largest page id is a ``response``; the others are ``revisit``
records that hold no payload. Only digests and ids are grouped; payloads are joined to the groups that have
several rows, and adaptive skew joins split a payload shared by very many pages.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.shared import AttemptFile, RangeReader, partitions, shared_dir, table, written

DICTIONARY_MAGIC = (0x184D2A5D).to_bytes(4, "little")
DICT_BYTES = 32 << 10
TRAIN_BYTES = 2 << 20
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
INDEX = "archive string, offset long, length long, page_id long"
RECORD = "archive string, offset long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): what to store for each row; refers_to is null for responses.

    Null html is an empty payload. Payloads below ``least_bytes`` are always responses. Repeated rows with the
    largest page id of their payload are all responses; a null page id never wins over another, and rows of a
    payload that has only null ids are all responses."""
    own = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    many = own.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    many = written(many.where("n > 1").select("digest", "first"), "payload-groups")
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return own.join(many, "digest", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = base32_sha1(payload)
    own = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {digest}")
    fields = [("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", _clean(url)))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return _record("response", [*fields, ("Content-Type", "application/http;msgtype=response")], http + payload)
    fields += [
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to} {digest}')}>"),
        ("X-Refers-To-Page-ID", str(refers_to)),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    return _record("revisit", fields, http)


def train(samples: list[bytes], dict_bytes: int) -> bytes:
    """A Zstandard dictionary, or as a raw-content dictionary the last bytes of samples too few to train on."""
    if len(samples) >= 16:
        try:
            return zstd.train_dictionary(dict_bytes, samples, k=256, d=8).as_bytes()
        except zstd.ZstdError:
            pass  # too little variety
    return b"".join(samples)[-dict_bytes:]


class ArchiveWriter:
    def __init__(self, folder: str, dict_bytes: int, train_bytes: int, level: int):
        self.folder, self.dict_bytes, self.train_bytes, self.level = folder, dict_bytes, train_bytes, level
        self.waiting: list[tuple[int | None, bytes]] = []
        self.held, self.file = 0, None

    def add(self, page_id: int | None, record: bytes) -> list[tuple]:
        """Index rows of what was written."""
        if self.file is None:
            self.waiting.append((page_id, record))
            self.held += len(record)
            return self.start() if self.held >= self.train_bytes else []
        return [self._put(page_id, record)]

    def start(self) -> list[tuple]:
        content = train([r for _, r in self.waiting], self.dict_bytes)
        packed = zstd.ZstdCompressor(level=19).compress(content)
        self.file = AttemptFile(self.folder, "archive", ".warc.zst")
        self.file.write(DICTIONARY_MAGIC + len(packed).to_bytes(4, "little") + packed)
        self.press = zstd.ZstdCompressor(level=self.level, dict_data=zstd.ZstdCompressionDict(content), write_content_size=True)
        info = b"software: terrace\r\nformat: WARC File Format 1.1\r\n"
        self._put(None, _record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, self.file.name)}>"), ("Content-Type", "application/warc-fields")], info))
        out = [self._put(*x) for x in self.waiting]
        self.waiting, self.held = [], 0
        return out

    def _put(self, page_id: int | None, record: bytes) -> tuple:
        data = self.press.compress(record)
        return self.file.name, self.file.write(data), len(data), page_id

    def close(self) -> list[tuple]:
        out = self.start() if self.waiting else []
        if self.file is not None:
            self.file.close()
        self.file = None
        return out


def _index(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["archive", "offset", "length", "page_id"])


def write_archives(
    records: DataFrame, folder: str, dict_bytes: int = DICT_BYTES, train_bytes: int = TRAIN_BYTES, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL
) -> DataFrame:
    """Write (page_id, url, payload, refers_to) to archives below ``folder`` (a URI); returns their index.

    A task that runs again writes new files; only those of the attempt that counts are in the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ArchiveWriter(folder, dict_bytes, train_bytes, level)
        for b in batches:
            rows = []
            for page_id, url, payload, refers in zip(*(b.column(i) for i in range(4)), strict=True):
                page_id = page_id.as_py()
                rows += out.add(page_id, make_record(page_id, url.as_py(), payload.as_py(), refers.as_py()))
                if out.file is not None and out.file.size >= archive_bytes:
                    rows += out.close()
            yield _index(rows)
        yield _index(out.close())

    return written(records.select("page_id", "url", "payload", "refers_to").mapInArrow(run, INDEX), "warc-index")


def parse_record(record: bytes) -> dict:
    """The fields of ``RECORD`` but for the place; raises if the payload doesn't have its digest and length."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block, tail = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
    if tail != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    digest, length, payload = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"]), None
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if (base32_sha1(payload), len(payload)) != (digest, length):
            raise ValueError(f"payload of {len(payload)} bytes doesn't match its digest {digest}")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID"),
        "payload_bytes": length, "payload_digest": digest, "payload": payload,
    }


def archive_dictionary(reader: RangeReader, name: str) -> zstd.ZstdDecompressor:
    head = reader.read(name, 0, 8)
    if head[:4] != DICTIONARY_MAGIC:
        raise ValueError(f"{name} has no dictionary frame")
    content = zstd.ZstdDecompressor().decompress(reader.read(name, 8, int.from_bytes(head[4:], "little")))
    return zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(content))


def read_archives(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records at the places that ``index`` names; ``payloads=False`` checks payloads but leaves them out."""
    run_bytes = 4 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, name, press = RangeReader(folder), None, None
        kinds = [("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                 ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
        schema = pa.schema(kinds)
        for b in batches:
            rows, held = [], 0
            places = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
            i = 0
            while i < len(places):
                j, (archive, first, _) = i + 1, places[i]
                # Records that lie together are read at once.
                while j < len(places) and places[j][0] == archive and places[j][1] == places[j - 1][1] + places[j - 1][2] and places[j][1] + places[j][2] - first <= run_bytes:
                    j += 1
                if archive != name:
                    name, press = archive, archive_dictionary(reader, archive)
                data = memoryview(reader.read(archive, first, places[j - 1][1] + places[j - 1][2] - first))
                for _, offset, length in places[i:j]:
                    row = parse_record(press.decompress(data[offset - first : offset - first + length])) | {"archive": archive, "offset": offset}
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    held += len(row["payload"] or b"")
                if held > run_bytes:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
                i = j
            yield pa.RecordBatch.from_pylist(rows, schema)
        reader.close()

    n = partitions(index.sparkSession)
    places = index.select("archive", "offset", "length").repartitionByRange(n, "archive", "offset").sortWithinPartitions("archive", "offset")
    return places.mapInArrow(run, RECORD)


def op1_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    index = write_archives(plan_records(table(spark, sf_dir, "pages")), folder)
    return read_archives(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The query in DuckDB's SQL; base32 is spelt out as 32 groups of 5 bits.
ORACLE = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS m FROM pages)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_aggregate(list_transform(range(5), lambda j: (ascii(substr(bits, (5 * i + j + 1)::BIGINT, 1)) - 48) << (4 - j)::INT), 'sum')::BIGINT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN m = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN m <> page_id THEN m END AS refers_to
FROM (SELECT *, unhex(sha1(h))::BIT::VARCHAR AS bits FROM p)"""
