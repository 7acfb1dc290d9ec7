"""Legacy archive (ARC) conversion to WARC.

``parse_arc`` reads ARC version 1 and 2: the version block names the version and the fields of the header lines; each record is a header line
followed by as many bytes as its last field declares. ``convert`` turns the records of ARC files into WARC records: identifiers are UUIDs
derived from address, date and digest, dates are ISO 8601, types are response or revisit, digests are SHA-1 of the payload. ``read_warc`` reads WARC files back.

Every record is a gzip member of its own, so a record is read by its offset alone. Files go to the shared folder under names that no
other attempt of a task uses, and only files that a finished task has reported count: a task that is run again leaves no double.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest key is the response and the others are revisits of it; smaller
ones are responses. Null bodies are empty; null addresses get a ``urn:`` address; white space in addresses is escaped. A record with a null key has no key header
and is a response only if no other of its payload has a key; of records with one key and one payload one is the response and the others revisit it. Other columns of
the input are not read, so none can clash.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.ship import ship
from tideline.llm.common import cut, fresh_path

#: Fields of an ARC header line by version.
ARC_FIELDS = {
    "1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    "2": ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
KEY = b"X-Record-Key"
FILE_BYTES = 64 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def arc_head(version: str, name: str, date: str) -> bytes:
    body = f"{version} 0 tideline\n{' '.join(ARC_FIELDS[version])}\n".encode()
    tail = f"text/plain {len(body)}" if version == "1" else f"text/plain 200 - - 0 {name} {len(body)}"
    return f"filedesc://{name} 0.0.0.0 {date} {tail}\n".encode() + body + b"\n"


def arc_record(version: str, url: str, date: str, body: bytes, offset: int, name: str) -> bytes:
    kind = "text/html"
    line = f"{url} 0.0.0.0 {date} {kind} {len(body)}" if version == "1" else f"{url} 0.0.0.0 {date} {kind} 200 {hashlib.md5(body).hexdigest()} - {offset} {name} {len(body)}"
    return line.encode() + b"\n" + body + b"\n"


def parse_header(line: bytes, version: str) -> dict[str, str]:
    """The fields of one header line. The address may hold spaces: the other fields are counted from the right."""
    names = ARC_FIELDS[version]
    parts = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
    if len(parts) != len(names) or not parts[-1].isdigit():
        raise ValueError(f"not an ARC version {version} header line: {line[:200]!r}")
    return dict(zip(names, parts, strict=True))


def parse_arc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, body) of each record of an ARC stream after its version block."""
    first = stream.readline()
    if not first:
        return
    size = int(first.rsplit(b" ", 1)[1])
    block = stream.read(size)
    version = block[:1].decode()
    if version not in ARC_FIELDS:
        raise ValueError(f"unknown ARC version {version!r}")
    while line := stream.readline():
        if not line.strip():
            continue
        fields = parse_header(line, version)
        body = stream.read(int(fields["Archive-length"]))
        if len(body) != int(fields["Archive-length"]):
            raise ValueError("an ARC record ends before its declared length")
        yield fields, body


def warc_date(arc_date: str) -> str:
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, digest: str, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {key}')}>"


def _b32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP header block, with its empty line, and payload."""
    at = body.find(b"\r\n\r\n")
    return (body, b"") if at < 0 else (body[: at + 4], body[at + 4 :])


def http_value(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n"):
        if line[: len(name) + 1].lower() == name.lower() + b":":
            return line[len(name) + 1 :].strip().decode()
    return None


def _key(head: bytes) -> int | None:
    value = http_value(head, KEY)
    return None if value is None else int(value)


def warc_record(fields: dict[str, str], body: bytes, refers_to: tuple[str, str] | None) -> bytes:
    """A WARC/1.0 record of an ARC record; ``refers_to``: (record id, key or none) of the response if it is a revisit."""
    head, payload = split_http(body)
    digest, date = hashlib.sha1(payload).hexdigest(), warc_date(fields["Archive-date"])
    key = http_value(head, KEY) or ""
    lines = [
        "WARC/1.0", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {record_id(fields['URL'], fields['Archive-date'], digest, key)}",
        f"WARC-Target-URI: {fields['URL']}", f"WARC-IP-Address: {fields['IP-address']}", f"WARC-Date: {date}", f"WARC-Payload-Digest: {_b32(digest)}",
    ]
    if refers_to:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to[0]}", *([f"X-Refers-To-Key: {refers_to[1]}"] if refers_to[1] else [])]
    block = head if refers_to else body
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def read_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.partition(b":")
            fields[name.decode()] = value.strip().decode("utf-8", "replace")
        yield fields, stream.read(int(fields["Content-Length"]))


class _Writer:
    """Members written to files of bounded size in the shared folder; reports (file, offset, length)."""

    def __init__(self, folder: str, ending: str):
        self.folder, self.ending, self.out = folder, ending, None

    def begin(self) -> bool:
        """True if the next member starts a file."""
        if self.out is not None and self.at < FILE_BYTES:
            return False
        self.close()
        fs, root = _open(self.folder)
        fs.create_dir(root, recursive=True)
        self.name = f"{uuid.uuid4().hex}{self.ending}"
        self.out, self.at = fs.open_output_stream(f"{root}/{self.name}", compression=None), 0
        return True

    def put(self, data: bytes) -> tuple[str, int, int]:
        member = gzip.compress(data, 1, mtime=0)
        self.out.write(member)
        place = (f"{self.folder}/{self.name}", self.at, len(member))
        self.at += len(member)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def write_arc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", date: str = "20240101000000") -> DataFrame:
    """(file, offset, length): pages as ARC records, in version 1 and version 2 files in turn."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, files, version = _Writer(folder, ".arc.gz"), 0, "1"
        for b in batches:
            places = []
            for k, u, h in zip(b["k"], b["u"], b["h"], strict=True):
                if out.begin():
                    files += 1
                    version = "12"[files % 2]
                    out.put(arc_head(version, out.name, date))
                payload = (h or "").encode("utf-8", "surrogatepass")
                own = b"%s: %s\r\n" % (KEY, k.encode()) if k is not None else b""
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n%s\r\n" % (len(payload), own)
                address = quote(u, safe="%/:?#[]@!$&'()*+,;=~") if u else f"urn:record:{k or 'none'}"
                places.append(out.put(arc_record(version, address, date, head + payload, out.at, out.name)))
            yield pd.DataFrame(places, columns=["file", "offset", "length"])
        out.close()

    return pages.select(F.col(key).cast("string").alias("k"), F.col(url).alias("u"), F.col(html).alias("h")).mapInPandas(run, "file string, offset long, length long")


def _arc_members(rows: pd.DataFrame, source: dict) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(row number, fields, body) of ARC records by their places; a file's version is read once."""
    for i, (file, offset, length) in enumerate(zip(rows["file"], rows["offset"], rows["length"], strict=True)):
        if source.get("file") != file:
            if "in" in source:
                source["in"].close()
            fs, path = _open(file)
            source["file"], source["in"] = file, fs.open_input_file(path)
            head = zlib.decompressobj(31).decompress(source["in"].read(1 << 12))
            source["head"] = head[: head.index(b"\n") + 1 + int(head.split(b"\n", 1)[0].rsplit(b" ", 1)[1])] + b"\n"
        source["in"].seek(int(offset))
        data = gzip.decompress(source["in"].read(int(length)))
        for fields, body in parse_arc(io.BytesIO(source["head"] + data)):
            yield i, fields, body


def arc_index(places: DataFrame) -> DataFrame:
    """(file, offset, length, key, url, date, payload_bytes, digest) of ARC records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source: dict = {}
        for b in batches:
            rows = []
            for i, fields, body in _arc_members(b, source):
                head, payload = split_http(body)
                rows.append((b["file"].iat[i], b["offset"].iat[i], b["length"].iat[i], _key(head), fields["URL"], fields["Archive-date"], len(payload), hashlib.sha1(payload).hexdigest()))
            yield pd.DataFrame(rows, columns=["file", "offset", "length", "key", "url", "date", "payload_bytes", "digest"]).assign(key=pd.array([r[3] for r in rows], "Int64"))

    return places.mapInPandas(run, "file string, offset long, length long, key long, url string, date string, payload_bytes long, digest string")


def decide(index: DataFrame, min_bytes: int = 1000, salts: int = 16) -> DataFrame:
    """``index`` with revisit (whether it is one) and (ref_key, ref_url, ref_date) of the response it revisits. Groups of equal payloads are dealt out by salt."""
    at = ["key", "url", "date", "file", "offset"]
    slim = index.filter(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(*at)).alias("best")).filter("n > 1")
    spread = slim.select("digest", "best", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = index.withColumn("salt", F.pmod(F.xxhash64("file", "offset"), F.lit(salts)).cast("int"))
    joined = salted.join(spread, ["digest", "salt"], "left")
    other = F.coalesce((F.col("payload_bytes") >= min_bytes) & ((F.col("best.file") != F.col("file")) | (F.col("best.offset") != F.col("offset"))), F.lit(False))
    return joined.select(*index.columns, other.alias("revisit"), *[F.when(other, F.col(f"best.{c}").cast("string")).alias(f"ref_{c}") for c in ("key", "url", "date")])


def convert(decided: DataFrame, folder: str) -> DataFrame:
    """(file, offset, length): the ARC records as WARC records in files under ``folder``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, source = _Writer(folder, ".warc.gz"), {}
        for b in batches:
            places = []
            for i, fields, body in _arc_members(b, source):
                r = b.iloc[i]
                other = (record_id(r["ref_url"], r["ref_date"], r["digest"], r["ref_key"] or ""), r["ref_key"]) if r["revisit"] else None
                out.begin()
                places.append(out.put(warc_record(fields, body, other)))
            yield pd.DataFrame(places, columns=["file", "offset", "length"])
        out.close()

    slim = decided.select("file", "offset", "length", "digest", "revisit", "ref_key", "ref_url", "ref_date")
    return slim.repartition("file", F.floor(F.col("offset") / (8 << 20))).sortWithinPartitions("file", "offset").mapInPandas(run, "file string, offset long, length long")


def read_back(places: DataFrame) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) of WARC records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, stream = None, None
        for b in batches:
            rows = []
            for file, offset, length in zip(b["file"], b["offset"], b["length"], strict=True):
                if at != file:
                    if stream:
                        stream.close()
                    fs, path = _open(file)
                    at, stream = file, fs.open_input_file(path)
                stream.seek(int(offset))
                for fields, block in read_warc(io.BytesIO(gzip.decompress(stream.read(int(length))))):
                    head, payload = split_http(block)
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    revisit = fields["WARC-Type"] == "revisit"
                    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                    size = int(http_value(head, b"Content-Length")) if revisit else len(payload)
                    other = fields.get("X-Refers-To-Key")
                    rows.append((_key(head), size, digest, fields["WARC-Type"], int(other) if other else None))
            out = pd.DataFrame(rows, columns=["key", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            yield out.assign(**{c: pd.array([r[i] for r in rows], "Int64") for c, i in (("key", 0), ("refers_to", 4))})

    return places.mapInPandas(run, "key long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 1000) -> DataFrame:
    """Pages as ARC files, converted to WARC files, read back."""
    spark = pages.sparkSession
    ship(spark)
    arcs = cut(write_arc(pages, fresh_path(spark, "arc"), key, url, html))
    warcs = cut(convert(decide(cut(arc_index(arcs)), min_bytes), fresh_path(spark, "warc")))
    return read_back(warcs)
