"""Convert legacy ARC archives to WARC, write WARC files, and read them back."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one ARC archive that the writer fills before it starts another.
ARC_BYTES = 1 << 20
#: Records in one WARC file; a reader holds one file at a time.
WARC_RECORDS = 1000
#: The field lists that the version block of an ARC file declares.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ARCHIVES = "name string, content binary"
RECORDS = "uri string, ip string, date string, mime string, head binary, bytes long, digest string, payload binary"
#: Records that leave a task together.
TOGETHER = 250
BLANK = b"\r\n\r\n"


def arc_archive(name: str, version: int, records: Iterable[tuple[str, str, str, str, bytes]]) -> bytes:
    """The bytes of an ARC file of (url, ip, date, mime, block) records, uncompressed."""
    body = f"{version} 0 corpus\n{ARC_FIELDS[version]}\n".encode()
    length = len(body) + 1
    middle = " 200 - - 0 " + name if version == 2 else ""
    out = [f"filedesc://{name} 0.0.0.0 20080101000000 text/plain{middle} {length}\n".encode(), body, b"\n"]
    for url, ip, date, mime, block in records:
        # Spaces separate the fields of the header line, so they are escaped inside a URL.
        line = f"{escape(url)} {ip} {date} {mime}{middle} {len(block)}\n"
        out += [b"\n", line.encode(), block]
    return b"".join(out) + b"\n"


def escape(url: str) -> str:
    return url.replace("%", "%25").replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D") or "-"


def unescape(url: str) -> str:
    return "" if url == "-" else url.replace("%0D", "\r").replace("%0A", "\n").replace("%20", " ").replace("%25", "%")


def arc_records(content: bytes) -> Iterator[dict[str, object]]:
    """The records of an ARC file: its header line's fields by name, and `block`.

    The first record is the version block; its first line says the version, its second the names of
    the fields, and every later header line is read by them. The last field is the block's length:
    a block is cut by it, never by its content. Blank lines between records are skipped. A file
    that ends inside a block, or a header line that does not have the declared fields, raises.
    """
    fields, at = ARC_FIELDS[1].split(), 0
    first = True
    while True:
        while content[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(content):
            return
        end = content.index(b"\n", at)
        values = content[at:end].decode("utf-8").rstrip("\r").split(" ")
        length = int(values[-1])
        block = content[end + 1 : end + 1 + length]
        if len(block) < length:
            raise ValueError(f"the archive ends inside the record at byte {at}")
        at = end + 1 + length
        if first:
            version, _, names = block.decode("utf-8").partition("\n")
            if int(version.split(" ")[0]) not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version: {version}")
            fields, first = names.partition("\n")[0].split(" "), False
            continue
        if len(values) != len(fields):
            raise ValueError(f"{len(values)} fields where the version block declares {len(fields)}")
        yield dict(zip(fields, values)) | {"block": block}


def write_arc(rows: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """ARC archives (name, content) of the rows; even ids in version 1, odd ones in version 2.

    Blocks are HTTP responses whose head has the row's id. Archives hold about `ARC_BYTES`; a null
    payload is empty, a null id or url an empty field.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[int, list] = {1: [], 2: []}
            sizes, n = {1: 0, 2: 0}, 0

            def close(version: int) -> pa.RecordBatch:
                name = f"legacy-{version}-{n}.arc"
                content = arc_archive(name, version, held[version])
                held[version], sizes[version] = [], 0
                return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], ["name", "content"])

            ids, urls, payloads = (batch.column(i) for i in range(3))
            for i in range(batch.num_rows):
                key, url, payload = ids[i].as_py(), urls[i].as_py(), payloads[i].as_py() or b""
                version = 1 if (key or 0) % 2 == 0 else 2
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\nX-Row: {'' if key is None else key}\r\n\r\n"
                date = "2008" + "0101" + f"{(key or 0) % 240000 // 10000:02d}{(key or 0) % 6000 // 100:02d}{(key or 0) % 60:02d}"
                held[version].append((url or "", "0.0.0.0", date, "text/html", head.encode() + payload))
                sizes[version] += len(payload)
                if sizes[version] >= ARC_BYTES:
                    n += 1
                    yield close(version)
            for version in (1, 2):
                if held[version]:
                    n += 1
                    yield close(version)

    chosen = rows.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(payload_col).cast("binary"))
    return chosen.mapInArrow(pack, ARCHIVES)


def read_arc(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of ARC archives (a `content` column, such as Spark's binaryFile source gives):
    uri, ip, date, mime, head (the HTTP head with its blank line, or empty), bytes and digest of the
    payload, and the payload, unless it is not asked for."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for r in arc_records(content.as_py()):
                    head, blank, payload = r["block"].partition(BLANK)
                    if not head.startswith(b"HTTP/"):
                        head, blank, payload = b"", b"", r["block"]
                    rows.append((
                        unescape(r["URL"]), r["IP-address"], r["Archive-date"], r["Content-type"], head + blank,
                        len(payload), base32_sha1(payload), payload if payloads else None,
                    ))
                    if len(rows) == TOGETHER:
                        yield packed(rows, RECORDS)
                        rows = []
                if rows:
                    yield packed(rows, RECORDS)

    return archives.select("content").mapInArrow(parse, RECORDS)


_ARROW = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}


def packed(rows: list[tuple], columns: str) -> pa.RecordBatch:
    fields = [x.split(" ") for x in columns.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(zip(*rows), fields)], [name for name, _ in fields]
    )


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def convert(archives: DataFrame, row_header: str = "X-Row", least_bytes: int = 0) -> DataFrame:
    """WARC records of ARC archives (a `content` column), which are read twice: without payloads to
    find the equal ones, and with them to write them. See `to_warc`."""
    return to_warc(read_arc(archives), row_header, least_bytes, read_arc(archives, payloads=False))


def to_warc(
    records: DataFrame, row_header: str = "X-Row", least_bytes: int = 0, narrow: DataFrame | None = None
) -> DataFrame:
    """WARC records from the records of ARC archives: one string column, `record`, of raw bytes
    without the closing blank line. `narrow` may give the same records without payloads.

    Synthesised for each record: the identifier, a UUID of (uri, date, row, digest), the same in
    every run; the timestamp, from the 14 digits of the ARC date (1970 if there are not 14); type
    response or revisit; payload digest; block and its length. Of records with equal payloads of
    `least_bytes` or more, that with the smallest row number is the response and the others revisit
    it, without a copy of the payload. Records without a row number stay responses, and so do
    those that repeat the response's. Payloads are compared by SHA-1 and length.
    """
    head = F.decode("head", "ISO-8859-1")
    row = F.regexp_extract(head, rf"(?i)\r\n{row_header}: (-?\d+)\r\n", 1)
    key = F.concat_ws("|", "uri", "date", "row", "digest")
    hexed = F.md5(key.cast("binary"))
    uuid = F.concat_ws("-", *(F.substring(hexed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    stamp = F.regexp_replace("date", r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")
    named, narrow = (
        x.withColumn("row", F.when(row != "", row.cast("long")))
        .withColumn("urn", F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">")))
        .withColumn("stamp", F.when(F.col("date").rlike(r"^\d{14}$"), stamp).otherwise(F.lit("1970-01-01T00:00:00Z")))
        for x in (records, records if narrow is None else narrow)
    )
    # One row per payload that occurs more than once; combined in every task before the shuffle.
    first = (
        narrow.where(F.col("bytes") >= least_bytes)
        .groupBy("digest", "bytes")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min(F.struct(F.col("row").isNull(), "row", "urn", "uri", "stamp")).alias("first"),
        )
        .where("_n > 1")
        .select("digest", "bytes", "first")
    )
    joined = named.join(first, ["digest", "bytes"], "left")
    revisit = F.coalesce(F.col("row") > F.col("first.row"), F.lit(False))
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    lines = [
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), "urn"),
        F.concat(F.lit("WARC-Date: "), "stamp"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("uri", r"[\r\n]", " ")),
        F.concat(F.lit("WARC-IP-Address: "), "ip"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), "first.urn")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Target-URI: "), F.regexp_replace("first.uri", r"[\r\n]", " "))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Date: "), "first.stamp")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.length(block).cast("string")),
    ]
    # concat_ws leaves out the lines that are null.
    header = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))
    return joined.select(F.concat(header.cast("binary"), block).cast("string").alias("record"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write gzip-compressed WARC files through Spark's own committed output, to any file system.

    The text writer ends every value with the blank line that ends a WARC record, and writes bytes
    as they are.
    """
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", WARC_RECORDS).text(path)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of every record of a WARC file, gzip-compressed or not."""
    if content[:2] == b"\x1f\x8b":
        parts = []
        while content[:2] == b"\x1f\x8b":
            unpack = zlib.decompressobj(31)
            parts.append(unpack.decompress(content))
            content = unpack.unused_data
        content = b"".join(parts)
    at = 0
    while at < len(content):
        end = content.index(BLANK, at)
        version, *lines = content[at:end].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        start = end + 4
        at = start + int(fields["content-length"])
        if content[at : at + 4] != BLANK:
            raise ValueError(f"the record before byte {at} does not end with a blank line")
        yield fields, content[start:at]
        at += 4


WARC_ROWS = "urn string, type string, uri string, stamp string, digest string, refers_urn string, row long, payload_bytes long, payload binary"


def read_warc(spark: SparkSession, path: str, row_header: str = "X-Row", payloads: bool = True) -> DataFrame:
    """The records of the WARC files under `path`; payload_bytes of a revisit comes from its HTTP
    head, its payload is null, as are all if they are not asked for. The digest of a response is computed from the payload that was read;
    if it differs from the one in the header, that raises."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in warc_records(content.as_py()):
                    head, _, payload = block.partition(BLANK)
                    http = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode("latin-1").split("\r\n"))}
                    revisit = fields["warc-type"] == "revisit"
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if not revisit and base32_sha1(payload) != digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
                    row = http.get(row_header.lower(), "")
                    size = int(http["content-length"]) if revisit else len(payload)
                    rows.append((fields["warc-record-id"], fields["warc-type"], fields["warc-target-uri"], fields["warc-date"], digest,
                                 fields.get("warc-refers-to"), int(row) if row else None, size, None if revisit or not payloads else payload))
                    if len(rows) == TOGETHER:
                        yield packed(rows, WARC_ROWS)
                        rows = []
                if rows:
                    yield packed(rows, WARC_ROWS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path)
    return files.select("content").mapInArrow(parse, WARC_ROWS)


def describe_records(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of what `read_warc` gives."""
    revisits = read.where("type = 'revisit'").select("row", "payload_bytes", "digest", F.col("refers_urn").alias("urn"))
    others = read.where("type <> 'revisit'")
    # Pages that are alike in all share an id, and with it their row: one of them is enough to look up.
    to = others.select("urn", F.col("row").alias("refers_to")).dropDuplicates(["urn"])
    found = revisits.join(to, "urn", "left").select("row", "payload_bytes", "digest", F.lit("revisit").alias("type"), "refers_to")
    kept = others.select("row", "payload_bytes", "digest", "type", F.lit(None).cast("long").alias("refers_to"))
    return kept.unionByName(found).select(
        F.col("row").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to",
    )
