"""A deterministic sharded WARC writer, and a reader of what it wrote."""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib

import pandas as pd
from pyarrow.fs import FileType as fs_type
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, discard, filesystem, join_counted, materialize, new_folder, shuffle_parts

#: A file is closed by the record with which its compressed size reaches this.
FILE_BYTES = 64 << 20
#: All records' date, so that a run's files can be repeated byte by byte.
DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, turn: int = 0) -> str:
    """Of a page's payload; ``turn`` tells rows of equal id and payload apart."""
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}{f':{turn}' if turn else ''}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, turn: int = 0) -> bytes:
    """One record; a revisit has the payload's digest and length, but not the payload.

    A line break in a URL would end the header, so control characters are percent-encoded.
    """
    digest = base32_sha1(payload)
    block = _HTTP % len(payload) + (payload if refers_to is None else b"")
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else "about:blank"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest, turn)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one record, its block checked against both digests."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if first != "WARC/1.1" or f"sha1:{base32_sha1(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    page = lambda urn: int(urn.strip("<>").split(":")[2]) if urn.split(":")[2] else None
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(fields["X-Payload-Length"])
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if (base32_sha1(payload), len(payload)) != (digest, size):
            raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    return {"page_id": page(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page(fields["WARC-Refers-To"]) if kind == "revisit" else None}


def records_of(stream):
    """The records of a stream of gzip members, one a record."""
    left, member, parts = b"", None, []
    while True:
        if not left:
            left = stream.read(1 << 20)
            if not left:
                if member is not None:
                    raise ValueError("the file ends within a record")
                return
        member = member or zlib.decompressobj(31)
        parts.append(member.decompress(left))
        left = b""
        if member.eof:
            left, member = member.unused_data, None
            yield b"".join(parts)
            parts = []


def _bounds(digests: DataFrame, parts: int) -> list[tuple]:
    """Cuts of the order by id and digest, the same for the same rows however they are laid out: quantiles of a hash sample."""
    sample = digests.select("page_id", "digest").distinct().orderBy(F.xxhash64("page_id", "digest"), "page_id", "digest").limit(32 * parts).collect()
    keys = sorted(order_key(r.page_id, bytes(r.digest)) for r in sample)
    return [keys[i * len(keys) // parts] for i in range(1, parts)] if keys else []


def order_key(page_id: int | None, digest: bytes) -> tuple:
    return (page_id is not None, page_id or 0, digest)


def write_archives(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, file_bytes: int = FILE_BYTES, date: str = DATE, parts: int | None = None
) -> DataFrame:
    """Write a record of every row to gzipped WARC files in order of the id; the manifest: path, part, file, records, bytes.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the largest id is the
    response and the others revisit it, those with a null id too; of rows that repeat that id and payload the first in the order of
    urls is the response. Payloads that only rows with null ids have are responses all: there is no id to refer to. Which
    page a row revisits is found by a digest beforehand and meets the row in the range sort, so pages
    are shuffled once. The order is by id and digest and cut into ``parts`` (by default as many as shuffle partitions) at
    quantiles of a hash sample, so files have the same names and bytes however the rows are laid out. Tasks write
    under temporary names; when all have succeeded, the files that they listed get their names, and the manifest is
    written last: a failed or repeated task leaves no file with a final name. Null payloads are
    empty; rows with a null id come first; a null URL
    is about:blank. An empty table has an empty manifest.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    parts = parts or shuffle_parts(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "utf-8").alias("payload"))
    digest = F.unhex(F.sha1("payload"))
    digests = materialize(rows.select("page_id", digest.alias("digest"), (F.octet_length("payload") >= least_bytes).alias("shared")), "warc-digests")
    shared = digests.where("shared")
    last = shared.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select("digest", "last", "n")
    last = materialize(last, "warc-last")
    known = join_counted(shared.select("page_id", "digest"), last, "digest", "n").where("page_id < last or page_id is null")
    known = known.select("page_id", "digest", F.col("last").alias("refers_to")).distinct()
    both = rows.select("page_id", "url", "payload", digest.alias("digest"), F.lit(None).cast("long").alias("refers_to")).unionByName(
        known.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "refers_to")
    )
    bounds = _bounds(digests, parts)

    @F.pandas_udf("int")
    def part_of(page_id: pd.Series, digest: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(bounds, order_key(None if pd.isna(p) else int(p), bytes(d))) for p, d in zip(page_id, digest, strict=True)], dtype="int32")

    both = both.withColumn("part", part_of("page_id", "digest")).repartitionById(parts, "part")
    both = both.sortWithinPartitions("part", F.col("page_id").asc_nulls_first(), "digest", F.col("payload").isNotNull(), F.col("url").asc_nulls_first())

    def write(batches):
        fs, path = filesystem(folder)
        fs.create_dir(f"{path}/_tmp", recursive=True)
        run, part, file, out, n, size, at, to, turn = uuid.uuid4().hex, None, 0, None, 0, 0, None, None, 0
        temporary = lambda: f"_tmp/part-{part:06d}-{file:05d}-{run}"

        def close():
            out.close()
            return pd.DataFrame({"path": [f"{folder}/part-{part:06d}-{file:05d}.warc.gz"], "part": [part], "file": [file], "records": [n], "bytes": [size], "temporary": [temporary()]})

        for b in batches:
            for own, page, url, payload, digest, refers in zip(b["part"], b["page_id"], b["url"], b["payload"], b["digest"], b["refers_to"], strict=True):
                page, digest = None if pd.isna(page) else int(page), bytes(digest)
                if own != part:
                    if out is not None:
                        yield close()
                    part, file, out = int(own), 0, None
                if (page, digest) != at:
                    at, to, turn = (page, digest), None, 0
                if payload is None:
                    to = int(refers)
                    continue
                if out is None:
                    n, size = 0, 0
                    out = fs.open_output_stream(f"{path}/{temporary()}", compression=None)
                again = page if turn and to is None and len(payload) >= least_bytes else to  # a repeated row revisits the first
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = packer.compress(record(page, url, bytes(payload), again, date, turn)) + packer.flush()
                turn += 1
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    yield close()
                    file, out = file + 1, None
        if out is not None:
            yield close()

    written = materialize(both.mapInPandas(write, "path string, part long, file long, records long, bytes long, temporary string"), "warc-written", TEXT_ROWS)

    def commit(batches):
        """Gives the listed files their names; a task that is repeated finds some of them named already."""
        fs, path = filesystem(folder)
        for b in batches:
            for to, name in zip(b["path"], b["temporary"], strict=True):
                source, target = f"{path}/{name}", f"{path}/{to.rpartition('/')[2]}"
                if fs.get_file_info(source).type != fs_type.NotFound:
                    fs.move(source, target)
                elif fs.get_file_info(target).type == fs_type.NotFound:
                    raise FileNotFoundError(source)
            yield b.drop(columns="temporary")

    manifest = materialize(written.repartition(parts, "path").mapInPandas(commit, "path string, part long, file long, records long, bytes long"), "warc-manifest")
    discard(f"{folder}/_tmp")
    return manifest


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of a manifest's files."""

    def read(batches):
        for b in batches:
            for path in b["path"]:
                fs, at = filesystem(path)
                with fs.open_input_stream(at, compression=None) as f:
                    held = []
                    for data in records_of(f):
                        held.append(parse(data))
                        if len(held) == 2000:
                            yield _frame(held)
                            held = []
                    if held:
                        yield _frame(held)

    return manifest.select("path").repartition(shuffle_parts(manifest.sparkSession)).mapInPandas(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows).astype({"page_id": "Int64", "refers_to": "Int64"})
