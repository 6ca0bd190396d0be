"""WARC archives: writing pages as gzip members, and a splittable reader.

The reader's tasks get byte ranges. A task scans its range for the gzip magic, takes a position as a
member only if decoding it gives a WARC header, and owns the records that start inside its range;
a record may end beyond it. From one member the next is known to start where it ends; these chains are followed from range to
range, so a member that is stored inside another is not taken for a record, and a broken one is an error.
Archives are written to and read from any store that pyarrow.fs opens by its URI.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bagweave.llm.common import cut, drop_dir

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 4 << 20
READ_BYTES = 1 << 20
#: Bytes of archives that a reader's task takes, where there are enough tasks for all cores.
TASK_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def plan_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, first_id and nth: first_id is of equal payloads of at least ``least`` bytes the smallest page_id, else its own; nth counts rows
    of one page_id and payload.

    The html itself is dealt by page_id and payload, so a payload that many pages share is no hot key; the smallest id is a partial aggregate.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("mark", F.sha2("html", 256))
    marks = rows.select("page_id", "mark", F.octet_length("html").alias("bytes"))
    firsts = marks.groupBy("mark").agg(F.min("page_id").alias("first_id")).withColumnRenamed("mark", "m")
    repeats = marks.filter(F.col("bytes") >= least).join(firsts, F.col("mark") == F.col("m")).filter("page_id > first_id or page_id is null and first_id is not null")
    # one dealing of the html serves the join and the numbering: both go by these keys
    keyed = lambda df: df.withColumn("page_key", F.coalesce("page_id", F.lit(0).cast("long"))).withColumn("no_page", F.col("page_id").isNull())
    keys = ["page_key", "no_page", "mark"]
    planned = keyed(rows).join(keyed(repeats).select(*keys, "first_id").distinct(), keys, "left").withColumn("first_id", F.coalesce("first_id", "page_id"))
    return planned.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("url"))).select("page_id", "url", "html", "first_id", "nth")


def record_id(page_id: int | None, digest: str, nth: int = 1) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest}{f':{nth}' if nth > 1 else ''}>"


def page_of(uri: str) -> int | None:
    number = uri.strip("<>").split(":")[2]
    return None if number == "null" else int(number)


def member(page_id: int | None, url: str | None, payload: bytes, first_id: int | None, level: int, nth: int = 1) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = first_id != page_id
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest, nth)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(first_id, digest)}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + pack.flush()


def write_warc(pages: DataFrame, path: str, least: int = 0, level: int = 3) -> DataFrame:
    """Writes one archive per partition to ``path`` at once, and returns (file, records, bytes).

    Defined cases: null html is an empty payload; a null url gives a record without a target; a null page_id counts as the
    last, so it revisits a page with the same payload, and is a response if no page with an id has it; repeated rows each give a
    record with an id of its own, all of them responses if their page is; an empty table writes no file; other columns are ignored. A task that runs again writes the same file under
    the same name, put in place by a rename, so lost executors leave no half or double archive.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, folder = pafs.FileSystem.from_uri(path)
        name, temporary = f"{folder}/part-{task.partitionId():06d}.warc.gz", f"{folder}/_tmp-{task.taskAttemptId()}"
        out, n, size = None, 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, first, nth = (batch.column(k)[i].as_py() for k in range(5))
                if out is None:
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(temporary)
                data = member(page_id, url, html.encode(), first, level, nth)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            if store.get_file_info(name).type != pafs.FileType.NotFound:
                store.delete_file(name)
            store.move(temporary, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([size])], ["file", "records", "bytes"])

    planned = plan_records(pages, least).sortWithinPartitions("page_id", "url", "html")
    files = planned.mapInArrow(write, "file string, records long, bytes long").collect()  # one row for each partition
    return pages.sparkSession.createDataFrame(files, "file string, records long, bytes long")


def chains_in(store: pafs.FileSystem, path: str, begin: int, end: int, size: int) -> Iterator[tuple[int, int, bytes | None, bool]]:
    """Chains of members that start in [begin, end), each from where the one before ends: (start of the chain, place, member, whole).

    After a chain's members comes a row without a member: the place where it leaves the range or the file, or where it breaks off (not
    whole). Behind a break the search for a first member goes on: one member may be stored inside another, and only the chains of the
    ranges before tell which of them is an archive's own.
    """
    with store.open_input_file(path) as source:
        at, buffer, base, chain = begin, b"", begin, None

        def more() -> bool:
            nonlocal buffer
            source.seek(base + len(buffer))
            got = source.read(min(READ_BYTES, size - base - len(buffer))) if base + len(buffer) < size else b""
            buffer += got
            return bool(got)

        while at < end:
            if chain is None:  # any magic may start one
                found = buffer.find(MAGIC, at - base)
                if found < 0:
                    keep = max(at, base + len(buffer) - len(MAGIC) + 1)
                    buffer, base, at = buffer[keep - base :], keep, keep
                    if at >= end or not more():
                        return
                    continue
                at = base + found
                if at >= end:
                    return
            buffer, base = buffer[at - base :], at
            unpack, out, used, got = zlib.decompressobj(31), [], 0, 0
            try:
                while not unpack.eof:
                    if used == len(buffer) and not more():
                        break
                    out.append(unpack.decompress(buffer[used:]))
                    used = len(buffer)
                    got += len(out[-1])
                    if got >= 7 and not b"".join(out[:8]).startswith(b"WARC/1."):
                        raise zlib.error("not a record")
                valid = unpack.eof and b"".join(out).startswith(b"WARC/1.")
            except zlib.error:
                valid = False
            if not valid:
                if chain is not None:
                    yield chain, at, None, False
                    chain = None
                at += 1
                continue
            chain = at if chain is None else chain
            yield chain, at, b"".join(out), True
            at = base + len(buffer) - len(unpack.unused_data)
            if at >= size:
                break
        if chain is not None:
            yield chain, at, None, True


def members_in(store: pafs.FileSystem, path: str) -> Iterator[bytes]:
    """The members of a whole archive, in order; an error where there is none."""
    size = store.get_file_info(path).size
    ends = 0
    for chain, at, data, whole in chains_in(store, path, 0, size, size):
        if chain or not whole:
            break
        if data is not None:
            yield data
        else:
            ends = at
    if ends != size:
        raise ValueError(f"{path}: broken archive, no whole member where one has to start")


def own_chains(found: DataFrame) -> DataFrame:
    """path and chain of an archive's own chains: the first starts at 0, each other where the one before leaves its range. A gap or a break is an error with its place."""

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        path, size = pdf["path"].iloc[0], int(pdf["length"].iloc[0])
        ends = {int(c): (int(at), bool(whole)) for c, at, whole in zip(pdf["chain"], pdf["at"], pdf["whole"], strict=True)}
        own, at = [], 0
        while at < size:
            if at not in ends or not ends[at][1]:
                raise ValueError(f"{path}: broken archive, no whole member at byte {ends[at][0] if at in ends else at}")
            own.append(at)
            at = ends[at][0]
        return pd.DataFrame({"path": path, "chain": pd.Series(own, dtype="int64")})

    return found.filter("page is null").select("path", "length", "chain", "at", "whole").groupBy("path").applyInPandas(follow, "path string, chain long")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The record's headers and its block of Content-Length bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    return headers, rest[: int(headers["Content-Length"])]


def record_row(file: str, data: bytes) -> tuple | None:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a response or revisit."""
    headers, block = parse_record(data)
    if headers["WARC-Type"] not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    told = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response":
        if (digest := base64.b32encode(hashlib.sha1(payload).digest()).decode()) != told:
            raise ValueError(f"{file}: {headers['WARC-Record-ID']} has another payload than its digest says")
        return page_of(headers["WARC-Record-ID"]), len(payload), digest, "response", None
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return page_of(headers["WARC-Record-ID"]), length, told, "revisit", page_of(headers["WARC-Refers-To"])


def read_warc(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the archives in a folder.

    A response's digest and length come from its payload; a revisit's from its header and the headers of its HTTP block.
    Each range's task reads the records of every chain of members that starts there; the chains that hang together from a file's first byte to its last count,
    and records that were stored inside others go. A member that is broken or cut off, a gap, and a response whose payload doesn't have the
    digest of its header raise an error that names the file.
    """
    kinds = pa.schema([("path", pa.string()), ("length", pa.int64()), ("chain", pa.int64()), ("at", pa.int64()), ("whole", pa.bool_()), ("page", pa.struct([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, file = pafs.FileSystem.from_uri(row["path"])
                rows = []
                for chain, at, data, whole in chains_in(store, file, row["begin"], min(row["begin"] + split_bytes, row["length"]), row["length"]):
                    if data is None or (record := record_row(file, data)) is not None:
                        page = None if data is None else dict(zip(kinds.field("page").type.names, record, strict=True))
                        rows.append({"path": row["path"], "length": row["length"], "chain": chain, "at": at, "whole": whole, "page": page})
                yield pa.RecordBatch.from_pylist(rows, kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "length")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("begin"))
    n, total = ranges.agg(F.count("*"), F.sum(F.least(F.lit(split_bytes), F.col("length") - F.col("begin")))).first()
    tasks = max(-(-(total or 0) // TASK_BYTES), min(n, 4 * spark.sparkContext.defaultParallelism), 1)
    dealt = ranges.repartition(tasks, "path", "begin")  # a stated number of tasks stays: the rows are tiny, what they name is not
    found = cut(dealt.mapInArrow(read, f"path string, length long, chain long, at long, whole boolean, page struct<{RECORDS.replace(' ', ':').replace(',:', ',')}>"))
    return found.filter("page is not null").join(own_chains(found), ["path", "chain"]).select("page.*")


def archived(pages: DataFrame, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Writes the pages as archives and reads them back; the archives stay."""
    spark = pages.sparkSession
    if write_warc(pages, path).isEmpty():
        return spark.createDataFrame([], RECORDS)
    return read_warc(spark, path, split_bytes)


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """What the archives say of the pages; the archives go, as their records are checkpointed."""
    found = archived(pages, path)
    drop_dir(path)
    return found
