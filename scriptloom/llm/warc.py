"""WARC archives: an index first, then coalesced byte-range reads.

Records are lines of Spark's text writer with CR LF CR LF, the end of a WARC
record, as line separator; so archives are written by executors through
whatever file system the shared folder is on.  The index is computed from the
lengths alone, before any archive is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.workspace import FILES_GO, new_path, set_for, write_table

_END = "\r\n\r\n"
INDEX = "archive int, page_id long, url string, offset long, length long, digest string, payload_bytes long"


def payload(html: Column) -> Column:
    return F.coalesce(html, F.lit(""))


def plan_records(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload_bytes, digest (SHA-1, hex), payload_key, refers_to (null for responses) per row of ``pages``.

    Of rows with equal payloads of at least ``min_bytes`` the one with the largest
    page_id is the response and the others refer to it.  Rows that repeat that very
    page_id are responses too.  Payloads don't travel: only digests are shuffled.
    """
    slim = pages.select(
        "page_id",
        F.coalesce("url", F.lit("")).alias("url"),
        F.octet_length(payload(F.col("html"))).cast("long").alias("payload_bytes"),
        F.sha1(F.encode(payload(F.col("html")), "UTF-8")).alias("digest"),
        F.xxhash64(payload(F.col("html"))).alias("payload_key"),
    )
    slim = write_table(slim, "pages")
    owners = (
        slim.where(F.col("payload_bytes") >= min_bytes)
        .groupBy(F.col("digest").alias("_digest"))
        .agg(F.max("page_id").alias("_owner"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
    )
    joined = slim.join(owners, (slim["digest"] == owners["_digest"]) & (slim["payload_bytes"] >= min_bytes), "left")
    refers = F.when(F.col("_owner") != F.coalesce(F.col("page_id"), F.lit(-1)), F.col("_owner"))
    return joined.select("page_id", "url", "payload_bytes", "digest", "payload_key", refers.alias("refers_to"))


def _header(length: Column) -> Column:
    """Header of a record; ``length`` is the Content-Length."""
    revisit = F.col("refers_to").isNotNull()
    lines = [
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\r\n]", "%0A")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(_END))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = 32 << 20, min_bytes: int = 1000, waves: int = 2) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC archives below ``path``; returns the index as a table.

    Rows go to archives of about ``archive_bytes`` by a hash of page_id and payload, ordered
    by page_id within each (repeated and null page_ids in the order of their digests).  Index
    columns: archive, page_id, url, offset, length (without the closing CR LF CR LF),
    digest, payload_bytes.  ``waves`` divides the payloads that are shuffled at a time
    (and multiplies scans of ``pages``).  Null html is an empty payload, a null url an empty
    one; an empty table gives no archive.
    """
    spark = pages.sparkSession
    plan = plan_records(pages, min_bytes)
    total = plan.agg(F.sum(F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(0) + 500)).first()[0] or 0
    archives = max(1, -(-total // archive_bytes))
    body = F.when(F.col("refers_to").isNotNull(), F.lit(0)).otherwise(F.col("payload_bytes")).cast("long")
    archive = F.pmod(F.xxhash64("page_id", "payload_key"), F.lit(archives)).cast("int")
    plan = plan.withColumn("archive", archive).withColumn("head", _header(body))
    plan = plan.withColumn("length", (F.octet_length("head") + body).cast("long"))
    # The rank among rows of one page_id and digest keeps repeated rows apart in both tables below.
    same = Window.partitionBy("archive", "page_id", "digest").orderBy("length")
    in_archive = Window.partitionBy("archive").orderBy("page_id", "digest", "_k").rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.withColumn("_k", F.row_number().over(same))
    index = write_table(
        plan.withColumn("offset", F.coalesce(F.sum(F.col("length") + len(_END)).over(in_archive), F.lit(0)).cast("long")), "warc-index"
    )
    html = pages.select(F.col("page_id").alias("_page"), F.xxhash64(payload(F.col("html"))).alias("_payload"), payload(F.col("html")).alias("_html"))
    html = html.withColumn("_archive", F.pmod(F.xxhash64("_page", "_payload"), F.lit(archives)).cast("int"))
    # Both sides are dealt by archive, which is enough for the join by archive and page: payloads move once.
    # Archives are written in waves, so that only a wave's payloads lie in shuffle files at a time.
    with set_for(spark, FILES_GO | {"spark.sql.requireAllClusterKeysForCoPartition": "false"}):
        for wave in range(waves):
            of_wave = F.pmod(F.col("archive"), F.lit(waves)) == wave
            once = index.where(of_wave).select("archive", "page_id", "digest", "payload_key", "_k", "head", "refers_to").repartition(archives, "archive")
            # Rows that repeat page_id and payload are one on this side and as many as they are on the other.
            distinct = html.where(F.pmod(F.col("_archive"), F.lit(waves)) == wave)
            distinct = distinct.repartition(archives, "_archive").dropDuplicates(["_archive", "_page", "_payload"])
            on = (once["archive"] == distinct["_archive"]) & once["page_id"].eqNullSafe(distinct["_page"]) & (once["payload_key"] == distinct["_payload"])
            joined = once.join(distinct.hint("merge"), on & once["refers_to"].isNull(), "left")
            record = F.concat("head", F.when(F.col("refers_to").isNull(), F.col("_html")).otherwise(F.lit("")))
            (
                joined.select("archive", "page_id", "digest", "_k", record.alias("value"))
                .sortWithinPartitions("archive", "page_id", "digest", "_k")
                .select("archive", "value")
                .write.mode("append")
                .partitionBy("archive")
                .option("lineSep", _END)
                .text(path)
            )
    return index.select("archive", "page_id", "url", "offset", "length", "digest", "payload_bytes")


def _ranges(rows: list[tuple[int, int]], gap: int, most: int) -> Iterator[tuple[int, int, int, int]]:
    """Join neighbouring (offset, length) of one archive to (first row, end row, offset, end) of one read."""
    first, start, end = 0, *(rows[0][0], sum(rows[0]))
    for i, (offset, length) in enumerate(rows[1:], 1):
        if offset - end > gap or offset + length - start > most:
            yield first, i, start, end
            first, start = i, offset
        end = max(end, offset + length)
    yield first, len(rows), start, end


def parse_record(record: bytes, digest: str) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload bytes, payload digest, type, refers_to of one record; a response is checked against its digest."""
    head, _, body = record.partition(_END.encode())
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    number = lambda name: int(v) if (v := fields[name][len("<urn:page:") : -1]) else None
    if lines[0] != "WARC/1.0" or fields["WARC-Payload-Digest"] != f"sha1:{digest}" or int(fields["Content-Length"]) != len(body):
        raise ValueError(f"no such record at its place in the archive: {lines[:3]}")
    if fields["WARC-Type"] == "revisit":
        return number("WARC-Record-ID"), int(fields["WARC-Payload-Length"]), digest, "revisit", number("WARC-Refers-To")
    if (found := hashlib.sha1(body).hexdigest()) != digest:
        raise ValueError(f"payload digest {found}, {digest} expected")
    return number("WARC-Record-ID"), len(body), digest, "response", None


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(spark: SparkSession, path: str, index: DataFrame, gap_bytes: int = 64 << 10, range_bytes: int = 4 << 20) -> DataFrame:
    """Read the records that ``index`` selects from the archives below ``path``.

    Rows of an archive are sorted by offset; reads whose gaps are at most
    ``gap_bytes`` become one, of up to ``range_bytes`` (a longer record is read
    alone).  Each record is checked against the index.  Where the folder's file
    system is one that only Spark opens, archives are read whole, as binary files.
    """
    slots = index.select("archive").distinct().count()
    plan = index.select("archive", "offset", "length", "digest").repartition(max(1, slots), "archive").sortWithinPartitions("archive", "offset")
    scheme = path.split("://")[0] if "://" in path else "file"
    if scheme not in ("file", "hdfs", "s3", "s3a", "gs"):
        return _read_whole(spark, path, plan)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(path.replace("s3a://", "s3://") if "://" in path else "file://" + path)
        for batch in batches:
            rows = list(zip(*[batch.column(c).to_pylist() for c in ("archive", "offset", "length", "digest")]))
            at = 0
            while at < len(rows):
                end = next((i for i in range(at, len(rows)) if rows[i][0] != rows[at][0]), len(rows))
                part = rows[at:end]
                files = [f.path for f in system.get_file_info(fs.FileSelector(f"{top}/archive={part[0][0]}")) if f.size and not f.base_name.startswith((".", "_"))]
                if len(files) != 1:
                    raise ValueError(f"archive {part[0][0]} has {len(files)} files")
                with system.open_input_file(files[0]) as f:
                    for i, j, start, stop in _ranges([(o, n) for _, o, n, _ in part], gap_bytes, range_bytes):
                        data = f.read_at(stop - start, start)
                        yield _batch(parse_record(data[o - start : o - start + n], d) for _, o, n, d in part[i:j])
                at = end

    return plan.mapInArrow(read, READ)


_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _batch(records) -> pa.RecordBatch:
    columns = list(zip(*records))
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _ARROW)], schema=_ARROW)


def _read_whole(spark: SparkSession, path: str, plan: DataFrame) -> DataFrame:
    """Slices of whole archives, each bounded by the size given when it was written."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"archive=(\d+)/", 1).cast("int").alias("_a"), "content")
    wanted = plan.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "digest"))).alias("rows"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, rows in zip(batch.column("content"), batch.column("rows").to_pylist()):
                data = content.as_buffer().to_pybytes()
                for i in range(0, len(rows), 1000):
                    yield _batch(parse_record(data[r["offset"] : r["offset"] + r["length"]], r["digest"]) for r in rows[i : i + 1000])

    return wanted.join(files, wanted["archive"] == files["_a"]).select("content", "rows").mapInArrow(read, READ)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read every record back (columns as in ``READ``)."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    return read_records(spark, path, write_archives(pages, path))
