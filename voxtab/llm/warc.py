"""WARC archives: records written from pages, and read back by following the chain of record ends."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtab.functions.values import let
from voxtab.llm.common import read_table, written
from voxtab.operators.skew import split_join
from voxtab.sources.catalog import shared_folder

#: Records in one archive file, at most.
FILE_RECORDS = 20_000
#: Bytes of a file whose candidates are chained in one group; between groups pointers jump.
CELL_BYTES = 4 << 20
MAGIC = "WARC/1."
VERSION = f"{MAGIC}1"
END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed value: the alphabet of base32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary; 160 bits are 8 times 4 letters, without padding."""
    def letter(v: Column, shift: int) -> Column:
        at = F.shiftright(v, shift).bitwiseAND(31) + 1
        return F.substring(F.lit(BASE32), at, F.lit(1))

    def letters(hexes: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda g: let(
            F.conv(F.substring(hexes, g * 5 + 1, F.lit(5)), 16, 10).cast("int"),
            lambda v: F.concat(*[letter(v, s) for s in (15, 10, 5, 0)]))), "")

    return let(F.sha1(payload), letters)


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is NULL. Control characters would break the line."""
    safe = F.when(value.rlike(r"[\x00-\x20\x7f]"), F.url_encode(value)).otherwise(value)
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(END)), F.lit(""))


def as_records(pages: DataFrame) -> DataFrame:
    """One ``value`` per page: its WARC record without the last line end.

    Of pages with equal payloads that with the smallest page_id is the response
    (NULL ids last; rows that repeat page and payload are all responses), the others
    revisit it and carry no payload. Payloads are told apart by SHA-256.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce("html", F.lit("")).alias("html"), base32_sha1(payload).alias("digest"),
                        F.sha2(payload, 256).alias("key"))
    heads = written(rows.groupBy("key").agg(F.min("page_id").alias("head"), F.count("*").alias("n")))
    joined = split_join(rows, heads, ["key"], "n")
    first = F.col("head").eqNullSafe(F.col("page_id"))
    size = F.octet_length("html").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"),
                    _line("Content-Length", size), F.lit(END))
    block = F.when(first, F.concat(http, F.col("html"))).otherwise(http)
    page = F.col("page_id").cast("string")
    urn = F.concat(F.lit("<urn:page:"), F.coalesce(page, F.lit("none")), F.lit(">"))
    head = F.concat(
        F.lit(f"{VERSION}{END}"),
        F.lit("WARC-Type: "), F.when(first, "response").otherwise("revisit"), F.lit(END),
        _line("WARC-Record-ID", urn), _line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        _line("WARC-Target-URI", F.col("url")), _line("X-Page-ID", page),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(~first, F.concat(
            F.lit(f"WARC-Profile: {PROFILE}{END}"),
            _line("X-Refers-To-Page-ID", F.col("head").cast("string")))).otherwise(""),
        F.lit(f"Content-Type: application/http;msgtype=response{END}"),
        _line("Content-Length", F.octet_length(block).cast("string")), F.lit(END))
    return joined.select(F.concat(head, block, F.lit(END)).alias("value"))


def write_archives(pages: DataFrame, folder: str, file_records: int = FILE_RECORDS) -> None:
    """Write pages as gzipped archive files. Spark's text writer commits whole files of tasks that ended well."""
    as_records(pages).write.option("lineSep", END).option("maxRecordsPerFile", file_records).option(
        "compression", "gzip").text(folder)



def _rows(spark: SparkSession, folder: str) -> DataFrame:
    """What lies between two magics, in order within (``file``, ``block``, ``k``).

    Files are read in splits that end at the magic; a gzipped file is one split. The
    same files give the same numbers again.
    """
    return spark.read.option("lineSep", MAGIC).text(folder).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("k"), "value")


def _header(value: Column) -> tuple[Column, Column]:
    """Header of a record and the length of its block, NULL if it names none."""
    head = F.substring_index(value, END * 2, 1)
    size = F.regexp_extract(head, r"(?im)^Content-Length:[ \t]*([0-9]{1,17})[ \t]*\r?$", 1)
    return head, F.when(value.contains(END * 2) & (size != ""), size.try_cast("bigint"))


def _made(value: Column, make: Callable[[Column, Column], Column]) -> Column:
    """``make`` of header and block (binary), NULL unless the block is whole in the value."""
    head, size = _header(value)
    at = F.octet_length(head) + 2 * len(END)
    block = F.substring(value.cast("binary"), at + 1, size.cast("int"))
    return F.when(F.octet_length(value) >= at + size, make(head, block))


def candidates(spark: SparkSession, folder: str, make: Callable[[Column, Column], Column]) -> DataFrame:
    """All rows between magics without their text: place, what ``make`` gives, and the record they may start.

    ``start`` is the offset of the row's magic; ``begin`` that of the candidate it
    belongs to. A magic that doesn't follow a blank line starts no record, so a
    header with a magic in it is put together from its rows. ``stop``, in the first
    row of a candidate, is where the next record starts if this is one, NULL if its
    header has no length. A magic in a payload may well come out as a candidate.
    """
    value = F.col("value")
    piece = F.when(value.contains(END * 2), F.concat(F.substring_index(value, END * 2, 1), F.lit(END * 2))).otherwise(
        value)
    rows = _rows(spark, folder).select(
        "file", "block", "k", F.octet_length("value").cast("long").alias("n"), F.substring("value", -4, 4).alias("tail"),
        piece.alias("piece"), _made(value, make).alias("made"))
    w = Window.partitionBy("file").orderBy("block", "k")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("n") + len(MAGIC)).over(upto), F.lit(0)) - len(MAGIC)
    after_blank = F.coalesce(F.lag("tail").over(w), F.lit("")).isin("", END * 2)
    rows = rows.withColumn("start", start).withColumn("fresh", after_blank).where("start >= 0")
    begin = F.last(F.when(F.col("fresh"), F.col("start")), ignorenulls=True).over(w)
    rows = rows.withColumn("begin", begin)
    pieces = F.sort_array(F.collect_list(F.struct("start", "piece")).over(Window.partitionBy("file", "begin")))
    head, size = _header(F.array_join(F.transform(pieces, lambda v: v["piece"]), MAGIC))
    first = F.col("start") == F.col("begin")
    return rows.withColumn("stop", F.when(first, F.col("start") + len(MAGIC) + F.octet_length(head)
                                          + size + 4 * len(END))).select(
        "file", "block", "k", "start", "begin", "stop", F.when(first, F.col("made")).alias("made"))


def _inside(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of a cell's records in order, their stops, and the number of the next record in the cell or -1."""
    rows = rows.sort_values("start")
    starts, stops = rows["start"].to_numpy(np.int64), rows["stop"].to_numpy(np.int64)
    at = np.searchsorted(starts, stops)
    hit = starts[np.minimum(at, len(starts) - 1)] == stops
    return starts, stops, np.where(hit, at, -1)


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each record of a cell leaves the cell."""
    starts, stops, onward = _inside(rows)
    out = stops.tolist()
    for i in range(len(out) - 1, -1, -1):
        if onward[i] >= 0:
            out[i] = out[onward[i]]
    return pd.DataFrame({"file": rows["file"].iloc[0], "start": starts, "stop": out})


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """The records of a cell on the chain from ``entry``."""
    starts, _, onward = _inside(rows)
    i, got = int(np.searchsorted(starts, rows["entry"].iloc[0])), []
    while i >= 0:
        got.append(starts[i])
        i = int(onward[i])
    return pd.DataFrame({"file": rows["file"].iloc[0], "start": np.array(got, np.int64)})


def reachable(links: DataFrame, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """``file`` and ``start`` of the records on the chain that begins at offset 0 of each file.

    Files are cut in cells of ``cell_bytes``. Within a cell every candidate's jumps
    are followed to where they leave it. Between cells pointers jump: in each round
    what is reached also reaches the ends of its jumps, and every jump becomes two
    in a row, so the rounds number the logarithm of the cells of a file. The chain
    enters a cell once at most; the records after that entry are read off inside.
    Links into nowhere end a chain.
    """
    cells = links.select("file", "start", F.when(F.col("stop") > F.col("start"), F.col("stop")).otherwise(
        F.lit(-1)).cast("long").alias("stop"), F.expr(f"start div {cell_bytes}").alias("cell"))
    exits = written(cells.groupBy("file", "cell").applyInPandas(_exits, "file string, start long, stop long"))
    entered = exits.select("file", F.col("stop").alias("start")).distinct()
    jumps = written(exits.where("start = 0").unionByName(
        exits.where("start > 0").join(entered, ["file", "start"], "left_semi")))
    got = jumps.where("start = 0").select("file", "start")
    size = got.count()
    while True:
        ends = jumps.join(got, ["file", "start"], "left_semi").select("file", F.col("stop").alias("start"))
        ends = ends.join(jumps.select("file", "start"), ["file", "start"], "left_semi")
        got = written(got.unionByName(ends).distinct())
        before, size = size, got.count()
        if size == before:
            break
        onward = jumps.select("file", F.col("start").alias("stop"), F.col("stop").alias("far"))
        jumps = written(jumps.join(onward, ["file", "stop"], "left").select(
            "file", "start", F.coalesce("far", F.lit(-1)).alias("stop")))
    entries = got.select("file", F.expr(f"start div {cell_bytes}").alias("cell"), F.col("start").alias("entry"))
    return cells.join(entries, ["file", "cell"]).groupBy("file", "cell").applyInPandas(
        _walk, "file string, start long")


def read_archives(spark: SparkSession, folder: str,
                  make: Callable[[Column, Column], Column] = lambda head, block: F.struct(
                      head.alias("head"), block.alias("block"))) -> DataFrame:
    """``file``, ``start`` and ``made`` (of header and block) of every true record.

    ``make`` runs in the scan on whatever may be a record, so blocks don't travel.
    Only blocks with a magic inside, which lie in several rows, are put together
    from a second reading.
    """
    found = written(candidates(spark, folder, make))
    true = reachable(found.where("start = begin").select("file", "start", "stop"))
    records = written(found.join(true, ["file", "start"], "left_semi").select("file", "start", "made"))
    whole = records.where(F.col("made").isNotNull())
    broken = records.where(F.col("made").isNull()).select("file", F.col("start").alias("owner"))
    if not broken.limit(1).count():
        return whole
    owners = found.select("file", "block", "k", "start").join(
        records.select("file", "start", F.lit(True).alias("true")), ["file", "start"], "left").withColumn(
        "owner", F.last(F.when(F.col("true"), F.col("start")), ignorenulls=True).over(
            Window.partitionBy("file").orderBy("start"))).join(broken, ["file", "owner"], "left_semi")
    parts = _rows(spark, folder).join(owners.drop("true"), ["file", "block", "k"]).groupBy("file", "owner").agg(
        F.sort_array(F.collect_list(F.struct("start", "value"))).alias("v"))
    value = F.array_join(F.transform("v", lambda v: v["value"]), MAGIC)
    again = parts.select("file", F.col("owner").alias("start"), value.alias("value")).select(
        "file", "start", _made(F.col("value"), make).alias("made"))
    return whole.unionByName(again)


def _value(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*(.*?)\r?$", 1)
    return F.when(found != "", found)


def page_record(head: Column, block: Column) -> Column:
    """Page, payload and kind of a record, as a struct.

    Size and digest of a response are taken from its payload as read, those of a
    revisit from its headers.
    """
    http = F.substring_index(block.cast("string"), END * 2, 1)
    payload = F.substring(block, F.octet_length(http) + 2 * len(END) + 1, F.octet_length(block))
    kind = _value(head, "WARC-Type")
    first = kind == "response"
    named = F.substring_index(_value(head, "WARC-Payload-Digest"), ":", -1)
    return F.struct(
        _value(head, "X-Page-ID").try_cast("bigint").alias("page_id"),
        F.when(first, F.octet_length(payload).cast("long")).otherwise(
            _value(http, "Content-Length").try_cast("bigint")).alias("payload_bytes"),
        F.when(first, base32_sha1(payload)).otherwise(named).alias("payload_digest"),
        kind.alias("record_type"), _value(head, "X-Refers-To-Page-ID").try_cast("bigint").alias("refers_to"))


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of response and revisit records; other records are left out."""
    return read_archives(spark, folder, page_record).select("made.*").where(
        F.col("record_type").isin("response", "revisit"))


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A NULL html is an empty payload. Pages may repeat: every row is a record."""
    archives = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(read_table(spark, folder, "pages"), archives)
    return read_pages(spark, archives)


OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('{BASE32}', 1 + CAST(
    (CAST('0x' || substr(d, (k // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS BIGINT), 1)), '')
    AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> m THEN m END AS refers_to
FROM f
"""
