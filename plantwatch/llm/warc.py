"""Operator 5: WARC archives, written and read by Spark's text source.

Writing: a record is one text value, and the text writer puts the two line ends that close a
record after each. Equal payloads are written once, as a response; the others are revisits.

Reading finds record borders by boundary-chain verification. Split at the magic bytes, a file
falls into candidates, some of which may lie inside payloads. For each candidate a task works
out where its record must end (its successor); inside a split of the file it follows that chain
at once and emits the first successor beyond the split. Pointer jumping from the start of each
file over splits (each round doubles the reach) then says where each split is entered. A second
pass follows the chain from there, and only what it meets is a record; payloads that contain the
magic are put together again from their pieces, across splits too.

Only the table of splits (one row for some MB of archive) is shuffled, plus the rare pieces of
records that leave their split. No file is read into one task as a whole.

Defined results: a null payload is empty; a null id or address is left out of its header; of
rows with equal large payloads all that have the smallest id are responses, so repeated rows
are too; payloads of unidentified rows are never first; an empty table gives no records. A file
whose chain breaks (a border that is no record) yields the records before the break.

Both passes split files alike whatever the cores (``fixed_splits``), and the records are written
before ``read_warc`` returns, so no later evaluation can split otherwise. A split that the first
pass did not see is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from plantwatch.llm.arrow import map_arrow
from plantwatch.session import fresh_path, materialise

# Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"


def record_text(page_id: Column, url: Column, html: Column, digest: Column, refers_to: Column) -> Column:
    """A whole record but for the two line ends that close it."""
    revisit = refers_to.isNotNull()
    bytes_ = F.octet_length(html).cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), bytes_, F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, html))
    address = F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20")

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    return F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", address),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers_to.cast("string"), F.lit(">"))),
        line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit(END), block)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               least: int = LEAST_REVISIT) -> str:
    """Write one record per row below ``path``.

    First ids are found by digest, which combines before the shuffle; only digests that occur
    more than once are kept, and joined to the rows as Spark sees fit for their number.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.coalesce(payload_col, F.lit("")).alias("_html"))
    rows = rows.withColumn("_digest", F.sha2(F.col("_html").cast("binary"), 256))
    large = F.octet_length("_html") >= least
    first = materialise(rows.filter(large).groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
                        .filter("_n > 1").select(F.col("_digest").alias("_same"), "_first"), "payloads")
    if not first.isEmpty():
        rows = rows.join(first, (rows["_digest"] == first["_same"]) & large, "left")
    else:
        rows = rows.withColumn("_first", F.lit(None).cast(rows.schema["_id"].dataType))
    refers = F.when(~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first"))
    rows.select(record_text(F.col("_id"), F.col("_url"), F.col("_html"), F.col("_digest"), refers).alias("value")
                ).write.option("lineSep", END).text(path)
    return path


@dataclass
class Head:
    """What a candidate says of itself; ``length`` counts from the magic to the next record."""
    length: int
    body: int
    fields: dict[bytes, bytes] = field(repr=False)


def parse_head(value: bytes) -> Head | None:
    """Headers of a candidate whose bytes follow the magic; None if they are no record's headers."""
    stop = value.find(b"\r\n\r\n")
    if stop < 0:
        return None
    fields = {}
    for row in value[:stop].split(b"\r\n"):
        name, colon, rest = row.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = rest.strip()
    size = fields.get(b"content-length", b"")
    if not size.isdigit() or len(size) > 15 or b"warc-type" not in fields:
        return None
    return Head(len(MAGIC) + stop + 4 + int(size) + 4, stop + 4, fields)


@contextmanager
def fixed_splits(spark: SparkSession):
    """Within it Spark cuts files every spark.sql.files.maxPartitionBytes, at any number of cores and of files.

    The size is the smaller of that setting and max(opening cost, all bytes / fewest partitions). An
    opening cost of the setting fixes it. One as the fewest partitions does so too where that cost is
    held by others: the size is then the setting, or no smaller than any file.
    """
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    wanted = {"spark.sql.files.openCostInBytes": most, "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Bytes between magics, with file and split; rows of a split come in order, in one task."""
    return (spark.read.option("lineSep", MAGIC).text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                    F.col("value").cast("binary").alias("value")))


class _Splits:
    """Groups the rows of a task by split; offsets count from the first byte of the split's first row."""

    def __init__(self, batches):
        self.batches = batches

    def rows(self) -> Iterator[tuple[tuple[str, int], int, bytes]]:
        now, at = None, 0
        for b in self.batches:
            for file, split, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if (file, split) != now:
                    now, at = (file, split), 0
                yield now, at, value
                at += len(value) + len(MAGIC)


def _chains(batches):
    """Per candidate of a split: its place and the first successor beyond the split, both from the split's start."""

    def done(key, at, follow):
        # From the last candidate backwards every successor inside the split is already resolved.
        out = {}
        for place in sorted(follow, reverse=True):
            to = follow[place]
            # The last magic of a split begins the first record of the next one.
            out[place] = out.get(to, to if to >= at - len(MAGIC) else None)
        columns = [[key[0]] * (len(out) + 1), [key[1]] * (len(out) + 1), [*out, None], [*out.values(), at]]
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                                           pa.array(columns[3], pa.int64())], names=["file", "split", "place", "to"])

    now, follow, end = None, {}, 0
    for key, at, value in _Splits(batches).rows():
        if key != now:
            if now:
                yield done(now, end, follow)
            now, follow = key, {}
        end = at + len(value) + len(MAGIC)
        # What precedes the first magic of a file is no candidate.
        if (key[1] or at) and (head := parse_head(value)):
            follow[at - len(MAGIC)] = at - len(MAGIC) + head.length
    if now:
        yield done(now, end, follow)


def split_entries(spark: SparkSession, path: str) -> DataFrame:
    """Per split: file, split, base (offset of its first byte) and entry (offset of its first true record, null if none).

    A row with place null carries the length of its split. A candidate that starts at the magic
    just before its split's first row has place -len(MAGIC), so its offset is base + place.
    """
    with fixed_splits(spark):
        found = materialise(map_arrow(_lines(spark, path), _chains, "file string, split long, place long, to long"), "chains")
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    splits = found.filter("place is null").select("file", "split", F.col("to").alias("length"),
                                                  F.coalesce(F.sum("to").over(before), F.lit(0)).alias("base"))
    edges = materialise(
        found.filter("place is not null").join(splits.select("file", "split", "base"), ["file", "split"])
        .select("file", "split", (F.col("base") + F.col("place")).alias("at"), (F.col("base") + F.col("to")).alias("to")), "jumps")
    reached = materialise(splits.groupBy("file").agg(F.lit(0).cast("bigint").alias("at")), "reached")
    jumps, rounds = edges.select("file", "at", "to"), 0
    while True:
        step = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        wider = materialise(reached.unionByName(step).distinct(), "reached")
        rounds += 1
        if rounds > 64 or wider.count() == reached.count():
            break
        reached = wider
        further = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("_to"))
        jumps = materialise(jumps.join(further, ["file", "to"]).select("file", "at", F.col("_to").alias("to")), "jumps")
    entries = reached.join(edges, ["file", "at"]).groupBy("file", "split").agg(F.min("at").alias("entry"))
    ends = reached.groupBy("file").agg(F.max("at").alias("_last"))
    later = W.partitionBy("file").orderBy("split").rowsBetween(1, W.unboundedFollowing)
    return materialise(
        splits.join(entries, ["file", "split"], "left").join(ends, "file", "left")
        .select("file", "split", "base", "entry", F.coalesce("entry", F.min("entry").over(later), "_last").alias("end")), "entries")


FOUND = "file string, end long, part long, raw binary, complete boolean"


def _follow(table: dict):
    """Second pass: the bytes of every record, or what of them lies in this split.

    ``end`` (where the record ends in its file) names a record in all of its splits.
    """

    def run(batches):
        rows: list[tuple] = []
        held = 0

        def put(file, end, part, pieces, complete):
            nonlocal held
            raw = b"".join(pieces)
            rows.append((file, end, part, raw, complete))
            held += len(raw) + 100

        def flush():
            nonlocal held
            c = list(zip(*rows))
            rows.clear()
            held = 0
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], names=["file", "end", "part", "raw", "complete"])

        now, base = None, 0
        # The open record: where it (or its part in this split) starts and it ends, its bytes, whether it starts here.
        part, end, pieces, here = 0, None, [], False

        def close():
            nonlocal pieces
            if pieces and end is not None:
                put(now[0], end, part, pieces, here and part + sum(map(len, pieces)) >= end)
            pieces = []

        for key, at, value in _Splits(batches).rows():
            if key != now:
                close()
                now = key
                if key not in table:
                    raise RuntimeError(f"split {key[1]} of {key[0]} was not seen by the first pass")
                base, entry, end = table[key]
                part, here = base + at - len(MAGIC), False
            if not key[1] and not at:
                continue  # what precedes the first magic of a file
            place = base + at - len(MAGIC)
            if end is None:
                continue  # the chain broke earlier
            if place >= end:
                close()
                head = parse_head(value) if place == end else None
                part, here, end = place, True, None if head is None else place + head.length
                if head is None:
                    continue
            pieces.append(MAGIC.encode() + value)
            if held > 1 << 23:
                yield flush()
        if now:
            close()
        if rows:
            yield flush()

    return run


RECORDS = ("file string, end long, record_type string, record_id string, target_uri string, refers_to string, "
           "declared_digest string, declared_length long, payload binary")


def _parse(batches):
    """Fields and payload of whole records; the headers of an enclosed HTTP message are taken off."""
    for b in batches:
        out = []
        for raw in b.column("raw").to_pylist():
            value = raw[len(MAGIC):]
            head = parse_head(value)
            body = value[head.body:head.length - len(MAGIC) - 4]
            get = lambda name, h=head: (h.fields.get(name) or b"").decode("utf-8", "replace") or None
            length = None
            if body.startswith(b"HTTP/"):
                http, _, body = body.partition(END.encode())
                for row in http.split(b"\r\n"):
                    name, _, rest = row.partition(b":")
                    if name.strip().lower() == b"content-length" and rest.strip().isdigit():
                        length = int(rest)
            out.append((get(b"warc-type"), get(b"warc-record-id"), get(b"warc-target-uri"), get(b"warc-refers-to"),
                        get(b"warc-payload-digest"), length, body))
        c = list(zip(*out)) or [[]] * 7
        kinds = [*[pa.string()] * 5, pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([b.column("file"), b.column("end"), *[pa.array(x, k) for x, k in zip(c, kinds)]],
                                         names=[x.split()[0] for x in RECORDS.split(", ")])


#: Splits whose entries one job carries; an archive of more splits is read by several jobs, file by file.
SPLITS_PER_JOB = 200_000


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives below ``path``: file, end (offset), record_type, record_id, target_uri,
    refers_to, declared_digest, declared_length and payload (bytes)."""
    entries = split_entries(spark, path)
    files = entries.groupBy("file").agg(F.count(F.lit(1)).alias("n")).orderBy("file").collect()
    jobs, room = [[]], SPLITS_PER_JOB
    for f in files:
        if jobs[-1] and f["n"] > room:
            jobs.append([])
            room = SPLITS_PER_JOB
        jobs[-1].append(f["file"])
        room -= f["n"]
    out = None
    for names in jobs:
        mine = entries if len(jobs) == 1 else entries.join(F.broadcast(spark.createDataFrame([(n,) for n in names], "file string")), "file")
        table = {(r["file"], r["split"]): (r["base"], r["entry"], r["end"]) for r in mine.collect()}
        # A record goes on in a split whose entry is not its first candidate.
        torn = any(split and entry != base - len(MAGIC) for (_, split), (base, entry, _) in table.items())
        lines = _lines(spark, path if len(jobs) == 1 else names)
        found = map_arrow(lines, _follow(table), FOUND)
        whole = found.filter("complete").select("file", "end", "raw")
        if torn:
            parts = (found.filter("not complete").groupBy("file", "end")
                     .agg(F.array_sort(F.collect_list(F.struct("part", "raw"))).alias("_parts"))
                     .select("file", "end", F.aggregate("_parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["raw"])).alias("raw"))
                     # The last record of a file may be cut short; then it is no record.
                     .join(mine.groupBy("file").agg(F.max("end").alias("_end")), "file").filter(F.col("end") <= F.col("_end")).drop("_end"))
            whole = whole.unionByName(parts)
        with fixed_splits(spark):
            records = materialise(map_arrow(whole, _parse, RECORDS), "records", compression="zstd")
        out = records if out is None else out.unionByName(records)
    return out if out is not None else spark.createDataFrame([], RECORDS)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages as archives in the shared folder and read the archives back."""
    spark = pages.sparkSession
    return read_warc(spark, write_warc(pages, fresh_path(spark, "warc"), **options))
