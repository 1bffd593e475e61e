"""WARC archives: writing captures, reading records, assembling transactions.

A capture is a response or revisit record with its request and metadata records, which
name it as concurrent. Archives are text that Spark's own writer puts down (a record of
UTF-8 payload is text, and the record separator its line separator), one gzip file for a
bounded number of records and bytes, so that any task can read any archive whole.

Assembly takes records from any archives in any order: a request or metadata record
belongs to the capture that it names, that names it, or that a record near it belongs
to. Records that link to nothing outside their archive, and that nothing outside links
to, are joined by the task that reads the archive, with their payloads; all others are
joined as tables, links without payloads first. A capture with very many records comes in
several rows, each of a bounded number.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aislebrook.sources.scratch import materialize

from .common import field, named

# Records of one archive file by the bytes of a payload, up to each limit: three records
# to a page, some 128 MB of pages to a file, or one page.
RECORDS_PER_FILE = {64 << 10: 6000, 1 << 20: 375, 1 << 62: 3}
# Requests and metadata of one capture that one row nests.
NESTED = 1000
_CRLF = "\r\n"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CAPTURES = ["response", "revisit", "resource"]

_FIELDS = "array<struct<name:string,value:string>>"
RECORD = T.StructType(
    [
        field("record_id", T.StringType()),
        field("record_type", T.StringType()),
        field("target_uri", T.StringType()),
        field("date", T.StringType()),
        field("content_type", T.StringType()),
        field("concurrent_to", T.ArrayType(T.StringType())),
        field("refers_to", T.StringType()),
        field("stated_digest", T.StringType()),
        field("payload_digest", T.StringType()),
        field("payload_bytes", T.LongType()),
        field("fields", T.ArrayType(T.StructType([field("name", T.StringType()), field("value", T.StringType())]))),
        field("payload", T.BinaryType()),
    ]
)


def base32_of_hex(digits: Column) -> Column:
    """Upper-case base32 of a text of 40 hexadecimal digits."""
    out = []
    for i in range(8):
        part = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(_ALPHABET), F.shiftright(part, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in range(4)]
    return F.concat(*out)


def _record(kind, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record's text without the blank lines that end it. Headers that are null are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(_CRLF, *lines), F.lit(_CRLF * 2), block)


def _urn(kind: str, *key: Column) -> Column:
    texts = [F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("")) for k in key]
    h = F.md5(F.concat_ws("\n", F.lit(kind), *texts))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write the rows of pages (page_id, url, html) as captures to folder path.

    Of rows with equal payloads of at least least_bytes bytes, the one with the largest
    page_id, then url, is written as response, the others as revisits of it. A null html is
    an empty payload; a null url leaves out the target; a null page_id is smaller than any;
    rows that repeat in all three each make a capture, and one of them the response.
    Records are named after what their rows hold, so a pages table may be split differently
    each time that it is read. Empty tables give an empty folder."""
    rows = pages.select(
        named("page_id").alias("page_id"),
        F.replace(F.replace(named("url").cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"),
        F.coalesce(named("html"), F.lit("")).alias("html"),
    )
    rows = rows.withColumns({"content": F.sha2(F.col("html"), 256), "size": F.octet_length("html")})
    kinds = rows.groupBy("content", "page_id", "url").agg(F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"))
    first = kinds.groupBy("content").agg(F.max(F.struct("page_id", "url")).alias("first"), F.max("copies").alias("most"), F.max("size").alias("bytes"))
    first = materialize(first, "payloads")
    largest, repeated = first.agg(F.max("bytes"), F.max("most")).first()
    low = -1
    for high, records in RECORDS_PER_FILE.items():
        if largest is not None and largest > low:
            _write_records(rows.where((F.col("size") > low) & (F.col("size") <= high)), first, repeated > 1, path, records, least_bytes, date)
        low = high
    if largest is None:
        pages.sparkSession.createDataFrame([], "value string").write.text(path)


def _write_records(rows: DataFrame, first: DataFrame, repeated: bool, path: str, per_file: int, least_bytes: int, date: str) -> None:
    rows = rows.withColumn("digest", F.sha1("html"))
    known = first.select("content", "first", "most")
    some = rows.join(known.where("most = 1") if repeated else known, "content").withColumn("copy", F.lit(0).cast("long"))
    if repeated:
        same = rows.join(known.where("most > 1"), "content").groupBy("content", "page_id", "url")
        each = same.agg(*[F.first(c).alias(c) for c in ("html", "size", "digest", "first", "most")], F.count(F.lit(1)).alias("n"))
        each = each.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        some = some.unionByName(each.drop("n"))
    _records(some, least_bytes, date).write.mode("append").option("lineSep", _CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def _records(rows: DataFrame, least_bytes: int, date: str) -> DataFrame:
    """The records of rows (page_id, url, html, content, digest, copy, first) as text."""
    own = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url")) & (F.col("copy") == 0)
    again = ~own & (F.col("size") >= least_bytes)
    digest = F.concat(F.lit("sha1:"), base32_of_hex(F.col("digest")))
    row = [F.col(c) for c in ("content", "page_id", "url", "copy")]
    original = [F.col("content"), F.col("first.page_id"), F.col("first.url"), F.lit(0)]
    response, request = _urn("response", *row), _urn("request", *row)
    body = F.when(again, F.lit("")).otherwise(F.col("html"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "),
        F.col("size").cast("string"),
        F.lit(_CRLF * 2),
        body,
    )
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    host = F.coalesce(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.lit(""))
    asked = F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{_CRLF}Host: "), host, F.lit(_CRLF * 2))
    records = F.array(
        _record(
            F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
            response,
            [
                *common,
                ("WARC-Concurrent-To", request),
                ("WARC-Payload-Digest", digest),
                ("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
                ("WARC-Refers-To", F.when(again, _urn("response", *original))),
                ("Content-Type", F.lit("application/http; msgtype=response")),
            ],
            http,
        ),
        _record(F.lit("request"), request, [*common, ("Content-Type", F.lit("application/http; msgtype=request"))], asked),
        _record(
            F.lit("metadata"),
            _urn("metadata", *row),
            [*common, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/warc-fields"))],
            F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(_CRLF)),
        ),
    )
    return rows.select(F.explode(records).alias("value"))


def _header(lines: bytes) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for line in lines.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        found.setdefault(name.decode("utf-8", "replace").strip().lower(), []).append(value.decode("utf-8", "replace").strip())
    return found


def parse(stream, name: str = ""):
    """The records of an archive stream, as tuples in the order of RECORD. A record that
    does not begin or end as it should raises ValueError with its place."""
    at = 0
    while True:
        head = b""
        while True:
            line = stream.readline()
            if not line:
                if head.strip():
                    raise ValueError(f"{name}: record {at} is cut off")
                return
            if not head and line in (b"\r\n", b"\n"):
                continue
            if line in (b"\r\n", b"\n"):
                break
            head += line
        if not head.startswith(b"WARC/"):
            raise ValueError(f"{name}: record {at} has no version")
        h = _header(head.replace(b"\r\n", b"\n").replace(b"\n", b"\r\n").rstrip(b"\r\n"))
        size = int(h.get("content-length", ["0"])[0])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"{name}: record {at} is cut off")
        at += 1
        one = {k: v[0] for k, v in h.items()}
        kind = one.get("content-type", "")
        payload, fields = block, None
        if kind.startswith("application/http"):
            cut = block.find(b"\r\n\r\n")
            payload = block[cut + 4 :] if cut >= 0 else b""
        elif kind.startswith("application/warc-fields"):
            fields = [{"name": k, "value": x} for k, v in _header(b"\r\n" + block).items() if k for x in v]
        stated = one.get("warc-payload-digest")
        yield (
            one.get("warc-record-id"),
            one.get("warc-type"),
            one.get("warc-target-uri"),
            one.get("warc-date"),
            kind or None,
            h.get("warc-concurrent-to", []),
            one.get("warc-refers-to"),
            stated.removeprefix("sha1:") if stated else None,
            base64.b32encode(hashlib.sha1(payload).digest()).decode(),
            len(payload),
            fields,
            payload,
        )


_FIELD = pa.struct([("name", pa.string()), ("value", pa.string())])
_KINDS = [
    *[pa.field(n, pa.string()) for n in RECORD.names[:5]],
    pa.field("concurrent_to", pa.list_(pa.string())),
    *[pa.field(n, pa.string()) for n in RECORD.names[6:9]],
    pa.field("payload_bytes", pa.int64()),
    pa.field("fields", pa.list_(_FIELD)),
    pa.field("payload", pa.binary()),
]
# What a capture nests of a request or metadata record.
LIGHT = ["record_id", "record_type", "target_uri", "date", "fields", "payload", "concurrent_to"]
_PLACES = [RECORD.names.index(c) for c in LIGHT]
_NESTED = T.ArrayType(T.StructType([RECORD[c] for c in LIGHT]))


def _streams(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    """The records of each archive of a batch (path, content)."""
    for i in range(batch.num_rows):
        content = batch.column(1)[i].as_buffer()
        raw = pa.BufferReader(content)
        stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2].to_pybytes() == b"\x1f\x8b" else io.BufferedReader(raw)
        yield parse(stream, batch.column(0)[i].as_py())


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """rows in batches of a bounded number and size."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total > 4 << 20 or len(held) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held), schema)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held), schema)], schema=schema)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below path, plain or gzip, by record or as a whole.
    payload is the body of an HTTP message, else the block; its digest and size are
    taken of the bytes read, stated_digest is the header's."""

    def run(batches):
        for batch in batches:
            for records in _streams(batch):
                yield from _batches(records, pa.schema(_KINDS), lambda r: r[9])

    return _files(spark, path).mapInArrow(run, RECORD)


def transactions(records: list[tuple]) -> Iterator[tuple[tuple, list | None, list | None, bool]]:
    """(record, requests, metadata, whole) of one archive's records. A set of linked
    records is whole if all that they link to is among them and none is there twice: its
    captures come with what they nest. The records of other sets come one by one, not
    whole, as do those that no capture has."""
    place: dict[str, int] = {}
    twice = set()
    for i, r in enumerate(records):
        if r[0] is not None and place.setdefault(r[0], i) != i:
            twice.add(r[0])
    root = list(range(len(records)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    broken = set()
    near: dict[int, set[int]] = {}
    for i, r in enumerate(records):
        if r[0] is None:
            continue
        if r[0] in twice:
            broken.add(i)
        for other in r[5]:
            j = place.get(other)
            if j is None or other in twice:
                broken.add(i)
            elif i != j:
                near.setdefault(i, set()).add(j)
                near.setdefault(j, set()).add(i)
                root[top(i)] = top(j)
    broken = {top(i) for i in broken}
    sets: dict[int, list[int]] = {}
    for i in range(len(records)):
        sets.setdefault(top(i), []).append(i)
    for name, some in sets.items():
        captures = [i for i in some if records[i][1] in CAPTURES]
        if name in broken or not captures or len(some) - len(captures) > NESTED:
            for i in some:
                yield records[i], None, None, False
            continue
        # Level by level, as links lead: the smallest capture of those reached before.
        owner = {i: records[i][0] for i in captures}
        front = captures
        while front:
            reached = {j for i in front for j in near.get(i, ()) if j not in owner}
            new = {j: min(owner[i] for i in near[j] if i in owner) for j in reached}
            owner |= new
            front = list(new)
        for i in captures:
            mine = sorted((records[j] for j in some if j not in captures and owner[j] == records[i][0]), key=lambda r: r[0])
            nested = [[tuple(r[k] for k in _PLACES) for r in mine if (r[1] == "request") is wanted] for wanted in (True, False)]
            yield records[i], *(nested if mine else (None, None)), True


def assemble_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per capture of all archives below path, as `assemble` gives them from the
    records, bodies included. The task that reads an archive joins what lies together
    there; sets of records that reach into other archives, or whose records another archive
    holds as well, go through `assemble`. What was read is written once. An empty folder
    gives no rows."""
    light = pa.struct([_KINDS[k] for k in _PLACES])
    schema = pa.schema([*_KINDS, pa.field("requests", pa.list_(light)), pa.field("metadata", pa.list_(light)), pa.field("whole", pa.bool_())])

    def run(batches):
        for batch in batches:
            for records in _streams(batch):
                made = ((*r, *([None if x is None else [dict(zip(LIGHT, t)) for t in x] for x in nested]), whole) for r, *nested, whole in transactions(list(records)))
                yield from _batches(made, schema, lambda r: r[9])

    kinds = T.StructType([*RECORD, field("requests", _NESTED), field("metadata", _NESTED), field("whole", T.BooleanType())])
    read = materialize(_files(spark, path).mapInArrow(run, kinds), "transactions")
    whole, rest = read.where("whole").drop("whole"), read.where("not whole").select(*RECORD.names)
    nested = F.concat(*[F.coalesce(F.col(c), F.array().cast(_NESTED)) for c in ("requests", "metadata")])
    members = whole.select("record_id", F.explode(F.concat(F.array("record_id"), F.transform(nested, lambda r: r["record_id"]))).alias("member"))
    alone = rest.select(F.lit(None).cast("string").alias("record_id"), F.explode(F.concat(F.array("record_id"), "concurrent_to")).alias("member")).distinct()
    # Sets that a record of another archive links to, or that another archive holds as well.
    touched = members.unionByName(alone).where("member is not null").groupBy("member").agg(F.count(F.lit(1)).alias("n"), F.collect_set("record_id").alias("ids")).where("n > 1")
    touched = materialize(touched.select(F.explode("ids").alias("record_id")).distinct(), "touched")
    captures = whole.drop("fields").withColumn("part", F.lit(0).cast("long"))
    if rest.isEmpty() and touched.isEmpty():
        return captures
    reopened = whole.join(touched, "record_id", "left_semi")
    inner = reopened.select(F.explode(nested).alias("r")).select("r.*")
    again = reopened.select(*RECORD.names).unionByName(inner, allowMissingColumns=True)
    others = assemble(materialize(rest.unionByName(again.select(*RECORD.names)), "records"))
    return captures.join(touched, "record_id", "left_anti").unionByName(others, allowMissingColumns=True)


def index_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives without their payloads, written once."""
    return materialize(read_archives(spark, path).drop("payload"), "index")


def _owners(records: DataFrame) -> DataFrame:
    """(record_id, capture_id) of the requests and metadata that belong to a capture; the
    smallest capture where there are several. Follows links from record to record as far
    as they lead."""
    light = materialize(records.select("record_id", F.col("record_type").isin(*CAPTURES).alias("capture"), "concurrent_to"), "records")
    pairs = light.select("record_id", F.explode("concurrent_to").alias("other"))
    both = pairs.union(pairs.select("other", "record_id")).toDF("record_id", "other").distinct()
    parts = light.where("not capture").select("record_id").distinct()
    both = materialize(both.join(parts, "record_id", "left_semi"), "pairs")
    reached = light.where("capture").select(F.col("record_id").alias("other"), F.col("record_id").alias("capture_id")).distinct()
    found = None
    while True:
        new = both.join(reached, "other").groupBy("record_id").agg(F.min("capture_id").alias("capture_id"))
        if found is not None:
            new = new.join(found, "record_id", "left_anti")
        new = materialize(new, "owners")
        found = new if found is None else found.union(new)
        # Links that still lead to a record without a capture, from one that has just got one.
        reached = new.withColumnRenamed("record_id", "other")
        ahead = both.join(reached, "other", "left_semi").select("record_id").join(found, "record_id", "left_anti")
        if ahead.isEmpty():
            return found


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture from records (RECORD, with or without payload; read several
    times, so a written index of the archives is best): its own columns, requests and metadata as arrays of structs
    ordered by record id, and part (0, 1, ... where there are more than NESTED of them;
    the capture's columns repeat). Requests and metadata that no link ties to a capture
    come as rows of their own, with null record_id. Repeated records repeat; a record
    without id is a capture of its own or, if no capture, untied."""
    owners = _owners(records)
    light = [c for c in LIGHT if c in records.columns]
    rest = records.where(~F.col("record_type").isin(*CAPTURES)).select(*light).join(owners, "record_id", "left")
    counts = owners.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > NESTED)
    rest = rest.join(counts, "capture_id", "left")
    whole = F.xxhash64("record_id")
    part = F.when(F.col("capture_id").isNull(), whole).otherwise(F.pmod(whole, F.ceil(F.coalesce("n", F.lit(1)) / NESTED)))
    nested = F.sort_array(F.collect_list(F.struct(*light)))
    groups = rest.groupBy("capture_id", part.alias("part")).agg(nested.alias("all"))
    groups = groups.select(
        "capture_id",
        F.when(F.col("capture_id").isNotNull(), F.col("part")).alias("part"),
        F.filter("all", lambda r: r["record_type"] == "request").alias("requests"),
        F.filter("all", lambda r: r["record_type"] != "request").alias("metadata"),
    )
    captures = records.where(F.col("record_type").isin(*CAPTURES)).drop("fields")
    tied = captures.join(groups.where("capture_id is not null"), captures.record_id == F.col("capture_id"), "left").drop("capture_id")
    tied = tied.withColumn("part", F.coalesce("part", F.lit(0).cast("long")))
    loose = groups.where("capture_id is null").drop("capture_id")
    return tied.unionByName(loose, allowMissingColumns=True)


def field_of(captures: Column, name: str) -> Column:
    """A field of the first of a capture's metadata records that has it, or null."""
    fields = F.flatten(F.transform(captures, lambda m: F.coalesce(m["fields"], F.array().cast(_FIELDS))))
    return F.filter(fields, lambda f: f["name"] == name).getItem(0)["value"]


def resolve(captures: DataFrame, columns: list[str]) -> DataFrame:
    """captures with `full_<column>` for each column: a revisit has the column of the
    response it refers to (null if no archive holds it), any other capture its own."""
    full = captures.where("record_type = 'response' and part = 0").select(F.col("record_id").alias("refers_to"), *[F.col(c).alias(f"full_{c}") for c in columns])
    revisits = captures.where("record_type = 'revisit'").join(full, "refers_to", "left").select(*captures.columns, *[f"full_{c}" for c in columns])
    others = captures.where("record_type is null or record_type != 'revisit'").withColumns({f"full_{c}": F.col(c) for c in columns})
    return revisits.unionByName(others)
