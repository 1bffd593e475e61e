"""Archives: names that no split changes, bounded files, and transactions joined where they
are read against those joined as tables."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from aislebrook.llm import queries, warc
from aislebrook.sources.scratch import scratch_path


def record(name, kind, links=(), body=b"x"):
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode()]
    head += [b"WARC-Record-ID: " + name.encode()] if name else []
    head += [b"WARC-Concurrent-To: " + x.encode() for x in links] + [b"Content-Length: %d" % len(body)]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def shape(captures):
    """What each capture nests, over its parts; and what no capture has."""
    found, loose = {}, []
    for r in captures.collect():
        nested = [x for side in (r.requests, r.metadata) for x in side or []]
        if r.record_id is None and r.record_type is None:
            loose += [(x.record_type, x.record_id, bytes(x.payload)) for x in nested]
        else:
            key = (r.record_id, r.record_type, bytes(r.payload))
            entry = found.setdefault(key, [])
            entry += [("requests" if x in (r.requests or []) else "metadata", x.record_id, bytes(x.payload)) for x in nested]
    return {k: sorted(v) for k, v in found.items()}, sorted(loose, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_joined_in_the_archive_is_as_joined_in_tables(spark, tmp_path, seed):
    rng = random.Random(seed)
    files = {f: [] for f in range(6)}
    names = [f"r{i}" for i in range(160)]
    for i in range(0, 160, 4):  # transactions, most of them in one archive
        home = rng.randrange(6)
        for k, name in enumerate(names[i : i + 4]):
            kind = ["response", "request", "metadata", rng.choice(["metadata", "revisit", "request"])][k]
            links = [names[i + rng.choice([0, 0, 1])]] if k else ([names[i + 1]] if rng.random() < 0.5 else [])
            links += [rng.choice(names)] if rng.random() < 0.06 else []
            links += ["nowhere"] if rng.random() < 0.03 else []
            where = home if rng.random() < 0.9 else rng.randrange(6)
            files[where].append(record(name, kind, links, name.encode()))
            if rng.random() < 0.03:
                files[rng.randrange(6)].append(record(name, kind, links, name.encode()))
    files[0] += [record(None, "metadata", ["r0"], b"no id"), record(None, "response", [], b"no id either")]
    for f, some in files.items():
        rng.shuffle(some)
        (tmp_path / f"{f}.warc.gz").write_bytes(gzip.compress(b"".join(some)) if f % 2 else b"".join(some))
    got = shape(warc.assemble_archives(spark, str(tmp_path)))
    want = shape(warc.assemble(warc.read_archives(spark, str(tmp_path))))
    assert got == want and len(got[0]) > 40


def test_records_are_named_after_their_rows(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i % 90 if i % 7 else None, f"http://h/{i % 11}", rng.choice(["a", "bb", "", None, "ccc" * 50])) for i in range(300)]
    rows += rows[:40]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    seen = []
    for parts in (1, 5, 13):
        path = scratch_path(spark, "archives")
        warc.write_archives(pages.repartition(parts), path)
        records = warc.read_archives(spark, path)
        seen.append(sorted(map(tuple, records.select("record_id", "record_type", "refers_to", "payload_bytes").collect()), key=str))
        ids = records.select("record_id")
        assert ids.count() == 3 * len(rows) == ids.distinct().count()
        assert records.where("record_type = 'response'").count() == 4
    assert seen[0] == seen[1] == seen[2]


def test_large_pages_get_files_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", {100: 30, 1000: 6, 1 << 62: 3})
    pages = spark.createDataFrame([(i, "u", chr(97 + i % 26) * n) for i, n in enumerate([5] * 20 + [500] * 4 + [5000] * 3)], "page_id bigint, url string, html string")
    path = scratch_path(spark, "archives")
    warc.write_archives(pages.coalesce(1), path)
    files = warc._files(spark, path).select(F.length("content").alias("n"))
    assert files.count() == 2 + 2 + 3
    assert warc.assemble_archives(spark, path).where("record_type IS NOT NULL").count() == 27


def test_empty_pages_and_the_query(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    path = scratch_path(spark, "archives")
    warc.write_archives(pages, path)
    assert warc.assemble_archives(spark, path).count() == 0
    os.makedirs(tmp_path / "empty")
    pages.write.parquet(f"{tmp_path}/empty/pages.parquet")
    assert queries.QUERIES["op2_warc_assembly"](spark, f"{tmp_path}/empty").count() == 0
