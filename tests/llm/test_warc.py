"""WARC archives: round trip, byte ranges, and payload groups against brute force."""

import base64
import glob
import gzip
import hashlib
import os
import random
import tempfile
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vigie.llm.warc import Archive, member, parse, read_warc, record, resolved, revisits, warc_report, write_warc

PAGES = "page_id long, url string, html string"


def brute(rows, min_bytes=0):
    groups = defaultdict(list)
    key = lambda k, i: (i is not None, i or 0, -k)
    for k, (i, _, html) in enumerate(rows):
        groups[(html or "").encode()].append(key(k, i))
    out = []
    for k, (i, _, html) in enumerate(rows):
        payload = (html or "").encode()
        top = max(groups[payload])
        again = top != key(k, i) and len(payload) >= min_bytes
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((i, len(payload), digest, "revisit" if again else "response", top[1] if again and top[0] else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [None, "", "same", "é" * 1000, "x" * 200_000, "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "\x1f tail\x00"]
    own = [(i, rng.choice([None, f"http://x/{i}", "a\r\nb é"]), rng.choice(texts + [rng.randbytes(2000).hex()])) for i in range(200)]
    return own + [(None, "u", "same")] * 3 + [(199, "dup", "same")] * 2 + [(None, None, "solo")] * 2


@pytest.fixture(scope="module")
def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES).coalesce(1)


def test_report(spark, pages, rows):
    clash = pages.withColumns({c: F.lit("x") for c in ("id", "key", "digest", "place", "top", "payload", "members", "record_type")})
    assert sorted(map(tuple, warc_report(clash).collect()), key=str) == brute(rows)


def test_smaller_payloads_are_all_responses(spark, pages, rows):
    got = [r["record_type"] for r in revisits(pages, min_bytes=100).collect()]
    assert got.count("revisit") == sum(r[3] == "revisit" for r in brute(rows, 100)) > 0


@pytest.mark.parametrize("split", [900, 7777, 1 << 30])
def test_ranges_own_every_record_once(spark, pages, rows, split):
    folder = tempfile.mkdtemp(prefix="warc-")
    write_warc(revisits(pages).coalesce(2), folder, file_bytes=60_000)
    files = glob.glob(f"{folder}/*")
    assert len(files) > 2 and all(f.endswith(".warc.gz") for f in files)
    back = read_warc(spark, folder, split_bytes=split)
    assert back.rdd.getNumPartitions() == sum(-(-os.path.getsize(f) // split) for f in files)
    held = back.select("file", "offset", "record_type", "record_id").collect()
    assert len({(r["file"], r["offset"]) for r in held}) == len(held) == len(rows) + len(files)
    assert len({r["record_id"] for r in held}) == len(held)
    # the standard decoder reads the same bytes
    assert sum(gzip.open(f).read().count(b"\r\nWARC-Record-ID: ") for f in files) == len(held)
    full = [(r["page_id"], bytes(r["payload"]).decode()) for r in resolved(back).select("page_id", "payload").collect()]
    assert sorted(full, key=str) == sorted(((None if i is None else str(i), h or "") for i, _, h in rows), key=str)


def test_empty_table(spark, empty):
    assert warc_report(spark.createDataFrame([], PAGES)).count() == 0


def test_overwrite(spark, pages):
    folder = tempfile.mkdtemp(prefix="warc-")
    for mode, times in (("append", 1), ("append", 2), ("overwrite", 1)):
        write_warc(revisits(pages), folder, mode=mode)
        assert read_warc(spark, folder).where("record_type <> 'warcinfo'").count() == times * pages.count()


class File:
    def __init__(self, data):
        self.data, self.pos = data, 0

    def seek(self, pos):
        self.pos = pos

    def read(self, n):
        return self.data[self.pos:self.pos + n]


def stored(data):
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def test_members_inside_a_record_are_not_records():
    rng = random.Random(5)
    make = lambda k: record("resource", [("X-Page-ID", str(k))], rng.randbytes(rng.randint(0, 400)))
    inner = b"".join(member(make(1000 + k)) for k in range(5))
    whole = []
    for k in range(30):
        # stored blocks keep a whole embedded archive readable inside the record
        data = record("resource", [("X-Page-ID", str(k))], rng.randbytes(50) + inner + rng.randbytes(50)) if k % 4 == 0 else make(k)
        whole.append(stored(data) if k % 4 == 0 else member(data))
        if k == 7:
            whole.append(member(b""))  # an empty member holds no record
    archive = b"".join(whole)
    longest = max(map(len, whole))
    for size in (longest, longest + 501, 2 * longest, len(archive)):
        found = []
        for start in range(0, len(archive), size):
            reader = Archive(File(archive), len(archive), "a")
            found += [parse(data, "a")["page_id"] for _, data in reader.records(start, min(start + size, len(archive)))]
        assert found == [str(k) for k in range(30)]


def test_damage_raises():
    good = b"".join(member(record("resource", [], b"x" * n)) for n in (5, 3000, 7))
    with pytest.raises(ValueError, match="truncated"):
        list(Archive(File(good[:-3]), len(good) - 3, "a").records(0, len(good)))
    with pytest.raises(ValueError, match="no gzip member"):
        list(Archive(File(good + b"tail"), len(good) + 4, "a").records(0, len(good) + 4))
    http = b"HTTP/1.1 200 OK\r\n\r\npayload"
    with pytest.raises(ValueError, match="digest"):
        parse(record("response", [("WARC-Payload-Digest", "sha1:" + "A" * 32)], http), "a")
    with pytest.raises(ValueError, match="length"):
        parse(record("response", [], http)[:-1], "a")
