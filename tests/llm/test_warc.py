import base64
import hashlib
import random
import shutil
import uuid
from collections import Counter, defaultdict

import pyarrow.fs as pafs
from pyspark.sql import functions as F

from tablewright.functions.scale import shared_folder
from tablewright.llm import warc
from tablewright.llm.warc import LoserTree, archived, capture_index, url_key, write_archives

PAGES = [
    (1, "http://a.example.com/x?b=1", "<p>same</p>"),
    (2, "https://www.a.example.com/x?b=1", "<p>same</p>"),
    (3, None, None),
    (4, "not a url\r\nX: y", ""),
    (5, "http://b.example.com", "café \U0001f600" * 5000),
    (5, "http://b.example.com", "other"),
    (6, "http://b.example.com", "other"),
    (6, "http://b.example.com", "other"),
    (None, "http://c.example.com/", "alone"),
    (None, "http://c.example.com/", "other"),
    (7, "http://[bad", "x"),
]


def brute(rows):
    keeper = defaultdict(list)
    for page_id, _, html in rows:
        keeper[html or ""].append(-1 if page_id is None else page_id)
    out = Counter()
    for page_id, _, html in rows:
        payload, best = (html or "").encode(), max(keeper[html or ""])
        revisit = (-1 if page_id is None else page_id) != best
        out[page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", best if revisit else None] += 1
    return out


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("same", F.lit(1)).withColumn("key", F.lit(2)).repartition(3)
    index = archived(pages, archive_bytes=200).cache()
    assert Counter(map(tuple, index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())) == brute(PAGES)
    assert index.where("page_id = 3").first().url is None
    rows = index.orderBy("part", "position").collect()
    order = [(r.url_key, r.captured, -1 if r.page_id is None else r.page_id) for r in rows]
    assert order == sorted(order)
    assert archived(pages.where("false")).count() == 0


def test_archives_are_whole_and_a_given_time_is_kept(spark):
    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    pages = spark.createDataFrame(PAGES[:2], "page_id long, url string, html string").withColumn("at", F.timestamp_seconds(F.lit(1_000_000_000)))
    assert write_archives(pages, folder, "at") == 2
    names = [f.base_name for f in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(folder)) if f.base_name != "_archives"]
    assert names and all(n.endswith(".warc.gz") and not n.startswith(".") for n in names)
    assert {r.captured for r in capture_index(spark, folder).collect()} == {"2001-09-09T01:46:40Z"}


def test_loser_tree():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(n)]
        assert list(LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_key():
    assert url_key("http://WWW.A.example.com:80/X?y=1") == "com,example,a)/x?y=1"
    assert url_key("") == ")/"


def test_any_page_id_and_archives_of_lost_attempts(spark, monkeypatch):
    rows = [(i, "http://a.example.com/", f"page {i % 3}") for i in (0, -1, 10**13, 2**63 - 1, -(2**63), 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(warc, "RANGE_ROWS", 2)
    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    assert write_archives(pages, folder, archive_bytes=100) == len(rows)
    # a whole archive that a lost attempt left is not listed, and not read
    names = [f.path for f in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(folder)) if f.base_name.endswith(".gz")]
    shutil.copy(names[0], f"{folder}/part-000000-lost-00000.warc.gz")
    index = capture_index(spark, folder)
    got = Counter(map(tuple, index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    want = defaultdict(list)
    for i, _, html in rows:
        want[html].append(i)
    assert sorted(k[0] for k in got.elements()) == sorted(i for i, *_ in rows)
    assert all((k[3] == "response") == any(k[0] == max(m) for m in want.values()) for k in got)
    order = [(r.url_key, r.captured, r.page_id) for r in index.orderBy("part", "position").collect()]
    assert order == sorted(order)
