from __future__ import annotations

import datetime as dt
import hashlib
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from sourcelight.operators import catalog as C
from sourcelight.operators import checks
from sourcelight.plans import registry
from sourcelight.sources.files import read_files, scan_files, write_table, write_text_files
from sourcelight.streaming import ingest

NOW = dt.datetime(2024, 7, 1)


def folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_equal_files_share_one_object(spark):
    text = "one small text"
    files = spark.createDataFrame([("a", text), ("b", text)], "path string, text string")
    refs = C.object_references(files, "text", "text/plain")
    rows = C.content_objects(refs.unionByName(refs).unionByName(refs)).collect()  # original, extraction, passage
    assert [(r.sha256, r.reference_count, r.compression_level) for r in rows] == [(hashlib.sha256(text.encode()).hexdigest(), 6, 6)]
    levels = spark.createDataFrame([("image/png",), ("text/x",), ("application/octet-stream",), ("image/tiff",), ("application/vnd.openxmlformats-officedocument.x",)], "m string")
    assert [r.l for r in levels.select(C.compression_level("m").alias("l")).collect()] == [1, 6, 3, 3, 1]


def test_verification(spark):
    good = hashlib.sha256(b"abc").hexdigest()
    df = spark.createDataFrame([(good, "abc"), (good.upper(), "abc"), (good, "abd"), (good, "abcdef")], "sha256 string, payload string")
    assert [r.reason for r in C.verify_objects(df, limit=5).collect()] == [None, "invalid_hash", "checksum_mismatch", "read_limit_exceeded"]


def test_extraction_state(spark):
    rows = [("text/plain", b"ok"), ("text/plain", b"\xff\xfe"), ("image/png", b"x"), ("application/json", b"{}")]
    df = spark.createDataFrame([(m, bytearray(c)) for m, c in rows], "mime_type string, content binary")
    assert [r.state for r in C.extraction_state(df).collect()] == ["active", "unsupported", "unsupported", "active"]


def test_version_chain_with_failures(spark):
    rng = random.Random(4)
    rows = [("hot" if i % 3 else f"s{i % 4}", i, rng.randint(0, 9) * 1000 + i, rng.random() < 0.6) for i in range(300)]
    df = spark.createDataFrame(rows, "source_id string, version_id bigint, seq bigint, extraction_ok boolean")
    got = {r.version_id: (r.superseded_version_id, r.current_version_id) for r in C.version_chain(df).collect()}
    final = {r.source_id: r.current_version_id for r in C.current_versions(df).collect()}
    for source in {r[0] for r in rows}:
        current = None
        for _, version, _, ok in sorted((r for r in rows if r[0] == source), key=lambda r: r[2]):
            superseded = current if ok else None
            if ok or current is None:
                current = version
            assert got[version] == (superseded, current)
        assert final[source] == current


def test_pages_walk_the_whole_listing(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("aAbB") + str(rng.randint(0, 9)), rng.randint(0, 5), NOW + dt.timedelta(days=rng.randint(0, 3)), rng.choice(["text/a", "Text/A", "text/b"])) for i in range(95)]
    df = spark.createDataFrame(rows, "source_id bigint, display_name string, byte_size bigint, updated_at timestamp, mime_type string")
    expected = {
        "updated": sorted(rows, key=lambda r: (-r[3].timestamp(), -r[0])), "name": sorted(rows, key=lambda r: (r[1].lower(), r[0])),
        "size": sorted(rows, key=lambda r: (-r[2], r[0])), "type": sorted(rows, key=lambda r: (r[4].lower(), r[1].lower(), r[0])),
    }
    for sort, want in expected.items():
        seen, after = [], None
        while True:
            page = C.asset_page(df, sort, after, 30).orderBy("position").collect()
            seen += [r.source_id for r in page]
            if not page[-1].has_more:
                break
            after = page[-1].asDict()
        assert seen == [r[0] for r in want], sort


def test_search_takes_wildcards_literally(spark):
    schema = "source_id bigint, display_name string, canonical_uri string, kind string, state string"
    df = spark.createDataFrame([(1, "50%_Off.md", "file:///x", "local_file", "active"), (2, "50 off", "file:///x", "local_file", "active"), (3, "50%_off", "u", "local_file", "deleted"), (4, "a\\b", "u", "web_page", "active")], schema)
    ids = lambda **f: sorted(r.source_id for r in C.filter_assets(df, **f).collect())
    assert ids(search="%_o") == [1] and ids(search="FILE:") == [1, 2] and ids(search="\\") == [4] and ids(kind="web_page") == [4]
    with pytest.raises(ValueError):
        C.filter_assets(df, kind="other")


def test_cursor_round_trip(spark):
    df = spark.createDataFrame([(1, "naïve ?>~", "z")], "source_id bigint, a string, b string")
    row = df.select(C.encode_cursor("type", "a", "b", "source_id").alias("c")).withColumn("d", C.decode_cursor("c")).first()
    assert not set(row.c) & set("+/=\n") and (row.d.sort, row.d.primary, row.d.secondary, row.d.source_id) == ("type", "naïve ?>~", "z", "1")
    bad = spark.createDataFrame([("",), ("!!!",), ("e30",), ("x" * 5000,)], "c string").select(C.decode_cursor("c").alias("d")).collect()
    assert all(r.d is None for r in bad)


def test_missing_sources_stay_searchable(spark):
    sources = spark.createDataFrame([(s, s * 10, "n", st) for s, st in enumerate(["active", "missing", "deleted", "unsupported", "blocked"])], "source_id bigint, current_version_id bigint, display_name string, state string")
    chunks = spark.createDataFrame([(v, 0) for v in (0, 10, 20, 30, 40, 11)], "version_id bigint, ordinal bigint")
    assert sorted(r.version_id for r in C.current_chunks(chunks, sources).collect()) == [0, 10, 40]


def test_recognised_text(spark):
    words = spark.createDataFrame([(1, "a", 90.0), (1, "b", 70.0), (1, " ", 10.0), (1, "c", -1.0), (2, " ", 50.0)], "image_id bigint, word string, confidence double")
    assert {r.image_id: r.confidence for r in C.ocr_confidence(words, ["image_id"]).collect()} == {1: 80.0, 2: None}
    attempts = [(1, 3, "low", 30.0), (1, 9, "mid", 50.0), (1, 4, "mid too", 46.0), (2, 5, " ", 99.0), (2, 7, "x", 24.9), (3, 2, "unknown", None), (3, 1, "b", 56.0)]
    got = {r.image_id: (r.mode, r.threshold) for r in C.ocr_first_accepted(spark.createDataFrame(attempts, "image_id bigint, mode int, text string, confidence double")).collect()}
    assert got == {1: (4, 45.0), 3: (1, 55.0)}


def test_removing_recognised_text(spark):
    rows = [(1, 100, 0, "meta", False), (1, 101, 1, "a", True), (1, 102, 2, "b", True), (2, 200, 1, "c", True), (3, 300, 1, "d", True)]
    chunks = spark.createDataFrame(rows, "version_id bigint, chunk_id bigint, ordinal bigint, body string, ocr boolean")
    removals = spark.createDataFrame([(1, 101), (2, None)], "version_id bigint, chunk_id bigint")
    left, text = C.remove_derived_chunks(chunks, removals)
    assert sorted(r.chunk_id for r in left.collect()) == [100, 102, 300]
    assert {r.version_id: r.recognised_text for r in text.collect()} == {1: "b", 2: None}


def test_watching(spark):
    sources = spark.createDataFrame([("/a", "1", "active", False), ("/b", "1", "active", False), ("/c", "1", "missing", False), ("/d", "1", "active", False), ("/e", "1", "active", True), ("/f", "1", "deleted", False), ("/g", "1", "missing", False)],
                                    "path string, fingerprint string, state string, watch_paused boolean")
    files = "path string, fingerprint string"
    listing = spark.createDataFrame([("/a", "1"), ("/b", "2"), ("/c", "1"), ("/new", "1"), ("/old", "1"), ("/edited", "2")], files)
    baseline = spark.createDataFrame([("/old", "1"), ("/edited", "1")], files)
    got = {r.path: r.status for r in C.watch_diff(sources, listing, baseline).collect()}
    assert got == {"/a": "unchanged", "/b": "changed", "/c": "reappeared", "/d": "missing", "/new": "new", "/edited": "new"}


def test_files_and_partitions(spark):
    root = folder()
    os.makedirs(f"{root}/sub dir")
    for name, text in [("a.md", "# T\nhello"), ("sub dir/b é.txt", "x" * 10)]:
        with open(f"{root}/{name}", "w") as f:
            f.write(text)
    rows = {r.path.removeprefix(root): r.size for r in scan_files(spark, root).collect()}
    assert rows == {"/a.md": 9, "/sub dir/b é.txt": 10}
    assert "content" not in scan_files(spark, root)._jdf.queryExecution().executedPlan().toString()
    out = f"{folder()}/t"
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id bigint, p string")
    write_table(df, out, "p")
    write_table(df.filter("id = 3").withColumn("id", F.lit(9).cast("bigint")), out, "p")
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 9]
    versions, chunks = ingest.ingest_batch(read_files(spark, root).withColumnRenamed("modificationTime", "modificationTime"))
    assert {r.display_name: r.mime_type for r in versions.collect()} == {"a.md": "text/markdown", "b é.txt": "text/plain"}
    assert sorted((r.display_name, r.token_count) for r in chunks.collect()) == [("a.md", 3), ("b é.txt", 1)]


def test_ingest_keeps_the_last_good_version(spark):
    root, out = folder(), folder()
    run = lambda: ingest.ingest_stream(spark, root, out, f"{out}/checkpoint").awaitTermination()
    with open(f"{root}/a.txt", "w") as f:
        f.write("first text")
    with open(f"{root}/b [x] {{1,2}}*.txt", "w") as f:
        f.write("# H\nother text")
    run()
    with open(f"{root}/c.txt", "wb") as f:
        f.write(b"\xff\xfe\x00bad")
    run()
    versions, chunks = ingest.committed(spark, out)
    assert {r.display_name: r.state for r in versions.collect()} == {"a.txt": "active", "b [x] {1,2}*.txt": "active", "c.txt": "unsupported"}
    first = {r.source_id: r.current_version_id for r in ingest.current_library(versions).collect()}
    assert len(first) == 3 and chunks.count() == 2
    # The same file, broken: its version is recorded, the one before stays current. Then good again.
    at = os.stat(f"{root}/a.txt").st_mtime
    for number, (data, good) in enumerate([(b"\xff\xfe\x00bad", False), (b"second text now", True)]):
        with open(f"{root}/a.txt", "wb") as f:
            f.write(data)
        os.utime(f"{root}/a.txt", (at + 10 + number, at + 10 + number))
        ingest.ingest_files(spark, [f"file:{root}/a.txt"], out, 100 + number)
        versions, chunks = ingest.committed(spark, out)
        now = {r.source_id: r.current_version_id for r in ingest.current_library(versions).collect()}
        assert (now != first) == good and versions.count() == 4 + number
        left = chunks.join(ingest.current_library(versions).selectExpr("current_version_id as version_id"), "version_id", "left_semi")
        assert ("second text now" if good else "first text") in {r.body for r in left.collect()}
    # A batch without its manifest row is not there; trying it again changes nothing.
    before = versions.count(), chunks.count()
    ingest.passages(ingest.extracted(ingest.open_files(spark, [f"file:{root}/a.txt"]))).write.parquet(f"{out}/chunks/batch=200")
    ingest.ingest_files(spark, [f"file:{root}/a.txt"], out, 101)
    again, kept = ingest.committed(spark, out)
    assert (again.count(), kept.count()) == before


def test_long_files_are_not_read(spark):
    root = folder()
    for name, text in [("short.txt", "x"), ("long.txt", "y" * 50)]:
        with open(f"{root}/{name}", "w") as f:
            f.write(text)
    files = ingest.open_files(spark, [f"file:{root}/short.txt", f"file:{root}/long.txt"], most=10)
    assert {r.path[-9:]: r.content for r in files.collect()} == {"short.txt": bytearray(b"x"), "/long.txt": None}
    got = {r.display_name: (r.state, r.byte_size, r.original_sha256 is None) for r in ingest.extracted(files).collect()}
    assert got == {"short.txt": ("active", 1, False), "long.txt": ("unsupported", 50, True)}
    assert ingest.open_files(spark, []).count() == 0


def test_marker_offsets_and_constraints(spark):
    text = "é<m> and <m>"
    df = spark.createDataFrame([("f", bytearray(text.encode())), ("g", bytearray(b"\xff\xfe<m>"))], "path string, content binary")
    assert {(r.path, r.byte_offset) for r in checks.marker_scan(df, ["<m>", "zz"]).collect()} == {("f", 2), ("g", 2)}
    rows = spark.createDataFrame([(1, "supported", 0.5), (2, "odd", 1.5), (3, "stale", None)], "claim_id bigint, status string, confidence double")
    assert {(r.row_key, r.column_name) for r in checks.enum_constraints(rows, "claims", "claim_id").collect()} == {("2", "status"), ("2", "confidence")}


def test_each_document_is_a_file_of_its_own(spark, tmp_path):
    rows = [(7, "one"), (7, "two"), (7, "two"), (-3, "größe"), (None, "x"), (8, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["scan_files"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r["size"]) for r in got) == [(-3, 8), (0, 2), (7, 4), (7, 4), (7, 4)]


def test_written_files_have_no_companions_and_can_be_written_again(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", "x"), ("a/c.txt", "ü\n")], "path string, text string")
    for root in (f"file://{tmp_path}/out", f"{tmp_path}/out"):
        write_text_files(rows, root)
        files = sorted(p for p in (tmp_path / "out").rglob("*") if p.is_file())
        assert [(p.name, p.read_bytes()) for p in files] == [("b.txt", b"x\n"), ("c.txt", "ü\n\n".encode())]


def test_paths_of_a_batch_are_listed_once(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    opened = ingest.open_files(spark, [f"file:{tmp_path}/a.txt"], most=10)
    scans = opened._jdf.queryExecution().analyzed().collectLeaves()
    listings = [spark._jvm.java.lang.System.identityHashCode(scans.apply(n).relation().location()) for n in range(scans.size())]
    assert len(listings) == 2 and len(set(listings)) == 1


def test_a_batch_of_small_files_is_few_tasks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(40):
        (tmp_path / "in" / f"{k}.txt").write_text(f"file {k}\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")
    try:
        out = str(tmp_path / "out")
        ingest.ingest_stream(spark, str(tmp_path / "in"), out, f"{out}/checkpoint").awaitTermination()
        versions, chunks = ingest.committed(spark, out)
        assert versions.count() == chunks.count() == 40
        assert len(list((tmp_path / "out" / "versions" / "batch=0").glob("*.parquet"))) <= 2 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
