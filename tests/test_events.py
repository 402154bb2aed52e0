from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F
from pyspark.sql import types

from sourcelight.operators import conversations as V
from sourcelight.operators import tasks as T
from sourcelight.operators import webpolicy as W
from sourcelight.session import scratch_dir
from sourcelight.sources.keyed import Conflict, KeyedTable
from sourcelight.streaming import watch

NOW = dt.datetime(2024, 7, 1)


def test_incoming_events_win(spark):
    schema = "sequence bigint, task_id string, state string"
    current = spark.createDataFrame([(3, "a", "live")], schema)
    incoming = spark.createDataFrame([(2, "a", "old"), (3, "a", "newer")], schema)
    assert [(r.sequence, r.state) for r in T.merge_events(current, incoming).collect()] == [(2, "old"), (3, "newer")]
    many = spark.range(700).select(F.col("id").alias("sequence"), F.lit("a").alias("task_id"), F.lit("s").alias("state"))
    rows = T.merge_events(many, current.limit(0)).collect()
    assert len(rows) == 500 and rows[0].sequence == 200


def test_visible_tasks(spark):
    rows = [(f"d{i}", i, "completed") for i in range(30)] + [(f"r{i}", 100 + i, "running") for i in range(25)] + [("r0", 1, "failed")]
    got = T.visible_tasks(spark.createDataFrame(rows, "task_id string, sequence bigint, state string")).collect()
    assert len(got) == 45 and {r.task_id for r in got if r.state == "completed"} == {f"d{i}" for i in range(10, 30)}


def test_status(spark):
    cases = {
        1: [(1, "failed", "x"), (2, "running", "Web SEARCH")], 2: [(5, "failed", "x"), (2, "queued", "build it")], 3: [(1, "running", "x"), (2, "cancelling", "x")],
        4: [(1, "waiting_for_user", "search")], 5: [(3, "failed_interrupted", "x"), (1, "completed", "x")], 6: [(3, "completed", "x")], 7: [(1, "cancelled", "x")], 8: [(1, "running", "x")],
    }
    rows = [(g, f"{g}-{n}", *e) for g, events in cases.items() for n, e in enumerate(events)]
    df = spark.createDataFrame(rows, "g int, task_id string, sequence bigint, state string, phase_name string")
    got = {r.g: r.status for r in T.status_rollup(df, ["g"]).collect()}
    assert got == {1: "researching", 2: "creating", 3: "cancelling", 4: "waiting", 5: "error", 6: "completed", 7: "idle", 8: "thinking"}


def test_interrupted_and_segments(spark):
    rows = [("b", 1, "running"), ("a", 2, "cancelling"), ("c", 3, "completed"), ("b", 4, "running")]
    df = spark.createDataFrame([(*r, NOW, "p") for r in rows], "task_id string, sequence bigint, state string, timestamp timestamp, phase_name string")
    got = T.interrupted_tasks(df, F.lit(NOW)).orderBy("sequence").collect()
    assert [(r.task_id, r.sequence, r.state) for r in got] == [("a", 5, "failed_interrupted"), ("b", 6, "failed_interrupted")]
    log = T.task_event_log(df, segment=1).orderBy("task_id", "segment").collect()
    assert [(r.task_id, r.segment, [e.sequence for e in r.events]) for r in log] == [("a", 0, [2]), ("b", 0, [1]), ("b", 1, [4]), ("c", 0, [3])]
    tasks = spark.createDataFrame([("a", "cancelling"), ("b", "failed"), ("z", "queued")], "task_id string, state string")
    assert sorted(r.task_id for r in T.log_consistency(tasks, df).collect()) == ["b", "z"]


def test_messages(spark):
    conversations = spark.createDataFrame([(1, "t", NOW), (2, "t", NOW)], "conversation_id bigint, title string, updated_at timestamp")
    messages = spark.createDataFrame([(1, 4, "user", "x")], "conversation_id bigint, ordinal bigint, role string, content string")
    rows = [(1, 2, "user", "b", []), (1, 1, "assistant", "a", []), (2, 1, "user", "c", []), (1, 3, "system", "d", []), (1, 4, "user", " ", []), (9, 5, "user", "e", []), (1, 6, "user", "f", ["u"] * 65)]
    drafts = spark.createDataFrame(rows, "conversation_id bigint, place bigint, role string, content string, citations array<string>")
    added, changed, rejected = V.append_messages(conversations, messages, drafts, ["place"], F.lit(NOW))
    assert {(r.conversation_id, r.content, r.ordinal) for r in added.collect()} == {(1, "a", 5), (1, "b", 6), (2, "c", 0)}
    assert changed.count() == 2
    assert {r.place: r.reason for r in rejected.collect()} == {3: "invalid_role", 4: "invalid_content", 5: "not_found", 6: "too_many_citations"}
    objects = spark.createDataFrame([("h", 1), ("k", 5)], "sha256 string, reference_count bigint")
    stored = spark.createDataFrame([(1, "h"), (1, "h"), (1, "k"), (2, "k")], "conversation_id bigint, content_sha256 string")
    left, kept, counts = V.delete_conversations(conversations, stored, objects, spark.createDataFrame([(1,)], "conversation_id bigint"))
    assert left.count() == 1 and kept.count() == 1 and {r.sha256: r.reference_count for r in counts.collect()} == {"h": 0, "k": 4}
    assert spark.range(1).select(V.conversation_title(F.lit(" a \n b" + "c" * 100)).alias("t")).first().t == "a b" + "c" * 69


def fold_stable(rows):
    out, state = [], {}
    for key, fingerprint, at, number in sorted(rows, key=lambda r: (r[2], r[3])):
        if fingerprint is None:
            state.pop(key, None)
            continue
        s = state.get(key)
        if s is None or s[0] != fingerprint:
            s = state[key] = [fingerprint, at, 0, False]
        s[2] += 1
        if not s[3] and s[2] >= 2 and at - s[1] >= 750_000:
            s[3] = True
            out.append((key, fingerprint, s[1], at))
    return sorted(out)


def test_debounce_and_cooldown_match_the_fold(spark):
    rng = random.Random(8)
    rows = [(0 if i % 3 else i % 5, rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 40) * 200_000, i) for i in range(400)]
    df = spark.createDataFrame(rows, "path_key bigint, fingerprint string, observed_us bigint, observation_id bigint")
    assert sorted(tuple(r) for r in watch.stable_changes(df).collect()) == fold_stable(rows)
    tries = [(0 if i % 3 else i % 5, i, rng.randint(0, 3000) * 1_000_000, rng.random() < 0.5) for i in range(400)]
    got = {r.observation_id for r in watch.retry_cooldown(spark.createDataFrame(tries, "path_key bigint, observation_id bigint, observed_us bigint, ok boolean")).collect()}
    until, want = {}, set()
    for key, number, at, ok in sorted(tries, key=lambda r: (r[2], r[1])):
        if at >= until.get(key, at):
            want.add(number)
            until.pop(key, None)
            if not ok:
                until[key] = at + 30_000_000
    assert got == want


def test_url_rules(spark):
    cases = {
        "https://example.org/a?b": None, "https://example.org.": None, "http://8.8.8.8/": None, "http://[2001:4860::1]/": None, "HTTPS://EXAMPLE.org": None,
        "https://a b": "invalid_url", "nonsense": "invalid_url", "https://": "invalid_url", "ftp://example.org": "unsupported_scheme", "file:///etc": "unsupported_scheme",
        "https://u@example.org": "unsafe_url_metadata", "https://u:p@example.org": "unsafe_url_metadata", "https://example.org/#x": "unsafe_url_metadata",
        "http://localhost": "blocked_domain", "http://printer.local/": "blocked_domain", "http://x.home.arpa": "blocked_domain", "https://bad.test": "blocked_domain",
        "https://deep.bad.test": "blocked_domain", "https://notbad.test": None, "http://127.0.0.1": "non_public_address", "http://10.0.0.1": "non_public_address",
        "http://172.16.5.4": "non_public_address", "http://172.32.0.1": None, "http://192.168.1.1": "non_public_address", "http://169.254.1.1": "non_public_address",
        "http://100.64.0.1": "non_public_address", "http://100.128.0.1": None, "http://0x7f.1": "non_public_address", "http://2130706433": "non_public_address",
        "http://198.18.0.1": "non_public_address", "http://224.0.0.1": "non_public_address", "http://256.1.1.1": "invalid_url", "http://[::1]": "non_public_address",
        "http://[fc00::1]": "non_public_address", "http://[fe80::1]/": "non_public_address", "http://[ff02::1]": "non_public_address", "http://[::]": "non_public_address",
    }
    blocked = spark.createDataFrame([(" BAD.test. ",), ("",), ("with/slash",)], "domain string")
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    got = {r.url: r for r in W.url_policy(df, "url", blocked).collect()}
    for url, reason in cases.items():
        assert got[url].reason == reason, url
    assert got["HTTPS://EXAMPLE.org"].normal_url == "https://example.org/"


def test_query_lists(spark):
    rows = [(1, 0, " a "), (1, 1, "A"), (1, 2, "b"), (2, 0, "x"), (2, 1, " "), (4, 0, "y" * 513)] + [(3, i, f"q{i}") for i in range(6)] + [(5, i, "same") for i in range(9)]
    good, bad = W.normalize_queries(spark.createDataFrame(rows, "request_id bigint, position bigint, query string"))
    assert [(r.request_id, r.place, r.query) for r in good.orderBy("request_id", "place").collect()] == [(1, 1, "a"), (1, 2, "b"), (5, 1, "same")]
    assert {r.request_id: r.reason for r in bad.collect()} == {2: "invalid_query", 3: "too_many_queries", 4: "invalid_query"}


def test_results_are_bounded_per_request(spark):
    rows = [(1, q, r, f"https://h{r % 70}.example.org/", "t" * 9000, "s", None) for q in range(2) for r in range(70)] + [(2, 0, 0, "http://10.0.0.1/", "t", "s", None)]
    df = spark.createDataFrame(rows, "request_id bigint, query_place bigint, result_place bigint, url string, title string, snippet string, engine string")
    got = W.dedup_results(df).orderBy("place").collect()
    assert len(got) == 50 and {r.request_id for r in got} == {1} and got[0].normal_url == "https://h0.example.org/" and len(got[0].title) == 8192


def test_budgets(spark):
    base = dict(schema_version=1, max_documents=40, max_download_bytes=1, max_duration_seconds=1200, max_pages_per_origin=10, max_concurrent_requests=4, min_origin_interval_ms=1, crawl_depth=2)
    cases = [({}, None), ({"schema_version": 2}, "unsupported_schema"), ({"max_documents": 0}, "invalid_budget:max_documents"), ({"crawl_depth": 3}, "excessive_budget:crawl_depth"),
             ({"max_documents": 41}, "excessive_budget:max_documents"), ({"max_concurrent_requests": 5, "min_origin_interval_ms": 0}, "invalid_budget:min_origin_interval_ms")]
    df = spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], ", ".join(f"{k} bigint" for k in base))
    assert [r.reason for r in W.budget_check(df).collect()] == [r for _, r in cases]


def _cooled(tries):
    until, want = {}, set()
    for key, number, at, ok in sorted(tries, key=lambda r: (r[2], r[1])):
        if at >= until.get(key, at):
            want.add(number)
            until.pop(key, None)
            if not ok:
                until[key] = at + 30_000_000
    return want


def _in_batches(spark, rows, schema, at, parts):
    """Rows as a stream, in batches by time."""
    folder, rows = scratch_dir(spark), sorted(rows, key=lambda r: r[at])
    for n in range(parts):
        spark.createDataFrame(rows[n * len(rows) // parts:(n + 1) * len(rows) // parts], schema).coalesce(1).write.parquet(f"{folder}/p={n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_streams_over_batches_match_the_fold(spark):
    rng = random.Random(18)
    rows = [(0 if i % 3 else i % 5, rng.choice(["a"] * 6 + ["b", None]), i * 70_000, i) for i in range(500)]
    stream = _in_batches(spark, rows, "path_key bigint, fingerprint string, observed_us bigint, observation_id bigint", 2, 5)
    assert sorted(tuple(r) for r in watch.followed(watch.follow_stable_changes, stream).collect()) == fold_stable(rows)
    tries = [(0 if i % 3 else i % 5, i, i * 1_500_000 + rng.randrange(1_400_000), rng.random() < 0.6) for i in range(500)]
    stream = _in_batches(spark, tries, "path_key bigint, observation_id bigint, observed_us bigint, ok boolean", 2, 4)
    assert {r.observation_id for r in watch.followed(watch.follow_retry_cooldown, stream).collect()} == _cooled(tries)


def test_a_busy_key_is_spread(spark):
    rng = random.Random(28)
    tries = [(7, i, rng.randrange(4_000) * 500_000, rng.random() < 0.9) for i in range(3000)]
    df = spark.createDataFrame(tries, "path_key bigint, observation_id bigint, observed_us bigint, ok boolean")
    assert {r.observation_id for r in watch.retry_cooldown(df, fanout=6).collect()} == _cooled(tries)
    assert watch.retry_cooldown(df.limit(0)).count() == 0
    slices = watch.with_slice(df, "observed_us", 6).groupBy("__os_slice").count().collect()
    assert len(slices) > 30 and max(r["count"] for r in slices) < 200


def test_a_batch_that_is_tried_again(spark):
    """A failure after the rows were written, before the state was: the second try gives the same."""
    rows = [(1, "a", n * 400_000, n) for n in range(6)]
    schema = "path_key bigint, fingerprint string, observed_us bigint, observation_id bigint"
    folder, tries = scratch_dir(spark), []

    class Failing(KeyedTable):
        def upsert(self, *args, **more):
            tries.append(1)
            if len(tries) == 2:
                raise RuntimeError("lost")
            return super().upsert(*args, **more)

    stream = lambda: _again(spark, rows, schema, folder)
    kept, watch.KeyedTable = watch.KeyedTable, Failing
    try:
        query = watch.follow_stable_changes(stream(), f"{folder}/out", f"{folder}/check")
        try:
            query.awaitTermination()
        except Exception as error:
            assert "lost" in str(error)
        watch.follow_stable_changes(stream(), f"{folder}/out", f"{folder}/check").awaitTermination()
    finally:
        watch.KeyedTable = kept
    assert len(tries) == 4
    assert [tuple(r)[:4] for r in spark.read.parquet(f"{folder}/out/rows").collect()] == [(1, "a", 0, 800_000)]


def _again(spark, rows, schema, folder):
    try:
        for n in range(3):
            spark.createDataFrame(rows[2 * n:2 * n + 2], schema).coalesce(1).write.parquet(f"{folder}/in/p={n}")
    except Exception as error:
        assert "PATH_ALREADY_EXISTS" in str(error)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def test_keyed_table(spark):
    table = KeyedTable(spark, scratch_dir(spark), ["k"], types.StructType.fromDDL("k string, v bigint"), buckets=8)
    df = lambda *rows: spark.createDataFrame(list(rows), "k string, v bigint")
    held = lambda: {r.k: r.v for r in table.read().collect()}
    assert held() == {} and table.version() == 0 and table.tag() is None
    assert table.upsert(df(*[(str(i), i) for i in range(50)])) == 1
    before = table._newest()[2]
    assert table.upsert(df(("7", 70), ("new", 1), (None, 5)), spark.createDataFrame([("8",), ("none",)], "k string"), expected=1, tag=9) == 2
    want = {str(i): i for i in range(50) if i != 8} | {"7": 70, "new": 1, None: 5}
    assert held() == want
    after = table._newest()[2]
    assert 0 < sum(after[b] != before.get(b) for b in after) <= 5  # only the buckets of those keys
    assert table.upsert(df(("x", 1)), tag=9) == 2 and held() == want
    for act in (lambda: table.upsert(df(("x", 1)), expected=1), lambda: table._publish(2, None, after)):
        try:
            act()
            raise AssertionError("no conflict")
        except Conflict:
            pass
    table.upsert(df().limit(0), table.read().select("k"))
    assert held() == {} and table.version() == 3
    table.upsert(df((None, 6)))
    assert held() == {None: 6}


def test_a_slice_of_many_keys_is_one_group():
    # All keys of a slice are folded in one call, so that calls grow with slices and not with keys times slices.
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    tries = [(int(k), n, int(t), bool(ok)) for n, (k, t, ok) in enumerate(zip(rng.integers(0, 40, 1500), rng.integers(0, 400_000_000, 1500), rng.random(1500) < 0.6, strict=True))]
    frame = pd.DataFrame(tries, columns=["path_key", "observation_id", "observed_us", "ok"])
    frame["slice"] = frame["observed_us"] // 100_000_000
    summaries = pd.concat([watch._summary(part) for _, part in frame.groupby("slice")])
    chained = watch._chain(summaries)
    made = pd.concat([watch._made(part) for _, part in frame.merge(chained, on=["path_key", "slice"]).groupby("slice")])
    assert len(summaries) == len(frame[["path_key", "slice"]].drop_duplicates())
    assert set(made["observation_id"]) == _cooled(tries)


def test_a_batch_of_changes_is_put_in_order_once(spark):
    batch = spark.createDataFrame([("a", "x", 0, 1), ("a", "x", 800_000, 2), ("b", "y", 5, 3)], "path_key string, fingerprint string, observed_us bigint, observation_id bigint")
    carried = spark.createDataFrame([], "path_key string, fingerprint string, first_seen_us bigint, emitted boolean")
    ready, left = watch.stable_batch(batch, carried)
    for table in (ready, left):  # the order is written, neither table looks for it again
        assert "Window" not in table._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in ready.collect()] == [("a", "x", 0, 800_000)]
    assert sorted(tuple(r) for r in left.collect()) == [("a", "x", 0, True), ("b", "y", 5, False)]


def test_parts_of_several_files_stay_in_the_order_of_time(spark):
    from sourcelight.plans.streams import in_time

    rows = spark.range(4000).selectExpr("id % 7 AS path_key", "if(id % 5 = 0, 'x', 'y') AS fingerprint", "id * 300000 AS observed_us", "id AS observation_id")
    got = watch.followed(watch.follow_stable_changes, in_time(rows, file_rows=300))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, watch.stable_changes(rows).select(got.columns).collect()))
