"""Streams against their batch twins."""

import base64
import json

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lorekeep import store
from lorekeep.operators.governance import failure_rate
from lorekeep.session import scratch_path
from lorekeep.sources.envelope import decode_events
from lorekeep.streaming import events as ev
from lorekeep.streaming import ingest as ig

STAMP = F.lit("2024-02-01 00:00:00").cast("timestamp")


def envelope(source="slack", doc="1", content="hello world", **metadata):
    body = {"source": source, "content": content, "metadata": {"id": doc, **metadata}}
    return base64.b64encode(json.dumps(body).encode()).decode()


def publish(spark, topic, *data):
    spark.createDataFrame([(d,) for d in data], "data string").coalesce(1).write.mode("append").parquet(topic)


def test_decode_reasons(spark):
    bad_utf8 = base64.b64encode(b"\xff\xfe{").decode()
    rows = [
        envelope(author="ann", timestamp="2024-01-01", page=3),
        "%%%",
        bad_utf8,
        base64.b64encode(b"{oops").decode(),
        envelope(doc=None),
        envelope(source=None),
        None,
    ]
    df = spark.createDataFrame([(r,) for r in rows], "data string").coalesce(1)
    got = decode_events(df).collect()
    assert [r.reason for r in got] == [None, "bad base64", "bad utf-8", "bad json", "missing id", "missing source", "bad base64"]
    assert (got[0].source_id, got[0].author, got[0].metadata["page"]) == ("1", "ann", "3")


def test_ingest_replaces_documents_and_repeats_are_harmless(spark):
    topic, path = scratch_path(spark, "t-topic"), scratch_path(spark, "t-ingest")
    run = lambda: ig.start_ingest(
        spark.readStream.schema("data string").parquet(topic), path, f"{path}/cp", STAMP, size=4, overlap=1
    ).awaitTermination()
    long = " ".join(f"w{i}" for i in range(12))
    publish(spark, topic, envelope(content=long), envelope("mail", "7", "other"), "%%%", envelope("drive", "2", "x y"))
    run()
    ids = lambda: sorted(r.id for r in ig.current_index(spark, path).collect())
    assert ids() == ["drive-2-0", "mail-7-0", "slack-1-0", "slack-1-1", "slack-1-2", "slack-1-3"]
    publish(spark, topic, envelope(content="short", author="ann"), envelope("drive", "2", " "))
    run()
    rows = {r.id: r for r in ig.current_index(spark, path).collect()}
    assert sorted(rows) == ["mail-7-0", "slack-1-0"]
    assert rows["slack-1-0"].content == "short" and rows["slack-1-0"].author == "ann"
    assert {r.namespace for r in rows.values()} == {"slack/", "default"}
    # the same micro-batch delivered once more overwrites itself
    batch = spark.createDataFrame([(envelope(content="short", author="ann"),), (envelope("drive", "2", " "),)], "data string")
    run_id = ig.dead_letters(spark, path).first()["run"]
    ig.write_batch(batch, 1, path, STAMP, run_id, size=4, overlap=1)
    assert ids() == ["mail-7-0", "slack-1-0"]
    assert ig.dead_letters(spark, path).count() == 1
    target = ig.export_index(spark, path, scratch_path(spark, "t-export"))
    assert spark.read.parquet(target).count() == 2


def test_streams_and_restarts_do_not_overwrite_each_other(spark):
    path = scratch_path(spark, "t-ingest")

    def run(topic, checkpoint):
        stream = spark.readStream.schema("data string").parquet(topic)
        ig.start_ingest(stream, path, f"{path}/{checkpoint}", STAMP).awaitTermination()

    slack, notion, dead = (scratch_path(spark, "t-topic") for _ in range(3))
    publish(spark, dead, "%%%", "@@@")
    run(dead, "cp-dead")
    assert ig.current_index(spark, path).count() == 0 and ig.dead_letters(spark, path).count() == 2
    publish(spark, slack, envelope(content="one"))
    publish(spark, notion, envelope("notion", "2", "two"), "%%%")
    run(slack, "cp-slack")
    run(notion, "cp-notion")
    ids = lambda: sorted(r.id for r in ig.current_index(spark, path).collect())
    assert ids() == ["notion-2-0", "slack-1-0"] and ig.dead_letters(spark, path).count() == 3
    run(slack, "cp-slack-new")  # a new checkpoint reads the topic again
    assert ids() == ["notion-2-0", "slack-1-0"]


def batch_of(spark, *data):
    return spark.createDataFrame([(d,) for d in data], "data string")


def test_compaction_rewrites_touched_buckets_only(spark):
    path = scratch_path(spark, "t-store")
    day = lambda n: f"2024-01-{n:02}"
    ig.write_batch(batch_of(spark, *[envelope(doc=str(i), content=f"text {i}", timestamp=day(2)) for i in range(200)]), 0, path, STAMP, "r")
    assert ig.compact(spark, path) == 0
    table = ig.store(spark, path)
    files = lambda: {f.rsplit("/", 1)[0].rsplit("/", 2)[-1] + f[-40:] for f in ig.current_index(spark, path).inputFiles()}
    before = files()
    assert table.state()[1] == [] and len(before) > 30
    # one document, once newer and once from the past, and one that comes back empty
    ig.write_batch(batch_of(spark, envelope(doc="7", content="new", timestamp=day(3)), envelope(doc="8", content="old", timestamp=day(1))), 1, path, STAMP, "r")
    ig.write_batch(batch_of(spark, envelope(doc="9", content=" ", timestamp=day(3))), 2, path, STAMP, "r")
    texts = lambda: {r.doc_id: r.content for r in ig.current_index(spark, path).collect()}
    want = {f"slack-{i}": f"text {i}" for i in range(200)} | {"slack-7": "new"}
    del want["slack-9"]
    assert texts() == want
    assert ig.compact(spark, path) == 3 and texts() == want
    after = files()
    assert len(before - after) <= 3 and len(after - before) <= 3
    assert table.vacuum() and texts() == want
    # versions in the base still count: an older event stays beaten
    ig.write_batch(batch_of(spark, envelope(doc="7", content="late", timestamp=day(2)), envelope(doc="9", content="late", timestamp=day(2))), 3, path, STAMP, "r")
    assert texts() == want
    assert ig.compact(spark, path) == 5 and texts() == want


def test_a_crash_before_the_commit_loses_nothing(spark, monkeypatch):
    path = scratch_path(spark, "t-store")
    one = batch_of(spark, envelope(content="one"), "%%%")
    from lorekeep.store import Log

    def crash(*_):
        raise RuntimeError("lost")

    ids = lambda: [(r.doc_id, r.content) for r in ig.current_index(spark, path).collect()]
    for attempt in range(2):
        with monkeypatch.context() as broken:
            broken.setattr(Log, "commit", crash)
            try:
                ig.write_batch(one, 0, path, STAMP, "r")
            except RuntimeError:
                pass
        assert ids() == [] and ig.dead_letters(spark, path).count() == 0
    ig.write_batch(one, 0, path, STAMP, "r")
    assert ids() == [("slack-1", "one")]
    with monkeypatch.context() as broken:
        broken.setattr(Log, "commit", crash)
        try:
            ig.compact(spark, path)
        except RuntimeError:
            pass
    assert ids() == [("slack-1", "one")] and ig.store(spark, path).state()[0]["covers"] == -1
    ig.compact(spark, path)
    ig.write_batch(one, 0, path, STAMP, "r")  # repeated after the base covers it
    assert ids() == [("slack-1", "one")] and ig.dead_letters(spark, path).count() == 1


def test_budget_stops_embedding_and_skipped_events_are_taken_up(spark):
    path = scratch_path(spark, "t-budget")
    events = [envelope(doc=str(i), content="w " * 1000, timestamp=f"2024-01-01T00:00:{i:02}") for i in range(10)]
    cost = 1000 * 0.02 / 1e6 * 1.05  # windows overlap
    ids = lambda: sorted(int(d) for d in {r.doc_id[6:] for r in ig.current_index(spark, path).collect()})
    ig.write_batch(batch_of(spark, *events[:6]), 0, path, STAMP, "r", budget=4.5 * cost * 1.1)
    taken = ids()
    assert taken == list(range(len(taken))) and 3 <= len(taken) <= 5
    ig.write_batch(batch_of(spark, *events[6:]), 1, path, STAMP, "r", budget=4.5 * cost * 1.1)
    assert ids() == taken and ig.skipped_events(spark, path).count() == 10 - len(taken)
    assert ig.take_up(spark, path, STAMP, budget=4.5 * cost * 1.1) == 10 - len(taken) and ids() == taken
    march = F.lit("2024-03-01 00:00:00").cast("timestamp")
    assert ig.take_up(spark, path, march, budget=1.0) == 10 - len(taken) and ids() == list(range(10))
    assert ig.take_up(spark, path, march) == 0
    assert abs(ig.spent_in(spark, path, "2024-02") - len(taken) * ig.spent_in(spark, path, "2024-03") / (10 - len(taken))) < 1e-12


def test_model_hook_failures_and_replay(spark):
    from lorekeep.operators.embedding import embed_model

    path = scratch_path(spark, "t-model")

    def load():
        def model(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("refused")
            return [[float(len(t)), 1.0] for t in texts]

        return model

    embed = lambda df, col: embed_model(df, load, col, batch=1)
    ig.write_batch(batch_of(spark, envelope(doc="1", content="mail a@b.example.org"), envelope(doc="2", content="bad"), "%%%"), 0, path, STAMP, "r", embed=embed, model="mine")
    row = ig.current_index(spark, path, "mine").collect()
    assert [(r.doc_id, r.model, r.dimension, r["values"][1]) for r in row] == [("slack-1", "mine", 2, 1.0)]
    assert ig.current_index(spark, path, "other").count() == 0
    assert sorted(r.reason for r in ig.dead_letters(spark, path).collect()) == ["bad base64", "embedding failed"]
    assert {r.doc_id: r.redactions for r in ig.store(spark, path).documents().collect()} == {"slack-1": 1, "slack-2": 0}
    fixed = envelope(doc="3", content="mended")
    assert ig.replay_dead(spark, path, lambda dead: dead.select(F.lit(fixed).alias("data")), STAMP) == 1
    assert sorted(r.doc_id for r in ig.current_index(spark, path).collect()) == ["slack-1", "slack-3"]
    for _ in range(3):
        ig.replay_dead(spark, path, lambda dead: dead.select(F.col("raw").alias("data")), STAMP)
    assert ig.replay_dead(spark, path, lambda dead: dead.select(F.col("raw").alias("data")), STAMP) == 0


def test_newest_event_by_time_not_by_text(spark):
    rows = [("a", "999999999.5", "old"), ("a", "1700000000.5", "new"), ("b", "2024-01-01T00:30:00+02:00", "old"), ("b", "2023-12-31T23:00:00Z", "new")]
    events = spark.createDataFrame([("s", i, t, c) for i, t, c in rows], "source string, source_id string, timestamp string, content string")
    assert {r.content for r in ig.newest_events(events).collect()} == {"new"}


def test_long_chunks_are_stored_whole(spark):
    text = " ".join(["word"] * 400)
    good, _ = ig.split_dead(decode_events(spark.createDataFrame([(envelope(content=text),)], "data string")))
    row = ig.index_rows(good).first()
    assert row.content == text and row.preview == text[:1000]


def test_stream_equals_batch(spark):
    topic, path = scratch_path(spark, "t-topic"), scratch_path(spark, "t-ingest")
    publish(spark, topic, *[envelope(doc=str(i), content=f"mail a{i}@b.example.org text {i}") for i in range(20)])
    ig.start_ingest(spark.readStream.schema("data string").parquet(topic), path, f"{path}/cp", STAMP).awaitTermination()
    good, _ = ig.split_dead(decode_events(spark.read.parquet(topic)))
    want = sorted((r.id, r.content, tuple(r["values"])) for r in ig.index_rows(good).collect())
    got = sorted((r.id, r.content, tuple(r["values"])) for r in ig.current_index(spark, path).collect())
    assert got == want and all("@" not in row[1] for row in got)


def test_redaction_comes_before_chunking(spark):
    text = "a b c Bearer abcdef z"
    good, _ = ig.split_dead(decode_events(spark.createDataFrame([(envelope(content=text),)], "data string")))
    contents = [r.content for r in ig.index_rows(good, size=4, overlap=0).orderBy("chunk_index").collect()]
    assert contents == ["a b c [BEARER_TOKEN_REDACTED]", "z"]


def test_dead_letter_depth_and_retries(spark):
    dead = spark.createDataFrame([("bad json",)] * 3 + [("missing id",)], "reason string")
    depth = {r.reason: (r.events, r.alert) for r in ig.dead_letter_depth(dead, 3).collect()}
    assert depth == {"bad json": (3, False), "missing id": (1, False), None: (4, True)}
    tried = ig.retry_state(spark.createDataFrame([(None,), (2,)], "retries int")).orderBy("retries").collect()
    assert [(r.retries, r.given_up) for r in tried] == [(1, False), (3, True)]


def event_files(spark, rows):
    folder = scratch_path(spark, "t-events")
    df = spark.createDataFrame(rows, "minute int, failed boolean").select(
        (STAMP + F.make_dt_interval(F.lit(0), F.lit(0), F.col("minute"))).alias("ts"), "failed", "minute"
    )
    df.write.parquet(folder)
    return folder, df


def test_failure_windows_equal_batch_on_closed_windows(spark):
    folder, df = event_files(spark, [(i, i % 9 == 0) for i in range(0, 400)])
    stream = ev.file_stream(spark, folder, "*.parquet", df.schema)
    for slide in (None, "15 minutes"):
        path = scratch_path(spark, "t-windows")
        got = ev.run_to_end(ev.failure_stream(stream, slide=slide), f"{path}/out", f"{path}/cp")
        last = STAMP + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(389))
        want = failure_rate(df, slide=slide).where(F.col("window_end") <= last)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 4


def test_stream_dedup(spark):
    folder, df = event_files(spark, [(i % 50, True) for i in range(200)])
    path = scratch_path(spark, "t-dedup")
    unique = ev.dedup_stream(ev.file_stream(spark, folder, "*.parquet", df.schema), ["minute"])
    assert ev.run_to_end(unique, f"{path}/out", f"{path}/cp").count() == 50


def test_stream_dedup_does_not_depend_on_batches(spark):
    rows = [(i % 180, i % 7 == 0) for i in range(900)]
    counts = []
    for files in (1, 6):
        folder = scratch_path(spark, "t-events")
        df = spark.createDataFrame(sorted(rows), "minute int, failed boolean").coalesce(1)
        df = df.select((STAMP + F.make_dt_interval(F.lit(0), F.lit(0), F.col("minute"))).alias("ts"), "failed")
        for k in range(files):
            df.where(F.floor(F.minute("ts") * files / 60) == k).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        path = scratch_path(spark, "t-dedup")
        out = ev.run_to_end(ev.dedup_stream(stream, ["failed"], delay="4 hours"), f"{path}/out", f"{path}/cp")
        counts.append(sorted(map(tuple, out.collect())))
    assert counts[0] == counts[1] and len(counts[0]) == 6


def test_ledger_survives_a_restart(spark):
    folder, df = event_files(spark, [(i % 50, True) for i in range(200)])
    path = scratch_path(spark, "t-ledger")
    costed = ev.file_stream(spark, folder, "*.parquet", df.schema).select(
        F.date_format("ts", "yyyy-MM").alias("month"), F.lit("m").alias("model"), F.lit(2).alias("tokens"), F.lit(0.5).alias("cost_usd")
    )
    for _ in range(2):  # a restart adds nothing
        ev.start_ledger(costed, f"{path}/ledger", f"{path}/ledger-cp").awaitTermination()
    assert [tuple(r) for r in ev.ledger(spark, f"{path}/ledger").collect()] == [("2024-02", "m", 400, 100.0)]


def test_first_of_repeats_does_not_depend_on_batches(spark):
    minutes = [(i, i * 7 % 400, i % 5) for i in range(300)]  # (id, minute, content)
    df = spark.createDataFrame(minutes, "id int, minute int, said int").select(
        "id", (STAMP + F.make_dt_interval(F.lit(0), F.lit(0), F.col("minute"), F.lit(0.000123))).alias("ts"), F.concat(F.lit("é "), "said").alias("said"), F.array("said").alias("list")
    )
    late = [m for _, m, _ in minutes]
    want, last = [], {}
    for number, minute, said in sorted(minutes, key=lambda r: (r[1], str(r[0]))):
        if minute < max(late) - 120:
            if said not in last or minute - last[said] > 12:
                want.append(number)
            last[said] = minute
    for files in (1, 6):
        folder, path = scratch_path(spark, "t-events"), scratch_path(spark, "t-first")
        for k in range(files):
            df.where(F.floor((F.unix_timestamp("ts") - F.unix_timestamp(STAMP)) * files / 60 / 401) == k).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        counted = ev.LateRows()
        first = ev.first_of_repeats(stream, ["said"], "id", within=12 * 60, delay="2 hours")
        out = ev.run_to_end(first, f"{path}/out", f"{path}/cp", counted)
        rows = {r.id: (r.ts, r.said, r.list) for r in out.collect()}
        assert sorted(rows) == sorted(want) and rows == {r.id: (r.ts, r.said, r.list) for r in df.collect() if r.id in rows}
        assert counted.table(spark).agg(F.sum("dropped")).first()[0] == 0


def test_many_contents_share_a_state(spark):
    """Each content of its own cost a call of Python; 300 contents in four buckets are as many state rows at most."""
    rows = [(number, number % 300, minute) for number, minute in enumerate([0] * 300 + [40] * 300 + [130] * 300 + [400] * 300)]
    df = spark.createDataFrame(rows, "id int, said int, minute int").select(
        "id", "said", F.when(F.col("said") != 7, STAMP + F.make_dt_interval(F.lit(0), F.lit(0), F.col("minute"))).alias("ts")
    )
    folder, path = scratch_path(spark, "t-events"), scratch_path(spark, "t-first")
    df.write.parquet(folder)
    states = []

    class Watch(ev.LateRows):
        def onQueryProgress(self, event) -> None:
            states.extend(o.numRowsTotal for o in event.progress.stateOperators)
            super().onQueryProgress(event)

    first = ev.first_of_repeats(spark.readStream.schema(df.schema).parquet(folder), ["said"], "id", delay="1 hour", buckets=4)
    out = ev.run_to_end(first, f"{path}/out", f"{path}/cp", Watch())
    assert sorted(r.id for r in out.collect()) == sorted(i for i, said, minute in rows if minute in (0, 130) and said != 7)
    assert 0 < max(states) <= 4


def test_a_batch_is_redacted_once(spark, monkeypatch):
    path, calls, real = scratch_path(spark, "t-once"), [], ig.redact
    monkeypatch.setattr(ig, "redact", lambda *a, **b: calls.append(1) or real(*a, **b))
    events = [envelope(doc="1", content="ssn 000-12-3456"), envelope(doc="2", content="a b"), envelope(doc="3", content=None), "%%%"]
    batch = spark.createDataFrame([(e,) for e in events], "data string")
    ig.write_batch(batch, 0, path, STAMP, "r", budget=2 * 0.02 / 1e6)
    assert len(calls) == 1
    table = ig.store(spark, path)
    done = {r.doc_id: r.redactions for r in table.documents().collect()}
    left = {r.source_id: r.content for r in ig.skipped_events(spark, path).collect()}
    assert len(done) + len(left) == 3 and left.get("1", "ssn 000-12-3456") == "ssn 000-12-3456" and done.get("1", 1) == 1
    assert table.every("ledger").agg(F.sum("tokens")).first()[0] == ig.current_index(spark, path).agg(F.sum("token_count")).first()[0]
    assert not table.log.folders(table.place("clean", "r", 0))
    assert {r.content for r in ig.current_index(spark, path).collect()} <= {"ssn [SSN_REDACTED]", "a b"}


def test_a_filter_on_the_reason_parses_once(spark):
    good = decode_events(spark.createDataFrame([(envelope(),)], "data string")).where("reason IS NULL")
    assert good._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1 and good.count() == 1


def test_a_batch_is_not_held_in_memory_and_its_row_groups_are_small(spark, monkeypatch):
    path, plans, sizes = scratch_path(spark, "t-ingest"), [], []
    whole, parts = ig.write_events, ig.clean_chunks

    def met(session, place, good, dead, *rest, **options):
        plans.extend(frame._jdf.queryExecution().withCachedData().toString() for frame in (good, dead))
        assert sorted(r.reason for r in dead.collect()) == ["bad base64", "missing id"]
        whole(session, place, good, dead, *rest, **options)

    def seen(clean, *rest):
        files = [name.removeprefix("file://") for name in clean.inputFiles()]
        sizes.extend(footer.row_group(i).num_rows for footer in map(pq.read_metadata, files) for i in range(footer.num_row_groups))
        return parts(clean, *rest)

    monkeypatch.setattr(ig, "write_events", met)
    monkeypatch.setattr(ig, "clean_chunks", seen)
    monkeypatch.setattr(store, "ROW_GROUP", 1 << 18)
    events = [envelope(doc=str(i), content=" ".join(f"w{i * 400 + j}" for j in range(400)), timestamp="2024-01-02") for i in range(1200)]
    batch = batch_of(spark, *events, "%%%", envelope(doc=None)).coalesce(1)
    ig.write_batch(batch, 0, path, STAMP, "r")
    assert "InMemoryRelation" not in "".join(plans) and len(plans) == 2
    assert sum(sizes) == 1200 and max(sizes) < 1200
    assert ig.current_index(spark, path).count() == 1200
    assert ig.store(spark, path).log.folders(f"{path}/decoded/run=r") == []


def test_chunks_are_compacted_without_a_join_that_shuffles_them(spark):
    """Only versions that do not stand are looked for, by their keys, and a bucket is written by several tasks."""
    path = scratch_path(spark, "t-ingest")
    for batch, day in ((0, "2024-01-02"), (1, "2024-01-01"), (2, "2024-01-03")):
        events = [envelope(doc=str(i), content=f"day {day} {i}", timestamp=day) for i in range(40 if batch < 2 else 5)]
        ig.write_batch(batch_of(spark, *events), batch, path, STAMP, "r")
    want = sorted([f"day 2024-01-03 {i}" for i in range(5)] + [f"day 2024-01-02 {i}" for i in range(5, 40)])
    table = ig.store(spark, path)
    rows = table.current()
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and sorted(r.content for r in rows.collect()) == want
    table.buckets = 1
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesced, "false")
    table.compact()
    spark.conf.unset(coalesced)
    base, _ = table.state()
    assert len(table.base("chunks", base).inputFiles()) > 1 and sorted(r.content for r in table.current().collect()) == want
