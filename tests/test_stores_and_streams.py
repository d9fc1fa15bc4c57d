"""Byte sink, event-stream source, keyed store and chat service: restarts, replays, failures, odd inputs."""

import json
import os
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from marginalia.sources import golden, manifest, stores
from marginalia.sources.files import FileSink, safe_path
from marginalia.sources.sse_stream import SseSource
from marginalia.streaming import chat


@pytest.fixture(scope="module")
def spark(spark):
    spark.dataSource.register(FileSink)
    spark.dataSource.register(SseSource)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def tree(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, files in os.walk(folder) for f in files)


# --- byte sink --------------------------------------------------------------------------


@pytest.mark.parametrize("file", [None, "", "/etc/x", "../x", "a/../../x", "a//b", "a/./b", "a\\b", "a/", "c:/x", "a\0b", "_staging-1/x"])
def test_paths_that_leave_the_root(file):
    with pytest.raises(ValueError):
        safe_path(file)


def test_byte_sink_round_trip(spark, tmp_path):
    """Every page as a file, read again by the manifest's byte scan; writing again replaces."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.select(F.concat(F.lit("site/"), F.col("page_id") % 7, F.lit("/page "), "page_id", F.lit(".html")).alias("file"), F.col("html").cast("binary").alias("content"))
    root = f"{tmp_path}/root"
    for part in (rows.repartition(5), rows.limit(20)):
        part.write.format("marginalia_files").mode("append").save(root)
    known = rows.select("file", F.sha2("content", 256).alias("sha256"))
    back = manifest.read_bytes(spark, root, known)
    assert back.where(F.sha2("content", 256) == F.col("sha256")).count() == rows.count() == len(tree(root))


@pytest.mark.parametrize("bad", [("../out", b"x"), ("ok2", None), ("ok", b"again")])
def test_aborted_write_leaves_nothing(spark, tmp_path, bad):
    """One bad row, in whatever task: no new file, and no staging folder, but what was there before stays."""
    root = f"{tmp_path}/root"
    spark.createDataFrame([("old", b"1")], "file string, content binary").write.format("marginalia_files").mode("append").save(root)
    rows = spark.createDataFrame([("ok", b"1"), ("a/b", b"2"), ("old", b"3"), bad], "file string, content binary").repartition(4, "content")
    with pytest.raises(Exception, match=r"no path below|no content|two rows"):
        rows.write.format("marginalia_files").mode("append").save(root)
    assert tree(root) == ["old"] and open(f"{root}/old", "rb").read() == b"1" and not os.path.exists(f"{tmp_path}/out")
    assert [d for d in os.listdir(root) if d.startswith("_staging")] == []


# --- event streams ----------------------------------------------------------------------

TEXT = 'event: token\ndata: {"a":\ndata: 1}\n\n: note\n\ndata: not json\n\n\n\nevent:result\r\ndata:{"é": "ü"}\r\n\r\ndata: [3]\n\nevent: late\ndata: "last"'

WHOLE = (TEXT + "\n\n") * 2


def sse_lines(spark, files):
    rows = [(name, i, line) for name, text in files.items() for i, line in enumerate(text.replace("\r\n", "\n").split("\n"))]
    return spark.createDataFrame(rows, "stream string, pos int, line string")


def run_stream(spark, folder, check, out, **options):
    frames = spark.readStream.format("marginalia_sse").options(**options).load(folder)
    query = frames.writeStream.format("parquet").option("checkpointLocation", check).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()


@pytest.mark.parametrize("range_bytes", [7, 1 << 20])
def test_sse_stream_over_restarts(spark, tmp_path, range_bytes):
    """Two files grow by odd numbers of bytes, with a restart after each step, in the middle of frames and of letters."""
    folder, check, out = (f"{tmp_path}/{x}" for x in ("in", "check", "out"))
    os.makedirs(folder)
    data = WHOLE.encode()
    for at in range(0, len(data), 41):
        for name, step in (("a.sse", 41), ("b.sse", 41)):
            with open(f"{folder}/{name}", "ab") as file:
                file.write(data[at : at + step] if name == "a.sse" else data[at : at + 41])
        if at % 3 == 0 or at + 41 >= len(data):
            run_stream(spark, folder, check, out, rangeBytes=range_bytes)
    found = spark.read.parquet(out)
    whole = golden.parse_sse(sse_lines(spark, {"a.sse": WHOLE, "b.sse": WHOLE}))
    key = lambda df: sorted((r.stream, r.event, r.data) for r in df.select("stream", "event", "data").collect())
    assert key(found) == key(whole) and found.select("stream", "at").distinct().count() == found.count()


def test_sse_last_frame(spark, tmp_path):
    """An unended last frame waits, or counts where the files are said to have ended."""
    folder = f"{tmp_path}/in"
    os.makedirs(folder)
    with open(f"{folder}/x", "w", newline="") as file:
        file.write(TEXT)
    for ended, events in (("false", 3), ("true", 4)):
        run_stream(spark, folder, f"{tmp_path}/check{ended}", f"{tmp_path}/out{ended}", ended=ended)
        assert spark.read.parquet(f"{tmp_path}/out{ended}").count() == events


# --- keyed store ------------------------------------------------------------------------


def test_keyed_store_touches_only_its_buckets(spark, tmp_path):
    store = stores.KeyedStore(spark, f"{tmp_path}/s", "id long, v string, `a b` int", "id", 16)
    assert store.read().count() == 0 and store.load([1]).count() == 0 and store.upsert(store.read()) == []
    first = spark.range(200).select("id", F.lit("old").alias("v"), F.lit(1).alias("a b"))
    assert store.upsert(first) == list(range(16))
    before = {f: os.stat(f"{tmp_path}/s/{f}").st_mtime_ns for f in tree(f"{tmp_path}/s") if f.endswith(".parquet")}
    changes = spark.createDataFrame([(3, "a", 1, 1), (3, "b", 1, 2), (None, "x", 1, 1), (900, "new", None, 5)], "id long, v string, `a b` int, at int")
    touched = store.upsert(changes, order="at")
    after = {f: os.stat(f"{tmp_path}/s/{f}").st_mtime_ns for f in tree(f"{tmp_path}/s") if f.endswith(".parquet")}
    same = [f for f in before if after.get(f) == before[f]]
    assert 1 <= len(touched) <= 2 and len(same) == len(before) - len(touched)
    assert {(r.id, r.v) for r in store.load([3, 900, 5, 77777]).collect()} == {(3, "b"), (900, "new"), (5, "old")}
    assert store.read().count() == 201 and {r.v for r in store.read().where("id = 3").collect()} == {"b"}
    plan = store.load([3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters")[1][:80]


# --- chat -------------------------------------------------------------------------------


def requests_of(rows):
    return [json.dumps(r) if not isinstance(r, str) else r for r in rows]


def test_requests_are_strict(spark):
    good = {"question": "why?", "itemId": "i1"}
    bodies = {
        "good": good, "all": good | {"traceId": "0123456789abcdef" * 2, "ownerId": "o", "sessionId": "s"}, "empty": {"question": "", "itemId": "i"}, "number": good | {"itemId": 7},
        "extra": good | {"model": "x"}, "trace": good | {"traceId": "ABC"}, "session": good | {"sessionId": ""}, "owner": good | {"ownerId": None}, "list": [1], "text": "oops", "missing": {"question": "q"},
    }
    rows = spark.createDataFrame([(k, v if k == "text" else json.dumps(v)) for k, v in bodies.items()], "name string, raw string")
    found = {r["name"]: r.r for r in rows.select("name", chat.parse_requests(F.col("raw")).alias("r")).collect()}
    assert {k for k, r in found.items() if r.problem is None} == {"good", "all"}
    assert found["all"].session_id == "s" and found["all"].owner_id == "o" and found["extra"].problem == "unknown field"


def scripted(request):
    if "fail" in request.question:
        raise RuntimeError("model down")
    if "refuse" in request.question:
        return chat.Answer("refuse", "no")
    return chat.Answer("flag-void-clause" if "void" in request.question else "answer", f"turn {request.turns} of <{request.summary[-20:]}> {request.profile}", ({"text": "c"},))


def folding(summary, question, answer):
    if "nofold" in question:
        raise RuntimeError("summariser down")
    return chat.fold_turn(summary, question, answer)


SCHEMA = "session_id string, seq long, item_id string, question string, owner_id string, keys array<string>, contexts array<string>, problem string, asked_at timestamp"


def chat_rows(n):
    out = []
    for i in range(n):
        question = ["hello", "please refuse", "is it void", "now fail", "nofold please", "why"][i % 6]
        out.append(([None, "s1", "s2"][i % 3], i, f"i{i}", f"{question} {i}", f"o{i % 2}", [f"k{i}"], ["some context"], "bad body" if i % 11 == 10 else None, f"2024-01-01 00:00:{i:02d}"))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA.replace("timestamp", "string")).withColumn("asked_at", F.to_timestamp("asked_at"))


def answered(spark, requests):
    return chat.with_profiles(requests, spark.createDataFrame([("o1", "owner of a flat")], "owner_id string, profile string"))


def rows_of(events):
    return sorted(map(repr, events.select("session_id", "seq", "n", "type", "token", "body").collect()))


def test_chat_stream_equals_batch_over_restarts(spark, tmp_path):
    """Three restarts, the second of which brings old requests again; state is read by key afterwards."""
    rows = chat_rows(36)
    source, check, out = (f"{tmp_path}/{x}" for x in ("in", "check", "out"))
    batches = [rows[:10], rows[10:20], rows[14:20] + rows[20:30], rows[30:]]
    failed = lambda events, number: (_ for _ in ()).throw(OSError("store down")) if number == 1 else None
    for batch in batches:
        frame(spark, [r for r in batch if r[0] is not None or r not in rows[14:20] or batch is batches[1]]).write.mode("append").parquet(source)
        events = chat.chat_events(answered(spark, spark.readStream.schema(SCHEMA).parquet(source)), answer=scripted, fold=folding)
        query = events.writeStream.outputMode("update").option("checkpointLocation", check).foreachBatch(chat.event_sink(out, failed)).trigger(availableNow=True).start()
        query.awaitTermination()
    found = spark.read.parquet(f"{out}/events")
    expected = chat.chat_events_batch(answered(spark, frame(spark, rows)), answer=scripted, fold=folding)
    assert rows_of(found) == rows_of(expected)
    assert [(r.batch, r.kind, r.message) for r in spark.read.parquet(f"{out}/failed").collect()] == [(1, "OSError", "store down")]

    bodies = [(r.session_id, r.seq, json.loads(r.body)) for r in expected.where("type = 'result'").collect()]
    assert all(b["remembered"] == (s != "" and b["behaviorClass"] in chat.REMEMBERED and "memoryError" not in b) for s, _, b in bodies)
    assert any("memoryError" in b for _, _, b in bodies) and any(b["behaviorClass"] == "refuse" and not b["remembered"] for _, _, b in bodies)
    errors = {r.seq for r in expected.where("type = 'error'").collect()}
    assert errors == {r[1] for r in rows if r[7] or "fail" in r[3]}
    states = {r.session_id: r for r in stores.load_states(spark, check, "memory", ["s1", "s2", "none"], "session_id").collect()}
    turns = {s: sum(b["remembered"] for t, _, b in bodies if t == s) for s in ("s1", "s2")}
    assert {s: r.turns for s, r in states.items()} == turns and all(len(r.summary) <= 2000 for r in states.values())
    ends = chat.service_response(expected)
    assert ends.count() == len(rows) and ends.where("failed").count() == len(errors)


def test_idle_sessions_close(spark, tmp_path):
    """A session that asks nothing for ten seconds of event time is closed; its next request starts anew."""
    source, check, out = (f"{tmp_path}/{x}" for x in ("in", "check", "out"))
    at = lambda session, seq, second: (session, seq, f"i{seq}", "hello", None, [], ["context"], None, f"2024-01-01 00:00:{second:02d}")
    for batch in ([at("a", 1, 1), at("b", 1, 2)], [at("b", 2, 30)], [at("b", 3, 31)], [at("a", 4, 50), at("b", 4, 51)]):
        frame(spark, batch).coalesce(1).write.mode("append").parquet(source)
        requests = spark.readStream.schema(SCHEMA).parquet(source).withWatermark("asked_at", "1 second")
        query = chat.chat_events(requests, idle=timedelta(seconds=10)).writeStream.outputMode("append").option("checkpointLocation", check).foreachBatch(chat.event_sink(out)).trigger(availableNow=True).start()
        query.awaitTermination()
    events = spark.read.parquet(f"{out}/events")
    closed = {(r.session_id, r.seq) for r in events.where("type = 'closed'").collect()}
    prior = {(r.session_id, r.seq): json.loads(r.body)["priorTurns"] for r in events.where("type = 'result'").collect()}
    assert ("a", 1) in closed and prior == {("a", 1): 0, ("b", 1): 0, ("b", 2): 1, ("b", 3): 2, ("a", 4): 0, ("b", 4): 3}


def test_ttl_and_idle_exclude_one_another(spark):
    with pytest.raises(ValueError):
        chat.chat_events(frame(spark, chat_rows(1)), ttl=timedelta(days=1), idle=timedelta(days=1))
