"""Parsing, ingest status, tailing and streaming forms."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from colloquy.sources import tail, transcripts as T
from colloquy.streaming import live

LINES = [
    "", "{bad", "[1,2]", '{"type":"summary","sessionId":"s"}', '{"type":"user","sessionId":"s1","cwd":"/a","timestamp":"2024-01-01T00:00:00Z","message":{"content":"hello\\u2028there"}}',
    '{"type":"user","message":"x"}', '{"type":"user","message":{"content":5}}', '{"type":"user","isMeta":true,"message":{"content":"   "}}',
    json.dumps({"type": "assistant", "isSidechain": True, "message": {"content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "one"}, {"type": "text", "text": "two"}, {"type": "tool_use", "id": "t1", "name": "run", "input": {"b": 1, "a": "x"}}, {"type": "odd"}, 3, {"type": "text"}]}}),
    json.dumps({"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": [{"type": "text", "text": "out"}, "raw"]}, {"type": "text", "text": "mine"}, {"type": "image"}]}}),
]


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/s1.jsonl").write_text("\n".join(LINES) + '\n{"type":"user","message":{"content":"half')
    (tmp_path / "p/s2.jsonl").write_text("no line feed")
    return tmp_path


def test_parse_degrades_and_counts(spark, folder):
    parsed = T.parse(T.lines(T.scan(spark, str(folder)))).cache()
    rows = {r.line_no: r for r in parsed.collect()}
    assert sorted(rows) == list(range(1, 11))
    assert [n for n, r in rows.items() if r.malformed] == [2, 3] and rows[4].unknown_type == "summary"
    assert {n: r.skipped_blocks for n, r in rows.items() if r.skipped_blocks} == {6: 1, 7: 1, 9: 3}
    turns = [(r.line_no, r.seq, r.role, r.text) for r in T.turns(parsed).orderBy("line_no", "seq").collect()]
    assert turns == [
        (5, 0, "user", "hello there"), (9, 0, "assistant", "one\ntwo"), (9, 1, "thinking", "hm"), (9, 2, "tool_use", '{"a":"x","b":1}'),
        (10, 0, "user", "mine"), (10, 1, "tool_result", "out\nraw"), (10, 2, "image", None),
    ]
    drift = T.drift(parsed).first()
    assert (drift.lines, drift.malformed, drift.skipped_blocks, drift.unknown_types) == (10, 2, 5, {"summary": 1})
    assert {(r.key, r.value) for r in T.first_meta(parsed).collect()} == {("sessionId", "s"), ("cwd", "/a")}
    assert T.resolve_pointer(T.lines(T.scan(spark, str(folder))), "s1", 2, 4).count() == 3


def test_ingest_status(spark):
    old = b'{"a":1}\n'
    digest = hashlib.sha256(old).hexdigest()
    files = spark.createDataFrame([("new", '{"a":1}\n'), ("same", '{"a":1}\n{"half'), ("more", '{"a":1}\n{"b":2}\n'), ("changed", '{"a":2}\n{"b":2}\n'), ("short", "{}\n"), ("none", "half"), ("gone", "half")], "session_id string, content string")
    prior = spark.createDataFrame([(s, 8, 1, digest) for s in ("same", "more", "changed", "short", "gone")], "session_id string, bytes long, lines long, sha256 string")
    got = {r.session_id: (r.status, r.from_line) for r in T.ingest_status(files, prior).collect()}
    assert got == {"new": ("new", 1), "same": ("unchanged", None), "more": ("appended", 2), "changed": ("rewritten", 1), "short": ("rewritten", 1), "none": ("empty", None), "gone": ("unchanged", None)}


def test_merge_counts(spark):
    row = spark.range(1).select(T.merge_counts(F.create_map(F.lit("a"), F.lit(1).cast("long")), F.create_map(F.lit("a"), F.lit(2).cast("long"), F.lit("b"), F.lit(3).cast("long"))).alias("m")).first()
    assert row.m == {"a": 3, "b": 3}


def test_tail_reads_what_is_new_and_starts_over_after_a_rewrite(tmp_path):
    (tmp_path / "deep").mkdir()
    p, state = tmp_path / "deep" / "s.jsonl", str(tmp_path / "state")
    reader = tail.TailReader(tmp_path.as_uri(), state)

    def step(start, reader=reader):
        reader.read_bytes = 0
        end = reader.latestOffset()
        read = reader.read_bytes
        rows = [(g, n, raw) for part in reader.partitions(start, end) for _, g, n, raw in reader.read(part)]
        reader.commit(end)
        return end, rows, read

    def write(text, mode="w"):
        before = p.stat().st_mtime_ns if p.exists() else 0
        with open(p, mode) as f:
            f.write(text)
        os.utime(p, ns=(before + 10**9, before + 10**9))

    write("one\ntw")
    at, got, read = step(reader.initialOffset())
    assert got == [(0, 1, "one")] and read == 6
    write("o\nthree\n", "a")
    at, got, read = step(at)
    assert got == [(0, 2, "two"), (0, 3, "three")] and read == 4 + len("two\nthree\n")  # four bytes that were there are compared
    at, got, read = step(at)
    assert got == [] and read == 0
    lines = "".join(f"{k} {'x' * 99}\n" for k in range(40_000))
    write(lines, "a")
    at, got, read = step(at)
    assert len(got) == 40_000 and got[-1][:2] == (0, 40_003) and read == len(lines) + len("one\ntwo\nthree\n")
    write("more\n", "a")
    at, got, read = step(at)
    assert got == [(0, 40_004, "more")] and read == 5 + tail.WINDOW  # of four megabytes
    os.utime(p, ns=(10**18, 10**18))  # another time, the same bytes
    at, got, _ = step(at)
    assert got == []
    write("changed\nall\n")
    at, got, _ = step(at)
    assert got == [(1, 1, "changed"), (1, 2, "all")]
    write("CHANGED\nall\n")  # as many bytes
    at, got, _ = step(at)
    assert got == [(2, 1, "CHANGED"), (2, 2, "all")]
    write("other\nbytes\nand more of them\n")
    at, got, _ = step(at)
    assert [g for g, *_ in got] == [3, 3, 3]
    # a restarted reader goes on from the state
    again = tail.TailReader(str(tmp_path), state)
    write("last\n", "a")
    end, got, read = step(at, again)
    assert got == [(3, 4, "last")] and read == 5 + len("other\nbytes\nand more of them\n")


def test_digests_are_carried_on():
    data = bytes(range(256)) * 40
    for k in (0, 1, 999, 10_239):
        assert tail.extend(tail.extend(0, data[:k]), data[k:]) == tail.extend(0, data)
    assert tail.extend(0, data) != tail.extend(0, data[1:] + data[:1])


def test_tail_as_a_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "s.jsonl").write_text("a\nb\npart")
    spark.dataSource.register(tail.TranscriptTail)
    from colloquy.shipping import ship

    ship(spark)

    def run():
        q = spark.readStream.format("transcript_tail").load(str(src)).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert q.exception() is None
        return sorted((r.line_no, r.raw) for r in spark.read.parquet(str(out)).collect())

    assert run() == [(1, "a"), (2, "b")]
    (src / "s.jsonl").write_text("a\nb\nparted\nc\n")
    assert run() == [(1, "a"), (2, "b"), (3, "parted"), (4, "c")]


def at(minutes):
    return dt.datetime(2024, 1, 1, 12) + dt.timedelta(minutes=minutes)


def test_quiet_projects_in_batch(spark):
    files = spark.createDataFrame([("a", "x", at(0)), ("a", "y", at(9)), ("b", "z", at(1))], "project string, path string, changed_at timestamp")
    assert {r.path for r in live.quiet(files, "2024-01-01 12:11:00").collect()} == {"z"}
    assert {r.path for r in live.quiet(files, "2024-01-01 12:19:00").collect()} == {"x", "y", "z"}


def stream(spark, tmp_path, frames, build, name):
    folder = tmp_path / name
    schema = frames[0].schema
    for k, f in enumerate(frames):
        f.coalesce(1).write.parquet(f"{folder}/in/{k}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    q = build(source).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/cp").outputMode("append").start()
    try:
        q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def test_streaming_occasions_and_replays(spark, tmp_path):
    rows = [(1, at(0)), (1, at(30)), (1, at(200)), (2, at(10)), (9, at(2000))]
    frames = [spark.createDataFrame([r], "key long, at timestamp") for r in rows]
    got = stream(spark, tmp_path, frames, lambda s: live.stream_occasions(s, "key", "at"), "occ")
    assert {(r.key, r.n) for r in got} == {(1, 2), (1, 1), (2, 1)}
    got = stream(spark, tmp_path, [frames[0], frames[0], frames[3]], lambda s: live.once(s, ["key"], "at"), "once_rows")
    assert sorted(r.key for r in got) == [1, 2]


def test_streaming_daily_notices(spark, tmp_path):
    rows = [("u", "k1", at(0), "t"), ("u", "k1", at(1500), "t"), ("u", "k2", at(1501), "t"), ("u", "k3", at(1502), "t")]
    frames = [spark.createDataFrame(rows, "user string, key string, at timestamp, text string")]
    got = stream(spark, tmp_path, frames, lambda s: live.daily_once(s, 9), "notices")
    assert [(r.user, r.key) for r in got] == [("u", "k1"), ("u", "k2")]


def test_streaming_quiet_projects_lose_no_change(spark, tmp_path):
    """b changed a second before a's newest change and arrives a batch later; c changes again while it waits, d after it came out."""
    now = dt.datetime.now().replace(microsecond=0)
    old = lambda seconds: now - dt.timedelta(hours=1, seconds=seconds)
    schema = "project string, path string, changed_at timestamp"
    batches = [[("a", "x", old(9)), ("a", "y", old(0)), ("d", "v", old(4))], [("b", "z", old(1))], [("c", "w", now)], [("c", "u", now)], [("d", "v", old(2))]]
    for k in range(2):
        spark.createDataFrame(batches[k], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    from colloquy.shipping import ship

    ship(spark)
    source = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = live.stream_quiet(source, 10).writeStream.format("memory").queryName("quiet_rows").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()

    def wait(done):
        until = time.monotonic() + 120
        while time.monotonic() < until and q.exception() is None:
            got = [(r.project, tuple(r.paths)) for r in spark.table("quiet_rows").collect()]
            if done(got):
                return got
            time.sleep(0.5)
        raise AssertionError((q.exception(), got))

    try:
        wait(lambda got: len(got) >= 3)
        for k in range(2, 5):
            spark.createDataFrame(batches[k], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        got = wait(lambda got: got.count(("d", ("v",))) == 2)
        assert sorted(got) == [("a", ("x", "y")), ("b", ("z",)), ("d", ("v",)), ("d", ("v",))]  # c waits for its ten minutes
    finally:
        q.stop()
        spark.conf.unset(provider)


def test_sweep_tells_files_of_one_name_apart(spark, tmp_path):
    for folder, body in (("a", "one\n"), ("b b+c", "two\nthree\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "s1.jsonl").write_text(body)
    prior = spark.createDataFrame([("s1", 4, 1, hashlib.sha256(b"one\n").hexdigest())], "session_id string, bytes long, lines long, sha256 string")
    got = sorted((r.path.split("/")[-2], r.session_id, r.status, r.bytes) for r in T.sweep(spark, str(tmp_path), prior).collect())
    assert got == [("a", "s1", "unchanged", 4), ("b b+c", "s1", "rewritten", 10)]


def test_derived_queue(spark):
    got = []
    turns = spark.createDataFrame([(1, 1, "user", "hi", False, False), (2, 1, "user", "hi", False, False)], "session_id long, line_no long, role string, text string, is_meta boolean, is_sidechain boolean")
    covered = spark.createDataFrame([(1, 1)], "session_id long, seen long")
    live.derive_queue(lambda: covered, lambda: turns, lambda df: got.extend(df.collect()))(turns, 7)
    assert [(r.session_id, r.reason, r.epoch) for r in got] == [(2, "never", 7)]


def test_a_sweep_goes_past_a_file_that_cannot_be_read(spark, tmp_path):
    for name, body in (("new", "{}\n{}\n"), ("grown", "a\nb\nc\n"), ("again", "x\n"), ("empty", "no line end"), ("bad", "{}\n")):
        (tmp_path / f"{name}.jsonl").write_text(body)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    prior = spark.createDataFrame([("grown", 2, 1, sha("a\n")), ("again", 9, 3, sha("y"))], "session_id string, bytes long, lines long, sha256 string")
    (tmp_path / "bad.jsonl").write_bytes(b"{}\n")
    (tmp_path / ".bad.jsonl.crc").write_bytes(b"crc\x00\x00\x00\x02\x00\x00\x00\x00\x00")  # a checksum that the file does not meet
    found = {r.session_id: r for r in T.sweep(spark, str(tmp_path), prior).collect()}
    assert {k: r.status for k, r in found.items()} == {"new": "new", "grown": "appended", "again": "rewritten", "empty": "empty", "bad": "error"}
    assert T.sweep(spark, str(tmp_path), prior, limit=2).count() == 2
    files = spark.createDataFrame([("grown", "a\nb\nc\n"), ("again", "x\n"), ("new", "{}\n{}\n")], "session_id string, content string")
    new = T.ingested(files, T.sweep(spark, str(tmp_path), prior).where("session_id <> 'bad'"))
    held = spark.createDataFrame([("grown", 1, "a"), ("again", 1, "y"), ("again", 2, "z"), ("other", 1, "o")], "session_id string, line_no long, raw string")
    assert sorted(map(tuple, T.after(held, new).collect())) == [("again", 1, "x"), ("grown", 1, "a"), ("grown", 2, "b"), ("grown", 3, "c"), ("new", 1, "{}"), ("new", 2, "{}"), ("other", 1, "o")]
