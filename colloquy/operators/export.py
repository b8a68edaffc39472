"""Flat export: one frame a kind of thing, redaction, manifest, files.

Each frame is built from the log by folds and joins on ids; nothing is collected. ``write_frames`` refuses a folder
that holds something and leaves JSON lines with the columns in sorted order; ``archive`` puts frames of any size into one zip.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, functions as F

from colloquy.shipping import ship
from colloquy.sources.store import file_system
from colloquy.state import cut

#: Text that leaves the machine only when asked for, by event type.
TEXT_KEYS = {"encounter_recorded": ("paraphrase",), "session_analysed": ("candidates",), "encounter_dismissed": ("reason",)}


def redact(events: DataFrame, include_text: bool = False) -> DataFrame:
    """Drops text keys of each event type from the payload map and lists them. events: event_type, payload (map)."""
    if include_text:
        return events.withColumn("withheld", F.array().cast("array<string>"))
    drop = F.array().cast("array<string>")
    for kind, keys in TEXT_KEYS.items():
        drop = F.when(F.col("event_type") == kind, F.array(*map(F.lit, keys))).otherwise(drop)
    held = events.withColumn("_drop", drop)
    withheld = F.array_sort(F.array_intersect("_drop", F.map_keys("payload")))
    return held.withColumn("withheld", withheld).withColumn("payload", F.map_filter("payload", lambda k, v: ~F.array_contains("_drop", k))).drop("_drop")


def scrub_source(sources):
    """Keeps kind and place of each source and drops its excerpt."""
    return F.transform(sources, lambda x: F.struct(x["kind"].alias("kind"), x["place"].alias("place")))


def flags(encounters: DataFrame, concepts: DataFrame, judgments: DataFrame) -> DataFrame:
    """Encounters with their concept and judgment, each optional."""
    return encounters.join(concepts, "concept_id", "left").join(judgments, "key", "left")


def detections(runs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row a ranked candidate (a run without any keeps a row), with its verdict. runs: run_id, candidates (array)."""
    rows = runs.select("run_id", F.posexplode_outer("candidates").alias("place", "term"))
    return rows.join(verdicts, ["run_id", "term"], "left")


def sessions(analysed: DataFrame, runs: DataFrame, spend: DataFrame, turns: DataFrame) -> DataFrame:
    """Every session that was analysed or run, with what is known of it."""
    return analysed.join(runs, "session_id", "full").join(spend, "session_id", "left").join(turns, "session_id", "left")


def corrections(judgments: DataFrame, corrected: DataFrame, most: int) -> DataFrame:
    """Newest judgments with the correction that supersedes them, if any."""
    return judgments.join(corrected, judgments["event_id"] == corrected["supersedes"], "left").drop("supersedes").orderBy(F.desc("event_id")).limit(most)


def materials(generated: DataFrame, refused: DataFrame, delivered: DataFrame) -> DataFrame:
    """Generated and refused material in one frame, with whether it was delivered."""
    every = generated.withColumn("refused", F.lit(False)).unionByName(refused.withColumn("refused", F.lit(True)), allowMissingColumns=True)
    got = delivered.select("material_id").distinct().withColumn("_d", F.lit(True))
    return every.join(got, "material_id", "left").withColumn("delivered", F.coalesce("_d", F.lit(False))).drop("_d")


def manifest(frames: dict[str, DataFrame], at: str) -> DataFrame:
    """Per frame: rows, first and last time, rows of fixtures."""
    one = lambda n, f: f.agg(F.count(F.lit(1)).alias("rows"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count_if("is_fixture").alias("fixtures")).withColumn("frame", F.lit(n))
    return reduce(DataFrame.unionByName, [one(n, f) for n, f in sorted(frames.items())])


def write_frames(frames: dict[str, DataFrame], folder: str) -> None:
    for name, frame in frames.items():
        frame.select(*sorted(frame.columns)).write.mode("errorifexists").json(f"{folder}/{name}")


#: Bytes of JSON lines of a member, before they are compressed.
MEMBER_BYTES = 8 << 20
MEMBER = "frame string, part long, rows long, size long, crc long, body binary"


def _members(frame: DataFrame, name: str, member_bytes: int) -> DataFrame:
    """The frame's rows as compressed members, made where the rows are: part counts up in the frame's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lines, held = TaskContext.get().partitionId() << 32, [], 0

        def member() -> pa.RecordBatch:
            data, press = b"".join(lines), zlib.compressobj(6, zlib.DEFLATED, -15)
            body = press.compress(data) + press.flush()
            row = {"frame": [name], "part": [at], "rows": [len(lines)], "size": [len(data)], "crc": [zlib.crc32(data)], "body": pa.array([body], pa.binary())}
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for (line,) in zip(*batch.columns, strict=True):
                lines.append(line.as_py().encode() + b"\n")
                held += len(lines[-1])
                if held >= member_bytes:
                    yield member()
                    at, lines, held = at + 1, [], 0
        if lines:
            yield member()

    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(frame.columns)]), {"ignoreNullFields": "false"})
    return frame.select(row.alias("line")).mapInArrow(run, MEMBER)


def _wide(*values: int) -> bytes:
    """The extra field that holds numbers of 64 bits."""
    return struct.pack(f"<HH{len(values)}Q", 1, 8 * len(values), *values)


def archive(frames: dict[str, DataFrame], path: str, names: dict[str, str] | None = None, member_bytes: int = MEMBER_BYTES) -> DataFrame:
    """Writes frames of any size as one zip of JSON lines on any file system, and returns its index: member, rows, size.

    Members are compressed by tasks, each with its own checksum, and kept as a table in the shared folder. The driver then
    passes them on to the file, one partition of compressed members at a time, and ends it with the directory, of which it
    knows a row a member. A frame of several members has them as numbered parts of a folder; one without rows has an empty
    one. Sizes and places are numbers of 64 bits. A file that is there is refused.
    """
    if not frames:
        raise ValueError("nothing to archive")
    spark = next(iter(frames.values())).sparkSession
    ship(spark)
    fs, target = file_system(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    index, offset = [], 0
    out = fs.create(target, False)

    def put(data: bytes) -> int:
        out.write(bytearray(data))
        return len(data)

    for name, frame in sorted(frames.items()):
        made = cut(_members(frame, name, member_bytes), "members")
        count, shown = made.count(), (names or {}).get(name, name)
        parts = made.orderBy("part").toLocalIterator() if count else [Row(rows=0, size=0, crc=0, body=b"\x03\x00")]
        for k, m in enumerate(parts):
            member = (f"{shown}.jsonl" if count <= 1 else f"{shown}/part-{k:06d}.jsonl").encode()
            common = struct.pack("<HHHHH", 45, 0x800, 8, 0, 0x21) + struct.pack("<III", m["crc"], 0xFFFFFFFF, 0xFFFFFFFF)
            extra = _wide(m["size"], len(m["body"]))
            index.append((member, common, m["size"], len(m["body"]), offset, m["rows"]))
            offset += put(b"PK\x03\x04" + common + struct.pack("<HH", len(member), len(extra)) + member + extra)
            offset += put(m["body"])
    start = offset
    for member, common, size, packed, at, _ in index:
        extra = _wide(size, packed, at)
        offset += put(b"PK\x01\x02" + struct.pack("<H", 45) + common + struct.pack("<HHHHHII", len(member), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + member + extra)
    end = struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, len(index), len(index), offset - start, start)
    put(b"PK\x06\x06" + end + b"PK\x06\x07" + struct.pack("<IQI", 0, offset, 1) + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    out.close()
    return spark.createDataFrame([(member.decode(), rows, size) for member, _, size, _, _, rows in index], "member string, rows long, size long")
