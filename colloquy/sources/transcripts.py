"""Append-only JSONL transcripts: discovery, complete lines, parsing that degrades, ingest status.

A file is one row with exact line numbers (lines end at ``\\n`` alone; a half-written last line waits). JSON is parsed
once into a variant; whatever does not fit is counted, never raised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Line types that carry turns, block types that are turns of their own, keys of session metadata.
CONTENT_TYPES = ("user", "assistant")
BLOCK_TURNS = ("tool_result", "tool_use", "thinking", "image")
META_KEYS = ("sessionId", "cwd", "gitBranch", "version", "entrypoint")
TURN = "seq int, role string, text string, tool_name string, tool_use_id string, is_error boolean"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, modified_at, content of every transcript below a folder, newest first when collected in order."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.jsonl")
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified_at"), F.col("value").alias("content"))


def complete_prefix(content: Column) -> Column:
    """Everything through the last line feed."""
    return F.regexp_extract(content, r"(?s)^(.*\n)", 1)


def lines(files: DataFrame, session: Column | None = None) -> DataFrame:
    """session_id, line_no (from 1), raw for every complete line."""
    session = session if session is not None else F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    whole = files.select(session.alias("session_id"), complete_prefix(F.col("content")).alias("c")).where("c <> ''")
    return whole.select("session_id", F.posexplode(F.split(F.regexp_replace("c", r"\n$", ""), "\n", -1)).alias("n", "raw")).select("session_id", (F.col("n") + 1).cast("long").alias("line_no"), "raw")


def _text(v: Column, path: str) -> Column:
    """A string at a path; null if something else is there."""
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def _kind(v: Column, path: str) -> Column:
    return F.regexp_extract(F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("")), r"^(\w+)", 1)


def _truth(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "boolean"), F.lit(False))


def flatten(v: Column) -> Column:
    """A payload as text: a string as it is, a list's texts joined by lines, anything else as JSON."""
    kind = _kind(v, "$")
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(_text(x, "$.text"), _text(x, "$")))
    texts = F.filter(items, lambda x: x.isNotNull())
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when((kind == "ARRAY") & (F.size(texts) > 0), F.array_join(texts, "\n")).when((kind != "") & (kind != "VOID"), F.to_json(v))


def parse(rows: DataFrame) -> DataFrame:
    """Each line with malformed, unknown_type, skipped_blocks, meta (map) and turns (array of TURN)."""
    blank = F.trim(F.regexp_replace("raw", r"\s+", " ")) == ""
    v = F.col("_v")
    parsed = rows.withColumn("_v", F.when(~blank, F.try_parse_json("raw")))
    is_object = _kind(v, "$") == "OBJECT"
    known = parsed.withColumns({
        "malformed": ~blank & ~F.coalesce(is_object, F.lit(False)), "_type": F.when(is_object, F.coalesce(F.try_variant_get(v, "$.type", "string"), F.lit("None"))),
        "_content": F.when(is_object & (_kind(v, "$.message") == "OBJECT"), F.try_variant_get(v, "$.message.content", "variant")),
        "_message": is_object & (_kind(v, "$.message") == "OBJECT"),
        "meta": F.when(is_object, F.map_filter(F.map_from_arrays(F.array(*map(F.lit, META_KEYS)), F.array(*[_text(v, f"$.{k}") for k in META_KEYS])), lambda k, x: x.isNotNull())),
        "is_meta": _truth(v, "$.isMeta"), "is_sidechain": _truth(v, "$.isSidechain"), "timestamp": _text(v, "$.timestamp"),
    })
    carries = F.col("_type").isin(*CONTENT_TYPES)
    c = F.col("_content")
    kind = F.coalesce(_kind(c, "$"), F.lit(""))
    blocks = F.when(carries & (kind == "ARRAY"), F.try_variant_get(c, "$", "array<variant>")).otherwise(F.array().cast("array<variant>"))
    typed = F.transform(blocks, lambda b: F.struct(F.when(_kind(b, "$") == "OBJECT", F.coalesce(F.try_variant_get(b, "$.type", "string"), F.lit(""))).alias("type"), b.alias("b")))
    told = F.transform(F.filter(typed, lambda x: x["type"] == "text"), lambda x: _text(x["b"], "$.text"))
    joined = F.when(kind == "STRING", F.try_variant_get(c, "$", "string")).otherwise(F.array_join(F.filter(told, lambda t: t.isNotNull()), "\n"))
    own = F.when(carries & (F.trim(F.regexp_replace(joined, r"\s+", " ")) != ""), F.array(F.struct(
        F.lit(0).alias("seq"), F.col("_type").alias("role"), joined.alias("text"), F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("tool_use_id"), F.lit(None).cast("boolean").alias("is_error"),
    ))).otherwise(F.array().cast(f"array<struct<{','.join(x.replace(' ', ':') for x in TURN.split(', '))}>>"))

    def other(x: Column, i: Column) -> Column:
        b, t = x["b"], x["type"]
        text = F.when(t == "tool_result", flatten(F.try_variant_get(b, "$.content", "variant"))).when(t == "tool_use", flatten(F.try_variant_get(b, "$.input", "variant"))).when(t == "thinking", F.coalesce(_text(b, "$.thinking"), _text(b, "$.text")))
        use = F.when(t == "tool_result", _text(b, "$.tool_use_id")).when(t == "tool_use", _text(b, "$.id"))
        return F.struct((i + 1).alias("seq"), t.alias("role"), text.alias("text"), F.when(t == "tool_use", _text(b, "$.name")).alias("tool_name"), use.alias("tool_use_id"), F.when(t == "tool_result", _truth(b, "$.is_error")).alias("is_error"))

    rest = F.transform(F.filter(typed, lambda x: x["type"].isin(*BLOCK_TURNS)), other)
    odd = F.size(F.filter(typed, lambda x: x["type"].isNull() | ~x["type"].isin("text", *BLOCK_TURNS))) + F.size(F.filter(told, lambda t: t.isNull()))
    whole = F.when(carries & ~F.col("_message"), 1).when(carries & ~kind.isin("STRING", "ARRAY"), 1).otherwise(0)
    return known.select(
        "session_id", "line_no", "malformed", F.when(~F.col("malformed") & ~carries, F.col("_type")).alias("unknown_type"), (odd + whole).alias("skipped_blocks"), "meta", "is_meta", "is_sidechain", "timestamp", F.concat(own, rest).alias("turns"),
    )


def turns(parsed: DataFrame) -> DataFrame:
    """One row a turn: session_id, line_no, seq, role, text, flags, tool columns and the time as an instant."""
    when = F.try_to_timestamp(F.regexp_replace("timestamp", "Z$", "+00:00"))
    return parsed.select("session_id", "line_no", "is_meta", "is_sidechain", when.alias("occurred_at"), F.inline("turns"))


def drift(parsed: DataFrame) -> DataFrame:
    """Per session: lines, malformed ones, skipped blocks, and how many lines of each unknown type."""
    by = parsed.groupBy("session_id", "unknown_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("malformed").alias("bad"), F.sum("skipped_blocks").alias("skipped"))
    types = F.map_from_entries(F.filter(F.array_sort(F.collect_list(F.when(F.col("unknown_type").isNotNull(), F.struct("unknown_type", "n")))), lambda x: x.isNotNull()))
    return by.groupBy("session_id").agg(F.sum("n").alias("lines"), F.sum("bad").alias("malformed"), F.sum("skipped").alias("skipped_blocks"), types.alias("unknown_types"))


def merge_counts(a: Column, b: Column) -> Column:
    """Two maps of counts as one."""
    return F.map_zip_with(F.coalesce(a, F.create_map().cast("map<string,bigint>")), F.coalesce(b, F.create_map().cast("map<string,bigint>")), lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def first_meta(parsed: DataFrame) -> DataFrame:
    """The first value of each metadata key of a session."""
    rows = parsed.select("session_id", "line_no", F.explode("meta").alias("key", "value"))
    return rows.groupBy("session_id", "key").agg(F.min_by("value", "line_no").alias("value"))


def ingest_status(files: DataFrame, prior: DataFrame) -> DataFrame:
    """empty, new, rewritten, unchanged or appended for each file, and the line to go on from.

    files: session_id, content; prior: session_id, bytes, lines, sha256 (of that many leading bytes).
    """
    whole = files.select("session_id", F.encode(complete_prefix(F.col("content")), "utf-8").alias("b"))
    size = F.octet_length("b")
    j = whole.join(prior, "session_id", "left")
    status = (
        F.when((size == 0) & F.col("bytes").isNull(), "empty").when(size == 0, "unchanged").when(F.col("bytes").isNull(), "new").when(F.col("bytes") > size, "rewritten")
        .when(F.sha2(F.substring(F.col("b"), F.lit(1), F.least("bytes", F.lit((1 << 31) - 1)).cast("int")), 256) != F.col("sha256"), "rewritten").when(F.col("bytes") == size, "unchanged").otherwise("appended")
    )
    staged = j.withColumn("status", status)
    start = F.when(F.col("status") == "appended", F.col("lines") + 1).when(F.col("status").isin("new", "rewritten"), F.lit(1))
    return staged.select("session_id", "status", start.cast("long").alias("from_line"), size.cast("long").alias("bytes"), F.sha2("b", 256).alias("sha256"))


def resolve_pointer(rows: DataFrame, session: str, first: int, last: int) -> DataFrame:
    """The raw lines of one range of one session; on a table partitioned by session only that one is read."""
    return rows.where((F.col("session_id") == session) & F.col("line_no").between(first, last))


def sweep(spark: SparkSession, folder: str, prior: DataFrame, limit: int | None = None) -> DataFrame:
    """ingest_status of every transcript below a folder, with its path, newest first up to limit; a file that cannot be read has status error.

    Names come from the listing and contents from a read that passes over unreadable files, so one of them stops nothing.
    Both are joined by path: files of one name in several folders are each their own, and all of one session's prior.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(folder).select("path", "modificationTime")
    if limit is not None:
        listed = listed.orderBy(F.desc("modificationTime"), "path").limit(limit)
    whole = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.jsonl")
    bare = lambda path: F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/*", "/")  # noqa: E731  both forms of a path
    read = whole.select(bare(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("content"))
    asked = listed.select(bare(F.col("path")).alias("path"))
    session = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    by_path = asked.select(F.col("path").alias("file"), session.alias("session_id")).join(prior, "session_id").drop("session_id").withColumnRenamed("file", "session_id")
    found = ingest_status(asked.join(read, "path").select(F.col("path").alias("session_id"), "content"), by_path).withColumnRenamed("session_id", "path")
    every = found.unionByName(asked.join(found.select("path"), "path", "left_anti").withColumn("status", F.lit("error")), allowMissingColumns=True)
    return every.select(session.alias("session_id"), "path", *[c for c in found.columns if c != "path"])


def ingested(files: DataFrame, status: DataFrame) -> DataFrame:
    """The lines to add: of appended files those from from_line on, of new and rewritten ones all. files: session_id, content."""
    asked = status.where("from_line is not null").select("session_id", "status", "from_line")
    rows = lines(files, F.col("session_id")).join(asked, "session_id").where("line_no >= from_line")
    return rows.select("session_id", "status", "line_no", "raw")


def after(held: DataFrame, new: DataFrame) -> DataFrame:
    """The table of lines with what was ingested: a rewritten session is replaced, others grow."""
    gone = new.where("status = 'rewritten'").select("session_id").distinct()
    return held.join(gone, "session_id", "left_anti").unionByName(new.select(*held.columns))
