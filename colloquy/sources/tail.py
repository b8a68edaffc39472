"""A streaming source of growing transcripts: byte offsets a file, with a digest that is carried on.

``spark.dataSource.register(TranscriptTail)`` and ``readStream.format("transcript_tail").load(folder)`` give
(path, generation, line_no, raw) of every ``*.jsonl`` below a folder, on any file system that Arrow reaches by the
folder's URI. A half-written last line waits. A file that was rewritten starts a new generation from line 1.

A trigger lists the folder and reads what is new: a file of the same size and time is not opened; of one that grew,
the last bytes that were read before are compared (at most WINDOW) and the rest is new. The digest of all that was read
is a number that new bytes extend, so nothing is read again for it; the whole prefix is read only where a file has
another time but not more bytes. A file that shrank, or that fails either comparison, was rewritten.

Options: ``state``, a folder for the source's own state, from which a restarted query goes on without reading anything
again; without it a restart reads every file once to know where it stands.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

CHUNK, WINDOW = 1 << 20, 1 << 10
#: A prime above any 15 bytes; digests are numbers below it.
PRIME = (1 << 127) - 1


class _Range(InputPartition):
    def __init__(self, folder: str, path: str, generation: int, start: int, end: int, line: int):
        super().__init__((path, generation, start, end, line))
        self.folder, self.path, self.generation, self.start, self.end, self.line = folder, path, generation, start, end, line


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The folder's file system and its path there. ``file:`` and no scheme are local."""
    if urlparse(folder).scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(urlparse(folder).path) if folder.startswith("file:") else folder
    return fs.FileSystem.from_uri(folder)


def extend(digest: int, data: bytes) -> int:
    """The digest of some bytes and of what follows them."""
    return (digest * pow(256, len(data), PRIME) + int.from_bytes(data, "big")) % PRIME


class Held:
    """What is known of a file: generation, bytes and lines read, their digest, their last bytes, and the file's size and time then."""

    def __init__(self, generation: int = 0, end: int = 0, lines: int = 0, digest: int = 0, last: str = "", size: int = -1, time: int = -1):
        self.generation, self.end, self.lines, self.digest, self.last, self.size, self.time = generation, end, lines, digest, last, size, time

    def packed(self) -> list:
        return [self.generation, self.end, self.lines, str(self.digest), self.last, self.size, self.time]

    @classmethod
    def of(cls, packed: list) -> Held:
        return cls(*packed[:3], int(packed[3]), *packed[4:])


class TailReader(DataSourceStreamReader):
    """Offsets: path -> what ``Held`` has, as JSON."""

    def __init__(self, folder: str, state: str | None = None):
        self.folder, self.state, self.read_bytes, self.held = folder, state, 0, None

    def _known(self) -> dict[str, Held]:
        if self.held is None:
            self.held = {}
            if self.state:
                files, at = file_system(f"{self.state}/tail.json")
                if files.get_file_info(at).type == fs.FileType.File:
                    with files.open_input_stream(at) as f:
                        self.held = {p: Held.of(x) for p, x in json.loads(f.read()).items()}
        return self.held

    def _bytes(self, files: fs.FileSystem, path: str, start: int, end: int) -> Iterator[bytes]:
        with files.open_input_file(path) as f:
            f.seek(start)
            while start < end and (data := f.read(min(CHUNK, end - start))):
                start += len(data)
                self.read_bytes += len(data)
                yield data

    def _rewritten(self, files: fs.FileSystem, path: str, info: fs.FileInfo, held: Held) -> bool:
        if info.size < held.end or info.size < held.size:
            return True
        if info.size == held.size:  # another time alone: whether the bytes are others too takes reading them
            digest = 0
            for data in self._bytes(files, path, 0, held.end):
                digest = extend(digest, data)
            return digest != held.digest
        last = bytes.fromhex(held.last)
        return b"".join(self._bytes(files, path, held.end - len(last), held.end)) != last

    def _read_on(self, files: fs.FileSystem, path: str, info: fs.FileInfo, held: Held) -> Held:
        """Goes on to the last complete line. What stands after it is read again when it has become a line."""
        new, waiting = Held(held.generation, held.end, held.lines, held.digest, held.last, info.size, info.mtime_ns), []
        for data in self._bytes(files, path, held.end, info.size):
            cut = data.rfind(b"\n") + 1
            if not cut:
                waiting.append(data)
                continue
            for part in (*waiting, data[:cut]):
                new.digest, new.end = extend(new.digest, part), new.end + len(part)
                new.last = (bytes.fromhex(new.last) + part)[-WINDOW:].hex()
                new.lines += part.count(b"\n")
            waiting = [data[cut:]]
        return new

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        known = self._known()
        files, root = file_system(self.folder)
        for info in sorted(files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)), key=lambda x: x.path):
            if info.type != fs.FileType.File or posixpath.splitext(info.path)[1] != ".jsonl":
                continue
            held = known.get(info.path, Held())
            if (info.size, info.mtime_ns) == (held.size, held.time):
                continue
            if held.size >= 0 and self._rewritten(files, info.path, info, held):
                held = Held(held.generation + 1)
            known[info.path] = self._read_on(files, info.path, info, held)
        return {"files": json.dumps({p: x.packed() for p, x in sorted(known.items())})}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = ({p: Held.of(x) for p, x in json.loads(o["files"]).items()} for o in (start, end))
        if self.held is None and not self.state:
            self.held = dict(after)
        out = []
        for path, held in sorted(after.items()):
            was = before.get(path, Held(held.generation))
            at, line = (was.end, was.lines) if was.generation == held.generation else (0, 0)
            if held.end > at:
                out.append(_Range(self.folder, path, held.generation, at, held.end, line))
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        files, _ = file_system(partition.folder)
        line, waiting = partition.line, []
        for data in self._bytes(files, partition.path, partition.start, partition.end):
            first, *others = data.split(b"\n")
            waiting.append(first)
            for after in others:
                line += 1
                yield (partition.path, partition.generation, line, b"".join(waiting).decode("utf-8", "replace"))
                waiting = [after]

    def commit(self, end: dict) -> None:
        if self.state:
            files, folder = file_system(self.state)
            files.create_dir(folder, recursive=True)
            with files.open_output_stream(f"{folder}/.tail.json") as f:
                f.write(end["files"].encode())
            files.move(f"{folder}/.tail.json", f"{folder}/tail.json")


class TranscriptTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcript_tail"

    def schema(self) -> str:
        return "path string, generation int, line_no long, raw string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(self.options["path"], self.options.get("state"))
