"""FASTA and FASTQ as a data source: spark.read.format("fastx") and spark.readStream.format("fastx").

A record begins with > or @, and its header ends with the line: a name up to the
first white space, and a comment. Lines that follow are sequence, whatever marks
they hold, up to one that begins with >, @ or +. Behind a + line come lines of
quality until they are as long as the sequence; there a line may begin with any
mark. What lies between the end of a quality, or of what goes before the first
record, and the next > or @ is passed over. So kinds mix freely in one file, a
record that begins with @ may lack its quality, and one that begins with > may have
one. Empty lines of a sequence count for nothing, and line ends may be CRLF.

Where quality and sequence differ in length the read is invalid. Its quality ends
then before the first further line of it, if any, that begins with @ and that lines of
sequence and a + line follow, so that a quality too short costs one read and not two.

A file is cut by bytes, and a task reads the records that begin in its part. Which
marks begin records hangs on what goes before, so a task looks back: it reads from
every mark in the first half of a window of LOOK_BACK bytes. Reading from a wrong
one falls in step with the right one at the next true record, as a rule; the window
doubles until all agree, if need be up to the file's beginning. One of those
marks is right if no record is longer than half the window, so the result is that
of reading from the beginning for all files whose records are not longer, and for
longer ones too unless qualities span lines of which some look like headers.

Options: path (a file, a folder, or a pattern; commas separate several), bytes (of
a part) and lookback. Where there are many more parts than TASKS, a task reads several
that follow one another, up to 64 MB of a file, and looks back once. Files named .gz
are read by one task each.
"""

from __future__ import annotations

import fnmatch
import io
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

BYTES = 64 << 20
#: Tasks that are enough; where there are more parts, neighbours go together up to BYTES.
TASKS = 64
LOOK_BACK = 1 << 20
#: Bytes that are read at once, and records of a batch, with some bound on their characters.
BLOCK = 1 << 20
ROWS, CHARACTERS = 2_000, 8 << 20

FIELDS = "file string, record long, name string, comment string, seq string, qual string, valid boolean"
SCHEMA = pa.schema([("file", pa.string()), ("record", pa.int64()), *((c, pa.string()) for c in ("name", "comment", "seq", "qual")), ("valid", pa.bool_())])

_MARK = re.compile(rb"[>@]")
_HEADER = re.compile(rb"([^ \t\v\f\r]*)[ \t\v\f\r]?(.*)", re.S)

Record = tuple[int, str, str, str, "str | None", bool]


class Text:
    """Lines of a text that is read on demand; what lies before a place can be let go."""

    def __init__(self, read: Callable[[int, int], bytes], at: int = 0):
        self.read, self.base, self.data, self.ended = read, at, bytearray(), False

    def line(self, at: int) -> tuple[bytes, int, bool] | None:
        """The line at a place, where the next begins, and whether a line feed ends it."""
        seen = at - self.base
        while (end := self.data.find(b"\n", seen)) < 0 and not self.ended:
            seen = max(at - self.base, len(self.data))
            more = self.read(self.base + len(self.data), max(BLOCK, len(self.data) // 2))
            self.data += more
            self.ended = not more
        if end >= 0:
            return bytes(self.data[at - self.base : end]), self.base + end + 1, True
        rest = bytes(self.data[at - self.base :])
        return (rest, self.base + len(self.data), False) if rest else None

    def drop(self, before: int) -> None:
        if before - self.base > 4 * BLOCK:
            del self.data[: before - self.base]
            self.base = before


def _plain(line: bytes) -> bytes:
    return line[:-1] if line.endswith(b"\r") else line


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def _followed(text: Text, at: int) -> bool:
    """Whether lines that begin with no mark, and then a + line, follow the line at a place."""
    at = text.line(at)[1]
    while (found := text.line(at)) is not None:
        if found[0][:1] in (b">", b"@", b"+"):
            return found[0][:1] == b"+"
        at = found[1]
    return False


def records(text: Text, at: int, whole: bool = True) -> Iterator[Record]:
    """start, name, comment, seq, qual, valid of the records from a place on, which is looked at as one between records.

    whole: texts are let go behind, and records told in full; otherwise only their starts are.
    """
    mark: tuple[int, bytes, bool] | None = None  # start, line behind the mark, whether it was ended
    while True:
        while mark is None:
            if (found := text.line(at)) is None:
                return
            line, following, ended = found
            if m := _MARK.search(line):
                mark = at + m.start(), line[m.end() :], ended
            at = following
        start, header, ended = mark
        if not header and not ended:
            return
        mark, parts, plus = None, [], None
        while (found := text.line(at)) is not None:
            line, following, ended = found
            first = line[:1]
            if first in (b">", b"@"):
                mark = at, line[1:], ended
                at = following
                break
            at = following
            if first == b"+":
                plus = ended
                break
            parts.append(_plain(line))
        seq, qual, valid = b"".join(parts), None, True
        if plus is not None:
            lines, n = [], 0
            while plus and (found := text.line(at)) is not None:
                lines.append((at, _plain(found[0])))
                n, at = n + len(lines[-1][1]), found[1]
                if n >= len(seq):
                    break
            valid = plus and n == len(seq)
            if not valid:
                for i, (place, line) in enumerate(lines):
                    if i and line[:1] == b"@" and _followed(text, place):
                        lines, at = lines[:i], place
                        break
            qual = b"".join(x for _, x in lines)
        if whole:
            name, comment = _HEADER.fullmatch(_plain(header)).groups()
            yield start, _text(name), _text(comment), _text(seq), None if qual is None else _text(qual), valid
            text.drop(mark[0] if mark else at)
        else:
            yield start, "", "", "", None, valid


def _marks(text: Text, at: int, end: int) -> Iterator[int]:
    """The first mark of each line that begins in a range of bytes."""
    while at < end and (found := text.line(at)) is not None:
        if m := _MARK.search(found[0]):
            yield at + m.start()
        at = found[1]


def first_start(read: Callable[[int, int], bytes], at: int, look_back: int = LOOK_BACK) -> int | None:
    """The first record that begins at or behind a place, as reading from the beginning finds it."""
    while True:
        begin = max(0, at - look_back)
        text = Text(read, begin)
        if begin == 0:
            return next((r[0] for r in records(text, 0, False) if r[0] >= at), None)
        if (partial := text.line(begin)) is None:
            return None
        known: dict[int, int | None] = {}  # of a start, the first one behind the place
        for mark in _marks(text, partial[1], at - look_back // 2):
            if mark not in known:
                path, end = [], None
                for start, *_ in records(text, mark, False):
                    if start in known or start >= at:
                        end = known.get(start, start)
                        break
                    path.append(start)
                known.update(dict.fromkeys(path, end))
        found = set(known.values())
        if len(found) == 1:
            return found.pop()
        look_back *= 2


@dataclass
class Part(InputPartition):
    path: str
    begin: int
    end: int | None


def _where(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", path)))


def _files(paths: str) -> list[tuple[str, int, int]]:
    """Path, size and time of change (ns) of all files, in order of their paths."""
    found = {}
    for path in filter(None, (p.strip() for p in paths.split(","))):
        where, name = _where(path)
        scheme = path[: len(path) - len(name)] if path.endswith(name) else ""
        fixed = re.split(r"[*?\[]", name, maxsplit=1)[0]
        if fixed != name:
            top = fs.FileSelector(fixed.rsplit("/", 1)[0] or "/", recursive=True, allow_not_found=True)
            depth = name.count("/")
            infos = [i for i in where.get_file_info(top) if i.path.count("/") == depth and fnmatch.fnmatch(i.path, name)]
        else:
            info = where.get_file_info(name)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            infos = where.get_file_info(fs.FileSelector(name)) if info.type == fs.FileType.Directory else [info]
        for i in infos:
            if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")):
                found[scheme + i.path] = (scheme + i.path, i.size, i.mtime_ns or 0)
    return [found[p] for p in sorted(found)]


def _parts(files: list[tuple[str, int, int]], size: int) -> list[Part]:
    out = []
    for path, n, _ in files:
        out += [Part(path, 0, None)] if path.endswith(".gz") else [Part(path, at, min(n, at + size)) for at in range(0, n, size)]
    return out


def _dealt(parts: list[Part]) -> list[Part]:
    """The same stretches of files in fewer parts: a task for each small one costs more than what it reads."""
    most, out = min(BYTES, sum(p.end - p.begin for p in parts if p.end is not None) // TASKS), []
    for part in parts:
        last = out[-1] if out else None
        if last and part.end is not None and last.path == part.path and last.end == part.begin and part.end - last.begin <= most:
            out[-1] = Part(part.path, last.begin, part.end)
        else:
            out.append(part)
    return out


def _gunzipped(stream) -> Callable[[int, int], bytes]:
    """Reads one block after the other of a gzip file, of one or several members."""
    state, rest = zlib.decompressobj(31), b""

    def read(at: int, n: int) -> bytes:
        nonlocal state, rest
        while raw := rest or stream.read(BLOCK):
            if state.eof:
                state = zlib.decompressobj(31)
            out = state.decompress(raw, n)
            rest = state.unused_data if state.eof else state.unconsumed_tail
            if out:
                return out
        return b""

    return read


def own_records(part: Part, look_back: int = LOOK_BACK) -> Iterator[Record]:
    """Records that begin in a part of a file."""
    where, name = _where(part.path)
    if part.end is None:
        with where.open_input_stream(name, compression=None) as stream:
            yield from records(Text(_gunzipped(stream)), 0)
        return
    with where.open_input_file(name) as file:
        read = lambda at, n: file.read_at(n, at) if at < file.size() else b""
        start = part.begin
        if start:
            blocks = (read(at, min(BLOCK, part.end - at)) for at in range(part.begin, part.end, BLOCK))
            if not any(map(_MARK.search, blocks)):
                return
            start = first_start(read, part.begin, look_back)
        if start is None or start >= part.end:
            return
        for record in records(Text(read, start), start):
            if record[0] >= part.end:
                return
            yield record


def batches(file: str, found: Iterator[Record]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for record in found:
        rows.append((file, *record))
        size += len(record[3])
        if len(rows) >= ROWS or size >= CHARACTERS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)


class _Reading:
    """What batch and stream readers share."""

    def __init__(self, options: dict[str, str]):
        self.path = options.get("path") or options.get("paths") or ""
        self.bytes, self.look_back = int(options.get("bytes", BYTES)), int(options.get("lookback", LOOK_BACK))

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        return batches(part.path, own_records(part, self.look_back))


class FastxReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Part]:
        return _dealt(_parts(_files(self.path), self.bytes)) or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        return super().read(part) if part.path else iter(())


class FastxStreamReader(_Reading, DataSourceStreamReader):
    """New files, in order of their time and path. A file is taken once, as it is when it is first seen; an offset is the
    latest time with the paths of that time."""

    def initialOffset(self) -> dict:
        return {"time": -1, "paths": []}

    def latestOffset(self) -> dict:
        files = _files(self.path)
        time = max((t for _, _, t in files), default=-1)
        return {"time": time, "paths": [p for p, _, t in files if t == time]}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        after = lambda offset, p, t: t > offset["time"] or t == offset["time"] and p not in offset["paths"]
        files = [f for f in _files(self.path) if after(start, f[0], f[2]) and not after(end, f[0], f[2])]
        return _dealt(_parts(files, self.bytes)) or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        return super().read(part) if part.path else iter(())


class FastxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> FastxReader:
        return FastxReader(self.options)

    def streamReader(self, schema) -> FastxStreamReader:
        return FastxStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(FastxSource)


def whole_texts(rows: DataFrame, name: str = "file", text: str = "text") -> DataFrame:
    """Records of texts that are whole files: name, record (place in the text's bytes), and the source's other columns."""
    kind = rows.schema[name].dataType

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            names = part.column(0)
            for i in range(part.num_rows):
                raw = io.BytesIO((part.column(1)[i].as_py() or "").encode())
                for found in batches("", records(Text(lambda at, n, raw=raw: raw.read(n)), 0)):
                    own = pa.concat_arrays([names.slice(i, 1)] * found.num_rows)
                    yield pa.RecordBatch.from_arrays([own, *found.columns[1:]], names=[name, *found.schema.names[1:]])

    return rows.select(F.col(name), F.col(text)).mapInArrow(run, f"`{name}` {kind.simpleString()}, {FIELDS.split(', ', 1)[1]}")
