"""Token ids in Arrow files of equal-length sequences, with masks.

A file is Arrow's file format: a stream of record batches with a footer that
tells where each lies. Batches hold fixed-size lists, so every sequence has the
same place in its batch's buffer, and sequence i of a file is found by division,
as a view of the mapped file without copying or decoding anything. Columns:

- ids: LENGTH ids, uint16 where the vocabulary allows it, else uint32
- valid: LENGTH bits, false for the padding behind the last id of a file
- last: LENGTH bits, true at the id that ends a document
- docs: doc_id of the documents that begin in the sequence

Scale: texts are dealt by ranges of doc_id, sorted there, encoded and written by
the task that has them; only texts are shuffled, once. A task ends a file behind
the document that brings it to FILE_TOKENS ids, so files stay of a size and a
document lies in one file. File names are new for each attempt, and only those
count that are in the table of files, which Spark commits: an executor that is
lost costs its unfinished files. Where a file's ids start in the whole follows
from running sums over the table of files. Distinct words with the white space
before them are encoded once for each worker, up to a bound.

The shared folder may be any that pyarrow can write to: local or mounted paths,
HDFS, S3, GCS. Files are mapped where they are local, else read by batch.

Edge cases: null text counts as empty (the end id alone); a null doc_id comes
first, and rows of equal id are in order of their texts; repeated rows are written
each; a very long text spans sequences, and batches; an empty table gives no
file and an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import running
from .common import materialise, shared_dir, slices

TOKENIZER = "byte_bpe_50k.json"
END = 0
#: Ids of a sequence, sequences of a batch, ids after which a file ends with the next document.
LENGTH = 2048
ROWS = 256
FILE_TOKENS = 64 << 20
#: Texts that are split together.
TEXTS = 2_000
#: Units that a worker remembers.
REMEMBERED = 1_000_000

FILES = "task int, part int, path string, n_docs long, n_tokens long, n_sequences long"

_UNIT = re.compile(rb"[ \n]+[^ \n]*|[^ \n]+")
_ODD = re.compile(r"[^\S \n]|<\|")
_PARTS = re.compile(rb"( [A-Za-z\x80-\xff]+)([!-/:-;=-@\[-`{-~]*)")
#: Fixed value: how the vocabulary writes a space.
SPACE = "\u0120"
#: Stands before a text while it is split, so that its first word is known; a text that has it is split by itself.
FIRST = b"\x01"


def _latin(word: bytes) -> bool:
    """Whether these are letters up to U+024F, whose kind no version of the character tables doubts."""
    text = word[1:].decode()
    return max(text) < "\u0250" and text.isalpha()


class UnitEncoder:
    """Ids of whole texts as bytes of the given type, encoding each distinct unit once.

    A unit is a run of spaces and line feeds and the word behind it. The tokenizer's pattern never joins a word with
    white space behind it and looks ahead no further than a run of white space, so a text's ids are those of its units.
    Other white space would cut such a run in two: a text that has any is given to the tokenizer whole, and so is one
    that may spell a special token.

    Texts are split and their ids put together in Arrow, many texts at a time, where white space is such that a unit
    begins at each single space or line feed: runs of one, two line feeds, or a line feed and a space, before a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.type = id_type(len(vocabulary))
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens with a space before them
        for token, i in vocabulary.items():
            self.begins[i] = token.startswith(SPACE)
        # Units met of late, and before.
        self.known: dict[bytes, bytes | None] = {}
        self.older: dict[bytes, bytes | None] = {}

    def _units(self, units: list[bytes]) -> list[bytes | None]:
        """Ids of units; None for those that need their text."""
        self._meet(units)
        found = [self.known[u] for u in units]
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        return found

    def _meet(self, units: list[bytes]) -> None:
        """Units of a space, letters and punctuation are put together from the ids of the word and of the punctuation."""
        known, older = self.known, self.older
        missing = []
        for u in units:
            if u not in known:
                if u in older:
                    known[u] = older[u]
                else:
                    missing.append(u)
        parted, words, other = [], [], []
        for u in missing:
            m = _PARTS.fullmatch(u)
            if m is None or not (m[1].isascii() or _latin(m[1])):
                other.append(u)
            elif m[2]:
                parted.append((u, m[1], m[2]))
            else:
                words.append(u)
        if parted:
            self._meet(list({x for _, word, tail in parted for x in (word, tail)}))
        self._learn_words([w for w in words if w not in known])
        self._learn_each([u for u in other if u not in known])
        known.update((u, known[word] + known[tail]) for u, word, tail in parted)

    def _learn_words(self, words: list[bytes]) -> None:
        """Many words in one text: each begins at a token with a space before it."""
        for at in range(0, len(words), 2_000):
            some = words[at : at + 2_000]
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join(some).decode()], add_special_tokens=False)[0].ids, self.type)
            cuts = [*(np.flatnonzero(self.begins[ids]) * self.type.itemsize).tolist(), ids.nbytes]
            raw = ids.tobytes()
            self.known.update((w, raw[a:b]) for w, a, b in zip(some, cuts[:-1], cuts[1:], strict=True))

    def _learn_each(self, units: list[bytes]) -> None:
        for at in range(0, len(units), 2_000):
            some = units[at : at + 2_000]
            texts = [u.decode() for u in some]
            for u, t, e in zip(some, texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                self.known[u] = None if _ODD.search(t) else np.array(e.ids, self.type).tobytes()

    def _one(self, raw: bytes) -> bytes:
        parts = self._units(_UNIT.findall(raw))
        return b"".join(parts) if None not in parts else np.array(self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids, self.type).tobytes()

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Of each text; null counts as empty."""
        raw = pc.fill_null(texts.cast(pa.binary()), b"")
        pieces = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(FIRST, raw, b""), b"\n", b" \n"), b" ")
        flat = pieces.flatten().dictionary_encode()
        words = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = self._units([w[1:] if w[:1] == FIRST else w if w[:1] == b"\n" else b" " + w for w in words])
        index = flat.indices.to_numpy()
        # Pieces between two spaces, and line feeds before others, stand in longer runs.
        odd = np.array([x is None or not w for w, x in zip(words, ids, strict=True)])[index]
        lone = np.array([w == b"\n" for w in words])[index]
        odd[1:] |= lone[1:] & lone[:-1]
        bounds = pieces.offsets.to_numpy()
        whole = np.logical_or.reduceat(odd, bounds[:-1]) | pc.match_substring(raw, FIRST).to_numpy(zero_copy_only=False) if len(raw) else []
        stream = pa.array([x or b"" for x in ids], pa.binary()).take(flat.indices)
        data, places = memoryview(stream.buffers()[2] or b""), np.frombuffer(stream.buffers()[1], np.int32, len(index) + 1)[bounds].tolist()
        for i, apart in enumerate(whole):
            yield self._one(raw[i].as_py()) if apart else bytes(data[places[i] : places[i + 1]])


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(tokenizer: str) -> UnitEncoder:
    """One for each worker process, which keeps it from task to task."""
    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = UnitEncoder(public_tokenizers.path(tokenizer))
    return _ENCODERS[tokenizer]


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def schema(kind: np.dtype, length: int) -> pa.Schema:
    own = lambda t: pa.list_(t, length)
    return pa.schema([("ids", own(pa.from_numpy_dtype(kind))), ("valid", own(pa.bool_())), ("last", own(pa.bool_())), ("docs", pa.list_(pa.int64()))])


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file as Spark names it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", path)))


class Writer:
    """One file of documents, in the order in which they come."""

    def __init__(self, path: str, kind: np.dtype, length: int = LENGTH, rows: int = ROWS):
        where, name = place(path)
        where.create_dir(name.rsplit("/", 1)[0], recursive=True)
        self.sink = where.open_output_stream(name)
        self.schema, self.kind, self.length, self.rows = schema(kind, length), kind, length, rows
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.docs = self.tokens = self.sequences = 0
        self.held, self.begins, self.size = [], [], 0  # ids, (place, doc_id) not yet written

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.begins.append((self.size, doc_id))
        self.held.append(ids)
        n = len(ids) // self.kind.itemsize
        self.docs, self.tokens, self.size = self.docs + 1, self.tokens + n, self.size + n
        if self.size >= self.rows * self.length:
            self._write(self.size // (self.rows * self.length) * self.rows)

    def _write(self, sequences: int) -> None:
        """That many sequences from the front; those of the last batch may be padded."""
        ids = np.frombuffer(b"".join(self.held), self.kind)
        count, whole = len(ids), sequences * self.length
        last = np.zeros(max(count, whole), bool)
        last[[at - 1 for at, _ in self.begins if at > 0]] = True
        last[count - 1] = True  # documents are added whole
        begins = np.array([at for at, _ in self.begins], np.int64)
        padded = np.concatenate([ids, np.zeros(max(0, whole - count), self.kind)])
        for row in range(0, sequences, self.rows):
            n = min(self.rows, sequences - row)
            a, b = row * self.length, (row + n) * self.length
            inside = slice(*np.searchsorted(begins, [a, b]).tolist())
            offsets = np.searchsorted(begins[inside], np.arange(a, b + 1, self.length)).astype(np.int32)
            docs = pa.ListArray.from_arrays(pa.array(offsets), pa.array([d for _, d in self.begins[inside]], pa.int64()))
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded[a:b], np.arange(a, b) < count, last[a:b])]
            self.file.write_batch(pa.RecordBatch.from_arrays([*columns, docs], schema=self.schema))
        self.sequences += sequences
        rest = ids[whole:]
        self.held, self.begins, self.size = [rest.tobytes()], [(at - whole, d) for at, d in self.begins if at >= whole], len(rest)

    def close(self) -> None:
        if self.size:
            self._write(-(-self.size // self.length))
        self.file.close()
        self.sink.close()


def write(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, length: int = LENGTH, file_tokens: int = FILE_TOKENS, folder: str | None = None) -> DataFrame:
    """Write documents (doc_id, text) into Arrow files in order of doc_id; the table of files, itself written.

    Files are in order by task and part. folder: by default a new one in the shared folder.
    """
    spark = docs.sparkSession
    top = folder or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, part, file = encoder(tokenizer), TaskContext.get().partitionId(), 0, None
        tail = np.array([end], own.type).tobytes()

        def finish() -> pa.RecordBatch:
            file.close()
            row = {"task": task, "part": part, "path": path, "n_docs": file.docs, "n_tokens": file.tokens, "n_sequences": file.sequences}
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in slices(batches, TEXTS):
            for doc_id, raw in zip(batch.column(0).to_pylist(), own.encode(batch.column(1)), strict=True):
                if file is None:
                    path = f"{top}/tokens-{task:06d}-{part:05d}-{uuid.uuid4().hex}.arrow"
                    file = Writer(path, own.type, length)
                file.add(doc_id, raw + tail)
                if file.tokens >= file_tokens:
                    yield finish()
                    part, file = part + 1, None
        if file is not None:
            yield finish()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return materialise(ordered.mapInArrow(run, FILES), "token-files")


class TokenFile:
    """Random access to a file's sequences."""

    def __init__(self, path: str):
        where, name = place(path)
        source = pa.memory_map(name) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(name)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        n = self.file.num_record_batches
        self.rows = self.file.get_batch(0).num_rows if n else 0
        self.size = (n - 1) * self.rows + self.file.get_batch(n - 1).num_rows if n else 0

    def __len__(self) -> int:
        return self.size

    def batches(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
        """ids (a view), valid, last, docs of each batch, its sequences end to end."""
        for i in range(self.file.num_record_batches):
            batch = self.file.get_batch(i)
            yield batch.column("ids").flatten().to_numpy(), *(batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("valid", "last")), batch.column("docs").flatten()

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """ids, valid and last of a sequence: views of the file's bytes."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        batch, at = self.file.get_batch(i // self.rows), i % self.rows * self.length
        ids, valid, last = (batch.column(c).values.slice(at, self.length) for c in ("ids", "valid", "last"))
        return ids.to_numpy(), valid, last


def documents(path: str) -> Iterator[tuple[list, list[int], list[int]]]:
    """doc_ids, numbers of ids and crc32 (of ids as uint32) of the documents in a file, batch by batch."""
    waiting, n, crc = [], 0, 0
    for ids, valid, last, docs in TokenFile(path).batches():
        waiting += docs.to_pylist()
        raw = memoryview(ids.astype("<u4").tobytes())
        sizes, sums, at = [], [], 0
        for stop in (np.flatnonzero(last) + 1).tolist():
            sizes.append(n + stop - at)
            sums.append(zlib.crc32(raw[4 * at : 4 * stop], crc))
            at, n, crc = stop, 0, 0
        rest = int(np.count_nonzero(valid))
        if rest > at:
            n, crc = n + rest - at, zlib.crc32(raw[4 * at : 4 * rest], crc)
        yield waiting[: len(sizes)], sizes, sums
        waiting = waiting[len(sizes) :]


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files of write()'s table."""
    count = files.count()
    placed = running(files, ["task", "part"], F.col("n_tokens"), "before").select("task", "part", "path", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for doc_ids, sizes, sums in documents(path):
                    starts = start + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                    start = int(starts[-1])
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts[:-1].astype(np.int64)), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # A file to each task, or nearly so.
    dealt = placed.repartitionByRange(max(count, 1), "task", "part").select("path", "before")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of documents written and read back."""
    return read(write(docs))
