"""Reads of files and of texts, against reading one byte after the other."""

import gzip
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqgraph.sources import fastx, gfa


def by_bytes(data):
    """A parser that goes through bytes, with a state for what comes next."""
    out, at, waiting = [], 0, None

    def line():
        nonlocal at
        end = data.find(b"\n", at)
        found, ended = (data[at:end], True) if end >= 0 else (data[at:], False)
        at = end + 1 if ended else len(data)
        return found, ended

    cr = lambda x: x.removesuffix(b"\r")
    while True:
        if waiting is None:
            places = [p for p in (data.find(b">", at), data.find(b"@", at)) if p >= 0]
            if not places:
                return out
            waiting = min(places)
        start, at, waiting = waiting, waiting + 1, None
        if at == len(data):
            return out
        header = cr(line()[0])
        cut = next((i for i, c in enumerate(header) if c in b" \t\v\f\r"), len(header))
        seq, qual, valid = b"", None, True
        while at < len(data):
            c = data[at : at + 1]
            if c in (b">", b"@"):
                waiting = at
                break
            found, ended = line()
            if c == b"+":
                got, ends = b"", []
                while ended and at < len(data):
                    ends.append((at, got))
                    got += cr(line()[0])
                    if len(got) >= len(seq):
                        break
                qual, valid = got, ended and len(got) == len(seq)
                if not valid:
                    again = [e for e in ends[1:] if re.match(rb"@[^\n]*\n(?:[^>@+\n][^\n]*\n|\n)*\+", data[e[0] :])]
                    if again:
                        at, qual = again[0]
                break
            seq += cr(found)
        out.append((start, header[:cut].decode(), header[cut + 1 :].decode(), seq.decode(), None if qual is None else qual.decode(), valid))


CASES = {
    "leading_empty_line": "\n@a x\nACGT\n+\nIIII\n",
    "any_character": ">a\nAC-GT.*1 2\n;x\n@b\nA~C\n+\n!@>\n",
    "mixed": ">f\nACGT\n@b\nACGT\n+\nIIII\n>g\nTT\n",
    "mixed_other_way": "@b\nACGT\n+\nIIII\n>f\nACGT\nGG\n@c\nA\n+\n@\n",
    "no_quality": "@b\nACGT\n@c z\nGG\n+c\nII\n@d\n",
    "fasta_with_quality": ">b\nAC\n+\n@>\n>c\nG\n",
    "crlf_and_wraps": "@q1 x\r\nACGT\r\nACGTAC\r\n+\r\n@III\r\nIIII\r\n+I\r\n@q2\r\nA\r\n+\r\nI\r\n",
    "quality_too_short": "@a\nACGTA\n+\nII\n@b\nAC\n+\nII\n",
    "quality_too_long_in_lines": "@a\nACG\n+\nI\n@III\njunk\n@b\nAC\n+\nII\n",
    "quality_too_long": "@a\nAC\n+\nIII\n@b\nAC\n+\nII\n",
    "junk_between": "@a\nAC\n+\nII\njunk\n\nmore @b c\nGG\n",
    "no_end": "@a\nACGT\n+",
    "mark_at_the_end": ">a\nAC\n>",
    "empty": "",
    "empty_reads": "@\n\n+\n\n>\n>x",
}


@pytest.mark.parametrize("case", CASES)
def test_cases_in_parts_of_any_size(tmp_path, case):
    data = CASES[case].encode()
    (tmp_path / "x").write_bytes(data)
    want = by_bytes(data)
    for size in (1, 2, 3, 7, 1000):
        for back in (8, 64):
            parts = fastx._parts(fastx._files(f"file://{tmp_path}"), size)
            assert [r for p in parts for r in fastx.own_records(p, max(back, 4 * len(data)))] == want


def test_cases_say_what_they_should():
    read = lambda case: [(r[1], r[3], r[4], r[5]) for r in by_bytes(CASES[case].encode())]
    assert read("leading_empty_line") == [("a", "ACGT", "IIII", True)]
    assert read("any_character") == [("a", "AC-GT.*1 2;x", None, True), ("b", "A~C", "!@>", True)]
    assert read("mixed") == [("f", "ACGT", None, True), ("b", "ACGT", "IIII", True), ("g", "TT", None, True)]
    assert read("no_quality") == [("b", "ACGT", None, True), ("c", "GG", "II", True), ("d", "", None, True)]
    assert read("quality_too_short") == [("a", "ACGTA", "II", False), ("b", "AC", "II", True)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(">@+\nAC \r"), max_size=60), st.integers(1, 20))
def test_any_text_is_read_as_by_bytes(text, block):
    data = text.encode()
    old, fastx.BLOCK = fastx.BLOCK, block
    try:
        assert list(fastx.records(fastx.Text(lambda at, n: data[at : at + n]), 0)) == by_bytes(data)
    finally:
        fastx.BLOCK = old


def wrapped(rng, n):
    """Records of all kinds; qualities are full of marks, and every fourth spans lines."""
    out = []
    for i in range(n):
        k, kind = rng.randint(0, 40), rng.randint(0, 3)
        seq, qual = "".join(rng.choice("ACGTN") for _ in range(k)), "".join(rng.choice("@>+I") for _ in range(k))
        cut = (lambda s: "\n".join(s[j : j + 11] for j in range(0, len(s), 11))) if rng.random() < 0.25 else str
        out.append(f"{'>@'[kind > 0]}r{i} c\n{cut(seq)}\n" + (f"+\n{cut(qual)}\n" if kind > 1 else ""))
    return "".join(out)


def test_parts_of_long_files(tmp_path):
    data = wrapped(random.Random(7), 3_000).encode()
    (tmp_path / "x").write_bytes(data)
    want = by_bytes(data)
    for size, back in ((997, 1000), (20_000, 1000), (20_000, 50_000)):
        assert [r for p in fastx._parts(fastx._files(f"{tmp_path}/x"), size) for r in fastx.own_records(p, back)] == want


def test_the_format(spark, tmp_path):
    data = wrapped(random.Random(8), 2_000).encode()
    (tmp_path / "a.fq").write_bytes(data)
    with gzip.open(tmp_path / "b.fq.gz", "wb") as f:
        f.write(data)
    (tmp_path / "_left_out").write_text(">x\nA\n")
    fastx.register(spark)
    rows = spark.read.format("fastx").option("bytes", "5000").load(f"file://{tmp_path}")
    assert rows.rdd.getNumPartitions() > 10
    for name in ("a.fq", "b.fq.gz"):
        found = sorted(tuple(r)[1:] for r in rows.where(rows.file.endswith(name)).collect())
        assert found == by_bytes(data)
    assert spark.read.format("fastx").load(f"file://{tmp_path}/*.gz").count() == len(by_bytes(data))
    numbers = gfa.read_reads(spark, f"file://{tmp_path}", bytes="5000").select("read_idx", "file_path", "record").collect()
    assert [r.read_idx for r in sorted(numbers, key=lambda r: (r.file_path, r.record))] == list(range(len(numbers)))


def test_many_small_parts_are_read_by_few_tasks(spark, tmp_path):
    """Neighbours go together, all of them, each file's apart; numbers follow paths and places."""
    want = []
    for name, n in (("b", 900), ("a", 1_500), ("c", 1), ("d", 0)):
        (tmp_path / name).write_bytes(wrapped(random.Random(n), n).encode())
    for name in "abc":
        want += [(name, *r[1:]) for r in by_bytes((tmp_path / name).read_bytes())]
    parts = fastx._parts(fastx._files(f"file://{tmp_path}"), 40)
    dealt = fastx._dealt(parts)
    assert len(parts) > 1_000 and fastx.TASKS <= len(dealt) < 2 * fastx.TASKS
    assert [(p.path, at) for p in dealt for at in range(p.begin, p.end)] == [(p.path, at) for p in parts for at in range(p.begin, p.end)]
    found = gfa.read_reads(spark, f"file://{tmp_path}", bytes="40", lookback="1000").collect()
    assert sorted((r.read_idx, r.file_path[-1], r.name, r.comment, r.seq, r.qual, r.valid) for r in found) == [(i, *w) for i, w in enumerate(want)]
    fastx.register(spark)
    assert spark.read.format("fastx").option("bytes", "40").load(f"file://{tmp_path}").rdd.getNumPartitions() == len(dealt)


def test_the_stream(spark, tmp_path):
    inbox, out = tmp_path / "in", f"file://{tmp_path}/out"
    inbox.mkdir()
    fastx.register(spark)

    def drain():
        rows = spark.readStream.format("fastx").option("bytes", "300").load(f"file://{inbox}")
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted((r.file.rsplit("/")[-1], r.name, r.seq) for r in spark.read.parquet(out).collect())

    first, second = (wrapped(random.Random(i), 60).encode() for i in (1, 2))
    told = lambda name, data: [(name, r[1], r[3]) for r in by_bytes(data)]
    (inbox / "a").write_bytes(first)
    assert drain() == sorted(told("a", first))
    (inbox / "b").write_bytes(second)
    assert drain() == sorted(told("a", first) + told("b", second))


def test_texts_keep_their_names(spark):
    rows = spark.createDataFrame([(1, "\n>a\nAC\n@b\nG\n+\n@\n"), (2, None), (3, ""), (None, ">x y\nT")], "id int, text string")
    found = fastx.whole_texts(rows, "id").collect()
    assert sorted(((r.id or 0), r.name, r.comment, r.seq, r.qual, r.valid) for r in found) == [(0, "x", "y", "T", None, True), (1, "a", "", "AC", None, True), (1, "b", "", "G", "@", True)]
