"""Token files against the tokenizer itself, and their sequences against the stream of ids."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seqgraph.llm import tokenfile
from seqgraph.llm.queries import QUERIES

TOKENIZER = Tokenizer.from_file(public_tokenizers.path(tokenfile.TOKENIZER))
ODD = ["", "a", " ", "  ", "\n", "a  b", "a   b", "a\n\n\nb c", " a \n b\n", "a\tb", "a\t b", "a \t b", "x y", "x   y", "don't 'tis they're!!", "<|endoftext|> x", "<| endoftext", "naïve Ünïcode, größe.", "日本 語", "a\r\nb", "\x1c \x1d a", "1,234 5.6e7", "é ́x", "__a__ b_c", "a\n\nb", "a\n b", "a\n\n b", "a\n\n", "a\n", "\n\nb", "\x01a \x01b \x01", "e.\n\nF g."]


def plain(rows):
    """Of (doc_id, text) in order of doc_id and text: doc_id, start, n, crc, and the ids."""
    out, start, stream = [], 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start, stream = start + len(ids), stream + ids
    return out, stream


def told(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é'ßs ,.\n\t  <|1日\x1f"), max_size=40))
def test_units_encode_like_the_whole_text(text):
    own = tokenfile.encoder(tokenfile.TOKENIZER)
    assert np.frombuffer(next(own.encode(pa.array([text]))), own.type).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_odd_texts_together():
    own = tokenfile.encoder(tokenfile.TOKENIZER)
    assert [np.frombuffer(x, own.type).tolist() for x in own.encode(pa.array(ODD))] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in ODD]


@pytest.mark.parametrize("length,file_tokens", [(4, 30), (7, 1), (2048, 1 << 20)])
def test_documents_come_back(spark, length, file_tokens):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "x y"), (None, None), (3, "again"), (3, "again"), (40, None), (41, "long " * 3000)]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, path string, start int").repartition(5)
    expected, stream = plain(rows)
    files = tokenfile.write(docs, length=length, file_tokens=file_tokens)
    assert told(tokenfile.read(files)) == expected
    found = []
    for r in files.orderBy("task", "part").collect():
        own = tokenfile.TokenFile(r.path)
        assert len(own) == r.n_sequences
        part = []
        for i in range(len(own)):
            ids, valid, last = own[i]
            assert len(ids) == len(valid) == len(last) == length
            part += ids[np.array(valid)].tolist()
        assert len(part) == r.n_tokens
        assert sum(sum(own[i][2].to_pylist()) for i in range(len(own))) == r.n_docs
        found += part
    assert found == stream


def test_sequences_are_views_of_the_file(spark):
    docs = spark.createDataFrame([(i, "some words " * 500) for i in range(20)], "doc_id long, text string")
    before = pa.total_allocated_bytes()
    own = tokenfile.TokenFile(tokenfile.write(docs, length=512).first().path)
    views = [own[i] for i in range(len(own))]
    assert pa.total_allocated_bytes() - before < 512 * 2
    assert all(not ids.flags.owndata and not ids.flags.writeable for ids, _, _ in views)
    with pytest.raises(IndexError):
        own[len(own)]


def test_empty_table(spark):
    assert tokenfile.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert told(QUERIES["op11_token_files"](spark, sf)) == plain(rows)[0]
