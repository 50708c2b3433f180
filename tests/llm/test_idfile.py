import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import documents
from tokenizers import Tokenizer

from palimpsest.llm import idfile


def brute(rows, start=0):
    tokenizer = Tokenizer.from_file(idfile.default_vocabulary())
    out = []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_documents_round_trip(spark):
    docs = documents(spark)
    got = sorted(tuple(r) for r in idfile.written_and_read(docs).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edges(edge_docs, no_docs):
    got = [tuple(r) for r in idfile.written_and_read(edge_docs).collect()]
    want = brute([(r.doc_id, r.text) for r in edge_docs.collect()])
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((r[0], r[2], r[3]) for r in want)
    assert sorted(r[1] for r in got) == sorted(r[1] for r in want)
    assert idfile.written_and_read(no_docs).count() == 0


@pytest.mark.parametrize("text", ["a  b", " lead", "tail ", "x \n y", "\n\n a\t b", "é ü  漢字 漢", "it's we'll  'tis", "a b  c \x1cd", "<|endoftext|> a <|endoftext|>", "", "  ", "1 2 33 ,, !! a.b", "x\r\n  y z"])
def test_pieces_are_as_the_whole(text):
    with open(idfile.default_vocabulary(), encoding="utf-8") as f:
        encoder = idfile.Encoder(f.read())
    ids = np.frombuffer(encoder.encode(pa.array([text, "x", text]))[2], encoder.dtype).tolist()
    assert ids == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_elias_fano_select():
    r = np.random.default_rng(1)
    for n, most in [(1, 1), (1, 1000), (5, 5), (300, 3), (1000, 100_000), (64, 2), (65, 2)]:
        values = np.cumsum(r.integers(1, most + 1, n))
        bits, body = idfile.EliasFano.encode(values)
        read = idfile.EliasFano(n, bits, body)
        assert read.all().tolist() == values.tolist() == [read.select(i) for i in range(n)]
        assert len(body) <= n * (bits + 3) / 8 + n / 16 + 10
    data = idfile.write_segment([b"\x01\x00\x02\x00", b"\x03\x00"], 2)
    segment = idfile.Segment(data)
    assert [segment.ids(i).tolist() for i in range(2)] == [[1, 2], [3]] and segment.bounds(1) == (2, 3)
    with pytest.raises(ValueError):
        idfile.Segment(b"x" * 40)
