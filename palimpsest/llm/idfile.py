"""Token-id files with Elias-Fano document boundaries (operator 6).

Documents are range-partitioned by doc_id, tokenised in order, and written as a table of segments. A segment is a
self-contained binary file of about ``SEGMENT_IDS`` ids: a header, the ids of its documents one after another (two
bytes each where the vocabulary allows), and the ends of the documents as an Elias-Fano sequence. Of an end below U,
with n documents, the low log2(U / n) bits are stored as they are, the rest in unary in a bit vector, about
2 + log2(U / n) bits a document; every 64th one of that vector has its place stored (32 bits, within the segment),
which gives the select structure: end i is found by reading on from a stored place, and so are the offsets that
reading a table gives back. Segments are kept in the cells of
a Parquet table in the shared folder, so that any store works and lost executors' files never count; what a segment
must know of others is one number, the ids before its partition.

A text is cut before a space that precedes a plain character, and such pieces into words, digits and signs, where the
vocabulary's own pattern cuts them: byte-level BPE never joins tokens there, so words are encoded one by one, and
equal ones once for each Python process (up to ``PIECES`` of them are kept). Whatever isn't plain is encoded whole.

Nulls: a null text is empty (its end id alone), a null doc_id sorts first; rows of equal ids follow each other in any
order. Repeated rows are documents of their own. An empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import sys
import types
import uuid
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from palimpsest.llm.common import bounded, partitions, shared_folder

END_ID = 0
SEGMENT_IDS = 1 << 20
MAGIC = b"EFIDS\x01"
HEADER = "<6sBBIQ"  # magic, bytes of an id, low bits, documents, ids
SAMPLE = 64
PIECES = 500_000
AT_ONCE = 1 << 23
TOGETHER = 64
#: How a byte-level vocabulary writes a space.
SPACE_SIGN = "\u0120"
LONGEST_PIECE = 48
MAX_PARTS = 1_000_000
PLAIN = "!-~À-ɏ"
ODD = f" (?:[^{PLAIN}]|$)"
CUT = re.compile(f"(?= [{PLAIN}])")
#: Pieces that can be cut further, and the vocabulary's pattern for them: letters, digits or other characters, each
#: with a space before it, or one white space alone. Apostrophes (contractions), < and [ (special tokens) and
#: runs of white space stay whole.
PLAIN_SIGNS = "!-&(-;=-Z\\\\-~À-ÖØ-öø-ɏ"
SIMPLE = re.compile(f" ?[{PLAIN_SIGNS}]+(?:\n[{PLAIN_SIGNS}]+)*")
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
WORDS = re.compile(f" ?[{LETTERS}]+| ?[0-9]+| ?[^\\s{LETTERS}0-9]+|\n")


class EliasFano:
    """A non-decreasing sequence of integers; ``encode`` gives bytes, ``select`` reads one of them back."""

    def __init__(self, n: int, low_bits: int, body: memoryview | bytes):
        self.n, self.low_bits = n, low_bits
        low = (n * low_bits + 7) // 8
        samples = 4 * (-(-n // SAMPLE))
        self.low = np.frombuffer(body, np.uint8, low)
        self.samples = np.frombuffer(body, "<u4", samples // 4, low)
        self.high = np.frombuffer(body, np.uint8, len(body) - low - samples, low + samples)

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, bytes]:
        """Number of low bits, and low bits, select samples and high bits."""
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        places = (values >> bits) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        high[places] = 1
        lows = ((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8).reshape(-1)
        return bits, np.packbits(lows, bitorder="little").tobytes() + places[::SAMPLE].astype("<u4").tobytes() + np.packbits(high, bitorder="little").tobytes()

    def select(self, i: int) -> int:
        """Value i: the place of one number i in the high bits, less i, and its low bits."""
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = place // 8
        bits = int(self.high[byte]) >> place % 8 << place % 8
        while (ones := bits.bit_count()) <= left:
            left -= ones
            byte += 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1  # without its lowest one
        place = 8 * byte + (bits & -bits).bit_length() - 1
        first = i * self.low_bits
        some = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little") >> first % 8
        return (place - i) << self.low_bits | some & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        lows = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits).astype(np.int64)
        return (places - np.arange(self.n)) << self.low_bits | (lows << np.arange(self.low_bits)).sum(axis=1)


def write_segment(ids: list[bytes], id_bytes: int) -> bytes:
    """A segment of documents, each the little-endian bytes of its ids."""
    ends = np.cumsum([len(x) // id_bytes for x in ids], dtype=np.int64)
    low_bits, boundaries = EliasFano.encode(ends)
    return struct.pack(HEADER, MAGIC, id_bytes, low_bits, len(ids), int(ends[-1])) + b"".join(ids) + boundaries


class Segment:
    """A segment read back: ``bounds(i)`` are the first and end place of document i, ``ids(i)`` its ids."""

    def __init__(self, data: bytes):
        magic, self.id_bytes, low_bits, self.n, self.n_ids = struct.unpack_from(HEADER, data)
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        self.array = np.frombuffer(data, f"<u{self.id_bytes}", self.n_ids, struct.calcsize(HEADER))
        self.ends = EliasFano(self.n, low_bits, memoryview(data)[struct.calcsize(HEADER) + self.id_bytes * self.n_ids :])

    def bounds(self, i: int) -> tuple[int, int]:
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        return self.array[slice(*self.bounds(i))]


class Encoder:
    """Encodes texts piece by piece, remembering pieces; one for each Python process and vocabulary."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.id_bytes = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.id_bytes == 2 else "I"
        self.dtype = np.dtype(f"<u{self.id_bytes}")
        self.end = np.array([END_ID], self.dtype).tobytes()
        # Pieces with < or [ stay whole, so that special tokens are never cut.
        self.cuts = all("<" in t.content or "[" in t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        names = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(names.values()) + 1, bool)
        self.begins[[i for name, i in names.items() if name.startswith(SPACE_SIGN)]] = True
        self.words: dict[str, bytes] = {}
        self.after_space: dict[str, bytes] = {}

    @classmethod
    def here(cls, vocabulary: str) -> Encoder:
        process = sys.modules.setdefault("_token_encoders", types.ModuleType("_token_encoders"))
        key = f"v{zlib.crc32(vocabulary.encode())}"
        if not hasattr(process, key):
            setattr(process, key, cls(vocabulary))
        return getattr(process, key)

    def packed(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def one_by_one(self, words: list[str]) -> list[bytes]:
        return [self.packed(e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def spaced(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters with a space before each: encoded many in a row, and told apart by the tokens
        that begin with the space, of which each word has one."""
        texts = ["".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        out: list[bytes] = []
        for i, e in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            some, ids = words[i * TOGETHER : (i + 1) * TOGETHER], np.array(e.ids)
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) == len(some) and (not len(ids) or starts[0] == 0):
                data, edges = ids.astype(self.dtype).tobytes(), [*(starts * self.id_bytes).tolist(), len(ids) * self.id_bytes]
                out += [data[s:e] for s, e in zip(edges[:-1], edges[1:], strict=True)]
            else:
                out += self.one_by_one(some)
        return out

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece. A piece of plain characters is cut where the vocabulary's own pattern cuts it."""
        simple, find = SIMPLE.fullmatch if self.cuts else lambda p: None, WORDS.findall
        cut = [find(p) if simple(p) else [p] for p in pieces]
        words, spaced, others = self.words, [], []
        for w in set(chain.from_iterable(cut)).difference(words):
            (spaced if w[:1] == " " and w[1:].isalpha() else others).append(w)
        words.update(zip(spaced, self.spaced(spaced), strict=True))
        words.update(zip(others, self.one_by_one(others), strict=True))
        out = [words[c[0]] if len(c) == 1 else b"".join([words[w] for w in c]) for c in cut]
        for word in [w for w in chain(spaced, others) if len(w) > LONGEST_PIECE]:
            del words[word]
        if len(words) > PIECES:
            words.clear()
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, with the end id, as bytes. Equal pieces of the texts are looked up once."""
        known = self.after_space
        if len(known) > PIECES:
            known.clear()
        # A text with odd spaces is cut by its own pattern, one piece at a time.
        odd = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, ODD)))
        whole = {int(i): b"".join(self.pieces(CUT.split(texts[int(i)].as_py()))) for i in odd}
        if whole:
            texts = pa.array([None if i in whole else t for i, t in enumerate(texts.to_pylist())], texts.type).fill_null("")
        parts = pc.split_pattern(texts, " ")
        first, coded = np.asarray(parts.offsets)[:-1], parts.values.dictionary_encode()
        pieces, at = coded.dictionary.to_pylist(), np.asarray(coded.indices).copy()
        ids = list(map(known.get, pieces))
        plain, mixed = [], []
        for p, x in zip(pieces, ids, strict=True):
            if x is None:
                (plain if p.isalpha() else mixed).append(p)
        fresh = dict(zip(plain, self.spaced([" " + p for p in plain]), strict=True))
        fresh.update(zip(mixed, self.pieces([" " + p for p in mixed]), strict=True))
        ids = [fresh[p] if x is None else x for p, x in zip(pieces, ids, strict=True)]
        known.update(fresh)
        for p in [p for p in fresh if len(p) > LONGEST_PIECE]:
            del known[p]
        # What begins a text has no space before it: each text's first piece is an entry of its own.
        heads = self.pieces(parts.values.take(pa.array(first)).to_pylist())
        for i, x in whole.items():
            heads[i] = x
        ids += heads
        at[first] = len(pieces) + np.arange(len(texts))
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // self.id_bytes
        starts, values, lengths = np.cumsum(sizes, dtype=np.int32) - sizes, np.frombuffer(b"".join(ids), self.dtype), sizes[at]
        ends = np.cumsum(lengths, dtype=np.int32)
        place = np.repeat(starts[at] - ends + lengths, lengths)
        place += np.arange(len(place), dtype=np.int32)
        out = values[place].tobytes()
        edges = np.r_[0, ends[np.r_[first[1:], len(at)] - 1].astype(np.int64)] * self.id_bytes
        return [out[s:e] + self.end for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def chunks(batch: pa.RecordBatch):
    """Slices of a batch with about ``AT_ONCE`` bytes of text each; a longer text stands alone."""
    ends, start = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)).astype(np.int64)), 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + AT_ONCE, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


SEGMENTS = "part int, seq int, n_docs long, n_ids long, before long, doc_ids array<bigint>, file binary"


def write(docs: DataFrame, path: str, vocabulary_path: str | None = None) -> None:
    """Writes the segments of ``docs`` (doc_id, text) to the table ``path``, in ascending doc_id order."""
    spark = docs.sparkSession
    with open(vocabulary_path or default_vocabulary(), encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        gc.disable()  # nothing here is cyclic, and the remembered pieces are many to visit
        try:
            yield from segments(batches)
        finally:
            gc.enable()

    def segments(batches):
        encoder = Encoder.here(vocabulary.value)
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        held: list[bytes] = []
        size = 0

        def segment():
            n = size // encoder.id_bytes
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": [len(held)], "n_ids": [n], "before": [before], "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())), "file": [write_segment(held, encoder.id_bytes)]}
            )

        for batch in batches:
            for some in chunks(batch):
                ids = encoder.encode(some.column("text").fill_null(""))
                for doc_id, data in zip(some.column("doc_id").to_pylist(), ids, strict=True):
                    doc_ids.append(doc_id)
                    held.append(data)
                    size += len(data)
                    if size >= SEGMENT_IDS * encoder.id_bytes:
                        yield segment()
                        seq, before = seq + 1, before + size // encoder.id_bytes
                        doc_ids, held, size = [], [], 0
        if held:
            yield segment()

    ranged.mapInArrow(run, SEGMENTS).write.mode("errorifexists").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document of the table ``path``."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("base"))
    rows = segments.join(bounded(parts, MAX_PARTS), F.col("part") == F.col("_part")).select((F.col("base") + F.col("before")).alias("base"), "doc_ids", "file")

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                segment = Segment(batch.column("file")[row].as_py())
                ends = np.array([segment.ends.select(i) for i in range(segment.n)], np.int64)
                starts = np.r_[0, ends[:-1]]
                wide = segment.array.astype("<u4")
                crcs = [zlib.crc32(wide[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[row].values, pa.array(starts + batch.column("base")[row].as_py()), pa.array(ends - starts), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def written_and_read(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """Writes the table of ids to a new place in the shared folder, and reads the digests of its documents back."""
    path = f"{shared_folder(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    write(docs, path, vocabulary_path)
    return read(docs.sparkSession, path)
