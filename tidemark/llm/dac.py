"""Token ids on disk as directly addressable codes.

An id is cut into bytes, lowest first.  Level k holds the k-th byte of every id
that has one, a bitmap says which of these go on in the next level, and a
directory counts the set bits ahead of every block of it.  So the place of an
id's next byte is a rank, and any id is read from a few bytes without decoding
its neighbours.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.bpe_count import byte_symbols
from tidemark.llm.prefix import running_totals
from tidemark.llm.tasks import map_batches, map_stream
from tidemark.llm.tokenizing import KNOWN, MAX_CACHED, PIECE, UNUSUAL, load, public_path
from tidemark.storage import new_folder

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
SEGMENT_IDS = 1 << 20  # a segment is closed at the first document end after so many ids
MAGIC = b"DAC1"
BLOCK = 512  # bits per directory entry
_encoders: dict[str, "PieceEncoder"] = {}


def dac_encode(ids: np.ndarray) -> bytes:
    """One self-contained code: header, then chunks, continuation bits and directory of each level."""
    rest, levels = np.asarray(ids, dtype=np.uint32), []
    while True:
        more = rest > 255
        levels.append(((rest & 255).astype(np.uint8), more))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    out = [struct.pack("<4sI", MAGIC, len(levels)), struct.pack(f"<{len(levels)}Q", *[len(c) for c, _ in levels])]
    for k, (chunks, more) in enumerate(levels):
        out.append(chunks.tobytes())
        if k + 1 < len(levels):
            bits = np.packbits(more, bitorder="little")
            ahead = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64))])
            out += [bits.tobytes(), ahead[:-1].astype("<u8").tobytes()]
    return b"".join(out)


class Dac:
    """A view of one code."""

    def __init__(self, code: bytes):
        magic, levels = struct.unpack_from("<4sI", code)
        if magic != MAGIC:
            raise ValueError("not a directly addressable code")
        sizes = struct.unpack_from(f"<{levels}Q", code, 8)
        at, self.levels = 8 + 8 * levels, []
        for k, n in enumerate(sizes):
            chunks = np.frombuffer(code, np.uint8, n, at)
            at += n
            bits = ahead = None
            if k + 1 < levels:
                bits = np.frombuffer(code, np.uint8, (n + 7) // 8, at)
                at += len(bits)
                ahead = np.frombuffer(code, "<u8", (n + BLOCK - 1) // BLOCK, at)
                at += 8 * len(ahead)
            self.levels.append((chunks, bits, ahead))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """Id ``i``: a byte and a rank per level, nothing else is read."""
        value, shift = 0, 0
        for chunks, bits, ahead in self.levels:
            value |= int(chunks[i]) << shift
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                return value
            block, shift = i // BLOCK, shift + 8
            inside = int.from_bytes(bits[block * BLOCK // 8 : (i >> 3) + 1].tobytes(), "little")
            i = int(ahead[block]) + (inside & ((1 << (i - block * BLOCK)) - 1)).bit_count()
        return value

    def ids(self) -> np.ndarray:
        """All ids."""
        values = np.zeros(0, dtype=np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            here = chunks.astype(np.uint32)
            if bits is not None:
                here[np.unpackbits(bits, count=len(here), bitorder="little").view(bool)] |= values << np.uint32(8)
            values = here
        return values


class PieceEncoder(dict):
    """Encodes whole texts with the library, each distinct piece once.

    The mapping holds the ids of pieces.  A piece that is one cut of the
    pattern goes straight to the library's merges, any other to the whole
    library, as does a text with a special string or odd white space.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.merges = self.tokenizer.model
        self.characters = dict(enumerate(byte_symbols()))
        names = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([UNUSUAL.pattern, *names]))

    def _library(self, text: str) -> bytes:
        (made,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(made.ids, dtype="<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        if KNOWN.match(piece):
            symbols = piece.encode().decode("latin-1").translate(self.characters)
            ids = np.array([t.id for t in self.merges.tokenize(symbols)], dtype="<u4").tobytes()
        else:
            ids = self._library(piece)
        self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if self.whole.search(text):
            return self._library(text)
        if len(self) > MAX_CACHED:
            self.clear()
        return b"".join(map(self.__getitem__, PIECE.findall(text)))


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for a file; it outlives the task."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def write_token_ids(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every whole text, ``end_id`` after each, in ascending id order.

    Texts are dealt out by id range, so a task's segments follow each other and
    tasks follow each other by number.  A segment is one row: its place
    (``part``, ``seq``), ids and token counts of its documents, and the code;
    Spark's writer commits it whole or not at all.  A null text is empty, null
    ids come first, rows of equal id are in text order, other columns play no
    part, an empty table makes an empty folder of files.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    rows = rows.repartitionByRange(order[0]).sortWithinPartitions(*order)
    end = np.array([end_id], dtype="<u4").tobytes()

    def work(batches):
        pieces = encoder(vocabulary if "/" in vocabulary else public_path(vocabulary))
        part, seq = TaskContext.get().partitionId(), 0
        names, lengths, held = [], [], bytearray()

        def segment():
            return {
                "part": [part],
                "seq": [seq],
                "n_ids": [len(held) // 4],
                "doc_ids": [names],
                "doc_tokens": [lengths],
                "code": [dac_encode(np.frombuffer(bytes(held), dtype="<u4"))],
            }

        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = pieces.encode(text or "") + end
                held += ids
                names.append(name)
                lengths.append(len(ids) // 4)
                if len(held) >= 4 * segment_ids:
                    yield segment()
                    names, lengths, held, seq = [], [], bytearray(), seq + 1
        if names:
            yield segment()

    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"part int, seq long, n_ids long, doc_ids array<{id_type}>, doc_tokens array<long>, code binary"
    map_stream(rows, work, schema).write.option("parquet.block.size", 16 << 20).parquet(path)


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """``part, seq, n_ids, before_n_ids``: how many ids lie ahead of each segment."""
    return running_totals(spark.read.parquet(path).select("part", "seq", "n_ids"), [], ["part", "seq"], ["n_ids"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is over
    its decoded ids as little-endian 32-bit numbers.
    """
    files = spark.read.parquet(path)

    def work(batch):
        out = {k: [] for k in ("part", "seq", "doc_id", "local", "n_tokens", "ids_crc32")}
        for row in batch.to_pylist():
            ids, at = Dac(row["code"]).ids().astype("<u4").tobytes(), 0
            for name, n in zip(row["doc_ids"], row["doc_tokens"]):
                for key, value in zip(out, (row["part"], row["seq"], name, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]))):
                    out[key].append(value)
                at += n
        return out

    id_type = files.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"part int, seq long, doc_id {id_type}, local long, n_tokens long, ids_crc32 long"
    rows = map_batches(files.select("part", "seq", "doc_ids", "doc_tokens", "code"), work, schema)
    starts = segment_starts(spark, path).select("part", "seq", "before_n_ids")
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("before_n_ids") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def read_tokens(spark: SparkSession, path: str, places: Sequence[int]) -> DataFrame:
    """``place, id`` of single tokens; only the segments that hold one are read, and none is decoded."""
    inside = [F.when((F.col("before_n_ids") <= p) & (F.col("before_n_ids") + F.col("n_ids") > p), F.lit(p)) for p in places]
    wanted = segment_starts(spark, path).select("part", "seq", "before_n_ids", F.array_compact(F.array(*inside)).alias("places"))
    rows = spark.read.parquet(path).select("part", "seq", "code").join(wanted.filter(F.size("places") > 0), ["part", "seq"])

    def work(batch):
        out = {"place": [], "id": []}
        for row in batch.to_pylist():
            code = Dac(row["code"])
            for place in row["places"]:
                out["place"].append(place)
                out["id"].append(code[place - row["before_n_ids"]])
        return out

    return map_batches(rows.select("code", "before_n_ids", "places"), work, "place long, id long")


def encoded_documents(docs: DataFrame, **options) -> DataFrame:
    """Write the ids of ``docs`` to a folder of the session's and read its documents back."""
    path = new_folder(docs.sparkSession, "token-ids")
    write_token_ids(docs, path, **options)
    return read_documents(docs.sparkSession, path)
