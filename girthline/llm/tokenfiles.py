"""Token ids in binary files: byte planes of fixed-size id blocks, each compressed with zstandard, and a chunk index.

A file holds the ids of a run of documents in ascending id order as unsigned 32-bit integers, cut into blocks of ``BLOCK`` ids:

    magic b"IDPLANE1"
    for each block: four byte planes (all lowest bytes, ..., all highest bytes), each one zstandard frame
    index: for each block 4 x uint32, the compressed sizes of its planes
    footer: uint64 number of ids, uint32 ids in a block, uint32 number of blocks, magic b"IDPLANE1"

So one block is read by its offset without its neighbours. Beside the files lies a Parquet manifest with one row for each
document: file, place of its first id in the file and in the whole output, and number of ids.

Each task writes one file under a name of its own attempt and reports it in the rows it returns; the manifest names only files
of tasks that ended well, so a lost executor or a repeated task leaves at worst a file that nothing names. The folder must be
one that all executors reach (local or shared disks and the object stores that pyarrow opens by URI).

A null text counts as empty and gives the end id alone. Rows without an id come first; rows with one id follow each other in the
order of their texts' hashes. Other columns are not looked at.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from girthline.llm import bytewords as B
from girthline.session import shared_folder

BLOCK, MAGIC, LEVEL = 1 << 16, b"IDPLANE1", 3
#: Pieces of text whose ids a worker remembers.
REMEMBERED, TOGETHER = 1 << 20, 256


class BlockWriter:
    """Appends ids to an open binary file in blocks of byte planes."""

    def __init__(self, out, block: int = BLOCK) -> None:
        self.out, self.block, self.waiting, self.held, self.n, self.sizes = out, block, [], 0, 0, []
        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress
        out.write(MAGIC)

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        self.n += len(ids)
        if self.held >= self.block:
            joined = np.concatenate(self.waiting)
            whole = len(joined) // self.block * self.block
            for at in range(0, whole, self.block):
                self._write(joined[at:at + self.block])
            self.waiting, self.held = [joined[whole:]], len(joined) - whole

    def _write(self, ids: np.ndarray) -> None:
        planes = np.ascontiguousarray(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T)
        packed = [self.pack(plane.tobytes()) for plane in planes]
        self.sizes.append([len(x) for x in packed])
        self.out.write(b"".join(packed))

    def close(self) -> None:
        if self.held:
            self._write(np.concatenate(self.waiting))
        self.out.write(np.array(self.sizes, "<u4").tobytes())
        self.out.write(struct.pack("<QII", self.n, self.block, len(self.sizes)) + MAGIC)
        self.out.close()


class BlockReader:
    """Ids of a file by place; holds one decoded block at a time."""

    def __init__(self, source, size: int) -> None:
        self.source = source
        source.seek(size - 24)
        self.n, self.block, blocks, magic = struct.unpack("<QII8s", source.read(24))
        if magic != MAGIC:
            raise ValueError("not a file of id planes")
        source.seek(size - 24 - 16 * blocks)
        self.sizes = np.frombuffer(source.read(16 * blocks), "<u4").reshape(-1, 4)
        self.starts = len(MAGIC) + np.concatenate(([0], np.cumsum(self.sizes.sum(axis=1, dtype=np.int64))))
        self.at, self.ids, self.unpack = -1, None, zstandard.ZstdDecompressor().decompress

    def _load(self, k: int) -> np.ndarray:
        if k != self.at:
            self.source.seek(int(self.starts[k]))
            planes, n = [], min(self.block, self.n - k * self.block)
            for size in self.sizes[k]:
                planes.append(np.frombuffer(self.unpack(self.source.read(int(size)), max_output_size=n), np.uint8))
            self.ids, self.at = np.ascontiguousarray(np.stack(planes).T).view("<u4").ravel(), k
        return self.ids

    def read(self, first: int, n: int) -> Iterator[np.ndarray]:
        """The ids from ``first`` on, block by block."""
        while n > 0:
            k, skip = divmod(first, self.block)
            piece = self._load(k)[skip:skip + n]
            yield piece
            first, n = first + len(piece), n - len(piece)


class PieceEncoder:
    """Ids of texts, each distinct piece encoded once by the tokenizer.

    Byte-level pre-tokens never go on over a space that a visible character follows, nor from an ASCII letter or digit to a
    punctuation mark, so a text's ids are those of its pieces cut at these places, one after the other. A slice that holds one of
    the tokenizer's added tokens is cut at spaces only. Ids of pieces met before come from a bounded memory, found by one hash and
    confirmed by a second one of its own: 128 bits, of which pieces of up to 8 bytes need only 64 and their length to be exact.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores; threads of its own would each hold memory
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode = tokenizer.encode_batch_fast
        end, apart = (tokenizer.encode(x, add_special_tokens=False).ids for x in ("\n", "a\n a\n"))
        self.line_end = end[0] if len(end) == 1 and apart.count(end[0]) == 2 else None
        self.added = [x.content.encode() for x in tokenizer.get_added_tokens_decoder().values()]
        self._forget()
        self.visible, self.letter, self.mark = (np.zeros(256, bool) for _ in range(3))
        self.visible[0x21:0x7F] = self.visible[0xC3:0xE1] = self.visible[0xE4:0xF5] = True
        self.letter[48:58] = self.letter[65:91] = self.letter[97:123] = True
        self.mark[0x21:0x7F] = ~self.letter[0x21:0x7F]

    def _forget(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.length, self.ids, self.second = [], [], [], []
        self.n_pieces = self.n_ids = 0

    def _unlike(self, raw: bytes, at: np.ndarray, slot: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces whose first hash is that of another piece, told by the second, are encoded by themselves."""
        for i in at.tolist():
            ids = np.array(self.encode([raw[starts[i]:ends[i]].decode()], add_special_tokens=False)[0].ids, np.uint32)
            for held, more in ((self.first, [self.n_ids]), (self.length, [len(ids)]), (self.ids, ids), (self.second, np.zeros(1, np.uint64))):
                held[:] = [np.concatenate((*held, np.asarray(more, held[0].dtype)))]
            slot[i] = self.n_pieces
            self.n_pieces += 1
            self.n_ids += len(ids)
        return slot

    def _learn(self, raw: bytes, new: np.ndarray, second: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        pieces = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
        # One call of the tokenizer for many pieces: a line end is a pre-token of its own between pieces without white space
        # but a leading space, so its id parts them. Other pieces go one by one.
        plain = np.fromiter((p[1:].split() == [p[1:]] and p[0] not in "\r\n\t\v\f" for p in pieces), bool, len(pieces)) & (self.line_end is not None)
        chosen = [p for p, ok in zip(pieces, plain.tolist()) if ok]
        joined = ["\n".join(chosen[i:i + TOGETHER]) + "\n" for i in range(0, len(chosen), TOGETHER)]
        stream = np.fromiter(chain.from_iterable(x.ids for x in self.encode(joined, add_special_tokens=False)), np.uint32)
        stops = np.flatnonzero(stream == self.line_end)
        single = [x.ids for x in self.encode([p for p, ok in zip(pieces, plain.tolist()) if not ok], add_special_tokens=False)]
        length = np.zeros(len(pieces), np.int64)
        length[plain] = np.diff(stops, prepend=-1) - 1
        length[~plain] = [len(x) for x in single]
        ids = np.zeros(int(length.sum()), np.uint32)
        from_stream = np.repeat(plain, length)
        ids[from_stream] = stream[stream != self.line_end]
        ids[~from_stream] = np.fromiter(chain.from_iterable(single), np.uint32)
        for held, more in ((self.first, self.n_ids + np.cumsum(length) - length), (self.length, length), (self.ids, ids), (self.second, second)):
            held[:] = [np.concatenate((*held, more))]
        at = np.searchsorted(self.known, new)
        self.known, self.slot = np.insert(self.known, at, new), np.insert(self.slot, at, self.n_pieces + np.arange(len(new)))
        self.n_pieces += len(new)
        self.n_ids += len(ids)

    def _new(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.ones(len(hashes), bool)
        return self.known[np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)] != hashes

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        for data, at in B.slices(column):
            raw = data.tobytes()
            cut = np.zeros(len(data) + 1, bool)
            if len(data):
                cut[:-2] = (data[:-1] == 32) & self.visible[data[1:]]
                if not any(x in raw for x in self.added):
                    cut[1:-1] |= self.letter[data[:-1]] & self.mark[data[1:]]
            cut[at] = True
            starts = np.flatnonzero(cut[:-1])
            if not len(starts):
                yield from (np.zeros(0, np.uint32) for _ in at[:-1])
                continue
            ends = np.append(starts[1:], len(data))
            hashed, second = (B.span_hashes(data, starts, ends, False, seed) for seed in (0, 1))
            hashes, place, which = np.unique(hashed, return_index=True, return_inverse=True)
            new = self._new(hashes)
            if len(self.known) + int(new.sum()) > REMEMBERED:
                self._forget()
                new = self._new(hashes)
            if new.any():
                self._learn(raw, hashes[new], second[place[new]], starts[place[new]], ends[place[new]])
            slot = self.slot[np.searchsorted(self.known, hashes)][which]
            slot = self._unlike(raw, np.flatnonzero(self.second[0][slot] != second), slot, starts, ends)
            first, length = self.first[0][slot], self.length[0][slot]
            total = np.concatenate(([0], np.cumsum(length)))
            ids = self.ids[0][np.repeat(first - total[:-1], length) + np.arange(total[-1])]
            bounds = total[np.searchsorted(starts, at)]
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                yield ids[a:b]


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


_encoders: dict[str, PieceEncoder] = {}


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, row_id: str = "doc_id", text: str = "text") -> None:
    """Encodes the documents into files below ``folder`` in ascending id order, with the manifest in ``folder``/manifest."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, encoder, n = None, _encoders.get(tokenizer), 0
        for batch in batches:
            if out is None:
                encoder = encoder or _encoders.setdefault(tokenizer, PieceEncoder(tokenizer))
                store, base = _open(folder)
                context = TaskContext.get()
                name = f"ids-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.planes"
                store.create_dir(base, recursive=True)
                out = BlockWriter(store.open_output_stream(f"{base}/{name}"))
            firsts, counts = [], []
            for ids in encoder.texts(batch.column("text")):
                out.add(np.append(ids, np.uint32(end_id)))
                firsts.append(n)
                counts.append(len(ids) + 1)
                n += counts[-1]
            where = pa.array([name] * len(counts)), pa.array([context.partitionId()] * len(counts), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), *where, pa.array(firsts, pa.int64()), pa.array(counts, pa.int64())], names=MANIFEST.names[:5])
        if out is not None:
            out.close()

    rows = docs.select(F.col(row_id).alias("row_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    MANIFEST = T.StructType([T.StructField("row_id", rows.schema["row_id"].dataType), *(T.StructField(n, t()) for n, t in (("file", T.StringType), ("part", T.IntegerType), ("first", T.LongType), ("n_tokens", T.LongType)))])
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "row_id", F.xxhash64("text")).sortWithinPartitions("row_id", F.xxhash64("text"))
    written = dealt.mapInArrow(encode, MANIFEST)
    written.write.parquet(f"{folder}/files")
    made = docs.sparkSession.read.parquet(f"{folder}/files")
    # One row for each file: its place in the whole output.
    ends = made.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    base = ends.select("file", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    made.join(base, "file").select("row_id", "file", "first", "n_tokens", (F.col("first") + F.col("base")).alias("start")).write.parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's ids read back from the files: ``row_id``, ``start``, ``n_tokens``, ``ids_crc32`` (of the ids as little-endian uint32)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        store, base = _open(folder)
        for batch in batches:
            sums = []
            for file, first, n in zip(*(batch.column(c).to_pylist() for c in ("file", "first", "n_tokens"))):
                if file != name:
                    source = store.open_input_file(f"{base}/{file}")
                    name, reader = file, BlockReader(source, source.size())
                crc = 0
                for piece in reader.read(first, n):
                    crc = zlib.crc32(np.ascontiguousarray(piece, "<u4"), crc)
                sums.append(crc)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], names=["row_id", "start", "n_tokens", "ids_crc32"])

    manifest = spark.read.parquet(f"{folder}/manifest")
    schema = T.StructType([manifest.schema["row_id"], *(T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32"))])
    # Neighbours in a file are read by one task; a range holds a part of a file or several, so large files are split.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartitionByRange(parts, "start").sortWithinPartitions("start").mapInArrow(check, schema)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes the token files into a fresh shared folder and reads them back."""
    folder = shared_folder(docs.sparkSession)
    write_token_files(docs, folder, tokenizer, end_id)
    return read_token_files(docs.sparkSession, folder)
