"""Token ids in seekable files: independent zstandard frames and a trailing seek table.

A file holds, one after another: zstandard frames of FRAME bytes of ids
(little-endian, 2 bytes an id where the vocabulary allows, else 4), one
skippable frame with the document index (ids, starts and lengths of the file's
documents), and one skippable frame with the public seekable-format table: each
frame's compressed size, size and checksum (low 32 bits of XXH64). A reader
takes the table from the file's end and decompresses only the frames that a
wanted document touches; each is checked.

Documents lie in ascending id order (null first; equal ids by text hash) over
files named by partition, and a manifest lists the files with their first
token's global position. Every file is written under a name of the attempt's
own and renamed, so retried or repeated tasks leave one whole file.

Null and empty texts have no ids but the end id. An empty table gives no
documents. Any number of documents may share an id.
"""

from __future__ import annotations

import json
import os
import struct
from bisect import bisect_left

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import PieceStore
from .shared import file_system, kept, mapped, new_folder, put_file, small_batches

VOCABULARY = "byte_bpe_50k.json"
FRAME = 1 << 18
FILE_BYTES = 256 << 20  # input bytes a file, about
LEVEL = 1
SEEK_MAGIC, SKIP_SEEK, SKIP_INDEX = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50


class Encoder:
    """A process's tokenizer. texts gives the ids of each text as bytes of width bytes an id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 65536 else 4
        self.added = [t["content"] for t in kind["added_tokens"]]
        before = kind["pre_tokenizer"] or {}
        self.by_pieces = kind["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        # The byte-level alphabet: a printable Latin-1 byte is itself, the others are the code points from 256 on, in order.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.alphabet = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}
        self.store = PieceStore(public_tokenizers.PATTERN, self._encode_pieces)

    def _encode_pieces(self, pieces: list[str]):
        """The library's model on single pieces, which are spelt in the byte-level alphabet as its pre-tokenizer spells them."""
        model, alphabet, width = self.tokenizer.model.tokenize, self.alphabet, self.width
        for p in pieces:
            yield b"".join([t.id.to_bytes(width, "little") for t in model(p.encode("utf-8", "surrogatepass").decode("latin-1").translate(alphabet))])

    def _encode(self, texts: list[str]):
        kind = f"<u{self.width}"
        for s in range(0, len(texts), 20_000):
            for e in self.tokenizer.encode_batch_fast(texts[s : s + 20_000], add_special_tokens=False):
                yield np.array(e.ids, kind).tobytes()

    def texts(self, texts: list[str]) -> list[bytes]:
        whole = [k for k, t in enumerate(texts) if not self.by_pieces or any(x in t for x in self.added)]
        if not whole:
            return self.store.texts(texts)
        asked = set(whole)
        out = self.store.texts(["" if k in asked else t for k, t in enumerate(texts)])
        for k, ids in zip(whole, self._encode([texts[k] for k in whole])):
            out[k] = ids
        return out


# ---- one file


class FrameWriter:
    """Turns documents into the file's chunks, in order."""

    def __init__(self, width: int):
        self.width, self.buffer, self.table = width, bytearray(), []
        self.ids: list = []
        self.counts: list[int] = []
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, doc, ids: np.ndarray):
        return self.add_raw(doc, ids.astype(f"<u{self.width}").tobytes())

    def add_raw(self, doc, ids: bytes):
        """ids: width bytes each."""
        self.ids.append(doc)
        self.counts.append(len(ids) // self.width)
        self.buffer += ids
        while len(self.buffer) >= FRAME:
            yield self._frame(bytes(self.buffer[:FRAME]))
            del self.buffer[:FRAME]

    def _frame(self, raw: bytes) -> bytes:
        done = self.compressor.compress(raw)
        self.table.append((len(done), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        return done

    def end(self):
        if self.buffer:
            yield self._frame(bytes(self.buffer))
        ids = np.array([-(2**63) if i is None else i for i in self.ids], "<i8")
        counts = np.array(self.counts, "<i8")
        index = self.compressor.compress(struct.pack("<IQ", self.width, len(ids)) + ids.tobytes() + counts.tobytes())
        yield struct.pack("<II", SKIP_INDEX, len(index)) + index
        body = b"".join(struct.pack("<III", *row) for row in self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEK_MAGIC)
        yield struct.pack("<II", SKIP_SEEK, len(body)) + body


class FrameReader:
    """Random access to one file's documents; frames stay compressed until a document needs them."""

    def __init__(self, source, size: int):
        self.source = source
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError("no seek table")
        body = self._at(size - 9 - 12 * count, 12 * count)
        self.table = np.frombuffer(body, "<u4").reshape(count, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.raw = np.concatenate([[0], np.cumsum(self.table[:, 1])])
        magic, length = struct.unpack("<II", self._at(int(self.offsets[-1]), 8))
        if magic != SKIP_INDEX:
            raise ValueError("no document index")
        self.decompressor = zstandard.ZstdDecompressor()
        index = self.decompressor.decompress(self._at(int(self.offsets[-1]) + 8, length))
        self.width, n = struct.unpack_from("<IQ", index)
        self.ids = np.frombuffer(index, "<i8", n, 12)
        self.counts = np.frombuffer(index, "<i8", n, 12 + 8 * n)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.frames_read, self._held = 0, (-1, b"")

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def _frame(self, k: int) -> bytes:
        if self._held[0] != k:
            raw = self.decompressor.decompress(self._at(int(self.offsets[k]), int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
            if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self.frames_read += 1
            self._held = (k, raw)
        return self._held[1]

    def document(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document."""
        start, end = int(self.starts[k]) * self.width, int(self.starts[k + 1]) * self.width
        parts, f = [], int(np.searchsorted(self.raw, start, "right")) - 1
        while start < end:
            upto = min(end, int(self.raw[f + 1]))
            parts.append(self._frame(f)[start - int(self.raw[f]) : upto - int(self.raw[f])])
            start, f = upto, f + 1
        return np.frombuffer(b"".join(parts), f"<u{self.width}").astype("<u4")


# ---- a folder of files


def write_tokens(df: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, folder: str | None = None, end_id: int = 0, files: int | None = None) -> str:
    """Encode every text, append end_id, write the files and manifest.json; returns the folder."""
    spark = df.sparkSession
    vocabulary = path or public_tokenizers.path(VOCABULARY)
    out = folder or new_folder(spark, "tokens")
    rows = df.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"), F.xxhash64(F.col(text)).alias("_hash"))
    files = files or _files(rows)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = kept(f"tokens {vocabulary}", lambda: Encoder(vocabulary))
        width = encoder.width if end_id < 65536 else 4
        writer, end = FrameWriter(width), np.array([end_id], f"<u{width}").tobytes()

        def chunks():
            for batch in batches:
                for piece in small_batches([batch], 256):
                    texts = encoder.texts([t or "" for t in piece.column(1).to_pylist()])
                    if width != encoder.width:
                        texts = [np.frombuffer(x, f"<u{encoder.width}").astype(f"<u{width}").tobytes() for x in texts]
                    for doc, ids in zip(piece.column(0).to_pylist(), texts):
                        yield from writer.add_raw(doc, ids + end)
            yield from writer.end()

        name = f"part-{part:06d}.ids.zst"
        size = put_file(f"{out}/{name}", chunks())
        ids = writer.ids or [None]
        yield {"file": [name], "part": [part], "documents": [len(writer.ids)], "tokens": [sum(writer.counts)], "bytes": [size], "first": [ids[0]], "last": [ids[-1]]}

    ordered = rows.repartitionByRange(files, "_id", "_hash").sortWithinPartitions("_id", "_hash")  # an id of many rows is many tasks' work
    schema = "file string, part int, documents long, tokens long, bytes long, first long, last long"
    parts = sorted(mapped(ordered, run, schema).collect(), key=lambda r: r["part"])
    position, manifest = 0, []
    for r in parts:
        manifest.append(r.asDict() | {"start": position})
        position += r["tokens"]
    put_file(f"{out}/manifest.json", iter([json.dumps({"vocabulary": os.path.basename(vocabulary), "files": manifest}).encode()]))
    return out


def _files(rows: DataFrame) -> int:
    """One file a shuffle partition, or more where the input is estimated to hold over FILE_BYTES a file; no estimate counts as small."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // FILE_BYTES if size < 1 << 60 else 0)


def read_tokens(spark: SparkSession, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, ids): every document of the folder, or those with wanted ids only; ids as little-endian unsigned 32-bit binary, start the number of ids before the document in the whole folder."""
    where, path = file_system(folder)
    with where.open_input_stream(f"{path}/manifest.json") as f:
        files = json.loads(f.read())["files"]
    if wanted is not None:
        wanted = sorted(set(wanted))
        files = [f for f in files if f["last"] is not None and (k := bisect_left(wanted, -(2**63) if f["first"] is None else f["first"])) < len(wanted) and wanted[k] <= f["last"]]

    def run(batches):
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                where, path = file_system(f"{folder}/{name}")
                with where.open_input_file(path) as source:
                    reader = FrameReader(source, where.get_file_info(path).size)
                    docs = range(len(reader.ids)) if wanted is None else np.flatnonzero(np.isin(reader.ids, wanted)).tolist()
                    at, held = [], 0
                    out: list[bytes] = []
                    for k in docs:
                        out.append(reader.document(k).tobytes())
                        at.append(k)
                        held += len(out[-1])
                        if held > 1 << 23:
                            yield _rows(reader, at, out, before)
                            at, out, held = [], [], 0
                    if at:
                        yield _rows(reader, at, out, before)

    kinds = "file string, start long"
    listed = spark.createDataFrame([(f["file"], f["start"]) for f in files if f["documents"]], kinds)
    spread = listed.repartition(max(1, min(len(files), int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return mapped(spread, run, "doc_id long, start long, ids binary")


def _rows(reader: FrameReader, at: list[int], ids: list[bytes], before: int) -> dict:
    docs = reader.ids[at]
    return {"doc_id": pa.array(docs, mask=docs == -(2**63)), "start": reader.starts[:-1][at] + before, "ids": ids}
