"""Token ids as sorted-string-table shards.

A shard holds documents in ascending order of their identifier:

* data blocks of about BLOCK bytes: entries (shared key bytes, further key
  bytes, value bytes as varints, the key's rest, the value), keys prefix-
  compressed against the entry before, with a whole key every RESTART entries
  and the places of these at the end; each block compressed, with its CRC-32;
* a sparse index, a block in the same form: the last key of each data block with
  its place;
* a Bloom filter over the keys;
* a footer of fixed size: places of index and filter, numbers of documents and
  ids, bytes of an id, and a magic number.

A lookup asks the filter, searches the index and then one block by bisection.

Writing sorts the documents by ranges of the identifier; each task encodes its
range and writes its shards to the shared folder under a temporary name and
renames them to one made of the range and a number, and in a folder that was given of the run. Attempts of a task
give the same bytes, so the first that is there stays and no reader ever loses a
file that it has opened. Reading opens the files and takes a block at a time. The place where a shard's ids begin
among all ids comes from the shards' totals, a row each.

Defined cases: a null text is empty and has the end id alone; a null identifier
sorts first; rows with equal identifiers are kept, ordered by text; an empty
table has no shards and an empty result; a very long text is one entry in a
block of its own; other columns aren't read.
"""

from __future__ import annotations

import gc
import json
import os
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice
from pathlib import Path
from typing import Any

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import arrow_map, batch_of, resident, shared_folder, stored

MAGIC = b"QSSTAB01"
FOOTER = struct.Struct("<QQQQQQB7x8s")
BLOCK, RESTART, SHARD = 64 << 10, 16, 16 << 20
BITS_A_KEY, PROBES = 10, 7
#: Encoded pieces that a worker remembers before it drops those that came once.
REMEMBERED = 1_000_000
#: Words encoded as one line.
LINE = 100
#: Marks pieces at the start of a line; a text that holds it is encoded whole.
START = "\0"
LINE_START = f" \n {START}"
#: Documents in a batch that is read.
ROWS = 1_000
#: Documents encoded together.
TOGETHER, TOGETHER_CHARS = 512, 4 << 20


def cuts_at_spaces(file: dict[str, Any]) -> bool:
    """Whether a tokenizer file is a plain byte-level pair encoding: no normalizer, the usual expression, no options of the model, and no added token that is made of letters or holds white space."""
    model, cut = file.get("model") or {}, file.get("pre_tokenizer") or {}
    options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    added = file.get("added_tokens") or ()
    return (
        file.get("normalizer") is None
        and cut.get("type") == "ByteLevel"
        and not cut.get("add_prefix_space")
        and cut.get("use_regex", True)
        and model.get("type", "BPE") == "BPE"
        and not any(model.get(o) for o in options)
        and all(not t["content"].isalpha() and not any(c.isspace() for c in t["content"]) and not any(t.get(o) for o in ("lstrip", "rstrip", "single_word")) for t in added)
    )


class Encoder:
    """The ids that the tokenizers library gives, as packed little-endian integers.

    The byte-level pre-tokenizer never puts a token across a single space or
    newline between other characters, nor across a letter and a comma or full
    stop at the end of a piece. So the library encodes each piece between such places once,
    and the piece's ids are remembered. Pieces of Latin letters alone are one
    pre-token, so a second instance of the same vocabulary encodes them without
    looking for more. A text with any other white space is encoded whole.

    All of this holds for byte-level pair encodings that cut texts just so;
    cuts_at_spaces() looks at the file for it. With any other file whole texts are encoded.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        path = public_tokenizers.path(name)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        file = json.loads(Path(path).read_text(encoding="utf-8"))
        self.in_pieces = cuts_at_spaces(file)
        if not self.in_pieces:
            return
        model = file["model"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.letters = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0))
        # Words are encoded many in a line, each ended by a newline, which no merge joins to a letter.
        line = "\u010a"  # as the byte-level alphabet writes it; then space, tab and return
        joined = any(line in t and t.strip(line + "\u0120\u0109\u010d") for t in model["vocab"])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated" if joined else "merged_with_previous"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.newline, *stops = self._encode(["\n", ",", "."])
        self.stops = dict(zip(",.", stops, strict=True))
        self.pieces: dict[str, bytes | None] = {"\n": self.newline}
        self.again: set[str] = set()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.kind).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str], before: str) -> list[bytes]:
        """Ids of words of letters, each with what stands before it."""
        out, width, end = [], self.kind.itemsize, np.frombuffer(self.newline, self.kind)[0]
        lines = [before + f"\n{before}".join(words[i : i + LINE]) + "\n" for i in range(0, len(words), LINE)]
        for x in self.letters.encode_batch_fast(lines, add_special_tokens=False):
            numbers, at = np.array(x.ids, self.kind), 0
            ids = numbers.tobytes()
            for cut in (np.flatnonzero(numbers == end) * width).tolist():
                out.append(ids[at:cut])
                at = cut + width
        return out

    def _learn(self, new: set[str]) -> None:
        """Remembers new pieces, each with the space before it; those that begin a line start with START and have none."""
        pieces, plain, heads, other, stopped = self.pieces, [], [], [], []
        for p in new:
            stem = p
            if p[-1:] in self.stops:
                stem = p[:-1]
                if stem[-1:].isalpha():
                    stopped.append((p, stem))
                    if stem in pieces or stem in new:
                        continue
                else:
                    stem = p
            if stem.isalpha() and (stem.isascii() or max(stem) < "\u0180"):
                plain.append(stem)
            elif stem[:1] == START and (word := stem[1:]).isalpha() and (word.isascii() or max(word) < "\u0180"):
                heads.append(word)
            else:
                other.append(stem)
        pieces.update(zip(plain, self._encode_words(plain, " "), strict=True))
        pieces.update(zip([START + w for w in heads], self._encode_words(heads, ""), strict=True))
        for piece, ids in zip(other, self._encode([p[1:] if p[:1] == START else " " + p for p in other]), strict=True):
            bare = p if (p := piece.removeprefix(START)) else " "
            pieces[piece] = None if bare[0].isspace() or bare[-1].isspace() else ids
        for piece, stem in stopped:
            ids = pieces[stem]
            pieces[piece] = None if ids is None else ids + self.stops[piece[-1]]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.in_pieces:
            return self._encode(texts)
        gc.disable()  # nothing here forms cycles, and there are millions of pieces to look through
        try:
            return self._ids(texts)
        finally:
            gc.enable()

    def _ids(self, texts: list[str]) -> list[bytes]:
        split = [(START + t.replace("\n", LINE_START)).split(" ") for t in texts]
        every = set().union(*split)
        if len(self.pieces) + len(every) > REMEMBERED:  # only what came more than once stays
            kept = self.again if len(self.again) < REMEMBERED // 2 else ()
            self.pieces, self.again = {"\n": self.newline} | {p: self.pieces[p] for p in kept}, set()
        new = every.difference(self.pieces)
        if 2 * len(self.pieces) > REMEMBERED:
            self.again |= every - new
        self._learn(new)
        out, piece, whole = [], self.pieces.__getitem__, []
        for i, s in enumerate(split):
            try:
                out.append(b"".join(map(piece, s)) if START not in texts[i] else None)
            except TypeError:  # a piece that can't stand alone
                out.append(None)
            if out[i] is None:
                whole.append(i)
        for i, ids in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


def encoder(name: str) -> Encoder:
    """The worker's own; what it remembers serves its later tasks."""
    return resident(("encoder", name), lambda: Encoder(name))


def encode_key(key: int | None) -> bytes:
    """Bytes that sort as the identifiers do; null first."""
    return b"\0" if key is None else b"\1" + (key + (1 << 63)).to_bytes(8)


def decode_key(raw: bytes) -> int | None:
    return None if raw == b"\0" else int.from_bytes(raw[1:]) - (1 << 63)


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[at] & 127) << shift
        if b[at] < 128:
            return n, at + 1
        at, shift = at + 1, shift + 7


class BlockWriter:
    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.restarts: list[int] = []
        self.size = self.count = 0
        self.last = b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.count % RESTART:
            shared = len(os.path.commonprefix([key, self.last]))
        else:
            self.restarts.append(self.size)
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.parts.append(entry)
        self.size += len(entry)
        self.count += 1
        self.last = key

    def finish(self) -> bytes:
        raw = b"".join(self.parts) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
        packed = zstandard.compress(raw, 1)
        return packed + zlib.crc32(packed).to_bytes(4, "little")


class Block:
    """A block that was read: entries in order, and those of a key."""

    def __init__(self, stored_: bytes):
        packed, crc = stored_[:-4], int.from_bytes(stored_[-4:], "little")
        if zlib.crc32(packed) != crc:
            raise ValueError("a block's checksum doesn't match")
        self.raw = zstandard.decompress(packed)
        n = int.from_bytes(self.raw[-4:], "little")
        self.end = len(self.raw) - 4 * (n + 1)
        self.restarts = struct.unpack_from(f"<{n}I", self.raw, self.end)

    def entries(self, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < self.end:
            shared, at = _read_varint(self.raw, at)
            more, at = _read_varint(self.raw, at)
            size, at = _read_varint(self.raw, at)
            key = key[:shared] + self.raw[at : at + more]
            yield key, self.raw[at + more : at + more + size]
            at += more + size

    def seek(self, key: bytes) -> Iterator[tuple[bytes, bytes]]:
        """Entries from the first whose key isn't below key."""
        if not self.restarts:
            return
        i = bisect_left(self.restarts, key, key=lambda at: next(self.entries(at))[0])
        for k, v in self.entries(self.restarts[max(0, i - 1)]):
            if k >= key:
                yield k, v


def _bits(keys: list[bytes], m: int) -> np.ndarray:
    a, b = (np.array([xxhash.xxh64_intdigest(k, seed) for k in keys], np.uint64) for seed in (0, 1))
    return (a[:, None] + np.arange(PROBES, dtype=np.uint64) * (b | np.uint64(1))[:, None]) % np.uint64(m)


class Writer:
    """Collects entries in ascending order and gives the bytes of a shard."""

    def __init__(self, kind: np.dtype):
        self.kind, self.block, self.index = kind, BlockWriter(), BlockWriter()
        self.out: list[bytes] = []
        self.keys: list[bytes] = []
        self.size = self.ids = 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        self.block.add(key, value)
        self.keys.append(key)
        self.ids += len(value) // self.kind.itemsize
        if self.block.size >= BLOCK:
            self._flush()

    def _append(self, data: bytes) -> int:
        self.out.append(data)
        self.size += len(data)
        return self.size - len(data)

    def _flush(self) -> None:
        if self.block.count:
            data = self.block.finish()
            self.index.add(self.block.last, struct.pack("<QQ", self._append(data), len(data)))
            self.block = BlockWriter()

    def finish(self) -> bytes:
        self._flush()
        index = self.index.finish()
        m = max(64, -(-len(self.keys) * BITS_A_KEY // 8) * 8)
        bits = np.zeros(m, np.uint8)
        bits[_bits(list(dict.fromkeys(self.keys)), m).ravel()] = 1
        bloom = np.packbits(bits, bitorder="little").tobytes()
        at_index, at_bloom = self._append(index), self._append(bloom)
        self._append(FOOTER.pack(at_index, len(index), at_bloom, len(bloom), len(self.keys), self.ids, self.kind.itemsize, MAGIC))
        return b"".join(self.out)


class Reader:
    """A shard, from its bytes or from an open file, of which a block is read at a time."""

    def __init__(self, source: bytes | pa.NativeFile):
        self.source = source
        whole = len(source) if isinstance(source, bytes) else source.size()
        at, size, bloom, bloom_size, self.docs, self.ids, width, magic = FOOTER.unpack(self._read(whole - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.kind = np.dtype(f"<u{width}")
        self.blocks = [(k, *struct.unpack("<QQ", v)) for k, v in Block(self._read(at, size)).entries()]
        self.bloom = self._read(bloom, bloom_size)

    def _read(self, at: int, size: int) -> bytes:
        return self.source[at : at + size] if isinstance(self.source, bytes) else self.source.read_at(size, at)

    def _block(self, i: int) -> Block:
        _, at, size = self.blocks[i]
        return Block(self._read(at, size))

    def entries(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            yield from self._block(i).entries()

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[i >> 3] >> (i & 7) & 1 for i in _bits([key], 8 * len(self.bloom))[0].tolist())

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of each document with this identifier."""
        raw, out = encode_key(key), []
        if not self.may_hold(raw):
            return out
        for i in range(bisect_left(self.blocks, raw, key=lambda b: b[0]), len(self.blocks)):
            for k, v in self._block(i).seek(raw):
                if k != raw:
                    return out
                out.append(np.frombuffer(v, self.kind))
        return out


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts of several batches."""
    keys, texts, size = [], [], 0
    for b in batches:
        keys += b.column(0).to_pylist()
        texts += (new := b.column(1).to_pylist())
        size += sum(map(len, new))
        if len(keys) >= TOGETHER or size >= TOGETHER_CHARS:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def write_shards(df: DataFrame, tokenizer: str, end_id: int | None = 0, key: str = "doc_id", text: str = "text", folder: str | None = None) -> tuple[str, DataFrame]:
    """Writes the shards; returns their folder, which stays, and the table (shard, docs, ids), in order of the names."""
    spark = df.sparkSession
    run = f"{uuid.uuid4().hex[:12]}-" if folder else ""  # a folder of the caller's may hold shards of other runs
    folder = folder or shared_folder(spark, lasting=True)
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], encode.kind).tobytes()
        task, done, writer = TaskContext.get(), [], Writer(encode.kind)
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)

        def close() -> None:
            name = f"shard-{run}{task.partitionId():06d}-{len(done):04d}.sst"
            temporary = f"{base}/_{name}.{task.taskAttemptId()}"
            with where.open_output_stream(temporary, compression=None) as f:
                f.write(writer.finish())
            if where.get_file_info(f"{base}/{name}").type == fs.FileType.NotFound:
                where.move(temporary, f"{base}/{name}")
            else:  # of another attempt at the same range, with the same bytes
                where.delete_file(temporary)
            done.append((name, len(writer.keys), writer.ids))

        for keys, texts in _together(batches):
            for k, ids in zip(keys, encode(texts), strict=True):
                writer.add(encode_key(k), ids + end)
                if writer.size >= SHARD:
                    close()
                    writer = Writer(encode.kind)
        if writer.keys:
            close()
        if done:
            names, docs, ids = zip(*done, strict=True)
            yield batch_of({"shard": pa.array(names), "docs": pa.array(docs, pa.int64()), "ids": pa.array(ids, pa.int64())})

    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    return folder, stored(arrow_map(ordered, write, "shard string, docs bigint, ids bigint"))


def read_shards(spark: SparkSession, folder: str, shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32, shard[, ids]) for each document in the shards, read from their files a block at a time.

    start: the ids of all documents before it. ids_crc32: over little-endian
    unsigned 32-bit integers.
    """
    schema = "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint, shard string" + ", ids array<int>" * with_ids
    n = shards.count()
    if not n:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with where.open_input_file(f"{base}/{name}") as f:
                    shard = Reader(f)
                    entries = shard.entries()
                    while part := list(islice(entries, ROWS)):
                        keys, starts, sizes, sums, ids = [], [], [], [], []
                        for k, v in part:
                            own = np.frombuffer(v, shard.kind)
                            keys.append(decode_key(k))
                            starts.append(at)
                            sizes.append(len(own))
                            sums.append(zlib.crc32(own.astype("<u4").tobytes()))
                            if with_ids:
                                ids.append(own.astype(np.int32))
                            at += len(own)
                        got = {"key": pa.array(keys, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(sums, pa.int64()), "shard": pa.array([name] * len(keys), pa.string())}
                        yield batch_of(got | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}))

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each shard
    places = shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    return arrow_map(places.repartition(-(-n // 2)), read, schema)
