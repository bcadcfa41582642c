"""Token-id files of directly addressable codes.

Every id is cut into chunks. A level holds one chunk of each id that reaches it, a bitmap of
the ids that continue on the next level and a rank directory over the bitmap; the place of an
id on the next level is its rank among the continuing ones. So any token of a file is read
from one chunk a level, without decoding what stands before it.

Texts are dealt by range of id and sorted, each task encodes its own and writes files of
about ``shard_tokens`` ids. A file gets its name from a fresh uuid and counts only once its
row is in the manifest, which Spark commits; files of failed attempts are never read.

Layout of a file, all little-endian: ``DAC1``, u32 header length, JSON header (number of
documents and tokens, chunk widths, array sizes), then document ids (i64), flags of null ids
(u8), token offsets (u64, one more than documents), then for each level chunks (u8 or u16),
bitmap (u8, bit i of the level at byte i // 8, low bits first) and directory (u32 counts
of set bits before each 512 bits).

Defined cases: null text counts as empty; a document always has its end id; null ids come
first; rows that share an id stand in order of a hash of their texts; an empty table gives no files.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common
from .encoder import encoder

MAGIC = b"DAC1"
RANK_BITS = 512
WIDTHS = (8, 8, 16)
#: Characters encoded at a time; for each piece the table of known words is hashed.
CHARS = 1_000_000


def packed(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, directory) of each level that any id reaches."""
    rest, levels = ids.astype(np.uint32), []
    for k, width in enumerate(widths):
        chunk = (rest & np.uint32((1 << width) - 1)).astype("<u2" if width > 8 else np.uint8)
        rest = rest >> np.uint32(width)
        more = rest > 0
        if k == len(widths) - 1 and more.any():
            raise ValueError("an id is too large for the chunk widths")
        bits = np.packbits(more, bitorder="little")
        words = np.zeros(-(-len(bits) // (RANK_BITS // 8)) * (RANK_BITS // 8), np.uint8)
        words[: len(bits)] = bits
        per = np.bitwise_count(words).reshape(-1, RANK_BITS // 8).sum(1, dtype=np.int64)
        levels.append((chunk, bits, (np.cumsum(per) - per).astype("<u4")))
        rest = rest[more]
        if not len(rest):
            break
    return levels


def to_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """A file of documents with ``counts`` ids each."""
    levels = packed(ids, widths)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    parts = [np.array([d or 0 for d in doc_ids], "<i8"), nulls, np.append(0, np.cumsum(counts)).astype("<u8")]
    for level in levels:
        parts += level
    head = json.dumps({"docs": len(doc_ids), "tokens": len(ids), "widths": widths[: len(levels)], "sizes": [[len(x) for x in level] for level in levels]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *[x.tobytes() for x in parts]])


class Reader:
    """Random access to a file's tokens; holds the file's bytes, decodes nothing ahead."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        size = struct.unpack_from("<I", data, 4)[0]
        self.head, self._data, self._at = json.loads(data[8 : 8 + size]), data, 8 + size
        n = self.head["docs"]
        self.doc_ids, self.nulls, self.offsets = self._take("<i8", n), self._take(np.uint8, n), self._take("<u8", n + 1).astype(np.int64)
        self.levels = [(self._take("<u2" if w > 8 else np.uint8, a), self._take(np.uint8, b), self._take("<u4", c)) for w, (a, b, c) in zip(self.head["widths"], self.head["sizes"], strict=True)]

    def _take(self, kind, n: int) -> np.ndarray:
        out = np.frombuffer(self._data, kind, n, self._at)
        self._at += out.nbytes
        return out

    def __len__(self) -> int:
        return self.head["tokens"]

    def rank(self, level: int, at: int) -> int:
        """Set bits of a level before bit ``at``."""
        _, bits, directory = self.levels[level]
        block = min(at // RANK_BITS, len(directory) - 1)
        whole = bits[block * RANK_BITS // 8 : at // 8]
        part = int(bits[at // 8]) & ((1 << at % 8) - 1) if at % 8 else 0
        return int(directory[block]) + int(np.bitwise_count(whole).sum()) + part.bit_count()

    def __getitem__(self, at: int) -> int:
        """One token."""
        out, shift = 0, 0
        for k, width in enumerate(self.head["widths"]):
            chunks, bits, _ = self.levels[k]
            out |= int(chunks[at]) << shift
            if not bits[at // 8] >> (at % 8) & 1:
                break
            at, shift = self.rank(k, at), shift + width
        return out

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Tokens from ``start`` to ``end``: the first place of each level by rank, the others follow."""
        out, shift = np.zeros(end - start, np.uint32), 0
        if not len(out):
            return out
        here, a, b = np.arange(end - start), start, end
        for k, width in enumerate(self.head["widths"]):
            chunks, bits, _ = self.levels[k]
            out[here] |= chunks[a:b].astype(np.uint32) << np.uint32(shift)
            more = np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            here, shift = here[more], shift + width
            if not len(here):
                break
            a = self.rank(k, a)
            b = a + len(here)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.offsets[k]), int(self.offsets[k + 1]))


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI as Hadoop writes it."""
    scheme, sep, rest = path.partition("://")
    if not sep and path.startswith("file:"):
        scheme, sep, rest = "file", "://", "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + sep + rest)


def written(docs: DataFrame, path: str, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = 2, shard_tokens: int = 1 << 21) -> DataFrame:
    """Write token files under ``path``, a folder of a file system that all executors reach
    (local, HDFS, S3, ABFS or GCS; a path without a scheme is of Hadoop's default one);
    returns their manifest (part, shard, file, docs, tokens, start), ``start`` being the
    number of tokens in all files before."""
    path = common.qualified(docs.sparkSession, path)
    def write(part, shard, ids, held, counts):
        where, folder = opened(path)
        where.create_dir(folder, recursive=True)
        name = f"{folder}/{part:08d}-{shard:06d}-{uuid.uuid4().hex}.dac"
        every, n = np.concatenate(held), int(sum(map(len, held)))
        held.clear()
        with where.open_output_stream(name) as out:
            out.write(to_bytes(ids, np.concatenate(counts), every))
        return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "file": name, "docs": len(ids), "tokens": n}], schema=arrow)

    arrow = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])

    def run(batches):
        own, shard, part, size = encoder(tokenizer), 0, 0, 0
        ids, held, counts = [], [], []
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            size_of, at = pc.utf8_length(texts).to_numpy(), 0
            while at < len(texts):  # a few MB at a time, one long text alone
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + size_of[to] <= min(CHARS, 2 * shard_tokens)):
                    chars += size_of[to]
                    to += 1
                got, n = own.encode(texts[at:to])
                ends = np.cumsum(n)
                held.append(np.insert(got, ends, end_id))
                counts.append(n + 1)
                ids += batch.column("id")[at:to].to_pylist()
                part, size, at = batch.column("part")[0].as_py(), size + len(held[-1]), to
                if size >= shard_tokens:
                    yield write(part, shard, ids, held, counts)
                    shard, size, ids, held, counts = shard + 1, 0, [], [], []
        if ids:
            yield write(part, shard, ids, held, counts)

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]  # the range's samples go to the driver: no texts
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumn("part", F.spark_partition_id())
    manifest = common.stored(common.mapped(rows, run, "part int, shard int, file string, docs long, tokens long"), "manifest")
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row for each task
    inside = F.sum("tokens").over(W.partitionBy("part").orderBy("shard")) - F.col("tokens")
    return manifest.withColumn("inside", inside).join(before, "part").select("part", "shard", "file", "docs", "tokens", (F.col("before") + F.col("inside")).alias("start"))


def dealt(manifest: DataFrame) -> DataFrame:
    """Files over so many tasks as a shuffle has, or over one each if they are fewer."""
    most = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(max(1, min(most, manifest.count())), "file")


def summaries(manifest: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from the files."""
    path = common.qualified(manifest.sparkSession, path)

    def run(batches):
        where, _ = opened(path)
        for batch in batches:
            for row in batch.to_pylist():
                with where.open_input_stream(row["file"]) as f:
                    own = Reader(f.read())
                crcs = np.zeros(len(own.doc_ids), np.int64)
                for at in range(0, len(crcs), 256):  # levels are walked once for so many documents
                    bounds = own.offsets[at : at + 257]
                    flat = memoryview(own.tokens(int(bounds[0]), int(bounds[-1])).astype("<u4").tobytes())
                    bounds = (bounds - bounds[0]) * 4
                    crcs[at : at + 256] = [zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                ids = pa.array(own.doc_ids, mask=own.nulls.astype(bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(own.offsets[:-1] + row["start"]), pa.array(np.diff(own.offsets)), pa.array(crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return dealt(manifest).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_lists(manifest: DataFrame, path: str) -> DataFrame:
    """(doc_id, tokens) of each document, read from the files."""
    path = common.qualified(manifest.sparkSession, path)

    def run(batches):
        where, _ = opened(path)
        for batch in batches:
            for row in batch.to_pylist():
                with where.open_input_stream(row["file"]) as f:
                    own = Reader(f.read())
                for at in range(0, len(own.doc_ids), 256):
                    to = min(at + 256, len(own.doc_ids))
                    flat = own.tokens(int(own.offsets[at]), int(own.offsets[to])).astype(np.int32)
                    tokens = pa.ListArray.from_arrays((own.offsets[at : to + 1] - own.offsets[at]).astype(np.int32), flat)
                    yield pa.RecordBatch.from_arrays([pa.array(own.doc_ids[at:to], mask=own.nulls[at:to].astype(bool)), tokens], ["doc_id", "tokens"])

    return dealt(manifest).mapInArrow(run, "doc_id long, tokens array<int>")
