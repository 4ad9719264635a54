"""Token-id files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents, cut into blocks of a fixed number of
ids.  A block stores its minimum, the differences to it packed at the width that a
percentile of them needs, and the wider ones whole in an exception list (place and
value).  Behind the blocks lie the index of block starts, the documents' ids and
token counts, and a footer with the lengths.  ``manifest.json`` lists the files in order
with the ids before each, so any document or id range is found without a scan.

Documents are dealt by ranges of (doc_id, hash of the text), so files follow each
other in ascending doc_id order and one hot id cannot fill one file unless its rows
are equal.  Files are as many as the texts' bytes ask for.  A task writes under a name of its
own and then renames, so a task that runs again leaves one whole file; what lost tasks left is
deleted at the end.

Cases: null doc_ids come first; rows with the same doc_id are ordered by a hash of
their text; repeated rows are documents of their own; a null text is empty and has
the end id alone; an empty table has a manifest without files.  Other columns are
not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tokens import worker_encoder

#: Fixed values of the format.
MAGIC, BLOCK, PERCENTILE = b"PMTOK01\n", 512, 95
_HEAD, _FOOT = "<IBxHH", "<QQQQ8s"
_HEAD_SIZE, _FOOT_SIZE = struct.calcsize(_HEAD), struct.calcsize(_FOOT)


def _bits(v: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(v.astype(np.float64) + 1)).astype(np.int64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of unsigned values below 2**width to rows of bytes."""
    if not width:
        return np.zeros((len(values), 0), np.uint8)
    octets = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(*values.shape, 4)
    bits = np.unpackbits(octets, axis=-1, bitorder="little")[..., :width]
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(octets: np.ndarray, width: int, n: int) -> np.ndarray:
    if not width:
        return np.zeros((len(octets), n), "<u4")
    bits = np.unpackbits(octets, axis=1, bitorder="little")[:, : n * width].reshape(len(octets), n, width)
    whole = np.zeros((len(octets), n, 32), np.uint8)
    whole[..., :width] = bits
    return np.packbits(whole, axis=-1, bitorder="little").view("<u4").reshape(len(octets), n)


def encode_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> list[bytes]:
    """``ids`` (uint32) as blocks; all but the last hold :data:`BLOCK` ids."""
    out: list[bytes] = []
    full = len(ids) // BLOCK
    for matrix in (ids[: full * BLOCK].reshape(full, BLOCK), ids[full * BLOCK :].reshape(1, -1) if len(ids) % BLOCK else None):
        if matrix is None or not len(matrix):
            continue
        n = matrix.shape[1]
        low = matrix.min(axis=1)
        rest = matrix - low[:, None]
        at = min(n - 1, n * percentile // 100)
        widths = _bits(np.partition(rest, at, axis=1)[:, at])
        made: list[bytes] = [b""] * len(matrix)
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            part = rest[rows]
            wide = part >> np.uint32(width) > 0 if width < 32 else np.zeros_like(part, bool)
            packed = _pack(np.where(wide, 0, part), int(width))
            counts = wide.sum(axis=1)
            places, values = np.nonzero(wide)[1].astype("<u2"), part[wide].astype("<u4")
            ends = np.cumsum(counts)
            for k, row in enumerate(rows):
                a, b = ends[k] - counts[k], ends[k]
                made[row] = struct.pack(_HEAD, int(low[row]), int(width), n, int(counts[k])) + packed[k].tobytes() + places[a:b].tobytes() + values[a:b].tobytes()
        out += made
    return out


def decode_blocks(blocks: list[bytes]) -> np.ndarray:
    """The ids of some blocks, joined."""
    heads = [struct.unpack_from(_HEAD, b) for b in blocks]
    out = [np.zeros(0, "<u4")] * len(blocks)
    by_shape: dict[tuple[int, int], list[int]] = {}
    for k, (_, width, n, _) in enumerate(heads):
        by_shape.setdefault((width, n), []).append(k)
    for (width, n), ks in by_shape.items():
        size = (n * width + 7) // 8
        octets = np.stack([np.frombuffer(blocks[k], np.uint8, size, _HEAD_SIZE) for k in ks])
        values = _unpack(octets, width, n)
        for row, k in zip(values, ks):
            low, _, _, extra = heads[k]
            if extra:
                at = _HEAD_SIZE + size
                row[np.frombuffer(blocks[k], "<u2", extra, at)] = np.frombuffer(blocks[k], "<u4", extra, at + 2 * extra)
            out[k] = row + np.uint32(low)
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path within it, of a URL or a plain path; names that only Hadoop has for the same stores are known."""
    for name, plain in (("s3a://", "s3://"), ("s3n://", "s3://"), ("wasbs://", "abfss://")):
        path = path.replace(name, plain, 1) if path.startswith(name) else path
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class _Writer:
    def __init__(self, sink):
        self.sink, self.at, self.starts, self.held = sink, 0, [], np.zeros(0, "<u4")
        self.put(MAGIC)

    def put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.at += len(raw)

    def add(self, ids: list[np.ndarray], last: bool = False) -> None:
        self.held = np.concatenate([self.held, *ids])
        n = len(self.held) if last else len(self.held) // BLOCK * BLOCK
        for block in encode_blocks(self.held[:n]):
            self.starts.append(self.at)
            self.put(block)
        self.held = self.held[n:]

    def close(self, docs: np.ndarray, nulls: np.ndarray, counts: np.ndarray) -> None:
        self.add([], last=True)
        at = self.at
        self.put(np.array([*self.starts, at], "<u8").tobytes())
        self.put(docs.astype("<i8").tobytes() + nulls.astype(np.uint8).tobytes() + counts.astype("<u8").tobytes())
        self.put(struct.pack(_FOOT, at, len(self.starts), len(docs), int(counts.sum()), MAGIC))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = 1 << 26) -> list[dict]:
    """Writes the files and the manifest below ``path``; returns the manifest's entries.

    The manifest has one entry per file.  A file is for about ``file_bytes`` bytes of text, or for less,
    down to a sixty-fourth, where the cluster has more cores than files.
    """
    target, root = open_fs(path)
    target.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        where, base = open_fs(path)
        name, temp = f"part-{part:08d}.ids", f".{uuid.uuid4().hex}.tmp"
        encoder, end = worker_encoder(tokenizer), np.array([end_id], "<u4")
        docs_, nulls, counts = [], [], []  # arrays, one per batch
        sink = writer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                sink = where.open_output_stream(f"{base}/{temp}")
                writer = _Writer(sink)
            docs_.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            nulls.append(batch.column(0).is_null().to_numpy(zero_copy_only=False))
            for own in batched(encoder.arrays(batch.column(1)), 64):
                counts.append(np.array([len(x) + 1 for x in own], np.int64))
                writer.add([x for ids in own for x in (ids, end)])
        if writer is None:
            return
        sizes = np.concatenate(counts)
        writer.close(np.concatenate(docs_), np.concatenate(nulls), sizes)
        sink.close()
        where.move(f"{base}/{temp}", f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "docs": [len(sizes)], "ids": [int(sizes.sum())]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    files = max(1, -(-total // file_bytes), min(cores, -(-64 * total // file_bytes)))
    rows = rows.withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text")
    made = sorted(dealt.select("doc_id", "text").mapInArrow(run, "part long, file string, docs long, ids long").collect())
    manifest, before = [], 0
    for r in made:
        manifest.append({"file": r["file"], "docs": r["docs"], "ids": r["ids"], "ids_before": before})
        before += r["ids"]
    for left in target.get_file_info(pafs.FileSelector(root)):
        if left.base_name.endswith(".tmp"):
            target.delete_file(left.path)
    with target.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True, blocks_at_once: int = 256) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (``with_ids``) ids, per document, read from the files alone.

    ``start`` counts the ids of all documents before.  A task reads ``blocks_at_once`` blocks at a time.
    """
    source, root = open_fs(path)
    with source.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    if not manifest:
        return spark.createDataFrame([], schema)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.binary())] * with_ids]

    def documents(file: str, before: int) -> Iterator[tuple]:
        where, base = open_fs(path)
        with where.open_input_file(f"{base}/{file}") as f:
            size = f.size()
            at, n_blocks, n_docs, n_ids, magic = struct.unpack(_FOOT, f.read_at(_FOOT_SIZE, size - _FOOT_SIZE))
            if magic != MAGIC or f.read_at(len(MAGIC), 0) != MAGIC:
                raise ValueError(f"{file} is no token-id file")
            starts = np.frombuffer(f.read_at(8 * (n_blocks + 1), at), "<u8").astype(np.int64)
            at += 8 * (n_blocks + 1)
            names = np.frombuffer(f.read_at(8 * n_docs, at), "<i8")
            nulls = np.frombuffer(f.read_at(n_docs, at + 8 * n_docs), np.uint8)
            counts = np.frombuffer(f.read_at(8 * n_docs, at + 9 * n_docs), "<u8").astype(np.int64)
            held, k = np.zeros(0, "<u4"), 0
            for doc, null, n in zip(names.tolist(), nulls.tolist(), counts.tolist()):
                while len(held) < n:
                    to = min(n_blocks, k + blocks_at_once)
                    raw = f.read_at(int(starts[to] - starts[k]), int(starts[k]))
                    blocks = [raw[starts[i] - starts[k] : starts[i + 1] - starts[k]] for i in range(k, to)]
                    held, k = np.concatenate([held, decode_blocks(blocks)]), to
                ids, held = held[:n].tobytes(), held[n:]
                yield (None if null else doc, before, n, zlib.crc32(ids), *[ids] * with_ids)
                before += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, size = [], 0
                for row in documents(file, before):
                    rows.append(row)
                    size += 4 * row[2]
                    if size > 1 << 24 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(fields)})
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(fields)})

    files = spark.createDataFrame([(m["file"], m["ids_before"]) for m in manifest], "file string, before long").repartition(len(manifest))
    return files.mapInArrow(run, schema)
