"""Media columns: documents stored as lossless 8-bit images in archives, and a data source that reads archives back.

The writer packs members into zip archives (stored, as images are compressed already) of bounded size in a shared
directory. The source ``media_archive`` lists a directory's archives, plans byte ranges of them as partitions, streams
the members that begin in a range as Arrow batches, and reads each member by its own offset, trying again by itself when
a read or a checksum fails.
"""

from __future__ import annotations

import struct
import zipfile
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from textloom.llm import shared

#: Bytes that a payload is padded to a multiple of: one image row.
WIDTH = 576
BATCH_BYTES = 2 << 20


def to_image(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """An 8-bit greyscale PNG whose samples are the payload, row by row; its length is a positive multiple of width."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()  # filter type 0 for each row
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def from_image(media: bytes) -> np.ndarray:
    """Samples (rows, width) of an image that to_image has made."""
    at, data, shape = 8, [], None
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("an image chunk fails its checksum")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    return raw[:, 1:]


def features(samples: np.ndarray) -> str:
    """Mean, standard deviation, entropy of the histogram in bits, share of edges, and an 8-bin histogram of the samples."""
    flat = samples.reshape(-1)
    counts = np.bincount(flat, minlength=256)
    share = counts[counts > 0] / len(flat)
    edges = float(np.mean(np.abs(np.diff(flat.astype(np.int16))) > 32)) if len(flat) > 1 else 0.0
    values = [float(np.dot(counts, np.arange(256)) / len(flat)), float(np.std(flat.astype(np.float64))), float(-(share * np.log2(share)).sum()), edges, *(counts.reshape(8, 32).sum(axis=1) / len(flat))]
    return ";".join(f"{v:.6f}" for v in values)


def write_archives(docs: DataFrame, directory: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Store each row's text as an image member named by its id; returns the archives (archive, members), written once.

    A null text is empty, a null id is named "null"; repeated rows are stored as often as they come. Archive names follow
    the partition, so a second attempt of a task replaces the first one's files.
    """
    table = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("data"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, total, done = TaskContext.get().partitionId(), 0, []
        file, out, n = None, None, 0

        for b in batches:
            for name, data in zip(b.column(0), b.column(1)):
                data = data.as_py()
                payload = data + b"\xff" * (-len(data) % width or (0 if data else width))
                if file is None:
                    file, n = shared.File(directory, f"part-{part:06d}-{len(done):05d}.zip"), 0
                    out = zipfile.ZipFile(file, "w", zipfile.ZIP_STORED)
                out.writestr(zipfile.ZipInfo(f"{total:09d}_{name.as_py() or 'null'}.png"), to_image(payload, width))
                n, total = n + 1, total + 1
                if file.tell() >= shared.ARCHIVE_BYTES:
                    out.close()
                    file.close()
                    done.append((file.uri, n))
                    file = None
        if file is not None:
            out.close()
            file.close()
            done.append((file.uri, n))
        yield pa.RecordBatch.from_pydict({"archive": [a for a, _ in done], "members": [m for _, m in done]}, schema=pa.schema([("archive", pa.string()), ("members", pa.int64())]))

    return shared.save(table.mapInArrow(run, "archive string, members long"), "archives")


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class MediaArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.directory, self.split = options["path"], int(options.get("splitBytes", 8 << 20))
        self.tries = int(options.get("retries", 3)) + 1

    def partitions(self):
        """Byte ranges over the directory's archives; nothing but sizes is looked at."""
        from pyarrow import fs as pafs

        fs, base = shared.filesystem(self.directory)
        found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        files = sorted((x.path, x.size) for x in found if x.is_file and x.base_name.endswith(".zip") and x.base_name[0] != ".")
        return [ByteRange(p, s, min(size, s + self.split)) for p, size in files for s in range(0, size, self.split)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange):
        import pyarrow as pa

        if not partition.archive:
            return
        fs, _ = shared.filesystem(self.directory)
        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("member", pa.string()), ("media", pa.binary()), ("attempts", pa.int32()), ("error", pa.string())])
        with fs.open_input_file(partition.archive) as f:
            members = sorted((x for x in zipfile.ZipFile(f).infolist() if partition.start <= x.header_offset < partition.end), key=lambda x: x.header_offset)
        rows, held, source = [], 0, None
        for m in members:
            data, error, tried = None, None, 0
            while data is None and tried < self.tries:
                tried += 1
                try:
                    source = source or fs.open_input_file(partition.archive)
                    data, error = self.member(source, m), None
                except (OSError, ValueError, struct.error) as e:
                    error, source = f"{type(e).__name__}: {e}", None
            rows.append((partition.archive, m.header_offset, m.filename, data, tried, error))
            held += len(data or b"")
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    @staticmethod
    def member(source, m: zipfile.ZipInfo) -> bytes:
        """One member by its offset, held against its size and checksum."""
        source.seek(m.header_offset)
        head = source.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no member begins here")
        name, extra = struct.unpack("<HH", head[26:30])
        source.seek(m.header_offset + 30 + name + extra)
        data = source.read(m.file_size)
        if len(data) != m.file_size or zlib.crc32(data) != m.CRC:
            raise ValueError("a member fails its checksum")
        return data


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").option("splitBytes", n).option("retries", n).load(directory)``."""

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return "archive string, offset long, member string, media binary, attempts int, error string"

    def reader(self, schema):
        return MediaArchiveReader(self.options)


def read_archives(spark: SparkSession, directory: str, **options) -> DataFrame:
    """A row for each member, read whole; a member that no try could read has media null and its error."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(directory)


def described(members: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of archive members.

    All of it comes from the stored bytes. Any member that couldn't be read fails the query: none is left out.
    """
    bad = F.raise_error(F.concat(F.col("archive"), F.lit(" at "), F.col("offset"), F.lit(": "), F.col("error"))).cast("binary")
    table = members.select("member", F.when(F.col("error").isNotNull(), bad).otherwise(F.col("media")).alias("media"))

    def run(batches):
        import hashlib

        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
        for b in batches:
            rows = []
            for member, media in zip(b.column(0), b.column(1)):
                key, media = member.as_py()[10:-4], media.as_py()
                samples = from_image(media)
                payload = samples.tobytes()
                row = (None if key == "null" else int(key), len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(samples))
                rows.append(dict(zip(schema.names, row)))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return table.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as an image, read the archives back, and describe what they hold; one row for each row of docs.

    Equal texts give equal payloads, media and features. An empty table writes no archive and gives an empty result.
    """
    spark = docs.sparkSession
    shared.bound_batches(spark)
    directory = shared.folder(spark, "media")
    write_archives(docs, directory, id_col, text_col)
    return described(read_archives(spark, directory))
