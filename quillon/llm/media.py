"""Media columns: content-addressed payloads in tar shards.

``write_payloads`` stores each payload as an 8-bit grey PNG in a tar shard of the shared folder, named by
the payload's SHA-256, and gives rows that carry digest, shard, offset and length.  ``read_headers`` reads
only the 33 bytes that hold a member's PNG header to fill metadata columns; ``read_members`` reads whole
members.  A task stores a payload once; the catalogue keeps one address for each digest.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_split, materialize, read_table, shared_path

#: Fixed values of the PNG format: signature, and an IHDR chunk's place in the file.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
#: Samples in a row of the picture; payloads are padded with spaces to a positive multiple of it.
WIDTH = 192
TAR_BLOCK = 512
#: A task goes on to another shard file beyond this size.
SHARD_BYTES = 1 << 30

ADDRESS = [("digest", pa.string()), ("n_bytes", pa.int64()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]


def padded(text: str | None) -> tuple[bytes, int]:
    """A text's payload and its unpadded length; a null text is an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw)), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, level: int = 6) -> bytes:
    """The payload's bytes as the samples of a grey picture ``WIDTH`` wide, without loss."""
    height = len(payload) // WIDTH
    lines = np.zeros((height, WIDTH + 1), dtype=np.uint8)
    lines[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_header(head: bytes) -> dict[str, int]:
    """Metadata from a PNG's first ``HEADER_BYTES`` bytes."""
    if head[:8] != PNG_SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    if zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("damaged PNG header")
    width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "colour_type": colour}


def decode_png(data: bytes) -> bytes:
    """The samples of a picture that ``encode_png`` made."""
    meta, at, body = decode_header(data[:HEADER_BYTES]), 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(meta["height"], meta["width"] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered scan lines are not written here")
    return lines[:, 1:].tobytes()


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class TarShard:
    """A tar file written from front to back; ``add`` returns where a member's bytes lie."""

    def __init__(self, folder: str):
        self.name = f"{uuid.uuid4().hex}.tar"
        where, path = filesystem(folder)
        where.create_dir(path, recursive=True)
        self.out = where.open_output_stream(f"{path}/{self.name}")
        self.at = 0

    def add(self, name: str, data: bytes) -> tuple[int, int]:
        import tarfile

        info = tarfile.TarInfo(name)
        info.size = len(data)
        self.out.write(info.tobuf(tarfile.USTAR_FORMAT) + data + b"\0" * (-len(data) % TAR_BLOCK))
        start = self.at + TAR_BLOCK
        self.at = start + len(data) + (-len(data) % TAR_BLOCK)
        return start, len(data)

    def close(self) -> None:
        self.out.write(b"\0" * (2 * TAR_BLOCK))
        self.out.close()


def _writer(folder: str, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, known = None, {}
        try:
            for batch in batches:
                rows = []
                for text in batch.column(1).to_pylist():
                    payload, n = padded(text)
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in known:
                        if shard is not None and shard.at > SHARD_BYTES:
                            shard.close()
                            shard = None
                        shard = shard or TarShard(folder)
                        known[digest] = (shard.name, *shard.add(f"{digest}.png", encode_png(payload)))
                    rows.append((digest, n, *known[digest]))
                columns = list(zip(*rows, strict=True)) or [[]] * len(ADDRESS)
                arrays = [pa.array(c, t) for c, (_, t) in zip(columns, ADDRESS, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema.field(0).type), *arrays], schema=schema)
        finally:
            if shard is not None:
                shard.close()

    return run


def write_payloads(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text; one row per row of ``docs``: id, digest, n_bytes (unpadded), shard, offset, length.

    The rows are written as a table, so that a shard is written by one task attempt and read ever after.
    What a failed attempt leaves is never referred to.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    ident = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = ident.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), *ADDRESS])
    out = "id " + kind.simpleString() + ", digest string, n_bytes long, shard string, offset long, length long"
    return materialize(ident.mapInArrow(_writer(folder, schema), out), "media-rows").withColumnRenamed("id", id_col)


def _range_reads(folder: str, use: Callable[[Callable[[int, int], bytes], int, int], tuple], names: list[str], types: list[pa.DataType]) -> Callable:
    """Adds what ``use(read, offset, length)`` gives to each address; ``read(offset, length)`` is a range read of its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = filesystem(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file = shard, where.open_input_file(f"{path}/{shard}")
                rows.append(use(lambda at, n, file=file: file.read_at(n, at), offset, length))
            columns = list(zip(*rows, strict=True)) or [[]] * len(types)
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *names])
        if file is not None:
            file.close()

    return run


def _headers(read, offset, length):
    meta = decode_header(read(offset, HEADER_BYTES))
    return meta["width"], meta["height"], meta["bit_depth"]


def feature(payload: bytes) -> str:
    """Shape, mean, deviation and entropy of the samples, and a 64-bit average hash of an 8 x 8 thumbnail."""
    x = np.frombuffer(payload, dtype=np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    cells = np.add.reduceat(x.astype(np.int64), np.arange(64) * (len(x) // 64))
    bits = cells * 64 > int(x.sum(dtype=np.int64))
    code = int("".join("1" if b else "0" for b in bits), 2)
    return f"{WIDTH}x{len(x) // WIDTH};mean={x.mean():.4f};sd={x.std():.4f};entropy={-(p * np.log2(p)).sum():.4f};ahash={code:016x}"


def _features(read, offset, length):
    data = read(offset, length)
    payload = decode_png(data)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload)


def catalogue(rows: DataFrame) -> DataFrame:
    """One address for each digest, and how many rows have it, dealt out by shard and place so that a task reads its shards from front to back."""
    first = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("a"), F.count(F.lit(1)).alias("copies"))
    return first.select("digest", "copies", "a.shard", "a.offset", "a.length").repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")


def _with(addresses: DataFrame, reads: Callable, names: list[str], types: list[str]) -> DataFrame:
    return addresses.mapInArrow(reads, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in addresses.schema) + "".join(f", {n} {t}" for n, t in zip(names, types, strict=True)))


def read_headers(addresses: DataFrame, folder: str) -> DataFrame:
    """The addresses with metadata columns, from their members' first bytes alone: width, height, bit_depth."""
    names = ["width", "height", "bit_depth"]
    return _with(addresses, _range_reads(folder, _headers, names, [pa.int32()] * 3), names, ["int"] * 3)


def read_members(addresses: DataFrame, folder: str) -> DataFrame:
    """The addresses with checks and features of their whole members."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return _with(addresses, _range_reads(folder, _features, names, types), names, ["long", "string", "long", "long", "string", "string"])


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store all texts and read them back: one row per row of ``docs``.

    The metadata columns come from range reads of the headers, the checks and features from the whole members.  Null
    texts count as empty; equal texts share one digest and so all values; repeated rows and null ids are rows like
    others; texts of any length are stored whole; an empty table gives no rows.  Other columns are not read, whatever
    their names.
    """
    folder = shared_path(docs.sparkSession, "media")
    rows = write_payloads(docs, folder, id_col, text_col)
    facts = materialize(read_members(read_headers(catalogue(rows), folder), folder).drop("shard", "offset", "length"), "media-facts")
    out = join_split(rows.select(id_col, "n_bytes", "digest"), facts, "digest", "copies")
    return out.select(id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth")


def op3_media(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` stored, read back and described."""
    return media(read_table(spark, sf_dir, "documents"))
