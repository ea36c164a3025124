"""Media columns: bytes stored as progressive JPEGs, JPEGs decoded to RGB tensors.

`decode_column` turns a column of progressive JPEGs into full-resolution RGB tensors. `store_bytes` stores any bytes
in such a file without loss. The query stores every text, reads the stored form back through the decoder and
describes the tensor.

Defined results: a null text counts as empty; its payload is 576 bytes of 255. Equal texts give equal values. Rows
that repeat are handled one by one. A null file has a null tensor. A text too large for one picture (over 6 GB) is an
error. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandline.llm.common import byte_values, table
from strandline.llm.jpeg import Picture, carried_bytes, encode_bytes

UNIT = 576


def padded(text: bytes, unit: int = UNIT) -> bytes:
    """Bytes 255 appended up to a positive multiple of the unit."""
    return text + b"\xff" * (unit - len(text) if not text else -len(text) % unit)


def feature(rgb: np.ndarray) -> str:
    """Size, mean of each channel in thousandths, and a checksum of the tensor."""
    n = rgb.shape[0] * rgb.shape[1]
    sums = [int(rgb[:, :, k].sum(dtype=np.int64)) for k in range(3)]
    means = ",".join(str(1000 * s // n) for s in sums)
    return f"{rgb.shape[0]}x{rgb.shape[1]}x3:{means}:{zlib.crc32(np.ascontiguousarray(rgb)):08x}"


def _batches(values: list, width: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows whose tensors are small together."""
    a = size = 0
    for b, v in enumerate(values):
        if size and size + len(v or b"") > width:
            yield a, b
            a = b
            size = 0
        size += len(v or b"")
    if a < len(values):
        yield a, len(values)


def decode_column(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """key, height, width, rgb (row by row, three bytes a pixel) for each progressive JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_pylist()
            for a, b in _batches(values):
                t = [None if v is None else Picture(v).rgb() for v in values[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([None if x is None else x.shape[0] for x in t], pa.int32()), pa.array([None if x is None else x.shape[1] for x in t], pa.int32()), pa.array([None if x is None else x.tobytes() for x in t], pa.binary())],
                    names=[key, "height", "width", "rgb"],
                )

    return df.select(key, media).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, height int, width int, rgb binary")


def store_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and media: the padded bytes of each text as a progressive JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = byte_values(batch.column(1))
            for a, b in _batches(values):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([encode_bytes(padded(v)) for v in values[a:b]], pa.binary())], names=[key, "media"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, media binary")


def described(text: bytes) -> tuple:
    """The columns of the query for one text: all but n_bytes come from the stored form."""
    media = encode_bytes(padded(text))
    picture = Picture(media)
    back = carried_bytes(picture)
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(picture.rgb())


_KINDS = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a progressive JPEG, read back and described."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, tuple] = {}
            rows = []
            for v in byte_values(batch.column("text")):
                if v not in known:
                    known[v] = described(v)
                rows.append(known[v])
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _KINDS]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, _KINDS.values(), strict=True))], names=["doc_id", *_KINDS])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
