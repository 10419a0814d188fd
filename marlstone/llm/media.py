"""Media columns: texts as bytes in baseline JPEG files, and the files' dimensions and thumbnail hashes.

`store` turns each text (null: empty) into UTF-8, padded with spaces to a positive multiple of 192 bytes, and
that payload into a JPEG file in a binary column. `features` reads such a column: it parses and
Huffman-decodes each file, takes the payload back from the coefficients, and describes the image by its
dimensions and the hash of its DC-only luminance thumbnail.

Edge cases. Null, empty and one-word texts: one MCU at least. Very long texts: one image holds 12 GB; each file
is coded and decoded in slices of about a megabyte, but its bytes, its payload and its coefficients (two bytes each)
stand in memory at once, some six bytes for each byte of the text. Null media: null features. Null or repeated doc_id: each row has
its file; equal texts have equal files. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jpeg

_BLOCK = 4 << 20


def padded(raw: bytes) -> bytes:
    return raw + b" " * (max(1, -(-len(raw) // jpeg.UNIT)) * jpeg.UNIT - len(raw))


def _blocks(sizes: list[int], most: int = _BLOCK) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, media (binary)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in b.column(1)]
            for i, j in _blocks([len(x) for x in raw]):
                files = jpeg.store([padded(x) for x in raw[i:j]])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([len(x) for x in raw[i:j]], pa.int64()), pa.array(files, pa.binary())], names=schema.names)

    return rows.mapInArrow(each, schema)


def described(files: list[bytes]) -> list[tuple]:
    out = []
    for image, file in zip(jpeg.decode(files), files):
        payload = jpeg.payload(image)
        feature = f"{image.width}x{image.height} dhash={jpeg.thumbnail_hash(image.luminance())}"
        out.append((len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), sha256(file).hexdigest(), feature))
    return out


FEATURES = (("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()))


def features(media: DataFrame, media_col: str = "media") -> DataFrame:
    """media with its features in place of the binary column; all other columns stay."""
    others = [c for c in media.columns if c != media_col]
    rows = media.select(*[F.col(f"`{c}`") for c in others], F.col(media_col))
    kinds = {pa.int64(): T.LongType(), pa.string(): T.StringType()}
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(c, kinds[k]) for c, k in FEATURES]])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = b.column(b.num_columns - 1)
            sizes = pa.compute.binary_length(files).fill_null(0).to_pylist()
            for i, j in _blocks(sizes):
                part = [f.as_py() for f in files.slice(i, j - i)]
                found = iter(described([f for f in part if f is not None]))
                found = [next(found) if f is not None else (None,) * len(FEATURES) for f in part]
                yield pa.RecordBatch.from_arrays([*[b.column(k).slice(i, j - i) for k in range(b.num_columns - 1)], *[pa.array(x, k) for x, (_, k) in zip(zip(*found), FEATURES)]], names=schema.names)

    return rows.mapInArrow(each, schema)


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    return features(store(docs, id_col, text_col))
