"""Packing by power-of-two decomposition.

A document's token ids (byte-level BPE, then the end id 1) are cut into pieces of 2048 ids and, for the rest,
of the powers of two of its binary notation, largest first. Equal lengths share a bucket; each piece is a
sequence of its own, so no sequence crosses documents and none is padded, as every length is a power of two.
Sequences are numbered without gaps, longest bucket first, within a bucket by a hash of (doc_id, start).

Ids are those of the `tokenizers` library for the given file. Text is cut at single spaces, and the ids of
each part are kept in a bounded table: BPE here never merges across " x", where x is no white space. Parts
that stand beside other white space, and texts with a special token's string, are encoded whole; what holds a
run of 4,096 white-space characters or more goes to `tokenizers`, as the faster library's pattern overflows its
stack on very long ones.

Edge cases. Very long texts: ids of one text stand in memory at once, four bytes each; all its pieces are made.
Null and empty texts: the end id alone, one piece of length 1. Null or repeated doc_id: each row
is packed; equal rows share their bucket. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import array
import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import Scratch, group_key, parts_for, ranked

LENGTH, END = 2048, 1
_HELD, _LONG, _RUN = 1 << 19, 64, 1 << 12
_WHITE = re.compile(rf"\s{{{_RUN}}}")


class Encoder(dict):
    """text -> ids as little-endian 32-bit bytes. As a dict: part of a text -> the bytes of " part", or None."""

    def __init__(self, path: str, ranks: str):
        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.parts = tiktoken.Encoding("parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def library(self, text: str) -> bytes:
        return array.array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def fast(self, text: str) -> bytes:
        """The fast library's pattern backtracks and overflows its stack on long white space."""
        return self.library(text) if len(text) > _RUN and _WHITE.search(text) else array.array("I", self.parts.encode_ordinary(text)).tobytes()

    def __missing__(self, part: str) -> bytes | None:
        if len(self) >= _HELD:
            self.clear()
        alone = not part or part[0].isspace() or part[-1].isspace()
        found = None if alone else self.fast(" " + part)
        if len(part) <= _LONG:
            self[part] = found
        return found

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.specials):
            return self.library(text)
        first, *rest = text.split(" ")
        found = list(map(self.__getitem__, rest))
        if None in found or not first or first[-1].isspace():
            return self.fast(text)
        return self.fast(first) + b"".join(found)


def cuts(n: int, most: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    out = [(i * most, most) for i in range(n // most)]
    start, rest = n // most * most, n % most
    for power in range(most.bit_length() - 2, -1, -1):
        if rest >> power & 1:
            out.append((start, 1 << power))
            start += 1 << power
    return out


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, ranks: str | None = None, with_ids: bool | str = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, and on demand ids: an array of int (True), or binary,
    little-endian unsigned ("binary": 16 bits an id if the vocabulary allows it, else 32)."""
    path, ranks = path or public_tokenizers.path("byte_bpe_50k.json"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]])
    if with_ids:
        schema = schema.add("ids", T.BinaryType() if with_ids == "binary" else T.ArrayType(T.IntegerType()))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(path, ranks), array.array("I", [END]).tobytes()
        narrow = np.uint16 if encoder.whole.get_vocab_size() <= 1 << 16 else np.uint32
        for b in batches:
            which, out, ids = [], [], []
            for i, t in enumerate(b.column(1)):
                coded = encoder.ids(t.as_py() or "") + end
                for start, length in cuts(n := len(coded) // 4):
                    own = coded[4 * start : 4 * (start + length)]
                    which.append(i)
                    out.append((start, length, zlib.crc32(own), n))
                    if with_ids:
                        read = np.frombuffer(own, np.uint32)
                        ids.append(read.astype(narrow).tobytes() if with_ids == "binary" else read.view(np.int32))
            if out:
                columns = [b.column(0).take(pa.array(which)), *[pa.array(x, pa.int64()) for x in zip(*out)]]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.binary() if with_ids == "binary" else pa.list_(pa.int32()))] if with_ids else []), names=schema.names)

    return rows.mapInArrow(each, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """pieces with sequence_id and offset (0: a piece opens its sequence and fills it)."""
    scratch = Scratch(docs.sparkSession)
    own = pieces(docs, id_col, text_col, **how).withColumn("__at", F.monotonically_increasing_id())
    own = scratch.table(own, "pieces")
    columns = [c for c in own.columns if c != "__at"]
    slim = own.drop("ids").withColumns({"__short": -F.col("length"), "__h": F.xxhash64(group_key(F.col("doc_id")), "start")})
    placed = ranked(slim, [], ["__short", "__h", "doc_id", "start", "ids_crc32"], "sequence_id", "__n", scratch, "line")
    offset = F.lit(0).cast("long").alias("offset")
    if "ids" not in columns:
        return placed.select(*columns, "sequence_id", offset)
    tokens = own.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    dealt = lambda df: df.repartition(parts_for(tokens, 1 << 22), "__at")  # noqa: E731  ids cross one shuffle, some 8 MB a task
    return dealt(own).join(dealt(placed.select("__at", "sequence_id")), "__at").select(*columns, "sequence_id", offset)
