"""Token counts by a linear longest-match automaton.

A word (a run without the six white-space bytes) gets a leading space and is split greedily: again and again
the longest string of the vocabulary that opens the rest. Only the number of pieces is wanted, so none is
built: the vocabulary's trie has failure links, and each node knows how many pieces are popped on its link.
A word's count takes time linear in its bytes, whatever the vocabulary.

The vocabulary is the byte strings of a public byte-level BPE file; all 256 bytes are in it, so every text
has a count. Counts differ from BPE's, which merges by rank.

Edge cases. Null and empty texts: no words, no pieces. Null or repeated doc_id: each row is counted. Empty
table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HELD = 1 << 18


def vocabulary(path: str | None = None) -> list[bytes]:
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines]


class Automaton(dict):
    """word -> number of pieces; missing words are run through the trie, and a bounded number is kept."""

    def __init__(self, pieces: Iterable[bytes], lead: bytes = b" "):
        super().__init__()
        self.lead, self.step = lead, {}
        ends, size, order = {0: False}, 1, deque()
        children: list[list[int]] = [[]]
        for piece in pieces:
            node = 0
            for c in piece:
                key = node << 8 | c
                if (after := self.step.get(key)) is None:
                    after = self.step[key] = size
                    children[node].append(c)
                    children.append([])
                    ends[size] = False
                    size += 1
                node = after
            ends[node] = bool(piece)
        missing = [c for c in range(256) if not ends.get(self.step.get(c, 0))]
        if missing:
            raise ValueError(f"{len(missing)} bytes are no pieces")
        self.fail, self.popped = [0] * size, [0] * size
        order.append(0)
        while order:
            node = order.popleft()
            for c in children[node]:
                child = self.step[node << 8 | c]
                order.append(child)
                if ends[child]:
                    self.fail[child], self.popped[child] = 0, 1
                    continue
                at, popped = self.fail[node], self.popped[node]
                while (after := self.step.get(at << 8 | c)) is None:  # ends at the root, which has every byte
                    popped += self.popped[at]
                    at = self.fail[at]
                self.fail[child], self.popped[child] = after, popped

    def run(self, word: bytes) -> int:
        node, count, step = 0, 0, self.step
        for c in word:
            while (after := step.get(node << 8 | c)) is None:
                count += self.popped[node]
                node = self.fail[node]
            node = after
        while node:
            count += self.popped[node]
            node = self.fail[node]
        return count

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _HELD:
            self.clear()
        found = self.run(self.lead + word)
        if len(word) <= 64:
            self[word] = found
        return found


def count(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_pieces."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_pieces", T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Automaton(vocabulary(path))
        for b in batches:
            n_words, n_pieces = [], []
            for t in b.column(1):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                n_words.append(len(words))
                n_pieces.append(sum(map(pieces.__getitem__, words)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_pieces, pa.int64())], names=schema.names)

    return rows.mapInArrow(each, schema)
