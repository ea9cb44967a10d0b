"""Token ids of a whole corpus by content-defined chunk reuse.

A rolling hash over the last 16 code points cuts every text where its low bits are zero, so equal
passages of different documents fall into equal chunks.  A worker encodes each distinct chunk once
and keeps it by content.  Chunk ids alone are wrong near the cuts, as a pre-token may cross a cut.  So a
chunk is encoded between its first and its last *agreed place*, and each join is repaired: the text from
the last agreed place of the left chunk to the first of the right one is encoded anew, over as many
chunks as have none.  Repairs are kept by content, too.  The result equals that of encoding the whole
text, which the tests check.

Why the repair is exact: the pattern matches from left to right and depends on nothing before the
place it is at, so two splits that share a boundary agree from there on.  An agreed place is one where
every split has a boundary, whatever stands around it: white space after something that is none (no
alternative of the pattern goes on from other characters to white space), or a full-width mark after a
Chinese character.  What ends there ends there with the text, too, as the only look-ahead of the
pattern is that of white space, and a piece that ends before white space ends with none.

There is no shuffle: documents are encoded where they are read, and what is kept is bounded per
worker (the oldest half goes when it is full; that costs time, never changes a result).  Defined results:
null and empty texts have no ids.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.tokenizers import byte_bpe, folder

WINDOW_BITS = 4  # the hash covers 2**4 code points
MASK_BITS = 8  # a cut after one of 2**8 positions
KEPT = 60_000  # chunks, and repairs, that a worker keeps
NEAR = 60  # code points from the end in which the last agreed place is looked for first

#: Agreed places: a blank or line feed after a character that is surely no white space, a full-width mark after a Chinese character.
_AGREED = re.compile("(?<=[!-~À-ɏΑ-ωЀ-ӿ一-鿿])[ \n]|(?<=[一-鿿])[，。！？；：、]")


def cut_points(codes: np.ndarray) -> np.ndarray:
    """Positions after which a text is cut, from its code points (content-defined)."""
    with np.errstate(over="ignore"):
        h = codes * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
        factor = np.uint32(0x01000193)
        for k in range(WINDOW_BITS):
            step = 1 << k
            older = np.zeros_like(h)
            older[step:] = h[:-step] if len(h) > step else 0
            h = h + older * factor
            factor = np.uint32(int(factor) * int(factor) & 0xFFFFFFFF)
        h *= np.uint32(0x85EBCA6B)
    return np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + 1


class ChunkEncoder:
    """Encodes texts by one byte-level BPE, reusing chunks; one per worker process."""

    _by_name: dict[tuple[str, str], ChunkEncoder] = {}

    @classmethod
    def get(cls, name: str, path: str) -> ChunkEncoder:
        if (name, path) not in cls._by_name:
            cls._by_name[name, path] = cls(name, path)
        return cls._by_name[name, path]

    def __init__(self, name: str, path: str):
        self.whole = byte_bpe(name, path).encode_ordinary
        self.chunks: dict[str, tuple | None] = {}
        self.joins: dict[str, array] = {}

    @staticmethod
    def _room(kept: dict) -> None:
        if len(kept) > KEPT:
            for key in list(islice(kept, len(kept) // 2)):
                del kept[key]

    def _chunk(self, s: str) -> tuple | None:
        """(text before the first agreed place, ids up to the last one, text after it); null without two such places."""
        first = _AGREED.search(s)
        if first is None:
            return None
        begin, end = first.start(), -1
        for at in (max(len(s) - NEAR, begin + 1), begin + 1):
            for m in _AGREED.finditer(s, at):
                end = m.start()
            if end >= 0:
                break
        if end < 0:
            return None
        return s[:begin], array("i", self.whole(s[begin:end])), s[end:]

    def encode(self, pieces: list[str]) -> array:
        """Ids of the text that ``pieces`` add up to."""
        if len(pieces) == 1:
            return array("i", self.whole(pieces[0]))
        chunks, joins = self.chunks, self.joins
        out, pending = array("i"), ""
        for p in pieces:
            chunk = chunks.get(p, 0)
            if chunk == 0:
                self._room(chunks)
                chunk = chunks[p] = self._chunk(p)
            if chunk is None:
                pending += p
                continue
            head, ids, tail = chunk
            out += self._join(joins, pending + head)
            out += ids
            pending = tail
        out += self._join(joins, pending)
        return out

    def _join(self, joins: dict[str, array], text: str) -> array:
        ids = joins.get(text)
        if ids is None:
            self._room(joins)
            ids = joins[text] = array("i", self.whole(text))
        return ids

    def encode_all(self, texts: list[str | None]) -> Iterator[array]:
        """Ids of each text, in order."""
        known = [t or "" for t in texts]
        joined = "".join(known)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        ends = np.cumsum([len(t) for t in known]) if known else np.zeros(0, np.int64)
        cuts = cut_points(codes) if len(codes) else np.zeros(0, np.int64)
        low = np.searchsorted(cuts, ends - [len(t) for t in known], side="right") if known else ends
        high = np.searchsorted(cuts, ends, side="left")
        at = 0
        places = cuts.tolist()
        for t, end, a, b in zip(known, ends.tolist(), low.tolist(), high.tolist()):
            if not t:
                yield array("i")
                continue
            stops = [*places[a:b], end]
            pieces = []
            for stop in stops:
                pieces.append(joined[at:stop])
                at = stop
            yield self.encode(pieces)


def encode_column(df: DataFrame, tokenizer: str = "byte_bpe_50k", path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ids (list of integers) of each row of ``df``."""
    where = folder(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder.get(tokenizer, where)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids, offsets = array("i"), [0]
            for one in encoder.encode_all(texts):
                ids += one
                offsets.append(len(ids))
            values = pa.array(np.frombuffer(ids, dtype=np.int32) if ids else np.zeros(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, ids array<int>")
