"""Filling fixed-capacity containers: bounded-space online best-fit.

Each task reads its documents in order and packs them at once, with ``open_bins`` open containers per
specification.  Their free spaces are kept in a bitset - bit f is set while some open container has f
tokens free - so the tightest container that takes an item is the lowest set bit at or above its
size.  When all are open, none fits and the new one has space left, the fullest one is closed.  Items are never moved and never
shuffled.

What is still open at the end of a task (at most ``open_bins`` containers per specification) is
emptied into one another in a second step: the open containers of up to ``LANES`` tasks are packed, the
largest first, as if each were one item.  That step sees ``open_bins`` rows per task, not the corpus.

An item longer than the capacity, and only such an item, is split: into full containers and a rest.
Defined results: null and empty texts are items of no tokens and get a container like any other;
repeated rows are items of their own; an empty table gives no rows; a specification with a null or
non-positive capacity is left out.  Which container an item gets depends on how the files are split into
tasks; that all have one, and none is too full, does not.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.chunked_encoding import ChunkEncoder
from weftgraph.llm.tokenizers import folder, whole_text_encoder
from weftgraph.plans.materialize import cut

OPEN_BINS = 64
LANES = 64

_PLACED = "spec_id int, doc_id long, piece_no int, n_tokens int, lane long, bin long, open_used int"


class BestFit:
    """Online best-fit with at most ``space`` open bins of ``capacity``."""

    def __init__(self, capacity: int, space: int):
        self.capacity, self.space = capacity, space
        self.free_bits = 0
        self.by_free: dict[int, list[int]] = {}
        self.n_open = self.n_bins = 0

    def place(self, size: int) -> int:
        """The bin that takes an item of ``size`` (at most the capacity)."""
        fitting = self.free_bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            b = self._take(free)
        else:
            if self.n_open == self.space and size < self.capacity:  # else the new bin is full at once
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)  # closes the fullest
            b, free = self.n_bins, self.capacity
            self.n_bins += 1
        left = free - size
        if left:
            self.by_free.setdefault(left, []).append(b)
            self.free_bits |= 1 << left
            self.n_open += 1
        return b

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        b = bins.pop()
        if not bins:
            self.free_bits &= ~(1 << free)
        self.n_open -= 1
        return b

    def still_open(self) -> list[tuple[int, int]]:
        """(bin, tokens used) of the open bins."""
        return [(b, self.capacity - f) for f, bins in self.by_free.items() for b in bins]


def counter(tokenizer: str, path: str) -> Callable[[list[str | None]], list[int]]:
    """What counts the tokens of texts: the chunk encoder for byte-level vocabularies, else the tokenizer itself."""
    if os.path.exists(f"{path}/{tokenizer}.tiktoken"):
        encoder = ChunkEncoder.get(tokenizer, path)
        return lambda texts: [len(x) for x in encoder.encode_all(texts)]
    encode = whole_text_encoder(tokenizer, path)
    return lambda texts: [len(x) for x in encode([t or "" for t in texts])]


def _pack_partition(specs: list[tuple[int, str, int]], path: str, space: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = TaskContext.get().partitionId()
        fits = {s: BestFit(cap, space) for s, _, cap in specs}
        counters = {t: counter(t, path) for t in {t for _, t, _ in specs}}

        def batch(cols: list[list]) -> pa.RecordBatch:
            types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
            names = [x.split()[0] for x in _PLACED.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for part in batches:
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            counts = {t: count(texts) for t, count in counters.items()}
            for s, tokenizer, cap in specs:
                place = fits[s].place
                docs, pieces, sizes, bins = [], [], [], []
                for doc, n in zip(ids, counts[tokenizer]):
                    k = 0
                    while n > cap:
                        docs.append(doc), pieces.append(k), sizes.append(cap), bins.append(place(cap))
                        n -= cap
                        k += 1
                    docs.append(doc), pieces.append(k), sizes.append(n), bins.append(place(n))
                m = len(docs)
                yield batch([[s] * m, docs, pieces, sizes, [lane] * m, bins, [None] * m])
        for s, fit in fits.items():
            left = fit.still_open()
            m = len(left)
            yield batch([[s] * m, [None] * m, [None] * m, [None] * m, [lane] * m, [b for b, _ in left], [u for _, u in left]])

    return run


def _merge_open(capacity: dict[int, int]):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["open_used", "lane", "bin"], ascending=[False, True, True])
        fit = BestFit(capacity[int(key[0])], 1 << 40)  # nothing closes here: the group is small
        firsts: dict[int, tuple[int, int]] = {}
        to = []
        for lane, b, used in zip(pdf["lane"], pdf["bin"], pdf["open_used"]):
            into = fit.place(int(used))
            to.append(firsts.setdefault(into, (int(lane), int(b))))
        return pd.DataFrame({"spec_id": pdf["spec_id"], "lane": pdf["lane"], "bin": pdf["bin"], "to_lane": [x for x, _ in to], "to_bin": [x for _, x in to]})

    return run


def pack(documents: DataFrame, specs: list[tuple[int, str, int]], path: str | None = None, open_bins: int = OPEN_BINS) -> DataFrame:
    """spec_id, doc_id, piece_no, n_tokens, container_id of every piece of every document.

    ``specs``: (spec_id, tokenizer, capacity); containers are numbered within their specification.
    """
    good = [(int(s), t, int(c)) for s, t, c in specs if c and c > 0]
    first = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pack_partition(good, folder(path), open_bins), _PLACED)
    first = cut(first, "packed")  # tokenized once; read by both steps
    groups = first.where("open_used is not null").withColumn("grp", F.floor(F.col("lane") / LANES))
    moves = groups.select("spec_id", "grp", "lane", "bin", "open_used").groupBy("spec_id", "grp").applyInPandas(_merge_open({s: c for s, _, c in good}), "spec_id int, lane long, bin long, to_lane long, to_bin long")
    placed = first.where("open_used is null").join(moves, ["spec_id", "lane", "bin"], "left")
    lane, b = F.coalesce("to_lane", "lane"), F.coalesce("to_bin", "bin")
    return placed.select("spec_id", "doc_id", "piece_no", "n_tokens", F.concat_ws("-", lane.cast("string"), b.cast("string")).alias("container_id"))


def fill(placed: DataFrame, specs: list[tuple[int, str, int]]) -> DataFrame:
    """spec_id, capacity, n_documents, n_tokens, n_containers, fill (share of the space used)."""
    bins = placed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("used"))
    docs = placed.groupBy("spec_id").agg(F.count_if(F.col("piece_no") == 0).alias("n_documents"))
    caps = F.create_map(*[x for s, _, c in specs for x in (F.lit(int(s)), F.lit(int(c)))])
    out = bins.groupBy("spec_id").agg(F.sum("used").alias("n_tokens"), F.count(F.lit(1)).alias("n_containers")).join(docs, "spec_id").withColumn("capacity", caps[F.col("spec_id")])
    return out.select("spec_id", "capacity", "n_documents", "n_tokens", "n_containers", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 4).alias("fill"))
