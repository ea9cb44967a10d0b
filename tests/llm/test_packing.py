import os
from collections import defaultdict

import pytest

from weftgraph.llm import packing
from weftgraph.llm.tokenizers import folder


def test_a_full_new_bin_closes_no_open_bin():
    fit = packing.BestFit(10, 2)
    a, b = fit.place(7), fit.place(8)
    assert fit.place(10) not in (a, b)
    assert sorted(fit.still_open()) == [(a, 7), (b, 8)]
    assert (fit.place(3), fit.place(2)) == (a, b)


def test_the_fullest_bin_closes_when_the_new_one_stays_open():
    fit = packing.BestFit(10, 2)
    a, b = fit.place(7), fit.place(8)
    c = fit.place(6)
    assert sorted(fit.still_open()) == [(a, 7), (c, 6)] and b not in (a, c)


@pytest.mark.parametrize("capacity", [5, 32, 1000])
def test_every_token_is_placed_and_no_container_overflows(spark, capacity, monkeypatch):
    monkeypatch.setattr(packing, "folder", lambda path: path)
    monkeypatch.setattr(packing, "counter", lambda tokenizer, path: lambda texts: [len((t or "").split()) for t in texts])
    sizes = [0, 1, 5, 7, 32, 64, 33, 12, 3, 900, 2, 2] * 6
    docs = [(i, " ".join(["w"] * n) if i else None, "extra") for i, n in enumerate(sizes)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, other string")
    local = [(1, "words", capacity), (2, "words", None), (3, "words", 0)]
    rows = run_here(packing, frame, local)
    used, tokens, pieces = defaultdict(int), defaultdict(int), defaultdict(list)
    for spec, doc, piece, n, bin_ in rows:
        assert spec == 1
        used[bin_] += n
        tokens[doc] += n
        pieces[doc].append((piece, n))
    assert max(used.values()) <= capacity
    assert dict(tokens) == dict(enumerate(sizes))
    for doc, parts in pieces.items():
        assert sorted(k for k, _ in parts) == list(range(len(parts)))
        assert len(parts) == 1 if sizes[doc] <= capacity else all(n == capacity for k, n in parts if k < len(parts) - 1)


def run_here(packing, frame, specs):
    """The first step in this process, one task, with two open bins."""
    import pyarrow as pa

    class Task:
        def partitionId(self):  # noqa: N802
            return 0

    held = packing.TaskContext.get
    packing.TaskContext.get = staticmethod(Task)
    try:
        good = [(s, t, c) for s, t, c in specs if c and c > 0]
        batch = pa.RecordBatch.from_pylist([{"doc_id": r["doc_id"], "text": r["text"]} for r in frame.orderBy("doc_id").collect()], pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
        out = [r for b in packing._pack_partition(good, "", 2)(iter([batch])) for r in b.to_pylist()]
    finally:
        packing.TaskContext.get = held
    return [(r["spec_id"], r["doc_id"], r["piece_no"], r["n_tokens"], r["bin"]) for r in out if r["open_used"] is None]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001") or not os.path.isdir(folder()), reason="no test tables")
def test_every_document_is_placed_and_no_container_is_too_full(spark):
    d = "/root/testdata/sf0.001"
    specs = [tuple(r) for r in spark.read.parquet(f"{d}/pack_specs.parquet").select("spec_id", "tokenizer", "capacity").collect()]
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    placed = packing.pack(spark.read.parquet(f"{d}/documents.parquet").repartition(3), specs).collect()
    for s, tokenizer, capacity in specs:
        sizes = dict(zip([r["doc_id"] for r in docs], packing.counter(tokenizer, folder())([r["text"] for r in docs])))
        mine = [r for r in placed if r["spec_id"] == s]
        used, got, pieces = defaultdict(int), defaultdict(int), defaultdict(list)
        for r in mine:
            used[r["container_id"]] += r["n_tokens"]
            got[r["doc_id"]] += r["n_tokens"]
            pieces[r["doc_id"]].append(r["piece_no"])
        assert got == sizes and max(used.values()) <= capacity
        assert all(len(pieces[i]) == 1 or n > capacity for i, n in sizes.items())
        assert all(sorted(p) == list(range(len(p))) for p in pieces.values())
        totals = {r["spec_id"]: r for r in packing.fill(spark.createDataFrame(placed), specs).collect()}[s]
        assert (totals["n_documents"], totals["n_tokens"], totals["n_containers"]) == (len(docs), sum(sizes.values()), len(used))
