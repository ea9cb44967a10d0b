import os
import random

import pytest

import __spark_entry__
from weftgraph.llm.chunked_encoding import ChunkEncoder, encode_column
from weftgraph.llm.tokenizers import byte_bpe, folder

NAME = "byte_bpe_50k"
pytestmark = pytest.mark.skipif(not os.path.exists(f"{folder()}/{NAME}.tiktoken"), reason="the tokenizer's file is not here")

PARTS = [
    "The quick brown fox doesn't jump over 1234567 lazy dogs. ", "  \n\n\t ", "   x", "naïve café — “quoted” … ", "Жил-был у бабушки серенький козлик, ", "数据处理系统在运行。", "'s 't're", "a" * 40,
    "😀👩‍👩‍👧 ", "  ​﻿", "\r\n", "!!!???...,,,", "0" * 30, "ȩ́ ", "\U00020000\U0001f600", "<|endoftext|>", "\x1c\x85\x00", "ſK ",
]


def texts() -> list[str | None]:
    """Random texts of repeated passages, so that chunks and joins are reused."""
    rnd = random.Random(7)
    passages = ["".join(rnd.choices(PARTS, k=rnd.randint(1, 30))) for _ in range(20)]
    out = ["".join(rnd.choices(passages, k=rnd.randint(1, 8))) for _ in range(150)]
    out += ["".join(rnd.choices("ab '.\n1é数", k=rnd.randint(1, 400))) for _ in range(150)]
    return [None, "", " ", "\n", "x", *PARTS, *passages, *out, out[0], " " * 3000, "a" * 9000, "ab " * 5000]


def test_ids_equal_those_of_the_whole_text():
    encoder, whole = ChunkEncoder(NAME, folder()), byte_bpe(NAME, folder()).encode_ordinary
    given = texts()
    for _ in range(2):  # again with everything kept
        for t, ids in zip(given, encoder.encode_all(given), strict=True):
            assert list(ids) == whole(t or ""), repr((t or "")[:80])
    assert encoder.joins and any(v for v in encoder.joins.values())  # the repair took part


def test_nothing_kept_changes_nothing(monkeypatch):
    monkeypatch.setattr("weftgraph.llm.chunked_encoding.KEPT", 1)
    encoder, whole = ChunkEncoder(NAME, folder()), byte_bpe(NAME, folder()).encode_ordinary
    given = texts()
    assert [list(x) for x in encoder.encode_all(given)] == [whole(t or "") for t in given]


def test_no_texts_give_no_ids():
    assert list(ChunkEncoder(NAME, folder()).encode_all([])) == []


def test_query_gives_every_row_its_ids(spark, tmp_path):
    rows = [(i, t, "extra") for i, t in enumerate(texts()[:80])] + [(1, "", "copy")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    whole = byte_bpe(NAME, folder()).encode_ordinary
    out = __spark_entry__.queries()["p6_ids"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "ids"]
    assert sorted((r["doc_id"], r["ids"]) for r in out.collect()) == sorted((i, whole(t or "")) for i, t, _ in rows)
    assert encode_column(frame.where("doc_id < 0")).collect() == []
