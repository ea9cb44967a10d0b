"""Whether source files are well-formed in the language of their path.

Every content is parsed as a whole by a parser that keeps going after errors: GDScript by recursive
descent with precedence climbing, section texts (tscn, tres, import) and JSON by recursive descent,
all with panic-mode recovery.  All errors of a file are kept, the first by line is its first cause.
Files are parsed where they are read, without a shuffle.

Defined results: the language is what the extension of ``path`` says (upper and lower case alike),
whatever lang_hint and kind say; other extensions and null paths have no language and no errors; null,
empty and blank contents and a leading byte order mark are no errors; rows are files, so revisions of
a path count one by one; a null repo is a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.sources import gdscript, json_text, section_text
from weftgraph.sources.gdscript import Problem

PARSERS = {"gd": ("gdscript", gdscript.parse), "json": ("json", json_text.parse), "import": ("import", partial(section_text.parse, titles=True))}
PARSERS |= {x: (x, section_text.parse) for x in ("tscn", "tres")}

_ERRORS = pa.list_(pa.struct([("line", pa.int32()), ("message", pa.string())]))
_ADDED = "language string, malformed boolean, first_line int, first_message string, errors array<struct<line:int,message:string>>"


def extension(path: str | None) -> str:
    return (path or "").strip().rpartition("/")[2].rpartition(".")[2].lower()


def check(path: str | None, content: str | None) -> tuple[str | None, list[Problem]]:
    """(language, problems in order of lines) of one file."""
    language, parse = PARSERS.get(extension(path), (None, None))
    if parse is None or not (content or "").removeprefix("﻿").strip():
        return language, []
    return language, parse(content)[1]


def judge(files: DataFrame) -> DataFrame:
    """file_id, repo, language, malformed, first_line, first_message, errors (line, message) of every file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [check(p, c) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist())]
            problems = [p for _, p in got]
            columns = [
                batch.column("file_id"),
                batch.column("repo"),
                pa.array([x for x, _ in got], pa.string()),
                pa.array([bool(p) for p in problems], pa.bool_()),
                pa.array([p[0].line if p else None for p in problems], pa.int32()),
                pa.array([p[0].message if p else None for p in problems], pa.string()),
                pa.array([[x._asdict() for x in p] for p in problems], _ERRORS),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["file_id", "repo", *(x.split()[0] for x in _ADDED.split(", "))])

    kind = files.schema["file_id"].dataType.simpleString()
    return files.select("file_id", "repo", "path", "content").mapInArrow(run, f"file_id {kind}, repo string, {_ADDED}")


def found(files: DataFrame) -> DataFrame:
    """file_id of the malformed files."""
    return judge(files).where("malformed").select("file_id").distinct()


def rates(judged: DataFrame, *by: str) -> DataFrame:
    """n_files, n_malformed and rate of each group."""
    return judged.groupBy(*by).agg(F.count(F.lit(1)).alias("n_files"), F.count_if("malformed").alias("n_malformed"), F.round(F.count_if("malformed") / F.count(F.lit(1)), 6).alias("rate"))


def acceptance(judged: DataFrame) -> DataFrame:
    """language, n_files, n_accepted, acceptance (share of files without errors)."""
    return rates(judged, "language").select("language", "n_files", (F.col("n_files") - F.col("n_malformed")).alias("n_accepted"), F.round(1 - F.col("n_malformed") / F.col("n_files"), 6).alias("acceptance"))
