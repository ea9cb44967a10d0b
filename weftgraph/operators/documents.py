"""Documents that refer to a project: a YAML head with anchors, resolved against the nodes.

A document is a text whose head stands between two lines of ``---``; ``type`` says what it is, ``covers``
lists ids, match keys or uids.  Each document becomes a node, each anchor a ``documents`` edge.  A head
that is missing or unreadable is kept as the node's ``problem``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import keys
from weftgraph.functions.globs import glob_regex
from weftgraph.project import Project

#: What a document may be.
TYPES = ("system", "level", "design", "devlog", "adr")


def parse_head(text: str | None) -> tuple[dict, list[tuple[str, int]], str | None]:
    """(fields, anchors with their lines, problem) of one document."""
    import yaml

    lines = (text or "").removeprefix("﻿").replace("\r\n", "\n").split("\n")
    if lines[0].strip() != "---" or "---" not in [x.strip() for x in lines[1:]]:
        return {}, [], "no frontmatter"
    end = [x.strip() for x in lines[1:]].index("---") + 1
    try:
        head = yaml.safe_load("\n".join(lines[1:end]))
    except yaml.YAMLError:
        return {}, [], "frontmatter is not valid YAML"
    if not isinstance(head, dict):
        return {}, [], "frontmatter is not a mapping"
    covers = head.get("covers")
    problem = None
    if head.get("type") not in TYPES:
        problem = f"unknown type {head.get('type')!r}"
    elif covers is not None and not isinstance(covers, list):
        problem = "covers is not a list"
    anchors = []
    for a in covers if isinstance(covers, list) else []:
        at = next((i + 1 for i, x in enumerate(lines[:end]) if str(a) in x), 1)
        anchors.append((str(a).strip(), at))
    return head, anchors, problem


def read(listed: DataFrame, globs: list[str]) -> DataFrame:
    """path, content of listed files (where, rel) that a glob matches; ``**`` crosses folders."""
    test = F.lit(False)
    for g in globs:
        if r := glob_regex(g.replace("**/", "**"), deep=True):
            test = test | F.col("rel").rlike(r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            out = []
            for where in batch.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(where if "://" in where else "file://" + where.removeprefix("file:"))
                with system.open_input_stream(at) as f:
                    out.append(f.read().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.string())], names=["path", "content"])

    return listed.where(test).select("where", "rel").mapInArrow(run, "path string, content string")


def document_facts(docs: DataFrame) -> DataFrame:
    """path, identity, anchors (anchor, line) of documents (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [parse_head(t) for t in batch.column(1).to_pylist()]
            about = [json.dumps({k: str(v) for k, v in (("type", h.get("type")), ("domain", h.get("domain")), ("updated", h.get("updated")), ("problem", p)) if v is not None}) for h, _, p in heads]
            kind = pa.list_(pa.struct([("anchor", pa.string()), ("line", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(about, pa.string()), pa.array([[{"anchor": a, "line": n} for a, n in x] for _, x, _ in heads], kind)], names=["path", "identity", "anchors"])

    return docs.select("path", "content").mapInArrow(run, "path string, identity string, anchors array<struct<anchor:string,line:int>>")


def with_documents(p: Project, docs: DataFrame, uids: DataFrame | None = None) -> Project:
    """The project with a node for each document and an edge for each anchor.

    Anchors are canonical keys; a uid that ``uids`` (uid, path) knows stands for its file.  ``resolved`` says whether
    the anchor names a node.
    """
    facts = document_facts(docs)
    nothing = F.lit(None)
    nodes = facts.select(keys.doc_id("path").alias("id"), F.lit("doc").alias("kind"), keys.doc_id("path").alias("path"), nothing.cast("int").alias("line"), "identity", nothing.cast("string").alias("properties"))
    anchors = facts.select(keys.doc_id("path").alias("source_id"), F.posexplode("anchors").alias("pos", "x")).select("source_id", "pos", keys.canonical_key("x.anchor").alias("target_id"), F.col("x.line").alias("ev_line"))
    if uids is not None:
        anchors = anchors.join(uids.select(F.col("uid").alias("target_id"), F.col("path").alias("file")), "target_id", "left").withColumn("target_id", F.coalesce("file", "target_id")).drop("file")
    known = p.nodes.select(F.col("id").alias("target_id"), F.lit(True).alias("resolved"))
    met = anchors.join(known, "target_id", "left")
    edges = met.select(
        F.xxhash64("source_id", "pos", "target_id").alias("edge_id"), F.lit("documents").alias("type"), "source_id", "target_id", F.lit("docs").alias("origin"), F.coalesce("resolved", F.lit(False)).alias("resolved"), F.lit(1.0).alias("confidence"),
        F.col("source_id").alias("ev_file"), "ev_line", nothing.cast("string").alias("properties"),
    )
    return Project(p.nodes.unionByName(nodes), p.edges.unionByName(edges), p.boundaries, p.diagnostics, p.meta)
