"""Finding what belongs to a project: its root, its files, its settings, its uids.

Listing a directory and reading the ignore settings is control work of the driver; contents are read
by the tasks.  Paths are ids: ``res://`` and the path below the root.
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import keys
from weftgraph.functions.globs import ignored_regex
from weftgraph.sources.section_facts import is_binary

SETTINGS_FILE = "project.godot"

#: Directories that are never entered, and kinds by extension.
NEVER = (".godot", ".git")
KINDS = {
    "script": ("gd", "cs"),
    "scene": ("tscn", "scn"),
    "resource": ("tres", "res"),
    "extension": ("gdextension",),
    "asset": (
        "png", "jpg", "jpeg", "svg", "webp", "bmp", "tga", "exr", "hdr", "dds", "wav", "ogg", "mp3", "ogv", "webm", "glb", "gltf", "obj", "fbx", "dae", "blend", "ttf", "otf", "woff", "woff2", "fnt", "gdshader", "gdshaderinc", "theme",
    ),
    "import": ("import",),
    "plugin": ("cfg",),
}


def kind_of(path: str | Column) -> Column:
    """Kind of a file by its extension, upper and lower case alike; null for files that are not modelled.

    ``import`` (sidecars) and ``plugin`` (plugin.cfg) are read but are no nodes.
    """
    c = F.col(path) if isinstance(path, str) else path
    name = F.substring_index(c, "/", -1)
    ext = F.lower(F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)))
    out = F.lit(None).cast("string")
    for kind, extensions in KINDS.items():
        out = F.when(ext.isin(*extensions), F.lit(kind)).otherwise(out)
    return F.when(name == SETTINGS_FILE, F.lit(None)).when((ext == "cfg") & (name != "plugin.cfg"), F.lit(None)).otherwise(out)


def find_root(start: str) -> str:
    """The nearest directory at or above ``start`` that holds the project's settings, else ``start``."""
    at = Path(start).absolute()
    for d in (at, *at.parents):
        if (d / SETTINGS_FILE).is_file():
            return str(d)
    return start


def load_settings(root: str, name: str = "weftgraph.yml") -> dict:
    """The tool's own settings; a missing file is no error and unknown keys are kept unread."""
    import yaml

    try:
        with open(os.path.join(root, name), encoding="utf-8") as f:
            found = yaml.safe_load(f)
    except FileNotFoundError:
        return {}
    return found if isinstance(found, dict) else {}


def is_ignored(path: str | Column, globs: list[str]) -> Column:
    """Whether a path (relative to the root) is left out: a segment that is never entered, or a glob.

    A glob without ``/`` is compared with each segment, one with ``/`` with the whole path and each folder above it,
    as an ignored folder takes its files with it.  A malformed glob matches nothing; null stays null.
    """
    c = F.col(path) if isinstance(path, str) else path
    segments = F.split(c, "/")
    out = F.exists(segments, lambda s: s.isin(*NEVER))
    for single, regex in ignored_regex(globs):
        if single:
            out = out | F.exists(segments, lambda s: s.rlike(regex))  # noqa: B023
        else:
            heads = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda n: F.array_join(F.slice(segments, F.lit(1), n), "/"))
            out = out | F.exists(heads, lambda h: h.rlike(regex))  # noqa: B023
    return out


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """where, rel: every file below ``root``, on any file system that Hadoop knows."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root if "://" in root else Path(root).absolute().as_uri())
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    top = fs.getFileStatus(base).getPath().toString().rstrip("/") + "/"
    todo, rows = [base], []
    while todo:
        for status in fs.listStatus(todo.pop()):
            at = status.getPath()
            if status.isDirectory():
                if at.getName() not in NEVER:
                    todo.append(at)
            else:
                rows.append((at.toString(), at.toString()[len(top) :]))
    return spark.createDataFrame(sorted(rows), "where string, rel string")


def read_files(listed: DataFrame) -> DataFrame:
    """path, content, binary of listed files that are modelled; only texts are read, by the tasks.

    Bytes that are no UTF-8 become replacement characters.
    """
    readable = [x for kind in ("script", "scene", "resource", "extension", "import", "plugin") for x in KINDS[kind] if x != "cs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            out = []
            for where, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if path.rpartition(".")[2].lower() not in readable:
                    out.append((path, None, False))
                    continue
                system, at = fs.FileSystem.from_uri(where if "://" in where else "file://" + where.removeprefix("file:"))
                with system.open_input_stream(at) as f:
                    data = f.read()
                out.append((path, None, True) if is_binary(data) else (path, data.decode("utf-8", "replace"), False))
            columns = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.bool_())], names=["path", "content", "binary"])

    wanted = listed.select("where", keys.normalize_path(F.concat(F.lit("res://"), "rel")).alias("path")).where(kind_of("path").isNotNull())
    return wanted.mapInArrow(run, "path string, content string, binary boolean")


# ---- uids --------------------------------------------------------------------------------------

_UID = r'uid="(uid://[^"]+)"'


def header_uids(files: DataFrame) -> DataFrame:
    """path, uid of scenes and resources: from the first line that is neither blank nor a comment; null if it has none."""
    lines = F.filter(F.transform(F.split(F.substring(F.regexp_replace("content", "^\\uFEFF", ""), 1, 1 << 30), "\n"), keys.trim_ws), lambda s: (s != "") & ~s.startswith(";"))
    first = F.get(lines, 0)
    return files.where(kind_of("path").isin("scene", "resource")).select("path", F.nullif(F.regexp_extract(first, _UID, 1), F.lit("")).alias("uid"))


def import_uids(files: DataFrame) -> DataFrame:
    """path, uid, source_file of sidecars: the first of each, null where it is missing."""
    found = lambda p: F.nullif(F.regexp_extract("content", p, 1), F.lit(""))
    return files.where(kind_of("path") == "import").select("path", found(_UID).alias("uid"), found(r'(?m)^[ \t\r\f\x0b]*source_file[ \t]*=[ \t]*"([^"\n]+)"').alias("source_file"))


def uid_map(files: DataFrame) -> DataFrame:
    """uid, path: which file a uid means; a sidecar's word counts before a header's, then the greater path."""
    heads = header_uids(files).where("uid is not null").select("uid", "path", F.lit(0).alias("rank"))
    cars = import_uids(files).where("uid is not null and source_file is not null").select("uid", keys.normalize_path("source_file").alias("path"), F.lit(1).alias("rank"))
    return heads.unionByName(cars).groupBy("uid").agg(F.max(F.struct("rank", "path"))["path"].alias("path"))


# ---- project settings -------------------------------------------------------------------------

_KEY = r"^([A-Za-z0-9_][A-Za-z0-9_/]*)\s*=(.*)$"


def settings_lines(texts: DataFrame) -> DataFrame:
    """project, pos, section, key, value: the assignments of settings files (project, content).

    An assignment begins in column 0, so the lines of a value that goes on are none; ``;`` begins a
    comment.  The section is carried forward within a file; a file is one task's work.
    """
    lines = texts.select("project", F.posexplode(F.split(F.regexp_replace("content", "\r", ""), "\n")).alias("pos", "line"))
    t = keys.trim_ws("line")
    head = F.when(t.startswith("[") & t.endswith("]"), keys.trim_ws(F.substring(t, F.lit(2), F.length(t) - 2)))
    from pyspark.sql import Window

    w = Window.partitionBy("project").orderBy("pos")
    marked = lines.where((t != "") & ~t.startswith(";")).withColumn("head", head)
    carried = marked.withColumn("section", F.coalesce(F.last("head", ignorenulls=True).over(w), F.lit(""))).where("head is null")
    return carried.where(F.col("line").rlike(_KEY)).select("project", "pos", "section", F.regexp_extract("line", _KEY, 1).alias("key"), keys.trim_ws(F.regexp_extract("line", _KEY, 2)).alias("value"))


def _bare(value: str) -> Column:
    return F.regexp_replace(value, '^"+|"+$', "")


def project_facts(lines: DataFrame) -> DataFrame:
    """project, version, main_scene: matched by key, in whatever section they stand; the last counts."""
    version = F.nullif(F.regexp_extract("value", r'"(\d+\.\d+(?:\.\d+)?)"', 1), F.lit(""))
    is_version, is_scene = F.col("key") == "config/features", F.col("key") == "run/main_scene"
    return lines.groupBy("project").agg(F.max_by(F.when(is_version, version), F.when(is_version & version.isNotNull(), F.col("pos"))).alias("version"), F.max_by(F.when(is_scene, keys.normalize_path(_bare("value"))), F.when(is_scene, F.col("pos"))).alias("main_scene"))


def concept_nodes(lines: DataFrame) -> DataFrame:
    """project and node columns of the autoloads, actions, groups and layers that settings declare.

    ``*`` before the path of an autoload enables it; names of one layer index from several categories are one
    node; of a name declared twice the last counts.
    """
    own = lines.where(~F.col("key").isin("config/features", "run/main_scene"))
    js = lambda *c: F.to_json(F.struct(*c))
    bare = _bare("value")
    auto = own.where("section = 'autoload'").select("project", "pos", keys.concept_id("autoload", "key").alias("id"), F.lit("autoload").alias("kind"), js(F.col("key").alias("name"), keys.normalize_path(F.regexp_replace(bare, r"^\*", "")).alias("path"), bare.startswith("*").alias("enabled")).alias("identity"))
    acts = own.where("section = 'input'").select("project", "pos", keys.concept_id("action", "key").alias("id"), F.lit("action").alias("kind"), js(F.col("key").alias("name")).alias("identity"))
    groups = own.where("section = 'global_group'").select("project", "pos", keys.concept_id("group", "key").alias("id"), F.lit("group").alias("kind"), js(F.col("key").alias("name"), F.lit(True).alias("predeclared")).alias("identity"))
    pattern = r"^(\w+)/layer_(\d+)$"
    named = own.where("section = 'layer_names'").where(F.col("key").rlike(pattern)).select("project", "pos", F.regexp_extract("key", pattern, 1).alias("category"), F.regexp_extract("key", pattern, 2).cast("int").alias("index"), bare.alias("name"))
    last = named.groupBy("project", "index", "category").agg(F.max_by("name", "pos").alias("name"), F.max("pos").alias("pos"))
    merged = last.groupBy("project", "index").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "name")))).alias("names"), F.max("pos").alias("pos"))
    layers = merged.select("project", "pos", keys.concept_id("layer", F.col("index").cast("string")).alias("id"), F.lit("layer").alias("kind"), js(F.col("index"), F.col("names")).alias("identity"))
    every = auto.unionByName(acts).unionByName(groups).unionByName(layers)
    one = every.groupBy("project", "id").agg(F.max_by(F.struct("kind", "identity"), "pos").alias("x"))
    null = F.lit(None)
    return one.select("project", "id", "x.kind", null.cast("string").alias("path"), null.cast("int").alias("line"), "x.identity", null.cast("string").alias("properties"))


def read_settings(spark: SparkSession, root: str) -> DataFrame:
    """project, content of the settings file of ``root``; no row if there is none."""
    at = posixpath.join(root, SETTINGS_FILE)
    rows = [(root, Path(at).read_text(encoding="utf-8", errors="replace"))] if os.path.isfile(at) else []
    return spark.createDataFrame(rows, "project string, content string")


def counts(nodes: DataFrame) -> DataFrame:
    """kind, n."""
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


