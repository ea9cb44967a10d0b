"""Identifiers and match keys as Column expressions (no Python on the executors).

Every function takes Columns (or column names) and returns a Column.  Null in, null out, unless a
function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

#: Engine schemes of a path.
RES, USER, UID = "res://", "user://", "uid://"
_WS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def _c(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Written out, an expression that uses its parts several times grows until the generated method is
    too large for the JIT compiler; a lambda over a one-element array binds the part instead.
    """
    return F.get(F.transform(F.array(value), body), 0)


def trim_ws(value: ColumnLike) -> Column:
    """Trim Unicode white space on both sides (SQL's ``trim`` strips blanks only).

    The regular expression runs only where the first or last character is no printable ASCII.
    """
    c = _c(value)
    printable = F.ascii(c).between(33, 126) & _ends_printable(c)
    return F.when(printable, c).otherwise(F.regexp_replace(c, _WS, ""))


def fold_segments(body: ColumnLike) -> Column:
    """Clean a ``/``-path: empty and ``.`` segments vanish, ``..`` removes the one before it."""
    b = _c(body)
    framed = F.concat(F.lit("/"), b, F.lit("/"))
    dirty = framed.contains("//") | framed.contains("/./") | framed.contains("/../")
    return F.when(~dirty, b).otherwise(_folded(b))


def _folded(body: Column) -> Column:
    return F.aggregate(
        F.split(body, "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "") | (x == "."), acc)
        .when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(x))),
        lambda acc: F.array_join(acc, "/"),
    )


def clean_node_path(path: ColumnLike) -> Column:
    """A scene-tree path: trimmed, without empty and ``.`` segments; nothing left is ``.``."""
    t = trim_ws(path)
    kept = F.array_join(F.filter(F.split(t, "/"), lambda x: (x != "") & (x != ".")), "/")
    framed = F.concat(F.lit("/"), t, F.lit("/"))
    dirty = framed.contains("//") | framed.contains("/./")
    return F.when(~dirty, t).otherwise(F.when(kept == "", F.lit(".")).otherwise(kept))


def canonical_key(value: ColumnLike) -> Column:
    """The id that a key in a referring column means.

    Outer white space goes; a leading ``res:`` that is not part of ``res://`` goes, with the blanks
    after it; of ``res://`` keys the file part (before the first ``::``) is trimmed and cleaned.
    """
    c = _c(value)

    def path(u: Column) -> Column:
        return let(F.substring_index(u, "::", 1), lambda f: F.concat(F.lit(RES), _folded(F.substring(F.regexp_replace(f, _WS, ""), 7, 1 << 30)), F.substring(u, F.length(f) + 1, F.lit(1 << 30))))

    def stripped(t: Column) -> Column:
        inner = F.when(t.startswith("res:") & ~t.startswith(RES), F.regexp_replace(F.substring(t, 5, 1 << 30), _WS, "")).otherwise(t)
        return let(inner, lambda u: F.when(u.startswith(RES), path(u)).otherwise(u))

    whole = let(F.regexp_replace(c, _WS, ""), stripped)
    # most keys are canonical already, which a few byte searches tell
    tail = F.substring(c, 6, 1 << 30)
    unclean = tail.contains("//") | tail.contains("/.") | tail.contains("/:") | tail.endswith("/")
    clean_path = ~unclean & _ends_printable(c) & _ends_printable(F.substring_index(c, "::", 1))
    clean = F.when(c.startswith(RES), clean_path).otherwise(~c.startswith("res:") & F.ascii(c).between(33, 126) & _ends_printable(c))
    return F.when(clean, c).otherwise(whole)


def _ends_printable(c: Column) -> Column:
    return F.ascii(F.right(c, F.lit(1))).between(33, 126)


def normalize_path(path: ColumnLike) -> Column:
    """A project path in ``res://`` form; ``user://`` keeps its scheme, ``uid://`` stays, empty stays empty."""
    t = trim_ws(path)
    body = F.when(t.startswith(RES), F.substring(t, 7, 1 << 30)).when(t.startswith(USER), F.substring(t, 8, 1 << 30)).otherwise(t)
    scheme = F.when(t.startswith(USER), F.lit(USER)).otherwise(F.lit(RES))
    return F.when((t == "") | t.startswith(UID), t).otherwise(F.concat(scheme, fold_segments(body)))


def is_reference(key: ColumnLike) -> Column:
    """Whether a canonical key can name a record: false for null, empty and symbolic keys."""
    k = _c(key)
    symbolic = F.lit(False)
    for prefix in ("signal:", "nodepath:", "rpc:", USER, UID):
        symbolic = symbolic | k.startswith(prefix)
    return F.coalesce(k.isNotNull() & (k != "") & ~symbolic, F.lit(False))


# ---- match keys -------------------------------------------------------------------------------


def _wild(value: ColumnLike) -> Column:
    """Trimmed, with ``*`` for null or empty."""
    return F.coalesce(F.nullif(trim_ws(value), F.lit("")), F.lit("*"))


def signal_key(emitter: ColumnLike, name: ColumnLike) -> Column:
    return F.concat(F.lit("signal:"), _wild(emitter), F.lit(":"), trim_ws(name))


def rpc_key(owner: ColumnLike, method: ColumnLike) -> Column:
    return F.concat(F.lit("rpc:"), _wild(owner), F.lit(":"), trim_ws(method))


def resource_key(path: ColumnLike) -> Column:
    return F.concat(F.lit("res:"), normalize_path(path))


def prefixed(prefix: str, name: ColumnLike) -> Column:
    """``action:``, ``group:``, ``autoload:`` and ``nodepath:`` match keys; the name is trimmed."""
    return F.concat(F.lit(prefix + ":"), trim_ws(name))


# ---- ids --------------------------------------------------------------------------------------


def file_id(path: ColumnLike) -> Column:
    return normalize_path(path)


def symbol_id(file: ColumnLike, symbol: ColumnLike) -> Column:
    return F.concat(normalize_path(file), F.lit("::"), _c(symbol))


def signal_id(file: ColumnLike, name: ColumnLike) -> Column:
    return F.concat(normalize_path(file), F.lit("::signal:"), _c(name))


def scene_node_id(scene: ColumnLike, node_path: ColumnLike) -> Column:
    return F.concat(normalize_path(scene), F.lit("::"), _c(node_path))


def concept_id(prefix: str, name: ColumnLike) -> Column:
    """``action:``, ``group:``, ``autoload:``, ``class:`` and ``layer:`` ids; the name stays as it is."""
    return F.concat(F.lit(prefix + ":"), _c(name).cast("string"))


def extension_id(path: ColumnLike) -> Column:
    return F.concat(F.lit("ext:"), normalize_path(path))


def doc_id(path: ColumnLike) -> Column:
    """A path relative to the repository, without outer white space and a leading ``./``."""
    return F.regexp_replace(trim_ws(path), r"^\./", "")


def scene_path(parent: ColumnLike, name: ColumnLike) -> Column:
    """Path of a scene node from its ``parent`` attribute; none means the root, ``.``."""
    p, n = _c(parent), _c(name)
    return F.when(p.isNull() | (p == ""), F.lit(".")).when(p == ".", n).otherwise(F.concat(p, F.lit("/"), n))


def _head_tail(value: ColumnLike) -> tuple[Column, Column]:
    c = _c(value)
    head = F.substring_index(c, "::", 1)
    return head, F.when(F.instr(c, "::") > 0, F.substring(c, F.length(head) + 3, F.lit(1 << 30)))


def _is_scene(head: Column) -> Column:
    return head.endswith(".tscn") | head.endswith(".scn")


def parse_symbol_id(value: ColumnLike) -> Column:
    """``struct(file, name)`` of a symbol id, else null (signals and scene nodes are none)."""
    head, tail = _head_tail(value)
    ok = tail.isNotNull() & ~tail.startswith("signal:") & ~_is_scene(head)
    return F.when(ok, F.struct(head.alias("file"), tail.alias("name")))


def parse_signal_id(value: ColumnLike) -> Column:
    head, tail = _head_tail(value)
    return F.when(tail.startswith("signal:"), F.struct(head.alias("file"), F.substring(tail, 8, 1 << 30).alias("name")))


def parse_scene_node_id(value: ColumnLike) -> Column:
    head, tail = _head_tail(value)
    return F.when(tail.isNotNull() & _is_scene(head), F.struct(head.alias("file"), tail.alias("name")))


def asset_edge_type(resource_type: ColumnLike) -> Column:
    """Edge type of a reference to an asset, by the resource type that it was declared with."""
    t = _c(resource_type)
    return (
        F.when(t.isin("PackedScene", "Resource"), "loads_resource")
        .when(t == "Shader", "uses_shader")
        .when(t == "Theme", "uses_theme")
        .when(t.contains("Material"), "uses_material")
        .otherwise("uses_asset")
    )


def repository(key: ColumnLike) -> Column:
    """First path segment of a ``res://`` key; null for others."""
    k = _c(key)
    return F.when(k.startswith(RES), F.split_part(F.substring(k, 7, 1 << 30), F.lit("/"), F.lit(1)))


def path_distance(node_path: ColumnLike) -> Column:
    """Number of upward steps (``..``) in a node path: how far a reach goes."""
    return F.size(F.filter(F.split(_c(node_path), "/"), lambda x: x == ".."))
