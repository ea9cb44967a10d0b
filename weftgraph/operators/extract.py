"""From files to a project: nodes, edges and boundary points.

Each file is parsed once, where it lies, into primitive facts (``sources.script_facts``,
``sources.section_facts``), which are written to a table.  Everything else is joins and projections of
that table: what a call means is looked up in a small table of rules, resources are dereferenced by (file,
id), connections find the handler's script and the emitter's type by (scene, node path), local calls the
functions of their file, loads the known paths, heads of chains the registered autoloads.

Defined results: a repeated declaration counts once, the last; files that do not parse give what could
be read and a diagnostic; binary resources give a diagnostic only; null contents count as empty.
Resolved flags say what the file itself shows: editor references are resolved without a look at
their target.  ``edge_id`` and ``boundary_id`` are hashes of where the fact stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions import keys
from weftgraph.plans.materialize import cut
from weftgraph.plans.together import together
from weftgraph.project import BOUNDARY_COLUMNS, EDGE_COLUMNS, NODE_COLUMNS, NODE_SCHEMA, Project
from weftgraph.sources import discovery, script_facts, section_facts

FACT_COLUMNS = ["line", "fact", "owner", "a", "b", "c", "d", "e"]
FACT_SCHEMA = "file string, seq int, line int, fact string, owner string, a string, b string, c string, d string, e string"

#: What a call of a name means: form, method, argument that counts, meaning.
CALL_RULES = [
    ("plain", "emit_signal", 0, "emit"), ("plain", "connect", 0, "connect"), ("plain", "preload", 0, "preload"), ("plain", "load", 0, "load"), ("plain", "ResourceLoader", 0, "load"),
    ("plain", "get_node", 0, "reach"), ("plain", "get_node_or_null", 0, "reach"), ("plain", "add_to_group", 0, "join"), ("plain", "change_scene_to_file", 0, "scene"),
    ("plain", "change_scene_to_packed", 0, "scene"), ("plain", "rpc", 0, "rpc"), ("plain", "rpc_id", 1, "rpc"),
    ("attr", "emit", -1, "emit"), ("attr", "connect", -1, "connect"), ("attr", "change_scene_to_file", 0, "scene"), ("attr", "change_scene_to_packed", 0, "scene"), ("attr", "call_group", 0, "group"),
    ("attr", "call_group_flags", 1, "group"), ("attr", "get_nodes_in_group", 0, "group"), ("attr", "rpc", 0, "rpc"), ("attr", "rpc_id", 1, "rpc"), ("attr", "load", 0, "load_from"),
]
ACTION_METHODS = ("is_action_pressed", "is_action_just_pressed", "is_action_just_released", "is_action_released", "get_action_strength", "get_action_raw_strength")
FILE_RECEIVERS = ("FileAccess", "ConfigFile", "DirAccess")
VIRTUALS = ("_init", "_ready", "_enter_tree", "_exit_tree", "_process", "_physics_process", "_draw", "_get_configuration_warnings", "_to_string", "_integrate_forces", "_get", "_set", "_get_property_list")
INPUT_HANDLERS = ("_input", "_unhandled_input", "_unhandled_key_input", "_gui_input", "_shortcut_input")

#: Properties whose bits name layers.
LAYER_PROPERTIES = ("collision_layer", "collision_mask", "light_mask", "visibility_layer", "layers", "navigation_layers", "light_cull_mask")

#: Parsers by extension; more languages may be added.
PARSERS = {
    "gd": script_facts.facts,
    "tscn": section_facts.facts,
    "tres": section_facts.facts,
    "import": lambda t: section_facts.facts(t, True),
    "gdextension": lambda t: section_facts.facts(t, True),
    "cfg": lambda t: section_facts.facts(t, True),
}
BINARY_MESSAGE = "binary resource: nothing is extracted; save it as text"


def facts_of(files: DataFrame, parsers: dict = PARSERS) -> DataFrame:
    """The facts of ``files`` (path, content, binary), a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("seq", pa.int32()), ("line", pa.int32()), *[(c, pa.string()) for c in FACT_COLUMNS[1:]]])
        for batch in batches:
            rows: list[tuple] = []
            for path, content, binary in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "binary"))):
                parse = parsers.get(path.rpartition(".")[2].lower())
                if binary:
                    rows.append((path, 0, 0, "problem", None, BINARY_MESSAGE, None, None, None, None))
                elif parse:
                    rows += [(path, i, *f) for i, f in enumerate(parse(content or ""))]
            columns = list(zip(*rows)) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return files.where("path is not null").select("path", "content", "binary").mapInArrow(run, FACT_SCHEMA)


def _json(**columns: Column) -> Column:
    """A JSON object without its null fields; null if nothing is left."""
    return F.nullif(F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()])), F.lit("{}"))


def _text(c: str | Column) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _within(file: str | Column, path: str | Column) -> Column:
    return keys.scene_node_id(file, path)


_EDGE = ["file", "seq", "line", "type", "source_id", "target_id", "origin", "resolved", "confidence", "properties"]
_POINT = ["file", "seq", "line", "direction", "type", "node_id", "match_key", "meta"]


def _edge(rows: DataFrame, type_: str | Column, source: Column, target: Column, origin: str, resolved: bool | Column, properties: Column | None = None, confidence: Column | None = None) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(
        "file", "seq", "line", lit(type_).alias("type"), source.alias("source_id"), target.alias("target_id"), F.lit(origin).alias("origin"), lit(resolved).alias("resolved"),
        (confidence if confidence is not None else F.lit(1.0)).alias("confidence"), (properties if properties is not None else F.lit(None).cast("string")).alias("properties"),
    )


def _point(rows: DataFrame, direction: str, type_: str | Column, node: Column, key: Column, meta: Column | None = None) -> DataFrame:
    return rows.select(
        "file", "seq", "line", F.lit(direction).alias("direction"), (type_ if isinstance(type_, Column) else F.lit(type_)).alias("type"), node.alias("node_id"), key.cast("string").alias("match_key"),
        (meta if meta is not None else F.lit(None).cast("string")).alias("meta"),
    )


# ---- scripts ---------------------------------------------------------------------------------


def _owner() -> Column:
    return F.when(F.col("owner").isNull(), F.col("file")).otherwise(keys.symbol_id("file", "owner"))


def calls(facts: DataFrame, rules: list[tuple] = CALL_RULES) -> DataFrame:
    """file, seq, line, owner_id, does, literal, raw, next, before, emitter of the calls that mean something.

    ``literal`` is the argument that counts if it is a string, ``raw`` its source if not, ``next`` the string after it.
    """
    spark = facts.sparkSession
    table = F.broadcast(spark.createDataFrame(rules, "a string, b string, arg int, does string"))  # a setting of some twenty rows
    rows = facts.where("fact = 'call'").join(table, ["a", "b"], "left")
    by_head = F.when((F.col("c") == "Input") & F.col("b").isin(*ACTION_METHODS), "action").when(F.col("c").isin(*FILE_RECEIVERS), "file")
    does = F.coalesce(F.col("does"), F.when(F.col("a") == "attr", by_head).otherwise("local"))
    arg = F.coalesce("arg", F.lit(0))
    nth = lambda k, after=0: F.when(arg == 0, F.get_json_object("e", f"$[{after}].{k}")).when(arg == 1, F.get_json_object("e", f"$[{1 + after}].{k}"))
    return rows.select(
        "file", "seq", "line", "owner", _owner().alias("owner_id"), F.col("b").alias("method"), F.col("c").alias("head"), does.alias("does"), nth("s").alias("literal"), F.coalesce(nth("x"), F.lit("")).alias("raw"), nth("s", 1).alias("next"),
        F.get_json_object("d", "$[0]").alias("before"), F.get_json_object("d", "$[1]").alias("emitter"),
    ).where("does is not null and (does <> 'load_from' or head = 'ResourceLoader')")


def script_parts(facts: DataFrame, known: DataFrame, autoloads: DataFrame, groups_in_scenes: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """(edges, boundary points) of scripts.

    ``known``: path of every file; ``autoloads``: name; ``groups_in_scenes``: file (of a script), group of the nodes that it is attached to.
    """
    edges, points = [], []
    file, me = F.col("file"), F.col("owner_id")
    there = known.select(F.col("path").alias("want"), F.lit(True).alias("there")).distinct()

    # declarations
    ext = facts.where("fact = 'extends'").withColumn("want", F.when(F.col("a") == "path", keys.normalize_path("b"))).join(there, "want", "left")
    edges.append(_edge(ext, "extends", file, F.coalesce("want", keys.concept_id("class", "b")), "code", F.coalesce("there", F.lit(False))))
    sig = facts.where("fact = 'signal'")
    edges.append(_edge(sig, "declares_signal", file, keys.signal_id("file", "a"), "code", True))
    exp = facts.where("fact = 'export'")
    edges.append(_edge(exp, "exports_var", file, keys.symbol_id("file", "a"), "code", True, _json(var=F.col("a"), type=F.col("b"))))
    fun = facts.where("fact = 'func'").withColumn("owner_id", keys.symbol_id("file", "a"))
    entry = F.when(F.col("a").isin(*INPUT_HANDLERS), "input_handler").when(F.col("a") == "_notification", "notification").when(F.col("a").startswith("_on_"), "signal_handler").when(F.col("a").isin(*VIRTUALS), "lifecycle")
    points.append(_point(fun.where(entry.isNotNull()), "ingress", entry, me, F.lit(None), F.when(entry.isin("signal_handler", "lifecycle"), _json(method=F.col("a")))))
    remote = fun.where(F.array_contains(F.split("d", ","), "rpc"))
    edges.append(_edge(remote, "rpc_endpoint", me, keys.rpc_key("owner", "a"), "code", False))
    points.append(_point(remote, "ingress", "rpc_endpoint", me, keys.rpc_key("owner", "a")))

    # calls
    c = cut(calls(facts), "calls")
    of = lambda *does: c.where(F.col("does").isin(*does))
    named = F.coalesce("literal", "raw")
    for does, kind, point in (("emit", "emits_signal", "signal_emit"), ("connect", "connects_signal", "signal_connect")):
        signal = F.when(F.col("head").isNotNull() & (F.col("before") != ""), F.col("before")).otherwise(named)
        key, meta = keys.signal_key("emitter", signal), _json(signal=signal)
        edges.append(_edge(of(does), kind, me, key, "code", False, meta))
        points.append(_point(of(does), "egress", point, me, key, meta))
    static = F.col("literal").isNotNull()
    half = F.when(static, 1.0).otherwise(0.5)
    loads = of("load", "load_from", "preload", "scene").withColumn("want", keys.normalize_path("literal")).join(there, "want", "left")
    is_scene = F.col("does") == "scene"
    props = _json(via=F.when(F.col("does") == "preload", F.lit("preload")), dynamic=F.when(~static, F.lit(True)), expr=F.when(~static, F.col("raw")))
    edges.append(_edge(loads, F.when(is_scene, "changes_scene_to").otherwise("loads_resource"), me, F.when(static, keys.resource_key("literal")).otherwise(F.col("raw")), "code", F.coalesce("there", F.lit(False)) & static, props, half))
    points.append(_point(loads, "egress", F.when(is_scene, "scene_change").otherwise("resource_load"), me, F.when(static, keys.resource_key("literal")), props))
    arrow = facts.where("fact = 'reach'").select("file", "seq", "line", _owner().alias("owner_id"), F.col("a").alias("literal"), F.lit("").alias("raw"))
    reach = arrow.unionByName(of("reach").select("file", "seq", "line", "owner_id", "literal", "raw"))
    key = keys.prefixed("nodepath", named)
    meta = F.when(static, _json(path=F.col("literal"))).otherwise(_json(dynamic=F.lit(True), expr=F.col("raw")))
    edges.append(_edge(reach, "references_node", me, key, "code", False, meta, half))
    points.append(_point(reach, "egress", "node_reach", me, key, meta))
    edges.append(_edge(of("join").where(static), "in_group", file, keys.concept_id("group", "literal"), "code", True, _json(group=F.col("literal"))))
    groups = of("group").where(static)
    edges.append(_edge(groups, "calls_group", me, keys.concept_id("group", "literal"), "code", True, _json(group=F.col("literal"))))
    points.append(_point(groups, "egress", "group_call", me, keys.prefixed("group", "literal"), _json(group=F.col("literal"))))
    # the methods that a group call names, in the files that join the group
    joined = of("join").where(static).select("file", F.col("literal").alias("group")).unionByName(groups_in_scenes).distinct()
    asked = groups.where("method in ('call_group', 'call_group_flags') and next is not null").select(F.col("literal").alias("group"), F.col("next").alias("a")).distinct()
    targets = fun.join(joined.join(asked, "group").distinct(), ["file", "a"])
    points.append(_point(targets, "ingress", "group_target", me, keys.prefixed("group", "group"), _json(group=F.col("group"), method=F.col("a"))))
    rpc = of("rpc").where(static)
    edges.append(_edge(rpc, "rpc_call", me, keys.rpc_key(F.lit("*"), "literal"), "code", False, _json(method=F.col("literal"))))
    points.append(_point(rpc, "egress", "rpc_call", me, keys.rpc_key(F.lit("*"), "literal"), _json(method=F.col("literal"))))
    edges.append(_edge(of("action").where(static), "uses_action", me, keys.concept_id("action", "literal"), "code", True, _json(action=F.col("literal"))))
    path = _text("literal")
    points.append(_point(of("file"), "egress", "file_io", me, keys.resource_key(path), _json(path=path)))
    local = of("local").join(fun.select("file", F.col("a").alias("method")).distinct(), ["file", "method"], "left_semi")
    edges.append(_edge(local, "calls", me, keys.symbol_id("file", "method"), "code", True))

    # autoloads: once for each owner and name
    heads = facts.where("fact = 'head'").join(autoloads.select(F.col("name").alias("a")).distinct(), "a", "left_semi")
    first = heads.groupBy("file", "owner", "a").agg(F.min(F.struct("seq", "line")).alias("x")).select("file", "owner", "a", "x.seq", "x.line").withColumn("owner_id", _owner())
    edges.append(_edge(first, "accesses_autoload", me, keys.concept_id("autoload", "a"), "code", True))
    points.append(_point(first, "egress", "autoload_access", me, keys.prefixed("autoload", "a")))
    return edges, points


def script_nodes(facts: DataFrame) -> DataFrame:
    """seq and node columns of signals, methods and classes."""
    sig = facts.where("fact = 'signal'")
    params = F.when(F.col("b") != "", F.split("b", ","))
    out = sig.select("seq", keys.signal_id("file", "a").alias("id"), F.lit("signal").alias("kind"), F.col("file").alias("path"), "line", _json(name=F.col("a"), params=params, script=F.col("file")).alias("identity"), F.lit(None).cast("string").alias("properties"))
    flags = F.split("d", ",")
    virtual = F.col("a").isin(*VIRTUALS, *INPUT_HANDLERS, "_notification")
    fun = facts.where("fact = 'func'").select(
        "seq", keys.symbol_id("file", "a").alias("id"), F.lit("method").alias("kind"), F.col("file").alias("path"), "line",
        _json(name=F.col("a"), arity=F.col("c").cast("int"), static=F.array_contains(flags, "static"), virtual=virtual, return_type=F.col("b"), rpc=F.when(F.array_contains(flags, "rpc"), F.lit(True))).alias("identity"),
        _json(complexity=F.col("e").cast("int")).alias("properties"),
    )
    # a class is known from its first mention; its declaration adds the script
    mentions = facts.where("fact = 'class_name' or (fact = 'extends' and a = 'class')").select(F.when(F.col("fact") == "class_name", F.col("a")).otherwise(F.col("b")).alias("name"), F.when(F.col("fact") == "class_name", F.col("file")).alias("script"))
    classes = mentions.groupBy("name").agg(F.max("script").alias("script"))
    classes = classes.select(F.lit(0).alias("seq"), keys.concept_id("class", "name").alias("id"), F.lit("class").alias("kind"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line"), _json(name=F.col("name"), script=F.col("script")).alias("identity"), F.lit(None).cast("string").alias("properties"))
    return out.unionByName(fun).unionByName(classes)


def script_identities(facts: DataFrame) -> DataFrame:
    """file, identity parts of every script, lists in the order of the source.  A list is as long as its file."""
    kept = facts.where("fact in ('extends', 'class_name', 'export', 'const', 'enum', 'onready', 'inner_class')")
    lists = lambda fact: F.transform(F.array_sort(F.collect_list(F.when(F.col("fact") == fact, F.struct("seq", "a")))), lambda x: x["a"])
    some = lambda c: F.when(F.size(c) > 0, c)
    last = lambda test, c: F.max_by(F.when(test, c), F.when(test, F.col("seq")))
    ext, cls = F.col("fact") == "extends", F.col("fact") == "class_name"
    return kept.groupBy("file").agg(
        last(ext & (F.col("a") == "class"), F.col("b")).alias("extends"), last(ext & (F.col("a") == "path"), keys.normalize_path("b")).alias("extends_path"), last(cls, F.col("a")).alias("class_name"),
        *[some(lists(f)).alias(n) for f, n in (("export", "exports"), ("const", "consts"), ("enum", "enums"), ("onready", "onready"), ("inner_class", "inner_classes"))],
    )


# ---- section texts -----------------------------------------------------------------------------


def dereferenced(facts: DataFrame, uids: DataFrame) -> DataFrame:
    """The facts that name an external resource, with target, rtype: by its declared path, else by its uid; others are left out."""
    ext = facts.where("fact = 'ext'").groupBy("file", F.col("a").alias("rid")).agg(F.max_by(F.struct(F.col("b").alias("rtype"), F.col("c").alias("rpath"), F.col("d").alias("uid")), "seq").alias("x")).select("file", "rid", "x.*")
    placed = ext.join(uids.select("uid", F.col("path").alias("upath")), "uid", "left").select("file", "rid", "rtype", F.coalesce(keys.normalize_path(_text("rpath")), "upath").alias("target"))
    rid = F.when(F.col("fact") == "node", F.col("e")).when(F.col("fact") == "ref", F.when(F.col("b") == "ExtResource", F.col("c"))).when(F.col("fact").isin("script", "sub_script"), F.col("a"))
    rows = facts.where("fact in ('node', 'ref', 'script', 'sub_script')").withColumn("rid", rid).where("rid is not null")
    return rows.join(placed, ["file", "rid"]).where("target is not null and target <> ''")


def section_parts(facts: DataFrame, listing: DataFrame, uids: DataFrame) -> tuple[list[DataFrame], list[DataFrame], DataFrame, DataFrame]:
    """(edges, boundary points, nodes with seq, groups of attached scripts) of scenes, resources, sidecars.  ``listing``: path, kind."""
    edges, points = [], []
    kinds = listing.select(F.col("path").alias("file"), F.col("kind").alias("fkind"))
    own = cut(facts.where("fact in ('ext', 'node', 'group', 'script', 'sub_script', 'ref', 'value', 'connection', 'editable')").join(kinds.where("fkind in ('scene', 'resource')"), "file"), "sections")
    met = cut(dereferenced(own, uids), "references")
    file, here = F.col("file"), F.when(F.col("owner").isNull(), F.col("file")).otherwise(_within("file", "owner"))
    scene = F.col("fkind") == "scene"

    scripts = met.where("fact in ('script', 'sub_script')").where(~(scene & (F.col("fact") == "sub_script"))).where(~(scene & F.col("owner").isNull()))
    edges.append(_edge(scripts, "attaches_script", here, F.col("target"), "editor", True))
    marked = own.where("fact = 'editable'").select("file", F.col("a").alias("d"), F.lit(True).alias("editable")).distinct()
    edges.append(_edge(met.where("fact = 'node'").join(marked, ["file", "d"], "left"), "instances", file, F.col("target"), "editor", True, _json(node=F.col("d"), editable=F.col("editable"))))
    edges.append(_edge(own.where("fact = 'group'"), "in_group", here, keys.concept_id("group", "a"), "editor", True))
    paths = own.where("fact = 'ref' and b = 'NodePath'")
    edges.append(_edge(paths, "references_node", here, keys.prefixed("nodepath", "c"), "editor", False, _json(property=F.col("a"), path=F.col("c"))))
    edges.append(_edge(met.where("fact = 'ref'"), keys.asset_edge_type("rtype"), file, F.col("target"), "editor", True, _json(property=F.col("a"))))

    # the tracks of an animation, and the layers that a node's bits name
    tracks = paths.where("owner is null and a like 'tracks/%/path'")
    edges.append(_edge(tracks, "animates", file, keys.prefixed("nodepath", F.substring_index("c", ":", 1)), "editor", False, _json(property=F.col("a"), path=F.col("c"))))
    masks = own.where("fact = 'value' and b = 'int'").where(F.col("a").isin(*LAYER_PROPERTIES)).withColumn("bits", F.conv("c", 10, 2)).withColumn("i", F.explode(F.sequence(F.lit(1), F.length("bits"))))
    edges.append(_edge(masks.where(F.substring("bits", F.length("bits") - F.col("i") + 1, F.lit(1)) == "1"), "uses_layer", here, keys.concept_id("layer", "i"), "editor", True, _json(property=F.col("a"))))

    # connections: the emitter's type and the handler's script, by node path
    nodes = own.where("fact = 'node'")
    types = nodes.where("b <> ''").groupBy("file", F.col("d").alias("from_")).agg(F.max_by("b", "seq").alias("etype"))
    handlers = met.where("fact = 'script'").groupBy("file", F.col("owner").alias("to_")).agg(F.max_by("target", "seq").alias("handler"))
    con = own.where("fact = 'connection'").where(scene).withColumn("from_", F.col("b")).withColumn("to_", F.col("c")).join(types, ["file", "from_"], "left").join(handlers, ["file", "to_"], "left")
    key = keys.signal_key("etype", "a")
    method = F.when(F.col("handler").isNotNull(), keys.symbol_id("handler", "d"))
    props = F.to_json(F.struct(F.col("a").alias("signal"), F.col("b").alias("from"), F.col("c").alias("to"), F.col("d").alias("method"), F.col("e").cast("int").alias("flags")))
    edges.append(_edge(con, "connects_signal", _within("file", "b"), F.coalesce(method, key), "editor", method.isNotNull(), props))
    points.append(_point(con, "ingress", "editor_connection", F.coalesce(method, F.lit("")), key, props))

    # sidecars
    remap = facts.where("fact = 'setting' and a = 'remap' and b in ('importer', 'type')").groupBy("file").agg(F.max(F.when(F.col("b") == "importer", F.col("c"))).alias("importer"), F.max(F.when(F.col("b") == "type", F.col("c"))).alias("rtype"))
    cars = listing.where("kind = 'import'").select(F.col("path").alias("file"), F.regexp_replace("path", r"\.import$", "").alias("asset"))
    paired = cars.join(listing.where("kind = 'asset'").select(F.col("path").alias("asset")), "asset", "left_semi").join(remap, "file", "left").select("*", F.lit(0).alias("seq"), F.lit(0).alias("line"))
    edges.append(_edge(paired, "imports", F.col("asset"), file, "config", True, _json(importer=_text("importer"), type=_text("rtype"))))

    # what scenes assign to exported variables of attached scripts
    exported = facts.where("fact = 'export'").select(F.col("file").alias("target"), F.col("a").alias("property")).distinct()
    attached = met.where("fact = 'script'").where(scene).select("file", "owner", "target").distinct()
    values = own.where("fact = 'value'").where(scene).withColumn("property", F.col("a")).join(attached, ["file", "owner"]).join(exported, ["target", "property"], "left_semi")
    edges.append(_edge(values, "binds_export", here, keys.symbol_id("target", "a"), "editor", True, _json(value_type=F.col("b"), value=F.col("c"))))

    instance = met.where("fact = 'node'").select("file", "seq", F.col("target").alias("instance"))
    script = handlers.select("file", F.col("to_").alias("d"), F.col("handler").alias("script"))
    full = nodes.where(scene).join(instance, ["file", "seq"], "left").join(script, ["file", "d"], "left")
    identity = _json(name=F.col("a"), scene=file, node_type=_text("b"), root=F.when(F.col("c") == "", F.lit(True)), parent=_text("c"), instance=F.col("instance"), script=F.col("script"))
    made = full.select("seq", _within("file", "d").alias("id"), F.lit("scene_node").alias("kind"), file.alias("path"), "line", identity.alias("identity"), F.lit(None).cast("string").alias("properties"))
    in_group = own.where("fact = 'group'").select("file", "owner", F.col("a").alias("group")).join(attached, ["file", "owner"]).select(F.col("target").alias("file"), "group")
    return edges, points, made, in_group


# ---- all of it -----------------------------------------------------------------------------------


def extracted(files: DataFrame, concepts: DataFrame | None = None, main_scene: str | None = None) -> Project:
    """The project of ``files`` (path as id, content, binary) and of what its settings declare.

    ``concepts``: nodes of autoloads, actions, groups and layers.
    """
    spark: SparkSession = files.sparkSession
    listed = files.select("path", discovery.kind_of("path").alias("kind")).where("path is not null and kind is not null").distinct()
    listing, facts, uids = together(spark, [partial(cut, listed, "listing"), partial(cut, facts_of(files), "facts"), partial(cut, discovery.uid_map(files), "uids")])
    concepts = concepts if concepts is not None else spark.createDataFrame([], NODE_SCHEMA)
    autoloads = concepts.where("kind = 'autoload'").select(F.substring("id", 10, 1 << 30).alias("name"))
    real = listing.where("kind not in ('import', 'plugin')")
    se, sp, scene_nodes, groups_in_scenes = section_parts(facts, listing, uids)
    fe, fp = script_parts(facts, real.select("path"), autoloads, groups_in_scenes)

    # identities of files
    setting = lambda name: F.max(F.when(F.col("b") == name, F.col("c"))).alias(name)
    registered = facts.where("fact = 'setting' and a = 'configuration' and b in ('entry_symbol', 'compatibility_minimum')").groupBy("file").agg(setting("entry_symbol"), setting("compatibility_minimum"))
    plugins = facts.where("fact = 'setting' and a = 'plugin' and b = 'script' and c <> ''").select(keys.normalize_path(F.concat(F.regexp_replace("file", "[^/]*$", ""), "c")).alias("file"), F.lit(True).alias("editor_plugin")).distinct()
    pairs = listing.where("kind = 'import'").select(F.regexp_replace("path", r"\.import$", "").alias("file"), F.col("path").alias("import"))
    x = real.withColumnRenamed("path", "file").join(script_identities(facts), "file", "left").join(registered, "file", "left").join(plugins, "file", "left").join(pairs, "file", "left")
    of_script, of_ext, of_asset = F.col("kind") == "script", F.col("kind") == "extension", F.col("kind") == "asset"
    names = ["extends", "extends_path", "class_name", "exports", "consts", "enums", "onready", "inner_classes"]
    identity = _json(
        **{n: F.when(of_script, F.col(n)) for n in names}, is_class_name=F.when(of_script & F.col("class_name").isNotNull(), F.lit(True)), editor_plugin=F.col("editor_plugin"),
        entry_symbol=F.when(of_ext, _text("entry_symbol")), compatibility_minimum=F.when(of_ext, _text("compatibility_minimum")), **{"import": F.when(of_asset, F.col("import"))},
        main_scene=F.when(F.col("file") == (main_scene or ""), F.lit(True)),
    )
    nothing = F.lit(None)
    file_nodes = x.select(F.lit(0).alias("seq"), F.col("file").alias("id"), "kind", F.col("file").alias("path"), nothing.cast("int").alias("line"), identity.alias("identity"), nothing.cast("string").alias("properties"))
    every = file_nodes.unionByName(scene_nodes).unionByName(script_nodes(facts)).unionByName(concepts.select(F.lit(0).alias("seq"), *NODE_COLUMNS))
    w = Window.partitionBy("id").orderBy(F.desc("seq"), F.col("identity").desc_nulls_last())
    nodes = every.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*NODE_COLUMNS)

    edges = reduce(DataFrame.unionByName, [e.select(*_EDGE) for e in fe + se])
    edges = edges.select(F.xxhash64("file", "seq", "type", "source_id", "target_id", "properties").alias("edge_id"), *[F.col(c) for c in EDGE_COLUMNS[1:7]], F.col("file").alias("ev_file"), F.col("line").alias("ev_line"), "properties")
    points = reduce(DataFrame.unionByName, [p.select(*_POINT) for p in fp + sp])
    points = points.select(F.xxhash64("file", "seq", "type", "node_id", "match_key").alias("boundary_id"), *[F.col(c) for c in BOUNDARY_COLUMNS[1:5]], F.col("file").alias("ev_file"), F.col("line").alias("ev_line"), "meta")
    source = F.when(F.lower("file").endswith(".gd"), "gdscript").otherwise("scene")
    problems = facts.where("fact = 'problem'").select(source.alias("source"), "file", "line", F.col("a").alias("msg"))
    tables = (("nodes", nodes), ("edges", edges), ("boundaries", points), ("diagnostics", problems))
    return Project(*together(spark, [partial(cut, df, name) for name, df in tables]))
