"""Integrity rules: what a project refers to and does not have, or has and does not use.

A rule is a function from a project to findings, registered by name with its default severity; nearly
every one is an anti join.  A finding is (rule, severity, node_id, edge_id, file, line, message).
Settings may switch rules off, change severities, and suppress a rule for a node.

Where the facts do not suffice to judge (an emitter without a script, a type of the engine), a rule
stays silent.  References count whatever their ``resolved`` flag says.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.keys import path_distance
from weftgraph.operators import resolve
from weftgraph.plans.materialize import cut
from weftgraph.plans.skew import left_join
from weftgraph.plans.together import together
from weftgraph.project import Project

#: Severities, the gravest first.
SEVERITIES = ("error", "warning", "info")
COLUMNS = ("rule", "severity", "node_id", "edge_id", "file", "line", "message")
SCHEMA = "rule string, severity string, node_id string, edge_id long, file string, line int, message string"

Rule = Callable[[Project, "Settings"], DataFrame]
RULES: dict[str, tuple[str, Rule]] = {}


@dataclass(frozen=True)
class Settings:
    """Rule settings; all are small."""

    disabled: frozenset[str] = frozenset()
    severity: dict[str, str] = field(default_factory=dict)
    suppress: tuple[tuple[str, str], ...] = ()  # (rule, node id)
    max_distance: int = 2  # steps up that a node path may take
    entry_scenes: tuple[str, ...] = ()  # scenes that may stand alone
    large_scene: int = 200  # nodes of a scene from which on it is large
    fan_in: int = 10  # from which on a node ought to be documented


def rule(severity: str):
    def register(f: Rule) -> Rule:
        RULES[f.__name__] = (severity, f)
        return f

    return register


def _edges(p: Project, *types: str) -> DataFrame:
    return p.edges.where(F.col("type").isin(*types))


def _without(left: DataFrame, key: str, spread: str, keys: DataFrame) -> DataFrame:
    """Rows of ``left`` whose non-null ``key`` is not in ``keys`` (one column); rows of hot keys are dealt."""
    known = keys.toDF(key).where(F.col(key).isNotNull()).distinct().withColumn("_known", F.lit(True))
    return left_join(left.where(F.col(key).isNotNull()), known, key, spread).where("_known is null").drop("_known")


def _at_edge(rows: DataFrame, message: Column) -> DataFrame:
    return rows.select(F.col("source_id").alias("node_id"), "edge_id", F.col("ev_file").alias("file"), F.col("ev_line").alias("line"), message.alias("message"))


def _at_node(rows: DataFrame, message: Column) -> DataFrame:
    return rows.select(F.col("id").alias("node_id"), F.lit(None).cast("long").alias("edge_id"), F.col("path").alias("file"), "line", message.alias("message"))


def _nodes(p: Project, kind: str) -> DataFrame:
    return p.nodes.where(F.col("kind") == kind)


_EDGE = ["edge_id", "type", "source_id", "target_id", "origin", "ev_file", "ev_line"]


# ---- editor and code -------------------------------------------------------------------------


@rule("error")
def dangling_connection(p: Project, _: Settings) -> DataFrame:
    """An editor connection whose target is no method."""
    rows = _edges(p, "connects_signal").where("origin = 'editor'").select(*_EDGE)
    return _at_edge(_without(rows, "target_id", "edge_id", _nodes(p, "method").select("id")), F.concat(F.lit("no method "), "target_id"))


@rule("error")
def connection_to_missing_signal(p: Project, _: Settings) -> DataFrame:
    """An editor connection to a signal that the script of its emitter does not declare.

    Silent for emitters without a script, and if that script has a base, as the base may declare it.
    """
    c = _edges(p, "connects_signal").where("origin = 'editor'").withColumn("signal", F.get_json_object("properties", "$.signal")).where("signal is not null").select(*_EDGE, "signal")
    scripts = _edges(p, "attaches_script").select(F.col("source_id"), F.substring_index("target_id", "::", 1).alias("script")).distinct()
    based = _edges(p, "extends").where("target_id like 'res://%' or target_id like 'class:%'").select(F.substring_index("source_id", "::", 1).alias("script")).distinct()
    plain = scripts.join(based, "script", "left_anti")
    met = left_join(c, plain, "source_id", "edge_id").where("script is not null").withColumn("want", F.concat("script", F.lit("::signal:"), "signal"))
    return _at_edge(_without(met, "want", "edge_id", _nodes(p, "signal").select("id")), F.concat(F.lit("no signal "), "want"))


@rule("warning")
def dead_export(p: Project, _: Settings) -> DataFrame:
    """An exported variable that no scene assigns."""
    rows = _edges(p, "exports_var").select(*_EDGE)
    return _at_edge(_without(rows, "target_id", "edge_id", _edges(p, "binds_export").select("target_id")), F.concat(F.col("target_id"), F.lit(" is never assigned")))


@rule("warning")
def export_type_mismatch(p: Project, _: Settings) -> DataFrame:
    """A scene assigns an exported variable a value of another type than the declared one.

    Compared are the plain types; a whole number fits a float, and other declared types are not judged.
    """
    names = {"int": ["int"], "float": ["int", "float"], "bool": ["bool"], "String": ["string"], "StringName": ["string"], "Array": ["array"], "Dictionary": ["dict"]}
    declared = _edges(p, "exports_var").select("target_id", F.get_json_object("properties", "$.type").alias("declared")).where("declared is not null").groupBy("target_id").agg(F.min("declared").alias("declared"))
    rows = _edges(p, "binds_export").withColumn("given", F.get_json_object("properties", "$.value_type")).where("given is not null").select(*_EDGE, "given")
    met = left_join(rows, declared, "target_id", "edge_id")
    fits = F.lit(None).cast("boolean")
    for name, ok in names.items():
        fits = F.when(F.col("declared") == name, F.col("given").isin(*ok)).otherwise(fits)
    return _at_edge(met.where(~fits), F.concat(F.col("target_id"), F.lit(" is "), "declared", F.lit(", given "), "given"))


@rule("error")
def undefined_action(p: Project, _: Settings) -> DataFrame:
    """An input action is used and not defined."""
    return _at_edge(_without(_edges(p, "uses_action").select(*_EDGE), "target_id", "edge_id", _nodes(p, "action").select("id")), F.concat("target_id", F.lit(" is not defined")))


@rule("info")
def unused_action(p: Project, _: Settings) -> DataFrame:
    """An input action is defined and never used."""
    return _at_node(_without(_nodes(p, "action").select("id", "path", "line"), "id", "id", _edges(p, "uses_action").select("target_id")), F.concat("id", F.lit(" is never used")))


@rule("warning")
def empty_group_call(p: Project, _: Settings) -> DataFrame:
    """A group is called that nothing joins."""
    return _at_edge(_without(_edges(p, "calls_group").select(*_EDGE), "target_id", "edge_id", _edges(p, "in_group").select("target_id")), F.concat("target_id", F.lit(" has no members")))


@rule("info")
def unused_group(p: Project, _: Settings) -> DataFrame:
    """A group is joined and never called; one finding for each group, at its first member."""
    joined = _edges(p, "in_group").where("target_id is not null")
    first = joined.groupBy("target_id").agg(F.min_by(F.struct("source_id", "edge_id", "ev_file", "ev_line"), "edge_id").alias("m")).select("target_id", "m.*")
    return _at_edge(_without(first, "target_id", "edge_id", _edges(p, "calls_group").select("target_id")), F.concat("target_id", F.lit(" is never called")))


@rule("info")
def unresolved_load(p: Project, _: Settings) -> DataFrame:
    """The path of a load or of a scene change is only known when the game runs."""
    dynamic = F.coalesce(F.get_json_object("properties", "$.dynamic") == "true", F.lit(False)) | F.col("target_id").isNull() | (F.col("target_id") == "")
    return _at_edge(_edges(p, "loads_resource", "changes_scene_to").where(dynamic), F.lit("the path is dynamic"))


@rule("error")
def missing_resource(p: Project, _: Settings) -> DataFrame:
    """A static path names a file that is not there."""
    types = ("loads_resource", "changes_scene_to", "instances", "attaches_script", "uses_asset", "uses_shader", "uses_material", "uses_theme")
    dynamic = F.coalesce(F.get_json_object("properties", "$.dynamic") == "true", F.lit(False))
    rows = _edges(p, *types).where(~dynamic).where("target_id like 'res://%' or target_id like 'uid://%' or target_id like 'res:res://%'").withColumn("target_id", F.regexp_replace("target_id", "^res:(?=res://)", "")).select(*_EDGE)
    return _at_edge(_without(rows, "target_id", "edge_id", p.nodes.select("id")), F.concat("target_id", F.lit(" does not exist")))


# ---- signals and node paths --------------------------------------------------------------------


def _signal_uses(p: Project, *types: str) -> DataFrame:
    """owner, name of signals in edges: from declared ids, match keys and the properties of editor connections.

    ``owner`` is a file or class name, null when it is unknown.
    """
    t = F.col("target_id")
    by_id = F.when(t.contains("::signal:"), F.substring_index(t, "::signal:", -1))
    by_key = F.when(t.startswith("signal:"), F.substring_index(t, ":", -1))
    editor = F.get_json_object("properties", "$.signal")
    owner = F.coalesce(F.when(t.contains("::signal:"), F.substring_index(t, "::signal:", 1)), F.when(t.startswith("signal:"), F.nullif(F.split_part(t, F.lit(":"), F.lit(2)), F.lit("*"))))
    return _edges(p, *types).select(owner.alias("owner"), F.coalesce(editor, by_id, by_key).alias("name")).where("name is not null")


def _unheard(p: Project, declared: DataFrame, *types: str) -> DataFrame:
    """Signals (id, script, name ..) that no edge of the types names: neither with their own owner nor without one."""
    uses = _signal_uses(p, *types)
    key = F.concat_ws("\t", "owner", "name")
    loose = _without(declared, "name", "id", uses.where("owner is null or owner not like 'res://%'").select("name"))
    exact = uses.where("owner like 'res://%'").select(key)
    return _without(loose.withColumn("k", F.concat_ws("\t", "script", "name")), "k", "id", exact)


def _signals(p: Project) -> DataFrame:
    return _nodes(p, "signal").select("id", "path", "line", F.substring_index("id", "::signal:", 1).alias("script"), F.substring_index("id", "::signal:", -1).alias("name"))


@rule("info")
def unused_signal(p: Project, _: Settings) -> DataFrame:
    """A signal is declared and neither emitted nor connected; uses without a known file count by name."""
    return _at_node(_unheard(p, _signals(p), "emits_signal", "connects_signal"), F.concat("id", F.lit(" is never used")))


@rule("info")
def unhandled_signal(p: Project, _: Settings) -> DataFrame:
    """A declared signal is emitted and nothing connects to it; uses without a known file count by name."""
    emitted = _signal_uses(p, "emits_signal").select(F.concat_ws("\t", F.coalesce("owner", F.lit("")), "name").alias("k")).distinct()
    own = _signals(p).withColumn("k", F.concat_ws("\t", "script", "name"))
    some = own.join(emitted, "k", "left_semi").drop("k")
    return _at_node(_unheard(p, some, "connects_signal"), F.concat("id", F.lit(" is emitted to nobody")))


@rule("warning")
def fragile_nodepath(p: Project, s: Settings) -> DataFrame:
    """A node path climbs more than ``max_distance`` steps."""
    rows = _edges(p, "references_node").where("target_id like 'nodepath:%'").withColumn("d", path_distance(F.substring("target_id", 10, 1 << 30)))
    return _at_edge(rows.where(F.col("d") > s.max_distance), F.concat(F.substring("target_id", 10, 1 << 30), F.lit(" climbs "), F.col("d").cast("string"), F.lit(" steps")))


@rule("warning")
def nodepath_unresolved(p: Project, _: Settings) -> DataFrame:
    """A node path leads nowhere in the scenes that it starts from."""
    bad = resolve.node_paths(p).where("reason = 'nodepath_unresolved'").select("edge_id", "path")
    return _at_edge(_edges(p, "references_node").select(*_EDGE).join(bad, "edge_id"), F.concat("path", F.lit(" leads nowhere")))


# ---- dead weight ---------------------------------------------------------------------------


@rule("info")
def orphan_script(p: Project, _: Settings) -> DataFrame:
    """A script that is attached nowhere, no autoload, extended by none and loaded by none."""
    used = _edges(p, "attaches_script", "extends", "loads_resource", "accesses_autoload").select(F.regexp_replace(F.substring_index("target_id", "::", 1), "^res:(?=res://)", ""))
    autoloads = _nodes(p, "autoload").select(F.get_json_object("identity", "$.path"))
    by_class = _nodes(p, "class").select(F.col("id").alias("target_id"), F.get_json_object("identity", "$.script").alias("script")).where("script is not null").join(_edges(p, "extends").select("target_id").distinct(), "target_id", "left_semi").select("script")
    keys = used.toDF("k").unionByName(autoloads.toDF("k")).unionByName(by_class.toDF("k"))
    return _at_node(_without(_nodes(p, "script").select("id", "path", "line"), "id", "id", keys), F.concat("id", F.lit(" is used nowhere")))


@rule("info")
def orphan_scene(p: Project, s: Settings) -> DataFrame:
    """A scene that is instanced, loaded and entered nowhere and is neither the main scene nor a known entry."""
    used = _edges(p, "instances", "changes_scene_to", "loads_resource").select(F.regexp_replace(F.substring_index("target_id", "::", 1), "^res:(?=res://)", ""))
    free = _nodes(p, "scene").where(~F.coalesce(F.get_json_object("identity", "$.main_scene") == "true", F.get_json_object("identity", "$.mainScene") == "true", F.lit(False)))
    if s.entry_scenes:
        free = free.where(~F.col("id").isin(*s.entry_scenes))
    return _at_node(_without(free.select("id", "path", "line"), "id", "id", used), F.concat("id", F.lit(" is entered nowhere")))


@rule("info")
def orphan_asset(p: Project, _: Settings) -> DataFrame:
    """An asset that nothing uses."""
    used = _edges(p, "uses_asset", "uses_shader", "uses_material", "uses_theme", "loads_resource").select(F.regexp_replace("target_id", "^res:(?=res://)", ""))
    return _at_node(_without(_nodes(p, "asset").select("id", "path", "line"), "id", "id", used), F.concat("id", F.lit(" is used nowhere")))


@rule("info")
def orphan_layer(p: Project, _: Settings) -> DataFrame:
    """A named layer that nothing uses."""
    return _at_node(_without(_nodes(p, "layer").select("id", "path", "line"), "id", "id", _edges(p, "uses_layer").select("target_id")), F.concat("id", F.lit(" is never used")))


@rule("info")
def per_frame_cost(p: Project, _: Settings) -> DataFrame:
    """A method that runs every frame, with the number of edges that leave it."""
    frame = _nodes(p, "method").where(F.substring_index("id", "::", -1).isin("_process", "_physics_process")).select("id", "path", "line")
    n = p.edges.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return _at_node(frame.join(n, "id"), F.concat(F.col("n").cast("string"), F.lit(" references every frame")))


@rule("info")
def large_scene(p: Project, s: Settings) -> DataFrame:
    """A scene of more than ``large_scene`` nodes."""
    n = _nodes(p, "scene_node").groupBy(F.substring_index("id", "::", 1).alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > s.large_scene)
    return _at_node(_nodes(p, "scene").select("id", "path", "line").join(n, "id"), F.concat(F.col("n").cast("string"), F.lit(" nodes")))


@rule("warning")
def doc_broken_anchor(p: Project, _: Settings) -> DataFrame:
    """A document refers to something that is not there."""
    return _at_edge(_without(_edges(p, "documents").select(*_EDGE), "target_id", "edge_id", p.nodes.select("id")), F.concat("target_id", F.lit(" does not exist")))


@rule("info")
def doc_malformed_frontmatter(p: Project, _: Settings) -> DataFrame:
    """The head of a document is missing, unreadable, or of an unknown type."""
    return _at_node(_nodes(p, "doc").where(F.get_json_object("identity", "$.problem").isNotNull()), F.get_json_object("identity", "$.problem"))


@rule("info")
def doc_unknown_domain(p: Project, _: Settings) -> DataFrame:
    """A document names a domain in which no node lies (domains are the first folders of a project)."""
    docs = _nodes(p, "doc").select("id", "path", "line", F.get_json_object("identity", "$.domain").alias("domain")).where("domain is not null")
    known = p.nodes.select(F.regexp_extract("id", "^res://([^/]+)/", 1))
    return _at_node(_without(docs, "domain", "id", known), F.concat("domain", F.lit(" is no domain")))


@rule("info")
def doc_uncovered_entity(p: Project, s: Settings) -> DataFrame:
    """An autoload that at least ``fan_in`` sources use and no document covers."""
    busy = _edges(p, "accesses_autoload").select(F.col("target_id").alias("id"), "source_id").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= s.fan_in)
    rows = _nodes(p, "autoload").select("id", "path", "line").join(busy, "id")
    return _at_node(_without(rows, "id", "id", _edges(p, "documents").select("target_id")), F.concat(F.col("n").cast("string"), F.lit(" users, no document")))


# ---- all of them -----------------------------------------------------------------------------


def findings(p: Project, settings: Settings = Settings(), only: tuple[str, ...] = ()) -> DataFrame:
    """The findings of all rules (or of those named), without those that the settings suppress."""
    names = [n for n in RULES if n not in settings.disabled and (not only or n in only)]
    if not names:
        return p.edges.sparkSession.createDataFrame([], SCHEMA)

    def one(name: str) -> DataFrame:
        severity, check = RULES[name]
        level = settings.severity.get(name, severity)
        return check(p, settings).select(F.lit(name).alias("rule"), F.lit(level).alias("severity"), *COLUMNS[2:])

    found = reduce(DataFrame.unionByName, together(p.edges.sparkSession, [partial(one, n) for n in names]))
    if settings.suppress:
        hidden = p.edges.sparkSession.createDataFrame(list(settings.suppress), "rule string, node_id string").distinct()
        found = found.join(hidden, ["rule", "node_id"], "left_anti")
    return found.select(*COLUMNS)


def ordered(found: DataFrame) -> DataFrame:
    """Findings by severity, rule, file, line, then node and edge."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return found.orderBy(rank, "rule", "file", "line", "node_id", "edge_id")


def severity_counts(found: DataFrame) -> DataFrame:
    """severity, rule, n."""
    return found.groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("n"))


def materialised(p: Project) -> Project:
    """The project with its tables written once, for many rules that read them."""
    tables = (("nodes", p.nodes), ("edges", p.edges), ("boundaries", p.boundaries))
    return Project(*together(p.edges.sparkSession, [partial(cut, df, name) for name, df in tables]), p.diagnostics, p.meta)


def suggestions(p: Project, found: DataFrame) -> DataFrame:
    """node_id, edge_id, want, suggestion, distance: for missing methods and signals, the nearest name of the same script.

    Ties go to the smaller name.  Candidates are the declarations of one script, never all names.
    """
    wanted = found.where("rule in ('dangling_connection', 'connection_to_missing_signal')").select("node_id", "edge_id", F.regexp_replace("message", "^no (method|signal) ", "").alias("want"))
    wanted = wanted.select("node_id", "edge_id", "want", F.substring_index("want", "::", 1).alias("script"), F.substring_index(F.substring_index("want", "::", -1), "signal:", -1).alias("name"), F.col("want").contains("::signal:").alias("is_signal"))
    names = p.nodes.where("kind in ('method', 'signal')").select(F.substring_index("id", "::", 1).alias("script"), (F.col("kind") == "signal").alias("is_signal"), F.substring_index(F.substring_index("id", "::", -1), "signal:", -1).alias("other"))
    near = wanted.join(names, ["script", "is_signal"]).withColumn("d", F.levenshtein("name", "other"))
    best = near.groupBy("node_id", "edge_id", "want").agg(F.min(F.struct("d", "other")).alias("b"))
    return best.select("node_id", "edge_id", "want", F.col("b.other").alias("suggestion"), F.col("b.d").alias("distance"))


