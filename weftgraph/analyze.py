"""Analysing a project directory: discovery, extraction, and everything that builds on them."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import documents, extract, resolve
from weftgraph.operators.integrity import SEVERITIES, Settings
from weftgraph.plans.materialize import cut
from weftgraph.project import NODE_COLUMNS, Project
from weftgraph.sources import discovery


def analyze(spark: SparkSession, directory: str) -> Project:
    """The project at or above ``directory``.  Its ``meta`` (key, value) has version and main scene."""
    root = discovery.find_root(directory)
    settings = discovery.load_settings(root)
    listed = discovery.list_files(spark, root)
    kept = listed.where(~discovery.is_ignored("rel", [str(g) for g in settings.get("ignore") or []]))
    plugins = listed.where(F.substring_index("rel", "/", -1) == "plugin.cfg")  # ignore globs do not hide plugins
    files = cut(discovery.read_files(kept.where(F.substring_index("rel", "/", -1) != "plugin.cfg").unionByName(plugins)), "files")
    lines = cut(discovery.settings_lines(discovery.read_settings(spark, root)), "settings")
    about = discovery.project_facts(lines).first()
    version, main = (about["version"], about["main_scene"]) if about else (None, None)
    p = extract.extracted(files, discovery.concept_nodes(lines).select(*NODE_COLUMNS), main)
    globs = (settings.get("docs") or {}).get("globs") or []
    if globs:
        p = documents.with_documents(p, documents.read(kept, globs))
    p = resolve.hinted(p, {str(k): str(v) for k, v in ((settings.get("resolve") or {}).get("loads") or {}).items()})
    rows = [("version", version or ""), ("main_scene", main or ""), ("root", "res://")]
    return Project(p.nodes, p.edges, p.boundaries, p.diagnostics, spark.createDataFrame(rows, "key string, value string"))


def rule_settings(directory: str) -> Settings:
    """The integrity settings of a project: rules (enabled, severity, parameters), suppressions, entry scenes."""
    found = discovery.load_settings(discovery.find_root(directory))
    rules = {k: v for k, v in (found.get("rules") or {}).items() if isinstance(v, dict)}
    known = {"max_distance": ("fragile_nodepath", "max_distance"), "large_scene": ("large_scene", "nodes"), "fan_in": ("doc_uncovered_entity", "fan_in")}
    values = {field: int(rules[rule][key]) for field, (rule, key) in known.items() if key in rules.get(rule, {})}
    return Settings(
        disabled=frozenset(k for k, v in rules.items() if v.get("enabled") is False),
        severity={k: v["severity"] for k, v in rules.items() if v.get("severity") in SEVERITIES},
        suppress=tuple((str(s["rule"]), str(s["node"])) for s in found.get("suppress") or [] if isinstance(s, dict) and {"rule", "node"} <= s.keys()),
        entry_scenes=tuple(map(str, found.get("entry_scenes") or ())),
        **values,
    )
