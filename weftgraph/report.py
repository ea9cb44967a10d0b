"""What is shown to people and programs: small results, collected and written as text or JSON."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import graph, integrity, stats
from weftgraph.project import Project

LIMIT = 1_000_000  # rows that are shown at most; more are an error, not a cut list


class TooManyRows(Exception):
    pass


def _rows(df: DataFrame) -> list[dict]:
    found = [r.asDict(recursive=True) for r in df.limit(LIMIT + 1).collect()]
    if len(found) > LIMIT:
        raise TooManyRows(f"more than {LIMIT} rows; query the tables instead")
    return found


def as_json(value) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False)


def summary(p: Project, directory: str, store: str) -> str:
    """All counts of an analysis."""
    meta = {r["key"]: r["value"] for r in p.meta.collect()} if p.meta is not None else {}
    t = stats.totals(p).first()
    d = stats.directions(p).first()
    by = {"nodes": [], "edges": []}
    for r in _rows(stats.breakdown(p)):
        if r["section"] in by:
            by[r["section"]].append(f"    {r['key'] or '(none)':<18} {r['n']}")
    out = [f"analyzed {directory} (engine {meta.get('version') or 'unknown'})", f"  {t['nodes']} nodes", *by["nodes"], f"  {t['edges']} edges", *by["edges"]]
    out.append(f"  {t['boundaries']} boundaries (ingress {d['ingress']}, egress {d['egress']})")
    out.append(f"  {t['unresolved']} unresolved edges")
    out.append(f"  {p.diagnostics.count() if p.diagnostics is not None else 0} diagnostics")
    return "\n".join([*out, f"  store: {store}"])


def node_view(p: Project, node_id: str) -> dict | None:
    """A node with its edges in both directions, sorted by type and peer; null if there is no such node."""
    row = p.nodes.where(F.col("id") == node_id).first()
    if row is None:
        return None
    ids = p.nodes.where(F.col("id") == node_id).select("id")
    edges = _rows(graph.neighbours(p.edges, ids).orderBy("direction", "type", "peer", "origin"))
    side = lambda d: [{k: e[k] for k in ("type", "peer", "origin", "resolved")} for e in edges if e["direction"] == d]
    out = {"id": row["id"], "kind": row["kind"]}
    if row["path"]:
        out["path"] = row["path"]
    if row["identity"]:
        out["identity"] = json.loads(row["identity"])
    return out | {"outbound": side("outbound"), "inbound": side("inbound")}


def node_text(view: dict) -> str:
    tag = lambda e: "" if e["resolved"] else ", unresolved"
    out = [f"{view['id']}  [{view['kind']}]"]
    if view.get("path") and view["path"] != view["id"]:
        out.append(f"  path: {view['path']}")
    out.append(f"  outbound ({len(view['outbound'])}):")
    out += [f"    -{e['type']}-> {e['peer']}  ({e['origin']}{tag(e)})" for e in view["outbound"]]
    out.append(f"  inbound ({len(view['inbound'])}):")
    return "\n".join([*out, *[f"    <-{e['type']}- {e['peer']}  ({e['origin']}{tag(e)})" for e in view["inbound"]]])


def golden_rows(p: Project) -> dict[str, list[dict]]:
    """A project as plain records in a fixed order, empty fields left out, JSON fields as values; for small projects."""
    order = {"nodes": ("id",), "edges": ("source_id", "type", "target_id", "ev_line"), "boundaries": ("node_id", "type", "match_key", "ev_line")}
    out = {}
    for name, by in order.items():
        rows = []
        for r in _rows(getattr(p, name).drop("edge_id", "boundary_id")):
            rows.append({k: json.loads(v) if k in ("identity", "properties", "meta") else v for k, v in r.items() if v not in (None, "", 0) or k in ("resolved", "node_id")})
        out[name] = sorted(rows, key=lambda r: ([str(r.get(k) or "") for k in by[:3]], r.get("ev_line") or 0, json.dumps(r, sort_keys=True)))
    return out


def matches_golden(path: str, value) -> bool:
    """Whether the file holds ``value``; with WEFT_UPDATE_GOLDEN set, or without a file, it is written first."""
    text = json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n"
    if os.environ.get("WEFT_UPDATE_GOLDEN") or not os.path.exists(path):
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    with open(path, encoding="utf-8") as f:
        return f.read() == text


def stats_view(p: Project, top: int = 10) -> dict:
    """Totals and the nodes with most fan-in; ``top`` of 0 or less shows all."""
    return stats.totals(p).first().asDict() | {"top_fan_in": _rows(stats.ranking(p, "fan_in", top))}


def stats_text(view: dict) -> str:
    out = [f"{k + ':':<12} {view[k]}" for k in ("nodes", "edges", "boundaries", "unresolved")]
    return "\n".join([*out, "top fan-in:", *[f"  {r['fan_in']:>4}  {r['id']}  [{r['kind']}]" for r in view["top_fan_in"]]])


def impact(p: Project, node_id: str, max_depth: int = 0, reverse: bool = True) -> dict:
    """What a change of a node reaches: by kind and by hop, and whether the node lies on a cycle."""
    from weftgraph.plans.materialize import cut

    ids, links = stats.graph_of(p)
    links = cut(links, "links")
    root = ids.where(F.col("id") == node_id).select(F.col("id").alias("root"))
    met = cut(graph.reach(links, root, max_depth, reverse), "met")
    there = graph.reach(links, root, max_depth, not reverse)
    return {
        "id": node_id,
        "by_kind": {r["kind"]: r["n"] for r in _rows(stats.count_by(met.join(p.nodes.select("id", "kind"), "id"), "kind").orderBy("kind"))},
        "by_depth": {r["depth"]: r["n"] for r in _rows(stats.count_by(met, "depth").orderBy("depth"))},
        "on_cycle": not met.join(there.select("id"), "id", "left_semi").isEmpty(),
    }


def findings_view(found: DataFrame, least: str = "info") -> list[dict]:
    """Findings of at least a severity, in their order."""
    kept = integrity.SEVERITIES[: integrity.SEVERITIES.index(least) + 1]
    return _rows(integrity.ordered(found.where(F.col("severity").isin(*kept))))


def findings_text(rows: list[dict], unresolved: int) -> str:
    out = []
    for r in rows:
        where = f"{r['file'] or r['node_id']}" + (f":{r['line']}" if r["line"] else "")
        out.append(f"{r['severity'].upper():<8} {r['rule']}  {where}  {r['message']}")
    n = {s: sum(r["severity"] == s for r in rows) for s in integrity.SEVERITIES}
    out.append(f"{n['error']} errors, {n['warning']} warnings, {n['info']} infos; {unresolved} unresolved edges")
    return "\n".join(out)
