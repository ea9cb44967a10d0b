"""DuckDB statements that answer the graph queries another way, for the side-by-side comparison."""

from __future__ import annotations

from weftgraph.operators.training_sql import canonical, folded, trimmed


def _latest(table: str, key: str, extra: str = "") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY loaded_at DESC NULLS LAST) rn FROM {table}) WHERE rn = 1 {extra})"


_COLS = "id, kind, path, line, identity, removed_at, loaded_at"
N = f"n AS MATERIALIZED (SELECT id, kind, path, line, identity FROM {_latest(f'(SELECT {_COLS} FROM nodes UNION ALL SELECT {_COLS} FROM shared_nodes)', 'id', 'AND removed_at IS NULL')})"
E = f"e AS MATERIALIZED (SELECT edge_id, type, {canonical('source_id')} AS s, {canonical('target_id')} AS t, origin, coalesce(resolved, false) AS ok, resolved, confidence, ev_file, ev_line, properties FROM {_latest('edges', 'edge_id')})"
B = f"b AS MATERIALIZED (SELECT boundary_id, direction, type, {canonical('node_id')} AS node_id, {canonical('match_key')} AS k, ev_file, ev_line, meta FROM {_latest('boundaries', 'boundary_id')})"
L = "l AS MATERIALIZED (SELECT DISTINCT s, t FROM e WHERE s <> t AND s IN (SELECT id FROM n) AND t IN (SELECT id FROM n))"
GRAPH = f"{N}, {E}, {L}"
FANS = "fan AS (SELECT id, (SELECT count(*) FROM l WHERE t = n.id) AS fan_in, (SELECT count(*) FROM l WHERE s = n.id) AS fan_out FROM n)"


def directory(c: str) -> str:
    return f"nullif(regexp_extract(split_part({c}, '::', 1), '^(res://([^/]+/)*)', 1), '')"


def repository(c: str) -> str:
    return f"CASE WHEN {c} LIKE 'res://%' THEN split_part(substr({c}, 7), '/', 1) END"


def rank_sql(by: str, limit: str) -> str:
    return f"WITH {GRAPH}, {FANS} SELECT id, kind, {by} FROM fan JOIN n USING (id) WHERE {by} > 0 ORDER BY {by} DESC, id {limit}"


def _reach(roots: str, a: str = "s", b: str = "t", bound: int = 80, links: str = "l") -> str:
    """``roots`` gives (root); walks by (root, id, depth), the least depth counts."""
    return f"""hop AS (SELECT root, root AS id, 0 AS depth FROM ({roots})
      UNION SELECT h.root, x.{b}, h.depth + 1 FROM hop h JOIN {links} x ON x.{a} = h.id WHERE h.depth < {bound}),
    met AS MATERIALIZED (SELECT root, id, CAST(min(depth) AS INTEGER) AS depth FROM hop GROUP BY root, id HAVING id <> root)"""


def top_id(by: str) -> str:
    return f"SELECT id AS root FROM fan ORDER BY {by} DESC, id LIMIT 1"


def _pairs(unit: str) -> str:
    return f"u AS (SELECT id, {unit} AS g FROM n), x AS (SELECT a.g AS a, b.g AS b, l.s, l.t FROM l JOIN u a ON a.id = l.s JOIN u b ON b.id = l.t WHERE a.g IS NOT NULL AND b.g IS NOT NULL)"


def _coupling(unit: str) -> str:
    return f"""{_pairs(unit)}, cc AS (SELECT g AS unit, (SELECT count(DISTINCT s) FROM x WHERE b = g AND a <> g) AS ca, (SELECT count(DISTINCT t) FROM x WHERE a = g AND b <> g) AS ce
      FROM (SELECT DISTINCT g FROM u WHERE g IS NOT NULL))"""


_DOMAIN = """CASE WHEN q LIKE 'shared/%' THEN 'shared' WHEN regexp_matches(q, '^[^/]*/ui/') THEN 'interface' WHEN regexp_matches(q, '^[^/]*/(levels|world)/') THEN 'world'
  WHEN regexp_matches(q, '^[^/]*/(actors|npc)/') THEN 'actors' WHEN regexp_matches(q, '^[^/]*/systems/') THEN 'systems' END"""
_DECLARED = _DOMAIN.replace("q ", "regexp_replace(split_part(id, '::', 1), '^res://', '') ").replace("(q,", "(regexp_replace(split_part(id, '::', 1), '^res://', ''),")


def _cycle(links: str) -> str:
    """Components by mutual reachability of (s, t) pairs."""
    return f"""far AS (SELECT s AS a, t AS b FROM {links} UNION SELECT far.a, x.t FROM far JOIN {links} x ON x.s = far.b),
      mates AS (SELECT f.a, f.b FROM far f JOIN far g ON g.a = f.b AND g.b = f.a)"""


_FLOW = """flow AS (SELECT DISTINCT s, t FROM (
    SELECT split_part(s, '::', 1) AS s, regexp_replace(split_part(t, '::', 1), '^res:res://', 'res://') AS t FROM e WHERE type = 'changes_scene_to'
    UNION ALL SELECT split_part(a.s, '::', 1), regexp_replace(split_part(c.t, '::', 1), '^res:res://', 'res://') FROM e a JOIN e c ON split_part(c.s, '::', 1) = split_part(a.t, '::', 1) WHERE a.type = 'attaches_script' AND c.type = 'changes_scene_to')
  WHERE s <> t AND s IN (SELECT id FROM n WHERE kind = 'scene') AND t IN (SELECT id FROM n WHERE kind = 'scene'))"""

_WALKS = """c AS (SELECT DISTINCT s, t FROM e WHERE type = 'calls' AND s <> t),
  way AS (SELECT DISTINCT node_id AS start_id, node_id AS at_id, [node_id] AS p FROM b WHERE direction = 'ingress' AND node_id <> ''
    UNION ALL SELECT w.start_id, c.t, list_append(w.p, c.t) FROM way w JOIN c ON c.s = w.at_id WHERE len(w.p) <= 3 AND NOT list_contains(w.p, c.t)),
  walk AS MATERIALIZED (SELECT start_id, at_id AS end_id, array_to_string(p, ' > ') AS path, CAST(len(p) - 1 AS INTEGER) AS hops FROM way WHERE at_id IN (SELECT node_id FROM b WHERE direction IS DISTINCT FROM 'ingress' AND node_id <> ''))"""


def _types(where: str) -> str:
    return f"(SELECT node_id, array_to_string(list_sort(list(DISTINCT type)), '+') AS w FROM b WHERE {where} AND node_id <> '' GROUP BY node_id)"


# ---- rules -------------------------------------------------------------------------------------


def _edge_rule(name: str, severity: str, where: str, message: str, source: str = "e") -> str:
    return f"SELECT '{name}' AS rule, '{severity}' AS severity, s AS node_id, edge_id, ev_file AS file, ev_line AS line, {message} AS message FROM {source} WHERE {where}"


def _node_rule(name: str, severity: str, where: str, message: str, source: str = "n") -> str:
    return f"SELECT '{name}' AS rule, '{severity}' AS severity, id AS node_id, CAST(NULL AS BIGINT) AS edge_id, path AS file, line, {message} AS message FROM {source} WHERE {where}"


def _targets(*types: str) -> str:
    return f"SELECT t FROM e WHERE type IN ({', '.join(repr(x) for x in types)}) AND t IS NOT NULL"


_PLAIN_T = "regexp_replace(split_part(t, '::', 1), '^res:res://', 'res://')"


def _used(*types: str, c: str = _PLAIN_T) -> str:
    return f"SELECT {c} FROM e WHERE type IN ({', '.join(repr(x) for x in types)}) AND t IS NOT NULL"


def _ids(kind: str) -> str:
    return f"SELECT id FROM n WHERE kind = '{kind}'"


_DYNAMIC = "coalesce(properties->>'$.dynamic' = 'true', false)"
_SIG = "sig AS MATERIALIZED (SELECT id, path, line, split_part(id, '::signal:', 1) AS script, list_extract(string_split(id, '::signal:'), -1) AS name FROM n WHERE kind = 'signal')"
_USES = """uses AS MATERIALIZED (SELECT type, CASE WHEN t LIKE '%::signal:%' THEN split_part(t, '::signal:', 1) WHEN t LIKE 'signal:%' THEN nullif(split_part(t, ':', 2), '*') END AS owner,
  coalesce(properties->>'$.signal', CASE WHEN t LIKE '%::signal:%' THEN list_extract(string_split(t, '::signal:'), -1) WHEN t LIKE 'signal:%' THEN list_extract(string_split(t, ':'), -1) END) AS name
  FROM e WHERE type IN ('emits_signal', 'connects_signal'))"""


def _heard(*types: str) -> str:
    ts = ", ".join(repr(x) for x in types)
    return f"EXISTS (SELECT 1 FROM uses WHERE uses.type IN ({ts}) AND uses.name = sig.name AND (uses.owner IS NULL OR uses.owner NOT LIKE 'res://%' OR uses.owner = sig.script))"


_STEPS = "len(list_filter(string_split(substr(t, 10), '/'), lambda x: x = '..'))"

_NODE_PATHS = """att AS (SELECT DISTINCT split_part(t, '::', 1) AS script, s AS owner FROM e WHERE type = 'attaches_script' AND s LIKE '%::%' AND s IN (SELECT id FROM n WHERE kind = 'scene_node')),
  ref AS (SELECT edge_id, s, substr(t, 10) AS path, split_part(s, '::', 1) AS f FROM e WHERE type = 'references_node' AND t LIKE 'nodepath:%'),
  start AS (SELECT edge_id, s, path, CASE WHEN contains(s, '::') THEN s ELSE s || '::.' END AS owner FROM ref WHERE f LIKE '%.tscn' OR f LIKE '%.scn'
    UNION ALL SELECT r.edge_id, r.s, r.path, a.owner FROM ref r LEFT JOIN att a ON a.script = r.f WHERE NOT (r.f LIKE '%.tscn' OR r.f LIKE '%.scn')),
  split AS (SELECT *, split_part(owner, '::', 1) AS scene, substr(owner, length(split_part(owner, '::', 1)) + 3) AS base FROM start),
  -- ':' marks having climbed over the root
  walked AS (SELECT *, list_reduce(list_concat([CASE WHEN base = '.' THEN '' ELSE base END], string_split(path, '/')),
      lambda acc, x: CASE WHEN acc = ':' OR x IN ('', '.') THEN acc WHEN x = '..' THEN CASE WHEN acc = '' THEN ':' ELSE regexp_replace(acc, '/?[^/]*$', '') END WHEN acc = '' THEN x ELSE acc || '/' || x END) AS w FROM split),
  asked AS (SELECT *, CASE WHEN path LIKE '/%' THEN NULL WHEN path LIKE '%%' AND substr(path, 1, 1) = '%' THEN scene || '::%' || regexp_extract(path, '^%([^/]+)', 1) WHEN w = ':' THEN NULL ELSE scene || '::' || CASE WHEN w = '' THEN '.' ELSE w END END AS want FROM walked),
  known AS (SELECT id AS want, id AS hit FROM n WHERE kind = 'scene_node' UNION ALL SELECT split_part(id, '::', 1) || '::%' || list_extract(string_split(list_extract(string_split(id, '::'), -1), '/'), -1), min(id) FROM n WHERE kind = 'scene_node' GROUP BY 1),
  np AS MATERIALIZED (SELECT edge_id, s AS source_id, path, count(DISTINCT owner) AS n_owners, count(hit) AS n_found, min(hit) AS target_id FROM asked LEFT JOIN known USING (want) GROUP BY 1, 2, 3),
  judged AS MATERIALIZED (SELECT *, CASE WHEN n_found > 0 THEN NULL WHEN path LIKE '/%' THEN 'absolute' WHEN n_owners = 0 THEN 'no_owner' ELSE 'nodepath_unresolved' END AS reason FROM np)"""

_MISSING = ("loads_resource", "changes_scene_to", "instances", "attaches_script", "uses_asset", "uses_shader", "uses_material", "uses_theme")
_SCENE_FREE = "kind = 'scene' AND NOT coalesce(identity->>'$.main_scene' = 'true', identity->>'$.mainScene' = 'true', false)"

RULE_SQL = {
    "dangling_connection": ("", _edge_rule("dangling_connection", "error", f"type = 'connects_signal' AND origin = 'editor' AND t IS NOT NULL AND t NOT IN ({_ids('method')})", "'no method ' || t")),
    "connection_to_missing_signal": (
        """att AS (SELECT DISTINCT s, split_part(t, '::', 1) AS script FROM e WHERE type = 'attaches_script'), based AS (SELECT DISTINCT split_part(s, '::', 1) AS script FROM e WHERE type = 'extends' AND (t LIKE 'res://%' OR t LIKE 'class:%')),
        conn AS (SELECT e.*, a.script || '::signal:' || (e.properties->>'$.signal') AS want FROM e JOIN att a ON a.s = e.s WHERE e.type = 'connects_signal' AND e.origin = 'editor' AND a.script NOT IN (SELECT script FROM based WHERE script IS NOT NULL))""",
        _edge_rule("connection_to_missing_signal", "error", f"want IS NOT NULL AND want NOT IN ({_ids('signal')})", "'no signal ' || want", "conn"),
    ),
    "undefined_action": ("", _edge_rule("undefined_action", "error", f"type = 'uses_action' AND t IS NOT NULL AND t NOT IN ({_ids('action')})", "t || ' is not defined'")),
    "unused_action": ("", _node_rule("unused_action", "info", f"kind = 'action' AND id NOT IN ({_targets('uses_action')})", "id || ' is never used'")),
    "empty_group_call": ("", _edge_rule("empty_group_call", "warning", f"type = 'calls_group' AND t IS NOT NULL AND t NOT IN ({_targets('in_group')})", "t || ' has no members'")),
    "unused_group": ("", _edge_rule("unused_group", "info", f"type = 'in_group' AND edge_id IN (SELECT min(edge_id) FROM e WHERE type = 'in_group' AND t IS NOT NULL GROUP BY t) AND t NOT IN ({_targets('calls_group')})", "t || ' is never called'")),
    "unresolved_load": ("", _edge_rule("unresolved_load", "info", f"type IN ('loads_resource', 'changes_scene_to') AND ({_DYNAMIC} OR coalesce(t, '') = '')", "'the path is dynamic'")),
    "missing_resource": (
        "",
        _edge_rule(
            "missing_resource", "error", f"type IN ({', '.join(map(repr, _MISSING))}) AND NOT {_DYNAMIC} AND (t LIKE 'res://%' OR t LIKE 'uid://%' OR t LIKE 'res:res://%') AND regexp_replace(t, '^res:res://', 'res://') NOT IN (SELECT id FROM n)", "regexp_replace(t, '^res:res://', 'res://') || ' does not exist'"
        ),
    ),
    "unused_signal": (f"{_SIG}, {_USES}", _node_rule("unused_signal", "info", f"NOT {_heard('emits_signal', 'connects_signal')}", "id || ' is never used'", "sig")),
    "unhandled_signal": (
        f"{_SIG}, {_USES}",
        _node_rule("unhandled_signal", "info", f"EXISTS (SELECT 1 FROM uses WHERE uses.type = 'emits_signal' AND uses.owner = sig.script AND uses.name = sig.name) AND NOT {_heard('connects_signal')}", "id || ' is emitted to nobody'", "sig"),
    ),
    "fragile_nodepath": ("", _edge_rule("fragile_nodepath", "warning", f"type = 'references_node' AND t LIKE 'nodepath:%' AND {_STEPS} > 2", f"substr(t, 10) || ' climbs ' || {_STEPS} || ' steps'")),
    "nodepath_unresolved": (_NODE_PATHS, _edge_rule("nodepath_unresolved", "warning", "edge_id IN (SELECT edge_id FROM judged WHERE reason = 'nodepath_unresolved')", "substr(t, 10) || ' leads nowhere'")),
    "orphan_script": (
        f"""used AS (SELECT k FROM ({_used('attaches_script', 'extends', 'loads_resource', 'accesses_autoload')} UNION ALL SELECT identity->>'$.path' FROM n WHERE kind = 'autoload'
          UNION ALL SELECT identity->>'$.script' FROM n WHERE kind = 'class' AND id IN ({_targets('extends')})) v(k) WHERE k IS NOT NULL)""",
        _node_rule("orphan_script", "info", "kind = 'script' AND id NOT IN (SELECT k FROM used)", "id || ' is used nowhere'"),
    ),
    "orphan_scene": ("", _node_rule("orphan_scene", "info", f"{_SCENE_FREE} AND id NOT IN ({_used('instances', 'changes_scene_to', 'loads_resource')})", "id || ' is entered nowhere'")),
    "orphan_asset": ("", _node_rule("orphan_asset", "info", f"kind = 'asset' AND id NOT IN ({_used('uses_asset', 'uses_shader', 'uses_material', 'uses_theme', 'loads_resource', c="regexp_replace(t, '^res:res://', 'res://')")})", "id || ' is used nowhere'")),
    "orphan_layer": ("", _node_rule("orphan_layer", "info", f"kind = 'layer' AND id NOT IN ({_targets('uses_layer')})", "id || ' is never used'")),
    "per_frame_cost": (
        "out_of AS (SELECT s, count(*) AS k FROM e GROUP BY s), busy AS (SELECT n.*, k FROM n JOIN out_of ON s = id WHERE kind = 'method' AND (id LIKE '%::\\_process' ESCAPE '\\' OR id LIKE '%::\\_physics\\_process' ESCAPE '\\'))",
        _node_rule("per_frame_cost", "info", "true", "k || ' references every frame'", "busy"),
    ),
    "large_scene": (
        "sizes AS (SELECT split_part(id, '::', 1) AS f, count(*) AS k FROM n WHERE kind = 'scene_node' GROUP BY 1), big AS (SELECT n.*, k FROM n JOIN sizes ON f = id WHERE kind = 'scene' AND k > 200)",
        _node_rule("large_scene", "info", "true", "k || ' nodes'", "big"),
    ),
    "doc_uncovered_entity": (
        "busy AS (SELECT n.*, k FROM n JOIN (SELECT t, count(DISTINCT s) AS k FROM e WHERE type = 'accesses_autoload' GROUP BY t) ON t = id WHERE kind = 'autoload' AND k >= 10)",
        _node_rule("doc_uncovered_entity", "info", f"id NOT IN ({_targets('documents')})", "k || ' users, no document'", "busy"),
    ),
}


def rules_with(names: list[str]) -> tuple[str, str]:
    """(CTEs, union of the rules), each rule in a scope of its own."""
    parts = []
    for name in names:
        ctes, body = RULE_SQL[name]
        parts.append(f"SELECT * FROM ({'WITH ' + ctes if ctes else ''} {body})")
    return f"{N}, {E}", " UNION ALL ".join(parts)


def oracle_sql() -> dict[str, str]:
    name, path = "identity->>'$.name'", "path"
    scopes = {"composition": ("instances", "attaches_script"), "signals": ("declares_signal", "emits_signal", "connects_signal"), "autoloads": ("accesses_autoload", "accesses_autoload"), "scene_flow": ("changes_scene_to", "changes_scene_to")}
    norm = lambda c: f"(CASE WHEN {c} IS NULL THEN NULL WHEN {trimmed(c)} = '' OR {trimmed(c)} LIKE 'uid://%' THEN {trimmed(c)} WHEN {trimmed(c)} LIKE 'user://%' THEN 'user://' || {folded(f'substr({trimmed(c)}, 8)')} ELSE 'res://' || {folded(f'''regexp_replace({trimmed(c)}, '^res://', '')''')} END)"
    wild = lambda c: f"coalesce(nullif({trimmed(c)}, ''), '*')"
    owner = "identity->>'$.node_type'"
    out = {
        "g1_nodes_by_kind": f"WITH {N} SELECT kind, count(*) AS n FROM n GROUP BY kind",
        "g2_edges_by_type": f"WITH {E} SELECT type, count(*) AS n FROM e GROUP BY type",
        "g3_boundaries_by_direction": f"WITH {B} SELECT count(*) FILTER (WHERE direction = 'ingress') AS ingress, count(*) FILTER (WHERE direction IS DISTINCT FROM 'ingress') AS egress FROM b",
        "g4_breakdown": f"""WITH {N}, {E}, {B} SELECT 'nodes' AS section, kind AS key, count(*) AS n FROM n GROUP BY kind UNION ALL SELECT 'edges', type, count(*) FROM e GROUP BY type
          UNION ALL SELECT 'boundaries', CASE WHEN direction = 'ingress' THEN 'ingress' ELSE 'egress' END, count(*) FROM b GROUP BY 2""",
        "g5_totals": f"WITH {N}, {E}, {B} SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM b) AS boundaries, (SELECT count(*) FROM e WHERE NOT ok) AS unresolved",
        "g8_order": f"WITH {N} SELECT count(*) AS n FROM n",
        "g10_autoload_access": f"WITH {E} SELECT s AS owner_id, t AS autoload_id, min(ev_line) AS first_line, count(*) AS n_accesses FROM e WHERE type = 'accesses_autoload' GROUP BY 1, 2",
        "g11_stub_enrich": f"""WITH {N}, {E} SELECT class_id, max(script) AS script, CAST(sum(m) AS BIGINT) AS n_mentions FROM (SELECT t AS class_id, NULL AS script, 1 AS m FROM e WHERE type = 'extends' AND t LIKE 'class:%'
          UNION ALL SELECT id, identity->>'$.script', 0 FROM n WHERE kind = 'class') GROUP BY class_id""",
        "g12_signal_lists": f"WITH {N} SELECT identity->>'$.script' AS script, string_agg({name}, ',' ORDER BY coalesce(line, 0), {name}) AS signals FROM n WHERE kind = 'signal' AND identity->>'$.script' IS NOT NULL GROUP BY 1",
        "g13_coupling": f"WITH {GRAPH}, {_coupling(directory('id'))} SELECT unit, ca, ce, round(ce / nullif(ca + ce, 0), 4) AS instability FROM cc",
        "g14_autoload_fan_in": f"WITH {E} SELECT t AS id, count(*) AS n_edges, count(DISTINCT s) AS n_peers FROM e WHERE type = 'accesses_autoload' AND t LIKE 'autoload:%' GROUP BY t",
        "g14_instance_fan_in": f"WITH {E} SELECT t AS id, count(*) AS n_edges, count(DISTINCT s) AS n_peers FROM e WHERE type = 'instances' AND t IS NOT NULL GROUP BY t",
        "g14_signal_fan_out": f"WITH {E} SELECT s AS id, count(*) AS n_edges, count(DISTINCT t) AS n_peers FROM e WHERE type = 'connects_signal' AND s IS NOT NULL GROUP BY s",
        "g15_fragile_reach": f"WITH {E} SELECT {directory('s')} AS unit, count(*) AS n, round(avg({_STEPS}), 4) AS avg_distance, max({_STEPS}) AS max_distance FROM e WHERE type = 'references_node' AND t LIKE 'nodepath:%' GROUP BY 1",
        "g16_flow_patterns": f"""WITH RECURSIVE {E}, {B}, {_WALKS} SELECT i.w || ' > ' || hops || ' > ' || o.w AS signature, count(*) AS n_walks FROM walk
          JOIN {_types("direction = 'ingress'")} i ON i.node_id = start_id JOIN {_types("direction IS DISTINCT FROM 'ingress'")} o ON o.node_id = end_id GROUP BY 1""",
        "g18_dependency_matrix": f"WITH {GRAPH}, {_pairs(repository('id'))} SELECT a AS source_unit, b AS target_unit, count(*) AS n_links FROM x GROUP BY 1, 2",
        "g18_domain_summary": f"WITH {GRAPH}, {_coupling(repository('id'))} SELECT count(*) AS n_units, (SELECT count(*) FROM x WHERE a <> b) AS cross_links, round(avg(ce / nullif(ca + ce, 0)), 4) AS avg_instability FROM cc",
        "g19_impact_rings": f"WITH RECURSIVE {GRAPH}, {FANS}, {_reach(top_id('fan_in'), 't', 's')} SELECT depth, count(*) AS n, round(count(*) / (SELECT count(*) FROM n), 6) AS share FROM met GROUP BY depth",
        "g19_impact_domains": f"WITH RECURSIVE {GRAPH}, {FANS}, {_reach(top_id('fan_in'), 't', 's')} SELECT {repository('id')} AS unit, count(*) AS n, round(count(*) / (SELECT count(*) FROM n), 6) AS share FROM met GROUP BY 1",
        "t1_top_fan_in": rank_sql("fan_in", "LIMIT 10"),
        "t1_top_fan_out": rank_sql("fan_out", "LIMIT 10"),
        "t1_all_fan_in": rank_sql("fan_in", ""),
        "op1_links": f"WITH {GRAPH} SELECT s AS source_id, t AS target_id FROM l",
        "op5_fan": f"WITH {GRAPH}, {FANS} SELECT id AS node_id, fan_in, fan_out FROM fan",
        "r2_forward_reach": f"WITH RECURSIVE {GRAPH}, {FANS}, {_reach(top_id('fan_out'))} SELECT * FROM met",
        "r2_forward_depth2": f"WITH RECURSIVE {GRAPH}, {_reach(_ids('scene').replace('SELECT id', 'SELECT id AS root'), bound=2)} SELECT * FROM met",
        "r3_reverse_reach": f"WITH RECURSIVE {GRAPH}, {FANS}, {_reach(top_id('fan_in'), 't', 's')} SELECT * FROM met",
        "r6_directories": f"WITH {GRAPH}, {_pairs(directory('id'))} SELECT DISTINCT a AS source_id, b AS target_id FROM x WHERE a <> b",
        "r6_directory_vertices": f"WITH {N} SELECT DISTINCT {directory('id')} AS id FROM n WHERE {directory('id')} IS NOT NULL",
        "r7_node_view": f"""WITH {E} SELECT a.id, x.direction, x.type, x.peer, x.origin, x.resolved FROM (SELECT DISTINCT id FROM shared_nodes WHERE kind = 'autoload') a
          JOIN (SELECT s AS id, 'outbound' AS direction, type, t AS peer, origin, resolved FROM e UNION ALL SELECT t, 'inbound', type, s, origin, resolved FROM e) x USING (id)""",
        "r8_focus": f"""WITH RECURSIVE {N}, {E}, l AS MATERIALIZED (SELECT DISTINCT s, t FROM e WHERE origin = 'editor' AND s <> t AND s IN (SELECT id FROM n) AND t IN (SELECT id FROM n)), {FANS},
          {_reach(top_id('fan_out'), bound=2)}, {_reach(top_id('fan_out'), 't', 's', 2).replace('hop', 'hop2').replace('met AS', 'met2 AS')} SELECT root, id, min(depth) AS hops FROM (SELECT * FROM met UNION ALL SELECT * FROM met2) GROUP BY 1, 2""",
        "r8_scopes": f"WITH {N}, {E}, "
        + ", ".join(f"s_{name} AS (SELECT DISTINCT s, t FROM e WHERE type IN ({', '.join(map(repr, types))}) AND s <> t AND s IN (SELECT id FROM n) AND t IN (SELECT id FROM n))" for name, types in scopes.items())
        + " ".join((" UNION ALL" if i else "") + f" SELECT '{name}' AS scope, s AS source_id, t AS target_id FROM s_{name}" for i, name in enumerate(scopes)),
        "r9_scene_flow": f"WITH RECURSIVE {N}, {E}, {_FLOW}, {_reach(f'''SELECT id AS root FROM n WHERE kind = 'scene' AND coalesce(identity->>'$.main_scene', identity->>'$.mainScene') = 'true' ''', links='flow', bound=30)} SELECT * FROM met",
        "r10_walks": f"WITH RECURSIVE {E}, {B}, {_WALKS} SELECT start_id, end_id, path, hops FROM walk",
        "r12_declared": f"WITH {GRAPH}, {_pairs(_DECLARED)} SELECT DISTINCT a AS source_id, b AS target_id FROM x WHERE a <> b",
        "r13_unit_cycles": f"""WITH RECURSIVE {GRAPH}, {_pairs(directory('id'))}, d AS MATERIALIZED (SELECT DISTINCT a AS s, b AS t FROM x WHERE a <> b), {_cycle('d')}
          SELECT min(b) AS component_id, a AS id, count(DISTINCT b) AS size FROM mates GROUP BY a""",
        "r14_declared_sprawl": f"""WITH {N}, parts AS (SELECT {_DECLARED} AS g, {repository('id')} AS part, count(*) AS k FROM n GROUP BY 1, 2), sh AS (SELECT g, k, k / sum(k) OVER (PARTITION BY g) AS p FROM parts WHERE g IS NOT NULL)
          SELECT g AS "group", CAST(sum(k) AS BIGINT) AS n, count(*) AS n_parts, round(max(p), 4) AS purity, round(-sum(p * log2(p)) + 0.0, 4) AS entropy FROM sh GROUP BY g""",
        "r15_blast_radius": f"""WITH RECURSIVE {GRAPH}, {FANS}, {_reach(top_id('fan_in'), 't', 's')}, {_reach(top_id('fan_in')).replace('hop', 'hop2').replace('met AS', 'met2 AS')}
          SELECT kind, count(*) AS n, EXISTS (SELECT 1 FROM met2 WHERE id IN (SELECT id FROM met)) AS on_cycle FROM met JOIN n USING (id) GROUP BY kind""",
        "j2_connections": f"""WITH {N}, {E} SELECT edge_id, s AS emitter_id, properties->>'$.signal' AS signal, coalesce(nullif(n.identity->>'$.node_type', ''), '*') AS emitter_type, split_part(t, '::', 1) AS handler_script, properties->>'$.method' AS method
          FROM e LEFT JOIN n ON n.id = e.s AND n.kind = 'scene_node' WHERE type = 'connects_signal' AND origin = 'editor'""",
        "j5_resource_exists": f"WITH {N}, {E} SELECT edge_id, type, t AS target_id, coalesce(t IN (SELECT id FROM n), false) AS \"exists\" FROM e WHERE type IN ('loads_resource', 'changes_scene_to')",
        "j6_extends_path": f"WITH {N}, {E} SELECT edge_id, s AS source_id, t AS target_id, t IN (SELECT id FROM n) AS \"exists\" FROM e WHERE type = 'extends' AND t LIKE 'res://%'",
        "j7_autoloads": f"WITH {N}, {E} SELECT edge_id, s AS source_id, t AS target_id FROM e WHERE type = 'accesses_autoload' AND t IN ({_ids('autoload')})",
        "j8_local_calls": f"WITH {N}, {E} SELECT edge_id, s AS source_id, t AS target_id FROM e WHERE type = 'calls' AND split_part(s, '::', 1) = split_part(t, '::', 1) AND t IN ({_ids('method')})",
        "j13_match_keys": f"""WITH {B}, k AS (SELECT *, (k LIKE 'signal:%:%' OR k LIKE 'rpc:%:%') AS named, split_part(k, ':', 1) AS scheme, split_part(k, ':', 2) AS own, substr(k, length(split_part(k, ':', 1)) + length(split_part(k, ':', 2)) + 3) AS nm, nullif(node_id, '') AS node FROM b WHERE coalesce(k, '') <> ''),
          i AS MATERIALIZED (SELECT * FROM k WHERE direction = 'ingress'), o AS (SELECT * FROM k WHERE direction IS DISTINCT FROM 'ingress'),
          x AS (SELECT o.boundary_id, o.k, (SELECT count(*) FROM i WHERE i.k = o.k) AS ne, (SELECT min(node) FROM i WHERE i.k = o.k) AS ie,
            (SELECT count(*) FROM i WHERE o.named AND i.named AND i.scheme = o.scheme AND i.nm = o.nm AND (o.own = '*' OR i.own = '*')) AS nv, (SELECT min(node) FROM i WHERE o.named AND i.named AND i.scheme = o.scheme AND i.nm = o.nm AND (o.own = '*' OR i.own = '*')) AS iv FROM o)
          SELECT boundary_id, k AS match_key, CASE WHEN ne > 0 THEN 'exact' WHEN nv > 0 THEN 'variant' ELSE 'none' END AS strategy, CASE WHEN ne > 0 THEN ne ELSE nv END AS n_partners, CASE WHEN ne > 0 THEN ie ELSE iv END AS partner_id,
            CAST(CASE WHEN ne > 0 THEN 1.0 WHEN nv > 0 THEN 0.7 ELSE 0.0 END AS DOUBLE) AS confidence FROM x""",
        "j14_node_paths": f"WITH {N}, {E}, {_NODE_PATHS} SELECT edge_id, source_id, path, n_owners, n_found, target_id, reason FROM judged",
        "k_normalized_paths": f"SELECT DISTINCT edge_id, loaded_at, {norm('target_id')} AS path FROM edges",
        "k_match_keys": f"""WITH {N} SELECT id, 'signal:' || {wild(owner)} || ':' || {trimmed(name)} AS signal_key, 'rpc:' || {wild(owner)} || ':' || {trimmed(name)} AS rpc_key, 'res:' || {norm(path)} AS resource_key,
          'action:' || {trimmed(name)} AS action_key, 'group:' || {trimmed(name)} AS group_key, 'autoload:' || {trimmed(name)} AS autoload_key, 'nodepath:' || {trimmed(name)} AS nodepath_key FROM n""",
        "k_ids": f"""WITH {N} SELECT id, {norm(path)} AS file, {norm(path)} || '::' || ({name}) AS symbol, {norm(path)} || '::signal:' || ({name}) AS signal, {norm(path)} || '::' || ({name}) AS scene_node, 'class:' || ({name}) AS class,
          'ext:' || {norm(path)} AS ext, regexp_replace({trimmed(path)}, '^\\./', '') AS doc FROM n""",
        "k_parsed_ids": """WITH %s, p AS (SELECT id, split_part(id, '::', 1) AS f, CASE WHEN contains(id, '::') THEN substr(id, length(split_part(id, '::', 1)) + 3) END AS r FROM n),
          q AS (SELECT *, CASE WHEN r LIKE 'signal:%%' THEN 'signal' WHEN r IS NOT NULL AND (f LIKE '%%.tscn' OR f LIKE '%%.scn') THEN 'scene_node' WHEN r IS NOT NULL THEN 'symbol' END AS form FROM p)
          SELECT id, form, CASE WHEN form IS NOT NULL THEN f END AS file, CASE WHEN form = 'signal' THEN substr(r, 8) ELSE r END AS name FROM q""" % N,
        "k_scene_paths": f"WITH {N}, p AS (SELECT id, identity->>'$.parent' AS pa, {name} AS nm FROM n WHERE kind = 'scene_node') SELECT id, CASE WHEN coalesce(pa, '') = '' THEN '.' WHEN pa = '.' THEN nm ELSE pa || '/' || nm END AS node_path FROM p",
        "k_asset_types": f"""WITH {N} SELECT DISTINCT identity->>'$.resource_type' AS resource_type, CASE WHEN identity->>'$.resource_type' IN ('PackedScene', 'Resource') THEN 'loads_resource' WHEN identity->>'$.resource_type' = 'Shader' THEN 'uses_shader'
          WHEN identity->>'$.resource_type' = 'Theme' THEN 'uses_theme' WHEN contains(identity->>'$.resource_type', 'Material') THEN 'uses_material' ELSE 'uses_asset' END AS edge_type FROM n WHERE kind = 'resource' AND identity->>'$.resource_type' IS NOT NULL""",
        "k5_json": f"""WITH {N}, j AS (SELECT id, CASE WHEN trim(identity) <> '' THEN identity END AS i FROM n)
          SELECT id, CASE WHEN i IS NOT NULL THEN '{{' || coalesce((SELECT string_agg(to_json(k)::VARCHAR || ':' || json(i->('$."' || k || '"'))::VARCHAR, ',' ORDER BY k) FROM (SELECT unnest(json_keys(i)) AS k)), '') || '}}' END AS canonical FROM j""",
        "r4_components": f"""WITH RECURSIVE {GRAPH}, {_cycle('l')} SELECT n.id, coalesce(min(b), n.id) AS component_id, greatest(count(DISTINCT b), 1) AS size FROM n LEFT JOIN mates ON a = n.id GROUP BY n.id""",
        "k_unresolved": f"WITH {E} SELECT edge_id, ', unresolved' AS tag FROM e WHERE NOT ok",
    }
    for rule in RULE_SQL:
        ctes, body = rules_with([rule])
        out[f"i_{rule}"] = f"WITH {ctes} {body}"
    ctes, body = rules_with(list(RULE_SQL))
    out["i_findings"] = f"WITH {ctes} {body}"
    out["g20_overview"] = f"WITH {ctes} SELECT count(*) FILTER (WHERE origin = 'editor') AS editor_edges, count(*) FILTER (WHERE NOT ok) AS unresolved, (SELECT count(*) FROM ({body})) AS findings FROM e"
    out["g17_severity_counts"] = f"WITH {ctes} SELECT severity, rule, count(*) AS n FROM ({body}) GROUP BY 1, 2"
    ctes, body = rules_with(["unused_group", "unused_action", "undefined_action"])
    out["i_configured"] = f"WITH {ctes} SELECT CASE WHEN rule = 'unused_group' THEN 'warning' ELSE severity END AS severity, rule, count(*) AS n FROM ({body}) WHERE NOT (rule = 'unused_action' AND node_id = 'action:jump') GROUP BY 1, 2"
    ctes, body = rules_with(["dangling_connection", "connection_to_missing_signal"])
    out["i_suggestions"] = f"""WITH {ctes}, w AS (SELECT node_id, edge_id, regexp_replace(message, '^no (method|signal) ', '') AS want FROM ({body})),
      v AS (SELECT *, split_part(want, '::', 1) AS script, regexp_replace(list_extract(string_split(want, '::'), -1), '^signal:', '') AS nm, contains(want, '::signal:') AS sg FROM w),
      c AS (SELECT split_part(id, '::', 1) AS script, kind = 'signal' AS sg, regexp_replace(list_extract(string_split(id, '::'), -1), '^signal:', '') AS other FROM n WHERE kind IN ('method', 'signal'))
      SELECT node_id, edge_id, want, other AS suggestion, CAST(d AS INTEGER) AS distance FROM (SELECT v.node_id, v.edge_id, v.want, c.other, levenshtein(v.nm, c.other) AS d, row_number() OVER (PARTITION BY v.node_id, v.edge_id, v.want ORDER BY levenshtein(v.nm, c.other), c.other) rn
        FROM v JOIN c USING (script, sg)) WHERE rn = 1"""
    return out
