"""DuckDB statements that answer p1-p4 another way, for the side-by-side comparison."""

from __future__ import annotations

_WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f\x0b]"


def trimmed(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def folded(c: str) -> str:
    """Clean a '/'-path with a string accumulator."""
    step = r"CASE WHEN x IN ('', '.') THEN acc WHEN x = '..' THEN regexp_replace(acc, '/?[^/]*$', '') WHEN acc = '' THEN x ELSE acc || '/' || x END"
    return f"list_reduce(list_concat([''], string_split({c}, '/')), lambda acc, x: {step})"


def canonical(c: str) -> str:
    t = trimmed(c)
    u = f"(CASE WHEN {t} LIKE 'res:%' AND {t} NOT LIKE 'res://%' THEN {trimmed(f'substr({t}, 5)')} ELSE {t} END)"
    file = f"split_part({u}, '::', 1)"
    return f"(CASE WHEN {u} LIKE 'res://%' THEN 'res://' || {folded(f'substr({trimmed(file)}, 7)')} || substr({u}, length({file}) + 1) ELSE {u} END)"


def _node_cleaned(c: str) -> str:
    return f"coalesce(nullif(array_to_string(list_filter(string_split({trimmed(c)}, '/'), lambda x: x NOT IN ('', '.')), '/'), ''), '.')"


_LIVE = """live AS (
  SELECT id, kind, identity FROM (
    SELECT id, kind, identity, removed_at, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) rn
    FROM (SELECT id, kind, identity, removed_at, loaded_at FROM nodes UNION ALL SELECT id, kind, identity, removed_at, loaded_at FROM shared_nodes))
  WHERE rn = 1 AND removed_at IS NULL)"""

_PARENTS = f"""{_LIVE},
attrs AS MATERIALIZED (SELECT id, kind, identity->>'$.scene' sc, identity->>'$.parent' pa, identity->>'$.extends' ex, identity->>'$.script' cs,
  coalesce(identity->>'$.name', list_extract(string_split(list_extract(string_split(id, '::'), -1), '/'), -1)) label FROM live),
named AS MATERIALIZED (
  SELECT id, label, CASE WHEN kind = 'scene_node' THEN CASE WHEN pa IS NOT NULL THEN sc || '::' || {_node_cleaned('pa')} END
    WHEN kind = 'script' OR (kind = 'class' AND cs IS NULL) THEN CASE WHEN {canonical('ex')} LIKE 'res://%' THEN {canonical('ex')} ELSE 'class:' || {trimmed('ex')} END END ref,
    CASE WHEN kind = 'class' AND cs IS NOT NULL THEN {canonical('cs')} END alias
  FROM attrs),
up AS MATERIALIZED (
  SELECT n.id, n.label, t.id parent FROM named n LEFT JOIN named c ON c.id = n.ref AND c.alias IS NOT NULL
  LEFT JOIN named t ON t.id = coalesce(c.alias, n.ref))"""

# Walks of up to all nodes: rings are found by walking from every node until it meets itself.
_CYCLES = """walk AS (SELECT id AS begun, parent AS cur_id, 1 AS n FROM up WHERE parent IS NOT NULL
  UNION SELECT w.begun, u.parent, 0 FROM walk w JOIN up u ON u.id = w.cur_id WHERE u.parent IS NOT NULL),
reach AS MATERIALIZED (SELECT DISTINCT begun, cur_id FROM walk),
ring AS MATERIALIZED (SELECT r.begun AS id, min(s.cur_id) AS cycle_id FROM reach r JOIN reach s ON s.begun = r.begun WHERE r.begun = r.cur_id GROUP BY r.begun),
below AS MATERIALIZED (SELECT DISTINCT r.begun AS id, g.cycle_id FROM reach r JOIN ring g ON g.id = r.cur_id)"""

P1_FOUND = f"WITH RECURSIVE {_PARENTS}, {_CYCLES} SELECT id AS node_id, cycle_id FROM below"

_CHAINS = """chain AS (
  SELECT u.id, u.id AS cur_id, 0 AS n FROM up u
  UNION ALL SELECT c.id, u.parent, c.n + 1 FROM chain c JOIN up u ON u.id = c.cur_id WHERE u.parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ring WHERE ring.id = c.cur_id)),
depths AS MATERIALIZED (SELECT id, max(n) AS depth, arg_max(cur_id, n) AS root_id FROM chain GROUP BY id)"""

P1_DESCENDANTS = f"WITH RECURSIVE {_PARENTS}, {_CYCLES}, {_CHAINS} SELECT cur_id AS ancestor_id, id AS node_id, CAST(n AS INTEGER) AS distance FROM chain WHERE n > 0"

P1_HIERARCHY = f"""WITH RECURSIVE {_PARENTS}, {_CYCLES}, {_CHAINS},
paths AS (SELECT c.id, string_agg(u.label, '/' ORDER BY c.n DESC) AS path FROM chain c JOIN up u ON u.id = c.cur_id GROUP BY c.id),
kids AS (SELECT cur_id, count(*) AS k FROM chain WHERE n > 0 GROUP BY cur_id)
SELECT d.id AS node_id, p.path, CAST(d.depth AS INTEGER) AS depth, d.root_id, coalesce(k.k, 0) AS n_descendants, b.cycle_id
FROM depths d JOIN paths p ON p.id = d.id LEFT JOIN below b ON b.id = d.id LEFT JOIN kids k ON k.cur_id = d.id"""


def _refs() -> str:
    return f"""refs AS MATERIALIZED (SELECT src_table, row_id, {canonical('k')} AS k, observed_at FROM (
  SELECT 'edges' AS src_table, edge_id AS row_id, target_id AS k, observed_at, row_number() OVER (PARTITION BY edge_id ORDER BY loaded_at DESC NULLS LAST) rn FROM edges
  UNION ALL SELECT 'boundaries', boundary_id, match_key, observed_at, row_number() OVER (PARTITION BY boundary_id ORDER BY loaded_at DESC NULLS LAST) FROM boundaries) WHERE rn = 1),
real_refs AS MATERIALIZED (SELECT * FROM refs WHERE k IS NOT NULL AND k <> '' AND NOT regexp_matches(k, '^(signal:|nodepath:|rpc:|user://|uid://)')),
recs AS MATERIALIZED (SELECT id, added_at, removed_at FROM (
  SELECT id, added_at, removed_at, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) rn
  FROM (SELECT id, added_at, removed_at, loaded_at FROM nodes UNION ALL SELECT id, added_at, removed_at, loaded_at FROM shared_nodes)) WHERE rn = 1),
judged AS (SELECT r.src_table, r.row_id, r.observed_at, (n.id IS NULL OR coalesce(n.added_at > r.observed_at, false) OR coalesce(n.removed_at <= r.observed_at, false)) AS orphan
  FROM real_refs r LEFT JOIN recs n ON n.id = r.k)"""


P2_FOUND = f"WITH {_refs()} SELECT src_table, row_id FROM judged WHERE orphan"
P2_REPORT = f"WITH {_refs()} SELECT src_table, strftime(observed_at, '%Y-%m') AS month, count(*) AS n_references, count(*) FILTER (WHERE orphan) AS n_orphans FROM judged GROUP BY 1, 2"

_NO = "(year(loaded_at) * 12 + month(loaded_at))"
P2_SNAPSHOTS = f"""WITH vr AS (SELECT 'edges' AS src_table, edge_id AS row_id, {canonical('target_id')} AS k, observed_at, loaded_at, {_NO} AS m FROM edges
    UNION ALL SELECT 'boundaries', boundary_id, {canonical('match_key')}, observed_at, loaded_at, {_NO} FROM boundaries),
  vp AS (SELECT id, added_at, removed_at, loaded_at, {_NO} AS m FROM nodes UNION ALL SELECT id, added_at, removed_at, loaded_at, {_NO} FROM shared_nodes),
  span AS (SELECT min(m) AS lo, max(m) AS hi FROM (SELECT m FROM vr UNION ALL SELECT m FROM vp)),
  ks AS (SELECT unnest(generate_series(1, hi - lo + 1)) AS k, lo FROM span),
  r AS (SELECT ks.k AS batch_no, vr.* FROM ks JOIN vr ON coalesce(vr.m - ks.lo + 1, 1) <= ks.k QUALIFY row_number() OVER (PARTITION BY ks.k, src_table, row_id ORDER BY loaded_at DESC NULLS LAST) = 1),
  p AS (SELECT ks.k AS batch_no, vp.* FROM ks JOIN vp ON coalesce(vp.m - ks.lo + 1, 1) <= ks.k QUALIFY row_number() OVER (PARTITION BY ks.k, id ORDER BY loaded_at DESC NULLS LAST) = 1)
  SELECT r.src_table, strftime(r.observed_at, '%Y-%m') AS month, count(*) AS n_references,
    count(*) FILTER (WHERE p.id IS NULL OR coalesce(p.added_at > r.observed_at, false) OR coalesce(p.removed_at <= r.observed_at, false)) AS n_orphans, CAST(r.batch_no AS INTEGER) AS batch_no
  FROM r LEFT JOIN p ON p.id = r.k AND p.batch_no = r.batch_no WHERE r.k IS NOT NULL AND r.k <> '' AND NOT regexp_matches(r.k, '^(signal:|nodepath:|rpc:|user://|uid://)') GROUP BY 1, 2, 5"""

_ENDS = f"""cur AS MATERIALIZED (SELECT type, origin, observed_at, {canonical('source_id')} AS s, {canonical('target_id')} AS t FROM (
  SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY loaded_at DESC NULLS LAST) rn FROM edges) WHERE rn = 1),
ends AS (SELECT 'source' AS endpoint, s AS key_id, type, origin, observed_at FROM cur UNION ALL SELECT 'target', t, type, origin, observed_at FROM cur)"""

P3_FOUND = f"WITH {_ENDS} SELECT endpoint, key_id FROM ends WHERE key_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 0.02 * (SELECT count(*) FROM cur)"
P3_KEYS = f"WITH {_ENDS} SELECT endpoint, key_id, type, origin, count(*) AS n_edges, min(observed_at) AS first_observed_at, max(observed_at) AS last_observed_at FROM ends GROUP BY 1, 2, 3, 4"


def _diff(entity: str, table: str, keys: list[tuple[str, str]], content: list[str], near: str) -> str:
    names = [n for _, n in keys]
    eq = " AND ".join(f"o.{n} = n.{n}" for n in names)
    same = " AND ".join(f"o.{c} = n.{c}" for c in [f"c{i}" for i in range(len(content))])
    out = ", ".join((f"coalesce(o.{c}, n.{c})" if c in names else "''") + f" AS {c}" for c in ("node_id", "edge_type", "source_id", "target_id"))
    picked = ", ".join(f"{e} AS {n}" for e, n in keys)
    parts = ", ".join(f"{e} AS c{i}" for i, e in enumerate(content))
    conf = "coalesce(confidence, 1.0)" if near else "1.0"
    return f"""(WITH s AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, {', '.join(names)} ORDER BY delivered_at DESC NULLS LAST) rn
  FROM (SELECT snapshot_no, delivered_at, {picked}, {parts}, {conf} AS conf FROM {table})) WHERE rn = 1),
  order_of AS (SELECT snapshot_no, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS following FROM (SELECT DISTINCT snapshot_no FROM s)),
  o AS (SELECT s.*, following FROM s JOIN order_of USING (snapshot_no) WHERE following IS NOT NULL), n AS (SELECT * FROM s WHERE snapshot_no > (SELECT min(snapshot_no) FROM s))
  SELECT '{entity}' AS entity, CAST(coalesce(o.following, n.snapshot_no) AS INTEGER) AS snapshot_no, {out},
    CASE WHEN o.rn IS NULL THEN 'added' WHEN n.rn IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM o FULL JOIN n ON {eq} AND o.following = n.snapshot_no
  WHERE o.rn IS NULL OR n.rn IS NULL OR NOT ({same}) OR abs(o.conf - n.conf) >= 1e-6)"""


_VALUE = "coalesce(nullif(trim(identity), ''), '{}')"
_SORTED_JSON = f"list_sort(list_transform(json_keys({_VALUE}), lambda k: k || '=' || ({_VALUE}->k)::VARCHAR))"
P4_FOUND = (
    _diff("node", "node_snapshots", [(canonical("id"), "node_id")], ["coalesce(kind, '')", "coalesce(path, '')", "coalesce(line, 0)", f"({_SORTED_JSON})"], "")
    + " UNION ALL "
    + _diff("edge", "edge_snapshots", [("type", "edge_type"), (canonical("source_id"), "source_id"), (canonical("target_id"), "target_id")], ["coalesce(origin, '')", "coalesce(resolved, false)", "coalesce(ev_file, '')", "coalesce(ev_line, 0)"], "near")
)


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_hierarchy": P1_HIERARCHY, "p1_descendants": P1_DESCENDANTS, "p2_found": P2_FOUND, "p2_report": P2_REPORT, "p2_snapshots": P2_SNAPSHOTS, "p3_found": P3_FOUND, "p3_keys": P3_KEYS, "p4_found": P4_FOUND}
