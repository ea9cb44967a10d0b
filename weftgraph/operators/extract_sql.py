"""DuckDB statements for the scans of source files, and for declarations that begin a line.

A statement cannot parse; those of declarations find them by regular expressions on lines, which agrees
where no declaration stands in a string or behind a syntax error.
"""

from __future__ import annotations

from weftgraph.operators.training_sql import canonical, folded, trimmed
from weftgraph.sources.discovery import KINDS

_FILES = f"f AS MATERIALIZED (SELECT {canonical('path')} AS path, content FROM (SELECT *, row_number() OVER (PARTITION BY {canonical('path')} ORDER BY committed_at DESC NULLS LAST, file_id DESC) rn FROM source_files WHERE path IS NOT NULL) WHERE rn = 1)"
_NAME = "list_extract(string_split(path, '/'), -1)"
_EXT = f"CASE WHEN contains({_NAME}, '.') THEN lower(list_extract(string_split({_NAME}, '.'), -1)) END"
_UID = r"""'uid="(uid://[^"]+)"'"""


def _kind() -> str:
    arms = " ".join(f"WHEN {_EXT} IN ({', '.join(repr(x) for x in extensions)}) THEN '{kind}'" for kind, extensions in KINDS.items() if kind != "plugin")
    return f"CASE WHEN {_NAME} = 'plugin.cfg' THEN 'plugin' {arms} END"


def oracle_sql() -> dict[str, str]:
    heads = f"""heads AS (SELECT path, nullif(regexp_extract(coalesce(list_extract(list_filter(list_transform(string_split(regexp_replace(content, '^\\x{{FEFF}}', ''), chr(10)), lambda s: {trimmed('s')}), lambda s: s <> '' AND NOT s LIKE ';%'), 1), ''), {_UID}, 1), '') AS uid
      FROM f WHERE {_EXT} IN ('tscn', 'scn', 'tres', 'res'))"""
    cars = f"""cars AS (SELECT path, nullif(regexp_extract(content, {_UID}, 1), '') AS uid, nullif(regexp_extract(content, '(?m)^[ \\t\\r\\f]*source_file[ \\t]*=[ \\t]*"([^"\\n]+)"', 1), '') AS source_file FROM f WHERE {_EXT} = 'import')"""
    norm = f"(CASE WHEN {trimmed('source_file')} LIKE 'uid://%' THEN {trimmed('source_file')} ELSE 'res://' || {folded(f'''regexp_replace({trimmed('source_file')}, '^res://', '')''')} END)"
    return {
        "s6_kinds": f"WITH {_FILES} SELECT path, {_kind()} AS kind FROM f",
        "s4_ignored": f"""WITH {_FILES}, r AS (SELECT path, string_split(regexp_replace(path, '^res://', ''), '/') AS s, regexp_replace(path, '^res://', '') AS q FROM f)
          SELECT path, list_contains(s, 'npc') OR list_contains(s, '.godot') OR list_contains(s, '.git') OR len(list_filter(s, lambda x: x LIKE '%.import')) > 0 OR regexp_matches(q, '^[^/]*/ui/.') AS ignored FROM r""",
        "s8_header_uids": f"WITH {_FILES}, {heads} SELECT path, uid FROM heads",
        "s9_import_uids": f"WITH {_FILES}, {cars} SELECT path, uid, source_file FROM cars",
        "s_uid_map": f"""WITH {_FILES}, {heads}, {cars} SELECT uid, max(p)[5:] AS path FROM (SELECT uid, 'r0: ' || path AS p FROM heads WHERE uid IS NOT NULL UNION ALL SELECT uid, 'r1: ' || {norm} FROM cars WHERE uid IS NOT NULL AND source_file IS NOT NULL) GROUP BY uid""",
        "i_dead_export": f"""WITH {_FILES}, r AS (SELECT path, string_split(content, chr(10)) AS ls FROM f WHERE {_EXT} = 'gd'), e AS (SELECT path, unnest(ls) AS l, generate_subscripts(ls, 1) AS n FROM r),
          v AS (SELECT path, n, regexp_extract(l, '^@export[a-z_]*(?:\\([^)]*\\))?[ \\t]+(?:@[a-z_]+[ \\t]+)*(?:static[ \\t]+)?var[ \\t]+([A-Za-z_][A-Za-z_0-9]*)', 1) AS v FROM e)
          SELECT 'dead_export' AS rule, 'warning' AS severity, path AS node_id, path AS file, CAST(n AS INTEGER) AS line, path || '::' || v || ' is never assigned' AS message FROM v WHERE v <> ''""",
        "x11_signals": f"WITH {_FILES} SELECT DISTINCT path AS file, n AS name FROM (SELECT path, unnest(regexp_extract_all(content, '(?m)^[ \\t]*signal[ \\t]+([A-Za-z_][A-Za-z_0-9]*)', 1)) AS n FROM f WHERE {_EXT} = 'gd')",
        "x10_bases": f"""WITH {_FILES} SELECT DISTINCT path AS file, regexp_replace(n, '^"|"$', '', 'g') AS base FROM (SELECT path, unnest(regexp_extract_all(content, '(?m)^(?:class_name[ \\t]+[A-Za-z_0-9]+[ \\t]+)?extends[ \\t]+([A-Za-z_][A-Za-z_0-9.]*|"[^"\\n]*")', 1)) AS n FROM f WHERE {_EXT} = 'gd')""",
    }
