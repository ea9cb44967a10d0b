"""Command line: analyze, graph, stats, check, impact.  Exit codes: 0 done, 1 failed, 2 wrong usage."""

from __future__ import annotations

import argparse
import sys

DEFAULT_STORE = "weftgraph-store"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftgraph", description="Architecture graphs of game projects.")
    sub = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, text: str) -> argparse.ArgumentParser:
        v = sub.add_parser(name, help=text)
        v.add_argument("--db", default=DEFAULT_STORE, help="folder of the store")
        return v

    v = verb("analyze", "analyze a project and store it")
    v.add_argument("dir")
    v = verb("graph", "show a node and its edges")
    v.add_argument("--file", required=True, help="id of the node")
    v.add_argument("--json", action="store_true")
    v = verb("stats", "show totals and the nodes with most fan-in")
    v.add_argument("--json", action="store_true")
    v.add_argument("--top", type=int, default=10, help="0 or less: all")
    v = verb("check", "check the integrity of a project")
    v.add_argument("dir")
    v.add_argument("--json", action="store_true")
    v.add_argument("--severity", choices=("error", "warning", "info"), default="info")
    v.add_argument("--rule", default="", help="names, joined by ','")
    v.add_argument("--exit-code", action="store_true", help="fail if something is found")
    v = verb("impact", "show what depends on a node")
    v.add_argument("--file", required=True)
    v.add_argument("--forward", action="store_true")
    v.add_argument("--depth", type=int, default=0)
    return p


def run(argv: list[str], out=print, spark=None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code in (0, None) else 2
    from weftgraph import report
    from weftgraph.analyze import analyze, rule_settings
    from weftgraph.operators import integrity
    from weftgraph.session import local_session
    from weftgraph.store import Store, StoreError

    spark = spark or local_session("*")
    try:
        if a.verb == "analyze":
            p = analyze(spark, a.dir)
            Store(spark, a.db).save(p)
            out(report.summary(p, a.dir, a.db))
        elif a.verb == "check":
            p = analyze(spark, a.dir)
            found = integrity.findings(p, rule_settings(a.dir), tuple(x for x in a.rule.split(",") if x))
            Store(spark, a.db).save(p, found)
            rows = report.findings_view(found, a.severity)
            out(report.as_json(rows) if a.json else report.findings_text(rows, p.unresolved().count()))
            return 1 if rows and a.exit_code else 0
        else:
            p = Store(spark, a.db).load()
            if a.verb == "stats":
                view = report.stats_view(p, a.top)
                out(report.as_json(view) if a.json else report.stats_text(view))
            elif a.verb == "graph":
                view = report.node_view(p, a.file)
                if view is None:
                    out(f"no node {a.file}")
                    return 1
                out(report.as_json(view) if a.json else report.node_text(view))
            else:
                out(report.as_json(report.impact(p, a.file, a.depth, not a.forward)))
    except (StoreError, OSError, report.TooManyRows) as e:
        out(f"error: {e}")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
