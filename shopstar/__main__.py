"""Command line: the warehouse runbook as Spark jobs.

    python -m shopstar build    --src DIR --out DIR          # land, stage, marts
    python -m shopstar load     --src DIR --out DIR          # land raw files only
    python -m shopstar report   NAME (--marts DIR | --sf DIR) [--rows N]
    python -m shopstar reports                                # list report names
    python -m shopstar snapshot --marts DIR --root DIR [--schema-only]
    python -m shopstar verify   SNAPSHOT
    python -m shopstar list     --root DIR
    python -m shopstar restore  SNAPSHOT --target DIR [--table T ...] [--confirm]

The session comes from ``spark-submit``/the environment; settings the
results depend on are applied on top (see ``shopstar.session``).
"""

from __future__ import annotations

import argparse
import sys


def _session():
    from pyspark.sql import SparkSession

    from shopstar.session import apply_session_conf, ensure_checkpoint_dir
    spark = (SparkSession.builder.appName("shopstar")
             .config("spark.ui.enabled", "false")          # no web server from the CLI
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    apply_session_conf(spark)
    ensure_checkpoint_dir(spark)
    return spark


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="shopstar")
    sub = p.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("build"); b.add_argument("--src", required=True); b.add_argument("--out", required=True)
    ld = sub.add_parser("load"); ld.add_argument("--src", required=True); ld.add_argument("--out", required=True)
    r = sub.add_parser("report"); r.add_argument("name"); r.add_argument("--marts"); r.add_argument("--sf")
    r.add_argument("--rows", type=int, default=20)
    sub.add_parser("reports")
    s = sub.add_parser("snapshot"); s.add_argument("--marts", required=True); s.add_argument("--root", required=True)
    s.add_argument("--schema-only", action="store_true")
    v = sub.add_parser("verify"); v.add_argument("snapshot")
    li = sub.add_parser("list"); li.add_argument("--root", required=True)
    rs = sub.add_parser("restore"); rs.add_argument("snapshot"); rs.add_argument("--target", required=True)
    rs.add_argument("--table", action="append"); rs.add_argument("--confirm", action="store_true")
    a = p.parse_args(argv)

    if a.cmd == "reports":
        from shopstar.plans.registry import queries
        print("\n".join(sorted(queries())))
        return 0
    spark = _session()
    if a.cmd == "build":
        from shopstar.operators.warehouse import build_warehouse, load_report
        build_warehouse(spark, a.src, a.out)
        load_report(spark, a.out).show(30, truncate=False)
    elif a.cmd == "load":
        from shopstar.sources.delimited import load_all, load_report
        load_all(spark, a.src, a.out)
        load_report(spark, a.out).show(30, truncate=False)
    elif a.cmd == "report":
        from shopstar.operators.marts import WrittenMarts
        from shopstar.plans.registry import on_marts, queries
        if a.marts:
            df = on_marts(a.name, WrittenMarts(spark, a.marts))
        elif a.sf:
            df = queries()[a.name](spark, a.sf)
        else:
            p.error("report needs --marts or --sf")
        df.show(a.rows, truncate=False)
    elif a.cmd == "snapshot":
        from shopstar.operators.marts import DIM_KEYS, FACT_TABLES, WrittenMarts
        from shopstar.operators.snapshot import snapshot
        m = WrittenMarts(spark, a.marts)
        print(snapshot(spark, {t: getattr(m, t) for t in (*DIM_KEYS, *FACT_TABLES)}, a.root,
                       schema_only=a.schema_only))
    elif a.cmd == "verify":
        from shopstar.operators.snapshot import verification_passed, verify_snapshot
        rep = verify_snapshot(spark, a.snapshot)
        rep.show(100, truncate=False)
        return 0 if verification_passed(rep) else 1
    elif a.cmd == "list":
        from shopstar.operators.snapshot import list_snapshots
        list_snapshots(spark, a.root).show(100, truncate=False)
    elif a.cmd == "restore":
        from shopstar.operators.snapshot import restore
        restore(spark, a.snapshot, a.target, a.table, dry_run=not a.confirm, confirm=a.confirm).show(100, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
