"""Compare registered queries with their oracle SQL: python tests/check_queries.py [--sf DIR] [name ...]."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, int):
        return v
    return v if isinstance(v, str) else str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(cols), sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, name, sf_dir):
    from palimpsest.catalog import ORACLES, QUERIES

    t0 = time.time()
    df = QUERIES[name](spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if name not in ORACLES:
        return len(got) > 0, f"rows={len(got)} (no oracle) {t1 - t0:.1f}s"
    res = con.execute(ORACLES[name])
    want_cols, want = rows_of([d[0] for d in res.description], res.fetchall())
    t2 = time.time()
    info = f"rows={len(got)}/{len(want)} {t1 - t0:.1f}s/{t2 - t1:.1f}s"
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols} {info}"
    if not want:
        return False, f"empty {info}"
    kinds = [{type(r[i]) for r in got if r[i] is not None} ^ {type(r[i]) for r in want if r[i] is not None} for i in range(len(got_cols))]
    if got != want:
        bad = next(((g, w) for g, w in zip(got, want) if g != w), (len(got), len(want)))
        only = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return False, f"values differ {info}\n   first {str(bad)[:900]}\n   only spark {str(only[0])[:600]}\n   only oracle {str(only[1])[:600]}"
    if any(kinds):
        return False, f"types differ {[(c, k) for c, k in zip(got_cols, kinds) if k]} {info}"
    return True, info


def main(argv):
    import palimpsest.catalog.all  # noqa: F401
    from palimpsest.catalog import QUERIES
    from palimpsest.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf_dir, argv = argv[1], argv[2:]
    names = [n for n in QUERIES if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) or QUERIES_MODULE(n) == a for a in argv)]
    spark = local_session("check", 8)
    con = connect(sf_dir)
    bad = []
    for n in names:
        try:
            ok, info = compare(spark, con, n, sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, info = False, f"{type(e).__name__}: {str(e)[:1200]}"
            if "-v" in argv:
                traceback.print_exc()
        print(("ok  " if ok else "BAD ") + n + " " + info, flush=True)
        if not ok:
            bad.append(n)
    print(f"{len(names) - len(bad)}/{len(names)} ok; bad: {bad}")
    return 1 if bad else 0


def QUERIES_MODULE(name):
    from palimpsest.catalog import MODULES

    return MODULES.get(name)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
