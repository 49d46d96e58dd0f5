"""Registered queries against their SQL: used by the tests."""

from __future__ import annotations

import os

import duckdb


def mismatches(spark, queries, oracle, d: str) -> dict[str, str]:
    con, bad = duckdb.connect(), {}
    for t in os.listdir(d):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{d}/{t}'")
    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    for name, sql in oracle.items():
        frame = queries[name](spark, d)
        cols = sorted(frame.columns)
        got = sorted((tuple(norm(r[c]) for c in cols) for r in frame.collect()), key=repr)
        cur = con.execute(sql)
        names = [x[0] for x in cur.description]
        at = [names.index(c) for c in cols] if sorted(names) == cols else None
        if at is None:
            bad[name] = f"columns {cols} and {sorted(names)}"
            continue
        want = sorted((tuple(norm(r[i]) for i in at) for r in cur.fetchall()), key=repr)
        if got != want:
            bad[name] = f"{len(got)} and {len(want)} rows; {[x for x in zip(got, want) if x[0] != x[1]][:2]}"
    return bad
