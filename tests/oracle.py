"""Compare a query with its oracle SQL on the given tables."""

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, int(v))
    if isinstance(v, float):
        if math.isnan(v):
            return (3, "nan")
        return (1, v)
    if isinstance(v, int):
        return (1, v)
    return (2, str(v))


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def _same(a, b):
    if a == b:
        return True
    if a[0] == b[0] == 1:
        return math.isclose(a[1], b[1], rel_tol=0, abs_tol=0)
    return False


def differences(con, df, sql):
    """Empty string when equal, else a short description."""
    cols = df.columns
    mine = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    ocols = [c[0] for c in cur.description]
    theirs = cur.fetchall()
    c1, r1 = _rows(cols, mine)
    c2, r2 = _rows(ocols, theirs)
    if c1 != c2:
        return f"columns {c1} != {c2}"
    if len(r1) != len(r2):
        return f"rows {len(r1)} != {len(r2)}; {r1[:2]} {r2[:2]}"
    for a, b in zip(r1, r2):
        if not all(_same(x, y) for x, y in zip(a, b)):
            n = sum(1 for p, q in zip(r1, r2) if p != q)
            return f"{n} of {len(r1)} rows differ, first {a} != {b}"
    return ""
