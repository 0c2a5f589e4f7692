"""Rows of a query and of its SQL, in a form that can be compared."""

import math


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "quantize"):
        return float(v)
    return tuple(plain(x) for x in v) if isinstance(v, list | tuple) else v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def duck_rows(con, sql):
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)


def same(a, b) -> bool:
    close = lambda x, y: x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-8)
    return len(a) == len(b) and all(len(p) == len(q) and all(close(x, y) for x, y in zip(p, q, strict=True)) for p, q in zip(a, b, strict=True))
