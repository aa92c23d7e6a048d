"""Compare a query with its SQL: column names, types, row count and values."""

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def compare(df, con, sql):
    """Empty text when both sides agree, else what differs."""
    names = sorted(df.columns)
    got = df.select(*names).toArrow()
    res = con.execute(sql)
    want = res.to_arrow_table() if hasattr(res, "to_arrow_table") else res.fetch_arrow_table()
    if sorted(want.column_names) != names:
        return f"columns {names} != {sorted(want.column_names)}"
    want = want.select(names)
    types = [(n, str(g.type), str(w.type)) for n, g, w in zip(names, got.schema, want.schema) if not _same(g.type, w.type)]
    if got.num_rows != want.num_rows:
        return f"rows {got.num_rows} != {want.num_rows}"
    a = sorted((tuple(r[n] for n in names) for r in got.to_pylist()), key=_key)
    b = sorted((tuple(r[n] for n in names) for r in want.to_pylist()), key=_key)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}"
    return f"types {types}" if types else ""


def _same(a, b):
    text = lambda t: str(t).replace("large_", "").replace(" not null", "")
    return text(a) == text(b)
