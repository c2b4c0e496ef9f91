"""Compare a query with its SQL in DuckDB: names, rows and values, in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float) and v == v and abs(v) < 2**53 and v == int(v):
        return int(v)
    if hasattr(v, "to_eng_string"):
        return plain(float(v))
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, query, sql, sf):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    df = query(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want = rows_of([d[0] for d in rel.description], rel.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
