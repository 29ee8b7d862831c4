"""Rows of a query and of its SQL, for comparison."""

from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, dict):
        return sorted((k, plain(v)) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return round(float(value), 9) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([plain(r[k]) for k in order]) for r in found)


def compare(spark, con, sf_dir, query, sql):
    """None, or what differs."""
    got = query(spark, sf_dir)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} and {sorted(names)}"
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(names, cur.fetchall())
    if a == b:
        return None if a else "no rows"
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"{len(a)} and {len(b)} rows; only here {only_a[:2]}; only in SQL {only_b[:2]}"
