"""Compares a query's rows with those of its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(sql)
    return [c[0] for c in cursor.description], cursor.fetchall()


def _key(row: tuple) -> tuple:
    return tuple((v is None, round(v, 4) if isinstance(v, float) else str(v)) if not isinstance(v, (int, float)) or isinstance(v, bool) else (False, round(float(v), 4)) for v in row)


def same_rows(df, sql: str, sf_dir: str) -> None:
    names, expected = rows_of(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    found = sorted((tuple(r[c] for c in names) for r in df.collect()), key=_key)
    expected = sorted(expected, key=_key)
    assert len(found) == len(expected)
    for a, b in zip(found, expected, strict=True):
        for x, y in zip(a, b, strict=True):
            if isinstance(x, float) and isinstance(y, (int, float)):
                assert math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6), (a, b)
            else:
                assert x == y, (a, b)
