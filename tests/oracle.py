"""Compares a query with its DuckDB SQL over the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def same(spark, query, sql: str, sf_dir: str) -> None:
    found = query(spark, sf_dir).toArrow()
    duck = duckdb.connect()
    for name in TABLES:
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    cursor = duck.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(found.column_names)
    expected = sorted(tuple(_plain(v) for _, v in sorted(zip(names, row, strict=True))) for row in cursor.fetchall())
    got = sorted(tuple(_plain(v) for _, v in sorted(row.items())) for row in found.to_pylist())
    assert got == expected
