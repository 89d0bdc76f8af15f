"""How queries are declared: a name, a function of the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, rounded: tuple[str, ...] = ()):
    """Registers ``f(testbed) -> DataFrame``; ``sql`` may use the common table expressions of ``testbed.BASE``.

    ``rounded``: columns that both give as they stand and that are rounded to 6 decimals at the end.
    """

    def add(f: Callable[..., DataFrame]):
        from harrow.plans.testbed import BASE, Testbed, r6

        if name in QUERIES:
            raise ValueError(f"two queries {name}")
        QUERIES[name] = lambda spark, sf_dir: f(Testbed(spark, sf_dir)).withColumns({c: r6(c) for c in rounded})
        if sql is not None:
            text = sql.strip()
            recursive = text.upper().startswith("WITH RECURSIVE")
            more = text[len("WITH RECURSIVE" if recursive else "WITH"):].lstrip() if text.upper().startswith("WITH") else None
            SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{BASE}" + (f",\n{more}" if more is not None else f"\n{text}")
            if rounded:
                SQL[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in rounded)}) FROM ({SQL[name]})"
        return f

    return add
