"""A Spark data source over SQLite files, and a writer that replaces a table in one transaction."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "millrace_sqlite"

    def schema(self) -> str:
        raise ValueError("the reader gives the schema")

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options["path"], self.options["query"], [f.name for f in schema.fields])


class SqliteReader(DataSourceReader):
    """Reads a query's rows; a file is read by one task."""

    def __init__(self, path: str, query: str, names: list[str]):
        self.path, self.query, self.names = path, query, names

    def read(self, partition) -> Iterator[tuple]:
        import sqlite3

        link = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            rows = link.execute(self.query)
            have = [d[0] for d in rows.description]
            places = [have.index(n) for n in self.names]
            for r in rows:
                yield tuple(None if r[p] is None else str(r[p]) for p in places)
        finally:
            link.close()


def write_sqlite(df: DataFrame, path: str, table: str) -> None:
    """Rows go through the driver a partition at a time; readers see the old table until all are there."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "boolean": "INTEGER"}
    link = sqlite3.connect(path)
    quoted = '"' + table.replace('"', '""') + '"'
    columns = ", ".join('"' + n.replace('"', '""') + '" ' + kinds.get(t, "TEXT") for n, t in df.dtypes)
    texts = df.selectExpr(*(f"`{n}`" if t in kinds else f"cast(`{n}` AS string) AS `{n}`" for n, t in df.dtypes))
    try:
        with link:
            link.execute(f"DROP TABLE IF EXISTS {quoted}")
            link.execute(f"CREATE TABLE {quoted} ({columns})")
            link.executemany(f"INSERT INTO {quoted} VALUES ({', '.join('?' * len(df.columns))})", (tuple(r) for r in texts.toLocalIterator()))
    finally:
        link.close()
