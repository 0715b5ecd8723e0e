"""Tables that stay where they are: views and tables over files, JDBC or queries."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from quern.frame import Frame
from quern.sources.readers import checked_name, jdbc_options

FORMATS = ("csv", "json", "parquet", "orc")


class ForeignTables:
    """Transient ones are temporary views, persistent ones external tables."""

    def __init__(self, session) -> None:
        self._session, self._spark = session, session.spark

    def _register(self, fmt: str, options: Mapping, name: str | None, persistent: bool) -> Frame:
        name = checked_name(name or f"foreign_{uuid.uuid4().hex[:12]}")
        if persistent:
            self._spark.catalog.createTable(name, source=fmt, **{k: str(v) for k, v in options.items()})
        else:
            reader = self._spark.read.format(fmt).options(**options)
            reader.load().createOrReplaceTempView(name)
            self._session.track_view(name)
        return self._session.table(name)

    def register_file_table(self, path: str, format: str = "csv", name: str | None = None, options: Mapping | None = None, persistent: bool = False) -> Frame:  # noqa: A002
        if format not in FORMATS:
            raise ValueError(f"unknown format {format!r}")
        return self._register(format, {**(options or {}), "path": path}, name, persistent)

    def register_jdbc_table(self, url: str, dbtable: str, user: str = "", password: str = "", driver: str = "", name: str | None = None, persistent: bool = False, properties: Mapping | None = None) -> Frame:
        return self._register("jdbc", jdbc_options(url, dbtable, user, password, driver, properties), name, persistent)

    def create_from_query(self, name: str, select_sql: str, persistent: bool = False) -> Frame:
        if persistent:
            self._spark.sql(select_sql).write.saveAsTable(checked_name(name))
        else:
            self._spark.sql(select_sql).createOrReplaceTempView(checked_name(name))
            self._session.track_view(name)
        return self._session.table(name)

    def drop(self, name: str) -> None:
        if not self._spark.catalog.dropTempView(checked_name(name)):
            self._spark.sql(f"DROP TABLE IF EXISTS {name}")

    def tables(self) -> list[str]:
        return sorted(t.name for t in self._spark.catalog.listTables() if t.isTemporary or t.tableType == "EXTERNAL")

    def is_foreign(self, name: str) -> bool:
        return name in self.tables()

    def is_persistent(self, name: str) -> bool:
        return any(t.name == name and not t.isTemporary for t in self._spark.catalog.listTables())

    def refresh(self, name: str) -> None:
        """Forgets cached file lists and metadata."""
        self._spark.catalog.refreshTable(checked_name(name))
