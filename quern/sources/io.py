"""Module-level readers on a given or the active session."""

from __future__ import annotations

from collections.abc import Mapping

from quern.frame import Frame
from quern.session import Session, get_active_session

#: File endings and formats.
ENDINGS = {"csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "pq": "parquet", "orc": "orc"}


def _session(session: Session | None) -> Session:
    session = session or get_active_session()
    if session is None:
        raise RuntimeError("no active session")
    return session


def read_csv(path: str, foreign: bool = False, name: str | None = None, persistent: bool = False, options: Mapping | None = None, session: Session | None = None) -> Frame:
    return _session(session).read.csv(path, foreign, name, persistent, options)


def read_json(path: str, foreign: bool = False, name: str | None = None, persistent: bool = False, options: Mapping | None = None, session: Session | None = None) -> Frame:
    return _session(session).read.json(path, foreign, name, persistent, options)


def read_parquet(path: str, foreign: bool = False, name: str | None = None, persistent: bool = False, options: Mapping | None = None, session: Session | None = None) -> Frame:
    return _session(session).read.parquet(path, foreign, name, persistent, options)


def read_table(path: str, format: str | None = None, session: Session | None = None, **options) -> Frame:  # noqa: A002
    """Format by name or by the file's ending."""
    kind = format or ENDINGS.get(path.rstrip("/").rpartition(".")[2].lower())
    if kind not in ENDINGS.values():
        raise ValueError(f"unknown format of {path!r}")
    return getattr(_session(session).read, kind)(path, options=options)


def read_sql(sql: str, index_col: str | None = None, session: Session | None = None) -> Frame:
    """SQL text as a lazy frame, sorted by ``index_col`` if given."""
    frame = _session(session).sql(sql)
    return frame.orderBy(index_col) if index_col else frame


read_sql_query = read_sql


def read_sql_table(table_name: str, schema: str | None = None, index_col: str | None = None, session: Session | None = None) -> Frame:
    frame = _session(session).table(f"{schema}.{table_name}" if schema else table_name)
    return frame.orderBy(index_col) if index_col else frame


def from_pandas(pdf, session: Session | None = None) -> Frame:
    return _session(session).createDataFrame(pdf)
