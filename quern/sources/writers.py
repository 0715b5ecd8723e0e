"""Writers with save modes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from quern.frame import Frame
from quern.sources.readers import checked_name, jdbc_options

MODES = ("append", "overwrite", "error", "errorifexists", "ignore")
#: Storage kinds and file formats that lie that way.
STORAGE = {"columnar": "parquet", "row": "csv"}


class Writer:
    def __init__(self, df: DataFrame) -> None:
        self._df, self._mode, self._storage, self._partition, self._buckets = df, "error", "columnar", (), None

    def mode(self, saveMode: str) -> Writer:  # noqa: N803
        if saveMode.lower() not in MODES:
            raise ValueError(f"unknown save mode {saveMode!r}")
        self._mode = saveMode.lower()
        return self

    def storageType(self, storageType: str) -> Writer:  # noqa: N802, N803
        if storageType.lower() not in STORAGE:
            raise ValueError(f"unknown storage type {storageType!r}")
        self._storage = storageType.lower()
        return self

    def partitionBy(self, *cols: str) -> Writer:  # noqa: N802
        self._partition = cols
        return self

    def bucketBy(self, n: int, *cols: str) -> Writer:  # noqa: N802
        """Buckets a saved table, so that later joins on these keys don't shuffle it."""
        self._buckets = (n, cols)
        return self

    def _writer(self):
        out = self._df.write.mode(self._mode)
        return out.partitionBy(*self._partition) if self._partition else out

    def saveAsTable(self, table_name: str) -> None:  # noqa: N802
        out = self._writer().format(STORAGE[self._storage])
        if self._buckets:
            out = out.bucketBy(self._buckets[0], *self._buckets[1]).sortBy(*self._buckets[1])
        out.saveAsTable(checked_name(table_name))

    def insertInto(self, table_name: str) -> None:  # noqa: N802
        """By position; 'error' and 'ignore' look at whether the table has rows."""
        spark = self._df.sparkSession
        if self._mode in ("error", "errorifexists", "ignore") and not spark.table(checked_name(table_name)).isEmpty():
            if self._mode == "ignore":
                return
            raise ValueError(f"{table_name} has rows")
        self._df.write.insertInto(table_name, overwrite=self._mode == "overwrite")

    def parquet(self, path: str) -> None:
        self._writer().parquet(path)

    def csv(self, path: str, header: bool = True) -> None:
        self._writer().option("header", header).csv(path)

    def json(self, path: str) -> None:
        self._writer().json(path)

    def orc(self, path: str) -> None:
        self._writer().orc(path)

    def jdbc(self, url: str, dbtable: str, user: str = "", password: str = "", driver: str = "", mode: str = "append", properties: Mapping | None = None) -> Frame:
        """Writes a remote table; returns it as a frame."""
        if mode not in ("append", "overwrite"):
            raise ValueError("jdbc takes 'append' or 'overwrite'")
        options = jdbc_options(url, dbtable, user, password, driver, properties)
        self._df.write.format("jdbc").options(**options).mode(mode).save()
        return Frame(self._df.sparkSession.read.format("jdbc").options(**options).load())

    def saveAsForeignTable(self, name: str, options: Mapping[str, str], mode: str = "overwrite", fmt: str = "jdbc") -> Frame:  # noqa: N802
        """Writes through a connector and registers the result as a view."""
        spark = self._df.sparkSession
        self._df.write.format(fmt).options(**options).mode(mode).save()
        spark.read.format(fmt).options(**options).load().createOrReplaceTempView(checked_name(name))
        return Frame(spark.table(name))
