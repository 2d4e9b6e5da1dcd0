"""A small versioned log beside a table: the columns each import brought, and how many rows.

Version ``n`` is the file ``_log/<n>.json`` in the table's folder, written under a name of its own and renamed into
place, which fails if another writer was first; the loser takes the next number. Readers build the table's schema
from the log and open no footer for it. All access goes through Spark's file systems, on the driver; a version
holds column names and types only, so its size doesn't follow the rows.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

FOLDER = "_log"


class ColumnConflict(ValueError):
    """A column arrives with another type than the table holds."""


class TableLog:
    def __init__(self, spark: SparkSession, table: str):
        self._spark, self._jvm = spark, spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._root = f"{table.rstrip('/')}/{FOLDER}"
        self._fs = self._path(self._root).getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def has_table(self) -> bool:
        """Whether the table's folder is there."""
        return self._fs.exists(self._path(self._root).getParent())

    def versions(self) -> list[dict]:
        """All versions, oldest first."""
        folder = self._path(self._root)
        if not self._fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder))
        out = []
        for name in names:
            if name.endswith(".json") and not name.startswith((".", "_")):
                stream = self._fs.open(self._path(f"{self._root}/{name}"))
                try:
                    text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
                out.append(json.loads(text))
        return out

    def columns(self) -> dict[str, str]:
        """Name and type of every column of any version, in order of arrival."""
        found: dict[str, str] = {}
        for version in self.versions():
            for name, kind in version["columns"].items():
                found.setdefault(name, kind)
        return found

    def schema(self) -> StructType | None:
        """The table's schema, None before the first version."""
        columns = self.columns()
        return StructType([StructField(n, _parse_datatype_string(k)) for n, k in columns.items()]) if columns else None

    def check(self, schema: StructType) -> None:
        """Raises :class:`ColumnConflict` with all columns whose type differs from the table's."""
        have = self.columns()
        off = [f"{f.name}: {have[f.name]}, now {f.dataType.simpleString()}" for f in schema if have.get(f.name, f.dataType.simpleString()) != f.dataType.simpleString()]
        if off:
            raise ColumnConflict("; ".join(off))

    def commit(self, schema: StructType, rows: int) -> int:
        """Adds a version and returns its number."""
        text = json.dumps({"columns": {f.name: f.dataType.simpleString() for f in schema}, "rows": rows}, indent=1)
        draft = self._path(f"{self._root}/_draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        options = self._spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs.getUri(), self._conf)
        number = len(self.versions())
        while True:
            try:
                context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._path(f"{self._root}/{number:08}.json")), options)
                return number
            except Py4JJavaError as error:
                if "FileAlreadyExists" not in str(error.java_exception.getClass()):
                    raise
                number += 1
