"""A sink that gives rows to a user's receiver and tells it afterwards whose deliveries count.

A task may run twice, after a failure or as a speculative copy. So tasks only prepare deliveries, each one named by a
receipt, and the receipts of the tasks that Spark accepted are committed together at the end, or all are called off.
"""

from __future__ import annotations

import base64
import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs, parquet
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "lumengrid_committed"


class Receiver:
    """What a user writes: `start`, `receive` and `finish` run in each task, the others once, near the driver."""

    def start(self) -> None:
        """Before a task's first row."""

    def receive(self, row: Row) -> None:
        """A row; nothing that others can see may happen yet."""
        raise NotImplementedError

    def finish(self) -> Any:
        """After a task's last row: a receipt that names what was prepared."""

    def commit(self, receipts: list) -> None:
        """Make the deliveries of these receipts count."""
        raise NotImplementedError

    def abort(self, receipts: list) -> None:
        """Undo what these receipts name; tasks that failed have none."""


@dataclass
class Receipt(WriterCommitMessage):
    value: Any


class _Writer(DataSourceWriter):
    def __init__(self, receiver: Receiver):
        self.receiver = receiver

    def write(self, iterator: Iterator[Row]) -> Receipt:
        self.receiver.start()
        for row in iterator:
            self.receiver.receive(row)
        return Receipt(self.receiver.finish())

    def commit(self, messages: list) -> None:
        self.receiver.commit([m.value for m in messages if m is not None])

    def abort(self, messages: list) -> None:
        self.receiver.abort([m.value for m in messages if m is not None])


class _Sink(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(pickle.loads(base64.b64decode(self.options["receiver"])))


def sink_committed(rows: DataFrame, receiver: Receiver) -> None:
    """Deliver every row once, however often tasks run."""
    rows.sparkSession.dataSource.register(_Sink)
    packed = base64.b64encode(cloudpickle.dumps(receiver)).decode()
    rows.write.format(NAME).option("receiver", packed).mode("append").save()


class FolderReceiver(Receiver):
    """What a function makes of each row (a dict, or None for nothing), as Parquet files of a folder.

    Files are written under a name of their own beside the folder and moved into it by the commit. The folder may be
    in any store that Arrow reaches, by its URI.
    """

    def __init__(self, path: str, fn: Callable[[Row], dict | None] = Row.asDict, rows: int = 1000):
        self.path, self.fn, self.rows = path.rstrip("/"), fn, rows

    def _store(self) -> tuple[fs.FileSystem, str]:
        store, path = fs.FileSystem.from_uri(self.path)
        return store, path

    def start(self) -> None:
        self.name, self.held, self.writer = f"{uuid.uuid4().hex}.parquet", [], None

    def receive(self, row: Row) -> None:
        if (made := self.fn(row)) is not None:
            self.held.append(made)
        if len(self.held) >= self.rows:
            self._put()

    def _put(self) -> None:
        table = pa.Table.from_pylist(self.held, None if self.writer is None else self.writer.schema)
        if self.writer is None:
            store, path = self._store()
            store.create_dir(f"{path}-staged", recursive=True)
            self.writer = parquet.ParquetWriter(f"{path}-staged/{self.name}", table.schema, filesystem=store)
        self.writer.write_table(table)
        self.held = []

    def finish(self) -> str | None:
        if self.held:
            self._put()
        if self.writer is None:
            return None
        self.writer.close()
        self.writer = None
        return self.name

    def commit(self, receipts: list) -> None:
        store, path = self._store()
        store.create_dir(path, recursive=True)
        for name in receipts:
            if name:
                store.move(f"{path}-staged/{name}", f"{path}/{name}")
        self._clear()

    def abort(self, receipts: list) -> None:
        self._clear()

    def _clear(self) -> None:
        store, path = self._store()
        if store.get_file_info(f"{path}-staged").type != fs.FileType.NotFound:
            store.delete_dir(f"{path}-staged")
