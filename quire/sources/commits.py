"""Numbered states of a folder of tables: which sub-folders make it up, switched at once.

A change writes its tables beside the others, which nothing reads yet, and then
one small file, `state-<number>`, that only one writer can create. Who began
from an older state than the newest fails there and has changed nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

_NAME = "state-"


class Conflict(RuntimeError):
    """Another writer has committed in between."""


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def fresh(self, kind: str) -> str:
        """The name of a sub-folder that no other writer uses."""
        return f"{kind}/{uuid.uuid4().hex}"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def numbers(self) -> list[int]:
        base = self._path(self.path)
        if not self._store.exists(base):
            return []
        return sorted(int(s.getPath().getName()[len(_NAME) :]) for s in self._store.listStatus(base) if s.getPath().getName().startswith(_NAME))

    def state(self, back: int = 0) -> tuple[int, dict]:
        """The number and content of the newest whole state, or of the one so many before it; 0 and nothing where there is none."""
        for n in self.numbers()[::-1]:
            read = self._store.open(self._path(self.at(f"{_NAME}{n}")))
            try:
                text = bytes(read.readAllBytes()).decode()
            finally:
                read.close()
            if text.endswith("\n"):  # else its writer has died on the way
                if not back:
                    return n, json.loads(text)
                back -= 1
        return 0, {}

    def commit(self, base: int, content: dict) -> int:
        """Makes content the newest state; base is the number that it was made from."""
        newest = (self.numbers() or [0])[-1]
        whole = self.state()[0]
        if whole != base:
            raise Conflict(f"{self.path} has state {whole}, the change was made on {base}")
        try:
            out = self._store.create(self._path(self.at(f"{_NAME}{newest + 1}")), False)
        except Exception as e:
            raise Conflict(f"another writer changes {self.path}") from e
        try:
            out.write((json.dumps(content) + "\n").encode())
        finally:
            out.close()
        return newest + 1

    def delete(self, name: str) -> None:
        self._store.delete(self._path(self.at(name)), True)

    def names(self, kind: str) -> list[str]:
        base = self._path(self.at(kind))
        return [f"{kind}/{s.getPath().getName()}" for s in self._store.listStatus(base)] if self._store.exists(base) else []
