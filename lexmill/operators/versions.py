"""Tables that jobs replace step by step: data folders and a manifest that names the valid ones.

A commit writes its data first and then one small manifest file, put in place by
a rename. Readers see what the newest manifest names, so a job that dies before
the rename has changed nothing, and a step that runs again finds itself
committed. All files go through Spark and the file system of the folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """Manifest of one folder: ``parts`` (data folders), ``done`` (step or source -> last mark)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # -- files -----------------------------------------------------------------

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _put(self, path: str, text: str) -> None:
        fs, temporary = self._fs(f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(temporary, True)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(self._fs(path)[1]) or not fs.rename(temporary, self._fs(path)[1]):
            fs.delete(temporary, False)
            raise RuntimeError(f"another job has written {path}")

    # -- state -----------------------------------------------------------------

    def number(self) -> int:
        return max((int(n.split(".")[0]) for n in self._names(f"{self.folder}/manifest") if n.endswith(".json")), default=-1)

    def state(self) -> dict:
        n = self.number()
        if n < 0:
            return {"parts": [], "done": {}}
        return json.loads(self.spark.read.text(f"{self.folder}/manifest/{n:010}.json", wholetext=True).first()[0])

    def commit(self, state: dict) -> None:
        self._put(f"{self.folder}/manifest/{self.number() + 1:010}.json", json.dumps(state))

    def write(self, df: DataFrame) -> str:
        """Store rows in a new data folder, which counts once a manifest names it."""
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        return name

    def open(self, parts: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/{p}" for p in parts])

    def current(self) -> DataFrame | None:
        """Rows of the valid data folders."""
        parts = self.state()["parts"]
        return self.open(parts) if parts else None

    # -- changes ---------------------------------------------------------------

    def append(self, df: DataFrame, source: str, mark: int, compact: Callable[[DataFrame], DataFrame], most: int = 8) -> bool:
        """Add rows once per (source, mark); marks of a source rise. Beyond ``most`` folders all are compacted to one."""
        state = self.state()
        if state["done"].get(source, -1) >= mark:
            return False
        parts = [*state["parts"], self.write(df)]
        if len(parts) > most:
            parts = [self.write(compact(self.open(parts)))]
        self.commit({"parts": parts, "done": state["done"] | {source: mark}})
        return True

    def step(self, name: str, make: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        """Tables of a step: stored and committed once, read back whenever the step is met again."""
        state = self.state()
        if name not in state["done"]:
            state["done"][name] = {table: self.write(df) for table, df in make().items()}
            self.commit(state)
        return {table: self.open([part]) for table, part in state["done"][name].items()}

    def vacuum(self) -> int:
        """Delete data folders and manifests that the newest manifest does not need; run it while no job writes."""
        state = self.state()
        held = {*state["parts"], *(p for d in state["done"].values() if isinstance(d, dict) for p in d.values())}
        gone = [f"{self.folder}/data/{n}" for n in self._names(f"{self.folder}/data") if f"data/{n}" not in held]
        gone += [f"{self.folder}/manifest/{n}" for n in self._names(f"{self.folder}/manifest") if n != f"{self.number():010}.json"]
        for path in gone:
            fs, p = self._fs(path)
            fs.delete(p, True)
        return len(gone)
