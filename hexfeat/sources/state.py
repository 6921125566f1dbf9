"""Versioned JSON state with compare-and-swap: of several writers that have read one generation, exactly one puts the next."""

from __future__ import annotations

import json
import os
import time
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession

# Fixed value: the state that a watch begins with.
DEFAULTS = {"mode": "quiet", "prior_mode": None, "revert_at": None, "consecutive_fire_scans": 0, "consecutive_no_fire_scans": 0, "active_fire_cells": []}


class Versions:
    """Generations of a small JSON object in a folder, one file each: 1.json, 2.json, and so on.

    A generation is put by creating its file only if it is absent, which the file system decides: a hard link of a local
    file, an exclusive create of any other (atomic on HDFS and on object stores with conditional puts). A file appears
    whole or, on stores that show files as they are written, is read again until it is whole. Old generations stay as an
    audit trail until `prune`.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._folder = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())
        parsed = urlparse(str(self._fs.makeQualified(self._folder).toString()))
        self._local = parsed.path if parsed.scheme == "file" else None

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._folder):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, defaults: dict | None = None) -> tuple[int, dict]:
        """The newest generation (0 if there is none) and its state, over the defaults."""
        defaults = DEFAULTS if defaults is None else defaults
        numbers = self._numbers()
        return (numbers[-1], defaults | self._load(numbers[-1])) if numbers else (0, dict(defaults))

    def _load(self, number: int, patience: int = 50) -> dict:
        for left in range(patience, -1, -1):
            try:
                return self._parse(number)
            except ValueError:  # another writer is at it
                if not left:
                    raise
                time.sleep(0.1)
        raise AssertionError

    def _parse(self, number: int) -> dict:
        stream = self._fs.open(self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{number}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, state: dict, generation: int) -> bool:
        """Puts the generation after the one that was read; False, and nothing changed, if another writer has put it first."""
        payload, name = json.dumps(state, default=str, sort_keys=True), f"{generation + 1}.json"
        numbers = self._numbers()
        if (numbers[-1] if numbers else 0) != generation:
            return False
        return self._link(payload, name) if self._local else self._create(payload, name)

    def _link(self, payload: str, name: str) -> bool:
        os.makedirs(self._local, exist_ok=True)
        draft = f"{self._local}/.{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as f:
            f.write(payload)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, f"{self._local}/{name}")
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True

    def _create(self, payload: str, name: str) -> bool:
        from py4j.protocol import Py4JJavaError

        try:
            stream = self._fs.create(self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        stream.write(bytearray(payload, "utf-8"))
        stream.close()
        return True

    def update(self, change, attempts: int = 10) -> tuple[int, dict]:
        """Reads, applies change (state -> state) and writes, again from the start where another writer was first."""
        for _ in range(attempts):
            generation, state = self.read()
            changed = change(dict(state))
            if self.write(changed, generation):
                return generation + 1, changed
        raise RuntimeError(f"{attempts} other writers were first")

    def prune(self, keep: int = 100) -> None:
        """Deletes all but the newest `keep` generations."""
        for number in self._numbers()[: -max(keep, 1)]:
            self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{number}.json"), False)
