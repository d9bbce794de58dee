"""Stored query results: a Parquet table per query, reused until it is too old."""

from __future__ import annotations

import fnmatch
import hashlib
import logging
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

logger = logging.getLogger(__name__)

DEFAULT_TTL = 300.0


def result_key(path: str, params: Mapping[str, Any], version: str | None = None) -> str:
    """Key of a query: path and parameters, whatever the order of the latter.

    ``version`` (say, size and modification time of the source) makes the key
    follow the content too.
    """
    digest = hashlib.sha256()

    def put(value: Any) -> None:
        """A kind, a length and a body for each value, so that no two queries are spelled alike."""
        if isinstance(value, Mapping):
            entries = sorted(value.items(), key=lambda entry: str(entry[0]))
            digest.update(b"m%d:" % len(entries))
            for name, inner in entries:
                put(str(name))
                put(inner)
        elif isinstance(value, (list, tuple)):
            digest.update(b"l%d:" % len(value))
            for inner in value:
                put(inner)
        else:
            body = repr(value).encode()
            digest.update(f"{type(value).__name__}{len(body)}:".encode() + body)

    put((path, params, version))
    return digest.hexdigest()


@dataclass
class ResultStore:
    """Results kept under ``root`` (the shared folder unless given) for ``ttl`` seconds.

    A write goes to a folder of its own, named by its time, and counts only once
    Spark has marked it complete; readers of an older one are not disturbed.
    Nothing here raises for a broken store: the query is simply run again.
    """

    spark: SparkSession
    root: str | None = None
    ttl: float = DEFAULT_TTL

    def __post_init__(self) -> None:
        self.root = (self.root or f"{shared_folder(self.spark)}/results").rstrip("/")

    def get(self, key: str) -> DataFrame | None:
        """The stored result, or None when there is none, or only an expired one."""
        try:
            fresh = [v for v in self._versions(key) if self._age(v) < self.ttl]
            return self.spark.read.parquet(f"{self._folder(key)}/{max(fresh)}") if fresh else None
        except Exception as failure:
            logger.warning("stored result %s unreadable: %s", key, failure)
            return None

    def set(self, key: str, result: DataFrame) -> bool:
        """Store the result; False if that failed."""
        try:
            stamp = f"{time.time_ns() // 1_000_000:015d}-{uuid.uuid4().hex[:8]}"
            result.write.parquet(f"{self._folder(key)}/{stamp}")
            return True
        except Exception as failure:
            logger.warning("result %s not stored: %s", key, failure)
            return False

    def get_or_compute(self, key: str, compute: Callable[[], DataFrame]) -> DataFrame:
        """The stored result, else the computed one, stored for next time."""
        stored = self.get(key)
        if stored is not None:
            return stored
        result = compute()
        return (self.get(key) if self.set(key, result) else None) or result

    def invalidate(self, key: str) -> bool:
        """Drop one result; True if there was one."""
        return self._delete(self._folder(key))

    def flush(self, pattern: str = "*") -> int:
        """Drop the results whose key matches the pattern; how many there were."""
        try:
            keys = [k for k in self._names(self.root) if fnmatch.fnmatchcase(k, pattern)]
        except Exception as failure:
            logger.warning("results not listed: %s", failure)
            return 0
        return sum(self._delete(self._folder(k)) for k in keys)

    def _folder(self, key: str) -> str:
        return f"{self.root}/{key}"

    def _versions(self, key: str) -> list[str]:
        folder = self._folder(key)
        return [v for v in self._names(folder) if self._exists(f"{folder}/{v}/_SUCCESS")]

    @staticmethod
    def _age(version: str) -> float:
        return time.time() - int(version.split("-")[0]) / 1000

    # Folder listing and removal are the file system's business: Spark has no
    # DataFrame operation for them.
    def _path(self, path: str) -> tuple[Any, Any]:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        target, files = self._path(path)
        return files.exists(target)

    def _names(self, path: str) -> list[str]:
        target, files = self._path(path)
        if not files.exists(target):
            return []
        return [status.getPath().getName() for status in files.listStatus(target)]

    def _delete(self, path: str) -> bool:
        try:
            target, files = self._path(path)
            return files.delete(target, True)
        except Exception as failure:
            logger.warning("%s not deleted: %s", path, failure)
            return False
