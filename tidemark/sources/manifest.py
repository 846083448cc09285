"""The store's manifest: which batches are live, what is deleted, how writes are numbered.

One JSON file for each version, never rewritten: a commit writes version n+1 with create-if-absent. Of two writers from the
same version one fails; it reads the newest version, makes its change of that, and tries again (``change``), so that neither
loses what the other wrote. Writes are numbered when they are committed: files of one write hold no number, the manifest
has it. Readers keep the version they have read; its files stay until ``vacuum``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Batch:
    """Points written at once: their folder under the root, the level, numbers of rows and bytes, files.

    ``seq`` is the write's number; a merged batch has None, as its rows have numbers of their own. ``records`` is a table of
    its records (see ``Store.records``) in the same terms.
    """

    path: str
    level: int
    rows: int
    bytes: int
    files: int
    seq: int | None = None
    records: str | None = None


@dataclass(frozen=True)
class Listed:
    """A folder of the catalogue; ``seq`` is the number of the write that brought it, None where its rows have their own."""

    path: str
    seq: int | None = None


@dataclass(frozen=True)
class Tombstone:
    """What is deleted of writes up to ``seq``: a measurement, one field of it, or one record (series within a write)."""

    measurement: str
    seq: int
    field: str | None = None
    series_id: str | None = None
    only: bool = False  # writes equal to seq rather than up to it


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    seq: int = 0
    batches: tuple[Batch, ...] = ()
    catalog: tuple[Listed, ...] = ()
    tombstones: tuple[Tombstone, ...] = field(default=())
    #: The last micro-batch of each stream that was written.
    streams: dict[str, int] = field(default_factory=dict)

    def next(self, **changes) -> Manifest:
        return replace(self, version=self.version + 1, **changes)


class Files:
    """The few file operations that a manifest needs, on whatever file system the root is on."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [x.getPath().getName() for x in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def usage(self, folder: str, suffix: str = "") -> tuple[int, int]:
        """(number, bytes) of the files below a folder."""
        path, n, total = self._path(folder), 0, 0
        if self.fs.exists(path):
            found = self.fs.listFiles(path, True)
            while found.hasNext():
                status = found.next()
                if status.getPath().getName().endswith(suffix):
                    n, total = n + 1, total + status.getLen()
        return n, total

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Write a new file, which appears whole; fails where it exists.

        The text is written aside, then the name is taken by create-if-absent of a lock that stays beside the version.
        """
        aside = self._path(f"{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(aside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            self.fs.create(self._path(f"{name}.taken"), False).close()
            self.fs.rename(aside, self._path(name))
        finally:
            self.fs.delete(aside, False)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def latest(self) -> Manifest:
        numbers = sorted(int(n[1:-5]) for n in self.names("_manifest") if n.startswith("v") and n.endswith(".json"))
        if not numbers:
            return Manifest()
        x = json.loads(self.read(f"_manifest/v{numbers[-1]}.json"))
        parts = {"batches": tuple(Batch(**b) for b in x["batches"]), "tombstones": tuple(Tombstone(**t) for t in x["tombstones"]), "catalog": tuple(Listed(**c) for c in x["catalog"])}
        return Manifest(version=x["version"], seq=x["seq"], streams=x["streams"], **parts)

    def change(self, changed: Callable[[Manifest], Manifest | None]) -> Manifest | None:
        """Commit what ``changed`` makes of the newest version, again and again until no other writer is faster; None cancels."""
        while True:
            manifest = changed(self.latest())
            if manifest is None:
                return None
            name = f"_manifest/v{manifest.version}.json"
            try:
                self.create(name, json.dumps(asdict(manifest)))
                return manifest
            except Py4JJavaError:
                if not self.fs.exists(self._path(f"{name}.taken")):
                    raise
                for _ in range(200):  # the other writer has the name and is about to rename
                    if self.fs.exists(self._path(name)):
                        break
                    time.sleep(0.05)
                else:
                    raise
