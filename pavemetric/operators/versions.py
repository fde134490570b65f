"""Tables kept as parts in folders, and manifests that say which parts make up a version (K5, SRC8, SRC11)."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has committed since the version was read that this one builds on."""


@dataclass
class Version:
    """number: of the manifest to commit next. parts: table to part to its folders; schemas: table to its schema; facts: whatever else."""

    number: int = 0
    parts: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)


class Versions:
    """Reads the last committed version of a folder's tables, and commits the next one.

    Parts are written into folders of their own before they are named by a manifest, and never changed after that. A manifest is
    a file that is created only if there is none of its number, so of two writers that build on the same version one gets a
    Conflict; one that was left unfinished is passed over. A reader keeps the version it has read, whatever is committed
    meanwhile, until vacuum deletes what only older versions name.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str = "_versions"):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        p, fs = self._path()
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(p)) if fs.exists(p) else []

    def _read(self, number: int) -> Version | None:
        p, fs = self._path(f"_versions/{number:010d}.json")
        stream = fs.open(p)
        try:
            return Version(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        except ValueError:  # a writer was stopped within it
            return None
        finally:
            stream.close()

    def latest(self) -> Version:
        """The last version, ready to be changed and committed."""
        numbers = self._numbers()
        found = next((v for n in reversed(numbers) if (v := self._read(n))), Version())
        found.number = numbers[-1] + 1 if numbers else 0
        return found

    def commit(self, version: Version) -> None:
        p, fs = self._path(f"_versions/{version.number:010d}.json")
        if fs.exists(p):
            raise Conflict(f"version {version.number} of {self.folder} is there already")
        try:
            out = fs.create(p, False)
        except Exception as e:
            if fs.exists(p):
                raise Conflict(f"version {version.number} of {self.folder} is there already") from e
            raise
        out.write(bytearray(json.dumps(version.__dict__).encode()))
        out.close()

    def new_folder(self, name: str) -> str:
        return f"{self.folder}/{name}/{uuid.uuid4().hex}"

    def written(self, rows: DataFrame, name: str, part: str) -> dict[str, str]:
        """Writes rows in a new folder, dealt over folders by the column part; which part lies where."""
        folder = self.new_folder(name)
        rows.write.partitionBy(part).parquet(folder)
        p = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p)
        names = [s.getPath().getName() for s in found if s.isDirectory()]
        return {n.split("=", 1)[1]: f"{folder}/{n}" for n in names if n.startswith(f"{part}=")}

    def read(self, version: Version, name: str, parts: set[str] | None = None) -> DataFrame:
        """Rows of the given parts of a table, or of all; only their folders are listed and read."""
        known = version.parts.get(name, {})
        folders = [f for part, fs in sorted(known.items()) if parts is None or part in parts for f in fs]
        kind = StructType.fromJson(json.loads(version.schemas[name]))
        return self.spark.read.schema(kind).parquet(*folders) if folders else self.spark.createDataFrame([], kind)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes all but the last manifests, and the parts' folders that these don't name; which ones. No writer may be at work."""
        numbers = self._numbers()
        kept = [v for n in numbers[-keep:] if (v := self._read(n))]
        if not kept:
            return []
        named = {f.rsplit("/", 1)[0] if "=" in f.rsplit("/", 1)[1] else f for v in kept for parts in v.parts.values() for fs in parts.values() for f in fs}
        gone = []
        for table in {t for v in kept for t in v.parts}:
            p, fs = self._path(table)
            for s in fs.listStatus(p) if fs.exists(p) else []:
                folder = f"{self.folder}/{table}/{s.getPath().getName()}"
                if folder not in named:
                    fs.delete(s.getPath(), True)
                    gone.append(folder)
        for n in numbers[:-keep]:
            p, fs = self._path(f"_versions/{n:010d}.json")
            fs.delete(p, False)
        return gone
