"""A versioned log of tables below a root: commits of several tables at once, made under leases with fencing tokens.

Every entry of the log is a version, and a version has one entry: entries are folders that a rename puts in place, so that of two
writers one succeeds. A claim of a job's lease is an entry like a commit. A commit is written for the version after the last that
its writer has read; if that version was a claim of its job, its token is no longer the job's and it is refused. So a writer that
stalls beyond its lease can't commit, however late it wakes. Data folders are written before the entry that names
them: of a writer that dies in between nothing is seen, of none of its tables.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = "version long, kind string, job string, token long, until double, tables array<struct<name:string,folder:string,replace:boolean>>"
_FILE = "entry-"


class Refused(Exception):
    """The lease is held by another writer, or is no longer this one's."""


class Ledger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        fs, path = self._fs()
        top = path(f"{self.root}/log")
        return max((int(x.getPath().getName()) for x in fs.listStatus(top)), default=0) if fs.exists(top) else 0

    def entries(self, version: int | None = None) -> DataFrame:
        """The log up to a version."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _ENTRY)
        # A folder that was moved into another writer's version holds an entry one level below: it is none.
        return self.spark.read.schema(_ENTRY).json(f"{self.root}/log/*/{_FILE}*").where(F.col("version") <= version)

    def _lease(self, job: str, version: int):
        last = self.entries(version).where((F.col("job") == job) & F.col("kind").isin("claim", "release")).agg(F.max_by(F.struct("token", "until"), "version").alias("x")).first()[0]
        return (last.token, last.until) if last else (0, 0.0)

    def _put(self, entry: dict, version: int) -> bool:
        """Whether this entry is that version's."""
        fs, path = self._fs()
        name, place = uuid.uuid4().hex, f"{self.root}/log/{version}"
        out = fs.create(path(f"{self.root}/pending/{name}/{_FILE}{name}"), False)
        out.write(bytearray(json.dumps(entry | {"version": version}).encode()))
        out.close()
        fs.mkdirs(path(f"{self.root}/log"))
        moved = not fs.exists(path(place)) and fs.rename(path(f"{self.root}/pending/{name}"), path(place))
        if fs.exists(path(f"{place}/{_FILE}{name}")):
            return True
        fs.delete(path(f"{place}/{name}" if moved else f"{self.root}/pending/{name}"), True)
        return False

    def claim(self, job: str, seconds: float, now: float | None = None) -> int:
        """The token of a new lease of a job. Refused while another one holds."""
        while True:
            version = self.version()
            token, until = self._lease(job, version)
            at = time.time() if now is None else now
            if until > at:
                raise Refused(f"{job} is leased until {until}")
            if self._put({"kind": "claim", "job": job, "token": token + 1, "until": at + seconds}, version + 1):
                return token + 1

    def release(self, job: str, token: int) -> None:
        """Ends a lease early; the next claim need not wait."""
        self._under_lease(job, token, {"kind": "release", "until": 0.0})

    def _under_lease(self, job: str, token: int, entry: dict) -> int:
        while True:
            version = self.version()
            if self._lease(job, version)[0] != token:
                raise Refused(f"token {token} of {job} is no longer the current one")
            if self._put(entry | {"job": job, "token": token}, version + 1):
                return version + 1

    def commit(self, job: str, token: int, appended: dict[str, DataFrame] | None = None, replaced: dict[str, DataFrame] | None = None) -> int:
        """The version in which all these tables' rows are seen at once. Replaced tables lose their earlier rows."""
        tables = []
        for replace, frames in ((False, appended or {}), (True, replaced or {})):
            for name, rows in frames.items():
                folder = f"{self.root}/data/{name}/{uuid.uuid4().hex}"
                rows.write.parquet(folder)
                tables.append({"name": name, "folder": folder, "replace": replace})
        return self._under_lease(job, token, {"kind": "commit", "tables": tables})

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table as of a version; None before its first commit."""
        own = self.entries(version).select("version", F.explode("tables").alias("t")).where(F.col("t.name") == name).select("version", "t.*")
        since = own.agg(F.max(F.when(F.col("replace"), F.col("version")))).first()[0] or 0
        folders = [r.folder for r in own.where(F.col("version") >= since).orderBy("version").select("folder").toLocalIterator()]
        return self.spark.read.parquet(*folders) if folders else None
