"""Tables on a shared folder: bucketed Parquet parts behind numbered manifests, markers, archives and a lock.

Rows lie in buckets by the hash of their path (edges: source; commits: hash). A change writes new parts for the
buckets that it touches and then one manifest with the next number, which names all parts of the table. Readers take
the manifest with the greatest number, so they and repeated jobs see one state or the other, and there is no moment
without a table: nothing is moved over anything. The state before the newest stays for plans that read it. Writers
take the lock; parts of a writer that died are in no manifest and go when the table is compacted. Paths go through
Hadoop's file system, so any store that Spark knows works.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import incremental
from tessera.schemas import TABLES, read_table, schema_of

#: Buckets of a new table.
BUCKETS = 16

#: Tables by clearing mode, and the marker that goes with each.
MODES = {
    "code": (["code_blocks"], "files"), "text": (["text_blocks"], "files"), "docs": (["document_blocks"], "files"), "commits": (["commit_blocks"], "commits"),
    "graph": (["graph_nodes", "graph_edges"], "graph"), "all": ([t for t in TABLES if t != "markers"], None),
}


class Store:
    def __init__(self, spark: SparkSession, root: str, branch: str | None = None, buckets: int = BUCKETS):
        self.spark, self.base, self.buckets = spark, root.rstrip("/"), buckets
        self.root = f"{self.base}/branches/{branch.replace('/', '--')}/storage" if branch else f"{self.base}/storage"
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # files
    def _exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def _write(self, p: str, text: str) -> None:
        temp = f"{p}.{uuid.uuid4().hex}"
        out = self.fs.create(self.path(temp), True)
        out.write(bytearray(text.encode()))
        out.close()
        # readers see the old file or the new one, never none
        rename = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        conf = self.spark._jsc.hadoopConfiguration()
        self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf).rename(self.path(temp), self.path(p), how)

    def _move(self, a: str, b: str) -> None:
        if self._exists(b):
            self.fs.delete(self.path(b), True)
        self.fs.mkdirs(self.path(b).getParent())
        if not self.fs.rename(self.path(a), self.path(b)):
            raise OSError(f"can't move {a} to {b}")

    def _read(self, p: str) -> str | None:
        if not self._exists(p):
            return None
        source = self.fs.open(self.path(p))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()

    # tables
    def _versions(self, name: str) -> list[int]:
        at = self.path(f"{self.root}/{name}/manifests")
        names = [f.getPath().getName() for f in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _at(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/manifests/{version:012d}.json"

    def manifest(self, name: str) -> dict | None:
        """The newest state: its number, schema, number of buckets and parts as {bucket: [folders]}."""
        known = self._versions(name)
        return json.loads(self._read(self._at(name, known[-1])) or "null") if known else None

    def _commit(self, name: str, before: dict | None, parts: dict[str, list[str]]) -> None:
        """Make parts the next state of the table that was at before; another writer's state in between raises."""
        version = before["version"] + 1 if before else 1
        known = self._versions(name)
        if (known[-1] if known else 0) >= version:
            raise RuntimeError(f"{name}: another writer was first")
        now = {"version": version, "schema": TABLES[name], "buckets": before["buckets"] if before else self.buckets, "parts": {k: v for k, v in parts.items() if v}}
        self._write(self._at(name, version), json.dumps(now))
        kept = {p for m in (before, now) if m for ps in m["parts"].values() for p in ps}
        for old in known[:-1]:
            gone = json.loads(self._read(self._at(name, old)) or '{"parts": {}}')
            for p in {p for ps in gone["parts"].values() for p in ps} - kept:
                self.fs.delete(self.path(f"{self.root}/{name}/{p}"), True)
            self.fs.delete(self.path(self._at(name, old)), False)

    def _key(self, name: str) -> str:
        names = schema_of(name).names
        return next((c for c in ("path", "source", "hash") if c in names), names[0])

    def _bucket(self, key: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets))

    def _written(self, name: str, df: DataFrame, buckets: int) -> dict[str, list[str]]:
        """Rows as a new part: its folder of each bucket. Large buckets are split over tasks, small ones share one."""
        at = f"part-{uuid.uuid4().hex}"
        rows = df.select(*[F.col(f.name).cast(f.dataType) for f in schema_of(name)]).withColumn("_bucket", self._bucket(self._key(name), buckets))
        rows.hint("rebalance", F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{self.root}/{name}/{at}")
        names = [f.getPath().getName() for f in self.fs.listStatus(self.path(f"{self.root}/{name}/{at}"))]
        return {n.split("=")[1]: [f"{at}/{n}"] for n in names if n.startswith("_bucket=")}

    def _rows(self, name: str, parts: dict[str, list[str]]) -> DataFrame:
        paths = [f"{self.root}/{name}/{p}" for ps in parts.values() for p in ps]
        return read_table(self.spark, paths, name) if paths else self.spark.createDataFrame([], schema_of(name))

    def read(self, name: str) -> DataFrame:
        return self._rows(name, (self.manifest(name) or {"parts": {}})["parts"])

    def replace(self, name: str, df: DataFrame) -> None:
        m = self.manifest(name)
        self._commit(name, m, self._written(name, df, m["buckets"] if m else self.buckets))

    def append(self, name: str, df: DataFrame) -> None:
        """A state with one more part; what is there isn't written again."""
        self._revise(name, {}, None, df)

    def _revise(self, name: str, touched: dict[str, list[str]], kept: DataFrame | None, add: DataFrame | None) -> None:
        """One new state: the touched buckets hold kept, add comes to it, the other buckets stay as they are."""
        m = self.manifest(name)
        if m is None or m["schema"] != TABLES[name]:  # a part of another schema would lie beside the older ones
            rest = self._rows(name, {k: v for k, v in m["parts"].items() if k not in touched}) if m else None
            add = rest if add is None else add if rest is None else rest.unionByName(add.select(*rest.columns))
            touched = m["parts"] if m else {}
        both = kept if add is None else add if kept is None else kept.unionByName(add.select(*kept.columns))
        parts = {k: list(v) for k, v in m["parts"].items() if k not in touched} if m else {}
        for k, v in (self._written(name, both, m["buckets"] if m else self.buckets) if both is not None else {}).items():
            parts.setdefault(k, []).extend(v)
        self._commit(name, m, parts)

    def _touched(self, name: str, keys: DataFrame, on: list[str]) -> dict[str, list[str]]:
        """The buckets that rows with these keys lie in: from the keys if they say so, else by a scan of their columns."""
        m = self.manifest(name)
        if m is None:
            return {}
        key = self._key(name)
        rows = keys if key in on else self.read(name).select(key, *on).join(keys.select(*on), on, "left_semi")
        found = {str(r[0]) for r in rows.select(self._bucket(key, m["buckets"])).distinct().collect()}  # at most one row a bucket
        return {k: v for k, v in m["parts"].items() if k in found}

    def count(self, name: str) -> int:
        return self.read(name).count()

    def delete(self, name: str, keys: DataFrame, on: str | list[str], add: DataFrame | None = None) -> None:
        """Rows with these keys go and the rows of add come, in one new state."""
        on = [on] if isinstance(on, str) else on
        touched = self._touched(name, keys, on)
        if touched or add is not None:
            old = self._rows(name, touched)
            self._revise(name, touched, old.join(keys.select(*on), on, "left_anti").select(*old.columns) if touched else None, add)

    def cascade(self, paths: DataFrame) -> None:
        for name in ("code_blocks", "text_blocks", "document_blocks", "graph_nodes", "graph_edges", "file_metadata"):
            touched: dict[str, list[str]] = {}
            for c in ("source", "target") if name == "graph_edges" else ("path",):
                touched |= self._touched(name, paths.select(F.col("path").alias(c)), [c])
            if touched:
                self._revise(name, touched, incremental.cascade_delete({name: self._rows(name, touched)}, paths)[name], None)

    def upsert_metadata(self, rows: DataFrame) -> None:
        touched = self._touched("file_metadata", rows, ["path"])
        self._revise("file_metadata", touched, None, incremental.upsert(self._rows("file_metadata", touched), rows, ["path"], "indexed_at"))

    def compact(self, name: str) -> None:
        """One part a bucket; folders that no state names go. Take the lock: a running writer's part isn't named yet."""
        if self.manifest(name) is None:
            return
        self.replace(name, self.read(name))
        states = [json.loads(self._read(self._at(name, v)) or "{}") for v in self._versions(name)]
        named = {p.split("/")[0] for m in states for ps in m["parts"].values() for p in ps}
        for f in self.fs.listStatus(self.path(f"{self.root}/{name}")):
            if f.getPath().getName().startswith("part-") and f.getPath().getName() not in named:
                self.fs.delete(f.getPath(), True)

    def drop(self, mode: str = "all") -> None:
        tables, marker = MODES[mode]
        for t in tables:
            self.fs.delete(self.path(f"{self.root}/{t}"), True)
        for m in [marker] if marker else ["files", "commits", "graph"]:
            self.fs.delete(self.path(f"{self.root}/markers/{m}.json"), True)

    def flush(self) -> None:
        """Writes are whole when they return; kept for callers that flush."""

    # markers
    def marker(self, name: str) -> str | None:
        text = self._read(f"{self.root}/markers/{name}.json")
        return json.loads(text)["commit_hash"] if text else None

    def set_marker(self, name: str, commit: str, at: int) -> bool:
        """False where it is set already."""
        if self.marker(name) == commit:
            return False
        self._write(f"{self.root}/markers/{name}.json", json.dumps({"commit_hash": commit, "indexed_at": at}))
        return True

    def stats(self) -> dict[str, int]:
        return {n: self.count(n) for n in TABLES if n != "markers"}

    # archives
    def export(self, target: str) -> None:
        """storage and branches with a marker file; the copy appears whole."""
        temp = f"{target}.{uuid.uuid4().hex}"
        for part in ("storage", "branches"):
            if self._exists(f"{self.base}/{part}"):
                self._copy(f"{self.base}/{part}", f"{temp}/{part}")
        self._write(f"{temp}/EXPORT.json", json.dumps({"format": 1}))
        self._move(temp, target)

    def load(self, source: str) -> None:
        """Check the marker, copy beside the current index, swap; the old one comes back if the swap fails."""
        text = self._read(f"{source}/EXPORT.json")
        if not text or json.loads(text).get("format") != 1:
            raise ValueError(f"{source} isn't an export")
        temp, backup = f"{self.base}.{uuid.uuid4().hex}", f"{self.base}.{uuid.uuid4().hex}"
        self._copy(source, temp)
        had = self._exists(self.base)
        if had:
            self._move(self.base, backup)
        try:
            self._move(temp, self.base)
        except Exception:
            if had:
                self._move(backup, self.base)
            raise
        self.fs.delete(self.path(f"{self.base}/EXPORT.json"), True)
        if had:
            self.fs.delete(self.path(backup), True)

    def _copy(self, a: str, b: str) -> None:
        util = self.spark._jvm.org.apache.hadoop.fs.FileUtil
        conf = self.spark._jsc.hadoopConfiguration()
        util.copy(self.fs, self.path(a), self.fs, self.path(b), False, conf)


class Lock:
    """A driver-side lock file with the holder's PID; a dead holder's lock goes."""

    def __init__(self, path: str, wait: float = 60, poll: float = 0.5):
        self.path, self.wait, self.poll = path, wait, poll

    def __enter__(self) -> Lock:
        end = time.monotonic() + self.wait
        while True:
            try:
                fd = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
                os.write(fd, str(os.getpid()).encode())
                os.close(fd)
                return self
            except FileExistsError:
                try:
                    with open(self.path) as f:
                        pid = int(f.read() or 0)
                    if pid:
                        os.kill(pid, 0)
                except (ProcessLookupError, ValueError):
                    os.unlink(self.path)
                    continue
                except OSError:
                    pass
                if time.monotonic() > end:
                    raise TimeoutError(f"{self.path} is held by another process") from None
                time.sleep(self.poll)

    def __exit__(self, *_: object) -> None:
        os.unlink(self.path)


def branch_manifest(name: str, base: str, fork_point: str, head: str, changed: list[str], deleted: list[str], base_db_commit: str, at: int) -> dict:
    return {"version": 1, "branch_name": name, "base_branch": base, "base_commit": fork_point, "branch_commit": head, "changed_paths": sorted(changed), "deleted_paths": sorted(deleted), "indexed_at": at, "fork_point": fork_point, "base_db_commit": base_db_commit}
