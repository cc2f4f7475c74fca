"""Keyed tables that batches are merged into, and commits over several of them.

A table's rows lie in folders by a hash bucket of the key. A batch reads and writes only the buckets
that its keys fall into; a commit is one small file, versions/<n>.json, that names each table's buckets
and the folders that hold them. It is created only if nobody else has made version n, so

* readers see a version or the next one, never half of a commit, however many tables it changes;
* of two writers that claim the same version one wins. The other looks whether the winner touched buckets that
  it has read: if not, its own commit goes on top as it is; else it merges again, over what is there now;
* a batch that was committed under a name before (a stream's batch that is run again) changes nothing.

Files are never changed in place, so a lost executor or a failed writer leaves nothing but
folders that no version names; `clean` removes these. The number of buckets is fixed when a table is first
written: choose it so that a bucket is a file of some 100 MB. What the driver holds is the list of buckets, not of keys.
Rows with a null in the key lie in the bucket of the hash that nulls have."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.folders import Files


class Conflict(Exception):
    """Another writer changed what this one has read, more often than it may try."""


@dataclass(frozen=True)
class Table:
    name: str
    keys: tuple[str, ...]
    buckets: int = 64

    def bucket(self) -> Column:
        # As texts, so that a key's number type doesn't matter.
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")


#: How a table's rows in the touched buckets (None if there are none) and a batch become the new rows of these buckets.
Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


class Snapshot:
    """One version of a store, and what a writer has read and written on top of it."""

    def __init__(self, store: Store, version: int, state: dict) -> None:
        self.store, self.version, self.state = store, version, state
        self.commit = uuid.uuid4().hex
        self.touched: dict[str, set[str]] = {}
        self.described: dict[str, dict] = {}
        self.written: dict[str, dict[str, str]] = {}

    def read(self, table: str, buckets: set[str] | None = None) -> DataFrame | None:
        """The rows of a table, or of some buckets; None if there are none yet."""
        there = self.state["tables"].get(table, {}).get("folders", {})
        folders = sorted(f for b, f in there.items() if buckets is None or b in buckets)
        return self.store.rows(folders, StructType.fromJson(json.loads(self.state["tables"][table]["schema"]))) if folders else None

    def merge(self, table: Table, batch: DataFrame, merge: Merge) -> DataFrame:
        """Merges a batch into the buckets that it falls into, and returns the new rows of these buckets. They are seen by others once
        the snapshot is committed."""
        known = self.state["tables"].get(table.name)
        if known and (known["keys"], known["buckets"]) != (list(table.keys), table.buckets):
            raise ValueError(f"{table.name} is stored by {known['buckets']} buckets of {known['keys']}")
        # As many rows as buckets at most.
        buckets = {str(r[0]) for r in batch.select(table.bucket()).distinct().collect()}
        self.touched.setdefault(table.name, set()).update(buckets)
        new = merge(self.read(table.name, buckets), batch)
        folder = f"data/{table.name}/{self.commit}"
        if buckets:
            # One task a bucket, unless a bucket is larger than a task should be: then its rows are split.
            new.withColumn("bucket_", table.bucket()).hint("rebalance", "bucket_").write.partitionBy("bucket_").mode("overwrite").parquet(f"{self.store.path}/{folder}")
        there = set(self.store.files.names(f"{self.store.path}/{folder}"))
        self.written[table.name] = {b: f"{folder}/bucket_={b}" if f"bucket_={b}" in there else "" for b in buckets}
        self.described[table.name] = {"keys": list(table.keys), "buckets": table.buckets, "schema": new.schema.json()}
        return self.store.rows([f for f in self.written[table.name].values() if f], new.schema)

    def next_state(self, state: dict, batch: tuple[str, int] | None) -> dict:
        tables = {name: dict(t, folders=dict(t["folders"])) for name, t in state["tables"].items()}
        for name, folders in self.written.items():
            table = tables.setdefault(name, {"folders": {}}) | self.described[name]
            table["folders"] = {b: f for b, f in (table["folders"] | folders).items() if f}
            tables[name] = table
        return {"tables": tables, "batches": state["batches"] | ({batch[0]: batch[1]} if batch else {})}


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    def rows(self, folders: list[str], schema: StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names(f"{self.path}/versions") if n.endswith(".json") and not n.startswith("."))

    def _state(self, version: int) -> dict:
        return json.loads(self.files.read(f"{self.path}/versions/{version:020d}.json")) if version else {"tables": {}, "batches": {}}

    def snapshot(self, version: int | None = None) -> Snapshot:
        at = max(self.versions(), default=0) if version is None else version
        return Snapshot(self, at, self._state(at))

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        return self.snapshot(version).read(table)

    def _committed(self, own: Snapshot, batch: tuple[str, int] | None) -> bool:
        """Puts a snapshot's writes on top of the newest version, unless what it has read was changed since."""
        version, state = own.version, own.state
        while not self.files.create(f"{self.path}/versions/{version + 1:020d}.json", json.dumps(own.next_state(state, batch))):
            version += 1
            newer = self._state(version)
            folders = lambda s, t: s["tables"].get(t, {}).get("folders", {})
            if any(folders(newer, t).get(b) != folders(state, t).get(b) for t, buckets in own.touched.items() for b in buckets):
                return False
            if batch and newer["batches"].get(batch[0], -1) >= batch[1]:
                return False
            state = newer
        return True

    def update(self, change: Callable[[Snapshot], object], batch: tuple[str, int] | None = None, tries: int = 10) -> object:
        """Runs `change`, which merges batches into tables of a snapshot, and commits all it has written at once; returns
        what it returned. If another writer came first, it is run again over the new version. `batch`: a writer's name and the number
        of its batch; None is returned if that or a later one was committed before."""
        for _ in range(tries):
            own = self.snapshot()
            if batch and own.state["batches"].get(batch[0], -1) >= batch[1]:
                return None
            out = change(own)
            if self._committed(own, batch):
                return out
            for table in own.written:
                self.files.delete(f"{self.path}/data/{table}/{own.commit}")
        raise Conflict(f"{tries} tries")

    def merge(self, table: Table, rows: DataFrame, merge: Merge, batch: tuple[str, int] | None = None) -> None:
        self.update(lambda own: own.merge(table, rows, merge), batch)

    def clean(self, keep: int = 2) -> list[str]:
        """Removes versions but the last `keep`, and folders that these don't name. For use while nobody writes."""
        versions = self.versions()
        named = {f for v in versions[-keep:] for t in self._state(v)["tables"].values() for f in t["folders"].values()}
        gone = [f"versions/{v:020d}.json" for v in versions[:-keep]]
        for table in self.files.names(f"{self.path}/data"):
            for commit in self.files.names(f"{self.path}/data/{table}"):
                for bucket in self.files.names(f"{self.path}/data/{table}/{commit}"):
                    if bucket.startswith("bucket_=") and (folder := f"data/{table}/{commit}/{bucket}") not in named:
                        gone.append(folder)
        for path in gone:
            self.files.delete(f"{self.path}/{path}")
        return gone
