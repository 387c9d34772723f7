"""The stored collection: loads that are never rewritten, and a manifest that says which count.

A load goes to a folder of its own below ``loads``; the manifest, a small JSON file with a new
number, is written last and by a rename. Readers take the manifest with the highest number. A
write that breaks before that changes nothing: its folder is in no manifest, and ``vacuum``
deletes it. Older manifests keep older versions of the collection readable until then.

The first load is the base, later ones are deltas. A load holds only points that are new or of
a higher version than the stored one, so of two rows of one id the later load's counts, and a
load that is repeated adds nothing. Reading joins the base against the ids of the deltas; a
filter on the result reaches the scan of the base. Deltas are merged with each other beyond
MOST_DELTAS, and with the base when their bytes pass MERGE_AT of its own.

Files are laid out by range of the columns of ``cluster``, in as many tasks as the bytes and
the rows ask for, with Parquet Bloom filters on the columns of ``bloom`` and bounds on all: a filter on
any of them skips row groups that cannot match. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes and rows of a task's share; deltas kept apart; share of the base at which they are merged into it.
TASK_BYTES, TASK_ROWS, MOST_DELTAS, MERGE_AT = 128 << 20, 500_000, 8, 0.5
CLUSTER = ("court_level", "date_judgment", "point_uuid")
BLOOM = ("point_uuid", "case_number", "parent_case_id")


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _bytes(spark: SparkSession, path: str) -> int:
    files, target = _files(spark, path)
    return files.getContentSummary(target).getLength() if files.exists(target) else 0


def latest(points: DataFrame, version: str, key: str = "point_uuid") -> DataFrame:
    """Last version of each point; of equal versions the one whose columns hash lowest, so that reruns agree."""
    tie = F.xxhash64(*[f.name for f in points.schema.fields if f.dataType.typeName() not in ("map", "variant")])
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version), tie))
    return points.withColumn("__rank", rank).filter(F.col("__rank") == 1).drop("__rank")


def tasks_for(rows: int, size: int = 0) -> int:
    """Tasks for so many rows of so many bytes; short rows are small in a file and large in memory."""
    return max(1, -(-size // TASK_BYTES), -(-rows // TASK_ROWS))


class Collection:
    """A collection of points at ``path``, keyed by ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str = "point_uuid", cluster: Sequence[str] = CLUSTER, bloom: Sequence[str] = BLOOM):
        self.spark, self.path, self.key, self.cluster, self.bloom = spark, path.rstrip("/"), key, cluster, bloom

    # ── manifest ──
    def numbers(self) -> list[int]:
        files, folder = _files(self.spark, f"{self.path}/manifest")
        names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, number: int | None = None) -> dict | None:
        """{"schema", "base", "deltas"} of a number, of the last one by default."""
        numbers = self.numbers()
        if not numbers:
            return None
        files, target = _files(self.spark, f"{self.path}/manifest/{numbers[-1] if number is None else number}.json")
        stream = files.open(target)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _switch(self, schema: StructType, base: str | None, deltas: list[str]) -> None:
        """Makes these loads the collection."""
        number = (self.numbers() or [-1])[-1] + 1
        files, draft = _files(self.spark, f"{self.path}/manifest/{number}.{uuid.uuid4().hex}.draft")
        stream = files.create(draft)
        stream.write(bytearray(json.dumps({"schema": schema.jsonValue(), "base": base, "deltas": deltas}).encode()))
        stream.close()
        final = _files(self.spark, f"{self.path}/manifest/{number}.json")[1]
        if files.exists(final) or not files.rename(draft, final):
            raise RuntimeError(f"another writer made manifest {number}")

    # ── reading ──
    def exists(self) -> bool:
        return bool(self.numbers())

    def _load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/loads/{name}")

    def _rows(self, names: Sequence[str | None]) -> int:
        """Rows of loads, from the files' footers."""
        return sum(self._load(name).count() for name in names if name)

    def _deltas(self, names: list[str]) -> DataFrame:
        """The deltas' rows, each id from the last one that has it."""
        rows = None
        for number, name in enumerate(names):
            one = self._load(name).withColumn("__load", F.lit(number))
            rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
        if len(names) > 1:
            rank = F.row_number().over(Window.partitionBy(self.key).orderBy(F.desc("__load")))
            tasks = tasks_for(self._rows(names))
            rows = rows.repartition(tasks, self.key) if tasks > 1 else rows
            rows = rows.withColumn("__rank", rank).filter(F.col("__rank") == 1).drop("__rank")
        return rows.drop("__load")

    def read(self, number: int | None = None) -> DataFrame:
        """All points, once each; an older manifest's number gives an older version."""
        made = self.manifest(number)
        if made is None:
            raise FileNotFoundError(f"no collection at {self.path}")
        schema = StructType.fromJson(made["schema"])
        if made["base"] is None:
            return self.spark.createDataFrame([], schema)
        rows = self._load(made["base"])
        if made["deltas"]:
            ids = self._load(made["deltas"][0]).select(self.key)
            for name in made["deltas"][1:]:
                ids = ids.unionByName(self._load(name).select(self.key))
            if tasks_for(self._rows(made["deltas"])) > 1:
                tasks = tasks_for(self._rows([made["base"], *made["deltas"]]))
                rows, ids = rows.repartition(tasks, self.key), ids.repartition(tasks, self.key)
            rows = rows.join(ids, self.key, "left_anti").unionByName(self._deltas(made["deltas"]), allowMissingColumns=True)
        return rows.select(*[f.name for f in schema])

    # ── writing ──
    def _write(self, rows: DataFrame, tasks: int) -> str:
        """A new load, laid out in so many tasks."""
        name, cluster = uuid.uuid4().hex, [c for c in self.cluster if c in rows.columns] or [self.key]
        laid = rows.repartitionByRange(tasks, *cluster).sortWithinPartitions(*cluster).write.option("parquet.block.size", str(16 << 20))
        for c in self.bloom:
            if c in rows.columns:
                laid = laid.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{c}", "true")
        laid.parquet(f"{self.path}/loads/{name}")
        return name

    def create(self, schema: StructType) -> bool:
        """An empty collection; False when it is there already."""
        if self.exists():
            return False
        self._switch(schema, None, [])
        return True

    def upsert(self, new: DataFrame, version: str) -> int:
        """Adds points by id, the highest ``version`` wins, the stored one if equal; returns the rows added.

        New points are stored first, so that they are computed once, however costly they are.
        Rows without an id, and loads without rows, are left out.
        """
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
        new.filter(F.col(self.key).isNotNull()).write.parquet(draft)
        rows = self.spark.read.schema(new.schema).parquet(draft)
        tasks = tasks_for(rows.count(), _bytes(self.spark, draft))
        rows = latest(rows.repartition(tasks, self.key), version, self.key)
        made = self.manifest()
        if made and made["base"]:
            held = self.read().select(F.col(self.key).alias("__key"), F.col(version).alias("__version"))
            if tasks > 1:
                held = held.repartition(tasks, "__key")
            met = rows.join(held, rows[self.key] == held["__key"], "left")
            rows = met.filter(F.col("__key").isNull() | (F.col(version) > F.col("__version"))).drop("__key", "__version")
        name = self._write(rows, tasks)
        added = self._load(name).count()
        if added:
            schema = self._schema(made, new.schema)
            if not made or not made["base"]:
                self._switch(schema, name, [])
            else:
                self._switch(schema, made["base"], [*made["deltas"], name])
                self.compact()
        self._delete(draft)
        return added

    @staticmethod
    def _schema(made: dict | None, new: StructType) -> StructType:
        """The stored columns and the new ones behind them."""
        held = StructType.fromJson(made["schema"]) if made else StructType([])
        return StructType([*held, *[f for f in new if f.name not in held.names]])

    def compact(self, whole: bool = False) -> bool:
        """Merges deltas into one, or into the base when they have grown; ``whole`` merges all now."""
        made = self.manifest()
        if not made or not made["deltas"]:
            return False
        base, deltas = (sum(_bytes(self.spark, f"{self.path}/loads/{n}") for n in names) for names in ([made["base"]], made["deltas"]))
        schema = StructType.fromJson(made["schema"])
        if whole or deltas > MERGE_AT * base:
            self._switch(schema, self._write(self.read(), tasks_for(self._rows([made["base"], *made["deltas"]]), base + deltas)), [])
        elif len(made["deltas"]) > MOST_DELTAS:
            self._switch(schema, made["base"], [self._write(self._deltas(made["deltas"]), tasks_for(self._rows(made["deltas"]), deltas))])
        else:
            return False
        return True

    def _delete(self, path: str) -> bool:
        files, target = _files(self.spark, path)
        return files.delete(target, True)

    def vacuum(self) -> int:
        """Deletes loads and drafts that the last manifest does not name, and older manifests; returns the loads deleted."""
        made, gone = self.manifest(), 0
        if made is None:
            return 0
        files, folder = _files(self.spark, f"{self.path}/loads")
        for found in files.listStatus(folder) if files.exists(folder) else []:
            if found.getPath().getName() not in (made["base"], *made["deltas"]):
                gone += files.delete(found.getPath(), True)
        self._delete(f"{self.path}/drafts")
        for number in self.numbers()[:-1]:
            self._delete(f"{self.path}/manifest/{number}.json")
        return gone

    def delete(self) -> bool:
        return self._delete(self.path)

    def info(self) -> dict:
        made = self.manifest()
        if made is None:
            return {"exists": False}
        stored = self.read()
        counted = stored.agg(F.count("*"), F.count("dense") if "dense" in stored.columns else F.lit(0)).first()
        return {"exists": True, "points_count": counted[0], "indexed_vectors_count": counted[1], "status": "green"}
