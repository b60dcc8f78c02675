"""Exactly one copy of each message that was delivered at least once.

The messages kept so far form a table partitioned by the day of delivery, so a message's copies lie in
different partitions. An index (hash of stream_name and message_id) -> partition tells which partitions an incoming batch
affects: only those are read, put together with the batch, reduced to one winner for each message, and replaced.

The index is cut into buckets by hash, and a batch reads the buckets of its own keys. A merge adds to a bucket one run with an entry for each
message that the batch brought in, so the index grows with the messages and not with the partitions that are rewritten; a bucket of
more than ``MOST_RUNS`` runs is written anew as one. An entry whose message has since moved to another partition, or whose hash is another
message's, costs reading a partition too many, no more.

A version is a numbered manifest that names the folders of all partitions and index runs. A merge writes its folders first and its manifest last,
by a rename that fails if the number is taken, so a reader sees either all of a batch or none of it, a batch that dies half-way
leaves the version before in force, and of two writers one commits while the other begins again from the new version. ``vacuum`` removes what
no recent version names.

A winner is found by partial aggregation (min_by), so a message with very many copies costs a task one row.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["stream_name", "message_id"]
PARTITION = "__tessera_part"
NEW = "__tessera_new"
#: Runs of an index bucket before it is written anew; attempts of a merge that other writers overtake.
MOST_RUNS, ATTEMPTS = 8, 5
_ENTRY = f"key bigint, {PARTITION} string"


class Overtaken(RuntimeError):
    """Another writer has committed the version that this one was to become."""


def day_of_delivery() -> Column:
    return F.coalesce(F.date_format("delivered_at", "yyyyMMdd"), F.lit("none"))


@dataclass
class MessageStore:
    """The messages kept, in ``path``, a folder that all executors share.

    ``partition`` names a row's partition; ``order`` gives the winner, the row with the least value. ``buckets`` is the number of the index's
    buckets, fixed by the store's first version. Rows without message_id or stream_name are never copies of another and all stay.
    """

    spark: SparkSession
    path: str
    partition: Column = field(default_factory=day_of_delivery)
    order: str = "delivery_id"
    buckets: int = 32

    # -- versions ---------------------------------------------------------------------------------

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _names(self) -> list[str]:
        fs, where = self._fs(self.path)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def versions(self) -> list[int]:
        """The numbers of the versions that are still there."""
        return sorted(int(n[9:-5]) for n in self._names() if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """A version, by default the one in force: its number and the folders of its partitions and of its index."""
        there = self.versions() if version is None else [version]
        if not there:
            return {"version": 0, "buckets": self.buckets, "partitions": {}, "index": {}}
        fs, where = self._fs(f"{self.path}/manifest-{there[-1]:012d}.json")
        stream = fs.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Put a version in force unless its number is taken."""
        fs, new = self._fs(f"{self.path}/new-{uuid.uuid4().hex}.json")
        stream = fs.create(new)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        sc = self.spark.sparkContext
        context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), sc._jsc.hadoopConfiguration())
        no_options = sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(new, sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-{manifest['version']:012d}.json"), no_options)
        except Py4JJavaError as e:
            fs.delete(new, False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                raise Overtaken(f"version {manifest['version']} was committed by another writer") from e
            raise

    def vacuum(self, keep: int = 2, grace_seconds: float = 24 * 3600) -> list[str]:
        """Remove all versions but the last ``keep``, and folders that none of those names; returns what was removed.

        Folders younger than ``grace_seconds`` stay, as a merge that is still running, or a reader, may need them. Rows that
        ``merge`` returned must have been read before.
        """
        versions = self.versions()
        manifests = [self.manifest(v) for v in versions[-keep:]]
        used = {f.rstrip("/").split("/")[-2] for m in manifests for f in [*m["partitions"].values(), *(x for runs in m["index"].values() for x in runs)]}
        kept = {f"manifest-{v:012d}.json" for v in versions[-keep:]}
        fs, where = self._fs(self.path)
        gone = []
        for status in fs.listStatus(where) if versions else []:
            name = status.getPath().getName()
            ours = name.startswith(("v-", "i-", "new-", "manifest-"))
            if ours and name not in used and name not in kept and time.time() - status.getModificationTime() / 1000 >= grace_seconds:
                fs.delete(status.getPath(), True)
                gone.append(name)
        return sorted(gone)

    # -- reading ----------------------------------------------------------------------------------

    def _read(self, folders: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def messages(self, schema) -> DataFrame:
        """All messages kept."""
        return self._read(sorted(self.manifest()["partitions"].values()), schema)

    # -- merging ----------------------------------------------------------------------------------

    @staticmethod
    def _key_hash() -> Column:
        return F.when(F.col("message_id").isNotNull() & F.col("stream_name").isNotNull(), F.xxhash64(*KEY))

    def affected(self, incoming: DataFrame, manifest: dict) -> tuple[list[str], list[int]]:
        """The partitions that hold a message of the batch, by the index, or that the batch adds to; and the buckets of its keys."""
        rows = incoming.select(self.partition.alias(PARTITION), self._key_hash().alias("key"))
        bucket = F.pmod("key", F.lit(manifest["buckets"])).cast("int")
        seen = rows.select(PARTITION, bucket.alias("bucket")).distinct().collect()  # as many as days and buckets, at most
        touched, buckets = {r[0] for r in seen}, sorted({r[1] for r in seen if r[1] is not None})
        folders = [f for b in buckets for f in manifest["index"].get(str(b), [])]
        if folders:
            old = self._read(folders, _ENTRY).join(rows.select("key").where("key is not null").distinct(), "key", "left_semi")
            touched |= {r[0] for r in old.select(PARTITION).distinct().collect()}  # as many as there are days, at most
        return sorted(touched), buckets

    def _folders(self, folder: str, column: str) -> dict[str, str]:
        fs, where = self._fs(folder)
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return {n.partition("=")[2]: f"{folder}/{n}" for n in names if n.startswith(f"{column}=")}

    def merge(self, incoming: DataFrame) -> DataFrame:
        """Add a batch; returns (stream_name, message_id, <order>) of the rows dropped, from the batch or from history.

        A row with the kept row's key and order is the same delivery, merged again, and isn't reported: merging a batch
        again changes nothing. So does an empty batch. A merge that another writer overtakes begins again.
        """
        for attempt in range(ATTEMPTS):
            try:
                return self._merge(incoming)
            except Overtaken:
                if attempt + 1 == ATTEMPTS:
                    raise
        raise AssertionError

    def _merge(self, incoming: DataFrame) -> DataFrame:
        manifest = self.manifest()
        schema = incoming.schema
        touched, buckets = self.affected(incoming, manifest)
        if not touched:
            return incoming.select(*KEY, self.order).limit(0)
        old = [manifest["partitions"][p] for p in touched if p in manifest["partitions"]]
        rows = self._read(old, schema).withColumn(NEW, F.lit(0)).unionByName(incoming.withColumn(NEW, F.lit(1)))
        rows = rows.withColumn(PARTITION, self.partition).withColumn("__tessera_at", F.struct(F.col(self.order), F.col(NEW)))
        keyed = F.col("message_id").isNotNull() & F.col("stream_name").isNotNull()
        # a row equal in key and order to the winner is a copy as well: the row itself rides in the aggregate
        kept = [c for c in rows.columns if c != "__tessera_at"]
        groups = rows.where(keyed).groupBy(*KEY).agg(F.min_by(F.struct(*kept), "__tessera_at").alias("__tessera_row"))
        winners = groups.select("__tessera_row.*").unionByName(rows.where(~keyed).drop("__tessera_at"))
        version = uuid.uuid4().hex
        folder, index = f"{self.path}/v-{version}", f"{self.path}/i-{version}"
        try:
            # rebalanced at run time: a day with very many messages is split, days with few share a task
            winners.hint("rebalance", PARTITION).write.partitionBy(PARTITION).parquet(folder)
            written = self.spark.read.schema(winners.schema).option("basePath", folder).parquet(folder)
            # entries of what the batch brought in; what was kept before has its own
            entries = written.where(F.col(NEW) == 1).select(self._key_hash().alias("key"), PARTITION).where("key is not null")
            full = [str(b) for b in buckets if len(manifest["index"].get(str(b), [])) >= MOST_RUNS]
            if full:
                entries = entries.unionByName(self._read([f for b in full for f in manifest["index"][b]], _ENTRY)).distinct()
            entries = entries.withColumn("bucket", F.pmod("key", F.lit(manifest["buckets"])).cast("int"))
            entries.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(index)
            partitions = {p: f for p, f in manifest["partitions"].items() if p not in touched} | self._folders(folder, PARTITION)
            runs = {b: [] if b in full else list(x) for b, x in manifest["index"].items()}
            for b, f in self._folders(index, "bucket").items():
                runs.setdefault(b, []).append(f)
            self._commit({"version": manifest["version"] + 1, "buckets": manifest["buckets"], "partitions": partitions, "index": runs})
        except Overtaken:
            for f in (folder, index):
                fs, where = self._fs(f)
                fs.delete(where, True)
            raise
        # a row was dropped when it isn't the one kept for its message
        kept_now = written.select(*[F.col(c).alias(f"__tessera_{c}") for c in KEY], F.col(self.order).alias("__tessera_order"))
        same = [F.col(c) == F.col(f"__tessera_{c}") for c in KEY]
        return rows.where(keyed).select(*KEY, self.order).join(kept_now, [*same, F.col(self.order).eqNullSafe(F.col("__tessera_order"))], "left_anti")


def repeated_deliveries(messages: DataFrame, store: MessageStore, batches: int = 2) -> DataFrame:
    """(delivery_id) of each row that a store drops when the messages arrive in ``batches`` portions, in order.

    The portions are cut by batch_no, at equal parts of its range; rows without batch_no come first. Ties in
    delivery_id within one message keep one row and count as one delivery.
    """
    low, high = messages.agg(F.min("batch_no"), F.max("batch_no")).first()
    if low is None:
        low = high = 0
    step = max(1, -(-(high - low + 1) // batches))
    at = F.coalesce(F.floor((F.col("batch_no") - low) / step), F.lit(0))
    out: DataFrame | None = None
    for k in range(batches):
        dropped = store.merge(messages.where(at == k)).select("delivery_id")
        out = dropped if out is None else out.unionByName(dropped)
    return out
