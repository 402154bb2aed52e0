"""A stored table with a key: upserts rewrite only the hash buckets they touch, and writers cannot overwrite each other."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(Exception):
    """Another writer has made a newer version since the expected one."""


@dataclass
class KeyedTable:
    """Rows by ``keys`` below ``folder``, which every executor can reach.

    A version is a short list that names, for each bucket, the folder of its rows. Reading follows the newest list, so a
    write becomes visible as a whole when its list is there, and readers of older lists keep what they see.
    """

    spark: SparkSession
    folder: str
    keys: list[str]
    schema: T.StructType
    buckets: int = 64

    def _lists(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("bucket int, place string, tag bigint, version bigint").parquet(f"{self.folder}/versions")
        except Exception as error:  # no version yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None

    def _newest(self) -> tuple[int, int | None, dict[int, str]]:
        """Version, tag and the folder of each bucket: at most ``buckets`` rows."""
        lists = self._lists()
        if lists is None:
            return 0, None, {}
        newest = lists.agg(F.max("version")).first()[0]
        rows = lists.filter(F.col("version") == newest).collect()
        return newest, rows[0]["tag"], {r["bucket"]: r["place"] for r in rows if r["bucket"] >= 0}

    def version(self) -> int:
        """0 before the first write."""
        return self._newest()[0]

    def tag(self) -> int | None:
        """What the newest write was called."""
        return self._newest()[1]

    def _read(self, places: list[str]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*places)

    def read(self) -> DataFrame:
        return self._read(list(self._newest()[2].values()))

    def upsert(self, rows: DataFrame, removed: DataFrame | None = None, expected: int | None = None, tag: int | None = None) -> int:
        """Put ``rows`` in the place of those with their keys, take out the keys in ``removed``; the new version.

        One row per key is expected in ``rows``; of several, one stays. A null in a key is a value of its own. ``expected``:
        the version that the caller has read; :class:`Conflict` if there is a newer one. A write with the tag of the newest
        version has been made already and changes nothing, so a step that is tried again can be written again.
        """
        newest, last, places = self._newest()
        if tag is not None and tag == last:
            return newest
        if expected is not None and expected != newest:
            raise Conflict(f"version {newest} is newer than {expected}")
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        names = [f.name for f in self.schema.fields]
        new = rows.select(*names).dropDuplicates(self.keys)
        keys = new.select(*self.keys) if removed is None else new.select(*self.keys).unionByName(removed.select(*self.keys)).distinct()
        touched = [r["b"] for r in keys.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets``
        held = self._read([places[b] for b in touched if b in places])
        gone = keys.select(*[F.col(k).alias(f"__gone_{k}") for k in self.keys])
        same = [F.col(k).eqNullSafe(F.col(f"__gone_{k}")) for k in self.keys]
        kept = held.join(gone, same, "left_anti").select(*names)
        place = f"{self.folder}/rows/{uuid.uuid4().hex}"
        # Rows meet by bucket in as many tasks as there are buckets; a bucket is a share of the table.
        kept.unionByName(new).withColumn("bucket", bucket).repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(place)
        written = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(place)
        full = {r["bucket"] for r in written.select("bucket").distinct().collect()}
        now = {b: p for b, p in places.items() if b not in touched} | {b: f"{place}/bucket={b}" for b in full}
        self._publish(newest + 1, tag, now)
        return newest + 1

    def _publish(self, version: int, tag: int | None, places: dict[int, str]) -> None:
        rows = [(b, p, tag) for b, p in sorted(places.items())] or [(-1, "", tag)]
        try:  # the folder of a version exists once
            self.spark.createDataFrame(rows, "bucket int, place string, tag bigint").coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/versions/version={version}")
        except Exception as error:
            if "PATH_ALREADY_EXISTS" in str(error):
                raise Conflict(f"version {version} was written by another") from error
            raise
