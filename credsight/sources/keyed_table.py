"""A stored table that is changed by key (S12, R5): an upsert rewrites the touched hash buckets only.

The table is laid out in ``buckets`` folders by a hash of the key.  An upsert merges the batch with the
buckets its keys fall in, writes them as new generations beside the old ones, and only then publishes
a manifest that names the generation of every bucket.  Readers follow the newest manifest, so a crash
before it is published leaves the old table; generations that no manifest names are removed by ``clean``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import landing as L


class KeyedTable:
    def __init__(self, spark: SparkSession, folder: str, key: str, seq: str, buckets: int = 64):
        self.spark, self.folder, self.key, self.seq, self.buckets = spark, folder.rstrip("/"), key, seq, buckets

    # ------------------------------------------------------------------ manifest

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _numbers(self) -> list[int]:
        at = self._path("manifests")
        if not self._fs().exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self) -> dict[str, str]:
        """Bucket number -> generation; empty before the first load.  One entry per bucket."""
        numbers = self._numbers()
        if not numbers:
            return {}
        text = self.spark.read.text(f"{self.folder}/manifests/{numbers[-1]}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _publish(self, entries: dict[str, str]) -> None:
        """A manifest appears by one rename: it is there whole or not at all."""
        number = (self._numbers() or [0])[-1] + 1
        fs, hidden = self._fs(), self._path("manifests", f".{uuid.uuid4().hex}")
        out = fs.create(hidden, False)
        try:
            out.write(bytearray(json.dumps(entries).encode()))
        finally:
            out.close()
        if not fs.rename(hidden, self._path("manifests", f"{number}.json")):
            raise RuntimeError(f"another load published manifest {number} first; run this one again")

    # ------------------------------------------------------------------ reading and changing

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _read(self, entries: dict[str, str]) -> DataFrame | None:
        paths = [f"{self.folder}/data/generation={g}/_bucket={b}" for b, g in sorted(entries.items())]
        return self.spark.read.option("mergeSchema", True).parquet(*paths) if paths else None

    def read(self) -> DataFrame:
        rows = self._read(self.manifest())
        if rows is None:
            raise LookupError(f"nothing was loaded into {self.folder} yet")
        return rows

    def stage(self, batch: DataFrame) -> tuple[dict[str, str], DataFrame]:
        """Write the merged buckets of the batch's keys; (manifest entries to publish, rejects).  Nothing
        a reader sees changes."""
        known = batch.where(F.col(self.key).isNotNull())
        touched = [str(r[0]) for r in known.select(self._bucket().alias("b")).distinct().collect()]     # bucket numbers
        before = self.manifest()
        target = self._read({b: g for b, g in before.items() if b in set(touched)})
        merged, rejects = L.upsert_last_write_wins(batch.limit(0) if target is None else target, batch, self.key, self.seq)
        generation = uuid.uuid4().hex[:12]
        rows = merged.withColumn("_bucket", self._bucket()).repartition(max(1, len(touched)), "_bucket")
        rows.write.partitionBy("_bucket").parquet(f"{self.folder}/data/generation={generation}")
        return {**before, **{b: generation for b in touched}}, rejects

    def upsert(self, batch: DataFrame) -> DataFrame:
        """Insert or overwrite by key, the highest ``seq`` wins; returns the rows without a key."""
        entries, rejects = self.stage(batch)
        self._publish(entries)
        return rejects

    def clean(self) -> int:
        """Remove the bucket folders that the newest manifest doesn't name; how many went."""
        named = {f"generation={g}/_bucket={b}" for b, g in self.manifest().items()}
        fs, gone = self._fs(), 0
        if not fs.exists(self._path("data")):
            return 0
        for generation in fs.listStatus(self._path("data")):
            for bucket in fs.listStatus(generation.getPath()):
                name = f"{generation.getPath().getName()}/{bucket.getPath().getName()}"
                if bucket.isDirectory() and name not in named:
                    gone += bool(fs.delete(bucket.getPath(), True))
        return gone
