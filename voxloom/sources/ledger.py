"""The transcript history as a table of changes (K5, D1-D6), in a folder that driver and executors share.

Each commit adds a Parquet folder of changed rows and a manifest, a small text file by
version that says what the table is made of: the folders that count, the greatest id
ever given, and the last batch of each stream. A manifest is created only
if its version isn't there yet, so of two writers that began from one version the later
is refused, and what a failed or refused writer leaves is in no manifest. Ids go up from
the greatest ever given, so those of deleted entries are not given again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.text import entry_title
from voxloom.operators.ranking import placed
from voxloom.sources.tables import HISTORY_SCHEMA

CHANGE_SCHEMA = f"{HISTORY_SCHEMA}, _deleted BOOLEAN, _version BIGINT"
EMPTY = {"version": 0, "top": 0, "folders": [], "batches": {}}


class StaleWriterError(RuntimeError):
    """Another writer has committed since this one has read the table."""


class Ledger:
    """The table as of its newest version, or of a version given; commits go on from there."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = self._read(self._newest() if version is None else version)

    # manifests

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _newest(self) -> int:
        fs, path = self._fs("manifest")
        if not fs.exists(path):
            return 0
        return max((int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit()), default=0)

    def _read(self, version: int) -> dict:
        if not version:
            return json.loads(json.dumps(EMPTY))
        fs, path = self._fs(f"manifest/{version:012d}")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Writes a manifest under a name of its own and gives it its version's name, which must not be there."""
        text = json.dumps(manifest)
        fs, draft = self._fs(f"manifest/draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        _, name = self._fs(f"manifest/{manifest['version']:012d}")
        try:
            taken = fs.exists(name) or not fs.rename(draft, name)
        except Py4JJavaError:
            taken = True
        if taken:
            fs.delete(draft, False)
            raise StaleWriterError(f"version {manifest['version']} of {self.path} is there already")
        self.manifest = manifest

    # reading

    @property
    def version(self) -> int:
        return self.manifest["version"]

    def rows(self) -> DataFrame:
        """The entries as they are now."""
        columns = [c.split()[0] for c in HISTORY_SCHEMA.split(", ")]
        if not self.manifest["folders"]:
            return self.spark.createDataFrame([], HISTORY_SCHEMA)
        changes = self.spark.read.schema(CHANGE_SCHEMA).parquet(*[f"{self.path}/{f}" for f in self.manifest["folders"]])
        newest = changes.groupBy("id").agg(F.max_by(F.struct(*columns[1:], "_deleted"), "_version").alias("e"))
        return newest.filter(~F.col("e._deleted")).select("id", "e.*").drop("_deleted")

    # writing

    def _commit(self, changes: DataFrame, top: int, batch: tuple[str, int] | None = None, instead: bool = False) -> int:
        """changes (the history's columns and _deleted) as the next version; instead: they are all there is."""
        version, folder = self.version + 1, f"changes-{uuid.uuid4().hex}"
        kinds = {c.split()[0]: c.split()[1] for c in CHANGE_SCHEMA.split(", ")}
        full = changes.withColumn("_version", F.lit(version).cast("long"))
        full.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()]).write.parquet(f"{self.path}/{folder}")
        batches = self.manifest["batches"] | ({batch[0]: batch[1]} if batch else {})
        self._publish({"version": version, "top": top, "folders": [*([] if instead else self.manifest["folders"]), folder], "batches": batches})
        return version

    def append(self, entries: DataFrame, now: int) -> DataFrame:
        """(id, file_name) of new entries (file_name, texts, post_process_requested), numbered in order of file_name above all ids ever given."""
        numbered = placed(entries, [F.asc("file_name")], "id")
        top = self.manifest["top"]
        made = numbered.withColumns({"id": F.col("id") + top, "timestamp": F.lit(now).cast("long"), "saved": F.lit(False), "title": entry_title(F.lit(now)), "_deleted": F.lit(False)})
        self._commit(made, top + numbered.count())
        return made.select("id", "file_name")

    def upsert(self, entries: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Entries (the history's columns) in place of those of the same ids. A batch (stream, number) that has been committed changes nothing; False then."""
        if batch and self.manifest["batches"].get(batch[0], -1) >= batch[1]:
            return False
        top = entries.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        self._commit(entries.withColumn("_deleted", F.lit(False)), max(self.manifest["top"], top), batch)
        return True

    def delete(self, ids: DataFrame) -> None:
        """Removes entries by id (id); others don't matter."""
        gone = ids.select(F.col("id").cast("long").alias("id")).distinct().join(self.rows().select("id"), "id")
        columns = [c.split() for c in HISTORY_SCHEMA.split(", ")[1:]]
        self._commit(gone.select("id", *[F.lit(None).cast(k).alias(c) for c, k in columns], F.lit(True).alias("_deleted")), self.manifest["top"])

    def compact(self) -> None:
        """One folder for the entries as they are; ids stay given."""
        self._commit(self.rows().withColumn("_deleted", F.lit(False)), self.manifest["top"], instead=True)

    def sink(self, stream: str) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: upserts each batch once, by the stream's name and the batch's number."""

        def write(batch: DataFrame, number: int) -> None:
            Ledger(self.spark, self.path).upsert(batch, (stream, number))

        return write
