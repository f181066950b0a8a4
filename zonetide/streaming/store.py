"""Tables that micro-batches write: replaceable by batch, compacted, with a manifest that says what counts.

A batch writes a folder of its own, then a manifest that names the folders which make up the table. The manifest of a batch follows
from the one before it, so a batch that is retried, even after its folders were merged, writes the same table again. Readers see the
newest manifest; it is put in place by a rename, so they never see half a batch.

Whenever ``every`` folders of one size have gathered they are merged into one of the next size, so a table of n batches has about
``every * log(n)`` folders, and a row is rewritten only that often. Folders that neither of the last two manifests names are deleted.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession

from zonetide.sources.folders import Folder

#: Folders of one size that are merged into one.
EVERY = 8
#: Rows of one file of a merged folder.
FILE_ROWS = 5_000_000


def run_together(spark: SparkSession, *jobs: Callable[[], object]) -> None:
    """Start Spark jobs that do not depend on one another at the same time, and wait for all."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]:
            done.result()


class BatchTable:
    """A table of one folder, written batch by batch. ``keep`` is a filter that merged rows must pass: what it drops has expired."""

    def __init__(self, spark: SparkSession, folder: str, schema=None, every: int = EVERY, keep: Column | None = None):
        self.spark, self.schema, self.every, self.keep = spark, schema, every, keep
        self._at = Folder(spark, folder)

    # --- manifests ---

    def _manifest(self, number: int) -> list[str]:
        """Folders of the newest manifest up to ``number``."""
        known = [int(n) for n in self._at.names("manifest") if n.isdigit() and int(n) <= number]
        if not known:
            return []
        return json.loads(self._at.text(f"manifest/{max(known)}"))

    def _commit(self, folders: list[str], number: int) -> None:
        self._at.put_text(f"manifest/{number}", json.dumps(folders))
        known = [int(n) for n in self._at.names("manifest") if n.isdigit()]
        recent = sorted(n for n in known if n <= number)[-2:]
        named = {f for n in recent for f in self._manifest(n)}
        for name in self._at.names():
            if name.startswith("p") and name not in named:
                self._at.drop(name)
        for n in known:
            if n not in recent:
                self._at.drop(f"manifest/{n}")

    # --- tables that grow ---

    def put(self, rows: DataFrame, number: int) -> None:
        """Add a batch's rows, or put them in place of what the batch wrote before."""
        schema = rows.schema
        name = f"p0-{number}"
        rows.write.mode("overwrite").parquet(f"{self._at.root}/{name}")
        folders = [*self._manifest(number - 1), name]
        size = 0
        while (full := [f for f in folders if f.startswith(f"p{size}-")]) and len(full) >= self.every:
            merged = f"p{size + 1}-{number}"
            together = self.spark.read.schema(schema).parquet(*[f"{self._at.root}/{f}" for f in full])
            if self.keep is not None:
                together = together.filter(self.keep)
            # No shuffle: neighbouring files are read together.
            together.coalesce(max(1, -(-together.count() // FILE_ROWS))).write.mode("overwrite").parquet(f"{self._at.root}/{merged}")
            folders = [merged, *[f for f in folders if f not in full]]
            size += 1
        self._commit(folders, number)

    def read(self, schema=None) -> DataFrame:
        """All rows of the newest manifest. The schema may be left out if there is a batch."""
        folders = self._manifest(1 << 62)
        schema = schema or self.schema
        if not folders:
            return self.spark.createDataFrame([], schema)
        return (self.spark.read.schema(schema) if schema is not None else self.spark.read).parquet(*[f"{self._at.root}/{f}" for f in folders])

    # --- tables of which only the last state counts ---

    def replace(self, rows: DataFrame, number: int) -> DataFrame:
        """The state after batch ``number``. The one before it stays for a retry, older ones go."""
        name = f"p0-{number}"
        rows.write.mode("overwrite").parquet(f"{self._at.root}/{name}")
        self._commit([name], number)
        return self.spark.read.schema(rows.schema).parquet(f"{self._at.root}/{name}")

    def last(self, schema, number: int) -> DataFrame:
        """The state as batch ``number`` found it."""
        folders = self._manifest(number - 1)
        return self.spark.read.schema(schema).parquet(f"{self._at.root}/{folders[-1]}") if folders else self.spark.createDataFrame([], schema)
