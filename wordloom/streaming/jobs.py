"""Restartable jobs: each key is worked on once, over any number of runs, within a budget.

A job has a folder.  Every micro-batch writes its results and then its ledger,
the keys that are done; the ledger's folder is the commit.  A batch that is
run again after a crash replaces what it wrote before, and readers see only
results whose ledger is there.  So each key has its result once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.sources.store import files_of, read_file, replace_file


class BudgetSpent(Exception):
    """Raised by a job's work, or by the job, when no more may be done in this run."""


@dataclass
class Job:
    """A job over rows with ``keys``; ``work`` maps the rows to do to one row each, keys kept."""

    spark: SparkSession
    folder: str
    keys: list[str]
    work: Callable[[DataFrame], DataFrame]

    def _batches(self) -> list[int]:
        text = read_file(self.spark, f"{self.folder}/DONE")
        return [int(x) for x in text.split()] if text else []

    def _read(self, what: str, schema: str) -> DataFrame:
        done = self._batches()
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{what}/batch={b}" for b in done))

    def _key_schema(self, rows: DataFrame) -> str:
        return ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in self.keys)

    def finished(self, rows: DataFrame) -> DataFrame:
        """The keys that are done; ``rows`` gives their types."""
        return self._read("ledger", self._key_schema(rows))

    def results(self) -> DataFrame:
        """The results of all batches that are done."""
        done = self._batches()
        if not done or not any(files_of(self.spark, f"{self.folder}/results/batch={b}") for b in done):
            raise ValueError(f"{self.folder} has no results yet")
        return self.spark.read.parquet(*(f"{self.folder}/results/batch={b}" for b in done))

    def todo(self, rows: DataFrame) -> DataFrame:
        """Rows whose key isn't done, the first of each key (by its other columns)."""
        left = rows.join(self.finished(rows), self.keys, "left_anti")
        others = [c for c in rows.columns if c not in self.keys]
        order = Window.partitionBy(*self.keys).orderBy(*(others or self.keys))
        return left.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")

    def step(self, rows: DataFrame, batch: int, most: int | None = None) -> int:
        """Works on a batch, on ``most`` of its rows at most; returns how many were done.

        A batch that is done already is left alone.  The rows of the largest
        allowed number are taken in the order of their keys.
        """
        if batch in self._batches():
            return 0
        todo = self.todo(rows)
        if most is not None:
            todo = todo.orderBy(*self.keys).limit(most)
        done = self.work(todo)
        where = f"{self.folder}/results/batch={batch}"
        done.write.mode("overwrite").parquet(where)
        # The ledger is taken from what was written, not from work done a second time.
        written = self.spark.read.schema(done.schema).parquet(where).select(*self.keys)
        written.write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={batch}")
        n = self.spark.read.schema(self._key_schema(rows)).parquet(f"{self.folder}/ledger/batch={batch}").count()
        replace_file(self.spark, f"{self.folder}/DONE", " ".join(map(str, [*self._batches(), batch])))
        return n

    def run(self, rows: DataFrame, chunk: int, budget: int) -> dict[str, int]:
        """Works on a table in chunks until all is done or ``budget`` rows are; what is left is for the next run."""
        total = 0
        while total < budget:
            batch = max(self._batches(), default=-1) + 1
            try:
                n = self.step(rows, batch, min(chunk, budget - total))
            except BudgetSpent:
                break
            total += n
            if n == 0:
                break
        return {"done": total, "left": self.todo(rows).count()}

    def follow(self, stream: DataFrame, budget: int | None = None) -> dict[str, int]:
        """Works on what has arrived in a stream since the last run, batch by batch, until the budget is spent.

        A batch that would go beyond the budget is not begun; it comes again
        in the next run.
        """
        spent, stopped = 0, False

        def each(rows: DataFrame, batch: int) -> None:
            nonlocal spent, stopped
            if stopped or batch in self._batches():
                return
            if budget is not None and spent + self.todo(rows).count() > budget:
                stopped = True
                raise BudgetSpent
            try:
                spent += self.step(rows, batch)
            except BudgetSpent:
                stopped = True
                raise

        query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception:
            if not stopped:
                raise
        return {"done": spent, "stopped": int(stopped)}
