"""Tables on shared storage that jobs change step by step: a store of laws with versions, and batches under a budget.

Both follow one rule: a step writes folders named by its number and, last, a record that names them. What no record names
doesn't count, so that a step which was killed leaves nothing behind and is simply done again under the same number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmere.functions.shared import shared_dir, stage
from lexmere.plans.registry import Tables, query

BUCKETS = 64


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at a path, or an empty one."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class Store:
    """Laws (law_id, ...) in buckets by hash; each step writes the buckets that it touches anew.

    The record of a step holds, for each bucket, the step that wrote it last: a row a bucket, whatever the number of laws.
    law_id keeps its type. Rows with a null law_id are a law of their own.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _record(self) -> tuple[int, dict[int, int]]:
        """The last step and the writer of each bucket."""
        rows = _read(self.spark, f"{self.path}/records", "bucket int, writer int, step int")
        last = rows.agg(F.max("step")).first()[0]
        return (0, {}) if last is None else (last, {r.bucket: r.writer for r in rows.where((F.col("step") == last) & (F.col("bucket") >= 0)).collect()})

    def rows(self, schema) -> DataFrame:
        """All laws as the last whole step left them."""
        return self._of(self._record()[1], schema)

    def _of(self, writers: dict[int, int], schema) -> DataFrame:
        if not writers:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/laws/step={w}/bucket={b}" for b, w in sorted(writers.items())])

    def log(self) -> DataFrame:
        """Laws that whole steps replaced: step, law_id, reason, n_rows before and after. Needs one step at least."""
        done = _read(self.spark, f"{self.path}/records", "bucket int, writer int, step int").select("step").distinct()
        return self.spark.read.parquet(f"{self.path}/log").join(F.broadcast(done), "step", "left_semi")

    def replace(self, rows: DataFrame, reason: str, laws: DataFrame | None = None) -> DataFrame:
        """Puts rows in the place of all rows of ``laws`` (law_id; without it, the laws of rows) and returns the store.

        A law that is named but has no rows is emptied; rows of laws that aren't named are an error of the caller and don't
        count. Repeated rows stay repeated. With an empty table nothing changes but the log.
        """
        rows = rows.drop("__bucket", "__known")
        schema = rows.schema
        bucket = F.pmod(F.xxhash64(F.col("law_id").cast("string")), F.lit(self.buckets)).cast("int")
        named = stage((rows if laws is None else laws).select("law_id").distinct().withColumn("__bucket", bucket), "laws")
        touched = [r[0] for r in named.select("__bucket").distinct().collect()]  # a number a bucket
        last, writers = self._record()
        step = last + 1
        known = named.select(F.col("law_id").alias("__known"))
        same = F.col("law_id").eqNullSafe(F.col("__known"))
        before = self._of({b: w for b, w in writers.items() if b in touched}, schema)
        new = rows.join(known, same, "left_semi")
        both = before.join(known, same, "left_anti").unionByName(new)
        out = f"{self.path}/laws/step={step}"
        both.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64(F.col("law_id").cast("string"), F.lit(1)), F.lit(16))).write.mode("overwrite").partitionBy("bucket").parquet(out)
        there = {r[0] for r in _read(self.spark, out, "bucket int").select("bucket").distinct().collect()}
        count = lambda x, name: x.groupBy("law_id").agg(F.count(F.lit(1)).alias(name)).withColumnRenamed("law_id", f"__{name}")
        old_n, new_n = count(before, "n_before"), count(new, "n_after")
        log = named.join(old_n, F.col("law_id").eqNullSafe(F.col("__n_before")), "left").join(new_n, F.col("law_id").eqNullSafe(F.col("__n_after")), "left")
        counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_before", "n_after")]
        log.select("law_id", F.lit(reason).alias("reason"), *counts).write.mode("overwrite").parquet(f"{self.path}/log/step={step}")
        writers = {b: w for b, w in writers.items() if b not in touched} | {b: step for b in touched if b in there}
        record = self.spark.createDataFrame([(-1, step), *sorted(writers.items())], "bucket int, writer int")  # bucket -1: the step itself
        record.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/records/step={step}")
        return self._of(writers, schema)


def within_budget(rows: DataFrame, order: list[str], cost: str, budget: float) -> DataFrame:
    """The first rows in an order, which must tell rows apart, whose costs add up to a budget; the first one always, so that
    work goes on. A null cost is 0, costs below 0 count as 0. Sums within ranges of the sorted rows, and for each range the
    sum before it: no task takes all rows."""
    at = stage(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).withColumn("__cost", F.greatest(F.coalesce(cost, F.lit(0)), F.lit(0))), "costs")
    sums = at.groupBy("__range").agg(F.sum("__cost").alias("__sum"))
    before = F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("__range", F.coalesce(before, F.lit(0)).alias("__start"), (F.row_number().over(Window.orderBy("__range")) == 1).alias("__first"))  # a row a range
    w = Window.partitionBy("__range").orderBy(*order)
    total = F.col("__start") + F.sum("__cost").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = at.join(F.broadcast(starts.where(F.col("__start") <= budget)), "__range")
    out = out.withColumn("__taken", (total <= budget) | (F.col("__first") & (F.row_number().over(w) == 1)))
    return out.where("__taken").drop("__range", "__cost", "__start", "__first", "__taken")


class Batches:
    """Work in calls under a budget, at most ``calls`` in ``window`` seconds. The report of a call is its record: a call
    that starts again leaves out what reports name, and a call that was killed has none."""

    def __init__(self, spark: SparkSession, path: str, budget: float, calls: int = 5, window: int = 3600):
        self.spark, self.path, self.budget, self.calls, self.window = spark, path, budget, calls, window

    def report(self, id_type: str = "long") -> DataFrame:
        return _read(self.spark, f"{self.path}/reports", f"id {id_type}, at long, call int")

    def run(self, queue: DataFrame, at: int, work: Callable[[DataFrame, str], None], order: list[str]) -> str:
        """One call at a time in seconds over queue (id, cost, ...): done, empty or limited. ``work`` gets the rows of the call
        and a folder that is its own, which it overwrites."""
        id_type = queue.schema["id"].dataType.simpleString()
        reports = self.report(id_type)
        last, recent = reports.agg(F.max("call"), F.count_distinct(F.when(F.col("at") > at - self.window, F.col("call")))).first()
        if recent >= self.calls:
            return "limited"
        todo = queue.join(reports.select(F.col("id").alias("__done")), F.col("id").eqNullSafe(F.col("__done")), "left_anti")
        chosen = stage(within_budget(todo, order, "cost", self.budget), "batch")
        if chosen.isEmpty():
            return "empty"
        call = (last or 0) + 1
        work(chosen, f"{self.path}/out/call={call}")
        chosen.select("id", F.lit(at).cast("long").alias("at")).write.mode("overwrite").parquet(f"{self.path}/reports/call={call}")
        return "done"


@query("""
SELECT 'C' || lpad(o_custkey::VARCHAR, 9, '0') AS law_id, o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'second' ELSE 'first' END AS written
FROM orders WHERE o_custkey % 5 <> 1 AND NOT (o_custkey % 3 = 0 AND o_orderkey % 2 = 1)""")
def replaced_laws(t: Tables) -> DataFrame:
    """Customers as laws: all are written, then every third one is replaced by its even orders, then a fifth is emptied."""
    rows = t.orders.select(F.concat(F.lit("C"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("law_id"), "o_orderkey", "o_custkey", F.lit("first").alias("written"))
    store = Store(t.spark, shared_dir(t.spark, "laws"))
    store.replace(rows, "all")
    third = rows.where("o_custkey % 3 = 0")
    store.replace(third.where("o_orderkey % 2 = 0").withColumn("written", F.lit("second")), "even orders", third.select("law_id"))
    out = store.replace(rows.limit(0), "emptied", rows.where("o_custkey % 5 = 1").select("law_id"))
    return out.select("law_id", "o_orderkey", "written")


@query("""
WITH q AS (SELECT p_partkey AS id, p_size AS cost, sum(p_size) OVER (ORDER BY p_size DESC, p_partkey ROWS UNBOUNDED PRECEDING) AS total, sum(p_size) OVER () // 4 AS budget FROM part),
a AS (SELECT max(total) AS e FROM q WHERE total <= budget), b AS (SELECT max(total) AS e FROM q, a WHERE total <= a.e + budget), c AS (SELECT max(total) AS e FROM q, b WHERE total <= b.e + budget)
SELECT id, cost, CASE WHEN total <= a.e THEN 1 WHEN total <= b.e THEN 2 ELSE 3 END AS call FROM q, a, b, c WHERE total <= c.e""")
def budgeted_batches(t: Tables) -> DataFrame:
    """Parts in calls that each take a quarter of the sizes, larger parts first; a fourth call in the hour is refused."""
    queue = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("cost"))
    budget = (queue.agg(F.sum("cost")).first()[0] or 0) // 4
    batches = Batches(t.spark, shared_dir(t.spark, "batches"), budget, calls=3)
    for at in (0, 60, 120, 180):
        batches.run(queue, at, lambda rows, path: rows.write.mode("overwrite").parquet(path), [F.desc("cost"), "id"])
    return _read(t.spark, f"{batches.path}/out", "id long, cost int, call int")
