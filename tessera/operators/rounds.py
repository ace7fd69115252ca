"""A loop of rounds over a table of runs: each round works on the runs that are still open and leaves a table behind."""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.artifacts import exists

STATE = "round int, quality double, passed boolean, cost double, stagnant int, stop string"


@dataclass(frozen=True)
class Limits:
    """When a run stops: rounds at most, cost from which no further round starts, and rounds in a row that gain less than ``gain``."""

    rounds: int
    cost: float
    gain: float
    stagnant: int


def _stop(limits: Limits) -> Column:
    """Why a run does not go on, in the order in which this is asked; null if it does."""
    return (
        F.when(F.col("passed"), "passed")
        .when(F.col("stagnant") >= limits.stagnant, "stagnant")
        .when(F.col("cost").isNull(), "cost_unknown")
        .when(F.col("cost") >= limits.cost, "budget")
        .when(F.col("round") >= limits.rounds, "limit")
    )


class Loop:
    """Rounds of repair over many runs at once, kept at ``target``, a folder that the cluster shares.

    ``step`` gets the open runs with their state and gives ``run, quality, passed, cost`` of those that it has worked on; cost null is unknown
    from then on. A run that it leaves out has nothing more to do. A round's table holds the runs that were open
    before it, so later rounds never read the others; it counts once Spark has committed it whole, and a loop
    that is started again goes on after the last one that does, with the same result.
    """

    def __init__(self, spark: SparkSession, target: str, step: Callable[[DataFrame], DataFrame], limits: Limits) -> None:
        self.spark, self.target, self.step, self.limits = spark, target.rstrip("/"), step, limits

    def _path(self, number: int) -> str:
        return f"{self.target}/round-{number:05d}"

    def table(self, number: int) -> DataFrame:
        return self.spark.read.parquet(self._path(number))

    def done(self) -> int:
        """The last round that counts, -1 before any; there are no more than ``limits.rounds``."""
        number = -1
        while exists(self.spark, f"{self._path(number + 1)}/_SUCCESS"):
            number += 1
        return number

    def write(self, number: int, before: DataFrame) -> None:
        """Works on the open runs once and keeps what each has come to."""
        worked = self.step(before).select("run", F.col("quality").cast("double").alias("_quality"), F.col("passed").alias("_passed"), F.col("cost").cast("double").alias("_cost"), F.lit(True).alias("_worked"))
        rows = before.drop("stop").join(worked, "run", "left")
        had = F.coalesce("_worked", F.lit(False))
        gained = F.col("_quality") - F.col("quality") >= self.limits.gain
        state = {
            "round": F.when(had, F.lit(number)).otherwise(F.col("round")),
            "quality": F.when(had, F.col("_quality")).otherwise(F.col("quality")),
            "passed": F.when(had, F.coalesce("_passed", F.lit(False))).otherwise(F.col("passed")),
            "cost": F.when(had, F.col("cost") + F.col("_cost")).otherwise(F.col("cost")),
            "stagnant": F.when(had & F.coalesce(gained, F.lit(False)), 0).otherwise(F.col("stagnant") + had.cast("int")),
        }
        rows = rows.select("run", had.alias("_had"), *[c.cast(t).alias(n) for n, t in (x.split() for x in STATE.split(", ")[:-1]) for c in [state[n]]])
        rows.withColumn("stop", F.when(F.col("_had"), _stop(self.limits)).otherwise("nothing_to_do")).drop("_had").write.mode("overwrite").parquet(self._path(number))

    def run(self, runs: DataFrame) -> DataFrame:
        """``run, round, quality, passed, cost, stagnant, stop`` of each of ``runs`` (``run, quality, passed``) once all have stopped."""
        number = self.done()
        if number < 0:
            start = runs.select("run", F.lit(0).alias("round"), F.col("quality").cast("double").alias("quality"), F.coalesce("passed", F.lit(False)).alias("passed"), F.lit(0.0).alias("cost"), F.lit(0).alias("stagnant"))
            start.withColumn("stop", _stop(self.limits)).write.mode("overwrite").parquet(self._path(0))
            number = 0
        while not (open_ := self.table(number).filter("stop IS NULL")).isEmpty():
            number += 1
            self.write(number, open_)
        return reduce(DataFrame.unionByName, [self.table(i).filter("stop IS NOT NULL") for i in range(number + 1)])

    def audit(self) -> DataFrame:
        """A row for each run and round it was worked on."""
        return reduce(DataFrame.unionByName, [self.table(i).filter(F.col("round") == i) for i in range(1, self.done() + 1)], self.table(0).limit(0))
