"""Claims and provider actions: which claims a run normalises without review, and which task asked each query."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.relational import join_hot

#: Claims of a field, and of a run, that are taken without review.
PER_FIELD, PER_RUN = 3, 24


def bounded_claims(claims: DataFrame, sources: DataFrame, policies: DataFrame, per_field: int = PER_FIELD, per_run: int = PER_RUN) -> DataFrame:
    """The claims, in order, that a run takes without review: ``run, task, field, claim``.

    ``claims``: run, claim (a number that orders them), task, field, value, verdict, unsafe, sources (ids, repeats count once).
    ``sources``: source, source_type. ``policies``: field, accepted (types), minimum: one row for each low-risk field.

    A claim is fit if nobody has reviewed it, it is not unsafe, has a value, and enough of its sources are of accepted types. A field
    stops after ``per_field`` fit claims; those count for the run, which stops after ``per_run``. What is passed over
    never counts, so a place inside the field, and then one inside the run, say the same as a walk.
    Null verdict, null value and null sources: not fit.
    """
    fit = claims.filter((F.col("verdict") == "not_reviewed") & ~F.coalesce(F.col("unsafe"), F.lit(False)) & (F.trim("value") != ""))
    # Fields and sources may be few, and a third of all claims may have the same: neither is what rows are dealt by.
    fit = join_hot(fit, policies.select("field", "accepted", "minimum"), "field", "claim")
    cited = fit.select("run", "claim", "accepted", F.explode(F.array_distinct("sources")).alias("source"))
    cited = join_hot(cited, sources.select("source", "source_type"), "source", "claim")
    support = cited.filter(F.array_contains("accepted", F.col("source_type"))).groupBy("run", "claim").agg(F.countDistinct("source").alias("support"))
    fit = fit.join(support, ["run", "claim"], "left").filter(F.coalesce("support", F.lit(0)) >= F.col("minimum"))
    for keys, most in ((["run", "task", "field"], per_field), (["run"], per_run)):
        fit = fit.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy("claim"))).filter(F.col("_place") <= most)
    return fit.select("run", "task", "field", "claim")


def query_key(query: Column) -> Column:
    """What queries are compared by: lower case, white space squeezed."""
    return F.lower(F.btrim(F.regexp_replace(query, r"\s+", " ")))


def attributed(actions: DataFrame, tasks: DataFrame, reported: DataFrame) -> DataFrame:
    """L4: ``action, at, query, tasks``: of each query of a provider's action, the tasks that asked for it, in the plan's order.

    ``actions``: action, scope (task ids), queries. ``tasks``: task, place, queries as planned. ``reported``: task, query, as the model told.
    A planned query belongs to the tasks that planned it, in scope or not; one that no task planned, to those that report it. Of
    these, the action's scope counts. Queries without a task are left out, as are null ones.
    """
    planned = tasks.select("task", "place", F.explode("queries").alias("q")).select(query_key(F.col("q")).alias("key"), "task", "place").dropna(subset=["key"]).distinct()
    told = reported.join(tasks.select("task", "place"), "task").select(query_key(F.col("query")).alias("key"), "task", "place").dropna(subset=["key"]).distinct()
    told = told.join(planned.select("key").distinct(), "key", "left_anti")
    asked = actions.select("action", F.posexplode("queries").alias("at", "query")).withColumn("key", query_key(F.col("query")))
    # An action's scope leads to its tasks' keys before queries meet them, so a key that many tasks share costs nothing outside the scope.
    scoped = actions.select("action", F.explode(F.array_distinct("scope")).alias("task")).distinct().join(planned.unionByName(told), "task")
    met = asked.join(scoped, ["action", "key"])
    found = met.groupBy("action", "at").agg(F.first("query").alias("query"), F.array_sort(F.collect_set(F.struct("place", "task"))).alias("t"))
    return found.select("action", "at", "query", F.transform("t", lambda t: t["task"]).alias("tasks"))
