"""Budgets that items of a run draw on in sequence, where an item whose choice gives nothing tries its next one."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.relational import join_hot

#: An item's choices, in order of preference: the name of an action, what it draws on, and the ids of its pool.
#: ``pool``: ids that were granted before are free, others cost one of the first budget each; the choice gives something if any
#: id is had. ``search``: the item's task, free if granted before, else one of the second budget. ``forced``, as the first choice only: the task
#: is granted whatever is left, and counts. ``always``: gives something and costs nothing.
CHOICES = "array<struct<action: string, kind: string, ids: array<bigint>>>"


def choice(action: str, kind: str, ids: Column | None = None) -> Column:
    """One choice."""
    none = F.array().cast("array<bigint>")
    return F.struct(F.lit(action).alias("action"), F.lit(kind).alias("kind"), (none if ids is None else ids.cast("array<bigint>")).alias("ids"))


def _reached(asked: DataFrame, budget: int, name: str) -> DataFrame:
    """``run, name``: the ``seq`` at which a budget is certainly spent; no row where it may never be. ``asked``: run, seq of each first demand."""
    place = F.row_number().over(Window.partitionBy("run").orderBy("seq"))
    return asked.withColumn("_place", place).filter(F.col("_place") <= budget).groupBy("run").agg(F.count("*").alias("_n"), F.max("seq").alias(name)).filter(F.col("_n") == budget).drop("_n")


def deciding(items: DataFrame, sources: int, searches: int) -> DataFrame:
    """The items that may change what is granted, ``run, seq, task, choices``; all others only look at it.

    A second item of the same task and choices finds all that the first one had, so it changes nothing. While a budget is
    open, a first choice on it is always granted; so once as many distinct ids, and tasks, as the budgets have been first
    choices, both are spent, and nothing after that changes anything. Forced items count one by one, up to the budget.
    """
    alike = items.groupBy("run", "task", "choices").agg(F.min("seq").alias("seq"))
    first = F.try_element_at("choices", F.lit(1))
    forced = items.filter(first["kind"] == "forced")
    # A task that is forced at any time may cost a search nothing, so its searches are no demand to count on.
    free = forced.select("run", "task").distinct()
    place = F.row_number().over(Window.partitionBy("run").orderBy("seq"))
    # The first one of a task counts at any place: what searches for that task has it, and asks for nothing else.
    again = F.row_number().over(Window.partitionBy("run", "task").orderBy("seq"))
    forced = forced.withColumn("_place", place).withColumn("_again", again).filter((F.col("_place") <= searches) | (F.col("_again") == 1))
    demands = forced.filter(F.col("_place") <= searches).select("run", "seq")
    forced = forced.select(*alike.columns)
    ids = alike.filter(first["kind"] == "pool").select("run", "seq", F.explode(first["ids"]).alias("id")).groupBy("run", "id").agg(F.min("seq").alias("seq"))
    tasks = alike.filter(first["kind"] == "search").groupBy("run", "task").agg(F.min("seq").alias("seq"))
    tasks = tasks.join(free, (tasks["run"] == free["run"]) & tasks["task"].eqNullSafe(free["task"]), "left_anti")
    demands = tasks.select("run", "seq").unionByName(demands)
    rows = alike.filter(F.coalesce(first["kind"], F.lit("")) != "forced").unionByName(forced)
    if sources and searches:
        spent = _reached(ids, sources, "spent_ids").join(_reached(demands, searches, "spent_tasks"), "run")
        spent = spent.select("run", F.greatest("spent_ids", "spent_tasks").alias("spent"))
        rows = rows.join(spent, "run", "left").filter(F.col("spent").isNull() | (F.col("seq") <= F.col("spent"))).drop("spent")
    return rows.select("run", "seq", "task", "choices")


def grants(rows: DataFrame, sources: int, searches: int) -> DataFrame:
    """``run, kind, id, seq``: what each run's fold over its items in order grants, and when.

    Items arrive sorted, so the state of a run is its grants, of which there are no more than the budgets and forced items.
    They are dealt by a hash of the run: dealt by the run itself, as a join before has it, Spark takes the join's exchange
    for this one, and reads it as its writers left it once the join's other side is small enough to be sent to all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, ids, tasks, used = None, set(), set(), 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["run"] != of or ids is None:
                    of, ids, tasks, used = row["run"], set(), set(), 0
                if len(ids) >= sources and used >= searches and not (row["choices"] and row["choices"][0]["kind"] == "forced"):
                    continue
                for c in row["choices"] or []:
                    if c["kind"] == "pool":
                        wanted = list(dict.fromkeys(c["ids"] or []))
                        fresh = [i for i in wanted if i not in ids][: max(0, sources - len(ids))]
                        had = bool(fresh) or any(i in ids for i in wanted)
                        ids.update(fresh)
                        out += [(of, "pool", i, row["seq"]) for i in fresh]
                    elif c["kind"] == "always":
                        had = True
                    else:
                        had = c["kind"] == "forced" or row["task"] in tasks or used < searches
                        if had and (c["kind"] == "forced" or row["task"] not in tasks):
                            used += 1
                        if had and row["task"] not in tasks:
                            tasks.add(row["task"])
                            out.append((of, "search", row["task"], row["seq"]))
                    if had:
                        break
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            kinds = [batch.schema.field("run").type, pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["run", "kind", "id", "seq"])

    kind = dict(rows.dtypes)["run"]
    return rows.repartition(F.xxhash64("run")).sortWithinPartitions("run", "seq").mapInArrow(run, f"run {kind}, kind string, id bigint, seq bigint")


def allocate(items: DataFrame, sources: int, searches: int) -> DataFrame:
    """``items`` (``run, seq, task, choices``) with the ``action`` each gets and the ``ids`` it may use, in its pool's order.

    A run's items are served by ``seq``, which is unique in it. Who gets what depends on all grants before; so a fold over the few
    items that can change them finds the grants and their times, and every item then reads its own answer from these, all at
    once. Items whose choices all give nothing have no action. Repeated ids of a pool count once, null ids never.
    Null and empty choices: no action. A run with a third of all items is one fold over what ``deciding`` leaves of it.
    """
    own = F.transform(F.col("choices"), lambda c: F.struct(c["action"].alias("action"), c["kind"].alias("kind"), F.array_distinct(F.array_compact(F.coalesce(c["ids"], F.array().cast("array<bigint>")))).alias("ids")))
    given = F.filter(own, lambda c: (c["kind"] != "pool") | (F.size(c["ids"]) > 0))
    rows = items.withColumn("choices", F.coalesce(given, F.array().cast(CHOICES)))
    found = grants(deciding(rows, sources, searches), sources, searches)
    # Forced tasks are granted whatever the fold has left.
    forced = rows.filter(F.try_element_at("choices", F.lit(1))["kind"] == "forced").groupBy("run", F.col("task").alias("id")).agg(F.min("seq").alias("seq"))
    found = found.unionByName(forced.select("run", F.lit("search").alias("kind"), "id", "seq")).groupBy("run", "kind", "id").agg(F.min("seq").alias("seq"))
    entries = lambda kind: F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, F.struct("id", "seq"))))
    facts = found.groupBy("run").agg(entries("pool").alias("_ids"), entries("search").alias("_tasks"))
    rows = join_hot(rows, facts, "run", "seq", "left")
    had = lambda grants, i: F.coalesce(F.try_element_at(grants, i) <= F.col("seq"), F.lit(False))
    taken = F.transform(F.col("choices"), lambda c: F.struct(c["action"].alias("action"), c["kind"].alias("kind"), F.filter(c["ids"], lambda i: had(F.col("_ids"), i)).alias("ids")))
    gives = F.filter(taken, lambda c: c["kind"].isin("always", "forced") | ((c["kind"] == "pool") & (F.size(c["ids"]) > 0)) | ((c["kind"] == "search") & had(F.col("_tasks"), F.col("task"))))
    best = F.try_element_at(gives, F.lit(1))
    return rows.select(*[c for c in items.columns if c != "choices"], best["action"].alias("action"), F.coalesce(best["ids"], F.array().cast("array<bigint>")).alias("ids"))
