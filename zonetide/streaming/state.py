"""State carried from batch to batch: run lengths, last actions, the day's budget.

The state is kept as small tables that each micro-batch reads and stores anew. Run lengths and surplus are computed by the
same distributed operators as in a nightly run, whatever a zone's share of the rows. Only the budget and the cooldowns depend on every
earlier decision; for these the rows of a budget group pass one by one, in the order of their time, through a fold that holds
nothing but the last actions of the group's zones and what its day has spent.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from zonetide.functions.numeric import round_even
from zonetide.functions.scoring import severity
from zonetide.operators import decision as D
from zonetide.operators.segments import RANGE_ROWS
from zonetide.session import written
from zonetide.settings import DecisionSettings
from zonetide.streaming.store import BatchTable, run_together

RUNS = "zone_id long, timestamp timestamp, carried_count int"
ACTIONS = "zone_id long, action string, acted_at timestamp"
SUPPLY = "zone_name string, taxi_count double, baseline_supply double, seen_at timestamp"
#: Budgets and costs are counted in whole ten-thousandths.
UNITS = 10_000


def _carried(runs: DataFrame) -> DataFrame:
    return runs.select("zone_id", "carried_count")


def _next_runs(runs: DataFrame, counted: DataFrame) -> DataFrame:
    """Last run length per zone: new where the batch has the zone, else as before."""
    ends = counted.select(F.col("zone_id").cast("long").alias("zone_id"), "timestamp", F.col("persistence_count").alias("carried_count"))
    last = F.max_by(F.struct("timestamp", "carried_count"), "timestamp")
    return runs.unionByName(ends).groupBy("zone_id").agg(last.alias("r")).select("zone_id", "r.*")


def _supply_of(rows: DataFrame) -> DataFrame:
    return rows.select("zone_name", F.col("taxi_count").cast("double").alias("taxi_count"),
                       F.col("baseline_supply").cast("double").alias("baseline_supply"), F.col("timestamp").alias("seen_at"))


def _last_supply(known: DataFrame, rows: DataFrame) -> DataFrame:
    """Last reported supply per zone name, of this batch or an earlier one."""
    last = F.max_by(F.struct("taxi_count", "baseline_supply", "seen_at"), F.struct("seen_at", "taxi_count"))
    return known.unionByName(_supply_of(rows)).groupBy("zone_name").agg(last.alias("s")).select("zone_name", "s.*")


def surplus_as_of(rows: DataFrame, known: DataFrame, edges: DataFrame, buffer: float) -> DataFrame:
    """``neighbor_surplus`` of every row: what its neighbours could spare by their last report up to the row's time.

    ``known`` holds earlier reports. One series per edge, as long as the two zones' rows of the batch.
    """
    reports = known.unionByName(_supply_of(rows)).select(F.col("zone_name").alias("neighbor"), F.col("seen_at").alias("at"),
                                                         D.exportable(buffer=buffer).alias("spare"), "taxi_count")
    latest = reports.groupBy("neighbor", "at").agg(F.max_by("spare", "taxi_count").alias("spare"))
    asks = rows.select(F.col("zone_name").alias("zone"), F.col("timestamp").alias("at")).distinct()
    told = edges.join(latest, "neighbor").select("zone", "neighbor", "at", "spare", F.lit(False).alias("asks"))
    asked = edges.join(asks, "zone").select("zone", "neighbor", "at", F.lit(None).cast("double").alias("spare"), F.lit(True).alias("asks"))
    series = W.partitionBy("zone", "neighbor").orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    seen = told.unionByName(asked).withColumn("spare", F.last("spare", ignorenulls=True).over(series)).filter("asks")
    total = seen.groupBy(F.col("zone").alias("zone_name"), F.col("at").alias("timestamp")).agg(round_even(F.sum("spare")).alias("neighbor_surplus"))
    return rows.join(total, ["zone_name", "timestamp"], "left").withColumn("neighbor_surplus", F.coalesce("neighbor_surplus", F.lit(0.0)))


def persistence_batches(spark: SparkSession, folder: str, threshold: float = DecisionSettings().monitor_max, range_rows: int = RANGE_ROWS):
    """A ``foreachBatch`` function: run lengths of (zone_id, timestamp, predicted_shortage) rows.

    Results go to the batch table ``folder/rows``. Within a batch the series are cut, see ``segments.run_lengths``.
    """
    runs, out = BatchTable(spark, f"{folder}/runs"), BatchTable(spark, f"{folder}/rows")

    def step(batch: DataFrame, number: int) -> None:
        rows = written(batch.select("zone_id", "timestamp", "predicted_shortage"), "batch-rows")
        before = runs.last(RUNS, number)
        counted = written(D.persistence_counts(rows, F.col("predicted_shortage") > threshold, carried=_carried(before), range_rows=range_rows), "counted")
        out.put(counted, number)
        runs.replace(_next_runs(before, counted), number)

    return step


# --- decisions ----------------------------------------------------------------

def _fold(cfg: DecisionSettings, cooldowns: list[int], costs: list[int], spends: list[bool], fallbacks: tuple[int, int]):
    """The rows of one budget group in turn: what is left of the day's budget, which actions cool down, which one is taken."""
    full = round(cfg.daily_budget * UNITS)

    def fold(key: tuple[Any, ...], parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acted: dict[tuple[int, int], int] = {}
        day, spent, turn = None, 0, None
        for part in parts:
            found = []
            for kind, zone, at, here, number, value, row, nets, severe in part[
                    ["kind", "zone_id", "at", "day_number", "number", "value", "row", "nets", "severe"]].itertuples(index=False, name=None):
                if turn is not None and (kind, at, zone) < turn:
                    raise ValueError("rows of a budget group out of order")
                turn = (kind, at, zone)
                if kind == 0:  # what earlier batches left: spends of a day, or the last time of an action in a zone
                    if number < 0:
                        day, spent = (here, value) if day is None or here > day else (day, spent)
                    else:
                        acted[zone, number] = value
                    continue
                if here != day:
                    day, spent = here, 0
                left = max(full - spent, 0)
                cooling = [c > 0 and (zone, i) in acted and (at - acted[zone, i]) // 1_000_000 < c * 60 for i, c in enumerate(cooldowns)]
                options = [(net, -i) for i, net in enumerate(nets) if net == net and not cooling[i] and (not spends[i] or left >= costs[i])]
                taken = -max(options)[1] if options else fallbacks[bool(severe)]
                acted[zone, taken] = at
                spent += costs[taken] if spends[taken] else 0
                found.append((row, left / UNITS, cooling, taken))
            yield pd.DataFrame(found, columns=["row", "remaining_budget", "cooling", "taken"])

    return fold


def _folded(rows: DataFrame, acted: DataFrame, spent: DataFrame, groups: list[str], cfg: DecisionSettings) -> DataFrame:
    """Adds remaining_budget and the ``cooling_*`` flags to rows (with ``_row``, ``day`` and the groups)."""
    fold_keys = [g for g in groups if g != "day"]
    key = F.concat_ws("\x1f", F.lit(""), *[F.coalesce(F.col(g).cast("string"), F.lit("\x1e")) for g in fold_keys])
    names = [a.name for a in cfg.actions]
    bucket = severity("predicted_shortage", cfg)
    nets = []
    for a in cfg.actions:
        walls = D._obstacles(a, cfg, F.lit(cfg.daily_budget), F.lit(False))
        fits = D._is_candidate(a, bucket, cfg) & ~D._any(w for name, w in walls.items() if name != "daily_budget_exhausted")
        nets.append(F.when(fits, D.net_value(a, D.shortage_reduction(a, "predicted_shortage", "neighbor_surplus"), cfg)).otherwise(F.lit(float("nan"))))
    micros = lambda c: F.unix_micros(c)
    days = lambda c: F.unix_date(c) if "day" in groups else F.lit(0)
    nothing = {"row": F.lit(-1).cast("long"), "nets": F.array().cast("array<double>"), "severe": F.lit(False), "kind": F.lit(0)}
    columns = ["key", "kind", "zone_id", "at", "day_number", "number", "value", "row", "nets", "severe"]
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("action")).cast("int") - 1
    homes = rows.select(F.col("zone_id").cast("long").alias("zone_id"), key.alias("key")).distinct()  # a zone may be in several groups
    old = acted.join(homes, "zone_id").withColumns({**nothing, "at": F.lit(0).cast("long"), "day_number": F.lit(0), "number": number, "value": micros(F.col("acted_at"))})
    bought = spent.withColumns({**nothing, "key": key, "zone_id": F.lit(-1).cast("long"), "at": F.lit(0).cast("long"), "number": F.lit(-1),
                                "day_number": days(F.col("day")) if "day" in groups else F.lit(0), "value": (F.col("spent") * UNITS).cast("long")})
    mine = rows.select(key.alias("key"), F.lit(1).alias("kind"), F.col("zone_id").cast("long").alias("zone_id"), micros(F.col("timestamp")).alias("at"),
                       days(F.col("day")).alias("day_number"), F.lit(0).alias("number"), F.lit(0).cast("long").alias("value"), F.col("_row").alias("row"),
                       F.array(*nets).alias("nets"), (bucket == "severe").alias("severe"))
    queue = bought.select(columns).unionByName(old.select(columns)).unionByName(mine.select(columns))
    fold = _fold(cfg, [a.cooldown_minutes for a in cfg.actions], [round(a.cost * UNITS) for a in cfg.actions], [a.spends_budget for a in cfg.actions],
                 (names.index(cfg.fallback_action), names.index(cfg.alert_action)))
    ordered = queue.repartition("key").sortWithinPartitions("key", "kind", "at", "zone_id")
    done = ordered.groupBy("key").applyInPandas(fold, "row long, remaining_budget double, cooling array<boolean>, taken int")
    out = rows.join(done.withColumnRenamed("row", "_row"), "_row")
    return out.withColumns({f"cooling_{n}": F.get("cooling", F.lit(i)) for i, n in enumerate(names)}).drop("cooling", "taken")


def decide_batches(spark, folder: str, edges: DataFrame, groups: list[str], cfg: DecisionSettings = DecisionSettings(), wait: str = "0 minutes"):
    """A ``foreachBatch`` function: decide rows in the order of their time, with the state left by earlier batches.

    Rows need zone_id, zone_name, timestamp, predicted_shortage, taxi_count and baseline_supply. A row is decided when a later one
    than its time plus ``wait`` has been seen, so all rows of a moment are there, and however the rows are cut into batches the decisions are
    the same; the closing row of ``ingest.closable`` releases the last ones. Rows that come later than that are kept in ``folder/late``
    and not decided. State: rows waiting, the last run length per zone, the last time of each action per zone, the last supply of
    each zone (for its neighbours), and what each budget group spent on its last day. Decisions are the batch table ``folder/decisions``.
    """
    kinds = {g: "date" if g == "day" else "string" for g in groups}
    spend_schema = ", ".join([f"{g} {k}" for g, k in kinds.items()] + ["spent decimal(22,4)"])
    tables = {name: BatchTable(spark, f"{folder}/{name}") for name in ("mark", "waiting", "runs", "actions", "spends", "supply", "late", "decisions")}

    def step(batch: DataFrame, number: int) -> None:
        state = lambda name, schema: tables[name].last(schema, number)
        fresh = written(batch, "batch-rows")
        marks = state("mark", "passed timestamp")
        reached = written(fresh.select((F.col("timestamp") - F.expr(f"INTERVAL {wait}")).alias("passed")).unionByName(marks).agg(F.max("passed").alias("passed")), "mark")
        before, now = marks.agg(F.max("passed")).scalar(), reached.select("passed").scalar()
        real = fresh.filter(F.col("zone_id").isNotNull())
        late = F.coalesce(F.col("timestamp") < before, F.lit(False))
        open_ = written(real.filter(~late).unionByName(state("waiting", real.schema)).withColumn("_ready", F.col("timestamp") < now), "open-rows")
        rows = written(open_.filter("_ready").drop("_ready").withColumns({"day": F.to_date("timestamp"), "_row": F.monotonically_increasing_id()}), "ready-rows")
        runs, acted, spent, supply = state("runs", RUNS), state("actions", ACTIONS), state("spends", spend_schema), state("supply", SUPPLY)
        counted = D.persistence_counts(rows, F.col("predicted_shortage") > cfg.monitor_max, carried=_carried(runs))
        placed = written(surplus_as_of(counted, supply, edges, cfg.surplus_buffer), "decision-rows")
        decided = written(D.decide(_folded(placed, acted, spent, groups, cfg), cfg).drop("_row"), "decisions")
        new_actions = decided.select(F.col("zone_id").cast("long").alias("zone_id"), F.col("recommended_action").alias("action"), F.col("timestamp").alias("acted_at"))
        spends = _last_day(spent.unionByName(_spends(decided, groups, cfg)), groups)
        actions = acted.unionByName(new_actions).groupBy("zone_id", "action").agg(F.max("acted_at").alias("acted_at"))
        # Each a small job of its own; none reads what another writes.
        run_together(
            spark, lambda: tables["decisions"].put(decided, number), lambda: tables["late"].put(real.filter(late), number),
            lambda: tables["waiting"].replace(open_.filter("NOT _ready").drop("_ready"), number), lambda: tables["mark"].replace(reached, number),
            lambda: tables["runs"].replace(_next_runs(runs, decided), number), lambda: tables["supply"].replace(_last_supply(supply, rows), number),
            lambda: tables["actions"].replace(actions, number), lambda: tables["spends"].replace(spends, number))

    return step


def _spends(decided: DataFrame, groups: list[str], cfg: DecisionSettings) -> DataFrame:
    costly = F.col("recommended_action").isin(*[a.name for a in cfg.spending])
    cost: Column = F.when(costly, F.col("estimated_action_cost")).otherwise(0.0)
    return decided.select(*[F.col(g) if g == "day" else F.col(g).cast("string").alias(g) for g in groups], cost.cast("decimal(22,4)").alias("spent"))


def _last_day(spends: DataFrame, groups: list[str]) -> DataFrame:
    """What each group spent, and if it has days, on its last one: time does not go back."""
    total = spends.groupBy(*groups).agg(F.sum("spent").cast("decimal(22,4)").alias("spent"))
    if "day" not in groups:
        return total
    rest = [g for g in groups if g != "day"]
    return total.groupBy(*rest).agg(F.max_by(F.struct("day", "spent"), "day").alias("s")).select(*rest, "s.day", "s.spent").select(*groups, "spent")


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    """All decisions of :func:`decide_batches`."""
    return BatchTable(spark, f"{folder}/decisions").read()
