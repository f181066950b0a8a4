"""Choosing an action per zone: persistence, cooldown, surplus, budget.

The choice itself is row-local: each action's feasibility and net value are plain columns and
the best one is a ``greatest`` over structs, so nothing is exploded or shuffled. Only three
things need other rows: the run length (a window per zone), the neighbours' surplus (an edge
join) and the shared budget (below).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonetide.functions.numeric import clip, col_of, round_even
from zonetide.functions.scoring import severity
from zonetide.operators.scoring import latest_snapshot
from zonetide.operators.segments import run_lengths
from zonetide.session import written
from zonetide.settings import Action, DecisionSettings

DEFAULT = DecisionSettings()
MONEY = "decimal(12,4)"


# --- persistence ------------------------------------------------------------

def persistence_counts(df: DataFrame, over: Column, keys: tuple[str, ...] = ("zone_id",), ts: str = "timestamp",
                       carried: DataFrame | None = None, range_rows: int | None = None,
                       out: str = "persistence_count") -> DataFrame:
    """Consecutive rows with ``over`` true per zone, restarting at 0.

    ``carried`` (keys, carried_count) continues runs of an earlier job: it is added to rows before
    a zone's first reset. ``range_rows`` cuts series that are too long for one task, see
    ``segments.run_lengths``. Of rows of one moment those over the threshold come first.
    """
    hit = F.coalesce(over, F.lit(False)).cast("int")
    flagged = df.withColumn("_hit", hit)
    if range_rows:
        counted = run_lengths(flagged.withColumnRenamed("_hit", "_over"), list(keys), ts, "_over", rows=range_rows, out=out, fresh="_fresh")
        fresh = F.col("_fresh")
    else:
        turn = [F.col(ts), F.col("_hit").desc()]
        order = W.partitionBy(*keys).orderBy(*turn).rowsBetween(W.unboundedPreceding, 0)
        counted = flagged.withColumn("_island", F.sum(1 - F.col("_hit")).over(order))
        inside = W.partitionBy(*keys, "_island").orderBy(*turn).rowsBetween(W.unboundedPreceding, 0)
        counted = counted.withColumn(out, F.sum("_hit").over(inside))
        fresh = F.col("_island") == 0
    if carried is not None:
        counted = (counted.join(carried.select(*keys, "carried_count"), list(keys), "left")
                   .withColumn(out, F.col(out) + F.when(fresh, F.coalesce("carried_count", F.lit(0))).otherwise(0))
                   .drop("carried_count"))
    kept = [c for c in df.columns if c != out]
    return counted.select(*kept, F.col(out).cast("int").alias(out))


# --- neighbours -------------------------------------------------------------

def zone_snapshot(df: DataFrame, order: tuple[str, ...] = ("timestamp",), key: str = "zone_name") -> DataFrame:
    """The last row per zone name: its supply and baseline. Combines on the map side."""
    last = F.max_by(F.struct("taxi_count", "baseline_supply"), F.struct(*order))
    return df.groupBy(key).agg(last.alias("s")).select(
        F.col(key).alias("neighbor"), F.col("s.taxi_count").alias("taxi_count"),
        F.col("s.baseline_supply").alias("baseline_supply"))


def exportable(supply="taxi_count", baseline="baseline_supply", buffer: float = DEFAULT.surplus_buffer) -> Column:
    """Supply above the kept share of the baseline, in baselines."""
    c = F.greatest(F.coalesce(col_of(supply).cast("double"), F.lit(0.0)), F.lit(0.0))
    given = col_of(baseline).cast("double")
    b = F.greatest(F.coalesce(given, c), F.lit(1.0))
    kept = F.greatest(b * F.lit(1.0 - buffer), F.lit(1.0))
    return F.greatest(c - kept, F.lit(0.0)) / b


def neighbor_surplus(edges: DataFrame, snapshot: DataFrame, buffer: float = DEFAULT.surplus_buffer) -> DataFrame:
    """Total exportable surplus around each zone; neighbours without a snapshot add nothing."""
    offered = snapshot.select("neighbor", exportable(buffer=buffer).alias("_spare"))
    return (edges.join(offered, "neighbor").groupBy("zone")
            .agg(round_even(F.sum("_spare")).alias("neighbor_surplus")))


def with_neighbor_surplus(df: DataFrame, edges: DataFrame, buffer: float = DEFAULT.surplus_buffer,
                          key: str = "zone_name", snapshot: DataFrame | None = None) -> DataFrame:
    """``snapshot`` (neighbor, taxi_count, baseline_supply) if it is known already; else the last rows of ``df``."""
    last = zone_snapshot(df, key=key) if snapshot is None else snapshot
    around = neighbor_surplus(edges, last, buffer).withColumnRenamed("zone", key)
    return df.join(around, key, "left").withColumn(
        "neighbor_surplus", F.coalesce("neighbor_surplus", F.lit(0.0)))


# --- cooldown ---------------------------------------------------------------

def last_actions(log: DataFrame, cfg: DecisionSettings = DEFAULT, ts: str = "acted_at") -> DataFrame:
    """Newest time of each action per zone, one column per action."""
    return log.groupBy("zone_id").agg(*[
        F.max(F.when(F.col("action") == a.name, F.col(ts))).alias(f"last_{a.name}") for a in cfg.actions])


def with_cooldowns(df: DataFrame, last: DataFrame | None, now: Column, cfg: DecisionSettings = DEFAULT) -> DataFrame:
    """Flags ``cooling_<action>``: the action was taken too recently in this zone."""
    joined = df if last is None else df.join(last, "zone_id", "left")
    cols = {}
    for a in cfg.actions:
        if last is None or a.cooldown_minutes <= 0:
            cols[f"cooling_{a.name}"] = F.lit(False)
        else:
            age = F.timestamp_diff("SECOND", F.col(f"last_{a.name}"), now)
            cols[f"cooling_{a.name}"] = F.coalesce(age < a.cooldown_minutes * 60, F.lit(False))
    out = joined.withColumns(cols)
    return out.drop(*[f"last_{a.name}" for a in cfg.actions]) if last is not None else out


# --- value of one action ----------------------------------------------------

def shortage_reduction(a: Action, shortage, surplus) -> Column:
    """Expected fall of the shortage index, bounded by the index itself."""
    s = F.greatest(col_of(shortage).cast("double"), F.lit(0.0))
    effect = s * F.lit(a.uplift)
    if a.needs_surplus:
        effect = effect * clip(surplus, 0.0, 1.0)
    if a.boost != 1.0:
        effect = effect * F.lit(a.boost)
    return round_even(F.greatest(F.lit(0.0), F.least(effect, s)))


def net_value(a: Action, reduction: Column, cfg: DecisionSettings = DEFAULT) -> Column:
    penalty = cfg.alert_penalty if a.name == cfg.alert_action else 0.0
    return round_even(reduction * F.lit(cfg.reduction_weight) - F.lit(a.cost) * F.lit(cfg.cost_weight)
                      - F.lit(penalty))


def _is_candidate(a: Action, bucket: Column, cfg: DecisionSettings) -> Column:
    return bucket.isin(*[s for s, names in cfg.candidates.items() if a.name in names])


def _obstacles(a: Action, cfg: DecisionSettings, budget: Column, cooling: Column) -> dict[str, Column]:
    """What stands in the way of an action, by reason."""
    out = {"cooldown_active": cooling}
    if a.spends_budget:
        out["daily_budget_exhausted"] = ~(budget >= F.lit(a.cost))
    if a.needs_surplus:
        out["neighbor_surplus_unavailable"] = ~(F.col("neighbor_surplus") > 0)
    if not a.always_allowed:
        out["persistence_requirement"] = F.col("persistence_count") < cfg.persistence_threshold
    return out


def _any(flags) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | f
    return out


def _best(cfg: DecisionSettings, bucket: Column, blocked: dict[str, Column]) -> Column:
    """Highest net value among feasible candidates; the earlier action wins ties."""
    options = []
    for i, a in enumerate(cfg.actions):
        reduction = shortage_reduction(a, "predicted_shortage", "neighbor_surplus")
        options.append(F.when(_is_candidate(a, bucket, cfg) & ~blocked[a.name], F.struct(
            net_value(a, reduction, cfg).alias("net"), F.lit(-i).alias("rank"), F.lit(a.name).alias("action"),
            F.lit(a.cost).alias("cost"), reduction.alias("reduction"))))
    return F.greatest(*options)


def candidate_actions(df: DataFrame, cfg: DecisionSettings = DEFAULT) -> DataFrame:
    """One row per zone row and candidate action, with cost, reduction, net value and obstacles.

    At most four rows come out of one: this is the audit view, the decision does not need it.
    """
    bucket = severity("predicted_shortage", cfg)
    base = df if "remaining_budget" in df.columns else df.withColumn("remaining_budget", F.lit(cfg.daily_budget))
    options = []
    for i, a in enumerate(cfg.actions):
        reduction = shortage_reduction(a, "predicted_shortage", "neighbor_surplus")
        cooling = F.col(f"cooling_{a.name}") if f"cooling_{a.name}" in df.columns else F.lit(False)
        walls = _obstacles(a, cfg, F.col("remaining_budget"), cooling)
        options.append(F.when(_is_candidate(a, bucket, cfg), F.struct(
            F.lit(i).alias("action_rank"), F.lit(a.name).alias("action"), F.lit(a.cost).alias("action_cost"),
            reduction.alias("shortage_reduction"), net_value(a, reduction, cfg).alias("net_value"),
            F.concat_ws("; ", *[F.when(w, name) for name, w in sorted(walls.items())]).alias("obstacles"))))
    return (base.withColumn("severity_bucket", bucket)
            .withColumn("_o", F.explode(F.array_compact(F.array(*options))))
            .select(*base.columns, "severity_bucket", "_o.*")
            .withColumn("feasible", F.col("obstacles") == ""))


def decide(df: DataFrame, cfg: DecisionSettings = DEFAULT) -> DataFrame:
    """Best action per row given ``remaining_budget`` and the ``cooling_*`` flags.

    Needs predicted_shortage, persistence_count, neighbor_surplus and remaining_budget. Without a
    feasible action severe zones alert the ops team and the others keep monitoring.
    """
    bucket = severity("predicted_shortage", cfg)
    budget = F.col("remaining_budget")
    walls = {a.name: _obstacles(a, cfg, budget,
                                F.col(f"cooling_{a.name}") if f"cooling_{a.name}" in df.columns else F.lit(False))
             for a in cfg.actions}
    best = _best(cfg, bucket, {name: _any(w.values()) for name, w in walls.items()})
    alert, keep = cfg.action(cfg.alert_action), cfg.action(cfg.fallback_action)

    def fall(a: Action) -> Column:
        reduction = shortage_reduction(a, "predicted_shortage", "neighbor_surplus")
        return F.struct(net_value(a, reduction, cfg).alias("net"), F.lit(0).alias("rank"),
                        F.lit(a.name).alias("action"), F.lit(a.cost).alias("cost"), reduction.alias("reduction"))

    reasons = sorted({r for w in walls.values() for r in w})
    hit = [F.when(_any(walls[a.name][r] & _is_candidate(a, bucket, cfg)
                       for a in cfg.actions if r in walls[a.name]), r) for r in reasons]
    listed = F.concat_ws('", "', *hit)
    spends = F.col("_pick.action").isin(*[a.name for a in cfg.spending])
    # The three reason sentences.
    reason = (F.when(F.col("_best").isNotNull(), F.concat(
        F.lit("Selected "), F.col("_pick.action"),
        F.lit(" because it maximized deterministic net value under current constraints.")))
        .when(F.col("_pick.action") == alert.name, "No automated action was feasible under current constraints.")
        .otherwise("Constraints blocked active intervention; continue monitoring."))
    picked = (df.withColumns({"severity_bucket": bucket, "_best": best})
              .withColumn("_pick", F.coalesce("_best", F.when(F.col("severity_bucket") == "severe", fall(alert))
                                              .otherwise(fall(keep)))))
    scratch = [c for c in df.columns if c.startswith("cooling_")]
    return picked.withColumns({
        "recommended_action": F.col("_pick.action"),
        "action_reason": reason,
        "estimated_action_cost": F.col("_pick.cost"),
        "estimated_shortage_reduction": F.col("_pick.reduction"),
        "net_value": F.col("_pick.net"),
        "budget_remaining": round_even(F.greatest(
            F.when(spends, budget - F.col("_pick.cost")).otherwise(budget), F.lit(0.0))),
        "constraints_triggered": F.when(F.col("_best").isNotNull() | (listed == ""), "[]").otherwise(
            F.concat(F.lit('["'), listed, F.lit('"]'))),
    }).drop("_best", "_pick", *scratch)


# --- shared budget ----------------------------------------------------------

def _choices(cfg: DecisionSettings) -> dict[tuple[str, ...], Column]:
    """For every set of spending actions still allowed: which of them a row would take, if any."""
    bucket = severity("predicted_shortage", cfg)
    names = [a.name for a in cfg.spending]
    out = {}
    for size in range(1, len(names) + 1):
        for allowed in combinations(names, size):
            blocked = {}
            for a in cfg.actions:
                cooling = F.col(f"cooling_{a.name}")
                walls = _obstacles(a, cfg, F.lit(cfg.daily_budget), cooling)
                if a.spends_budget:
                    walls["daily_budget_exhausted"] = F.lit(a.name not in allowed)
                blocked[a.name] = _any(walls.values())
            taken = _best(cfg, bucket, blocked)["action"]
            out[allowed] = F.when(taken.isin(*allowed), taken)
    return out


def _column_for(allowed) -> str:
    return "_take_" + "_or_".join(allowed)


def allocate_budget(df: DataFrame, groups: list[str], order: list[str], zone: str = "zone_id",
                    cfg: DecisionSettings = DEFAULT, in_run_cooldown: bool = False,
                    opening: DataFrame | None = None) -> DataFrame:
    """Add ``remaining_budget``: what is left of the group's budget when a row's turn comes.

    Rows take turns by ``order`` inside a budget group (say region and day). A row's choice depends
    on what earlier rows spent, which looks sequential, but only spending rows change anything and
    each spend costs at least the cheapest incentive: a budget allows ``cfg.most_spends`` spends at
    most, however many rows the group has. So the spends are found instead of folding over rows:

    * while the dearest incentive is affordable, the spenders are the first few rows that would
      choose one; a top-n per group that Spark prunes before the shuffle;
    * from the row where it no longer is, the same with the next cheaper incentive, and so on.

    With ``in_run_cooldown`` a zone that took an incentive cannot take the same one again in the
    run (rows of one zone repeat, as when all history is scored); each zone then contributes at
    most one spend per incentive. No group is ever gathered in one task.

    ``opening`` (groups, opening_budget) replaces the full daily budget where earlier runs spent some.
    ``df`` is read a few times: give it a stored table (see ``session.written``) when it is the
    end of a long plan.
    """
    spending = cfg.spending
    costs = {a.name: a.cost for a in spending}
    names = [a.name for a in spending]
    keys = groups or ["_all"]
    turn = F.struct(*order)
    for a in cfg.actions:
        if f"cooling_{a.name}" not in df.columns:
            df = df.withColumn(f"cooling_{a.name}", F.lit(False))
    choices = {_column_for(k): v for k, v in _choices(cfg).items()}
    rows = df.withColumns({**({} if groups else {"_all": F.lit(0)}), "_turn": turn, **choices})
    full = F.lit(cfg.daily_budget).cast(MONEY)
    if opening is None:
        rows = rows.withColumn("_open", full)
    else:
        rows = rows.join(opening.select(*groups, F.col("opening_budget").cast(MONEY).alias("_given")), groups, "left") \
            .withColumn("_open", F.coalesce("_given", full)).drop("_given")
    asked = rows.select(*keys, zone, "_turn", "_open", *choices)
    near = None if in_run_cooldown else _first_candidates(asked, keys, zone, names, cfg)
    spends = None
    for tier in range(len(names), 0, -1):
        open_names = names[:tier]
        need = costs[open_names[-1]]
        pool = asked if near is None else near.filter(F.col("_tier") == tier)
        if spends is None:
            pool = pool.withColumn("_left", F.col("_open"))
        else:
            used = spends.groupBy(*keys).agg(F.sum("_cost").alias("_used"), F.max("_turn").alias("_since"))
            pool = pool.join(used, keys, "left").withColumn(
                "_left", (F.col("_open") - F.coalesce("_used", F.lit(0).cast(MONEY))).cast(MONEY))
            since = F.col("_since")
            pool = pool.filter((F.col("_left") < F.lit(costs[names[tier]]).cast(MONEY))
                               & (since.isNull() | (F.col("_turn") > since)))
        pool = pool.filter(F.col("_left") >= F.lit(need).cast(MONEY))
        if near is None:
            pool = _spend_events(pool, keys, zone, open_names, spends)
        found = pool.select(*keys, zone, "_turn", "_took", "_left")
        priced = found.withColumn("_cost", _cost_of("_took", costs))
        first = W.partitionBy(*keys).orderBy("_turn")
        few = priced.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= cfg.most_spends)
        earlier = first.rowsBetween(W.unboundedPreceding, -1)
        bought = (few.withColumn("_before", F.col("_left") - F.coalesce(F.sum("_cost").over(earlier), F.lit(0).cast(MONEY)))
                  .filter(F.col("_before") >= F.lit(need).cast(MONEY)).select(*keys, zone, "_turn", "_took", "_cost"))
        spends = bought if spends is None else spends.unionByName(bought)
    # At most most_spends entries per group and tier.
    ledger = spends.groupBy(*keys).agg(F.collect_list(F.struct("_turn", F.col(zone).alias("_zone"), "_took", "_cost")).alias("_ledger"))
    # One budget for all: the ledger is a value, not a join on a key that every row has.
    met = rows.join(ledger, keys, "left") if groups else rows.withColumn("_ledger", ledger.select("_ledger").scalar())
    joined = met.withColumn(
        "_mine", F.filter("_ledger", lambda e: e["_turn"] < F.col("_turn")))
    spent = F.aggregate("_mine", F.lit(0).cast("decimal(22,4)"), lambda acc, e: (acc + e["_cost"]).cast("decimal(22,4)"))
    left = F.greatest(F.col("_open").cast("decimal(22,4)") - F.coalesce(spent, F.lit(0).cast("decimal(22,4)")),
                      F.lit(0).cast("decimal(22,4)")).cast("double")
    cols = {"remaining_budget": left}
    if in_run_cooldown:
        for n in names:
            mine = F.filter("_mine", lambda e: e["_zone"] == F.col(zone))
            again = F.array_contains(F.transform(mine, lambda e: e["_took"]), n)
            cols[f"cooling_{n}"] = F.col(f"cooling_{n}") | F.coalesce(again, F.lit(False))
    return joined.withColumns(cols).drop("_all", "_turn", "_open", "_ledger", "_mine", *choices)


def _cost_of(action: str, costs: dict[str, float]) -> Column:
    out = None
    for name, cost in costs.items():
        out = F.when(F.col(action) == name, F.lit(cost)) if out is None else out.when(F.col(action) == name, F.lit(cost))
    return out.cast(MONEY)


def _take(open_names: list[str], used: Column | None) -> Column:
    """The row's choice among open incentives minus those its zone already used."""
    if used is None:
        return F.col(_column_for(open_names))
    out = None
    for size in range(len(open_names), 0, -1):
        for allowed in combinations(open_names, size):
            rest = [n for n in open_names if n not in allowed]
            match = F.lit(True)
            for n in allowed:
                match = match & ~F.array_contains(used, n)
            for n in rest:
                match = match & F.array_contains(used, n)
            value = F.col(_column_for(allowed))
            out = F.when(match, value) if out is None else out.when(match, value)
    return out


def _first_candidates(asked: DataFrame, keys: list[str], zone: str, names: list[str], cfg: DecisionSettings) -> DataFrame:
    """Per group and tier the first rows that would spend: all that the search for spends has to look at, from one read of the rows.

    A row that would spend with fewer incentives allowed would also spend with more. So of a tier's candidates before the last spend
    of the tiers above it, every one has spent, and ``most_spends`` a tier is enough.
    """
    tiers = [F.when(F.col(_column_for(names[:t])).isNotNull(), F.struct(F.lit(t).alias("_tier"), F.col(_column_for(names[:t])).alias("_took")))
             for t in range(len(names), 0, -1)]
    listed = asked.select(*keys, zone, "_turn", "_open", F.inline(F.array_compact(F.array(*tiers))))
    place = F.row_number().over(W.partitionBy(*keys, "_tier").orderBy("_turn"))
    return written(listed.withColumn("_n", place).filter(F.col("_n") <= len(names) * cfg.most_spends).drop("_n"), "candidates")


def _spend_events(pool: DataFrame, keys: list[str], zone: str, open_names: list[str], spends: DataFrame | None) -> DataFrame:
    """Rows that would spend in this tier, where a zone takes each incentive once in a run."""
    if spends is None:
        state = pool.withColumn("_used", F.array().cast("array<string>"))
    else:
        taken = spends.groupBy(*keys, zone).agg(F.collect_set("_took").alias("_used"))
        state = pool.drop("_used").join(taken, [*keys, zone], "left").withColumn(
            "_used", F.coalesce("_used", F.array().cast("array<string>")))
    events = None
    for _ in open_names:
        would = state.withColumn("_took", _take(open_names, F.col("_used"))).filter(F.col("_took").isNotNull())
        first = would.groupBy(*keys, zone).agg(F.min(F.struct("_turn", "_took")).alias("_e"), F.first("_left").alias("_left"))
        step = first.select(*keys, zone, F.col("_e._turn").alias("_turn"), F.col("_e._took").alias("_took"), "_left")
        events = step if events is None else events.unionByName(step)
        after = first.select(*keys, zone, F.col("_e").alias("_seen"))
        state = (state.join(after, [*keys, zone]).filter(F.col("_turn") > F.col("_seen._turn"))
                 .withColumn("_used", F.array_append("_used", F.col("_seen._took"))).drop("_seen"))
    return events


def decide_zones(scored: DataFrame, edges: DataFrame, now: Column, groups: list[str], cfg: DecisionSettings = DEFAULT,
                 last: DataFrame | None = None, carried: DataFrame | None = None, scope: str = "latest",
                 order: list[str] | None = None, newest: Column | None = None) -> DataFrame:
    """Persistence, surplus, cooldown, budget and choice in one go.

    ``scope='latest'`` decides only the newest snapshot (persistence still sees all rows);
    ``scope='all'`` decides every row, as a replay. The rows to decide are stored in the shared
    folder first, because the budget reads them several times.
    """
    counted = persistence_counts(scored, F.col("predicted_shortage") > cfg.monitor_max, carried=carried)
    if scope == "latest":
        counted = latest_snapshot(counted, newest=newest)
    # A neighbour's supply is its last known one, whichever rows are being decided.
    around = neighbor_surplus(edges, zone_snapshot(scored), cfg.surplus_buffer).withColumnRenamed("zone", "zone_name")
    near = counted.join(around, "zone_name", "left").withColumn("neighbor_surplus", F.coalesce("neighbor_surplus", F.lit(0.0)))
    placed = with_cooldowns(near, last, now, cfg)
    turns = order or ["zone_id", "timestamp"]
    funded = allocate_budget(written(placed, "decision-rows"), groups, turns, cfg=cfg, in_run_cooldown=scope == "all")
    return decide(funded, cfg)


def budget_after(decisions: DataFrame, groups: list[str], cfg: DecisionSettings = DEFAULT) -> DataFrame:
    """Spent and remaining budget per group (a new UTC day is a new group, so it starts fresh)."""
    cost = F.when(F.col("recommended_action").isin(*[a.name for a in cfg.spending]),
                  F.col("estimated_action_cost").cast(MONEY)).otherwise(F.lit(0).cast(MONEY))
    total = F.sum(cost).cast("double")
    return decisions.groupBy(*groups).agg(
        round_even(total).alias("spent"),
        round_even(F.greatest(F.lit(cfg.daily_budget) - total, F.lit(0.0))).alias("remaining"))
