"""Following recommendations up: resolution, feedback, effectiveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonetide import settings as S
from zonetide.functions import scoring as X
from zonetide.functions.numeric import count_where, label_of, round_even, share

FOLLOW_STATES = ("followed", "not_followed")


def resolve(issued: DataFrame, current: DataFrame, now: Column, score: str = "delay_risk_score") -> DataFrame:
    """Outcomes of open records that are due and whose zone has a current score.

    ``current`` may hold many rows per zone; the last one counts. Zones without a score stay open.
    """
    latest = current.groupBy("zone_id").agg(
        F.max_by(F.struct(F.col(score).alias("score"), F.col("taxi_count").alias("supply")), "timestamp").alias("_c"))
    due = issued.filter(F.col("check_after") <= now)
    joined = due.join(latest, "zone_id")
    return joined.select(
        *[c for c in issued.columns if c not in ("outcome", "score_after")],
        X.outcome_class("score_at_time", F.col("_c.score")).alias("outcome"),
        round_even(F.col("_c.score")).alias("score_after"),
        F.col("_c.supply").cast("int").alias("supply_after_30m"),
        (F.col("_c.supply") - F.coalesce("supply_at_time", F.lit(0))).cast("int").alias("supply_delta_30m"))


def unresolved(issued: DataFrame, resolved: DataFrame) -> DataFrame:
    return issued.join(resolved.select("recommendation_id"), "recommendation_id", "left_anti")


def checked_feedback(feedback: DataFrame) -> DataFrame:
    """Feedback rows with a valid status, lowered and trimmed."""
    status = F.lower(F.trim("followed_status"))
    return feedback.withColumn("followed_status", status).filter(F.col("followed_status").isin(*FOLLOW_STATES))


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """Newest feedback per recommendation. A keyed max combines on the map side, however often one card is marked."""
    newest = F.max_by(F.struct("followed_status", "followed_at", "followed_by", "follow_note"),
                      F.struct("followed_at", "followed_status"))
    return (checked_feedback(feedback).groupBy("recommendation_id").agg(newest.alias("f"))
            .select("recommendation_id", "f.*"))


def with_feedback(records: DataFrame, feedback: DataFrame) -> DataFrame:
    """Every matching record takes the newest feedback."""
    return records.drop("followed_status", "followed_at", "followed_by", "follow_note").join(
        latest_feedback(feedback), "recommendation_id", "left")


def recent_records(records: DataFrame, days: int | None = None, ts: str = "logged_at") -> DataFrame:
    """The report window: records less than ``days`` older than the newest one; all records without ``days``."""
    if days is None:
        return records
    return records.filter(F.col(ts) > records.agg(F.max(ts)).scalar() - F.make_interval(days=F.lit(days)))


_MEANS = ("delta", "supply", "cost")
_COUNTS = ("total", "resolved", "_followed", "_known", "followed_resolved", "unfollowed_resolved",
           *[f"_{t}_{c}" for t in "fr" for c in ("rec", "imp", *[f"{m}_n" for m in _MEANS])])
_SUMS = tuple(f"_{t}_{m}_sum" for t in "fr" for m in _MEANS)


def _effect_sums() -> list[Column]:
    """Counts and sums only, so that partial results can be added up again.

    Scores and money have few decimals; as decimals they add up without rounding noise.
    """
    done = F.col("outcome").isNotNull()
    followed = F.coalesce(F.col("followed_status") == "followed", F.lit(False))
    skipped = F.coalesce(F.col("followed_status") == "not_followed", F.lit(False))
    sums = [F.count(F.lit(1)).alias("total"), count_where(done).alias("resolved"),
            count_where(followed).alias("_followed"), count_where(followed | skipped).alias("_known"),
            count_where(done & followed).alias("followed_resolved"),
            count_where(done & skipped).alias("unfollowed_resolved")]
    sources = dict(zip(_MEANS, ("_delta", "supply_delta_30m", "estimated_cost_sgd")))
    for tag, rows in (("f", done & followed), ("r", done)):
        sums += [count_where(rows & (F.col("outcome") == "recovered")).alias(f"_{tag}_rec"),
                 count_where(rows & F.col("outcome").isin("recovered", "improved")).alias(f"_{tag}_imp")]
        for name, source in sources.items():
            v = F.when(rows, F.col(source))
            sums += [F.count(v).alias(f"_{tag}_{name}_n"), F.sum(v.cast("decimal(18,6)")).alias(f"_{tag}_{name}_sum")]
    return sums


def _added_up() -> list[Column]:
    """Totals of partial counts and sums."""
    return [F.sum(c).alias(c) for c in (*_COUNTS, *_SUMS)]


def _prepared(records: DataFrame) -> DataFrame:
    cols = {"_delta": F.col("score_after").cast("decimal(18,6)") - F.col("score_at_time").cast("decimal(18,6)")}
    for missing in ("supply_delta_30m", "estimated_cost_sgd"):
        if missing not in records.columns:
            cols[missing] = F.lit(None).cast("double")
    return records.withColumns(cols)


EFFECT_COLUMNS = (
    "total", "resolved", "follow_rate", "followed_resolved", "unfollowed_resolved", "recovery_rate",
    "improvement_rate", "estimated_score_delta", "expected_supply_response_30m", "avg_estimated_cost_sgd",
    "expected_roi", "confidence_band")


def _finished(summed: DataFrame, keys: list[str]) -> DataFrame:
    """Smoothed rates and expected return; followed outcomes count alone when there are any."""
    use_followed = F.col("followed_resolved") > 0

    def pick(name: str) -> Column:
        return F.when(use_followed, F.col(f"_f_{name}")).otherwise(F.col(f"_r_{name}"))

    def mean(name: str) -> Column:
        return F.coalesce(pick(f"{name}_sum").cast("double") / F.nullif(pick(f"{name}_n"), F.lit(0)), F.lit(0.0))

    n = F.when(use_followed, F.col("followed_resolved")).otherwise(F.col("resolved"))
    smooth = lambda hits: F.when(n > 0, (hits + F.lit(1)) / (n + F.lit(2))).otherwise(F.lit(0.0))
    df = summed.withColumns({"_n": n, "_rr": smooth(pick("rec")), "_ir": smooth(pick("imp")),
                             "_d": mean("delta"), "_s": mean("supply"), "_c": mean("cost")})
    benefit = (F.col("_rr") * F.lit(2.0) + F.col("_ir") + F.greatest(F.col("_s"), F.lit(0.0)) * F.lit(0.1)
               + F.greatest(-F.col("_d"), F.lit(0.0)) * F.lit(5.0))
    return df.withColumns({
        "follow_rate": share("_followed", "_known"), "recovery_rate": round_even("_rr"),
        "improvement_rate": round_even("_ir"), "estimated_score_delta": round_even("_d"),
        "expected_supply_response_30m": round_even("_s"), "avg_estimated_cost_sgd": round_even("_c"),
        "expected_roi": round_even(F.when(F.col("_c") > 0, benefit / F.col("_c")).otherwise(benefit)),
        "confidence_band": X.confidence_band("_n")}).select(*keys, *EFFECT_COLUMNS)


def effectiveness(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Outcome statistics per key set (or over everything). One conditional aggregation."""
    keys = keys or []
    return _finished(_prepared(records).groupBy(*keys).agg(*_effect_sums()), keys)


def effectiveness_by_action(records: DataFrame) -> DataFrame:
    return effectiveness(records.withColumn("action_type", F.coalesce("action_type", F.lit("unknown"))), ["action_type"])


def effectiveness_by_follow_status(records: DataFrame) -> DataFrame:
    state = F.when(F.col("followed_status").isin(*FOLLOW_STATES), F.col("followed_status")).otherwise("unknown")
    return effectiveness(records.withColumn("follow_state", state), ["follow_state"])


CONTEXT = ("action_type", "risk_level", "root_cause", "intervention_window")


def top_contexts(records: DataFrame, n: int = 6) -> DataFrame:
    """Contexts with the most resolved outcomes, then the best improvement."""
    labelled = records.filter(F.col("outcome").isNotNull()).withColumns({c: label_of(c) for c in CONTEXT})
    stats = effectiveness(labelled, list(CONTEXT)).filter(F.col("resolved") > 0)
    return (stats.orderBy(F.col("resolved").desc(), F.col("improvement_rate").desc(), *CONTEXT).limit(n)
            .select(*CONTEXT, "resolved", "recovery_rate", "improvement_rate", "confidence_band"))


def zone_interventions(records: DataFrame, n: int = 10) -> DataFrame:
    """Zones with the most resolved interventions."""
    named = records.filter(F.col("outcome").isNotNull() & (F.col("zone_id") >= 0)).withColumn(
        "zone_name", label_of("zone_name", ""))
    named = named.withColumn("zone_name", F.when(F.col("zone_name") == "", F.col("zone_id").cast("string"))
                             .otherwise(F.col("zone_name")))
    counted = named.groupBy("zone_id", "zone_name").agg(
        F.count(F.lit(1)).alias("interventions"), count_where(F.col("outcome") == "recovered").alias("_rec"))
    return (counted.withColumn("recovery_rate", share("_rec", "interventions")).drop("_rec")
            .orderBy(F.col("interventions").desc(), "zone_id", "zone_name").limit(n))


def outcome_rates(records: DataFrame) -> DataFrame:
    """Logged and resolved counts with recovery, improvement and worsening rates, one row."""
    o = F.col("outcome")
    counted = records.agg(
        F.count(F.lit(1)).alias("total_logged"), F.count(o).alias("total_resolved"),
        count_where(o == "recovered").alias("_rec"), count_where(o.isin("recovered", "improved")).alias("_imp"),
        count_where(o == "worsened").alias("_bad"))
    return counted.select("total_logged", "total_resolved", share("_rec", "total_resolved").alias("recovery_rate"),
                          share("_imp", "total_resolved").alias("improvement_rate"),
                          share("_bad", "total_resolved").alias("worsened_rate"))


def outcome_counts(records: DataFrame, days: int | None = None,
                   outcomes=("recovered", "improved", "unchanged", "worsened")) -> DataFrame:
    """Resolved outcomes per action as columns, of all records or of the last ``days``."""
    window = recent_records(records, days)
    done = window.filter(F.col("outcome").isNotNull()).withColumn("action_type", F.coalesce("action_type", F.lit("unknown")))
    return done.groupBy("action_type").pivot("outcome", list(outcomes)).agg(F.count(F.lit(1))).fillna(0, list(outcomes))


def recent_outcomes(records: DataFrame, n: int = 20) -> DataFrame:
    """Newest resolved outcomes for display."""
    cols = ["recommendation_id", "zone_id", "action_type", "score_at_time", "score_after", "outcome", "logged_at",
            label_of("followed_status").alias("followed_status")]
    return (records.filter(F.col("outcome").isNotNull())
            .orderBy(F.col("logged_at").desc(), F.col("recommendation_id").asc()).limit(n).select(*cols))


def treatment_gap(records: DataFrame) -> DataFrame:
    """Recovery rates of treatment and holdout and their gap, one row. No bucket counts as treatment."""
    bucket = F.coalesce("evaluation_bucket", F.lit("treatment"))
    treated, held = bucket == "treatment", bucket == "holdout"
    rec = F.coalesce(F.col("outcome") == "recovered", F.lit(False))
    c = records.agg(count_where(treated).alias("treatment_count"), count_where(held).alias("holdout_count"),
                    count_where(treated & rec).alias("_t"), count_where(held & rec).alias("_h"))
    rate = lambda hits, n: F.when(F.col(n) > 0, F.col(hits) / F.col(n)).otherwise(F.lit(0.0))
    t, h = rate("_t", "treatment_count"), rate("_h", "holdout_count")
    return c.select("treatment_count", "holdout_count", round_even(t).alias("treatment_recovery_rate"),
                    round_even(h).alias("holdout_recovery_rate"), round_even(t - h).alias("recovery_rate_gap"))


# --- fallback ladder --------------------------------------------------------

# The ladder from narrow to broad and how each rung is described.
LADDER = (
    (("action_id", "risk_level", "root_cause", "intervention_window", "adjacent_risk_flag"), "exact action variant and context"),
    (("action_id", "risk_level", "root_cause"), "same action variant, risk, and cause"),
    (("action_id", "risk_level"), "same action variant and risk level"),
    (("action_id",), "all historical uses of this exact action variant"),
    (("action_type", "risk_level", "root_cause", "intervention_window", "adjacent_risk_flag"), "exact context"),
    (("action_type", "risk_level", "root_cause", "intervention_window"), "same action, risk, cause, and window"),
    (("action_type", "risk_level", "root_cause"), "same action, risk, and cause"),
    (("action_type", "risk_level"), "same action and risk level"),
    (("action_type",), "all historical uses of this action"),
)
LADDER_KEYS = ("action_id", "action_type", "risk_level", "root_cause", "intervention_window", "adjacent_risk_flag")


def _rungs(df: DataFrame) -> DataFrame:
    """One row per rung: its number and only the keys that rung looks at."""
    kinds = dict(df.dtypes)
    options = [F.struct(F.lit(i).alias("rung"), *[
        (F.col(k) if k in keys else F.lit(None).cast(kinds[k])).alias(f"_k_{k}") for k in LADDER_KEYS])
        for i, (keys, _) in enumerate(LADDER)]
    return df.withColumn("_r", F.explode(F.array(*options))).select("*", "_r.*").drop("_r")


def context_effectiveness(records: DataFrame, contexts: DataFrame, enough: int = S.MIN_EVIDENCE) -> DataFrame:
    """Effectiveness for each context from the narrowest rung with enough resolved outcomes.

    Records are summed once per full context; those few sums are then added up along the nine rungs,
    so the records themselves are neither copied nor read again. Contexts look their rungs up; null
    keys match null keys of the same rung only.
    """
    wanted = contexts.select(*LADDER_KEYS).distinct()
    rung_keys = ["rung", *[f"_k_{k}" for k in LADDER_KEYS]]
    finest = _prepared(records).groupBy(*LADDER_KEYS).agg(*_effect_sums())
    stats = _finished(_rungs(finest).groupBy(*rung_keys).agg(*_added_up()), rung_keys)
    asked = _rungs(wanted).alias("a")
    found = stats.alias("s")
    match = F.col("a.rung") == F.col("s.rung")
    for k in LADDER_KEYS:
        match = match & F.col(f"a._k_{k}").eqNullSafe(F.col(f"s._k_{k}"))
    met = asked.join(found, match, "left")
    order = F.when(F.col("s.resolved") >= enough, F.col("a.rung")).when(F.col("s.total") > 0, F.col("a.rung") + 100)
    best = met.groupBy(*[F.col(f"a.{k}").alias(k) for k in LADDER_KEYS]).agg(
        F.min_by(F.struct(F.col("a.rung").alias("rung"), *[F.col(f"s.{c}").alias(c) for c in EFFECT_COLUMNS]), order).alias("b"))
    reason = None
    for i, (_, words) in enumerate(LADDER):
        reason = F.when(F.col("b.rung") == i, words) if reason is None else reason.when(F.col("b.rung") == i, words)
    seen = F.col("b").isNotNull()
    evidence = F.when(F.col("b.followed_resolved") > 0, F.col("b.followed_resolved")).otherwise(F.col("b.resolved"))
    zeros = {c: F.coalesce(F.col(f"b.{c}"), F.lit("low") if c == "confidence_band" else F.lit(0)) for c in EFFECT_COLUMNS}
    # The two explanation sentences.
    return best.select(
        *LADDER_KEYS, *[v.alias(c) for c, v in zeros.items()],
        F.coalesce(evidence, F.lit(0)).alias("evidence_count"),
        F.when(seen, F.concat(F.lit("Based on "), reason, F.lit("; "), evidence.cast("string"),
                              F.lit(" resolved examples, "), F.col("b.confidence_band"), F.lit(" confidence.")))
        .otherwise("No resolved outcomes for this action yet; using rule-based default.").alias("policy_rank_reason"),
        F.when(seen, F.concat(F.lit("Expected supply response based on "), reason, F.lit(".")))
        .otherwise("No historical supply response yet; using catalog prior.").alias("driver_response_reason"))
