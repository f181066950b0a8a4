"""Model versions as an append-only event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonetide.functions import text as T
from zonetide.functions.numeric import round_even
from zonetide.functions.scoring import psi_level

METRICS = ("precision", "recall", "f1", "roc_auc")
KEEP_PREVIOUS = 2


def current_versions(events: DataFrame) -> DataFrame:
    """Newest status per version with its last known times and metrics.

    ``events``: version_id, status, at, seq, trained_at, promoted_at and metric columns. The keyed
    maximum combines on the map side.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("at", "seq")))
    return events.groupBy("version_id").agg(
        F.max_by("status", F.struct("at", "seq")).alias("status"),
        *[last(c).alias(c) for c in ("trained_at", "promoted_at", *METRICS)])


def is_stale(metrics=METRICS) -> Column:
    """A candidate with no usable metric at all."""
    blank = F.lit(True)
    for m in metrics:
        blank = blank & (F.coalesce(F.col(m).cast("string").try_cast("double"), F.lit(0.0)) <= 0.0)
    return blank


def recency() -> Column:
    """When a version last mattered: the later of training and promotion."""
    floor = F.lit("0001-01-01 00:00:00").cast("timestamp")
    return F.greatest(F.coalesce(F.col("promoted_at").cast("timestamp"), floor),
                      F.coalesce(F.col("trained_at").cast("timestamp"), floor))


def _removable(versions: DataFrame, candidate: Column, keep_previous: int) -> DataFrame:
    """Versions with a flag for stale candidates and for previous ones beyond the kept lineage."""
    kept = (versions.filter(F.col("status") == "previous")
            .orderBy(recency().desc(), F.col("version_id").desc()).limit(keep_previous)
            .select("version_id", F.lit(True).alias("_kept")))
    return versions.join(kept, "version_id", "left").withColumn("removable", F.when(
        F.col("status") == "candidate", is_stale() & ~F.coalesce(F.col("version_id") == candidate, F.lit(False)))
        .when(F.col("status") == "previous", F.col("_kept").isNull()).otherwise(False)).drop("_kept")


def newest_candidate(versions: DataFrame) -> Column:
    """The candidate under evaluation: the latest trained one."""
    return versions.filter(F.col("status") == "candidate").agg(
        F.max_by("version_id", F.struct(recency(), "version_id"))).scalar()


def lineage(versions: DataFrame, keep_previous: int = KEEP_PREVIOUS, candidate: Column | None = None) -> DataFrame:
    """Versions worth showing, newest first."""
    under_test = newest_candidate(versions) if candidate is None else candidate
    shown = _removable(versions, under_test, keep_previous).filter(~F.col("removable")).drop("removable")
    return shown.orderBy(recency().desc(), F.col("version_id").desc())


def prunable(versions: DataFrame, keep_previous: int = KEEP_PREVIOUS, candidate: Column | None = None) -> DataFrame:
    """Versions that may be deleted."""
    under_test = newest_candidate(versions) if candidate is None else candidate
    return _removable(versions, under_test, keep_previous).filter("removable").select("version_id", "status")


def active_version(versions: DataFrame) -> DataFrame:
    return versions.filter(F.col("status") == "active")


def rollback_target(versions: DataFrame) -> DataFrame:
    """The newest previous version (by time, not by name)."""
    return (versions.filter(F.col("status") == "previous")
            .orderBy(recency().desc(), F.col("version_id").desc()).limit(1))


def register_event(spark, version_id: str, at: str, metrics: dict, seq: int = 0) -> DataFrame:
    """The event row a new candidate adds."""
    return _event(spark, version_id, "candidate", at, seq, trained_at=at, metrics=metrics)


def _event(spark, version_id, status, at, seq, trained_at=None, promoted_at=None, metrics=None) -> DataFrame:
    values = [F.lit(version_id).alias("version_id"), F.lit(status).alias("status"),
              F.lit(at).cast("timestamp").alias("at"), F.lit(seq).alias("seq"),
              F.lit(trained_at).cast("timestamp").alias("trained_at"), F.lit(promoted_at).cast("timestamp").alias("promoted_at")]
    values += [F.lit((metrics or {}).get(m)).cast("double").alias(m) for m in METRICS]
    return spark.range(1).select(*values)


def _status_events(rows: DataFrame, status: str, at: Column, seq: int, promoted: bool) -> DataFrame:
    return rows.select("version_id", F.lit(status).alias("status"), at.alias("at"), F.lit(seq).alias("seq"),
                       F.lit(None).cast("timestamp").alias("trained_at"),
                       (at if promoted else F.lit(None)).cast("timestamp").alias("promoted_at"),
                       *[F.lit(None).cast("double").alias(m) for m in METRICS])


def promote_events(versions: DataFrame, version_id: str, at: Column) -> DataFrame:
    """Events of a promotion: the active version steps back, the candidate becomes active."""
    known = versions.filter(F.col("version_id") == version_id)
    old = active_version(versions).filter((F.col("version_id") != version_id) & (known.agg(F.count("*")).scalar() > 0))
    return _status_events(old, "previous", at, 0, False).unionByName(_status_events(known, "active", at, 1, True))


def rollback_events(versions: DataFrame, at: Column) -> DataFrame:
    """Events of a rollback; none when there is nothing to go back to."""
    target = rollback_target(versions)
    old = active_version(versions).filter(target.agg(F.count("*")).scalar() > 0)
    return _status_events(old, "rolled_back", at, 0, False).unionByName(_status_events(target, "active", at, 1, True))


def rollback_audit(judged: DataFrame, versions: DataFrame, now: Column) -> DataFrame:
    """Audit rows for runs that call for a rollback: what was left, what was gone back to, and why.

    ``judged`` has run_id, model_version, should_rollback and rollback_reason. Without a previous
    version the attempt is recorded as failed.
    """
    target = rollback_target(versions).select("version_id").scalar()
    # Event names and wording.
    return judged.filter("should_rollback").select(
        F.when(target.isNotNull(), "rollback").otherwise("rollback_failed").alias("event"),
        F.coalesce("model_version", F.lit("unknown")).alias("from_version"), target.alias("to_version"),
        F.when(target.isNotNull(), F.col("rollback_reason")).otherwise(
            "rollback attempted but failed: No previous stable version to roll back to").alias("reason"),
        "run_id", now.alias("timestamp"))


def rollback_alerts(audit: DataFrame) -> DataFrame:
    """The alert beside each audit row."""
    done = F.col("event") == "rollback"
    # Alert wording.
    text = F.when(done, F.format_string("Model rolled back: %s → %s. Reason: %s", "from_version", "to_version", "reason")).otherwise(
        F.format_string("Rollback failed for %s: %s", "from_version", F.regexp_replace("reason", "^rollback attempted but failed: ", "")))
    return audit.select(F.when(done, "ROLLBACK_OCCURRED").otherwise("ROLLBACK_FAILED").alias("alert_id"), F.lit("high").alias("severity"),
                        text.alias("message"), F.lit(None).cast("int").alias("zone_id"), F.col("timestamp").alias("created_at"))


def compare_versions(candidate: DataFrame, active: DataFrame, metrics=METRICS, worst: float = -0.05) -> DataFrame:
    """Candidate against active per metric; a relative loss of more than 5 % is a regression."""
    tall = lambda df, name: df.select([F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in metrics]) \
        .unpivot([], list(metrics), "metric", name)
    both = tall(candidate, "candidate").join(tall(active, "active"), "metric")
    delta = F.col("candidate") - F.col("active")
    lost = F.when(F.col("active") > 0, delta / F.col("active") < worst).otherwise(False)
    return both.select("metric", "candidate", "active", round_even(delta).alias("delta"), lost.alias("regressed"))


def removed_features(active: DataFrame, candidate: DataFrame) -> DataFrame:
    """Feature names the candidate no longer has (new ones are fine)."""
    return active.select("feature").distinct().join(candidate.select("feature"), "feature", "left_anti")


def gate(candidate: DataFrame, active: DataFrame, removed: DataFrame, stability: DataFrame,
         min_f1: float = 0.50, min_auc: float = 0.65, max_ratio: float = 3.0) -> DataFrame:
    """Promotion verdict per candidate row: each check, the verdict and the reasons.

    ``stability`` has one row: candidate_std, active_std, lowest, highest, n_scored, n_rows.
    """
    f1, auc = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("f1", "roc_auc"))
    worse = F.coalesce(compare_versions(candidate, active).agg(F.bool_or("regressed")).scalar(), F.lit(False))
    gone = F.coalesce(removed.agg(F.array_join(F.sort_array(F.collect_set("feature")), ", ")).scalar(), F.lit(""))
    stat = stability.select(F.struct("candidate_std", "active_std", "lowest", "highest", "n_scored", "n_rows")).scalar()
    checked = candidate.withColumns({
        "performance_ok": (f1 >= min_f1) & (auc >= min_auc), "regression_ok": ~worse, "schema_ok": gone == "",
        "integration_ok": (stat["n_scored"] == stat["n_rows"]) & (stat["lowest"] >= 0) & (stat["highest"] <= 1),
        "stability_ok": F.coalesce((stat["active_std"] == 0) | (stat["candidate_std"] / F.nullif(
            stat["active_std"], F.lit(0.0)) <= max_ratio), F.lit(True))})
    names = ("performance_ok", "regression_ok", "schema_ok", "integration_ok", "stability_ok")
    passed = F.lit(True)
    for n in names:
        passed = passed & F.coalesce(F.col(n), F.lit(False))
    # Reason wording.
    why = F.concat_ws(
        "; ",
        F.when(~F.col("performance_ok"), F.format_string(
            f"performance below threshold (F1=%.3f min={min_f1}, AUC=%.3f min={min_auc})", round_even(f1, 3), round_even(auc, 3))),
        F.when(~F.col("regression_ok"), "metric regression > 5% vs active model"),
        F.when(~F.col("schema_ok"), F.concat(F.lit("schema regression: features removed="), gone)),
        F.when(~F.coalesce(F.col("integration_ok"), F.lit(False)), "integration test failed: predictions outside [0, 1] or missing"),
        F.when(~F.col("stability_ok"), f"stability check failed: variance ratio > {max_ratio}"))
    return checked.select("version_id", *names, passed.alias("passed"),
                          F.when(why == "", "all checks passed").otherwise(why).alias("reason"))


def model_impact(drift: DataFrame, versions: DataFrame, now: Column) -> DataFrame:
    """Drift and metrics of the active model in words, with the lineage as an array, one row."""
    active = active_version(versions)
    row = active.select(F.struct("version_id", "precision", "recall", "f1", "trained_at")).limit(1).scalar()
    at = {c: row[c] for c in ("version_id", "precision", "recall", "f1", "trained_at")}
    entry = F.struct("trained_at", "version_id", "status", "f1", "roc_auc")
    # The lineage is short by construction: active, candidate, two previous.
    tree = lineage(versions).agg(F.sort_array(F.collect_list(entry), asc=False)).scalar()
    newest = F.coalesce(drift.select("psi").limit(1).scalar(), F.lit(0.0))
    base = drift.sparkSession.range(1).select(
        at["version_id"].alias("active_version"), newest.alias("psi"), at["precision"].alias("precision"),
        at["recall"].alias("recall"), at["f1"].alias("f1"), at["trained_at"].alias("trained_at"), tree.alias("version_lineage"))
    return base.select(
        "active_version", round_even("psi").alias("psi"), psi_level("psi").alias("psi_level"),
        T.psi_impact("psi", "precision").alias("psi_business_impact"), "precision", "recall", "f1",
        T.false_positive_note("precision").alias("estimated_false_positive_note"), "version_lineage",
        T.model_advice("psi", "f1", "trained_at", now).alias("recommendation"))


def model_status(versions: DataFrame) -> DataFrame:
    """Active version beside the candidate under test, one row even when there is neither."""
    active, candidate = active_version(versions), versions.filter(F.col("version_id") == newest_candidate(versions))
    a = active.select(F.struct("version_id", "promoted_at", "trained_at", *METRICS)).limit(1).scalar()
    c = candidate.select(F.struct("version_id", "f1", "roc_auc")).limit(1).scalar()
    return versions.sparkSession.range(1).select(
        a["version_id"].alias("active_version"), a["promoted_at"].alias("promoted_at"),
        a["trained_at"].alias("last_retrained_at"), *[a[m].alias(m) for m in METRICS],
        c["version_id"].alias("candidate_version"), c["f1"].alias("candidate_f1"), c["roc_auc"].alias("candidate_roc_auc"))
