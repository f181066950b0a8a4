"""Splits, sampling and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonetide import settings as S
from zonetide.functions.numeric import round_even
from zonetide.learning import models as ML
from zonetide.learning import neighbours as NN
from zonetide.learning import sampling as SA
from zonetide.learning import splits as SP
from zonetide.operators import features as FT
from zonetide.operators import metrics as M
from zonetide.plans import proxies as P
from zonetide.plans import sql as Q
from zonetide.plans.catalogue import query
from zonetide.session import use_utc, written
from zonetide.sources.readers import table


def _u(key: str, seed: int = 0) -> str:
    return f"(CAST('0x' || left(md5('{seed}|' || CAST({key} AS VARCHAR)), 13) AS BIGINT) / {float(16 ** 13):.1f}::DOUBLE)"


@query("Q-04", Q.with_(Q.COUNTS) + """SELECT zone_id, timestamp, epoch(timestamp) / 3600 <= (SELECT quantile_cont(epoch(timestamp) / 3600, 0.8) FROM zc) AS is_train FROM zc""")
def time_split(spark, folder):
    return SP.time_split(P.zone_counts(spark, folder)).select("zone_id", "timestamp", "is_train")


@query("Q-04 V-04", Q.with_(Q.COUNTS) + """SELECT zone_id, timestamp, row_number() OVER (ORDER BY zone_id, timestamp) <= (SELECT count(*) - ceil(count(*) * 0.2::DOUBLE) FROM zc) AS is_train FROM zc""")
def positional_split(spark, folder):
    return SP.positional_split(P.zone_counts(spark, folder)).select("zone_id", "timestamp", "is_train")


@query("Q-05", f"""SELECT doc_id, quality, u >= quantile_cont(u, 0.2) OVER (PARTITION BY quality) AS is_train FROM (SELECT *, {_u('doc_id')} AS u FROM labels)""")
def stratified_split(spark, folder):
    return SP.stratified_split(table(use_utc(spark), folder, "labels"), "quality", ["doc_id"]).select("doc_id", "quality", "is_train")


@query("Q-06", "SELECT doc_id, quality, CAST(" + " + ".join(f"CAST(u >= quantile_cont(u, {i / 5}) OVER (PARTITION BY quality) AS INTEGER)" for i in range(1, 5))
       + f" AS INTEGER) AS fold FROM (SELECT *, {_u('doc_id')} AS u FROM labels)")
def stratified_folds(spark, folder):
    return SP.stratified_folds(table(use_utc(spark), folder, "labels"), "quality", ["doc_id"]).select("doc_id", "quality", "fold")


_RATIO = "(SELECT count(*) FILTER (WHERE toxic = 0) / greatest(count(*) FILTER (WHERE toxic = 1), 1) FROM labels)"


@query("Q-09", f"""SELECT doc_id, toxic, CAST(unnest(generate_series(1, CAST(CASE WHEN toxic = 1 THEN greatest(floor({_RATIO} + {_u('doc_id')}), 1) ELSE 1 END AS BIGINT))) AS INTEGER) AS copy FROM labels""")
def oversample(spark, folder):
    return SA.oversample(table(use_utc(spark), folder, "labels"), "toxic", ["doc_id"]).select("doc_id", "toxic", "copy")


@query("Q-09", f"SELECT doc_id, toxic FROM labels WHERE toxic = 1 OR {_u('doc_id')} < 1.0::DOUBLE / {_RATIO}")
def undersample(spark, folder):
    return SA.undersample(table(use_utc(spark), folder, "labels"), "toxic", ["doc_id"]).select("doc_id", "toxic")


@query("Q-13", f"""SELECT doc_id, {Q.r("CASE WHEN toxic = 1 THEN n / (2.0::DOUBLE * p) ELSE n / (2.0::DOUBLE * (n - p)) END")} AS weight FROM labels,
  (SELECT count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS p FROM labels)""")
def class_weights(spark, folder):
    return SA.balanced_weights(table(use_utc(spark), folder, "labels"), "toxic").select("doc_id", round_even("weight").alias("weight"))


_X = tuple(f"x{i}" for i in range(64))


def spots(spark, folder):
    """Embeddings as rows of all their 64 dimensions; one label is the minority."""
    v = table(use_utc(spark), folder, "embeddings")
    return v.select("vec_id", (F.col("label") == 1).cast("int").alias("y"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(_X)])


_SPOTS = """spots AS (SELECT vec_id, CAST(label = 1 AS INTEGER) AS y, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (SELECT a.vec_id, b.vec_id AS neighbour, a.y, b.y AS other, list_distance(a.v, b.v) AS d FROM spots a JOIN spots b ON a.vec_id <> b.vec_id)"""


@query("Q-10", Q.with_(_SPOTS) + """SELECT vec_id, neighbour, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour) AS place FROM pairs) WHERE place <= 5""")
def nearest_neighbours(spark, folder):
    return NN.nearest_neighbours(spots(spark, folder), "vec_id", list(_X), 5).select("vec_id", "neighbour", "place")


@query("Q-10", Q.with_(_SPOTS) + """SELECT a.vec_id, a.neighbour FROM (SELECT vec_id, arg_min(neighbour, {'d': d, 'n': neighbour}) AS neighbour, arg_min(other, {'d': d, 'n': neighbour}) AS other, any_value(y) AS y FROM pairs GROUP BY 1) a
  JOIN (SELECT vec_id, arg_min(neighbour, {'d': d, 'n': neighbour}) AS neighbour FROM pairs GROUP BY 1) b ON b.vec_id = a.neighbour AND b.neighbour = a.vec_id WHERE a.y <> a.other""")
def tomek_links(spark, folder):
    return SA.tomek_links(spots(spark, folder), "y", "vec_id", list(_X))


_DRAW = lambda seed, *keys: _u(" || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys), seed)
#: Positives, their five nearest positives, and the rows made between them.
_MADE = _SPOTS + f""",
near AS (SELECT p.vec_id, row_number() OVER (PARTITION BY p.vec_id ORDER BY p.d, p.neighbour) AS place, o.v AS o FROM pairs p JOIN spots o ON o.vec_id = p.neighbour WHERE p.y = 1 AND p.other = 1),
extra AS (SELECT s.*, (SELECT count(*) FILTER (WHERE y = 0) / greatest(count(*) FILTER (WHERE y = 1), 1) FROM spots) AS ratio FROM spots s WHERE y = 1),
copies AS (SELECT *, CAST(unnest(generate_series(1, CAST(floor(ratio - 1.0::DOUBLE + {_DRAW(0, "vec_id")}) AS BIGINT))) AS INTEGER) AS copy FROM extra),
drawn AS (SELECT *, CAST(floor({_DRAW(1, "vec_id", "copy")} * (SELECT count(*) FROM near n WHERE n.vec_id = c.vec_id AND place <= 5)) AS BIGINT) + 1 AS pick, {_DRAW(2, "vec_id", "copy")} AS t FROM copies c),
made AS (SELECT vec_id, y, v, 0 AS copy, false AS synthetic FROM spots UNION ALL
  SELECT d.vec_id, d.y, list_transform(generate_series(1, 64), lambda i: d.v[i] + d.t * (n.o[i] - d.v[i])), copy, true FROM drawn d JOIN near n ON n.vec_id = d.vec_id AND n.place = d.pick)"""
_WIDE = "vec_id, y, copy, synthetic, " + ", ".join(f"v[{i + 1}] AS {c}" for i, c in enumerate(_X))


@query("Q-10", Q.with_(_MADE) + f"SELECT {_WIDE} FROM made")
def smote(spark, folder):
    return SA.smote(spots(spark, folder), "y", "vec_id", list(_X))


@query("Q-10", Q.with_(_MADE, """numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id, copy) AS r FROM made),
nearest AS MATERIALIZED (SELECT a.r, any_value(a.y) AS y, arg_min(b.r, list_distance(a.v, b.v)) AS near, arg_min(b.y, list_distance(a.v, b.v)) AS other FROM numbered a JOIN numbered b ON a.r <> b.r GROUP BY a.r)""")
       + f"SELECT {_WIDE} FROM numbered WHERE r NOT IN (SELECT a.r FROM nearest a JOIN nearest b ON a.near = b.r AND b.near = a.r WHERE a.y <> b.y)")
def smote_tomek(spark, folder):
    return SA.smote_tomek(spots(spark, folder), "y", "vec_id", list(_X))


def _training(spark, folder):
    """Features with the next-hour label and a time split, stored because fitting reads them many times."""
    rows = FT.next_hour_label(P.features(spark, folder, congestion=True))
    wanted = FT.model_columns(rows, S.MODEL_FEATURES)
    split = SP.time_split(rows)
    return written(split.select("zone_id", "timestamp", "supply_shortage", "is_train", *wanted), "training"), wanted


@query("Q-01 Q-14 A-26")
def ml_gbt_scores(spark, folder):
    rows, wanted = _training(spark, folder)
    _, held = ML.train(rows, wanted, "supply_shortage", estimator=ML.gradient_boosting(validation=ML.VALIDATION))
    return held.select("zone_id", "timestamp", "label", round_even("p").alias("p"))


@query("Q-02 A-26 A-27")
def ml_tree_metrics(spark, folder):
    rows, wanted = _training(spark, folder)
    _, held = ML.train(rows, wanted, "supply_shortage", estimator=ML.decision_tree())
    return M.evaluate(held, "label")


@query("Q-03 Q-17")
def forest_importance(spark, folder):
    rows, wanted = _training(spark, folder)
    model, _ = ML.train(rows, wanted, "supply_shortage", estimator=ML.random_forest())
    return ML.selected_features(model, wanted, spark)


#: Each score's fitted value is the largest, over all places up to it, of the smallest mean from there to a place behind it.
_ISOTONIC = f"""pts AS (SELECT f, l, w, row_number() OVER (ORDER BY f) AS i, sum(l) OVER (ORDER BY f) AS s, sum(w) OVER (ORDER BY f) AS n
  FROM (SELECT {Q.r('p')} AS f, CAST(sum(y) AS DOUBLE) AS l, CAST(count(*) AS DOUBLE) AS w FROM lab GROUP BY 1)),
means AS (SELECT a.i AS a, b.i AS b, b.w, (b.s - a.s + a.l) / (b.n - a.n + a.w) AS mean FROM pts a JOIN pts b ON b.i >= a.i),
lowest AS (SELECT b AS i, w, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS v FROM means)"""


@query("Q-12", Q.with_(Q.LABELLED, _ISOTONIC) + f"""SELECT {Q.r('v')} AS calibrated, CAST(sum(w) AS BIGINT) AS n
  FROM (SELECT i, any_value(w) AS w, max(v) AS v FROM lowest GROUP BY i) GROUP BY 1""")
def isotonic_fit(spark, folder):
    _, out = ML.isotonic(P.labelled(spark, folder))
    return out.groupBy(round_even("calibrated").alias("calibrated")).agg(F.count(F.lit(1)).alias("n"))


@query("Q-06")
def cross_validation_auc(spark, folder):
    rows, wanted = _training(spark, folder)
    return ML.cross_validated(rows, wanted, "supply_shortage", ["zone_id", "timestamp"], ML.decision_tree())


@query("Q-18")
def model_search(spark, folder):
    """Tree and linear families in three rounds over five folds, at the cost of sixty fits on all rows at most."""
    rows, wanted = _training(spark, folder)
    return ML.model_search(rows, wanted, "supply_shortage", ["zone_id", "timestamp"], candidates=ML.families(trees=10))


@query("Q-15")
def learning_curve(spark, folder):
    rows, wanted = _training(spark, folder)
    return ML.learning_curve(rows, wanted, "supply_shortage", ["zone_id", "timestamp"])


@query("Q-16")
def strategy_comparison(spark, folder):
    rows = spots(spark, folder).withColumn("is_train", F.col("vec_id") % 5 != 0)
    return ML.compare_strategies(rows, list(_X), "y", "vec_id", estimator=ML.decision_tree())


@query("Q-07", " UNION ALL ".join(f"SELECT vec_id, '{c}' AS feature, {Q.r(f'(CAST(embedding[{i + 1}] AS DOUBLE) - avg(CAST(embedding[{i + 1}] AS DOUBLE)) OVER ()) / stddev_samp(CAST(embedding[{i + 1}] AS DOUBLE)) OVER ()')} AS scaled FROM embeddings"
                                  for i, c in enumerate(_X)))
def scaled_features(spark, folder):
    rows = ML.assembled(spots(spark, folder), list(_X))
    out = ML.scaler().fit(rows).transform(rows)
    from pyspark.ml.functions import vector_to_array

    wide = out.select("vec_id", *[vector_to_array("scaled")[i].alias(c) for i, c in enumerate(_X)])
    return wide.unpivot(["vec_id"], list(_X), "feature", "v").select("vec_id", "feature", round_even("v").alias("scaled"))


@query("Q-08", """SELECT event_id, event_type, CAST(e AS INTEGER) AS hot FROM (SELECT event_id, event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS e FROM events)""")
def one_hot_events(spark, folder):
    from pyspark.ml.functions import vector_to_array

    e = table(use_utc(spark), folder, "events").select("event_id", "event_type")
    out = ML.one_hot(["event_type"]).fit(e).transform(e)
    return out.select("event_id", "event_type", (F.array_position(vector_to_array("event_type_onehot"), F.lit(1.0)) - 1).cast("int").alias("hot"))
