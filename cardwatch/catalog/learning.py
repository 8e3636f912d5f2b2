"""Queries: model features, training sets, splits, models and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardwatch import schemas
from cardwatch.catalog import ingest, reports as Rq  # noqa: F401  (their SQL fragments are used here)
from cardwatch.catalog.base import event_pass, fragment, q6, query, r6, with_
from cardwatch.config import DAY_MS, FeatureWindow
from cardwatch.ml import dataset as D, evaluate as E, models as M
from cardwatch.operators.attempts import per_payment
from cardwatch.operators.features import ENTITY, features
from cardwatch.operators.links import join_observations
from cardwatch.operators.traffic import traffic_context, with_traffic
from cardwatch.session import stage, stage_by
from cardwatch.sources import sinks as S, tables as T

KEY = "scope, entity_kind, entity_key"
FEATS = schemas.FEATURES

_feat_sql = {
    "log_attempts": "ln(1 + attempts::DOUBLE)", "failure_rate": "failures::DOUBLE / attempts", "approval_rate": "approval_rate",
    "infra_share": "shop_infra_failure_share", "cards_per_attempt": "distinct_cards::DOUBLE / attempts", "small_amount_share": "small_amount_share",
    "burstiness": "burstiness", "recovery_rate": "recovery_rate", "top_session_failure_share": "shop_top_session_failure_share",
    "log_failing_sessions": "ln(1 + shop_failing_sessions::DOUBLE)",
}
_feat_cols = ", ".join(f"{r6(e)} AS {n}" for n, e in _feat_sql.items())


@query("ml_features", with_("rules", tail=f"SELECT {KEY}, {_feat_cols} FROM rules"))
def _(spark, sf_dir):
    p = event_pass(spark, sf_dir)
    rows = D.with_features(with_traffic(p.vectors, p.traffic))
    return rows.select(*ENTITY, *[q6(f).alias(f) for f in FEATS])


# Labelled entities of the families (one scope each): abusive families label all their entities.
fragment("lab", ("rules",), """
SELECT *, CASE WHEN scope IN ('f0', 'f1') THEN 1 ELSE 0 END AS is_abuse, scope AS "group" FROM rules""")


def _family_rows(spark, sf_dir):
    p = Rq._family_pass(spark, sf_dir)
    rows = D.with_features(with_traffic(p.vectors, p.traffic)).withColumn("group", F.col("scope"))
    return rows.withColumn("is_abuse", F.col("scope").isin("f0", "f1").cast("int"))


@query("cap_per_class", Rq._by_family(with_("lab", tail=f"""SELECT {KEY}, is_abuse FROM (SELECT *, row_number() OVER (PARTITION BY "group", entity_kind, is_abuse ORDER BY failures DESC, attempts DESC, entity_key) AS n FROM lab)
WHERE n <= CASE WHEN is_abuse = 1 THEN 4 ELSE 8 END""")))
def _(spark, sf_dir):
    return D.cap_per_class(_family_rows(spark, sf_dir)).select(*ENTITY, "is_abuse")


# Composed shops: inside one group, abusive sessions are those with at least half their attempts failed.
_mixed = "CASE WHEN failures * 2 >= attempts THEN 1 ELSE 0 END"


@query("cap_benign_ratio", Rq._by_family(with_("rules", tail=f"""
SELECT {KEY}, is_abuse FROM (SELECT *, row_number() OVER (PARTITION BY scope, is_abuse ORDER BY failures DESC, attempts DESC, entity_key) AS n, sum(is_abuse) OVER (PARTITION BY scope) AS abuse
  FROM (SELECT *, {_mixed} AS is_abuse FROM rules WHERE entity_kind = 'session')) WHERE is_abuse = 1 OR n <= greatest(15, 3 * abuse)""")))
def _(spark, sf_dir):
    rows = _family_rows(spark, sf_dir).filter("entity_kind = 'session'")
    mixed = rows.withColumn("is_abuse", (F.col("failures") * 2 >= F.col("attempts")).cast("int"))
    return D.cap_benign_ratio(mixed).select(*ENTITY, "is_abuse")


@query("ml_training_set", Rq._by_family(with_("lab", tail=f"""SELECT entity_kind, entity_key, is_abuse, "group", "group" AS origin, {_feat_cols} FROM (
  SELECT *, row_number() OVER (PARTITION BY "group", entity_kind, is_abuse ORDER BY failures DESC, attempts DESC, entity_key) AS n FROM lab WHERE entity_kind IN ('session', 'network'))
WHERE n <= CASE WHEN is_abuse = 1 THEN 4 ELSE 8 END""")))
def _(spark, sf_dir):
    rows = D.cap_per_class(_family_rows(spark, sf_dir).filter(F.col("entity_kind").isin("session", "network")))
    return rows.select("entity_kind", "entity_key", "is_abuse", "group", F.col("group").alias("origin"), *[q6(f).alias(f) for f in FEATS])


@query("union_training", Rq._by_family(with_("lab", tail="SELECT \"group\" AS origin, is_abuse, count(*) AS rows_n FROM lab GROUP BY ALL"))
       + " UNION ALL SELECT 'merchant', is_abuse, count(*) FROM (SELECT CASE WHEN best = 'attack' THEN 1 WHEN best = 'healthy_traffic' THEN 0 WHEN status = 'contained' THEN 1 END AS is_abuse FROM ("
       + with_("inc", tail="SELECT * FROM inc WHERE source = 'live'") + ")) WHERE is_abuse IS NOT NULL GROUP BY 2")
def _(spark, sf_dir):
    corpus = _family_rows(spark, sf_dir).withColumn("origin", F.col("group"))
    both = D.union_training(corpus, ingest.labelled_incidents(spark, sf_dir))
    return both.groupBy("origin", "is_abuse").agg(F.count(F.lit(1)).alias("rows_n"))


@query("snk_training", Rq._by_family(with_("lab", tail=f"SELECT \"group\", is_abuse, {_feat_cols} FROM lab")))
def _(spark, sf_dir):
    """Training table written as CSV and read back under its schema."""
    rows = _family_rows(spark, sf_dir).withColumn("origin", F.col("group"))
    for f in FEATS:
        rows = rows.withColumn(f, q6(f))
    path = ingest._folder(spark, "training")
    S.write_training(rows, path)
    return S.read_training(spark, path).select("group", "is_abuse", *FEATS)


@query("src_training_csv", Rq._by_family(with_("lab", tail="SELECT count(*) AS rows_n, TRUE AS same_hash FROM lab")))
def _(spark, sf_dir):
    """Content hash of a training CSV, equal however its rows are laid out."""
    rows = _family_rows(spark, sf_dir).withColumn("origin", F.col("group"))
    path = ingest._folder(spark, "training")
    S.write_training(rows, path)
    read = S.read_training(spark, path)
    a = S.content_hash(read).withColumnsRenamed({"rows": "rows_n", "xor_hash": "x", "sum_hash": "s"})
    b = S.content_hash(read.repartition(5)).withColumnsRenamed({"rows": "rows_n", "xor_hash": "x2", "sum_hash": "s2"})
    return a.join(b, "rows_n").select("rows_n", ((F.col("x") == F.col("x2")) & (F.col("s") == F.col("s2"))).alias("same_hash"))


# --- scored rows: one per checkout session of the line items, with a fixed risk ---------------------

fragment("mlr", ("lines", "checkouts"), """
SELECT *, floor((0.7::DOUBLE * rate + 0.3::DOUBLE * (k % 37)::DOUBLE / 37.0::DOUBLE) * 1e6) / 1e6 AS risk, CASE WHEN failures * 100.0::DOUBLE / attempts + k % 37 > 55 THEN 1 ELSE 0 END AS y FROM (
  SELECT session AS row_id, substr(session, 2)::BIGINT AS k, any_value(network) AS "group", 'o' || (substr(session, 2)::BIGINT % 5) AS origin, count(*) AS attempts,
    count(*) FILTER (WHERE outcome = 'failed') AS failures, (count(*) FILTER (WHERE outcome = 'failed'))::DOUBLE / count(*) AS rate,
    (count(*) FILTER (WHERE l.amount_paise <= 2000000))::DOUBLE / count(*) AS small_amount_share
  FROM lines l JOIN checkouts USING (order_id) GROUP BY session)""")


def _scored(spark, sf_dir):
    rows = join_observations(T.lineitem_events(spark, sf_dir), T.checkout_sessions(spark, sf_dir)).filter(F.col("session").isNotNull())
    g = rows.groupBy(F.col("session").alias("row_id")).agg(
        F.max("network").alias("group"), F.count(F.lit(1)).alias("attempts"), F.sum((F.col("outcome") == "failed").cast("bigint")).alias("failures"),
        F.sum((F.col("amount_paise") <= 2_000_000).cast("bigint")).alias("small"),
    )
    k = F.substring("row_id", 2, 20).cast("bigint")
    rate = F.col("failures").cast("double") / F.col("attempts")
    return g.withColumn("k", k).withColumn("origin", F.concat(F.lit("o"), F.col("k") % 5)).withColumn("rate", rate).withColumn(
        "small_amount_share", F.col("small").cast("double") / F.col("attempts")
    ).withColumn("risk", F.floor((0.7 * F.col("rate") + 0.3 * (F.col("k") % 37).cast("double") / 37.0) * 1e6) / 1e6).withColumn(
        "y", (F.col("failures") * 100.0 / F.col("attempts") + F.col("k") % 37 > 55).cast("int")
    ).withColumn("model", F.lit("fixed"))


def _at(spark, sf_dir, threshold=0.45):
    return _scored(spark, sf_dir).withColumn("threshold", F.lit(threshold))


_split = lambda expr, salt: f"(('0x' || substr(md5('{salt}' || {expr}), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE)"


@query("ml_grouped_split", with_("mlr", tail=f"""SELECT row_id, "group", CASE WHEN {_split('"group"', f'outer{D.SEED}:')} < 0.25 THEN 'test' WHEN {_split('"group"', f'inner{D.SEED}:')} < 0.2 THEN 'validation' ELSE 'train' END AS split FROM mlr"""))
def _(spark, sf_dir):
    return D.grouped_split(_scored(spark, sf_dir)).select("row_id", "group", "split")


@query("ml_naive_split", with_("mlr", tail=f"""SELECT row_id, CASE WHEN {_split('row_id', f'naive{D.SEED}:')} < 0.25 THEN 'test' WHEN {_split('row_id', f'naive{D.SEED}:')} < 0.45 THEN 'validation' ELSE 'train' END AS split FROM mlr"""))
def _(spark, sf_dir):
    return D.naive_split(_scored(spark, sf_dir), F.col("row_id")).select("row_id", "split")


@query("group_overlap", with_("mlr", tail="SELECT 0::BIGINT AS shared_groups"))
def _(spark, sf_dir):
    return D.group_overlap(D.grouped_split(_scored(spark, sf_dir)), "train", "test")


_cost = "sum(CASE WHEN risk < t AND y = 1 THEN 500000 WHEN risk >= t AND y = 0 THEN 80000 ELSE 0 END)"


@query("ml_threshold", with_("mlr", tail=f"""SELECT {r6('t')} AS threshold, cost AS cost_paise FROM (SELECT i, t, {_cost}::BIGINT AS cost FROM mlr, (SELECT i, 0.05::DOUBLE + i * 0.01::DOUBLE AS t FROM range(91) r(i)) GROUP BY i, t) ORDER BY cost, i LIMIT 1"""))
def _(spark, sf_dir):
    return E.cost_threshold(_scored(spark, sf_dir)).select(q6("threshold").alias("threshold"), "cost_paise")


@query("ml_confusion", with_("mlr", tail=f"""SELECT tp, fp, fn, tn, {r6('tp::DOUBLE / (tp + fp)')} AS "precision", {r6('tp::DOUBLE / (tp + fn)')} AS recall, {r6('2.0 * tp / (2 * tp + fp + fn)')} AS f1 FROM (
SELECT count(*) FILTER (WHERE risk >= 0.45 AND y = 1) AS tp, count(*) FILTER (WHERE risk >= 0.45 AND y = 0) AS fp, count(*) FILTER (WHERE risk < 0.45 AND y = 1) AS fn, count(*) FILTER (WHERE risk < 0.45 AND y = 0) AS tn FROM mlr)"""))
def _(spark, sf_dir):
    c = E.confusion(_at(spark, sf_dir))
    return c.select("tp", "fp", "fn", "tn", *[q6(m).alias(m) for m in ("precision", "recall", "f1")])


@query("ml_operating_point", with_("mlr", tail=f"""
SELECT {r6('wrong::DOUBLE / negatives')} AS false_decline_rate, {r6('blocked::DOUBLE / n')} AS block_rate, {r6('take::DOUBLE / n')} AS review_rate,
  {r6('(SELECT min(risk) FROM (SELECT risk, row_number() OVER (ORDER BY risk DESC) AS k FROM mlr WHERE risk < 0.45) WHERE k <= take)')} AS review_threshold FROM (
  SELECT *, least(floor(n * 0.03)::BIGINT, n - blocked) AS take FROM (SELECT count(*) AS n, count(*) FILTER (WHERE y = 0) AS negatives, count(*) FILTER (WHERE risk >= 0.45) AS blocked, count(*) FILTER (WHERE risk >= 0.45 AND y = 0) AS wrong FROM mlr))"""))
def _(spark, sf_dir):
    names = ("false_decline_rate", "block_rate", "review_rate", "review_threshold")
    return E.operating_point(_at(spark, sf_dir)).select(*[q6(n).alias(n) for n in names])


_wil = lambda sign: f"(p + 3.8416 / (2 * n) {sign} 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)"


@query("ml_wilson", with_("mlr", tail=f"SELECT origin, {r6('greatest(0.0, ' + _wil('-') + ')')} AS low, {r6('least(1.0, ' + _wil('+') + ')')} AS high FROM (SELECT origin, count(*)::DOUBLE AS n, sum(y)::DOUBLE / count(*) AS p FROM mlr GROUP BY origin)"))
def _(spark, sf_dir):
    g = _scored(spark, sf_dir).groupBy("origin").agg(F.sum("y").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = E.wilson(F.col("k"), F.col("n"))
    return g.select("origin", q6(low).alias("low"), q6(high).alias("high"))


@query("ml_per_origin", with_("mlr", tail=f"""SELECT origin, count(*) AS n, count(*) FILTER (WHERE risk >= 0.45 AND y = 1) AS flagged, sum(y)::BIGINT AS denominator,
  {r6('(count(*) FILTER (WHERE risk >= 0.45 AND y = 1))::DOUBLE / sum(y)')} AS recall, {r6('(count(*) FILTER (WHERE risk >= 0.45 AND y = 0))::DOUBLE / (count(*) - sum(y))')} AS false_positive_rate, {r6('avg(risk)')} AS mean_risk FROM mlr GROUP BY origin"""))
def _(spark, sf_dir):
    o = E.per_origin(_at(spark, sf_dir))
    return o.select("origin", "n", "flagged", "denominator", *[q6(c).alias(c) for c in ("recall", "false_positive_rate", "mean_risk")])


fragment("ticks", ("mlr",), """
SELECT *, sum(pos) OVER (ORDER BY risk DESC) AS cum_pos, sum(n) OVER (ORDER BY risk DESC) AS cum_n FROM (SELECT risk, sum(y) AS pos, count(*) AS n FROM mlr GROUP BY risk)""")


@query("ml_pr_auc", with_("ticks", tail=f"SELECT {r6('sum(pos * cum_pos::DOUBLE / cum_n) / sum(pos)')} AS pr_auc FROM ticks"))
def _(spark, sf_dir):
    return E.ranking(_scored(spark, sf_dir)).select(q6("pr_auc").alias("pr_auc"))


@query("ml_roc_auc", with_("ticks", tail=f"SELECT {r6('sum((n - pos) * (cum_pos - pos / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * (sum(n) - sum(pos)))')} AS roc_auc FROM ticks"))
def _(spark, sf_dir):
    return E.ranking(_scored(spark, sf_dir)).select(q6("roc_auc").alias("roc_auc"))


@query("ml_brier", with_("mlr", tail=f"SELECT {r6('avg((risk - y) * (risk - y))')} AS brier FROM mlr"))
def _(spark, sf_dir):
    return E.brier(_scored(spark, sf_dir)).select(q6("brier").alias("brier"))


@query("ml_reliability", with_("mlr", tail=f"""
, e AS (SELECT list_sort(list(risk)) AS s, count(*) AS n FROM mlr), cuts AS (SELECT list_transform(range(1, 10), lambda i: s[greatest(ceil(n * (i / 10.0::DOUBLE)), 1)::INT]) AS c FROM e)
SELECT len(list_filter(c, lambda x: risk > x))::INT AS bin, count(*) AS n, {r6('avg(risk)')} AS predicted, {r6('avg(y)')} AS observed FROM mlr, cuts GROUP BY bin"""))
def _(spark, sf_dir):
    r = E.reliability(_scored(spark, sf_dir))
    return r.select("bin", "n", q6("predicted").alias("predicted"), q6("observed").alias("observed"))


@query("ml_error_taxonomy", with_("mlr", tail="""
, e AS (SELECT list_sort(list(small_amount_share)) AS s, count(*) AS n FROM mlr), cuts AS (SELECT s[greatest(ceil(n / 3.0::DOUBLE), 1)::INT] AS a, s[greatest(ceil(n * (2 / 3.0::DOUBLE)), 1)::INT] AS b FROM e)
SELECT CASE WHEN small_amount_share < a THEN 'low' WHEN small_amount_share < b THEN 'mid' ELSE 'high' END AS amount_band, count(*) AS n, count(*) FILTER (WHERE risk >= 0.45 AND y = 0) AS false_positive,
  count(*) FILTER (WHERE risk < 0.45 AND y = 1) AS false_negative FROM mlr, cuts GROUP BY 1"""))
def _(spark, sf_dir):
    return E.error_taxonomy(_at(spark, sf_dir))


@query("ml_bootstrap")
def _(spark, sf_dir):
    return E.bootstrap(_at(spark, sf_dir), F.col("row_id"))


# --- fitted models (no SQL twin) ---------------------------------------------------------------------

_LONG = FeatureWindow(window_ms=20 * 365 * DAY_MS, half_life_ms=365 * DAY_MS, long_span_ms=20 * 365 * DAY_MS)


def _training(spark, sf_dir):
    """Sessions and networks of the line items with all features; one shop per country, which is also the group."""
    obs = join_observations(T.lineitem_events(spark, sf_dir), T.checkout_sessions(spark, sf_dir)).drop("device").withColumn("scope", F.col("network"))
    # a payment's id is made of its order's number, so payments are collapsed where the join has left their orders; then sessions, of
    # which there are as many as customers, are laid together once for all that is counted per session
    payments = per_payment(obs.filter(F.col("session").isNotNull()), within=("order_id",))
    attempts = stage_by(payments, "attempts", ["scope", "session"])
    as_of = int(attempts.agg(F.max("at_ms").alias("m")).first()["m"]) + 1_000
    traffic = stage(traffic_context(attempts, as_of_ms=as_of, window=_LONG), "traffic")
    of_kind = lambda kind: features(attempts, as_of_ms=as_of, window=_LONG, kinds=(kind,), columns=("distinct_cards", "recovery_rate"))
    vectors = of_kind("session").unionByName(of_kind("network"))
    rows = D.with_features(with_traffic(vectors, traffic))
    k = F.substring("entity_key", 2, 20).cast("bigint")
    label = (F.col("failure_rate") * 100 + k % 37 > 55).cast("int")
    labelled = rows.withColumn("y", label).withColumn("row_id", F.concat_ws(":", "scope", "entity_key")).withColumn("group", F.col("scope"))
    return stage(D.grouped_split(labelled).select("row_id", "group", "y", "split", *FEATS), "training")


_ROUNDS = {"logistic": 0, "boosted": 200, "forest": 300}


def _fit(name):
    def run(spark, sf_dir):
        rows = _training(spark, sf_dir)
        model = M.train(rows, name, rounds=_ROUNDS[name])
        return M._test_metrics(model, rows, name)

    return run


query("ml_logistic")(_fit("logistic"))
query("ml_gbt")(_fit("boosted"))
query("ml_forest")(_fit("forest"))


@query("ml_temperature")
def _(spark, sf_dir):
    """The temperature fitted on the validation side, with the loss there before and after it."""
    rows = _training(spark, sf_dir)
    model = M.train(rows, "logistic")
    loss = lambda t: F.avg(F.log1p(F.exp(F.col("logit") / t)) - F.col("y") * F.col("logit") / t)
    judged = model.risk(rows.filter("split = 'validation'")).select("y", "logit")
    return judged.agg(F.count(F.lit(1)).alias("rows_n"), loss(1.0).alias("loss_before"), loss(model.temperature).alias("loss_after")).select(
        "rows_n", "loss_before", "loss_after", F.lit(model.temperature).alias("temperature"), F.lit(model.threshold).alias("threshold"), F.lit(model.review_threshold).alias("review_threshold")
    )


@query("ml_score_linear")
def _(spark, sf_dir):
    rows = _training(spark, sf_dir)
    model = M.train(rows, "logistic")
    scored = M.score(model, rows).withColumn("contributions", M.top_contributions(M.linear_contributions(model)))
    return scored.select("row_id", "risk", "risk_band", "predicted_class", "model_abstained", F.col("contributions.feature").alias("top_features"))


@query("ml_score_trees")
def _(spark, sf_dir):
    rows = _training(spark, sf_dir)
    model = M.train(rows, "boosted")
    parts = M.ablated(model, rows, M.medians(rows), ["row_id"])
    top = parts.groupBy("row_id").agg(F.collect_list(F.struct("feature", "contribution")).alias("c"))
    return M.score(model, rows).join(top, "row_id").select(
        "row_id", "risk", "risk_band", "predicted_class", M.top_contributions(F.col("c"))["feature"].alias("top_features")
    )


@query("top_contributions")
def _(spark, sf_dir):
    rows = _training(spark, sf_dir)
    model = M.train(rows, "logistic")
    return rows.select("row_id", F.inline(M.top_contributions(M.linear_contributions(model))))


@query("ml_importance")
def _(spark, sf_dir):
    rows = _training(spark, sf_dir)
    model = M.train(rows, "boosted")
    return M.importance(M.ablated(model, rows.filter("split = 'test'"), M.medians(rows), ["row_id"]))


@query("ml_canary")
def _(spark, sf_dir):
    rows = _training(spark, sf_dir)
    model = M.train(rows, "boosted")
    return M.canary(rows, float(M._test_metrics(model, rows, "boosted").first()["pr_auc"]))


@query("ml_leakage")
def _(spark, sf_dir):
    rows = _training(spark, sf_dir)
    return M.leakage(rows, D.naive_split(rows.drop("split"), F.col("row_id")))


@query("ml_ladder")
def _(spark, sf_dir):
    return M.ladder(_training(spark, sf_dir))


@query("ml_ablation")
def _(spark, sf_dir):
    return M.ablation(_training(spark, sf_dir))


@query("ml_learning_curve")
def _(spark, sf_dir):
    return M.learning_curve(_training(spark, sf_dir))


@query("ml_stability")
def _(spark, sf_dir):
    return M.stability(_training(spark, sf_dir))
