"""Query registry: key -> callable(spark, sf_dir) -> DataFrame.

"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators import aggregates as agg
from tarmac.operators import classify as cls
from tarmac.operators import summary as sm
from tarmac.operators import sweep
from tarmac.plans.context import Ctx
from tarmac.session import cut_lineage, scratch_path
from tarmac.streaming import requests as rq

QUERIES: dict[str, Callable[[Ctx], DataFrame]] = {}


def query(key: str):
    def deco(fn: Callable[[Ctx], DataFrame]):
        QUERIES[key] = fn
        return fn
    return deco


def as_entry(fn: Callable[[Ctx], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Ctx(spark, sf_dir))
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    # import for registration side effects
    from tarmac.plans import catalog_io, catalog_ml, catalog_more  # noqa: F401
    return {k: as_entry(v) for k, v in QUERIES.items()}


# ------------------------------------------------------------- aggregates
@query("agg_per_origin")
def q_agg_per_origin(c: Ctx) -> DataFrame:
    return agg.per_origin(c.fl)


@query("agg_per_destination")
def q_agg_per_destination(c: Ctx) -> DataFrame:
    return agg.per_destination(c.fl)


@query("agg_per_airline")
def q_agg_per_airline(c: Ctx) -> DataFrame:
    return agg.per_airline(c.fl)


@query("agg_per_route")
def q_agg_per_route(c: Ctx) -> DataFrame:
    return agg.per_route(c.fl)


@query("agg_per_route_v2")
def q_agg_per_route_v2(c: Ctx) -> DataFrame:
    return agg.per_route_v2(c.fl)


@query("agg_carrier_year_count")
def q_agg_carrier_year_count(c: Ctx) -> DataFrame:
    return agg.carrier_year_count(c.fl)


@query("agg_origin_month")
def q_agg_origin_month(c: Ctx) -> DataFrame:
    return agg.origin_month(c.fl, c.major_airports)


@query("agg_dest_month")
def q_agg_dest_month(c: Ctx) -> DataFrame:
    return agg.dest_month(c.fl, c.major_airports)


# ------------------------------------------------------------- dimensions
@query("pipe_major_airlines")
def q_pipe_major_airlines(c: Ctx) -> DataFrame:
    return c.major_airlines


@query("pipe_major_airports")
def q_pipe_major_airports(c: Ctx) -> DataFrame:
    return c.major_airports


@query("pipe_flights_subset")
def q_pipe_flights_subset(c: Ctx) -> DataFrame:
    return c.subset


@query("pipe_large_hubs")
def q_pipe_large_hubs(c: Ctx) -> DataFrame:
    return c.hubs


@query("pipe_year_sample")
def q_pipe_year_sample(c: Ctx) -> DataFrame:
    return c.sample


# ------------------------------------------------------------- summaries
@query("sum_origin")
def q_sum_origin(c: Ctx) -> DataFrame:
    return sm.origin_summary(c.subset)


@query("sum_destination")
def q_sum_destination(c: Ctx) -> DataFrame:
    return sm.destination_summary(c.subset)


@query("sum_route")
def q_sum_route(c: Ctx) -> DataFrame:
    return sm.route_summary(c.subset)


@query("sum_defaults")
def q_sum_defaults(c: Ctx) -> DataFrame:
    return sm.with_defaults(sm.parse_requests(c.requests), sm.origin_summary(c.subset))


@query("fn_parse_request")
def q_fn_parse_request(c: Ctx) -> DataFrame:
    return sm.parse_requests(c.requests)


# ------------------------------------------------------------- classifier
def _trained(c: Ctx):
    train, codes = c.train, c.train_codes  # stored: fit, evaluation and scoring share them
    model = cls.fit(train)
    return train, codes, model


@query("cls_training_frame")
def q_cls_training_frame(c: Ctx) -> DataFrame:
    return cls.training_frame(c.subset)[0]


@query("win_label_encode")
def q_win_label_encode(c: Ctx) -> DataFrame:
    clean = c.subset.dropna(how="any")
    parts = [cls.label_codes(clean, col).select(F.lit(col).alias("FEATURE"), "VALUE", "CODE")
             for col in cls.ENCODED]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("cls_gnb_fit")
def q_cls_gnb_fit(c: Ctx) -> DataFrame:
    _, _, model = _trained(c)
    t = model.table(c.spark)
    return t.select("CLASS", "N", *[F.round(x, 6).alias(x) for x in t.columns[2:]])


@query("cls_gnb_proba")
def q_cls_gnb_proba(c: Ctx) -> DataFrame:
    train, _, model = _trained(c)
    s = cls.proba(train, model)
    return s.select(*cls.FEATURES, cls.TARGET, F.round("PROBA", 6).alias("PROBA"))


@query("cls_threshold")
def q_cls_threshold(c: Ctx) -> DataFrame:
    train, _, model = _trained(c)
    thr = model.threshold
    s = cls.proba(train, model)
    return s.agg(F.round(F.lit(thr), 6).alias("THRESHOLD"),
                 F.sum((F.col("PROBA") >= F.lit(thr)).cast("int")).alias("N_PRED_LATE"),
                 F.count(F.lit(1)).alias("N"))


@query("cls_evaluate")
def q_cls_evaluate(c: Ctx) -> DataFrame:
    train, _, model = _trained(c)
    return cls.evaluate(cls.proba(train, model), model.threshold)


def _rounded_scores(c: Ctx, digits: int) -> tuple[DataFrame, float]:
    train, _, model = _trained(c)
    s = cls.proba(train, model)
    return s.select(F.round("PROBA", digits).alias("PROBA"), cls.TARGET), model.threshold


@query("ml_metrics")
def q_ml_metrics(c: Ctx) -> DataFrame:
    """STA-07: confusion counts at the decision threshold, area under the curve, log loss."""
    scores, threshold = _rounded_scores(c, 6)
    return sweep.metrics(scores, "PROBA", cls.TARGET, threshold)


@query("cls_threshold_sweep")
def q_cls_threshold_sweep(c: Ctx) -> DataFrame:
    """CLS-04 + STA-07: confusion counts and rates at every score (to four places)."""
    return sweep.threshold_sweep(_rounded_scores(c, 4)[0], "PROBA", cls.TARGET)


@query("cls_score_requests")
def q_cls_score_requests(c: Ctx) -> DataFrame:
    _, codes, model = _trained(c)
    return cls.score_requests(sm.parse_requests(c.requests), codes, model)


@query("pipe_request_answer")
def q_pipe_request_answer(c: Ctx) -> DataFrame:
    return answers(c, c.requests)


def answers(c: Ctx, requests: DataFrame) -> DataFrame:
    """SUM-09 for any table of requests; the asked slices are found once and stored."""
    _, codes, model = _trained(c)
    parsed = sm.parse_requests(requests)
    sub = cut_lineage(sm.requested_slices(c.subset, parsed))
    return sm.request_answer(cls.score_requests(parsed, codes, model), sm.origin_summary(sub),
                             sm.destination_summary(sub), sm.route_summary(sub))


@query("str_request_answer")
def q_str_request_answer(c: Ctx) -> DataFrame:
    """SUM-09 as a stream: requests arrive in two portions, each run answers the new ones."""
    landing, out, ckpt = (scratch_path(c.spark, f"requests-{x}") for x in ("in", "out", "ckpt"))
    half = F.pmod(F.xxhash64("variables"), F.lit(2))
    for i in (0, 1):
        rq.land_requests(c.requests.where(half == i), landing)
        rq.answer_arrived(c.spark, landing, out, ckpt, lambda batch: answers(c, batch))
    return rq.read_answers(c.spark, out)


@query("cls_proba_histogram")
def q_cls_proba_histogram(c: Ctx) -> DataFrame:
    """CLS-07: density histogram (10 bins) of the predicted probabilities
    with the decision threshold alongside."""
    from tarmac.operators.stats import histogram
    train, _, model = _trained(c)
    s = cls.proba(train, model).select(F.round("PROBA", 6).alias("PROBA"))
    return histogram(s, "PROBA", 10).withColumn("THRESHOLD", F.round(F.lit(model.threshold), 6))


@query("cls_evaluate_split")
def q_cls_evaluate_split(c: Ctx) -> DataFrame:
    """CLS-05 with the dated split the reference sketches: fit on the years
    before 2015, evaluate on 2015 and later (threshold = training prior)."""
    train = c.train
    model = cls.fit(train.where(F.col("YEAR") < 2015))
    valid = train.where(F.col("YEAR") >= 2015)
    return cls.evaluate(cls.proba(valid, model), model.threshold)
