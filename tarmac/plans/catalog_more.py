"""Query registrations for projections, filters, functions, reshaping,
joins, statistics, features and deterministic clustering kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions import dates as fd
from tarmac.functions import derived as fn
from tarmac.operators import aggregates as agg
from tarmac.operators import clean, cluster, joins, reshape, stats
from tarmac.operators.aggregates import top_per_year
from tarmac.plans import dims
from tarmac.plans import features as feat
from tarmac.plans.context import TOP_AIRPORTS, Ctx
from tarmac.registry import query
from tarmac.sources.tables import CAUSE_COLUMNS
from tarmac.session import cut_lineage


# ------------------------------------------------------------- projections
@query("src_flights")
def q_src_flights(c: Ctx) -> DataFrame:
    """SRC-03: the raw table with the reference's 37-column list."""
    cols = ["YEAR", "QUARTER", "MONTH", "DAY_OF_MONTH", "DAY_OF_WEEK", "AIRLINE_ID", "CARRIER", "TAIL_NUM",
            "FL_NUM", "ORIGIN_AIRPORT_ID", "ORIGIN", "ORIGIN_CITY_NAME", "ORIGIN_STATE_NM", "DEST_AIRPORT_ID",
            "DEST", "DEST_CITY_NAME", "DEST_STATE_NM", "DEP_DELAY", "DEP_DELAY_NEW", "DEP_DEL15", "TAXI_OUT",
            "TAXI_IN", "ARR_DELAY", "ARR_DELAY_NEW", "ARR_DEL15", "CANCELLED", "CANCELLATION_CODE", "DIVERTED",
            "AIR_TIME", "FLIGHTS", "DISTANCE", "CARRIER_DELAY", "WEATHER_DELAY", "NAS_DELAY", "SECURITY_DELAY",
            "LATE_AIRCRAFT_DELAY", "FL_DATE"]
    return c.fl.select(*cols)


def model_data(c: Ctx) -> DataFrame:
    """The modelling query: flights between large hubs by carriers flying
    in every year up to 2015, booking-time columns with short aliases."""
    carriers = c.model_carriers
    h = c.hubs.select("Locid")
    return (c.fl.join(carriers, "CARRIER", "left_semi")
            .join(h.withColumnRenamed("Locid", "ORIGIN"), "ORIGIN", "left_semi")
            .join(h.withColumnRenamed("Locid", "DEST"), "DEST", "left_semi")
            .select("YEAR", "MONTH", "DAY_OF_MONTH", "DAY_OF_WEEK", "ORIGIN", "DEST", "CARRIER",
                    F.col("DEP_DEL15").alias("DEP_DEL"), F.col("DEP_DELAY").alias("DDEL1"),
                    F.col("DEP_DELAY_NEW").alias("DDEL2")))


@query("prj_alias")
def q_prj_alias(c: Ctx) -> DataFrame:
    """PRJ-01 (+ PRE-04, PRE-02): aliased projection of the modelling query."""
    return model_data(c)


@query("prj_drop_leakage")
def q_prj_drop_leakage(c: Ctx) -> DataFrame:
    return clean.drop_leakage(c.camel)


@query("prj_zero_variance")
def q_prj_zero_variance(c: Ctx) -> DataFrame:
    return clean.variance_profile(clean.drop_leakage(c.camel))


@query("prj_rename")
def q_prj_rename(c: Ctx) -> DataFrame:
    """PRJ-04: rename by full positional list."""
    return c.ranks.toDF("YEAR", "RANK", "IATA", "HUB", "ENPLANEMENT", "CHANGE")


@query("prj_upper_names")
def q_prj_upper_names(c: Ctx) -> DataFrame:
    r = c.ranks
    return r.toDF(*[x.upper() for x in r.columns])


SAMPLE_YEAR = 2010  # the reference's sample


def _sample_camel(c: Ctx, year: int = SAMPLE_YEAR) -> DataFrame:
    """The EDA sample (one year) in the camel-case layout."""
    s = c.camel.alias("s")
    carriers = c.major_airlines.select(F.col("CARRIER").alias("Carrier"))
    h = c.hubs.select("Locid")
    return (s.where(F.col("Year") == year).join(carriers, "Carrier", "left_semi")
            .join(h.withColumnRenamed("Locid", "Origin"), "Origin", "left_semi")
            .join(h.withColumnRenamed("Locid", "Dest"), "Dest", "left_semi"))


@query("imp_mode_all")
def q_imp_mode_all(c: Ctx) -> DataFrame:
    """IMP-01: mode imputation of every column of the sample (checkpointed:
    the fit and the transform read it once)."""
    s = cut_lineage(_sample_camel(c))
    return clean.impute_modes(s, s.columns)


@query("prj_typed_cast")
def q_prj_typed_cast(c: Ctx) -> DataFrame:
    s = cut_lineage(_sample_camel(c))
    return clean.typed_cast(clean.impute_modes(s, s.columns))


@query("prj_booking_features")
def q_prj_booking_features(c: Ctx) -> DataFrame:
    """PRJ-07: booking-time features + route + target."""
    s = c.camel
    return s.select("FlightDate", "Month", "DayofMonth", "DayOfWeek", "WeekofYear", "DepTimeBlk", "ArrTimeBlk",
                    "Carrier", "Origin", "Dest", fn.route(F.col("Origin"), F.col("Dest")).alias("Route"),
                    "OriginState", "DestState", "Distance", "DistanceGroup", "AirTime", "Flights",
                    "DepartureDelayGroups", "ArrivalDelayGroups")


@query("prj_feature_slice")
def q_prj_feature_slice(c: Ctx) -> DataFrame:
    """PRJ-08: feature columns = all but the two key columns."""
    f = c.airport_features
    keys = ["YEAR", "IATA"]
    return f.select(*[x for x in f.columns if x not in keys])


# ------------------------------------------------------------- filters
@query("flt_equality")
def q_flt_equality(c: Ctx) -> DataFrame:
    return c.fl.where(F.col("YEAR") == 2012).select("FL_DATE", "CARRIER", "ORIGIN", "DEST", "ARR_DELAY")


@query("flt_range")
def q_flt_range(c: Ctx) -> DataFrame:
    return c.fl.where(F.col("YEAR") <= 2015).select("YEAR", "CARRIER", "ORIGIN", "DEST", "DEP_DELAY")


@query("flt_conjunction")
def q_flt_conjunction(c: Ctx) -> DataFrame:
    """PRE-03: conjunction of equalities with parameters (no SQL text)."""
    f = c.subset
    return f.where((F.col("YEAR") == 2012) & (F.col("CARRIER") == "C10") & (F.col("ORIGIN") == "A07"))


@query("flt_in_list")
def q_flt_in_list(c: Ctx) -> DataFrame:
    """PRE-04 with literal lists (a one-element list works too)."""
    air = ["A01", "A02", "A03", "A05", "A08", "A13"]
    return (c.fl.where(F.col("CARRIER").isin(["C01", "C02", "C03", "C04", "C05", "C06", "C07"])
                       & F.col("ORIGIN").isin(air) & F.col("DEST").isin(air))
            .select("YEAR", "CARRIER", "ORIGIN", "DEST", "ARR_DEL15"))


@query("flt_isin")
def q_flt_isin(c: Ctx) -> DataFrame:
    """PRE-05: membership in a computed list, as a semi join."""
    return c.airports.join(c.hubs, c.airports.iata == c.hubs.Locid, "left_semi")


@query("flt_null_key")
def q_flt_null_key(c: Ctx) -> DataFrame:
    return c.ranks.dropna(subset=["Locid"])


@query("flt_dropna_any")
def q_flt_dropna_any(c: Ctx) -> DataFrame:
    return c.subset.dropna(how="any")


@query("flt_null_profile")
def q_flt_null_profile(c: Ctx) -> DataFrame:
    return clean.null_profile(c.camel)


@query("flt_major_airlines")
def q_flt_major_airlines(c: Ctx) -> DataFrame:
    return dims.major_carriers(c.fl)


# ------------------------------------------------------------- aggregates
@query("agg_cause_by_weekday")
def q_agg_cause_by_weekday(c: Ctx) -> DataFrame:
    return agg.cause_by_weekday(c.fl, CAUSE_COLUMNS)


@query("agg_crosstab_totals")
def q_agg_crosstab_totals(c: Ctx) -> DataFrame:
    return reshape.row_totals(c.fl, "WEEK_OF_YEAR")


@query("agg_crosstab_all_totals")
def q_agg_crosstab_all_totals(c: Ctx) -> DataFrame:
    return reshape.all_totals(c.fl, "WEEK_OF_YEAR")


@query("agg_route_carriers_rollup")
def q_agg_route_carriers_rollup(c: Ctx) -> DataFrame:
    """AGG-05 over months, years and all time, from one stored table of bitmaps."""
    bits, out = c.carrier_bits, None
    for period in (["YEAR", "MONTH"], ["YEAR"], []):
        p = agg.carriers_over(bits, period).select(
            *[(F.col(x) if x in period else F.lit(None).cast("int")).alias(x) for x in ("YEAR", "MONTH")],
            "ORIGIN", "DEST", "CARRIERS")
        out = p if out is None else out.unionByName(p)
    return out


@query("agg_distinct")
def q_agg_distinct(c: Ctx) -> DataFrame:
    return agg.distinct_values(c.fl, ["CARRIER", "ORIGIN"])


@query("agg_value_counts")
def q_agg_value_counts(c: Ctx) -> DataFrame:
    return agg.value_counts(c.fl, "ARR_DEL15")


@query("agg_mode")
def q_agg_mode(c: Ctx) -> DataFrame:
    """AGG-14: mode of every column of the raw table (lowest on ties)."""
    m = clean.mode_table(c.fl, c.fl.columns)
    return m.select("FEATURE", F.round(F.coalesce(F.col("INT").cast("double"), F.col("NUM")), 6).alias("NUM"), "STR")


@query("agg_airport_mean")
def q_agg_airport_mean(c: Ctx) -> DataFrame:
    f = c.airport_features
    return agg.airport_mean(f, "IATA", feat.AIRPORT_NUMERIC + ["REC_TIME"])


@query("win_airport_day_traffic")
def q_win_airport_day_traffic(c: Ctx) -> DataFrame:
    return agg.airport_day_traffic(c.fl)


# ------------------------------------------------------------- windows
@query("win_top_airports")
def q_win_top_airports(c: Ctx) -> DataFrame:
    return top_per_year(c.fl, "ORIGIN", TOP_AIRPORTS)


@query("win_row_percent")
def q_win_row_percent(c: Ctx) -> DataFrame:
    return reshape.row_percent(c.fl, "DAY_OF_WEEK")


@query("win_cause_rate")
def q_win_cause_rate(c: Ctx) -> DataFrame:
    return reshape.cause_rate(c.fl, CAUSE_COLUMNS)


@query("win_same_week_last_year")
def q_win_same_week_last_year(c: Ctx) -> DataFrame:
    """WIN-04: weekly flights per carrier joined to the same ISO week one
    year earlier (a self join on (YEAR - 1, WEEK), not a lag: weeks may be
    missing)."""
    wk = c.fl.groupBy("YEAR", "WEEK_OF_YEAR", "CARRIER").agg(
        F.sum("FLIGHTS").alias("FLIGHTS"), F.sum("ARR_DEL15").alias("ARR_DEL"))
    prev = wk.select((F.col("YEAR") + 1).alias("YEAR"), "WEEK_OF_YEAR", "CARRIER",
                     F.col("FLIGHTS").alias("FLIGHTS_LY"), F.col("ARR_DEL").alias("ARR_DEL_LY"))
    return wk.join(prev, ["YEAR", "WEEK_OF_YEAR", "CARRIER"], "left")


def _fixed_airport_assign(c: Ctx, k: int = 4) -> DataFrame:
    f = c.airport_features
    cen = cluster.first_rows(f, ["YEAR", "IATA"], feat.AIRPORT_CLUSTER_FEATURES, k)
    return cluster.assign(f, feat.AIRPORT_CLUSTER_FEATURES, cen)


@query("win_dense_relabel")
def q_win_dense_relabel(c: Ctx) -> DataFrame:
    a = _fixed_airport_assign(c, 6).select("YEAR", "IATA", (F.col("CLASS") * 10 + 3).alias("CLASS"))
    return cluster.dense_relabel(a, ["YEAR"])


# ------------------------------------------------------------- sort / limit
@query("srt_by_date")
def q_srt_by_date(c: Ctx) -> DataFrame:
    return c.sample.select("FL_DATE", "CARRIER", "ORIGIN", "DEST", "ARR_DELAY").orderBy("FL_DATE")


@query("srt_group_year")
def q_srt_group_year(c: Ctx) -> DataFrame:
    return agg.carrier_year_count(c.fl).orderBy("YEAR")


@query("srt_variance_rank")
def q_srt_variance_rank(c: Ctx) -> DataFrame:
    """SRT-03: features ranked by variance, descending."""
    f = c.airport_features
    v = clean.variance_profile(f.drop("YEAR")).drop("LOW")
    from pyspark.sql import Window as W
    return v.withColumn("RANK", F.row_number().over(W.orderBy(F.desc("VARIANCE"), F.asc("FEATURE"))))


@query("srt_topk")
def q_srt_topk(c: Ctx) -> DataFrame:
    """SRT-05/06: the 5 busiest origin airports over all years."""
    cnt = c.fl.groupBy("ORIGIN").agg(F.count("ORIGIN").alias("CNT"))
    return cnt.orderBy(F.desc("CNT"), F.asc("ORIGIN")).limit(5)


# ------------------------------------------------------------- set ops
@query("set_union_all")
def q_set_union_all(c: Ctx) -> DataFrame:
    """SET-01: the frames of all years put together by column name; each
    frame comes with its columns in another order, as separate files may."""
    years = sorted(r["YEAR"] for r in c.airport_base.select("YEAR").distinct().collect())
    frames = [c.airport_base.where(F.col("YEAR") == y) for y in years]
    turned = [f.select(*f.columns[i % len(f.columns):], *f.columns[:i % len(f.columns)]) for i, f in enumerate(frames)]
    return clean.union_frames(turned)


@query("set_major_airports")
def q_set_major_airports(c: Ctx) -> DataFrame:
    return dims.major_airport_codes(c.fl, TOP_AIRPORTS)


@query("set_carrier_exclusion")
def q_set_carrier_exclusion(c: Ctx) -> DataFrame:
    return dims.carrier_exclusion(c.major_airlines, c.subset)


# ------------------------------------------------------------- functions
@query("fn_iso_week")
def q_fn_iso_week(c: Ctx) -> DataFrame:
    d = c.fl.select("YEAR", "MONTH", "DAY_OF_MONTH").distinct()
    return d.withColumn("WEEK", fd.iso_week("YEAR", "MONTH", "DAY_OF_MONTH"))


def _calendar(c: Ctx) -> DataFrame:
    """Holidays from a year before the data to a year after: observed dates
    move over New Year, and the nearest holiday may lie beyond the data."""
    return fd.holidays(fd.years_around(c.fl.select("YEAR")))


def _holidays(c: Ctx) -> DataFrame:
    return fd.holidays(c.fl.select("YEAR"))


@query("fn_clean_date")
def q_fn_clean_date(c: Ctx) -> DataFrame:
    h = _holidays(c).select("Year", "Holiday", F.date_format("Date", "EEEE, MMMM d").alias("TEXT"))
    return h.withColumn("DATE", fd.clean_date(F.col("Year"), F.col("TEXT")))


@query("fn_date_parts")
def q_fn_date_parts(c: Ctx) -> DataFrame:
    h = _holidays(c).select("Year", "Date", "Holiday")
    return fd.date_parts(h, "Date")


@query("fn_to_date")
def q_fn_to_date(c: Ctx) -> DataFrame:
    t = c.fl.select(F.date_format("FL_DATE", "M/d/yy").alias("TEXT")).distinct()
    return t.withColumn("DATE", F.try_to_date("TEXT", "M/d/yy"))


@query("fn_rec_time")
def q_fn_rec_time(c: Ctx) -> DataFrame:
    return c.fl.select("FL_DATE", "CARRIER", "ORIGIN", "DEST", "DEP_DELAY", "ARR_DELAY",
                       fn.rec_time(F.col("DEP_DELAY"), F.col("ARR_DELAY")).alias("REC_TIME"))


@query("fn_rec_time_agg")
def q_fn_rec_time_agg(c: Ctx) -> DataFrame:
    b = c.airport_base
    return b.select("YEAR", "IATA", (F.col("DDEL2") - F.col("ADEL2")).alias("REC_TIME"))


@query("fn_route")
def q_fn_route(c: Ctx) -> DataFrame:
    return c.fl.select(fn.route(F.col("ORIGIN"), F.col("DEST")).alias("ROUTE")).distinct()


@query("fn_ave_speed")
def q_fn_ave_speed(c: Ctx) -> DataFrame:
    r = agg.per_route_v2(c.fl)
    return r.select("YEAR", "ORIGIN", "DEST", F.round(fn.ratio("DISTANCE", "AIR_TIME"), 6).alias("AVE_SPEED"))


@query("fn_relative_delay")
def q_fn_relative_delay(c: Ctx) -> DataFrame:
    r = agg.per_route_v2(c.fl)
    return r.select("YEAR", "ORIGIN", "DEST",
                    F.round(fn.ratio("DDEL1", "AIR_TIME"), 6).alias("REL_DDEL"),
                    F.round(fn.ratio("ADEL1", "AIR_TIME"), 6).alias("REL_ADEL"),
                    F.round(fn.ratio(F.col("DDEL2") - F.col("ADEL2"), F.col("AIR_TIME")), 6).alias("REL_RTIME"))


@query("fn_normalize")
def q_fn_normalize(c: Ctx) -> DataFrame:
    o = agg.per_origin(c.fl)
    cols = [x for x in o.columns if x not in ("YEAR", "ORIGIN", "FLIGHTS")]
    n = fn.normalize(o, cols, "FLIGHTS")
    return n.select("YEAR", "ORIGIN", "FLIGHTS", *[F.round(x, 6).alias(x) for x in cols])


@query("fn_sq_distance")
def q_fn_sq_distance(c: Ctx) -> DataFrame:
    """FN-16: squared distance between the two ends of every route."""
    r = agg.per_route(c.fl).select("YEAR", "ORIGIN", "DEST")
    a = c.airports
    o = a.select(F.col("iata").alias("ORIGIN"), F.col("lat").alias("LAT1"), F.col("lon").alias("LON1"))
    d = a.select(F.col("iata").alias("DEST"), F.col("lat").alias("LAT2"), F.col("lon").alias("LON2"))
    j = r.join(o, "ORIGIN").join(d, "DEST")
    return j.select("YEAR", "ORIGIN", "DEST",
                    fn.sq_distance([F.col("LAT1"), F.col("LON1")], [F.col("LAT2"), F.col("LON2")]).alias("D2"))


@query("fn_label_text")
def q_fn_label_text(c: Ctx) -> DataFrame:
    h = _holidays(c)
    return h.select("Year", "Date", fn.label_text(fd.iso_dow(F.col("Date")), F.col("Holiday")).alias("LABEL"))


# ------------------------------------------------------------- imputation
@query("imp_most_frequent")
def q_imp_most_frequent(c: Ctx) -> DataFrame:
    r = cut_lineage(agg.per_route_v2(c.fl))
    return clean.impute_modes(r, feat.ROUTE_NUMERIC)


@query("imp_mode_by_year")
def q_imp_mode_by_year(c: Ctx) -> DataFrame:
    b = c.airport_base
    return clean.impute_modes_by(b, feat.AIRPORT_NUMERIC, ["YEAR"])


# ------------------------------------------------------------- reshaping
@query("pivot_carrier_year")
def q_pivot_carrier_year(c: Ctx) -> DataFrame:
    """RSH-01: year x carrier counts; the carrier list comes from the
    carrier dimension (dimension-sized, read once)."""
    codes = sorted(r["Code"] for r in c.carriers.select("Code").collect())
    cnt = agg.carrier_year_count(c.fl)
    return reshape.pivot_values(cnt, "YEAR", "CARRIER", codes, "CNT")


@query("pivot_week")
def q_pivot_week(c: Ctx) -> DataFrame:
    return reshape.pivot_by_group(c.fl, "WEEK_OF_YEAR")


@query("pivot_day_of_month")
def q_pivot_day_of_month(c: Ctx) -> DataFrame:
    return reshape.pivot_by_group(c.fl, "DAY_OF_MONTH")


@query("pivot_day_of_week")
def q_pivot_day_of_week(c: Ctx) -> DataFrame:
    return reshape.pivot_by_group(c.fl, "DAY_OF_WEEK")


@query("pivot_month")
def q_pivot_month(c: Ctx) -> DataFrame:
    return reshape.pivot_by_group(c.fl, "MONTH")


def _time_blocks(c: Ctx) -> DataFrame:
    blocks = (c.fl.select(F.col("DEP_TIME_BLK").alias("BLOCK"))
              .unionByName(c.fl.select(F.col("ARR_TIME_BLK").alias("BLOCK"))).distinct())
    return blocks.select("BLOCK", block_label(F.col("BLOCK")).alias("LABEL"))


def block_label(b):
    """'0600-0659' -> '06:00-06:59'; the night block keeps its text."""
    return F.concat(F.substring(b, 1, 2), F.lit(":"), F.substring(b, 3, 2), F.lit("-"),
                    F.substring(b, 6, 2), F.lit(":"), F.substring(b, 8, 2))


@query("pivot_dep_block")
def q_pivot_dep_block(c: Ctx) -> DataFrame:
    """RSH-06: departure block x delay group, labelled by a real join."""
    p = reshape.pivot_by_group(c.fl, "DEP_TIME_BLK")
    return p.join(_time_blocks(c).withColumnRenamed("BLOCK", "DEP_TIME_BLK"), "DEP_TIME_BLK", "left")


@query("pivot_arr_block")
def q_pivot_arr_block(c: Ctx) -> DataFrame:
    p = reshape.pivot_by_group(c.fl, "ARR_TIME_BLK")
    return p.join(_time_blocks(c).withColumnRenamed("BLOCK", "ARR_TIME_BLK"), "ARR_TIME_BLK", "left")


# ------------------------------------------------------------- joins
@query("join_origin_dest")
def q_join_origin_dest(c: Ctx) -> DataFrame:
    return joins.origin_dest(agg.per_origin(c.fl), agg.per_destination(c.fl))


@query("join_coords")
def q_join_coords(c: Ctx) -> DataFrame:
    return feat.airport_base(c.fl, c.airports)


def _airport_classes(c: Ctx) -> DataFrame:
    return feat.airport_classes(c.airport_features)


@query("join_rank_left")
def q_join_rank_left(c: Ctx) -> DataFrame:
    cl = _airport_classes(c).join(c.hubs, F.col("IATA") == F.col("Locid"), "left_semi")
    return joins.rank_left(cl, c.ranks)


def _hub_airports(c: Ctx, classes: DataFrame | None = None) -> DataFrame:
    cl = (_airport_classes(c) if classes is None else classes).join(c.hubs, F.col("IATA") == F.col("Locid"), "left_semi")
    return joins.rank_left(cl, c.ranks)


@query("join_flight_origin")
def q_join_flight_origin(c: Ctx) -> DataFrame:
    return joins.role_join(model_data(c), _hub_airports(c), "ORIGIN", "ORIG")


@query("join_flight_dest")
def q_join_flight_dest(c: Ctx) -> DataFrame:
    return joins.role_join(model_data(c), _hub_airports(c), "DEST", "DEST")


@query("join_model_table")
def q_join_model_table(c: Ctx) -> DataFrame:
    """JOIN-06 with classes of fixed centroids, which SQL can reproduce;
    ``pipe_model_table`` is the same table with the k-means classes."""
    return model_table(c, _airport_classes(c), feat.route_classes(c.route_features))


def model_table(c: Ctx, airport_classes: DataFrame, rc: DataFrame) -> DataFrame:
    """Flights + origin / destination airport classes and ranks + route class
    -> the 21-column modelling table."""
    ha = _hub_airports(c, airport_classes)
    j = joins.role_join(joins.role_join(model_data(c), ha, "ORIGIN", "ORIG"), ha, "DEST", "DEST")
    j = j.join(rc, ["YEAR", "ORIGIN", "DEST"], "left")
    return j.select("YEAR", "MONTH", "DAY_OF_MONTH", "DAY_OF_WEEK", "ORIGIN", "DEST", "CARRIER", "DEP_DEL",
                    "DDEL1", "DDEL2",
                    F.col("C1_ORIG"), F.col("C2_ORIG"), F.col("RANK_ORIG"), F.col("ENPLANEMENT_ORIG").alias("ENP_ORIG"),
                    F.col("CHANGE_ORIG").alias("CHA_ORIG"),
                    F.col("C1_DEST"), F.col("C2_DEST"), F.col("RANK_DEST"), F.col("ENPLANEMENT_DEST").alias("ENP_DEST"),
                    F.col("CHANGE_DEST").alias("CHA_DEST"), F.col("C").alias("C_FLIGHT"))


@query("join_semi_dims")
def q_join_semi_dims(c: Ctx) -> DataFrame:
    """JOIN-07: flights restricted to major airports (origin) and major
    carriers by semi joins, counted per airport and month."""
    s = (c.fl.join(c.major_airports.select(F.col("CODE").alias("ORIGIN")), "ORIGIN", "left_semi")
         .join(c.major_airlines.select("CARRIER"), "CARRIER", "left_semi"))
    return s.groupBy("ORIGIN", "YEAR", "MONTH").agg(F.count(F.lit(1)).alias("N"))


@query("join_name_code")
def q_join_name_code(c: Ctx) -> DataFrame:
    """JOIN-08: request codes -> names, and names -> codes again."""
    from tarmac.operators.summary import parse_requests
    p = parse_requests(c.requests)
    names = c.major_airports.select(F.col("CODE"), F.col("HUB_NM"))
    carr = c.carriers.select(F.col("Code").alias("CARRIER"), F.col("Description").alias("CARRIER_NM"))
    j = (p.join(names.withColumnsRenamed({"CODE": "ORIGIN", "HUB_NM": "ORIGIN_NM"}), "ORIGIN", "left")
         .join(carr, "CARRIER", "left"))
    back = names.withColumnsRenamed({"CODE": "ORIGIN_BACK", "HUB_NM": "ORIGIN_NM"})
    return j.join(back, "ORIGIN_NM", "left").select("variables", "ORIGIN", "ORIGIN_NM", "ORIGIN_BACK",
                                                     "CARRIER", "CARRIER_NM")


@query("join_holiday_week")
def q_join_holiday_week(c: Ctx) -> DataFrame:
    wk = c.fl.groupBy("YEAR", "WEEK_OF_YEAR").agg(F.sum("FLIGHTS").alias("FLIGHTS"))
    return joins.holiday_week(wk, _calendar(c))


@query("join_nearest_holiday")
def q_join_nearest_holiday(c: Ctx) -> DataFrame:
    return joins.nearest_holiday(c.fl, _calendar(c))


@query("join_flight_holiday")
def q_join_flight_holiday(c: Ctx) -> DataFrame:
    """JOIN-10: the nearest holiday of every flight (found once per date)."""
    near = joins.nearest_holiday(c.fl, _calendar(c))
    return c.fl.select("FL_DATE", "CARRIER", "ORIGIN", "DEST", "ARR_DELAY").join(near, "FL_DATE", "left")


@query("join_asof")
def q_join_asof(c: Ctx) -> DataFrame:
    """JOIN-10: for every airport and day the nearest day on which a departure was cancelled there."""
    cancelled = c.fl.where(F.col("CANCELLED") == 1)
    return joins.nearest_asof(c.fl, cancelled, "FL_DATE", ["ORIGIN"])


# ------------------------------------------------------------- statistics
@query("stat_variance")
def q_stat_variance(c: Ctx) -> DataFrame:
    f = c.airport_features
    return clean.variance_profile(f.drop("YEAR")).drop("LOW")


def _airport_feature_cols(f: DataFrame) -> list[str]:
    return [x for x in f.columns if x not in ("YEAR", "IATA")]


def _route_feature_cols(f: DataFrame) -> list[str]:
    return [x for x in f.columns if x not in ("YEAR", "ORIGIN", "DEST")]


@query("stat_variance_route")
def q_stat_variance_route(c: Ctx) -> DataFrame:
    return clean.variance_profile(c.route_features.drop("YEAR")).drop("LOW")


@query("stat_corr_route")
def q_stat_corr_route(c: Ctx) -> DataFrame:
    f = c.route_features
    return stats.corr_matrix(f, _route_feature_cols(f))


@query("stat_corr_by_year")
def q_stat_corr_by_year(c: Ctx) -> DataFrame:
    """STA-02 per year, on the four features of the yearly clustering."""
    return stats.corr_matrix(c.airport_features, feat.AIRPORT_YEAR_FEATURES, ["YEAR"])


@query("prj_drop_low_variance")
def q_prj_drop_low_variance(c: Ctx) -> DataFrame:
    """PRJ-03: the airport features without those of low variance."""
    return clean.drop_low_variance(c.airport_features, _airport_feature_cols(c.airport_features))


@query("prj_kept_features")
def q_prj_kept_features(c: Ctx) -> DataFrame:
    """PRJ-03: the names of the airport features that the drop leaves."""
    left = q_prj_drop_low_variance(c).columns
    kept = [(x,) for x in _airport_feature_cols(c.airport_features) if x in left]
    return c.spark.createDataFrame(kept, "FEATURE string")


@query("stat_corr_matrix")
def q_stat_corr_matrix(c: Ctx) -> DataFrame:
    f = c.airport_features
    return stats.corr_matrix(f, _airport_feature_cols(f))


@query("stat_corr_filter")
def q_stat_corr_filter(c: Ctx) -> DataFrame:
    f = c.airport_features
    return stats.corr_filter(stats.corr_matrix(f, _airport_feature_cols(f)), 0.5)


@query("stat_histogram")
def q_stat_histogram(c: Ctx) -> DataFrame:
    return stats.histogram(c.fl, "ARR_DELAY", 10)


@query("stat_three_sigma")
def q_stat_three_sigma(c: Ctx) -> DataFrame:
    return stats.three_sigma(c.fl.select("FL_DATE", "CARRIER", "ORIGIN", "DEST", "ARR_DELAY"), "ARR_DELAY")


@query("ml_covariance")
def q_ml_covariance(c: Ctx) -> DataFrame:
    f = c.airport_features
    return stats.covariance(f, feat.AIRPORT_CLUSTER_FEATURES)


# ------------------------------------------------------------- features / kernels
@query("pipe_airport_features")
def q_pipe_airport_features(c: Ctx) -> DataFrame:
    return feat.airport_features(c.fl, c.airports)


@query("pipe_route_features")
def q_pipe_route_features(c: Ctx) -> DataFrame:
    f = feat.route_features(c.fl)
    return f.select("YEAR", "ORIGIN", "DEST", *[F.round(x, 6).alias(x) for x in f.columns[3:]])


@query("ml_standard_scale")
def q_ml_standard_scale(c: Ctx) -> DataFrame:
    f = c.airport_features
    cols = _airport_feature_cols(f)
    s = cluster.standard_scale(f, cols)
    return s.select("YEAR", "IATA", *[F.round(x, 6).alias(x) for x in cols])


@query("ml_robust_scale")
def q_ml_robust_scale(c: Ctx) -> DataFrame:
    f = c.airport_features
    cols = _airport_feature_cols(f)
    s = cluster.robust_scale(f, cols)
    return s.select("YEAR", "IATA", *[F.round(x, 6).alias(x) for x in cols])


@query("ml_kmeans_assign")
def q_ml_kmeans_assign(c: Ctx) -> DataFrame:
    return _fixed_airport_assign(c).select("YEAR", "IATA", "CLASS", "D2")


@query("ml_kmeans_step")
def q_ml_kmeans_step(c: Ctx) -> DataFrame:
    return cluster.lloyd_step(_fixed_airport_assign(c), feat.AIRPORT_CLUSTER_FEATURES)


@query("ml_sse")
def q_ml_sse(c: Ctx) -> DataFrame:
    return cluster.sse(_fixed_airport_assign(c))


@query("ml_merge_small")
def q_ml_merge_small(c: Ctx) -> DataFrame:
    a = _fixed_airport_assign(c, 6).select("YEAR", "IATA", "CLASS")
    return cluster.merge_small(a, ["YEAR"], "CLASS", min_size=3)


@query("ml_merge_map")
def q_ml_merge_map(c: Ctx) -> DataFrame:
    a = _fixed_airport_assign(c, feat.AIRPORT_K).select("YEAR", "IATA", "CLASS")
    return cluster.merge_map(a, feat.AIRPORT_MERGE)


@query("ml_merge_nearest")
def q_ml_merge_nearest(c: Ctx) -> DataFrame:
    """ML-12: classes under 40 members go to the nearest large class."""
    a = _fixed_airport_assign(c, feat.AIRPORT_K)
    return cluster.merge_nearest(a, feat.AIRPORT_CLUSTER_FEATURES, [], "CLASS", feat.MIN_MEMBERS) \
        .select("YEAR", "IATA", "CLASS")
