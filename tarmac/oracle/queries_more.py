"""Oracle statements for projections, filters, functions, reshaping, joins,
statistics, features and the deterministic clustering kernels."""

from __future__ import annotations

from tarmac.oracle.queries import GNB, ORACLE, OSUM, ROUTE_V2_SQL, q

# Camel-case layout: (name, upper-snake column) -- the file layout of the
# on-time data, written out independently of the Spark side.
CAMEL = """Year YEAR|Quarter QUARTER|Month MONTH|DayofMonth DAY_OF_MONTH|DayOfWeek DAY_OF_WEEK|FlightDate FL_DATE|
UniqueCarrier CARRIER|AirlineID AIRLINE_ID|Carrier CARRIER|TailNum TAIL_NUM|FlightNum FL_NUM|Origin ORIGIN|
OriginCityName ORIGIN_CITY_NAME|OriginState ORIGIN_STATE_NM|OriginCityMarketID ORIGIN_AIRPORT_ID|Dest DEST|
DestCityName DEST_CITY_NAME|DestState DEST_STATE_NM|DestCityMarketID DEST_AIRPORT_ID|CRSDepTime CRS_DEP_TIME|
DepTime CRS_DEP_TIME|DepDelay DEP_DELAY|DepDelayMinutes DEP_DELAY_NEW|DepDel15 DEP_DEL15|
DepartureDelayGroups DEP_DELAY_GROUP|DepTimeBlk DEP_TIME_BLK|TaxiOut TAXI_OUT|TaxiIn TAXI_IN|
CRSArrTime CRS_ARR_TIME|ArrTime CRS_ARR_TIME|ArrDelay ARR_DELAY|ArrDelayMinutes ARR_DELAY_NEW|ArrDel15 ARR_DEL15|
ArrivalDelayGroups ARR_DELAY_GROUP|ArrTimeBlk ARR_TIME_BLK|Cancelled CANCELLED|CancellationCode CANCELLATION_CODE|
Diverted DIVERTED|CRSElapsedTime CRS_ELAPSED_TIME|ActualElapsedTime ACTUAL_ELAPSED_TIME|AirTime AIR_TIME|
Flights FLIGHTS|Distance DISTANCE|DistanceGroup DISTANCE_GROUP|CarrierDelay CARRIER_DELAY|WeatherDelay WEATHER_DELAY|
NASDelay NAS_DELAY|SecurityDelay SECURITY_DELAY|LateAircraftDelay LATE_AIRCRAFT_DELAY|WeekofYear WEEK_OF_YEAR"""
CAMEL_PAIRS = [tuple(p.split()) for p in CAMEL.replace("\n", "").split("|")]
CAMEL_NAMES = [a for a, _ in CAMEL_PAIRS]
CAMEL_SQL = "camel as (select " + ", ".join(f"{b} as {a}" for a, b in CAMEL_PAIRS) + " from fl)"

STRING_COLS = {"CARRIER", "TAIL_NUM", "ORIGIN", "ORIGIN_CITY_NAME", "ORIGIN_STATE_NM", "DEST", "DEST_CITY_NAME",
               "DEST_STATE_NM", "DEP_TIME_BLK", "ARR_TIME_BLK", "CANCELLATION_CODE"}
DATE_COLS = {"FL_DATE"}
FL_COLS = ["YEAR", "QUARTER", "MONTH", "DAY_OF_MONTH", "DAY_OF_WEEK", "WEEK_OF_YEAR", "FL_DATE", "AIRLINE_ID",
           "CARRIER", "TAIL_NUM", "FL_NUM", "ORIGIN_AIRPORT_ID", "ORIGIN", "ORIGIN_CITY_NAME", "ORIGIN_STATE_NM",
           "DEST_AIRPORT_ID", "DEST", "DEST_CITY_NAME", "DEST_STATE_NM", "DEP_DELAY", "DEP_DELAY_NEW", "DEP_DEL15",
           "DEP_DELAY_GROUP", "DEP_TIME_BLK", "TAXI_OUT", "TAXI_IN", "ARR_DELAY", "ARR_DELAY_NEW", "ARR_DEL15",
           "ARR_DELAY_GROUP", "ARR_TIME_BLK", "CANCELLED", "CANCELLATION_CODE", "DIVERTED", "CRS_DEP_TIME",
           "CRS_ARR_TIME", "CRS_ELAPSED_TIME", "AIR_TIME", "ACTUAL_ELAPSED_TIME", "FLIGHTS", "DISTANCE",
           "DISTANCE_GROUP", "CARRIER_DELAY", "WEATHER_DELAY", "NAS_DELAY", "SECURITY_DELAY", "LATE_AIRCRAFT_DELAY"]
CAMEL_KIND = {a: ("str" if b in STRING_COLS else "date" if b in DATE_COLS else "num") for a, b in CAMEL_PAIRS}


def mode_expr(src: str, col: str) -> str:
    return f"(select {col} from {src} where {col} is not null group by {col} order by count(*) desc, {col} limit 1)"


def impute_select(src: str, cols: list[str], allcols: list[str]) -> str:
    return "select " + ", ".join(
        (f"coalesce({c}, {mode_expr(src, c)}) as {c}" if c in cols else c) for c in allcols) + f" from {src}"


# ---------------------------------------------------------------- airport / route feature CTEs
AIRPORT_NUMERIC = ["DEP_FLIGHTS", "DEP_DEL", "DDEL1", "DDEL2", "CANCELLED", "SEC_DEL", "CAR_DEL", "NAS_DEL",
                   "WEA_DEL", "LAD_DEL", "ARR_FLIGHTS", "ARR_DEL", "ADEL1", "ADEL2", "DIVERTED"]
ABASE_COLS = ["YEAR", "IATA"] + AIRPORT_NUMERIC + ["LAT", "LON"]
AFEAT_COLS = AIRPORT_NUMERIC + ["LAT", "LON", "REC_TIME"]
ROUTE_NUMERIC = ["FLIGHTS", "CARRIER", "DEP_DEL", "ARR_DEL", "DISTANCE", "AIR_TIME", "DDEL1", "DDEL2", "ADEL1",
                 "ADEL2", "DIVERTED", "CANCELLED", "SEC_DEL", "CAR_DEL", "NAS_DEL", "WEA_DEL", "LAD_DEL"]
ROUTE_NORM = ["DEP_DEL", "ARR_DEL", "DDEL1", "DDEL2", "ADEL1", "ADEL2", "DIVERTED", "CANCELLED", "SEC_DEL",
              "CAR_DEL", "NAS_DEL", "WEA_DEL", "LAD_DEL", "REC_TIME", "REL_DDEL", "REL_ADEL", "REL_RTIME"]
CL_FEATS = ["REC_TIME", "LAD_DEL", "CAR_DEL", "NAS_DEL", "WEA_DEL", "SEC_DEL"]
ROUTE_CL_FEATS = ROUTE_NUMERIC + ["AVE_SPEED", "REC_TIME", "REL_DDEL", "REL_ADEL", "REL_RTIME"]

FEAT = f"""
ao as (select YEAR, ORIGIN as IATA, sum(FLIGHTS) as DEP_FLIGHTS, sum(DEP_DEL15) as DEP_DEL, sum(DEP_DELAY) as DDEL1,
              sum(DEP_DELAY_NEW) as DDEL2, sum(CANCELLED) as CANCELLED, sum(SECURITY_DELAY) as SEC_DEL,
              sum(CARRIER_DELAY) as CAR_DEL, sum(NAS_DELAY) as NAS_DEL, sum(WEATHER_DELAY) as WEA_DEL,
              sum(LATE_AIRCRAFT_DELAY) as LAD_DEL from fl group by YEAR, ORIGIN),
ad as (select YEAR, DEST as IATA, sum(FLIGHTS) as ARR_FLIGHTS, sum(ARR_DEL15) as ARR_DEL, sum(ARR_DELAY) as ADEL1,
              sum(ARR_DELAY_NEW) as ADEL2, sum(DIVERTED) as DIVERTED from fl group by YEAR, DEST),
aod as (select ao.*, ad.ARR_FLIGHTS, ad.ARR_DEL, ad.ADEL1, ad.ADEL2, ad.DIVERTED from ao join ad using (YEAR, IATA)),
abase as (select aod.*, a.lat as LAT, a.lon as LON from aod join airports a on a.iata = aod.IATA),
aimp as ({impute_select("abase", AIRPORT_NUMERIC, ABASE_COLS)}),
afeat as (select YEAR, IATA, DEP_FLIGHTS, {", ".join(f"{c} / nullif(DEP_FLIGHTS, 0) as {c}" for c in AIRPORT_NUMERIC[1:])},
                 LAT, LON, (DDEL2 - ADEL2) / nullif(DEP_FLIGHTS, 0) as REC_TIME from aimp),
rv2 as ({ROUTE_V2_SQL}),
rimp as ({impute_select("rv2", ROUTE_NUMERIC, ["YEAR", "ORIGIN", "DEST"] + ROUTE_NUMERIC)}),
rder as (select *, DISTANCE / nullif(AIR_TIME, 0) as AVE_SPEED, DDEL2 - ADEL2 as REC_TIME,
                DDEL1 / nullif(AIR_TIME, 0) as REL_DDEL, ADEL1 / nullif(AIR_TIME, 0) as REL_ADEL,
                (DDEL2 - ADEL2) / nullif(AIR_TIME, 0) as REL_RTIME from rimp),
rfeat as (select YEAR, ORIGIN, DEST, FLIGHTS, CARRIER, DISTANCE, AIR_TIME, AVE_SPEED,
                 {", ".join(f"{c} / nullif(FLIGHTS, 0) as {c}" for c in ROUTE_NORM)} from rder),
rfi as ({impute_select("rfeat", ROUTE_CL_FEATS, ["YEAR", "ORIGIN", "DEST"] + ROUTE_CL_FEATS)}),
rscl as (select f.YEAR, f.ORIGIN, f.DEST, {", ".join(f"(f.{c} - s.m_{c}) / s.s_{c} as {c}" for c in ROUTE_CL_FEATS)}
           from rfi f, (select {", ".join(f"avg({c}) as m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) as s_{c}"
                                           for c in ROUTE_CL_FEATS)} from rfi) s)
"""


def nearest_sql(name: str, src: str, keys: list[str], feats: list[str], k: int, out: str) -> str:
    """Fixed-centroid assignment: centroids = first k rows in key order."""
    order = ", ".join(keys)
    cen = (f"{name}_cen as (select row_number() over (order by {order}) - 1 as cid, {', '.join(feats)} "
           f"from (select * from {src} order by {order} limit {k}) z)")
    d2 = " + ".join(f"(s.{f} - c.{f}) * (s.{f} - c.{f})" for f in feats)
    pairs = (f"{name}_pairs as (select s.*, c.cid, {d2} as d2, row_number() over (partition by "
             f"{', '.join('s.' + x for x in keys)} order by {d2}, c.cid) as rn from {src} s, {name}_cen c)")
    pick = f"{name} as (select * exclude (rn, cid, d2), cast(cid as int) as {out}, round(d2, 6) as D2 from {name}_pairs where rn = 1)"
    return ",\n".join([cen, pairs, pick])


CLASSES = FEAT + ",\n" + ",\n".join([
    nearest_sql("ac1", "afeat", ["YEAR", "IATA"], CL_FEATS, 4, "C1"),
    nearest_sql("ac2", "afeat", ["YEAR", "IATA"], ["LAT", "LON"], 3, "C2"),
    nearest_sql("rc", "rscl", ["YEAR", "ORIGIN", "DEST"], ROUTE_CL_FEATS, 5, "C"),
    nearest_sql("as4", "afeat", ["YEAR", "IATA"], CL_FEATS, 4, "CLASS"),
    nearest_sql("as6", "afeat", ["YEAR", "IATA"], CL_FEATS, 6, "CLASS"),
    nearest_sql("as10", "afeat", ["YEAR", "IATA"], CL_FEATS, 10, "CLASS"),
]) + """,
aclass as (select a.YEAR, a.IATA, a.C1, b.C2 from ac1 a join ac2 b using (YEAR, IATA)),
mc15 as (select CARRIER from (select CARRIER, count(distinct YEAR) as n from fl where YEAR <= 2015 and CARRIER is not null
          group by CARRIER) q where n = (select count(distinct YEAR) from fl where YEAR <= 2015)),
mdata as (select YEAR, MONTH, DAY_OF_MONTH, DAY_OF_WEEK, ORIGIN, DEST, CARRIER, DEP_DEL15 as DEP_DEL,
                 DEP_DELAY as DDEL1, DEP_DELAY_NEW as DDEL2 from fl
           where CARRIER in (select CARRIER from mc15) and ORIGIN in (select Locid from hubs)
             and DEST in (select Locid from hubs)),
hubair as (select c.YEAR, c.IATA, c.C1, c.C2, r.Rank as RANK, r.Enplanement as ENPLANEMENT, r.Change as CHANGE
             from aclass c left join ranks r on r.Year = c.YEAR and r.Locid = c.IATA
            where c.IATA in (select Locid from hubs))
"""


def Q(body: str, extra: str = "") -> str:
    return q(body, CLASSES + ("," + extra if extra.strip() else ""))


# ---------------------------------------------------------------- projections / filters
SRC37 = ("YEAR, QUARTER, MONTH, DAY_OF_MONTH, DAY_OF_WEEK, AIRLINE_ID, CARRIER, TAIL_NUM, FL_NUM, ORIGIN_AIRPORT_ID, "
         "ORIGIN, ORIGIN_CITY_NAME, ORIGIN_STATE_NM, DEST_AIRPORT_ID, DEST, DEST_CITY_NAME, DEST_STATE_NM, DEP_DELAY, "
         "DEP_DELAY_NEW, DEP_DEL15, TAXI_OUT, TAXI_IN, ARR_DELAY, ARR_DELAY_NEW, ARR_DEL15, CANCELLED, "
         "CANCELLATION_CODE, DIVERTED, AIR_TIME, FLIGHTS, DISTANCE, CARRIER_DELAY, WEATHER_DELAY, NAS_DELAY, "
         "SECURITY_DELAY, LATE_AIRCRAFT_DELAY, FL_DATE")
ORACLE["src_flights"] = q(f"select {SRC37} from fl")
ORACLE["prj_alias"] = Q("select * from mdata")

LEAK = {"AirlineID", "FlightNum", "UniqueCarrier", "TailNum", "OriginCityName", "DestCityName", "OriginCityMarketID",
        "DestCityMarketID", "CRSDepTime", "CRSArrTime", "DepTime", "ArrTime", "DepDel15", "ArrDel15",
        "CRSElapsedTime", "ActualElapsedTime", "Year", "Quarter"}
KEPT = [c for c in CAMEL_NAMES if c not in LEAK]
ORACLE["prj_drop_leakage"] = q(f"select {', '.join(KEPT)} from camel", CAMEL_SQL)
ORACLE["prj_zero_variance"] = q(" union all ".join(
    f"select '{c}' as FEATURE, round(var_samp(cast({c} as double)), 6) as VARIANCE, "
    f"var_samp(cast({c} as double)) < 0.1 as LOW from camel"
    for c in KEPT if CAMEL_KIND[c] == "num"), CAMEL_SQL)
ORACLE["prj_rename"] = q("select Year as YEAR, Rank as RANK, Locid as IATA, Hub as HUB, Enplanement as ENPLANEMENT, "
                         "Change as CHANGE from ranks")
ORACLE["prj_upper_names"] = q("select Year as YEAR, Rank as RANK, Locid as LOCID, Hub as HUB, "
                              "Enplanement as ENPLANEMENT, Change as CHANGE from ranks")
SAMPLE_CAMEL = CAMEL_SQL + """,
scamel as (select * from camel where Year = 2010 and Carrier in (select CARRIER from major_airlines)
             and Origin in (select Locid from hubs) and Dest in (select Locid from hubs))"""
IMP_ALL = f"select {', '.join(f'coalesce({c}, {mode_expr('scamel', c)}) as {c}' for c in CAMEL_NAMES)} from scamel"
ORACLE["imp_mode_all"] = q(IMP_ALL, SAMPLE_CAMEL)
INT_F = ["Year", "Quarter", "Month", "DayofMonth", "DayOfWeek", "WeekofYear", "AirlineID", "FlightNum",
         "OriginCityMarketID", "DestCityMarketID", "DepTime", "CRSDepTime", "DepDel15", "ArrTime", "CRSArrTime",
         "ArrDel15", "DepartureDelayGroups", "ArrivalDelayGroups", "Cancelled", "Diverted", "DistanceGroup", "Flights"]
FLOAT_F = ["DepDelay", "DepDelayMinutes", "TaxiOut", "TaxiIn", "ArrDelay", "ArrDelayMinutes", "CRSElapsedTime",
           "ActualElapsedTime", "AirTime", "Distance", "CarrierDelay", "WeatherDelay", "NASDelay", "SecurityDelay",
           "LateAircraftDelay"]
STR_F = ["UniqueCarrier", "Carrier", "TailNum", "Origin", "OriginCityName", "OriginState", "Dest", "DestCityName",
         "DestState", "DepTimeBlk", "ArrTimeBlk", "CancellationCode"]
ORACLE["prj_typed_cast"] = q(
    "select cast(FlightDate as date) as FlightDate, "
    + ", ".join(f"try_cast({c} as bigint) as {c}" for c in INT_F) + ", "
    + ", ".join(f"cast({c} as double) as {c}" for c in FLOAT_F) + ", "
    + ", ".join(f"cast({c} as varchar) as {c}" for c in STR_F)
    + f" from ({IMP_ALL}) i", SAMPLE_CAMEL)
ORACLE["prj_booking_features"] = q(
    "select FlightDate, Month, DayofMonth, DayOfWeek, WeekofYear, DepTimeBlk, ArrTimeBlk, Carrier, Origin, Dest, "
    "Origin || '-' || Dest as Route, OriginState, DestState, Distance, DistanceGroup, AirTime, Flights, "
    "DepartureDelayGroups, ArrivalDelayGroups from camel", CAMEL_SQL)
ORACLE["prj_feature_slice"] = Q("select * exclude (YEAR, IATA) from afeat")
ORACLE["flt_equality"] = q("select FL_DATE, CARRIER, ORIGIN, DEST, ARR_DELAY from fl where YEAR = 2012")
ORACLE["flt_range"] = q("select YEAR, CARRIER, ORIGIN, DEST, DEP_DELAY from fl where YEAR <= 2015")
ORACLE["flt_conjunction"] = q("select * from sub where YEAR = 2012 and CARRIER = 'C10' and ORIGIN = 'A07'")
ORACLE["flt_in_list"] = q("""select YEAR, CARRIER, ORIGIN, DEST, ARR_DEL15 from fl
 where CARRIER in ('C01','C02','C03','C04','C05','C06','C07') and ORIGIN in ('A01','A02','A03','A05','A08','A13')
   and DEST in ('A01','A02','A03','A05','A08','A13')""")
ORACLE["flt_isin"] = q("select * from airports where iata in (select Locid from hubs)")
ORACLE["flt_null_key"] = q("select * from ranks where Locid is not null")
ORACLE["flt_dropna_any"] = q("select * from clean", GNB)
ORACLE["flt_null_profile"] = q("select * from (" + " union all ".join(
    f"select '{c}' as FEATURE, count(*) filter (where {c} is null) as N_NULL from camel" for c in CAMEL_NAMES)
    + ") z where N_NULL > 0", CAMEL_SQL)
ORACLE["flt_major_airlines"] = q("select CARRIER from mc")

# ---------------------------------------------------------------- aggregates
CAUSES = ["CARRIER_DELAY", "WEATHER_DELAY", "NAS_DELAY", "SECURITY_DELAY", "LATE_AIRCRAFT_DELAY"]
ORACLE["agg_cause_by_weekday"] = q("select DAY_OF_WEEK, " + ", ".join(
    f"cast(sum(case when {c} > 0 then 1 else 0 end) as bigint) as {c}" for c in CAUSES)
    + " from fl group by DAY_OF_WEEK")
ORACLE["agg_crosstab_totals"] = q("select WEEK_OF_YEAR, sum(FLIGHTS) as TOTAL from fl "
                                  "where ARR_DELAY_GROUP is not null group by WEEK_OF_YEAR")
ORACLE["agg_crosstab_all_totals"] = q("select WEEK_OF_YEAR, ARR_DELAY_GROUP, grouping(WEEK_OF_YEAR, ARR_DELAY_GROUP) as KIND, "
                                      "sum(FLIGHTS) as TOTAL from fl "
                                      "group by grouping sets ((WEEK_OF_YEAR), (ARR_DELAY_GROUP), ())")
ORACLE["agg_route_carriers_rollup"] = q("""
select YEAR, MONTH, ORIGIN, DEST, count(distinct CARRIER) as CARRIERS from fl
 group by grouping sets ((YEAR, MONTH, ORIGIN, DEST), (YEAR, ORIGIN, DEST), (ORIGIN, DEST))""")
ORACLE["agg_distinct"] = q("select distinct CARRIER, ORIGIN from fl")
ORACLE["agg_value_counts"] = q("select ARR_DEL15, count(*) as CNT, round(count(*) / (select count(*) from fl), 6) "
                               "as SHARE from fl group by ARR_DEL15")


def _mode_row(c: str) -> str:
    if c in STRING_COLS:
        v, num, st = c, "cast(null as double)", c
    elif c in DATE_COLS:
        v, num, st = f"date_diff('day', DATE '1970-01-01', {c})", "v", "cast(null as varchar)"
    else:
        v, num, st = f"cast({c} as double)", "v", "cast(null as varchar)"
    if c in STRING_COLS:
        return (f"select '{c}' as FEATURE, cast(null as double) as NUM, v as STR from (select {c} as v from fl "
                f"where {c} is not null group by {c} order by count(*) desc, {c} limit 1) z")
    return (f"select '{c}' as FEATURE, round({num}, 6) as NUM, {st} as STR from (select {v} as v from fl "
            f"where {c} is not null group by v order by count(*) desc, v limit 1) z")


ORACLE["agg_mode"] = q(" union all ".join(_mode_row(c) for c in FL_COLS))
ORACLE["agg_airport_mean"] = Q("select IATA, " + ", ".join(
    f"round(avg({c}), 6) as {c}" for c in AIRPORT_NUMERIC + ["REC_TIME"]) + " from afeat group by IATA")
ORACLE["win_airport_day_traffic"] = q("""
select coalesce(o.FL_DATE, i.FL_DATE) as FL_DATE, coalesce(o.AIRPORT, i.AIRPORT) as AIRPORT,
       coalesce(o.OUT_FLIGHTS, 0) as OUT_FLIGHTS, coalesce(i.IN_FLIGHTS, 0) as IN_FLIGHTS
  from (select FL_DATE, ORIGIN as AIRPORT, sum(FLIGHTS) as OUT_FLIGHTS from fl group by FL_DATE, ORIGIN) o
  full outer join (select FL_DATE, DEST as AIRPORT, sum(FLIGHTS) as IN_FLIGHTS from fl group by FL_DATE, DEST) i
    on o.FL_DATE = i.FL_DATE and o.AIRPORT = i.AIRPORT""")

# ---------------------------------------------------------------- windows / sort / sets
ORACLE["win_top_airports"] = q("select * from top_air")
ORACLE["win_row_percent"] = q("""
select DAY_OF_WEEK, ARR_DELAY_GROUP, FLIGHTS,
       round(100.0 * FLIGHTS / sum(FLIGHTS) over (partition by DAY_OF_WEEK), 6) as PCT
  from (select DAY_OF_WEEK, ARR_DELAY_GROUP, sum(FLIGHTS) as FLIGHTS from fl where ARR_DELAY_GROUP is not null
         group by DAY_OF_WEEK, ARR_DELAY_GROUP) z""")
ORACLE["win_cause_rate"] = q("select DAY_OF_WEEK, " + ", ".join(
    f"round(sum(case when {c} > 0 then 1 else 0 end) / nullif(sum(case when ARR_DELAY_GROUP between 0 and 12 "
    f"then FLIGHTS end), 0), 6) as {c}" for c in CAUSES) + " from fl group by DAY_OF_WEEK")
ORACLE["win_same_week_last_year"] = q("""
select w.YEAR, w.WEEK_OF_YEAR, w.CARRIER, w.FLIGHTS, w.ARR_DEL, p.FLIGHTS as FLIGHTS_LY, p.ARR_DEL as ARR_DEL_LY
  from wk w left join wk p on p.YEAR = w.YEAR - 1 and p.WEEK_OF_YEAR = w.WEEK_OF_YEAR and p.CARRIER = w.CARRIER""",
    "wk as (select YEAR, WEEK_OF_YEAR, CARRIER, sum(FLIGHTS) as FLIGHTS, sum(ARR_DEL15) as ARR_DEL from fl "
    "group by YEAR, WEEK_OF_YEAR, CARRIER)")
ORACLE["win_dense_relabel"] = Q("""
select YEAR, IATA, cast(dense_rank() over (partition by YEAR order by CLASS * 10 + 3) - 1 as int) as CLASS from as6""")
ORACLE["srt_by_date"] = q("select FL_DATE, CARRIER, ORIGIN, DEST, ARR_DELAY from sample")
ORACLE["srt_group_year"] = q("select YEAR, CARRIER, count(CARRIER) as CNT from fl group by YEAR, CARRIER")
AFEAT_NUM = ["DEP_FLIGHTS"] + AIRPORT_NUMERIC[1:] + ["LAT", "LON", "REC_TIME"]
VAR_ROWS = " union all ".join(f"select '{c}' as FEATURE, round(var_samp({c}), 6) as VARIANCE from afeat"
                              for c in AFEAT_NUM)
ORACLE["srt_variance_rank"] = Q(f"select FEATURE, VARIANCE, cast(row_number() over (order by VARIANCE desc, FEATURE) "
                                f"as int) as RANK from ({VAR_ROWS}) v")
ORACLE["stat_variance"] = Q(f"select * from ({VAR_ROWS}) v")
ORACLE["srt_topk"] = q("select ORIGIN, count(ORIGIN) as CNT from fl group by ORIGIN order by CNT desc, ORIGIN limit 5")
ORACLE["set_union_all"] = Q("select * from abase")
ORACLE["set_major_airports"] = q("select distinct ORIGIN from top_air")
ORACLE["set_carrier_exclusion"] = q("select * from major_airlines where CARRIER not in (select distinct CARRIER from sub)")

# ---------------------------------------------------------------- functions
HOL = """
yrs as (select distinct YEAR as Year from fl),
rules(h, m, r, k, w) as (values ('New Year''s Day', 1, 'fixed', 1, 0),
  ('Birthday of Martin Luther King, Jr.', 1, 'nth', 3, 1), ('Washington''s Birthday', 2, 'nth', 3, 1),
  ('Memorial Day', 5, 'last', 0, 1), ('Independence Day', 7, 'fixed', 4, 0), ('Labor Day', 9, 'nth', 1, 1),
  ('Columbus Day', 10, 'nth', 2, 1), ('Veterans Day', 11, 'fixed', 11, 0), ('Thanksgiving Day', 11, 'nth', 4, 4),
  ('Christmas Day', 12, 'fixed', 25, 0)),
hb as (select cast(y.Year as int) as Year, r.*, make_date(y.Year, r.m, 1) as first_day,
              make_date(y.Year, r.m, case when r.r = 'fixed' then r.k else 1 end) as fixed_day
         from yrs y, rules r),
hol as (select Year, cast(case
    when r = 'fixed' and isodow(fixed_day) = 6 then fixed_day - 1
    when r = 'fixed' and isodow(fixed_day) = 7 then fixed_day + 1
    when r = 'fixed' then fixed_day
    when r = 'nth' then first_day + cast(((w - isodow(first_day) + 7) % 7 + (k - 1) * 7) as int)
    else last_day(first_day) - cast(((isodow(last_day(first_day)) - w + 7) % 7) as int) end as date) as Date,
    h as Holiday from hb),
holm as (select *, cast(month(Date) as int) as Month, cast(weekofyear(Date) as int) as Week from hol)
"""
HOL_AROUND = HOL.replace("select distinct YEAR as Year from fl",
                         "select unnest(range(min(YEAR) - 1, max(YEAR) + 2)) as Year from fl")
ORACLE["fn_iso_week"] = q("select distinct YEAR, MONTH, DAY_OF_MONTH, cast(weekofyear(make_date(YEAR, MONTH, "
                          "DAY_OF_MONTH)) as int) as WEEK from fl")
ORACLE["fn_clean_date"] = q("select Year, Holiday, strftime(Date, '%A, %B %-d') as TEXT, "
                            "make_date(Year, month(Date), day(Date)) as DATE from hol", HOL)
ORACLE["fn_date_parts"] = q("select Year, Date, Holiday, cast(month(Date) as int) as Month, "
                            "cast(weekofyear(Date) as int) as Week, cast(isodow(Date) as int) as DayOfWeek from hol", HOL)
ORACLE["fn_to_date"] = q("select distinct strftime(FL_DATE, '%-m/%-d/%y') as TEXT, FL_DATE as DATE from fl")
ORACLE["fn_rec_time"] = q("""select FL_DATE, CARRIER, ORIGIN, DEST, DEP_DELAY, ARR_DELAY,
  case when DEP_DELAY < 0 and ARR_DELAY < 0 then -DEP_DELAY - ARR_DELAY else DEP_DELAY - ARR_DELAY end as REC_TIME
  from fl""")
ORACLE["fn_rec_time_agg"] = Q("select YEAR, IATA, DDEL2 - ADEL2 as REC_TIME from abase")
ORACLE["fn_route"] = q("select distinct ORIGIN || '-' || DEST as ROUTE from fl")
ORACLE["fn_ave_speed"] = Q("select YEAR, ORIGIN, DEST, round(DISTANCE / nullif(AIR_TIME, 0), 6) as AVE_SPEED from rv2")
ORACLE["fn_relative_delay"] = Q("""select YEAR, ORIGIN, DEST, round(DDEL1 / nullif(AIR_TIME, 0), 6) as REL_DDEL,
  round(ADEL1 / nullif(AIR_TIME, 0), 6) as REL_ADEL, round((DDEL2 - ADEL2) / nullif(AIR_TIME, 0), 6) as REL_RTIME from rv2""")
ORIGIN_NORM = ["DEP_DEL", "DDEL1", "DDEL2", "CANCELLED", "SEC_DEL", "CAR_DEL", "NAS_DEL", "WEA_DEL", "LAD_DEL"]
ORACLE["fn_normalize"] = Q("select YEAR, IATA as ORIGIN, DEP_FLIGHTS as FLIGHTS, " + ", ".join(
    f"round({c} / nullif(DEP_FLIGHTS, 0), 6) as {c}" for c in ORIGIN_NORM) + " from ao")
ORACLE["fn_sq_distance"] = q("""
select r.YEAR, r.ORIGIN, r.DEST, (o.lat - d.lat) * (o.lat - d.lat) + (o.lon - d.lon) * (o.lon - d.lon) as D2
  from (select distinct YEAR, ORIGIN, DEST from fl) r join airports o on o.iata = r.ORIGIN
  join airports d on d.iata = r.DEST""")
ORACLE["fn_label_text"] = q("select Year, Date, cast(isodow(Date) as varchar) || ' - ' || Holiday as LABEL from hol", HOL)

# ---------------------------------------------------------------- imputation
ORACLE["imp_most_frequent"] = Q("select * from rimp")


def _year_mode(c: str) -> str:
    return (f"ym_{c} as (select YEAR, {c} as m from (select YEAR, {c}, row_number() over (partition by YEAR "
            f"order by count(*) desc, {c}) as rn from abase where {c} is not null group by YEAR, {c}) z where rn = 1)")


ORACLE["imp_mode_by_year"] = Q(
    "select b.YEAR, b.IATA, " + ", ".join(f"coalesce(b.{c}, ym_{c}.m, 0) as {c}" for c in AIRPORT_NUMERIC)
    + ", b.LAT, b.LON from abase b " + " ".join(f"left join ym_{c} on ym_{c}.YEAR = b.YEAR" for c in AIRPORT_NUMERIC),
    ",\n".join(_year_mode(c) for c in AIRPORT_NUMERIC))

# ---------------------------------------------------------------- reshaping
CODES = [f"C{i:02d}" for i in range(1, 26)]
ORACLE["pivot_carrier_year"] = q("select YEAR, " + ", ".join(
    f"cast(sum(case when CARRIER = '{c}' then CNT end) as bigint) as {c}" for c in CODES)
    + " from (select YEAR, CARRIER, count(CARRIER) as CNT from fl group by YEAR, CARRIER) z group by YEAR")


def gname(g: int) -> str:
    return f"G{g}".replace("-", "M")


def pivot_sql(index: str) -> str:
    return (f"select {index}, " + ", ".join(
        f"sum(case when ARR_DELAY_GROUP = {g} then FLIGHTS end) as {gname(g)}" for g in range(-2, 13))
        + f" from fl group by {index}")


ORACLE["pivot_week"] = q(pivot_sql("WEEK_OF_YEAR"))
ORACLE["pivot_day_of_month"] = q(pivot_sql("DAY_OF_MONTH"))
ORACLE["pivot_day_of_week"] = q(pivot_sql("DAY_OF_WEEK"))
ORACLE["pivot_month"] = q(pivot_sql("MONTH"))
BLOCKS = """blocks as (select BLOCK, substr(BLOCK, 1, 2) || ':' || substr(BLOCK, 3, 2) || '-' || substr(BLOCK, 6, 2)
  || ':' || substr(BLOCK, 8, 2) as LABEL from (select DEP_TIME_BLK as BLOCK from fl union select ARR_TIME_BLK from fl) z)"""
ORACLE["pivot_dep_block"] = q(f"select p.*, b.LABEL from ({pivot_sql('DEP_TIME_BLK')}) p left join blocks b "
                              "on b.BLOCK = p.DEP_TIME_BLK", BLOCKS)
ORACLE["pivot_arr_block"] = q(f"select p.*, b.LABEL from ({pivot_sql('ARR_TIME_BLK')}) p left join blocks b "
                              "on b.BLOCK = p.ARR_TIME_BLK", BLOCKS)

# ---------------------------------------------------------------- joins
ORACLE["join_origin_dest"] = Q("select * from aod")
ORACLE["join_coords"] = Q("select * from abase")
ORACLE["join_rank_left"] = Q("select * from hubair")
ORACLE["join_flight_origin"] = Q("""
select m.*, h.C1 as C1_ORIG, h.C2 as C2_ORIG, h.RANK as RANK_ORIG, h.ENPLANEMENT as ENPLANEMENT_ORIG,
       h.CHANGE as CHANGE_ORIG from mdata m left join hubair h on h.YEAR = m.YEAR and h.IATA = m.ORIGIN""")
ORACLE["join_flight_dest"] = Q("""
select m.*, h.C1 as C1_DEST, h.C2 as C2_DEST, h.RANK as RANK_DEST, h.ENPLANEMENT as ENPLANEMENT_DEST,
       h.CHANGE as CHANGE_DEST from mdata m left join hubair h on h.YEAR = m.YEAR and h.IATA = m.DEST""")
ORACLE["join_model_table"] = Q("""
select m.YEAR, m.MONTH, m.DAY_OF_MONTH, m.DAY_OF_WEEK, m.ORIGIN, m.DEST, m.CARRIER, m.DEP_DEL, m.DDEL1, m.DDEL2,
       o.C1 as C1_ORIG, o.C2 as C2_ORIG, o.RANK as RANK_ORIG, o.ENPLANEMENT as ENP_ORIG, o.CHANGE as CHA_ORIG,
       d.C1 as C1_DEST, d.C2 as C2_DEST, d.RANK as RANK_DEST, d.ENPLANEMENT as ENP_DEST, d.CHANGE as CHA_DEST,
       rc.C as C_FLIGHT
  from mdata m left join hubair o on o.YEAR = m.YEAR and o.IATA = m.ORIGIN
  left join hubair d on d.YEAR = m.YEAR and d.IATA = m.DEST
  left join rc on rc.YEAR = m.YEAR and rc.ORIGIN = m.ORIGIN and rc.DEST = m.DEST""")
ORACLE["join_semi_dims"] = q("""select ORIGIN, YEAR, MONTH, count(*) as N from fl
 where ORIGIN in (select CODE from major_airports) and CARRIER in (select CARRIER from major_airlines)
 group by ORIGIN, YEAR, MONTH""")
ORACLE["join_name_code"] = q("""
select p.variables, p.ORIGIN, a.HUB_NM as ORIGIN_NM, b.CODE as ORIGIN_BACK, p.CARRIER, c.Description as CARRIER_NM
  from preq2 p left join major_airports a on a.CODE = p.ORIGIN left join carriers c on c.Code = p.CARRIER
  left join major_airports b on b.HUB_NM = a.HUB_NM""", OSUM)
ORACLE["join_holiday_week"] = q("""
select w.YEAR, w.WEEK_OF_YEAR, w.FLIGHTS, h.HOLIDAYS
  from (select YEAR, WEEK_OF_YEAR, sum(FLIGHTS) as FLIGHTS from fl group by YEAR, WEEK_OF_YEAR) w
  left join (select year(Date) as Year, Week, string_agg(cast(isodow(Date) as varchar) || ' - ' || Holiday, '; ' order by Date)
               as HOLIDAYS from holm group by 1, 2) h on h.Year = w.YEAR and h.Week = w.WEEK_OF_YEAR""", HOL_AROUND)
ORACLE["join_nearest_holiday"] = q("""
select FL_DATE, Date as HOLIDAY_DATE, Holiday as HOLIDAY, cast(Date - FL_DATE as int) as DAYS_TO_HOLIDAY
  from (select d.FL_DATE, h.Date, h.Holiday,
               row_number() over (partition by d.FL_DATE order by abs(h.Date - d.FL_DATE), h.Date, h.Holiday) as rn
          from (select distinct FL_DATE from fl) d, hol h) z where rn = 1""", HOL_AROUND)
ORACLE["join_flight_holiday"] = q("""
select f.FL_DATE, f.CARRIER, f.ORIGIN, f.DEST, f.ARR_DELAY, n.HOLIDAY_DATE, n.HOLIDAY, n.DAYS_TO_HOLIDAY
  from fl f left join near n on n.FL_DATE = f.FL_DATE""", HOL_AROUND + """,
near as (select FL_DATE, Date as HOLIDAY_DATE, Holiday as HOLIDAY, cast(Date - FL_DATE as int) as DAYS_TO_HOLIDAY
  from (select d.FL_DATE, h.Date, h.Holiday,
               row_number() over (partition by d.FL_DATE order by abs(h.Date - d.FL_DATE), h.Date, h.Holiday) as rn
          from (select distinct FL_DATE from fl) d, hol h) z where rn = 1)""")

ORACLE["join_asof"] = q("""
select ORIGIN, FL_DATE, NEAREST, cast(NEAREST - FL_DATE as int) as DAYS_TO
  from (select l.ORIGIN, l.FL_DATE, r.FL_DATE as NEAREST,
               row_number() over (partition by l.ORIGIN, l.FL_DATE order by abs(r.FL_DATE - l.FL_DATE), r.FL_DATE) as rn
          from (select distinct ORIGIN, FL_DATE from fl) l
          left join (select distinct ORIGIN, FL_DATE from fl where CANCELLED = 1) r on r.ORIGIN = l.ORIGIN) z where rn = 1""")

# ---------------------------------------------------------------- statistics
CORR_FEATS = AFEAT_NUM


def _corr_rows(feats: list[str] = CORR_FEATS, src: str = "afeat", by: str = "") -> str:
    rows = []
    key, group = (f"{by}, ", f" group by {by}") if by else ("", "")
    for i, a in enumerate(feats):
        for b in feats[i + 1:]:
            e = (f"case when stddev_pop({a}) = 0 or stddev_pop({b}) = 0 then null else corr({a}, {b}) end")
            rows.append(f"select {key}'{a}' as F1, '{b}' as F2, round({e}, 6) as CORR from {src}{group}")
            rows.append(f"select {key}'{b}' as F1, '{a}' as F2, round({e}, 6) as CORR from {src}{group}")
        rows.append(f"select {key}'{a}' as F1, '{a}' as F2, case when stddev_pop({a}) > 0 then 1.0 end as CORR "
                    f"from {src}{group}")
    return " union all ".join(rows)


ORACLE["stat_corr_matrix"] = Q(f"select * from ({_corr_rows()}) c")
RFEAT_NUM = ["FLIGHTS", "CARRIER", "DISTANCE", "AIR_TIME", "AVE_SPEED"] + ROUTE_NORM
ORACLE["stat_corr_route"] = Q(f"select * from ({_corr_rows(RFEAT_NUM, 'rfeat')}) c")
ORACLE["stat_corr_by_year"] = Q(f"select * from ({_corr_rows(['SEC_DEL', 'WEA_DEL', 'LAT', 'LON'], 'afeat', 'YEAR')}) c")
ORACLE["stat_variance_route"] = Q(" union all ".join(
    f"select '{c}' as FEATURE, round(var_samp({c}), 6) as VARIANCE from rfeat" for c in RFEAT_NUM))
ORACLE["stat_corr_filter"] = Q(f"""
select F1 as FEATURE, max(abs(CORR)) as MAX_ABS_CORR, coalesce(max(abs(CORR)) < 0.5, true) as LOW
  from ({_corr_rows()}) c where F1 <> F2 group by F1""")
ORACLE["stat_histogram"] = q("""
select b.BIN, round(s.lo + b.BIN * s.w, 6) as LOWER, round(s.lo + (b.BIN + 1) * s.w, 6) as UPPER,
       coalesce(c.CNT, 0) as CNT, round(coalesce(c.CNT, 0) / (s.n * s.w), 6) as DENSITY
  from (select cast(range as int) as BIN from range(10)) b
  cross join st s
  left join (select cast(least(floor((ARR_DELAY - (select lo from st)) / (select w from st)), 9) as int) as BIN,
                    count(*) as CNT from fl where ARR_DELAY is not null group by 1) c on c.BIN = b.BIN""",
    """st0 as (select min(ARR_DELAY) as mn, max(ARR_DELAY) as mx, count(ARR_DELAY) as n from fl),
st as (select case when mn = mx then mn - 0.5 else mn end as lo, n,
              ((case when mn = mx then mx + 0.5 else mx end) - (case when mn = mx then mn - 0.5 else mn end)) / 10.0 as w
         from st0)""")
ORACLE["stat_three_sigma"] = q("""
select FL_DATE, CARRIER, ORIGIN, DEST, ARR_DELAY from fl
 where abs(ARR_DELAY - (select avg(ARR_DELAY) from fl)) <= 3.0 * (select stddev_samp(ARR_DELAY) from fl)""")


def _cov_rows() -> str:
    rows = []
    for i, a in enumerate(CL_FEATS):
        for b in CL_FEATS[i + 1:] + [a]:
            # + 0.0 turns a rounded -0.0 into 0.0, as Spark's round returns
            rows.append(f"select '{a}' as F1, '{b}' as F2, round(covar_samp({a}, {b}), 6) + cast(0 as double) "
                        f"as COV from afeat")
    return " union all ".join(rows)


ORACLE["ml_covariance"] = Q(f"select * from ({_cov_rows()}) c")

# ---------------------------------------------------------------- features / kernels
ORACLE["pipe_airport_features"] = Q("select * from afeat")
ORACLE["pipe_route_features"] = Q("select YEAR, ORIGIN, DEST, " + ", ".join(
    f"round({c}, 6) as {c}" for c in ["FLIGHTS", "CARRIER", "DISTANCE", "AIR_TIME", "AVE_SPEED"] + ROUTE_NORM)
    + " from rfeat")
ORACLE["ml_standard_scale"] = Q("select f.YEAR, f.IATA, " + ", ".join(
    f"round((f.{c} - s.m_{c}) / s.s_{c}, 6) as {c}" for c in AFEAT_NUM) + " from afeat f, (select " + ", ".join(
    f"avg({c}) as m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) as s_{c}" for c in AFEAT_NUM) + " from afeat) s")
ORACLE["ml_robust_scale"] = Q("select f.YEAR, f.IATA, " + ", ".join(
    f"round((f.{c} - s.m_{c}) / s.s_{c}, 6) as {c}" for c in AFEAT_NUM) + " from afeat f, (select " + ", ".join(
    f"quantile_cont({c}, 0.5) as m_{c}, coalesce(nullif(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 0), 1)"
    f" as s_{c}" for c in AFEAT_NUM) + " from afeat) s")
ORACLE["ml_kmeans_assign"] = Q("select YEAR, IATA, CLASS, D2 from as4")
ORACLE["ml_kmeans_step"] = Q("select CLASS, count(*) as N, " + ", ".join(
    f"round(avg({c}), 6) as {c}" for c in CL_FEATS) + " from as4 group by CLASS")
ORACLE["ml_sse"] = Q("select CLASS, count(*) as N, round(sum(D2), 6) as SSE from as4 group by CLASS")
ORACLE["ml_merge_small"] = Q("""
select YEAR, IATA, cast(dense_rank() over (partition by YEAR order by C2) - 1 as int) as CLASS
  from (select a.YEAR, a.IATA, case when n.n < 3 then 10000 else a.CLASS end as C2
          from as6 a join (select YEAR, CLASS, count(*) as n from as6 group by YEAR, CLASS) n
            on n.YEAR = a.YEAR and n.CLASS = a.CLASS) z""")
ORACLE["ml_merge_map"] = Q("select YEAR, IATA, case CLASS when 6 then 1 when 8 then 3 else CLASS end as CLASS from as10")
ORACLE["ml_pca_norms"] = Q("select f.YEAR, f.IATA, round(" + " + ".join(
    f"(f.{c} - m.{c}) * (f.{c} - m.{c})" for c in CL_FEATS) + ", 4) as D2 from afeat f, (select " + ", ".join(
    f"avg({c}) as {c}" for c in CL_FEATS) + " from afeat) m")
ORACLE["ml_kmeans_nearest"] = Q("select YEAR, IATA, true as NEAREST, true as MEAN from afeat")
ORACLE["ml_total_ss"] = Q(" union all ".join(
    f"select '{c}' as FEATURE, round(case when stddev_pop({c}) > 0 then count({c}) else 0 end, 4)::double as SSE from afeat"
    for c in ["SEC_DEL", "WEA_DEL", "LAT", "LON"]))
ORACLE["prj_kept_features"] = Q(" union all ".join(
    f"select '{c}' as FEATURE from afeat having coalesce(var_samp(cast({c} as double)) >= 0.1, true)"
    for c in AFEAT_NUM))
ORACLE["ml_merge_nearest"] = Q("""
select a.YEAR, a.IATA, coalesce(m.TARGET, a.CLASS) as CLASS
  from as10 a
  left join (select CLASS, TARGET from (
               select s.CLASS, l.CLASS as TARGET, row_number() over (partition by s.CLASS order by round("""
    + " + ".join(f"(s.{c} - l.{c}) * (s.{c} - l.{c})" for c in CL_FEATS) + """, 6), l.CLASS) as rn
                 from cen10 s, cen10 l where s.n < 40 and l.n >= 40) z where rn = 1) m
    on m.CLASS = a.CLASS""", "cen10 as (select CLASS, count(*) as n, " + ", ".join(
    f"avg({c}) as {c}" for c in CL_FEATS) + " from as10 group by CLASS)")
ORACLE["ml_grid_bounds"] = Q("select cast(n.range as int) as N, cast(k as int) as K, true as WITHIN, "
    "case when n.range = 6 and k = 1 then round((select " + " + ".join(
        f"var_pop({c}) * count({c})" for c in CL_FEATS) + " from afeat), 2) end as TOTAL_SS "
    "from range(1, 7) n, (values (1), (2), (4), (8)) as t(k)")
ORACLE["ml_year_classes"] = Q("select YEAR, IATA, true as DENSE, true as MERGED from abase")
ORACLE["snk_cluster_pipeline"] = Q("select YEAR, ORIGIN, DEST, true as SAME, true as NEAREST from rfeat")
