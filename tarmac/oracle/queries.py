"""Oracle SQL (DuckDB) for every deterministic query key.

Written as plain SQL from the operator definitions, sharing no code with
the Spark implementation; ``fixture.sql`` prepends the data-model CTEs.
"""

from __future__ import annotations

from tarmac.oracle.fixture import sql

ORACLE: dict[str, str] = {}

# ---------------------------------------------------------------- shared CTEs
MAJOR = """
mc as (select CARRIER from (select CARRIER, count(distinct YEAR) as n from fl where CARRIER is not null group by CARRIER) q
        where n = (select count(distinct YEAR) from fl)),
major_airlines as (select distinct Code as CARRIER, Description as CARRIER_NM from carriers where Code in (select CARRIER from mc)),
top_air as (select * from (select YEAR, ORIGIN, count(ORIGIN) as CNT,
                   cast(row_number() over (partition by YEAR order by count(ORIGIN) desc, ORIGIN) as int) as RANK
              from fl group by YEAR, ORIGIN) q where RANK <= 20),
major_airports as (select distinct iata as CODE, airport as HUB_NM, city as CITY, state as STATE, lat as LAT, lon as LON
                     from airports where iata in (select ORIGIN from top_air)),
sub as (select YEAR, MONTH, DAY_OF_MONTH, CARRIER, ORIGIN, DEST, FLIGHTS, DEP_DEL15, ARR_DEL15, DEP_DELAY, ARR_DELAY,
               DEP_DELAY_NEW, ARR_DELAY_NEW, AIR_TIME, DISTANCE, TAXI_IN, TAXI_OUT, CANCELLED, DIVERTED,
               cast(weekofyear(make_date(YEAR, MONTH, DAY_OF_MONTH)) as int) as WEEK_OF_YEAR
          from fl where CARRIER in (select CARRIER from major_airlines)
           and ORIGIN in (select CODE from major_airports) and DEST in (select CODE from major_airports)),
hubs as (select distinct Locid from ranks where Hub = 'L' and Locid is not null),
sample as (select * from fl where YEAR = 2010 and CARRIER in (select CARRIER from major_airlines)
             and ORIGIN in (select Locid from hubs) and DEST in (select Locid from hubs))
"""


def q(body: str, ctes: str = "") -> str:
    return sql(body, MAJOR + ("," + ctes if ctes.strip() else ""))


# ---------------------------------------------------------------- aggregates
ORACLE["agg_per_origin"] = q("""
select YEAR, ORIGIN, sum(FLIGHTS) as FLIGHTS, sum(DEP_DEL15) as DEP_DEL, sum(DEP_DELAY) as DDEL1,
       sum(DEP_DELAY_NEW) as DDEL2, sum(CANCELLED) as CANCELLED, sum(SECURITY_DELAY) as SEC_DEL,
       sum(CARRIER_DELAY) as CAR_DEL, sum(NAS_DELAY) as NAS_DEL, sum(WEATHER_DELAY) as WEA_DEL,
       sum(LATE_AIRCRAFT_DELAY) as LAD_DEL
  from fl group by YEAR, ORIGIN""")

ORACLE["agg_per_destination"] = q("""
select YEAR, DEST, sum(FLIGHTS) as FLIGHTS, sum(ARR_DEL15) as ARR_DEL, sum(ARR_DELAY) as ADEL1,
       sum(ARR_DELAY_NEW) as ADEL2, sum(DIVERTED) as DIVERTED
  from fl group by YEAR, DEST""")

ORACLE["agg_per_airline"] = q("""
select YEAR, CARRIER, sum(FLIGHTS) as FLIGHTS, sum(ARR_DEL15) as ARR_DEL, sum(ARR_DELAY) as ADEL1,
       sum(ARR_DELAY_NEW) as ADEL2, sum(DIVERTED) as DIVERTED, sum(DEP_DEL15) as DEP_DEL, sum(DEP_DELAY) as DDEL1,
       sum(DEP_DELAY_NEW) as DDEL2, sum(CANCELLED) as CANCELLED, sum(SECURITY_DELAY) as SEC_DEL,
       sum(CARRIER_DELAY) as CAR_DEL, sum(NAS_DELAY) as NAS_DEL, sum(WEATHER_DELAY) as WEA_DEL,
       sum(LATE_AIRCRAFT_DELAY) as LAD_DEL
  from fl group by YEAR, CARRIER""")

ROUTE_SQL = """
select YEAR, ORIGIN, DEST, sum(FLIGHTS) as FLIGHTS, sum(ARR_DEL15) as ARR_DEL, sum(DISTANCE) as DISTANCE,
       sum(AIR_TIME) as AIR_TIME, sum(ARR_DELAY) as ADEL1, sum(ARR_DELAY_NEW) as ADEL2, sum(DIVERTED) as DIVERTED,
       sum(DEP_DEL15) as DEP_DEL, sum(DEP_DELAY) as DDEL1, sum(DEP_DELAY_NEW) as DDEL2, sum(CANCELLED) as CANCELLED,
       sum(SECURITY_DELAY) as SEC_DEL, sum(CARRIER_DELAY) as CAR_DEL, sum(NAS_DELAY) as NAS_DEL,
       sum(WEATHER_DELAY) as WEA_DEL, sum(LATE_AIRCRAFT_DELAY) as LAD_DEL
  from fl group by YEAR, ORIGIN, DEST"""
ORACLE["agg_per_route"] = q(ROUTE_SQL)

ROUTE_V2_SQL = """
select YEAR, ORIGIN, DEST, FLIGHTS, CARRIER, DEP_DEL, ARR_DEL, DISTANCE / FLIGHTS as DISTANCE,
       AIR_TIME / FLIGHTS as AIR_TIME, DDEL1, DDEL2, ADEL1, ADEL2, DIVERTED, CANCELLED, SEC_DEL, CAR_DEL, NAS_DEL,
       WEA_DEL, LAD_DEL
  from (select YEAR, ORIGIN, DEST, sum(FLIGHTS) as FLIGHTS, count(distinct CARRIER) as CARRIER,
               sum(DEP_DEL15) as DEP_DEL, sum(ARR_DEL15) as ARR_DEL, sum(DISTANCE) as DISTANCE,
               sum(AIR_TIME) as AIR_TIME, sum(DEP_DELAY) as DDEL1, sum(DEP_DELAY_NEW) as DDEL2,
               sum(ARR_DELAY) as ADEL1, sum(ARR_DELAY_NEW) as ADEL2, sum(DIVERTED) as DIVERTED,
               sum(CANCELLED) as CANCELLED, sum(SECURITY_DELAY) as SEC_DEL, sum(CARRIER_DELAY) as CAR_DEL,
               sum(NAS_DELAY) as NAS_DEL, sum(WEATHER_DELAY) as WEA_DEL, sum(LATE_AIRCRAFT_DELAY) as LAD_DEL
          from fl group by YEAR, ORIGIN, DEST) a"""
ORACLE["agg_per_route_v2"] = q(ROUTE_V2_SQL)

ORACLE["agg_carrier_year_count"] = q("select YEAR, CARRIER, count(CARRIER) as CNT from fl group by YEAR, CARRIER")

ORACLE["agg_origin_month"] = q("""
select ORIGIN, YEAR, MONTH, sum(FLIGHTS) as FLIGHTS, sum(DEP_DELAY_NEW) as DELAY, sum(DEP_DEL15) as DEL15,
       sum(CANCELLED) as CANCELLED
  from fl where ORIGIN in (select CODE from major_airports) group by ORIGIN, YEAR, MONTH""")

ORACLE["agg_dest_month"] = q("""
select DEST, YEAR, MONTH, sum(FLIGHTS) as FLIGHTS, sum(ARR_DELAY_NEW) as DELAY, sum(ARR_DEL15) as DEL15,
       sum(DIVERTED) as DIVERTED
  from fl where DEST in (select CODE from major_airports) group by DEST, YEAR, MONTH""")

# ---------------------------------------------------------------- dimensions
ORACLE["pipe_major_airlines"] = q("select * from major_airlines")
ORACLE["pipe_major_airports"] = q("select * from major_airports")
ORACLE["pipe_flights_subset"] = q("select * from sub")
ORACLE["pipe_large_hubs"] = q("select * from hubs")
ORACLE["pipe_year_sample"] = q("select * from sample")

# ---------------------------------------------------------------- summaries
OSUM = """
osum as (select YEAR, WEEK_OF_YEAR, CARRIER, ORIGIN, count(*) as nflights,
                cast(round(100.0 * sum(DEP_DEL15) / count(*), 0) as int) as delay_rate,
                cast(round(100.0 * sum(CANCELLED) / count(*), 0) as int) as cd_rate,
                cast(round(avg(DEP_DELAY_NEW), 0) as int) as mean_delay_time,
                cast(round(case when count(DEP_DELAY_NEW) >= 2 then sqrt(greatest(count(DEP_DELAY_NEW) * sum(DEP_DELAY_NEW * DEP_DELAY_NEW) - sum(DEP_DELAY_NEW) * sum(DEP_DELAY_NEW), 0) / (count(DEP_DELAY_NEW) * (count(DEP_DELAY_NEW) - 1))) end, 0) as int) as std_delay_time
           from sub group by YEAR, WEEK_OF_YEAR, CARRIER, ORIGIN),
dsum as (select YEAR, WEEK_OF_YEAR, CARRIER, DEST, count(*) as nflights,
                cast(round(100.0 * sum(ARR_DEL15) / count(*), 0) as int) as delay_rate,
                cast(round(100.0 * sum(DIVERTED) / count(*), 0) as int) as cd_rate,
                cast(round(avg(ARR_DELAY_NEW), 0) as int) as mean_delay_time,
                cast(round(case when count(ARR_DELAY_NEW) >= 2 then sqrt(greatest(count(ARR_DELAY_NEW) * sum(ARR_DELAY_NEW * ARR_DELAY_NEW) - sum(ARR_DELAY_NEW) * sum(ARR_DELAY_NEW), 0) / (count(ARR_DELAY_NEW) * (count(ARR_DELAY_NEW) - 1))) end, 0) as int) as std_delay_time
           from sub group by YEAR, WEEK_OF_YEAR, CARRIER, DEST),
rsum as (select YEAR, WEEK_OF_YEAR, CARRIER, ORIGIN, DEST, cast(count(*) as varchar) as nflights,
                coalesce(cast(cast(round(avg(ARR_DELAY_NEW), 0) as int) as varchar), 'NA') as mean_adelay_time,
                coalesce(cast(cast(round(avg(DEP_DELAY_NEW), 0) as int) as varchar), 'NA') as mean_ddelay_time,
                coalesce(cast(cast(round(case when count(ARR_DELAY_NEW) >= 2 then sqrt(greatest(count(ARR_DELAY_NEW) * sum(ARR_DELAY_NEW * ARR_DELAY_NEW) - sum(ARR_DELAY_NEW) * sum(ARR_DELAY_NEW), 0) / (count(ARR_DELAY_NEW) * (count(ARR_DELAY_NEW) - 1))) end, 0) as int) as varchar), 'NA') as std_adelay_time,
                coalesce(cast(cast(round(case when count(DEP_DELAY_NEW) >= 2 then sqrt(greatest(count(DEP_DELAY_NEW) * sum(DEP_DELAY_NEW * DEP_DELAY_NEW) - sum(DEP_DELAY_NEW) * sum(DEP_DELAY_NEW), 0) / (count(DEP_DELAY_NEW) * (count(DEP_DELAY_NEW) - 1))) end, 0) as int) as varchar), 'NA') as std_ddelay_time,
                coalesce(cast(cast(round(100.0 * sum(ARR_DEL15) / count(*), 0) as int) as varchar), 'NA') as adel_rate,
                coalesce(cast(cast(round(100.0 * sum(DEP_DEL15) / count(*), 0) as int) as varchar), 'NA') as ddel_rate
           from sub group by YEAR, WEEK_OF_YEAR, CARRIER, ORIGIN, DEST),
preq as (select variables, split_part(variables, '__', 1) as ORIGIN, split_part(variables, '__', 2) as DEST,
                split_part(variables, '__', 3) as CARRIER,
                cast(strptime(split_part(variables, '__', 4), '%m/%d/%Y') as date) as FL_DATE
           from requests),
preq2 as (select *, cast(year(FL_DATE) as int) as YEAR, cast(weekofyear(FL_DATE) as int) as WEEK_OF_YEAR from preq)
"""
ORACLE["sum_origin"] = q("select * from osum", OSUM)
ORACLE["sum_destination"] = q("select * from dsum", OSUM)
ORACLE["sum_route"] = q("select * from rsum", OSUM)
ORACLE["fn_parse_request"] = q("select * from preq2", OSUM)
ORACLE["sum_defaults"] = q("""
select p.variables, p.ORIGIN, p.CARRIER, p.YEAR - 1 as PREV_YEAR, p.WEEK_OF_YEAR,
       coalesce(o.nflights, 0) as nflights,
       case when o.nflights is null then 100 else o.delay_rate end as delay_rate,
       case when o.nflights is null then 100 else o.cd_rate end as cd_rate,
       case when o.nflights is null then 100 else o.mean_delay_time end as mean_delay_time,
       case when o.nflights is null then 100 else o.std_delay_time end as std_delay_time
  from preq2 p left join osum o on o.YEAR = p.YEAR - 1 and o.WEEK_OF_YEAR = p.WEEK_OF_YEAR
   and o.CARRIER = p.CARRIER and o.ORIGIN = p.ORIGIN""", OSUM)

# ---------------------------------------------------------------- classifier
GNB = OSUM + """,
clean as (select * from sub where YEAR is not null and MONTH is not null and DAY_OF_MONTH is not null
            and CARRIER is not null and ORIGIN is not null and DEST is not null and FLIGHTS is not null
            and DEP_DEL15 is not null and ARR_DEL15 is not null and DEP_DELAY is not null and ARR_DELAY is not null
            and DEP_DELAY_NEW is not null and ARR_DELAY_NEW is not null and AIR_TIME is not null
            and DISTANCE is not null and TAXI_IN is not null and TAXI_OUT is not null and CANCELLED is not null
            and DIVERTED is not null and WEEK_OF_YEAR is not null),
enc as (select 'CARRIER' as FEATURE, v as VALUE, cast(row_number() over (order by v) - 1 as int) as CODE
          from (select distinct CARRIER as v from clean) a
        union all
        select 'ORIGIN', v, cast(row_number() over (order by v) - 1 as int) from (select distinct ORIGIN as v from clean) b
        union all
        select 'DEST', v, cast(row_number() over (order by v) - 1 as int) from (select distinct DEST as v from clean) c),
train as (select t.YEAR, t.MONTH, t.DAY_OF_MONTH, ec.CODE as CARRIER, eo.CODE as ORIGIN, ed.CODE as DEST, t.FLIGHTS,
                 t.DEP_DEL15, t.ARR_DEL15, t.DEP_DELAY, t.ARR_DELAY, t.DEP_DELAY_NEW, t.ARR_DELAY_NEW, t.AIR_TIME,
                 t.DISTANCE, t.TAXI_IN, t.TAXI_OUT, t.CANCELLED, t.DIVERTED, t.WEEK_OF_YEAR
            from clean t join enc ec on ec.FEATURE = 'CARRIER' and ec.VALUE = t.CARRIER
            join enc eo on eo.FEATURE = 'ORIGIN' and eo.VALUE = t.ORIGIN
            join enc ed on ed.FEATURE = 'DEST' and ed.VALUE = t.DEST),
eps as (select 1e-9 * greatest(var_pop(CARRIER), var_pop(ORIGIN), var_pop(DEST), var_pop(WEEK_OF_YEAR)) as e,
               count(*) as total from train),
model as (select cast(ARR_DEL15 as int) as CLASS, count(*) as N, count(*) * 1.0 / (select total from eps) as PRIOR,
                 avg(CARRIER) as MEAN_CARRIER, avg(ORIGIN) as MEAN_ORIGIN, avg(DEST) as MEAN_DEST,
                 avg(WEEK_OF_YEAR) as MEAN_WEEK_OF_YEAR,
                 var_pop(CARRIER) + (select e from eps) as VAR_CARRIER, var_pop(ORIGIN) + (select e from eps) as VAR_ORIGIN,
                 var_pop(DEST) + (select e from eps) as VAR_DEST,
                 var_pop(WEEK_OF_YEAR) + (select e from eps) as VAR_WEEK_OF_YEAR
            from train group by cast(ARR_DEL15 as int)),
m0 as (select * from model where CLASS = 0),
m1 as (select * from model where CLASS = 1),
scored as (select t.*,
  1.0 / (1.0 + exp(
    (ln(m0.PRIOR) - 0.5*ln(2*pi()*m0.VAR_CARRIER) - 0.5*(t.CARRIER - m0.MEAN_CARRIER)^2/m0.VAR_CARRIER
                  - 0.5*ln(2*pi()*m0.VAR_ORIGIN) - 0.5*(t.ORIGIN - m0.MEAN_ORIGIN)^2/m0.VAR_ORIGIN
                  - 0.5*ln(2*pi()*m0.VAR_DEST) - 0.5*(t.DEST - m0.MEAN_DEST)^2/m0.VAR_DEST
                  - 0.5*ln(2*pi()*m0.VAR_WEEK_OF_YEAR) - 0.5*(t.WEEK_OF_YEAR - m0.MEAN_WEEK_OF_YEAR)^2/m0.VAR_WEEK_OF_YEAR)
  - (ln(m1.PRIOR) - 0.5*ln(2*pi()*m1.VAR_CARRIER) - 0.5*(t.CARRIER - m1.MEAN_CARRIER)^2/m1.VAR_CARRIER
                  - 0.5*ln(2*pi()*m1.VAR_ORIGIN) - 0.5*(t.ORIGIN - m1.MEAN_ORIGIN)^2/m1.VAR_ORIGIN
                  - 0.5*ln(2*pi()*m1.VAR_DEST) - 0.5*(t.DEST - m1.MEAN_DEST)^2/m1.VAR_DEST
                  - 0.5*ln(2*pi()*m1.VAR_WEEK_OF_YEAR) - 0.5*(t.WEEK_OF_YEAR - m1.MEAN_WEEK_OF_YEAR)^2/m1.VAR_WEEK_OF_YEAR)
  )) as PROBA
  from train t, m0, m1),
thr as (select avg(ARR_DEL15) as t from train),
rq as (select p.variables, p.ORIGIN, p.DEST, p.CARRIER, p.YEAR, p.WEEK_OF_YEAR,
              ec.CODE as C_CODE, eo.CODE as O_CODE, ed.CODE as D_CODE
         from preq2 p left join enc ec on ec.FEATURE = 'CARRIER' and ec.VALUE = p.CARRIER
         left join enc eo on eo.FEATURE = 'ORIGIN' and eo.VALUE = p.ORIGIN
         left join enc ed on ed.FEATURE = 'DEST' and ed.VALUE = p.DEST),
rscored as (select r.variables, r.ORIGIN, r.DEST, r.CARRIER, r.YEAR, r.WEEK_OF_YEAR,
  round(100.0 / (1.0 + exp(
    (ln(m0.PRIOR) - 0.5*ln(2*pi()*m0.VAR_CARRIER) - 0.5*(r.C_CODE - m0.MEAN_CARRIER)^2/m0.VAR_CARRIER
                  - 0.5*ln(2*pi()*m0.VAR_ORIGIN) - 0.5*(r.O_CODE - m0.MEAN_ORIGIN)^2/m0.VAR_ORIGIN
                  - 0.5*ln(2*pi()*m0.VAR_DEST) - 0.5*(r.D_CODE - m0.MEAN_DEST)^2/m0.VAR_DEST
                  - 0.5*ln(2*pi()*m0.VAR_WEEK_OF_YEAR) - 0.5*(r.WEEK_OF_YEAR - m0.MEAN_WEEK_OF_YEAR)^2/m0.VAR_WEEK_OF_YEAR)
  - (ln(m1.PRIOR) - 0.5*ln(2*pi()*m1.VAR_CARRIER) - 0.5*(r.C_CODE - m1.MEAN_CARRIER)^2/m1.VAR_CARRIER
                  - 0.5*ln(2*pi()*m1.VAR_ORIGIN) - 0.5*(r.O_CODE - m1.MEAN_ORIGIN)^2/m1.VAR_ORIGIN
                  - 0.5*ln(2*pi()*m1.VAR_DEST) - 0.5*(r.D_CODE - m1.MEAN_DEST)^2/m1.VAR_DEST
                  - 0.5*ln(2*pi()*m1.VAR_WEEK_OF_YEAR) - 0.5*(r.WEEK_OF_YEAR - m1.MEAN_WEEK_OF_YEAR)^2/m1.VAR_WEEK_OF_YEAR)
  )), 2) as PROBABILITY
  from rq r, m0, m1)
"""
ORACLE["cls_training_frame"] = q("select * from train", GNB)
ORACLE["win_label_encode"] = q("select * from enc", GNB)
ORACLE["cls_gnb_fit"] = q("""
select CLASS, N, round(PRIOR, 6) as PRIOR, round(MEAN_CARRIER, 6) as MEAN_CARRIER, round(MEAN_ORIGIN, 6) as MEAN_ORIGIN,
       round(MEAN_DEST, 6) as MEAN_DEST, round(MEAN_WEEK_OF_YEAR, 6) as MEAN_WEEK_OF_YEAR,
       round(VAR_CARRIER, 6) as VAR_CARRIER, round(VAR_ORIGIN, 6) as VAR_ORIGIN, round(VAR_DEST, 6) as VAR_DEST,
       round(VAR_WEEK_OF_YEAR, 6) as VAR_WEEK_OF_YEAR from model""", GNB)
ORACLE["cls_gnb_proba"] = q("select CARRIER, ORIGIN, DEST, WEEK_OF_YEAR, ARR_DEL15, round(PROBA, 6) as PROBA from scored", GNB)
ORACLE["cls_threshold"] = q("""
select round((select t from thr), 6) as THRESHOLD,
       cast(sum(case when PROBA >= (select t from thr) then 1 else 0 end) as bigint) as N_PRED_LATE, count(*) as N from scored""", GNB)
EVAL = """
select round(avg((ARR_DEL15 - p)^2), 6) as MSE, round(avg(case when ARR_DEL15 = p then 1.0 else 0.0 end), 6) as ACCURACY,
       count(*) as N
  from (select ARR_DEL15, case when PROBA >= (select t from thr) then 1.0 else 0.0 end as p from scored) s"""
ORACLE["cls_evaluate"] = q(EVAL, GNB)
ORACLE["ml_metrics"] = q("""
select cast(sum(case when P >= (select t from thr) and Y = 1 then 1 else 0 end) as bigint) as TP,
       cast(sum(case when P >= (select t from thr) and Y <> 1 then 1 else 0 end) as bigint) as FP,
       cast(sum(case when P < (select t from thr) and Y <> 1 then 1 else 0 end) as bigint) as TN,
       cast(sum(case when P < (select t from thr) and Y = 1 then 1 else 0 end) as bigint) as FN,
       round(sum(case when Y = 1 then RANK_SUM else 0 end) / (sum(case when Y = 1 then 1.0 else 0.0 end)
             * sum(case when Y <> 1 then 1.0 else 0.0 end)), 6) as AUC,
       round(-avg(case when Y = 1 then ln(P) else ln(1 - P) end), 6) as LOG_LOSS
  from (select P, Y, coalesce(sum(case when Y <> 1 then 1.0 else 0.0 end) over (order by P range between unbounded preceding
                and 0 following), 0) - 0.5 * sum(case when Y <> 1 then 1.0 else 0.0 end) over (partition by P) as RANK_SUM
          from (select round(PROBA, 6) as P, ARR_DEL15 as Y from scored) s) z""", GNB)
ORACLE["cls_threshold_sweep"] = q("""
select T as THRESHOLD, TP, FP, TN, FN, round(TP / nullif(TP + FP, 0), 6) as PRECISION, round(TP / nullif(TP + FN, 0), 6) as RECALL,
       round(FP / nullif(FP + TN, 0), 6) as FALL_OUT, round((TP + TN) / (TP + FP + TN + FN), 6) as ACCURACY
  from (select t.T, cast(sum(case when P >= T and Y = 1 then 1 else 0 end) as bigint) as TP,
               cast(sum(case when P >= T and Y <> 1 then 1 else 0 end) as bigint) as FP,
               cast(sum(case when P < T and Y <> 1 then 1 else 0 end) as bigint) as TN,
               cast(sum(case when P < T and Y = 1 then 1 else 0 end) as bigint) as FN
          from (select distinct round(PROBA, 4) as T from scored) t,
               (select round(PROBA, 4) as P, ARR_DEL15 as Y from scored) s group by t.T) z""", GNB)
ORACLE["cls_score_requests"] = q("select * from rscored", GNB)
ORACLE["pipe_request_answer"] = q("""
select r.variables, r.PROBABILITY,
       coalesce(o.nflights, 0) as o_nflights,
       case when o.nflights is null then 100 else o.delay_rate end as o_delay_rate,
       case when o.nflights is null then 100 else o.cd_rate end as o_cd_rate,
       case when o.nflights is null then 100 else o.mean_delay_time end as o_mean_delay_time,
       case when o.nflights is null then 100 else o.std_delay_time end as o_std_delay_time,
       coalesce(d.nflights, 0) as d_nflights,
       case when d.nflights is null then 100 else d.delay_rate end as d_delay_rate,
       case when d.nflights is null then 100 else d.cd_rate end as d_cd_rate,
       case when d.nflights is null then 100 else d.mean_delay_time end as d_mean_delay_time,
       case when d.nflights is null then 100 else d.std_delay_time end as d_std_delay_time,
       coalesce(f.nflights, '0') as r_nflights,
       coalesce(f.mean_adelay_time, 'NA') as r_mean_adelay_time, coalesce(f.mean_ddelay_time, 'NA') as r_mean_ddelay_time,
       coalesce(f.std_adelay_time, 'NA') as r_std_adelay_time, coalesce(f.std_ddelay_time, 'NA') as r_std_ddelay_time,
       coalesce(f.adel_rate, 'NA') as r_adel_rate, coalesce(f.ddel_rate, 'NA') as r_ddel_rate
  from rscored r
  left join osum o on o.YEAR = r.YEAR - 1 and o.WEEK_OF_YEAR = r.WEEK_OF_YEAR and o.CARRIER = r.CARRIER and o.ORIGIN = r.ORIGIN
  left join dsum d on d.YEAR = r.YEAR - 1 and d.WEEK_OF_YEAR = r.WEEK_OF_YEAR and d.CARRIER = r.CARRIER and d.DEST = r.DEST
  left join rsum f on f.YEAR = r.YEAR - 1 and f.WEEK_OF_YEAR = r.WEEK_OF_YEAR and f.CARRIER = r.CARRIER
   and f.ORIGIN = r.ORIGIN and f.DEST = r.DEST""", GNB)


def all_oracles() -> dict[str, str]:
    from tarmac.oracle import queries_io, queries_more  # noqa: F401
    return dict(ORACLE)

ORACLE["cls_proba_histogram"] = q("""
select b.BIN, round(s.lo + b.BIN * s.w, 6) as LOWER, round(s.lo + (b.BIN + 1) * s.w, 6) as UPPER,
       coalesce(c.CNT, 0) as CNT, round(coalesce(c.CNT, 0) / (s.n * s.w), 6) as DENSITY,
       round((select t from thr), 6) as THRESHOLD
  from (select cast(range as int) as BIN from range(10)) b
  cross join st s
  left join (select cast(least(floor((p - (select lo from st)) / (select w from st)), 9) as int) as BIN,
                    count(*) as CNT from pr group by 1) c on c.BIN = b.BIN""", GNB + """,
pr as (select round(PROBA, 6) as p from scored),
st0 as (select min(p) as mn, max(p) as mx, count(p) as n from pr),
st as (select case when mn = mx then mn - 0.5 else mn end as lo, n,
              ((case when mn = mx then mx + 0.5 else mx end) - (case when mn = mx then mn - 0.5 else mn end)) / 10.0 as w
         from st0)""")

SPLIT = GNB + """,
trn as (select * from train where YEAR < 2015),
tst as (select * from train where YEAR >= 2015),
eps2 as (select 1e-9 * greatest(var_pop(CARRIER), var_pop(ORIGIN), var_pop(DEST), var_pop(WEEK_OF_YEAR)) as e,
               count(*) as total from trn),
model2 as (select cast(ARR_DEL15 as int) as CLASS, count(*) as N, count(*) * 1.0 / (select total from eps2) as PRIOR,
                 avg(CARRIER) as MEAN_CARRIER, avg(ORIGIN) as MEAN_ORIGIN, avg(DEST) as MEAN_DEST,
                 avg(WEEK_OF_YEAR) as MEAN_WEEK_OF_YEAR,
                 var_pop(CARRIER) + (select e from eps2) as VAR_CARRIER, var_pop(ORIGIN) + (select e from eps2) as VAR_ORIGIN,
                 var_pop(DEST) + (select e from eps2) as VAR_DEST,
                 var_pop(WEEK_OF_YEAR) + (select e from eps2) as VAR_WEEK_OF_YEAR
            from trn group by cast(ARR_DEL15 as int)),
m0s as (select * from model2 where CLASS = 0),
m1s as (select * from model2 where CLASS = 1),
scored2 as (select t.*,
  1.0 / (1.0 + exp(
    (ln(m0.PRIOR) - 0.5*ln(2*pi()*m0.VAR_CARRIER) - 0.5*(t.CARRIER - m0.MEAN_CARRIER)^2/m0.VAR_CARRIER
                  - 0.5*ln(2*pi()*m0.VAR_ORIGIN) - 0.5*(t.ORIGIN - m0.MEAN_ORIGIN)^2/m0.VAR_ORIGIN
                  - 0.5*ln(2*pi()*m0.VAR_DEST) - 0.5*(t.DEST - m0.MEAN_DEST)^2/m0.VAR_DEST
                  - 0.5*ln(2*pi()*m0.VAR_WEEK_OF_YEAR) - 0.5*(t.WEEK_OF_YEAR - m0.MEAN_WEEK_OF_YEAR)^2/m0.VAR_WEEK_OF_YEAR)
  - (ln(m1.PRIOR) - 0.5*ln(2*pi()*m1.VAR_CARRIER) - 0.5*(t.CARRIER - m1.MEAN_CARRIER)^2/m1.VAR_CARRIER
                  - 0.5*ln(2*pi()*m1.VAR_ORIGIN) - 0.5*(t.ORIGIN - m1.MEAN_ORIGIN)^2/m1.VAR_ORIGIN
                  - 0.5*ln(2*pi()*m1.VAR_DEST) - 0.5*(t.DEST - m1.MEAN_DEST)^2/m1.VAR_DEST
                  - 0.5*ln(2*pi()*m1.VAR_WEEK_OF_YEAR) - 0.5*(t.WEEK_OF_YEAR - m1.MEAN_WEEK_OF_YEAR)^2/m1.VAR_WEEK_OF_YEAR)
  )) as PROBA
  from tst t, m0s m0, m1s m1),
thr2 as (select avg(ARR_DEL15) as t from trn)"""
ORACLE["cls_evaluate_split"] = q("""
select round(avg((ARR_DEL15 - p)^2), 6) as MSE, round(avg(case when ARR_DEL15 = p then 1.0 else 0.0 end), 6) as ACCURACY,
       count(*) as N
  from (select ARR_DEL15, case when PROBA >= (select t from thr2) then 1.0 else 0.0 end as p from scored2) s""", SPLIT)
