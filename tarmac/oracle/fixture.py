"""SQL text of the flights projection and derived dimensions, DuckDB dialect.

Shares no code with the Spark side (``tarmac.sources.tables``): this is the
independent statement of the same data model used by the oracle.
"""

FL_CTES = """
b as (
  select cast(l.l_shipdate + interval 15 year as date) as FL_DATE, s.s_nationkey as sn, c.c_nationkey as cn,
         cast(substr(p.p_brand, 7) as int) as bn, l.l_partkey as pk, l.l_suppkey as sk,
         l.l_orderkey*31 + l.l_partkey*17 + l.l_suppkey*7 + l.l_linenumber as h
    from lineitem l join orders o on l.l_orderkey = o.o_orderkey join supplier s on s.s_suppkey = l.l_suppkey
    join customer c on c.c_custkey = o.o_custkey join part p on p.p_partkey = l.l_partkey
   where s.s_nationkey <> c.c_nationkey),
d as (
  select *, (h*13)%100 as x, cast((h*7)%24 as int) as hr, 100 + 25*((sn*7 + cn*11)%97) as dist, year(FL_DATE) as yr,
         case when h%53 = 0 then 1 else 0 end as canc, case when h%53 <> 0 and h%97 = 1 then 1 else 0 end as divt from b),
e as (
  select *, cast((hr + 1 + floor(dist/500.0))%24 as int) as hr2,
         case when canc = 1 then null else floor(x*x*x*x/1000000.0) - 15 + bn%5 end as dd
    from d where bn <= 15 or yr >= 2011 + bn%4),
f as (
  select *, case when canc = 1 or divt = 1 then null else dd + (h*29)%31 - 17 end as ad from e),
fl as (
  select cast(yr as int) as YEAR, cast(quarter(FL_DATE) as int) as QUARTER, cast(month(FL_DATE) as int) as MONTH,
    cast(day(FL_DATE) as int) as DAY_OF_MONTH, cast(isodow(FL_DATE) as int) as DAY_OF_WEEK,
    cast(weekofyear(FL_DATE) as int) as WEEK_OF_YEAR, FL_DATE,
    cast(19000 + bn as int) as AIRLINE_ID,
    concat('C', lpad(cast(bn as varchar), 2, '0')) as CARRIER,
    case when h%211 = 0 then null else concat('N', cast(pk as varchar)) end as TAIL_NUM,
    cast(sk*100 + bn as bigint) as FL_NUM,
    cast(10000 + sn as int) as ORIGIN_AIRPORT_ID,
    concat('A', lpad(cast(sn as varchar), 2, '0')) as ORIGIN,
    concat('CITY_', cast(sn as varchar)) as ORIGIN_CITY_NAME,
    concat('STATE_', cast(sn%5 as varchar)) as ORIGIN_STATE_NM,
    cast(10000 + cn as int) as DEST_AIRPORT_ID,
    concat('A', lpad(cast(cn as varchar), 2, '0')) as DEST,
    concat('CITY_', cast(cn as varchar)) as DEST_CITY_NAME,
    concat('STATE_', cast(cn%5 as varchar)) as DEST_STATE_NM,
    cast(dd as double) as DEP_DELAY,
    case when dd is null then null when dd > 0 then cast(dd as double) else cast(0 as double) end as DEP_DELAY_NEW,
    case when dd is null then null when dd >= 15 then cast(1 as double) else cast(0 as double) end as DEP_DEL15,
    case when dd is null then null when floor(dd/15.0) < -2 then -2 when floor(dd/15.0) > 12 then 12
         else cast(floor(dd/15.0) as int) end as DEP_DELAY_GROUP,
    case when hr < 6 then '0001-0559' else concat(lpad(cast(hr as varchar),2,'0'), '00-', lpad(cast(hr as varchar),2,'0'), '59') end as DEP_TIME_BLK,
    case when canc = 1 then null else cast(8 + h%17 as double) end as TAXI_OUT,
    case when canc = 1 then null else cast(3 + h%11 as double) end as TAXI_IN,
    cast(ad as double) as ARR_DELAY,
    case when ad is null then null when ad > 0 then cast(ad as double) else cast(0 as double) end as ARR_DELAY_NEW,
    case when ad is null then null when ad >= 15 then cast(1 as double) else cast(0 as double) end as ARR_DEL15,
    case when ad is null then null when floor(ad/15.0) < -2 then -2 when floor(ad/15.0) > 12 then 12
         else cast(floor(ad/15.0) as int) end as ARR_DELAY_GROUP,
    case when hr2 < 6 then '0001-0559' else concat(lpad(cast(hr2 as varchar),2,'0'), '00-', lpad(cast(hr2 as varchar),2,'0'), '59') end as ARR_TIME_BLK,
    cast(canc as double) as CANCELLED,
    case when canc = 1 then substr('ABCD', cast(1 + h%4 as int), 1) end as CANCELLATION_CODE,
    cast(divt as double) as DIVERTED,
    cast(hr*100 + h%60 as int) as CRS_DEP_TIME,
    cast(hr2*100 + h%60 as int) as CRS_ARR_TIME,
    cast(floor(dist/8.0) + 30 as double) as CRS_ELAPSED_TIME,
    case when canc = 1 or divt = 1 then null else cast(floor(dist/8.0) + h%20 as double) end as AIR_TIME,
    case when canc = 1 or divt = 1 then null else cast(floor(dist/8.0) + h%20 + 8 + h%17 + 3 + h%11 as double) end as ACTUAL_ELAPSED_TIME,
    cast(1 as double) as FLIGHTS,
    cast(dist as double) as DISTANCE,
    cast(floor(dist/250.0) + 1 as int) as DISTANCE_GROUP,
    case when ad >= 15 then cast(case when h%5 = 0 then ad - h%7 when (h+1)%5 = 0 then h%7 else 0 end as double) end as CARRIER_DELAY,
    case when ad >= 15 then cast(case when h%5 = 1 then ad - h%7 when (h+1)%5 = 1 then h%7 else 0 end as double) end as WEATHER_DELAY,
    case when ad >= 15 then cast(case when h%5 = 2 then ad - h%7 when (h+1)%5 = 2 then h%7 else 0 end as double) end as NAS_DELAY,
    case when ad >= 15 then cast(case when h%5 = 3 then ad - h%7 when (h+1)%5 = 3 then h%7 else 0 end as double) end as SECURITY_DELAY,
    case when ad >= 15 then cast(case when h%5 = 4 then ad - h%7 when (h+1)%5 = 4 then h%7 else 0 end as double) end as LATE_AIRCRAFT_DELAY
  from f),
airports as (
  select concat('A', lpad(cast(n_nationkey as varchar), 2, '0')) as iata, n_name as airport,
         concat('CITY_', cast(n_nationkey as varchar)) as city, concat('STATE_', cast(n_nationkey%5 as varchar)) as state,
         cast(25 + (n_nationkey*7)%24 as double) as lat, cast(-70 - (n_nationkey*11)%53 as double) as lon
    from nation where n_nationkey <> 24),
carriers as (
  select distinct concat('C', lpad(cast(cast(substr(p_brand, 7) as int) as varchar), 2, '0')) as Code,
         concat(p_brand, ' Airways (1990 - )') as Description from part),
ranks as (
  select cast(YEAR as int) as Year, cast(rk as int) as Rank, ORIGIN as Locid,
         case when rk <= 8 then 'L' when rk <= 16 then 'M' else 'S' end as Hub,
         cast(n*1000 as double) as Enplanement, cast((n*7)%21 - 10 as double) as Change
    from (select YEAR, ORIGIN, count(*) as n, row_number() over (partition by YEAR order by count(*) desc, ORIGIN) as rk
            from fl where YEAR <= 2015 and ORIGIN <> 'A23' group by YEAR, ORIGIN) q
  union all
  select distinct YEAR, cast(null as int), cast(null as varchar), cast(null as varchar), cast(null as double), cast(null as double)
    from fl where YEAR <= 2015),
requests as (
  select concat(ORIGIN, '__', DEST, '__', CARRIER, '__', cast(MONTH as varchar), '/', cast(DAY_OF_MONTH as varchar), '/', cast(YEAR as varchar)) as variables
    from (select distinct ORIGIN, DEST, CARRIER, YEAR, MONTH, DAY_OF_MONTH from fl) q
  union all select 'A00__ZZZ__C01__6/15/2012')
"""


def sql(body: str, ctes: str = "") -> str:
    """Full oracle statement: the fixture CTEs, optional extra CTEs, the body."""
    extra = ("," + ctes) if ctes.strip() else ""
    return "with " + FL_CTES + extra + "\n" + body
