"""Oracle statements for file sources, sinks and the streaming ingest:
the content read back must equal the data that was landed."""

from __future__ import annotations

from tarmac.oracle.queries import ORACLE, q
from tarmac.oracle.queries_more import CAMEL_NAMES, CAMEL_SQL, HOL

_NO_WEEK = ", ".join(c for c in CAMEL_NAMES if c != "WeekofYear")
ORACLE["src_ontime_scan"] = q(f"select {_NO_WEEK} from camel", CAMEL_SQL)
ORACLE["src_ontime_source"] = ORACLE["src_ontime_scan"]
ORACLE["src_multi_period"] = q("select * from camel", CAMEL_SQL)
ORACLE["str_monthly_ingest"] = q("select * from camel", CAMEL_SQL)
ORACLE["src_airport_coords"] = q("""
select airport as Airport, iata as Iata, lat as Latitude, lon as Longitude,
       cast(cast(substr(iata, 2, 2) as int) * 100 as int) as Altitude,
       cast(-5.0 - cast(substr(iata, 2, 2) as int) % 4 as double) as Timezone
  from airports where cast(substr(iata, 2, 2) as int) % 4 <> 3""")
ORACLE["src_airport_ranks"] = q("select * from ranks")
ORACLE["src_lookup_airport"] = q("select iata as Code, city as Description from airports")
ORACLE["src_lookup_cancellation"] = q("""
select distinct CANCELLATION_CODE as Code, case CANCELLATION_CODE when 'A' then 'Carrier' when 'B' then 'Weather'
       when 'C' then 'National Air System' when 'D' then 'Security' end as Description
  from fl where CANCELLATION_CODE is not null""")
ORACLE["src_lookup_carrier"] = q("select Code, split_part(Description, '(', 1) as Description from carriers")
ORACLE["src_lookup_delay_group"] = q("""
select g as Code, case when g <= -2 then 'Delay < -15 minutes' when g = -1 then 'Delay between -15 and -1 minutes'
       when g >= 12 then 'Delay >= 180 minutes'
       else 'Delay between ' || cast(g * 15 as varchar) || ' and ' || cast(g * 15 + 14 as varchar) || ' minutes' end
       as Description
  from (select DEP_DELAY_GROUP as g from fl union select ARR_DELAY_GROUP from fl) z where g is not null""")
ORACLE["src_lookup_time_block"] = q("""
select BLOCK as Code, substr(BLOCK, 1, 2) || ':' || substr(BLOCK, 3, 2) || '-' || substr(BLOCK, 6, 2) || ':'
       || substr(BLOCK, 8, 2) as Description
  from (select DEP_TIME_BLK as BLOCK from fl union select ARR_TIME_BLK from fl) z""")
ORACLE["src_lookup_distance_group"] = q("""
select g as Code, case when g = 1 then 'Less Than 250 Miles'
       else cast((g - 1) * 250 as varchar) || '-' || cast((g - 1) * 250 + 249 as varchar) || ' Miles' end as Description
  from (select distinct DISTANCE_GROUP as g from fl) z""")
ORACLE["src_holidays"] = q("select * from holm", HOL)
ORACLE["snk_csv_roundtrip"] = ORACLE["agg_origin_month"]
ORACLE["src_table"] = ORACLE["agg_per_origin"]
ORACLE["snk_materialize"] = ORACLE["agg_per_origin"]
ORACLE["snk_append"] = q("select * from sub")
ORACLE["snk_create"] = q("select * from sub")
ORACLE["snk_overwrite"] = q("select * from sub")
for _key, _col in (("carrier", "CARRIER"), ("origin", "ORIGIN"), ("tail", "TAIL_NUM")):
    ORACLE[f"snk_lookup_{_key}"] = q(f"select FL_DATE, CARRIER, TAIL_NUM, FL_NUM, ORIGIN, DEST, ARR_DELAY from fl "
                                     f"where {_col} = (select min({_col}) from fl)")
ORACLE["str_agg_refresh"] = ORACLE["agg_per_origin"]
ORACLE["str_request_answer"] = ORACLE["pipe_request_answer"]
ORACLE["snk_model_params"] = ORACLE["cls_gnb_fit"]
ORACLE["snk_model_score"] = ORACLE["cls_score_requests"]
ORACLE["snk_partitioned_layout"] = q("select YEAR, MONTH, FL_DATE, CARRIER, ORIGIN, DEST, ARR_DELAY from fl "
                                     "where YEAR = 2012 and MONTH = 6")
