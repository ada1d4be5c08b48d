"""Tables, the visit schema, and the visit view over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Visits as they are read from files; everything that may be dirty is text.
RAW_VISIT = T.StructType([T.StructField(n, k) for n, k in (("subject_id", T.LongType()), ("stay_id", T.LongType()), ("intime", T.StringType()), ("outtime", T.StringType()), ("gender", T.StringType()), ("arrival_transport", T.StringType()), ("disposition", T.StringType()), ("temperature", T.StringType()), ("heartrate", T.StringType()), ("o2sat", T.StringType()), ("sbp", T.StringType()), ("dbp", T.StringType()), ("pain", T.StringType()), ("acuity", T.IntegerType()), ("chiefcomplaint", T.StringType()))])

#: A deterministic view of ``events`` as visits; the same text runs in Spark and in DuckDB.
VISITS_SQL = """SELECT event_id AS stay_id, user_id AS subject_id, ts AS intime,
 CAST((event_id*7919)%131-5 AS DOUBLE) AS age_at_visit,
 CASE WHEN event_id%17=0 THEN NULL ELSE CAST((event_id*31)%13 AS DOUBLE) END AS pain,
 CAST(940+(event_id*17)%90+CASE WHEN event_id%23=0 THEN 200 ELSE 0 END AS DOUBLE)/10 AS temperature,
 CAST(52+(event_id*37)%66+CASE WHEN event_id%19=0 THEN 150 ELSE 0 END AS DOUBLE) AS heartrate,
 CAST(84+(event_id*53)%74+CASE WHEN event_id%29=0 THEN 150 ELSE 0 END AS DOUBLE) AS sbp,
 CAST(50+(event_id*41)%60 AS DOUBLE) AS dbp,
 CASE WHEN event_id%13=0 THEN NULL ELSE CAST(90+(event_id*29)%11 AS DOUBLE) END AS o2sat,
 CASE event_id%6 WHEN 0 THEN 'm' WHEN 1 THEN ' F ' WHEN 2 THEN 'M' WHEN 3 THEN 'f' WHEN 4 THEN 'X' END AS gender,
 CASE event_id%7 WHEN 0 THEN 'AMBULANCE' WHEN 1 THEN 'Walk In' WHEN 2 THEN 'walk-in' WHEN 3 THEN ' Wheelchair'
   WHEN 4 THEN 'private car' WHEN 5 THEN 'Helicopter' END AS arrival_transport,
 CASE event_id%12 WHEN 0 THEN 'Chest  pain and SOB' WHEN 1 THEN 'abd pain w/ N&V x 2 days'
   WHEN 2 THEN 'H/A and dizziness, r/o migraine' WHEN 3 THEN 'Fever and cough!!!' WHEN 4 THEN 'back pain s/p fall'
   WHEN 5 THEN 'Unknown' WHEN 6 THEN 'seizure after trauma' WHEN 7 THEN ' n/a ' WHEN 8 THEN 'finger laceration'
   WHEN 9 THEN 'n/v/d' WHEN 10 THEN '' END AS chiefcomplaint,
 CAST(1+(event_id*13+event_id%3)%5 AS INT) AS acuity
FROM {events}"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VISITS_SQL.format(events="{events}"), events=load(spark, sf_dir, "events"))
