"""The grammar of times: accepted and refused texts."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from basketflow.functions.times import best_effort_ts

ACCEPTED = {
    "2024-03-09": (2024, 3, 9), "2024-03-09T14:05:09Z": (2024, 3, 9, 14, 5, 9), "2024-03-09 14:05:09.25+03:00": (2024, 3, 9, 11, 5, 9, 250000),
    "2024/3/9": (2024, 3, 9), "2024.03.09 1:02": (2024, 3, 9, 1, 2), " 9.3.2024 ": (2024, 3, 9), "09/03/2024 23:59:59": (2024, 3, 9, 23, 59, 59),
    "09-03-24": (2024, 3, 9), "1/2/70": (1970, 2, 1), "1/2/69": (2069, 2, 1), "9 Mar 2024": (2024, 3, 9), "9-mar-2024 10:00": (2024, 3, 9, 10),
    "March 9, 2024": (2024, 3, 9), "Mar 09 2024 2:05 PM": (2024, 3, 9, 14, 5), "12/12/2024 12:00 AM": (2024, 12, 12), "12/12/2024 12:30pm": (2024, 12, 12, 12, 30),
    "Sat, 09 Mar 2024 07:22:16 GMT": (2024, 3, 9, 7, 22, 16), "Saturday 9 march 2024 07:22:16 -0330": (2024, 3, 9, 10, 52, 16), "9.3.2024 01:00 +03": (2024, 3, 8, 22),
    "1709993109": (2024, 3, 9, 14, 5, 9), "999999999": (2001, 9, 9, 1, 46, 39), "1709993109250": (2024, 3, 9, 14, 5, 9, 250000), "20240309": (2024, 3, 9),
    "202403091405": (2024, 3, 9, 14, 5), "20240309140509": (2024, 3, 9, 14, 5, 9), "29.02.2024": (2024, 2, 29), "2024/3/9 10:00:00,5": (2024, 3, 9, 10, 0, 0, 500000),
    "May 1 2024": (2024, 5, 1), "9.3.2024 10:00:00.123456789": (2024, 3, 9, 10, 0, 0, 123456),
}
REFUSED = [None, "", "  ", "2024", "202403", "2024-03", "12:30", "9 March", "tomorrow", "now", "30.02.2024", "29.02.2023", "32/01/2024", "01/13/2024", "9.3-2024", "9 Foo 2024", "Marchy 9, 2024",
           "2024/3/9 25:00", "2024/3/9 10:60", "9.3.2024 10:00:61", "9.3.2024 13:00 PM", "9.3.2024 0:30 AM", "9.3.2024 x", "9.3.2024 10:00 +19:00", "9.3.2024 10:00 MSK", "20241309", "99999999999", "1" * 40, "9.3.20245"]


@pytest.mark.parametrize("zone", ["UTC"])
def test_times(spark, zone):
    df = spark.createDataFrame([(t,) for t in [*ACCEPTED, *REFUSED]], "t string")
    got = {r["t"]: r["us"] for r in df.select("t", F.unix_micros(best_effort_ts("t")).alias("us")).collect()}
    epoch = dt.datetime(1970, 1, 1)
    want = {t: int((dt.datetime(*x) - epoch) / dt.timedelta(microseconds=1)) for t, x in ACCEPTED.items()}
    assert {t: got[t] for t in ACCEPTED} == want
    assert [t for t in REFUSED if got[t] is not None] == []
