"""P25: date and time functions."""

from __future__ import annotations

from lakeloom.registry import query
from lakeloom.tables import views

SPARK = """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, CAST(month(o_orderdate) AS INT) AS m,
  CAST(day(o_orderdate) AS INT) AS d, CAST(dayofyear(o_orderdate) AS INT) AS doy, CAST({weekday} AS INT) AS iso_weekday, CAST({week} AS INT) AS iso_week,
  CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS month_start, CAST(last_day(o_orderdate) AS DATE) AS month_end,
  CAST({add_days} AS DATE) AS later, CAST({add_months} AS DATE) AS quarter_later, CAST({days} AS INT) AS age, {text} AS iso FROM {orders}"""


@query(
    "p25_dates",
    SPARK.format(weekday="isodow(o_orderdate)", week="week(o_orderdate)", add_days="o_orderdate + INTERVAL 45 DAY", add_months="o_orderdate + INTERVAL 3 MONTH", days="date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01')", text="strftime(o_orderdate, '%Y-%m-%d')", orders="orders"),
)
def dates(spark, sf_dir):
    text = SPARK.format(weekday="weekday(o_orderdate) + 1", week="weekofyear(o_orderdate)", add_days="date_add(CAST(o_orderdate AS DATE), 45)", add_months="add_months(CAST(o_orderdate AS DATE), 3)", days="datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE))", text="date_format(o_orderdate, 'yyyy-MM-dd')", orders="{orders}")
    return spark.sql(text, **views(spark, sf_dir, "orders"))


TIMES = """SELECT event_id, CAST({hour} AS INT) AS h, CAST({minute} AS INT) AS mi, {epoch} AS epoch_us, CAST({bucket} AS BIGINT) AS ten_minutes FROM {events}"""


@query("p25_times", TIMES.format(hour="hour(ts)", minute="minute(ts)", epoch="epoch_us(ts)", bucket="epoch_us(ts) // 600000000", events="events"))
def times(spark, sf_dir):
    text = TIMES.format(hour="hour(ts)", minute="minute(ts)", epoch="unix_micros(CAST(ts AS TIMESTAMP))", bucket="unix_micros(CAST(ts AS TIMESTAMP)) div 600000000", events="{events}")
    return spark.sql(text, **views(spark, sf_dir, "events"))
