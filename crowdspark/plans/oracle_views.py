"""DuckDB text of the landed inputs (same mapping as ``sources.landed``), used as CTEs by
the oracle SQL of every registered query."""

def em(x: str, scale: int = 2) -> str:
    """Exact mean of values with <= ``scale`` decimals (integer sum), as in ``exact_mean``."""
    return f"(sum(cast(floor({x} * 1e{scale} + 0.5) as bigint)) / count({x}) / 1e{scale})"


def r6(x: str) -> str:
    """floor(x * 1e6 + 0.5) / 1e6, as in ``round_to``."""
    return f"(floor(({x}) * 1e6 + 0.5) / 1e6)"


def median_cte(name: str, src: str, col: str) -> str:
    return f"{name} as (select median({col}) as m from {src})"


R_O = """r_o as (
  select o_orderkey as id, strftime(cast(o_orderdate as date), '%Y/%m/%d') as date_text,
         cast(o_orderdate as date) as date, cast(o_custkey as varchar) as ride_id,
         o_totalprice as queue_time, case when o_orderstatus = 'F' then 1 else 0 end as is_closed
  from orders)"""

P_O = """p_o as (
  select cast(c_custkey as varchar) as ride_id, cast(c_nationkey as varchar) as park_id, c_name as ride_name
  from customer)"""

R_E = """r_e as (
  select event_id as id, cast(ts as date) as date, cast(user_id as varchar) as ride_id, ts,
         cast(floor(value) as integer) as queue_time,
         case when event_type = 'error' then 1 else 0 end as is_closed,
         strftime(ts, '%H:%M') as time_of_day
  from events)"""

P_E = """p_e as (
  select distinct cast(user_id as varchar) as ride_id, cast(user_id % 3 + 1 as varchar) as park_id,
         'Ride ' || cast(user_id as varchar) as ride_name
  from events)"""

W_O = f"""w_o as (
  select cast(s_nationkey as varchar) as park_id, cast(l_shipdate as date) as date,
         {r6(em('l_quantity'))} as tavg, {r6(em('l_discount') + ' * 100')} as prcp,
         nullif({r6(em('l_tax') + ' * 100')}, 0) as wspd
  from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2)"""

W_E = f"""w_e as (
  select cast(user_id % 3 + 1 as varchar) as park_id, cast(ts as date) as date,
         {r6(em('value') + ' / 10')} as tavg,
         {r6(em("case when event_type = 'click' then value end") + ' / 20')} as prcp,
         case when count(*) filter (where event_type = 'error') <= count(*) filter (where event_type = 'view')
              then {r6(em('value') + ' / 30')} end as wspd
  from events group by 1, 2)"""

# ride -> park, the percentile crowd level per park-day (orders world)
LEVELS_O = f"""ride_park as (
  select ride_id, min(park_id) as park_id from p_o group by ride_id),
readings_park as (
  select r.date, r.ride_id, r.queue_time, cast(trunc(try_cast(rp.park_id as double)) as integer) as park_id
  from r_o r left join ride_park rp using (ride_id)
  where r.is_closed = 0 and try_cast(rp.park_id as double) is not null),
ride_day as (
  select date, park_id, ride_id, avg(queue_time) as avg_queue_time
  from readings_park where date is not null and ride_id is not null group by 1, 2, 3),
park_day as (
  select date, park_id, avg(avg_queue_time) as avg_queue_time from ride_day group by 1, 2),
levels as (
  select date, cast(park_id as varchar) as park_id,
         case when avg_queue_time is not null then
           cast(round_even(((rank() over w + count(avg_queue_time) over w) / 2.0) / count(avg_queue_time) over (partition by park_id) * 100.0, 0) as integer) end as crowd_level
  from park_day
  window w as (partition by park_id order by floor(avg_queue_time * 1e6 + 0.5) nulls last range between unbounded preceding and current row))"""

COUNTRY = """directory as (
  select cast(n_nationkey as varchar) as park_id, n_name as name, r_name as country
  from nation join region on n_regionkey = r_regionkey),
aliases as (
  select lower(r_name) as name_lower, upper(substr(r_name, 1, 2)) as alpha2 from region),
park_country as (
  select d.park_id, a.alpha2 from directory d left join aliases a on lower(d.country) = a.name_lower)"""

PUBLIC_HOLIDAYS = """years as (
  select unnest(range(min(y), max(y) + 1)) as y
  from (select year(o_orderdate) as y from orders union all select year(ts) from events)),
md as (select * from (values (1, 1), (5, 1), (12, 25)) as t(m, d)),
public_holidays as (
  select distinct upper(substr(r_name, 1, 2)) as country_code, make_date(cast(y as integer), m, d) as date
  from region, md, years
  where not (r_name = 'ASIA' and m = 12))"""

SCHOOL_DAYS = """periods as (
  select r_name as country, strftime(cast(o_orderdate as date), '%Y-%-m-%-d') as start_date,
         case when o_orderpriority = '5-LOW' then 'junk'
              when o_orderpriority = '4-NOT SPECIFIED' then strftime(cast(o_orderdate as date) - interval 2 day, '%Y-%m-%d')
              else strftime(cast(o_orderdate as date) + cast(o_orderkey % 4 as integer) * interval 1 day, '%Y-%m-%d') end as end_date
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
       join region on n_regionkey = r_regionkey),
parsed as (
  select country, cast(try_strptime(start_date, '%Y-%m-%d') as date) as s, cast(try_strptime(end_date, '%Y-%m-%d') as date) as e
  from periods),
school_days as (
  select distinct country, cast(unnest(generate_series(s, e, interval 1 day)) as date) as date
  from parsed where s is not null and e is not null and s <= e)"""


def with_ctes(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"
