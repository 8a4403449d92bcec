"""Shared sub-queries of the SQL twins: the same bindings as `sources.bindings`, in DuckDB SQL."""

from .catalog import cte

ORDER = "l_shipdate, l_linenumber, l_extendedprice"


def bars_sql(bucket: str) -> str:
    return f"""select l_suppkey as asset, {bucket} as ts, first(px order by {ORDER}) as open, max(px) as high, min(px) as low,
      last(px order by {ORDER}) as close, sum(l_quantity) as volume
      from (select *, 100 + sqrt(l_extendedprice) / 30 as px from lineitem) group by 1, 2"""


cte("bars_w", bars_sql("cast(date_trunc('week', l_shipdate) as date)"))
cte("bars_d", bars_sql("cast(l_shipdate as date)"))
cte("bars_h", """select user_id as asset, date_trunc('hour', ts) as ts, first(px order by t, event_id) as open, max(px) as high,
  min(px) as low, last(px order by t, event_id) as close, cast(count(*) as double) as volume
  from (select user_id, ts, ts as t, event_id, 100 + sqrt(value) / 3 as px from events) group by 1, 2""")
cte("cal_w", "select ts, row_number() over (order by ts) as sno from (select distinct ts from bars_w)")
cte("panel_w", "select b.*, c.sno from bars_w b join cal_w c using (ts)")
cte("sect", """select s_suppkey as asset, r_name as sector, n_name as segment from supplier join nation on s_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey""")
cte("panel_s", "select p.*, s.sector, s.segment from panel_w p join sect s using (asset)")
cte("filings", """select l_suppkey as asset, o_custkey as owner, o_orderkey as accession, cast(o_orderdate as date) as filed,
  cast(o_orderdate as date) - l_linenumber as traded, case l_returnflag when 'R' then 'S' else 'P' end as code, l_quantity as shares,
  100 + sqrt(l_extendedprice) / 30 as price, l_extendedprice as value, l_linestatus = 'O' as plan,
  case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'Officer' else 'Director' end as role,
  case o_orderpriority when '1-URGENT' then 'Chief Executive Officer (CEO)' when '2-HIGH' then 'CFO' else '' end as title
  from lineitem join orders on l_orderkey = o_orderkey""")
cte("buys", "select * from filings where code = 'P'")
cte("earn", """select asset, quarter, accession, filed + to_hours(cast(accession % 24 as int)) as accepted from (
  select asset, cast(date_trunc('quarter', filed) as date) as quarter, filed, accession,
  row_number() over (partition by asset, date_trunc('quarter', filed) order by filed, accession) as rn from filings) where rn = 1""")
cte("shortv", """select l_suppkey as asset, cast(date_trunc('week', l_shipdate) as date) as ts,
  sum(case when l_returnflag = 'R' then l_quantity else 0.0 end) as short, sum(l_quantity) as total from lineitem group by 1, 2""")
cte("funda", """select asset, "end", cast("end" + cast(20 + asset % 40 + case when quarter("end") = 2 and asset % 3 = 0 then 120 else 0 end as int) as date) as filed, val from (
  select o_custkey as asset, cast(date_trunc('quarter', o_orderdate) + interval 3 months - interval 1 day as date) as "end",
  sum(o_totalprice) as val from orders group by 1, 2)""")
QEND = "cast({q} + interval 3 months - interval 1 day as date)"
cte("qsum", """select asset, item, q, sum(v) as v from (select l_suppkey as asset, cast(date_trunc('quarter', l_shipdate) as date) as q, 'rev' as item, l_extendedprice as v from lineitem union all
  select l_suppkey, cast(date_trunc('quarter', l_shipdate) as date), case when l_returnflag = 'R' then 'ni' else 'cfo' end, l_extendedprice from lineitem) group by 1, 2, 3""")
cte("ytd", f"""select asset, item, cast(date_trunc('year', q) as date) as start, {QEND.format(q='q')} as "end", sum(v) over (partition by asset, item, year(q) order by q) as val,
  {QEND.format(q='q')} + cast(20 + asset % 40 as int) as filed from qsum""")
cte("facts", 'select * from ytd union all select asset, item, start, "end", val * 1.01e0, filed + 365 from ytd where asset % 5 = 0 and month("end") = 3')
cte("points", f"""select asset, {QEND.format(q='q')} as "end", {QEND.format(q='q')} + cast(20 + asset % 40 as int) as filed, assets, equity, shares from (
  select l_suppkey as asset, cast(date_trunc('quarter', l_shipdate) as date) as q, sum(l_quantity) * 1000 as assets, sum(case when l_returnflag = 'N' then l_quantity end) * 1000 as equity, count(*) * 100e0 as shares from lineitem group by 1, 2)""")
cte("snaps", """select distinct l_suppkey as asset, cast(date_trunc('month', o_orderdate) as date) as month from lineitem
  join orders on l_orderkey = o_orderkey where l_returnflag = 'R' and o_orderpriority = '1-URGENT'""")
cte("arts", """select doc_id as id, ts as created_at, text, user_id as asset, [lang, source] as symbols from documents
  join events on doc_id = event_id""")
cte("chain", """select p_partkey as contract, p_brand as underlying, round(p_retailprice / 100) * 100 as strike, 5 + p_size * 2 as dte,
  0.2 + (p_partkey % 17) / 100 as iv, case when p_partkey % 2 = 0 then 'C' else 'P' end as type,
  (case when p_partkey % 2 = 0 then 1 else -1 end) * (0.05 + (p_partkey % 90) / 100) as delta,
  1 + p_size / 10 as bid, (1 + p_size / 10) * 1.05e0 as ask, cast(p_partkey % 50 as double) as volume from part""")

# recursive averages: one step per bar
cte("tr_w", """select *, row_number() over (partition by asset order by ts) as bn, greatest(high - low, abs(high - pc), abs(low - pc)) as tr
  from (select *, lag(close) over (partition by asset order by ts) as pc from bars_w)""")


def ewm_sql(source: str, column: str, n: int) -> str:
    """Recursive average over rows numbered `bn` from 1 with non-null values."""
    a = f"(1e0 / {n})"
    return f"""select asset, bn, cast({column} as double) as e from {source} where bn = 1 union all
      select t.asset, t.bn, {a} * t.{column} + (1 - {a}) * r.e from e_{source}_{column}_{n} r join {source} t on t.asset = r.asset and t.bn = r.bn + 1"""


def ewm_cte(source: str, column: str, n: int) -> str:
    return cte(f"e_{source}_{column}_{n}", ewm_sql(source, column, n))


ewm_cte("tr_w", "tr", 14)
cte("atr_w", """select t.asset, t.ts, t.bn, t.open, t.high, t.low, t.close, t.volume, case when t.bn >= 14 then r.e end as atr
  from tr_w t join e_tr_w_tr_14 r on r.asset = t.asset and r.bn = t.bn""")
