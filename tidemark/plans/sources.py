"""A: sources and sinks. Files are written from the sample tables to the shared folder and read back whole."""

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import pit as D
from ..session import materialise, scratch_path
from ..sources import bindings as S
from ..sources import readers as R
from .catalog import cte, query
from .metrics import eq
from .outcomes import rounded
from .pit import early_leavers, mixed_spells

cte("zbars", "select l_suppkey as symbol, cast(l_shipdate as date) as date, max(100 + sqrt(l_extendedprice) / 30) as close, sum(case when l_returnflag = 'R' then 0 else l_quantity end) as volume from lineitem group by 1, 2")
cte("rbars", "select * from zbars where volume > 0 and symbol in (select symbol from zbars where volume > 0 group by 1 having count(*) >= 360 and min(close) > 0)")


def bar_file(spark, sf):
    l = S.table(spark, sf, "lineitem")
    b = l.groupBy(F.col("l_shipdate").cast("date").alias("date"), F.col("l_suppkey").cast("string").alias("symbol")).agg(F.max(S.line_price()).alias("close"), F.sum(F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity"))).alias("volume"))
    b = b.select("date", "symbol", *[F.col("close").alias(c) for c in ("open", "high", "low")], "close", "volume")
    path = scratch_path(spark, "bars-csv")
    R.write_table(b, path, "csv")
    return path


def bars_read(spark, sf, least=360):
    return R.read_bars(spark, bar_file(spark, sf), least).select(F.col("symbol").cast("long").alias("symbol"), "date", "close", "volume")


@query("a1_read_bars", "select symbol, date, round(close, 6) as close, volume from rbars")
def a1(spark, sf):
    return rounded(bars_read(spark, sf))


@query("a2_read_bars_pit", """select asset, ts, round(close, 6) as close, volume from cutb union all select asset, ts, round(price, 6), 0 from (select l.asset, l.price, cast(d.d as date) as ts, row_number() over (partition by l.asset order by d.d) as rn from (select asset, max(ts) as lt, last(close order by ts) as price from cutb group by 1) l,
  lateral (select unnest(generate_series(l.lt + 1, l.lt + 24, interval 1 day)) as d) d where isodow(d.d) < 6) where rn <= 10 and ts <= (select max(ts) from cal_d)""",
       cutb="""select asset, ts, close, volume from (select *, sum(brk) over (partition by asset order by ts) as breaks, sum(aft) over (partition by asset order by ts) as n from (
  select b.symbol as asset, b.date as ts, b.close, b.volume, case when b.date >= m.l then 1 else 0 end as aft, case when b.date >= m.l and date_diff('day', lag(b.date) over (partition by b.symbol order by b.date), b.date) > 60 then 1 else 0 end as brk
  from (select * from zbars where volume > 0 and symbol in (select symbol from zbars where volume > 0 group by 1 having count(*) >= 100 and min(close) > 0)) b join (select asset, min(start) as f, case when count(*) = count("end") then max("end") end as l from sp_snaps_q group by 1) m on m.asset = b.symbol where b.date >= m.f - 550)) where aft = 0 or (breaks = 0 and n <= 20)""")
def a2(spark, sf):
    bars = bars_read(spark, sf, 100).select(F.col("symbol").alias("asset"), F.col("date").alias("ts"), *[F.col("close").alias(c) for c in ("open", "high", "low")], "close", "volume")
    cut = D.cut_to_membership(bars, D.membership_windows(early_leavers(spark, sf)), 550, 20, 60)
    end = S.table(spark, sf, "lineitem").agg(F.max(F.col("l_shipdate").cast("date")).alias("data_end"))
    return rounded(cut.select("asset", "ts", "close", "volume").unionByName(B.closing_bars(cut, end, 10).select("asset", "ts", "close", "volume")))


@query("a3_read_filings_tsv", """select l_orderkey::varchar as accession, 'S' || (l_suppkey % 10) || '-A' as ticker, cast(o_orderdate as date) as filed, cast(l_shipdate as date) as traded, case l_returnflag when 'R' then 'S' else 'P' end as code, case when o_custkey % 10 > 0 then 'C' || o_custkey end as owner, l_quantity as shares, case when l_linenumber = 3 then null else l_extendedprice end as price
  from lineitem join orders on o_orderkey = l_orderkey where l_returnflag <> 'N' and o_orderstatus <> 'P' and o_custkey % 11 > 0""")
def a3(spark, sf):
    folder = scratch_path(spark, "filings")
    o, l = S.table(spark, sf, "orders"), S.table(spark, sf, "lineitem")
    day = lambda c: F.date_format(c, "dd-MMM-yyyy")

    def tsv(df, name):
        df.write.option("header", True).option("quote", "").csv(f"{folder}/{name}", sep="\t")

    per = l.filter("l_returnflag <> 'N'").select((F.col("l_orderkey") * 100000 + F.col("l_suppkey")).cast("string").alias("ACCESSION_NUMBER"), "l_orderkey", "l_suppkey").distinct().join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    tsv(per.select("ACCESSION_NUMBER", F.when(F.col("o_custkey") % 11 > 0, day("o_orderdate")).otherwise("n/a").alias("FILING_DATE"), F.when(F.col("o_orderstatus") == "P", "3").when(F.col("o_orderstatus") == "F", "4/A").otherwise("4").alias("DOCUMENT_TYPE"), F.concat(F.lit(" s"), F.col("l_suppkey") % 10, F.lit(".a ")).alias("ISSUERTRADINGSYMBOL")), "SUBMISSION")
    code = F.when(F.col("l_returnflag") == "R", "S").when(F.col("l_returnflag") == "A", "P").otherwise("M")
    tsv(l.select((F.col("l_orderkey") * 100000 + F.col("l_suppkey")).cast("string").alias("ACCESSION_NUMBER"), code.alias("TRANS_CODE"), day("l_shipdate").alias("TRANS_DATE"), F.col("l_quantity").cast("string").alias("TRANS_SHARES"), F.when(F.col("l_linenumber") == 3, "?").otherwise(F.col("l_extendedprice").cast("string")).alias("TRANS_PRICEPERSHARE")), "NONDERIV_TRANS")
    own = per.filter("o_custkey % 10 > 0").select("ACCESSION_NUMBER", F.explode(F.array(F.struct(F.lit(2).alias("n"), F.lit("second").alias("w")), F.struct(F.lit(1).alias("n"), F.concat(F.lit("C"), F.col("o_custkey")).alias("w")))).alias("e"))
    tsv(own.select("ACCESSION_NUMBER", F.col("e.n").alias("OWNER_NO"), F.col("e.w").alias("RPTOWNERNAME"), F.lit("Officer").alias("RPTOWNER_RELATIONSHIP"), F.lit("CEO").alias("RPTOWNER_TITLE")), "REPORTINGOWNER")
    df = R.read_filings(spark, folder)
    return df.select(F.floor(F.col("accession").cast("long") / 100000).cast("string").alias("accession"), "ticker", "filed", "traded", "code", "owner", "shares", "price")


@query("a4_union_recent", "select distinct accession, owner, code, shares, round(price, 6) as price from filings")
def a4(spark, sf):
    # written once: both parts read it, else a task joins the lines of both and keeps their sorts and rows side by side
    f = materialise(S.filings(spark, sf).select("accession", "owner", "code", "shares", "price"), "filings")
    df = R.union_recent(f.filter("accession % 3 < 2"), f.filter("accession % 3 > 0").withColumn("extra", F.lit(1)), ["accession", "owner", "code", "shares", "price"])
    return rounded(df.drop("extra"))


@query("a5_pipe_feed_sum", "select cast(l_shipdate as date) as date, l_suppkey as ticker, sum(case when l_returnflag = 'R' then l_quantity else 0 end) as short, sum(l_quantity) as total from lineitem where l_suppkey in (select s_suppkey from supplier where s_acctbal > 0) group by 1, 2")
def a5(spark, sf):
    folder = scratch_path(spark, "short")
    l = S.table(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyyMMdd").alias("Date"), F.col("l_suppkey").alias("Symbol"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0).alias("ShortVolume"), F.lit(0.0).alias("ShortExemptVolume"), F.col("l_quantity").alias("TotalVolume"), F.lit("Q").alias("Market"), (F.col("l_linenumber") % 2).alias("feed"))
    for k in (0, 1):
        l.filter(F.col("feed") == k).drop("feed").write.option("header", True).csv(f"{folder}/feed{k}", sep="|")
    tickers = S.table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("ticker"))
    return R.read_short_feeds(spark, [f"{folder}/feed0", f"{folder}/feed1"], tickers).withColumn("ticker", F.col("ticker").cast("long"))


cte("sv_all", "select cast(l_shipdate as date) as date, l_suppkey as ticker, sum(l_quantity) as total, max(l_linenumber) as load_ts from lineitem group by 1, 2")


@query("a6_upsert_days", "select date, ticker, total, load_ts from (select * from sv_all where day(date) % 2 = 0 or date not in (select date from sv_all where day(date) % 2 = 0)) where date > (select max(date) from sv_all) - 700")
def a6(spark, sf):
    v = S.table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("ticker")).agg(F.sum("l_quantity").alias("total"), F.max("l_linenumber").alias("load_ts"))
    even = v.filter(F.dayofmonth("date") % 2 == 0)
    return R.upsert_days(even, v, 700).select("date", "ticker", "total", "load_ts")


@query("a7_short_ratio", "select date, ticker, round(case when year(date) >= 1999 then short / total * 0.5 else short / total end, 8) as ratio from (select ts as date, asset as ticker, short, total from shortv) where total > 0")
def a7(spark, sf):
    v = S.short_volume(spark, sf).select(F.col("ts").alias("date"), F.col("asset").alias("ticker"), "short", "total")
    recent = v.filter("year(date) >= 1999").withColumns({"short": F.col("short") * 0.5})
    return R.short_ratio(v, recent).select("date", "ticker", F.round("ratio", 8).alias("ratio"))


@query("a8_refresh_overlap", "select asset, ts, round(case when asset % 4 = 1 and ts >= date '2000-01-03' then close * 0.5 else close end, 6) as close from bars_w where not (asset % 4 = 1 and ts < date '2000-01-03' and asset in (select asset from bars_w where ts between date '2000-01-03' and date '2000-02-01'))")
def a8(spark, sf):
    b = S.weekly_bars(spark, sf).select("asset", "ts", "close")
    old = b.filter("ts < date'2000-02-01'")
    new = b.filter("ts >= date'2000-01-03'").withColumn("close", F.when(F.col("asset") % 4 == 1, F.col("close") * 0.5).otherwise(F.col("close")))
    return rounded(R.refresh_overlap(old, new))


@query("a9_read_company_facts", """select asset as ticker, case item when 'rev' then 'revenue' else item end as item, start, "end", filed, round(val, 2) as val from ytd where "end" >= date '1996-01-01'
  union all select asset, k, null, "end", filed, round(case k when 'assets' then assets when 'equity' then equity else shares end, 2) from points, (select unnest(['assets', 'equity', 'shares']) as k) where "end" >= date '1996-01-01'""")
def a9(spark, sf):
    text = lambda c: F.col(c).cast("string").alias(c)
    row = lambda start, val: F.struct(start.alias("start"), text("end"), val.alias("val"), text("filed"), F.lit("10-Q").alias("form"))
    tag = F.when(F.col("item") == "rev", "Revenues").when(F.col("item") == "ni", "NetIncomeLoss").otherwise("NetCashProvidedByOperatingActivities")
    timed = S.facts(spark, sf).select("asset", F.lit("us-gaap").alias("space"), tag.alias("tag"), F.lit("USD").alias("unit"), row(F.col("start").cast("string"), F.col("val")).alias("r"))
    at = [("us-gaap", "Assets", "USD", "assets"), ("us-gaap", "StockholdersEquity", "USD", "equity"), ("dei", "EntityCommonStockSharesOutstanding", "shares", "shares")]
    kinds = F.array(*[F.struct(F.lit(a).alias("space"), F.lit(b).alias("tag"), F.lit(u).alias("unit"), row(F.lit(None).cast("string"), F.col(c).cast("double")).alias("r")) for a, b, u, c in at])
    rows = timed.unionByName(S.points(spark, sf).select("asset", F.explode(kinds).alias("x")).select("asset", "x.*"))
    per = rows.groupBy("asset", "space", "tag", "unit").agg(F.collect_list("r").alias("rows"))  # a row per quarter
    per = per.groupBy("asset", "space").agg(F.map_from_entries(F.collect_list(F.struct("tag", F.struct(F.map_from_entries(F.array(F.struct("unit", "rows"))).alias("units"))))).alias("tags"))
    docs = per.groupBy("asset").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("space", "tags"))).alias("facts"))).alias("json")).select(F.col("asset").alias("ticker"), "json")
    durations = {"revenue": ["RevenueFromContractWithCustomer", "Revenues"], "ni": ["NetIncomeLoss"], "cfo": ["NetCashProvidedByOperatingActivities"]}
    return rounded(R.company_facts(docs, durations, "1996-01-01", {"assets": ["Assets"], "equity": ["StockholdersEquity"]}), 2)


@query("a10_read_form4_xml", """select o_orderkey as accession, 'C' || o_custkey as owner, case l_returnflag when 'R' then 'S' else 'P' end as code, l_quantity as shares, l_extendedprice as price, round(l_quantity * l_extendedprice, 2) as value, o_orderpriority = '5-LOW' or l_linenumber = 3 as plan from lineitem join orders on o_orderkey = l_orderkey where l_returnflag <> 'N'""")
def a10(spark, sf):
    l, o = S.table(spark, sf, "lineitem"), S.table(spark, sf, "orders")
    tag = lambda name, *x: F.concat(F.lit(f"<{name}>"), *x, F.lit(f"</{name}>"))
    code = F.when(F.col("l_returnflag") == "R", "S").when(F.col("l_returnflag") == "A", "P").otherwise("M")
    note = F.when(F.col("l_linenumber") == 3, "<footnote>under a Rule 10b5-1 plan</footnote>").otherwise("")
    amounts = tag("transactionAmounts", tag("transactionShares", tag("value", F.col("l_quantity"))), tag("transactionPricePerShare", tag("value", F.col("l_extendedprice"))))
    t = tag("nonDerivativeTransaction", tag("transactionCoding", tag("transactionCode", code)), note, amounts)
    lines = l.groupBy("l_orderkey").agg(F.array_join(F.collect_list(t), "").alias("t"))  # the lines of an order
    owner = tag("reportingOwner", tag("reportingOwnerId", tag("rptOwnerCik", F.lit("C"), F.col("o_custkey"))))
    plan = tag("aff10b5One", F.when(F.col("o_orderpriority") == "5-LOW", "1").otherwise("0"))
    docs = lines.join(o, lines.l_orderkey == o.o_orderkey).select(F.col("o_orderkey").alias("accession"), tag("ownershipDocument", owner, plan, tag("nonDerivativeTable", F.col("t"))).alias("xml"))
    return R.form4_transactions(docs).withColumn("value", F.round("value", 2))


@query("a11_option_snapshots", "select underlying, contract, dte, bid, ask, iv, delta, volume from (select contract, underlying, dte, round(bid, 4) as bid, round(ask, 4) as ask, round(iv, 4) as iv, round(delta, 4) as delta, volume from chain)")
def a11(spark, sf):
    c = S.chain(spark, sf)
    expiry = F.date_format(F.date_add(F.lit("2026-01-02").cast("date"), F.col("dte")), "yyMMdd")
    sym = F.concat(F.lit("X"), expiry, F.col("type"), F.lpad(F.col("contract").cast("string"), 8, "0"))
    body = F.struct(F.struct(F.col("bid").alias("bp"), F.col("ask").alias("ap")).alias("latestQuote"), F.struct(F.col("volume").alias("v")).alias("dailyBar"), F.struct("delta").alias("greeks"), F.col("iv").alias("impliedVolatility"))
    page = c.select("underlying", (F.col("contract") % 64).alias("page"), F.struct(sym.alias("k"), body.alias("v")).alias("e"))
    docs = page.groupBy("underlying", "page").agg(F.to_json(F.map_from_entries(F.collect_list("e"))).alias("json"))
    df = R.option_rows(docs, F.lit("2026-01-02").cast("date"))
    return df.select("underlying", F.regexp_extract("symbol", r"(\d{8})$", 1).cast("long").alias("contract"), "dte", *[F.round(x, 4).alias(x) for x in ("bid", "ask", "iv", "delta")], "volume")


VIEWS = "select cast(ts as date) as day, user_id as asset, cast(floor(value) as int) % 7 - 3 as bias, case when event_id % 9 < 8 then 0.5e0 else 1.5e0 end as confidence, cast(event_id % 40 as int) as horizon from events"


def views(spark, sf):
    """(valid, rejected) views of files of one day each, every file one JSON array."""
    folder = scratch_path(spark, "views")
    view = F.struct(F.col("user_id").cast("string").alias("asset"), (F.floor("value") % 7 - 3).cast("int").alias("bias"), F.when(F.col("event_id") % 9 < 8, 0.5).otherwise(1.5).alias("confidence"), (F.col("event_id") % 40).cast("int").alias("horizon_days"))
    days = S.table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("d")).agg(F.to_json(F.collect_list(view)).alias("value"))  # a day's file
    days.write.partitionBy("d").text(folder)
    return R.checked_views(R.read_views(spark, folder))


@query("a12_json_views", f"select day, asset, bias, least(greatest(horizon, 1), 30) as horizon from ({VIEWS}) where abs(bias) <= 2 and confidence <= 1")
def a12(spark, sf):
    return views(spark, sf)[0].select("day", F.col("asset").cast("long").alias("asset"), "bias", F.col("horizon_days").alias("horizon"))


@query("a12_rejected_views", f"select day, asset, bias, confidence, horizon from ({VIEWS}) where not (abs(bias) <= 2 and confidence <= 1)")
def a12b(spark, sf):
    return views(spark, sf)[1].select("day", F.col("asset").cast("long").alias("asset"), "bias", "confidence", F.col("horizon_days").alias("horizon"))


def registry(spark, sf):
    return S.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"), F.col("c_custkey").alias("position"))


@query("a13_registry_merge", "select c_custkey as id, case when c_custkey % 3 = 0 then c_acctbal else 0 end as score from customer")
def a13(spark, sf):
    r = registry(spark, sf).select("id", "score")
    return R.registry_merge(r.filter("id % 3 = 0"), r.withColumn("score", F.lit(0.0)))


@query("a14_rescore_compare", "select c_custkey as id, c_custkey as position, c_acctbal as old_score, case when c_custkey % 4 = 0 then c_acctbal * 2 else c_acctbal end as score, c_custkey % 4 <> 0 as kept from customer")
def a14(spark, sf):
    r = registry(spark, sf)
    return R.rescore_compare(r, r.filter("id % 4 = 0").withColumn("score", F.col("score") * 2), "score")


@query("a15_returns_store", "select x.sector as dataset, a.try_id, w.week, round(coalesce(h.r, 0), 8) as r from (select distinct try_id from hw) a join sect x on x.asset = a.try_id join (select distinct x.sector, week from hw join sect x on x.asset = try_id) w on w.sector = x.sector left join hw h on h.try_id = a.try_id and h.week = w.week")
def a15(spark, sf):
    from .research import weekly
    w = weekly(spark, sf).join(S.sectors(spark, sf).select(F.col("asset").alias("try_id"), F.col("sector").alias("dataset")), "try_id")
    both = w.withColumn("file_ts", F.lit(2)).unionByName(w.withColumns({"r": F.lit(9.0), "file_ts": F.lit(1)}))
    return R.returns_store(both).withColumn("r", F.round("r", 8))


@query("a16_account_rollup", "select e.account, round(e.fe, 6) as equity, round(e.tr, 6) as ret, coalesce(t.n, 0) as trades, coalesce(p.n, 0) as open from (select account, last(equity order by ts) as fe, last(equity order by ts) / first(equity order by ts) - 1 as tr from eq group by 1) e left join (select l_suppkey, count(*) as n from lineitem where l_returnflag = 'R' group by 1) t on t.l_suppkey = e.account left join (select l_suppkey, count(*) as n from lineitem where l_returnflag = 'N' and l_linenumber = 7 and l_quantity > 49 group by 1) p on p.l_suppkey = e.account")
def a16(spark, sf):
    l = S.table(spark, sf, "lineitem").withColumn("account", F.col("l_suppkey"))
    return rounded(R.account_rollup(eq(spark, sf), l.filter("l_returnflag = 'R'"), l.filter("l_returnflag = 'N' and l_linenumber = 7 and l_quantity > 49")))


@query("a17_sinks", "select k as kind, asset, ts, round(close, 6) as close from bars_w, (values ('parquet'), ('csv'), ('json')) v(k)")
def a17(spark, sf):
    b = S.weekly_bars(spark, sf).select("asset", "ts", "close").withColumn("year", F.year("ts"))
    out = None
    for fmt in ("parquet", "csv", "json"):
        path = scratch_path(spark, f"sink-{fmt}")
        R.write_table(b, path, fmt, ["year"])
        back = spark.read.schema("asset LONG, ts DATE, close DOUBLE, year INT").format(fmt).option("header", True).load(path)
        d = back.select(F.lit(fmt).alias("kind"), "asset", "ts", F.round("close", 6).alias("close"))
        out = d if out is None else out.unionByName(d)
    return out


@query("a18_releases_from_submissions", "select o_custkey as ticker, case when o_orderstatus = 'F' then '8-K' else '8-K/A' end as form, o_orderdate as accepted, o_orderkey::varchar as accession from orders where o_orderstatus <> 'P' and o_orderkey % 3 = 0")
def a18(spark, sf):
    o = S.table(spark, sf, "orders").select("o_custkey", F.struct(F.when(F.col("o_orderstatus") == "F", "8-K").when(F.col("o_orderstatus") == "O", "8-K/A").otherwise("4").alias("f"), F.when(F.col("o_orderkey") % 3 == 0, "2.02,9.01").otherwise("5.02").alias("i"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("a"), F.col("o_orderkey").cast("string").alias("n")).alias("r"))
    g = o.groupBy("o_custkey").agg(F.collect_list("r").alias("r"))
    doc = F.to_json(F.struct(F.col("r.f").alias("form"), F.col("r.i").alias("items"), F.col("r.a").alias("acceptanceDateTime"), F.col("r.n").alias("accessionNumber")))
    return R.submissions(g.select(F.col("o_custkey").alias("ticker"), doc.alias("json")), ["8-K", "8-K/A"], "2.02")


@query("a19_filing_index_lines", "select o_orderkey::varchar as accession, c_name as ticker from orders join customer on c_custkey = o_custkey where o_orderstatus = 'F' and c_acctbal > 0")
def a19(spark, sf):
    o = S.table(spark, sf, "orders")
    line = F.concat(F.when(F.col("o_orderstatus") == "F", "4    ").otherwise("10-K "), F.lit("Some Company Inc   "), F.col("o_custkey"), F.lit("  2026-01-02  edgar/data/1/"), F.col("o_orderkey"), F.lit(".txt"))
    lines = o.select(F.explode(F.array(line, line)).alias("value"))
    tickers = S.table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("cik"), F.col("c_name").alias("ticker"))
    return R.index_filings(lines, tickers)


@query("a20_seen_markers", "select o_orderkey as accession, coalesce(l_returnflag, '-') as code from orders left join (select * from lineitem where l_returnflag = 'R') on l_orderkey = o_orderkey")
def a20(spark, sf):
    o = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("accession"))
    return R.seen_markers(o, S.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("accession"), F.col("l_returnflag").alias("code")))


@query("a21_merge_partial_refresh", "select asset, ts, round(case when asset % 2 = 0 and ts >= date '2000-01-03' then close + 1 else close end, 6) as close from bars_w where not (asset % 2 = 0 and ts >= (select min(ts) from bars_w b where b.asset = bars_w.asset and ts >= date '2000-01-03') and ts < date '2000-01-03')")
def a21(spark, sf):
    b = S.weekly_bars(spark, sf).select("asset", "ts", "close")
    new = b.filter("asset % 2 = 0 and ts >= date'2000-01-03'").withColumn("close", F.col("close") + 1)
    return rounded(R.keep_before_refresh(b, new, "ts", ["asset"]))


@query("a22_universe_lookup", "select coalesce(t.asset, p.asset) as symbol, coalesce(t.sector, p.sector) as sector, t.sector is not null as member from (select s_suppkey as asset, n_name as sector from supplier join nation on n_nationkey = s_nationkey where s_acctbal > 3000) t full join (select asset, last(sector order by start, sector) as sector from spells_seg group by 1) p on p.asset = t.asset")
def a22(spark, sf):
    today = S.table(spark, sf, "supplier").filter("s_acctbal > 3000").join(S.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("symbol"), F.col("n_name").alias("sector"))
    return R.universe_lookup(today, mixed_spells(spark, sf).withColumnRenamed("asset", "symbol"))
