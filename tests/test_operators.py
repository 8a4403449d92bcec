"""Hand tables and properties: publication bounds, greedy gaps, exact ranks under skew, no look-ahead."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import ranks, temporal
from tidemark.operators import asset_signals as E
from tidemark.operators import bars as B
from tidemark.operators import event_signals as G
from tidemark.operators import features as C
from tidemark.operators import fundamentals as J
from tidemark.operators import learning as O
from tidemark.operators import metrics as M
from tidemark.operators import news
from tidemark.operators import outcomes as L
from tidemark.operators import pit as D
from tidemark.operators import research as N
from tidemark.sources import readers
from tidemark.streaming import jobs

D0 = dt.date(2024, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


def walk(spark, assets=3, n=120, seed=1):
    rnd = random.Random(seed)
    rows = []
    for a in range(assets):
        c = 100.0
        for i in range(n):
            o = c * (1 + rnd.gauss(0, 0.004))
            c = o * (1 + rnd.gauss(0, 0.01))
            rows.append((a, day(i), o, max(o, c) * (1 + abs(rnd.gauss(0, 0.003))), min(o, c) * (1 - abs(rnd.gauss(0, 0.003))), c, float(rnd.randint(1, 99))))
    return spark.createDataFrame(rows, "asset long, ts date, open double, high double, low double, close double, volume double")


def test_recursive_average_equals_pandas(spark):
    rows = [(a, day(i), random.Random(a * 5000 + i).random()) for a in range(2) for i in range(1500)]
    df = spark.createDataFrame(rows, "asset long, ts date, x double")
    for n in (2, 14):
        got = C.ewm_means(df, {"y": ("x", 1 / n, n)}).toPandas().sort_values(["asset", "ts"])
        for a, g in got.groupby("asset"):
            want = pd.Series([r[2] for r in rows if r[0] == a]).ewm(alpha=1 / n, adjust=False, min_periods=n).mean()
            assert (g["y"].reset_index(drop=True) - want).abs().max() < 1e-12
            assert g["y"].isna().sum() == n - 1


def test_ranks_are_exact_with_a_hot_group_and_ties(spark):
    rnd = random.Random(3)
    rows = [("hot" if i % 3 else f"d{i % 5}", rnd.choice([0.0, 0.0, round(rnd.random(), 2), None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("id", F.monotonically_increasing_id())
    got = ranks.pct_rank(df, ["g"], "v", "p").toPandas()
    want = got.groupby("g")["v"].rank(pct=True)
    assert (got["p"] - want).abs().max() < 1e-12
    q = ranks.group_quantiles(df, ["g"], "v", {"q10": 0.1, "med": 0.5, "q90": 0.9}).toPandas().set_index("g")
    for g, part in got.dropna(subset=["v"]).groupby("g"):
        for name, s in (("q10", 0.1), ("med", 0.5), ("q90", 0.9)):
            assert q.loc[g, name] == pytest.approx(part["v"].quantile(s), abs=1e-12)


def test_trailing_distinct_equals_brute_force(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["hot", "hot", "b"]), rnd.randint(1, 6), day(rnd.randint(0, 60))) for _ in range(400)]
    df = spark.createDataFrame(rows, "asset string, owner int, d date")
    got = {(r.asset, r.d): r.n for r in temporal.trailing_distinct(df, ["asset"], "owner", "d", 7).collect()}
    for a, _, d in rows:
        assert got[(a, d)] == len({o for x, o, e in rows if x == a and d - dt.timedelta(days=7) < e <= d})


def test_asof_bounds_and_carry_over_slices(spark):
    left = spark.createDataFrame([("a", dt.datetime(2024, 3, 1, 10)), ("a", dt.datetime(2024, 9, 1)), ("b", dt.datetime(2024, 3, 1))], "k string, t timestamp")
    right = spark.createDataFrame([("a", dt.datetime(2024, 3, 1, 10), 2), ("a", dt.datetime(2024, 1, 5), 1)], "k string, u timestamp, v int")
    value = lambda strict: {(r.k, r.t): r.v for r in temporal.asof_join(left, right, ["k"], "t", "u", ["v"], strict=strict).collect()}
    loose, strict = value(False), value(True)
    assert loose[("a", dt.datetime(2024, 3, 1, 10))] == 2 and strict[("a", dt.datetime(2024, 3, 1, 10))] == 1
    assert loose[("a", dt.datetime(2024, 9, 1))] == 2 and loose[("b", dt.datetime(2024, 3, 1))] is None


def test_gap_filter_keeps_greedily(spark):
    df = spark.createDataFrame([("a", day(i)) for i in (0, 5, 11, 12, 22, 23)], "k string, d date")
    assert sorted(r.d for r in temporal.gap_filter(df, ["k"], "d", 10).collect()) == [day(0), day(11), day(22)]


def test_one_signal_per_cluster_and_weekend_filing(spark):
    bars = spark.createDataFrame([(1, dt.date(2024, 3, d)) for d in range(1, 29) if dt.date(2024, 3, d).weekday() < 5], "asset long, ts date")
    buys = spark.createDataFrame([(1, 7, dt.date(2024, 3, 2)), (1, 8, dt.date(2024, 3, 9)), (1, 9, dt.date(2024, 3, 12))], "asset long, owner long, filed date")
    assert [r.ts for r in G.insider_cluster(buys, bars, 2, 30).collect()] == [dt.date(2024, 3, 11)]


def test_late_filing_of_an_older_period_never_replaces(spark):
    filed = spark.createDataFrame([(1, dt.date(2024, 3, 31), dt.date(2024, 5, 1), 1.0), (1, dt.date(2024, 6, 30), dt.date(2024, 8, 1), 2.0), (1, dt.date(2023, 12, 31), dt.date(2024, 9, 1), 9.0)], "asset long, end date, filed date, val double")
    rows = spark.createDataFrame([(1, dt.date(2024, 5, 1)), (1, dt.date(2024, 5, 2)), (1, dt.date(2024, 10, 1))], "asset long, at date")
    got = {r.at: r.val for r in D.known_asof(rows, filed, "at").collect()}
    assert got == {dt.date(2024, 5, 1): None, dt.date(2024, 5, 2): 1.0, dt.date(2024, 10, 1): 2.0}


def test_spells_bridge_one_missing_snapshot(spark):
    months = [dt.date(2024, m, 1) for m in range(1, 13)]
    one = [("x", m) for i, m in enumerate(months) if i not in (3,)]
    two = [("y", m) for i, m in enumerate(months) if i not in (3, 4)]
    every = [("z", m) for m in months]
    got = D.spells_from_snapshots(spark.createDataFrame(one + two + every, "asset string, month date")).collect()
    assert sorted((r.asset, r.start, r.end) for r in got if r.asset == "x") == [("x", months[0], None)]
    assert sorted(((r.start, r.end) for r in got if r.asset == "y"), key=str) == [(months[0], months[3]), (months[5], None)]


def test_quarters_from_year_to_date(spark):
    ends = [dt.date(2023, 3, 31), dt.date(2023, 6, 30), dt.date(2023, 9, 30), dt.date(2023, 12, 31)]
    rows = [(1, "rev", dt.date(2023, 1, 1), e, v, e + dt.timedelta(days=40)) for e, v in zip(ends, (10.0, 25.0, 45.0, 70.0))]
    rows.append((1, "rev", dt.date(2023, 1, 1), ends[0], 99.0, dt.date(2024, 5, 1)))
    q = J.discrete_quarters(spark.createDataFrame(rows, "asset long, item string, start date, end date, val double, filed date")).orderBy("end").collect()
    assert [r.val for r in q] == [10.0, 15.0, 20.0, 25.0] and q[-1].filed == ends[-1] + dt.timedelta(days=40)


def bars_of(spark, ohlc):
    rows = [(1, day(i), *map(float, x), 1.0, 1.0) for i, x in enumerate(ohlc)]
    return spark.createDataFrame(rows, "asset long, ts date, open double, high double, low double, close double, volume double, atr double")


def outcome(spark, ohlc, rule, side=1):
    sig = spark.createDataFrame([(1, day(0), side)], "asset long, ts date, side int")
    return L.barrier_outcomes(sig, bars_of(spark, ohlc), rule, L.Costs(0.0, 0.0)).collect()[0]


def test_bar_touching_stop_and_target_is_a_stop(spark):
    t = outcome(spark, [(10, 10, 10, 10), (10, 13, 8, 10), (10, 10, 10, 10)], L.ExitRule(1.0, 2.0))
    assert (t.reason, round(t.r, 9)) == ("stop", -1.0)


def test_gap_through_the_stop_fills_at_the_open(spark):
    t = outcome(spark, [(10, 10, 10, 10), (10, 10.5, 9.5, 10), (7, 7, 7, 7)], L.ExitRule(1.0, 2.0))
    assert (t.reason, t.exit, round(t.r, 9)) == ("stop", 7.0, -3.0)


def test_short_target_and_time_exit(spark):
    assert outcome(spark, [(10, 10, 10, 10), (10, 10.5, 7.5, 8), (8, 8, 8, 8)], L.ExitRule(1.0, 2.0), -1).reason == "target"
    t = outcome(spark, [(10, 10, 10, 10)] + [(10, 10.2, 9.8, 10.1)] * 5, L.ExitRule(1.0, 2.0, max_bars=3))
    assert (t.reason, t.exit_no) == ("time", 3)


def test_signals_do_not_look_ahead(spark):
    bars = walk(spark)
    cut = day(90)
    for fn in (lambda b: E.donchian_breakout(b, 10, 20), lambda b: E.squeeze_breakout(b, 10, 1.5, 30, 0.3, 5), lambda b: E.rsi_reversion(b, 2, 20.0, 20), lambda b: E.liquidity_sweep(b, 5, 0.1)):
        whole = {tuple(r) for r in fn(bars).filter(F.col("ts") <= cut).collect()}
        part = {tuple(r) for r in fn(bars.filter(F.col("ts") <= cut)).collect()}
        assert whole == part and whole


def test_steady_rise_has_no_drift_free_edge(spark):
    rows = [(1, day(i), 100.0 + i, 101.0 + i, 99.5 + i, 100.5 + i, 1.0, 1.0) for i in range(80)]
    bars = spark.createDataFrame(rows, "asset long, ts date, open double, high double, low double, close double, volume double, atr double")
    sig = spark.createDataFrame([(1, day(i), 1) for i in range(5, 60, 5)], "asset long, ts date, side int")
    assert all(abs(r.edge) < 1e-9 for r in L.edge_events(sig, bars, [5]).collect())


def test_expected_max_round_trip():
    assert N.expected_max(1278) == pytest.approx(3.27, abs=0.1)
    assert N.effective_n(N.expected_max(500)) == pytest.approx(500, rel=1e-6)


def test_vertical_and_books_need_every_quote(spark):
    from tidemark.operators import options as K

    pos = spark.createDataFrame([(1, [("a", 1), ("b", -1)]), (2, [("a", 1), ("c", -1)])], "id int, legs array<struct<symbol:string,qty:int>>")
    quotes = spark.createDataFrame([("a", 1.0, 1.2), ("b", 2.0, 2.5)], "symbol string, bid double, ask double")
    assert {r.id: r.cost for r in K.close_cost(pos, quotes).collect()} == {1: pytest.approx(150.0), 2: None}


def test_filing_readers_and_upsert(spark, tmp_path):
    from tidemark.sources import readers as R

    (tmp_path / "SUBMISSION").mkdir(), (tmp_path / "NONDERIV_TRANS").mkdir(), (tmp_path / "REPORTINGOWNER").mkdir()
    (tmp_path / "SUBMISSION" / "x.tsv").write_text("ACCESSION_NUMBER\tFILING_DATE\tDOCUMENT_TYPE\tISSUERTRADINGSYMBOL\n1\t02-JAN-2024\t4\t brk.b \n2\t\t4\tA\n3\t02-JAN-2024\t10-K\tA\n")
    (tmp_path / "NONDERIV_TRANS" / "x.tsv").write_text("ACCESSION_NUMBER\tTRANS_CODE\tTRANS_DATE\tTRANS_SHARES\tTRANS_PRICEPERSHARE\n1\tP\t01-JAN-2024\t10\tn/a\n1\tA\t01-JAN-2024\t10\t1\n2\tP\t01-JAN-2024\t10\t1\n")
    (tmp_path / "REPORTINGOWNER" / "x.tsv").write_text("ACCESSION_NUMBER\tOWNER_NO\tRPTOWNERNAME\tRPTOWNER_RELATIONSHIP\tRPTOWNER_TITLE\n1\t2\tSecond\tDirector\t\n1\t1\tFirst\tOfficer\tCEO\n")
    rows = R.read_filings(spark, str(tmp_path)).collect()
    assert [(r.ticker, r.filed, r.owner, r.shares, r.price) for r in rows] == [("BRK-B", dt.date(2024, 1, 2), "First", 10.0, None)]


def test_lineage_of_a_long_chain_and_a_cycle(spark):
    chain = spark.range(300).selectExpr("id", "case when id > 0 then id - 1 end as parent")
    rows = N.lineage(chain).collect()
    assert {(r.root, r.depth - r.id) for r in rows} == {(0, 0)}
    for parents in ({0: 1, 1: 0}, {0: 1, 1: 2, 2: 0, 3: 2}):
        with pytest.raises(ValueError, match="cycle"):
            N.lineage(spark.createDataFrame(list(parents.items()), "id long, parent long"))


def test_ledger_books_the_exit_of_a_long_trade(spark):
    bars = spark.createDataFrame([(1, day(i), 100.0 + i) for i in range(40)], "asset long, ts date, close double")
    trade = spark.createDataFrame([("s", 1, 1, day(0), day(35), 100.0, 135.0, 10.0, 0.1)], "strategy string, asset long, side int, entry_ts date, exit_ts date, entry double, exit double, risk double, fees_r double")
    rows = M.ledger_equity(trade, bars, 1000.0, 0.01).orderBy("ts").collect()
    assert len(rows) == 36
    steps = [0.1] * 35  # one per close, the last with the fees
    expected = 1000.0
    for s in [0.0, *steps[:-1], 0.1 - 0.1]:
        expected *= 1 + 0.01 * s
    assert rows[-1].equity == pytest.approx(expected)


def test_rows_before_the_first_fit_stay(spark):
    pool = spark.createDataFrame([("s", 1, day(i), day(i), day(i + 2), 0.5 - i % 2, float(i)) for i in range(12)], "strategy string, asset long, signal_ts date, entry_ts date, exit_ts date, r double, x double")
    rows = O.meta_label_walkforward(pool, ["x"], 5, 100, 500).collect()
    assert len(rows) == 12 and all(r.p is None and r.take and r.size == 1.0 for r in rows)
    assert O.meta_label_walkforward(pool.limit(0), ["x"], 5, 100, 500).isEmpty()


def test_normal_distribution_function(spark):
    xs = [-9.0, -3.0, -0.5, 0.0, 1e-9, 0.7, 2.5, 7.5]
    got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").select(N.normal_cdf(F.col("x")).alias("p")).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], rel=1e-9)


def test_long_lists_of_gaps(spark):
    days_ = sorted(random.Random(4).sample(range(20000), 6000))
    df = spark.createDataFrame([(1, day(d)) for d in days_], "asset long, ts date")
    kept, last = [], None
    for d in days_:
        if last is None or d - last > 3:
            kept.append(day(d))
            last = d
    assert sorted(r.ts for r in temporal.gap_filter(df, ["asset"], "ts", 3).collect()) == kept


def test_sink_rerun_replaces(spark, tmp_path):
    df = spark.createDataFrame([(1, 2020), (2, 2021)], "x long, year int")
    for _ in range(2):
        readers.write_table(df, str(tmp_path / "t"), by=["year"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_cluster_signal_of_late_days(spark, tmp_path):
    """Three files, one at a time: the second brings owners of an earlier day, the third moves the watermark."""
    files = [[(9, o, 10) for o in range(7)], [(9, 7, 9), (9, 8, 9)], [(9, 1, 20), (8, 1, 20)], [(8, 1, 30)]]
    for k, rows in enumerate(files):
        spark.createDataFrame([(a, o, dt.datetime(2024, 1, d)) for a, o, d in rows], "asset long, owner long, day timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("asset long, owner long, day timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fired = [(r.asset, r.day) for r in jobs.run(jobs.cluster_signals(stream, 8, 3)).collect()]
    assert fired == [(9, dt.date(2024, 1, 10))]


def _files(spark, folder, files, schema):
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_decisions_survive_a_restart(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / k) for k in ("in", "out", "checkpoint"))
    schema = "asset long, day date, decision string"
    once = lambda: jobs.run(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), merge=jobs.first_write_wins(["asset", "day"]), out=out, checkpoint=checkpoint, prune="day")
    _files(spark, source, [[(1, day(0), "a"), (2, day(0), "b")], [(1, day(1), "c")]], schema)
    assert once().count() == 3
    _files(spark, source, [[(1, day(0), "later"), (3, day(0), "d")]], schema)
    assert sorted((r.asset, r.day, r.decision) for r in once().collect()) == [(1, day(0), "a"), (1, day(1), "c"), (2, day(0), "b"), (3, day(0), "d")]


def test_late_alerts_are_told(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    files = [[(1, at(10))], [(1, at(9.9)), (1, at(12))], [(1, at(16.5))], [(2, at(40))], [(2, at(41))]]
    _files(spark, str(tmp_path / "in"), files, "asset long, ts timestamp")
    stream = spark.readStream.schema("asset long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted((r.asset, r.ts, r.kind) for r in jobs.run(jobs.alert_throttle(stream, 6, "1 hour")).collect())
    assert got == [(1, at(9.9), "alert"), (1, at(16.5), "alert"), (1, at(22.5), "over")]


def test_averages_with_little_memory(spark):
    """n = 1 remembers nothing; a large alpha needs short blocks."""
    xs = [random.Random(i).random() for i in range(900)]
    df = spark.createDataFrame([(1, day(i), x) for i, x in enumerate(xs)], "asset long, ts date, x double")
    got = C.ewm_means(df, {"one": ("x", 1.0, 1), "fast": ("x", 0.9, 1)}).orderBy("ts").collect()
    assert [r.one for r in got] == xs
    assert [r.fast for r in got] == pytest.approx(pd.Series(xs).ewm(alpha=0.9, adjust=False).mean().tolist())


def test_first_rows_keep_k_of_a_hot_tie_in_each_task(spark):
    rows = [(0, 1.0, i) for i in range(3000)] + [(0, 2.0, 9000), (0, None, 9001), (1, 5.0, 7), (1, 4.0, 8), (None, 3.0, 1)]
    df = spark.createDataFrame(rows, "ts int, x double, asset long")
    got = ranks.first_rows(df.filter("ts is not null"), ["ts"], "x", "asset", 4, "rank", ascending=False)
    assert sorted((r.ts, r.rank, r.asset) for r in got.collect()) == [(0, 1, 9000), (0, 2, 0), (0, 3, 1), (0, 4, 2), (1, 1, 7), (1, 2, 8)]
    assert "Partial" in got._jdf.queryExecution().executedPlan().toString()


def test_slice_bounds_are_taken_once(spark):
    df = spark.range(400).select((F.col("id") % 3).alias("g"), F.sqrt("id").alias("v"), "id")
    for out in (ranks.value_ranks(df, ["g"], "v"), ranks.sum_before(df, ["g"], ["v"], "id", "s")):
        assert "percentile_approx" not in out._jdf.queryExecution().analyzed().toString()


def test_values_that_agree_to_the_digits_tie(spark):
    df = spark.createDataFrame([(0, 0.1 + 0.2), (0, 0.3), (0, 0.5)], "g int, v double")
    assert [r.p for r in ranks.pct_rank(df, ["g"], "v", "p", digits=12).orderBy("v").collect()] == [0.5, 0.5, 1.0]


def test_sum_before_equals_a_running_sum_with_a_hot_group(spark):
    rnd = random.Random(12)
    rows = [(0 if rnd.random() < 0.7 else rnd.randrange(1, 40), rnd.randrange(400), i, rnd.randrange(1, 80) / 8) for i in range(4000)]
    df = spark.createDataFrame(rows + [(3, None, 5000, 1.0), (None, 1, 5001, 1.0)], "symbol int, seq int, x int, size double")
    seen, want = {}, {}
    for symbol, seq, x, size in sorted(rows):
        want[x] = seen.get(symbol, 0.0)
        seen[symbol] = want[x] + size
    assert {r.x: r.used for r in ranks.sum_before(df, ["symbol"], ["seq", "x"], "size", "used").collect()} == want


def test_recent_mean_of_a_hot_day_takes_the_newest(spark):
    rnd = random.Random(13)
    rows = [("s", a, day(rnd.randrange(4)), day(4 + rnd.randrange(2)), rnd.randrange(100) / 4) for a in range(900)] + [("s", 5000 + i, day(4 + i), day(9), 1.0) for i in range(4)]
    df = spark.createDataFrame(rows, "strategy string, asset long, signal_ts date, exit_ts date, r double").withColumn("entry_ts", F.col("signal_ts"))
    got = {r.asset: (r.n_recent, r.mean_recent) for r in L.rule_learner_view(df, ["strategy"], last=7).collect()}
    for _, asset, signal, _, _ in rows:
        closed = sorted((x, a, s, r) for _, a, s, x, r in rows if x < signal)[-7:]
        n, mean = got[asset]
        assert n == len(closed) and (mean is None if not closed else abs(mean - sum(c[3] for c in closed) / len(closed)) < 1e-12)


def test_a_flat_tone_has_no_score(spark):
    from tidemark.operators import news as I
    daily = spark.createDataFrame([(1, day(i), 1, x) for i, x in enumerate([0.1 + 0.2, 0.3, 0.3, 0.1 + 0.2, 0.3, 0.3, 0.3, 0.1 + 0.2])], "asset long, day date, articles long, tone double")
    got = I.news_features(daily, daily.select("asset", "day"), (1, 1, 4, 2), (1, 1, 4, 2)).collect()
    assert {r.tone_z for r in got} == {None}


def test_column_ranks_of_small_and_large_dates_agree(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(day(i % 3 and 1), i, rnd.choice([None, 0.5, rnd.random()]), rnd.random(), 7.0) for i in range(300)]
    df = spark.createDataFrame(rows, "ts date, asset long, a double, b double, kept double")
    whole = O.rank_columns(df, "ts", "asset", ["a", "b"])
    assert "explode" not in whole._jdf.queryExecution().optimizedPlan().toString().lower()
    monkeypatch.setattr(O, "DATE_ROWS", 150)
    mixed = O.rank_columns(df, "ts", "asset", ["a", "b"])
    want = df.toPandas()
    want[["a", "b"]] = want.groupby("ts")[["a", "b"]].rank(pct=True)
    for got in (whole, mixed):
        pd.testing.assert_frame_equal(got.toPandas().sort_values("asset").reset_index(drop=True), want.sort_values("asset").reset_index(drop=True))


def test_signals_and_twins_of_several_rules_in_one_pass(spark):
    rng = random.Random(7)
    rows = []
    for a in (1, 2, 3):
        p = 100.0
        for k in range(90):
            p *= 1 + rng.uniform(-0.03, 0.03)
            o, c = p * (1 + rng.uniform(-0.02, 0.02)), p * (1 + rng.uniform(-0.02, 0.02))
            rows.append((a, dt.date(2020, 1, 6) + dt.timedelta(7 * k), o, max(o, c) * 1.01, min(o, c) * 0.99, c, 1.0))
    bars = spark.createDataFrame(rows, "asset long, ts date, open double, high double, low double, close double, volume double")
    got = E.fired_each(C.with_atr(bars), {"s": E.sweep_side(4, 0.1), "d": E.breakout_side(10, 40)})
    both = {(r.candidate, r.asset, r.ts, r.side) for r in got.collect()}
    apart = {"s": E.liquidity_sweep(bars, 4, 0.1), "d": E.donchian_breakout(bars, 10, 40)}
    assert both == {(k, r.asset, r.ts, r.side) for k, df in apart.items() for r in df.collect()} and len(both) > 10
    twins = E.random_twins(got, bars, 7)
    assert {(r.candidate, r.asset, r.ts, r.side) for r in twins.collect()} == {(k, r.asset, r.ts, r.side) for k, df in apart.items() for r in E.random_twin(df, bars, 7).collect()}
    assert got._jdf.queryExecution().executedPlan().toString().count("Union") == 0


def test_trailing_activity_equals_distinct_counts_and_sums(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice(["hot", "hot", "b"]), rnd.choice([None, 1, 2, 3, 4]), day(rnd.randint(0, 60)), rnd.randint(1, 9)) for _ in range(300)]
    df = spark.createDataFrame(rows, "asset string, owner int, d date, v int")
    back = lambda a, d, n: [r for r in rows if r[0] == a and d - dt.timedelta(days=n) < r[2] <= d]
    want = lambda a, d: (len({r[1] for r in back(a, d, 7)} - {None}), sum(r[3] for r in back(a, d, 11)) or None)
    got = {(r.asset, r.d): (r.n, r.s) for r in temporal.trailing_activity(df, ["asset"], "owner", "d", 7, {"s": "v"}, sum_days=11).collect()}
    assert got == {(a, d): want(a, d) for a, o, d, _ in rows if o is not None}
    grid = [(a, day(i)) for a in ("hot", "b", "none") for i in (-3, 0, 30, 64, 90)]
    asked = temporal.trailing_activity(df, ["asset"], "owner", "d", 7, {"s": "v"}, spark.createDataFrame(grid, "asset string, d date"), sum_days=11)
    assert {(r.asset, r.d): (r.n, r.s) for r in asked.collect()} == {k: want(*k) for k in grid}


def joins_of_filings(spark, catalog, name, monkeypatch):
    """How often a query makes the filings' join, the bars and the panel."""
    from tidemark.sources import bindings
    made = dict.fromkeys(("filings", "weekly_bars", "sector_panel"), 0)
    for f in made:
        def counted(*a, f=f, make=getattr(bindings, f)):
            made[f] += 1
            return make(*a)
        monkeypatch.setattr(bindings, f, counted)
    monkeypatch.setattr("tidemark.plans.event_signals.BARS", bindings.weekly_bars)
    monkeypatch.setattr("tidemark.plans.learning.BARS", bindings.weekly_bars)
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    return made


@pytest.mark.parametrize("name, panels", [("g29_low_short_combos", 1), ("g35_insider_consensus", 0), ("h6_turned_ideas", 1), ("o6_cluster_events", 0)])
def test_signals_of_a_query_share_filings_and_bars(spark, catalog, name, panels, monkeypatch):
    assert joins_of_filings(spark, catalog, name, monkeypatch) == {"filings": 1, "weekly_bars": 1, "sector_panel": panels}


def test_clean_signal_makes_the_filings_join_once(spark, catalog):
    plan = catalog.QUERIES["g9_insider_clean"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1


def test_surprises_of_another_sum_order_tie(spark):
    """Three equal companies whose quarters were added up in other orders, one worse and one better: the equal ones share their
    rank, (2 + 3 + 4) / 3 of 5."""
    noise = {"b": 0.0, "c": 1e-10, "d": -1e-10}
    ends = [d.date() for d in pd.date_range("2018-03-31", periods=14, freq="QE")]
    moves = [3.0, 9.0, 4.0, 1.0, 8.0, 2.0, 7.0, 5.0, 6.0, 4.0, 9.0, 2.0, 8.0, 6.0]
    last = {"a": 1.0, "e": 12.0} | {k: 6.0 + v for k, v in noise.items()}
    rows = [(k, "ni", e, v if i < 13 else last[k], e + dt.timedelta(20)) for k in "abcde" for i, (e, v) in enumerate(zip(ends, moves))]
    quarters = spark.createDataFrame(rows, "asset string, item string, end date, val double, filed date")
    grid = spark.createDataFrame([(k, dt.date(2021, 8, 2)) for k in "abcde"], "asset string, ts date")
    picked = lambda least: {r.asset for r in J.surprise_rank(grid, quarters, least).collect()}
    assert picked(0.6) == set("bcde") and picked(0.61) == {"e"}


def test_asof_of_bars_equals_the_sliced_one(spark):
    rng = np.random.default_rng(3)
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(int(k))
    bars = spark.createDataFrame([(int(a), day(7 * k), float(rng.random())) for a in range(5) for k in range(40)], "asset long, ts date, close double")
    series = {n: (spark.createDataFrame([(int(rng.integers(0, 6)), day(rng.integers(0, 280)), float(v)) for v in range(30)], "asset long, filed date, val double"), "filed", ["val"]) for n in ("x", "y")}
    for strict in (True, False):
        got, want = (sorted(map(str, f(bars, series, ["asset"], "ts", strict=strict).select("asset", "ts", "close", "x", "y").collect())) for f in (temporal.asof_bars, temporal.asof_join_many))
        assert got == want


def test_unions_make_the_filings_join_once(spark, catalog, monkeypatch):
    assert joins_of_filings(spark, catalog, "h7_unions", monkeypatch) == {"filings": 1, "weekly_bars": 0, "sector_panel": 0}


def test_parts_by_rank_are_those_of_the_ranks(spark):
    """Ties, a hot value across the share, small groups, groups of one, nulls, and a group beyond the sketch."""
    rnd = random.Random(4)
    rows = [("wide", rnd.gauss(0, 1)) for _ in range(6000)] + [("tied", float(rnd.randint(0, 9))) for _ in range(500)] + [("hot", 1.0 if rnd.random() < 0.6 else rnd.random() * 2) for _ in range(400)]
    rows += [("one", 5.0), ("none", None), ("equal", 2.0), ("equal", 2.0), ("ten", None)] + [("ten", float(v)) for v in range(10)]
    df = spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(rows)], "g string, v double, i int")
    ranked = {r.i: r.p for r in ranks.pct_rank(df, ["g"], "v", "p").collect()}
    for share in (0.3, 0.5, 0.6):
        assert {r.i for r in ranks.ranked_from(df, ["g"], "v", share).collect()} == {i for i, p in ranked.items() if p is not None and p >= share}
        assert {r.i for r in ranks.ranked_upto(df, ["g"], "v", share).collect()} == {i for i, p in ranked.items() if p is not None and p <= share}


def test_ideas_of_one_pass_are_those_of_each(spark):
    """Owners without a name, hot pairs, sales, titles and releases: the one pass gives what the operators give alone."""
    rnd = random.Random(11)
    filed = [(rnd.choice([0, 0, 0, 1, 2, 3]), rnd.choice([None, 1, 2, 3, 4, 5, 6]), day(rnd.randint(0, 700)), rnd.randint(0, 5), rnd.choice("PPPS"), float(rnd.randint(0, 9)), 90 + 20 * rnd.random(), rnd.choice(["CEO", "CFO", "x", None])) for _ in range(900)]
    f = spark.createDataFrame([(a, o, d, d - dt.timedelta(days=k), c, s, p, s * p * 200, t) for a, o, d, k, c, s, p, t in filed], "asset int, owner int, filed date, traded date, code string, shares double, price double, value double, title string")
    bars = spark.createDataFrame([(a, day(7 * k), 100 + 12 * math.sin(k / 3 + a)) for a in range(4) for k in range(95)], "asset int, ts date, close double")
    rel = spark.createDataFrame([(a, day(rnd.randint(0, 690))) for a in range(4) for _ in range(9)], "asset int, day date")
    gaps = {"base": 10, "fresh": 20, "late": 10, "exec": 30, "clean": 30, "under": 30, "votes": 30}
    buys = f.filter("code = 'P'")
    alone = {"base": G.insider_cluster(buys, bars, 2, 10), "fresh": G.insider_cluster(G.fresh(buys, 60), bars, 2, 10, 20), "late": G.insider_cluster(G.filing_lag(buys, "late"), bars, 2, 10), "exec": G.insider_top_exec(buys, bars, 90000.0, "ceo_cfo", 30),
             "clean": G.insider_clean(f, bars, 1, 10, 15, 30), "under": G.insider_underwater(buys, bars, 2, 0.01, 20, 30)}
    alone["votes"] = G.consensus([alone["fresh"], alone["under"], alone["exec"], alone["clean"], G.after_earnings(alone["base"], bars, rel, 4, 0.0)], bars, 2, 4, 30)
    got = G.insider_ideas(f, bars, 10, 2, 60, 3, 90000.0, "ceo_cfo", 15, 20, 0.01, gaps, rel, 4, 2, 4).collect()
    for k, df in alone.items():
        want = {(r.asset, r.ts) for r in df.collect()}
        assert want and {(r.asset, r.ts) for r in got if r.idea == k} == want, k


def test_what_is_known_at_bars_in_one_pass(spark):
    """Buyers, sums, items since the bar before, releases and the next event: as the operators give them one by one."""
    rnd = random.Random(12)
    f = spark.createDataFrame([(rnd.choice([0, 0, 1, 2, 9]), rnd.choice([None, 1, 2, 3]), day(rnd.randint(-9, 300)), rnd.choice("PPS"), float(rnd.randint(1, 99)), rnd.randint(0, 1), rnd.randint(0, 1), rnd.randint(0, 1)) for _ in range(500)],
                              "asset int, owner int, filed date, code string, value double, n int, pos int, neg int")
    bars = spark.createDataFrame([(a, day(7 * k), float(k)) for a in range(4) for k in range(40) if k % 9], "asset int, ts date, close double")
    rel, events = (spark.createDataFrame([(a, day(rnd.randint(-9, 290))) for a in range(4) for _ in range(6)] + [(0, day(14))], "asset int, day date") for _ in range(2))
    got = {(r.asset, r.ts): r for r in D.known_at_bars(bars, f, rel, events, 90, 30).collect()}
    grid = bars.select("asset", F.col("ts").alias("filed"))
    bought, sold = f.filter("code = 'P'"), f.filter("code = 'S'")
    n = {(r.asset, r.filed): r._n for r in temporal.trailing_distinct(bought, ["asset"], "owner", "filed", 90, grid, "_n").collect()}
    b, s = ({(r.asset, r.filed): r.v for r in temporal.trailing_sums(df, ["asset"], "filed", k, {"v": "value"}, grid).collect()} for df, k in ((bought, 90), (sold, 30)))
    laid = {(r.asset, r.ts): (r.n, r.pos, r.neg) for r in news.news_on_sessions(f.groupBy("asset", F.col("filed").alias("day")).agg(*[F.sum(c).alias(c) for c in ("n", "pos", "neg")]), bars, ["n", "pos", "neg"]).collect()}
    blocked = {(r.asset, r.ts): r.x for r in temporal.flag_session(bars, rel, "x").collect()}
    ahead = {(r.asset, r.day): r.to for r in B.days_to_next(bars.select("asset", F.col("ts").alias("day")), events.withColumnRenamed("day", "event"), ["asset"], "to").collect()}
    assert len(got) == bars.count()
    for k, r in got.items():
        assert (r._buyers, r._bought, r._sold) == (n[k], b[k], s[k]) and (r.n, r.pos, r.neg) == laid[k] and r.blocked == blocked[k]
        assert (None if r._next is None else (r._next - r.ts).days) == ahead[k]


def test_pool_makes_filings_and_bars_once(spark, catalog, monkeypatch):
    """The weekly bars come with their lines' counts; no second set is made."""
    assert joins_of_filings(spark, catalog, "o8_outcome_pool", monkeypatch) == {"filings": 1, "weekly_bars": 0, "sector_panel": 0}


def test_ranker_makes_filings_and_bars_once(spark, catalog, monkeypatch):
    """No panel is written and no second pass over the filings made for what the ranker knows of an asset."""
    assert joins_of_filings(spark, catalog, "o1_ranker_dataset", monkeypatch) == {"filings": 1, "weekly_bars": 0, "sector_panel": 0}


def test_fits_meet_rows_without_shuffling_them(spark):
    """Fits are a row per fold: the rows they score are not dealt out by fold."""
    rows = spark.range(2000).selectExpr("id % 7 as fold", "rand(1) as x", "rand(2) as y")
    plan = O.linear_scores(rows, O.ridge_fit(rows, ["x"], "y"), ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
