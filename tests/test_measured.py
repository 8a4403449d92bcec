"""Research statistics, documents, calendars and streams against plain versions on small tables."""

import datetime as dt
import itertools
import json
import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import asset_signals as E
from tidemark.operators import bars as B
from tidemark.operators import combine as H
from tidemark.operators import features as C
from tidemark.operators import outcomes as L
from tidemark.operators import research as N
from tidemark.sources import readers as R
from tidemark.streaming import jobs as Q

P = E.MIX_PRIME
DAY = dt.date(2020, 1, 6)


def cubed(x):
    return x * x % P * x % P


def mixed(seed, *parts):
    x = seed * 1299709
    for p, m in zip(parts, (7919, 104729, 15485863)):
        x = cubed((x + p % P * m) % P)
    return x


def uniform(x):
    return cubed((x * 48271 + 11) % P) / P


def test_cubing_is_a_permutation():
    assert math.gcd(3, P - 1) == 1 and all(P % k for k in range(2, 46342))
    seen = [uniform(mixed(1, d, i)) for d in range(120) for i in range(120)]
    assert abs(np.mean(seen) - 0.5) < 0.01 and abs(np.corrcoef(seen[:-1], seen[1:])[0, 1]) < 0.03


# edge drift (L1)

def walk(rng, n, asset):
    c, out = 100.0, []
    for i in range(n):
        o, c = c, c * (1 + rng.gauss(0, 0.02))
        out.append((asset, DAY + dt.timedelta(i), o, max(o, c) * 1.01, min(o, c) * 0.99, c, 1.0, 2.0 if i > 4 else None))
    return out


def test_edge_is_the_move_less_the_drift_between_the_signals(spark):
    rng = random.Random(2)
    bars = [b for a in (1, 2, 3) for b in walk(rng, 60, a)]
    signals = [(a, DAY + dt.timedelta(i), rng.choice((1, -1))) for a, days in ((1, (0, 7, 8, 30, 58)), (2, (20, 41)), (3, (58, 59))) for i in days]
    frame = spark.createDataFrame(bars, "asset long, ts date, open double, high double, low double, close double, volume double, atr double")
    df = L.edge_events(spark.createDataFrame(signals, "asset long, ts date, side int"), frame, [1, 5])
    got = {(r.asset, r.ts, r.horizon): r.edge for r in df.collect()}
    want = {}
    for h in (1, 5):
        for a in (1, 2, 3):
            own = [b for b in bars if b[0] == a]
            at = [(i, s) for x, d, s in signals if x == a for i in [(d - DAY).days]]
            lo, hi = max(min(i for i, _ in at), 1), min(max(i for i, _ in at), len(own) - h - 1)
            move = lambda k: (own[k + h][5] - own[k + 1][2]) / own[k][7]
            moves = [move(k) for k in range(lo, hi + 1) if own[k][7]]
            drift = float(np.mean(moves)) if moves else 0.0
            for i, s in at:
                if i + h < len(own) and own[i][7]:
                    want[a, own[i][1], h] = max(-10, min(10, s * (move(i) - drift)))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # signals with bars


# luck (N8, N9, N10)

def weekly_rows(tries, weeks, rng):
    return [(t, DAY + dt.timedelta(7 * w), rng.gauss(0.01, 1 + t % 3)) for t in range(tries) for w in range(weeks)]


def null_max(rows, replays, block=4, seed=1):
    weeks = sorted({w for _, w, _ in rows})
    n, out = len(weeks), []
    z = {}
    for t in {t for t, _, _ in rows}:
        r = {w: x for i, w, x in rows if i == t}
        s = np.std(list(r.values()), ddof=1)
        if s > 1e-9:
            z[t] = [(r[w] - np.mean(list(r.values()))) / s if w in r else 0.0 for w in weeks]
    for k in range(1, replays + 1):
        src, used = 0, []
        for i in range(n):
            src = math.floor(uniform(mixed(seed + 1, k, i)) * n) if i == 0 or uniform(mixed(seed, k, i)) < 1 / block else (src + 1) % n
            used.append(src)
        out.append(max(sum(v[i] for i in used) for v in z.values()) / math.sqrt(n))
    return out


def test_luck_of_the_luckiest_try(spark):
    rows = weekly_rows(9, 40, random.Random(4)) + [(99, DAY + dt.timedelta(7 * w), 0.5) for w in range(40)]
    frame = spark.createDataFrame(rows, "try_id long, week date, r double")
    got = [r.max_t for r in N.null_max(frame, 60).orderBy("replay").collect()]
    assert np.allclose(got, null_max(rows, 60))
    assert N.null_max(frame.limit(0), 5).isEmpty()


def test_tries_without_returns_raise_the_bar(spark):
    weekly = spark.createDataFrame(weekly_rows(6, 40, random.Random(5)), "try_id long, week date, r double")
    events = lambda extra: spark.createDataFrame([(t, 150) for t in range(5)] + [(5, 20)] + [(100 + k, 150) for k in range(extra)], "try_id long, events long")
    bar, missing = N.luck_bar(weekly, events(0), 50)
    rows = [r for r in weekly.collect() if r.try_id < 5]
    assert missing == 0 and abs(bar - np.mean(null_max([tuple(r) for r in rows], 50))) < 1e-9
    higher, missing = N.luck_bar(weekly, events(30), 50)
    assert missing == 30 and higher > bar and abs(N.effective_n(higher) - N.effective_n(bar) - 30) < 1e-6
    judged = {r.try_id: r for r in N.luck_scores(weekly, events(3), 50).collect()}
    assert judged[100].beats_luck is None and judged[5].beats_luck is None and judged[0].beats_luck is not None
    assert abs(judged[0].bar - N.luck_bar(weekly, events(3), 50)[0]) < 1e-9


# ranges (N11)

def test_range_of_the_mean_r(spark):
    rng = random.Random(6)
    trades = [("s", 1 + i % 3, i, rng.gauss(0.1, 1)) for i in range(40)] + [("s", 9, 1, float("nan")), ("s", 9, 2, None)]
    frame = spark.createDataFrame(trades, "strategy string, asset long, fill_no long, r double")
    steps, means = N.poisson_steps(), []
    for d in range(1, 301):
        w = [sum(uniform((mixed(1, ord("s"), a, f) + mixed(2, d)) % P) >= x for x in steps) for _, a, f, _ in trades[:40]]
        means.append(sum(x * t[3] for x, t in zip(w, trades)) / sum(w))
    got = N.trade_bootstrap(frame, 300).first()
    assert got.trades == 40 and np.allclose([got.avg_r, got.p05, got.p95, got.p_loss], [np.mean([t[3] for t in trades[:40]]), np.percentile(means, 5), np.percentile(means, 95), np.mean([m <= 0 for m in means])])
    spread = np.std([t[3] for t in trades[:40]]) / math.sqrt(40)
    assert abs(np.std(means) / spread - 1) < 0.15
    few = N.trade_bootstrap(frame.limit(9), 50).first()
    assert few.trades == 9 and few.p05 is None and few.avg_r is None


def test_draws_are_no_rows_and_weights_are_the_counts_of_the_uniforms(spark):
    rows = [("s", a, a * 31, 0.1 * a - 2) for a in range(600)]  # more than a block of rows
    df = N.trade_bootstrap(spark.createDataFrame(rows, "strategy string, asset long, fill_no long, r double"), 300)
    assert "explode" not in df._jdf.queryExecution().optimizedPlan().toString()
    steps, x = np.array(N.poisson_steps()), np.array([mixed(1, ord("s"), a, f) for _, a, f, _ in rows])
    w = [np.searchsorted(steps, [uniform(int(v)) for v in (x + mixed(2, d)) % P], "right") for d in range(1, 301)]
    means, got = [(v * [t[3] for t in rows]).sum() / v.sum() for v in w], df.first()
    assert np.allclose([got.p05, got.p95, got.p_loss], [*np.percentile(means, [5, 95]), np.mean(np.array(means) <= 0)])
    edges = np.array([v for s in steps for v in (math.floor(s * P) - 1, math.floor(s * P), math.ceil(s * P)) if v < P])
    assert (N._poisson_counts()(edges) == np.searchsorted(steps, edges / P, "right")).all()


def test_range_of_the_yearly_growth(spark):
    rng, equity, rows = random.Random(7), 100.0, []
    for i in range(48):
        rows.append(("a", DAY + dt.timedelta(i), equity))
        equity *= 1 + rng.gauss(0.001, 0.02)
    d = [b[2] / a[2] - 1 for a, b in zip(rows, rows[1:])]
    n, k = len(d), math.ceil(len(d) / 10)
    out = []
    for draw in range(1, 101):
        starts = [math.floor(uniform(mixed(1, draw, j)) * (n - 9)) for j in range(k)]
        picked = [d[s + i] for s in starts for i in range(10)][:n]
        out.append(np.prod([1 + x for x in picked]) ** (365.25 / n) - 1)
    got = {r.account: r for r in N.day_bootstrap(spark.createDataFrame([*rows, *[("b", DAY + dt.timedelta(i), 1.0 + i) for i in range(20)]], "account string, ts date, equity double"), 100).collect()}
    assert got["a"].days == n and np.allclose([got["a"].cagr, got["a"].p05, got["a"].p95], [np.prod([1 + x for x in d]) ** (365.25 / n) - 1, np.percentile(out, 5), np.percentile(out, 95)])
    assert got["b"].days == 19 and got["b"].p05 is None and got["b"].cagr is None


# exit rules (N19)

def test_each_year_takes_the_best_rule_of_the_years_before(spark):
    trade = lambda rule, year, r, day=10, out=12: ("s", "m", rule, f"m r{rule}", dt.date(year, 3, day), dt.date(year, 3, out), r)
    rows = [trade(0, y, 0.1 * (-1) ** k, 1 + k, 2 + k) for y in range(2001, 2006) for k in range(4)] + [trade(1, y, 0.5 + 0.1 * k, 1 + k, 2 + k) for y in range(2001, 2006) for k in range(4)]
    rows += [trade(2, 2004, 9.0 + k, 1 + k, 2 + k) for k in range(9)]  # the best, with too few trades
    bars = spark.createDataFrame([(1, dt.date(2000, 1, 3)), (1, dt.date(2007, 6, 1))], "asset long, ts date")
    first = spark.createDataFrame([("m", 0, "m r0")], "mode string, rule_no int, rule string")
    led = spark.createDataFrame(rows, "strategy string, mode string, rule_no int, rule string, entry_ts date, exit_ts date, r double")
    got = {r.year: r for r in N.walk_forward_tuning(led, first, ["strategy"], bars, train_years=3).collect()}
    assert sorted(got) == [2004, 2005, 2006, 2007]
    assert got[2004].rule == "m r1" and got[2004].trades == 4 and abs(got[2004].sum_r - 2.6) < 1e-9
    assert got[2007].rule == "m r0" and got[2007].quality is None and got[2007].trades == 0  # eight trades in its window
    chain = np.prod([1 + 0.01 * (0.5 + 0.1 * k) for k in range(4)])
    assert abs(got[2004].ret - (chain - 1)) < 1e-9 and abs(got[2005].equity - chain**2) < 1e-9


def test_tuning_reads_its_trades_once_and_adds_up_their_deviations(spark):
    rng, read = random.Random(11), spark.sparkContext.accumulator(0)
    rows = [("s", "m", k, f"m r{k}", dt.date(y, 12, 1 + i), dt.date(y + i % 2, 1 + 11 * (1 - i % 2), 20), rng.gauss(0.1 * k, 1)) for y in range(2001, 2007) for k in range(2) for i in range(9)]
    schema = "strategy string, mode string, rule_no int, rule string, entry_ts date, exit_ts date, r double"

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    bars = spark.createDataFrame([(1, dt.date(2000, 1, 3)), (1, dt.date(2007, 6, 1))], "asset long, ts date")
    first = spark.createDataFrame([("m", 0, "m r0")], "mode string, rule_no int, rule string")
    got = {r.year: r for r in N.walk_forward_tuning(spark.createDataFrame(rows, schema).mapInArrow(counted, schema), first, ["strategy"], bars).collect()}
    assert read.value == len(rows)
    for y in (2005, 2006, 2007):
        quality = {}
        for k in range(2):
            r = [t[6] for t in rows if t[2] == k and t[5].year < y <= t[4].year + 4]
            quality[k] = np.mean(r) / np.std(r, ddof=1)
        best = max(quality, key=quality.get)
        assert got[y].rule == f"m r{best}" and abs(got[y].quality - quality[best]) < 1e-12


def test_rules_of_a_table_give_what_each_gives_alone(spark):
    rng = random.Random(9)
    bars = spark.createDataFrame([(*b, 30.0 if b[1].day % 2 else 20.0) for a in (1, 2) for b in walk(rng, 80, a)], "asset long, ts date, open double, high double, low double, close double, volume double, atr double, adx double")
    signals = spark.createDataFrame([(a, DAY + dt.timedelta(i), 1 if i % 2 else -1) for a in (1, 2) for i in range(6, 75, 5)], "asset long, ts date, side int")
    rules = {"a": L.ExitRule(1.0, 2.0, max_bars=4), "b": L.ExitRule(1.5, None, max_bars=9, trail_atr=1.0), "c": L.ExitRule(2.0, 1.0, None, 6, 1.5, adaptive=True), "d": L.ExitRule(1.0, 1.0, 3.0, 5)}
    costs = L.Costs(0.001, 0.001, 0.02)
    grid = L.barrier_outcomes(signals, bars, rules, costs).collect()
    for name, rule in rules.items():
        alone = {(r.asset, r.fill_no): (r.reason, round(r.r, 9), r.exit_ts) for r in L.barrier_outcomes(signals, bars, rule, costs).collect()}
        assert {(r.asset, r.fill_no): (r.reason, round(r.r, 9), r.exit_ts) for r in grid if r.rule == name} == alone and alone


def test_signals_listed_on_bars_give_the_trades_of_a_table_of_signals(spark):
    from tidemark.functions.temporal import flag_session, on_session

    rng = random.Random(12)
    bars = spark.createDataFrame([b for a in (1, 2) for b in walk(rng, 80, a)], "asset long, ts date, open double, high double, low double, close double, volume double, atr double").filter("pmod(datediff(ts, date'2020-01-06'), 7) < 5")
    days = spark.createDataFrame([(a, DAY + dt.timedelta(i)) for a in (1, 3) for i in (-4, 2, 12, 13, 40, 40, 200)] + [(2, None)], "asset long, day date")
    want = {(r.asset, r.ts) for r in on_session(days.filter("day is not null").distinct(), bars).collect()}
    marked = flag_session(bars, days, "blocked")
    assert {(r.asset, r.ts) for r in marked.filter("blocked").collect()} == want and marked.count() == bars.count() and want
    rules = {"up": F.when(F.col("close") > 100, 1).otherwise(0), "down": F.when(F.col("close") < 101, -1).otherwise(0)}
    listed = marked.withColumn("fires", E.fires(rules))
    table = listed.select("asset", "ts", F.explode("fires").alias("x")).select("asset", "ts", "x.strategy", "x.side")
    rows = lambda signals: sorted(map(str, L.ledger(signals, marked if signals is table else listed, L.ExitRule(1.0, 1.5, max_bars=6), L.Costs(), ["strategy", "asset"]).collect()))
    assert rows("fires") == rows(table) and rows(table)


def test_medians_of_folds_are_exact_beyond_the_sketch(spark):
    from tidemark.operators import learning as O

    rng = np.random.default_rng(3)
    table = pd.DataFrame({"fold": np.arange(60_001) % 2, "a": rng.lognormal(0, 3, 60_001), "b": np.round(rng.normal(0, 1, 60_001), 1), "c": None}).astype({"c": float})
    table.loc[::7, "a"] = None
    frame = spark.createDataFrame(table).withColumns({k: F.when(~F.isnan(k), F.col(k)) for k in "abc"}).repartition(8)
    got = {r.fold: r for r in O.fold_medians(frame, ["a", "b", "c"]).collect()}
    for fold, rows in table.groupby("fold"):
        for k in "ab":
            v = np.sort(rows[k].dropna())
            assert got[fold][f"_m_{k}"] == v[math.ceil(len(v) / 2) - 1]
        assert got[fold]["_m_c"] is None


# documents (A9, A10)

def test_ownership_documents(spark):
    def doc(inner, plan="0"):
        return f"<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerCik>0001</rptOwnerCik></reportingOwnerId></reportingOwner>\n<aff10b5One>{plan}</aff10b5One>\n<nonDerivativeTable>{inner}</nonDerivativeTable></ownershipDocument>"

    def trade(code, shares, price, note=""):
        amounts = "".join(f"<{k}><value>{v}</value></{k}>" for k, v in (("transactionShares", shares), ("transactionPricePerShare", price)) if v is not None)
        return f"<nonDerivativeTransaction><transactionCoding><transactionCode>{code}</transactionCode></transactionCoding>{note}<transactionAmounts>{amounts}</transactionAmounts></nonDerivativeTransaction>"

    docs = [("a", doc(trade("P", 1000, 50.5) + trade("F", 10, None))), ("b", doc(trade("S", 5, None, "<footnote>a Rule 10b5-1 plan</footnote>") + trade("S", 7, 2))), ("c", doc(trade("P", 1, 2), "1")),
            ("d", doc("")), ("e", "no xml <"), ("f", None), ("g", doc(trade("P", "many", 3) + trade("P", 4, 3).replace("<value>", "").replace("</value>", "")))]
    got = sorted(tuple(r) for r in R.form4_transactions(spark.createDataFrame(docs, "accession string, xml string")).collect())
    assert got == [("a", "0001", "P", 1000.0, 50.5, 50500.0, False), ("b", "0001", "S", 5.0, 0.0, 0.0, True), ("b", "0001", "S", 7.0, 2.0, 14.0, False), ("c", "0001", "P", 1.0, 2.0, 2.0, True), ("g", "0001", "P", 4.0, 3.0, 12.0, False)]


def test_company_facts_with_instants_and_shares(spark):
    fact = lambda end, val, filed, start=None, form="10-Q": {"end": end, "val": val, "filed": filed, "form": form} | ({"start": start} if start else {})
    d = {"cik": 1, "facts": {
        "us-gaap": {"Revenues": {"label": "x", "units": {"USD": [fact("2020-03-31", 5, "2020-05-01", "2020-01-01"), fact("2020-03-31", 6, "2021-05-01", "2020-01-01"), fact("2020-06-30", 1, "2020-05-01", "2020-04-01", "8-K")]}},
                    "SalesRevenueNet": {"units": {"USD": [fact("2020-03-31", 7, "2020-05-01", "2020-01-01")]}},
                    "Assets": {"units": {"USD": [fact("2020-03-31", 9, "2020-05-01"), fact("2012-03-31", 1, "2012-05-01")]}}},
        "dei": {"EntityCommonStockSharesOutstanding": {"units": {"shares": [fact("2020-04-25", 3, "2020-05-01", form="10-K")]}}}}}
    docs = spark.createDataFrame([("X", json.dumps(d)), ("Y", "{}"), ("Z", None), ("W", "no json")], "ticker string, json string")
    got = sorted((r.ticker, r.item, str(r.start), str(r.end), str(r.filed), r.val) for r in R.company_facts(docs, {"rev": ["Revenues", "SalesRevenueNet"]}, instants={"assets": ["Assets"]}).collect())
    assert got == [("X", "assets", "None", "2020-03-31", "2020-05-01", 9.0), ("X", "rev", "2020-01-01", "2020-03-31", "2020-05-01", 5.0), ("X", "shares", "None", "2020-04-25", "2020-05-01", 3.0)]


# calendars (B14)

def test_holidays():
    days = B.market_holidays(2024, 2026)
    assert {dt.date(2024, 3, 29), dt.date(2025, 4, 18), dt.date(2026, 4, 3), dt.date(2024, 11, 28), dt.date(2026, 7, 3), dt.date(2025, 1, 20), dt.date(2024, 5, 27), dt.date(2025, 9, 1), dt.date(2026, 6, 19), dt.date(2026, 2, 16)} <= set(days)
    assert len(days) == 30 and all(d.weekday() < 5 for d in days)


def blackout(spark, hours, stock, earnings=(), fed=(), jobs=(), fn=B.blackout):
    days = lambda xs: spark.createDataFrame([(x,) for x in xs], "day date")
    bars = spark.createDataFrame([(1, h) for h in hours], "asset long, ts timestamp")
    out = fn(bars, spark.createDataFrame([(1, stock)], "asset long, stock boolean"), spark.createDataFrame([(1, x) for x in earnings], "asset long, day date"), days(fed), days(jobs), B.market_holidays(2026, 2027))
    return sorted(r.ts for r in out.filter("blocked").collect())


def session(day, last=20, first=14):
    """Bars from 9 to 15 o'clock of New York in summer time, in UTC."""
    return [dt.datetime(day.year, day.month, day.day, h) for h in range(first - 1, last)]


def test_blackout_rules(spark):
    thu, fri, mon = dt.date(2026, 7, 30), dt.date(2026, 7, 31), dt.date(2026, 8, 3)
    hours = session(thu) + session(fri) + session(mon)
    assert blackout(spark, hours, True, earnings=[mon]) == [session(fri)[-1], *session(mon)]
    assert blackout(spark, hours, False, earnings=[mon]) == []
    assert [h.hour for h in blackout(spark, hours, True, fed=[fri])] == [17, 18, 19] == [h.hour for h in blackout(spark, hours, False, fed=[fri])]
    assert blackout(spark, hours, True, jobs=[fri]) == [session(thu)[-1]]
    crypto = [dt.datetime(2026, 7, 31, h) for h in range(24)]
    assert blackout(spark, crypto, False, jobs=[fri]) == [dt.datetime(2026, 7, 31, 12)]
    # an event after the newest session: only with no trading day between, and only its bar of 15 o'clock
    assert blackout(spark, session(mon), True, jobs=[dt.date(2026, 8, 7)]) == []
    assert blackout(spark, session(thu), True, jobs=[fri]) == [session(thu)[-1]]
    assert blackout(spark, session(thu, last=17), True, jobs=[fri]) == []
    assert blackout(spark, session(dt.date(2026, 7, 2)), True, earnings=[dt.date(2026, 7, 6)]) == [session(dt.date(2026, 7, 2))[-1]]  # the holiday on Friday is no trading day
    assert blackout(spark, session(thu), True, earnings=[dt.date(2026, 8, 5)]) == []


def test_next_bar_blocked(spark):
    thu, fri = dt.date(2026, 7, 30), dt.date(2026, 7, 31)
    nxt = lambda hours, stock, **days: bool(blackout(spark, hours, stock, fn=B.next_bar_blocked, **days))
    assert nxt(session(thu, last=19), True, jobs=[fri]) and not nxt(session(thu), True, jobs=[fri])
    assert nxt([dt.datetime(2026, 7, 31, 11)], False, jobs=[fri]) and not nxt([dt.datetime(2026, 7, 31, 12)], False, jobs=[fri])


# streams (Q9, Q10)

def files(spark, tmp_path, parts, schema):
    """A streaming reader of one file a batch, in order; parts may be added later."""
    for k, part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/p={k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def test_late_rows_are_counted(spark, tmp_path):
    at = lambda d, h=1: dt.datetime(2024, 1, d, h)
    schema = "asset long, ts timestamp, value double"
    parts = [[(1, at(1), 1.0), (1, at(2), 2.0)], [(1, at(10), 4.0), (2, at(10), 1.0)], [(1, at(6, 23), 8.0), (1, at(7), 16.0), (1, at(8), 32.0)], [(1, at(1), 64.0), (2, at(11), 2.0)]]
    places = {"out": f"{tmp_path}/out", "checkpoint": f"{tmp_path}/cp"}
    Q.run_late(files(spark, tmp_path, list(enumerate(parts[:3])), schema), **places)
    totals, counts = Q.run_late(files(spark, tmp_path, [(3, parts[3])], schema), **places)  # goes on after a restart
    assert [(r.kept, r.dropped) for r in counts.orderBy("batch").collect()] == [(2, 0), (2, 0), (2, 1), (1, 1)]
    assert {(r.asset, r.day.day): r.total for r in totals.collect()} == {(1, 1): 1.0, (1, 2): 2.0, (1, 10): 4.0, (2, 10): 1.0, (1, 7): 16.0, (1, 8): 32.0, (2, 11): 2.0}


def stops(prices, trades):
    out = []
    for trade, asset, side, entry, stop, trail, since in trades:
        best, stop = side * entry, side * stop
        for _, ts, _, price in sorted((p for p in prices if p[0] == asset and p[1] >= since), key=lambda p: p[1:3]):
            if side * price <= stop:
                out.append((trade, ts, "out", side * stop))
                break
            best = max(best, side * price)
            if best - trail > stop:
                stop = best - trail
                out.append((trade, ts, "move", side * stop))
    return sorted(out)


def test_stops_of_open_trades_over_files_and_a_restart(spark, tmp_path):
    rng, start = random.Random(11), dt.datetime(2024, 1, 1)
    prices = []
    for asset in (1, 2, 3):
        p = 100.0
        for i in range(60):
            p += rng.gauss(0.02, 0.5)
            prices.append((asset, start + dt.timedelta(minutes=i), i, p))
    trades = [(10 * a + k, a, side, 100.0, 100.0 - side * 1.5, 1.0 + k, start + dt.timedelta(minutes=5 * k)) for a, (k, side) in itertools.product((1, 2, 3), enumerate((1, -1, 1)))]
    plan = spark.createDataFrame(trades, "trade long, asset long, side int, entry double, stop double, trail double, since timestamp")
    schema = "asset long, ts timestamp, seq long, price double"
    # neighbours are swapped between files, and the last file only moves the watermark
    early = [p for p in prices if p[2] < 20 or p[2] == 22]
    mid = [p for p in prices if 20 <= p[2] < 40 and p[2] != 22]
    late = [p for p in prices if p[2] >= 40]
    flush = [(99, start + dt.timedelta(days=1), 0, 1.0)]
    places = {"out": f"{tmp_path}/out", "checkpoint": f"{tmp_path}/cp"}
    Q.run(Q.trade_stops(files(spark, tmp_path, [(0, early), (1, mid)], schema), plan), **places)
    more = plan.unionByName(spark.createDataFrame([(990, 99, 1, 1.0, 0.5, 1.0, start)], plan.schema))
    got = Q.run(Q.trade_stops(files(spark, tmp_path, [(2, late), (3, flush)], schema), more), **places)
    rows = sorted((r.trade, r.ts, r.kind, r.stop) for r in got.filter("trade <> 990").collect())
    want = stops(prices, trades)
    assert [r[:3] for r in rows] == [w[:3] for w in want] and np.allclose([r[3] for r in rows], [w[3] for w in want]) and len(want) > 20


def test_ledger_is_what_is_left_of_all_outcomes(spark):
    rnd = random.Random(5)
    bars = C.with_atr(spark.createDataFrame([(a, dt.date(2024, 1, 1) + dt.timedelta(days=i), *(lambda o, c: (o, max(o, c) + 1, min(o, c) - 1, c))(100 + rnd.gauss(0, 3), 100 + rnd.gauss(0, 3))) for a in range(3) for i in range(80)], "asset long, ts date, open double, high double, low double, close double"), 5)
    signals = bars.select("asset", "ts", F.when(F.rand(3) < 0.5, 1).otherwise(-1).alias("side")).filter(F.rand(4) < 0.5).withColumn("strategy", F.lit("x")).localCheckpoint()
    rules = {"a": L.ExitRule(1.0, 1.0, max_bars=4), "b": L.ExitRule(1.0, None, max_bars=7, trail_atr=1.0)}
    every = L.barrier_outcomes(signals, bars, rules, L.Costs(borrow_apr=0.02), ["strategy", "asset"])
    want = L.non_overlapping(every.localCheckpoint(), ["strategy", "asset", "rule_no"])
    got = L.ledger(signals, bars, rules, L.Costs(borrow_apr=0.02), ["strategy", "asset"])
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect()) and got.count() < every.count()
    plan = every._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # no (signal, bar) rows


def test_same_idea_over_shared_weeks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_TRIES", 2)
    rnd = random.Random(2)
    r = {(t, w): rnd.gauss(0, 1) for t in range(9) for w in range(14) if rnd.random() < 0.8 or t < 2}
    r |= {(9, w): 0.0 for w in range(14)}
    weekly = spark.createDataFrame([(t, dt.date(2024, 1, 1) + dt.timedelta(days=7 * w), float(x)) for (t, w), x in r.items()], "try_id long, week date, r double")
    tries = spark.createDataFrame([(t, t) for t in range(10)], "try_id long, family long")
    out = N.same_idea(tries.filter("try_id < 4"), tries.filter("try_id >= 4"), weekly, 0.4)
    frame = pd.DataFrame([(t, w, x) for (t, w), x in r.items()], columns=["t", "w", "r"]).pivot(index="w", columns="t", values="r").corr()
    assert {x.try_id for x in out.collect()} == {t for t in range(4, 10) if (frame.loc[t, [0, 1, 2, 3]] >= 0.4).any()}
    assert "corr(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_short_ratios_of_another_order_tie(spark):
    ratios = {1: [1.0, 2.0, 3.0], 2: [3.0, 2.0, 1.0]}
    panel = spark.createDataFrame([(a, DAY + dt.timedelta(7 * k), k) for a in ratios for k in range(4)], "asset long, ts date, sno long")
    volumes = spark.createDataFrame([(a, DAY + dt.timedelta(7 * k), v, 10.0) for a, vs in ratios.items() for k, v in enumerate(vs)], "asset long, ts date, short double, total double")
    ranks = lambda digits: {r.asset: r.short_rank for r in H.short_rank(panel, volumes, 3, 3, digits).collect() if r.short_rank is not None}
    assert ranks(12) == {1: 0.75, 2: 0.75} and ranks(None) == {1: 1.0, 2: 0.5}
