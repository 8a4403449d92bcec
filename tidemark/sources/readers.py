"""Readers and sinks: files with explicit schemas, bad values to null, NaN to null, and parsers of text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BARS_SCHEMA = "date DATE, symbol STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"
SUBMISSION_SCHEMA = "ACCESSION_NUMBER STRING, FILING_DATE STRING, DOCUMENT_TYPE STRING, ISSUERTRADINGSYMBOL STRING"
TRANSACTION_SCHEMA = "ACCESSION_NUMBER STRING, TRANS_CODE STRING, TRANS_DATE STRING, TRANS_SHARES STRING, TRANS_PRICEPERSHARE STRING"
OWNER_SCHEMA = "ACCESSION_NUMBER STRING, OWNER_NO INT, RPTOWNERNAME STRING, RPTOWNER_RELATIONSHIP STRING, RPTOWNER_TITLE STRING"
SHORT_SCHEMA = "Date STRING, Symbol STRING, ShortVolume DOUBLE, ShortExemptVolume DOUBLE, TotalVolume DOUBLE, Market STRING"
VIEW_SCHEMA = "asset STRING, bias INT, confidence DOUBLE, horizon_days INT, key_events ARRAY<STRING>, reasoning STRING"
CHAIN_SCHEMA = "MAP<STRING, STRUCT<latestQuote: STRUCT<bp: DOUBLE, ap: DOUBLE>, latestTrade: STRUCT<p: DOUBLE>, dailyBar: STRUCT<v: DOUBLE>, greeks: STRUCT<delta: DOUBLE>, impliedVolatility: DOUBLE>>"
_FACT = "MAP<STRING, STRUCT<units: MAP<STRING, ARRAY<STRUCT<start: STRING, `end`: STRING, val: DOUBLE, filed: STRING, form: STRING>>>>>"
FACTS_SCHEMA = f"STRUCT<facts: STRUCT<`us-gaap`: {_FACT}, dei: {_FACT}>>"
#: Transactions stay text: a value stands in its element or in a `value` below it, and a plan is told anywhere inside.
FORM4_SCHEMA = ("STRUCT<aff10b5One: STRING, reportingOwner: ARRAY<STRUCT<reportingOwnerId: STRUCT<rptOwnerCik: STRING>>>, "
                "nonDerivativeTable: STRUCT<nonDerivativeTransaction: ARRAY<STRING>>>")

def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def read_bars(spark: SparkSession, path: str, min_days: int) -> DataFrame:
    """Daily bars from (compressed) CSV: without zero volume, symbols with `min_days` bars and only positive closes."""
    bars = nan_to_null(spark.read.schema(BARS_SCHEMA).csv(path, header=True, mode="PERMISSIVE")).filter("volume > 0")
    good = bars.groupBy("symbol").agg(F.count("*").alias("n"), F.min("close").alias("least")).filter((F.col("n") >= min_days) & (F.col("least") > 0))
    return bars.join(good.select("symbol"), "symbol", "left_semi")


def clean_symbol(c: str) -> Column:
    return F.translate(F.upper(F.trim(c)), ".", "-")


def read_filings(spark: SparkSession, folder: str) -> DataFrame:
    """Open-market purchases and sales of a quarter: submissions, transactions and each filing's first owner."""
    def tsv(name, schema):
        return spark.read.schema(schema).csv(f"{folder}/{name}", sep="\t", header=True, quote="")
    sub = tsv("SUBMISSION", SUBMISSION_SCHEMA).filter(F.col("DOCUMENT_TYPE").isin("4", "4/A"))
    sub = sub.select("ACCESSION_NUMBER", clean_symbol("ISSUERTRADINGSYMBOL").alias("ticker"), F.try_to_date("FILING_DATE", "dd-MMM-yyyy").alias("filed")).filter("filed is not null")
    trans = tsv("NONDERIV_TRANS", TRANSACTION_SCHEMA).filter(F.col("TRANS_CODE").isin("P", "S"))
    owner = tsv("REPORTINGOWNER", OWNER_SCHEMA).groupBy("ACCESSION_NUMBER").agg(F.min_by(F.struct("RPTOWNERNAME", "RPTOWNER_RELATIONSHIP", "RPTOWNER_TITLE"), "OWNER_NO").alias("o"))
    number = lambda c: F.expr(f"try_cast({c} as double)")
    return trans.join(sub, "ACCESSION_NUMBER").join(owner, "ACCESSION_NUMBER", "left").select(
        F.col("ACCESSION_NUMBER").alias("accession"), "ticker", "filed", F.try_to_date("TRANS_DATE", "dd-MMM-yyyy").alias("traded"), F.col("TRANS_CODE").alias("code"),
        F.col("o.RPTOWNERNAME").alias("owner"), F.col("o.RPTOWNER_RELATIONSHIP").alias("role"), F.col("o.RPTOWNER_TITLE").alias("title"),
        number("TRANS_SHARES").alias("shares"), number("TRANS_PRICEPERSHARE").alias("price"))


def union_recent(bulk: DataFrame, recent: DataFrame, key: Sequence[str]) -> DataFrame:
    return bulk.unionByName(recent, allowMissingColumns=True).dropDuplicates(list(key))


def read_short_feeds(spark: SparkSession, paths: Sequence[str], tickers: DataFrame | None = None) -> DataFrame:
    """Short and total volume per day and symbol, summed over all pipe-delimited feeds."""
    df = spark.read.schema(SHORT_SCHEMA).csv(list(paths), sep="|", header=True).filter("Symbol is not null and TotalVolume is not null")
    if tickers is not None:
        df = df.join(tickers, df.Symbol == tickers.ticker, "left_semi")
    return df.groupBy(F.to_date("Date", "yyyyMMdd").alias("date"), F.col("Symbol").alias("ticker")).agg(F.sum("ShortVolume").alias("short"), F.sum("TotalVolume").alias("total"))


def newest_per_key(df: DataFrame, key: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The last version of each key, chosen while aggregating (no sort, combines map-side)."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_r")).select(*key, "_r.*")


def upsert_days(stored: DataFrame, new: DataFrame, keep_days: int, key: Sequence[str] = ("date", "ticker")) -> DataFrame:
    """Stored rows plus those of days not stored yet, the last write per key, the last `keep_days` days kept."""
    fresh = new.join(stored.select("date").distinct(), "date", "left_anti")
    both = newest_per_key(stored.unionByName(fresh), key, ["load_ts"])
    newest = both.agg(F.max("date").alias("_m"))
    return both.filter(F.col("date") > F.date_sub(newest.select("_m").scalar(), keep_days))


def short_ratio(full: DataFrame, recent: DataFrame) -> DataFrame:
    """Short share per day and ticker, recent rows winning; usable from the next session."""
    both = full.withColumn("_v", F.lit(0)).unionByName(recent.withColumn("_v", F.lit(1)))
    df = newest_per_key(both, ["date", "ticker"], ["_v", "total", "short"]).filter("total > 0")
    return df.select("date", "ticker", (F.col("short") / F.col("total")).alias("ratio"))


def refresh_overlap(old: DataFrame, new: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Append newly fetched bars; an asset whose overlapping closes moved (re-adjusted history) is replaced whole."""
    both = old.select("asset", "ts", F.col("close").alias("_o")).join(new.select("asset", "ts", F.col("close").alias("_n")), ["asset", "ts"])
    moved = both.groupBy("asset").agg(F.max(F.abs(F.col("_n") / F.col("_o") - 1)).alias("_d")).filter(F.col("_d") > tolerance).select("asset")
    kept = old.join(moved, "asset", "left_anti").join(new.select("asset", "ts"), ["asset", "ts"], "left_anti")
    return kept.unionByName(new)


def company_facts(documents: DataFrame, durations: dict[str, Sequence[str]], earliest: str = "2013-01-01", instants: dict[str, Sequence[str]] | None = None,
                  shares: Sequence[str] = ("EntityCommonStockSharesOutstanding",)) -> DataFrame:
    """(ticker, item, start, end, filed, val) from company fact documents `(ticker, json)`: values of annual and quarterly
    reports under `facts.us-gaap`, and share counts under `facts.dei` as the item `shares`.

    The first filed version of each period stays, tags in order of preference on the same day. `durations` name items over
    a period; `instants` items at its end, which have no start and are one a day, as share counts are."""
    body = documents.select("ticker", F.from_json("json", FACTS_SCHEMA).alias("d"))
    named = [(item, tag, i, timed) for items, timed in ((durations, True), (instants or {}, False)) for item, tags in items.items() for i, tag in enumerate(tags)]
    entry = lambda item, i, timed: F.struct(F.lit(item).alias("item"), F.lit(i).alias("pref"), F.lit(timed).alias("timed"))

    def rows(facts: str, wanted: list[tuple]) -> DataFrame:
        known = F.create_map(*[x for item, tag, i, timed in wanted for x in (F.lit(tag), entry(item, i, timed))])
        df = body.select("ticker", F.explode(f"d.facts.{facts}").alias("tag", "body")).withColumn("_p", known[F.col("tag")]).filter("_p is not null")
        return df.select("ticker", "_p.*", F.explode("body.units").alias("unit", "rows")).select("ticker", "item", "pref", "timed", F.explode("rows").alias("r"))

    df = rows("`us-gaap`", named).unionByName(rows("dei", [("shares", tag, i, False) for i, tag in enumerate(shares)]))
    start = F.when(F.col("timed"), F.to_date("r.start"))
    df = df.filter(F.col("r.form").startswith("10-")).select("ticker", "item", "pref", "timed", start.alias("start"), F.to_date("r.end").alias("end"), F.to_date("r.filed").alias("filed"), F.col("r.val").alias("val"))
    df = df.filter((F.col("end") >= F.lit(earliest).cast("date")) & (~F.col("timed") | F.col("start").isNotNull()))
    return df.groupBy("ticker", "item", "start", "end").agg(F.min(F.struct("filed", "pref", "val")).alias("f")).select("ticker", "item", "start", "end", "f.filed", "f.val")


def _inside(block: str, name: str) -> Column:
    """Text of an element of a block of XML, its own or that of a `value` in it; null where there is none."""
    found = F.regexp_extract(block, rf"(?s)<{name}>\s*(?:<value>)?\s*([^<\s](?:[^<]*[^<\s])?)\s*<", 1)
    return F.when(found != "", found)


def form4_transactions(documents: DataFrame) -> DataFrame:
    """Open-market purchases and sales of ownership documents `(accession, xml)`: owner, code, shares, price, value, and
    whether they were made under a trading plan, as the document or the transaction says. A number that is lacking is 0,
    a transaction with one that cannot be read is left out, and so is a document that is no XML."""
    d = documents.select("accession", F.from_xml("xml", FORM4_SCHEMA).alias("d"))
    t = d.select("accession", F.col("d.reportingOwner")[0]["reportingOwnerId"]["rptOwnerCik"].alias("owner"), F.coalesce(F.trim("d.aff10b5One").isin("1", "true"), F.lit(False)).alias("_all"), F.explode("d.nonDerivativeTable.nonDerivativeTransaction").alias("_t"))
    raw = {"shares": _inside("_t", "transactionShares"), "price": _inside("_t", "transactionPricePerShare")}
    t = t.select("accession", "owner", _inside("_t", "transactionCode").alias("code"), *[F.coalesce(v, F.lit("0")).try_cast("double").alias(k) for k, v in raw.items()], (F.col("_all") | F.contains("_t", F.lit("10b5-1"))).alias("plan"))
    t = t.filter(F.col("code").isin("P", "S") & F.col("shares").isNotNull() & F.col("price").isNotNull())
    return t.select("accession", "owner", "code", "shares", "price", (F.col("shares") * F.col("price")).alias("value"), "plan")


def option_rows(snapshots: DataFrame, today: Column) -> DataFrame:
    """One flat row per contract from nested chain documents `(underlying, json)`."""
    df = snapshots.select("underlying", F.explode(F.from_json("json", CHAIN_SCHEMA)).alias("symbol", "s"))
    expiry = F.to_date(F.regexp_extract("symbol", r"(\d{6})[CP]\d{8}$", 1), "yyMMdd")
    return df.select("underlying", "symbol", F.datediff(expiry, today).alias("dte"), F.col("s.latestQuote.bp").alias("bid"), F.col("s.latestQuote.ap").alias("ask"), F.col("s.latestTrade.p").alias("last"), F.col("s.dailyBar.v").alias("volume"), F.col("s.greeks.delta").alias("delta"), F.col("s.impliedVolatility").alias("iv"))


def checked_views(views: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid views with the horizon clipped to 1..30, rejected rows)."""
    ok = F.col("asset").isNotNull() & F.col("bias").between(-2, 2) & F.col("confidence").between(0, 1)
    ok = F.coalesce(ok, F.lit(False))
    return views.filter(ok).withColumn("horizon_days", F.least(F.greatest("horizon_days", F.lit(1)), F.lit(30))), views.filter(~ok)


def read_views(spark: SparkSession, path: str) -> DataFrame:
    """Daily JSON arrays, the day taken from the file name."""
    df = spark.read.schema(VIEW_SCHEMA).json(path, multiLine=True)
    return df.withColumn("day", F.to_date(F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2}-\d{2})", 1)))


def registry_merge(mine: DataFrame, other: DataFrame) -> DataFrame:
    return mine.unionByName(other.join(mine.select("id"), "id", "left_anti"))


def rescore_compare(old: DataFrame, new: DataFrame, score: str) -> DataFrame:
    """Old and new score per id side by side in the old order, marking rows that were not scored again."""
    o = old.select("id", "position", F.col(score).alias("old_score"))
    return o.join(new.select("id", F.col(score).alias("new_score"), F.lit(True).alias("_again")), "id", "full_outer").select(
        "id", "position", "old_score", F.coalesce("new_score", "old_score").alias("score"), F.col("_again").isNull().alias("kept"))


def returns_store(rows: DataFrame) -> DataFrame:
    """Weekly returns per try on the full calendar of its data set: later files win, missing weeks are 0."""
    last = rows.groupBy("dataset", "try_id", "week").agg(F.max_by("r", F.struct("file_ts", "r")).alias("r"))
    weeks = last.select("dataset", "week").distinct()
    grid = last.select("dataset", "try_id").distinct().join(weeks, "dataset")
    return grid.join(last, ["dataset", "try_id", "week"], "left").select("dataset", "try_id", "week", F.coalesce("r", F.lit(0.0)).alias("r"))


def account_rollup(equity: DataFrame, trades: DataFrame, plan: DataFrame) -> DataFrame:
    e = equity.groupBy("account").agg(F.max_by("equity", "ts").alias("equity"), (F.max_by("equity", "ts") / F.min_by("equity", "ts") - 1).alias("ret"))
    t = trades.groupBy("account").agg(F.count("*").alias("trades"))
    p = plan.groupBy("account").agg(F.count("*").alias("open"))
    return e.join(t, "account", "left").join(p, "account", "left").na.fill(0, ["trades", "open"])


def submissions(documents: DataFrame, forms: Sequence[str], item: str | None) -> DataFrame:
    """Rows from parallel arrays of forms, items and dates `(ticker, json)`."""
    schema = "form ARRAY<STRING>, items ARRAY<STRING>, acceptanceDateTime ARRAY<STRING>, accessionNumber ARRAY<STRING>"
    df = documents.select("ticker", F.from_json("json", schema).alias("d"))
    rows = df.select("ticker", F.explode(F.arrays_zip("d.form", "d.items", "d.acceptanceDateTime", "d.accessionNumber")).alias("r"))
    rows = rows.filter(F.col("r.form").isin(*forms))
    if item:
        rows = rows.filter(F.col("r.items").contains(item))
    return rows.select("ticker", F.col("r.form").alias("form"), F.to_timestamp("r.acceptanceDateTime").alias("accepted"), F.col("r.accessionNumber").alias("accession"))


def index_filings(lines: DataFrame, tickers: DataFrame) -> DataFrame:
    """Ownership filings of a daily index: lines starting '4 ', the issuer third from the end, one row per accession."""
    parts = F.split(F.trim("value"), r"\s+")
    df = lines.filter(F.col("value").startswith("4 ")).select(F.element_at(parts, -3).cast("long").alias("cik"), F.regexp_extract(F.element_at(parts, -1), r"([\d-]+)\.txt$", 1).alias("accession"))
    return df.join(tickers, "cik").groupBy("accession").agg(F.min("ticker").alias("ticker"))


def seen_markers(filings: DataFrame, transactions: DataFrame) -> DataFrame:
    """Every filing's transactions, one marker row ('-') for a filing without any."""
    return filings.join(transactions, "accession", "left").withColumn("code", F.coalesce("code", F.lit("-")))


def keep_before_refresh(old: DataFrame, new: DataFrame, at: str, key: Sequence[str]) -> DataFrame:
    """Old rows of each key before its first refreshed moment, then the new rows; other keys untouched."""
    since = new.groupBy(*key).agg(F.min(at).alias("_since"))
    return old.join(since, list(key), "left").filter(F.col("_since").isNull() | (F.col(at) < F.col("_since"))).drop("_since").unionByName(new)


def universe_lookup(today: DataFrame, past: DataFrame) -> DataFrame:
    """Every symbol that is or was a member; today's sector overrides the past one."""
    p = past.groupBy("symbol").agg(F.max_by("sector", F.struct("start", "sector")).alias("_old"))
    return today.join(p, "symbol", "full_outer").select("symbol", F.coalesce("sector", "_old").alias("sector"), F.col("sector").isNotNull().alias("member"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = ()) -> None:
    """Sink in parquet, compressed CSV or JSON lines. A rerun replaces what it wrote: the whole table, or with `by` the
    partitions it has rows for."""
    w = df.write.mode("overwrite")
    if by:
        w = w.option("partitionOverwriteMode", "dynamic")
        w = w.partitionBy(*by)
    if fmt == "csv":
        w.option("header", True).option("compression", "gzip").csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
