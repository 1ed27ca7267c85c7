"""Statement, list, instrument, feed and fundamentals ingest, and snapshot sinks.

Whole-file formats with inferred headers are read one file to a row (``binaryFile``) and parsed file by
file in ``mapInArrow``; all else is column expressions.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_symbol_from_path(spark: SparkSession, folder: str) -> DataFrame:
    """Bars of per-symbol files: the symbol is the file's name."""
    df = spark.read.parquet(folder)
    return df.withColumn("symbol", F.regexp_extract(F.col("_metadata.file_name"), r"^([^/]+?)(?:\.parquet)?$", 1))


def universe(bars: DataFrame) -> DataFrame:
    return bars.select("symbol").distinct()


def daily_with_fallback(daily: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of the preferred daily source, else of the other; ``source`` says which."""
    return daily.withColumn("source", F.lit("daily")).unionByName(other.join(daily.select("symbol").distinct(), "symbol", "left_anti").withColumn("source", F.lit("1day")))


def daily_universe(daily: DataFrame) -> DataFrame:
    """Adds day number since 2000-01-01, turnover (non-finite: 0) and the last day of all, for adjusted closes above zero."""
    turnover = F.col("close") * F.col("volume")
    ok = daily.where("adj_close > 0").withColumn("day", F.datediff("date", F.lit("2000-01-01").cast("date"))).withColumn("turnover", F.when(F.isnan(turnover) | turnover.isNull() | (F.abs(turnover) == float("inf")), 0.0).otherwise(turnover))
    return ok.crossJoin(F.broadcast(ok.agg(F.max("day").alias("last_day"))))  # one row


def surveillance(lines: DataFrame) -> DataFrame:
    """(file, nth, line) of list files to symbol, measure: header found by its names, else positional; blank means ``surveillance``."""
    parts = F.transform(F.split("line", ","), lambda x: F.trim(F.regexp_replace(x, '"', "")))
    low = F.transform("parts", lambda x: F.lower(x))
    known = F.array(*map(F.lit, ["measure", "category", "asm", "gsm", "stage", "type"]))
    rows = lines.withColumn("parts", parts).withColumn("low", low)
    rows = rows.withColumn("is_head", F.array_contains("low", "symbol") & F.arrays_overlap("low", known))
    head = rows.where("is_head").groupBy("file").agg(F.min_by("low", "nth").alias("head"), F.min("nth").alias("head_nth"))
    j = rows.join(head, "file", "left").where("head_nth IS NULL OR nth > head_nth")
    s_at = F.coalesce(F.array_position("head", "symbol"), F.lit(1)).cast("int")
    m_at = F.coalesce(F.expr("array_position(head, filter(head, x -> array_contains(array('measure','category','asm','gsm','stage','type'), x))[0])"), F.lit(2)).cast("int")
    measure = F.coalesce(F.try_element_at("parts", m_at), F.lit(""))
    return j.select("file", F.upper(F.try_element_at("parts", s_at)).alias("symbol"), F.when(measure == "", "surveillance").otherwise(measure).alias("measure")).where("symbol <> ''")


def instruments(rows: DataFrame, archive: DataFrame, cap: int | None = None) -> DataFrame:
    """Equities of the exchange, the first row of a symbol, that the archive has; sorted, capped."""
    w = Window.partitionBy("tradingsymbol").orderBy("nth")
    one = rows.where("exchange = 'NSE' AND instrument_type = 'EQ'").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    out = one.join(archive.select(F.col("symbol").alias("tradingsymbol")).distinct(), "tradingsymbol")
    return out.orderBy("tradingsymbol").limit(cap) if cap else out


def valid_symbol(c: Column) -> Column:
    return F.coalesce(c.rlike("^[A-Za-z0-9&-]{1,24}$"), F.lit(False))


# ---------------------------------------------------------------- statements

# Header names of each role, best first.
HOLDING_NAMES = {
    "symbol": ["symbol", "tradingsymbol", "scrip", "stock", "instrument", "ticker", "company", "name"], "qty": ["quantity", "qty", "shares", "units", "holding"],
    "avg_cost": ["average cost", "avg cost", "avg. cost", "average price", "buy price", "avg price", "price"], "buy_value": ["buy value", "invested value", "invested", "cost value", "investment"],
    "last_price": ["ltp", "closing price", "current price", "last price", "close price"], "sector": ["sector", "industry"], "isin": ["isin"],
}
TRADE_NAMES = {
    "exit_time": ["exit time", "sell time", "close time"], "entry_time": ["entry time", "buy time", "open time", "time"], "date": ["trade date", "date"], "symbol": HOLDING_NAMES["symbol"],
    "side": ["side", "direction", "type", "buy/sell"], "qty": HOLDING_NAMES["qty"], "pnl": ["realised p&l", "realized p&l", "p&l", "pnl", "profit"], "order_price": ["order price", "intended price"],
    "exit": ["exit price", "sell price", "exit", "sell avg"], "entry": ["entry price", "buy price", "entry", "buy avg", "price"],
}


def number(text: str | None) -> float | None:
    """Digits with separators, currency signs, and accounting negatives."""
    if not text:
        return None
    if text.isascii() and text.replace(".", "", 1).isdigit():
        return float(text)
    return _marked_number(text) if len(text) <= 32 else _marked_number.__wrapped__(text)


@lru_cache(4096)
def _marked_number(text: str) -> float | None:
    t = re.sub(r"[\s,₹$]|Rs\.?|INR", "", text)
    sign = -1 if t.startswith("(") and t.endswith(")") else 1
    try:
        return sign * float(t.strip("()"))
    except ValueError:
        return None


@lru_cache
def _cells(by: str) -> re.Pattern:
    return re.compile(rf'(?:^|{re.escape(by)})\s*(?:"((?:[^"]|"")*)"|([^{re.escape(by)}]*))')


def split_line(line: str, by: str) -> list[str]:
    if '"' not in line and not by.isspace():
        return [x.strip() for x in line.split(by)]
    return [(a or b).replace('""', '"').strip() for a, b in _cells(by).findall(line)]


def delimiter(lines: list[str]) -> str:
    """The one that cuts most lines into the same number (two or more) of parts."""
    def rectangular(by: str) -> int:
        if not any(by in x for x in lines):
            return 0
        n = [x.count(by) + 1 if '"' not in x and by != "\t" else len(split_line(x, by)) if by in x else 1 for x in lines]
        if n.count(n[0]) == len(n):
            return len(n) if n[0] >= 2 else 0
        often = Counter(n)
        best = max(set(n), key=often.get)
        return often[best] if best >= 2 else 0

    return max(",\t;|", key=rectangular)


def roles(cells: list[str], names: dict[str, list[str]]) -> dict[str, int]:
    """Role -> column: exact names before names contained, each column once, roles in the order of ``names``."""
    low, out = [re.sub(r"\s+", " ", c.lower()).strip() for c in cells], {}
    for test in (lambda c, n: c == n, lambda c, n: len(n) > 2 and n in c):
        for role, aliases in names.items():
            if role not in out:
                hit = next((i for n in aliases for i, c in enumerate(low) if i not in out.values() and test(c, n)), None)
                if hit is not None:
                    out[role] = hit
    return out


@lru_cache(1024)
def _header(cells: tuple[str, ...], trades: bool) -> dict[str, int]:
    """The roles of a line; files of one layout share their header."""
    return roles(list(cells), TRADE_NAMES if trades else HOLDING_NAMES)


def _table(text: str, names: dict[str, list[str]]) -> tuple[list[list[str]], dict[str, int], int]:
    lines = [x for x in text.replace("\r", "").split("\n") if x.strip()]
    by = delimiter(lines)
    rows = [split_line(x, by) for x in lines]
    # Data lines mostly end with a number: asked from there, one cell tells them from a header.
    texts = (i for i, r in enumerate(rows) if all(number(c) is None for c in reversed(r)))
    scored = [(len(found), -i, found) for i in texts if "symbol" in (found := _header(tuple(rows[i]), names is TRADE_NAMES)) and len(found) >= 2]
    if not scored:
        return rows, {}, -1
    _, i, found = max(scored, key=lambda x: x[:2])
    return rows, found, -i


def _picked(rows: list[list[str]], at: dict[str, int], names: tuple[str, ...]) -> Iterator[list[str]]:
    """The cells of the named roles in each row; empty for a role without a column and in rows that end before it."""
    places = [at.get(role, sys.maxsize) for role in names]
    for r in rows:
        width = len(r)
        yield [r[i] if i < width else "" for i in places]


def parse_holdings(text: str) -> Iterator[tuple]:
    """(symbol, qty, avg_cost, last_price, sector, warning) of one statement."""
    rows, at, head = _table(text, HOLDING_NAMES)
    body, last, sector = rows[head + 1 :], None, None
    for r, (name, held, each, whole, quoted, group) in zip(body, _picked(body, at, ("symbol", "qty", "avg_cost", "buy_value", "last_price", "sector"))):
        if at:
            symbol, qty, cost, value, last, sector = name, number(held), number(each), number(whole), number(quoted), group or None
            cost = value / qty if value is not None and qty else cost
        else:
            numbers = [x for x in map(number, r[1:]) if x is not None]
            if len(r) == 1:
                m = re.match(r"\s*([A-Za-z0-9&-]+)\s+([\d.,]+)\s+(?:@\s*)?([\d.,]+)\s*$", r[0])
                r, numbers = ([m[1]], [number(m[2]), number(m[3])]) if m else (r, [])
            symbol, qty, cost = r[0], *(numbers[:2] if len(numbers) >= 2 else (None, None))
        bad = "no symbol" if not symbol else "no quantity" if not qty else "no cost" if cost is None else None
        yield symbol.upper() or None, qty, cost, last, sector, bad


def day_of(text: str) -> str | None:
    m = re.match(r"\s*(\d{4})[-/](\d{1,2})[-/](\d{1,2})", text) or re.match(r"\s*(\d{1,2})[-/](\d{1,2})[-/](\d{4})", text)
    if not m:
        return None
    y, mo, d = m.groups() if len(m[1]) == 4 else m.groups()[::-1]
    return f"{int(y):04d}-{int(mo):02d}-{int(d):02d}" if 1 <= int(mo) <= 12 and 1 <= int(d) <= 31 else None


def parse_trades(text: str) -> Iterator[tuple]:
    """(symbol, side, qty, entry, exit, pnl, order_price, day, warning) of one statement."""
    rows, at, head = _table(text, TRADE_NAMES)
    body = rows[head + 1 :]
    for r, (symbol, side, qty, entry, exit_, pnl, order, *days) in zip(body, _picked(body, at, ("symbol", "side", "qty", "entry", "exit", "pnl", "order_price", "date", "exit_time", "entry_time"))):
        if at:
            row = [symbol, "SELL" if side.lower()[:1] == "s" else "BUY", *map(number, (qty, entry, exit_, pnl, order)), day_of(days[0] or days[1] or days[2])]
        else:  # symbol side qty entry exit | symbol qty entry exit | symbol pnl
            words = [x for x in r if x.lower() in ("buy", "sell", "long", "short")]
            n = [x for x in map(number, r[1:]) if x is not None]
            n = n if len(n) >= 3 else [None, None, None] + n[:1]
            row = [r[0], "SELL" if words and words[0].lower() in ("sell", "short") else "BUY", *n[:3], n[3] if len(n) > 3 else None, None, next((d for d in map(day_of, r) if d), None)]
        bad = "no symbol" if not row[0] else "no result" if row[5] is None and (row[3] is None or row[4] is None or not row[2]) else None
        yield (row[0].upper() or None, *row[1:], bad)


#: Parsed rows that a task hands over together.
ROWS_AT_ONCE = 10_000


def statements(files: DataFrame, kind: str) -> DataFrame:
    """(path, content) of statement files to rows with warnings; every file is parsed whole, on its own. Rows leave a task
    ROWS_AT_ONCE together, whatever the files, so that small files cost no more than their rows."""
    parse, shape = {
        "holdings": (parse_holdings, "path string, nth int, symbol string, qty double, avg_cost double, last_price double, sector string, warning string"),
        "trades": (parse_trades, "path string, nth int, symbol string, side string, qty double, entry double, exit double, pnl double, order_price double, day string, warning string"),
    }[kind]
    fields = [c.split() for c in shape.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            # Contents one by one: a batch of long files is not held twice.
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for i, r in enumerate(parse((content.as_py() or b"").decode("utf-8", "replace"))):
                    rows.append((path, i, *r))
                    if len(rows) == ROWS_AT_ONCE:
                        yield packed(rows)
                        rows = []
        if rows:
            yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[t], from_pandas=True) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])

    return files.select("path", "content").mapInArrow(run, shape)


def closed_rows(trades: DataFrame) -> DataFrame:
    """Statement trades to closed journal rows: given result, else from prices; slippage if there is an order price."""
    sign = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    return trades.withColumn("pnl", F.coalesce("pnl", F.col("qty") * (F.col("exit") - F.col("entry")) * sign)).withColumn("slippage", F.when(F.col("order_price").isNotNull(), (F.col("entry") - F.col("order_price")) * sign))


IMPORT_KEY = ["symbol", "side", "qty", "paise", "day"]


def new_imports(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Rows not seen before, by symbol, side, quantity, result in paise and exit day; replace mode passes no ``existing``."""
    keyed = lambda d: d.withColumn("paise", F.round(F.col("pnl") * 100).cast("long"))
    out = keyed(rows).dropDuplicates(IMPORT_KEY)
    return out if existing is None else out.join(keyed(existing).select(*IMPORT_KEY), IMPORT_KEY, "left_anti")


# ---------------------------------------------------------------- metadata, fundamentals, feeds


def flatten_metrics(rows: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """(symbol, metrics map<string,double>) to one column per field: the first non-null of its aliases; all-null rows drop out."""
    norm = F.transform_keys("metrics", lambda k, v: F.lower(F.regexp_replace(k, "[^A-Za-z0-9]", "")))
    out = rows.withColumn("m", norm).select("symbol", *[F.coalesce(*[F.try_element_at("m", F.lit(a)) for a in names]).alias(c) for c, names in aliases.items()])
    some = None
    for c in aliases:
        some = F.col(c).isNotNull() if some is None else some | F.col(c).isNotNull()
    return out.where(some)


def merge_metadata(fresh: DataFrame, prior: DataFrame, listing: DataFrame, default: str = "Unknown") -> DataFrame:
    """sector and name by priority fresh, prior, listing, default; symbols without a rank follow the highest one."""
    a, b, c = (d.select("symbol", *[F.col(x).alias(f"{p}_{x}") for x in ("name", "sector")], *([F.col("rank")] if p == "p" else [])) for d, p in ((fresh, "f"), (prior, "p"), (listing, "l")))
    j = a.join(b, "symbol", "full").join(c, "symbol", "full")
    top = prior.agg(F.coalesce(F.max("rank"), F.lit(0)).alias("top"))
    j = j.crossJoin(F.broadcast(top))  # one row
    fresh_rank = F.row_number().over(Window.partitionBy(F.col("rank").isNull()).orderBy("symbol"))
    pick = lambda x, d: F.coalesce(f"f_{x}", f"p_{x}", f"l_{x}", d).alias(x)
    return j.select("symbol", pick("name", F.col("symbol").cast("string")), pick("sector", F.lit(default)), F.coalesce("rank", F.col("top") + fresh_rank).cast("int").alias("rank"))


def headlines(feed: DataFrame) -> DataFrame:
    """(symbol, json) of feed rows: up to three headlines without tags, percent change given as number or text."""
    s = F.from_json("json", "headlines array<string>, percentChange string")
    clean = F.transform(F.slice(F.coalesce(s["headlines"], F.array().cast("array<string>")), 1, 3), lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", "")))
    return feed.select("symbol", clean.alias("headlines"), F.expr("try_cast(regexp_replace(from_json(json, 'percentChange string').percentChange, '[%+,]', '') AS DOUBLE)").alias("pct_change"))


def expected_session(as_of: Column) -> Column:
    """The session whose bars should be there: today after 17:00, else the weekday before."""
    day = F.when(F.hour(as_of) >= 17, F.to_date(as_of)).otherwise(F.date_sub(F.to_date(as_of), 1))
    return F.when(F.dayofweek(day) == 1, F.date_sub(day, 2)).when(F.dayofweek(day) == 7, F.date_sub(day, 1)).otherwise(day)


def freshness(bars: DataFrame, as_of: Column) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max("session_date").alias("last")).select("symbol", F.col("last").cast("string").alias("last_session"), F.datediff(expected_session(as_of), "last").alias("days_behind"), (F.col("last") >= expected_session(as_of)).alias("fresh"))


# ---------------------------------------------------------------- sinks


def write_edges(edges: DataFrame, path: str) -> None:
    """Edge maps by timeframe; writing one timeframe leaves the others."""
    edges.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tf").parquet(path)


def export_journal(journal: DataFrame, path: str) -> None:
    """CSV with a header and quoted strings; null is empty."""
    text = [F.col(f.name).cast("string").alias(f.name) for f in journal.schema.fields]
    journal.select(*text).write.mode("overwrite").csv(path, header=True, quoteAll=True, nullValue="", emptyValue="")


def edge_freshness(edges: DataFrame) -> DataFrame:
    ok = F.col("eligible")
    return edges.agg(F.count_distinct("symbol").alias("symbols"), F.count_distinct(F.when(ok, F.col("symbol"))).alias("eligible_symbols"), F.sum(ok.cast("long")).alias("eligible_edges"), F.count(F.lit(1)).alias("edges"))


_ARTICLE = "title: string, source: string"
#: Where the two providers keep their articles, the text behind a missing title, and the scores of an article.
PROVIDERS = {
    "marketaux": (f"struct<data: array<struct<{_ARTICLE}, description: string, entities: array<struct<sentiment_score: string>>>>>", "data", "description", "a.entities.sentiment_score"),
    "eodhd": (f"array<struct<{_ARTICLE}, content: string, sentiment: struct<polarity: string>>>", "", "content", "array(a.sentiment.polarity)"),
}


def provider_sentiment(feed: DataFrame) -> DataFrame:
    """``feed`` (with provider and body, a provider's JSON answer) with sentiment, headline and source.

    The sentiment is the mean of all scores of all articles, numbers or numbers as text, clamped to -1..1, and 0 when articles
    have none; headline and source are the first article's. Answers without articles, broken ones and those of other
    providers have null in all three.
    """
    from functools import reduce

    found = []
    for name, (shape, at, text, scores) in PROVIDERS.items():
        read = F.from_json("body", shape)
        articles = (read[at] if at else read).alias("articles")
        rows = feed.where(F.col("provider") == name).withColumn("__a", articles).withColumn("__a", F.when(F.size("__a") > 0, F.col("__a")))
        rows = rows.withColumn("__s", F.expr(f"filter(transform(flatten(transform(__a, a -> coalesce({scores}, array()))), s -> try_cast(trim(s) AS double)), s -> s IS NOT NULL)"))
        mean = F.expr("aggregate(__s, 0D, (t, s) -> t + s) / nullif(size(__s), 0)")
        first = F.col("__a")[0]
        here = F.col("__a").isNotNull()
        found.append(rows.select(
            *feed.columns, F.when(here, F.greatest(F.least(F.coalesce(mean, F.lit(0.0)), F.lit(1.0)), F.lit(-1.0))).alias("sentiment"),
            F.when(here, F.trim(F.coalesce(first["title"], first[text], F.lit("")))).alias("headline"), F.when(here, F.trim(F.coalesce(first["source"], F.lit(name)))).alias("source"),
        ))
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("sentiment", "double"), ("headline", "string"), ("source", "string"))]
    found.append(feed.where(F.coalesce(~F.col("provider").isin(*PROVIDERS), F.lit(True))).select(*feed.columns, *none))
    return reduce(DataFrame.unionByName, found)
