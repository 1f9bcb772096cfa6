"""Reading and writing bars, dimension tables and results as files."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.functions.scalars import lenient_date, lenient_double, normalise_cik, normalise_ticker
from pairloom.schemas import OVERRIDES, InputError, require_columns


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Parquet with a clear message when the path or a column is missing."""
    try:
        df = spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise InputError(f"input not found: {path}; run the stage that writes it first") from error
        raise
    return require_columns(df, *columns)


def read_security_files(spark: SparkSession, folder: str) -> DataFrame:
    """One Parquet file per security (Date, Open, .., Volume), the ticker being the file's name; one tidy table."""
    # Files written from data frames in nanoseconds are read as numbers.
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    df = spark.read.option("pathGlobFilter", "*.parquet").parquet(folder)
    names = {c.lower(): c for c in df.columns}
    if "date" not in names:
        raise InputError("columns missing: date")
    ticker = F.regexp_extract(F.input_file_name(), r"([^/]+)\.parquet", 1)
    values = [lenient_double(F.col(names[c])).alias(c) for c in ("open", "high", "low", "close", "volume") if c in names]
    day = F.col(names["date"])
    if dict(df.dtypes)[names["date"]] == "bigint":
        day = F.timestamp_micros(F.floor(day / 1000))
    return df.select(F.url_decode(ticker).alias("ticker"), F.to_date(day).alias("session"), *values)


def write_bars(bars: DataFrame, path: str) -> None:
    """Partitioned by year, sorted by ticker: scans of a date range and of a ticker both skip. Large years are several files."""
    rows = bars.withColumn("year", F.year("session"))
    rows.repartitionByRange("year", "ticker").sortWithinPartitions("year", "ticker", "session").write.mode("overwrite").partitionBy("year").parquet(path)


#: Matrices of a panel, sessions by tickers.
MATRICES = ("open", "close", "volume", "median_dollar_volume", "eligible")


def write_wide_panels(panel: DataFrame, path: str, tickers: list[str], matrices: tuple[str, ...] = MATRICES) -> None:
    """One Parquet table per matrix: session and a column for each ticker. A matrix is as wide as the list of tickers."""
    for name in matrices:
        wide = panel.groupBy("session").pivot("ticker", tickers).agg(F.first(name, ignorenulls=True))
        wide.orderBy("session").write.mode("overwrite").parquet(f"{path}/{name}")


def read_wide_panels(spark: SparkSession, path: str, matrices: tuple[str, ...] = MATRICES) -> DataFrame:
    """session, ticker and the matrices' values; a session or ticker that one of them lacks is null there."""
    out = None
    for name in matrices:
        wide = spark.read.parquet(f"{path}/{name}")
        tickers = [c for c in wide.columns if c != "session"]
        long = wide.select("session", F.explode(F.array(*[F.struct(F.lit(t).alias("ticker"), F.col(f"`{t}`").alias(name)) for t in tickers])).alias("r")).select("session", "r.*")
        out = long if out is None else out.join(long, ["session", "ticker"], "full")
    return out


def unpivot_quotes(wide: DataFrame, fields: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """Rows of one session with columns <field>_<ticker> to tidy bars."""
    found = sorted({m[2] for c in wide.columns if (m := re.match(rf"({'|'.join(fields)})_(.+)$", c))})
    if not found:
        raise InputError("no quote columns")
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("ticker"), *[(F.col(f"`{f}_{t}`").cast("double") if f"{f}_{t}" in wide.columns else F.lit(None).cast("double")).alias(f) for f in fields]) for t in found]))
    return wide.select("session", rows.alias("r")).select("r.ticker", "session", *[f"r.{f}" for f in fields]).dropna("all", subset=list(fields))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """The patch list; position is its order in the file."""
    text = "ticker string, action string, start_date string, end_date string, field string, reason string, source string"
    # A patch list is one small file; ids grow over its parts, numbers run through them.
    order = Window.orderBy("id")
    rows = read_csv(spark, path, text).withColumn("id", F.monotonically_increasing_id()).withColumn("position", F.row_number().over(order) - 1)
    rows = rows.withColumns({c: lenient_date(F.col(c)) for c in ("start_date", "end_date")})
    return rows.select(*[x.split()[0] for x in OVERRIDES.split(", ")])


class _Rows(HTMLParser):
    """Cells of the first table of a page."""

    def __init__(self):
        super().__init__()
        self.rows: list[list[str]] = []
        self.depth, self.done, self.cell = 0, False, None

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if tag == "table":
            self.depth += 1
        elif self.depth and tag == "tr":
            self.rows.append([])
        elif self.depth and tag in ("td", "th") and self.rows:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table" and self.depth:
            self.depth -= 1
            self.done = self.depth == 0

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


#: Column titles of the constituents table and the names used here.
TITLES = {
    "Symbol": "official_ticker", "Security": "company", "GICS Sector": "sector", "GICS Sub-Industry": "sub_industry",
    "Headquarters Location": "headquarters", "Date added": "date_added", "CIK": "cik", "Founded": "founded",
}


def constituents(spark: SparkSession, page: str) -> DataFrame:
    """The dimension table of a page's first table: one small page, parsed on the driver."""
    parser = _Rows()
    parser.feed(page)
    rows = [r for r in parser.rows if r]
    if not rows or (missing := sorted(set(TITLES) - set(rows[0]))):
        raise InputError(f"columns missing: {', '.join(missing) if rows else 'no table'}")
    at = [rows[0].index(t) for t in TITLES]
    df = spark.createDataFrame([tuple(r[i] if i < len(r) else None for i in at) for r in rows[1:]], ", ".join(f"{n} string" for n in TITLES.values()))
    return df.select(
        "official_ticker", normalise_ticker(F.col("official_ticker")).alias("yahoo_ticker"), "company", "sector", "sub_industry",
        lenient_date(F.col("date_added")).alias("date_added"), normalise_cik(F.col("cik")).alias("cik"), "headquarters", "founded", F.lit(True).alias("is_current_member"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header: for small result tables."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    """A one-row table as JSON, numbers that aren't finite as null."""
    clean = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in metrics.dtypes]
    metrics.select(*clean).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
