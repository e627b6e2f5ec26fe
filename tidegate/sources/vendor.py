"""The price vendor's wire formats and its REST source.

Payloads are decoded by Spark's own JSON functions. The Data Source `vendor` fetches over HTTP on one reader
partition a month for intraday series, and can be given a folder of saved payloads instead of a network.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import threading
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.columns import parse_timestamp

#: Instruments with their kind, the vendor's function, and other names they go by.
INSTRUMENTS: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "wti": ("standard", "WTI", ()),
    "brent": ("standard", "BRENT", ()),
    "natural_gas": ("standard", "NATURAL_GAS", ("naturalgas", "gas")),
    "copper": ("standard", "COPPER", ("cu",)),
    "aluminum": ("standard", "ALUMINUM", ("aluminium", "al")),
    "wheat": ("standard", "WHEAT", ()),
    "corn": ("standard", "CORN", ()),
    "cotton": ("standard", "COTTON", ()),
    "sugar": ("standard", "SUGAR", ()),
    "coffee": ("standard", "COFFEE", ()),
    "all_commodities": ("standard", "ALL_COMMODITIES", ("all",)),
    "gold": ("metal", "GOLD_SILVER_HISTORY", ("xau",)),
    "silver": ("metal", "GOLD_SILVER_HISTORY", ("xag",)),
    "spy": ("equity", "TIME_SERIES_DAILY_ADJUSTED", ()),
    "qqq": ("equity", "TIME_SERIES_DAILY_ADJUSTED", ()),
}
#: Intervals with other names, and the minutes of intraday ones.
INTERVALS: dict[str, tuple[tuple[str, ...], int | None]] = {
    "daily": (("d",), None),
    "weekly": (("w",), None),
    "monthly": (("m",), None),
    "quarterly": (("q",), None),
    "annual": (("a", "y", "yearly"), None),
    "1min": ((), 1),
    "5min": ((), 5),
    "15min": ((), 15),
    "30min": ((), 30),
    "60min": ((), 60),
}
#: Intervals that the vendor has for each kind, and for the instruments that differ.
ENERGY = ("wti", "brent", "natural_gas")
SUPPORTED = {"energy": ("daily", "weekly", "monthly"), "standard": ("monthly", "quarterly", "annual"), "metal": ("daily", "weekly", "monthly"), "equity": ("daily", "weekly", "monthly", "1min", "5min", "15min", "30min", "60min")}


def instrument(name: str) -> str:
    """The instrument's key, whatever the case, hyphens or short name."""
    x = name.strip().lower().replace("-", "_").replace(" ", "_")
    for key, (_, _, others) in INSTRUMENTS.items():
        if x == key or x in others:
            return key
    raise ValueError(f"no instrument {name!r}")


def interval(name: str) -> str:
    x = name.strip().lower()
    for key, (others, _) in INTERVALS.items():
        if x == key or x in others:
            return key
    raise ValueError(f"no interval {name!r}")


def supported(key: str) -> tuple[str, ...]:
    return SUPPORTED["energy" if key in ENERGY else INSTRUMENTS[key][0]]


def parse_series(text: str) -> tuple[str, str]:
    """`instrument:interval` (daily, or the first the vendor has, if left out), checked against what the vendor has."""
    name, _, how = text.partition(":")
    key = instrument(name)
    chosen = interval(how) if how else supported(key)[0]
    if chosen not in supported(key):
        raise ValueError(f"{key} has no {chosen} series")
    return key, chosen


SERIES_SCHEMA = "symbol string, interval string, name string, unit string, ts timestamp_ntz, value double"


def _number(text: Column) -> Column:
    """A number; "." is a missing one; anything else is an error of the payload."""
    return F.when(text != ".", text.cast("double"))


def decode_standard(payloads: DataFrame) -> DataFrame:
    """Rows of (symbol, interval, payload) with {name, interval, unit, data: [{date, value}]}; missing values are dropped."""
    kind = "name string, interval string, unit string, data array<struct<date string, value string>>"
    rows = payloads.select("symbol", "interval", F.from_json("payload", kind).alias("p")).select("symbol", "interval", "p.name", "p.unit", F.explode("p.data").alias("d"))
    return rows.where("d.value <> '.'").select("symbol", "interval", "name", "unit", parse_timestamp("d.date").alias("ts"), _number(F.col("d.value")).alias("value"))


def decode_metal(payloads: DataFrame) -> DataFrame:
    """Rows with {nominal, data: [{date, price}]}, in US dollars."""
    kind = "nominal string, data array<struct<date string, price string>>"
    rows = payloads.select("symbol", "interval", F.from_json("payload", kind).alias("p")).select("symbol", "interval", F.col("p.nominal").alias("name"), F.explode("p.data").alias("d"))
    return rows.where("d.price <> '.'").select("symbol", "interval", "name", F.lit("USD").alias("unit"), parse_timestamp("d.date").alias("ts"), _number(F.col("d.price")).alias("value"))


def decode_equity(payloads: DataFrame) -> DataFrame:
    """Rows whose series is the object beside "Meta Data"; the adjusted close, or else the close. Rows without date or number are dropped."""
    objects = F.map_filter(F.from_json("payload", "map<string,string>"), lambda k, v: (k != "Meta Data") & v.startswith("{"))
    symbol = F.get_json_object("payload", "$['Meta Data']['2. Symbol']")
    rows = payloads.select("symbol", "interval", symbol.alias("s"), F.get(F.map_values(objects), 0).alias("o"))
    rows = rows.select("symbol", "interval", "s", F.explode(F.from_json("o", "map<string,map<string,string>>")).alias("date", "v"))
    value = F.coalesce(F.col("v")["5. adjusted close"], F.col("v")["4. close"]).try_cast("double")
    rows = rows.select("symbol", "interval", F.concat(F.coalesce("s", F.upper("symbol")), F.lit(" Adjusted Close")).alias("name"), F.lit("USD").alias("unit"), parse_timestamp("date").alias("ts"), value.alias("value"))
    return rows.where("ts IS NOT NULL AND value IS NOT NULL")


def decode(payloads: DataFrame) -> DataFrame:
    """Payloads of any kind, by their symbol."""
    kinds = {k: [s for s, x in INSTRUMENTS.items() if x[0] == k] for k in ("standard", "metal", "equity")}
    parts = [f(payloads.where(F.col("symbol").isin(kinds[k]))) for k, f in (("standard", decode_standard), ("metal", decode_metal), ("equity", decode_equity))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


class RateLimiter:
    """A token bucket of a number of permits a minute; takes no more than that at once."""

    def __init__(self, per_minute: int = 75, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if per_minute < 1:
            raise ValueError("at least one request a minute is needed")
        self.capacity, self.step = float(per_minute), 60.0 / per_minute
        self.clock, self.sleep = clock, sleep
        self.permits, self.at, self.lock = self.capacity, clock(), threading.Lock()

    def acquire(self) -> None:
        with self.lock:
            while True:
                now = self.clock()
                self.permits, self.at = min(self.capacity, self.permits + (now - self.at) / self.step), now
                if self.permits >= 1:
                    self.permits -= 1
                    return
                self.sleep((1 - self.permits) * self.step)


def months_back(until: dt.date, first_year: int = 1990) -> Iterator[str]:
    """`YYYY-MM` from a date's month back to January of the first year."""
    y, m = until.year, until.month
    while y >= first_year:
        yield f"{y:04d}-{m:02d}"
        y, m = (y, m - 1) if m > 1 else (y - 1, 12)


def only_month(rows: list[tuple[str, str]], month: str) -> list[tuple[str, str]]:
    """Rows (timestamp, value) of the asked month; the vendor also sends neighbours."""
    return [r for r in rows if r[0].startswith(month)]


def query(key: str, how: str, api_key: str, month: str | None = None) -> dict[str, str]:
    kind, function, _ = INSTRUMENTS[key]
    minutes = INTERVALS[how][1]
    if kind == "equity":
        if minutes:
            return {"function": "TIME_SERIES_INTRADAY", "symbol": key.upper(), "interval": how, "outputsize": "full", "apikey": api_key} | ({"month": month} if month else {})
        return {"function": f"TIME_SERIES_{how.upper()}_ADJUSTED", "symbol": key.upper(), "outputsize": "full", "apikey": api_key}
    return {"function": function, "interval": how, "apikey": api_key} | ({"symbol": key.upper()} if kind == "metal" else {})


class MonthPartition(InputPartition):
    def __init__(self, month: str | None):
        super().__init__(month)
        self.month = month


class VendorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.key, self.how = parse_series(f"{options['symbol']}:{options.get('interval', '')}")
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        """A partition for each month asked for; one for all of a series that isn't split."""
        if INTERVALS[self.how][1] and "from" in self.options:
            until = dt.date.fromisoformat(self.options.get("until") or dt.date.today().isoformat())
            return [MonthPartition(m) for m in months_back(until, int(self.options["from"][:4])) if m >= self.options["from"][:7]]
        return [MonthPartition(None)]

    def fetch(self, month: str | None) -> str | None:
        """The payload: a saved file, or the vendor's answer, asked again a minute later if it tells of the rate limit."""
        if folder := self.options.get("path"):
            try:
                with open(f"{folder}/{self.key}_{self.how}{'_' + month if month else ''}.json", encoding="utf-8") as f:
                    return f.read()
            except FileNotFoundError:
                return None
        from urllib.request import urlopen

        url = f"{self.options['url']}?{urlencode(query(self.key, self.how, self.options['api_key'], month))}"
        limiter = RateLimiter(int(self.options.get("per_minute", 75)))
        for _ in range(3):
            limiter.acquire()
            with urlopen(url, timeout=60) as answer:
                text = answer.read().decode()
            if not re.search(r'^\s*\{\s*"(Note|Information)"', text):
                return text
            time.sleep(60)
        raise RuntimeError("the vendor's rate limit holds on")

    def read(self, partition: MonthPartition) -> Iterator[tuple]:
        text = self.fetch(partition.month)
        if text is None:
            return
        if partition.month:
            data = json.loads(text)
            for k, v in data.items():
                if isinstance(v, dict) and k != "Meta Data":
                    data[k] = {d: x for d, x in v.items() if d.startswith(partition.month)}
                    break
            text = json.dumps(data)
        yield self.key, self.how, text


class VendorSource(DataSource):
    """`spark.read.format("vendor").option("symbol", ...)`: payload rows for `decode`."""

    @classmethod
    def name(cls) -> str:
        return "vendor"

    def schema(self) -> str:
        return "symbol string, interval string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return VendorReader(self.options)
