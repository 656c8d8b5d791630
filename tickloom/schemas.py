"""Explicit schemas (DDL) of stored tables; nothing is inferred."""


def names(ddl: str) -> list[str]:
    """Column names of a schema without nested fields."""
    return [field.split()[0] for field in ddl.split(", ")]


BARS = ("exchange string, symbol string, timeframe string, ms long, open double, high double, low double, close double, volume double")
RATES = ("symbol string, ms long, rate double")
TRADES = (
    "book string, symbol string, side string, entry_ms long, exit_ms long, qty double, entry_price double, exit_price double, "
    "exit_reason string, fees double, pnl double, prob double")
FILLS = ("book string, symbol string, side string, ms long, qty double, price double, fee double, value double")
EQUITY = ("book string, ms long, seq long, symbol string, close double, equity double, cash double")
ALERTS = ("book string, ms long, kind string, symbol string, message string, ok boolean, params map<string,string>")
STATE = ("book string, updated_ms long, equity double, cash double, last_close map<string,double>")
HISTORY = ("timestamp timestamp, scope string, field string, old string, new string, actor string")
EXPERIMENTS = ("timestamp timestamp, name string, strategy map<string,string>, metrics map<string,double>")
VENDOR_CHART = (
    "chart struct<result:array<struct<meta:struct<symbol:string>,timestamp:array<long>,indicators:struct<quote:array<struct<"
    "open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>>>>>,error:struct<code:string>>")
