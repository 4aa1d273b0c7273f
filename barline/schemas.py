"""Fixed schemas of the tables that the library reads and writes."""

KLINE = "open_time long, open double, high double, low double, close double, volume double, close_time long, quote_volume double, trades long, taker_buy_base double, taker_buy_quote double, ignore string"
CANDLE = "symbol string, datetime timestamp, open double, high double, low double, close double, volume double"
SIGNAL = "symbol string, datetime timestamp, signal int, entry_price double, stop_price double, take_price double, size double, risk double, trailing_distance double"
LIVE_LEDGER = (
    "id string, open_time string, close_time string, symbol string, side string, entry_raw string, entry_exec string, close_raw string, close_exec string, "
    "quantity string, notional_entry_exec string, notional_close_exec string, commission_usdt string, pnl_mid string, pnl_exec string"
)
POSITION = "symbol string, side string, quantity double, entry_price double, stop_loss double, take_profit double, opened_at timestamp, balance double"
LEVEL = "array<struct<price:double,qty:double>>"
MESSAGE = (
    "data struct<e:string, s:string, b:string, a:string, p:string, q:string, T:long, "
    "k:struct<t:long, o:string, h:string, l:string, c:string, v:string, x:boolean>>, e string, s string, b array<array<string>>, a array<array<string>>"
)
