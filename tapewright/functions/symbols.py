"""Symbol spellings, bases and quotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapewright.schemas import MARKET_TYPES, VENUES

#: Quote currencies in the order in which they are tried (fixed values).
BASE_SUFFIXES = ("USDT", "USDC", "BTC", "ETH", "BNB")
QUOTES = ("USDT", "USDC", "BUSD", "BTC", "ETH", "BNB", "USD", "EUR")


def normalize_symbol(symbol: Column) -> Column:
    return F.translate(F.upper(symbol), "-_", "")


def normalize_symbol_by_venue(venue: Column, symbol: Column) -> Column:
    """One spelling for a venue's own: contract suffixes and prefixes go, XBT is BTC."""
    s = F.upper(symbol)
    okx = F.translate(F.when((F.length(s) > 8) & s.endswith("-SWAP"), F.regexp_replace(s, "-SWAP$", "")).otherwise(s), "-", "")
    kucoin = F.translate(F.when(s.startswith("XBT") & s.endswith("M"), F.regexp_replace(F.regexp_replace(s, "^XBT", "BTC"), "M$", "")).otherwise(s), "-", "")
    bare = F.when(symbol.startswith("s"), F.upper(F.substring(symbol, 2, 1000))).otherwise(s)
    phemex = F.when(bare.endswith("USD"), F.concat(bare, F.lit("T"))).otherwise(bare)
    return F.when(venue == "okx", okx).when(venue == "kucoin", kucoin).when(venue == "phemex", phemex).when(venue == "gate", F.translate(s, "_", "")).otherwise(s)


def format_symbol(symbol: Column, venue: Column, market_type: Column) -> Column:
    """A normalised USDT symbol in a venue's spelling."""
    base = F.regexp_replace(symbol, "USDT$", "")
    has = symbol.endswith("USDT")
    okx = F.when(has, F.concat(base, F.when(market_type == "futures", "-USDT-SWAP").otherwise("-USDT"))).otherwise(symbol)
    kucoin = F.when(has, F.when(market_type == "futures", F.concat(symbol, F.lit("M"))).otherwise(F.concat(base, F.lit("-USDT")))).otherwise(symbol)
    gate = F.when(has, F.concat(base, F.lit("_USDT"))).otherwise(symbol)
    phemex = F.when(has, F.when(market_type == "futures", F.concat(base, F.lit("USD"))).otherwise(F.concat(F.lit("s"), symbol))).otherwise(symbol)
    return F.when(venue == "okx", okx).when(venue == "kucoin", kucoin).when(venue == "gate", gate).when(venue == "phemex", phemex).otherwise(symbol)


def normalize_side(side: Column) -> Column:
    return F.lower(side)


def base_symbol(symbol: Column) -> Column:
    """The coin of a pair: what stands before - or _, else without the first quote that fits."""
    out = F.when(symbol.contains("-"), F.substring_index(symbol, "-", 1)).when(symbol.contains("_"), F.substring_index(symbol, "_", 1))
    for quote in BASE_SUFFIXES:
        out = out.when(symbol.endswith(quote) & (F.length(symbol) > len(quote)), F.regexp_replace(symbol, f"{quote}$", ""))
    return out.otherwise(symbol)


def base_quote(symbol: Column) -> Column:
    """struct(base, quote); without a known quote the last three characters are the quote."""
    pair = lambda base, quote: F.struct(base.alias("base"), quote.alias("quote"))
    out = F.when(symbol.isNull(), F.lit(None))
    for quote in QUOTES:
        out = out.when(symbol.endswith(quote) & (F.length(symbol) > len(quote)), pair(F.regexp_replace(symbol, f"{quote}$", ""), F.lit(quote)))
    out = out.when(F.length(symbol) > 3, pair(F.left(symbol, F.length(symbol) - 3), F.right(symbol, F.lit(3))))
    return out.otherwise(pair(symbol, F.lit("")))


def clean_symbol(symbol: Column) -> Column:
    return F.upper(F.trim(symbol))


def is_valid_exchange(venue: Column) -> Column:
    return F.lower(venue).isin(*VENUES)


def is_valid_market(market_type: Column) -> Column:
    return F.lower(market_type).isin(*MARKET_TYPES)


def is_valid_symbol(symbol: Column) -> Column:
    return symbol.rlike("^[A-Z0-9]{2,10}$")


def match_bases(symbol: Column, *, leading_s: bool = True) -> Column:
    """Names of the targets that a trade's symbol belongs to, each once; an equi-join key after explode.

    The symbol itself; without USDT at its end, and without one - or _ before that; and, with
    ``leading_s``, without a leading S and USDT.
    """
    s = F.upper(symbol)
    bare = F.when(s.endswith("USDT"), F.regexp_replace(s, "USDT$", ""))
    names = [s, bare, F.when(bare.endswith("-"), F.regexp_replace(bare, "-$", "")), F.when(bare.endswith("_"), F.regexp_replace(bare, "_$", ""))]
    if leading_s:
        names.append(F.when(s.startswith("S") & s.endswith("USDT"), F.regexp_replace(F.regexp_replace(s, "^S", ""), "USDT$", "")))
    return F.array_distinct(F.filter(F.array(*names), lambda n: n.isNotNull() & (n != "")))


def symbols_of(base: Column, *, leading_s: bool = True) -> Column:
    """Upper-case symbols whose ``match_bases`` hold a target, each once: where listings are few and trades many, listings are exploded."""
    forms = [base, *(F.concat(base, F.lit(end)) for end in ("USDT", "-USDT", "_USDT"))]
    if leading_s:
        forms.append(F.concat(F.lit("S"), base, F.lit("USDT")))
    # What a symbol is compared with is upper case, so a target that is not has none.
    return F.when((base != "") & (F.upper(base) == base), F.array(*forms)).otherwise(F.array().cast("array<string>"))
