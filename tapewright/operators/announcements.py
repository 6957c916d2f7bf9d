"""Announcements: which are due, what they list, and the listing events they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.numbers import parse_notice_time

# Fixed values, down to NOTICE_URL: forms of listing titles, in the order in which they are tried, with the group of the symbols and that of the markets.
TITLE_FORMS = (
    ("multiple_coin_market", r"([^(]+)\(([A-Z0-9]+)\)\s*\(([^)]+)\s*마켓\)", 2, 3),
    ("coins_with_parenthesis_markets", r"([^(]+)\(([A-Z0-9]+)\)[^(]*\(([^)]+)\s*마켓\)", 2, 3),
    ("market_outside_parenthesis", r"([^(]+)\(([A-Z0-9]+)\)[^A-Z]*([A-Z]+)\s*마켓", 2, 3),
    ("single_coin_single_market", r"([^(]+)\(([A-Z0-9]+)\)\s*([A-Z]+)\s*마켓", 2, 3),
    ("coin_list_in_parenthesis", r"([A-Z]+)\s*마켓[^(]*\(([^)]+)\)", 2, 1),
)
MULTI_FORMS = {
    "coin_and_markets": r"([가-힣A-Za-z0-9]+)\(([A-Z0-9]+)\)\(([^)]+) 마켓\)",
    "coin": r"([가-힣A-Za-z0-9]+)\(([A-Z0-9]+)\)",
    "markets_in_parenthesis": r"\(([A-Z, ]+) 마켓\)",
    "markets_outside": r"([A-Z, ]+) 마켓",
    "coin_and_market": r"([가-힣A-Za-z0-9]+)\(([A-Z0-9]+)\) ([A-Z, ]+) 마켓",
    "coin_list": r"(KRW|BTC|USDT) 마켓 디지털 자산 추가 \(([^)]+)\)",
}
LISTING_WORDS = ("디지털 자산 추가", "거래 지원", "신규 거래지원", "마켓 추가", "상장")
UPDATE_WORDS = ("krw", "신규 거래지원", "마켓")
NOTICE_URL = "https://upbit.com/service_center/notice?id="


def is_listing_title(title: Column) -> Column:
    out = F.lit(False)
    for word in LISTING_WORDS:
        out = out | title.contains(word)
    return out


def eligible_announcements(announcements: DataFrame, now_ms: int, *, longest_ms: int = 30 * 60_000) -> DataFrame:
    """Notices of at most ``longest_ms`` age with the new badge, or with the update badge and a listing word."""
    words = F.lit(False)
    for word in UPDATE_WORDS:
        words = words | F.lower("title").contains(word)
    return announcements.where((F.lit(now_ms) - F.col("announced_ms") <= longest_ms) & (F.col("need_new_badge") | (F.col("need_update_badge") & words)))


def newest_only_announcements(announcements: DataFrame, now_ms: int, *, longest_ms: int = 15_000) -> DataFrame:
    """The newest notice, if it is younger than ``longest_ms``, new and no update."""
    newest = announcements.orderBy(F.desc("announced_ms"), F.desc("id")).limit(1)
    return newest.where((F.lit(now_ms) - F.col("announced_ms") < longest_ms) & F.col("need_new_badge") & ~F.col("need_update_badge"))


def _listed(text: Column) -> Column:
    parts = F.split(F.regexp_replace(text, "마켓|market", ""), ",")
    return F.filter(F.transform(parts, lambda m: F.upper(F.trim(m))), lambda m: m != "")


def _markets(text: Column) -> Column:
    """Markets of a title with several coins: separated by commas or blanks, as they are written."""
    plain = F.regexp_replace(F.regexp_replace(text, "마켓|[()]", ""), ",", " ")
    return F.filter(F.split(plain, r"(?U)\s+"), lambda m: m != "")


def parse_listings(announcements: DataFrame) -> DataFrame:
    """Symbol (one per title), markets, KRW flag and the form that matched; titles of no form are left out."""
    title = F.trim("title")
    pattern, symbol, markets = F.when(F.lit(False), ""), F.when(F.lit(False), ""), F.when(F.lit(False), F.array(F.lit("")))
    for name, form, symbol_group, market_group in TITLE_FORMS:
        hit = title.rlike(form)
        found = F.get(_listed(F.regexp_extract(title, form, symbol_group)), 0)
        pattern, symbol, markets = pattern.when(hit, name), symbol.when(hit, found), markets.when(hit, _listed(F.regexp_extract(title, form, market_group)))
    out = announcements.withColumn("pattern", pattern).withColumn("symbol", symbol).withColumn("markets", markets).where("pattern is not null")
    return out.withColumn("is_krw", F.array_contains("markets", "KRW"))


def parse_listings_multi(announcements: DataFrame) -> DataFrame:
    """All symbols of a title, one row per symbol, with the title's markets; empty items and "..." of a list are no symbols."""
    t = F.col("title")
    multi, names, paren, out_, single, coins = (MULTI_FORMS[k] for k in ("coin_and_markets", "coin", "markets_in_parenthesis", "markets_outside", "coin_and_market", "coin_list"))
    every = lambda form, group: F.regexp_extract_all(t, F.lit(form), F.lit(group))
    same = lambda symbols, markets: F.transform(symbols, lambda s: F.struct(F.trim(s).alias("symbol"), _markets(markets).alias("markets")))
    listed = F.filter(F.split(F.regexp_extract(t, coins, 2), ","), lambda s: ~F.trim(s).isin("", "..."))
    found = (
        F.when(t.rlike(multi), F.zip_with(every(multi, 2), every(multi, 3), lambda s, m: F.struct(s.alias("symbol"), _markets(m).alias("markets"))))
        .when(t.rlike(names) & t.rlike(paren), same(every(names, 2), F.regexp_extract(t, paren, 1)))
        .when(t.rlike(names) & t.rlike(out_), same(every(names, 2), F.regexp_extract(t, out_, 1)))
        .when(t.rlike(single), same(every(single, 2), F.regexp_extract(t, single, 3)))
        .when(t.rlike(coins), same(listed, F.regexp_extract(t, coins, 1)))
    )
    return announcements.withColumn("found", F.explode(found)).select("*", "found.symbol", "found.markets").drop("found")


def listing_events(announcements: DataFrame, now_ms: int) -> DataFrame:
    """Due KRW listings as listing events; the trigger is the announced time."""
    rows = parse_listings(eligible_announcements(announcements, now_ms)).where("is_krw")
    return rows.select(
        F.col("id").cast("string").alias("event_id"), "title", "symbol", "markets", "announced_ms", F.lit(now_ms).cast("bigint").alias("detected_ms"), F.col("announced_ms").alias("trigger_ms"),
        F.concat(F.lit(NOTICE_URL), F.col("id").cast("string")).alias("notice_url"), "is_krw",
    )


def unprocessed(announcements: DataFrame, state: DataFrame, now_ms: int, *, ttl_ms: int = 86_400_000) -> DataFrame:
    """Announcements whose id was not processed within the time to live."""
    seen = state.where(F.col("processed_ms") > now_ms - ttl_ms).select("id")
    return announcements.join(seen, "id", "left_anti")


def detection_delay_stats(notices: DataFrame, *, key: str = "node", slow_ms: int = 300_000, very_slow_ms: int = 600_000, share: float = 0.7) -> DataFrame:
    """Delays over ``slow_ms`` per key: count, mean, largest, share of notices; what the share of very slow ones points to."""
    delay = F.col("detected_ms") - F.col("announced_ms")
    slow, very = delay > slow_ms, delay > very_slow_ms
    part = F.when(F.col("slow") > 0, F.col("very_slow") / F.when(F.col("slow") > 0, F.col("slow"))).otherwise(0.0)
    out = notices.groupBy(key).agg(
        F.count(F.lit(1)).alias("notices"), F.count_if(slow).alias("slow"), F.count_if(very).alias("very_slow"), F.round(F.avg(F.when(slow, delay)), 3).alias("avg_slow_ms"), F.max(F.when(slow, delay)).alias("max_slow_ms")
    )
    out = out.withColumn("slow_percent", F.round(F.col("slow") * 100.0 / F.col("notices"), 4))
    return out.withColumn("likely_cause", F.when(F.col("slow") == 0, "none").when(part > share, "systematic").otherwise("sporadic"))


#: Delays that the running mean takes in: what lies before them weighs less than 2**-80.
_RECENT = 80


def ewma_delay(notices: DataFrame, *, key: str = "node") -> DataFrame:
    """Running mean avg <- (avg + x) / 2 in order of processing, the first delay as seed, to four places.

    A delay that n newer ones follow weighs 2**-(n + 1), so the newest ``_RECENT`` of a key give the mean. They are
    found by a ranking that every task cuts before the shuffle, and no key gathers its log.
    """
    newest = Window.partitionBy(key).orderBy(F.desc("processed_ms"), F.desc("id"))
    delay = (F.col("detected_ms") - F.col("announced_ms")).cast("double")
    recent = notices.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= _RECENT)
    share = F.pow(F.lit(2.0), -F.col("nth"))
    mean = F.sum(delay * share) + F.max_by(delay * share, F.col("nth"))  # the oldest one is the seed and weighs twice
    counts = notices.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return recent.groupBy(key).agg(F.round(mean, 4).alias("ewma_ms")).join(counts, key)


def announced_ms(listed_at: Column) -> Column:
    return F.unix_millis(parse_notice_time(listed_at))
