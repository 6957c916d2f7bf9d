"""Named analyzers and decoders: what a job runs is chosen by name and can be extended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tapewright.operators.pumps import detect_pumps, market_results, pump_windows
from tapewright.sources.venues import DECODERS, Decoder

Analyzer = Callable[[DataFrame], DataFrame]
ANALYZERS: dict[str, Analyzer] = {"pumps": detect_pumps, "windows": pump_windows, "markets": market_results}


def register_analyzer(name: str, analyzer: Analyzer) -> None:
    ANALYZERS[name] = analyzer


def register_decoder(venue: str, decoder: Decoder) -> None:
    DECODERS[venue] = decoder


def analyze(trades: DataFrame, name: str, **options) -> DataFrame:
    return trades.transform(ANALYZERS[name], **options)
