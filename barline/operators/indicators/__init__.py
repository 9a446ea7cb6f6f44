"""Indicators by name; many are computed side by side over one exchange and one sort."""

from barline.operators.indicators import frames, levels, scans, special  # noqa: F401 - fill the registry
from barline.operators.indicators.registry import INDICATORS, indicator, vote_rating, votes, with_indicators

__all__ = ["INDICATORS", "indicator", "vote_rating", "votes", "with_indicators"]
