"""Point-in-time market-data and factor research as Spark DataFrame jobs."""

from .functions.calendar import annual_schedule, market_calendar, period_end_dates
from .functions.quality import DataQualityError
from .functions.values import DIVIDEND_AFTER_TAX_RATIO, index_code, security_symbol
from .operators.cross_section import winsor_zscore
from .operators.intervals import expand_query_years, lookback_requests, missing_ranges, plan_minute_days
from .operators.intraday import daily_volatility, normalize_minute_bars, volatility_factor
from .plans.adjustment import back_adjusted_close
from .plans.features import quote_features
from .plans.groups import intraday_group_indices, traditional_group_indices
from .plans.index import annual_rebalanced_index, index_segments, intraday_monthly_index, monthly_index, monthly_index_with_selector
from .plans.performance import calc_metrics, performance_table, rebase_curves
from .plans.portfolio import portfolio_nav
from .plans.rules import IntradaySelectionRules, SelectionRules, TimingRules, UniverseRules
from .plans.selection import select_candidates, select_constituents, select_intraday_constituents
from .plans.timing import bp_spread, timing_backtest
from .plans.universe import build_universe, dividend_universe, history_counts
from .session import build_session
from .sources.csv_sink import save_output
from .sources.loading import load_dataset, standardize_price
from .streaming.intraday import stream_daily_volatility

__all__ = [name for name in dir() if not name.startswith("_")]
