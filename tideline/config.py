"""Settings of the operators, all explicit; defaults are those of one-minute bars of an index future."""

from __future__ import annotations

from dataclasses import dataclass, field


# The defaults of all settings.
@dataclass(frozen=True)
class Settings:
    tick_size: float = 0.25
    tick_value: float = 0.5
    horizons: tuple[int, ...] = (5, 15, 30)  # in minutes
    whipsaw_minutes: int = 30
    whipsaw_first_minutes: int = 10
    whipsaw_initial_ticks: float = 20.0
    whipsaw_reversal_ticks: float = 15.0
    whipsaw_reversal_share: float = 0.65
    lookback_minutes: int = 60
    blackout_before: int = 15
    blackout_after: int = 15
    flat_ticks: float = 4.0
    min_direction_confidence: float = 0.58
    watch: float = 0.25
    soft: float = 0.55
    hard: float = 0.75
    hard_ttl: int = 3600
    soft_ttl: int = 1800
    watch_ttl: int = 900
    soft_action: str = "REDUCE_SIZE"
    hard_action: str = "BLOCK_NEW_ENTRIES"
    commission: float = 0.74
    slippage_ticks: float = 1.0
    latency_seconds: int = 2
    starting_balance: float = 50_000.0
    daily_loss: float = 1_000.0
    maximum_loss: float = 2_000.0
    trailing_drawdown: float = 1_500.0


@dataclass(frozen=True)
class Rules:
    """Keyword rules: topics in order, and the word lists that decide a sentiment."""

    topics: dict[str, list[str]]
    bullish: list[str]
    bearish: list[str]
    geopolitical: list[str]
    neutral: list[str]
    market_topics: list[str] = field(default_factory=list)
    relevant_topics: list[str] = field(default_factory=list)
    other: str = "other"


# The taxonomy's topics and word lists.
DEFAULT_RULES = Rules(
    topics={
        "trade_policy": ["trade", "tariff", "tariffs", "tarriff", "tarriffs", "deal", "import", "export"],
        "china_tariffs": ["china", "tariff", "tariffs", "beijing", "chinese", "ccp", "xi"],
        "fed_monetary": ["fed", "powell", "rates", "rate", "cut"],
        "inflation_rates": ["inflation", "cpi", "prices"],
        "iran_energy": ["iran", "oil", "oil prices", "energy", "crude", "opec", "hormuz"],
        "middle_east_geopolitics": ["middle east", "israel", "iran", "gaza", "hamas", "hezbollah"],
        "equities_direct": ["market", "nasdaq", "s&p", "s&p 500", "s&p500", "sp500", "spx", "stocks", "equities", "dow", "russell", "vix", "futures"],
        "fx_usd": ["dollar", "us dollar", "usd", "currency", "currencies", "forex", "fx"],
        "gold_metals": ["gold", "silver", "bullion", "precious metals"],
        "technology_ai_semiconductors": ["ai", "semiconductor", "chip", "technology", "tech"],
        "tax_fiscal_policy": ["tax", "spending", "deficit", "regulation"],
        "domestic_political": ["crowd", "america", "american"],
        "legal_personal": ["court", "judge", "legal"],
        "media_attack": ["media", "fake news"],
        "campaign_political": ["campaign", "poll", "election"],
    },
    bullish=["boom", "beautiful", "cut rates", "deal", "growth", "lower regulation", "support", "fly"],
    bearish=["tariffs are coming", "tariff", "tariffs", "tarriff", "tarriffs", "fire", "war", "sanction", "sanctions"],
    geopolitical=["iran", "middle east", "israel", "energy security", "fire"],
    neutral=["crowd", "thank you", "fake news", "media"],
    market_topics=["china_tariffs", "fed_monetary", "equities_direct", "technology_ai_semiconductors", "tax_fiscal_policy"],
    relevant_topics=["china_tariffs", "trade_policy", "fed_monetary", "iran_energy", "middle_east_geopolitics", "equities_direct", "fx_usd", "gold_metals", "technology_ai_semiconductors", "tax_fiscal_policy"],
)
# What labels and post types can be.
SENTIMENTS = ["bullish_market", "bearish_market", "geopolitical_risk", "neutral", "volatility_only", "low_confidence"]
TRADEABILITY = ["tradeable_directional", "volatility_only", "no_trade_whipsaw", "no_impact", "ambiguous"]
MARKET_RELEVANCE = ["market_relevant", "not_market_relevant", "uncertain"]
CONTRADICTION = ["none", "self_contradiction", "prior_contradiction", "policy_reversal", "uncertain"]
POST_TYPES = ["original", "reply", "retruth", "quote", "deleted", "edited", "unknown"]
