"""Engine parameters (the reference's option defaults and clamps)."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

# Fixed values that must equal the reference's for equal results.
# Option defaults: analyses per hour 10 (allowed 1..100), AI analyses per hour 5,
# rate window 3600 s,
# redirect hops 0..5 (six requests), listing page size 50, top domains 10.
MAX_ANALYSES_PER_HOUR = 10
MAX_ANALYSES_MIN, MAX_ANALYSES_MAX = 1, 100
AI_MAX_PER_HOUR = 5
RATE_WINDOW_SECONDS = 3600
MAX_REQUESTS = 6
STATS_PER_PAGE = 50
TOP_DOMAINS = 10

# Score weights of the overall score, in the reference's addition order.
WEIGHTS = (
    ("seo", 0.25),
    ("security", 0.20),
    ("performance", 0.20),
    ("mobile", 0.15),
    ("technical", 0.12),
    ("accessibility", 0.08),
)


def clamp_rate_limit(n: int) -> int:
    return max(MAX_ANALYSES_MIN, min(MAX_ANALYSES_MAX, int(n)))


@dataclass(frozen=True)
class Params:
    """Run parameters; ``as_of`` replaces the reference's NOW()/CURDATE()."""

    as_of: datetime = datetime(2024, 1, 30, 12, 0, 0)
    period: str = "week"
    page: int = 1
    per_page: int = STATS_PER_PAGE
    top_n: int = TOP_DOMAINS
    max_per_hour: int = MAX_ANALYSES_PER_HOUR
    ai_max_per_hour: int = AI_MAX_PER_HOUR
    weights: tuple = field(default=WEIGHTS)
