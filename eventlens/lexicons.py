"""Fixed values shared with the reference behaviour.

Everything in this module is a fixed value (enum members, keyword lists,
lookup tables, thresholds). They must equal the reference's values for the
results to agree, so they are written out plainly in their natural order.
"""
from __future__ import annotations

# ---------------------------------------------------------------------------
# enums
# ---------------------------------------------------------------------------
EVENT_TYPES = ["conflict", "sanction", "trade_policy", "economic_data",
               "energy_disruption", "election", "regulation"]
IMPACT_DIRECTIONS = ["positive", "negative", "neutral"]
EVENT_STATUSES = ["auto_approved", "pending_review", "rejected", "human_approved"]
PUBLISHED_STATUSES = ["auto_approved", "human_approved"]
ASSET_TYPES = ["stock", "etf", "commodity", "crypto", "forex", "index"]
HORIZONS = ["1h", "6h", "24h", "7d", "30d"]
PRED_DIRECTIONS = ["up", "down", "neutral"]
PRED_OUTCOMES = ["correct", "wrong", "partial", "pending"]

# Horizon -> seconds (1h, 6h, 24h, 7d, 30d)
HORIZON_SECONDS = {"1h": 3600, "6h": 6 * 3600, "24h": 24 * 3600,
                   "7d": 7 * 86400, "30d": 30 * 86400}

# ---------------------------------------------------------------------------
# News category keywords (8 groups, in order; ties go to the
# earlier group)
# ---------------------------------------------------------------------------
NEWS_CATEGORY_KEYWORDS = [
    ("conflict", ["attack", "conflict", "war", "missile", "military", "offensive",
                  "invasion", "clash"]),
    ("sanction", ["sanction", "embargo", "blacklist", "restricted entity"]),
    ("trade_policy", ["tariff", "trade policy", "export control", "trade restriction",
                      "import ban"]),
    ("economic_data", ["inflation", "cpi", "gdp", "jobs report", "interest rate",
                       "unemployment", "retail sales", "central bank"]),
    ("energy_disruption", ["oil supply", "gas supply", "pipeline", "refinery", "opec",
                           "power outage", "lng", "crude"]),
    ("election", ["election", "vote", "ballot", "polls", "presidential race",
                  "parliament"]),
    ("regulation", ["regulation", "regulatory", "antitrust", "compliance",
                    "policy change", "ban approved", "lawmakers"]),
    ("markets", ["stock", "shares", "earnings", "market", "investor", "bond", "yield",
                 "forecast", "chip", "semiconductor", "technology"]),
]

# Country -> (latitude, longitude) for the heatmap
COUNTRY_COORDS = [
    ("United States", 37.0902, -95.7129),
    ("China", 35.8617, 104.1954),
    ("India", 20.5937, 78.9629),
    ("Russia", 61.5240, 105.3188),
    ("Ukraine", 48.3794, 31.1656),
    ("United Kingdom", 55.3781, -3.4360),
    ("Japan", 36.2048, 138.2529),
    ("South Korea", 35.9078, 127.7669),
    ("North Korea", 40.3399, 127.5101),
    ("Germany", 51.1657, 10.4515),
    ("France", 46.2276, 2.2137),
    ("Saudi Arabia", 23.8859, 45.0792),
    ("Israel", 31.0461, 34.8516),
    ("Iran", 32.4279, 53.6880),
    ("Taiwan", 23.6978, 120.9605),
    ("Brazil", -14.2350, -51.9253),
    ("Canada", 56.1304, -106.3468),
    ("Mexico", 23.6345, -102.5528),
    ("Australia", -25.2744, 133.7751),
    ("South Africa", -30.5595, 22.9375),
    ("United Arab Emirates", 23.4241, 53.8478),
    ("Qatar", 25.3548, 51.1839),
    ("Lebanon", 33.8547, 35.8623),
    ("Chad", 15.4542, 18.7322),
    ("Sudan", 12.8628, 30.2176),
    ("Morocco", 31.7917, -7.0926),
    ("Senegal", 14.4974, -14.4524),
    ("Hungary", 47.1625, 19.5033),
    ("European Union", 50.8503, 4.3517),
]

# News-text country aliases (alias, canonical), in order
NEWS_COUNTRY_ALIASES = [
    ("united states", "United States"), ("u.s.", "United States"),
    ("us", "United States"), ("america", "United States"),
    ("china", "China"), ("india", "India"), ("russia", "Russia"),
    ("ukraine", "Ukraine"), ("united kingdom", "United Kingdom"),
    ("britain", "United Kingdom"), ("uk", "United Kingdom"), ("japan", "Japan"),
    ("south korea", "South Korea"), ("north korea", "North Korea"),
    ("germany", "Germany"), ("france", "France"), ("saudi arabia", "Saudi Arabia"),
    ("israel", "Israel"), ("iran", "Iran"), ("taiwan", "Taiwan"),
    ("brazil", "Brazil"), ("canada", "Canada"), ("mexico", "Mexico"),
    ("australia", "Australia"), ("south africa", "South Africa"),
    ("uae", "United Arab Emirates"), ("united arab emirates", "United Arab Emirates"),
    ("qatar", "Qatar"), ("lebanon", "Lebanon"), ("chad", "Chad"), ("sudan", "Sudan"),
    ("morocco", "Morocco"), ("senegal", "Senegal"), ("hungary", "Hungary"),
    ("european union", "European Union"), ("eu", "European Union"),
]
NEWS_SHORT_ALIASES = ["us", "uk", "uae", "eu"]

# Base severity per news category
NEWS_CATEGORY_SEVERITY = {
    "conflict": 4.6, "sanction": 3.8, "trade_policy": 3.2, "energy_disruption": 4.1,
    "economic_data": 2.4, "election": 2.7, "regulation": 2.8, "markets": 2.0,
    "general": 2.3,
}
# News severity intensity term groups and lifts
NEWS_SEVERITY_TERMS = [
    (["war", "missile", "airstrike", "attack", "bombardment", "killed", "kills"], 0.7),
    (["sanction", "embargo", "tariff", "export control"], 0.35),
    (["refinery", "gas facility", "lng", "pipeline", "oil"], 0.3),
]

# ---------------------------------------------------------------------------
# Article NLP heuristics
# ---------------------------------------------------------------------------
# Relevance keyword groups with their weight (cap = weight, step = weight / 2)
RELEVANCE_GROUPS = [
    (0.18, ["geopolitics", "geopolitical", "sanction", "embargo", "tariff", "trade restriction",
            "export control", "military", "conflict", "war", "missile", "election", "ballot",
            "policy", "regulation", "antitrust"]),
    (0.14, ["inflation", "cpi", "gdp", "interest rate", "rate cut", "rate hike", "central bank",
            "unemployment", "retail sales", "manufacturing", "pmi", "treasury", "yield"]),
    (0.12, ["oil", "crude", "gas", "lng", "pipeline", "refinery", "opec", "power outage",
            "energy disruption", "shipping route", "strait of hormuz"]),
    (0.08, ["market", "stocks", "shares", "equity", "investor", "earnings", "guidance",
            "volatility", "sector", "semiconductor", "chip", "currency", "forex", "commodity"]),
]
IRRELEVANT_TERMS = ["sports", "football", "soccer", "cricket", "nba", "nfl", "movie", "box office",
                    "celebrity", "fashion", "lifestyle", "recipe", "travel tips", "horoscope",
                    "weather forecast"]
TRUSTED_SOURCE_TOKENS = ["reuters", "ap", "associated press", "bloomberg", "wsj", "ft"]
ENGLISH_STOPWORDS = ["the", "and", "for", "with", "from", "that", "this", "will", "have",
                     "after", "into", "about"]
SENTIMENT_POSITIVE = ["approval", "approved", "growth", "deal", "agreement", "stimulus", "eases"]
SENTIMENT_NEGATIVE = ["ban", "sanction", "attack", "war", "tariff", "shortage", "outage", "strike"]
RELEVANCE_THRESHOLD = 0.58
ALLOWED_LANGUAGES = ["en"]
MIN_LANGUAGE_CONFIDENCE = 0.80

# ---------------------------------------------------------------------------
# Event extraction heuristics
# ---------------------------------------------------------------------------
AUTO_APPROVE_THRESHOLD = 0.72
HUMAN_REVIEW_THRESHOLD = 0.55
SOURCE_CREDIBILITY = [("reuters", 0.95), ("associated press", 0.93), ("ap news", 0.90),
                      ("al jazeera", 0.84), ("newsapi", 0.70), ("gdelt", 0.75)]
EVENT_KEYWORDS = [
    ("conflict", ["attack", "conflict", "war", "missile", "military", "offensive", "invasion",
                  "clash"]),
    ("sanction", ["sanction", "blacklist", "embargo", "restricted entity"]),
    ("trade_policy", ["tariff", "export control", "trade restriction", "trade policy",
                      "import ban"]),
    ("economic_data", ["inflation", "cpi", "gdp", "jobs report", "interest rate",
                       "unemployment", "retail sales"]),
    ("energy_disruption", ["oil supply", "gas supply", "pipeline", "refinery", "opec",
                           "energy disruption", "power outage"]),
    ("election", ["election", "vote", "ballot", "polls", "presidential race"]),
    ("regulation", ["regulation", "regulatory", "antitrust", "compliance", "ban approved",
                    "policy change"]),
]
EVENT_COUNTRY_ALIASES = [
    ("united states", "United States"), ("u.s.", "United States"), ("us", "United States"),
    ("china", "China"), ("india", "India"), ("russia", "Russia"), ("ukraine", "Ukraine"),
    ("united kingdom", "United Kingdom"), ("uk", "United Kingdom"), ("israel", "Israel"),
    ("iran", "Iran"), ("taiwan", "Taiwan"), ("japan", "Japan"), ("south korea", "South Korea"),
    ("north korea", "North Korea"), ("saudi arabia", "Saudi Arabia"),
    ("uae", "United Arab Emirates"), ("germany", "Germany"), ("france", "France"),
]
EVENT_SHORT_ALIASES = ["us", "uk", "uae"]
HIGH_IMPACT_TERMS = ["escalation", "emergency", "nationwide", "record", "surge", "collapsed",
                     "default", "shutdown", "strike", "retaliation", "explosion", "attack",
                     "sanctioned", "ban"]
POSITIVE_IMPACT_TERMS = ["approval", "approved", "deal", "agreement", "growth", "expands",
                         "eases", "cuts rates", "stimulus"]
NEGATIVE_IMPACT_TERMS = ["ban", "sanction", "tariff", "export control", "shortage", "strike",
                         "attack", "invasion", "restriction", "outage"]
SIMILARITY_STOPWORDS = ["the", "and", "for", "with", "that", "this", "from", "have", "will",
                        "are", "has", "was", "were", "its", "their", "into", "over", "under",
                        "after", "before", "about", "amid", "near", "onto", "than", "also",
                        "more", "most", "just", "news"]
MARKET_CONTEXT_TERMS = ["stock", "shares", "equity", "bond", "yield", "futures", "market",
                        "investor", "earnings", "guidance", "volatility", "index"]
SEVERITY_TYPE_BIAS = {"conflict": 4, "sanction": 4, "energy_disruption": 4, "trade_policy": 3,
                      "economic_data": 3, "election": 3, "regulation": 2}
NEGATIVE_TYPES = ["conflict", "sanction", "energy_disruption"]
SIGNED_TYPES = ["regulation", "economic_data", "trade_policy"]

# HTML entities that the test pages hold (the strip knows all of HTML5)
HTML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"),
                 ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"),
                 ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"),
                 ("&hellip;", "…"), ("&lsquo;", "‘"), ("&rsquo;", "’"),
                 ("&ldquo;", "“"), ("&rdquo;", "”"), ("&amp;", "&")]

# ---------------------------------------------------------------------------
# Asset aliases and entity tags
# ---------------------------------------------------------------------------
ASSET_SUFFIX_TOKENS = ["inc", "incorporated", "corp", "corporation", "company", "co", "ltd",
                       "limited", "plc", "sa", "ag", "nv", "holdings", "holding", "group", "trust",
                       "series", "adr", "class"]
GENERIC_SINGLE_TOKEN_ALIASES = ["global", "technology", "energy", "holdings", "capital",
                                "resources", "materials", "financial", "industrial"]
TAG_COUNTRY_TERMS = [
    ("United States", ["united states", "u.s.", "us"]), ("China", ["china"]),
    ("India", ["india"]), ("Russia", ["russia"]), ("Ukraine", ["ukraine"]),
    ("United Kingdom", ["united kingdom", "uk"]), ("Israel", ["israel"]), ("Iran", ["iran"]),
    ("Taiwan", ["taiwan"]), ("Japan", ["japan"]), ("South Korea", ["south korea"]),
    ("Saudi Arabia", ["saudi arabia"]),
]
TOPIC_TAGS = [
    ("inflation", ["inflation", "cpi", "prices rose"]),
    ("rates", ["interest rate", "rate cut", "rate hike", "fed", "ecb", "central bank"]),
    ("semiconductors", ["semiconductor", "chip", "foundry"]),
    ("energy", ["oil", "gas", "lng", "refinery", "pipeline", "opec"]),
    ("trade", ["tariff", "trade policy", "export control", "import ban"]),
    ("sanctions", ["sanction", "embargo", "blacklist"]),
    ("elections", ["election", "ballot", "vote", "polls"]),
    ("defense", ["missile", "military", "defense", "drone", "airstrike"]),
]
MAX_TAGS = 12

# Knowledge-graph spread (layer 2), sector spread (layer 3),
# similarity spread (layer 4) and quality gates
KG_RELATIONSHIPS = ["SUPPLIES_TO", "PART_OF", "COMPETES_WITH", "CORRELATED", "REGULATES"]
KG_BIDIRECTIONAL = ["SUPPLIES_TO", "COMPETES_WITH", "CORRELATED", "REGULATES"]
KG_REVERSE_FACTOR = 0.9
KG_DEFAULT_STRENGTH = 0.5
L2_HOP1_WEIGHT = 0.60
L2_HOP2_WEIGHT = 0.35
L3_MAX_ASSETS_PER_SECTOR = 6
L3_BASE_WEIGHT = 0.45
L4_LOOKBACK_EVENTS = 300
L4_MIN_SIMILARITY = 0.38
L4_MAX_ASSET_CANDIDATES = 5
L4_DEFAULT_PRIOR = 0.5
QUALITY_MIN_CONFIDENCE = 0.55
QUALITY_TEMPORAL_MAX_HOURS = 48
KG_SEED_STRENGTH = 0.9
KG_PROFILE_SECTOR_STRENGTH = 0.78
KG_PROFILE_COUNTRY_STRENGTH = 0.86
FILING_WINDOW = 180
SUPPLIER_TERMS = ["supplier", "suppliers", "supply chain", "sourced from", "procured from"]
CUSTOMER_TERMS = ["customer", "customers", "revenue from", "sales to", "major customer"]
# Global macro entity patterns added to the gazetteer
GAZETTEER_EXTRA = ["Federal Reserve", "European Central Bank", "OPEC", "NATO", "US", "China",
                   "India", "Russia"]
