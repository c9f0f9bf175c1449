"""Tables of words and numbers that fix the meaning of the operators.  All are fixed values, in natural order."""

from __future__ import annotations

# --- sources of evidence: fixed values ---
SOURCE_WEIGHTS = {
    "peer_reviewed": 1.0,
    "financial_filing": 0.95,
    "benchmark": 0.8,
    "news_article": 0.7,
    "technical_blog": 0.6,
    "case_study": 0.4,
    "marketing": 0.2,
    "unknown": 0.5,
}
DEFAULT_SOURCE_WEIGHT = 0.5
VERIFIABLE = ("peer_reviewed", "benchmark", "independent_reporting", "open_dataset", "news_article", "financial_filing")

#: Rules of the source cascade, in order: what they look at (domain, url, text), the words, and the class.
SOURCE_RULES = (
    ("domain", ("sec.gov",), "financial_filing"),
    ("domain", ("reuters.com", "bloomberg.com", "wsj.com", "nytimes.com", "cnbc.com", "ft.com", "forbes.com", "yahoo.com"), "news_article"),
    ("domain", ("arxiv.org", "nature.com", "science.org", "ieee.org", "acm.org", "springer.com", "sciencedirect.com"), "peer_reviewed"),
    ("domain", ("paperswithcode.com", "huggingface.co", "kaggle.com"), "benchmark"),
    ("domain", ("medium.com", "towardsdatascience.com", "substack.com"), "technical_blog"),
    ("url", ("10-k", "10q", "10-q", "sec.gov", "edgar"), "financial_filing"),
    ("url", ("news", "article"), "news_article"),
    ("url", ("arxiv.org/abs", "pdf", "paper"), "peer_reviewed"),
    ("url", ("benchmark", "leaderboard", "dataset"), "benchmark"),
    ("url", ("blog", "post"), "technical_blog"),
    ("url", ("case-study", "customer"), "case_study"),
    ("text", ("10-k", "10q", "10-q", "8-k", "sec filing", "earnings report", "annual report", "quarterly report", "edgar", "form 10"), "financial_filing"),
    ("text", ("reported", "according to", "news", "press", "coverage"), "news_article"),
    ("text", ("benchmark", "evaluation", "leaderboard", "dataset"), "benchmark"),
    ("text", ("case study", "customer story", "use case"), "case_study"),
    ("text", ("introducing", "announcement", "launch", "product"), "marketing"),
    ("domain", ("openai.com", "google.com", "microsoft.com", "anthropic.com"), "marketing"),
)

# --- claims and contradiction: fixed values ---
HEDGES = ("may", "might", "could", "can", "suggests", "appears", "likely", "potentially", "approximately", "generally", "often")
NEGATIONS = (
    "not", "no", "never", "none", "nothing", "nowhere", "neither", "nor", "cannot", "can't", "won't", "shouldn't",
    "wouldn't", "couldn't", "doesn't", "don't", "didn't", "isn't", "aren't", "wasn't", "weren't", "without", "lack", "lacks",
    "lacking", "lacked", "fails", "failed", "failing", "fail", "absence", "missing",
)
VAGUE_WORDS = ("impact", "effect", "change", "trend", "growth")
NOISE_TEXTS = ("stock quotes, and market data", "stock quotes and market data")
#: A word and its opposites.
OPPOSITES = {
    "increase": ("decrease",),
    "decrease": ("increase", "rise", "grow"),
    "rise": ("fall", "drop", "decline"),
    "fall": ("rise", "increase", "grow"),
    "grow": ("shrink", "decline", "contract"),
    "shrink": ("grow", "expand"),
    "improve": ("worsen", "decline", "deteriorate"),
    "worsen": ("improve", "enhance"),
    "better": ("worse",),
    "worse": ("better",),
    "efficient": ("inefficient",),
    "inefficient": ("efficient",),
    "more": ("less", "fewer"),
    "less": ("more",),
    "greater": ("smaller", "lesser"),
    "smaller": ("larger", "greater"),
    "large": ("small",),
    "small": ("large",),
    "high": ("low",),
    "low": ("high",),
    "maximum": ("minimum",),
    "minimum": ("maximum",),
    "fast": ("slow",),
    "faster": ("slower",),
    "slow": ("fast",),
    "early": ("late",),
    "late": ("early",),
    "before": ("after",),
    "after": ("before",),
    "positive": ("negative",),
    "negative": ("positive",),
    "good": ("bad",),
    "bad": ("good",),
    "beneficial": ("harmful",),
    "harmful": ("beneficial",),
    "present": ("absent", "missing"),
    "absent": ("present",),
    "available": ("unavailable",),
    "unavailable": ("available",),
    "exist": ("disappear",),
    "missing": ("present",),
    "true": ("false",),
    "false": ("true",),
    "correct": ("incorrect", "wrong"),
    "incorrect": ("correct",),
    "certain": ("uncertain",),
    "uncertain": ("certain",),
    "likely": ("unlikely",),
    "unlikely": ("likely",),
    "include": ("exclude",),
    "exclude": ("include",),
    "all": ("none",),
    "none": ("all",),
    "always": ("never",),
    "never": ("always",),
    "enable": ("disable",),
    "disable": ("enable",),
    "allow": ("prevent", "block", "deny"),
    "prevent": ("allow", "enable"),
    "block": ("allow", "permit"),
    "success": ("failure",),
    "failure": ("success",),
    "win": ("lose",),
    "lose": ("win",),
    "achieve": ("fail",),
    "fail": ("succeed",),
    "profit": ("loss",),
    "loss": ("profit",),
    "revenue": ("loss",),
    "gain": ("loss",),
    "growth": ("decline",),
    "expansion": ("contraction",),
    "contraction": ("expansion",),
    "strong": ("weak",),
    "weak": ("strong",),
    "significant": ("insignificant",),
    "insignificant": ("significant",),
    "visible": ("invisible", "hidden"),
    "hidden": ("visible",),
    "active": ("inactive",),
    "inactive": ("active",),
    "open": ("closed",),
    "closed": ("open",),
    "consistent": ("inconsistent",),
    "inconsistent": ("consistent",),
    "agree": ("disagree",),
    "disagree": ("agree",),
    "support": ("oppose",),
    "oppose": ("support",),
    "safe": ("unsafe", "dangerous"),
    "unsafe": ("safe",),
    "secure": ("insecure",),
    "insecure": ("secure",),
    "often": ("rarely",),
    "rarely": ("often",),
    "frequent": ("infrequent",),
    "infrequent": ("frequent",),
}
ANTONYMS = [(word, other) for word, others in OPPOSITES.items() for other in others]

# --- filings and facts: fixed values ---
TECH_SIC_RANGES = ((3570, 3579), (3660, 3669), (3670, 3679), (7370, 7379))
MANUAL_TICKERS = ("AAPL", "MSFT", "NVDA", "AMZN", "GOOGL", "GOOG", "META", "NFLX", "TSLA", "ORCL", "ADBE", "CRM", "INTC", "CSCO", "AVGO", "AMD", "QCOM", "TXN")
CONCEPTS = ("Revenues", "NetIncomeLoss", "OperatingIncomeLoss", "ResearchAndDevelopmentExpense", "Assets", "CashAndCashEquivalentsAtCarryingValue", "NetCashProvidedByUsedInOperatingActivities", "CapitalExpenditures")
NEGATIVE_CUES = ("decrease", "decline", "down", "lower", "pressure", "headwind", "soft", "weak", "challenging", "unfavorable", "adverse", "constraint", "shortage")
POSITIVE_CUES = ("increase", "grow", "up", "higher", "strong", "improve", "favorable", "benefit", "tailwind", "expand", "expansion", "accelerate", "record")
PRICING_PATTERNS = (r"\bpricing\b", r"\bprice(s)?\b", r"\baverage\s+selling\s+price(s)?\b|\bASP(s)?\b", r"\bdiscount(s|ing)?\b", r"\bpromot(ion|ional)\b", r"\bprice\s+pressure\b|\bcompetitive\s+pricing\b")
STRATEGY_PATTERNS = (
    r"\binvest(ing|ment)\b.*\b(ai|artificial intelligence|cloud|data center|platform)\b",
    r"\bfocus(ed)?\b.*\b(ai|artificial intelligence|cloud|data center|platform)\b",
    r"\bstrategic\b.*\binitiative(s)?\b",
    r"\btransformation\b|\bpivot\b|\broadmap\b",
    r"\bcapabilit(y|ies)\b.*\b(ai|cloud)\b",
)
SECTION_STARTS = {
    "10-K": (r"\bitem\s*7\.\s*management[’']?s\s+discussion\s+and\s+analysis\b", r"\bitem\s*7\.\s*management\s+discussion\s+and\s+analysis\b"),
    "10-Q": (r"\bitem\s*2\.\s*management[’']?s\s+discussion\s+and\s+analysis\b", r"\bitem\s*2\.\s*management\s+discussion\s+and\s+analysis\b"),
}
SECTION_ENDS = {
    "10-K": (r"\bitem\s*7a\.\b", r"\bitem\s*8\.\s*financial\s+statements\b", r"\bitem\s*8\.\b"),
    "10-Q": (r"\bitem\s*3\.\s*quantitative\b", r"\bitem\s*3\.\b"),
}
LEGAL_SUFFIXES = ("inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "plc", "ag", "nv", "sa", "group", "holdings", "holding")

# --- news pages: fixed values ---
BLOCKED_MARKERS = (
    "please enable js and disable any ad blocker",
    "enable javascript",
    "are you a robot",
    "access denied",
    "reuters.com ===============",
    "we're sorry, but the content you're looking for is no longer available",
    "engage with, participate in, and build your own modern markets",
)
ARTICLE_SELECTORS = {
    "cnbc.com": ("div.ArticleBody-articleBody", "[data-module='ArticleBody']"),
    "reuters.com": ("div.article-body__content", "div[data-testid='paragraph']"),
    "finance.yahoo.com": ("div.caas-body", "article div.caas-body", "article [data-testid='article-content-wrapper']"),
    "nasdaq.com": ("article", "[class*='article-body']", "[class*='article__content']"),
    "cnn.com": ("article", ".article__content", ".article-body", "[data-editable='content']"),
}
FALLBACK_SELECTORS = ("article", "main", "body")

# --- metric names: fixed values ---
JUDGED = ("ESS", "ECS", "CMS", "LCS", "HLS")
EVIDENCE_METRICS = ("ESS", "ECS", "EAS", "ERS", "ESTS", "EAGS", "SDS", "EVS")
CLAIM_METRICS = ("CMS", "HLS", "LCS", "CScope")
EPS = 1e-6
