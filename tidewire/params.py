"""Defaults that results depend on. Every operator takes them as parameters."""

from __future__ import annotations

# --- fixed values: lists, patterns and limits that results must agree with ---

CATEGORIES = ("top_news", "model_tech", "funding", "policy", "research", "industry")
DEFAULT_CATEGORY = "industry"
QUOTA_CATEGORIES = ("model_tech", "funding", "policy", "research", "industry")

SECTIONS = (
    ("top_news", "今日头条"),
    ("model_tech", "模型发布与技术进展"),
    ("funding", "融资与资本动态"),
    ("policy", "政策与监管"),
    ("research", "学术与研究突破"),
    ("industry", "市场与产业动态"),
)

TRACKING_PREFIX = "utm_"
TRACKING_PARAMS = ("fbclid", "gclid", "ref", "ref_src", "referrer", "mc_cid", "mc_eid")

HIGH_DOMAINS = ("openai.com", "anthropic.com", "deepmind.google", "meta.ai", "nvidia.com", "arxiv.org")
HIGH_SUFFIXES = (".gov", ".gov.cn", ".gov.uk", ".gov.au", ".europa.eu")
MEDIUM_DOMAINS = (
    "reuters.com", "bloomberg.com", "ft.com", "wsj.com", "nature.com", "science.org", "technologyreview.com",
    "cac.gov.cn", "sec.gov", "ftchinese.com",
)
LOW_DOMAINS = (
    "techcrunch.com", "theverge.com", "wired.com", "arstechnica.com", "venturebeat.com", "zdnet.com", "engadget.com",
    "cnet.com", "36kr.com", "geekpark.net", "leiphone.com", "jiqizhixin.com", "syncedreview.com",
)

COMPANIES = (
    ("openai", "OpenAI"), ("anthropic", "Anthropic"), ("deepmind", "Google DeepMind"), ("google", "Google"),
    ("microsoft", "Microsoft"), ("meta", "Meta"), ("nvidia", "NVIDIA"), ("amazon", "Amazon"), ("apple", "Apple"),
    ("xai", "xAI"), ("mistral", "Mistral"), ("cohere", "Cohere"), ("perplexity", "Perplexity"),
    ("deepseek", "DeepSeek"), ("minimax", "MiniMax"), ("moonshot", "Moonshot AI"), ("zhipu", "Zhipu AI"),
    ("01.ai", "01.AI"), ("alibaba", "Alibaba"), ("tencent", "Tencent"), ("baidu", "Baidu"),
    ("bytedance", "ByteDance"), ("huawei", "Huawei"), ("cerebras", "Cerebras"), ("groq", "Groq"), ("tsmc", "TSMC"),
    ("samsung", "Samsung"), ("sk hynix", "SK Hynix"), ("amd", "AMD"), ("intel", "Intel"),
)

EVENT_RULES = (
    ("funding_round", ("funding", "raised", "series", "valuation", "融资", "估值", "亿美元")),
    ("acquisition", ("acquire", "acquisition", "收购", "并购")),
    ("model_release", ("launch", "release", "unveil", "introduce", "发布", "推出", "上线")),
    ("api_launch", ("api", "endpoint")),
    ("regulation_update", ("regulation", "policy", "law", "act", "监管", "政策", "法案")),
    ("chip_hardware", ("chip", "gpu", "asic", "芯片", "算力")),
    ("partnership", ("partner", "合作", "联盟")),
    ("research_breakthrough", ("research", "paper", "arxiv", "研究", "论文")),
    ("lawsuit_legal", ("lawsuit", "sue", "诉讼", "起诉")),
    ("market_data", ("revenue", "earnings", "收入", "财报")),
    ("model_release", ("agent", "智能体")),
)

OFFICIAL_KEYWORDS = ("openai.com", "anthropic.com", "nvidia.com", "gov", "gov.cn", "arxiv.org", "whitehouse")

CJK = "[一-鿿]"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

#: Dates in URLs (year, month, day), and in texts with the groups that hold year, month and day (0: the first day).
URL_DATES = (r"/(20\d{2})[-/](\d{1,2})[-/](\d{1,2})", r"/(20\d{2})(\d{2})(\d{2})(?:/|$)")
DAY_PATTERNS = (
    (r"(20\d{2})-(\d{1,2})-(\d{1,2})", (1, 2, 3)),
    (r"([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(20\d{2})", (3, 1, 2)),
    (r"(20\d{2})年(\d{1,2})月(\d{1,2})日", (1, 2, 3)),
)
MONTH_PATTERNS = (
    (r"(20\d{2})年(\d{1,2})月(?!\d)", (1, 2, 0)),
    (r"\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*)\s+(20\d{2})\b", (2, 1, 0)),
)
#: A result in a Markdown response (title, URL, body), and what separates the answers of a batch.
RESULT_PATTERN = r"(?s)###\s+\d+\.\s+(.+?)\n-\s+\*\*URL\*\*:\s+(\S+)\n-\s+(.*?)(?=\n###\s+\d+\.|\n##\s|$)"
RESULT_COUNT, QUERY_HEAD, FIRST_QUERY = r"\((\d+)\s+results", r"\n## Query \d+:\s+", "## Query 1:"

BACKFILL_QUERIES = {
    "funding": (
        "AI startup funding round this week",
        "AI company valuation 2026",
        "人工智能 融资 本周",
        "AI venture capital investment",
        "AI 并购 收购 最新",
    ),
    "industry": (
        "AI chip market update this week",
        "AI data center construction 2026",
        "AI 算力 产业动态 本周",
        "AI industry partnership announcement",
        "人工智能 应用落地 最新",
        "AI 机器人 产业 本周",
    ),
    "model_tech": (
        "new AI model release this week",
        "AI agent framework new",
        "大模型 发布 本周",
        "AI coding agent update",
    ),
    "policy": (
        "AI regulation policy update this week",
        "AI 监管 政策 本周",
        "EU AI Act latest",
        "China AI regulation new",
    ),
    "research": (
        "arXiv new AI paper this week",
        "AI research breakthrough 2026",
        "AI 论文 最新 本周",
        "NeurIPS ICML AI paper",
    ),
}
BACKFILL_MIN_ITEMS = 5
BACKFILL_MAX_RESULTS = 8
BACKFILL_DAYS = 7

MAX_RESULTS = 10
MAX_QUERY_CHARS = 500
SEARCH_BATCH = 5
DAILY_MAX_AGE_HOURS = 48
COLLECT_MAX_AGE_HOURS = 24
TITLE_THRESHOLD = 0.85
CLUSTER_THRESHOLD = 0.6
COMPANY_RELAXATION, COMPANY_FLOOR = 0.15, 0.35
HISTORY_DAYS, HISTORY_THRESHOLD = 3, 0.7
MIN_ARTICLES = 5
MAX_EVENTS = 18
TOP_SCORE, TOP_FALLBACK_SCORE, TOP_ITEMS, TOP_MIN_ITEMS = 80, 70, 7, 3
SECTION_ITEMS = 8
MAX_SOURCES = 5
RECHECK_SCORE = 85
DATE_WINDOW_DAYS, DATE_AHEAD_DAYS, STALE_MONTH_DAYS = 400, 1, 35
FULLTEXT_ARTICLES, FULLTEXT_CHARS = 2, 3000
CONTEXT_ARTICLES, CONTEXT_SNIPPET_CHARS = 6, 400
SUMMARY_TITLES, SUMMARY_CHARS = 5, 300
REPORT_TIMEZONE = "Asia/Shanghai"
