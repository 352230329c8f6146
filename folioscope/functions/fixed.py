"""Fixed values.

Everything in this file is a constant that results depend on: word lists, suffixes, weights, patterns and limits.
They are kept together and stated plainly so that a change here is visibly a change of results.
"""

# Small words that carry no topic. Used by search, title vectors and headline signatures.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "can", "do", "does", "for", "from",
    "how", "i", "in", "into", "is", "it", "its", "my", "of", "on", "or", "our", "s", "so", "t",
    "that", "the", "their", "them", "then", "there", "these", "this", "to", "up", "use", "using",
    "vs", "was", "we", "what", "when", "which", "who", "why", "will", "with", "you", "your",
]

# Labels too broad to say much about a post.
GENERIC_LABELS = [
    "technology", "tech", "programming", "software-development", "software-engineering", "coding",
    "business", "science", "artificial-intelligence", "ai", "writing", "life", "self-improvement",
    "productivity", "startup", "data-science", "machine-learning", "news", "education", "learning",
]

# Suffixes the light stemmer may remove, in matching order.
SUFFIXES = [
    "ational", "izations", "ization", "iveness", "fulness", "ousness", "ations", "ation",
    "ements", "ement", "ments", "ment", "ences", "ence", "ances", "ance", "ingly", "edly",
    "ities", "ity", "ives", "ive", "izes", "ized", "izer", "ize", "ises", "ised", "ise",
    "ings", "ing", "ies", "ied", "ers", "est", "ful", "ness", "ous", "ally", "ly",
    "ions", "ion", "als", "er", "ed", "es", "s",
]
MIN_STEM = 3
KEEP_DOUBLE = ["ll", "ss", "zz", "ff"]

# Words skipped when a briefing compares headlines.
HEADLINE_STOPWORDS = [
    "the", "and", "for", "with", "from", "that", "this", "into", "over", "after", "news", "new",
    "how", "what", "its", "are", "has",
]

# Words skipped when a query is expanded into feed tags.
FEED_STOPWORDS = [
    "a", "an", "and", "the", "of", "for", "to", "in", "on", "with", "how", "what", "why", "is",
    "are", "vs", "or", "by",
]

# Function words whose presence makes a slug look English.
ENGLISH_WORDS = [
    "the", "a", "an", "to", "of", "and", "for", "in", "on", "how", "why", "what", "with", "your",
    "is", "you", "i", "my", "from", "guide", "using", "vs", "when", "this", "are", "it", "we",
    "can", "do", "not", "new", "best", "about", "into", "will", "should",
]

# Words that never count towards a key sentence.
SUMMARY_STOPWORDS = (
    "a an the and or but if of to in on for with at by from as is are was were be been being it its this that "
    "these those i you he she we they them his her our your their my me us not no so than then there here what "
    "which who whom how why when where can could will would should may might must do does did done have has had "
    "just also more most very into about over such only one two all any some each other out up down new like get "
    "use using used make way"
).split()

# Tags too broad to be classification phrases on their own.
BROAD_PHRASES = [
    "news", "research", "technology", "business", "science", "engineering",
    "energy", "strategy", "performance", "space", "cloud", "markets",
    "training", "agents", "inference", "theory", "tutorials",
]

# Search: retrieval column weights, bands and the ranking features.
TITLE_WEIGHT, AUTHOR_WEIGHT = 10.0, 2.0
BM25_K1, BM25_B, BM25_IDF_FLOOR = 1.2, 0.75, 1e-6
RERANK_WINDOW, MAX_CANDIDATES, AUTHOR_CAP = 400, 1200, 2
SEARCH_WEIGHTS = {
    "taste": 0.35, "lex": 1.00, "cover": 2.20, "exact": 0.50, "phrase": 0.90, "head": 0.25,
    "soft": 0.10, "author": 0.60, "fresh": 0.45, "prio": 0.30, "brevity": 0.15,
}
TASTE_SHOWN, STEM_CREDIT, IDEAL_TITLE, TITLE_SPREAD = 0.35, 0.85, 10, 16.0
SEARCH_HALF_LIFE, DEFAULT_PRIO = 240.0, 0.2

# Interest profile and recommendations.
ENGAGEMENT = {"notes": 3.0, "read": 1.5, "fetched": 1.0, "saved": 0.4, "auto": 0.0}
PROFILE_HALF_LIFE, PROFILE_WORDS, PROFILE_FLOOR = 150.0, 120, 0.35
GENERIC_DAMP, SEED_WEIGHT, COLD_START = 0.3, 0.5, 8
RECOMMEND_WEIGHTS = {
    "labels": 1.0, "words": 0.7, "author": 0.25, "quality": 0.35, "fresh": 0.30, "dislike": 0.8,
    "cached": 0.05, "rotation": 0.04,
}
SEEDS, SEED_PHRASES, SEED_ROWS, SEED_DAYS = 8, 4, 40, 120
INDEX_SHARE, MAX_PER_AUTHOR, EXPLORE_EVERY = 0.3, 2, 7

# Curation.
SUBTOPIC_MIN, TOPIC_TARGET, POOL_SIZE, SCAN_LIMIT, RECENT_DAYS = 12, 1120, 100, 4000, 14
CHANGES_PER_RUN, ROTATE_FACTOR = 6, 1.2
PRIORITY_TIERS = [0.7, 0.5, 0.0]
TREND_DEFAULT_AGE, TREND_OFFSET, TREND_POWER = 30, 3, 0.8

# Briefing.
FEED_ITEMS, CLUSTER_SIMILARITY = 40, 0.55
SHORTLIST, PICKS, CATEGORY_PENALTY, PUBLISHER_PENALTY, INTEREST_BOOST = 10, 5, 1.8, 1.4, 1.6

# Readable page extraction.
BLOCK_TAGS = ["p", "h1", "h2", "h3", "h4", "blockquote", "pre", "li"]
SKIP_TAGS = [
    "script", "style", "noscript", "nav", "header", "footer", "aside", "form",
    "figure", "figcaption", "button", "svg", "iframe", "template", "select", "label",
]
MAX_IMAGES, MIN_ARTICLE_CHARS = 12, 400

# Fixed patterns of a page's head: a property's content, before or after its name; %s is the property.
META_NAME_FIRST = r"""(?i)<meta[^>]+property=["']%s["'][^>]+content=["']([^"']+)["']"""
META_CONTENT_FIRST = r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+property=["']%s["']"""
# Address of a post's thumbnail; the image id follows.
THUMBNAIL = "https://miro.medium.com/v2/resize:fill:320:214/"

# Named zones of mail dates (RFC 2822, section 4.3).
MAIL_ZONES = {
    "UT": "+0000", "GMT": "+0000", "UTC": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}
