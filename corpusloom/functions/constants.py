"""Fixed values of the search and evidence rules: word lists, weights and thresholds."""

TERM = r"[A-Za-z0-9][A-Za-z0-9_+.#-]{1,}"
WORD = r"[a-z0-9][a-z0-9_+.#-]*"

# Words that the index leaves out.
STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "if", "then", "else", "for", "to", "of", "in", "on", "at", "by", "with",
    "from", "as", "is", "are", "was", "were", "be", "been", "being", "it", "this", "that", "these", "those", "you",
    "your", "we", "our", "they", "their", "he", "she", "i", "me", "my", "can", "could", "would", "should", "will",
    "may", "might", "do", "does", "did", "not", "no", "yes", "about", "into", "over", "under", "than", "too", "very",
]

# Words that don't count as query terms of the evidence rules.
QUERY_STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "do", "does", "every", "for", "from", "how", "i", "in",
    "is", "it", "of", "on", "or", "should", "the", "this", "to", "use", "what", "when", "where", "which", "why",
    "with", "always", "inside",
]

JUDGMENT_TERMS = [
    "should", "always", "better", "best", "when", "tradeoff", "tradeoffs", "appropriate", "worth", "prefer", "choose",
    "recommended",
]
TRADEOFF_TERMS = [
    "tradeoff", "tradeoffs", "cost", "costs", "overhead", "latency", "throughput", "limitation", "limitations",
    "downside", "downsides", "advantage", "advantages", "disadvantage", "disadvantages", "depends", "appropriate",
    "when", "if", "guarantee", "guarantees", "failure", "failures", "retry", "retries", "duplicate", "duplicates",
    "idempotent", "idempotency",
]
NEGATION_TERMS = [
    "not", "no", "never", "none", "cannot", "can't", "cant", "doesn't", "doesnt", "isn't", "isnt", "won't", "wont",
    "without", "avoid", "avoids", "unsupported", "deprecated", "disabled", "false", "incorrect",
]
CLAIM_STOPWORDS = QUERY_STOPWORDS + [
    "means", "mean", "using", "used", "also", "may", "might", "could", "would", "server", "system", "systems",
    "service", "services",
]

AUTHORITY = {
    "developer.mozilla.org": 1.0,
    "kubernetes.io": 1.0,
    "postgresql.org": 1.0,
    "redis.io": 1.0,
    "docs.docker.com": 1.0,
    "kafka.apache.org": 1.0,
    "opentelemetry.io": 1.0,
    "prometheus.io": 1.0,
    "cheatsheetseries.owasp.org": 0.98,
    "docs.python.org": 1.0,
    "fastapi.tiangolo.com": 0.98,
    "react.dev": 1.0,
    "docs.oracle.com": 1.0,
    "aws.amazon.com": 0.98,
    "sre.google": 0.98,
}
TRUSTED_AUTHORITY, OTHER_AUTHORITY = 0.85, 0.60

TOPICS = {
    "developer.mozilla.org": ["http", "https", "status", "header", "cookie", "cors", "csp", "html", "css", "javascript", "browser", "web", "fetch"],
    "kubernetes.io": ["kubernetes", "k8s", "pod", "deployment", "service", "container", "cluster", "probe", "scheduler"],
    "postgresql.org": ["postgres", "postgresql", "sql", "database", "transaction", "index", "replication", "query"],
    "redis.io": ["redis", "cache", "caching", "key", "ttl", "stream", "pubsub"],
    "docs.docker.com": ["docker", "container", "image", "compose", "dockerfile", "registry"],
    "kafka.apache.org": ["kafka", "stream", "streams", "event", "events", "producer", "consumer", "partition", "offset", "exactly-once", "processing"],
    "opentelemetry.io": ["opentelemetry", "otel", "trace", "tracing", "span", "metric", "metrics", "telemetry"],
    "prometheus.io": ["prometheus", "metric", "metrics", "alert", "alertmanager", "scrape", "monitoring"],
    "cheatsheetseries.owasp.org": ["owasp", "security", "authentication", "authorization", "xss", "csrf", "injection"],
    "docs.python.org": ["python", "asyncio", "typing", "exception", "iterator", "decorator"],
    "fastapi.tiangolo.com": ["fastapi", "pydantic", "api", "endpoint", "dependency", "async"],
    "react.dev": ["react", "component", "hook", "state", "jsx", "frontend"],
    "docs.oracle.com": ["java", "jvm", "thread", "class", "interface", "collection"],
    "aws.amazon.com": ["aws", "cloud", "availability", "scaling", "distributed", "latency", "reliability"],
    "sre.google": ["sre", "reliability", "distributed", "availability", "latency", "incident", "error", "budget"],
}

# What tells a definition, in a sentence; the second list applies beside the title.
DEFINES = r"\bmeans?\b|\brefers?\s+to\b|\bdefined\s+as\b|\bindicates?\s+(?:that\s+)?\b|\bdescribes?\b|\brepresents?\b|\bspecif(?:y|ies)\b|\ballows?\b|\blets?\b|\benables?\b|\breturns?\b|\bis\s+(?:an?|the|a\s+property|the\s+property|when|used\s+to)\b|\bare\s+(?:an?|the)\b|\boccurs?\s+when\b"
DEFINES_WITH_TITLE = r"\bmeans?\b|\brefers?\s+to\b|\bdefined\s+as\b|\bindicates?\b|\bdescribes?\b|\brepresents?\b|\bspecif(?:y|ies)\b|\ballows?\b|\blets?\b|\benables?\b|\breturns?\b|\bis\s+(?:an?|the|when|used\s+to)\b|\bare\s+(?:an?|the)\b|\boccurs?\s+when\b"

MIN_RELEVANCE, RELATIVE_FLOOR = 0.18, 0.58

# Ranking.
BM25_K1, BM25_B, RRF_K = 1.5, 0.75, 60
LSA_DIMENSIONS, LSA_FEATURES = 48, 1200
SNIPPET_CHARS, SNIPPET_LEAD = 260, 70

# Urls and page blocks.
SKIP_EXTENSIONS = [
    "7z", "avi", "css", "csv", "doc", "docx", "gif", "gz", "ico", "jpeg", "jpg", "js", "json", "map", "mov", "mp3",
    "mp4", "pdf", "png", "ppt", "pptx", "rar", "rss", "svg", "tar", "tgz", "txt", "webm", "webp", "woff", "woff2",
    "xls", "xlsx", "xml", "zip",
]
TRACKING_PARAMS = [
    "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source",
]
LOCALE_EXEMPT = [
    "en", "en-us", "docs", "api", "learn", "reference", "tutorial",
]
LOW_VALUE_SECTIONS = ["navigation", "table of contents", "feedback", "community", "training", "certifications"]
LOW_VALUE_MARKERS = ["theme auto light dark", "index modules | next | previous"]
CHUNK_CHARS, CHUNK_OVERLAP, CHUNK_MIN, CHUNK_CAP = 1800, 220, 120, 24
LINKS_PER_PAGE = 250

# Planner, retries and guards.
MIN_HEALTH, WARN_LOAD, CUTOFF_LOAD, EMERGENCY_LOAD, LATENCY_BUDGET_MS = 0.67, 0.65, 0.75, 0.85, 1000.0
RETRY_BASE, RETRY_CAP, RETRY_MAX = 0.5, 10.0, 5
CIRCUIT_FAILURES, CIRCUIT_SECONDS = 3, 15.0
BUCKET_CAPACITY, BUCKET_PER_MINUTE, BUCKET_CLIENTS = 30, 60, 20_000

# Most results that each endpoint may be asked for, from 1.
TOP_K = {"search": 25, "ask": 10, "shard_search": 100}

# Settings of the vector provider under which a service is asked, given a key.
NEURAL_SETTINGS = ("auto", "openai")
