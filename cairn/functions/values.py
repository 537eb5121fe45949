"""Fixed values of the memory engine: word lists, patterns, constants and defaults, as its results need them."""

# Patterns that are redacted, in this order.
PRIVATE_BLOCK = r"(?s)<private>.*?</private>"
SECRET_PATTERNS = (
    r"""(?i)(api[_-]?key|apikey)(?U)\s*(?-U)[:=](?U)\s*(?-U)['"]?[A-Za-z0-9\-_]{20,}""",
    r"(?i)bearer(?U)\s+(?-U)[A-Za-z0-9\-_.~+/]+=*",
    r"AKIA[0-9A-Z]{16}",
    r"-----BEGIN(?U)\s+(?:RSA\s+)?PRIVATE\s+KEY-----",
    r"""(?i)(password|passwd|secret|token)(?U)\s*[:=]\s*['"]?[^\s'"]{8,}""",
    r"(?i)(postgres|postgresql|mysql|mongodb|redis)://(?U)\S+",
)
REDACTED = "[REDACTED]"

# Words that decide the type of a memory; the first type that has one wins.
TYPE_SIGNALS = (
    ("decision", ("we chose", "we decided", "kita pilih", "memutuskan", "keputusan", "decided to", "opted for")),
    ("procedure", ("to deploy", "steps:", "langkah", "cara ", "run the following", "first ", "then ", "procedure")),
    ("solution", ("fixed by", "solved by", "solution", "bug ", "workaround", "resolved by", "diperbaiki")),
    ("preference", ("prefer", "lebih suka", "biasanya pakai", "i like", "favorite", "selalu pakai")),
    ("event", ("deployed", "released", "shipped", "launched", "on june", "on may", "pada tanggal", "rilis")),
)
DEFAULT_TYPE = "fact"

# Technology terms, in the order in which tags are listed.
TECH_TERMS = tuple(
    "jwt redis postgres postgresql mysql mongodb kubernetes k8s docker rust python typescript javascript go java auth oauth oauth2 grpc rest graphql kafka rabbitmq aws gcp azure nginx grafana prometheus argocd terraform".split()
)
MAX_ENTITIES, MAX_TAGS = 8, 5

# Compression.
ABBREVIATIONS = {
    "menggunakan": "pakai",
    "mengimplementasikan": "impl",
    "konfigurasi": "config",
    "configuration": "config",
    "database": "DB",
    "repository": "repo",
    "production": "prod",
    "development": "dev",
    "environment": "env",
    "authentication": "auth",
    "authorization": "authz",
    "application": "app",
    "deployment": "deploy",
    "infrastructure": "infra",
    "implementation": "impl",
    "documentation": "docs",
    "dependencies": "deps",
    "requirements": "reqs",
    "performance": "perf",
    "middleware": "mw",
}
FILLERS = ("actually", "basically", "essentially", "sebenernya", "sebenarnya", "pada dasarnya", "well", "really", "just", "quite", "rather")
ARTICLES = ("the", "a", "an", "yang")
PHRASES = (("in order to", "to"), ("due to the fact that", "because"), ("at this point in time", "now"), ("pada saat ini", "now"))
PROTECTED = r"(?sU)```.*?```|`[^`]*`|https?://\S+|[A-Za-z]:\\[^\s]+|(?:\./|/)?[\w.\-]+(?:/[\w.\-]+)+|\b[\w.\-]+\.(?:rs|toml|json|md|yaml|yml|ts|js|py|go|sql)\b"

# Conflict rules.
SUPERSEDE_SIGNALS = ("sekarang", "now", "migrasi", "migrate", "pindah ke", "ganti", "replace", "update", "ubah", "change to", "mulai pakai", "switched to", "moved to", "upgraded to", "no longer", "tidak lagi", "beralih")
NEGATION_PAIRS = (("pakai", "tidak pakai"), ("enable", "disable"), ("enabled", "disabled"), ("tambah", "hapus"), ("aktif", "nonaktif"), ("use", "don't use"), ("uses", "does not use"))
CLAIM_VERBS = (
    ("uses", ("pakai", "menggunakan", "memakai", "use", "using")),
    ("is", ("adalah", "yaitu", "is", "are")),
    ("deployed_on", ("deploy di", "hosted on", "runs on", "di-deploy di")),
)
DUPLICATE_ABOVE = 0.90
RULE_CONFIDENCE = {"duplicate": 0.95, "supersede": 0.80, "contradicts": 0.75, "competing": 0.70}

# Words without weight in the check of answers.
STOPWORDS = tuple(
    "the and for are but not you all any can has have was with this that from they will would there their what which when your our its it's is of to in on a an as at be by or we us".split()
)

# Enumerations.
MEMORY_TYPES = ("fact", "decision", "procedure", "solution", "preference", "event", "observation")
MEMORY_STATES = ("active", "disputed", "superseded", "archived", "pending")
SCOPES = ("personal", "team")
SOURCE_TYPES = ("manual", "hook", "import")
EDGE_TYPES = ("supersedes", "contradicts", "complements", "references", "similar_to", "derived_from")
RELATIONS = ("unrelated", "complementary", "duplicate", "supersede", "contradicts")
CONFLICT_STATES = ("pending", "resolved", "expired", "auto_resolved")
SUGGESTED_ACTIONS = ("store", "merge", "replace", "ask_user", "skip")
RESOLUTIONS = ("replace", "keep_both", "discard_new", "merge")
DETAILS = ("headline", "summary", "full")
INTENSITIES = ("lite", "full", "ultra")

# BM25, embedding and ranking.
K1, B = 1.2, 0.75
EMBEDDER, DIM = "hash-bow-v1", 256
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
RECENCY_DAYS, RECENCY_WEIGHT, IMPORTANCE_WEIGHT, CONFIDENCE_WEIGHT, ACCESS_WEIGHT = 180.0, 0.3, 0.2, 0.1, 0.01
LEAST_BUDGET, LEAST_SHARE, TOP_SUMMARIES = 8, 16, 3
LEAD_BIAS = 0.15
NEW_CONFIDENCE, NEW_IMPORTANCE = 0.8, 0.5
VECTOR_MAGIC = b"YBV1"
SCHEMA_VERSION = 1
