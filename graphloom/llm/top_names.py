"""Which last labels of a plain domain are taken for top-level names of the Internet, by rule."""

from __future__ import annotations

#: Generic names in use (fixed values, not all that there are).
GENERIC = frozenset([
    "academy", "aero", "agency", "app", "art", "asia", "associates", "audio", "band", "bank", "bar", "berlin", "best", "beer", "bike", "bio", "biz", "blog", "boutique", "build",
    "business", "cafe", "camp", "capital", "care", "careers", "cash", "cat", "center", "chat", "church", "city", "clinic", "clothing", "cloud", "club", "coach", "coffee", "com", "community",
    "company", "consulting", "coop", "dance", "data", "date", "deals", "dental", "design", "dev", "digital", "direct", "dog", "earth", "eco", "edu", "education", "email", "energy", "engineering",
    "estate", "events", "example", "expert", "family", "farm", "fashion", "film", "finance", "fit", "foundation", "fun", "fund", "gallery", "games", "garden", "gmbh", "gov", "green", "group",
    "guide", "guru", "haus", "health", "help", "host", "house", "industries", "info", "ink", "institute", "insurance", "int", "international", "jobs", "koeln", "land", "law", "legal", "life",
    "link", "live", "london", "ltd", "market", "marketing", "media", "mil", "mobi", "money", "museum", "music", "name", "net", "network", "news", "ngo", "nrw", "nyc", "one",
    "online", "org", "page", "paris", "partners", "party", "photo", "photography", "photos", "place", "plus", "post", "press", "pro", "productions", "properties", "pub", "quest", "red", "rent",
    "report", "rest", "rocks", "run", "school", "science", "services", "shop", "site", "social", "software", "solar", "solutions", "space", "store", "studio", "support", "systems", "taxi", "team",
    "tech", "tel", "tips", "today", "tokyo", "tools", "top", "tours", "town", "travel", "university", "video", "vip", "wedding", "wien", "wiki", "wine", "work", "works", "world", "xyz", "yoga",
])
#: Two letters that end names of files rather than of hosts (fixed values).
FILES = frozenset(["cs", "go", "gz", "hs", "js", "kt", "py", "rb", "rs", "sh", "ts", "vb"])


def is_top_level(label: str) -> bool:
    """Two letters are a country, but for endings of source files; longer ones are as listed."""
    low = label.lower()
    return low in GENERIC or (len(low) == 2 and low.isascii() and low.isalpha() and low not in FILES)
