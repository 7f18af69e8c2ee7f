"""Fixed values that results depend on: word lists, mappings and patterns."""

from __future__ import annotations

# Words that carry no meaning in a question.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can", "not", "no", "nor", "so",
    "yet", "both", "either", "neither", "as", "if", "then", "than", "that", "this", "these", "those", "it", "its", "i", "we", "you", "he", "she",
    "they", "me", "us", "him", "her", "them", "my", "our", "your", "his", "their", "what", "which", "who", "whom", "when", "where", "why", "how",
    "all", "any", "each", "few", "more", "most", "other", "some", "such", "up", "out", "about", "into", "through", "after", "before", "between",
    "tell", "find", "explain", "describe", "relationship", "related", "knowledge", "graph", "article", "articles",
)

# Canonical relations, and the relation that each other spelling stands for.
CANONICAL_RELATIONS = (
    "founded", "invented", "discovered", "developed", "created", "led", "directed", "authored", "influenced", "inspired", "part_of", "uses",
    "requires", "caused", "resulted_in", "fought_in", "participated_in", "born_in", "died_in", "located_in", "related_to",
)
RELATION_SPELLINGS = {
    "established": "founded", "co-founded": "founded", "co_founded": "founded", "cofounded": "founded", "set_up": "founded",
    "built": "created", "made": "created", "constructed": "created", "designed": "created",
    "devised": "invented", "conceived": "invented", "patented": "invented",
    "found": "discovered", "uncovered": "discovered", "identified": "discovered",
    "built_on": "developed", "advanced": "developed", "improved": "developed", "refined": "developed",
    "headed": "led", "managed": "led", "chaired": "led", "ran": "led",
    "supervised": "directed", "oversaw": "directed",
    "wrote": "authored", "published": "authored", "co-authored": "authored",
    "affected": "influenced", "impacted": "influenced", "shaped": "influenced",
    "motivated": "inspired",
    "component_of": "part_of", "member_of": "part_of", "belongs_to": "part_of", "subset_of": "part_of",
    "employs": "uses", "utilizes": "uses",
    "relies_on": "requires", "depends_on": "requires", "needs": "requires",
    "led_to": "caused", "triggered": "caused",
    "produced": "resulted_in", "generated": "resulted_in",
    "battled_in": "fought_in",
    "served_in": "participated_in", "engaged_in": "participated_in", "took_part_in": "participated_in",
}

# Words that give a domain away, in the order in which domains win ties.
DOMAIN_WORDS = {
    "history": ("history", "war", "battle", "revolution", "empire", "dynasty", "political", "government", "military", "colonial", "medieval"),
    "science": ("physics", "chemistry", "biology", "mathematics", "computer", "engineering", "technology", "algorithm", "quantum", "molecular"),
    "biography": ("people", "person", "biography", "leader", "president", "scientist", "artist", "writer", "philosopher", "musician"),
    "geography": ("country", "city", "region", "continent", "geography", "river", "mountain", "island", "ocean", "state"),
}

# How questions start, without their subject.
QUESTION_STARTS = (
    "what is", "what are", "explain", "describe", "define", "how does", "how do", "what does",
    "who is", "who was", "when was", "where is", "why is", "why does", "tell me about",
)

# Page furniture; whole lines, and parts of lines in the order in which they are deleted.
FURNITURE_LINES = (
    "feedback", "share", "yes", "no", "edit", "next", "previous", "copy", "copied!", "print", "download", "bookmark",
)
FURNITURE_PARTS = (
    r"(?i)\b(feedback|share this|share on|tweet|facebook|x\.com|linkedin|reddit)\b",
    r"(?i)summarize this article for me",
    r"(?i)in this article",
    r"(?i)skip to main content",
    r"(?i)table of contents",
    r"(?i)on this page",
    r"(?i)was this page helpful\??",
    r"(?i)yes\s*no\s*(feedback)?",
    r"(?i)edit this page( on github)?",
    r"(?i)suggest (an )?edit",
    r"(?i)report (an )?issue",
    r"(?i)previous\s*(page|article|chapter)?\s*next\s*(page|article|chapter)?",
    r"(?i)we use cookies",
    r"(?i)cookie (policy|notice|consent|settings)",
    r"(?i)accept (all )?cookies",
    r"(?i)privacy (policy|notice)",
    r"(?i)subscribe to (our )?newsletter",
    r"(?i)sign up for updates",
    r"(?:[\w\s]+\s*>\s*){3,}[\w\s]+",
)

# Namespaces whose pages are no articles.
NAMESPACES = (
    "wikipedia", "help", "template", "file", "image", "category", "portal", "talk", "user", "mediawiki", "special", "draft", "module", "book",
    "timedtext",
)

# Signs of hedging and of citing in an answer.
HEDGES = ("i think", "i believe", "probably", "maybe", "might be", "could be", "possibly", "not sure", "uncertain")
CITES = (r"\[\d+\]", r"\([A-Za-z]+ \d{4}\)", r"(?i)according to", r"(?i)source:", r"(?i)citation:")
CITES_MORE = r"(?i)reference:"

# Path segments that name no category.
PLAIN_SEGMENTS = (
    "en", "us", "docs", "index", "learn",
)
