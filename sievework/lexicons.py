"""Word lists and pattern lists of the curation rules.

The blocklist is a moderation list: it names what is removed from a corpus. It
is a parameter everywhere, so a project can put its own in its place.
"""

from __future__ import annotations

# Labels in their declared order. Ties go to the earlier label.
LABELS = (
    "coffee", "university exams", "programming", "work", "food", "animals",
    "relationships", "technology", "sports", "money", "school", "travel",
    "health", "music", "general",
)
FALLBACK_LABEL = "general"

# Keywords per label. Each matches as a word prefix.
CONTEXT_KEYWORDS = (
    ("coffee", ("coffee", "espresso", "latte", "caffeine", "barista",
                "starbucks", "decaf", "cappuccino")),
    ("university exams", ("exam", "midterm", "final exam", "study", "studying",
                          "professor", "lecture", "semester", "thesis",
                          "dissertation", "graduate", "campus", "dorm", "gpa")),
    ("programming", ("program", "code", "coding", "developer", "python",
                     "javascript", "bug", "debug", "compiler", "software",
                     "git", "database", "algorithm", "stack overflow", "api")),
    ("work", ("boss", "office", "job", "meeting", "salary", "colleague",
              "manager", "coworker", "interview", "resume", "promotion",
              "overtime", "email")),
    ("food", ("pizza", "burger", "sandwich", "cheese", "bread", "cook",
              "restaurant", "chef", "dinner", "breakfast", "lunch", "bacon",
              "egg", "chicken", "taco")),
    ("animals", ("dog", "cat", "horse", "cow", "chicken", "bird", "fish",
                 "bear", "lion", "elephant", "penguin", "duck", "rabbit",
                 "snake", "puppy", "kitten")),
    ("relationships", ("wife", "husband", "girlfriend", "boyfriend",
                       "marriage", "married", "divorce", "dating", "tinder",
                       "date night", "ex-wife", "in-laws", "romance")),
    ("technology", ("computer", "phone", "internet", "wifi", "robot", "ai",
                    "tech", "app", "laptop", "battery", "smartphone",
                    "google", "facebook")),
    ("sports", ("football", "soccer", "basketball", "baseball", "tennis",
                "golf", "hockey", "coach", "referee", "olympic", "marathon",
                "gym")),
    ("money", ("money", "bank", "rich", "poor", "broke", "dollar", "loan",
               "debt", "tax", "wallet", "salary", "invest", "bitcoin",
               "credit card")),
    ("school", ("school", "teacher", "classroom", "homework", "student",
                "principal", "grade", "kindergarten", "pupil", "detention")),
    ("travel", ("flight", "airplane", "airport", "hotel", "vacation",
                "tourist", "luggage", "passport", "beach", "cruise",
                "train station")),
    ("health", ("doctor", "hospital", "nurse", "medicine", "patient",
                "surgery", "dentist", "pill", "diet", "gym", "sick",
                "therapist")),
    ("music", ("music", "guitar", "piano", "band", "singer", "song",
               "drummer", "concert", "violin", "album", "jazz", "rock band")),
)

# Moderation blocklist. Each entry matches as a word prefix.
BLOCKLIST = (
    "nigger", "nigga", "chink", "gook", "spic", "wetback", "kike", "raghead",
    "towelhead", "paki", "coon", "beaner", "jap", "wop", "dago",
    "faggot", "fag", "dyke", "tranny", "shemale",
    "retard", "retarded", "spastic", "mongoloid",
    "cunt", "whore", "slut",
    "pedophile", "paedophile", "pedo", "paedo", "pedos", "paedos",
    "child porn", "underage sex", "molest",
    "rape", "raping", "rapist",
    "suicide", "kill yourself", "kys",
    "holocaust", "genocide", "lynching",
)

# Spellings with digits and symbols in place of letters.
OBFUSCATIONS = (
    r"n[i1!|][gq]{2,}[e3a@]?r?",
    r"f[a@4][gq]{1,2}(?:[o0]t)?s?",
    r"r[e3]t[a@4]rd",
)

# Phrases of posts about the forum rather than content for it.
META_PHRASES = (
    "joke thread", "submit your", "upvote", "downvote", "r/jokes", "/r/",
    "repost", "front page", "tl;dr", "[meta]", "announcement", "contest",
    "winner",
)

# The same as patterns, each with a plain part of it.
META_PATTERNS = (
    ("this sub", r"this sub(?:reddit)?(?![a-z0-9_\p{L}\p{N}])"),
    ("karma", r"karma(?![a-z0-9_\p{L}\p{N}])"),
    ("rule ", r"rule \p{Nd}"),
)
