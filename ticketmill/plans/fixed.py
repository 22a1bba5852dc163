"""Fixed values of the registered queries: word lists and parameters shared with the SQL texts."""

# Dictionary of the segmentation queries.
WORDS = [
    "the", "then", "there", "an", "and", "hand", "in", "ing", "on", "tion", "ation", "er", "ere", "eau", "eaux",
    "que", "queeau", "der", "sch", "ción",
]

# Phrases that stay whole, and phrases with given parts.
PROTECTED = ["of the", "and the", "de la", "thea"]
RULES = {"in the": ["in", "the"], "thation": ["tha", "tion"]}

# Stop words.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "de", "la", "le", "et", "les", "der", "die",
    "und", "el", "en",
]

# Part of speech of some tokens; "w" is punctuation and "nr" a person's name.
NATURES = [
    ("|", "w"), ("of,", "w"), ("the.", "w"), ("the,", "w"), ("on", "p"), ("and", "c"), ("er", "nr"), ("re", "nr"),
    ("th", "nr"), ("this", "r"), ("orre", "nr"), ("un", "m"),
]

JOB = "job-1"
MOD = 10
