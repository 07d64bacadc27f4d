"""Arguments of the queries, shared with the SQL they are checked against."""

# Fixed words: frequent function words of the four languages in the documents.
STOP = [
    "a", "al", "an", "and", "are", "as", "at", "au", "auf", "avec", "be", "by", "con", "dans",
    "das", "de", "del", "dem", "den", "der", "des", "die", "du", "ein", "eine", "el", "en", "est",
    "et", "for", "from", "für", "im", "in", "is", "ist", "it", "la", "las", "le", "les", "los",
    "mit", "nicht", "of", "on", "or", "para", "pas", "por", "pour", "que", "qui", "se", "sich",
    "su", "sur", "that", "the", "this", "to", "un", "una", "und", "une", "von", "was", "with",
    "y", "zu",
]
# Fixed word forms and their lemmas.
LEMMAS = {
    "am": "be", "are": "be", "is": "be", "was": "be", "were": "be", "an": "a", "las": "la",
    "los": "el", "unas": "una", "les": "le", "des": "de", "une": "un", "den": "der", "dem": "der",
    "das": "der", "die": "der", "ist": "sein", "eine": "ein",
}
# Fixed words and their scores.
SCORES = {
    "idiot": -3, "moron": -3, "scum": -3, "disgusting": -3, "worthless": -2, "trash": -2,
    "pathetic": -2, "vile": -2, "clown": -1, "able": 1, "avec": 1, "mit": 1, "con": 1,
}
# Fixed scores for the whole run: words of lines that many documents share.
RUN_SCORES = {
    "thanedble": -2, "esndha": -1, "therhean": -1, "laleenéelle": -2, "réleou": -1, "aulich": -1,
    "erüver": -1, "erreth": -2, "ofretihaou": -1, "osóciónta": -2, "ofstthe": 1, "able": 1,
}
# A face, a sign with a skin tone, a family with joiners, a flag, a symbol with a selector, a keycap.
EMOJI = [
    "\U0001f600", "\U0001f44d\U0001f3fd", "\U0001f468\u200d\U0001f469\u200d\U0001f467",
    "\U0001f1eb\U0001f1f7", "\u2600\ufe0f", "1\ufe0f\u20e3", "",
]
# Fixed display names of the event types; one type is left out on purpose.
EVENT_NAMES = {"click": "Click", "view": "View", "purchase": "Purchase", "signup": "Sign-up"}
# Order states read as sentiment labels.
STATE_LABELS = {"O": "positive", "F": "negative", "P": "neutral"}
EVENT_RANGE = ("2024-01-08", "2024-01-21")
COMMENT_RANGE = ("2024-01-05 06:30:00", "2024-01-20 18:00:00")
FEED_RANGE = ("2024-01-03 00:00:00", "2024-02-05 12:00:00")
POST_CAP = 25
COMMENT_CAP = 120
NESTED_COMMENT_CAP = 60
TABLES = 4
BITS = 3
DIMS = 64
CLOSE = 0.3
