"""Closed vocabularies. The values are fixed: results depend on them and on their order."""

from __future__ import annotations

# Aspects in their order (output order and tie-break order), auxiliary sentence and display name.
ASPECTS = [
    ("BATERIE", "baterie și autonomie", "Battery"),
    ("ECRAN", "ecran și afișaj", "Screen"),
    ("SUNET", "sunet și audio", "Sound"),
    ("PERFORMANTA", "performanță și viteză", "Performance"),
    ("CONECTIVITATE", "conectivitate și semnal", "Connectivity"),
    ("DESIGN", "design și aspect fizic", "Design"),
    ("CALITATE_CONSTRUCTIE", "calitatea construcției și durabilitate", "Build Quality"),
    ("PRET", "preț și raport calitate-preț", "Price"),
    ("LIVRARE", "livrare și ambalaj", "Delivery"),
    ("GENERAL", "impresie generală", "General"),
]
ASPECT_NAMES = [a for a, _, _ in ASPECTS]
POLARITIES = ["positive", "negative", "neutral"]
LABEL_IDS = {"none": 0, "positive": 1, "negative": 2, "neutral": 3}
JOB_STATES = ["pending", "in_progress", "completed", "failed", "cancelled"]

# Substrings of a review that is not about technical products (spaces at the end count).
NON_TECHNICAL = [
    "carte ", "roman ", "autor ", "editura", "pagini", "lectura", "citit", "volum ",
    "crema ", "parfum ", "sampon", "lotiune", "serum", "ruj ", "fond de ten", "gel de dus",
    "haina", "tricou", "geaca", "bluza", "rochie", "pantalon", "adidas", "nike", "ghete", "tenisi",
    "canapea", "fotoliu", "pat ", "dulap", "raft", "biblioteca", "birou ",
    "jucarie", "lego", "puzzle", "papusa",
]

# Product domains in the order in which they are tried.
DOMAINS = {
    "ceas_smart": ["smartwatch", "ceas", "fitbit", "garmin", "amazfit", "apple watch", "bratara fitness", "bratara smart"],
    "audio_video": ["casti", "boxe", "boxa", "televizor", " tv ", "speaker", "sunet", "audio", "wireless", "bluetooth", "difuzor", "headphone", "earphone"],
    "telefon": ["telefon", "smartphone", "iphone", "samsung", "xiaomi", "huawei", "android", "ios", "galaxy"],
}

# Patterns of dangerous markup and of SQL in user input, matched without regard to case.
MARKUP_PATTERNS = [r"<script[\s\S]*?>[\s\S]*?</script>", r"javascript:", r"on\w+\s*=", r"<iframe", r"<object", r"<embed", r"eval\("]
SQL_PATTERNS = [r"(\bUNION\b.*\bSELECT\b)", r"(\bDROP\b.*\bTABLE\b)", r"(\bINSERT\b.*\bINTO\b)", r"(\bDELETE\b.*\bFROM\b)", r"(;.*--)", r"('.*OR.*'.*=.*')"]
URL_PATTERN = r"^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$"

# Month names by number, short English first.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
MONTHS_RO = ["ianuarie", "februarie", "martie", "aprilie", "mai", "iunie", "iulie", "august", "septembrie", "octombrie", "noiembrie", "decembrie"]

# Topic number -> aspect.
TOPIC_ASPECTS = {
    -1: "GENERAL", 0: "GENERAL", 1: "PRET", 2: "SUNET", 3: "GENERAL", 4: "GENERAL", 5: "SUNET", 6: "BATERIE", 7: "BATERIE", 8: "PRET", 9: "PERFORMANTA", 10: "ECRAN", 11: "PERFORMANTA",
    12: "CONECTIVITATE", 13: "SUNET", 14: "BATERIE", 15: "PERFORMANTA", 16: "DESIGN", 17: "ECRAN", 18: "CONECTIVITATE", 19: "GENERAL", 20: "CONECTIVITATE", 21: "DESIGN", 22: "BATERIE", 23: "ECRAN",
}

# How a text begins or what it holds if it is page furniture and no review.
FURNITURE_STARTS = ["Detii", "Adauga", "Review", "stele", "clienti eMAG", "Spune", "Ai cumparat", "Scrie"]
FURNITURE_PARTS = ["review-uri", "parerea acordand", "recomanda produsul"]
REVIEW_CLASS_WORDS = ["review", "comment", "feedback", "opinion", "recenzie", "comentariu"]
