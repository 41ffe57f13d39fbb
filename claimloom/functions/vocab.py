"""Words, maps and patterns that results must agree on (Java and RE2 dialect alike)."""

# fixed values: currency, unit and scale spellings
CURRENCY = {
    "₹": "INR", "inr": "INR", "rs": "INR", "rs.": "INR", "rupee": "INR", "rupees": "INR",
    "$": "USD", "usd": "USD", "dollar": "USD", "dollars": "USD",
    "€": "EUR", "eur": "EUR", "euro": "EUR", "euros": "EUR",
    "£": "GBP", "gbp": "GBP", "pound": "GBP", "pounds": "GBP",
}
UNIT = {
    "sq ft": "sq_ft", "sq. ft.": "sq_ft", "sqft": "sq_ft", "square feet": "sq_ft", "square foot": "sq_ft",
    "centres": "centres", "centers": "centres", "centre": "centres", "center": "centres",
    "fulfilment centres": "centres", "fulfilment centers": "centres", "fulfillment centres": "centres", "fulfillment centers": "centres",
    "facility": "facilities", "facilities": "facilities",
    "km": "km", "kms": "km", "kilometres": "km", "kilometers": "km",
    "tonne": "tonne", "tonnes": "tonne", "tons": "tonne", "ton": "tonne",
}
SCALE = {
    "thousand": 1e3, "k": 1e3, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "million": 1e6, "mn": 1e6, "m": 1e6,
    "crore": 1e7, "crores": 1e7, "cr": 1e7, "crs": 1e7, "billion": 1e9, "bn": 1e9, "b": 1e9, "trillion": 1e12, "tn": 1e12, "t": 1e12,
}
#: currency and scale as the quantity grammar writes them
TEXT_CURRENCY = {"₹": "₹", "inr": "INR", "rs": "INR", "rs.": "INR", "$": "$", "usd": "USD", "€": "€", "eur": "EUR", "£": "£", "gbp": "GBP"}
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6,
    "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "october": 10, "oct": 10,
    "november": 11, "nov": 11, "december": 12, "dec": 12,
}

# fixed values: words that make a sentence fact-bearing
FACT_WORDS = [
    "revenue", "profit", "loss", "operates", "operated", "operating", "acquired", "acquisition", "resigned", "appointed", "joined",
    "employees", "headcount", "growth", "margin", "owns", "owned", "located", "facility", "facilities", "fulfilment", "fulfillment",
    "ebitda", "ebit", "income", "expense", "expenditure", "market share", "volume", "sq ft", "square feet", "certified", "certification",
    "contract", "partnered", "founded", "headquartered", "reported", "generated", "launched", "increased", "decreased", "grew", "declined",
    "provides", "serves",
]
#: qualifier pattern, name; in this order
QUALIFIERS = [
    (r"\bapproximately\b", "approximately"), (r"\babout\b", "about"), (r"\baround\b", "around"), (r"\bnearly\b", "nearly"),
    (r"\bestimated\b", "estimated"), (r"\bover\b", "over"), (r"\bmore\s+than\b", "more than"), (r"\bat\s+least\b", "at least"),
    (r"\bup\s+to\b", "up to"), (r"\bless\s+than\b", "less than"), (r"\bunaudited\b", "unaudited"), (r"\bpro\s*forma\b", "pro forma"),
    (r"\bconsolidated\b", "consolidated"), (r"\bstandalone\b", "standalone"), (r"\bincluding\b", "including"),
    (r"\bexcluding\b", "excluding"), (r"\bcontinuing\s+operations\b", "continuing operations"),
    (r"\bconstant\s+currency\b", "constant currency"), (r"\bas\s+of\b", "as of"), (r"\bduring\b", "during"),
    (r"\bfor\s+the\s+year\s+ended\b", "for the year ended"),
]
COMPARISON = [
    (r"\b(over|more\s+than|greater\s+than)\b", "greater_than"), (r"\b(less\s+than|under)\b", "less_than"),
    (r"\b(at\s+least)\b", "greater_than_or_equal"), (r"\b(up\s+to|at\s+most)\b", "less_than_or_equal"),
    (r"\b(approximately|approx\.|about|around|nearly)\b", "approximate"),
]
VERBS = [
    (r"\b(operates|operating|operated)\b", "operates"), (r"\b(owns|owning|owned)\b", "owns"),
    (r"\b(acquired|acquiring|acquisition\s+of)\b", "acquired"), (r"\b(launched|launching)\b", "launched"),
    (r"\b(provides|providing|provided)\b", "provides"), (r"\b(serves|serving|served)\b", "serves"),
    (r"\b(appointed\s+as|appointed\s+director|appointed|joined\s+as)\b", "appointed_as"),
    (r"\b(resigned\s+as|resigned|stepped\s+down\s+as)\b", "resigned_as"),
    (r"\b(located\s+at|headquartered\s+at|situated\s+at|address\s+is)\b", "located_at"),
    (r"\b(covering|floor\s+area\s+of)\b", "floor_area"),
]
METRICS = [
    (r"^revenue(\s+from\s+operations)?$", "revenue"), (r"^total\s+revenue$", "revenue"), (r"^net\s+profit$", "profit"),
    (r"^pat$", "profit"), (r"^profit$", "profit"), (r"^net\s+loss$", "loss"), (r"^loss$", "loss"), (r"^ebitda$", "ebitda"),
    (r"^adjusted\s+ebitda$", "ebitda"), (r"^growth(\s*\(%\))?$", "growth"), (r"^margin(\s*\(%\))?$", "margin"),
    (r"^employees$", "employees"), (r"^headcount$", "employees"),
]

# fixed values: boilerplate, signals, subjects
BOILERPLATE = (
    r"(?i)table of contents|all rights reserved|strictly private and confidential|page intentionally left blank"
    r"|^\s*page\s+\d+(\s+of\s+\d+)?\s*$|^\s*-\s*\d+\s*-\s*$"
)
TEMPORAL_SIGNAL = (
    r"(?i)\bFY\s*\d{2,4}|\b(19|20)\d{2}\b|\bQ[1-4]\b|\b(January|February|March|April|May|June|July|August|September|October|November|December)"
    r"\s+\d{1,2},?\s+\d{4}|year ended|as of|during the year|since \d{4}"
)
GENERIC_SUBJECTS = [
    "it", "its", "they", "them", "we", "us", "our company", "the company", "company", "this company", "which we", "the following table", "he", "she",
]
PRONOUNS = ["it", "its", "they", "their", "he", "his", "she", "her"]
#: predicates that may be compared with each other
COMPATIBLE = [
    ["revenue", "total_revenue", "revenue_from_operations"],
    ["employee_count", "workforce", "employees", "total_employees"],
    ["operates", "fulfilment_centres"],
    ["operates", "facilities"],
]
TRANSITIONS = [("appointed", "resigned"), ("joined", "left"), ("opened", "closed"), ("started", "ended"), ("active", "inactive")]
TRANSITIONS_REASONING = [*TRANSITIONS, ("acquired", "divested"), ("launched", "closed")]

# fixed values: query words
QUERY_STOP = [
    "the", "in", "of", "and", "a", "an", "for", "to", "was", "is", "are", "by", "at", "on", "with", "from", "as", "that", "it", "its",
    "what", "how", "many", "there", "were", "or", "which", "who", "whom", "this", "be", "been", "being", "have", "has", "had", "do",
    "does", "did", "about", "any", "all", "some",
]
QUERY_TIME = ["year", "fiscal", "calendar", "period", "ended", "date", "as", "of", "quarter", "month"]
SYNONYMS = {
    "financial": ["revenue", "profit", "loss", "ebitda", "equity_share_capital", "income", "turnover", "capex"],
    "metrics": ["revenue", "profit", "growth", "volume", "shipments", "facilities", "centres", "equity_share_capital"],
    "metric": ["revenue", "profit", "growth", "volume", "shipments", "facilities", "centres", "equity_share_capital"],
    "capital": ["equity_share_capital"],
    "shares": ["equity_share_capital"],
    "share": ["equity_share_capital"],
    "equity": ["equity_share_capital"],
    "earnings": ["revenue", "ebitda", "profit"],
    "operational": ["fulfilment_centres", "express_parcel_shipments", "pincodes", "facilities", "vehicles"],
    "centres": ["fulfilment_centres", "delivery_centres"],
    "shipments": ["express_parcel_shipments", "part_truckload_volume"],
}
CONFLICT_WORDS = ["conflict", "contradict", "differ", "disagree", "discrepancy", "diverg", "incompatible"]

# fixed values: grammar of quantities and times
NUMBER = r"[-+]?\d{1,3}(?:,\d{3})*(?:\.\d+)?"
QUANTITY = (
    r"(?i)(?:(over|more\s+than|greater\s+than|less\s+than|approximately|approx\.|about|around|nearly|at\s+least|up\s+to)\s+)?"
    r"(?:(₹|INR|Rs\.?|\$|USD|€|EUR|£|GBP)\s*)?"
    rf"({NUMBER})"
    r"(?:\s*(million|billion|crore|crores|lakh|lakhs|thousand|thousands|trillion)\b)?"
    r"(?:\s*(%|percent|square\s*feet|sq\.?\s*ft\.?|sqft|tonnes|metric\s*tonnes|guards|centres|centers|facilities|employees|km|mt))?"
)
_MONTH = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
AS_OF = r"(?i)\bas\s+of\s+([A-Za-z]+(?:\.|\s+)\d{1,2},?\s+\d{2,4})\b"
YEAR_ENDED = r"(?i)\bfor\s+the\s+year\s+ended\s+([A-Za-z]+(?:\.|\s+)\d{1,2},?\s+\d{2,4})\b"
DATE = rf"(?i)\b(?:as\s+of\s+|for\s+the\s+year\s+ended\s+)?((?:{_MONTH})[a-z]*\.?\s+\d{{1,2}},?\s+\d{{2,4}})\b"
QUARTER = r"(?i)\b(Q[1-4])\s*(?:of\s+)?(FY\s*\d{2,4}|\d{4})?\b"
FISCAL = r"(?i)\b(FY\s*\d{2,4}(?:-\d{2,4})?|fiscal\s*(?:year)?\s*\d{2,4})\b"
DURING = r"(?i)\bduring\s+(\d{4})\b"
YEAR = r"\b(19\d{2}|20\d{2})\b"
