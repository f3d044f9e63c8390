"""Fixed values. Word lists, patterns, tables and message formats that must equal the published
ones for results to agree. They are data: operators receive them through ``Lexicon``."""

TAXONOMY = (
    "billing_payment", "account_access", "trip_issue", "safety_incident",
    "delivery_order", "service_complaint", "general_query",
)

KEYWORDS = {
    "billing_payment": (
        "charge", "charged", "refund", "credit", "cost", "price", "promo", "code", "coupon",
        "payment", "pay ", "penalty", "fare", "money back", "billed", "receipt", "overcharg",
        "dispute", "invoice",
    ),
    "account_access": (
        "log in", "login", "log back", "sign in", "password", "hacked", "account was",
        "cant access", "can't access", "locked out", "reinstall", "reset my phone", "verify",
        "otp", "my account",
    ),
    "trip_issue": (
        "driver cancel", "cancelled my", "cancel the ride", "canceled", "pickup", "pick up",
        "long way", "wrong route", "late", "rating", "stars", "gps", "trip", "ride",
        "waiting for", "no show", "didnt show", "didn't show",
    ),
    "safety_incident": (
        "unsafe", "assault", "accident", "harass", "threat", "drunk", "kicked me out",
        "asked me to get off", "hit a", "hitting", "grope", "weapon", "danger", "attacked",
        "crash", "collision", "reckless",
    ),
    "delivery_order": (
        "eats", "order", "food", "restaurant", "delivery", "delivered", "sold out", "rejected",
        "courier", "meal",
    ),
    "service_complaint": (
        "worst", "terrible", "unacceptable", "no response", "not responding", "sue",
        "ridiculous", "disgusting", "never received such", "day 4", "days and", "still no",
        "useless", "waste", "fed up", "complain",
    ),
    "general_query": (
        "how do i", "how can i", "where can i", "is there a number", "check dm", "dm",
        "any way to", "can i", "what is", "follow up", "?",
    ),
}

NAIVE_TERMS = (
    "unsafe", "assault", "accident", "harass", "threat", "drunk driver", "attacked", "weapon",
    "groped", "kidnap", "crash", "collision",
)

FRUSTRATION = (
    "angry", "furious", "worst", "terrible", "unacceptable", "ridiculous", "disgusting", "hate",
    "fuck", "shit", "wtf", "sue", "useless", "pathetic", "never again", "fed up", "!!!",
)

STRONG_TERMS = (
    "assault", "assaulted", "assaulting", "harass", "harassed", "harassing", "harassment",
    "groped", "grope", "groping", "molest", "molested", "kidnap", "kidnapped", "weapon", "knife",
    "raped", "rape", "stalked", "stalking", "threatened", "threatening",
)

# term: (words that must be near, words that must not be near)
AMBIGUOUS_TERMS = {
    "crash": (
        ("car", "vehicle", "cab", "driver", "road", "into", "hit", "highway", "truck", "bike",
         "auto"),
        ("app", "application", "website", "site", "page", "screen", "software", "system",
         "update", "keeps", "browser", "login", "load", "loading", "server"),
    ),
    "crashed": (
        ("car", "vehicle", "cab", "driver", "road", "into", "hit", "highway"),
        ("app", "website", "site", "page", "screen", "software", "system", "server"),
    ),
    "crashing": (
        ("car", "vehicle", "driver", "road", "into"),
        ("app", "application", "website", "site", "page", "screen", "software", "keeps",
         "server"),
    ),
    "accident": (
        ("car", "vehicle", "road", "hit", "rear", "rear-ended", "driver", "injured", "hospital",
         "collision"),
        (),
    ),
    "collision": (("car", "vehicle", "road", "driver", "another"), ()),
    "drunk": (
        ("driver", "driving", "wheel", "cab"),
        ("i", "we", "myself", "getting", "got"),
    ),
    "reckless": (("driver", "driving", "drove", "speeding", "road", "cab"), ()),
    "dangerous": (("driver", "driving", "road", "speed", "cab"), ()),
    "unsafe": ((), ()),
    "attacked": (("driver", "passenger", "physically", "me"), ("account", "spam", "app")),
    "threat": (("driver", "me", "physical", "violence"), ()),
}

NEGATIONS = (
    "no", "not", "never", "without", "wasnt", "isnt", "didnt", "dont", "avoid", "avoided",
    "prevent", "prevented", "almost", "nearly", "no-one",
)

DEFLECTION = ("dm", "direct message", "send us a", "private message", "shoot us")

PROMISES = (
    "we have refunded", "we've refunded", "your refund has been processed", "we have credited",
    "we've credited", "we have issued", "we have processed your", "has been refunded",
    "we have banned", "we have fired", "we have deactivated the driver",
)

CALM_WORDS = ("safe", "sorry")

REJECTION_PATTERNS = (
    r"not what i (asked|meant|wanted)",
    r"(is|are)n'?t helping",
    r"(this|that) (still )?(does|doesn'?t|did not|didn't) (work|help)",
    r"not (understanding|listening|helping) me",
    r"you keep saying",
    r"same (thing|answer)",
    r"already (told|said|explained)",
    r"(answer|response|reply) is wrong",
    r"that'?s wrong",
    r"wrong answer",
    r"didn'?t (help|work|answer)",
    r"still (not|doesn'?t|isn'?t)",
    r"useless",
    r"unacceptable",
)

HUMAN_PATTERNS = (
    r"talk to (a |an )?(human|person|agent|someone|representative)",
    r"(connect|transfer) me",
    r"real (person|human|agent)",
    r"speak to (a |an )?(human|person|agent)",
    r"want (a |an )?(human|agent|person)",
    r"customer service rep",
)

CONTENT_STOP = (
    "the", "you", "and", "your", "not", "did", "for", "was", "are", "its", "her", "him", "she",
    "they", "them", "this", "that", "with", "have", "has", "had", "but", "get", "got", "why",
    "how", "can", "i've", "i'm", "when", "what", "who", "still", "keep",
)

ABBREVIATIONS = {
    "u": "you", "ur": "your", "pls": "please", "plz": "please", "thx": "thanks",
    "acct": "account", "appt": "appointment", "msg": "message", "dm": "dm",
    "canceld": "cancelled", "refnd": "refund", "driverz": "drivers",
}

URL_TO_MASK = r"https?://\S+|t\.co/\S+|www\.\S+"
URL_TO_CHECK = r"https?://\S+|t\.co/\S+"

OPENING = {
    "billing_payment": "So sorry about the trouble with your charge — that's never what we want.",
    "account_access": "Sorry you're having trouble getting into your account.",
    "trip_issue": "Sorry your trip didn't go the way it should have.",
    "safety_incident": "We're really sorry to hear this — your safety is our top priority.",
    "delivery_order": "Sorry your order didn't arrive the way it should have.",
    "service_complaint": "Sorry for the poor experience and for the wait to hear back.",
    "general_query": "Happy to help you with this.",
    "": "Thanks for reaching out — we'd like to help.",
}

NEXT_STEP = {
    "billing_payment": "review the charge and sort out a refund if one is due",
    "account_access": "verify your details and get you back into your account",
    "trip_issue": "pull up the trip and look into what happened",
    "safety_incident": "escalate this to our safety team for an urgent review",
    "delivery_order": "look into your order and make it right",
    "service_complaint": "get this to a specialist and follow up properly",
    "general_query": "point you in the right direction",
    "": "look into this for you",
}

# printf formats of a drafted reply: opening, next step
DRAFT_FORMATS = {
    "safety": "%s Please DM us the trip details now so we can %s straight away.",
    "private": (
        "%s If you DM us your account email and the trip details, we'll %s as quickly as we can."
    ),
    "open": "%s Reply here with your account email and the details and we'll %s.",
}
DRAFT_PATTERNS = {
    "safety": "move the customer to a private channel and escalate",
    "private": "move to DM for account details, then resolve",
    "open": "gather details, then follow up directly",
}
JUSTIFICATION_FORMAT = (
    "Synthesized from %d similar historical cases (%s); mirrors their resolution pattern (%s) "
    "without copying any reply verbatim."
)

ESCALATION_CLAUSES = {
    "explicit_human_request": "the customer explicitly requested a human agent",
    "safety_incident": "this is a physical-safety incident",
    "second_thumbs_down": "the customer marked the answer unhelpful more than once",
    "high_dissatisfaction": "the customer rejected the previous response and remained dissatisfied",
    "repeated_unresolved_question": "the customer repeated an unresolved issue",
    "low_classifier_confidence": "the request was too ambiguous to classify confidently",
    "low_retrieval_confidence": "no sufficiently relevant past case was found",
    "groundedness_failure": "the drafted answer failed grounding checks",
    "llm_failure": "the AI generation service was unavailable",
}

FEEDBACK_KINDS = ("helpful", "not_helpful", "human_request")
IMMEDIATE_REASONS = {
    "human_request": "the customer explicitly requested a human agent",
    "not_helpful": "the customer marked the AI response Not Helpful",
}

ROLES = ("customer", "ai", "human", "system")
STATES = ("AI_ACTIVE", "WAITING_FOR_HUMAN", "HUMAN_ACTIVE", "RESOLVED", "CLOSED")

# state: states it may move to (staying put is always allowed)
TRANSITIONS = {
    "AI_ACTIVE": ("WAITING_FOR_HUMAN", "RESOLVED", "CLOSED"),
    "WAITING_FOR_HUMAN": ("HUMAN_ACTIVE", "RESOLVED", "CLOSED"),
    "HUMAN_ACTIVE": ("WAITING_FOR_HUMAN", "RESOLVED", "CLOSED"),
    "RESOLVED": ("HUMAN_ACTIVE", "WAITING_FOR_HUMAN", "CLOSED"),
    "CLOSED": ("WAITING_FOR_HUMAN",),
}

# Texts that the store writes into a conversation; the escalation's reason is appended to the second.
REOPENED_NOTE = "Conversation reopened by a new customer message."
ESCALATED_NOTE = "Escalated to Human Support — "
# Method of a template draft after an error of the model, named by its kind.
ERROR_METHOD = "rules (llm_error: %s)"

ID_SEPARATOR = "␟"
