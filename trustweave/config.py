"""Weights and thresholds, fixed values."""

CHANNEL = {"policy": 1.0, "procedure": 0.95, "manual": 0.9, "checklist": 0.85, "wiki": 0.8, "analysis": 0.8, "meeting": 0.75, "ticket": 0.7, "email": 0.55, "chat": 0.5}
CHANNEL_ELSE = 0.6
HALF_LIFE = {"policy": 720, "procedure": 540, "manual": 540, "checklist": 365, "wiki": 365, "analysis": 365, "meeting": 180, "ticket": 120, "email": 120, "chat": 90}
HALF_LIFE_ELSE = 365
RELATION = {"owns": 2.0, "authored": 2.0, "edited": 1.5, "answered": 1.2, "consulted": 1.0, "attended": 0.4, "assigned": 0.8, "reviewed": 1.0, "listed": 1.5}
RELATION_ELSE = 0.5
NO_REVIEW = ("chat", "email", "ticket", "meeting")
RELEVANT, ANSWERS, TRUSTED, FORMAL = 0.35, 0.5, 0.35, 0.75
RESEMBLES = 0.2
OFFICIAL = ("policy", "procedure", "manual")
INFORMAL = ("chat", "email", "ticket")
AS_OF = "2026-09-30"

# Countries and intents by keyword, in order of precedence, and the document types that an intent prefers.
COUNTRIES = {
    "BE": ["belgium", "belgian", "flanders", "wallonia", "brussels", "belgië"],
    "NL": ["netherlands", "dutch", "holland", "nederland"],
    "DE": ["germany", "german", "deutschland"],
    "FR": ["france", "french"],
    "UK": ["united kingdom", "uk", "british", "england", "great britain"],
}
COUNTRY_NAMES = {"BE": "Belgium", "NL": "Netherlands", "DE": "Germany", "FR": "France", "UK": "United Kingdom"}
INTENTS = {
    "contact": ["who can i ask", "who do i ask", "who should i ask", "who should i contact", "who to ask", "who is responsible", "who owns", "who can i contact"],
    "procedure": ["how do i", "how to", "how can i", "steps", "change", "configure", "process", "set up", "update the"],
    "decision": ["decide", "decided", "decision", "agreed", "agree", "outcome of the meeting"],
    "status": ["status", "bug", "ticket", "progress", "open issue"],
    "rule": ["what is", "what are", "how many", "how much", "which", "does", "is the", "who is"],
}
INTENT_ELSE = "rule"
INTENT_TYPES = {
    "contact": ["procedure", "wiki", "policy"],
    "procedure": ["procedure", "checklist", "manual", "wiki"],
    "decision": ["meeting", "email", "chat"],
    "status": ["ticket", "chat", "email"],
    "rule": ["policy", "manual", "wiki", "email"],
}
