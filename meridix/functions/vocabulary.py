"""Word lists and rule tables that results depend on."""

from __future__ import annotations

# Points for words in a company's notes.
FIT_AMPLIFIERS = [
    ("iot_device_control", 3, ["iot", "smart lock", "app-connected", "app control", "connected device", "physical safety", "front door", "home security", "surveillance camera", "pet feeder", "air purifier", "water purifier", "sprinkler", "breast pump", "thermostat", "telematics", "vehicle theft", "home intrusion"]),
    ("drop_model", 2, ["drop-model", "sell out", "limited release", "scalper", "bot magnet", "waitlist", "drop day", "collab drops", "resell at 2x", "flavor drops"]),
    ("kids_minors", 2, ["coppa", "minors", "children", "kids", "teen", "youth", "toddler", "baby", "infant", "pediatric", "school district", "parental consent", "kid sizing"]),
    ("health_data", 2, ["hipaa", "health data", "medical record", "pregnancy", "prenatal", "cycle tracking", "glucose", "diabetes", "health profile", "microbiome", "fertility", "vaginal health", "intimate health"]),
    ("creator_community_trust", 2, ["creator trust", "community trust", "transparency", "reddit ama", "live selling", "cult following", "mental-health optimism", "anti-scalper"]),
    ("age_gated", 1, ["age-gated", "21+", "alcohol", "whiskey", "hard seltzer", "thc", "cannabis", "cbd", "rolling papers"]),
    ("high_ticket_financing", 1, ["financing", "installment", "affirm", "klarna", "$1000+", "high-ticket", "$500+", "stolen-card ring"]),
    ("franchise_location", 1, ["franchise", "multi-location", "store network", "first franchise", "showroom network"]),
    ("practitioner_portal", 1, ["practitioner portal", "physician dispense", "salon channel", "professional pricing", "dealer portal"]),
    ("subscription", 1, ["subscription", "auto-refill", "recurring billing", "monthly delivery", "membership logins"]),
    ("made_in_usa", 1, ["made-in-usa", "our factory", "vertical manufacturing", "domestic manufacturing", "factory floor margin"]),
    ("soc2_has", 2, ["soc 2 type ii", "iso 27001", "public-company governance", "nasdaq:", "nyse:", "public parent", "japanese parent governance", "german consumer giant"]),
    ("soc2_needs", 2, ["enterprise procurement gate", "vendor security review", "institutional governance incoming", "pe governance", "growth-fund governance", "future50 scaling", "need soc 2", "procurement gate", "vendor-review window"]),
]

# Words that flag friction.
NEGATIVE_RULES = [
    ("corporate_route_only", ["corporate route only", "parent-owned", "decisions centralized", "no local buyer", "no accessible champion", "corporate pe route"]),
    ("ma_freeze", ["ma freeze", "post-acquisition integration", "ownership transition", "just acquired", "recently acquired", "sale exploration", "unstable ownership"]),
    ("founder_departed", ["stepped down", "retired", "no successor named", "current ceo not surfaced", "ceo vacancy", "founder exited at sale"]),
    ("business_contraction", ["major layoffs", "mass layoffs", "store closures", "sustained user decline", "revenue contraction", "downsizing", "restructuring"]),
]

# Weight and half-life in days of scored signals, and signals that are context only.
INTENT_RULES = {
    "trial_install": (5, 14), "sdk_install": (5, 14), "evaluate_activity": (5, 14), "pricing_visit": (4, 7), "docs_visit": (4, 7), "explicit_incident": (4, 14),
    "competitor_evaluation": (3, 30), "security_hiring": (3, 30), "new_security_leader": (3, 45), "tech_migration": (3, 45), "authenticated_product_change": (2, 45),
    "funding": (3, 21), "new_market": (2, 60), "executive_business_event": (2, 45), "franchise_launch": (2, 60), "seasonal_window": (1, 9999), "regulated_expansion": (2, 60),
}
CONTEXT_ONLY = ("dark_funnel", "pci", "ca_breach", "ftc_click_to_cancel", "dpdp", "gdpr", "soc2_requirement", "award")
BEHAVIOUR_P1 = ("IDENTIFIED_TECHNICAL_EVALUATION", "COMMERCIAL_EVALUATION", "ACTIVE_EVALUATION", "DEPLOYMENT", "PRODUCT_QUALIFIED")

# Other names of signals.
SIGNAL_ALIASES = [
    ("funding", ["funding", "funding round", "raise", "raised", "investment", "capital raise", "scale milestone", "major acquisition of scale"]),
    ("executive_business_event", ["new c-suite", "new c suite", "executive hire", "exec hire", "new ceo", "new cfo", "new cpo", "new cmo", "executive/business event", "business event"]),
    ("new_security_leader", ["new cto", "new ciso", "new cio", "new security leader", "security leader appointed", "head of security appointed"]),
    ("security_hiring", ["security hiring", "security hire", "security engineer", "application security", "cloud security", "risk analyst", "fraud analyst", "trust and safety hiring", "trust & safety hiring", "fraud hiring", "risk hiring", "data security hiring", "hiring spike", "security project"]),
    ("tech_migration", ["tech migration", "technology migration", "replatform", "replatforming", "platform migration", "authentication migration", "auth migration", "account-flow redesign", "payment architecture change", "major security-stack change", "improving our technology"]),
    ("competitor_evaluation", ["competitor evaluation", "tool comparison", "vendor evaluation", "replacement project", "incumbent dissatisfaction", "sift evaluation", "seon evaluation", "forter evaluation", "kount evaluation", "castle evaluation", "arkose evaluation", "signifyd evaluation", "datadome evaluation"]),
    ("explicit_incident", ["explicit company-specific incident", "company-specific ato", "company-specific account takeover", "compromised accounts", "confirmed account takeover", "session hijacking incident", "company-specific fraud incident"]),
    ("authenticated_product_change", ["authenticated product change", "new authenticated product capability", "new customer portal", "new account feature", "new app", "new administrative capability", "new subscription capability", "connected device launch that changes the authenticated surface"]),
    ("pricing_visit", ["pricing visit", "pricing page visit", "pricing engagement", "commercial evaluation"]),
    ("docs_visit", ["docs visit", "documentation visit", "docs page visit", "quickstart engagement", "api docs engagement", "sdk docs engagement", "proxy docs engagement"]),
    ("trial_install", ["trial install", "trial signup", "trial"]),
    ("sdk_install", ["sdk installed", "deployment", "sdk deployment"]),
    ("evaluate_activity", ["evaluate calls", "/evaluate activity", "product qualified", "pql"]),
    ("new_market", ["new market", "market entry", "market expansion", "international expansion", "eu launch", "expanded to"]),
    ("regulated_expansion", ["regulated expansion", "regulated category", "new regulated category", "new compliance regime", "health claims expansion"]),
    ("franchise_launch", ["franchise launch", "first franchise", "new franchise", "location launch", "store opening", "new store"]),
    ("seasonal_window", ["seasonal window", "seasonal spike", "seasonal trigger"]),
    ("dark_funnel", ["dark-funnel", "dark funnel", "community complaint", "reddit complaint", "category discussion", "generic reddit complaint"]),
    ("pci", ["pci", "pci dss", "pci dss 4.0", "pci 4.0"]),
    ("ca_breach", ["ca breach", "california breach", "sb 362", "30-day breach"]),
    ("ftc_click_to_cancel", ["ftc click-to-cancel", "click-to-cancel", "click to cancel"]),
    ("dpdp", ["dpdp", "dpdp act", "digital personal data protection"]),
    ("gdpr", ["gdpr", "gdpr art. 32", "gdpr article 32"]),
    ("soc2_requirement", ["soc2 requirement", "soc 2 requirement", "soc2 procurement", "vendor security review"]),
    ("award", ["award", "recognition milestone", "future50", "inc 5000", "forbes feature"]),
]

# Phrases of replies, in the order in which they decide.
REPLY_RULES = [
    ("unsubscribe", "explicit_unsubscribe", ["unsubscribe", "remove me", "stop emailing", "stop contacting"]),
    ("negative", "explicit_negative", ["not interested", "no thanks", "no thank you"]),
    ("ooo", "out_of_office_signal", ["out of office", "away from .*office", "back on"]),
    ("not_now", "defer_signal", ["not now", "maybe later", "reach out .* later"]),
    ("interested", "positive_interest_signal", ["interested", "tell me more", "let's talk", "schedule", "book .*call", "worth a chat"]),
    ("question", "question_signal", ["what(?:'s| is)", "how does", "can you"]),
]
REPLY_ACTIONS = {
    "interested": "human_follow_up", "question": "human_follow_up", "not_now": "schedule_later", "negative": "stop_cold_sequence",
    "unsubscribe": "suppress_contact", "ooo": "defer_until_return", "other": "human_review", "unclassified": "human_review",
}

# Roles (the first that a title holds), titles of security owners, scores of role families.
ROLE_FAMILIES = [
    ("ciso", "security", 1), ("chief information security", "security", 1), ("security", "security", 1), ("fraud", "security", 1), ("risk", "security", 1),
    ("cto", "engineering", 2), ("technology", "engineering", 2), ("engineering", "engineering", 2), ("product", "product", 3), ("growth", "growth", 4),
    ("marketing", "growth", 4), ("finance", "finance", 5), ("procurement", "finance", 5), ("founder", "founder", 2), ("chief executive", "founder", 2), ("ceo", "founder", 2),
]
CISO_TITLES = ("ciso", "chief information security officer", "chief information security & risk officer", "chief information security and risk officer")
ROLE_SCORES = {"security": 50, "identity": 48, "risk": 44, "fraud": 44, "engineering": 40, "product": 38, "compliance": 36, "technology": 34}
EXECUTIVE = (
    r"chief\s+(?:executive|technology|information security|financial|operating|product|marketing|revenue|risk)|"
    r"ceo|cto|ciso|cfo|coo|cio|president|vice president|vp|svp|evp|head of|director of|director|founder|co-founder"
)
COMPANY_STOPWORDS = ("the", "and", "company", "co", "corp", "corporation", "inc", "llc", "ltd", "limited", "group", "holdings", "international", "global")
REJECTED_NAME_TOKENS = ("linkedin", "official", "team", "predictions", "profile", "page", "as", "co", "ceo", "cto", "ciso", "cfo", "coo", "cio")

# Facts that a page's words give, the first that holds.
VERTICALS = [
    ("cybersecurity", "cybersecurity"), ("cyber security", "cybersecurity"), ("fintech", "fintech"), ("financial services", "financial_services"), ("ecommerce", "ecommerce"),
    ("e-commerce", "ecommerce"), ("healthcare", "healthcare"), ("saas", "saas"), ("gaming", "gaming"), ("media", "media"), ("education", "education"), ("travel", "travel"),
]
OWNERSHIP = [
    ("publicly traded", "public_company"), ("listed on", "public_company"), ("nasdaq", "public_company"), ("nyse", "public_company"), ("private company", "privately_held"),
    ("privately held", "privately_held"), ("family-owned", "family_owned"), ("family owned", "family_owned"),
]
SENSITIVITY = [
    ("payment", "financial"), ("credit card", "financial"), ("financial data", "financial"), ("health record", "health"), ("medical record", "health"),
    ("identity verification", "identity"), ("personal data", "personal"), ("customer data", "customer"),
]
INDIA_BRIDGE = ("india office", "india-based", "based in india", "bengaluru", "bangalore", "hyderabad", "mumbai", "delhi")
# Public intent signals and the contexts that show one: every term of any context must stand in the text.
INTENT_CONTEXTS = [
    ("funding", [["raised", "funding"], ["raised", "financing"], ["funding round"], ["series a"], ["series b"], ["series c"]]),
    ("new_c_suite", [["appointed", "ceo"], ["appointed", "cto"], ["appointed", "cfo"], ["appointed", "ciso"], ["named", "ceo"], ["joined as", "ceo"], ["new ceo"], ["new cto"], ["new cfo"]]),
    ("security_hiring", [["hiring", "security"], ["hiring", "cybersecurity"], ["hiring", "fraud"], ["hiring", "risk"], ["security engineer"], ["fraud analyst"]]),
    ("tech_migration", [["migrated", "platform"], ["migration", "platform"], ["replatform"], ["technology migration"], ["migrating to", "shopify"], ["migrating to", "next.js"]]),
    ("new_market", [["launched in", "market"], ["expanded into", "market"], ["entered", "market"], ["international expansion"], ["launched in", "europe"], ["expanded to", "india"]]),
    ("regulated_expansion", [["regulated", "expansion"], ["regulatory", "launch"], ["compliance", "expansion"], ["new regulated category"]]),
    ("franchise_launch", [["new franchise"], ["first franchise"], ["franchise", "opened"], ["franchise", "launch"]]),
    ("award", [["won", "award"], ["named", "award"], ["inc. 5000"], ["inc 5000"], ["future50"], ["forbes"]]),
    ("seasonal_window", [["seasonal", "campaign"], ["holiday", "campaign"], ["black friday"], ["cyber monday"]]),
    ("pci", [["pci dss"], ["pci 4.0"]]), ("gdpr", [["gdpr"]]), ("dpdp", [["dpdp act"], ["digital personal data protection"]]),
    ("soc2_requirement", [["soc 2", "requirement"], ["soc2", "procurement"], ["vendor security review"]]),
    ("ftc_click_to_cancel", [["ftc", "click to cancel"], ["click-to-cancel"]]),
    ("ca_breach", [["california breach"], ["security breach"], ["data breach", "california"], ["sb 362"]]),
]
#: The one signal that goes by another name once it is normalised.
SIGNAL_NAMES = {"new_c_suite": "executive_business_event"}

# Phrases that tell of a relation, what it is, and what kind of entity follows.
RELATIONS = [
    ("operated by", "OPERATED_BY", "OPERATING_ENTITY"), ("owned by", "OWNED_BY", "UNKNOWN"), ("a subsidiary of", "SUBSIDIARY_OF", "UNKNOWN"), ("subsidiary of", "SUBSIDIARY_OF", "UNKNOWN"),
    ("a brand of", "BRAND_OF", "UNKNOWN"), ("brand of", "BRAND_OF", "UNKNOWN"), ("part of", "PART_OF", "UNKNOWN"), ("acquired by", "ACQUIRED_BY", "UNKNOWN"),
]
GENERIC_MAILBOXES = ("info", "hello", "support", "sales", "contact", "careers", "hr", "team", "press")
