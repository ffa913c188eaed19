"""Rule tables of the routing cascade.

Everything below the FIXED VALUES marker must equal the values of the service
whose behaviour this library reproduces: phrase lists, their order (order is
semantic: the first matching rule wins), thresholds, prices and model names.
They are kept as plain text in their natural order.  Helpers at the bottom turn
them into small DataFrames with an explicit ``ord`` column so that no operator
ever relies on row order.
"""

from __future__ import annotations

import math

# ─────────────────────────────────────────────────────────────────────────────
# FIXED VALUES (must equal the reference service; do not reorder)
# ─────────────────────────────────────────────────────────────────────────────

# Layer 0A greetings: (phrase, answer), first match in this order wins.
GREETINGS = [
    ("hi", "Hello! How can I help you today?"),
    ("hello", "Hi there! What can I do for you?"),
    ("hey", "Hey! How can I assist you?"),
    ("good morning", "Good morning! How can I help?"),
    ("good evening", "Good evening! What do you need?"),
    ("good afternoon", "Good afternoon! How can I help?"),
    ("thanks", "You're welcome! Let me know if you need anything else."),
    ("thank you", "Happy to help! Feel free to ask more queries."),
    ("bye", "Goodbye! Have a wonderful day!"),
    ("goodbye", "Goodbye! Take care!"),
    ("who are you", "I am an intelligent multi-layer AI router designed to optimize query execution and minimize LLM costs."),
]

# Layer 0A facts: (phrase, answer); the phrase is matched as a substring.
FACTS = [
    ("what is pi", f"π (pi) = {math.pi}"),
    ("what is euler", f"e (Euler's number) = {math.e}"),
    ("speed of light", "Speed of light in vacuum = 299,792,458 m/s (~3 × 10⁸ m/s)"),
    ("how many days in a year", "365 days (366 days in a leap year)"),
    ("how many months in a year", "12 months"),
    ("how many weeks in a year", "52 weeks"),
    ("what is gravity", "Standard gravitational acceleration on Earth (g) = 9.80665 m/s²"),
    ("boiling point of water", "100°C (212°F / 373.15 K) at 1 atm"),
    ("freezing point of water", "0°C (32°F / 273.15 K)"),
    ("how many seconds in a day", "86,400 seconds"),
    ("how many hours in a day", "24 hours"),
    ("what is a byte", "1 byte = 8 bits"),
    ("what is a kilobyte", "1 KB = 1,024 bytes (or 1,000 bytes in SI decimal)"),
    ("what is a megabyte", "1 MB = 1,024 KB = 1,048,576 bytes"),
    ("what is a gigabyte", "1 GB = 1,024 MB = 1,073,741,824 bytes"),
]

# Layer 0A unit conversions: (from_unit, to_unit, factor, explanation), in order.
CONVERSIONS = [
    ("cm", "meter", 0.01, "1 meter = 100 cm"),
    ("meter", "cm", 100, "1 meter = 100 cm"),
    ("km", "miles", 0.621371, "1 km = 0.6214 miles"),
    ("miles", "km", 1.60934, "1 mile = 1.6093 km"),
    ("feet", "meter", 0.3048, "1 foot = 0.3048 meters"),
    ("meter", "feet", 3.28084, "1 meter = 3.2808 feet"),
    ("inch", "cm", 2.54, "1 inch = 2.54 cm"),
    ("cm", "inch", 0.393701, "1 cm = 0.3937 inch"),
    ("kg", "pounds", 2.20462, "1 kg = 2.2046 lbs"),
    ("pounds", "kg", 0.453592, "1 lb = 0.4536 kg"),
    ("grams", "oz", 0.035274, "1 gram = 0.0353 oz"),
    ("hours", "minutes", 60, "1 hour = 60 minutes"),
    ("minutes", "seconds", 60, "1 minute = 60 seconds"),
    ("hours", "seconds", 3600, "1 hour = 3,600 seconds"),
    ("days", "hours", 24, "1 day = 24 hours"),
    ("days", "minutes", 1440, "1 day = 1,440 minutes"),
    ("days", "seconds", 86400, "1 day = 86,400 seconds"),
    ("weeks", "days", 7, "1 week = 7 days"),
    ("weeks", "hours", 168, "1 week = 168 hours"),
    ("km", "meter", 1000, "1 km = 1,000 meters"),
    ("meter", "km", 0.001, "1,000 meters = 1 km"),
    ("mm", "cm", 0.1, "1 mm = 0.1 cm"),
    ("cm", "mm", 10, "1 cm = 10 mm"),
]
CONVERSION_CUES = ["how many", "convert", " in ", " to ", "equals"]

# Layer 0A math gate.
MATH_TRIGGERS = [
    "calculate the value of", "calculate", "solve", "compute", "how much is",
    "evaluate", "simplify", "what is the value of", "what is", "value of",
]
MATH_FUNCS = ["sin", "cos", "tan", "cot", "sec", "csc", "sqrt", "log", "ln", "exp", "abs", "factorial", "pi", "rad", "deg"]
MATH_SHORTHAND = ["sinx", "cosx", "tanx", "cotx", "secx", "cscx"]
MATH_WORD_OPS = ["plus", "minus", "times", "divided", "squared", "cubed", "sqrt", "derivative", "integral", "factor"]
# Characters that may follow a math trigger for it to be stripped.
MATH_TRIGGER_FOLLOW = " 0123456789(+-/*"
# Word-to-operator replacements, applied in this order.
MATH_WORD_REPLACEMENTS = [
    ("multiplied by", "*"),
    ("times", "*"),
    ("divided by", "/"),
    ("divided", "/"),
    ("plus", "+"),
    ("minus", "-"),
    ("to the power of", "**"),
    ("power of", "**"),
    ("squared", "**2"),
    ("cubed", "**3"),
    ("square root of", "sqrt"),
    ("cube root of", "cbrt"),
    ("^", "**"),
    ("×", "*"),
    ("÷", "/"),
]
MATH_SHORTHAND_FUNCS = ["sin", "cos", "tan", "cot", "sec", "csc", "log", "ln", "sqrt"]

# Layer 0B general-knowledge gate.
DOMAIN_KEYWORDS = [
    "my package", "my order", "my subscription", "my account",
    "my payment", "my card", "my address", "my delivery",
    "refund", "cancel", "charged", "billed", "return",
    "track", "shipping", "dispatch", "invoice",
    "code structure", "skeleton", "boilerplate", "syntax",
    "c++", "cpp", "python", "java", "rust", "golang", "html",
    "react", "state", "re-render", "closure", "lambda", "settimeout",
    "sql", "injection", "n+1", "big o", "time complexity", "p vs np",
    "isvalidbst", "binary search tree", "rate limiter", "redis",
    "self-attention", "transformer", "lua", "database query", "cors",
    "fastapi", "express", "orm", "algorithm",
]
GK_TRIGGERS = [
    "what is", "what are", "who is", "who was", "who are",
    "tell me about", "explain", "define", "when was", "when is",
    "where is", "capital of", "founder of", "invented by",
    "who created", "who built", "who invented", "who wrote", "who directed",
    "what does", "history of", "meaning of", "tell me who is",
    "who played", "what was", "summary of",
]
STRIP_PHRASES = [
    "tell me about", "tell me who is", "tell me what is",
    "what do you know about", "what is the capital of",
    "what is the meaning of", "what is the history of",
    "what is", "what are", "who is", "who was", "who are",
    "explain", "define", "what was", "where is", "when was", "when is",
    "give me info on", "information about", "what does", "capital of",
]
# Characters that make a short text "not an entity" for the 1-5 word rule.
GK_OPERATOR_CHARS = "0123456789+-*/^%()="

# Layer 1 keyword classifier: category -> phrases (substring), in order.
KEYWORD_PHRASES = [
    ("shipping_query", ["order status", "my order", "my package", "track order", "track package", "delivery status", "shipment", "parcel arrive", "order dispatched", "shipping delay"]),
    ("refund_request", ["refund", "money back", "return item", "reimburse", "give back money", "return product", "chargeback"]),
    ("payment_issue", ["payment failed", "charged twice", "double billed", "billing issue", "wrong invoice", "card declined", "overcharged", "unauthorized charge"]),
    ("cancellation", ["cancel subscription", "cancel my plan", "unsubscribe", "terminate account", "stop subscription", "close my account", "cancel membership"]),
    ("address_update", ["delivery address", "shipping address", "change address", "update address", "wrong address", "new address for order"]),
    ("general_inquiry", ["customer support", "support agent", "talk to human", "contact helpdesk", "customer service", "speak to representative"]),
]
# Strong single words (word-boundary match, weight 1.5).
KEYWORD_STRONG = [
    ("shipping_query", ["tracking", "courier", "dispatch", "shipment", "parcel"]),
    ("refund_request", ["refund", "reimburse", "reimbursement"]),
    ("payment_issue", ["overcharged", "double-billed", "overbilling"]),
    ("cancellation", ["unsubscribe", "cancellation"]),
    ("address_update", []),
    ("general_inquiry", ["helpdesk"]),
]
KEYWORD_STRONG_WEIGHT = 1.5
KEYWORD_THRESHOLD = 0.25
KEYWORD_MARGIN = 0.05
# Texts matching any of these words/phrases are never keyword-classified.
KEYWORD_EXCLUSIONS = [
    "sin", "cos", "tan", "sqrt", "log", "matrix", "integral", "derivative", "equation",
    "theorem", "python", "javascript", "code", "algorithm", "who is", "who was",
    "capital of", "when was", "what is the speed of",
]

# Layer 2 / 3 / 4 parameters.
MINHASH_NUM_PERM = 128
MINHASH_THRESHOLD = 0.5
SHINGLE_K = 3
EMBED_THRESHOLD = 0.72
ENSEMBLE_FLOOR = 0.62
ENSEMBLE_MIN_VOTES = 2

# Layer 5 provider selection.
DEEP_TRIGGERS = [
    "in detail", "comprehensive", "deep dive", "elaborate", "essay", "analysis",
    "compare and contrast", "pros and cons", "step by step", "breakdown",
    "detailed explanation", "philosophical", "history of", "summarize the article",
    "why is", "why do", "discuss the implications", "architecture",
]
DEEP_WORD_LIMIT = 30
AUTO_PROVIDER_NAMES = ["auto", "smart", "intelligent", ""]
DEEP_CHOICE = ("gemini", "gemini-3.5-flash", "Gemini 3.5 Flash (Deep Analytical Reasoning & Large Context)")
FAST_CHOICE = ("groq", "openai/gpt-oss-120b", "Groq GPT OSS 120B (Ultra-Fast High-Throughput Inference)")
GROQ_MODELS = ["openai/gpt-oss-120b", "qwen/qwen3.8-27b", "openai/gpt-oss-20b", "groq/compound"]
GEMINI_MODELS = ["gemini-3.5-flash", "gemini-3.6-flash", "gemini-3.5-flash-lite", "gemini-flash-latest"]

# Token prices (USD per 1000 tokens) and cost floor.
SPLIT_PROMPT_PRICE = 0.00015
SPLIT_COMPLETION_PRICE = 0.0006
FLAT_PRICE = 0.00015
COST_FLOOR = 0.00005
DEFAULT_LLM_COST = 0.0001
BASELINE_COST_PER_QUERY = 0.0020

# Price tiers: (tier, max_price inclusive, alpha, display name, colour).
PRICE_TIERS = [
    ("cheap", 0.002, 0.60, "Cheap", "#10B981"),
    ("normal", 0.010, 0.50, "Normal", "#3B82F6"),
    ("expensive", 0.030, 0.35, "Expensive", "#F59E0B"),
    ("spike", float("inf"), 0.25, "Spike", "#EF4444"),
]
# Explanation of a tier: price per 1000 tokens, then alpha.
TIER_EXPLANATIONS = {
    "cheap": "LLM rates cheap ($%s/1k) → strict threshold (α=%s) for maximum accuracy",
    "normal": "LLM normal market rate ($%s/1k) → balanced routing (α=%s)",
    "expensive": "LLM rates elevated ($%s/1k) → looser threshold (α=%s) to save costs",
    "spike": "LLM rate spike ($%s/1k) → aggressive local handling (α=%s)",
}
PRICE_HOLD_SECONDS = 60
DEFAULT_ALPHA = 0.5
DEFAULT_TIER = "normal"

# Layers of the cascade: (layer, step name, display name, handled_by on a hit).
LAYERS = [
    ("0A", "Query Handler", "Layer 0A: Query Handler"),
    ("0B", "General Knowledge", "Layer 0B: General Knowledge"),
    ("1", "TinyML", "Layer 1: TinyML Classifier"),
    ("2", "MinHash Cache", "Layer 2: MinHash LSH Cache"),
    ("3", "Embedder", "Layer 3: Semantic Embedder"),
    ("4", "Ensemble ML", "Layer 4: Ensemble ML (α-Calibrated)"),
    ("5", "LLM Inference", "Layer 5: LLM"),
]

# Identities that the math layer knows by heart: (form, answer).
IDENTITIES = [
    ("sinx/cosx", "tan(x)"),
    ("sin(x)/cos(x)", "tan(x)"),
    ("cosx/sinx", "cot(x)"),
    ("cos(x)/sin(x)", "cot(x)"),
    ("sinx/tanx", "cos(x)"),
    ("sin(x)/tan(x)", "cos(x)"),
    ("sin(x)^2 + cos(x)^2", "1"),
    ("sin(x)**2 + cos(x)**2", "1"),
    ("sin^2(x) + cos^2(x)", "1"),
]

# What a decision's handler is shown as: (handled_by, label, layer, cost); the last one stands for all others.
HANDLERS = [
    ("math", "Math Engine", "0A", "FREE (~1ms)"),
    ("greeting", "Greetings", "0A", "FREE (~1ms)"),
    ("conversion", "Unit Converter", "0A", "FREE (~1ms)"),
    ("facts", "Facts Database", "0A", "FREE (~1ms)"),
    ("wikipedia", "Wikipedia", "0B", "FREE (~500ms)"),
    ("duckduckgo", "DuckDuckGo", "0B", "FREE (~800ms)"),
    ("tinyml", "TinyML Classifier", "1", "FREE (~2ms)"),
    ("cache", "MinHash LSH Cache", "2", "FREE (~1ms)"),
    ("embedder", "Semantic Embedder", "3", "FREE (~50ms)"),
    ("ensemble", "Ensemble ML (α)", "4", "FREE (~400ms)"),
    ("groq", "Groq (Paid)", "5", "PAID (~900ms)"),
    ("gemini", "Gemini (Paid)", "5", "PAID (~1200ms)"),
    ("gpt4", "LLM Fallback", "5", "PAID (~1000ms)"),
    ("unknown", "Unknown Router", "?", "N/A"),
]

# Evaluation scorecard.
EVAL_FUNCTIONAL_POINTS = 90.0
EVAL_BURST_FAST_MS = 150.0
EVAL_BURST_FAST_POINTS = 10
EVAL_BURST_OK_POINTS = 8

# ─────────────────────────────────────────────────────────────────────────────
# end of fixed values
# ─────────────────────────────────────────────────────────────────────────────


def greeting_rules():
    """[(ord, phrase, answer)] for the greeting lookup."""
    return [(i, p, a) for i, (p, a) in enumerate(GREETINGS)]


def fact_rules():
    return [(i, p, a) for i, (p, a) in enumerate(FACTS)]


def conversion_rules():
    return [(i, f, t, float(x), e) for i, (f, t, x, e) in enumerate(CONVERSIONS)]


def conversion_units():
    """Distinct unit names in first-seen order."""
    seen = []
    for f, t, _, _ in CONVERSIONS:
        for u in (f, t):
            if u not in seen:
                seen.append(u)
    return seen


def keyword_rules():
    """[(category, cat_ord, phrase, kind, weight, denom)] for the keyword classifier.

    ``denom`` is half the number of phrases of the category, as in the scoring rule.
    """
    strong = dict(KEYWORD_STRONG)
    out = []
    for c_ord, (cat, phrases) in enumerate(KEYWORD_PHRASES):
        denom = len(phrases) * 0.5
        for p in phrases:
            out.append((cat, c_ord, p, "phrase", 1.0, denom))
        for w in strong.get(cat, []):
            out.append((cat, c_ord, w, "strong", KEYWORD_STRONG_WEIGHT, denom))
    return out


def keyword_categories():
    return [(i, cat, len(ph) * 0.5) for i, (cat, ph) in enumerate(KEYWORD_PHRASES)]
