"""Word lists, patterns, weights and texts that results depend on."""

# --- fixed values: text-column detection -----------------------------------
TEXT_COLUMN_KEYWORDS = [
    "comment", "text", "review", "feedback", "message", "description", "content",
    "body", "post", "tweet", "response", "answer", "note", "remark",
]
# (mean length above, score, reason)
LENGTH_STEPS = [
    (50, 0.3, "Long average text length (%.0f chars)"),
    (20, 0.2, "Medium text length (%.0f chars)"),
    (10, 0.1, "Short text length (%.0f chars)"),
]
# (share with a space above, score, reason)
SPACE_STEPS = [
    (0.7, 0.2, "Multi-word text (%.0f%%)"),
    (0.3, 0.1, "Some multi-word text (%.0f%%)"),
]
NAME_SCORE = 0.5
ARBITRATION_BELOW = 0.7
ARBITRATION_CONFIDENCE = 0.85

# --- fixed values: cells a CSV reader takes as missing -----------------------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- fixed values: cleaning ---------------------------------------------------
SPAM_PATTERNS = [
    r"(buy|click|visit|check)\s+(now|here|this)",
    r"http.*\s.*http",
    r"(!!!){2,}",
    r"(\$\$\$|€€€|£££)",
    r"(free|win|winner|prize).*now",
    r"(viagra|cialis|pharmacy)",
]
SHOUT_MIN_LENGTH = 10
SHOUT_SHARE = 0.7
MIN_TEXT_LENGTH = 3
MIN_ROWS = 10
ENGLISH_WORDS = ["the", "is", "and", "to", "a", "of", "in", "for"]
REMOVAL_REASONS = ["missing", "empty", "short", "spam", "duplicate"]

# --- fixed values: topics -------------------------------------------------------
TOPIC_STOP_WORDS = [
    "this", "that", "with", "from", "have", "been", "were",
    "they", "their", "the", "and", "for", "are", "but",
]
TOPIC_STRIP = ".,!?;:\"'"
TOPIC_MIN_LENGTH = 4
TOPICS_PER_COMMENT = 5
DEFAULT_TOPIC = "general"

# --- fixed values: labels ---------------------------------------------------------
SENTIMENTS = ["negative", "neutral", "positive"]
SENTIMENT_VALUES = {"positive": 1.0, "neutral": 0.0, "negative": -1.0}
EMOTIONS = ["anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise"]
BAND_EDGE = 0.3

# --- default lexicons (a choice of this package; any word lists can be passed) -----
POSITIVE_WORDS = [
    "amazing", "awesome", "best", "delighted", "easy", "enjoy", "excellent", "fantastic",
    "fast", "friendly", "good", "great", "happy", "helpful", "impressed", "love", "loved",
    "nice", "outstanding", "perfect", "pleased", "quick", "recommend", "reliable",
    "satisfied", "superb", "wonderful",
]
NEGATIVE_WORDS = [
    "angry", "awful", "bad", "broke", "broken", "clown", "crash", "defective",
    "disappointed", "disappointing", "disgusting", "frustrating", "hate", "horrible",
    "idiot", "loser", "moron", "pathetic", "poor", "rude", "scum", "slow", "stupid",
    "terrible", "trash", "unacceptable", "useless", "waste", "worst", "worthless",
]
EMOTION_WORDS = {
    "anger": ["angry", "furious", "hate", "idiot", "moron", "rude", "stupid", "unacceptable"],
    "disgust": ["awful", "disgusting", "gross", "nasty", "scum", "trash", "worthless"],
    "fear": ["afraid", "anxious", "scared", "scary", "unsafe", "worried"],
    "joy": ["best", "delighted", "enjoy", "excellent", "great", "happy", "love", "loved",
            "perfect", "pleased", "wonderful"],
    "sadness": ["disappointed", "disappointing", "loser", "pathetic", "regret", "sad",
                "unhappy"],
    "surprise": ["amazing", "astonished", "shocked", "surprised", "unexpected", "wow"],
}
HIT_LOGIT = 4.0
NEUTRAL_LOGIT = 2.0

# --- entity rules (a choice of this package), in order of precedence ---------------
# type, texts of which a match holds at least one, pattern, confidence
ENTITY_RULES = [
    ("EMAIL", ["@"],
     r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 1.0),
    ("URL", ["http", "www."], r"https?://[^\s<>\"]+|www\.[^\s<>\"]+", 1.0),
    ("MONEY", ["$", "€", "£"], r"[$€£]\s?\d[\d,]*(?:\.\d+)?", 1.0),
    ("DATE", ["-", "/"], r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}", 1.0),
]
GAZETTEER_CONFIDENCE = 0.9
CAPITALISED_RUN = ("MISC", r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+", 0.5)

# --- fixed values: summaries ---------------------------------------------------------
TOP_TOPICS, TOPICS_USED, TOPIC_SAMPLES = 10, 3, 5
TOP_ENTITIES, ENTITY_CONTEXTS = 20, 3
TOP_KEYPHRASES, KEYPHRASES_USED = 20, 3
SAMPLE_LENGTH = 100

# --- fixed values: quality gate --------------------------------------------------------
MIN_COVERAGE, MIN_CONFIDENCE, MIN_QUALITY = 0.8, 0.6, 70.0
WARNING_QUALITY = 60.0
# name, weight, order, critical, recommendation when failed
GATE_CHECKS = [
    ("Data Coverage", 0.3, 1, True, "Consider increasing data quality or quantity"),
    ("Sentiment Quality", 0.2, 2, False,
     "Sentiment distribution is too uniform - verify data quality"),
    ("Topic Quality", 0.15, 3, False, "Low topic diversity - consider more varied data"),
    ("Entity Quality", 0.1, 4, False, "Few entities detected - data may lack specificity"),
    ("Confidence Check", 0.25, 5, True,
     "Low confidence scores - verify text quality and clarity"),
]
OTHER_CHECK_WEIGHT = 0.1

# --- fixed values: report types ----------------------------------------------------------
# type, title, target pages, guideline
REPORT_TYPES = [
    ("executive", "Executive Sentiment Analysis Report", "3-5 pages", """
EXECUTIVE REPORT:
- Focus on high-level insights and key metrics
- Include executive summary (1-2 paragraphs)
- Highlight critical issues and opportunities
- Provide clear recommendations
- Keep sections concise and actionable
- Target length: 3-5 pages
"""),
    ("marketing", "Marketing Sentiment Analysis Report", "5-7 pages", """
MARKETING REPORT:
- Analyze customer sentiment and emotions
- Identify campaign effectiveness
- Highlight brand perception
- Compare platforms/channels if applicable
- Focus on audience insights
- Include actionable marketing recommendations
- Target length: 5-7 pages
"""),
    ("product", "Product Sentiment Analysis Report", "7-10 pages", """
PRODUCT REPORT:
- Focus on feature feedback and pain points
- Identify bugs and issues mentioned
- Analyze satisfaction with specific features
- Prioritize improvement areas
- Include user suggestions
- Provide product roadmap insights
- Target length: 7-10 pages
"""),
    ("customer_service", "Customer_Service Sentiment Analysis Report", "5-8 pages", """
CUSTOMER SERVICE REPORT:
- Identify common support issues
- Analyze response effectiveness
- Highlight service quality trends
- Focus on resolution patterns
- Include training recommendations
- Provide escalation insights
- Target length: 5-8 pages
"""),
    ("comprehensive", "Comprehensive Sentiment Analysis Report", "15-20 pages", """
COMPREHENSIVE REPORT:
- Cover all aspects of the analysis
- Deep dive into sentiment, emotions, topics
- Detailed entity analysis
- Cross-reference different data points
- Include visualizations suggestions
- Provide extensive recommendations
- Target length: 15-20 pages
"""),
]
FALLBACK_REPORT_TYPE = "executive"
# name, priority, key points, data sources, length
DEFAULT_SECTIONS = [
    ("Executive Summary", "high", ["Overview of findings", "Key metrics"],
     ["sentiment", "emotion"], "2-3 paragraphs"),
    ("Sentiment Analysis", "high", ["Distribution", "Trends"], ["sentiment"],
     "3-4 paragraphs"),
    ("Key Topics", "medium", ["Main themes", "Topic sentiment"], ["topics"],
     "2-3 paragraphs"),
    ("Recommendations", "high", ["Action items", "Next steps"], ["all"], "2-3 paragraphs"),
]
DEFAULT_LENGTH = "5-7 pages"
DEFAULT_INSIGHTS = ["Analysis completed", "Recommendations provided"]
DEFAULT_FOCUS = ["Sentiment trends", "Customer feedback"]
DEFAULT_FLOW = ["Introduction", "Analysis", "Recommendations"]

# --- fixed values: report evaluation ------------------------------------------------------
CRITERION_WEIGHTS = {
    "completeness": 0.30,
    "factual_accuracy": 0.25,
    "coherence": 0.20,
    "actionability": 0.15,
    "hallucination": 0.10,
}
MIN_REPORT_SCORE = 70.0

# --- fixed values: price per million tokens --------------------------------------------------
PRICES = [
    ("claude-sonnet-4-20250514", 3.00, 15.00),
    ("claude-3-5-sonnet-20241022", 3.00, 15.00),
    ("claude-3-5-sonnet-20240620", 3.00, 15.00),
    ("claude-3-opus-20240229", 15.00, 75.00),
]
DEFAULT_PRICE = (3.00, 15.00)
SECONDS_PER_COMMENT = 1.5
