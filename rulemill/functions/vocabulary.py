"""Word lists, patterns and lookup tables that results depend on. All are parameters of the operators."""

# Texts that stand for a missing value after trimming
NULL_TOKENS = ["", "nan", "NaN", "NULL", "null", "N/A", "n/a", "NA", "#N/A", "-", "None"]

# Words left out of a feature text
STOP_WORDS = [
    "high", "low", "good", "bad", "strong", "weak", "excellent", "poor",
    "significant", "limited", "extensive", "medium", "previous", "prior",
    "lack", "of", "the", "a", "an", "and", "or", "with", "in", "on",
]

# Characters stripped from both ends of a mechanism, and its longest length
MECHANISM_STRIP, MECHANISM_LENGTH = " \t\n\r.,;:!?", 500

# Outcome words and what they mean
OUTCOMES = {
    "success": "success", "successful": "success", "succeeded": "success", "positive": "success", "increased": "success",
    "better": "success", "improved": "success", "enhanced": "success", "good": "success", "excellent": "success",
    "failure": "failure", "failed": "failure", "failing": "failure", "negative": "failure", "decreased": "failure",
    "worse": "failure", "poor": "failure", "bad": "failure", "limited": "failure", "weak": "failure",
}

# Words of descriptive outcomes, and the share of a text's words that decides
SUCCESS_WORDS = [
    "success", "successful", "achieve", "accomplished", "enhanced", "improved",
    "increased", "better", "effective", "strong", "good", "excellent", "positive",
    "growth", "attraction", "confidence", "capability", "understanding", "insights",
    "management", "innovation", "strategic", "acquisition", "investment", "securing",
]
FAILURE_WORDS = [
    "failure", "failed", "hindered", "limited", "reduced", "insufficient", "lack",
    "poor", "weak", "negative", "decreased", "worse", "challenges", "difficulties",
    "obstacles", "problems", "issues", "constraints", "barriers",
]
OUTCOME_SHARE = 0.6

# Patterns of causal chains, in the order in which they are tried (name, pattern)
CHAIN_PATTERNS = [
    ("primary", r"(?im)([^→;]+?)\s*→\s*([^→;]+?)\s*→\s*(Success|Failure|success|failure|positive|negative|increased|decreased|better|worse)"),
    ("explicit", r"(?im)(?:High|Low|Strong|Weak|Good|Poor|Excellent|Limited|Significant|Medium|Previous|Extensive|Lack\s+of)?\s*([^→;]+?)\s*→\s*([^→;]+?)\s*→\s*(Success|Failure|success|failure)"),
    ("flexible", r"(?im)([^→;]+?)\s*→\s*([^→;]+?)\s*→\s*([^→;]+?)(?:\.|;|$)"),
    ("incomplete", r"(?im)([^→;]+?)\s*→\s*([^→;]+?)(?:\s+(?:for|necessary for|leading to|resulting in)\s+([^.;]+?))?(?:\.|;|$)"),
    ("alternative_1", r"(?im)([^→;]+?)\s+(?:leads?\s+to|results?\s+in|causes?|contributes?\s+to)\s+([^→;]+?)\s+(?:resulting\s+in|leading\s+to|causing|contributing\s+to)\s+(success|failure|positive|negative)"),
]
# Those that begin with a stretch of anything but marks: where a match of theirs can begin, after the one before or a mark
CHAIN_BEGUN, CHAIN_BEGIN = frozenset(p for _, p in CHAIN_PATTERNS), r"(?:\G|(?<=[→;]))"
# What a text must hold for a pattern to match at all, as a pattern that is quick to test
CHAIN_NEEDS = {
    "primary": r"(?i)→[^→;]+→\s*(?:success|failure|positive|negative|increased|decreased|better|worse)",
    "explicit": r"(?i)→[^→;]+→\s*(?:success|failure)",
    "flexible": "→[^→;]+→[^→;]",
    "incomplete": "→[^→;]",
    "alternative_1": "(?i)lead|result|cause|contribut",
}
# How a confidence is stated
CONFIDENCE = r"(?i)(?:I\s+am\s+)?(\d+)%?\s*(?:confident|confidence|certainty|\(.*?\))"

# Separators of compound features (tests, then splits), and the shortest part that counts
COMPOUND_MARKS = [" and ", " with ", ",", " including ", " plus "]
COMPOUND_SPLITS = [r"\s+and\s+", r"\s+with\s+", r"\s*,\s*", r"\s+including\s+", r"\s+plus\s+"]
SHORTEST_PART = 4

# Shares that phrase containment, keywords and fuzzy names must reach
CONTAINMENT, KEYWORDS, FUZZY = 0.3, 0.3, 0.6

# Labels of ordinal scales by their number of levels; codes of a scale that starts at 0 are looked up + 1
SCALES = {
    5: {1: "very_low", 2: "low", 3: "medium", 4: "high", 5: "very_high"},
    4: {1: "low", 2: "medium_low", 3: "medium_high", 4: "high"},
    3: {0: "low", 1: "medium", 2: "high"},
    2: {0: "no", 1: "yes"},
}
# Parts of names that tell a feature's kind where there is no table
CONTINUOUS_NAMES, BINARY_NAMES = ["number", "count", "yoe", "roles"], ["experience", "company", "leadership"]

# Cut-offs tried besides those from the scores, and the prefixes of the rule list
ABSOLUTE_CUTOFFS, PREFIXES = [0.02, 0.04, 0.06, 0.08, 0.10, 0.12, 0.15, 0.20], [3, 5, 8, 10, 15, 20]
# Tiers (least precision, most rules), and the shares that combinations must reach
TIERS = [(0.15, 2), (0.08, 5), (0.04, 8), (0.02, 10)]
MIN_PRECISION, TARGET_RECALL = 0.20, 0.50
# The precision a rule needs to be combined, the rules that votes look at, and the share left uncovered
LEAST_RULE_PRECISION, ENSEMBLE_RULES, ENSEMBLE_COVER = 0.04, 15, 0.1

# Texts of rules by kind
TEMPLATES = {
    "continuous": "IF {feature} >= <threshold> THEN P({outcome}) >= <confidence>",
    "ordinal": "IF {feature} >= <ordinal_level> THEN P({outcome}) >= <confidence>",
    "binary_success": "IF {feature} == True THEN P({outcome}) >= <confidence>",
    "binary_failure": "IF {feature} == False THEN P({outcome}) >= <confidence>",
    "categorical": "IF {feature} == <category> THEN P({outcome}) >= <confidence>",
}
# What stands for the threshold in them
PLACEHOLDERS = {"continuous": "<threshold>", "ordinal": "<ordinal_level>", "categorical": "<category>"}
