"""Fixed values of the data model: vocabularies, limits, word lists and patterns.

Results depend on every one of these being exactly as written.
"""

# --- fixed values: vocabularies -------------------------------------------------
LANGUAGES = ("python", "java", "javascript", "cpp")
TASKS = ("obfuscate", "deobfuscate", "refactor")
STRATEGIES = (
    "zero_shot",
    "few_shot_k3",
    "few_shot_k5",
    "chain_of_thought",
    "self_reflection",
    "zero_shot_light",
    "zero_shot_medium",
    "zero_shot_heavy",
)
TIERS = ("simple", "medium", "complex")
NATURAL_KEY = ("function_id", "model", "task", "strategy")

# --- fixed values: complexity tiers and quotas ----------------------------------
SIMPLE_MAX_CC = 10
MEDIUM_MAX_CC = 30
SAMPLE_LANGUAGE_QUOTA = {"python": 30, "java": 30, "javascript": 20, "cpp": 20}
SAMPLE_TIER_SHARE = {"simple": 0.4, "medium": 0.4}
REQUIRED_PER_LANGUAGE = {"python": 150, "java": 150, "javascript": 100, "cpp": 100}
DISTRIBUTION_TOLERANCE = 0.9
MIN_INSERTED = 450

# --- fixed values: budget -------------------------------------------------------
BUDGET_TOTAL_USD = 2000.0
BUDGET_TIER_PCT = {"tier1": 60.0, "tier2": 30.0, "tier3": 10.0}
BUDGET_EXHAUSTED_AT = 0.95
RATE_WHEN_UNPRICED = 0.001
RATE_WHEN_UNKNOWN = 0.002

# --- fixed values: model catalogue (tier, id, name, USD per 1k tokens) ----------
MODELS = (
    ("tier1", "x-ai/grok-code-fast-1", "Grok Code Fast 1", 0.0002),
    ("tier1", "google/gemini-2.5-flash", "Gemini 2.5 Flash", 0.000125),
    ("tier1", "deepseek/deepseek-chat", "DeepSeek V3.2", 0.00024),
    ("tier2", "anthropic/claude-sonnet-4.5", "Claude Sonnet 4.5", 0.003),
    ("tier2", "openai/gpt-5.2", "GPT-5.2", 0.00175),
    ("tier3", "anthropic/claude-opus-4.5", "Claude Opus 4.5", 0.015),
    ("tier3", "google/gemini-2.5-pro", "Gemini 2.5 Pro", 0.00125),
)

# --- fixed values: code metrics -------------------------------------------------
BRANCH_WORDS = ("if", "elif", "else", "for", "while", "case", "catch", "and", "or", "switch")
BRANCH_SYMBOLS = ("&&", "||", "?")
STRUCTURE_CHARS = "{}()[];,"

# --- fixed values: domain keywords, first matching row wins ----------------------
DOMAIN_BY_TASK = (
    ("algorithms", ("sort", "search", "tree", "graph", "dynamic")),
    ("data_structures", ("list", "array", "stack", "queue", "hash")),
    ("strings", ("string", "text", "parse", "regex")),
    ("math", ("math", "number", "prime", "factorial", "fibonacci")),
    ("io", ("file", "read", "write", "io")),
)
DOMAIN_BY_PATH = (
    ("algorithms", ("sort", "search", "dp", "dynamic", "graph", "tree")),
    ("data_structures", ("data_structure", "list", "stack", "queue", "hash")),
    ("strings", ("string", "text")),
    ("math", ("math", "number")),
    ("io", ("file", "io")),
)
LANGUAGE_ALIASES = {
    "Python": "python",
    "Java": "java",
    "JavaScript": "javascript",
    "C++": "cpp",
    "C%2B%2B": "cpp",
}

# --- fixed values: source trees --------------------------------------------------
EXTENSIONS = {"python": ".py", "java": ".java", "javascript": ".js", "cpp": ".cpp"}
SKIPPED_NAME_PARTS = ("test", "spec")
SKIPPED_DIRS = ("test", "tests", "__pycache__")
FILE_BYTES = (100, 5000)
BLOCK_CHARS = (50, 5000)
FUNCTION_CHARS = (50, 3000)
FUNCTION_WINDOW = 2000
MIN_COLLECTED_CC = 3

# --- fixed values: plausibility and test-suite structure markers -----------------
PLAUSIBLE_MARKERS = {
    "java": ("class ", "interface "),
    "javascript": ("function ", "=>", "const ", "var "),
    "cpp": ("#include", "int ", "void "),
}
SUITE_ALL_OF = {
    "java": ("import org.junit", "@Test"),
    "cpp": ("#include <gtest/", "TEST("),
}
SUITE_ANY_OF = {"javascript": ("describe(", "test(", "it(")}
SUITE_ERRORS = {
    "java": "Missing JUnit test structure",
    "javascript": "Missing Jest test structure",
    "cpp": "Missing GTest structure",
}
SUITE_MIN_COVERAGE_PCT = 80.0
SUITE_TIME_LIMIT_MS = 100

# --- fixed values: markers in model replies --------------------------------------
CODE_INDICATORS = {
    "python": ("def ", "import ", "class ", "from "),
    "javascript": ("function ", "const ", "let ", "var "),
    "java": ("public ", "class ", "import ", "private "),
    "cpp": ("#include", "void ", "int ", "class "),
}
TEST_TRIGGERS = {
    "python": ("def test_", "import pytest", "from hypothesis", "@given", "@seed"),
    "javascript": ("describe(", "test(", "it(", "fc.assert", "fc.property"),
    "java": ("import org.junit", "@Test", "class ", "public "),
    "cpp": ("#include", "TEST(", "EXPECT_", "ASSERT_", "RC_GTEST_PROP"),
}
TEST_STARTS = {
    "python": ("import ", "from ", "def ", "@"),
    "javascript": ("const ", "require(", "import ", "describe(", "test(", "it(", "fc."),
    "java": ("import ", "package ", "class ", "@Test", "public "),
    "cpp": ("#include", "using ", "TEST(", "namespace ", "int main"),
}
TEST_INDICATORS = {
    "python": ("def ", "import ", "class ", "@"),
    "javascript": ("function ", "const ", "describe(", "test("),
    "java": ("public ", "class ", "import ", "@Test"),
    "cpp": ("#include", "void ", "int ", "TEST("),
}
LEAD_IN_PATTERN = r"(Here is|Here's|This is)"
MAX_ATTEMPTS = 3

# --- fixed values: anomaly limits --------------------------------------------------
ANOMALY_SE = 50.0
ANOMALY_COST_USD = 0.10
ANOMALY_LATENCY_MS = 60000

# --- fixed values: intensity rules -------------------------------------------------
# (task, intensity, loc_lo, loc_hi, cc_lo, cc_hi); ratios of result to original,
# None = unbounded on that side.
INTENSITY_RULES = (
    ("obfuscate", "light", 0.8, 1.2, 0.9, 1.1),
    ("obfuscate", "medium", None, 1.5, 1.2, 1.5),
    ("obfuscate", "heavy", None, 2.0, 1.5, None),
    ("deobfuscate", "light", 0.8, 1.2, 1.0, 1.0),
    ("deobfuscate", "medium", None, 1.5, 0.7, 0.9),
    ("deobfuscate", "heavy", None, 2.0, 0.5, 0.7),
    ("refactor", "light", 0.8, 1.2, 0.9, 1.1),
    ("refactor", "medium", None, 1.5, 0.7, 0.9),
    ("refactor", "heavy", None, 2.0, 0.5, 0.7),
)

# --- fixed values: origin labels ----------------------------------------------------
SOURCE_PAGES = "rosetta_code"
SOURCE_TREES = "the_algorithms"
