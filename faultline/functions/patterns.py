"""Patterns and word lists that decide which text counts as what.

All of them must keep their meaning exactly, because results depend on them.  They are
written for Java's engine: ``(?U)`` makes ``\\w``, ``\\s`` and ``\\b`` Unicode-aware and
``(?iU)`` adds case-insensitivity.
"""

# --- fixed values: project layout ------------------------------------------------------
SOURCE_DIRS = ("models", "snapshots", "seeds", "analyses", "macros", "tests")
SOURCE_EXTENSIONS = (".sql", ".yml", ".yaml")
LINEAGE_TYPES = ("model", "snapshot", "seed")
RESOLVER_TYPES = ("model", "snapshot", "seed", "macro")

# --- fixed values: words that never count as symbols -----------------------------------
STOP_WORDS = (
    "and", "as", "by", "case", "cast", "else", "end", "false", "from",
    "group", "having", "join", "left", "not", "null", "on", "or", "order",
    "right", "select", "then", "true", "when", "where", "with",
)
BUILTIN_MACROS = ("config", "ref", "source", "var", "env_var", "doc")

# --- fixed values: trimming ------------------------------------------------------------
PUNCTUATION = "`'\".,;:()[]{}"
# every character that trimming removes
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# --- fixed values: log patterns (group numbers in comments) ----------------------------
ANSI_ESCAPE = r"\x1b\[[0-?]*[ -/]*[@-~]"
# 1 resource, 2 name, 3 path
ERROR_REF = (
    r"\b(?:Database|Compilation|Runtime|Parsing){start}\s+Error\s+in\s+(?:sql\s+)?"
    r"(model|snapshot|seed|macro)\s+([\w.$-]+)(?:\s+\(([^)\n]+)\))?"
)
# 1 resource, 2 name, 3 path
FAILURE_REF = (
    r"\bFailure{start}\s+in\s+(model|test|snapshot|seed|macro)\s+([\w.$-]+)"
    r"(?:\s+\(([^)\n]+)\))?"
)
# 1 path
SOURCE_PATH = (
    r"((?:[A-Za-z]:)?/?(?:[\w.@+ -]+/)*"
    r"(?:models|snapshots|seeds|analyses|macros|tests)/[\w.@+ /-]+\.(?:sql|yml|yaml))"
)
# 1 relation
STATUS_REF = r"\bERROR\b{start}[^\n]*\bmodel\s+([A-Za-z_][\w$]*(?:\.[A-Za-z_][\w$]*)?)"
# 1 name
NATURAL_REF = (
    r"\berror\b{start}[^\n]{{0,200}}\b(?:in|for|from)\s+(?:the\s+)?"
    r"([A-Za-z_][\w$]*)\s+(?:model|macro)\b"
)
COMPILED_SQL = r"compiled code at\s+(target/[^\s]+\.sql)"
ERROR_LOCATION = r"\b(?:line|LINE)\s+\d+|\[\d+:\d+\]"
COLUMN_ERROR = (
    r"\b(?:column|field|identifier)\b|does not exist|ambiguous column|invalid identifier"
)

# --- fixed values: SQL text patterns ---------------------------------------------------
IDENTIFIER = r"\b[A-Za-z_][\w$]*\b"
QUOTED_IDENTIFIER = r"[`'\"]([A-Za-z_][\w$.]*|[A-Za-z_][\w$]*\.[A-Za-z_][\w$]*)[`'\"]"
KEYWORD_SIGNAL = (
    r"\b(?:column|field|identifier|relation|table|model|macro|source|alias)\s+"
    r"[`'\"]?([A-Za-z_][\w$.]*)"
)
OPEN_KEYWORD = r"\b(?:column|field|identifier|relation|table|model|macro|source|alias)\z"
# 1 first argument, 2 second argument
REF_CALL = (
    r"\b(?:ref|source)\s*\(\s*['\"]([^'\"]+)['\"](?:\s*,\s*['\"]([^'\"]+)['\"])?"
)
MACRO_CALL = r"\{\{\s*([A-Za-z_][\w.]*)\s*\("
ALIAS = r"\bas\s+([A-Za-z_][\w$]*)\b"
CTE = r"(?:\bwith|,)\s+([A-Za-z_][\w$]*)\s+as\s*\("
CONFIG_BLOCK = r"\{\{\s*config\s*\((.*?)\)\s*\}\}"
JOIN_LINE = r"\bjoin\b|\bon\b"
FILTER_LINE = r"\bwhere\b|\bgroup\s+by\b|\bhaving\b|\bqualify\b"

# --- fixed values: answer format -------------------------------------------------------
SOURCE_OF = r"(?m)^SOURCE OF\s+([^:\n]+):"
SOLUTION_BLOCK = r"<solution>(.*?)</solution>\s*<file>(.*?)</file>"
PART_SEPARATOR = "----"
NO_FIX = "NO_FIX"
# what stands around the number of characters cut from a prompt
CUT_MARK = ("[... truncated ", " chars to keep the local Ollama prompt within the configured input limit ...]")
NO_FILE = "NO_FILE"
