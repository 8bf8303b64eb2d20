"""Fixed values.

Everything in this module is a value that must be exactly what the
weak-labelling rules, the augmentation and the encoders expect for the
results to be right: the class taxonomy, the ordered rule keyword lists,
the mutation vocabularies and the encoder ids. They are stated plainly,
in their natural order, and every Spark expression and every oracle SQL
string is generated from them.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: class taxonomy (class id = position in the list)
# ---------------------------------------------------------------------------
CLASSES = ["normal", "sqli", "xss", "lfi", "rce", "other", "upload", "traversal"]
CLASS_ID = {c: i for i, c in enumerate(CLASSES)}
NUM_CLASSES = len(CLASSES)

# ---------------------------------------------------------------------------
# FIXED VALUES: title rules, first hit wins, substring test on lower(title)
# ---------------------------------------------------------------------------
TITLE_RULES = [
    ("sqli", ["sql"]),
    ("xss", ["xss", "cross-site"]),
    ("lfi", ["lfi", "local file inclusion"]),
    ("rce", ["rce", "command injection", "execution"]),
    ("traversal", ["traversal", "directory traversal"]),
    ("upload", ["upload"]),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: payload rules, first hit wins, substring test on lower(payload)
# ---------------------------------------------------------------------------
PAYLOAD_RULES = [
    ("xss", ["script", "alert(", "onerror=", "onload=", "prompt(", "confirm(", "svg",
             "javascript:", "onmouseover=", "onmouseenter=", "onfocus=", "onauxclick=",
             "onpointer"]),
    ("sqli", ["select ", "union ", "waitfor ", "sleep(", "or 1=1", "or '1'='1",
              "drop table", "information_schema", "json_extract"]),
    ("lfi", ["/etc/passwd", "boot.ini", "win.ini"]),
    ("traversal", ["../", "..%2f", "..%c0%af", "..\\"]),
    ("rce", ["; cat", "| ls", "$(whoami)", "`id`", "wget ", "curl ", "exec cmd", "ping ",
             "whoami", "| set /a"]),
]
PAYLOAD_DEFAULT = "other"

# clean_label: classes tried in this order (normal excluded), characters stripped
CLEAN_ORDER = ["sqli", "xss", "lfi", "rce", "other", "upload", "traversal"]
CLEAN_STRIP = "[]\"' "

# ---------------------------------------------------------------------------
# FIXED VALUES: augmentation vocabularies
# ---------------------------------------------------------------------------
RANDOM_PARAMS = ["id", "page", "user", "search", "q", "query", "file", "dir", "path",
                 "name", "filter", "sort"]
RANDOM_PATHS = ["/assets/", "/images/", "/css/", "/api/v1/users", "/login", "/admin",
                "/index.php", "/search", "/api/docs"]
RANDOM_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
SQL_KEYWORDS = ["UNION", "SELECT", "DROP", "INSERT", "UPDATE", "DELETE", "AND", "OR"]
SQL_TAUTOLOGY_QUOTED = "1'='1"
SQL_TAUTOLOGY_PLAIN = "1=1"
XSS_ALERT = "alert(1)"
XSS_ALERT_OPTIONS = ["confirm(1)", "prompt(1)", "alert('XSS')"]
XSS_SCRIPT = "<script>"
XSS_SCRIPT_OPTIONS = ["<SeRiPt>", "<scr ipt>", " <script >"]
PATH_STEP = "../"
PATH_DEPTH_MIN, PATH_DEPTH_MAX = 1, 10
LFI_TARGET = "/etc/passwd"
LFI_TARGET_OPTIONS = ["/etc/passwd", "/etc/shadow", "/Windows/win.ini", "/boot.ini"]
# general mutation bucket edges: param wrap, path wrap, quote_plus, junk suffix, none
GENERAL_BUCKETS = [0.2, 0.4, 0.6, 0.8]
NORMAL_REGEN_P = 0.3
JUNK_LEN_NORMAL, JUNK_LEN_ATTACK = 8, 4

DEFAULT_SEED = 42
AUGMENT_TARGET = 20000
CAP_PER_CLASS = 5000
TEST_FRACTION = 0.2

# ---------------------------------------------------------------------------
# FIXED VALUES: encoders
# ---------------------------------------------------------------------------
MAX_LEN = 128
CHAR_PAD = 0          # chr(i) -> i + 1 for i < 128
CHAR_UNK = 129        # len(vocab) after PAD was added
CHAR_VOCAB_SIZE = 130
CLS_ID, SEP_ID, UNK_ID, PAD_ID = 101, 102, 100, 0

# ---------------------------------------------------------------------------
# FIXED VALUES: decisions
# ---------------------------------------------------------------------------
STATUS_NORMAL, STATUS_ATTACK, STATUS_ERROR = "NORMAL", "ATTACK", "ERROR"
OUTCOME_BLOCKED, OUTCOME_ALLOWED = "BLOCKED", "ALLOWED"
SEP_TOKEN = " [SEP] "
