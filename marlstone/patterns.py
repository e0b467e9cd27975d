"""The patterns, word lists and limits that decide results.

They state what counts as an artifact, so they must be exactly these.
"""

from __future__ import annotations

import re

CHARS_PER_TOKEN = 4

# --- fixed values: character repair ------------------------------------------
CHARACTERS = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st", "­": "", " ": " ", "‑": "-"}
CID = re.compile(r"\(cid:\d+\)")
PAGE_BREAK = re.compile(r"(?:[ \t]*\n)*(?:[ \t]*\f(?:[ \t]*\n)*)+")
LOST_RUN = re.compile("�{2,}")
BLANK_RUN = re.compile(r"\n{3,}")

# --- fixed values: doubled text ----------------------------------------------
THREE_PAIRS = re.compile(r"([A-Za-z])\1([A-Za-z])\2([A-Za-z])\3")
TWO_PAIRS = re.compile(r"([A-Za-z])\1([A-Za-z])\2")
LETTER_PAIR = re.compile(r"([A-Za-z])\1")
HEX = re.compile(r"[0-9A-Fa-f]+")
NUCLEOTIDES = frozenset("acgtu")
VOWELS = frozenset("aeiouy")

# --- fixed values: printers' slugs -------------------------------------------
_DATE = r"\d{1,2}/\d{1,2}/\d{2,4}"
_STAMP_TIME = r"(?:\s+" + _DATE + r"(?:\s+\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AaPp]\.?[Mm]\.?)?)?)?"
STAMP_TAIL = re.compile(r"\.indd\b\s+\d{1,4}" + _STAMP_TIME, re.I)
STAMP_DATED = re.compile(r"\.indd\b\s+\d{1,4}\s+" + _DATE, re.I)
STAMP_NAME = re.compile(r"(?:\b\d{4,}\s*-\s*)?(?:(?:[\w&']+\s+){0,5}[\w&'-]*_[\w&'.-]*(?:\s+[A-Z]\d{1,2})?|[\w&'.-]*)$")
STAMP_WINDOW = 120
STAMP_LINE = re.compile(r"^\s*(?:\d{4,}\s*-\s*)?[\w&' .-]{1,80}\.indd\s+\d{1,4}" + _STAMP_TIME + r"\s*$", re.I)
SLUG_STRONG = re.compile(
    r"(?:\(Fogra\s*\d+\)\s*\w{0,3}\s*)?\bJob(?:\s*No\.?)?\s*:\s*[\d-]+\s+Title\s*:\s*.*?(?=\s*(?:\((?:RAY|Ray|Text)\)|\bJob(?:\s*No\.?)?\s*:|" + _DATE + r"|\||$))"
    r"|(?:\bC\d+_)?#\d+\s+DTP\s*:\s*\S+\s+Page\s*:\s*\d+|\bDtp\s*:\s*\w+\s+Page\s*:\s*\d+|\(Fogra\s*\d+\)\w{0,3}",
    re.I,
)
SLUG_WEAK = re.compile(r"(?:\bP\s+\d{2,4}C\s*)?\((?:RAY|Ray|Text)\)|\(\((?:RRAAYY|RRaayy|TTeexxtt)\)\)")
DATE_TIME = re.compile(_DATE + r"\s+\d{1,2}:\d{2}")
SLUG_PROOF = re.compile(r"\bJob(?:\s*No\.?)?\s*:\s*[\d-]+\s+Title\s*:|\bDTP\s*:", re.I)
SLUG_PROOFS = 2
SLUG_WORDS = frozenset(["yellow", "cyan", "magenta", "black", "key", "am", "pm", "rp", "wf", "wh"])
SLUG_HINTS = (".indd", "job", "dtp", "(ray)", "(text)", "fogra", "rraayy", "tteexxtt")

# --- fixed values: page furniture --------------------------------------------
HEADER_REPEATS = 4
HEADER_LENGTH = 70
PAGE_NUMBER = r"(?:\d{1,4}|[ivxlcdm]{2,8})"
ROMAN = r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
BARE_NUMBER = re.compile(r"^\s*\d{1,4}\s*$")
BARE_NUMBERS = 5
BARE_ROMAN = re.compile(r"^\s*(?=[ivxlcdm]{2,8}\s*$)" + ROMAN + r"\s*$")
BARE_ROMANS = 3
NUMBER_FIRST = re.compile(rf"^\s*({PAGE_NUMBER})\s+(.{{1,{HEADER_LENGTH}}}?)\s*$")
NUMBER_LAST = re.compile(rf"^\s*(.{{1,{HEADER_LENGTH}}}?)\s+({PAGE_NUMBER})\s*$")

# --- fixed values: tables of contents ----------------------------------------
PAGE_REFERENCE = re.compile(rf"\d{{1,4}}|{ROMAN}")
SEPARATOR_CELL = re.compile(r"[\s:-]*")
REGION_GAP, BRIDGE_GAP, REGION_ROWS = 3, 8, 4
REFERENCE_PERCENT, EMPTY_PERCENT = 20, 15
FRAGMENT_LENGTH = 90
LEADER = re.compile("^\\s*\\S.{0,150}?[\\s]*(?:\\.{5,}|[·‐-―─-▟�]{3,})[\\s.]*(\\d{1,4}|[ivxlcdm]{1,8})?\\s*$")
BULLET_PAGE = re.compile(r"^(?![\s]*[•\-\*•])\s*\S.{0,120}?\s+•\s+(\d{1,4}|[ivxlcdm]{1,8})\s*$")
CONTENTS = re.compile(r"^\s*table of contents\s*$", re.I)
TOC_SIGNALS, TOC_CLUSTER, TOC_GAP = 8, 4, 4

# --- fixed values: chapters --------------------------------------------------
CHAPTER = re.compile(r"^\s*(Chapter|Part)\s+(\d{1,3}|[IVXLC]{1,7})\s*[:.]\s*(\S.*?)(?:\s{2,}\d{1,4})?\s*$")
CHAPTER_TITLES, TITLE_LINES, TITLE_LENGTH = 3, 3, 8

# --- fixed values: boilerplate -----------------------------------------------
BOILERPLATE_REPEATS, BOILERPLATE_LENGTH = 3, 20

# --- fixed values: code ------------------------------------------------------
IMPORT = re.compile(r"^(?:import\s+\w|from\s+\S+\s+import\b)")
DEFINITION = re.compile(r"^(?:async\s+)?(?:def|class)\s+\w")
DECORATOR = re.compile(r"^@\w")
COMPOUND = re.compile(r"^(?:if|elif|else|for|while|try|except|finally|with|async\s+for|async\s+with)\b")
ASSIGNMENT = re.compile(r"^[A-Za-z_][\w.\[\]]*\s*(?:=|:=|\+=|-=|\*=|/=)(?!=)\s*\S")
CONTINUATION = re.compile(r"[()\[\]{}=]|[,)\]};]\s*$")
FLOW_WORD = re.compile(r"^(?:return\b.*|pass|break|continue|end|yield\b.*|raise\b.*|[}\])];?|//.*|\[\w+\])$")
C_FAMILY = re.compile(
    r"^(?:(?:public|private|protected|internal|static|virtual|override|async|final)\s+\w|var\s+\w+\s*=|using\s+[A-Z][\w.]*\s*;"
    r"|#include\s*[<\"]|func\s+\w+|namespace\s+[A-Z])"
)
CODE_SIGN = re.compile(r"[;{}()<>=]")
STRONG_LENGTH, WEAK_LENGTH, WEAK_WORDS, INDENTED_WORDS = 140, 100, 6, 10
CODE_RUN, FENCE_GAP = 2, 8
C_SHARE = 0.34
#: In order of precedence among equals.
LANGUAGES = {
    "cpp": re.compile(r"#include\s*[<\"]|\bstd::|template\s*<|->\s*\w+\s*\(|\bcout\s*<<"),
    "go": re.compile(r"^\s*func\s+\w|^\s*package\s+\w+\s*$|:=|\bfmt\.\w+\(|\bgo\s+func\b", re.M),
    "csharp": re.compile(
        r"^\s*using\s+[A-Z]\w*(?:\.\w+)*\s*;|\bnamespace\s+[A-Z]|Console\.Write|\{\s*get;\s*set;\s*\}|\basync\s+Task\b|\bpublic\s+record\b"
        r"|\bIActionResult\b|\[HttpGet|\[HttpPost", re.M),
    "java": re.compile(r"^\s*(?:package|import)\s+[a-z]\w*(?:\.\w+){2,}\s*;|System\.out\.print|@Override\b|\b(?:extends|implements)\s+[A-Z]", re.M),
    "javascript": re.compile(r"^\s*(?:const|let)\s+\w+\s*=|=>\s*[{(]|console\.log\(|\bfunction\s+\w+\(", re.M),
    "ruby": re.compile(
        r"^\s*require\s+['\"]|\battr_(?:reader|writer|accessor)\b|^\s*puts\s|\bdo\s*\|\w+\||^\s*end\s*$"
        r"|^\s*def\s+(?:self\.)?\w+[?!]?(?:\(.*\))?\s*$|^\s*elsif\b", re.M),
    "kotlin": re.compile(r"^\s*fun\s+\w+\(|\bval\s+\w+\s*[:=]|^\s*data\s+class\s|\bcompanion\s+object\b|^\s*import\s+(?:java|javax|kotlin|kotlinx|android)\.", re.M),
    "python": re.compile(
        r"^\s*(?:def\s+\w+.*:\s*$|class\s+\w+.*:\s*$|import\s+(?!java\.|javax\.|kotlin|android\.|org\.|com\.)\w+|from\s+\S+\s+import|elif\b)|\bself\.", re.M),
}

# --- fixed values: bullets and wraps -----------------------------------------
BULLET = re.compile(r"^(\s*)•\s+(\S.*)$")
LONE_BULLET = re.compile(r"^\s*•\s*$")
ITEM_LENGTH = 120
WRAP_LENGTH, JOIN_LENGTH = 65, 4000
HYPHEN = re.compile(r"([A-Za-z][A-Za-z']*)-$")
JOIN_UNSAFE = re.compile(r"[;{}]\s*$|^\s*(?:\[|//|\.)|=>")
SENTENCE_END = (".", "!", "?", ":", ";", '"', "”", "’", "…")
STRUCTURE = ("#", "|", ">", "-", "*", "```", "•", "<")
NUMBERED = re.compile(r"^\d+[.)]\s")

# --- fixed values: sections --------------------------------------------------
H1 = re.compile(r"^#\s+(.+?)\s*$")
H2 = re.compile(r"^##\s+(.+?)\s*$")
HEADING = re.compile(r"^#{1,6}\s+\S")
FENCE = re.compile(r"^\s*```")
BOOK_HEADING = re.compile(r"^#\s+(?:Chapter|Part|Appendix)\s+[\dIVXLC]", re.I)
BOOK_HEADINGS = 3
NO_TEXT = re.compile(r"^\s*(?:<!--.*?-->)?\s*$")
IMAGE_LINK = re.compile(r"!\[([^\]]*)\]\([^)]+\)")
CODE_SPAN = re.compile(r"(`+[^`]*`+)")
LEAD_TITLE = "Front matter"
TARGETS = {"Claude": 30_000, "ChatGPT": 12_000, "Gemini": 60_000, "Gemini Notebook": 120_000, "Local LLM": 4_000}
DEFAULT_TOKENS, NOTEBOOK_TOKENS, NOTEBOOK_SOURCES = 30_000, 120_000, 25
