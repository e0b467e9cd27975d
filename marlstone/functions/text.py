"""Column forms of the text predicates and helpers; all run in the JVM.

The Java patterns are made from ``patterns`` with Unicode classes switched on,
so both forms of a predicate decide by one pattern.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone import patterns as p


def java(pattern: re.Pattern | str) -> str:
    """A Python pattern in Java's dialect."""
    if isinstance(pattern, str):
        return f"(?Ud){pattern}"
    flags = "Ud" + "iu" * bool(pattern.flags & re.I) + "m" * bool(pattern.flags & re.M)
    return f"(?{flags}){pattern.pattern}"


def like(c: Column, pattern: re.Pattern | str) -> Column:
    """The pattern is found (patterns of whole lines hold their anchors)."""
    return F.regexp_like(c, F.lit(java(pattern)))


def hits(c: Column, pattern: re.Pattern | str) -> Column:
    return F.regexp_count(c, F.lit(java(pattern)))


def group(c: Column, pattern: re.Pattern | str, k: int) -> Column:
    return F.regexp_extract(c, java(pattern), k)


def swap(c: Column, pattern: re.Pattern | str, by: str) -> Column:
    return F.regexp_replace(c, java(pattern), by)


def strip(c: Column) -> Column:
    return swap(c, r"^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return swap(c, r"\s+$", "")


def squash(c: Column) -> Column:
    return strip(swap(c, r"\s+", " "))


def count_words(c: Column) -> Column:
    return hits(c, r"\S+")


# --- lines -------------------------------------------------------------------
def is_fence(line: Column) -> Column:
    return like(line, r"^\s*```")


def is_row(line: Column) -> Column:
    return like(line, r"^\s*\|")


def is_blank(line: Column) -> Column:
    return ~like(line, r"\S")


def cells(line: Column) -> Column:
    return F.transform(F.split(swap(strip(line), r"^\|+|\|+$", ""), r"\|", -1), strip)


def is_separator(parts: Column) -> Column:
    return F.exists(parts, lambda c: F.contains(c, F.lit("-"))) & F.forall(parts, lambda c: like(c, r"^[\s:-]*$"))


def is_page_reference(cell: Column) -> Column:
    return (cell != "") & like(cell, rf"^(?:{p.PAGE_REFERENCE.pattern})$")


def footer_text(line: Column) -> Column:
    found = F.when(like(line, p.NUMBER_FIRST), group(line, p.NUMBER_FIRST, 2)).when(like(line, p.NUMBER_LAST), group(line, p.NUMBER_LAST, 1))
    found = strip(found)
    return F.when(F.regexp_like(found, F.lit("[A-Za-z]")) & ~F.contains(found, F.lit("|")), found)


def is_fragment(line: Column) -> Column:
    s = strip(line)
    return (s == "") | ((F.length(s) <= p.FRAGMENT_LENGTH) & ~F.regexp_like(s, F.lit("[.!?]$")) & ~is_row(line))


def is_toc_signal(line: Column) -> Column:
    s = rstrip(line)
    return (s != "") & ~is_row(s) & (like(s, p.LEADER) | like(s, p.BULLET_PAGE) | like(s, p.CONTENTS))


def is_strong_code(line: Column) -> Column:
    s = strip(line)
    colon = F.endswith(s, F.lit(":"))
    known = like(s, p.IMPORT) | like(s, p.DECORATOR) | (colon & (like(s, p.DEFINITION) | like(s, p.COMPOUND))) | (F.contains(s, F.lit("(")) & like(s, p.DEFINITION))
    return (s != "") & (F.length(s) <= p.STRONG_LENGTH) & (known | (like(s, p.C_FAMILY) & like(s, p.CODE_SIGN)) | like(s, p.ASSIGNMENT))


def is_weak_code(line: Column) -> Column:
    s, words = strip(line), count_words(line)
    short = (F.length(s) <= p.WEAK_LENGTH) & (words <= p.WEAK_WORDS)
    quoted = F.regexp_like(s, F.lit("^[\"']")) & F.regexp_like(s, F.lit("[\"']$"))
    return (s != "") & (like(s, p.FLOW_WORD) | (F.startswith(line, F.lit("    ")) & (words <= p.INDENTED_WORDS)) | (short & (like(s, p.CONTINUATION) | quoted)))


def is_structural(line: Column) -> Column:
    s = strip(line)
    return (s == "") | F.regexp_like(s, F.lit(r"^[#|>\-*•<]|^```")) | like(s, p.NUMBERED) | is_strong_code(line)


def is_item(line: Column) -> Column:
    s = strip(line)
    return (s != "") & (F.length(s) <= p.ITEM_LENGTH) & ~F.regexp_like(s, F.lit(r"^[#|>\-*•]|^```")) & ~F.regexp_like(s, F.lit("[.!?:]$")) & ~is_strong_code(line)


# --- doubled text --------------------------------------------------------------
def is_doubled(token: Column) -> Column:
    return (F.length(token) >= 4) & F.regexp_like(token, F.lit(r"(?ds)^(?:(.)\1)+$"))


def is_doubled_pair(token: Column) -> Column:
    return F.regexp_like(token, F.lit(r"(?ds)^(.)\1$"))


def halved(token: Column) -> Column:
    for _ in range(3):
        token = F.when(is_doubled(token), F.regexp_replace(token, r"(?ds)(.)\1", "$1")).otherwise(token)
    return token


def letter_pairs(token: Column) -> Column:
    return F.regexp_count(token, F.lit(r"([A-Za-z])\1"))


def is_wordlike(token: Column) -> Column:
    low = F.lower(token)
    return F.regexp_like(low, F.lit(r"(?U)[\p{L}&&[^acgtu]]")) & ~F.regexp_like(token, F.lit("^[0-9A-Fa-f]+$")) & F.regexp_like(low, F.lit("[aeiouy]")) & F.regexp_like(low, F.lit(r"[\p{L}&&[^aeiouy]]"))


def is_shadow(token: Column) -> Column:
    return is_doubled(token) & is_wordlike(halved(token))


# --- code ------------------------------------------------------------------------
#: What a text with a sign of the language holds, one of these at least; without them there is nothing to count.
SIGNS = {
    "cpp": ("#include", "std::", "template", "->", "cout"),
    "go": ("func", "package", ":=", "fmt."),
    "csharp": ("using", "namespace", "Console.Write", "get;", "async", "public", "IActionResult", "[HttpGet", "[HttpPost"),
    "java": ("package", "import", "System.out.print", "@Override", "extends", "implements"),
    "javascript": ("=", "console.log(", "function"),
    "ruby": ("require", "attr_", "puts", "|", "end", "def", "elsif"),
    "kotlin": ("fun", "val", "data", "companion", "import"),
    "python": ("def", "class", "import", "elif", "self."),
}


def language_hits(code: Column) -> dict[str, Column]:
    """Signs of each language; only texts that hold a part of one are searched."""
    return {k: F.when(code.isNull() | reduce(or_, (F.contains(code, F.lit(x)) for x in SIGNS[k])), hits(code, r)).otherwise(0) for k, r in p.LANGUAGES.items()}


def language_scores(code: Column) -> Column:
    return F.struct(*[n.alias(k) for k, n in language_hits(code).items()])


def c_share(code: Column) -> Column:
    """The share of lines, of those that aren't blank, that end in a semicolon or brace."""
    solid, ended = (F.regexp_count(code, F.lit(java(r))) for r in (r"\S[^\n]*", r"[;{}][^\S\n]*+(?:\n|\z)"))
    return F.coalesce(ended / F.nullif(solid, F.lit(0)), F.lit(0.0))


def leading_language(scores: dict[str, Column], share: Column) -> Column:
    """The language that clearly leads, else an empty string."""
    ranked = F.array_sort(F.array(*[F.struct((-scores[k]).alias("n"), F.lit(i).alias("order"), F.lit(k).alias("name")) for i, k in enumerate(p.LANGUAGES)]))
    top, second = -ranked[0]["n"], -ranked[1]["n"]
    clear = (top >= 2 * second) & ((top >= 2) | ((top == 1) & (second == 0)))
    return F.when(clear | ((top >= 2) & (share >= p.C_SHARE)), ranked[0]["name"]).otherwise("")


def guess_language(code: Column) -> Column:
    return leading_language(language_hits(code), c_share(code))


# --- characters --------------------------------------------------------------------
#: What counts as noise, and as part of a word.
NOISE = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F�\p{Co}\p{Cn}]"
WORDLIKE = r"[\x21-\x7E\p{L}\p{M}\p{N}\p{P}\p{Sc}]"
GARBAGE = r"[\p{Cc}\p{Co}&&[^\n\t\u0002]]"


def noise_characters(c: Column) -> Column:
    return F.regexp_count(c, F.lit(NOISE))


def wordlike_tokens(c: Column) -> Column:
    """Tokens made of word-like characters only."""
    return F.size(F.filter(F.regexp_extract_all(c, F.lit(r"(?U)\S+"), F.lit(0)), lambda t: F.regexp_like(t, F.lit(f"^{WORDLIKE}+$")) & ~F.contains(t, F.lit("�"))))


def garbage_characters(c: Column) -> Column:
    return F.regexp_count(c, F.lit(GARBAGE))


def normalize_characters(c: Column) -> Column:
    for a, b in p.CHARACTERS.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(swap(c, p.CID, ""), p.PAGE_BREAK.pattern, "\n\n")


def normalized_characters(c: Column) -> Column:
    """How many characters normalize_characters() repairs."""
    one = "".join(p.CHARACTERS)
    plain = c
    for a, b in p.CHARACTERS.items():
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return F.regexp_count(c, F.lit(f"[{one}]")) + hits(plain, p.CID) + F.regexp_count(c, F.lit(r"\f"))


def scrub_lost(c: Column) -> Column:
    return F.regexp_replace(c, p.LOST_RUN.pattern, "")


def collapse_blanks(c: Column) -> Column:
    return F.regexp_replace(c, p.BLANK_RUN.pattern, "\n\n")


# --- documents ---------------------------------------------------------------------
def est_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / p.CHARS_PER_TOKEN)).cast("long")


def count_images(c: Column) -> Column:
    return F.regexp_count(c, F.lit(java(p.IMAGE_LINK))).cast("long")


def slugify(c: Column, length: int = 60) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    slug = F.regexp_replace(F.substring(slug, 1, length), "-+$", "")
    return F.when(slug == "", "section").otherwise(slug)


def one_line(c: Column) -> Column:
    return strip(swap(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", ""), r"\s*[\r\n]+\s*", " "))


def document_title(markdown: Column, fallback: Column) -> Column:
    """The first line with text, if it is a top heading."""
    first = F.regexp_extract(markdown, r"(?Ud)^(?:\s*\n)?([^\n]*\S[^\n]*)", 1)
    return F.when(like(first, p.H1), group(first, p.H1, 1)).otherwise(fallback)


def is_divider(markdown: Column) -> Column:
    lines = F.split(markdown, "\n", -1)
    return F.startswith(markdown, F.lit("#")) & F.forall(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x: like(x, p.NO_TEXT))


def is_lead(title: Column) -> Column:
    return (title == p.LEAD_TITLE) | F.startswith(title, F.lit(f"{p.LEAD_TITLE} (part "))


#: Editions that a file name drops.
EDITION = r",?\s*\(?\b(?:\d+(?:st|nd|rd|th)|first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth)\s+edition\b\)?"


def source_prefix(title: Column, length: int = 40) -> Column:
    """Short slug of the main title, cut between words."""
    head = F.split(title, r"(?U)\s*[:–—]\s+|\s+-\s+", 2)[0]
    main = F.when(head == "", title).otherwise(head)
    bare = strip(F.regexp_replace(main, f"(?Uiu){EDITION}", ""))
    bare = F.regexp_replace(F.when(bare == "", main).otherwise(bare), "['’]", "")
    slug = F.regexp_replace(slugify(bare, 200), "^(?:the|an?)-(?=.)", "")
    cut = F.substring(slug, 1, length + 1)
    return F.when(F.length(slug) <= length, slug).when(F.contains(cut, F.lit("-")), F.regexp_replace(cut, "-[^-]*$", "")).otherwise(F.substring(slug, 1, length))


def figure_note(alt: Column) -> Column:
    alt = strip(alt)
    return F.when(alt == "", "[Figure]").when(F.startswith(F.lower(alt), F.lit("figure")), F.concat(F.lit("["), alt, F.lit("]"))).otherwise(F.concat(F.lit("[Figure: "), alt, F.lit("]")))


def roman_value(c: Column) -> Column:
    """Value of a strict roman numeral, else null."""
    values = F.create_map(*[F.lit(x) for k, v in {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}.items() for x in (k, v)])
    c = F.lower(c)
    digits = F.transform(F.split(c, ""), lambda x: values[x])
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("high"))
    add = lambda a, d: F.struct((a["sum"] + F.when(d < a["high"], -d).otherwise(d)).alias("sum"), F.greatest(a["high"], d).alias("high"))
    return F.when((c != "") & F.regexp_like(c, F.lit(f"^{p.ROMAN}$")), F.aggregate(F.reverse(digits), start, add, lambda a: a["sum"]))


def furniture_key(c: Column) -> Column:
    return squash(swap(F.lower(c), r"\d+", "#"))


def repair_title(c: Column) -> Column:
    """Lost characters in a title: an apostrophe before an ending, a dash between words, else nothing."""
    c = F.regexp_replace(c, r"(?U)(?<=\w)�(?=(?:s|t|d|m|ll|re|ve)\b)", "’")
    return F.regexp_replace(F.regexp_replace(c, r"(?U)(?<=\w)�(?=\w)", "—"), "�", "")


#: Names of files, and numbers, that are no titles.
FILE_TITLE = r"(?i)\.(?:pdf|indd|docx?|qxd|qxp|ai|psd|txt)\s*$|\d{7,}"


def sane_meta(c: Column) -> Column:
    """A metadata title or author that can be believed, else an empty string."""
    s = squash(c)
    bad = ~F.length(s).between(3, 200) | F.regexp_like(s, F.lit(FILE_TITLE)) | ~F.regexp_like(s, F.lit("[A-Za-z]{3}")) | F.regexp_like(s, F.lit(r"(?i)^(?:untitled|microsoft word|document)"))
    return F.when(s.isNull() | bad, "").otherwise(s)


#: Words that stay small in a title.
SMALL_WORDS = ("a", "an", "and", "as", "at", "but", "by", "for", "from", "in", "into", "nor", "of", "on", "or", "the", "to", "vs", "via", "with")


def title_case(c: Column) -> Column:
    def one(w: Column, k: Column) -> Column:
        small = F.lower(w).isin(*SMALL_WORDS) & (k > 0)
        return F.when(F.regexp_like(w, F.lit(r"^\p{Ll}")) & ~small, F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))).otherwise(w)

    return F.array_join(F.transform(F.split(squash(c), " "), one), " ")


def digit_share(c: Column) -> Column:
    return F.coalesce(hits(c, r"\d") / F.nullif(hits(c, r"\S"), F.lit(0)), F.lit(0.0))


def log_cell(c: Column, limit: int = 90) -> Column:
    s = F.replace(squash(c), F.lit("|"), F.lit("\\|"))
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.substring(s, 1, limit - 1), F.lit("…")))


def sample(c: Column, limit: int = 160) -> Column:
    s = strip(c)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.substring(s, 1, limit - 1), F.lit("…")))


def stamp(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from an hour on."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    two = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    minutes = F.concat(two(F.floor(s % 3600 / 60)), F.lit(":"), two(s % 60))
    return F.when(s >= 3600, F.concat(two(F.floor(s / 3600)), F.lit(":"), minutes)).otherwise(minutes)


def trimmed_traceback(c: Column, lines: int = 12) -> Column:
    parts = F.split(rstrip(c), "\n", -1)
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - lines + 1, F.lit(1)), lines), "\n")
