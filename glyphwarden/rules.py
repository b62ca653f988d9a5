"""Rule tables and other fixed values.

Everything in the first part of this module is a fixed value: results only agree
with other producers of the same findings if these patterns, texts, numbers and
their order are exactly these. The second part derives the engine dialects
(Java regular expressions for Spark, RE2 for Arrow and DuckDB) from them.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

# --------------------------------------------------------------------------
# Fixed values: (pattern, description, severity), in reporting order.
# --------------------------------------------------------------------------

INJECTION_RULES = [
    (r"ignore\s+(?:all\s+)?previous\s+instructions", "Prompt override — ignore previous instructions", "CRITICAL"),
    (r"system\s+override", "System override command detected", "CRITICAL"),
    (r"you\s+are\s+now\s+.{1,80}\s+and\s+must", "Identity reassignment injection", "CRITICAL"),
    (r"pretend\s+you\s+are", "Identity manipulation attempt", "HIGH"),
    (r"disregard\s+(?:your|the)\s+(?:system|safety)\s+(?:prompt|instructions)", "Safety bypass attempt", "CRITICAL"),
    (r"new\s+priority\s+(?:directive|instruction)", "Priority directive injection", "HIGH"),
    (r"from\s+now\s+on,?\s+(?:you\s+will|you\s+must)", "Behavioral override attempt", "HIGH"),
    (r"override\s+(?:all|the)\s+(?:previous|system)\s+(?:prompts?|instructions?)", "System prompt override", "CRITICAL"),
    (r"forget\s+(?:your|the)\s+(?:previous|system)\s+(?:prompt|instructions)", "Memory wipe injection", "CRITICAL"),
    (r"do\s+not\s+follow\s+(?:your|the|any)\s+(?:original|previous|system)", "Instruction negation detected", "HIGH"),
    (r"act\s+as\s+(?:if|though)\s+you\s+(?:have|are)", "Role manipulation attempt", "MEDIUM"),
    (r"respond\s+only\s+with", "Output constraint injection", "MEDIUM"),
    (r"execute\s+(?:the\s+following|this)\s+(?:command|code|instruction)", "Command execution injection", "HIGH"),
    (r"do\s+not\s+mention\s+(?:this|these)\s+instruction", "Stealth directive — hides its own presence", "CRITICAL"),
    (r"(?:secret|hidden)\s+(?:instruction|directive|command)", "Self-labeled hidden instruction", "HIGH"),
    (r"as\s+an?\s+(?:AI|language\s+model|LLM),?\s+(?:you\s+must|you\s+will|you\s+should)", "AI persona constraint injection", "HIGH"),
    (r"(?:jailbreak|dan\s+mode|developer\s+mode|unrestricted\s+mode)", "Jailbreak mode activation attempt", "CRITICAL"),
    (r"(?:ignore|bypass|skip)\s+(?:all\s+)?(?:safety|content|ethical)\s+(?:guidelines|filters|restrictions)", "Safety filter bypass attempt", "CRITICAL"),
    (r"print\s+(?:the\s+)?(?:above|full|entire|complete)\s+(?:prompt|system\s+prompt|instructions)", "System prompt extraction attempt", "HIGH"),
]

EXFIL_RULES = [
    (r"!\[\]\(https?://[^\s\)]+\)", "Markdown image exfiltration (zero-pixel tracking)", "CRITICAL"),
    (r"https?://[^\s]*?(?:email|data|token|secret|password|key|ssn|credit)\s*=", "Exfiltration URL with sensitive data parameter", "CRITICAL"),
    (r"https?://[^\s]*?(?:leak|steal|exfil|capture|log|collect)\b", "Suspicious exfiltration endpoint URL", "HIGH"),
    (r"fetch\s+(?:the\s+)?(?:url|image|resource)\s+(?:at|from)\s+https?://", "Fetch instruction targeting remote URL", "HIGH"),
    (r"send\s+(?:the|all|any)\s+(?:data|information|content|text)\s+to\s+https?://", "Data exfiltration send instruction", "CRITICAL"),
    (r"include\s+.{0,40}as\s+(?:url|query)\s+parameters?", "URL parameter stuffing instruction", "HIGH"),
    (r"(?:webhook|callback|notify)\s+(?:url|endpoint)\s*[:=]\s*https?://", "Webhook callback injection", "HIGH"),
]

# Code point and name of each invisible character; evidence label "Name (U+XXXX)".
INVISIBLE_CHARS = [
    (0x200B, "Zero-Width Space"),
    (0x200C, "Zero-Width Non-Joiner"),
    (0x200D, "Zero-Width Joiner"),
    (0x200E, "Left-to-Right Mark"),
    (0x200F, "Right-to-Left Mark"),
    (0x2060, "Word Joiner"),
    (0x2061, "Function Application"),
    (0x2062, "Invisible Times"),
    (0x2063, "Invisible Separator"),
    (0x2064, "Invisible Plus"),
    (0xFEFF, "Zero-Width No-Break Space / BOM"),
    (0x00AD, "Soft Hyphen"),
    (0x034F, "Combining Grapheme Joiner"),
    (0x061C, "Arabic Letter Mark"),
    (0x180E, "Mongolian Vowel Separator"),
]

METADATA_FIELDS = ["Title", "Author", "Subject", "Creator", "Producer"]
PROPERTY_FIELDS = ["title", "author", "subject", "description", "keywords", "category"]
METADATA_KEYWORDS = [
    "ignore", "override", "inject", "instruction", "prompt", "execute", "fetch", "disregard",
    "forget", "pretend", "exfil", "http://", "https://", "system", "jailbreak",
]

# Character substitutions: each character on the left reads as the one below it.
LEET_FROM = "013457@$!+869"
LEET_TO = "oieastasitbgg"

SEVERITY_LEVEL = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
SEVERITY_WEIGHT = {"LOW": 5, "MEDIUM": 15, "HIGH": 30, "CRITICAL": 50}
BLOCK_THRESHOLD = 30

# Upload suffix -> (scanner kind, format label the scanner reports).
FORMATS = [
    (".pdf", "paged", "pdf"),
    (".docx", "parts", "docx"),
    (".doc", "parts", "docx"),
    (".xlsx", "cells", "xlsx"),
    (".xls", "cells", "xlsx"),
    (".html", "html", "html"),
    (".htm", "html", "html"),
    (".txt", "plain", "txt"),
    (".md", "plain", "md"),
    (".csv", "plain", "csv"),
]

BASE64_RUN = r"[A-Za-z0-9+/]{40,}={0,2}"
HIDDEN_STYLE = r"display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0"

CATEGORY_INJECTION = "Prompt Injection"
CATEGORY_EXFIL = "Data Exfiltration"
CATEGORY_INVISIBLE = "Hidden Characters"
CATEGORY_METADATA = "Metadata Injection"
CATEGORY_METADATA_KEYWORD = "Suspicious Metadata"
CATEGORY_ANOMALY = "Text Anomaly"
CATEGORY_FORMULA = "Formula Injection"
CATEGORY_HIDDEN_HTML = "Hidden HTML Content"

CONFIDENCE_INJECTION = 0.95
CONFIDENCE_EXFIL = 0.90
CONFIDENCE_INVISIBLE = 0.80
CONFIDENCE_METADATA = 0.90
CONFIDENCE_METADATA_KEYWORD = 0.60
CONFIDENCE_PROPERTY = 1.0
CONFIDENCE_ANOMALY = 0.70
CONFIDENCE_FORMULA = 0.7
CONFIDENCE_HIDDEN_HTML = 0.85

# (description prefix, confidence taken off, confidence floor)
DERIVED_BASE64 = ("[Base64-decoded] ", 0.2, 0.5)
DERIVED_LEET = ("[L33t-decoded] ", 0.3, 0.4)
DERIVED_UNICODE = ("[Unicode-normalized] ", 0.25, 0.4)

DESCRIPTION_ANOMALY = "Unusually long unpunctuated text — potential hidden payload"
DESCRIPTION_FORMULA = "Spreadsheet formula — potential DDE/macro injection vector"
DESCRIPTION_HIDDEN_HTML = "Text hidden via CSS — possible invisible injection payload"
DESCRIPTION_PROPERTY_PREFIX = "Injection in DOCX property: "

# (key, name, icon, description)
BADGES = [
    ("first_scan", "First Scan", "🔍", "Complete your first document scan"),
    ("threat_hunter", "Threat Hunter", "🎯", "Catch 10 total threats across all scans"),
    ("security_analyst", "Security Analyst", "🛡️", "Complete 50 scans"),
    ("veteran", "Veteran", "⚔️", "Complete 200 scans"),
    ("eagle_eye", "Eagle Eye", "🦅", "Find your first CRITICAL threat"),
    ("clean_slate", "Clean Slate", "✨", "Scan 5 consecutive clean documents"),
    ("format_explorer", "Format Explorer", "📂", "Scan 3 different file formats"),
    ("api_master", "API Master", "🔑", "Generate your first API key"),
]
BADGE_FALLBACK_ICON = "🏅"
SCAN_MILESTONES = {"first_scan": 1, "security_analyst": 50, "veteran": 200}
THREAT_HUNTER_TOTAL = 10
FORMAT_EXPLORER_DISTINCT = 3
CLEAN_SLATE_RUN = 5

RISK_BUCKETS = ["0-19", "20-39", "40-59", "60-79", "80-100"]

# --------------------------------------------------------------------------
# Derived dialects.
# --------------------------------------------------------------------------

# What counts as white space in rule texts, strip and the like: the Unicode
# White_Space characters plus the four ASCII separators U+001C..U+001F. Spelled
# out because Java, RE2 and Python disagree about a bare \s.
WHITESPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Folded to "i" by the case-insensitive rules, but not by every engine.
FOLDED = {"i": "ıİ"}
WHITESPACE_CHARS = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())


def explicit_whitespace(pattern: str) -> str:
    """Spell out every whitespace class of a rule pattern."""
    pattern = pattern.replace(r"[^\s\)]", rf"[^{WHITESPACE}\)]").replace(r"[^\s]", rf"[^{WHITESPACE}]")
    return pattern.replace(r"\s", f"[{WHITESPACE}]")


def java_pattern(pattern: str, dotall: bool) -> str:
    """Rule pattern for Spark: Unicode case folding; '.' stops at newline only, or nowhere."""
    body = explicit_whitespace(pattern).replace(r"\b", r"(?![\p{L}\p{N}_])")
    return f"(?ius){body}" if dotall else f"(?iud){body}"


def re2_pattern(pattern: str) -> str:
    """Rule pattern for an RE2 engine; flags are given separately there."""
    return explicit_whitespace(pattern)


def screen_pattern(pattern: str, lookalikes: dict[str, str]) -> str:
    """A cheap RE2 pattern that hits at least every text the rule hits.

    Counted runs become plain runs and the word boundary is dropped, so the automaton
    stays small. Every character also accepts its lookalikes, so that one look at the
    original text covers the readings with characters exchanged as well.
    """
    body = re.sub(r"\.\{\d+,\d+\}", "(?s:.)*", pattern.replace(r"\b", ""))
    parts = re.split(r"(\\.|\(\?[s]?[.:]?|\[[^\]]*\])", body)
    for position, part in enumerate(parts):
        if position % 2 == 0:
            parts[position] = "".join(
                f"[{ch}{lookalikes[ch.lower()]}]" if ch.lower() in lookalikes else ch for ch in part
            )
    return "(?i)" + explicit_whitespace("".join(parts))


def _leet_lookalikes() -> dict[str, str]:
    lookalikes = dict(FOLDED)
    for source, target in zip(LEET_FROM, LEET_TO):
        lookalikes[target] = lookalikes.get(target, "") + source
    return lookalikes


@cache
def decomposing_class() -> str:
    """Class of the characters whose NFKD form brings in a letter, comma or space of ASCII.

    A text without any of them, and without a hit as it stands, has no hit in its
    normalised reading: whatever else normalisation does can only break a match up.
    """
    ranges: list[list[int]] = []
    for code in range(128, 0x20000):  # no character beyond decomposes to ASCII
        normal = unicodedata.normalize("NFKD", chr(code))
        if normal != chr(code) and any(c.isascii() and (c.isalpha() or c.isspace() or c == ",") for c in normal):
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return "[" + "".join(f"\\x{{{first:x}}}-\\x{{{last:x}}}" for first, last in ranges) + "]"


INJECTION_JAVA = [java_pattern(pattern, dotall=True) for pattern, _, _ in INJECTION_RULES]
EXFIL_JAVA = [java_pattern(pattern, dotall=False) for pattern, _, _ in EXFIL_RULES]
INJECTION_SCREEN = [screen_pattern(pattern, _leet_lookalikes()) for pattern, _, _ in INJECTION_RULES]
EXFIL_SCREEN = [screen_pattern(pattern, FOLDED) for pattern, _, _ in EXFIL_RULES]
# Markup that may hide an element: the style as written, or with a character reference somewhere.
HIDDEN_SCREEN = f"{screen_pattern(HIDDEN_STYLE, FOLDED)}|&"
# A stretch of more than 500 characters without a line end or punctuation. It may only
# start behind one of those, which keeps the search linear.
PUNCTUATION = ".!?,;:"
LONG_STRETCH = rf"(?:\A|[\n{PUNCTUATION}])[^\n{PUNCTUATION}]{{501}}"
INVISIBLE_CLASS = "[" + "".join(chr(code) for code, _ in INVISIBLE_CHARS) + "]"


def _rule_words() -> tuple[list[str], list[str]]:
    """(words a rule can start with, all words of all rules), optional endings both ways."""
    starts, words = set(), set()
    for pattern, _, _ in INJECTION_RULES + EXFIL_RULES:
        plain = re.sub(r"\\[a-zA-Z]", " ", pattern)
        found = re.findall(r"[A-Za-z]+\??", plain)
        expanded = [w for word in found for w in ({word.rstrip("?"), word[:-2]} if word.endswith("?") else {word})]
        words.update(w.lower() for w in expanded if w)
        head = re.match(r"\(\?:([^)]*)\)|([A-Za-z]+)", pattern)
        if head:
            starts.update(alternative.split("\\s")[0].lower() for alternative in (head.group(1) or head.group(2)).split("|"))
    # Rule X02 may break before its equals sign, behind a word that ends an address.
    starts.update("email data token secret password key ssn credit".split())
    return sorted(starts), sorted(words)


def open_end_pattern() -> str:
    """Java pattern: a text (stripped at its end) that a match may continue behind.

    A match only crosses white space behind one of the rules' own words: a whole word,
    or, for the first word of a rule, the end of one. The substituted reading counts too.
    """
    lookalikes = _leet_lookalikes()

    def spelled(word: str) -> str:
        return "".join(f"[{ch}{lookalikes[ch]}]" if ch in lookalikes else ch for ch in word)

    starts, words = _rule_words()
    return (
        f"(?iu)(?:(?:\\A|[{WHITESPACE}])(?:{'|'.join(map(spelled, words))})|(?:{'|'.join(map(spelled, starts))})),?\\z"
        "|[:=]\\z"
    )


OPEN_END = open_end_pattern()
# The only run that may hide a line end is the one behind "now" (at most 80 characters).
LOOSE_RUN_WORD = "(?iu)n[o0]w"
LOOSE_RUN_LENGTH = 80
