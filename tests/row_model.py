"""An independent row-by-row model of the scan, for comparison on small inputs.

Plain Python, no Spark and none of the expressions under test: it shares only the fixed
tables with the library.
"""

from __future__ import annotations

import base64
import binascii
import re
import unicodedata

from glyphwarden import rules

_INJECTION = [(re.compile(p, re.I | re.S), d, rules.SEVERITY_LEVEL[s]) for p, d, s in rules.INJECTION_RULES]
_EXFIL = [(re.compile(p, re.I), d, rules.SEVERITY_LEVEL[s]) for p, d, s in rules.EXFIL_RULES]
_LEET = str.maketrans(rules.LEET_FROM, rules.LEET_TO)
NAMES = {level: name for name, level in rules.SEVERITY_LEVEL.items()}


def page_at(offset, pages):
    for number, text in pages:
        offset -= len(text) + 1
        if offset < 0:
            return number
    return None


def hits(table, category, confidence, text, pages):
    return [
        (category, description, level, m.group(), page_at(m.start(), pages), confidence)
        for regex, description, level in table for m in regex.finditer(text)
    ]


def injections(text, pages=None):
    return hits(_INJECTION, rules.CATEGORY_INJECTION, 0.95, text, pages or [(1, text)])


def exfiltrations(text, pages=None):
    return hits(_EXFIL, rules.CATEGORY_EXFIL, 0.90, text, pages or [(1, text)])


def invisibles(text):
    seen = [(f"{name} (U+{code:04X})", text.count(chr(code))) for code, name in rules.INVISIBLE_CHARS]
    total = sum(n for _, n in seen)
    if not total:
        return []
    level = 4 if total > 50 else 3 if total > 10 else 2
    label = f"Detected {total} invisible Unicode character(s) — possible steganographic payload"
    return [(rules.CATEGORY_INVISIBLE, label, level, "; ".join(f"{l}: {n}" for l, n in seen if n), None, 0.80)]


def anomalies(pages):
    found = []
    for number, text in pages:
        for line in map(str.strip, text.split("\n")):
            if len(line) > 500 and not set(".!?,;:") & set(line):
                found.append((rules.CATEGORY_ANOMALY, rules.DESCRIPTION_ANOMALY, 2, line[:120] + "...", number, 0.70))
    return found


def derived(findings, derivation, demote=0):
    prefix, off, floor = derivation
    return [(c, prefix + d, max(1, l - demote), e, p, max(floor, conf - off)) for c, d, l, e, p, conf in findings]


def disguised(text):
    found = []
    for run in re.findall(rules.BASE64_RUN, text):
        try:
            payload = base64.b64decode(run).decode("utf-8", errors="ignore")
        except binascii.Error:
            continue
        if len(payload) > 10:
            found += derived(injections(payload) + exfiltrations(payload), rules.DERIVED_BASE64, 1)
    leet = text.lower().translate(_LEET)
    if leet != text.lower():
        found += derived(injections(leet), rules.DERIVED_LEET)
    normal = unicodedata.normalize("NFKD", text)
    if normal != text:
        found += derived(injections(normal), rules.DERIVED_UNICODE)
    return found


def scan(text, pages=None, with_anomalies=True):
    pages = pages or [(1, text)]
    lines = anomalies(pages) if with_anomalies else []
    return injections(text, pages) + exfiltrations(text, pages) + invisibles(text) + lines + disguised(text)


def score(findings):
    total = 0.0
    for _, _, level, _, _, confidence in findings:
        total += rules.SEVERITY_WEIGHT[NAMES[level]] * confidence
    return int(min(total, 100))
