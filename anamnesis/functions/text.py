"""Text functions of the memory store, as column expressions.

Lengths are counted in code points. White space is Unicode's, not only ASCII's: the
classes below name it, so that full-width blanks and byte order marks fold like others.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
FOLDED = r"[\t\n\x0B\f\r\p{Z}\x{FEFF}\p{P}\p{S}]+"
BLANKS = r"[\t\n\x0B\f\r\p{Z}\x{FEFF}]+"
QUERY_SPLIT = "[" + r"\t\n\x0B\f\r\p{Z}\x{FEFF}" + ",，。.!！?？：:；;、（）()\\[\\]{}「」“”‘’'\"" + "]+"
MAX_TERMS = 12
REDACTIONS = (
    (r"LTAI[A-Za-z0-9]{12,20}", "[redacted-aliyun-ak]"),
    (r"sk-[A-Za-z0-9]{16,}", "[redacted-sk]"),
    (r"ghp_[A-Za-z0-9]{20,}", "[redacted-ghp]"),
    (r"github_pat_[A-Za-z0-9_]{20,}", "[redacted-gh-pat]"),
)
#: A label before a key; the label stays. Lookbehind of changing width doesn't work here.
LABELLED_KEY = r"(?im)(access ?key(?: ?secret)?(?:是|=|:)\s*)[A-Za-z0-9]{24,40}(?=\s|$)"
LABELLED_TO = "$1[redacted-key]"
ENVELOPE_LINES = (
    r"^\*{0,2}注入(画像|记忆)[\*\s\d条：:]",
    r"^\d+[\.、]\s+#\d+\s+\((fact|preference|knowledge|lesson|skill_index)\)",
    r"^[_（(\*]*本对话已注入过的",
    r"^Use the above when it helps",
)
ENVELOPE_HINTS = ("注入", "Use the above")
INLINE_IMAGE = r"data:image/[a-zA-Z0-9+]+;base64,[A-Za-z0-9+/=\s]{200,}"
CODE_FENCE = r"(?s)```[a-zA-Z]*\n.*?```"
IMAGE_MARK, CODE_MARK = "[图片]", "[代码块]"
GROUNDING_TOKEN = r"[一-鿿]{2,}|[A-Za-z0-9]{4,}"


#: Characters without which a text is composed already: marks, the letters of Hangul syllables, and those
#: that have another canonical form.
COMPOSABLE = (
    r"[\p{M}\x{374}\x{37E}\x{387}\x{958}-\x{95F}\x{9DC}-\x{9DF}\x{A33}-\x{A5E}\x{B5C}\x{B5D}\x{F43}-\x{F69}\x{1100}-\x{11FF}"
    r"\x{1F71}-\x{1FFD}\x{2000}\x{2001}\x{2126}-\x{212B}\x{2329}\x{232A}\x{2ADC}\x{F900}-\x{FAFF}\x{FB1D}-\x{FB4E}\x{10000}-\x{10FFFF}]"
)

#: Characters before these are composed already.
BEYOND_LATIN = r"[^\x{0}-\x{2FF}]"


@F.pandas_udf(StringType())
def _composed(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else unicodedata.normalize("NFC", v))


def nfc(text: Column) -> Column:
    """Canonical composition. Spark has no built-in function for it, so the few texts that it can change go
    through Python. Cheap tests come first: most texts are ASCII, and most others have no mark or later letter."""
    changes = (F.octet_length(text) != F.length(text)) & text.rlike(BEYOND_LATIN) & text.rlike(COMPOSABLE)
    return F.coalesce(_composed(F.when(changes, text)), text)


def digest(content: Column) -> Column:
    """Fingerprint of a content: case, white space, punctuation and symbols don't count."""
    return F.sha2(F.regexp_replace(F.lower(nfc(content)), FOLDED, ""), 256)


def scrub(text: Column) -> Column:
    """Known shapes of access keys replaced by placeholders."""
    for pattern, mark in REDACTIONS:
        text = F.regexp_replace(text, pattern, mark)
    return F.regexp_replace(text, LABELLED_KEY, LABELLED_TO)


def query_terms(query: Column) -> Column:
    """Up to twelve terms of at least two characters."""
    parts = F.filter(F.split(query, QUERY_SPLIT), lambda t: F.length(t) >= 2)
    return F.slice(parts, 1, MAX_TERMS)


def terms_of(query: str) -> list[str]:
    """``query_terms`` of one query, on the driver."""
    blanks = "\\s﻿"
    parts = re.split(f"[{blanks},，。.!！?？：:；;、（）()\\[\\]{{}}「」“”‘’'\"]+", query)
    return [p for p in parts if len(p) >= 2][:MAX_TERMS]


def clip(text: Column, size: int) -> Column:
    """Cut to ``size`` characters, with a mark where something was cut."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("…"))).otherwise(text)


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, " ")


def strip(text: Column) -> Column:
    """Without white space at the ends, Unicode's included."""
    return F.regexp_replace(text, f"^{BLANKS}|{BLANKS}$", "")


def strip_envelope(text: Column) -> Column:
    """Without lines that an injected card left in a transcript."""
    own = lambda line: ~strip(line).rlike("|".join(f"(?:{p})" for p in ENVELOPE_LINES))
    suspect = F.lit(False)
    for hint in ENVELOPE_HINTS:
        suspect |= text.contains(hint)
    return F.when(suspect, F.array_join(F.filter(F.split(text, "\n", -1), own), "\n")).otherwise(text)


def clean(text: Column) -> Column:
    """Inline images and fenced code as placeholders."""
    text = F.regexp_replace(text, INLINE_IMAGE, IMAGE_MARK)
    return strip(F.regexp_replace(text, CODE_FENCE, CODE_MARK))


def grounded(gist: Column, source: Column) -> Column:
    """Whether some token of the gist occurs in its source as it is."""
    tokens = F.regexp_extract_all(gist, F.lit(GROUNDING_TOKEN), F.lit(0))
    return F.exists(tokens, lambda t: source.contains(t))


def theme_name(theme: Column) -> Column:
    return F.trim(F.replace(F.coalesce(theme, F.lit("")), F.lit("/"), F.lit("-")))


def handle(mini: Column, summary: Column) -> Column:
    """What a listing shows for a memory."""
    return F.coalesce(F.nullif(mini, F.lit("")), clip(summary, 60))


def status_label(status: Column) -> Column:
    """A note for memories that aren't active."""
    return (
        F.when(status == "absorbed", "absorbed into a profile")
        .when(status == "superseded", "superseded by a newer memory")
        .when(status == "archived", "archived")
        .otherwise("")
    )


def head_and_tail(text: Column, size: int = 100_000, end: int = 50_000) -> Column:
    """A text of more than ``size`` characters as its two ends, with what is left out named."""
    left = F.length(text) - 2 * end
    mark = F.concat(F.lit("\n…["), left.cast("string"), F.lit(" chars omitted]…\n"))
    short = F.concat(F.substring(text, 1, end), mark, F.right(text, F.lit(end)))
    return F.when(F.length(text) > size, short).otherwise(text)
