"""Reading form of text: one character sequence for everything that looks the same.

Two texts have the same reading form exactly if they read the same: characters that cannot be
seen, the kind of a space, full-width and joined forms, the way an accent is stored and letters of
another alphabet with the same shape make no difference; letter case, digits, accents themselves
and punctuation do. ``None`` stays ``None``; a text without a visible character becomes a text
without a visible character.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other alphabets and the Latin letter of the same shape.
LOOKALIKES = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѵ": "V", "Һ": "H", "Ԁ": "D",
    "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i",
    "ј": "j", "ѵ": "v", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    # Armenian
    "Օ": "O", "Տ": "S", "Լ": "L", "Ս": "U", "օ": "o", "ս": "u", "հ": "h", "ո": "n",
}

# Code points without a shape of their own that are not of category Cf, and the signs of category Cf that do have one.
UNSEEN = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
SEEN_FORMATS = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}

WIDTH_AND_JOINING = {"<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>"}


def _unfold(ch: str, letters: bool = True) -> str:
    """The character without width, joining, space kind and, with ``letters``, alphabet; '' if it cannot be seen."""
    code, kind = ord(ch), unicodedata.category(ch)
    if code in UNSEEN or (kind == "Cf" and code not in SEEN_FORMATS) or (kind == "Cc" and ch not in "\t\n\r\v\f\x85"):
        return ""
    if kind == "Zs":
        return " "
    parts = unicodedata.decomposition(ch).split()
    if parts and parts[0].startswith("<"):
        plain = "".join(chr(int(x, 16)) for x in parts[1:])
        joined = parts[0] == "<compat>" and kind[0] == "L" and len(plain) > 1 and plain.isalpha()
        if parts[0] in WIDTH_AND_JOINING or joined:
            return "".join(_unfold(x, letters) for x in plain)
        return ch
    if not letters:
        return ch
    if parts:
        mapped = "".join(LOOKALIKES.get(x, x) for x in unicodedata.normalize("NFD", ch))
        return unicodedata.normalize("NFC", mapped)
    return LOOKALIKES.get(ch, ch)


@lru_cache(maxsize=2)
def _table(letters: bool = True) -> tuple[dict[str, str], re.Pattern[str]]:
    """What each character that changes becomes, made by rule from the Unicode database over all its planes."""
    table = {}
    for c in range(0x110000):
        if 0xAC00 <= c < 0xE000 or 0x4E00 <= c < 0x9FFF or 0x17000 <= c < 0x18D00 or 0x20000 <= c < 0x2F800 or 0x30000 <= c < 0xE0000 or c >= 0xF0000:
            continue  # syllables, ideographs, surrogates and private characters stay as they are
        if (new := _unfold(ch := chr(c), letters)) != ch:
            table[ch] = new
    # one set for the basic plane, which matches by bitmap, and one of ranges for the others
    ranges: list[list[int]] = []
    for c in sorted(ord(x) for x in table if ord(x) > 0xFFFF):
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    beyond = "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges)
    return table, re.compile("[" + "".join(re.escape(c) for c in table if ord(c) < 0x10000) + "]|[" + beyond + "]")


def unfolded(text: str) -> str:
    """The text without width, joining, kinds of spaces, foreign look-alikes and what cannot be seen; accents as they are stored."""
    table, hit = _table()
    return hit.sub(lambda m: table[m[0]], text)


def same_alphabet_form(text: str | None) -> str | None:
    """Like ``reading_form``, but letters stay in their alphabet."""
    if text is None or text.isascii() and text.isprintable():
        return text
    table, hit = _table(False)
    text = hit.sub(lambda m: table[m[0]], text)
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def reading_form(text: str | None) -> str | None:
    """Reading form of one text (see the module)."""
    if text is None:
        return None
    text = unfolded(text)
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


# Blocks of letters and accents that the collation UNICODE tells apart as readers do: Latin, Cyrillic, kana, ideographs, Hangul.
_COLLATED = ("\x00\x7f", "\u00c0\u00d6", "\u00d8\u00f6", "\u00f8\u017e", "\u0180\u01bd", "\u01cd\u01f0", "\u01f4\u024f", "\u0300\u0304", "\u0306\u030c", "\u0400\u0481", "\u048a\u052f", "\u1e00\u1e99", "\u1ea0\u1eff", "\u3041\u3094", "\u3099\u309a", "\u30a1\u30fa", "\u4e00\u9ffc", "\uac00\ud7a3")
_OTHERS = re.compile("[^" + "".join(f"{a[0]}-{a[1]}" for a in _COLLATED) + "]")
_MARKS_IN_A_ROW = re.compile("[\u0300-\u036f\u3099\u309a]{2}")


@lru_cache(maxsize=65_536)
def _apart(ch: str) -> str:
    code = ord(ch)
    if 0xD800 <= code < 0xF900 or code > 0x1FFFF:  # private already, or in no plane with room: spelled out
        return f"\uf8fe{code:x};"
    return chr(0xF0000 + code) if code < 0x10000 else chr(0x100000 + (code & 0xFFFF))


def for_collation(text: str) -> str:
    """An unfolded text such that the collation UNICODE holds two of them equal exactly if they read the same.

    The collation compares letters and their accents in any form of storage. It also holds digits of different scripts,
    some symbols and rare letters equal, and leaves some marks out: whatever is not in ``_COLLATED`` goes to characters for private use, one each.
    """
    if not _OTHERS.search(text) and not _MARKS_IN_A_ROW.search(text):
        return text
    return _OTHERS.sub(lambda m: _apart(m[0]), unicodedata.normalize("NFC", text))


def reading_form_col(col: Column | str) -> Column:
    """Reading form of a column, over Arrow batches; null stays null."""

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.map(reading_form, na_action="ignore")

    return form(F.col(col) if isinstance(col, str) else col)


def has_visible(col: Column) -> Column:
    """Whether a reading form holds anything but white space."""
    return F.regexp_like(col, F.lit(r"[^\p{Z}\s\x85]"))


def reading_form_sql(column: str) -> str:
    """The same in DuckDB's SQL, to check results with; of the characters that become several, only Latin ones are unfolded there."""
    table, _ = _table()
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    one = {c: new for c, new in table.items() if len(new) == 1}
    gone = [c for c, new in table.items() if not new and c != "\x00"]
    sql = f"translate({column}, {quoted(''.join([*one, *gone]))}, {quoted(''.join(one.values()))})"
    for c, new in table.items():
        if len(new) > 1 and new.isascii():
            sql = f"replace({sql}, {quoted(c)}, {quoted(new)})"
    return f"nfc_normalize({sql})"
