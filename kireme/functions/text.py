"""Column functions over characters: normalization, types, escapes and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kireme.functions.arrays import running_sums

# Characters that models see in another form. Most move from ASCII to the full-width block.
_FULL_WIDTH = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789(){}<>[]/_,%?+:!&*@="
_OTHERS = {"-": "−", ".": "。", '"': "”", "'": "’", "｢": "「", "｣": "」", "～": "〜", "－": "ー", "､": "、", "―": "ー", "･": "・", "─": "ー", "–": "ー", "｡": "。"}
NORMALIZED = {**{c: chr(ord(c) + 0xFEE0) for c in _FULL_WIDTH}, **_OTHERS}

# Code point ranges of the character types, tried in this order; all else is O.
TYPE_RANGES = {
    "R": ((0x41, 0x5A), (0x61, 0x7A), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)),
    "H": ((0x3040, 0x3096),),
    "T": ((0x30A0, 0x30FA), (0x30FC, 0x30FF), (0xFF66, 0xFF9F)),
    "D": ((0x30, 0x39), (0xFF10, 0xFF19)),
    "K": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2F800, 0x2FA1F)),
}
ESCAPED = " /&\\"


def normalize(text: Column) -> Column:
    """Each character in the form that models see; one character stays one."""
    return F.translate(text, "".join(NORMALIZED), "".join(NORMALIZED.values()))


def char_type(cp: Column) -> Column:
    """Type letter of a (normalized) code point: R, H, T, D, K or O."""
    out = None
    for letter, ranges in TYPE_RANGES.items():
        hit = None
        for lo, hi in ranges:
            hit = cp.between(lo, hi) if hit is None else hit | cp.between(lo, hi)
        out = F.when(hit, letter) if out is None else out.when(hit, letter)
    return out.otherwise("O")


def _type_of(cp: int) -> str:
    return next((t for t, ranges in TYPE_RANGES.items() if any(a <= cp <= b for a, b in ranges)), "O")


def type_letters(text: Column) -> Column:
    """The type letter of each (normalized) character, as a text of as many characters.

    ASCII and what normalization changes are translated, which leaves no other ASCII letters; the other characters are replaced by ranges.
    """
    named = [*map(chr, range(0x80)), *(c for c in NORMALIZED if ord(c) >= 0x80)]
    out = F.translate(text, "".join(named), "".join(_type_of(ord(NORMALIZED.get(c, c))) for c in named))
    for letter, ranges in TYPE_RANGES.items():
        own = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges if a >= 0x80)
        out = F.regexp_replace(out, f"[{own}]", letter)
    return F.regexp_replace(out, r"[^\x{0}-\x{7F}]", "O")


def chars(text: Column) -> Column:
    """The characters of a text as an array; empty for the empty text."""
    return F.when(text != "", F.split(text, "")).when(text == "", F.expr("cast(array() as array<string>)"))


def escape_word(word: Column) -> Column:
    """The word with a backslash before each space, slash, ampersand and backslash."""
    return F.regexp_replace(word, r"([ /&\\])", r"\\$1")


def format_words(words: Column) -> Column:
    """Words of a line, escaped and joined by one space."""
    return F.array_join(F.transform(words, escape_word), " ")


def unescape(line: str, keep_empty: bool = True) -> list[str]:
    """Words of an escaped line. An unescaped space ends a word; a backslash at the end stands for itself.

    The last word is always there, even if empty, unless ``keep_empty`` is off.
    """
    words, word, at = [], [], 0
    while at < len(line):
        c = line[at]
        if c == "\\" and at + 1 < len(line):
            at += 1
            word.append(line[at])
        elif c == " ":
            words.append("".join(word))
            word = []
        else:
            word.append(c)
        at += 1
    words.append("".join(word))
    return words if keep_empty else [w for w in words if w]


def unescape_words(line: Column, keep_empty: bool = True) -> Column:
    """``unescape`` of a column, in expressions: pieces are an escaped character, a plain one or a space."""
    pieces = F.regexp_extract_all(line, F.lit(r"(?s)\\.|."), F.lit(0))
    marked = F.array_join(F.transform(pieces, lambda p: F.when(p == " ", F.lit("\x00")).when((F.length(p) == 2) & p.startswith("\\"), F.substring(p, 2, 1)).otherwise(p)), "")
    # most lines have no escapes
    words = F.when(F.contains(line, F.lit("\\")), F.split(marked, "\x00", -1)).otherwise(F.split(line, " ", -1))
    return words if keep_empty else F.filter(words, lambda w: w != "")


def boundary_offsets(words: Column) -> Column:
    """Byte offsets inside the joined words at which a word ends, without repeats."""
    ends = running_sums(F.transform(words, lambda w: F.octet_length(w).cast("long")))
    return F.array_distinct(F.slice(ends, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))


def explode_chars(lines: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """One row per character: keys, pos (from 0), ch, norm, cp (of the text), type (of the normalized one). No shuffle."""
    rows = lines.select(*keys, F.posexplode(chars(F.col(text))).alias("pos", "ch"))
    norm = normalize(F.col("ch"))
    return rows.select(*keys, "pos", "ch", norm.alias("norm"), F.ascii("ch").alias("cp"), char_type(F.ascii(norm)).alias("type"))
