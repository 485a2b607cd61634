"""Extended grapheme clusters (Unicode UAX #29, with the rule for Indic conjuncts) as dataflow.

Each code point has a class: the break property, split where a rule asks for more (conjunct consonants and linkers,
pictographs). Rules that look at more than two neighbours (flags, joined pictographs, conjuncts) mark the place they
decide; after that a gap is decided by the classes on its two sides. The column functions do so on a string of class
letters as long as the text and stay in expressions; ``breaks`` does it on arrays for the Arrow scorers; ``Breaker`` code
point by code point. Classes are made from general categories and the short lists of the standard.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kireme.functions.arrays import let, running_sums

#: Values of the Grapheme_Cluster_Break property.
BREAKS = ("Other", "CR", "LF", "Control", "Extend", "ZWJ", "Regional_Indicator", "Prepend", "SpacingMark", "L", "V", "T", "LV", "LVT")
#: Class letters and their break property. B: extending, but not inside conjuncts; D: linker; K: conjunct consonant; X: pictograph.
CLASSES = {"O": "Other", "R": "CR", "N": "LF", "C": "Control", "E": "Extend", "B": "Extend", "D": "Extend", "Z": "ZWJ", "I": "Regional_Indicator", "P": "Prepend", "S": "SpacingMark", "L": "L", "V": "V", "T": "T", "G": "LV", "H": "LVT", "K": "Other", "X": "Other"}
CODES = {c: i for i, c in enumerate(CLASSES)}

# Fixed values (hexadecimal ranges): the lists of the standard that general categories do not give.
OTHER_EXTEND = "9BE 9D7 B3E B57 BBE BD7 CC0 CC2 CC7-CC8 CCA-CCB CD5-CD6 D3E D57 DCF DDF 1715 1734 1B35 1B3B 1B3D 1B43-1B44 1BAA 1BF2-1BF3 200C 302E-302F A953 A9C0 FF9E-FF9F 111C0 11235 1133E 1134D 11357 113B8 113C2 113C5 113C7-113C9 113CF 114B0 114BD 115AF 116B6 11930 1193D 11F41 16FF0-16FF1 1D165-1D166 1D16D-1D172 1F3FB-1F3FF E0020-E007F"
PREPEND = "600-605 6DD 70F 890-891 8E2 D4E 110BD 110CD 111C2-111C3 113D1 1193F 11941 11A84-11A89 11D46 11F02"
NO_MARK = "102B-102C 1038 1062-1064 1067-106D 1083 1087-108C 108F 109A-109C 1A61 1A63-1A64 AA7B AA7D 11720-11721"
OTHER_MARK = "E33 EB3"
# characters that later versions added to the marks
NEWER_EXTEND = "5C8-5C9 897 B53-B54 1ACF-1AF0 10D69-10D6D 10ECB-10ECF 10EF0-10EFC 113BB-113C0 113CE 113D0 113D2 113E1-113E2 11B60 11B62-11B64 11B66 11DF0 11F5A 1611E-16129 1612D-1612F 1D127-1D128 1D250-1D252 1D25B-1D25C 1D25F 1D280-1D281 1E5EE-1E5EF 1E6E3 1E6E6 1E6EE-1E6EF 1E6F5"
NEWER_MARK = "113B9-113BA 113CA 113CC-113CD 1171E 11B61 11B65 11B67 1612A-1612C"
IGNORABLE = "2065 FFF0-FFF8 E0000-E001F E0080-E00FF E01F0-E0FFF"
LINKER = "94D 9CD ACD B4D C4D D4D"
CONSONANT = "915-939 958-95F 978-97F 995-9A8 9AA-9B0 9B2 9B6-9B9 9DC-9DD 9DF 9F0-9F1 A95-AA8 AAA-AB0 AB2-AB3 AB5-AB9 AF9 B15-B28 B2A-B30 B32-B33 B35-B39 B5C-B5D B5F B71 C15-C28 C2A-C39 C58-C5A D15-D3A"
JAMO = {"L": "1100-115F A960-A97C", "V": "1160-11A7 D7B0-D7C6 16D63 16D67-16D6A", "T": "11A8-11FF D7CB-D7FB"}
PICTOGRAPH = (
    "A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 2388 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6 25C0 25FB-25FE 2600-2605 2607-2612 2614-2685 2690-2705 2708-2712 2714 2716 271D 2721 2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2767 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 "
    "1F000-1F0FF 1F10D-1F10F 1F12F 1F16C-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F1AD-1F1E5 1F201-1F20F 1F21A 1F22F 1F232-1F23A 1F23C-1F23F 1F249-1F3FA 1F400-1F53D 1F546-1F64F 1F680-1F6FF 1F774-1F77F 1F7D5-1F7FF 1F80C-1F80F 1F848-1F84F 1F85A-1F85F 1F888-1F88F 1F8AE-1F8FF 1F90C-1F93A 1F93C-1F945 1F947-1FAFF 1FC00-1FFFD"
)


def _points(ranges: str) -> np.ndarray:
    bounds = [[int(x, 16) for x in r.split("-")] for r in ranges.split()]
    return np.concatenate([np.arange(b[0], b[-1] + 1) for b in bounds])


@cache
def properties() -> np.ndarray:
    """The class code of every code point."""
    out = np.zeros(0x110000, np.uint8)
    category = np.array([unicodedata.category(chr(c)) for c in range(0x110000)])
    put = lambda where, letter: out.__setitem__(where, CODES[letter])
    put(_points(PICTOGRAPH), "X")
    put(_points(CONSONANT), "K")
    put(np.isin(category, ["Zl", "Zp", "Cc", "Cf"]), "C")
    put(_points(IGNORABLE), "C")
    put(category == "Mc", "S")
    put(_points(OTHER_MARK), "S")
    put(_points(NO_MARK), "O")
    put(np.isin(category, ["Mn", "Me"]), "E")
    put(_points(OTHER_EXTEND), "E")
    put(_points(NEWER_EXTEND), "E")
    put(_points(NEWER_MARK), "S")
    put(_points(PREPEND), "P")
    put(np.array([0x200C]), "B")
    put(_points(LINKER), "D")
    for letter, ranges in JAMO.items():
        put(_points(ranges), letter)
    syllables = np.arange(0xAC00, 0xD7A4)
    put(syllables, "H")
    put(syllables[(syllables - 0xAC00) % 28 == 0], "G")
    put(np.arange(0x1F1E6, 0x1F200), "I")
    put(np.array([0x200D]), "Z")
    put(np.array([0x0D]), "R")
    put(np.array([0x0A]), "N")
    return out


@cache
def simple() -> np.ndarray:
    """Code points that are a cluster of their own whatever stands beside them: only these, and the text needs no rules."""
    return np.isin(properties(), [CODES[c] for c in "OCNKX"])


def property_table(spark: SparkSession) -> DataFrame:
    """Runs of equal properties: lo, hi, gcb, incb (conjunct property), pictographic."""
    p, letters = properties(), [*CLASSES]
    starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    ends = np.concatenate([starts[1:] - 1, [len(p) - 1]])
    conjunct = {"K": "Consonant", "D": "Linker", "E": "Extend", "Z": "Extend"}
    rows = [(int(a), int(b), CLASSES[letters[p[a]]], conjunct.get(letters[p[a]], "None"), letters[p[a]] == "X") for a, b in zip(starts, ends, strict=True)]
    return spark.createDataFrame(rows, "lo int, hi int, gcb string, incb string, pictographic boolean")


# Marks that rules leave: J a joiner after a pictograph, M an extender before a consonant that it joins, i a second indicator.
_JOINED = [("R", "N"), ("L", "LVGH"), ("GV", "VT"), ("HT", "T"), ("J", "X"), ("M", "K")]
_ALWAYS = "EBDZSJMi"


@cache
def _joins() -> np.ndarray:
    """Whether no gap is a break, by the codes of both sides; marks have codes after those of classes."""
    codes = CODES | {c: len(CODES) + k for k, c in enumerate("JMi")}
    out, hard = np.zeros((len(codes), len(codes)), bool), [codes[c] for c in "RNC"]
    out[:, [codes[c] for c in _ALWAYS]] = True
    out[codes["P"], :] = True
    out[hard, :] = out[:, hard] = False
    for left, right in _JOINED:
        for a in left:
            out[codes[a], [codes[b] for b in right]] = True
    return out


def breaks(cps: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """Whether a cluster starts at each code point; ``starts`` are places where texts start (always a break, and no rule looks across)."""
    n = len(cps)
    if not n:
        return np.zeros(0, bool)
    c = properties()[cps].astype(np.int64)
    fresh = np.zeros(n, bool)
    fresh[0] = True
    if starts is not None:
        fresh[starts[starts < n]] = True
    place = np.arange(n)

    def run_start(inside: np.ndarray) -> np.ndarray:
        """Where the run of ``inside`` (in one text) that ends at each place starts; place + 1 outside."""
        opened = inside & (fresh | ~np.append(False, inside[:-1]))
        return np.where(inside, np.maximum.accumulate(np.where(opened, place, -1)), place + 1)

    # flags: every second indicator of a run belongs to the one before
    flag = c == CODES["I"]
    second = flag & ((place - run_start(flag)) % 2 == 1)
    # a joiner whose extenders follow a pictograph
    soft = np.isin(c, [CODES[x] for x in "EBD"])
    soft_from = run_start(soft)
    z = np.flatnonzero((c == CODES["Z"]) & ~fresh)
    before = np.where(soft[z - 1], soft_from[z - 1] - 1, z - 1)
    before = np.where((before >= 0) & (np.maximum.accumulate(np.where(fresh, place, 0))[z] <= before), before, -1)
    joiner = z[(before >= 0) & (c[np.maximum(before, 0)] == CODES["X"])]
    # extenders between two consonants with a linker among them
    inner = np.isin(c, [CODES[x] for x in "EDZ"])
    inner_from = run_start(inner)
    links = np.append(0, np.cumsum(c == CODES["D"]))
    k = np.flatnonzero((c == CODES["K"]) & ~fresh)
    k = k[inner[k - 1]]
    first = inner_from[k - 1]
    k, first = k[~fresh[first]], first[~fresh[first]]
    k = k[(c[first - 1] == CODES["K"]) & (links[k] > links[first])]
    c[second] = len(CODES) + 2
    c[joiner] = len(CODES)
    c[k - 1] = len(CODES) + 1
    out = np.append(True, ~_joins()[c[:-1], c[1:]])
    out[fresh] = True
    return out


def cluster_starts(text: str) -> np.ndarray:
    """Code point index of each cluster's start."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.arange(len(cps)) if simple()[cps].all() else np.flatnonzero(breaks(cps))


def clusters(text: str) -> list[str]:
    at = [*cluster_starts(text).tolist(), len(text)]
    return [text[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


class Breaker:
    """Clusters code point by code point: ``next`` tells whether one starts here, given all that came since ``reset``."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.last: str | None = None
        self.picture = self.joined = self.odd = self.consonant = self.linked = False

    def next(self, cp: int) -> bool:
        c = [*CLASSES][properties()[cp]] if cp < 0x110000 else "O"
        a, code = self.last, CODES
        left = None if a is None else code[a]
        if a is None:
            start = True
        elif (a == "Z" and self.joined and c == "X") or (self.consonant and self.linked and c == "K") or (a == "I" and c == "I" and self.odd):
            start = False
        else:
            start = not _joins()[left, code[c]]
        # what the rules remember: a picture with its extenders, a joiner after it, the parity of a flag, an open conjunct
        self.joined = c == "Z" and self.picture
        self.picture = c == "X" or (self.picture and c in "EBD")
        self.odd = c == "I" and not (a == "I" and self.odd)
        self.linked = c != "K" and self.consonant and (self.linked or c == "D")
        self.consonant = c == "K" or (self.consonant and c in "EDZ")
        self.linked &= self.consonant
        self.last = c
        return start


@cache
def _translation() -> tuple[str, str]:
    """Characters that have a class letter and these letters; capital letters of a text become a plain character first."""
    p, letters = properties(), np.array([*CLASSES])
    named = np.flatnonzero(p != CODES["O"])
    named = named[(named < 0xD800) | (named > 0xDFFF)]
    used = "".join(sorted({*CLASSES} - {"O"} | {*"JMi"}))
    return used + "".join(map(chr, named.tolist())), "o" * len(used) + "".join(letters[p[named]].tolist())


@cache
def _needs_rules() -> str:
    """A pattern of the characters that can join others."""
    p = properties()
    hard = np.flatnonzero(~simple())
    hard = hard[(hard < 0xD800) | (hard > 0xDFFF)]
    cut = np.flatnonzero(np.diff(hard) > 1)
    assert p[hard].all()
    ranges = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(hard[np.append(0, cut + 1)].tolist(), hard[np.append(cut, len(hard) - 1)].tolist(), strict=True))
    # most characters are told from them by one comparison
    assert hard[0] == 0x0D and hard[1] >= 0x300
    return f"(?:(?=[^\\x{{0}}-\\x{{C}}\\x{{E}}-\\x{{2FF}}\\x{{3100}}-\\x{{A66E}}])[{ranges}])"


def class_letters(text: Column) -> Column:
    """The class letter of each character, as a text of as many characters; any other letter there is class O."""
    return F.translate(text, *_translation())


def marked_letters(text: Column) -> Column:
    """Class letters with the marks of the rules that look further than one neighbour."""
    c = F.regexp_replace(class_letters(text), "II", "Ii")
    c = F.regexp_replace(c, "(X[EBD]*+)Z", "$1J")
    # the last extender is marked if a linker is among them and a consonant follows
    return F.regexp_replace(c, "(?=K[EZ]*+D)(K[EDZ]*)[EDZ](?=K)", "$1M")


_GAP = "(?<=.)(?=.)(?!" + "|".join([f"(?<=[^RNC])[{_ALWAYS}]", "(?<=P)[^RNC]", *(f"(?<=[{a}])[{b}]" for a, b in _JOINED)]) + ")"


#: Characters that a piece has in the mean at least; texts of smaller ones are one piece, as a piece's rules cost more than its characters.
LEAST_CHARS = 32
#: Put between the pieces of a text; texts that hold it are one piece.
_MARK = "\uffff"


def _pieces(text: Column) -> Column:
    """Pieces of a text: stretches of characters that join others, with another character on each side, and what is between them.

    Two characters that join nothing are always parted, and no rule looks beyond such a gap, so pieces have clusters of their own.
    """
    hard, plain = _needs_rules(), f"(?:(?!{_needs_rules()}).)"
    # what is rare is asked first
    cut = F.regexp_replace(text, f"(?s)(?=..{hard})({plain})(?={plain})", f"$1{_MARK}")
    cut = F.regexp_replace(cut, f"(?s)({hard}{plain})(?={plain})", f"$1{_MARK}")
    few = let(F.split(cut, _MARK, -1), lambda ps: F.when(F.size(ps) * LEAST_CHARS > F.char_length(text), F.array(text)).otherwise(ps))
    return F.when(~text.rlike(_needs_rules()) | F.contains(text, F.lit(_MARK)), F.array(text)).otherwise(few)


def _by_piece(text: Column, plain: Callable[[Column], Column], ruled: Callable[[Column], Column]) -> Column:
    """The arrays of all pieces, one behind the other; null for null."""
    return F.when(text.isNotNull(), F.flatten(F.transform(_pieces(text), lambda p: F.when(p.rlike(_needs_rules()), ruled(p)).otherwise(plain(p)))))


def _ruled_sizes(piece: Column) -> Column:
    return F.transform(F.split(marked_letters(piece), _GAP, -1), F.char_length)


def _ruled_texts(piece: Column) -> Column:
    cut = lambda x: F.zip_with(x["n"], x["e"], lambda n, e: F.array_join(F.slice(x["c"], (e - n + 1).cast("int"), n), ""))
    ends = lambda sizes: running_sums(F.transform(sizes, lambda n: n.cast("long")))
    return let(_ruled_sizes(piece), lambda sizes: let(F.struct(F.split(piece, "").alias("c"), sizes.alias("n"), ends(sizes).alias("e")), cut))


def cluster_sizes(text: Column) -> Column:
    """Characters of each cluster, in order; empty for the empty text, null for null. Expressions only, linear in the text.

    Texts without a character that could join another skip the rules. Bytes that are no UTF-8 should be refused before.
    """
    rules = F.transform(F.split(marked_letters(text), _GAP, -1), F.char_length)
    plain = F.array_repeat(F.lit(1), F.char_length(text))
    return F.when(text == "", F.expr("cast(array() as array<int>)")).when(text.rlike(_needs_rules()), rules).otherwise(plain)


def cluster_texts(text: Column) -> Column:
    """The clusters of a text as an array of texts."""

    def cut(sizes: Column) -> Column:
        ends = running_sums(F.transform(sizes, lambda n: n.cast("long")))
        split = F.split(text, "")
        whole = let(F.struct(split.alias("c"), sizes.alias("n"), ends.alias("e")), lambda x: F.zip_with(x["n"], x["e"], lambda n, e: F.array_join(F.slice(x["c"], (e - n + 1).cast("int"), n), "")))
        return F.when(F.size(sizes) == F.char_length(text), F.when(text == "", F.expr("cast(array() as array<string>)")).otherwise(split)).otherwise(whole)

    return let(cluster_sizes(text), cut)


#: Runs of characters of 1, 2, 3 and 4 bytes.
WIDTHS = r"[\x{0}-\x{7F}]++|[\x{80}-\x{7FF}]++|[\x{800}-\x{FFFF}]++|[\x{10000}-\x{10FFFF}]++"


def equal_runs(text: Column) -> Column:
    """Runs (n, w) of n characters of w bytes each; there are few of them in most texts."""
    run = lambda r: let(F.char_length(r), lambda n: F.struct(n.cast("long").alias("n"), (F.octet_length(r) / n).cast("long").alias("w")))
    return F.transform(F.regexp_extract_all(text, F.lit(WIDTHS), F.lit(0)), run)


def run_ends(runs: Column) -> Column:
    """Where each of the things ends that runs (n, w) stand for: n things of size w for each run. Sums are made over runs, not over things."""
    things = lambda r, e: F.sequence(e - (r["n"] - 1) * r["w"], e, r["w"])
    return let(runs, lambda rs: F.flatten(F.zip_with(rs, running_sums(F.transform(rs, lambda r: r["n"] * r["w"])), things)))


def egc_split(text: Column) -> Column:
    """Byte offsets of cluster starts and the text's size (``[0]`` for the empty text); null for a null text and for invalid UTF-8."""
    one, zero = F.lit(1).cast("long"), F.array(F.lit(0).cast("long"))
    runs = lambda t: _by_piece(t, equal_runs, lambda p: F.transform(_ruled_texts(p), lambda c: F.struct(one.alias("n"), F.octet_length(c).cast("long").alias("w"))))
    return F.when(F.is_valid_utf8(text), let(F.try_validate_utf8(text), lambda t: F.concat(zero, run_ends(runs(t))))).cast("array<int>")


def break_tests(lines: DataFrame, line: str = "line") -> DataFrame:
    """text and clusters (characters of each) of lines of a break test file: ``÷ 0020 × 0308 ÷ 0020 ÷ # comment``; other lines are left out."""
    body = F.trim(F.regexp_replace(F.col(line), r"\s*#.*$", ""))
    # a code point's bytes are written as UTF-32, which is decoded as a whole
    text = lambda part: F.decode(F.unhex(F.array_join(F.transform(F.regexp_extract_all(part, F.lit("([0-9A-F]+)"), F.lit(1)), lambda h: F.lpad(h, 8, "0")), "")), "UTF-32")
    parts = F.filter(F.split(body, "÷"), lambda p: F.trim(p) != "")
    # a generator, so that no filter moves below it and makes a line once more
    found = lines.select("*", F.explode(F.array(body)).alias("_body")).filter(F.col("_body").rlike(r"^÷(?> [0-9A-F]{4,6} [÷×])++$"))
    return found.select("*", text(F.col("_body")).alias("text"), F.transform(parts, lambda p: F.size(F.regexp_extract_all(p, F.lit("[0-9A-F]+"), F.lit(0)))).alias("clusters")).drop("_body")


def break_test_line(text: Column) -> Column:
    """The break test line of a text: its code points in hexadecimal with a mark before, between and after them."""
    cluster = lambda c: F.array_join(F.transform(F.split(c, ""), lambda x: F.lpad(F.hex(F.ascii(x)), F.greatest(F.lit(4), F.length(F.hex(F.ascii(x)))), F.lit("0"))), " × ")
    return F.concat(F.lit("÷ "), F.array_join(F.transform(cluster_texts(text), cluster), " ÷ "), F.lit(" ÷"))


def split_pattern() -> re.Pattern[str]:
    """The pattern of gaps between clusters over marked letters."""
    return re.compile(_GAP)
