"""Text sources: lines, annotated corpora, word lists and treebanks.

All readers return DataFrames. Parsers give a struct with an ``error`` field; ``strict`` raises on the first bad line
instead, as one bad line spoils a whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kireme.errors import InvalidUtf8, MalformedCorpus
from kireme.functions.arrays import let
from kireme.functions.references import unescape_references

PARSED = "struct<text:string,tags:array<tinyint>,error:string>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``text`` and ``file`` of every line. Only newlines end lines; a carriage return stays in its line."""
    return spark.read.text(path, lineSep="\n").select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"))


#: Splits of files (or chunks of lines) whose counts may be broadcast; more are joined by a shuffle.
BROADCAST_SPLITS = 100_000


def _beside(rows: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the counts of their split."""
    return rows.join(F.broadcast(counted) if counted.count() <= BROADCAST_SPLITS else counted, keys)


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with ``line_no`` (from 1) in their file, ``path``.

    Files are read in splits by many tasks. Rows of a split follow each other in their task, so a line's number is
    its place behind the split's first row plus the lines of the splits before; a first scan counts these. No line is shuffled,
    and one large file is numbered as many small ones are.
    """
    meta = F.col("_metadata")
    rows = spark.read.text(path, lineSep="\n").select(meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("text"))
    splits = rows.groupBy("path", "block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # one row for each split of a file
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    numbered = splits.select("path", "block", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return _beside(rows, numbered, ["path", "block"]).select("path", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "text")


def strip_cr(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\z", "")


#: Marks between the characters of a partially annotated line and their tags; no tag is unknown.
MARKS = {"-": 0, "|": 1, " ": None, "?": None}
# Repeats are possessive: they run on without recursion, and no line can be read in two ways. A backslash makes the next
# character an ordinary one. A slash starts tags, which run to the end of the word or to the next mark.
_WORD = r"(?s)((?:\\.|[^ /\\])*+)(?:/(?:\\.|[^ \\])*+)?+(?: |\z)"
_CHARACTER = r"(?s)(\\.|[^-| ?/\\])(?:/(?:\\.|[^-| ?\\])*+)?+([-| ?]|\z)"
_OPEN_ESCAPE = r"(?s)(?:\A|[^\\])(?:\\\\)*+\\\z"


def _unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _full(line: Column) -> Column:
    """Words are parted by spaces; gaps inside a word have tag 0, those between words tag 1."""
    words = F.filter(F.transform(F.regexp_extract_all(line, F.lit(_WORD), F.lit(1)), _unescaped), lambda w: w != "")
    tags = lambda w, i: F.concat(F.array_repeat(F.lit(1), F.when(i > 0, 1).otherwise(0)), F.array_repeat(F.lit(0), F.char_length(w) - 1))
    error = F.when(line.rlike(_OPEN_ESCAPE), F.lit(f"{MalformedCorpus.code}: a backslash ends the line"))
    return let(words, lambda ws: F.struct(F.array_join(ws, "").alias("text"), F.flatten(F.transform(ws, tags)).cast("array<tinyint>").alias("tags"), error.alias("error")))


def _partial(line: Column) -> Column:
    """Characters and marks take turns; a mark after the last character says nothing."""
    part = lambda group: F.regexp_extract_all(line, F.lit(_CHARACTER), F.lit(group))
    tag = lambda m: F.when(m == "-", 0).when(m == "|", 1)
    tags = let(part(2), lambda ms: F.transform(F.slice(ms, F.lit(1), F.greatest(F.size(ms) - 1, F.lit(0))), tag))
    # what the pattern leaves out stands where it should not
    read = F.aggregate(part(0), F.lit(0), lambda n, x: n + F.char_length(x))
    error = F.when(read != F.char_length(line), F.lit(f"{MalformedCorpus.code}: characters and marks do not take turns"))
    return F.struct(_unescaped(F.array_join(part(1), "")).alias("text"), tags.cast("array<tinyint>").alias("tags"), error.alias("error"))


def parse_annotated(line: Column, kind: str = "full") -> Column:
    """(text, tags, error) of an annotated line; nulls for lines without characters. A carriage return at its end is no part of it.

    Validity is asked of the raw bytes, before any function could replace bad ones. Everything is an expression.
    """
    empty = lambda error: F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<tinyint>").alias("tags"), error.cast("string").alias("error"))
    found = let(strip_cr(F.try_validate_utf8(line)), {"full": _full, "partial": _partial}[kind])
    checked = let(found, lambda x: F.when(x["error"].isNull() & (x["text"] != ""), x.cast(PARSED)).otherwise(empty(x["error"])))
    return F.when(line.isNull(), empty(F.lit(None))).when(F.is_valid_utf8(line), checked).otherwise(empty(F.lit(InvalidUtf8.code)))


def annotated(lines: DataFrame, kind: str = "full", text: str = "text", strict: bool = True) -> DataFrame:
    """Sentences (the other columns, text, tags, error) of annotated lines; lines without characters are left out.

    ``strict`` fails the query on a bad line; otherwise bad lines stay with their error.
    """
    rest = [c for c in lines.columns if c != text]
    # a generator, so that no filter moves below it and parses once more
    found = lines.select(*rest, F.inline(F.array(parse_annotated(F.col(text), kind))))
    if strict:
        found = found.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string")))
    return found.filter(F.col("text").isNotNull() | F.col("error").isNotNull())


def read_annotated(spark: SparkSession, path: str, kind: str = "full", strict: bool = True) -> DataFrame:
    return annotated(read_lines(spark, path).select("text"), kind, strict=strict)


def union_corpora(full: list[DataFrame], partial: list[DataFrame]) -> DataFrame:
    """All fully annotated corpora, then all partial ones, each row with the ordinal of its source."""
    out = None
    for i, df in enumerate([*full, *partial]):
        part = df.withColumn("source_no", F.lit(i))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no corpus")
    return out


def words_of_list(lines: DataFrame, text: str = "text", unescaped: bool = False) -> DataFrame:
    """``word``: the first field of every line, up to a space or tab; empty ones are left out.

    Escapes are part of the word, as word lists hold none; ``unescaped`` takes lists that do.
    """
    line = strip_cr(F.col(text))
    if unescaped:
        word = F.regexp_replace(F.regexp_extract(line, r"^((?:\\.|[^ \t\\])*)", 1), r"\\(.)", "$1")
    else:
        word = F.split(line, "[ \t]", 2)[0]
    return lines.select(word.alias("word")).filter("word <> ''")


def read_dictionary(spark: SparkSession, path: str, unescaped: bool = False) -> DataFrame:
    return words_of_list(read_lines(spark, path), unescaped=unescaped)


def stack_dictionaries(word_lists: list[DataFrame]) -> DataFrame:
    """``channel`` (from 0) and ``word`` of several word lists."""
    if len(word_lists) > 255:
        raise ValueError("at most 255 dictionaries")
    out = None
    for i, df in enumerate(word_lists):
        part = df.select(F.lit(i).alias("channel"), "word")
        out = part if out is None else out.unionByName(part)
    return out


#: Line numbers of a chunk in which the ends of sentences are counted together.
CHUNK_LINES = 1 << 16


def segmented_counts(rows: DataFrame, mark: Column, file: str = "path", line: str = "line_no", chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Rows with ``before``: how many rows of their file that ``mark`` tells stand before them.

    A scan in segments: marks are counted in chunks of line numbers, summed over the chunks of a file (a row for each), and
    counted inside a chunk; no task holds more than a chunk of lines, however long the file is.
    """
    cut = rows.withColumn("_chunk", F.floor(F.col(line) / chunk_lines)).withColumn("_mark", F.coalesce(mark, F.lit(False)).cast("long"))
    chunks = cut.groupBy(file, "_chunk").agg(F.sum("_mark").alias("_n"))
    carried = chunks.select(file, "_chunk", F.coalesce(F.sum("_n").over(Window.partitionBy(file).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_carry"))
    inside = F.sum("_mark").over(Window.partitionBy(file, "_chunk").orderBy(line).rowsBetween(Window.unboundedPreceding, -1))
    found = _beside(cut, carried, [file, "_chunk"]).withColumn("before", F.col("_carry") + F.coalesce(inside, F.lit(0)))
    return found.drop("_chunk", "_mark", "_carry")


def conllu_sentences(lines: DataFrame) -> DataFrame:
    """Annotated lines of a treebank: path, sentence, line (``surface/tag/reading`` joined by spaces).

    ``lines`` has path, line_no and text. Rows without ten fields, comments and ids that are not whole numbers are
    skipped; a blank line ends a sentence, and ``sentence`` counts blank lines before it. The reading is the first value of
    ``UnidicInfo`` in the last field. Sentences are counted in chunks of lines, so a file may be of any length.
    """
    from kireme.functions.text import escape_word

    bare = strip_cr(F.col("text"))
    blank = F.trim(bare) == ""
    # only these count: the others need not be moved
    used = lines.filter(blank | (~F.col("text").startswith("#") & bare.rlike(r"^[0-9]+\t[^\t]*(?:\t[^\t]*){8}$")))
    fields = segmented_counts(used, blank).filter(~blank).withColumn("_f", F.split(bare, "\t", -1))
    reading = F.regexp_extract(F.col("_f")[9], r"(?:^|\|)UnidicInfo=([^,|]*)", 1)
    token = F.concat_ws("/", escape_word(F.col("_f")[1]), escape_word(F.col("_f")[4]), escape_word(reading))
    joined = fields.select("path", F.col("before").alias("sentence"), "line_no", token.alias("token")).groupBy("path", "sentence").agg(F.array_sort(F.collect_list(F.struct("line_no", "token"))).alias("t"))
    return joined.select("path", "sentence", F.array_join(F.transform("t", lambda x: x["token"]), " ").alias("line"))


def lexicon_words(rows: DataFrame, column: str = "_c0", shortest: int = 2, longest: int = 1_000_000_000) -> DataFrame:
    """Distinct surfaces of a lexicon table (its first column), without replacement characters, by length in characters."""
    word = F.regexp_replace(F.col(column), "�", "")
    return rows.select(word.alias("word")).filter(F.length("word").between(shortest, longest)).filter("word <> ''").distinct()


def clean_ruby_html(html: Column, closed: bool = False) -> Column:
    """Lines of a book page, as an array: the main text without ruby, notes and tags, split after sentence ends.

    Character references need no semicolon where the standard asks for none, unless ``closed``.
    """
    main = F.regexp_extract(html, r'(?s)(<div class="main_text">.*?)(?:<div class="bibliographical_information">|\z)', 1)
    body = F.when(main != "", main).otherwise(F.regexp_extract(html, r'(?s)\A(.*?)(?:<div class="bibliographical_information">|\z)', 1))
    for pattern, by in ((r"(?s)<rp>.*?</rp>", ""), (r"(?s)<rt>.*?</rt>", ""), (r"(?s)［＃.*?］", ""), (r"<br\s*/?>", "\n"), (r"<[^>]+>", "")):
        body = F.regexp_replace(body, pattern, by)
    lines = F.transform(F.split(unescape_references(body, closed), "\n"), lambda x: F.replace(F.regexp_replace(x, r"^[\s 　]+|[\s 　]+$", ""), F.lit("　"), F.lit("")))
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, "(?<=[。！？])")))
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^[\s ]+|[\s ]+$", "")), lambda x: x != "")


def ucd_ranges(lines: DataFrame, text: str = "text") -> DataFrame:
    """lo, hi and value of the range lines of a Unicode data file."""
    t = F.regexp_replace(F.col(text), r"\s*#.*$", "")
    pattern = r"^([0-9A-F]+)(?:\.\.([0-9A-F]+))?\s*;\s*(.*?)\s*$"
    lo, hi = F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2)
    return lines.filter(t.rlike(pattern)).select(F.conv(lo, 16, 10).cast("int").alias("lo"), F.conv(F.when(hi == "", lo).otherwise(hi), 16, 10).cast("int").alias("hi"), F.regexp_extract(t, pattern, 3).alias("value"))
