"""Column functions on text: tokens, lines, numbers, clean-up, folding. No Python runs on the executors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import ship

#: White space as Unicode has it, for engines whose ``\s`` is ASCII; and line ends.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
TOKEN = r"[^\s\x1c-\x1f\x85\p{Z}]+"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
NUMBER = r"[0-9][0-9,.\-/]*"
FIGURE = r"[0-9][0-9,]*(?:\.[0-9]+)?"
WORD = r"[\p{L}\p{N}_][\p{L}\p{N}_,.\-/]*"
#: The characters that ``fold`` blanks, all but ``a-z0-9.,%$/:()-`` and ASCII white space: as ranges, which match ten times as fast as their negation.
UNFOLDED = r"[\x00-\x08\x0e-\x1f\x21-\x23\x26\x27\x2a\x2b\x3b-\x60\x7b-\x{10ffff}]"
#: White space that ends no line, and what of it isn't a space.
INNER = r"[\t \x1f\p{Zs}]"
INNER_ODD = r"[\t\x1f\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
#: White space but a space.
SPACE_ODD = r"[\t-\r\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Characters that compatibility normalisation leaves alone: ASCII and precomposed Latin letters.
NORMAL = r"[^\x00-\x7f\x{a1}-\x{a7}\x{a9}\x{ab}-\x{ae}\x{b0}\x{b1}\x{b6}\x{b7}\x{bb}\x{bf}-\x{131}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}]"

# The clean-up patterns of chat-like output.
FENCE = r"(?s)\A\s*```[ \t]*[A-Za-z0-9_+-]*[ \t]*\r?\n(.*?)\r?\n?[ \t]*```\s*\z"
PREAMBLE = (
    r"(?i)\A[ \t]*(?:here(?:'s| is| are)[^\n:]{0,80}:|the (?:extracted |transcribed |visible )?text[^\n:]{0,80}:|sure[,!][^\n]{0,80}:|certainly[,!][^\n]{0,80}:"
    r"|of course[,!][^\n]{0,80}:|transcription[^\n:]{0,40}:|ocr (?:result|output)[^\n:]{0,40}:)[ \t]*\r?\n+"
)
EPILOGUE = r"(?i)\r?\n+[ \t]*(?:(?:let me know|feel free)[^\n]{0,120}|(?:would you like|do you want)[^\n]{0,120}|if you (?:need|have)[^\n]{0,120})[ \t]*\z"


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_matches(c: str | Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(column(c), F.lit("")), F.lit(pattern), F.lit(0))


def tokens(c: str | Column) -> Column:
    """Runs of anything but white space."""
    return all_matches(c, TOKEN)


def word_count(c: str | Column) -> Column:
    return F.regexp_count(F.coalesce(column(c), F.lit("")), F.lit(TOKEN)).cast("bigint")


def is_blank(c: str | Column) -> Column:
    """True for null, empty and white-space text."""
    return ~F.coalesce(column(c), F.lit("")).rlike(TOKEN)


def stripped(c: str | Column) -> Column:
    return F.regexp_replace(column(c), rf"\A{SPACE}+|{SPACE}+\z", "")


def normal_line(c: str | Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(column(c), rf"{SPACE}{{2,}}|{SPACE_ODD}", " "))


def lines(c: str | Column) -> Column:
    """Normalised lines, blank ones left out: every line end is white space, so a few passes over the whole text do."""
    ends = r"\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}"
    x = F.regexp_replace(F.coalesce(column(c), F.lit("")), rf"{INNER}{{2,}}|{INNER_ODD}", " ")
    x = F.regexp_replace(x, rf" ?[{ends}][ {ends}]*", "\n")
    return F.array_remove(F.split(F.trim(x, F.lit(" \n")), "\n"), "")


def numbers(c: str | Column) -> Column:
    """Digit runs with their inner separators, thousands commas removed."""
    return F.transform(all_matches(c, NUMBER), lambda x: F.replace(x, F.lit(","), F.lit("")))


def figures(c: str | Column) -> Column:
    """Numbers with their commas, as they stand."""
    return all_matches(c, FIGURE)


def looks_like_language(token: Column) -> Column:
    """A digit, no letters, at most two letters, or an (unaccented) vowel."""
    letters = F.length(F.regexp_replace(token, r"[^\p{L}]", ""))
    return token.rlike("[aeiouyAEIOUY]") | token.rlike(r"\p{N}") | (letters <= 2)


def normalised_spaces(c: str | Column) -> Column:
    """Line ends to LF, line ends stripped, blank runs to one blank line, ends stripped."""
    c = F.regexp_replace(column(c), r"\r\n|\r", "\n")
    c = F.regexp_replace(c, rf"(?m)(?:(?!\n){SPACE})+$", "")
    return stripped(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def clean_layer(c: str | Column) -> Column:
    """A text layer without extraction artefacts; the text must be normalised already (``with_normal_form``)."""
    c = F.regexp_replace(F.coalesce(column(c), F.lit("")), r"\r\n|\r", "\n")
    return normalised_spaces(F.regexp_replace(c, r"[ \t]{2,}", " "))


def may_change(c: str | Column) -> Column:
    """Whether compatibility normalisation may change a text; only what isn't ASCII meets the long class, which is slow."""
    return F.regexp_replace(column(c), r"[\x00-\x7f]+", "").rlike(NORMAL)


def with_normal_form(df: DataFrame, name: str) -> DataFrame:
    """``df`` with column ``name`` in compatibility normal form.

    Only texts with characters that the form may change are handed to Python; for all other rows it
    gets a null and gives one back, so the table is read once and isn't split.
    """
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    odd = F.coalesce(may_change(F.col(name)), F.lit(False))
    return df.withColumn("__odd", F.when(odd, F.col(name))).withColumn(name, F.coalesce(nfkc("__odd"), F.col(name))).drop("__odd")


def strip_fence(c: str | Column) -> Column:
    """The body of a code fence around the whole text; anything else unchanged."""
    return F.when(column(c).rlike(FENCE), F.regexp_extract(column(c), FENCE, 1)).otherwise(column(c))


def strip_preamble(c: str | Column) -> Column:
    return F.regexp_replace(column(c), PREAMBLE, "")


def strip_epilogue(c: str | Column) -> Column:
    return F.regexp_replace(column(c), EPILOGUE, "")


def clean_output(c: str | Column) -> Column:
    """Fence, lead-in, closing offer, fence again, white space."""
    return normalised_spaces(strip_fence(strip_epilogue(strip_preamble(strip_fence(F.coalesce(column(c), F.lit("")))))))


def fold(c: str | Column) -> Column:
    """The tokens that accuracy compares: lower case, other characters to spaces, edge punctuation dropped."""
    kept = F.regexp_replace(F.lower(F.coalesce(column(c), F.lit(""))), UNFOLDED, " ")
    return F.filter(F.transform(F.regexp_extract_all(kept, F.lit(r"\S+"), F.lit(0)), lambda t: F.regexp_replace(t, r"^[.,:;()\-/$%]+|[.,:;()\-/$%]+$", "")), lambda t: t != "")


def folded(c: str | Column) -> Column:
    """The tokens of ``fold`` joined by spaces, by passes over the whole text."""
    edge = r"[.,:;()\-/$%]+"
    kept = F.regexp_replace(F.lower(F.coalesce(column(c), F.lit(""))), UNFOLDED, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, rf"{edge}(?!\S)|(?<!\S){edge}", ""), r"\s+", " "))


def longest_repeat(c: str | Column) -> Column:
    """The longest run of equal consecutive non-blank lines; 0 when no line repeats."""
    trimmed = F.filter(F.transform(F.split(F.coalesce(column(c), F.lit("")), LINE_END), stripped), lambda x: x != "")
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        same = a["last"].eqNullSafe(x)
        run = F.when(same, a["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.when(same, F.greatest(a["best"], a["run"] + 1)).otherwise(a["best"]).alias("best"))

    return F.aggregate(trimmed, start, step, lambda a: a["best"])


def language_ratio(c: str | Column) -> Column:
    """Share of tokens that begin with an ASCII letter or digit; 0 without tokens."""
    t = tokens(c)
    n = F.size(t)
    return F.when(n > 0, F.size(F.filter(t, lambda x: x.rlike("^[A-Za-z0-9]"))) / n).otherwise(F.lit(0.0))
