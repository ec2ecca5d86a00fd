"""Text, token and protocol expressions. Everything returns a Column and stays in the JVM, but for the two
Arrow functions at the end, whose algorithms (sequence matching, a character scanner) no expression has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: What a word is made of, in the regexes of the JVM and of SQL engines alike.
WORD_CHARS = r"\p{L}\p{N}_"
BLANKS = r"[\s\p{Z}]+"
#: Texts of an Arrow batch that are Python objects at a time: Spark bounds the bytes of a batch, objects take several times as many.
SLICE = 16


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- normal forms -----------------------------------------------------------------------------------


def norm_term(x: Column | str) -> Column:
    """Blanks collapsed and trimmed, lower-cased; null stays null."""
    return F.lower(F.regexp_replace(F.regexp_replace(col(x), BLANKS, " "), "^ | $", ""))


def plain_tokens(x: Column | str) -> Column:
    """Lower-cased runs of Latin letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(x), F.lit(""))), F.lit("([a-zà-ÿ]+)"), 1)


def plain_text(x: Column | str) -> Column:
    return F.array_join(plain_tokens(x), " ")


def word_tokens(x: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col(x), F.lit(""))), F.lit(f"([{WORD_CHARS}]+)"), 1)


def phrase_tokens(x: Column | str, keep_blanks: bool = False) -> Column:
    """All of a text, lower-cased: whole words, and every other character by itself. Runs of blanks are one
    space (and none at the ends) unless ``keep_blanks``."""
    plain = F.lower(F.coalesce(col(x), F.lit("")))
    if not keep_blanks:
        plain = F.regexp_replace(F.regexp_replace(plain, BLANKS, " "), "^ | $", "")
    return F.regexp_extract_all(plain, F.lit(f"([{WORD_CHARS}]+|[^{WORD_CHARS}])"), 1)


def escaped(x: Column | str) -> Column:
    """``x`` as a literal inside a regex."""
    return F.regexp_replace(col(x), r"([\\\\.\[\]{}()*+?^$|#&~-])", r"\\$1")


def term_pattern(term: Column | str) -> Column:
    """Whole words only, any blanks between the words, in any case."""
    words = F.regexp_replace(escaped(F.regexp_replace(F.regexp_replace(col(term), BLANKS, " "), "^ | $", "")), " ", r"[\\s\\p{Z}]+")
    return F.concat(F.lit(f"(?iu)(?<![{WORD_CHARS}])(?:"), words, F.lit(f")(?![{WORD_CHARS}])"))


def occurrences(text: Column | str, phrase: Column | str) -> Column:
    """How often ``phrase`` stands in ``text`` as whole words, in any case."""
    return F.regexp_count(col(text), F.concat(F.lit(f"(?iu)(?<![{WORD_CHARS}])(?:"), escaped(phrase), F.lit(f")(?![{WORD_CHARS}])"))).cast("long")


def known_from(x: Column | str) -> Column:
    """The first integer of a free note such as 'chapter 3'; null if there is none."""
    return F.try_to_number(F.nullif(F.regexp_extract(F.coalesce(col(x), F.lit("")), r"(\d{1,9})", 1), F.lit("")), F.lit("999999999")).cast("int")


def safe_name(x: Column | str, most: int = 60) -> Column:
    return F.left(F.regexp_replace(col(x), "[^A-Za-z0-9_-]", "_"), F.lit(most))


def keep_list(x: Column | str) -> Column:
    """Entries separated by commas or line ends: trimmed, without empty ones, first of equal ones."""
    parts = F.transform(F.split(F.coalesce(col(x), F.lit("")), "[,\\r\\n]+"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


# ---- sizes and estimates ----------------------------------------------------------------------------


def token_pieces(x: Column | str) -> Column:
    """Estimated tokens but for line ends: five ASCII word characters, one ASCII mark, or two bytes of anything else are one. What stands apart by marks adds up."""
    text = F.coalesce(col(x), F.lit(""))
    # words and marks with anything beyond ASCII are measured one by one; pieces of the others need only be counted: all pieces, less those inside the former
    wide = F.lit(rf"(?<![{WORD_CHARS}])[A-Za-z0-9_]*+[{WORD_CHARS}&&[^\x00-\x7F]][{WORD_CHARS}]*+|[^{WORD_CHARS}\s\x00-\x7F]")
    narrow = F.lit(r"\w{1,5}+|[^\w\s]")  # ASCII; faster than the same classes as ranges
    measured = F.transform(F.regexp_extract_all(text, wide, F.lit(0)), lambda w: F.ceil(F.octet_length(w) / 2).cast("long") - F.regexp_count(w, narrow))
    plain = F.octet_length(text) == F.length(text)
    return (F.regexp_count(text, narrow) + F.when(plain, 0).otherwise(F.aggregate(measured, F.lit(0).cast("long"), lambda a, n: a + n))).cast("long")


def text_tokens(x: Column | str) -> Column:
    """Estimated tokens: five ASCII word characters, one ASCII mark, or two bytes of anything else are one; four
    line ends are one; at least one."""
    return tokens_of(token_pieces(x), x)


def tokens_of(pieces: Column, x: Column | str) -> Column:
    """``text_tokens`` of a text whose pieces are known."""
    text = F.coalesce(col(x), F.lit(""))
    lines = F.floor((F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))) / 4)
    return F.greatest(F.lit(1).cast("long"), pieces + lines)


def word_count(x: Column | str) -> Column:
    """Words, where an apostrophe or hyphen inside joins."""
    return F.regexp_count(F.coalesce(col(x), F.lit("")), F.lit(rf"[{WORD_CHARS}]+(?:['’-][{WORD_CHARS}]+)*")).cast("long")


def estimated_input(raw: Column | str, factor: float = 1.0, samples: int = 0) -> Column:
    return (F.ceil((col(raw) + 128) * F.lit(factor) * F.lit(1.05 if samples else 1.12)) + 64).cast("long")


def predicted_output(source: Column | str, overhead: Column | str, ratio: float) -> Column:
    return (F.ceil(col(source) * F.lit(ratio)) + col(overhead) + 2048).cast("long")


def simple_estimate(x: Column | str) -> Column:
    return F.greatest(F.lit(64), F.floor(F.length(col(x)) / 4)).cast("long")


def output_driven_target(limit: int, ratio: float) -> int:
    """Input that fills about nine tenths of the output budget."""
    return int((limit * 0.9 - 2048 - 4096) / max(ratio, 1.0))


def grouped_number(x: Column | str, digits: int = 0) -> Column:
    """Thousands apart; a dash for null."""
    return F.coalesce(F.format_number(col(x), digits), F.lit("—"))


def compact_number(x: Column | str) -> Column:
    """From a thousand on in thousands with at most one digit after the point."""
    return F.when(col(x) >= 1000, F.concat(F.regexp_replace(F.format_string("%.1f", col(x) / 1000), r"\.0$", ""), F.lit("K"))).otherwise(col(x).cast("string"))


def minutes_text(seconds: Column | str) -> Column:
    return F.format_number(col(seconds) / 60, 1)


# ---- identity ---------------------------------------------------------------------------------------


def canonical(*fields: Column) -> Column:
    """Compact JSON of a struct with the given (alphabetical) fields; nulls stay."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def digest(x: Column | str) -> Column:
    return F.sha2(col(x), 256)


def scope_key(model: str, secret: Column | str) -> Column:
    return F.concat(F.lit(f"{model}:"), F.left(digest(secret), F.lit(16)))


def key_label(no: Column | str, secret: Column | str) -> Column:
    return F.concat(F.lit("#"), col(no).cast("string"), F.lit(" ("), F.left(digest(secret), F.lit(8)), F.lit("…)"))


def redacted(x: Column | str, secret: Column | str, most: int = 1200) -> Column:
    hidden = F.when(F.length(col(secret)) > 0, F.replace(col(x), col(secret), F.lit("***"))).otherwise(col(x))
    return F.left(hidden, F.lit(most))


# ---- checks of texts --------------------------------------------------------------------------------


def trimmed(x: Column | str, blank: str = r"\s") -> Column:
    """Without the characters of the class ``blank`` at both ends. Texts that have none there, or no line end that counts as the end, are not searched."""
    ends = F.concat(F.left(col(x), F.lit(1)), F.right(col(x), F.lit(1)))
    return F.when(ends.rlike(rf"[{blank}\x{{85}}\x{{2028}}\x{{2029}}]"), F.regexp_replace(col(x), f"^[{blank}]+|[{blank}]+$", "")).otherwise(col(x))


def text_fault(source: Column | str, target: Column | str) -> Column:
    """Why a target text may not stand for its source; null if it may."""
    return length_fault(F.length(col(source)), target)


def length_fault(length: Column | str, target: Column | str) -> Column:
    """``text_fault`` for a source of a known length."""
    t = trimmed(target, r"\s\p{Z}")
    n, m = col(length), F.length(t)
    return (
        F.when(col(target).isNull() | (m == 0), F.lit("empty"))
        .when(col(target).rlike("[^\\x{9}\\x{A}\\x{D}\\x{20}-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]"), F.lit("illegal_character"))
        .when(m > F.greatest(F.lit(300), n * 8), F.lit("too_long"))
        .when((n > 160) & (m < n * 0.25), F.lit("too_short"))
    )


def adds_markup(source: Column | str, target: Column | str) -> Column:
    tag = "</?[A-Za-z][^>]*>"
    return col(target).rlike(tag) & ~col(source).rlike(tag)


def unfenced(x: Column | str) -> Column:
    """Without a code fence around the whole."""
    plain = trimmed(x)
    inner = F.regexp_replace(F.regexp_replace(plain, r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")
    return F.when(plain.startswith("```"), F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(plain)


def strict_json(x: Column | str) -> Column:
    """The text if it is one strict JSON value (no duplicate keys, no NaN, nothing cut off), else null."""
    return F.when(F.try_parse_json(col(x)).isNotNull(), col(x))


# ---- protocol ---------------------------------------------------------------------------------------


def retry_after(header: Column | str, delays: Column | str, now: Column | str) -> Column:
    """Seconds to wait: the header in seconds or as an HTTP date, or the longest ``Ns`` of ``delays``; at least 0."""
    h = col(header)
    seconds = F.try_to_number(h, F.lit("999999999.999")).cast("double")
    date = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(h, r"^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))).cast("double") - col(now)
    each = F.transform(F.coalesce(col(delays), F.array().cast("array<string>")), lambda d: F.nullif(F.regexp_extract(d, r"^([0-9]+(?:\.[0-9]+)?)s$", 1), F.lit("")).cast("double"))
    return F.greatest(F.lit(0.0), F.coalesce(seconds, date), F.array_max(each))


def quota_kind(message: Column | str, labels: Column | str, zero: Column | str) -> Column:
    """daily, zero, tpm, rpm or null from the labels of violations, else from the message."""
    joined = F.array_join(F.coalesce(col(labels), F.array().cast("array<string>")), " ")
    label = F.when(joined != "", joined).otherwise(F.coalesce(col(message), F.lit("")))
    return (
        F.when(label.rlike("(?i)per.?day|daily|requests.?per.?day"), F.lit("daily"))
        .when(F.coalesce(col(zero), F.lit(False)), F.lit("zero"))
        .when(label.rlike("(?i)token|tpm"), F.lit("tpm"))
        .when(label.rlike("(?i)per.?minute|rpm|request.*minute"), F.lit("rpm"))
    )


def effective_status(status: Column | str, error_code: Column | str, message: Column | str) -> Column:
    """A success that carries an error body counts as its code, 429 if it speaks of limits, else 502."""
    code = F.try_to_number(col(error_code), F.lit("999")).cast("int")
    hidden = F.when(code.between(400, 599), code).when(col(message).rlike("(?i)rate|quota|limit"), 429).otherwise(502)
    failed = (col(status) == 200) & (col(error_code).isNotNull() | col(message).isNotNull())
    return F.when(failed, hidden).otherwise(col(status)).cast("int")


def backoff(attempt: Column | str) -> Column:
    """Doubling from five seconds to two minutes (jitter is left to the caller)."""
    return F.least(F.lit(120.0), F.pow(F.lit(2.0), col(attempt)) * 5)


def pacific_midnight(ts: Column | str, days: int = 0) -> Column:
    """The civil midnight on the US west coast at or before ``ts`` (UTC), or ``days`` later."""
    local = F.date_trunc("DAY", F.from_utc_timestamp(col(ts), "America/Los_Angeles"))
    return F.to_utc_timestamp(local + F.expr(f"INTERVAL {days} DAY"), "America/Los_Angeles")


def is_english(lang: Column | str) -> Column:
    return col(lang).isNull() | (F.trim(col(lang)) == "") | F.trim(col(lang)).rlike("(?i)^en([-_].*)?$")


def rewritten_lang(lang: Column | str, to: str = "id") -> Column:
    return F.when(F.trim(col(lang)).rlike("(?i)^en([-_].*)?$"), F.lit(to)).otherwise(col(lang))


# ---- Arrow functions --------------------------------------------------------------------------------


#: From this length on, letters that make up more than a hundredth of the second string begin no block.
LONG, COMMON = 200, 100


def matching_ratio(a: str, b: str) -> float:
    """Twice the letters in common blocks, over all letters: the longest block (of equally long ones the first in ``a``, then in
    ``b``), and so on to its left and to its right. Two empty strings are equal.

    Blocks are runs of equal letters on a diagonal of the table of both strings. The table is filled once, row by row; a part of it is
    searched by clipping the runs that begin before the part.
    """
    if not a and not b:
        return 1.0
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
    equal = x[:, None] == y
    seeds = equal
    if len(y) >= LONG:
        letters, where, counts = np.unique(y, return_inverse=True, return_counts=True)
        seeds = equal & (counts <= len(y) // COMMON + 1)[where]
    runs = np.zeros((len(x) + 1, len(y) + 1), np.int64)  # length of the run of seeds that ends here
    for i in range(len(x)):
        runs[i + 1, 1:] = np.where(seeds[i], runs[i, :-1] + 1, 0)
    held, parts = 0, [(0, len(x), 0, len(y))]
    while parts:
        top, bottom, left, right = parts.pop()
        if top == bottom or left == right:
            continue
        inside = np.minimum(runs[top + 1 : bottom + 1, left + 1 : right + 1], np.minimum(np.arange(1, bottom - top + 1)[:, None], np.arange(1, right - left + 1)))
        at = int(inside.argmax())  # the first of the longest, by rows
        i, j = divmod(at, right - left)
        n = int(inside[i, j])
        i, j = (top + i + 1 - n, left + j + 1 - n) if n else (top, left)
        end_i, end_j = i + n, j + n
        while i > top and j > left and equal[i - 1, j - 1]:
            i, j = i - 1, j - 1
        while end_i < bottom and end_j < right and equal[end_i, end_j]:
            end_i, end_j = end_i + 1, end_j + 1
        if end_i > i:
            held += end_i - i
            parts += [(top, i, left, j), (end_i, bottom, end_j, right)]
    return 2.0 * held / (len(x) + len(y))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """``matching_ratio`` of two strings; null if one is null."""
    return pd.Series([None if x is None or y is None else matching_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def close_quotes(text: str) -> str:
    """JSON with its strings made sound: a quote ends a string only before a comma, colon or closing bracket
    (or the end); other quotes and raw control characters inside strings are escaped."""
    import re

    out: list[str] = []
    inside = False
    for piece in re.finditer(r'\\.?|"(?=\s*(?P<end>[,}\]:]|$))?|[^\\"]+', text, re.S):
        token = piece.group()
        if token == '"':
            closes = piece.group("end") is not None
            if inside and not closes:
                token = '\\"'
            else:
                inside = not inside
        elif inside and token[0] != "\\":
            token = re.sub(r"[\x00-\x1f]", lambda m: {"\n": "\\n", "\r": "\\r", "\t": "\\t"}.get(m.group(), f"\\u{ord(m.group()):04x}"), token)
        out.append(token)
    return "".join(out)


@F.arrow_udf(StringType())
def repaired_json(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``close_quotes`` of each text; null stays null. Of a batch, one slice at a time is made Python objects."""
    for batch in texts:
        done = [pa.array([None if t is None else close_quotes(t) for t in batch.slice(at, SLICE).to_pylist()], pa.string()) for at in range(0, len(batch), SLICE)]
        yield pa.concat_arrays(done) if done else pa.array([], pa.string())
