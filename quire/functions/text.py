"""String columns: trimming, lines, names, keys, sizes, language tests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode counts as white space, and the line boundaries among them.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"[\s\x1c-\x1f\x85\p{Z}]"
LINE_END_CHARS = ("\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")
LINE_BREAK = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"

# Thresholds and limits of the text rules.
LATIN_WORDS_FOR_ENGLISH = 15
CHALLENGE_HEAD = 8192
NAME_PUNCTUATION = " ._-()（）【】"

# Phrases seen on human-verification pages.
CHALLENGE_MARKS = (
    "please confirm that you are human",
    "just a moment",
    "cf-challenge",
    "challenge-platform",
    "checking your browser",
    "attention required",
    "認證圖案",
    "验证图案",
    "verify you are human",
)


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Trim every kind of Unicode white space at both ends of a line, without a regular expression."""
    return F.trim(as_col(c), F.lit(WHITESPACE))


def strip_text(c: str | Column, space: str = SPACE_CLASS) -> Column:
    """`strip` for whole texts, in linear time.

    The built-in trim with a character set keeps two integers per byte of the string, which a book of
    many megabytes cannot afford; this runs to the end and steps back over the last white space.
    """
    other = "[^" + space[1:]
    return F.regexp_extract(as_col(c), rf"(?s)\A{space}*+(.*{other})", 1)


def is_blank(c: str | Column) -> Column:
    """No character but white space; settled at the first other one."""
    return ~as_col(c).rlike("[^" + SPACE_CLASS[1:])


def collapse_space(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(as_col(c), SPACE_CLASS + "+", " "))


def split_lines(c: str | Column) -> Column:
    """Lines without their ends; a final line end opens no further line, empty text has none."""
    text = as_col(c)
    parts = F.split(F.regexp_replace(text, rf"(?:{LINE_BREAK})\z", ""), LINE_BREAK)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(parts)


def line_count(c: str | Column) -> Column:
    """Number of `split_lines`, counted without building the lines."""
    text = as_col(c)
    closed = (text == "") | F.substring(text, -1, 1).isin(*LINE_END_CHARS)
    return F.regexp_count(text, F.lit(LINE_BREAK)) + F.when(closed, 0).otherwise(1)


def normalize_text(c: str | Column) -> Column:
    """Windows and old Mac line ends to LF, ideographic space to space."""
    return F.translate(F.regexp_replace(as_col(c), r"\r\n?", "\n"), "\u3000", " ")


def has_cjk(c: str | Column) -> Column:
    return as_col(c).rlike(r"[\u4e00-\u9fff]")


def latin_words(c: str | Column) -> Column:
    return F.regexp_count(as_col(c), F.lit("[A-Za-z]{2,}"))


def trans_direction(c: str | Column, threshold: int = LATIN_WORDS_FOR_ENGLISH) -> Column:
    """`en2zh` for text with many Latin words, else `zh2en`."""
    return F.when(latin_words(c) >= threshold, "en2zh").otherwise("zh2en")


def is_challenge(c: str | Column, marks: Sequence[str] = CHALLENGE_MARKS) -> Column:
    """Does the head of the page carry a human-verification phrase?"""
    head = F.lower(F.substring(as_col(c), 1, CHALLENGE_HEAD))
    return reduce(or_, [F.contains(head, F.lit(m)) for m in marks])


def sanitize_filename(c: str | Column) -> Column:
    """Letters, numbers and a few marks stay, the rest becomes `_`; never empty."""
    kept = F.regexp_replace(as_col(c), r"[^\p{L}\p{N} ._\-()（）【】]", "_")
    return F.coalesce(F.nullif(F.trim(kept, F.lit(" ._")), F.lit("")), F.lit("untitled"))


def store_key(source: str | Column, id_: str | Column) -> Column:
    """Key of one edition in the content store."""
    return F.substring(full_key(source, id_), 1, 24)


def full_key(*parts: str | Column) -> Column:
    return F.sha1(F.concat_ws("|", *[as_col(p) for p in parts]))


def size_mb(bytes_: str | Column) -> Column:
    """`x.xMB`; empty when the size is missing, zero or no whole number.

    Rounds the double `bytes / 1e6` as it is in binary, a true half to even; the built-in format rounds
    its decimal text instead. 20x is split into 16x + 4x, whose rounding error is exact.
    """
    raw = as_col(bytes_).cast("string")
    n = F.when(raw.rlike(r"^\s*[+]?\d+\s*$"), F.trim(raw).try_cast("bigint"))
    tenths, rest = F.floor(n / F.lit(100_000)), n % 100_000
    x = n.cast("double") / F.lit(1e6)
    total = x * 16.0 + x * 4.0
    lost = x * 4.0 - (total - x * 16.0)
    above = (total - (tenths * 2 + 1).cast("double")) + lost
    up = (rest > 50_000) | ((rest == 50_000) & ((above > 0) | ((above == 0) & (tenths % 2 == 1))))
    t = tenths + up.cast("bigint")
    label = F.concat(F.floor(t / F.lit(10)).cast("string"), F.lit("."), (t % 10).cast("string"), F.lit("MB"))
    return F.when(n.isNull() | (n == 0), "").otherwise(label)


def size_kb(bytes_: str | Column) -> Column:
    return F.greatest(F.lit(1), F.floor(as_col(bytes_) / 1024)).cast("bigint")


def progress_key(c: str | Column) -> Column:
    """A partial file shares the reading position of the finished one."""
    return F.regexp_replace(as_col(c), r"\.part\z", "")


def progress_pct(chapter: str | Column, pct: str | Column, chapters: str | Column) -> Column:
    """Whole-book progress 1..100, rounded half up; null unless the book has several chapters."""
    n = as_col(chapters)
    done = (F.coalesce(as_col(chapter), F.lit(0)) + F.coalesce(as_col(pct), F.lit(0)) / 1000) / n * 100
    return F.when(n > 1, F.least(F.lit(100), F.greatest(F.lit(1), F.floor(done + 0.5)))).cast("int")


def xml_clean(c: str | Column) -> Column:
    """Drop the characters XML 1.0 forbids."""
    return F.regexp_replace(as_col(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "")


def xml_escape(c: str | Column) -> Column:
    out = F.replace(as_col(c), F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def encode_title(c: str | Column, keep_slash: bool = False) -> Column:
    """Percent-encode; unreserved characters as in RFC 3986, `/` kept for paths."""
    out = F.replace(F.url_encode(as_col(c)), F.lit("+"), F.lit("%20"))
    out = F.replace(out, F.lit("*"), F.lit("%2A"))
    out = F.replace(out, F.lit("%7E"), F.lit("~"))
    return F.replace(out, F.lit("%2F"), F.lit("/")) if keep_slash else out


def decode_title(c: str | Column) -> Column:
    """Percent-decode with `+` kept; `_` becomes a space. Broken escapes leave the text as it is."""
    raw = as_col(c)
    plain = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    return F.replace(F.coalesce(plain, raw), F.lit("_"), F.lit(" "))


def url_param(url: str | Column, key: str) -> Column:
    """First value of a query parameter, decoded; empty when absent."""
    return F.coalesce(F.try_url_decode(F.try_parse_url(as_col(url), F.lit("QUERY"), F.lit(key))), F.lit(""))


def url_host(url: str | Column) -> Column:
    """Network location with its port; empty when there is none."""
    return F.coalesce(F.try_parse_url(as_col(url), F.lit("AUTHORITY")), F.lit(""))


def base_name(path: str | Column) -> Column:
    return F.substring_index(as_col(path), "/", -1)


def file_title(path: str | Column) -> Column:
    """Trimmed base name without a `.txt` ending."""
    return strip(F.regexp_replace(base_name(path), r"(?i)\.txt\z", ""))


def folder(path: str | Column) -> Column:
    raw = as_col(path)
    return F.when(F.contains(raw, F.lit("/")), F.regexp_replace(raw, r"/[^/]*\z", "")).otherwise("")


def error_message(kind: str | Column, name: str | Column, detail: str | Column) -> Column:
    """Error class to the line a reader sees; the order of the cases is the rule."""
    k = as_col(kind)
    return (
        F.when(k == "verification", ERROR_TEXT["verification"])
        .when(k == "network", ERROR_TEXT["network"])
        .when(k == "parse", F.concat(F.lit(ERROR_TEXT["parse"]), F.lit("（"), as_col(name), F.lit("）")))
        .otherwise(F.concat_ws(": ", as_col(name), as_col(detail)))
    )


# Messages shown for the error classes.
ERROR_TEXT = {
    "verification": "源站要求人机验证（反爬拦截）——当前网络出口被源站标记；换个网络或代理节点后重试",
    "network": "网络请求失败（已自动重试仍不通）——请检查网络或稍后重试",
    "parse": "内容解析异常——该源返回了无法处理的数据，可能已改版",
}
