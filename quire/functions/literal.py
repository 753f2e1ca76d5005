"""Dictionaries inside expressions: one pattern that finds the words, one literal table that gives their values.

Everything runs in the JVM. A dictionary travels as text in the plan, so its size is that of its words.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most branches that are tried one after another; beyond it the first character is halved.
BRANCHES = 6
#: Up to so many characters are replaced one after another, which takes less time than looking each character up.
FEW = 16


def _quoted(char: str) -> str:
    plain = char.isalnum() and not "\ud800" <= char <= "\udfff"
    return char if plain else rf"\x{{{ord(char):x}}}"


def word_pattern(words: Iterable[str]) -> str:
    """Regular expression that matches the longest of the words at a place; words are not empty.

    A tree of prefixes. Where many characters can follow, ranges are halved by a look-ahead, so a place
    costs the logarithm of the number of words and not their number.
    """
    root: dict = {}
    for word in words:
        node = root
        for char in word:
            node = node.setdefault(char, {})
        node[""] = {}

    def choice(children: list[tuple[str, dict]]) -> str:
        if len(children) <= BRANCHES:
            return "|".join(_quoted(char) + rest(node) for char, node in children)
        half = len(children) // 2
        sides = []
        for some in (children[:half], children[half:]):
            sides.append(f"(?=[{_quoted(some[0][0])}-{_quoted(some[-1][0])}])(?:{choice(some)})")
        return "|".join(sides)

    def rest(node: dict) -> str:
        out = ""
        while len(node) == 1 and "" not in node:  # no choice: no group
            ((char, node),) = node.items()
            out += _quoted(char)
        children = sorted((c, n) for c, n in node.items() if c)
        if not children:
            return out
        return f"{out}(?:{choice(children)})" + ("?" if "" in node else "")

    return rest(root)


class LiteralMap:
    """Values of string keys from a hash table that is a literal: one array access for each look-up."""

    def __init__(self, entries: Mapping[str, str]):
        self.size = 1 << (2 * len(entries)).bit_length()
        used = set().union(*map(set, entries), *map(set, entries.values()))
        marks = (chr(c) for c in (*range(0xE000, 0xF900), *range(1, 9)) if chr(c) not in used)
        self.begin, self.middle, self.bucket = next(marks), next(marks), next(marks)
        buckets = [""] * self.size
        for key, value in entries.items():
            buckets[zlib.crc32(key.encode()) % self.size] += f"{self.begin}{key}{self.middle}{value}"
        self.text = self.bucket.join(buckets)

    def get(self, key: Column) -> Column:
        """Value of a key, null for a key that is not in the table."""
        table = F.split(F.lit(self.text), self.bucket)  # folded to an array when the plan is made
        place = F.get(table, F.pmod(F.crc32(key.cast("binary")), F.lit(self.size)).cast("int"))
        marked = F.concat(F.lit(self.begin), key, F.lit(self.middle))
        tail = F.split_part(F.split_part(place, marked, F.lit(2)), F.lit(self.begin), F.lit(1))
        return F.when(F.contains(place, marked), tail)


#: Stand around a match; a text that holds one is cut in another, slower way.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"


def replace_matches(text: Column, pattern: str, value: Callable[[Column], Column], between: Callable[[Column], Column] | None = None) -> Column:
    """The text with `value(match)` for every match of the pattern, and `between(part)` for what lies between them.

    The pattern has no empty match; a match without a value goes. The pattern is compiled anew for every row.
    """
    pairs = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        # there is one part more than there are matches
        lambda part, match: F.concat(between(part) if between else part, F.coalesce(value(match), F.lit(""))),
    )
    return F.array_join(pairs, "")


def replace_chars(text: Column, chars: Mapping[str, str]) -> Column:
    """Every character by its one-character value, all at once."""
    order, open_ = [], dict(chars)
    while open_:
        # a character whose value is itself a key comes after that key
        free = [c for c in open_ if open_[c] not in open_ or open_[c] == c]
        if not free:
            break
        order += free
        for c in free:
            del open_[c]
    if open_ or len(order) > FEW:
        return F.translate(text, "".join(chars), "".join(chars.values()))
    for c in order:
        text = F.replace(text, F.lit(c), F.lit(chars[c]))
    return text


def replace_words(text: Column, words: Mapping[str, str], chars: Mapping[str, str]) -> Column:
    """The leftmost longest words by their values, and the other characters by theirs.

    Matches are marked in one pass; then the whole text goes through the characters, the marked words with it, and
    these are looked up as they have become. Two words that become one text, and texts that hold a mark, are
    converted part by part instead.
    """
    pattern, table = word_pattern(words), str.maketrans(dict(chars))
    by_char = (lambda part: replace_chars(part, chars)) if chars else None
    apart = replace_matches(text, pattern, LiteralMap(words).get, by_char)
    became = {word.translate(table): value for word, value in words.items()}
    marks = {_OPEN, _CLOSE}
    if len(became) < len(words) or any(marks & set(x) for x in (*words, *words.values(), *chars, *chars.values())):
        return F.when(text.rlike(pattern), apart).otherwise(by_char(text) if by_char else text)
    marked = replace_chars(F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}"), chars)
    if len(became) <= FEW:
        for word, value in became.items():
            marked = F.replace(marked, F.lit(_OPEN + word + _CLOSE), F.lit(value))
        together = marked
    else:
        values = LiteralMap(became)

        def looked_up(piece: Column, at: Column) -> Column:
            word = F.substring_index(piece, _CLOSE, 1)
            return F.when(at == 0, piece).otherwise(F.concat(values.get(word), F.substring_index(piece, _CLOSE, -1)))

        together = F.array_join(F.transform(F.split(marked, _OPEN, -1), looked_up), "")
    return F.when(F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_CLOSE)), apart).otherwise(together)
