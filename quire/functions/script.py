"""Traditional / Simplified conversion from user-supplied tables, as expressions of the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.literal import replace_chars, replace_words
from quire.functions.rows import let
from quire.functions.text import as_col

# Words in which 乾 is the proper name and stays, in the order they are protected.
PROTECTED_WORDS = (
    "乾坤", "乾元", "乾卦", "乾下", "乾上", "乾为", "乾爲", "乾阳", "乾陽",
    "乾龙", "乾龍", "乾纲", "乾宅", "乾隆", "乾乾", "乾造", "乾以", "乾行",
    "乾知", "乾始", "乾西北",
)
# The look-alike word that has to be settled before the protection.
BEFORE_PROTECTION = (("乾乾淨淨", "干干净净"),)
# Classical phrases put right after the conversion, and the single-character name.
AFTER_CONVERSION = (
    ("夫干", "夫乾"), ("乎干", "乎乾"), ("干乎", "乾乎"), ("谓之干", "谓之乾"),
    ("之谓干", "之谓乾"), ("《干》", "《乾》"), ("。干，健也", "。乾，健也"),
    ("。干，天也", "。乾，天也"), ("”干，阳物也", "”乾，阳物也"), ("曰“干", "曰“乾"),
)

#: Bound of a conversion table, which is part of the plan; `load` refuses a longer one, unless asked for more.
TABLE_LIMIT = 250_000

#: A mark is this character and one more; the character itself, where a text holds it, is marked as well.
_ESCAPE, _ITSELF, _WORDS = "\ue0ff", "\ue0fe", 0xE000


def _fold(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Ordered replacements."""
    if not pairs:
        return text
    table = F.arrays_zip(
        F.lit([a for a, _ in pairs]).alias("a"), F.lit([b for _, b in pairs]).alias("b")
    )
    return F.aggregate(table, text, lambda acc, p: F.replace(acc, p["a"], p["b"]))


class ScriptTable:
    """Characters and phrases of both directions."""

    def __init__(
        self,
        t2s_chars: Mapping[str, str],
        s2t_chars: Mapping[str, str],
        t2s_phrases: Mapping[str, str] | None = None,
        s2t_phrases: Mapping[str, str] | None = None,
    ):
        self._t2s = (dict(t2s_chars), dict(t2s_phrases or {}))
        self._s2t = (dict(s2t_chars), dict(s2t_phrases or {}))

    @classmethod
    def load(cls, conv: DataFrame, limit: int = TABLE_LIMIT) -> ScriptTable:
        """From a table (kind, from, to); kinds are t2s_char, t2s_phrase, s2t_char, s2t_phrase."""
        rows = conv.select("kind", "from", "to").limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"conversion table has more than {limit} entries")
        by_kind: dict[str, dict[str, str]] = {}
        for kind, a, b in rows:
            by_kind.setdefault(kind, {})[a] = b
        kinds = ("t2s_char", "s2t_char", "t2s_phrase", "s2t_phrase")
        return cls(*[by_kind.get(k, {}) for k in kinds])

    @staticmethod
    def _convert(text: Column, chars: Mapping[str, str], phrases: Mapping[str, str]) -> Column:
        """Leftmost longest phrases, and the characters outside them."""
        # a character that becomes several, or none, is a phrase of one
        words = {**{a: b for a, b in chars.items() if len(b) != 1}, **phrases}
        singles = {a: b for a, b in chars.items() if a not in words and a != b}

        return replace_words(text, words, singles) if words else replace_chars(text, singles)

    def simplified(self, c: str | Column) -> Column:
        """Every protected word holds 乾 and every later repair 干: text without them skips those steps."""
        text = as_col(c)
        frozen = [(w, _ESCAPE + chr(_WORDS + i)) for i, w in enumerate(PROTECTED_WORDS)]
        own = (_ESCAPE, _ESCAPE + _ITSELF)
        held = _fold(text, [own, *BEFORE_PROTECTION, *frozen])
        thaw = [(mark, word) for word, mark in frozen]
        guarded = _fold(self._convert(held, *self._t2s), [*thaw, own[::-1], *AFTER_CONVERSION])
        plain = let(
            self._convert(text, *self._t2s),
            lambda t: F.when(F.contains(t, F.lit("干")), _fold(t, AFTER_CONVERSION)).otherwise(t),
        )
        return F.when(F.contains(text, F.lit("乾")), guarded).otherwise(plain)

    def traditional(self, c: str | Column) -> Column:
        return self._convert(as_col(c), *self._s2t)

    def to_simplified(self, df: DataFrame, cols: Sequence[str]) -> DataFrame:
        return df.withColumns({c: self.simplified(c) for c in cols})

    def to_traditional(self, df: DataFrame, cols: Sequence[str]) -> DataFrame:
        return df.withColumns({c: self.traditional(c) for c in cols})
