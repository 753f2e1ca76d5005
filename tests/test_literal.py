"""Dictionaries in expressions against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions.literal import LiteralMap, replace_chars, replace_matches, replace_words, word_pattern
from quire.functions.script import ScriptTable


def plain(text, words, chars):
    """Leftmost longest word, else the character."""
    out, at, longest = [], 0, max(map(len, words), default=0)
    while at < len(text):
        for n in range(longest, 0, -1):
            if text[at : at + n] in words:
                out.append(words[text[at : at + n]])
                at += n
                break
        else:
            out.append(chars.get(text[at], text[at]))
            at += 1
    return "".join(out)


TEXTS = ["", "the quick the", "abcabdab", "thethe", "﷐the﷑ a", "zz$\\.*+[]", "ab\x00c\n the\r\nqu", "𠀀𠀁the𠀀", "e3the3", None]


@pytest.mark.parametrize(
    "words, chars",
    [
        ({"the": "THE", "qu": "KW", "th": "", "thethe": "2"}, {"e": "3", "é": "e", "t": "7"}),
        ({"ab": "1", "abc": "22", "bd": "x", "c": "﷐"}, {"a": "b", "b": "a"}),  # characters that change places
        ({"$\\": "<$0>", ".*": "\\1", "[]": "", "z": "zz"}, {}),
        ({"ae": "1", "be": "2"}, {"a": "b"}),  # two words that become one
        ({"𠀀𠀁": "x", "𠀀": "yy"}, {"𠀁": "z", "h": "𠀀"}),
        ({f"{a}{b}": f"<{b}{a}>" for a in "abcdehtqu" for b in "abcdehtqu"}, {c: c.upper() for c in "abcdefghijklmnopqrstuvwxyz"}),
    ],
)
def test_replace_words(spark, words, chars):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [r[0] for r in df.select(replace_words(F.col("t"), words, chars)).collect()]
    assert got == [None if t is None else plain(t, words, chars) for t in TEXTS]


def test_a_large_dictionary(spark):
    rng = random.Random(1)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    words = {"".join(rng.choices(letters, k=rng.choice([1, 2, 2, 3, 5]))): f"<{i}>" for i in range(8000)}
    chars = {c: chr(ord(c) + 5000) for c in letters[:500]}
    some = list(words)
    texts = ["".join(rng.choice(some) if rng.random() < 0.3 else rng.choice(letters) for _ in range(60)) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", replace_words(F.col("t"), words, chars).alias("out"))
    assert all(r.out == plain(r.t, words, chars) for r in df.collect())
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_look_ups_and_matches(spark):
    table = LiteralMap({"a": "1", "b": "", "": "none", "": ""})
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("",), ("",), (None,)], "k string")
    assert [r[0] for r in df.select(table.get(F.col("k"))).collect()] == ["1", "", None, "none", "", None]
    assert df.limit(1).select(replace_matches(F.lit("x1y22"), "[0-9]+", lambda m: F.concat(F.lit("("), m, F.lit(")")))).first()[0] == "x(1)y(22)"
    assert df.limit(1).select(replace_chars(F.lit("aabc"), {"a": "b", "b": "c", "c": "c"})).first()[0] == "bbcc"
    assert word_pattern(["ab", "a"]) == "a(?:b)?"


def test_conversion_takes_no_python(spark):
    table = ScriptTable({"乾": "干", "陽": "阳", "髮": "发"}, {"干": "乾", "发": "發"}, {"乾隆": "x", "白髮": "白头"}, {"头发": "頭髮"})
    df = spark.createDataFrame([("乾隆 乾杯 白髮 髮",), ("陽",), (None,)], "t string").select(
        table.simplified("t").alias("s"), table.traditional("t").alias("z")
    )
    assert [tuple(r) for r in df.collect()] == [("乾隆 干杯 白头 发", "乾隆 乾杯 白髮 髮"), ("阳", "陽"), (None, None)]
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
