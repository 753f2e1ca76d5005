"""Plain and disguised spans of one text are merged without comparing all of them."""

import random

from quire.llm import pii


def plain_merge(text):
    plain = list(pii.detect(text))
    found = [(k, s, e, True) for k, s, e in plain]
    for k, s, e in dict.fromkeys(pii.disguised(text)):
        if not any(k == pk and ps <= s and e <= pe for pk, ps, pe in plain):
            found.append((k, s, e, False))
    return sorted(found, key=lambda x: (pii.KINDS.index(x[0]), x[1], x[2], not x[3]))


def test_disguised_spans_within_plain_ones_are_left_out():
    rng = random.Random(6)
    parts = ["jane@example.com", "jane [at] example [dot] org", "jаne@example.com", "10.0.0.1", "10[.]0[.]0[.]1", "+49 30 1234567", "plus 49 30 1234567", "words"]
    for _ in range(60):
        text = rng.choice([" ", " and ", ", "]).join(rng.choices(parts, k=rng.randrange(1, 30)))
        assert pii.personal_data(text) == plain_merge(text)


def test_many_spans_in_one_text():
    text = " ".join(f"jane{i}@example.com and bob{i} [at] example [dot] org" for i in range(4000))
    found = pii.personal_data(text)
    assert len(found) == 8000 and sum(plain for *_, plain in found) == 4000
