"""Linear grouping against plain sorting."""

from __future__ import annotations

import random

from ledger_spark.llm.suffix_groups import suffix_array


def test_equals_sorting():
    rng = random.Random(1)
    for _ in range(3000):
        text = [rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.randrange(0, 40))]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:]), text


def test_larger_texts():
    rng = random.Random(2)
    unit = [rng.randrange(4) for _ in range(90)]
    for text in ([0] * 3000, unit * 30, [rng.randrange(200) for _ in range(5000)], list(b"mississippi" * 200)):
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
