from __future__ import annotations

import random

import pyarrow as pa
import pytest

from kordex.llm import secrets

BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
OTHERS = ["1234567890123456789012345", "-" * 30, "internationalizationandlocalization", "articles/about/gardens-and/trees_in_towns", "some_long_identifier_with_parts_in_it"]


@pytest.mark.parametrize("length", [20, 24, 32, 40])
@pytest.mark.parametrize("others", [0, 2, 10, 50])
def test_recall_by_length_and_number_of_runs(length, others):
    rng, rest = random.Random(length), [OTHERS[k % len(OTHERS)] for k in range(others)]
    keys = ["".join(rng.choices(BASE64, k=length)) for _ in range(200)]
    found = [secrets.discoveries([*rest, k]) for k in keys]
    assert sum(others in f for f in found) >= 170
    assert not any(set(f) - {others} for f in found)


def test_keys_beside_signs_of_another_alphabet():
    rng = random.Random(3)
    keys = ["".join(rng.choices(BASE64[:62], k=32)) for _ in range(100)]
    texts = [f"see my-files/{k}/of_the-day now" for k in keys]
    found = secrets.scan(pa.array(texts))
    assert sum((t.index(k), t.index(k) + 32, 3) in f for t, k, f in zip(texts, keys, found, strict=True)) >= 85


def test_ordinary_runs_are_left_alone():
    plain = ["PYTHONFRAMEWORKINSTALLDIR", "SAXNOTSUPPORTEDEXCEPTION", "getElementByIdAndClassNameOrTag", "2024-01-15/report_final_v2_copy3", "usr/local/lib/python3/site-packages"]
    assert secrets.discoveries(plain) == [] and not any(secrets.discoveries([p]) for p in plain)
