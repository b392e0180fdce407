"""Operator 1 on runs of digits that hold several values, or a value beside other numbers."""

import pytest

from quire.llm import pseudonyms

CARD = "4111 1111 1111 1111"
RUNS = {
    "123-45-6789 555-123-4567": ["ssn 123-45-6789", "phone 555-123-4567"],
    f"{CARD} 123": [f"card {CARD}"],
    "4111111111111111 12/25": ["card 4111111111111111"],
    "2024 555-123-4567": ["phone 555-123-4567"],
    f"1234 {CARD}": [f"card {CARD}"],
    "4111111111111111-123": ["card 4111111111111111"],
    f"é {CARD} 123-45-6789 +1 (212) 555-0199": [f"card {CARD}", "ssn 123-45-6789", "phone +1 (212) 555-0199"],
    "3782 822463 10005 99": ["card 3782 822463 10005"],
    "41111 11111 11111 1": ["card 41111 11111 11111 1"],
    "4111 1111 1111 1112 123": [],
    "000-12-3456 12345678901234567890": [],
}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame(list(enumerate(RUNS)), "doc_id long, old string").selectExpr("*", "old AS text")
    return {r.old: r for r in pseudonyms.pseudonymise(docs).collect()}


@pytest.mark.parametrize("text", RUNS)
def test_values_in_a_run(found, text):
    r = found[text]
    assert [f"{f.kind} {text[f.start : f.end]}" for f in r.found] == RUNS[text]
    at, new = 0, ""
    for f in r.found:
        assert f.pseudonym != text[f.start : f.end]
        new, at = new + text[at : f.start] + f.pseudonym, f.end
    assert r.text == new + text[at:]
