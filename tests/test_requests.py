"""Requests as users type them."""

import pytest
from pyspark.sql import functions as F

from chronolex.functions import requests

VALUES = ["Haus", "Hausboot", "Mann", "a|b", "x/y", "Brand#1"]


def taken(spark, predicate):
    return [r["v"] for r in spark.createDataFrame([(v,) for v in VALUES], "v string").filter(predicate(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [("Haus", {"l": ["Haus"]}), ("Haus|Mann", {"l": ["Haus", "Mann"]}), ("l=Haus, p=Mann", {"l": ["Haus"], "p": ["Mann"]}), ("/^haus/i", {"l": ["Haus", "Hausboot"]}), ("/haus/gi", {"l": ["Haus"]}), ("Haus*", {"l": ["Haus", "Hausboot"]}),
     ("*boot", {"l": ["Hausboot"]}), ("*an*", {"l": ["Mann", "Brand#1"]}), (r"a\|b", {"l": ["a|b"]}), (r"/x\/y/", {"l": ["x/y"]}), ("$p=* Haus", {"p": VALUES, "l": ["Haus"]}), ("$l=Haus* WITH $p=Mann", {"l": ["Haus", "Hausboot"], "p": ["Mann"]}),
     ("l=Haus* l=*boot", {"l": ["Hausboot"]}), ("l:Haus", {"l": ["Haus"]}), ("", {}), (r"Brand\#1", {"l": ["Brand#1"]})],
)
def test_clauses(spark, text, want):
    assert {a: taken(spark, p) for a, p in requests.clauses(text, "l").items()} == want


def test_group_by(spark):
    items, having = requests.group_by("l,p=Haus|Mann")
    assert items == ["l", "p"] and {a: taken(spark, p) for a, p in having.items()} == {"p": ["Haus", "Mann"]}
    assert requests.group_by("$l $doc.genre, p=*") == (["l", "doc.genre", "p"], {})


def test_what_can_not_be_read():
    with pytest.raises(ValueError):
        requests.clauses("l=|", "l")
