"""URL filters: cascades against plain membership, rules, odd addresses."""

import random

import pytest
from pyspark.sql import functions as F

from quarterdeck.llm import url_filter as U

RULES = [U.Rule("allow", "org", "/"), U.Rule("block", "example.org", "/es/"), U.Rule("block", "example.org", "/en/1"),
         U.Rule("allow", "com", "/fr/"), U.Rule("block", "com", "/de/")]


@pytest.mark.parametrize("listed,others", [(0, 50), (50, 0), (1, 3000), (700, 3000), (3000, 20)])
def test_cascades_are_exact(rows, listed, others):
    keys = [f"host{i}.example" for i in random.Random(listed).sample(range(10**6), listed + others)]
    universe = rows("key string, listed boolean", [(k, i < listed) for i, k in enumerate(keys)])
    for bits in (U.MOST_BITS, 0):  # by filters, and by the join beyond their bound
        marked = U.mark(universe.select("key"), "key", universe, "found", bits)
        assert {r.key for r in marked.where("found").collect()} == set(keys[:listed]) and marked.count() == len(keys)


def test_a_cascade_needs_no_join_and_no_python(rows):
    universe = rows("key string, listed boolean", [(f"k{i}", i % 3 == 0) for i in range(300)])
    cascade = U.build_cascade(universe)
    assert len(cascade.levels) > 1
    plan = universe.where(cascade.contains(F.col("key")))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "Arrow" not in plan


def test_verdicts(rows):
    pages = [(1, "http://a.example.org/es/1"), (2, "https://EXAMPLE.org/en/12?x=/es/"), (3, "http://example.org/en/2"), (4, "http://b.com/fr/x#y"),
             (5, "http://b.com/de/x"), (6, "http://b.com/en/x"), (7, "http://c.com/en/x"), (8, "http://notexample.org/es/"), (9, "http://x.net"),
             (10, None), (11, "no scheme"), (12, ""), (13, "a://"), (14, "http://org"), (15, "http://h.com?q#z/de/"), (15, "http://h.com?q#z/de/"),
             (None, "x://y://z/w"), (17, "http://d.com" + "/de/" * 30_000), (18, "http://ÄB.com/é")]
    frame = rows("page_id long, url string, host string, rule string, listed string", [(*p, "h", "r", "l") for p in pages])
    found = U.judge(frame, RULES).collect()
    assert len(found) == len(pages)
    by = {r.page_id: tuple(r)[1:] for r in found}
    assert by[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert by[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert by[3] == ("example.org", "/en/2", "org/", "allow")
    assert by[4] == ("b.com", "/fr/x", "com/fr/", "allow")
    assert by[5][2:] == ("com/de/", "block")
    assert by[6] == ("b.com", "/en/x", None, "block")  # its host has a blocked page
    assert by[7] == ("c.com", "/en/x", None, "allow")
    assert by[8][2:] == ("org/", "allow")
    assert by[9] == ("x.net", "", None, "allow")
    assert by[10] == by[11] == by[12] == by[13] == ("", "", None, "allow")
    assert by[14] == ("org", "", None, "allow")  # no path, so no rule's path begins it
    assert by[15] == ("h.com", "", None, "allow")
    assert by[None] == ("y:", "//z/w", None, "allow")
    assert by[17][2:] == ("com/de/", "block") and by[18] == ("Äb.com", "/é", None, "allow")
    assert U.judge(rows("page_id long, url string", []), RULES).collect() == []
