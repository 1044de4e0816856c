"""Decontamination against a plain search for all windows."""

import random
import re

from quarterdeck.llm import decontamination
from tests.llm.brute import UPPER

DOCS = "doc_id long, text string, body string, words string, at string, items string, id string, start string"
ITEMS = "item_id long, text string, item string, window string, id string"


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def _brute(docs, items, window=10):
    cuts = set()
    for ident, text in items:
        w = _words(text)
        n = min(len(w), window)
        cuts |= {(ident, tuple(w[i:i + n])) for i in range(len(w) - n + 1) if w}
    out = []
    for ident, text in docs:
        w, hit, found = _words(text), set(), set()
        for item, cut in cuts:
            for i in range(len(w) - len(cut) + 1):
                if tuple(w[i:i + len(cut)]) == cut:
                    hit |= set(range(i, i + len(cut)))
                    found |= {str(item)} - {"None"}
        out.append((ident, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def _found(rows, docs, items, **more):
    found = decontamination.decontaminate(rows(DOCS, [(*d, "b", "w", "a", "i", "i", "s") for d in docs]),
                                          rows(ITEMS, [(*i, "i", "w", "d") for i in items]), **more)
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect()), key=str), found


def test_same_as_a_plain_search(rows):
    rnd = random.Random(5)
    # few words, so that shingles repeat much within and between texts
    text = lambda n: " ".join(rnd.choice(["a", "B", "c", "Ä", "d7", "the"]) + rnd.choice(["", ",", "."]) for _ in range(n))
    items = [(i, text(rnd.choice([1, 2, 3, 4, 5, 7, 9, 10, 11, 13, 30]))) for i in range(25)]
    items += [(30, None), (31, "  ..  "), (3, text(14)), (None, "only here twelve plain words stand in a row for no item id"), (32, items[4][1])]
    docs = [(i, text(rnd.choice([0, 1, 4, 5, 9, 10, 11, 40]))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, items[10][1]), (102, items[10][1]), (102, "other text of that id"), (None, items[9][1]),
             (103, "well ONLY here, twelve plain words stand in a row for no item id"), (104, "x " * 30_000 + items[24][1])]
    assert _found(rows, docs, items)[0] == _brute(docs, items)
    assert _found(rows, docs, items, window=6, shingle=3)[0] == _brute(docs, items, 6)


def test_ranges_and_a_share_of_the_shingles(rows):
    item = [(7, "one two three four five six seven eight nine ten")]
    docs = [(1, "so: One two three four five six seven EIGHT nine ten, yes"), (2, "one two three four five six seven eight nine eleven"),
            (3, "one two three four five"), (4, "ten nine eight seven six five four three two one")]
    found, frame = _found(rows, docs, item)
    assert found == [(1, 12, 10, ["7"]), (2, 10, 0, []), (3, 5, 0, []), (4, 10, 0, [])]
    assert [tuple(x) for x in frame.where("doc_id = 1").first()["ranges"]] == [(1, 11)]
    # five of six shingles stand in document 2
    assert _found(rows, docs, item, percent=80)[0][1] == (2, 10, 10, ["7"])


def test_empty_tables(rows):
    assert _found(rows, [], [(1, "a b")])[0] == []
    assert _found(rows, [(1, "a b")], [])[0] == [(1, 2, 0, [])]
    assert _found(rows, [(1, "a b")], [(1, "?")])[0] == [(1, 2, 0, [])]
