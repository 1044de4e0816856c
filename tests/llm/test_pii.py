"""Personal data: base spans by plain regular expressions, discovery on a fixture, redaction."""

import random
import re

from quarterdeck.llm import pii
from tests.llm.brute import personal

CLASH = "doc_id long, text string, body long, kind string, cuts string, own string, ident string"


def _frame(rows, docs):
    return rows(CLASH, [(*d, 1, "k", "c", "o", "i") for d in docs])


def _base(text):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in personal(text))


def test_base_spans(rows):
    rnd = random.Random(3)
    parts = [*"a0@.+- (1)", "ab", "@x.y", "1.2.3.4", "4111 1111 1111 1111", "+49 (30) 1234567", "é", "\n", "255", "256", "😀", "0", "7"]
    docs = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))) for i in range(1500)]
    docs += [(9000, None), (9000, ""), (None, "a@b.c 1.2.3.4"), (9001, "1" * 20_000 + " " + "a" * 50_000 + "@" + ".b" * 9000), (9002, "x 10.0.0.1\n" * 3000),
             (9003, "a@b.org"), (9003, "a@b.org")]
    found = pii.find_personal_data(_frame(rows, docs)).collect()
    assert sorted(((r.doc_id, r.base_spans) for r in found), key=str) == sorted(((i, _base(t)) for i, t in docs), key=str)
    for r in found:
        kinds = [s.split(":")[0] for s in r.base_spans.split(",") if s]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in pii.BASE]
    assert pii.find_personal_data(rows("doc_id long, text string", [])).collect() == []


SEEDS = ["4111111111111111", "+49 30 1234567", "jo@example.org", "10.1.2.3", "ann@example.org", "+1 212 5550100", "10.9.9.9", "kim@example.org"]


def test_cues_of_seeds_discover_other_identifiers(rows):
    docs = [(i, f"Filed today, account holder {s} as agreed") for i, s in enumerate(SEEDS)]
    docs += [(20, "Filed late, account holder AB-998877-C as agreed"), (21, "see AB-998877-C again"), (22, "the order number 5566778 stays"), (23, "account holder Smith")]
    found = {r.doc_id: r.spans for r in pii.find_personal_data(_frame(rows, docs)).collect()}
    assert found[20] == "found:27:38" and found[21] == "found:4:15" and found[22] == "" and found[23] == ""
    assert found[0] == _base(docs[0][1]) == "card:28:44"


def test_a_second_round_learns_from_what_the_first_found(rows):
    new = [f"QX-{10000 + i}-{i}" for i in range(12)]
    docs = [(i, f"account holder {s} ok") for i, s in enumerate(SEEDS * 2)] + [(100 + i, f"account holder {x} ok") for i, x in enumerate(new[:2])]
    docs += [(200 + i, f"member code {x} ok") for i, x in enumerate(new[:2] + SEEDS[:6])] + [(300, "member code ZZ-77777-Z ok")]
    one = {r.doc_id: r.n_found for r in pii.find_personal_data(_frame(rows, docs), rounds=1, confidence=0.7).collect()}
    two = {r.doc_id: r.n_found for r in pii.find_personal_data(_frame(rows, docs), rounds=3, confidence=0.7).collect()}
    assert one[100] == two[100] == 1 and (one[300], two[300]) == (0, 1)


def test_a_label_with_as_many_unknown_as_known_values_finds_them(rows):
    new = [f"QX-{10000 + i}-{i}" for i in range(len(SEEDS))]
    docs = [(i, f"Filed today. Holder:  {s} as agreed") for i, s in enumerate(SEEDS)] + [(100 + i, f"filed. holder: {x}, as agreed") for i, x in enumerate(new)]
    # a label that mostly precedes words is none of identifiers, however many seeds follow it
    docs += [(200 + i, f"note: {s} ok") for i, s in enumerate(SEEDS)] + [(300 + i, f"Note: w{chr(97 + i)} then") for i in range(6)] + [(400, "note: AB-123456-C ok")]
    docs += [(500, "seen QX-10003-3 there"), (501, "holder: nobody")]
    found = {r.doc_id: r.n_found for r in pii.find_personal_data(_frame(rows, docs)).collect()}
    assert [found[100 + i] for i in range(len(new))] == [1] * len(new) and found[500] == 1
    assert found[400] == found[501] == 0 and not any(found[i] for i in range(len(SEEDS)))


def test_planted_secrets_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    planted = {(i, m.start(1), m.end(1)) for i, t in texts.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    found = {(r.doc_id, int(a), int(b)) for r in pii.find_personal_data(docs).collect() for kind, a, b in
             (s.split(":") for s in r.spans.split(",") if s) if kind == "found"}
    assert len(planted) > 5 and len(found & planted) >= 0.9 * len(planted)
    assert found <= planted


def test_redaction(rows):
    docs = [(1, "😀 write jo@example.org or 10.0.0.1, é +49 30 1234567."), (2, None), (3, "nothing"), (4, "10.0.0.1"), (4, "10.0.0.1"), (None, "a@b.org x"),
            (6, "12345@10.0.0.1 y")]
    frame = _frame(rows, docs)
    out = pii.redact(frame)
    assert out.columns == frame.columns and {r.cuts for r in out.collect()} == {"c"}
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, "😀 write [EMAIL] or [IP], é [PHONE]."), (2, None), (3, "nothing"), (4, "[IP]"), (4, "[IP]"), (None, "[EMAIL] x"), (6, "[EMAIL] y")], key=str)
