"""Language identification: held-out accuracy, and what each sort of evidence does."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterdeck.llm import language_id as L

DATA = "/root/testdata/sf0.001"
RECORDS = "id long, text string, declared string, host string, suffix string, keys string, lang string, belief string"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return L.fit_text(docs.where("doc_id % 2 = 0"))


def _records(rows, *data):
    return rows(RECORDS, [(i, *r, "k", "l", "b") for i, r in enumerate(data)])


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 2 = 1")
    # the truth is hidden: neither declared nor known from the source
    records = L.records_of(docs.withColumn("truth", F.col("lang")).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("x")))
    found = L.identify(records, model).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    total = found.count()
    assert found.where("lang = truth AND accepted").count() >= 0.99 * total


def test_pages_are_read_from_their_markup(spark, model):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    found = L.identify(L.records_of(docs, pages), model).collect()
    assert len(found) == pages.count() and all(r.accepted and r.page_id is not None and r.doc_id is None for r in found)


def test_declaration_and_host_decide_where_the_text_cannot(rows, model):
    english, german = "the tion and of the that er in the on", "und der die sich ver heit ein ung mit"
    learned = [(english, "en", "a.example.com", "com")] * 30 + [(german, "de", "b.example.de", "de")] * 30
    short = [("xi", None, "a.example.com", "com"), ("xi", None, "b.example.de", "de"), ("xi", "de", "c.other.net", "net"), ("xi", "en", None, None),
             ("xi", None, "new.example.de", "de")]
    found = {r.id: r for r in L.identify(_records(rows, *learned, *short), model, threshold=0.0).collect()}
    assert [found[60 + i].lang for i in range(5)] == ["en", "de", "de", "en", "de"]


def _plain(records, model):
    """(probabilities) by plain arithmetic over all rows."""
    def softmax(logs):
        raw = np.exp(logs - logs.max())
        return raw / raw.sum()

    size = len(model.langs) + 1
    logs = [model.table[:, L.trigrams((t or "").encode())].astype(float).sum(axis=1) * L.TEMPER for t, *_ in records]
    votes = [softmax(x) if len(L.trigrams((r[0] or "").encode())) else np.zeros(size) for x, r in zip(logs, records, strict=True)]
    where = [((r[3] or ""), (r[2] or "")) for r in records]
    told = [(r[1] or "").strip().lower() for r in records]
    whole = sum(votes)
    share = (whole + 1) / (whole.sum() + size)
    out = []
    for i, (suffix, host) in enumerate(where):
        of_suffix = sum(v for v, w in zip(votes, where, strict=True) if w[0] == suffix)
        prior = (of_suffix + L.SUFFIX_STRENGTH * share) / (of_suffix.sum() + L.SUFFIX_STRENGTH)
        others = np.maximum(sum(v for v, w in zip(votes, where, strict=True) if w == (suffix, host)) - votes[i], 0)
        fused = logs[i] + np.log((others + L.HOST_STRENGTH * prior) / (others.sum() + L.HOST_STRENGTH))
        if told[i]:
            same = sum(v for v, d in zip(votes, told, strict=True) if d == told[i])
            fused = fused + np.log((same + L.DECLARED_STRENGTH) / (whole + L.DECLARED_STRENGTH * len(set(told))))
        out.append(softmax(fused).max())
    return out


def test_fusion_against_plain_arithmetic(rows, model):
    words = ["the", "of", "and", "der", "und", "ver", "que", "les", "xi", "tion", "12"]
    rnd = np.random.default_rng(4)
    data = [(" ".join(rnd.choice(words, rnd.integers(0, 6))), [None, "en", "DE ", "fr"][rnd.integers(4)],
             *[(None, None), ("a.x.com", "com"), ("b.x.com", "com"), ("c.y.de", "de")][rnd.integers(4)]) for _ in range(120)]
    found = L.identify(_records(rows, *data), model).orderBy("id").collect()
    assert np.allclose([r.probability for r in found], _plain(data, model), rtol=1e-6)


def test_documents_declare_nothing(rows, model):
    """A wrong label changes no verdict."""
    docs = rows("doc_id long, text string, lang string, source string", [(i, "the tion and of the that er in the on", x, "s") for i, x in enumerate(["en", "de", None])])
    found = L.identify(L.records_of(docs), model).collect()
    assert {r.lang for r in found} == {"en"} and len({r.probability for r in found}) == 1


def test_odd_rows(rows, model):
    noise = "zq9xkv" * 3 + "Qx Zk Wv Jq Xz Kq Vx Zj Qk Wx" * 40
    long = "the tion and of the that er in the on " * 20_000
    found = L.identify(_records(rows, (None, None, None, None), ("", "en", "h", "s"), (" 12 !!", "fr", "h", "s"), (noise, None, None, None),
                                (long, "xx", "h", None), (long, "xx", "h", None)), model).orderBy("id").collect()
    assert found[0].__fields__ == ["id", "keys", "belief", "lang", "probability", "accepted"]
    assert [r.lang for r in found[:3]] == ["und"] * 3 and not any(r.accepted for r in found[:4])
    assert [(r.lang, r.accepted) for r in found[4:]] == [("en", True)] * 2
    assert L.identify(_records(rows), model).collect() == []


def test_fit_is_bounded_and_ignores_unlabelled_rows(rows):
    docs = rows("doc_id long, text string, lang string", [(i, f"text {i}", "en") for i in range(400)] + [(999, "nothing", None), (998, None, "fr"), (997, "x", "")])
    assert L.fit_text(docs).langs in (["en"], ["en", "fr"])
    small = L.fit_text(docs, labelled_rows=40)
    assert small.langs and small.table.shape[1] == L.SLOTS
    assert L.fit_text(docs.limit(0)).langs == []


def test_every_label_is_in_the_model(rows):
    """A rare language stays as the others grow, with all its rows as long as they are fewer than its part."""
    common = [(i, f"text number {i}", "en" if i % 3 else "de") for i in range(6000)]
    rare = [(10_000 + i, "xyz", "is") for i in range(5)] + [(20_000, "uvw", "fo")]
    model = L.fit_text(rows("doc_id long, text string, lang string", common + rare), labelled_rows=60)
    assert model.langs == ["de", "en", "fo", "is"]
    # three trigrams a row: one row of fo has raised three slots, five rows of is have raised theirs five times
    raised = [sorted(set((np.exp(row - row.min()) * 0.5).round(1).tolist())) for row in model.table[2:4].astype(float)]
    assert raised == [[0.5, 1.5], [0.5, 5.5]]


def test_parts_add_up():
    assert L.equal_part([4, 100, 100], 24) == 10 and L.equal_part([4, 5], 24) >= 5 and L.equal_part([], 24) == 0
    assert L.equal_part([100] * 4, 10) == 2.5
