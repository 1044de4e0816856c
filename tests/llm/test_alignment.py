"""Alignment of two tokenizers against a plain version that takes whole texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quarterdeck.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, block string, pairs string, groups string, n_a string"


@pytest.fixture(scope="module")
def brute():
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in letters} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in letters)}

    def tokens(text):
        if not text:
            return [], []
        a = [(i, bytes(letter[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(second.id_to_piece(i)[3:-1], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode())
             for i in second.encode(text)]
        same = b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode()
        return (a, b) if same else ([], [])

    def spans(row):
        at, out = 0, []
        for ident, data in row:
            out.append((ident, at, at + len(data)))
            at += len(data)
        return out

    def align(texts):
        rows, heard = [], Counter()
        for text in texts:
            a, b = map(spans, tokens(text))
            cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
            groups = [[[i for i, s, e in row if low <= s and e <= high] for row in (a, b)] for low, high in zip([0, *cuts], cuts)]
            links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
            heard.update(links)
            rows.append((len(a), len(b), groups, links))
        best = defaultdict(int)
        for (_, j), n in heard.items():
            best[j] = max(best[j], n)
        return [(n_a, n_b, len(groups), len(links), sum(heard[x] == best[x[1]] for x in links), sum(heard[x] for x in links),
                 ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)) for n_a, n_b, groups, links in rows], heard

    return align


ODD = [None, "", " ", "  two  spaces ", "tab\there", "line\nend", "\nfirst", "last\n", "a\n\nb \n c", "<|endoftext|> is text", "</s> <s> <0x0A> <unk>",
       "naïve Ünïcode 中文字 😀 é", "▁ under ▁bar", "a▁b fine words", "it's we'll 'quoted' don't", "1234567 89,000.5", "nbsp\xa0here \xa0there",
       "\x00 zero", "　wide", "\x1c fs \x85 nel", "x" * 500, "word " * 300 + "end", "﻿bom", "tail ", "ﬁ ligature ½ Å", "a" + "̀" * 40]


def _rows(frame):
    return [tuple(r) for r in frame.select("doc_id", *alignment._COUNTS, "n_best", "count_sum", "groups").collect()]


def test_same_as_whole_texts(rows, spark, brute):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(40).collect() if len(r.text) < 8000]
    texts += texts[-3:]
    want, heard = brute(texts)
    frame = rows(SCHEMA, [(i, t, "b", "p", "g", "n") for i, t in enumerate(texts)]).repartition(3)
    found, pairs = alignment.align(frame, A, B)
    assert sorted(_rows(found)) == [(i, *w) for i, w in enumerate(want)]
    assert {(r.a, r.b): r.total for r in pairs.collect()} == dict(heard)
    digests, _ = alignment.align(frame, A, B, digest=True)
    assert sorted(_rows(digests)) == [(i, *w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for i, w in enumerate(want)]


def test_empty_tables_and_repeated_ids(rows, brute):
    assert _rows(alignment.align(rows(SCHEMA, []), A, B)[0]) == []
    assert _rows(alignment.align(rows("doc_id long, text string", [(1, None), (None, "")]).coalesce(1), A, B)[0]) == [
        (1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]
    want = brute(["same text", "same text", "other"])[0]
    found = _rows(alignment.align(rows("doc_id long, text string", [(7, "same text"), (7, "same text"), (None, "other")]), A, B)[0])
    assert sorted(found, key=str) == sorted([(7, *want[0]), (7, *want[1]), (None, *want[2])], key=str)


def test_groups_and_links_of_intervals():
    # A ends at 3, 5, 9; B at 2, 5, 7, 9: groups up to 5 and up to 9
    a, b = np.array([3, 5, 9]), np.array([2, 5, 7, 9])
    begin = lambda ends: np.concatenate([[0], ends[:-1]])
    group_a, group_b, link_a, link_b = alignment.coalesce(begin(a), a, begin(b), b)
    assert group_a.tolist() == [0, 0, 1] and group_b.tolist() == [0, 0, 1, 1]
    assert list(zip(link_a.tolist(), link_b.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2), (2, 3)]
    assert all(len(x) == 0 for x in alignment.coalesce(*[np.array([], np.int64)] * 4))
