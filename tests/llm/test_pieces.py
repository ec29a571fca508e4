import os

import numpy as np
import pytest

from cairn.llm import common, pieces as P
from cairn.llm.queries import PIECE_MODEL

pytestmark = pytest.mark.skipif(not os.path.exists(PIECE_MODEL), reason="no model file")
TEXTS = ["Hello world", "  two  spaces ", "naïve café über", "line\n\ttab", "数学 😀", "", "▁ literal ▁x", "x" * 300, "don't stop-now 12345", " "]


@pytest.fixture(scope="module")
def model():
    return P.Pieces(PIECE_MODEL)


def lists(enc, texts):
    flat, n = enc.encode(texts, list(range(len(texts))))
    ends = np.cumsum(n)
    return [flat[e - k : e].tolist() for k, e in zip(n, ends)]


def test_no_dropout_is_the_library(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    texts = [t for t in TEXTS if "▁" not in t]
    assert lists(P.Encoder(model, 0.0, 7), texts) == [sp.encode(t) for t in texts]


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_lossless(model, rate):
    assert [P.decode(i, model) for i in lists(P.Encoder(model, rate, 7), TEXTS)] == TEXTS


def test_blocks_equal_the_agenda(model):
    words = list(dict.fromkeys(w for t in TEXTS + ["internationalization of tokenization characteristics"] for w in P._CHUNK.findall(" " + t)))
    keys = common.mix64(np.arange(len(words), dtype=np.uint64))
    limit = int(0.3 * 2**64)
    ids, n = P.merge_all(words, keys, model, limit)
    ends = np.cumsum(n)
    for w, k, c, e in zip(words, keys, n, ends):
        want = [i if i >= 0 else model.byte[-2 - i] for i in P.agenda(model.start(w), model, int(k), limit)]
        assert ids[e - c : e].tolist() == want


def test_varied_and_repeatable(model):
    text = ["characteristics internationalization " * 200]
    a, b, c = (lists(P.Encoder(model, 0.3, s), text)[0] for s in (1, 1, 2))
    assert a == b and a != c
    assert len({tuple(x) for x in np.array_split(np.array(a[:60]), 6)}) > 1


@pytest.mark.parametrize("rate", [0.1, 0.6])
def test_every_occurrence_draws_its_own_skips(model, rate):
    texts = TEXTS + ["characteristics of tokenization, don't 数学 été " * 300] * 2
    enc = P.Encoder(model, rate, 7)
    seen, met = set(), 0
    for _ in range(2):  # the second time from memory
        got = lists(enc, texts)
        for row, t in enumerate(texts):
            want = []
            for place, w in enumerate(P._CHUNK.findall(" " + t) if t else []):
                key = P._mix(P._mix((place * 0x9E3779B97F4A7C15 & P._M64) ^ row, 2) ^ int(enc.seed), 3)
                ids = [i if i >= 0 else model.byte[-2 - i] for i in P.agenda(model.start(w), model, key, enc.limit)]
                want += ids
                if w == " characteristics":
                    seen.add(tuple(ids))
                    met += 1
            assert got[row] == want
    assert met >= 1000 and len(seen) > 3


def test_spark(spark, docs_of, odd):
    got = P.encode(docs_of(odd, ids=[None, 1, 2, 3, 4, 4, 6, 7]), PIECE_MODEL).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 8 and by[None].ids is None and by[None].lossless is None and by[1].ids == [] and by[1].lossless
    assert all(r.lossless for r in got if r.ids is not None)
    same = [r.ids for r in got if r.doc_id == 4]
    assert same[0] == same[1]
    assert P.encode(docs_of([]), PIECE_MODEL).count() == 0


def test_heap_and_block_merging_agree(model, monkeypatch):
    texts = ["the quick brown foxes jumped over seventeen lazily sleeping dogs " * 3, "Überraschung naïve 東京 xyz▁q", "", None]
    got = []
    for few in (0, 1 << 30):
        monkeypatch.setattr(P, "FEW", few)
        got.append([x.tolist() for x in P.Encoder(model, 0.3, 7).encode(texts, [1, 2, 3, 4])])
    assert got[0] == got[1]


def test_direct_merging_equals_the_trees(model, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("etaoinshr"), rng.integers(1, 14))) for _ in range(60)) + " the the of of" for _ in range(20)]
    got = lists(P.Encoder(model, 0.2, 7), texts)
    two = P.Encoder(model, 0.2, 7)
    lists(two, texts)
    assert lists(two, texts) == got  # all chunks are known by now
    monkeypatch.setattr(P, "MEMO", 0)  # every chunk is merged with its own skips
    assert lists(P.Encoder(model, 0.2, 7), texts) == got
