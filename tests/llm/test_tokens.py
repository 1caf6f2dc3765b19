import os
import random
import resource
import string

import pytest

from loomspan.llm import tokens as K

PATH = os.path.join(K.TOKENIZERS, K.BYTE_BPE)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")

TEXTS = [
    "", None, " ", "   \n\n\t x", "don't they'll I'VE", "Größe µ ≥ 3 mm³, 被験者の頭部は体積", "<|endoftext|> is plain text", "a" * 1000, "ab" * 900, " " * 700, "x9x9 " * 50,
    "👍🏽 naïve — “q”", "́e​﻿", "é" * 500, "supercalifragilistic" * 40, "\r\n\r\n", "1234567890" * 30,
]


def test_equals_the_public_library():
    assert K.Encoder(PATH).encode(TEXTS) == public([x or "" for x in TEXTS])


def public(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(K.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def runs(alphabet, sizes, seed=1):
    r = random.Random(seed)
    return " ".join("".join(r.choices(alphabet, k=k)) for k in sizes)


HAN = [chr(c) for c in range(0x4E00, 0xA000)]


@pytest.mark.parametrize("chars", [20, 100, 300])
def test_many_unspaced_words_stay_within_memory(chars):
    text = runs(HAN, [chars] * 20_000)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = K.Encoder(PATH).encode([text])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_500_000  # kB; an executor has 3 GB
    assert got == public([text])


@pytest.mark.parametrize("alphabet", ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABab01+/", "a", "ab", "-=", "ÃÂ", "éè"])
def test_runs_of_every_length(alphabet):
    texts = [runs(alphabet, range(1, 200)), runs(alphabet, [5_000, 20_000])]
    assert K.Encoder(PATH).encode(texts) == public(texts)


def test_twenty_thousand_digit_and_letter_runs():
    texts = [runs("0123456789", [60] * 20_000), runs(string.ascii_lowercase, [100] * 2_000)]
    assert K.Encoder(PATH).encode(texts) == public(texts)


def test_every_entry_contracts_to_itself():
    e = K.Encoder(PATH)
    entries = sorted(e.ranks, key=len)
    for k in range(0, len(entries), 10_000):
        part = entries[k : k + 10_000]
        assert e._contract(part) == [[e.ranks[b]] for b in part]


def test_nothing_spans_a_cut():
    e = K.Encoder(PATH)
    words = [w.encode() for w in ["被験者の頭部は体積", "naïveté", " plain", "x", "龍契士の魔", "ÃÂÃÂ", "Ωß"]]
    for w, places in zip(words, e.cuts(words)):
        assert places[0] == 0
        for p in places[1:]:
            assert not any(w[i:j] in e.ranks for i in range(p) for j in range(p + 1, len(w) + 1))


def test_long_texts_come_in_portions(monkeypatch):
    monkeypatch.setattr(K, "BATCH_BYTES", 50)
    monkeypatch.setattr(K, "WORDS_AT_ONCE", 3)
    e = K.Encoder(PATH)
    assert e.encode(TEXTS) == public([t or "" for t in TEXTS]) and e.count(TEXTS) == [len(x) for x in public([t or "" for t in TEXTS])]


def test_round_trip():
    e = K.Encoder(PATH)
    back = {i: b for b, i in e.ranks.items()}
    for t in TEXTS:
        assert b"".join(back[i] for i in e.encode([t])[0]).decode() == (t or "")


def test_forgetting_loses_nothing(monkeypatch):
    monkeypatch.setattr(K, "KNOWN_BYTES", 500)
    e = K.Encoder(PATH)
    assert e.encode(TEXTS) == K.Encoder(PATH).encode(TEXTS)


def test_frame(spark):
    df = spark.createDataFrame([(n, t, "x") for n, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in K.encode(df).collect()}
    assert got[0] == [] and got[1] == [] and got == dict(enumerate(K.Encoder(PATH).encode(TEXTS)))
    assert K.encode(df.where("false")).count() == 0
    assert {r.doc_id: r.n_tokens for r in K.encode(df, counts_only=True).collect()} == {k: len(v) for k, v in got.items()}
