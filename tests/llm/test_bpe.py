import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from flowlake.llm import bpe as B
from tests.llm.conftest import AWKWARD

ALPHABET = "abcdefghijklmnopqrstuvwxyz" * 2 + "ABCéßñİΣς'’''  \n\t0123456789<|>_-.,²½日本語🙂́\xa0　"
BITS = ["a\x1cb \x1f\x1d \x85\x0b\x0c ", "<|endoftext|>", "<|endof", "'re", "'ll", " don't", "    ", "\n\n\n  ", " 123", "!!!!", "'''s"]


@pytest.fixture(scope="module")
def both():
    path = public_tokenizers.path(B.TOKENIZER)
    return B.Vocabulary(path), Library.from_file(path)


def ids_of(lib, t):
    return lib.encode(t, add_special_tokens=False).ids


def test_equals_the_library_for_any_chunks(both, monkeypatch):
    monkeypatch.setattr(B, "HOLD", 20)
    vocab, lib = both
    rng, known = random.Random(1), B.Known(both[0])
    for n in range(1500):
        t = "".join(rng.choice(ALPHABET) if rng.random() < .8 else rng.choice(BITS) for _ in range(rng.randint(0, 80)))
        if n % 3 == 0:
            t = rng.choice("a \n'1!é日") * rng.randint(0, 90) + t + rng.choice("a \n'1!é日") * rng.randint(0, 90)
        want = ids_of(lib, t)
        for c in (1, 2, 5, 17, 1 << 16):
            assert B.Encoder(vocab, known).encode(t, c) == want, (c, t)


def test_the_lookahead_suffices_in_small_windows(both, monkeypatch):
    vocab, lib = both
    rng = random.Random(2)
    for letters in ("ab", "etaoinsh", "abcdefghijklmnopqrstuvwxyz", "é日ä", "=-_"):
        word = "".join(rng.choice(letters) for _ in range(6000)) + letters[0] * 3000
        s = B.WordStream(vocab)
        s.window = vocab.lookahead + vocab.longest
        got = [t for i in range(0, len(word.encode()), 61) for t in s.feed(word.encode()[i:i + 61])]
        assert len(s.held) <= s.window + 61
        assert got + s.finish() == vocab.merge(word.encode()) == ids_of(lib, word)


def test_lookahead_of_a_merge_list():
    # c|d takes c away, then b|cd takes b, then a|bcd takes a
    left, right = [b"c", b"b", b"a"], [b"d", b"cd", b"bcd"]
    assert B.lookahead(left, right) == 3
    assert B.lookahead(left[:1], right[:1]) == 1
    assert B.lookahead([b"a", b"c"], [b"b", b"d"]) == 1          # neither follows from the other
    assert B.lookahead([], []) == 0


def test_memory_stays_small_on_one_long_word(both):
    vocab, lib = both
    enc = B.Encoder(vocab)
    got = []
    for _ in range(40):
        got += enc.feed("xyz" * 1700)
        assert len(enc.held) <= B.HOLD and (enc.stream is None or len(enc.stream.held) <= enc.stream.window)
    assert got + enc.finish() == ids_of(lib, "xyz" * 1700 * 40)


def test_decoder_in_pieces_as_the_library(both):
    vocab, lib = both
    rng = random.Random(4)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(256), rng.randrange(50257)]) for _ in range(rng.randint(0, 30))]
        dec = B.Decoder(vocab)
        assert "".join(dec.feed([i]) for i in ids) + dec.finish() == lib.decode(ids, skip_special_tokens=False)


def test_documents(make_docs, both):
    rows = list(enumerate([*AWKWARD, "a<|endoftext|> b", "naïve  café\n\n"])) + [(None, "a b"), (3, "a")]
    out = B.decode(B.encode(make_docs(rows), chunk=1000)).collect()
    want = sorted(((i, ids_of(both[1], t or ""), t or "") for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.ids, r.text) for r in out), key=str) == want
    assert B.encode(make_docs([])).count() == 0


def test_decode_keeps_other_columns_and_odd_ids(ready_spark, both):
    rows = [(1, [15496, None, 10 ** 6], "old", "x"), (2, None, "old", "y"), (3, [], None, None), (4, [220, 50256], "", "z")]
    out = B.decode(ready_spark.createDataFrame(rows, "k int, ids array<int>, text string, extra string"))
    assert sorted((r.k, r.text, r.extra) for r in out.collect()) == [(1, "Hello", "x"), (2, None, "y"), (3, "", None), (4, " <|endoftext|>", "z")]


def test_query(ready_spark, both):
    import pyarrow.parquet as pq
    sf = "/root/testdata/sf0.001"
    docs = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r.doc_id: tuple(r) for r in B.op12(ready_spark, sf).collect()}
    for d in docs:
        ids = ids_of(both[1], d["text"] or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[d["doc_id"]] == (d["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(both[1].decode(ids, skip_special_tokens=False)))
    assert len(got) == len(docs)
