import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from flowlake.llm import token_counts as T
from tests.llm.conftest import AWKWARD


@pytest.fixture(scope="module")
def both():
    path = public_tokenizers.path(T.TOKENIZER)
    return T.Tokenizer(path), Library.from_file(path)


def test_equals_the_library_for_any_chunks(both):
    own, lib = both
    rng = random.Random(5)
    alphabet = "abcdefghijklmnopqrstuvwxyz" * 3 + "ABCéßñİΣς'’ \n\t0123456789<|>_-.,²½日本語🙂́  "
    for _ in range(1500):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        t += rng.choice(["", "", "<|endoftext|>", "a<|startoftext|>'s", " don't I'LL we've"])
        want = len(lib.encode(t, add_special_tokens=False).ids)
        assert {own.tokens(t, c) for c in (1, 2, 5, 17, 1 << 16)} == {want}, repr(t)


def test_tables_start_anew_when_full(both, monkeypatch):
    monkeypatch.setattr(T, "TABLE", 50)
    own, lib = T.Tokenizer(public_tokenizers.path(T.TOKENIZER)), both[1]
    t = " ".join(f"word{i}ing" for i in range(400))
    assert own.tokens(t) == len(lib.encode(t, add_special_tokens=False).ids)
    assert len(own.known) <= 52


def test_documents(make_docs, both):
    rows = list(enumerate(AWKWARD)) + [(None, "a b"), (3, "a")]
    out = T.count_tokens(make_docs(rows)).collect()
    want = [(i, len((t or "").encode()), n := len(both[1].encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows]
    assert sorted((tuple(r) for r in out), key=str) == sorted(want, key=str)
    assert T.count_tokens(make_docs([])).count() == 0
