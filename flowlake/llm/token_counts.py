"""Exact token counts from a compiled finite-state tokenizer.

Method.  Byte-pair merges over a word are a deterministic transducer: reading
a byte, the last token of the prefix read so far is the one token that ends
there, is made by the merges from its own bytes, and stays apart from the last token
of the prefix before it.  A state is therefore the few places where a longer token may
still have begun, each with its last token and its token count; a transition's
output is the change in emitted tokens.  Transitions are compiled when first
needed and annotated with that number, so a known word costs a table
lookup per byte, and a known whole word one lookup.

A text is read in chunks.  The transducer's state at the begin of a chunk is
unknown, but white space resets it, so a chunk's state map is the pending
fragment before its first white space, the tokens emitted in between, and the
fragment after its last one (or a single fragment, where no white space
occurs).  Maps compose associatively, and a balanced prefix scan joins the
chunks of a text: chunks may be cut anywhere, and the count is exact.

Memory is bounded: a chunk, and tables of ``TABLE`` entries that start anew when
full.  Texts stay in their tasks.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from flowlake.llm.common import own_columns, query, read

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048                    # tokens
CHUNK = 1 << 16                 # code points
TABLE = 300_000


def byte_letters() -> dict[str, int]:
    """Letters that byte-level vocabularies use for bytes: printable ones stand for themselves, the rest follow 255."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeTransducer:
    """Words (bytes) to token counts, by transitions compiled on demand.

    The last byte of a word is a symbol of its own (+ 256), as the vocabulary has its own units for it.
    """

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        letters = byte_letters()
        self.suffix, self.rank = suffix, {tuple(m): i for i, m in enumerate(merges)}
        self.units: list[list[str]] = []
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.names: list[str] = []
        for name in vocab:
            body = name.removesuffix(suffix) if suffix else name
            if not body or any(c not in letters for c in body):
                continue
            final = bool(suffix) and name != body
            units = list(body[:-1]) + [body[-1] + suffix] if final else list(body)
            node = 0
            for i, c in enumerate(body):
                sym = letters[c] + (256 if final and i == len(body) - 1 else 0)
                nxt = self.trie[node].get(sym)
                if nxt is None:
                    nxt = self.trie[node][sym] = len(self.trie)
                    self.trie.append({})
                    self.token.append(-1)
                node = nxt
            self.token[node] = len(self.names)
            self.names.append(name)
            self.units.append(units)
        self.apart: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, int] = {((0, -1, 0),): 0}
        self.open: list[tuple] = [((0, -1, 0),)]
        self.step: dict[int, tuple[int, int]] = {}
        self.apart.clear()

    def merge(self, units: list[str]) -> list[str]:
        units = list(units)
        while len(units) > 1:
            best = min(((self.rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(units, units[1:], strict=False))))
            if best[0] == 1 << 60:
                break
            a, b = units[best[1]], units[best[1] + 1]
            out, i = [], 0
            while i < len(units):                  # every such pair, from the left
                if i + 1 < len(units) and units[i] == a and units[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(units[i])
                    i += 1
            units = out
        return units

    def _stays(self, left: int, right: int) -> bool:
        key = (left, right)
        got = self.apart.get(key)
        if got is None:
            ahead = [] if left < 0 else self.units[left]
            want = [self.names[right]] if left < 0 else [self.names[left], self.names[right]]
            got = self.apart[key] = self.merge(ahead + self.units[right]) == want
        return got

    def _compile(self, state: int, sym: int) -> tuple[int, int]:
        last = emitted = None
        alive = []
        for node, before, count in self.open[state]:
            nxt = self.trie[node].get(sym)
            if nxt is None:
                continue
            tok = self.token[nxt]
            if last is None and tok >= 0 and self._stays(before, tok):
                last, emitted = tok, count + 1
            if self.trie[nxt]:
                alive.append((nxt, before, count))
        if last is None:
            raise ValueError(f"the vocabulary has no token for byte {sym % 256}")
        key = (*[(n, b, c - emitted) for n, b, c in alive], (0, last, 0))
        to = self.states.setdefault(key, len(self.open))
        if to == len(self.open):
            self.open.append(key)
        out = self.step[state * 512 + sym] = (to, emitted)
        return out

    def count(self, word: bytes) -> int:
        if len(self.step) > TABLE:
            self.reset()
        state = total = 0
        for sym in [*word[:-1], word[-1] + 256 if self.suffix else word[-1]]:
            t = self.step.get(state * 512 + sym) or self._compile(state, sym)
            state, total = t[0], total + t[1]
        return total


class Known(dict):
    """Token counts of the words met so far; a new one goes through the transducer."""

    def __init__(self, bpe: BpeTransducer):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> int:
        if len(self) > TABLE:
            self.clear()
        n = self[word] = self.bpe.count(word.encode())
        return n


class Tokenizer:
    """The counting part of one vocabulary file: special strings, normaliser, word pattern, merges."""

    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
    GAP = re.compile(r"[ \t\n\r]")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.bpe = BpeTransducer(spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]],
                                 spec["model"]["end_of_word_suffix"] or "")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.known = Known(self.bpe)

    def plain(self, text: str) -> int:
        if text.isascii():
            words = self.ASCII.findall(text.lower())
        else:
            # the library lowers character by character: no final sigma
            words = self.WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        return sum(map(self.known.__getitem__, words))

    def count(self, text: str) -> int:
        """Tokens of a text between resets: special strings count one each and split what is around them."""
        if "<|" not in text or self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))

    # state maps of chunks: (fragment,) without a reset, or (before, emitted, after)
    def chunk_map(self, text: str) -> tuple:
        first = self.GAP.search(text)
        if first is None:
            return (text,)
        last = max(text.rfind(c) for c in " \t\n\r")
        return text[:first.start()], self.count(text[first.start(): last + 1]), text[last + 1:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        if len(a) == 1:
            return (a[0] + b[0],) if len(b) == 1 else (a[0] + b[0], *b[1:])
        if len(b) == 1:
            return (*a[:2], a[2] + b[0])
        return a[0], a[1] + self.count(a[2] + b[0]) + b[1], b[2]

    def scan(self, maps: list[tuple]) -> tuple:
        """Balanced composition of the chunk maps in order."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def tokens(self, text: str, chunk: int = CHUNK) -> int:
        if len(text) <= chunk:
            return self.count(text)
        m = self.scan([self.chunk_map(text[i:i + chunk]) for i in range(0, len(text), chunk)])
        return self.count(m[0]) if len(m) == 1 else self.count(m[0]) + m[1] + self.count(m[2])


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    ``path`` is a vocabulary file of the same layout, readable on every executor; by default it is
    looked up there.  A null text counts as empty.  Repeated rows are counted alike.  Extra columns are ignored.
    """
    def run(batches):
        tok = Tokenizer(path or public_tokenizers.path(TOKENIZER))
        for batch in batches:
            n_bytes, n_tok = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, v in enumerate(batch.column(1)):
                t = v.as_py() or ""
                n_bytes[i], n_tok[i] = len(t.encode()), tok.tokens(t, chunk)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tok), pa.array(n_tok > limit)],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])
    d = own_columns(docs, "doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document."""
    return count_tokens(read(spark, sf_dir, "documents"))
