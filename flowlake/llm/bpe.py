"""Byte-level BPE as a streaming transducer of bounded lookahead, and its inverse.

Method.  Merges run in rank order, so what follows a text can only change its tokens through a chain:
a merge across its end takes the last token before the end away, a later merge across the new
end takes the next one, and so on.  A chain goes on from merge j to a later merge k only if the right part of
k begins with the left part of j, because at that place starts what j's left part became.
``lookahead`` computes the heaviest chain of the merge list in one pass in rank order (the bytes of
its left parts): any token that ends so many bytes before the end of what has been read is final.

Text goes through in chunks.  Words are cut by a machine that holds back only what the word pattern still has
to look at; a word longer than ``HOLD`` runs through the merges in windows that emit their
stable tokens and keep the rest, and starts anew behind them, which is exact because no merge crosses the end of a
final token.  So the memory of an encoder is a chunk, a window and tables of ``TABLE`` words,
however long the text or a word is.  A decoder keeps the bytes of an unfinished character, three at most.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import json
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm.common import others, own_columns, query, read
from flowlake.llm.token_counts import byte_letters

TOKENIZER = "byte_bpe_50k.json"
CHUNK = 1 << 16                 # code points fed at a time
HOLD = 1 << 10                  # code points after which an unfinished word is streamed
TABLE = 150_000                 # words in each of two tables of known ones
LONG = 64                       # units from which merges go through a heap
SHIFT, NONE = 20, 1 << 62       # ids below 2 ** SHIFT
MASK = (1 << SHIFT) - 1


def lookahead(left: list[bytes], right: list[bytes]) -> int:
    """Bytes after which a token is final, for merges ``left[k] + right[k]`` in rank order."""
    parts: dict[bytes, list[bytes]] = {}            # a token and the parts it begins with
    heaviest: dict[bytes, int] = {}
    most = 0
    for a, b in zip(left, right, strict=True):
        begins = parts.get(b) or [b]
        weight = len(a) + max((heaviest.get(p, 0) for p in begins), default=0)
        heaviest[a] = max(heaviest.get(a, 0), weight)
        most = max(most, weight)
        parts.setdefault(a + b, [a + b, *(parts.get(a) or [a])])
    return most


class Vocabulary:
    """One vocabulary file: ids, merges in rank order, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        raw = lambda name: bytes(letters[c] for c in name)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(name): i for name, i in model["vocab"].items() if name not in self.special}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = [raw(a) for a, _ in pairs], [raw(b) for _, b in pairs]
        #: (left id, right id) as one number to (rank, merged id) as one number
        self.rank: dict[int, int] = {}
        made = {bytes([b]) for b in range(256)}
        for k, (a, b) in enumerate(zip(left, right, strict=True)):
            if a not in made or b not in made:
                raise ValueError(f"merge {k} joins parts that no earlier merge makes")
            made.add(a + b)
            self.rank.setdefault(self.ids[a] << SHIFT | self.ids[b], k << SHIFT | self.ids[a + b])
        self.lookahead, self.longest = lookahead(left, right), max(map(len, made))
        self.unit = [self.ids[bytes([b])] for b in range(256)]

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word read to its end: the merge of least rank first, of equal ones the leftmost."""
        ids, get = [self.unit[b] for b in word], self.rank.get
        if len(ids) > LONG:
            return self._merge_long(ids)
        ranks = [get(a << SHIFT | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != NONE:
            i = ranks.index(best)
            ids[i] = to = best & MASK
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << SHIFT | to, NONE)
            if i < len(ranks):
                ranks[i] = get(to << SHIFT | ids[i + 1], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for n log n steps."""
        get, n = self.rank.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << SHIFT | ids[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << SHIFT | ids[j]) != r:
                continue                            # one of the parts has gone into another merge
            to = r & MASK
            ids[i], ids[j] = to, -1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                if (r := get(to << SHIFT | ids[j])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := get(ids[h] << SHIFT | to)) is not None:
                heapq.heappush(heap, (r, h))
        return [t for t in ids if t >= 0]


def pack(ids: Iterable[int]) -> bytes:
    return array("i", ids).tobytes()


class Known(dict):
    """Packed ids of the words met of late: a full table becomes the old one, whose words come back when they are met again."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab, self.old = vocab, {}

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word) or pack(self.vocab.merge(word.encode()))
        if len(self) >= TABLE:
            self.old = dict(self)
            self.clear()
        self[word] = out
        return out


class WordStream:
    """One long word in pieces: tokens are handed out once they are final."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.held = vocab, b""
        self.window = vocab.lookahead + vocab.longest + 4096      # at least the first token in it is final

    def feed(self, piece: bytes) -> list[int]:
        out: list[int] = []
        self.held += piece
        at = 0
        while len(self.held) - at > self.window:
            end = at + self.window
            for t in self.vocab.merge(self.held[at:end]):
                to = at + len(self.vocab.bytes[t])
                if to > end - self.vocab.lookahead:
                    break
                out.append(t)
                at = to
        self.held = self.held[at:]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.vocab.merge(self.held), b""
        return out


class Encoder:
    """``feed`` chunks of a text, then ``finish``: the ids come out in order, in pieces.

    Inside, pieces are packed 32-bit numbers, so that a known word costs one lookup, however many tokens it has.
    """

    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    #: the same where all code points are ASCII
    ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
    KINDS = {k: regex.compile(p) for k, p in {"letter": r"\p{L}*", "number": r"\p{N}*", "space": r"\s*", "other": r"[^\s\p{L}\p{N}]*"}.items()}
    BREAK = regex.compile(r"(?r)\S(?=\s)")          # the last place where a word must end

    def __init__(self, vocab: Vocabulary, known: Known | None = None):
        self.vocab, self.known = vocab, known if known is not None else Known(vocab)
        special = sorted(vocab.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.heads = {s[:i] for s in special for i in range(1, len(s))}
        self.first = {s[0] for s in special}
        self.longest = max(map(len, self.heads), default=0)
        self.tail = ""                              # may begin a special string
        self.held = ""                              # begins at a word's begin, or goes on with the open word
        self.open: str | None = None                # kind of the word that is being streamed
        self.stream: WordStream | None = None

    def _words(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, (self.ASCII if text.isascii() else self.WORDS).findall(text)))

    def _go_on(self) -> bytes:
        """The open word as far as ``held`` reaches."""
        end = self.KINDS[self.open].match(self.held).end()
        over = end < len(self.held)
        if self.open == "space":
            end -= 1                                # the last space may belong to the next word
        out = self.stream.feed(self.held[:end].encode())
        self.held = self.held[end:]
        if over:
            out += self.stream.finish()
            self.open = self.stream = None
        return pack(out)

    def _plain(self, text: str) -> bytes:
        """More text without special strings."""
        out = b""
        self.held += text
        if self.open:
            out += self._go_on()
        if self.open:
            return out
        if m := self.BREAK.search(self.held):
            out += self._words(self.held[:m.end()])
            self.held = self.held[m.end():]
        if len(self.held) <= HOLD:
            return out
        # no break in a long rest: its words end where their kind changes, and two more code points decide that
        at, words = 0, []
        for m in self.WORDS.finditer(self.held):
            if m.end() > len(self.held) - 3:
                break
            words.append(m.group())
            at = m.end()
        for w in words:
            if len(w) <= HOLD:
                out += self.known[w]
            else:
                s = WordStream(self.vocab)
                out += pack(s.feed(w.encode()) + s.finish())
        self.held = self.held[at:]
        if len(self.held) > HOLD:
            first = self.held[1] if self.held[0] == " " and not self.held[1].isspace() else self.held[0]
            self.open = next(k for k, p in self.KINDS.items() if p.match(first).end())
            self.stream = WordStream(self.vocab)
            if self.held[0] == " " and self.open != "space":
                out += pack(self.stream.feed(b" "))
                self.held = self.held[1:]
            out += self._go_on()
        return out

    def _end(self) -> bytes:
        """The text ends here, or a special string begins."""
        out = b""
        if self.open:
            end = self.KINDS[self.open].match(self.held).end()
            out += pack(self.stream.feed(self.held[:end].encode()) + self.stream.finish())
            self.held, self.open, self.stream = self.held[end:], None, None
        out += self._words(self.held)
        self.held = ""
        return out

    def _feed(self, text: str) -> bytes:
        text, self.tail = self.tail + text, ""
        if not any(c in text for c in self.first):
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._plain(text[at:m.start()]), self._end(), pack([self.vocab.special[m.group()]])]
            at = m.end()
        cut = next((i for i in range(max(at, len(text) - self.longest), len(text)) if text[i:] in self.heads), len(text))
        self.tail = text[cut:]
        return b"".join([*out, self._plain(text[at:cut])])

    def _finish(self) -> bytes:
        out = self._plain(self.tail)
        self.tail = ""
        return out + self._end()

    def feed(self, text: str) -> list[int]:
        return array("i", self._feed(text)).tolist()

    def finish(self) -> list[int]:
        return array("i", self._finish()).tolist()

    def packed(self, text: str, chunk: int = CHUNK) -> bytes:
        """All ids of a text as 32-bit numbers."""
        return b"".join([*(self._feed(text[i:i + chunk]) for i in range(0, len(text), chunk)), self._finish()])

    def encode(self, text: str, chunk: int = CHUNK) -> list[int]:
        return array("i", self.packed(text, chunk)).tolist()


class Decoder:
    """Ids to text in pieces: bytes that don't form a character yet wait, bytes that never can become U+FFFD."""

    def __init__(self, vocab: Vocabulary):
        self.bytes, self.machine = vocab.bytes, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.bytes.__getitem__, ids)))

    def finish(self) -> str:
        out = self.machine.decode(b"", final=True)
        self.machine.reset()
        return out


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[Vocabulary, Known]:
    """Once in a worker process."""
    v = Vocabulary(path)
    return v, Known(v)


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: doc_id, ids (array of int), the text's token ids.

    ``path`` is a byte-level vocabulary file, readable on every executor; by default it is looked up there.  Special
    strings in a text become their ids.  A null or empty text has no ids; repeated rows are encoded alike; extra
    columns are ignored; an empty table gives an empty table.
    """
    def run(batches):
        vocab, known = vocabulary(path or public_tokenizers.path(TOKENIZER))
        for batch in batches:
            enc = Encoder(vocab, known)
            rows = [enc.packed(t.as_py(), chunk) if t.is_valid else b"" for t in batch.column(1)]
            ends = np.cumsum([0, *(len(r) // 4 for r in rows)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])
    d = own_columns(docs, "doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """``tokens`` with a column ``ids`` (array of int) and any others: the same rows with ``text``, special strings kept.

    Null ids give a null text, no ids an empty one.  Ids that the vocabulary doesn't have, and null ones, give nothing.
    Bytes that form no character become U+FFFD.  An empty table gives an empty table.
    """
    def run(batches):
        vocab, _ = vocabulary(path or public_tokenizers.path(TOKENIZER))
        has = np.zeros(max(vocab.bytes) + 1, dtype=bool)
        has[list(vocab.bytes)] = True
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            dec, texts = Decoder(vocab), []
            col = batch.column(at)
            begin, there = col.offsets.to_numpy(), col.is_valid().to_pylist()
            ids = col.values.fill_null(-1).to_numpy()
            ids = np.where((ids >= 0) & (ids < len(has)) & has[np.clip(ids, 0, len(has) - 1)], ids, -1)
            for a, b, ok in zip(begin[:-1], begin[1:], there, strict=True):
                row = ids[a:b]
                row = row[row >= 0].tolist()
                texts.append("".join(dec.feed(row[i:i + chunk]) for i in range(0, len(row), chunk)) + dec.finish() if ok else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])
    kept = tokens.select(*others(tokens, "text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, text string")


@query("op12_bpe_round_trip")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document, and the text they decode to."""
    both = decode(encode(read(spark, sf_dir, "documents")))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("text", 256).alias("decoded_sha256"))
