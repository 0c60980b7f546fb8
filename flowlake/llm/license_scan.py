"""License scan: exact phrases and a fuzzy search for short notices.

Method.  Each notice, as lower-case words with single spaces, may be off by ``k``
edits (``RATE`` of its characters, one at least).  Cut into k + 1 pieces, one piece must occur
unchanged (pigeonhole), so exact seeds, found in one Aho-Corasick pass, locate
all candidates; the regex library's bounded-error matching then verifies the
edits in a window around each seed and gives the span.  Spans are reported in words.

Base phrases are found by word hashes over whole batches and confirmed on the bytes.
Texts stay in their tasks; there is no shuffle.  Rows are handled a slice of about 1 MB at a time.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from flowlake.llm import words as W
from flowlake.llm.common import own_columns, query, read

#: fixed values: phrases and labels of the base
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: short notices that the method adds, with their labels
NOTICES = (
    ("licensed under the gnu general public license", "gpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
)
RATE = 0.05


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """The notice in k + 1 parts of about equal length, with their places."""
    cut = [round(i * len(notice) / (k + 1)) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


class Notices:
    """Seeds and verifiers of a list of (notice, label)."""

    def __init__(self, notices=NOTICES, rate: float = RATE):
        self.items = []
        self.seeds = ahocorasick.Automaton()
        table: dict[str, list[tuple[int, int]]] = {}
        for i, (notice, label) in enumerate(notices):
            k = max(1, int(len(notice) * rate))
            raw = notice.encode().decode("latin-1")         # one character per byte
            # whole words only; the best match of the window
            self.items.append((raw, label, k, regex.compile(rf"(?be)(?<![^ ])(?:{regex.escape(raw)}){{e<={k}}}(?![^ ])")))
            for off, part in pieces(raw, k):
                table.setdefault(part, []).append((i, off))
        for part, where in table.items():
            self.seeds.add_word(part, (len(part), where))
        self.seeds.make_automaton()

    def search(self, text: str, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, start, end, notice, edits) in ``text``, rows at ``bounds``; matches of one notice don't overlap."""
        found, done = [], {}
        for end, (n, where) in self.seeds.iter(text):
            first = end - n + 1
            row = int(np.searchsorted(bounds, first, side="right")) - 1
            lo, hi = int(bounds[row]), int(bounds[row + 1])
            for i, off in where:
                raw, _, k, pat = self.items[i]
                at = max(lo, first - off - k)
                if done.get((i, row), -1) > first:          # inside a match that is known
                    continue
                m = pat.search(text, max(at, done.get((i, row), lo)), min(hi, at + len(raw) + 3 * k + 1))
                if m and m.end() > first:
                    found.append((row, m.start(), m.end(), i, sum(m.fuzzy_counts)))
                    done[i, row] = m.end()
        return sorted(set(found))


def _normal(low: np.ndarray, s: np.ndarray, e: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all rows with single spaces: bytes, start of each word, bounds of the rows."""
    n = e - s
    start = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(int(start[-1]), 32, dtype=np.uint8)
    out[np.arange(int(n.sum())) + np.repeat(np.arange(len(n)), n)] = low[np.arange(int(n.sum())) + np.repeat(
        s - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else s, n)]
    return out, start[:-1], start[at]


def scan(docs: DataFrame, notices=NOTICES, rate: float = RATE) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, matches (label, start and end word, edits).

    ``score``: 1 for an exact phrase or notice, else 1 minus the share of edits of the best match; 0 without one.
    Null and empty texts have no words.  Repeated rows are scanned alike.  Extra columns are ignored.
    """
    phrases = [(p.encode().split(), label) for p, label in PHRASES]

    def run(batches):
        book = Notices(notices, rate)
        keys = [W.hashes(d := np.frombuffer(b" ".join(p), dtype=np.uint8), *W.spans(d, np.array([0, len(d)]), W.ALNUM)[:2])
                for p, _ in phrases]
        for batch in batches:
            k = batch.num_rows
            n_words, n_base = np.zeros(k, np.int64), np.zeros(k, np.int64)
            first: list = [None] * k
            last: list = [None] * k
            base: list[set] = [set() for _ in range(k)]
            matches: list[list] = [[] for _ in range(k)]
            for r0, data, offs in W.slices(batch.column(1)):
                low = W.LOWER[data]
                s, e, at = W.spans(low, offs, W.ALNUM)
                n_words[r0: r0 + len(offs) - 1] = np.diff(at)
                if not len(s):
                    continue
                h = W.hashes(low, s, e)
                for (p, label), key in zip(phrases, keys, strict=True):
                    m = len(p)
                    hit = h[: len(h) - m + 1] == key[0]
                    for j in range(1, m):
                        hit &= h[j: len(h) - m + 1 + j] == key[j]
                    for w in np.flatnonzero(hit).tolist():
                        row = int(np.searchsorted(at, w, side="right")) - 1
                        if w + m > at[row + 1] or [low[s[w + j]: e[w + j]].tobytes() for j in range(m)] != p:
                            continue
                        x, r = w - int(at[row]), r0 + row
                        n_base[r] += 1
                        first[r] = x if first[r] is None else min(first[r], x)
                        last[r] = x if last[r] is None else max(last[r], x)
                        base[r].add(label)
                norm, start, bounds = _normal(low, s, e, at)
                for row, a, b, i, edits in book.search(norm.tobytes().decode("latin-1"), bounds):
                    x = int(np.searchsorted(start, a, side="right")) - 1 - int(at[row])
                    y = int(np.searchsorted(start, b, side="left")) - int(at[row])
                    matches[r0 + row].append({"label": book.items[i][1], "start": x, "end": y, "edits": edits,
                                              "score": 1 - edits / len(book.items[i][0])})
            score = [max([1.0] * bool(n_base[r]) + [m["score"] for m in matches[r]], default=0.0) for r in range(k)]
            join = lambda x: ",".join(sorted(x))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n_words), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()),
                pa.array([join(b) for b in base]),
                pa.array([join(b | {m["label"] for m in ms}) for b, ms in zip(base, matches, strict=True)]),
                pa.array(score, pa.float64()),
                pa.array(matches, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                                      ("edits", pa.int64()), ("score", pa.float64())])))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])
    d = own_columns(docs, "doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, "
                        "last_word long, base_labels string, labels string, score double, "
                        "matches array<struct<label:string,start:long,end:long,edits:long,score:double>>")


@query("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses in every whole document."""
    return scan(read(spark, sf_dir, "documents")).drop("matches")
