"""Substring dedup: words covered by a window of words that starts in an earlier document, by suffix automata.

The reference is the corpus itself, in shards by content: a shard is a class of segments (see ``segments``), the only place where
its windows can be equal. In order of doc_id each segment is streamed through the automaton of the segments from
smaller doc_ids, which gives its matching statistics: where the longest match ending at a word has ``length``
words or more, the window ending there is repeated. Then the segment joins the automaton. So automata are as
large as a shard, of at most ``class_limit`` segments; a larger one is decided window by window.

Shards and what they can match meet by key instead of by broadcast: with every document as reference, sending each
automaton to each document would grow with the square of the corpus.

Defined cases: a null text has no words; a null doc_id is neither smaller nor larger than another, so its document
is kept; repeated rows have one doc_id and don't cut each other; spans are judged on the input.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, functions as F

from ringfence.llm.segments import Units, covered, keyed, rebuilt, repeated_spans

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


class SuffixAutomaton:
    """Suffix automaton of several sequences; states are places in the three lists."""

    def __init__(self):
        self.moves: list[dict] = [{}]
        self.link, self.size = [-1], [0]

    def _state(self, size: int, moves: dict, link: int) -> int:
        self.moves.append(moves)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, source: int, unit) -> int:
        """The state for ``unit`` after ``source``, exactly one longer than it."""
        target = self.moves[source][unit]
        if self.size[target] == self.size[source] + 1:
            return target
        copy = self._state(self.size[source] + 1, dict(self.moves[target]), self.link[target])
        self.link[target] = copy
        while source >= 0 and self.moves[source].get(unit) == target:
            self.moves[source][unit] = copy
            source = self.link[source]
        return copy

    def add(self, sequence) -> None:
        last = 0
        for unit in sequence:
            if unit in self.moves[last]:
                last = self._split(last, unit)
                continue
            new, at = self._state(self.size[last] + 1, {}, 0), last
            while at >= 0 and unit not in self.moves[at]:
                self.moves[at][unit] = new
                at = self.link[at]
            if at >= 0:
                self.link[new] = self._split(at, unit)
            last = new

    def statistics(self, sequence) -> list[int]:
        """Length of the longest match that ends at each place."""
        state, length, out = 0, 0, []
        for unit in sequence:
            while state and unit not in self.moves[state]:
                state = self.link[state]
                length = self.size[state]
            if unit in self.moves[state]:
                state, length = self.moves[state][unit], length + 1
            out.append(length)
        return out


def shard_judge(length: int):
    """Windows of each segment that occur in one from a smaller doc_id; rows come in order of class and doc_id."""

    def judge(classes, lead, n, docs, bodies):
        hits = [[] for _ in bodies]
        automaton, held, own = None, [], None
        for i, (shard, doc) in enumerate(zip(classes.tolist(), docs.tolist())):
            if own is None or own[0] != shard:
                automaton, held = SuffixAutomaton(), []
            elif own[1] != doc:
                for body in held:
                    automaton.add(body)
                held = []
            own = (shard, doc)
            sequence = WORDS.findall(bodies[i])
            hits[i] = [end - length + 1 for end, m in enumerate(automaton.statistics(sequence)) if m >= length]
            held.append(sequence)
        return hits

    return judge


def _rest(batches):
    import pyarrow as pa

    for batch in batches:
        n, gone, digest = [], [], []
        spans_of = batch.column("spans")
        for i, text in enumerate(batch.column("text")):
            text, spans = text.as_py(), spans_of[i].as_py()
            found = WORDS.findall(text.encode())
            if spans:
                out = covered(spans, len(found))
                kept = [w for w, g in zip(found, out.tolist()) if not g]
            else:
                kept = found
            n.append(len(found))
            gone.append(len(found) - len(kept))
            digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())],
                                         ["doc_id", "n_words", "n_removed", "kept_sha256"])


def word_spans(docs: DataFrame, length: int = 13, class_limit: int = 20_000, bits: int = 26) -> DataFrame:
    """doc_id, text_key, spans: word ranges covered by a window of ``length`` words that starts in a smaller doc_id."""
    gram = max(1, min(5, length // 2))
    return repeated_spans(docs.filter(F.col("doc_id").isNotNull()), Units(True, length, gram, min(8, length)), shard_judge(length), True, class_limit, bits)


def remove_repeated_words(docs: DataFrame, length: int = 13, class_limit: int = 20_000, bits: int = 26) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    rows = keyed(docs)
    return rebuilt(rows, word_spans(rows, length, class_limit, bits), _rest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
