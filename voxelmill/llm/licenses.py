"""License scans by matching statistics against a generalised suffix automaton of license words.

All templates and phrases are one automaton over words. A text's words are streamed through it: at each word it holds the longest
stretch of words up to there that stands in some template (its length is the matching statistic), in time linear in the text. Words that no
template has end every stretch; single known words among unknown ones are passed over, unless a phrase is one word.

* A **phrase** stands at each place where the automaton's state, or one that its suffix links lead to, is the phrase's and
  the stretch is long enough. So all places are found, also within longer matches.
* **Matches** are stretches of `LONG` words and more that stand in a template and don't go on there with the text's next word; the state and
  those that its links lead to give them for all templates, also while another template's goes on. They are chained: both in
  the text and in the template a match comes after the one before, at most `GAP` words on, and what overlaps counts once. A chain
  that covers `COVER` of its template is a span with the template's label; of spans of one template that overlap the
  better covered stays.

Words are those of `decontaminate`: A-Z lowered, runs of ASCII letters, digits and all beyond ASCII. Texts are read whole, long ones piece by
piece with the automaton's state carried over; what is held of a text is its places, its spans and the chains of the last few hundred words.
Null texts are empty and have no words, places or spans, and score 0. Rows are scanned one by one: repeated rows have equal results, other
columns aren't read, and an empty table gives an empty result. Templates without words match nothing. All templates
together have at most `MOST_WORDS` words, as every task holds their automaton.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text
from .search import terms_of
from .templates import PHRASES, TEMPLATES

LONG, GAP, COVER = 4, 12, 0.75
MOST_WORDS = 1 << 17
PLACE = T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType())])
SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("covered", T.DoubleType())])


def words_of(text: str) -> list[str]:
    return [w.decode() for piece in terms_of(np.frombuffer(text.encode(), np.uint8)) for w in piece]


class Automaton:
    """The generalised suffix automaton of some templates and phrases, by word; built anew where it is unpickled."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Mapping[str, str]) -> None:
        self.made_of = templates, phrases
        self.labels = [label for label, _ in templates]
        texts, short = [words_of(t) for _, t in templates], [(label, words_of(p)) for p, label in phrases.items()]
        self.sizes = [len(t) for t in texts]
        if sum(self.sizes) > MOST_WORDS:
            raise ValueError(f"the templates have {sum(self.sizes)} words, one scan takes {MOST_WORDS}; scan for some of them at a time")
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for words in [*texts, *[p for _, p in short]]:
            last = 0
            for w in words:
                last = self.extend(last, self.number.setdefault(w.encode(), len(self.number) + 1))
        # Where a state's stretches end in the templates, from longer states to those that their links lead to.
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for k, words in enumerate(texts):
            at = 0
            for p, w in enumerate(words):
                at = self.next[at][self.number[w.encode()]]
                self.ends[at].append((k, p + 1))
        by_length = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for v in reversed(by_length):
            if self.length[self.link[v]] >= LONG:
                self.ends[self.link[v]] += self.ends[v]
        # What stands in a template as long as a state's stretch or its suffixes: template, end, longest, and the word that goes on.
        self.stops: list[list[tuple[int, int, int, int]]] = [[] for _ in self.next]
        for v in by_length:
            if self.length[v] >= LONG:
                own = set(self.ends[v])
                follow = lambda k, p: self.number[texts[k][p].encode()] if p < len(texts[k]) else -1
                self.stops[v] = [(k, p, self.length[v], follow(k, p)) for k, p in sorted(own)] + [s for s in self.stops[self.link[v]] if s[:2] not in own]
        self.alone = any(len(words) == 1 for _, words in short)
        # The phrases that end wherever a state's stretches do, if these are long enough.
        self.phrases: list[tuple[tuple[str, int], ...]] = [()] * len(self.next)
        for label, words in short:
            if words:
                at = 0
                for w in words:
                    at = self.next[at][self.number[w.encode()]]
                self.phrases[at] += ((label, len(words)),)
        for v in by_length:
            self.phrases[v] += self.phrases[self.link[v]]

    def __reduce__(self):
        return (type(self), self.made_of)

    def new(self, length: int, like: int | None = None) -> int:
        self.next.append(dict(self.next[like]) if like is not None else {})
        self.link.append(self.link[like] if like is not None else 0)
        self.length.append(length)
        return len(self.next) - 1

    def split(self, v: int, c: int) -> int:
        """The state of v's longest stretch followed by c: that of v's step if it has no longer one, else a copy for the shorter ones."""
        to = self.next[v][c]
        if self.length[to] == self.length[v] + 1:
            return to
        copy = self.new(self.length[v] + 1, to)
        self.link[to] = copy
        while v >= 0 and self.next[v].get(c) == to:
            self.next[v][c] = copy
            v = self.link[v]
        return copy

    def extend(self, last: int, c: int) -> int:
        """The state of a text's start with one more word."""
        if c in self.next[last]:
            return self.split(last, c)
        own = self.new(self.length[last] + 1)
        v = last
        while v >= 0 and c not in self.next[v]:
            self.next[v][c] = own
            v = self.link[v]
        self.link[own] = self.split(v, c) if v >= 0 else 0
        return own


class Chains:
    """Matches of one text, chained by template as they come."""

    def __init__(self, automaton: Automaton) -> None:
        self.of, self.best = automaton, 0.0
        # Of each template open chain ends: end in the text, end in the template, words covered, start in the text.
        self.open: dict[int, deque[tuple[int, int, int, int]]] = {}
        self.spans: dict[int, list[tuple[int, int, float]]] = {}

    def stop(self, end: int, size: int, state: int, word: int) -> None:
        """A stretch of `size` words that ends before word `end` of the text, which is `word`."""
        for k, upto, longest, follow in self.of.stops[state]:
            if follow != word:
                self.add(end, min(size, longest), k, upto)

    def add(self, end: int, size: int, k: int, upto: int) -> None:
        """A match with the `size` words of template k that end before its word `upto`."""
        ends = self.open.setdefault(k, deque())
        reach = self.of.sizes[k] + GAP
        while ends and ends[0][0] < end - reach:
            ends.popleft()
        covered, start = size, end - size
        for e, p, c, s in ends:
            step, across = end - size - e, upto - size - p
            if step <= GAP and across <= GAP and (total := c + size + min(0, step, across)) > max(c, covered) and p < upto:
                covered, start = total, s
        ends.append((end, upto, covered, start))
        share = min(1.0, covered / self.of.sizes[k])
        self.best = max(self.best, share)
        if share >= COVER:
            self.keep(k, start, end, share)

    def keep(self, k: int, start: int, end: int, share: float) -> None:
        own = self.spans.setdefault(k, [])
        if own and start < own[-1][1]:
            if share < own[-1][2]:
                return
            own.pop()
        own.append((start, end, share))

    def found(self) -> list[dict]:
        rows = [(start, end - 1, self.of.labels[k], share) for k, own in self.spans.items() for start, end, share in own]
        return [{"label": label, "first_word": a, "last_word": z, "covered": share} for a, z, label, share in sorted(rows)]


def scan(automaton: Automaton, data: np.ndarray) -> tuple[int, list[dict], list[dict], float]:
    """Number of words, places of phrases, spans, and the largest covered share of a template or, where a phrase stands, 1."""
    chains, places = Chains(automaton), []
    step, link, length, phrases, number = automaton.next, automaton.link, automaton.length, automaton.phrases, automaton.number
    n, state, size, last = 0, 0, 0, -1
    for words in terms_of(data):
        ids = np.fromiter(map(number.get, words, repeat(0)), np.int32, len(words))
        known = np.r_[True, ids > 0, True]  # the next piece may go on
        for k in np.flatnonzero(known[1:-1] & (known[:-2] | known[2:] | automaton.alone)).tolist():
            c, at = int(ids[k]), n + k
            if size >= LONG:
                chains.stop(last + 1, size, state, c if at == last + 1 else 0)
            if at != last + 1:
                state = size = 0
            while state and c not in step[state]:
                state = link[state]
                size = length[state]
            if c in step[state]:
                state, size = step[state][c], size + 1
            last = at
            for label, m in phrases[state]:
                if m <= size:
                    places.append({"label": label, "word": at - m + 1})
        n += len(words)
    if size >= LONG:
        chains.stop(last + 1, size, state, 0)
    return n, places, chains.found(), 1.0 if places else chains.best


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, places, spans, score) of every text: places (label, word) of phrases, spans (label, first_word, last_word, covered) of templates."""
    automaton = Automaton(templates, phrases)
    fields = [T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(PLACE)), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("score", T.DoubleType())]

    def kernel(data: np.ndarray, off: np.ndarray) -> list:
        return list(zip(*[scan(automaton, data[a:z]) for a, z in zip(off[:-1], off[1:], strict=True)], strict=True))

    return map_text(docs, [id_col], text, kernel, fields)


def license_query(docs: DataFrame) -> DataFrame:
    found = scan_licenses(docs)
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        listed(F.col("places.label")).alias("base_labels"), listed(F.concat("places.label", "spans.label")).alias("labels"), "score",
    )
