"""Language ID: script ranges narrow the candidates, Viterbi labels the spans of mixed-language text.

A word is a run of letters of one script. The script narrows the languages that it can be in to those
whose learned texts use it (for over 1% of their letters; where it is so in none, at all); its score for each of them is the log probability of its
character trigrams. Viterbi over a document's words, with a penalty for each switch, gives the labels;
words between two switches are a span. The prediction is the language of most letters, of several the
first by name, and its score the share of letters in its spans.

Texts that are null, empty or without letters are `und` with score 0 and no spans. Words of a script
that no learned language uses say nothing and go with their neighbours; a text of such words only gets the
language whose trigrams fit it best, with score 0, as nothing speaks for it. Equal texts get equal results, and
so do repeated rows and ids. Only the id and the text are read, so other columns may have any name; filters keep
all columns. Texts beyond PIECE bytes are dealt with piece by piece. An empty table gives an empty result; if there
is nothing to learn from, every text is `und`.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filter_text, held_out, map_text
from .words import PIECE, pieces

UNKNOWN = "und"
BINS = 1 << 15
#: Nats that a switch of language costs.
SWITCH = 14.0
#: First and last code point of blocks of letters. The script of other letters is the first word of their names.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFE)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F), (0x30000, 0x3347F)],
}
CODES = 0x33480
#: Signs that join letters of one word.
JOINERS = (0x200C, 0x200D)


#: Letters that have no script of their own, such as a modifier apostrophe, belong to the word around them.
LOOSE = "modifier"


def script_name(letter: str) -> str:
    words = [w for w in unicodedata.name(letter, "unnamed").lower().split() if w not in ("halfwidth", "fullwidth")]
    return {"katakana": "kana", "hiragana": "kana", "katakana-hiragana": "kana", "cjk": "han"}.get(words[0], words[0])


class Tables:
    """By code point: whether it is a letter, whether it is a mark that goes with the letter before it, and the number of its script (0: no letter)."""

    letter: np.ndarray | None = None
    mark: np.ndarray | None = None
    script: np.ndarray | None = None
    scripts = 0
    loose = 0

    def load(self) -> Tables:
        if self.letter is None:
            self.letter = np.fromiter((chr(c).isalpha() for c in range(CODES)), bool, CODES)
            self.mark = np.fromiter((unicodedata.category(chr(c)) in ("Mn", "Mc") or c in JOINERS for c in range(CODES)), bool, CODES)
            self.script = np.zeros(CODES, np.uint16)
            for k, ranges in enumerate(SCRIPTS.values(), 1):
                for lo, hi in ranges:
                    self.script[lo : hi + 1] = k
            others = {c: script_name(chr(c)) for c in np.flatnonzero(self.letter & (self.script == 0)).tolist()}
            place = {x: k for k, x in enumerate([*SCRIPTS, *sorted(set(others.values()) - set(SCRIPTS))], 1)}
            for c, x in others.items():
                self.script[c] = place[x]
            self.scripts, self.loose = len(place) + 1, place[LOOSE]
        return self

    def __reduce__(self):
        return (type(self), ())


@dataclass
class Words:
    """The words of a block of texts, in code points of the joined text."""

    start: np.ndarray
    length: np.ndarray
    row: np.ndarray
    script: np.ndarray
    bins: np.ndarray  # of the trigram around each letter, word after word
    first: np.ndarray  # of each word in bins
    base: np.ndarray  # first code point of each row


def words_of(data: np.ndarray, off: np.ndarray, tables: Tables) -> Words:
    t = tables.load()
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.cumsum(np.r_[0, (data & 0xC0) != 0x80])
    base = lead[off]  # rows in code points
    low = np.minimum(cp, CODES - 1)
    inside = np.zeros(len(cp) + 1, bool)
    inside[:-1] = t.letter[low]
    script = t.script[low]
    marks = np.flatnonzero(t.mark[low])
    if len(marks):  # vowel signs and other marks belong to the letter that they follow, in its word and script
        place = np.arange(len(cp))
        other = np.maximum.accumulate(np.where(t.mark[low], -1, place))  # the last that is no mark
        of, row = other[marks], np.searchsorted(base, marks, "right")
        held = (of >= 0) & (row == np.searchsorted(base, np.maximum(of, 0), "right"))
        held[held] &= t.letter[low[of[held]]]
        inside[marks[held]], script[marks[held]] = True, script[of[held]]
    begin, end = inside.copy(), np.zeros(len(cp) + 1, bool)
    begin[1:] &= ~inside[:-1]
    end[1:] = inside[:-1] & ~inside[1:]
    turn = np.flatnonzero(inside[1:-1] & inside[:-2] & (script[1:] != script[:-1]) & (script[1:] != t.loose) & (script[:-1] != t.loose)) + 1
    begin[turn] = end[turn] = True
    edge = base[1:-1]
    begin[edge] |= inside[edge]
    end[edge[edge > 0]] |= inside[edge[edge > 0] - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(end)
    at = np.flatnonzero(inside[:-1])
    c = lowered(low).astype(np.uint32) + 2
    prev, nxt = np.ones(len(cp), np.uint32), np.ones(len(cp), np.uint32)
    prev[1:], nxt[:-1] = c[:-1], c[1:]
    prev[s], nxt[e - 1] = 0, 0  # a word's edges
    h = (prev[at] * np.uint32(0x85EBCA6B)) ^ (c[at] * np.uint32(0xC2B2AE35)) ^ (nxt[at] * np.uint32(0x27D4EB2F))
    h ^= h >> np.uint32(15)
    h = h * np.uint32(0x2C1B3C6D)
    bins = (h >> np.uint32(17)).astype(np.int32)
    n = e - s
    first = np.r_[0, np.cumsum(n)[:-1]].astype(np.int64)
    return Words(s, n, np.searchsorted(base, s, "right") - 1, script[s], bins, first, base)


def lowered(cp: np.ndarray) -> np.ndarray:
    """Capitals of ASCII, Latin-1, Greek and Cyrillic made small; others stay."""
    up = ((cp >= 0x41) & (cp <= 0x5A)) | ((cp >= 0xC0) & (cp <= 0xDE) & (cp != 0xD7)) | ((cp >= 0x391) & (cp <= 0x3A9)) | ((cp >= 0x410) & (cp <= 0x42F))
    return cp + np.uint32(32) * up


@dataclass
class LanguageModel:
    langs: list[str]
    logp: np.ndarray  # (BINS, lang)
    allowed: np.ndarray  # (script, lang)
    tables: Tables

    def emissions(self, w: Words, known: np.ndarray) -> np.ndarray:
        """(word, lang): log probabilities; 0 for all where the script tells nothing in a row that has words of `known` scripts."""
        e = np.empty((len(w.start), len(self.langs)), np.float32)
        for lo in range(0, len(e), 1 << 16):
            hi = min(lo + (1 << 16), len(e))
            first = w.first[lo:hi]
            stop = w.first[hi] if hi < len(e) else len(w.bins)
            e[lo:hi] = np.add.reduceat(self.logp[w.bins[first[0] : stop]], first - first[0], axis=0)
        ok = self.allowed[w.script]
        some = ok.any(1)
        e[~ok & some[:, None]] = -1e6
        e[~some & known[w.row]] = 0
        return e

    def has_known(self, w: Words, n: int) -> np.ndarray:
        """Of each of n rows: whether it has a word of a script that a learned language uses."""
        return np.bincount(w.row, self.allowed[w.script].any(1), n) > 0

    def label(self, data: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray, Words | None, np.ndarray]:
        """Prediction and score of each row, its words, and the language number of each word."""
        n = len(off) - 1
        if n == 1 and len(data) > 2 * PIECE:
            w, state = self.long_words(data)
        else:
            w = words_of(data, off, self.tables)
            state = best_labels(self.emissions(w, self.has_known(w, n)), w.row, SWITCH) if len(w.start) and self.langs else None
        if not len(w.start) or not self.langs:
            return [UNKNOWN] * n, np.zeros(n), None, np.zeros(0, np.int32)
        letters = np.bincount(w.row * len(self.langs) + state, w.length, n * len(self.langs)).reshape(n, -1)
        best, total = letters.argmax(1), letters.sum(1)
        score = np.where(self.has_known(w, n), letters[np.arange(n), best] / np.maximum(total, 1), 0.0)
        return [self.langs[k] if some else UNKNOWN for k, some in zip(best, total > 0, strict=True)], score, w, state

    def long_words(self, data: np.ndarray) -> tuple[Words, np.ndarray]:
        """Words and labels of one long text; only what follows the last settled word waits for the next piece."""
        each = [data[a:z] for a, z in pieces(data)]
        parts = lambda: (words_of(d, np.array([0, len(d)]), self.tables) for d in each)
        known = np.array([any(self.allowed[w.script].any() for w in parts())])
        kept, states, waiting, point = [], [], np.zeros((0, len(self.langs)), np.float32), 0
        for d, w in zip(each, parts(), strict=True):
            kept.append((w.start + point, w.length, w.script))
            point += int(w.base[-1])
            if len(w.start) and self.langs:
                waiting = np.concatenate([waiting, self.emissions(w, known)])
                at = np.flatnonzero(settled_words(waiting, SWITCH))
                if len(at) and at[-1]:
                    states.append(best_labels(waiting[: at[-1] + 1], np.zeros(at[-1] + 1, np.int64), SWITCH)[:-1])
                    waiting = waiting[at[-1] :]
        if len(waiting):
            states.append(best_labels(waiting, np.zeros(len(waiting), np.int64), SWITCH))
        start, length, script = (np.concatenate(x) for x in zip(*kept, strict=True))
        empty = np.zeros(0, np.int64)
        return Words(start, length, np.zeros(len(start), np.int64), script, empty, empty, np.array([0, point])), np.concatenate(states) if states else empty


def settled_words(e: np.ndarray, penalty: float) -> np.ndarray:
    """Words that are better in one language by two penalties or more: they are in it on the best path, as going there and back costs no more."""
    top = e.argmax(1)
    others = e.copy()
    others[np.arange(len(e)), top] = -np.inf
    return e[np.arange(len(e)), top] - others.max(1) >= 2 * penalty


def best_labels(e: np.ndarray, row: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; rows are cut where a word settles its own label, so Viterbi has short rows.

    What is before a settled word and what is after it don't depend on each other: the word ends one stretch
    and begins the next.
    """
    top = e.argmax(1)
    settled = settled_words(e, penalty)
    begins = np.r_[True, row[1:] != row[:-1]]
    twice = settled & ~begins & ~np.r_[begins[1:], True]
    last = np.cumsum(1 + twice) - 1
    word = np.repeat(np.arange(len(e)), 1 + twice)
    start = np.zeros(len(word), bool)
    start[last[begins]] = start[last[twice]] = True
    fixed = e.copy()
    fixed[settled] = -1e9
    fixed[settled, top[settled]] = 0
    stretch = np.cumsum(start) - 1
    return viterbi(fixed[word], stretch, int(stretch[-1]) + 1, penalty)[last]


def viterbi(e: np.ndarray, row: np.ndarray, n: int, penalty: float) -> np.ndarray:
    """The best label of each word, for all rows at once: step k deals with the k-th word of every row that has one."""
    count = np.bincount(row, minlength=n)
    order = np.argsort(-count, kind="stable")
    order = order[count[order] > 0]
    first = (np.cumsum(count) - count)[order]
    alive = len(order) - np.searchsorted(np.sort(count[order]), np.arange(count.max(initial=0)), "right")
    langs = np.arange(e.shape[1])
    back = np.empty(e.shape, np.int16)
    best = e[first]
    last = best.copy()
    for k in range(1, len(alive)):
        m = alive[k]
        now = best[:m]
        top = now.argmax(1)
        switched = now[np.arange(m), top] - penalty
        stay = now >= switched[:, None]
        back[first[:m] + k] = np.where(stay, langs, top[:, None])
        best = np.where(stay, now, switched[:, None]) + e[first[:m] + k]
        last[:m] = best
    state = np.empty(len(e), np.int32)
    current = last.argmax(1)
    for k in range(len(alive) - 1, -1, -1):
        m = alive[k]
        at = first[:m] + k
        state[at] = current[:m]
        if k:
            current[:m] = back[at, current[:m]]
    return state


def spans(model: LanguageModel, n: int, w: Words | None, state: np.ndarray) -> list[list[dict]]:
    """Of each of n rows: the spans (start, end, lang) in code points, from a word's start to a word's end."""
    out: list[list[dict]] = [[] for _ in range(n)]
    if w is None:
        return out
    new = np.flatnonzero(np.r_[True, (w.row[1:] != w.row[:-1]) | (state[1:] != state[:-1])])
    stop = np.append(new[1:], len(state)) - 1
    for a, b in zip(new, stop, strict=True):
        r = w.row[a]
        out[r].append({"start": int(w.start[a] - w.base[r]), "end": int(w.start[b] + w.length[b] - w.base[r]), "lang": model.langs[state[a]]})
    return out


def fit_language(docs: DataFrame, learn: Column, per_lang: int = 1500, lang: str = "lang", id_col: str = "doc_id", text: str = "text", seed: int = 5) -> LanguageModel:
    """Trigram counts of about `per_lang` documents (at most twice as many are expected) of each language.

    A document is in the sample if the hash of its id is below a share of its language's documents, so
    no language is sorted or gathered. The counts are summed by Spark; the driver gets BINS per language.
    """
    known = docs.where(learn & F.col(lang).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(1.5 * per_lang) / F.col("n"))
    chosen = known.join(F.broadcast(counts), "lang").where((F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < share * (1 << 30)))
    tables = Tables()
    scripts = tables.load().scripts
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bin", T.IntegerType()), T.StructField("n", T.LongType())])

    def count(batches):
        from collections import defaultdict

        bins = defaultdict(lambda: np.zeros(BINS + scripts, np.int64))
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = np.frombuffer((text or "").encode(), np.uint8)
                for a, z in pieces(whole):
                    w = words_of(whole[a:z], np.array([0, z - a]), tables)
                    bins[name][:BINS] += np.bincount(w.bins, minlength=BINS)
                    bins[name][BINS:] += np.bincount(w.script, w.length, scripts).astype(np.int64)
        for name, n in bins.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bin", "n"])

    got = chosen.select("lang", "text").mapInArrow(count, schema).groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    names = got.column("lang").to_pylist()
    langs = sorted(set(names))
    table = np.zeros((BINS + scripts, len(langs)))
    if langs:
        place = {x: k for k, x in enumerate(langs)}
        table[got.column("bin").to_numpy(), [place[x] for x in names]] = got.column("n").to_numpy()
    seen, script = table[:BINS], table[BINS:]
    logp = np.log((seen + 0.5) / (seen.sum(0) + 0.5 * BINS)).astype(np.float32)
    allowed = script > 0.01 * np.maximum(script.sum(0), 1)
    rare = ~allowed.any(1)  # a script that is little of every language is still in those that have it
    allowed[rare] = script[rare] > 0
    return LanguageModel(langs, logp, allowed, tables)


def identify_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score, spans) of every whole text."""
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])

    def kernel(d: np.ndarray, o: np.ndarray) -> list:
        lang, score, words, state = model.label(d, o)
        return [lang, score, spans(model, len(o) - 1, words, state)]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))]
    return map_text(docs, [id_col], text, kernel, fields)


def filter_language(docs: DataFrame, model: LanguageModel, least: float = 0.5, text: str = "text") -> DataFrame:
    """The documents with a language whose spans hold `least` or more of the letters, with all their columns."""

    def keeps(d: np.ndarray, o: np.ndarray) -> np.ndarray:
        lang, score, _, _ = model.label(d, o)
        return (np.array(lang, object) != UNKNOWN) & (score >= least)

    return filter_text(docs, text, keeps)


def language_query(docs: DataFrame) -> DataFrame:
    key = F.col("doc_id")
    found = identify_language(docs, fit_language(docs, ~held_out(key, 4, 2)))
    return found.select("doc_id", held_out(key, 4, 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
