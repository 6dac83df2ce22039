"""Toxicity: a lexicon trie intersected with Levenshtein automata, and scores of the windows around matches.

Terms and stems are learned from labelled rows. The words of a text run through the product of the trie with the
Levenshtein automaton of each term, determinised as far as words reach into it; it accepts terms with a few misspelled
letters and words that begin with a stem. The window on both sides of a match is scored for quotation against abuse, and a
logistic model turns the matches of a document, weighted by those scores, into one.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHasher, annotated, mixed, normal_words, packed, training_rows
from .logistic import Logistic

#: Letters of a stem, and words that share one at least.
STEM_LENGTHS, STEM_WORDS = range(4, 9), 3
#: Words on either side of a match that make its window.
WINDOW = 6
#: Words that introduce what someone else said, and that speak about a word.
REPORTED = frozenset("said says wrote quoted quote quotes called term word phrase sagte schrieb zitat wort dit disait mot citation dijo palabra cita".split())
DIRECTED = frozenset("you your yours youre u du dich dir dein deine ihr euch tu te toi ton ta vous votre eres tus usted ustedes vosotros".split())
#: Quotation marks beyond ASCII, which would else count as letters, and the plain ones for which they stand.
_MARKS = re.compile("[“”„«»‚‘’]")
_PLAIN_MARKS = {ord(c): "'" if c in "‚‘’" else '"' for c in "“”„«»‚‘’"}
#: Features of a window, and ways in which a quotation is put.
WINDOW_FEATURES = 6
_QUOTED = ('he wrote "{}" to me', "she said “{}” and left", 'the word "{}" is', "they called it «{}» yesterday", "quote: '{}' end", '"{}" was the term', "er sagte „{}“ dann", "il a dit «{}» hier", "{} is what he said", 'dijo "{}" ayer')
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Features of a document.
FEATURES = 4
#: Distinct words kept per worker before the cache starts anew; only speed depends on it.
CACHE_WORDS = 400_000


def edits(term: str) -> int:
    """Edits by which a misspelled word may differ from a term."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def stem_edits(stem: str) -> int:
    return 0 if len(stem) < 7 else 1


class LexiconAutomaton:
    """State: the trie nodes that can be reached, each with its fewest edits. Transitions are worked out when first needed."""

    def __init__(self, terms: list[str], stems: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.term, self.stem, self.limit = [-1], [-1], [0]
        for i, t in enumerate(terms):
            self._add(t, edits(t), self.term, i)
        for i, t in enumerate(stems):
            self._add(t, stem_edits(t), self.stem, i)
        self.moves: list[dict[str, int]] = []
        self.limit_of_term, self.limit_of_stem = [edits(t) for t in terms], [stem_edits(t) for t in stems]
        #: (edits, place, is a stem) of the term that a word which ends in the state matches, and of the stem that it has begun with.
        self.accepts: list[tuple[int, int, bool] | None] = []
        self.begun: list[tuple[int, int, bool] | None] = []
        self._listed: list[tuple] = []
        self._ids: dict[tuple, int] = {}
        self._state(self._closed({0: 0}))

    def _add(self, text: str, limit: int, ends: list[int], i: int) -> None:
        at = 0
        self.limit[0] = max(self.limit[0], limit)
        for c in text:
            nxt = self.children[at].get(c)
            if nxt is None:
                nxt = self.children[at][c] = len(self.children)
                self.children.append({})
                for x in (self.term, self.stem):
                    x.append(-1)
                self.limit.append(0)
            at = nxt
            self.limit[at] = max(self.limit[at], limit)
        ends[at] = i

    def _closed(self, nodes: dict[int, int]) -> tuple:
        """With the nodes that missing letters reach."""
        waiting = list(nodes.items())
        while waiting:
            node, e = waiting.pop()
            for child in self.children[node].values():
                if e + 1 <= self.limit[child] and e + 1 < nodes.get(child, 99):
                    nodes[child] = e + 1
                    waiting.append((child, e + 1))
        return tuple(sorted(nodes.items()))

    def _state(self, nodes: tuple) -> int:
        if not nodes:
            return -1
        if nodes not in self._ids:
            self._ids[nodes] = len(self.moves)
            self.moves.append({})
            self._listed.append(nodes)
            ends = [(e, self.term[node], False) for node, e in nodes if self.term[node] >= 0 and e <= self.limit_of_term[self.term[node]]]
            begun = [(e, self.stem[node], True) for node, e in nodes if self.stem[node] >= 0 and e <= self.limit_of_stem[self.stem[node]]]
            self.accepts.append(min(ends, default=None))
            self.begun.append(min(begun, default=None))
        return self._ids[nodes]

    def _move(self, state: int, c: str) -> int:
        out: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.limit[node] and e < out.get(node, 99):
                out[node] = e

        for node, e in self._listed[state]:
            for letter, child in self.children[node].items():
                reach(child, e + (letter != c))
            reach(node, e + 1)
        self.moves[state][c] = to = self._state(self._closed(out))
        return to

    def match(self, word: str) -> tuple[int, int, bool] | None:
        """(place of the term or stem, edits, is a stem) of the match with the fewest edits, or None."""
        state, best = 0, None
        moves, begun = self.moves, self.begun
        for c in word:
            to = moves[state].get(c)
            if to is None:
                to = self._move(state, c)
            if to < 0:
                break
            state = to
            if (hit := begun[state]) and (best is None or hit < best):
                best = hit
                if not best[0]:
                    break
        else:
            if (hit := self.accepts[state]) and (best is None or hit[0] <= best[0]):
                best = hit
        return best and (best[1], best[0], best[2])


@dataclass
class Lexicon:
    terms: list[str]
    stems: list[str]
    exact: list[float] = field(default_factory=list)
    fuzzy: list[float] = field(default_factory=list)
    stem: list[float] = field(default_factory=list)
    near_stem: list[float] = field(default_factory=list)


def _odds(toxic: float, clean: float, n_toxic: int, n_clean: int, a: float = 0.5) -> float:
    return math.log((toxic + a) / (n_toxic + 2 * a)) - math.log((clean + a) / (n_clean + 2 * a))


def _gain(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """Twice the log likelihood by which the rows that hold a word are toxic more often than others; negative if less."""
    n, base = toxic + clean, n_toxic / (n_toxic + n_clean)
    if toxic <= base * n:
        return -1.0
    return 2 * (toxic * math.log(toxic / (n * base)) + (clean * math.log(clean / (n * (1 - base))) if clean else 0.0))


def learn_lexicon(bags: list[set[str]], toxic: np.ndarray, least_share: float = 0.8) -> Lexicon:
    """Words and stems (beginnings that several words share, none of which is most of it) that toxic rows hold and others
    hardly do: by the likelihood gain, asked for in step with how much can happen by chance, with at least ``least_share`` of their rows toxic were both classes equally many."""
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    if not n_toxic or not n_clean:
        return Lexicon([], [])
    least, least_gain = max(3, n_toxic // 300), 12 + 4 * math.log(max(1.0, n_toxic / 30))
    total, clean = Counter(), Counter()
    for words, y in zip(bags, toxic):
        (total if y else clean).update(words)

    def fine(t: int, c: int) -> bool:
        return t >= least and _gain(t, c, n_toxic, n_clean) >= least_gain and t / n_toxic >= least_share * (t / n_toxic + c / n_clean)

    seen_toxic, seen_clean, largest, kinds = Counter(), Counter(), Counter(), Counter()
    for words, y in zip(bags, toxic):
        (seen_toxic if y else seen_clean).update({w[:k] for w in words for k in STEM_LENGTHS if len(w) > k or not y})
    for w, n in total.items():
        for k in STEM_LENGTHS:
            if len(w) > k:
                kinds[w[:k]] += 1
                largest[w[:k]] = max(largest[w[:k]], n)
    stems: list[str] = []
    able = [s for s, t in seen_toxic.items() if kinds[s] >= STEM_WORDS and largest[s] <= 0.6 * t and fine(t, seen_clean[s])]
    for s in sorted(able, key=lambda s: (-_gain(seen_toxic[s], seen_clean[s], n_toxic, n_clean), -len(s), s)):
        if not any(s.startswith(x) or x.startswith(s) for x in stems):
            stems.append(s)
    terms = [w for w, t in sorted(total.items()) if len(w) >= 3 and fine(t, clean[w]) and not any(w.startswith(x) for x in stems)]
    return Lexicon(terms, stems)


def distinct_rows(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Without near copies of earlier rows, whose rare words would look like terms: rows that share two of four smallest shingle hashes."""
    hasher, seen, out = SpanHasher(), set(), []
    for text, y in rows:
        s = hasher.shingles(normal_words(text), 5)
        keys = [(i, int(mixed(s + np.uint64(i)).min())) for i in range(4)] if len(s) else []
        if sum(k in seen for k in keys) < 2:
            out.append((text, y))
        seen.update(keys)
    return out


class Matcher:
    """Matches of a text and its features."""

    def __init__(self, lexicon: Lexicon, window: Logistic | None = None) -> None:
        self.lexicon, self.automaton, self.window = lexicon, LexiconAutomaton(lexicon.terms, lexicon.stems), window
        self.known: set[bytes] = set()
        self.hits: dict[bytes, tuple[int, int, bool]] = {}

    def learn(self, words: list[bytes]) -> bool:
        """Run words not met before through the automaton; whether any of the words matches."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.hits = set(), {}
        new = set(words) - self.known
        for w in new:
            if hit := self.automaton.match(w.decode("utf-8", "replace")):
                self.hits[w] = hit
        self.known |= new
        return not self.hits.keys().isdisjoint(words)

    def of(self, word: bytes) -> tuple[int, int, bool] | None:
        self.learn([word])
        return self.hits.get(word)

    def matches(self, text: str) -> tuple[list[tuple[str, tuple[int, int, bool], float]], int]:
        """(word, match, chance that it is quoted) of each match, and the number of words."""
        text = folded(text)
        words = normal_words(text).split()
        if not self.learn(words):
            return [], len(words)
        out = []
        for i, (m, word) in enumerate(zip(_WORD.finditer(text), words)):
            if hit := self.hits.get(word):
                out.append((word.decode("utf-8", "replace"), hit, window_features(text, m.start(), m.end(), words, i)))
        chances = self.window.of(np.array([f for _, _, f in out])) if self.window and out else np.zeros(len(out))
        return [(word, hit, float(q)) for (word, hit, _), q in zip(out, chances)], len(words)

    def weight(self, hit: tuple[int, int, bool]) -> float:
        i, e, stem = hit
        x = self.lexicon
        return (x.near_stem if e else x.stem)[i] if stem else (x.fuzzy if e else x.exact)[i]

    def features(self, found: list, n: int) -> list[float]:
        """Of matches among n words, each weighted by the chance that it isn't quoted: largest and summed weight, largest of exact
        ones, density."""
        free = [max(0.0, self.weight(h)) * (1 - q) for _, h, q in found]
        exact = [max(0.0, self.weight(h)) * (1 - q) for _, h, q in found if h[1] == 0]
        return [max(free, default=0.0), math.log1p(sum(free)), max(exact, default=0.0), math.log1p(100 * sum(free) / (n + 5))]


def folded(text: str) -> str:
    """With plain quotation marks, so that a quoted word is the word."""
    return text.translate(_PLAIN_MARKS) if _MARKS.search(text) else text


def enclosed(text: str, start: int, end: int) -> bool:
    """Whether quotation marks on the line, within 60 characters on either side, enclose the range."""
    left, right = text[max(0, start - 60) : start].rpartition("\n")[2], text[end : end + 60].partition("\n")[0]
    return (left.count('"') % 2 == 1 and '"' in right) or (left.endswith("'") and right.startswith("'"))


def window_features(text: str, start: int, end: int, words: list[bytes], i: int) -> list[float]:
    """Of a match, the ``i``-th word: quotation marks around it, nearness of reporting words before and after it, nearness of
    words that address someone before and after it, an exclamation after it."""

    def nearness(listed: frozenset[str], side: list[bytes]) -> float:
        return max((1 / (1 + d) for d, w in enumerate(side) if w.decode("utf-8", "replace") in listed), default=0.0)

    left, right = words[max(0, i - WINDOW) : i][::-1], words[i + 1 : i + 1 + WINDOW]
    return [float(enclosed(text, start, end)), nearness(REPORTED, left), nearness(REPORTED, right), nearness(DIRECTED, left), nearness(DIRECTED, right), float(text[end : end + 1] == "!")]


def fit_window(rows: list[tuple[str, int]], matcher: Matcher) -> Logistic:
    """The chance that a match is quoted, by its window: windows of matches in toxic rows are abuse, and the same ones with the
    match put as a quotation, in each of a few ways, are quotation."""
    x, y = [], []
    for text, toxic in rows:
        text = folded(text)
        words = normal_words(text).split()
        if toxic != 1 or not matcher.learn(words):
            continue
        found = [(m.start(), m.end(), i) for i, (m, w) in enumerate(zip(_WORD.finditer(text), words)) if w in matcher.hits]
        for n, (start, end, i) in enumerate(found[:20]):
            x.append(window_features(text, start, end, words, i))
            y.append(0.0)
            put = folded(_QUOTED[(len(y) // 2 + n) % len(_QUOTED)])
            copy = text[max(0, start - 40) : start] + put.format(text[start:end]) + text[end : end + 40]
            at = min(40, start) + put.index("{")
            own = [(m.start(), m.end()) for m in _WORD.finditer(copy)]
            place = next((j for j, (a, b) in enumerate(own) if a <= at < b), None)
            if place is not None:
                x.append(window_features(copy, *own[place], normal_words(copy).split(), place))
                y.append(1.0)
    return Logistic.fit(np.array(x).reshape(len(x), WINDOW_FEATURES), np.array(y), empty=0.0)


@dataclass
class Model:
    lexicon: Lexicon
    window: Logistic
    logistic: Logistic


def bag(text: str) -> set[str]:
    return {w.decode("utf-8", "replace") for w in set(normal_words(folded(text)).split())}


def misspelled(text: str, matcher: Matcher, rng: np.random.Generator) -> str | None:
    """The text with one letter of each exact term changed, left out or doubled; None if no term can be."""
    changed = False

    def edit(m: re.Match) -> str:
        nonlocal changed
        word, hit = m[0], matcher.of(normal_words(m[0]))
        if not hit or hit[1] or hit[2] or edits(word) == 0:
            return word
        changed = True
        i, how = int(rng.integers(1, len(word))), int(rng.integers(3))
        return word[:i] + ("abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))] + word[i + 1 :], word[i + 1 :], word[i] + word[i:])[how]

    out = _WORD.sub(edit, text)
    return out if changed else None


def fit(rows: list[tuple[str, int]], seed: int = 3) -> Model:
    """Lexicon, its weights (the smoothed log odds of a row that holds a term or stem, as it is or misspelled), the window's model
    and the document's. Copies of toxic rows with misspelled terms are training rows too, so that misspelling counts as what it hides."""
    rows = distinct_rows(rows)
    x = learn_lexicon([bag(t) for t, _ in rows], np.array([y == 1 for _, y in rows], bool))
    matcher, rng = Matcher(x), np.random.default_rng(seed)
    rows = rows + [(t, 1) for text, y in rows if y == 1 and (t := misspelled(text, matcher, rng))]
    toxic = np.array([y == 1 for _, y in rows], bool)
    matcher.window = fit_window(rows, matcher)
    kinds = {"exact": len(x.terms), "fuzzy": len(x.terms), "stem": len(x.stems), "near_stem": len(x.stems)}
    counts = {kind: np.zeros((2, max(1, n))) for kind, n in kinds.items()}
    found = [matcher.matches(t) for t, _ in rows]
    for (hits, _), y in zip(found, toxic):
        for kind, i in {(("near_stem" if h[1] else "stem") if h[2] else ("fuzzy" if h[1] else "exact"), h[0]) for _, h, _ in hits}:
            counts[kind][int(y), i] += 1
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    for kind, n in kinds.items():
        setattr(x, kind, [_odds(counts[kind][1, i], counts[kind][0, i], n_toxic, n_clean) for i in range(n)])
    features = np.array([matcher.features(*f) for f in found]).reshape(len(rows), FEATURES)
    return Model(x, matcher.window, Logistic.fit(features, toxic.astype(float)))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1200) -> Model:
    """Fit on at most ``per_class`` labelled rows a class, by the smallest hash of doc_id, held-out rows left out."""
    return fit(training_rows(docs, labels, "toxic", per_class))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with score and matches array<struct<word, term, edits, quoted>> of every whole text; quoted is
    the chance that the match is a quotation.

    Null and empty texts have no matches and score as such; repeated rows stay; an empty table gives an empty one; without
    training rows of both classes every text scores the share of the one class there is, or 0.5; columns score and matches of
    ``docs`` are replaced; the time of a text is linear in its length. A map over Arrow
    batches: nothing is shuffled; the model is a few hundred terms.
    """
    arrow = pa.list_(pa.struct([("word", pa.string()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.float64())]))

    def start():
        matcher = Matcher(model.lexicon, model.window)
        named = (model.lexicon.terms, model.lexicon.stems)

        def work(texts: list[str]) -> list[pa.Array]:
            found = [matcher.matches(t) for t in texts]
            rows = np.array([matcher.features(*f) for f in found]).reshape(len(texts), FEATURES)
            shown = [[{"word": w, "term": named[h[2]][h[0]], "edits": h[1], "quoted": q} for w, h, q in hits] for hits, _ in found]
            return [pa.array(model.logistic.of(rows), pa.float64()), pa.array(shown, arrow)]

        return work

    return annotated(docs, text_col, start, {"score": "double", "matches": "array<struct<word:string,term:string,edits:int,quoted:double>>"})


#: Score from which a document is toxic.
REJECT = 0.7


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score less than ``REJECT``, with their columns, whatever these are called.

    Each row is judged by its own whole text: null and empty ones stay, repeated rows stay or go together, and an empty table
    gives an empty one.
    """
    return score(packed(docs), model, "_row.text").where(F.col("score") < REJECT).select("_row.*")
