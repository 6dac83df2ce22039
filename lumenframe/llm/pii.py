"""Personal data: base patterns, and further spans chosen by a semi-Markov conditional random field.

The field scores whole candidate spans (their digits, groups, separators, checksum, neighbours and cue words), and a
dynamic program over the tokens of a region, with entities of bounded length, jointly chooses boundaries and types. It is
trained on regions of a bounded sample of documents, in which base matches are the entities; rewritten copies of those
matches (other separators, no country code, spelled-out signs) teach it the forms that the base patterns don't have.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, sampled_texts, text_column

#: The kinds, in the order in which equal starts are listed, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: A match begins where a run of digits does; saying so keeps long runs from being tried at every digit.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_DIGITS = frozenset("0123456789")
_ZEROS = {ord(c): "0" for c in _DIGITS}

#: Regions in which candidates are sought, and their tokens.
_NUMBERS = re.compile(r"[+(]?[0-9][0-9().\- /]*[0-9]")
#: The sign of an address, as it is or spelled out, and the domain after it.
_SIGN = re.compile(r"@|[(\[{] ?at ?[)\]}]", re.I | re.A)
_AFTER = re.compile(r" ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[{] ?dot ?[)\]}]) ?[A-Za-z0-9-]++)+", re.I | re.A)
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)
#: Tokens of an entity at most; digits of a region at least; characters before a span in which cue words count.
MAX_TOKENS, MIN_DIGITS, CUE = 24, 7, 24
#: Words that announce a kind.
CUES = {"email": ("mail", "contact"), "ip": ("ip", "host", "server", "addr"), "card": ("card", "visa", "credit", "karte", "tarjeta", "carte"), "phone": ("tel", "phone", "call", "fax", "mobile", "fon")}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Equal to leftmost, non-overlapping matches of the pattern: its first part can't hold the sign, so each sign is tried once."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            after = m.end()
        at = text.find("@", max(at + 1, after))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), sorted."""
    out = [(s, 0, e) for s, e in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@dataclass
class Region:
    """Token ends in a text, and candidates (first token, token after the last, kind, features or their score)."""

    bounds: list[int]
    candidates: list[tuple[int, int, int, list[str] | float]] = field(default_factory=list)


def _near(c: str) -> str:
    return "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if not c.strip() else c


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Ranges that look like an address with a sign or a spelled one; each sign is tried once, from its place outwards."""
    after = 0
    for sign in _SIGN.finditer(text):
        start = sign.start() - (sign.start() > after and text[sign.start() - 1] == " ")
        end = start
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        if start < end and (m := _AFTER.match(text, sign.end())):
            yield start, m.end()
            after = m.end()


@lru_cache(maxsize=1 << 16)
def _shape(plain: str) -> tuple[tuple[int, tuple[str, ...]], ...]:
    """(kind, names of features) by the form of a span of numbers, whose digits are all written 0, for the kinds it can be."""
    groups = [len(x) for x in re.split(r"[^0]+", plain) if x]
    n = sum(groups)
    seps = "".join(sorted(set(plain) - {"0"}))
    out = (f"shape={'-'.join(map(str, groups))}", f"n={n}", f"groups={min(len(groups), 6)}", f"seps={seps}", f"plus={plain[0] == '+'}", f"paren={'(' in plain}")
    fits = {1: len(groups) == 4 and max(groups) <= 3, 2: n >= 12, 3: MIN_DIGITS <= n <= 15}
    return tuple((kind, tuple(f"{KINDS[kind]}:{x}" for x in out)) for kind, fine in fits.items() if fine)


def _particular(text: str, start: int, end: int, kind: int) -> list[str]:
    """Names of the features of a span that its form doesn't tell."""
    span, out = text[start:end], []
    if kind == 0:
        tail = re.split(r"\.|[)\]}]", span)[-1].strip()
        out = ["sign" if "@" in span else "spelled", f"tail={min(len(tail), 5)}{'a' if tail.isalpha() else ''}", f"parts={min(4, len(re.findall(r'[.]|dot', span)))}", f"space={' ' in span}"]
    elif kind == 1:
        out = [f"octets={all(int(x) <= 255 for x in re.findall(r'[0-9]+', span))}"]
    elif kind == 2:
        out = [f"luhn={luhn(re.sub(r'[^0-9]', '', span))}"]
    before = text[max(0, start - CUE) : start].lower()
    out += [f"cue={any(c in before for c in CUES[KINDS[kind]])}", f"left={_near(text[start - 1]) if start else 'edge'}", f"right={_near(text[end]) if end < len(text) else 'edge'}", "bias"]
    return [f"{KINDS[kind]}:{x}" for x in out]


def _kinds(text: str, start: int, end: int, plain: str | None) -> tuple[tuple[int, tuple[str, ...]], ...]:
    """What a span can be: an address where ``plain`` is None, else what its form allows."""
    if plain is not None:
        return _shape(plain)
    span = text[start:end]
    return ((0, ()),) if span[-1].isalnum() and re.match(r"[A-Za-z0-9._%+-]*[A-Za-z0-9]", span) else ()


def features(text: str, start: int, end: int, plain: str | None) -> list[tuple[int, list[str]]]:
    """(kind, names of all features) of a whole span for the kinds that it can be."""
    return [(kind, [*form, *_particular(text, start, end, kind)]) for kind, form in _kinds(text, start, end, plain)]


def regions(text: str, of: Callable[[str, int, int, str | None], list] = features) -> Iterator[Region]:
    """Places of the text with candidates, ``of`` each span that may be one: by default its features. The work is linear in the
    text's length: a token begins at most ``MAX_TOKENS`` spans."""
    spans = [m.span() for m in _NUMBERS.finditer(text) if m.end() - m.start() >= MIN_DIGITS and sum(c.isdigit() for c in m[0]) >= MIN_DIGITS - 3]
    spans += _addresses(text)
    spans.sort()
    merged: list[list[int]] = []
    for s, e in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        bounds = [s, *(m.end() for m in _TOKEN.finditer(text, s, e))]
        region = Region(bounds)
        signs = [m.span() for m in _SIGN.finditer(text, s, e)]
        plain, at = text[s:e].translate(_ZEROS), 0
        # digits, and tokens with letters, before each bound; bounds at which a span may end
        digits, letters = [0], [0]
        for a, b in zip(bounds, bounds[1:]):
            digits.append(digits[-1] + (b - a if text[a] in _DIGITS else 0))
            letters.append(letters[-1] + text[a].isalpha())
        ends = [j for j in range(1, len(bounds)) if text[bounds[j] - 1].isalnum()]
        near = 0
        for i, a in enumerate(bounds[:-1]):
            if not (text[a].isalnum() or text[a] in "+("):
                continue
            while at < len(signs) and signs[at][0] < a:
                at += 1
            while near < len(ends) and ends[near] <= i:
                near += 1
            sign = signs[at][1] if at < len(signs) else len(text) + 1
            for j in ends[near : near + MAX_TOKENS]:
                b, n = bounds[j], digits[j] - digits[i]
                if j > i + MAX_TOKENS or n > 19 and sign > bounds[min(i + MAX_TOKENS, len(bounds) - 1)]:
                    break
                if sign <= b:
                    region.candidates += [(i, j, kind, x) for kind, x in of(text, a, b, None)]
                elif MIN_DIGITS - 3 <= n <= 19 and letters[j] == letters[i]:
                    region.candidates += [(i, j, kind, x) for kind, x in of(text, a, b, plain[a - s : b - s])]
        if region.candidates:
            yield region


class SemiMarkovCRF:
    """A segment's score is the sum of its features' weights; a token outside entities scores 0."""

    def __init__(self, weights: dict[str, float] | None = None) -> None:
        self.weights = weights or {}
        self._forms: dict[str, list[tuple[int, float]]] = {}
        #: By kind, the most that features beyond the form can add.
        groups: dict[tuple[int, str], float] = defaultdict(float)
        for name, w in self.weights.items():
            kind, _, rest = name.partition(":")
            group = rest.partition("=")[0]
            if group not in ("shape", "n", "groups", "seps", "plus", "paren"):
                groups[KINDS.index(kind), group] = max(groups[KINDS.index(kind), group], w)
        self._more = [sum(w for (k, _), w in groups.items() if k == kind) for kind in range(len(KINDS))]

    def _scored(self, region: Region) -> list[tuple[int, int, int, list[str], float]]:
        w = self.weights.get
        return [(i, j, k, f, sum(w(x, 0.0) for x in f)) for i, j, k, f in region.candidates]

    def scores(self, text: str, start: int, end: int, plain: str | None) -> list[tuple[int, float]]:
        """(kind, score) of a span for the kinds that score above 0; only those that still can are looked at closely."""
        w = self.weights.get
        if plain is None:
            able = [(k, 0.0) for k, _ in _kinds(text, start, end, None)]
        else:
            able = self._forms.get(plain)
            if able is None:
                if len(self._forms) >= 1 << 16:
                    self._forms.clear()
                able = self._forms[plain] = [(k, x) for k, form in _shape(plain) if (x := sum(w(f, 0.0) for f in form)) + self._more[k] > 0]
        out = [(k, x + sum(w(f, 0.0) for f in _particular(text, start, end, k))) for k, x in able]
        return [(k, x) for k, x in out if x > 0]

    def find(self, text: str, blocked: list[tuple[int, int]] = ()) -> list[tuple[int, int, int]]:
        """The entities (start, kind, end) of a whole text, outside of the blocked ranges, which are sorted and disjoint or nested."""
        reach = list(accumulate((e for _, e in blocked), max))
        starts = [s for s, _ in blocked]

        def free(start: int, end: int) -> bool:
            before = bisect_left(starts, end)  # ranges that begin before the span's end
            return not before or reach[before - 1] <= start

        def of(text: str, start: int, end: int, plain: str | None) -> list[tuple[int, float]]:
            return self.scores(text, start, end, plain) if free(start, end) else []

        return [x for region in regions(text, of) for x in best(region.bounds, region.candidates)]

    def fit(self, examples: list[tuple[Region, set[tuple[int, int, int]]]], epochs: int = 8, rate: float = 0.4, decay: float = 1e-3) -> SemiMarkovCRF:
        """Gradient steps on the conditional likelihood of the gold entities (start, kind, end), forward and backward in log space."""
        w: dict[str, float] = defaultdict(float)
        self.weights = w
        for epoch in range(epochs):
            step = rate / (1 + epoch / 2)
            for region, gold in examples:
                b, n = region.bounds, len(region.bounds) - 1
                scored = self._scored(region)
                ends, begins = defaultdict(list), defaultdict(list)
                for c in scored:
                    ends[c[1]].append(c)
                    begins[c[0]].append(c)
                alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
                for j in range(1, n + 1):
                    alpha[j] = _logsum([alpha[j - 1], *(alpha[c[0]] + c[4] for c in ends[j])])
                for i in range(n - 1, -1, -1):
                    beta[i] = _logsum([beta[i + 1], *(beta[c[1]] + c[4] for c in begins[i])])
                for i, j, k, f, s in scored:
                    g = ((b[i], k, b[j]) in gold) - math.exp(min(0.0, alpha[i] + s + beta[j] - alpha[n]))
                    if abs(g) > 1e-3:
                        for x in f:
                            w[x] += step * (g - decay * w[x])
        self.__init__({x: round(v, 4) for x, v in w.items() if abs(v) > 1e-3})
        return self


def best(bounds: list[int], scored: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """The entities (start, kind, end) of the segmentation of largest score."""
    n, ending = len(bounds) - 1, defaultdict(list)
    for i, j, k, s in scored:
        ending[j].append((s, i, k))
    score, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        score[j] = score[j - 1]
        for s, i, k in ending.get(j, ()):
            if score[i] + s > score[j]:
                score[j], back[j] = score[i] + s, (i, k)
    out, j = [], n
    while j > 0:
        if back[j]:
            i, k = back[j]
            out.append((bounds[i], k, bounds[j]))
            j = i
        else:
            j -= 1
    return out[::-1]


def _logsum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(v - top) for v in x))


def rewritten(text: str, span: tuple[int, int, int]) -> list[tuple[str, int, int, int]]:
    """Copies of the text around a base match with the match in another form: (text, start, kind, end)."""
    start, kind, end = span
    left, own, right = text[max(0, start - 30) : start], text[start:end], text[end : end + 30]
    digits = re.sub(r"[^0-9]", "", own)
    forms = []
    if kind == 0:
        name, _, host = own.partition("@")
        forms = [f"{name} (at) {host.replace('.', ' (dot) ')}", f"{name}[at]{host}"]
    elif kind == 2 and len(digits) == 16:
        forms = ["-".join(digits[i : i + 4] for i in range(0, 16, 4)), ".".join(digits[i : i + 4] for i in range(0, 16, 4))]
    elif kind == 3 and len(digits) >= 10:
        d = digits[-10:]
        forms = [f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}"]
    return [(left + f + right, len(left), kind, len(left) + len(f)) for f in forms]


def examples_of(texts: list[str], limit: int) -> list[tuple[Region, set[tuple[int, int, int]]]]:
    """The training regions of the texts in their order, with and without entities, until there are ``limit``."""
    out = []
    for text in texts:
        gold = set(base_spans(text))
        out += [(r, gold) for r in regions(text)]
        for span in sorted(gold):
            for copy, s, k, e in rewritten(text, span):
                out += [(r, {(s, k, e)}) for r in regions(copy) if r.bounds[0] <= s and e <= r.bounds[-1]]
        for m in re.finditer(r"[0-9]{7,}", text):  # plain runs of digits that are nothing
            if not any(s <= m.start() < e for s, _, e in gold):
                out += [(r, set()) for r in regions(text[max(0, m.start() - 30) : m.end() + 30])]
        if len(out) >= limit:
            return out[:limit]
    return out


def train(docs: DataFrame, sample_docs: int = 800, limit: int = 1500) -> SemiMarkovCRF:
    """Fit on a bounded sample: of the documents that hold a base-like sign anywhere, the ``sample_docs`` with the smallest hash of
    doc_id, whole texts in the order of that hash, and of those regions at most ``limit``. No labels are used."""
    rows = docs.select("doc_id", text_column().alias("text")).where("doc_id IS NOT NULL")
    order = F.xxhash64(F.col("doc_id").cast("string"))
    picked = rows.where(F.col("text").rlike(r"[0-9][0-9 ().-]{6}|@")).select("doc_id").distinct().orderBy(order, "doc_id").limit(sample_docs)
    got = sampled_texts(docs, picked).withColumn("place", order).collect()
    return SemiMarkovCRF().fit(examples_of([r["text"] for r in sorted(got, key=lambda r: (r["place"], r["doc_id"]))], limit))


def spans_of(text: str, model: SemiMarkovCRF) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: the base ones and what the field finds outside of them."""
    base = base_spans(text)
    return base, sorted(base + model.find(text, sorted((s, e) for s, _, e in base)))


def find(docs: DataFrame, model: SemiMarkovCRF) -> DataFrame:
    """doc_id, base and spans of every whole text, each an array<struct<kind, start, end>> in code points, end exclusive.

    base holds the base patterns' matches; spans holds them and the field's. Null texts are empty; repeated rows stay;
    other columns aren't read, whatever their names; an empty table gives an empty one; the time of a text is linear in its length. A map over Arrow batches: nothing is shuffled; the model's few hundred weights
    travel with the task.
    """
    prepare(docs.sparkSession)
    weights = model.weights
    kind = "array<struct<kind:string,start:int,end:int>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def shown(spans: list[tuple[int, int, int]]) -> list[dict]:
        return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = SemiMarkovCRF(weights)
        for batch in batches:
            found = [spans_of(t, crf) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shown(b) for b, _ in found], arrow), pa.array([shown(a) for _, a in found], arrow)], names=["doc_id", "base", "spans"])

    return docs.select("doc_id", text_column().alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {kind}, spans {kind}")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, longest first where they overlap, replaced by its kind in angle brackets."""
    out, at = [], 0
    for start, same in groupby(sorted(spans), key=lambda s: s[0]):
        _, kind, end = max(same, key=lambda s: s[2])
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
            at = end
    return "".join(out) + text[at:]


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
