"""Personal data in whole texts: base patterns, and a semi-Markov conditional random field that adds spans.

Kinds: email, ip, card, phone. Base patterns give spans that always stay. Around them and around other runs of
digits or written-out addresses lie regions; within a region the model scores whole candidate segments
(digit grouping, separators, checksum, what stands on either side) and dynamic programming over entities of
bounded length picks boundaries and kinds together. Spans it adds never overlap a base span.

The model is fitted here, on a bounded sample of regions labelled by the base patterns, and on variants of those
spans that the patterns miss (no country code, other separators, written-out signs), with look-alikes as
negatives. Everything else runs over every row and every text; offsets are code points.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.reshape import quoted

KINDS = ("email", "ip", "card", "phone")
SAMPLE_REGIONS = 2_000
EPOCHS = 4
MAX_TOKENS = 20
CONTEXT = 12

_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_NUMBERS = re.compile(r"[+(]?[0-9](?:[\x20().+/-]{0,2}[0-9])*+")
_SAID = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}"
    r"(?:\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}(?:(?:\x20?[(\[]dot[)\]]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{1,63}){1,4}"
    r"|\x20at\x20[A-Za-z0-9-]{1,63}(?:(?:\x20dot\x20|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]{1,63}){1,4})"
)
_ADDRESS = re.compile(r"^[A-Za-z0-9._%+-]+\W+at\b.*(?:\.|\bdot\b)\W*[A-Za-z]{2,}$")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.DOTALL)

Span = tuple[int, int, str]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in time linear in the text: every '@' looks back over its local part."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """The base patterns, leftmost and non-overlapping per kind, ordered by start and kind."""
    found: list[Span] = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                parts = [p.lstrip("0") for p in m.group().split(".")]
                if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                    found.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def regions(text: str) -> list[tuple[int, int]]:
    """Where the model looks: runs of at least seven digits with separators, and written-out addresses."""
    found = []
    if _DIGIT.search(text):
        for m in _NUMBERS.finditer(text):
            if m.end() - m.start() >= 7 and sum(c.isdigit() for c in m.group()) >= 7:
                found.append(m.span())
    if " at " in text or "(at)" in text or "[at]" in text:
        found += [m.span() for m in _SAID.finditer(text)]
    return sorted(found)


def _shape(piece: str) -> str:
    """Digit groups as their lengths, letters as one mark, everything else as it is."""
    return re.sub(r"[0-9]+", lambda m: str(min(len(m.group()), 20)) + "_", re.sub(r"[A-Za-z]+", "a", piece))


def _side(char: str) -> str:
    if not char:
        return "edge"
    return "digit" if char.isdigit() else "letter" if char.isalpha() else "space" if char.isspace() else char


def _features(text: str, start: int, end: int) -> list[str]:
    """What the whole span looks like; the same list serves every kind."""
    piece = text[start:end]
    digits = "".join(c for c in piece if "0" <= c <= "9")
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    out = ["bias", "left=" + _side(before), "right=" + _side(after), f"digits={min(len(digits), 20)}"]
    if any(c.isalpha() for c in piece):
        marks = re.sub(r"[A-Za-z0-9._%+-]+", "w", piece)
        ending = re.split(r"[^A-Za-z]+", piece)[-1]
        return [*out, "said=" + marks[:24], f"tld={ending.isalpha() and 2 <= len(ending) <= 6}"]
    groups = re.findall(r"[0-9]+", piece)
    marks = "".join(sorted(set(re.sub(r"[0-9]", "", piece))))
    out += ["shape=" + _shape(piece)[:40], "marks=" + marks, f"groups={min(len(groups), 6)}", f"luhn={12 <= len(digits) <= 19 and luhn(digits)}"]
    octets = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    out += [f"octets={octets},{marks}", f"first={piece[0]}" if not piece[0].isdigit() else f"first={min(len(groups[0]), 5)}"]
    parens = piece.count("(") == piece.count(")")
    return [*out, f"parens={parens}", f"phone={9 <= len(digits) <= 15 or len(digits) == 7},{marks},{parens}"]


@dataclass
class SpanModel:
    """Weights by (kind, feature); an empty model adds nothing."""

    weights: dict[tuple[str, str], float] = field(default_factory=dict)

    def score(self, kind: str, features: list[str]) -> float:
        get = self.weights.get
        return sum(get((kind, f), 0.0) for f in features)


def possible(piece: str) -> tuple[str, ...]:
    """The kinds a segment may have at all: their checks hold for it."""
    if any(c.isalpha() for c in piece):
        return ("email",) if _ADDRESS.search(piece) else ()
    groups = re.findall(r"[0-9]+", piece)
    digits = "".join(groups)
    kinds = []
    if len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups):
        kinds.append("ip")
    if 13 <= len(digits) <= 19 and luhn(digits) and (len(groups) == 1 or all(3 <= len(g) <= 7 for g in groups)):
        kinds.append("card")
    if 7 <= len(digits) <= 15 and len(digits) < len(piece) and piece.count("(") == piece.count(")"):
        kinds.append("phone")
    return tuple(kinds)


def lattice(text: str, start: int, end: int) -> tuple[list[int], list[tuple[int, int, list[str], tuple[str, ...]]]]:
    """Token bounds of a region, and the candidate segments (from, to, features, kinds) over them.

    An entity spans at most MAX_TOKENS tokens; addresses hold letters, the other kinds none.
    """
    bounds = [start]
    for m in _TOKEN.finditer(text, start, end):
        bounds.append(m.end())
    candidates = []
    for i in range(len(bounds) - 1):
        first = text[bounds[i]]
        if not (first.isalnum() or first in "+("):
            continue
        for j in range(i + 1, min(i + MAX_TOKENS, len(bounds) - 1) + 1):
            if not text[bounds[j] - 1].isalnum():
                continue
            piece = text[bounds[i] : bounds[j]]
            kinds = possible(piece)
            if kinds:
                candidates.append((i, j, _features(text, bounds[i], bounds[j]), kinds))
    return bounds, candidates


def decode(model: SpanModel, text: str, start: int, end: int) -> list[Span]:
    """The best segmentation of a region; a token outside every entity scores zero."""
    bounds, candidates = lattice(text, start, end)
    if not candidates:
        return []
    ending: dict[int, list] = {}
    for i, j, features, kinds in candidates:
        kind = max(kinds, key=lambda k: model.score(k, features))
        ending.setdefault(j, []).append((i, model.score(kind, features), kind))
    best, back = [0.0] * len(bounds), [None] * len(bounds)
    for j in range(1, len(bounds)):
        best[j] = best[j - 1]
        for i, score, kind in ending.get(j, ()):
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, kind)
    found, j = [], len(bounds) - 1
    while j > 0:
        if back[j]:
            i, kind = back[j]
            found.append((bounds[i], bounds[j], kind))
            j = i
        else:
            j -= 1
    return found[::-1]


def _covered(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover together: apart from each other, so both are in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b, _ in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def all_spans(model: SpanModel, text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, base): base spans and what the model adds beside them, by start and kind."""
    if not text:
        return []
    base = base_spans(text)
    added: list[Span] = []
    if model.weights:
        starts, ends = _covered(base)
        for start, end in regions(text):
            for a, b, kind in decode(model, text, start, end):
                at = bisect_right(ends, a)
                clash = at < len(starts) and starts[at] < b
                if not clash and (not added or added[-1][1] <= a):
                    added.append((a, b, kind))
    out = [(*s, True) for s in base] + [(*s, False) for s in added]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- fitting ------------------------------------------------------------------------------------------


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def _step(model: SpanModel, squares: dict, text: str, span: tuple[int, int], gold: list[Span], rate: float) -> None:
    """One AdaGrad step on the log-likelihood of a region's labelled segmentation."""
    bounds, candidates = lattice(text, *span)
    if not candidates:
        return
    size = len(bounds)
    edges = [(i, j, k, f, model.score(k, f)) for i, j, f, kinds in candidates for k in kinds]
    ins: list[list] = [[] for _ in range(size)]
    outs: list[list] = [[] for _ in range(size)]
    for e in edges:
        ins[e[1]].append(e)
        outs[e[0]].append(e)
    ahead, behind = [0.0] * size, [0.0] * size
    for j in range(1, size):
        ahead[j] = _logsum([ahead[j - 1], *(ahead[e[0]] + e[4] for e in ins[j])])
    for i in range(size - 2, -1, -1):
        behind[i] = _logsum([behind[i + 1], *(behind[e[1]] + e[4] for e in outs[i])])
    wanted = set(gold)
    slope: dict[tuple[str, str], float] = {}
    for i, j, kind, features, score in edges:
        p = math.exp(ahead[i] + score + behind[j] - ahead[-1])
        delta = ((bounds[i], bounds[j], kind) in wanted) - p
        if abs(delta) > 1e-4:
            for f in features:
                slope[kind, f] = slope.get((kind, f), 0.0) + delta
    for key, g in slope.items():
        g -= 1e-3 * model.weights.get(key, 0.0)
        squares[key] = squares.get(key, 1e-6) + g * g
        model.weights[key] = model.weights.get(key, 0.0) + rate * g / math.sqrt(squares[key])


Example = tuple[str, tuple[int, int], list[Span]]


def _example(left: str, piece: str, right: str, kind: str | None) -> Example:
    span = (len(left), len(left) + len(piece))
    return left + piece + right, span, [(*span, kind)] if kind else []


def _digits(rng: random.Random, n: int) -> str:
    return str(rng.randint(1, 9)) + "".join(str(rng.randint(0, 9)) for _ in range(n - 1))


def variants(rng: random.Random, rounds: int) -> list[Example]:
    """Spans as people write them where the base patterns miss them, and numbers that only look alike."""
    out: list[Example] = []
    for _ in range(rounds):
        left, right = rng.choice(["call ", "tel. ", "the ", "(", ": "]), rng.choice([" or", ".", ", and", "", ")"])
        a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
        for piece in (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"+1 ({a}) {b}-{c}", f"+44 {a} {b} {c}"):
            out.append(_example(left, piece, right, "phone"))
        digits = _digits(rng, 15)
        good = next(digits + str(d) for d in range(10) if luhn(digits + str(d)))
        bad = next(digits + str(d) for d in range(10) if not luhn(digits + str(d)))
        for sep in ("", " ", "-", "."):
            out.append(_example(left, sep.join(good[n : n + 4] for n in range(0, 16, 4)), right, "card"))
            out.append(_example(left, sep.join(bad[n : n + 4] for n in range(0, 16, 4)), right, None))
        octets = [str(rng.randint(10, 255)) for _ in range(4)]
        out.append(_example(left, ".".join(octets), right, "ip"))
        name, host = rng.choice(["ana", "j.doe", "info", "li_wei"]), rng.choice(["mail", "site-two", "corp"])
        for at, dot in ((" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", "."), (" [at] ", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] ")):
            out.append(_example(left, f"{name}{at}{host}{dot}com", right, "email"))
        out.append(_example(left, f"{name} at {host}.com", right, None))
        year, month = rng.randint(1900, 2099), rng.randint(1, 12)
        for piece in (f"{year}-{month:02d}-{rng.randint(1, 28):02d}", f"{rng.randint(1, 28):02d}.{month:02d}.{year}", f"{year}-{year + 1}"):
            out.append(_example(left, piece, right, None))
        day, hour = rng.randint(1, 28), rng.randint(0, 23)
        for piece in (f"{year}-{month:02d}-{day:02d} {hour:02d}", f"{year}/{month:02d}/{day:02d} {hour:02d}", f"{day:02d}.{month:02d}.{year} {hour:02d}"):
            out.append(_example(left, piece, f":{rng.randint(0, 59):02d}", None))
        isbn = f"978-{rng.randint(0, 9)}-{_digits(rng, 2)}-{_digits(rng, 6)}-{rng.randint(0, 9)}"
        out += [_example(left, isbn, right, None), _example(left, isbn[4:], right, None)]
        ragged = rng.choice(" -.").join(_digits(rng, rng.randint(1, 6)) for _ in range(rng.randint(2, 5)))
        if not re.fullmatch(r"[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}", ragged) and "ip" not in possible(ragged):
            out.append(_example(left, ragged, right, None))
        for n in (7, 8, 9, 10, 11, 13, 17, 20):
            out.append(_example(left, _digits(rng, n), right, None))
        out.append(_example(left, f"{_digits(rng, 3)} {_digits(rng, 4)} {_digits(rng, 2)} {_digits(rng, 5)}", right, None))
        out.append(_example(left, f"{_digits(rng, 2)}.{_digits(rng, 4)}.{_digits(rng, 1)}.{_digits(rng, 2)}", right, None))
        out.append(_example(left, f"{_digits(rng, 5)}-{_digits(rng, 4)}-{_digits(rng, 4)}", right, None))
    return out


def fit_examples(seen: list[Example], epochs: int = EPOCHS, seed: int = 7) -> SpanModel:
    """Fit on regions of the corpus with their base labels, and on written variants."""
    rng = random.Random(seed)
    rows = seen + variants(rng, 40)
    model, squares = SpanModel(), {}
    for _ in range(epochs):
        rng.shuffle(rows)
        for text, span, gold in rows:
            _step(model, squares, text, span, gold, 0.3)
    return model


def _selected(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fit(documents: DataFrame, sample_regions: int = SAMPLE_REGIONS, id_col: str = "doc_id", text_col: str = "text") -> SpanModel:
    """Fit the model on at most ``sample_regions`` regions of the corpus, chosen by a hash of their text.

    Regions travel with a few characters of context, so the sample is small; those of more than 200 characters are not
    drawn. A corpus without any region gives a model of the written variants alone.
    """

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts, ends = [], [], []
            for text in batch.column(1).to_pylist():
                for start, end in regions(text or ""):
                    if end - start <= 200:
                        low = max(0, start - CONTEXT)
                        texts.append(text[low : end + CONTEXT])
                        starts.append(start - low)
                        ends.append(end - low)
            yield pa.RecordBatch.from_pydict({"text": texts, "start": starts, "end": ends}, schema=schema)

    schema = pa.schema([("text", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    seen = _selected(documents, id_col, text_col).mapInArrow(cut_out, "text string, start long, end long")
    rows = seen.orderBy(F.xxhash64("text"), "text", "start").limit(sample_regions).collect()
    examples = []
    for r in rows:
        gold = [s for s in base_spans(r.text) if r.start <= s[0] and s[1] <= r.end]
        kept: list[Span] = []
        for s in gold:
            if not kept or kept[-1][1] <= s[0]:
                kept.append(s)
        if kept:  # a number that no base pattern knows is no proof of a clean one
            examples.append((r.text, (r.start, r.end), kept))
    return fit_examples(examples)


# --- applying -----------------------------------------------------------------------------------------

_SPAN = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def find_spans(documents: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row; a null or empty text has no spans. Repeated rows answer alike."""
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [{"kind": k, "start": a, "end": b, "base": base} for a, b, k, base in all_spans(model, text)]
                for text in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind_type)], names=["doc_id", "spans"])

    return _selected(documents, id_col, text_col).mapInArrow(search, f"doc_id long, spans {_SPAN}")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the hash of the base spans and the list of all spans."""
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def masked_text(text: str, spans: list[tuple[int, int, str, bool]]) -> str:
    """Each covered stretch replaced by its kind in brackets; overlapping spans share the first one's kind."""
    out, at = [], 0
    for start, end, kind, _ in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def mask(documents: DataFrame, model: SpanModel, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows with personal data replaced in the text, and the length column set where there is one.

    A null text stays null and keeps its length; an empty one stays empty. Repeated rows are changed alike.
    """
    names = documents.columns

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            changed = [None if t is None else masked_text(t, all_spans(model, t)) for t in texts]
            yield batch.set_column(at, batch.schema.field(at), pa.array(changed, batch.schema.field(at).type))

    rows = documents.mapInArrow(replace, documents.schema)
    if length_col in names:
        length = F.when(quoted(text_col).isNull(), quoted(length_col)).otherwise(F.length(quoted(text_col)))
        rows = rows.withColumn(length_col, length.cast(documents.schema[length_col].dataType))
    return rows.select(*[quoted(c) for c in names])
