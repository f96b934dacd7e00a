"""Personal data in texts: fixed patterns, and a conditional random field that adds to them (operator 13).

Patterns find the plain forms of e-mail addresses, IP addresses, card and phone numbers; each is read so that its time
grows with the text alone. The field (``crf.py``) finds other forms and kinds: written-out addresses, national phone
numbers, identity and bank numbers, names behind a cue, secrets. Its features are word shapes of a token and its
neighbours, gaps between them, and the cue words of the labelled table it is trained on. The table is small: some
lines of sample text with slots, filled by a seeded draw (``labelled_table``), or rows of one's own.

A sequence is the tokens of a line within ``REACH`` characters of a digit, an @ or a cue: those parts of the whole
text are all that can hold a span, in training as in decoding. They are decoded by Viterbi in batches of similar
length. A span of the field that lies within one of the patterns', or overlaps one of its own kind, is left out.

Plan: one pass over the documents, no shuffle; the fitted weights, bounded by the labelled table, travel with the
tasks. Defined cases: a null or empty text has no spans; repeated rows come back each; an empty table gives no rows;
further columns are ignored unless ``keep`` names them. Places are code points, ends exclusive.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.bytewords import raw_texts, texts_of, with_rows
from cohortspark.llm.crf import Chain, tags
from cohortspark.llm.files import shipped
from cohortspark.session import tuned

#: Kinds in the order of results: those with patterns first.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "id", "name", "secret")
#: Characters beside a digit, an @ or a cue that belong to its sequence, up to the next white space.
REACH = 60
#: Characters of texts whose sequences are decoded together.
TEXTS_AT_ONCE = 1 << 22
#: Draws of each sample line, and the seed of the table.
DRAWS, SEED = 8, 20240229

#: Sample lines. Slots in braces are filled; kinds in capitals are labelled.
SAMPLES = """
{w} {w} {EMAIL} {w} {w}
{W} {w} {w}, {EMAIL}. {W} {w} {w}
contact: {EMAIL}
email {EMAIL} {w}{j}
{w} {j} {EMAIL}{j} {w}{j} {w}
{w} {w} {IP} {w} {w} {w}
{W} {w} {IP}, {w} {w}
server ip {IP} {w}
{w}{j} {IP}{j} {w}{j}
{w} {w} {CARD} {w} {w}
card number {CARD}
credit card: {CARD}, {w} {w}
{w}{j} {CARD}{j} {w}
{w} {w} {PHONE} {w} {w}
{W} {w}, {PHONE} {w}. {W} {w}
phone: {PHONE}
call {PHONE} {w} {w}
tel. {PHONE}, {w}
fax {PHONE} {w}
mobile {PHONE}
{w}{j} {PHONE}{j} {w}{j}
ssn {ID} {w}
{w} {w} {ID} {w} {w}
iban: {ID}
{W} {w} iban {ID}. {W}
my name is {NAME} {w} {w}
my name is {NAME}. {W} {w}
mr. {NAME} {w} {w}
Mrs. {NAME}, {w} {w}
Dr. {NAME} {w} {w}
name: {NAME}
mein Name ist {NAME}, {w} {w}
je m'appelle {NAME} {w}
me llamo {NAME}. {W} {w}
{w} token = "{SECRET}" {w} {w}
{w}{j} token = "{SECRET}"{j} {w}
password={SECRET} {w} {w}
{w} {w} password={SECRET}{j} {w}
password: {SECRET}
{w} {w} {KEY} {w} {w}
{W}. {KEY}, {w}
{w}{j} {KEY}{j} {w}
api_key = {SECRET} {w}
secret: "{SECRET}"
{w} {w} {n} {w} {w} {w}
{W} {w} {n}. {W} {w}
{n}. {W} {w} {w}
{n}.{n}. {W} {w} {w}
{n}) {w} {w} {w}
{w} {w} {year} {w} {w}
{w} {year}, {w} {year}-{year} {w}
{w} {date} {w} {w}
{date} {time} {w}
{w} {n} {n} {n} {w}
{w} | {n} | {n} | {w}
| {w} | {n}.{n} | {W} |
{w} {price} {w} {w} {price}
{w} {n}% {w} {w} {n},{n} {w}
{w} {version} {w} v{version} {w}
{w}{j} {n}{j} {w}{j}
{w} {w}{n} {w} {W}{n} {w}
{w} = {n} + {n}; {w}[{n}] = {n}
{w} token {w} {w} password {w}
{w} {w} name {w} {w} phone {w}
{W} {w} call {w} {w} {W} {w}
the name is {w} {w} {w}
{w} {w}: {W} {w} {w} {n}
{w} mr {w} {w} dr {w} {w}
{w} at {w} dot {w} {w}
{w} {long} {w} {w}
{w}@{w} {w} @{w} {w}
{w} {w} {unchecked} {w} {w}
{W} {w} {unchecked}, {w}
{w}{j} {unchecked}{j} {w}
under the {W} {W}, Version {n}.{n}
under the {W} {W} {W}, either version {n}
the {W} {W} {W} {n} {w}
copyright (c) {year} {W} {W}
{W} {W} {n} {w} {W} {W} {year}
this is the {W} {W} of {w} {n}
{w} of the {w} at this {w} {w} {CARD} {w} the {w} of
{w} the {w} and {w} at {w} {CARD} to {w} and the
{w} that {w} from the {IP} by {w} at {w}
"""

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_SLOT = re.compile(r"\{(\w+)\}")
_SPACE = re.compile(r"\s")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match that starts inside a run of digits could start at the run's first digit too.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NAMED = re.compile(r"\b(?:name|mr|mrs|dr|contact|appelle|llamo)\b[^\n]{0,8}$", re.IGNORECASE)
_AT, _DOT = (rf"\s?(?:{sign}|[(\[{{]\s?{word}\s?[)\]}}]|(?<=\s){word}(?=\s))\s?" for sign, word in (("@", "at"), (r"\.", "dot")))
_FORMS = {
    "email": re.compile(rf"[\w.%+-]+?{_AT}[\w-]+(?:{_DOT}[\w-]+)+", re.IGNORECASE),
    "ip": re.compile(r"[0-9a-fA-F:]*:[0-9a-fA-F]*:[0-9a-fA-F:.]*"),
    "id": re.compile(r"(?=(?:\D*\d){9})[A-Z0-9][A-Z0-9 -]+"),
    "secret": re.compile(r"\S{8,}"),
}

Span = tuple[str, int, int]


class Labelled(NamedTuple):
    """A text and its spans."""

    text: str
    spans: tuple[Span, ...]


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    doubled = [int(d) for d in digits[-2::-2]]
    plain = [int(d) for d in digits[-1::-2]]
    return (sum(plain) + sum(2 * d - 9 * (d > 4) for d in doubled)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns by kind, then start."""
    found: list[Span] = []
    done = 0
    if "@" in text:
        for match in _DOMAIN.finditer(text):
            low = match.start()
            while low > done and text[low - 1] in _LOCAL:
                low -= 1
            if low < match.start():
                done = match.end()
                found.append(("email", low, done))
    if not _DIGIT.search(text):
        return found
    for match in _IP.finditer(text):
        if all(len(part.lstrip("0")) < 4 and int(part) < 256 for part in match[0].split(".")):
            found.append(("ip", *match.span()))
    for kind, pattern in (("card", _CARD), ("phone", _PHONE)):
        for match in pattern.finditer(text):
            digits = "".join(_DIGIT.findall(match[0])) if len(match[0]) < 100 or kind == "phone" else ""
            if 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15:
                found.append((kind, *match.span()))
    return found


# ---------------------------------------------------------------------------------------------
# The labelled table


def _drawn(draw: random.Random, slot: str) -> str:
    """A value for a slot of a sample line."""

    def digits(n: int) -> str:
        return "".join(draw.choices("0123456789", k=n))

    def hexadecimal(n: int) -> str:
        return "".join(draw.choices("0123456789abcdef", k=n))

    def word(least: int = 1) -> str:
        parts = ("an", "be", "ción", "de", "ell", "er", "ge", "in", "lo", "mé", "no", "ou", "ra", "st", "ti", "zü")
        return "".join(draw.choices(parts, k=draw.randint(least, 4)))

    def checked(n: int) -> str:
        body = digits(n - 1)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def fours(text: str, gap: str) -> str:
        return gap.join(text[i : i + 4] for i in range(0, len(text), 4))

    a, b, c, n = digits(3), digits(3), digits(4), str(draw.randint(0, 10 ** draw.randint(1, 4)))
    host, end = draw.choice(("mail", "example", word())) + draw.choice(("", digits(1))), draw.choice(
        ("com", "org", "net", "de", "fr", "es")
    )
    user = draw.choice((word(), f"{word()}.{word()}", f"{word()}.{digits(2)}", f"{word()}_{digits(2)}"))
    at = draw.choice(("(at)", "[at]", "{at}", "at"))
    dot = {"(at)": "(dot)", "[at]": "[dot]", "{at}": "{dot}", "at": "dot"}[at]
    made = {
        "EMAIL": lambda: draw.choice(
            (
                f"{user}@{host}.{end}",
                f"{user}@{host}.example.{end}",
                f"{word()} {at} {host} {dot} {end}",
                f"{user} {at} {host} {dot} {end}",
                f"{word()}ü{word()}@{word()}ö{word()}.{end}",
            )
        ),
        "IP": lambda: draw.choice(
            (
                ".".join(str(draw.randint(0, 255)) for _ in range(4)),
                ":".join(hexadecimal(4) for _ in range(8)),
                f"{hexadecimal(4)}:{hexadecimal(3)}::{hexadecimal(4)}:{hexadecimal(2)}",
            )
        ),
        "CARD": lambda: draw.choice(
            (checked(16), fours(checked(16), " "), fours(checked(16), "-"), fours(checked(16), "."), checked(15))
        ),
        "PHONE": lambda: draw.choice(
            (
                f"+{draw.randint(1, 99)} ({a}) {b}-{c}",
                f"({a}) {b}-{c}",
                f"{a}-{b}-{c}",
                f"{a}.{b}.{c}",
                f"{a} {b} {c}",
                f"1-{a}-{b}-{c}",
                f"00{draw.randint(30, 49)} {digits(2)} {digits(7)}",
                f"0{digits(2)} {digits(7)}",
                f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}",
                f"+{draw.randint(10, 99)} {a} {b} {c}",
            )
        ),
        "ID": lambda: draw.choice(
            (f"{a}-{digits(2)}-{c}", f"{draw.choice(('DE', 'FR', 'ES'))}{digits(2)} {fours(digits(18), ' ')}")
        ),
        "NAME": lambda: " ".join(word(2).capitalize() for _ in range(draw.randint(1, 3))),
        "SECRET": lambda: draw.choice((hexadecimal(40), hexadecimal(18), hexadecimal(32), word(2) + digits(4))),
        "KEY": lambda: draw.choice(("AKIA", "ASIA"))
        + "".join(draw.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)),
        "w": word,
        "W": lambda: word().capitalize(),
        "j": lambda: draw.choice(("***", "%%%", "###", "$$$", "&&&", "!!", "", ",", ".")),
        "n": lambda: n,
        "year": lambda: str(draw.randint(1800, 2050)),
        "date": lambda: draw.choice(
            (f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(2)}/{digits(2)}/{digits(4)}")
        ),
        "time": lambda: f"{digits(2)}:{digits(2)}:{digits(2)}",
        "price": lambda: f"{draw.choice('$€£')}{draw.randint(1, 999)},{digits(3)}.{digits(2)}",
        "version": lambda: f"{draw.randint(0, 20)}.{draw.randint(0, 20)}.{draw.randint(0, 99)}",
        "long": lambda: digits(draw.randint(6, 12)),
        "unchecked": lambda: next(x for x in iter(lambda: digits(16), "") if not luhn(x)),
    }
    return made[slot]()


def labelled_table(draws: int = DRAWS, seed: int = SEED) -> list[Labelled]:
    """Sample lines, each drawn ``draws`` times; the same for the same seed."""
    draw, rows = random.Random(seed), []
    for line in SAMPLES.strip().splitlines():
        for _ in range(draws):
            text, spans, low = "", [], 0
            for slot in _SLOT.finditer(line):
                text += line[low : slot.start()]
                low, value = slot.end(), _drawn(draw, slot[1])
                if slot[1].isupper() and len(slot[1]) > 1:
                    kind = "secret" if slot[1] == "KEY" else slot[1].lower()
                    spans.append((kind, len(text), len(text) + len(value)))
                text += value
            rows.append(Labelled(text + line[low:], tuple(spans)))
    return rows


def sample_cues() -> frozenset[str]:
    """The words that stand in sample lines themselves, and those of written-out addresses."""
    lines = _SLOT.sub(" ", SAMPLES)
    return frozenset(t.lower() for t in _TOKEN.findall(lines) if t.isalpha()) | {"dot"}


# ---------------------------------------------------------------------------------------------
# Sequences and features


def _shape(token: str) -> str:
    """A token's shape: kinds of characters and, of digits and mixtures, some lengths."""
    if not token[0].isalnum():
        return token
    size = len(token)
    if token.isdigit():
        if 13 <= size < 20:
            return "d13 checked" if token.isascii() and luhn(token) else "d13"
        return f"d{size if size < 6 else 6 if size < 9 else 9 if size < 13 else 20}"
    if token.isalpha():
        if token.islower():
            return "x" if size < 20 else "x+"
        if token.isupper():
            return f"X{min(size, 3)}"
        return "Xx" if token[0].isupper() and token[1:].islower() else "xX"
    kinds = "".join(
        name
        for name, some in (
            ("X", any(c.isupper() for c in token)),
            ("x", any(c.islower() for c in token)),
            ("h", all(c in "0123456789abcdef" for c in token)),
        )
        if some
    )
    return f"m{kinds}{size if size < 5 else 5 if size < 12 else 12 if size < 17 else 17}"


class Reader:
    """Cuts texts into sequences and gives the features of their tokens, by the cues of a labelled table."""

    def __init__(self, cues: frozenset[str]) -> None:
        self.cues = cues
        #: Cue words that begin a sequence by themselves; others only matter beside one.
        starts = sorted(cues & {"name", "mr", "mrs", "dr", "appelle", "llamo", "dot", "password", "token", "secret"})
        bracketed = r"[(\[{]\s?(?i:at)\s?[)\]}]"
        words = "|".join(starts)
        self.salient = re.compile(rf"[0-9]+|@|{bracketed}|(?i:\b(?:{words})\b)" if words else rf"[0-9]+|@|{bracketed}")
        self.ids: dict[tuple, int] = {}
        self.learning = True

    def parts(self, text: str) -> Iterator[tuple[int, int]]:
        """Where the sequences of a text are."""
        low = high = -1
        for match in self.salient.finditer(text):
            if match.end() <= high:
                continue
            start = max(text.rfind("\n", 0, match.start()) + 1 if match.start() else 0, match.start() - REACH)
            if start > high:
                if high >= 0:
                    yield low, high
                while start and start > match.start() - 2 * REACH and not text[start - 1].isspace():
                    start -= 1
                low = max(start, high, 0)
            line = text.find("\n", match.end(), match.end() + REACH)
            high = line if line >= 0 else min(len(text), match.end() + REACH)
            if line < 0:
                space = _SPACE.search(text, high, high + REACH)
                high = space.start() if space else min(len(text), high + REACH)
        if high >= 0:
            yield low, high

    def tokens(self, text: str, low: int, high: int) -> list[tuple[int, int]]:
        return [match.span() for match in _TOKEN.finditer(text, low, high)]

    def features(self, text: str, places: list[tuple[int, int]]) -> np.ndarray:
        """A row of feature numbers for each token; 0 is a feature that no labelled row has."""
        words = [text[a:b] for a, b in places]
        shapes = ["<", "<", "<", *map(_shape, words), ">", ">", ">"]
        known = ["", "", "", *(w if w in self.cues else "" for w in map(str.lower, words)), "", "", ""]
        gaps = [True, *(a > b for (_, b), (a, _) in zip(places, places[1:])), True]
        rows = []
        for n in range(len(words)):
            a, b, c, d, e = shapes[n + 1 : n + 6]
            t, u, v, w, x, y = known[n : n + 6]
            before, after = gaps[n], gaps[n + 1]
            keys = (
                (0, c), (1, b), (2, d), (3, a), (4, e), (5, b, c, before), (6, c, d, after), (7, b, c, d, before, after),
                (8, a, b, c, before), (9, c, d, e, after), (10, w), (11, v, c), (12, u, v, c), (13, t, u, v), (14, x), (15, x, y, c),
                (16, shapes[n], a, b, c), (17, c, d, e, shapes[n + 6]),
            )
            if self.learning:
                rows.append([self.ids.setdefault(key, len(self.ids) + 1) for key in keys])
            else:
                rows.append([self.ids.get(key, 0) for key in keys])
        return np.array(rows, np.int32).reshape(len(rows), 18)


class Model(NamedTuple):
    reader: Reader
    chain: Chain


def fit(rows: Sequence[Labelled] | None = None, cues: frozenset[str] | None = None) -> Model:
    """The field trained on labelled rows; by default on the drawn table."""
    rows = labelled_table() if rows is None else rows
    reader, names = Reader(sample_cues() if cues is None else cues), tags(KINDS)
    sequences, answers = [], []
    for text, spans in rows:
        for low, high in reader.parts(text):
            places = reader.tokens(text, low, high)
            if not places:
                continue
            answer = np.zeros(len(places), np.int64)
            for kind, start, end in spans:
                inside = [n for n, (a, b) in enumerate(places) if a >= start and b <= end]
                answer[inside] = names.index(f"I-{kind}")
                answer[inside[:1]] = names.index(f"B-{kind}")
            sequences.append(reader.features(text, places))
            answers.append(answer)
    reader.learning = False
    chain = Chain(names, len(reader.ids))
    if sequences:
        chain.fit(sequences, answers)
    return Model(reader, chain)


@lru_cache(maxsize=1)
def default_model() -> Model:
    return fit()


# ---------------------------------------------------------------------------------------------
# Spans of documents


def field_spans(model: Model, texts: Sequence[str]) -> list[list[Span]]:
    """Spans the field finds in each text, by start."""
    owners, places, rows = [], [], []
    for number, text in enumerate(texts):
        for low, high in model.reader.parts(text):
            tokens = model.reader.tokens(text, low, high)
            if tokens:
                owners.append(number)
                places.append(tokens)
                rows.append(model.reader.features(text, tokens))
    found: list[list[Span]] = [[] for _ in texts]
    for owner, tokens, answer in zip(owners, places, model.chain.decode(rows)):
        kind, start, end = None, 0, 0
        for tag, (a, b) in zip(answer.tolist(), tokens):
            name = model.chain.names[tag]
            if name[0] == "I":
                end = b
                continue
            if kind:
                found[owner].append((kind, start, end))
            kind, start, end = (name[2:], a, b) if name[0] == "B" else (None, 0, 0)
        if kind:
            found[owner].append((kind, start, end))
    return found


def plausible(kind: str, value: str, before: str = "") -> bool:
    """What a span of a kind must look like whatever the field says; ``before`` is the text in front of it."""
    digits = "".join(_DIGIT.findall(value)) if len(value) < 100 else ""
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "name":
        return all(part[0].isupper() for part in value.split()) and _NAMED.search(before) is not None
    pattern = _FORMS.get(kind)
    return pattern is None or pattern.fullmatch(value) is not None


def added(text: str, base: Sequence[Span], more: Sequence[Span]) -> list[Span]:
    """The field's spans that look like their kind and that the patterns leave to it."""
    placed = {kind: ([], []) for kind in BASE_KINDS}
    for kind, low, high in base:
        placed[kind][0].append(low)
        placed[kind][1].append(high)
    kept = []
    for kind, low, high in more:
        if not plausible(kind, text[low:high], text[max(0, low - 20) : low]):
            continue
        for own, (lows, highs) in placed.items():
            before = bisect_left(lows, high) - 1  # of a kind, the last span that begins before the end
            around = bisect_right(lows, low) - 1
            if before >= 0 and highs[before] > low and (own == kind or around >= 0 and highs[around] >= high):
                break
        else:
            kept.append((kind, low, high))
    return kept


def _spans_of(model: Model, texts: list[str]) -> list[list[tuple[Span, bool]]]:
    """Spans of each text by kind, then start, and whether they are a pattern's."""
    result = []
    for text, more in zip(texts, field_spans(model, texts)):
        base = base_spans(text)
        spans = [(span, True) for span in base] + [(span, False) for span in added(text, base, more)]
        result.append(sorted(spans, key=lambda s: (KINDS.index(s[0][0]), s[0][1], s[0][2])))
    return result


_SPANS = "array<struct<kind string, start int, end int, base boolean>>"
_SPAN_TYPE = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
)


def _grouped(texts: list[str]) -> Iterator[list[str]]:
    """Texts in lists of some ``TEXTS_AT_ONCE`` characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size > TEXTS_AT_ONCE:
            yield held
            held, size = [], 0
    yield held


def marked(spans: list[tuple[Span, bool]], text: str) -> str:
    """The text with each span, or run of overlapping ones, replaced by ``<kind>`` of its first."""
    parts, low = [], 0
    for kind, start, end in sorted((span for span, _ in spans), key=lambda s: (s[1], -s[2])):
        if start >= low:
            parts += [text[low:start], f"<{kind}>"]
        low = max(low, end)
    return "".join([*parts, text[low:]])


def found_in(docs: DataFrame, model: Model | None = None, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``row``, a struct of the kept columns, ``spans`` by kind and start, and ``masked``, the text without them.

    A null text is masked as a null.
    """
    tuned(docs.sparkSession)
    shipped(docs.sparkSession)
    model = model or default_model()
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the labelled table

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts_of(batch)
            texts = [raw.decode(errors="replace") for raw in raw_texts(column)]
            found = [spans for part in _grouped(texts) for spans in _spans_of(held.value, part)]
            cells = [
                [{"kind": k, "start": a, "end": b, "base": base} for (k, a, b), base in spans] for spans in found
            ]
            masked = [
                None if null else marked(spans, text)
                for spans, text, null in zip(found, texts, column.is_null().to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cells, _SPAN_TYPE), pa.array(masked, pa.string())],
                names=["row", "spans", "masked"],
            )

    rows = with_rows(docs, list(keep))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(spans, f"row {kind}, spans {_SPANS}, masked string")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the patterns' spans, and all spans as text."""
    base = "filter(spans, s -> s.base)"
    text = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    return found.selectExpr(
        "row.doc_id",
        *[f"CAST(size(filter(spans, s -> s.base AND s.kind = '{k}')) AS bigint) AS n_{k}" for k in BASE_KINDS],
        f"sha2({text.format(base)}, 256) AS base_sha256",
        f"{text.format('spans')} AS spans",
    )
