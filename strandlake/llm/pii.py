"""Personal data: rules for the plain forms, a BiLSTM-CRF for what they miss.

The rules find e-mail and IP addresses, card and phone numbers by fixed patterns,
in one pass that is linear in the text whatever it holds.  A character-level
bidirectional LSTM with CRF transitions, trained on labelled spans, adds spans
that the rules lose: neighbours that run together into one failing match, and
forms without the sign that a pattern asks for.

Every window that holds a digit or an at sign is scored; a span of the four kinds
holds one of them, so no other window could yield any.  Overlapping windows'
emissions are averaged with weights that fall towards a window's ends, and each
stretch of covered text is decoded once as a whole.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, free_name, long_ids, map_texts, small_batches, stored
from .tagger import PAD, Decoder, Tagger, char_ids

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48
#: Windows that are scored at once, at most.
GROUP = 512
#: Windows of background that training uses, at most, and the spans put into them.
BACKGROUND = 1500
EXAMPLES = 1500
STEPS = 260
TRIGGER = re.compile("[0-9@]")

# The characters of the four patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """The check-digit test of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """One at sign after another; what stands left of it goes back to the last match at most."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield "email", start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[Span]:
    """Fours of the numbers in each dotted run, from its left."""
    for run in DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts, start = run.group().split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            length = sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in four):
                yield "ip", start, start + length
            start += length + 1


def _cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            yield "card", m.start(), m.end()


def _phones(text: str) -> Iterator[Span]:
    for m in PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            yield "phone", m.start(), m.end()


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns: by kind, then start; code points, end exclusive."""
    if not TRIGGER.search(text):
        return []
    return [*_emails(text), *_ips(text), *_cards(text), *_phones(text)]


def join_spans(spans: list[Span]) -> str:
    """kind:start:end by kind as listed, then start, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def window_starts(text: str) -> list[int]:
    """Starts of the overlapping windows that hold a digit or an at sign."""
    found: list[int] = []
    for m in TRIGGER.finditer(text):
        last = m.start() // STRIDE * STRIDE
        for start in (last - STRIDE, last) if last else (0,):
            if not found or start > found[-1]:
                found.append(start)
    return found


# Making labelled examples -------------------------------------------------


def _card_number(rng: random.Random) -> str:
    body = rng.choice("3456") + "".join(rng.choice("0123456789") for _ in range(rng.choice((14, 14, 14, 14, 17))))
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


def _make(kind: str, rng: random.Random) -> str:
    letters = lambda a, b: "".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(a, b)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "email":
        local = letters(2, 9) + rng.choice(("", f".{number(2)}", f".{letters(2, 7)}", f"_{number(3)}", number(2), f"+{letters(2, 4)}"))
        domain = rng.choice((f"mail{number(1)}.example", letters(3, 9), f"{letters(2, 5)}-{letters(2, 5)}"))
        return f"{local}@{domain}.{rng.choice(('com', 'org', 'net', 'de', 'fr', 'es', 'co.uk'))}"
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        d = _card_number(rng)
        return rng.choice((d, d, "-".join((d[:4], d[4:8], d[8:12], d[12:])), " ".join((d[:4], d[4:8], d[8:12], d[12:]))))
    area, mid, end = number(3), number(3), number(4)
    return rng.choice((f"+1 ({area}) {mid}-{end}", f"+1 ({area}) {mid}-{end}", f"+1-{area}-{mid}-{end}", f"+1 {area} {mid} {end}", f"({area}) {mid}-{end}", f"+{rng.choice(('44', '49', '33', '34'))} {number(3)} {number(7)}"))


def _decoy(rng: random.Random) -> str:
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    return rng.choice(
        (
            f"password={hexes(18)}",
            f'token = "{hexes(40)}"',
            "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)),
            f"version {rng.randint(1, 9)}.{rng.randint(0, 20)}",
            f"{rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 30)}",
            f"{rng.randint(1900, 2030)}",
            f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1950, 2030)}",
            f"{rng.randint(1, 999)},{rng.randint(100, 999)}",
            f"@{hexes(5)}",
            str(rng.randint(1, 10**7)),
        )
    )


def examples(background: list[str], count: int = EXAMPLES, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows of symbols and tags: background texts with labelled spans and decoys put in."""
    rng = random.Random(seed)
    symbols, gold = np.full((count, WINDOW), PAD), np.zeros((count, WINDOW), np.int64)
    for n in range(count):
        plain = rng.choice(background) if background else "some words that stand around it and go on for a while"
        text, tags = "", []

        def put(part: str, kind: str | None = None) -> None:
            nonlocal text
            text += part
            tags.extend([0] * len(part) if kind is None else [1 + 2 * KINDS.index(kind)] + [2 + 2 * KINDS.index(kind)] * (len(part) - 1))

        at = rng.randint(0, max(0, len(plain) - 10))
        put(plain[at : at + rng.randint(0, 60)])
        for _ in range(rng.choice((0, 1, 1, 1, 2, 2, 3))):
            if text and not text[-1].isspace():
                put(rng.choice((" ", " ", " ", ": ", " (", ", ")))
            if rng.random() < 0.25:
                put(_decoy(rng))
            else:
                kind = rng.choice(KINDS)
                put(_make(kind, rng), kind)
            put(rng.choice((" ", " ", " ", ". ", ", ", " " + plain[: rng.randint(1, 20)] + " ")))
        put(plain[at : at + 80])
        cut = rng.randint(0, max(0, min(len(text) - WINDOW, 40)))
        ids = char_ids(text[cut : cut + WINDOW])
        symbols[n, : len(ids)], gold[n, : len(ids)] = ids, tags[cut : cut + WINDOW]
    return symbols, gold


def train(background: list[str], count: int = EXAMPLES, steps: int = STEPS, seed: int = 3) -> Tagger:
    """A tagger fitted on examples made from background texts."""
    model = Tagger(1 + 2 * len(KINDS))
    model.train(*examples(background, count, seed), steps=steps)
    return model


def background_windows(docs: DataFrame, limit: int = BACKGROUND) -> list[str]:
    """Stretches of the documents without a digit or at sign, for training; of each text one is offered."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                middle = (text or "")[len(text or "") // 2 :][:200]
                if middle and not TRIGGER.search(middle):
                    out.append(middle)
            yield pa.RecordBatch.from_pydict({"part": pa.array(out, pa.string())})

    found = stored(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "part string"), "background")
    return [r[0] for r in bounded_sample(found, ["part"], limit).collect()]


# Finding -------------------------------------------------------------------


def _valid(kind: str, text: str) -> bool:
    digits = _digits(text)
    if kind == "email":
        return re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@.]+", text) is not None
    if kind == "ip":
        return re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", text) is not None and all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9 .-]+", text) is not None
    return 8 <= len(digits) <= 15 and re.fullmatch(r"[+(]?[0-9][0-9 ().+-]*[0-9]", text) is not None and not re.search(r"[0-9]{12}", text) and (text[0] in "+(" or re.search(r"[ ().-]", text) is not None)


def _read(text: str, start: int, tags: np.ndarray) -> Iterator[Span]:
    """Spans of a decoded stretch, trimmed of space and closing marks."""
    at = 0
    while at < len(tags):
        tag = int(tags[at])
        end = at + 1
        if tag:
            kind = (tag - 1) // 2
            while end < len(tags) and tags[end] == 2 + 2 * kind:
                end += 1
            a, b = start + at, start + end
            while b > a and text[b - 1] in " \t\n.,;:-(":
                b -= 1
            while b > a and text[a] in " \t\n.,;:-)":
                a += 1
            whole = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
            if b > a and whole and _valid(KINDS[kind], text[a:b]):
                yield KINDS[kind], a, b
        at = end


def stretches(starts: list[int]) -> Iterator[list[int]]:
    """The starts of windows cut where two do not overlap."""
    begin = 0
    for i in range(1, len(starts) + 1):
        if i == len(starts) or starts[i] - starts[i - 1] >= WINDOW:
            yield starts[begin:i]
            begin = i


FALL = (np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1.0)[:, None]


class Blend:
    """Weighted means of overlapping windows' emissions, handed on as soon as no later window reaches them."""

    def __init__(self, tags: int, low: int, end: int):
        self.low, self.end = low, end
        self.total, self.weight = np.zeros((0, tags)), np.zeros((0, 1))

    def add(self, starts: list[int], scores: np.ndarray, until: int) -> np.ndarray:
        """Take the windows in order; the means before ``until`` are returned and let go."""
        more = min(self.end, starts[-1] + WINDOW) - self.low - len(self.total)
        self.total = np.concatenate((self.total, np.zeros((more, self.total.shape[1]))))
        self.weight = np.concatenate((self.weight, np.zeros((more, 1))))
        for s, e in zip(starts, scores):
            k = min(WINDOW, self.end - s)
            self.total[s - self.low : s - self.low + k] += (e * FALL)[:k]
            self.weight[s - self.low : s - self.low + k] += FALL[:k]
        ready = min(until, self.end) - self.low
        means = self.total[:ready] / self.weight[:ready]
        self.total, self.weight, self.low = self.total[ready:], self.weight[ready:], self.low + ready
        return means


def find(texts: list[str], model: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """For each whole text: the spans of the fixed patterns, and those that the model adds.

    An added span never overlaps one of the fixed patterns.  Windows are scored
    ``GROUP`` at a time, those of short stretches together; a longer stretch goes
    through blending and decoding part by part.
    """
    added: list[list[Span]] = [[] for _ in texts]

    def emissions(where: list[tuple[int, int]]) -> np.ndarray:
        ids = np.full((len(where), WINDOW), PAD)
        for i, (n, s) in enumerate(where):
            found = char_ids(texts[n][s : s + WINDOW])
            ids[i, : len(found)] = found
        return model.emissions(ids)[0]

    def decoded(group: list[tuple[int, list[int]]]) -> None:
        scores, at = emissions([(n, s) for n, part in group for s in part]), 0
        for n, part in group:
            whole = Blend(model.tags, part[0], len(texts[n])).add(part, scores[at : at + len(part)], len(texts[n]) + WINDOW)
            added[n] += _read(texts[n], part[0], model.best_path(whole))
            at += len(part)

    group: list[tuple[int, list[int]]] = []
    for n, text in enumerate(texts):
        for part in stretches(window_starts(text)):
            if len(part) > GROUP:
                blend, decoder = Blend(model.tags, part[0], len(text)), Decoder(model)
                for at in range(0, len(part), GROUP):
                    some, after = part[at : at + GROUP], part[at + GROUP : at + GROUP + 1]
                    decoder.push(blend.add(some, emissions([(n, s) for s in some]), after[0] if after else len(text)))
                added[n] += _read(text, part[0], decoder.path())
                continue
            if sum(len(p) for _, p in group) + len(part) > GROUP:
                decoded(group)
                group = []
            group.append((n, part))
    if group:
        decoded(group)
    out = []
    for text, more in zip(texts, added):
        base = base_spans(text)
        ends = sorted((a, b) for _, a, b in base)
        out.append((base, [x for x in more if not any(x[1] < b and a < x[2] for a, b in ends)] if more else more))
    return out


SPANS = "base array<struct<kind:string,start:int,stop:int>>, added array<struct<kind:string,start:int,stop:int>>"


def _structs(spans: list[Span]) -> list[dict]:
    return [{"kind": k, "start": a, "stop": b} for k, a, b in spans]


def personal_data(docs: DataFrame, model: Tagger | None = None, derive=None, schema: str = SPANS) -> DataFrame:
    """(doc_id, base, added) for each row of ``docs`` (doc_id, text, and any others).

    ``derive(base, added)`` returns other columns in the order of ``schema``.
    A null text counts as empty, which has no spans.  Repeated rows each get a
    row; an empty table gives none.
    """
    model = model or train(background_windows(docs))
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    made = derive or (lambda base, added: (_structs(base), _structs(added)))
    return map_texts(long_ids(docs), lambda texts: list(zip(*[made(*found) for found in find(texts, broadcast.value)])), schema)


def digests(base: list[Span], added: list[Span]) -> tuple:
    """Counts of the base spans by kind, SHA-256 of their list, and the list of all spans."""
    import hashlib

    counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
    return (*counts, hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans([*base, *added]), len(added))


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each stretch of spans replaced by its first kind in brackets."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redacted(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, all other columns as they are; nulls stay null."""
    model = model or train(background_windows(docs))
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str]) -> list[list]:
        return [[redact(t, base + added) for t, (base, added) in zip(texts, find(texts, broadcast.value))]]

    columns, name = docs.columns, free_name(docs.columns, "redacted")
    done = map_texts(docs, work, f"{name} string", keep=columns)
    return done.select(*[F.when(F.col("text").isNotNull(), F.col(name)).alias("text") if c == "text" else F.col(f"`{c}`") for c in columns])
