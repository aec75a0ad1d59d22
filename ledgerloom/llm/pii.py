r"""Personal data: fixed base patterns, and a semi-Markov conditional random field that adds what they miss.

Method. Around every trigger outside the base spans (a digit, @, an "at" or "dot" in brackets, or " at ... dot ") a window of
text, its ends moved out to white space, is cut into tokens. A candidate segment starts and ends at whole words and is as long
as its entity can be: up to 19 digits with separators between any of them, an address of up to 64 characters before its at
sign and domain labels of up to 63, or a run of key characters. Features describe the whole span (its digit count, checksum,
dotted parts, address shape once undisguised, signs and separators, what stands beside it). The model gives each
(segment, kind) a score linear in these; everything else is outside, one token at a time, at score 0. Dynamic programming over
token ends jointly picks boundaries and kinds. Weights maximise the conditional likelihood (forward-backward over
segmentations) of windows whose labels come from the base patterns, on at most ``SAMPLE`` windows of the corpus, and from a
fixed generator of disguised forms and look-alikes.

Base spans always stay; no window reaches into them. Beside the base kinds the model knows ``secret``: credentials such as
tokens and keys.

Scale. Narrow: one pass over whole texts in Arrow batches, no shuffle; the sample is one bounded top-k. Texts without a
trigger cost one scan. Patterns, windows and decoding take time linear in the text.

Defined results. Null text counts as empty. Spans that start at one place are ordered by kind. Repeated rows are scanned one by
one; an empty table trains on the generator alone and gives no rows. Offsets are code points, end exclusive. Extra columns are
ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the model.
ALL = (*KINDS, "secret")
_ORDER = {k: i for i, k in enumerate(ALL)}
#: Characters kept around a trigger, sampled windows, passes over the training windows.
AROUND, SAMPLE, PASSES = 24, 200, 40

#: The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile("[0-9]")
_DIGITS = re.compile("[0-9]+")
#: The same matches as IP: one that fails at the start of a run of digits fails everywhere in it.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_TRIGGER = re.compile(r"[0-9@]|[\[({<] ?(?:at|dot) ?[\])}>]|(?<= )at(?= \S{1,64} (?:dot |[\[({<] ?dot))", re.IGNORECASE)
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[\W_]")
_AT_SIGN = r"(?: ?(?:[\[({<] ?(?:at|AT|At) ?[\])}>]|@) ?| (?:at|AT|At) )"
_SET_DOT = r"(?: ?[\[({<] ?(?:dot|DOT|Dot|\.) ?[\])}>] ?| \. | (?:dot|DOT|Dot) )"
_AT = re.compile(_AT_SIGN)
_DOT = re.compile(_SET_DOT + r"|(?<=\S)\.(?=\S)")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
#: What a segment can be, from its first character on: a number, an address, a key.
_NUMBER = re.compile(r"[+(]{0,2}[0-9](?:[ ().\-/_\[\]]{0,3}[0-9]){3,18}")
_MAIL = re.compile(rf"[A-Za-z0-9._%+-]{{1,64}}(?:{_SET_DOT}[A-Za-z0-9._%+-]{{1,64}}){{0,8}}{_AT_SIGN}[A-Za-z0-9-]{{1,63}}(?:(?:{_SET_DOT}|\.)[A-Za-z0-9-]{{1,63}}){{1,126}}")
_KEY = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{20,}+(?:\.[A-Za-z0-9+/_\-]{20,}+){0,2}")
_NAMED = re.compile(r"(?i)(?:token|key|secret|passw\w{0,4}|pwd|bearer|credential)\W{0,5}\Z")


_DOUBLED = bytes((2 * d - 9 * (d > 4) + 48) if 0 <= (d := c - 48) <= 9 else c for c in range(256))


def luhn(digits: str) -> bool:
    d = digits.encode()
    return (sum(d[-1::-2]) + sum(d[-2::-2].translate(_DOUBLED)) - 48 * len(d)) % 10 == 0


def octet(digits: str) -> bool:
    """Whether a run of digits, of any length, is at most 255."""
    d = digits.lstrip("0")
    return len(d) < 3 or len(d) == 3 and d <= "255"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost non-overlapping per kind; a match that fails its check is dropped."""
    out = []
    if "@" in text:
        out += [(m.start(), m.end(), "email") for m in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(octet(p) for p in m[0].split("."))] if "." in text else []
        for m in CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], _ORDER[s[2]]))


def _emails(text: str) -> Iterator[re.Match]:
    """EMAIL.finditer, without walking through words that no @ follows."""
    at = 0
    while (i := text.find("@", at)) >= 0:
        low = max(at, i - 1)
        while low > at and text[low - 1] in _LOCAL:
            low -= 1
        m = EMAIL.match(text, low) if low < i and text[low] in _LOCAL else None
        if m:
            yield m
        at = m.end() if m else i + 1


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def windows(text: str, blocked: list[tuple[int, int]] = ()) -> Iterator[tuple[int, int]]:
    """(start, end) of stretches around triggers, ends moved out to white space but not into blocked spans (in order, apart)."""
    edges = [0, *(x for span in blocked for x in span), len(text)]
    for first, last in zip(edges[::2], edges[1::2], strict=True):
        low = high = first
        for m in _TRIGGER.finditer(text, first, last):
            if m.end() + AROUND <= high:
                continue
            a, b = max(high, m.start() - AROUND), min(last, m.end() + AROUND)
            while a > high and not text[a - 1].isspace():
                a -= 1
            while b < last and not text[b].isspace():
                b += 1
            if a > high:  # apart from the window so far
                if low < high:
                    yield low, high
                low = a
            high = b
        if low < high:
            yield low, high


FEATURES = (
    "bias", "address", "at_sign", "letters", "digits_only", "digits<7", "digits 7-9", "digits 10-11", "digits 12-13", "digits 14-19", "digits>19", "card", "long_no_card",
    "dotted", "dotted_wide", "plus", "parenthesis", "groups 2-3", "groups 4+", "grouped_phone", "separators", "other_signs", "space_at_ends", "glued", "in_run",
    "key", "key_hex", "key>=32", "key_cases", "key_named", "spoken",
)
_INDEX = {f: i for i, f in enumerate(FEATURES)}
_GROUPED = re.compile(r"(?:\+?\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]?\d{3,4}")
_MORE = re.compile(r" ?[\[({<] ?(?:at|dot|\.) ?[\])}>]| dot \w|\.\w", re.IGNORECASE)
_QUAD = re.compile(r"\d+(?:(?:\.| \. |\[\.\]|\(\.\))\d+){3}")


def describe(span: str, left: str, right: str) -> tuple[int, ...]:
    """Indices of the features that a whole span has; left are the few characters before it, right those after it."""
    on = ["bias"]
    digits = "".join(re.findall("[0-9]", span))
    n = len(digits)
    if len(span) >= 20 and _KEY.fullmatch(span):
        on.append("key")
        on += ["key_hex"] if re.fullmatch("[0-9a-f]+|[0-9A-F]+", span) else []
        on += ["key>=32"] if len(span) >= 32 else []
        on += ["key_cases"] if re.search("[a-z]", span) and re.search("[A-Z]", span) and n else []
        on += ["key_named"] if _NAMED.search(left) else []
    if n and (re.search(r"[0-9][ .\-/]\Z", left) or re.match(r"[ .\-/][0-9]", right)):
        on.append("in_run")
    left = left[-1:]
    if _ADDRESS.fullmatch(_DOT.sub(".", _AT.sub("@", span, count=1))):
        on.append("address")
        on += ["spoken"] if " at " in span.lower() else []
    if _AT.search(span):
        on.append("at_sign")
    if re.search(r"[^\W\d_]", span):
        on.append("letters")
    elif n == len(span):
        on.append("digits_only")
    on.append("digits<7" if n < 7 else "digits 7-9" if n < 10 else "digits 10-11" if n < 12 else "digits 12-13" if n < 14 else "digits 14-19" if n < 20 else "digits>19")
    plain = not re.search(r"[^0-9 .\-]", span)
    if 14 <= n <= 19:
        on.append("card" if plain and luhn(digits) else "long_no_card")
    if _QUAD.fullmatch(span):
        on.append("dotted" if all(octet(p) for p in re.findall("[0-9]+", span)) else "dotted_wide")
    if span[0] == "+":
        on.append("plus")
    if "(" in span:
        on.append("parenthesis")
    groups = len(re.findall("[0-9]+", span))
    on += ["groups 2-3"] if 2 <= groups <= 3 else ["groups 4+"] if groups > 3 else []
    if 9 <= n <= 15 and _GROUPED.fullmatch(span):
        on.append("grouped_phone")
    rest = re.sub(r"\w", "", span)
    if rest:
        on.append("other_signs" if re.search(r"[^ ().+@\-\[\]]", rest) else "separators")
    if span[0] == " " or span[-1] == " ":
        on.append("space_at_ends")
    if left and left in "-.@#$/:=_%" or right and (right[0] in "-@/_%=" or _MORE.match(right)):
        on.append("glued")
    return tuple(_INDEX[f] for f in on)


class Window:
    """Tokens of a stretch of text and, by end token, its candidate segments (first token, feature indices)."""

    def __init__(self, text: str, start: int, end: int):
        self.tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]
        t = self.tokens
        ends = {b: j for j, (_, b) in enumerate(t)}
        alnum = lambda i: 0 <= i < len(text) and text[i].isalnum()
        self.ends: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in t]
        for i, (a, _) in enumerate(t):
            c = text[a]
            if not (c.isalnum() and not alnum(a - 1) or c in "+("):
                continue
            # Ends at which the segment is a whole number of words and can be one of the entities.
            found = set()
            if m := _NUMBER.match(text, a, end):
                # Seven digits in up to six groups, as in phone numbers, four dotted groups, or the digits of a card however they stand.
                digits, groups = "", 0
                for g in _DIGITS.finditer(text, a, m.end()):
                    digits, groups, b = digits + g[0], groups + 1, g.end()
                    n = len(digits)
                    if (n >= 7 and groups <= 6 or groups == 4 and "." in text[a:b] or 14 <= n <= 19 and luhn(digits)) and not alnum(b):
                        found.add(b)
            if c.isalnum() and (m := _MAIL.match(text, a, end)):
                b = _AT.search(text, a, end).end()
                while b < m.end():
                    b += 1
                    if text[b - 1].isalnum() and not alnum(b):
                        found.add(b)
            if c.isalnum() and (m := _KEY.match(text, a, end)) and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]):
                found.add(m.end())
            for b in sorted(found):
                if b in ends:
                    self.ends[ends[b]].append((i, describe(text[a:b], text[max(0, a - 24) : a], text[b : b + 8])))


def _log_sum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(v - top) for v in x))


class Model:
    def __init__(self, weights: np.ndarray):
        self.w = weights  # kinds x features
        self.cache: dict[tuple[int, ...], list[float]] = {}

    def score(self, on: tuple[int, ...]) -> list[float]:
        s = self.cache.get(on)
        if s is None:
            s = self.cache[on] = self.w[:, list(on)].sum(axis=1).tolist()
        return s

    def decode(self, x: Window) -> list[tuple[int, int, str]]:
        """Best segmentation's spans: token ends in order, each with the candidates that end there."""
        best, back = [0.0], []
        for j, found in enumerate(x.ends):
            top, how = best[j], None
            for i, on in found:
                s = self.score(on)
                if (v := best[i] + max(s)) > top:
                    top, how = v, (i, s.index(max(s)))
            best.append(top)
            back.append(how)
        out, j = [], len(back)
        while j:
            how = back[j - 1]
            if how is None:
                j -= 1
            else:
                i, k = how
                out.append((x.tokens[i][0], x.tokens[j - 1][1], ALL[k]))
                j = i
        return out[::-1]

    def gradient(self, x: Window, gold: dict[tuple[int, int], int]) -> np.ndarray:
        """Of the log-likelihood of gold, (first token, last token) -> kind: what it has less what the model expects."""
        n = len(x.ends)
        before = [0.0]
        for j, found in enumerate(x.ends):
            before.append(_log_sum([before[j], *(before[i] + v for i, on in found for v in self.score(on))]))
        after = [0.0] * (n + 1)
        starts: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(n)]
        for j, found in enumerate(x.ends):
            for i, on in found:
                starts[i].append((j, on))
        for i in range(n - 1, -1, -1):
            after[i] = _log_sum([after[i + 1], *(after[j + 1] + v for j, on in starts[i] for v in self.score(on))])
        g = np.zeros_like(self.w)
        for j, found in enumerate(x.ends):
            for i, on in found:
                p = np.exp(before[i] + np.array(self.score(on)) + after[j + 1] - before[n])
                if (i, j) in gold:
                    p[gold[i, j]] -= 1
                g[:, list(on)] -= p[:, None]
        return g


def _generated(rng: random.Random) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences with base forms, disguised forms and look-alikes, and their spans."""
    word = lambda: "".join(rng.choice(["an", "the", "re", "ou", "in", "er", "st", "on"]) for _ in range(rng.randint(1, 3)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(sep: str) -> str:
        d = "4" + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def email(at: str, dot: str) -> str:
        return f"{word()}{rng.choice(['', '.' + num(2), num(2)])}{at}{word()}{rng.choice(['', num(1)])}{dot}{rng.choice(['com', 'org', 'net', 'example' + dot + 'com'])}"

    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "aB3" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789") for _ in range(n))
    octet = lambda: str(rng.randint(0, 255))
    a, b, c, d = (lambda: num(3)), (lambda: num(3)), (lambda: num(4)), (lambda: rng.choice(["1", "44", "33"]))
    makers = [
        ("email", lambda: email("@", ".")), ("email", lambda: email(" [at] ", " [dot] ")), ("email", lambda: email("(at)", ".")), ("email", lambda: email(" @ ", ".")), ("email", lambda: email("[at]", "[dot]")), ("email", lambda: email(" at ", " dot ")), ("email", lambda: email(" AT ", " DOT ")), ("email", lambda: email(" [At] ", " [Dot] ")), ("email", lambda: email(" (at) ", " (dot) ")),
        ("ip", lambda: ".".join(octet() for _ in range(4))), ("ip", lambda: "[.]".join(octet() for _ in range(4))), ("ip", lambda: "[.]".join(["10", num(1), num(1), num(1)])), ("ip", lambda: "(.)".join(octet() for _ in range(4))), ("ip", lambda: " . ".join(octet() for _ in range(4))), ("ip", lambda: " . ".join(["10", num(1), num(1), num(1)])),
        ("card", lambda: card("")), ("card", lambda: card(" ")), ("card", lambda: card("-")), ("card", lambda: card(".")), ("card", lambda: card("_")), ("card", lambda: "/".join(card(""))), ("card", lambda: " ".join(card(""))),
        ("secret", lambda: f'token = "{key(40)}"'), ("secret", lambda: f"api_key={key(32)}"), ("secret", lambda: f"secret: {mixed(24)}"), ("secret", lambda: f"password: {mixed(28)}"), ("secret", lambda: f"bearer {mixed(20)}.{mixed(40)}.{mixed(30)}"),
        ("phone", lambda: f"+{d()} ({a()}) {b()}-{c()}"), ("phone", lambda: f"({a()}) {b()}-{c()}"), ("phone", lambda: f"{a()}-{b()}-{c()}"), ("phone", lambda: f"+{d()} {a()} {b()} {c()}"), ("phone", lambda: f"{a()}.{b()}.{c()}"), ("phone", lambda: f"{d()}-{a()}-{b()}-{c()}"),
        (None, lambda: str(rng.randint(1900, 2030))), (None, lambda: f"20{num(2)}-0{rng.randint(1, 9)}-1{num(1)}"), (None, lambda: f"{num(1)}.{num(1)}.{num(2)}"), (None, lambda: key(40)), (None, lambda: key(32)), (None, lambda: f"{word()}-{num(4)}-{word()}-{word()}{word()}{word()}"), (None, lambda: f"{word()} at {word()} {word()}"),
        (None, lambda: "9" + num(15) if not luhn("9" + num(15)) else num(12)), (None, lambda: num(6)), (None, lambda: num(11)), (None, lambda: num(10)), (None, lambda: "@" + word()), (None, lambda: f"{num(2)},{num(3)}.{num(2)}"), (None, lambda: f"{num(3)}-{num(4)}"),
        (None, lambda: f"{rng.randint(300, 999)}.{octet()}.{octet()}.{octet()}"), (None, lambda: f"978-3-{num(2)}-{num(6)}-{num(1)}"), (None, lambda: f"1.{num(1)}.{num(1)}.{num(1)}.{num(1)}"), (None, lambda: f"({word()}) {num(3)} {word()}"), (None, lambda: " ".join(num(3) for _ in range(4))),
    ]
    out = []
    for _ in range(8):
        for kind, make in makers:
            x = make()
            left = " ".join(word() for _ in range(rng.randint(0, 3)))
            left += " " if left else ""
            right = rng.choice(["", ".", ",", " "]) + rng.choice(["", " " + word(), "\n" + word()])
            skip = _KEY.search(x).start() if kind == "secret" else 0  # the key alone, not its name
            end = len(x) - (x[-1] == '"')
            out.append((left + x + right, [(len(left) + skip, len(left) + end, kind)] if kind else []))
    return out


def train(samples: list[str], passes: int = PASSES) -> np.ndarray:
    """Weights from base-labelled samples of the corpus and the generator; the same input gives the same weights."""
    examples = _generated(random.Random(7))
    for text in samples:
        spans, free = [], 0
        for s in base_spans(text):
            if s[0] >= free:
                spans.append(s)
                free = s[1]
        examples.append((text, spans))
    made = []
    for text, spans in examples:
        # Ends of a sample can cut a number: what touches them is not learned from.
        x = Window(text, 0, len(text))
        first, last = {a: i for i, (a, _) in enumerate(x.tokens)}, {b: i for i, (_, b) in enumerate(x.tokens)}
        gold = {(first[a], last[b]): _ORDER[k] for a, b, k in spans if a in first and b in last}
        if all(any(i == g[0] for i, _ in x.ends[g[1]]) for g in gold):
            made.append((x, gold))
    model = Model(np.zeros((len(ALL), len(FEATURES))))
    squares = np.full_like(model.w, 1e-6)
    for _ in range(passes):
        g = sum((model.gradient(x, gold) for x, gold in made), -0.05 * model.w)
        squares += g * g
        model = Model(model.w + 1.5 * g / np.sqrt(squares))
    return model.w


def find(text: str, model: Model) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, spans the model adds) of a whole text."""
    base = base_spans(text)
    blocked: list[tuple[int, int]] = []
    for a, b, _ in base:
        if blocked and a < blocked[-1][1]:
            blocked[-1] = blocked[-1][0], max(b, blocked[-1][1])
        else:
            blocked.append((a, b))
    added = []
    for low, high in windows(text, blocked):
        added += model.decode(Window(text, low, high))
    return base, added


def _join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], _ORDER[s[2]])))


def sample(docs: DataFrame, id_col: str, text_col: str, rows: int = SAMPLE) -> list[str]:
    """Stretches of at most 140 characters of the documents with the lowest id hashes, around the first trigger from a hashed place of the text on."""
    text = F.col(f"`{text_col}`").cast("string")
    rest = docs.select(F.xxhash64(F.col(f"`{id_col}`")).alias("h"), text.alias("t")).withColumn("skip", F.expr("pmod(h, greatest(length(t), 1))"))
    later = F.regexp_instr(F.expr("substring(t, skip + 1)"), F.lit("[0-9@]"))
    found = rest.withColumn("later", later).withColumn("at", F.when(F.col("later") > 0, F.col("later") + F.col("skip")).otherwise(F.regexp_instr("t", F.lit("[0-9@]")))).filter("at > 0")
    cut = found.select("h", F.substring("t", F.greatest(F.col("at") - 40, F.lit(1)), F.lit(140)).alias("cut"))
    return [r["cut"] for r in cut.orderBy("h", "cut").limit(rows).collect()]


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added, n_spans."""
    if weights is None:
        weights = train(sample(docs, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType([docs.select(F.col(f"`{id_col}`")).schema[0], *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType()), T.StructField("n_spans", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for b in batches:
            counts = {k: [] for k in KINDS}
            digests, texts, more, every = [], [], [], []
            for t in b.column(1):
                base, added = find(t.as_py() or "", model)
                for k in KINDS:
                    counts[k].append(sum(s[2] == k for s in base))
                digests.append(hashlib.sha256(_join(base).encode()).hexdigest())
                texts.append(_join(base + added))
                more.append(len(added))
                every.append(len(base) + len(added))
            columns = [b.column(0), *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(digests), pa.array(texts), pa.array(more, pa.int64()), pa.array(every, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__ll_text")).mapInArrow(run, schema)
