"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

The field segments a text into spans of a kind and characters outside. Its segments are the candidates of SHAPES: numbers
of 7 to 19 digits or four groups joined by points, addresses written out or set apart (name at host dot com), runs of
letters, digits and signs that hold both letters and digits, and whatever a word like password or key introduces. A
segment scores by features of the whole span and its neighbours; a transition scores each change between outside and a
kind, and between two kinds that only a few separators part. Segments are bounded (GROUPS groups, PARTS parts of a host,
TOKENS runs of a key), so that the dynamic programme is linear in the text: boundaries and kinds are chosen together, and
where no candidate stands the field is outside. Its weights maximise the conditional likelihood of made-up sentences with
known spans, by gradients from forward and backward sums. Base spans are fixed; the field adds spans that meet none of them.

Defined cases: null and empty texts have no spans; offsets are code points, ends exclusive; long texts are scanned
whole; repeated rows are each scanned; an empty table gives an empty table; other columns pass through, save those named
as a result column.
"""

import math
import re
from bisect import bisect_right
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, REST, TEXT, ddl, pack, unpack

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: Bounds of a segment: groups of digits in a number, parts of a host after its first, boundaries within a run.
GROUPS, PARTS, TOKENS = 8, 4, 8
#: Digits of a number that may be a segment.
DIGITS = (7, 19)
#: Separators over which two spans stand next to each other, and how many.
NEXT, APART = " ,;:/|\t\n", 3
#: Names of the weights of transitions, beside those of features: into a kind, out of it, and from kind to kind.
INTO, OUT = "into", "out"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HELD = re.compile(r"[0-9@]|\b[aA][tT]\b|[kKdDtTrR][eEnNwW][yYtTdDrRnN]")
_GROUP = re.compile(r"[0-9]+")
_BETWEEN = re.compile(r"[ ().-]{1,3}")
_MARK = re.compile(r"\s?(?:[(\[]\s?at\s?[)\]]|@|\bat\b)\s?", re.I)
_PART = re.compile(r"\s?(?:\.|\(dot\)|\[dot\]|\bdot\b)\s?[A-Za-z0-9-]+", re.I)
_HOST = re.compile(r"[A-Za-z0-9-]+")
_RUN = re.compile(r"[A-Za-z0-9_+/=.-]{12,}")
#: Words that introduce a secret, and other words before a span that tell of its kind.
_CUE = re.compile(r"\b(password|passwd|pwd|token|secret|(?:api[ _-]?)?key|bearer)\b(?P<mark>\s*(?:is\b|[:=])\s*|\s+)[\"']?(?=[^\s\"']{4})", re.I)
CUES = ("password", "passwd", "pwd", "token", "secret", "key", "apikey", "api", "bearer", "tel", "phone", "call", "fax", "mobile", "card", "visa", "ip", "host", "mail", "email", "write", "version", "page", "year", "total")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind in the order of BASE, then start."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def _numbers(text: str) -> list[tuple[int, int]]:
    """Spans from a group of digits to another, with the signs that open the first."""
    groups = [m.span() for m in _GROUP.finditer(text)]
    out = []
    for i, (a, b) in enumerate(groups):
        start = a
        while start and a - start < 2 and text[start - 1] in "+(":
            start -= 1
        digits, quad, at = 0, True, i
        for j in range(i, min(len(groups), i + GROUPS)):
            c, d = groups[j]
            if j > i:
                gap = text[groups[j - 1][1] : c]
                if not _BETWEEN.fullmatch(gap):
                    break
                quad = quad and gap == "."
            digits += d - c
            if digits > DIGITS[1]:
                break
            if digits >= DIGITS[0] or quad and j - i == 3:
                out.append((start, d))
    return out


def _addresses(text: str) -> list[tuple[int, int]]:
    """Spans from a name before a mark to each part of the host behind it."""
    out = []
    for m in _MARK.finditer(text):
        host = _HOST.match(text, m.end())
        if not host:
            continue
        start = m.start()
        while start and (text[start - 1].isalnum() or text[start - 1] in "_.%+-"):
            start -= 1
        while start < m.start() and text[start] in ".-%+":
            start += 1
        if start == m.start():
            continue
        end = host.end()
        for _ in range(PARTS):
            if not (part := _PART.match(text, end)):
                break
            end = part.end()
            out.append((start, end))
    return out


def _runs(text: str) -> list[tuple[int, int]]:
    """Spans within a run of letters, digits and signs that hold both letters and digits, and what a cue introduces."""
    out = []
    for m in _RUN.finditer(text):
        run = m[0]
        if any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
            a, b = m.span()
            cuts = [a, *[a + k + 1 for k, c in enumerate(run) if c == "=" and run[k + 1 : k + 2] not in ("", "=")][:TOKENS]]
            out += [(c, e) for c in cuts for e in {b, a + len(run.rstrip(".")), a + len(run.rstrip("=."))} if e - c >= 12]
    for m in _CUE.finditer(text):
        a = b = m.end()
        while b < len(text) and not text[b].isspace() and text[b] not in "\"'<>|":
            b += 1
        out += [(a, e) for e in {b, a + len(text[a:b].rstrip(".,;:!?)*#&$%"))} if e - a >= 4]
    return out


def candidates(text: str, fixed: list[tuple[str, int, int]] = ()) -> list[tuple[int, int]]:
    """The segments that may have a kind, by start and end, without those that meet a fixed span."""
    if not _HELD.search(text):
        return []
    found = sorted({*_numbers(text), *_addresses(text), *_runs(text)})
    if not fixed:
        return found
    taken: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in fixed):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    starts = [a for a, _ in taken]
    free = lambda a, b: (k := bisect_right(starts, b - 1)) == 0 or taken[k - 1][1] <= a
    return [(a, b) for a, b in found if free(a, b)]


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return next((i for i, e in enumerate(edges) if n <= e), len(edges))


_DIGITS, _LENGTHS = (0, 3, 6, 8, 11, 12, 15, 16, 19, 24), (3, 6, 9, 14, 19, 24, 39)
_AT = re.compile(r"[\w.%+-]+\s?(?:@|[(\[]\s?at\s?[)\]]|\bat\b)\s?[\w-]+(?:\s?(?:\.|\(dot\)|\[dot\]|\bdot\b)\s?[\w-]+)+", re.I)
_NUMBER = re.compile(r"[+(]{0,2}[0-9][0-9 ().-]*[0-9]")
_BLEND = re.compile(r"[A-Za-z0-9_+/=.-]+")
_WORD = re.compile(r"[A-Za-z]+")


def cue_features(text: str, a: int) -> list[str]:
    """The last telling word before a place, and what stands between."""
    words = _WORD.findall(text, max(0, a - 40), a)[-6:]
    cue = next((w.lower() for w in reversed(words) if w.lower() in CUES), None)
    if not cue:
        return []
    near = text[max(0, a - 4) : a]
    return [f"cue:{cue}", "set" if ":" in near or "=" in near else "quoted" if near[-1:] in ("\"", "'") else "after"]


def span_features(text: str, a: int, b: int, cue: list[str] | None = None) -> list[str]:
    """What a whole span shows, by itself and by its neighbours; cue holds the features of its start, if they are known."""
    span = text[a:b]
    digits = sum(c.isdigit() for c in span)
    out = ["bias", f"digits{_bucket(digits, _DIGITS)}", f"length{_bucket(b - a, _LENGTHS)}"]
    before, after = text[a - 1] if a else " ", text[b] if b < len(text) else " "
    out.append("cut" if before.isalnum() or after.isalnum() or before in "@+" or after == "@" else "clean")
    if after == "=":
        out.append("padding")
    if before in ".-/" or after in "-/" or after in ":." and b + 1 < len(text) and text[b + 1].isalnum():
        out.append("joined")
    if _AT.fullmatch(span):
        out.append("mail")
        if "@" not in span:  # prose has such words too: met at home. Then
            out += ["spelt" if re.search(r"[(\[]\s?(?:at|dot)\s?[)\]]|\bdot\b", span, re.I) else "prose", "spaced" if re.search(r"\s\.|\.\s", span) else "tight"]
        if _PART.match(text, b):
            out.append("more")
    elif _NUMBER.fullmatch(span):
        groups = _GROUP.findall(span)
        quad = span.count(".") == 3 and len(groups) == 4
        out += ["number", f"groups{min(len(groups), 6)}", "first" + (span[0] if span[0] in "+(" else "9")]
        if quad:
            out.append("quad" if all(len(g) < 4 and int(g) <= 255 for g in groups) else "badquad")
        elif 13 <= digits <= 19:
            out.append("luhn" if luhn("".join(groups)) else "noluhn")
        if len(groups) >= 3 and len(groups[-1]) == 4 and len(groups[-2]) == 3:
            out.append("dialled")
    elif _BLEND.fullmatch(span) and digits and _WORD.search(span):
        out.append("hex" if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", span) else "upper" if span.upper() == span else "mixed")
        out.append(f"blend{min(digits * 5 // (b - a), 4)}")
        longest = max(map(len, _WORD.findall(span)))
        out.append(f"wordy{_bucket(longest * 10 // (b - a), (3, 5, 7))}")
    else:
        out += ["other", "signs" if any(not c.isalnum() for c in span) else "digits" if digits else "letters"]
    return out + (cue_features(text, a) if cue is None else cue)


def _exits(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """For each span the end of the separators behind it: a span that starts up to there is its neighbour."""
    out = []
    for _, b in spans:
        e = b
        while e < len(text) and e - b < APART and text[e] in NEXT:
            e += 1
        out.append(e)
    return out


def _scores(text: str, spans, weights) -> list[list[float]]:
    out, start, cue = [], None, []
    for a, b in spans:
        if a != start:
            start, cue = a, cue_features(text, a)
        sums = [0.0] * len(KINDS)
        for f in span_features(text, a, b, cue):
            if w := weights.get(f):
                sums = [x + y for x, y in zip(sums, w)]
        out.append(sums)
    return out


def _transitions(weights):
    none = [0.0] * len(KINDS)
    return weights.get(INTO, none), weights.get(OUT, none), [weights.get(f"from:{k}", none) for k in KINDS]


def segment(text: str, weights: dict[str, list[float]], fixed: list[tuple[str, int, int]] = ()) -> list[tuple[str, int, int]]:
    """The best spans of a text that meet no fixed span: a dynamic programme over the candidates by start.

    best[c][k] is the best total of a segmentation that ends with candidate c as kind k. Before c stands either a neighbour,
    found by its end, or the outside, whose best total so far a pointer carries over the candidates by their exits."""
    spans = candidates(text, fixed)
    if not spans:
        return []
    scores, exits, kinds = _scores(text, spans, weights), _exits(text, spans), range(len(KINDS))
    into, out, between = _transitions(weights)
    by_exit, by_end = sorted(range(len(spans)), key=exits.__getitem__), {}
    best, back = [None] * len(spans), [None] * len(spans)
    outside, outside_back, at = 0.0, None, 0

    def leave(c):
        k = max(kinds, key=lambda k: best[c][k] + out[k])
        return best[c][k] + out[k], (c, k)

    for c, (a, b) in enumerate(spans):
        while at < len(by_exit) and exits[by_exit[at]] < a:
            total, step = leave(by_exit[at])
            if total > outside:
                outside, outside_back = total, step
            at += 1
        row, steps = [outside + into[k] for k in kinds], [outside_back] * len(KINDS)
        for end in range(a - APART, a + 1):
            for p in by_end.get(end, ()):
                if exits[p] >= a:
                    for k in kinds:
                        for j in kinds:
                            if (total := best[p][j] + between[j][k]) > row[k]:
                                row[k], steps[k] = total, (p, j)
        best[c], back[c] = [x + s for x, s in zip(row, scores[c])], steps
        by_end.setdefault(b, []).append(c)
    for c in by_exit[at:]:
        total, step = leave(c)
        if total > outside:
            outside, outside_back = total, step
    found, step = [], outside_back
    while step:
        c, k = step
        found.append((KINDS[k], *spans[c]))
        step = back[c][k]
    return found[::-1]


def _log_sum(values):
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if top > -math.inf else top


class Chart:
    """Forward and backward sums over the segmentations of a text."""

    def __init__(self, text: str, weights, features=None):
        import numpy as np

        self.spans = candidates(text)
        n, m = len(self.spans), len(KINDS)
        self.features = features if features is not None else [span_features(text, a, b) for a, b in self.spans]
        zero = np.zeros(m)
        self.score = np.array([sum((np.asarray(weights[f]) for f in fs if f in weights), zero) for fs in self.features]).reshape(n, m)
        into, out, between = (np.asarray(x, float) for x in _transitions(weights))
        exits = _exits(text, self.spans)
        # which candidates may follow which, next to it or over the outside
        self.near = np.array([[p[1] <= q[0] <= e for q in self.spans] for p, e in zip(self.spans, exits)], bool).reshape(n, n)
        self.far = np.array([[e < q[0] for q in self.spans] for e in exits], bool).reshape(n, n)
        sums = lambda values: np.logaddexp.reduce(values) if len(values) else -np.inf
        self.alpha, self.before = np.zeros((n, m)), np.zeros(n)
        for c in range(n):
            self.before[c] = sums(np.append((self.alpha[self.far[:, c]] + out).ravel(), 0.0))
            rows = [self.before[c] + into]
            if self.near[:, c].any():
                rows.append(np.logaddexp.reduce((self.alpha[self.near[:, c]][:, :, None] + between).reshape(-1, m), axis=0))
            self.alpha[c] = self.score[c] + np.logaddexp.reduce(rows, axis=0)
        self.total = sums(np.append((self.alpha + out).ravel(), 0.0))
        self.beta, self.behind = np.zeros((n, m)), np.zeros(n)
        for c in reversed(range(n)):
            tail = self.score + self.beta
            self.behind[c] = sums(np.append((tail[self.far[c]] + into).ravel(), 0.0))
            rows = [self.behind[c] + out]
            if self.near[c].any():
                rows.append(np.logaddexp.reduce((between[None] + tail[self.near[c]][:, None, :]).transpose(0, 2, 1).reshape(-1, m), axis=0))
            self.beta[c] = np.logaddexp.reduce(rows, axis=0)
        self.shares = np.exp(self.alpha + self.beta - self.total)
        self.entered = np.exp(self.before[:, None] + into + self.score + self.beta - self.total)
        self.left = np.exp(self.alpha + out + self.behind[:, None] - self.total)
        i, j = np.nonzero(self.near)
        self.pairs = np.exp(self.alpha[i][:, :, None] + between[None] + (self.score + self.beta)[j][:, None, :] - self.total).sum(axis=0) if len(i) else np.zeros((m, m))


def probabilities(text: str, weights: dict[str, list[float]]) -> dict[tuple[str, int, int], float]:
    """The share of all segmentations, by their weight, that hold each span."""
    chart = Chart(text, weights)
    return {(kind, *span): float(chart.shares[c, k]) for c, span in enumerate(chart.spans) for k, kind in enumerate(KINDS)}


def find_spans(text: str | None, weights: dict[str, list[float]]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans, each by kind, then start."""
    if not text or not _HELD.search(text):
        return [], []
    base = base_spans(text)
    added = segment(text, weights, base)
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _made_up(rng) -> tuple[str, list[tuple[str, int, int]]]:
    """A sentence and its true spans."""
    digit = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters + "éü") for _ in range(rng.randrange(2, 10)))
    plain_word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 9)))
    pick = rng.choice
    of = lambda alphabet, n: "".join(pick(alphabet) for _ in range(n))

    def card():
        n = digit(15)
        n = next(n + str(c) for c in range(10) if luhn(n + str(c)))
        return pick([n, f"{n[:4]} {n[4:8]} {n[8:12]} {n[12:]}", "-".join((n[:4], n[4:8], n[8:12], n[12:]))])

    name = lambda: f"{plain_word()}{pick(['.', '_', '', '-'])}{pick([plain_word(), digit(2)])}"
    host = lambda: f"{plain_word()}{pick(['', '', digit(1)])}"

    def email():
        mark, dot = pick([("@", "."), (" at ", " dot "), ("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" @ ", " . "), ("(at)", "(dot)")])
        return name() + mark + host() + "".join(dot + p for p in pick([["com"], ["org"], ["example", "net"], ["co", "uk"]]))

    def secret():
        kind = rng.randrange(6)
        if kind == 0:
            return of("0123456789abcdef", pick([18, 32, 40, 64])), False
        if kind == 1:
            return pick(["AKIA" + of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "sk-" + of("ABCDEFGHabcdefgh0123456789", 32), "ghp_" + of(letters + "ABCDEF0123456789", 36)]), False
        if kind == 2:
            return of(letters + letters.upper() + "0123456789+/", pick([24, 32, 44])) + pick(["", "=", "=="]), False
        if kind == 3:
            return of(letters, rng.randrange(8, 20)), True
        if kind == 4:
            return of(letters + "!?#$%&*", rng.randrange(8, 14)) + pick("abc"), True
        return of(letters + "0123456789", rng.randrange(8, 16)), True

    makers = {
        "email": email,
        "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        "card": card,
        "phone": lambda: pick([f"+{digit(1)} ({digit(3)}) {digit(3)}-{digit(4)}", f"({digit(3)}) {digit(3)}-{digit(4)}", f"{digit(3)}-{digit(3)}-{digit(4)}", f"{digit(3)}.{digit(3)}.{digit(4)}", f"+{digit(2)} {digit(3)} {digit(7)}"]),
    }
    plain = [
        lambda: digit(rng.randrange(1, 6)), lambda: f"{digit(1)}.{digit(1)}", lambda: f"version {digit(1)}.{digit(1)}.{digit(2)}", lambda: f"20{digit(2)}-0{digit(1)}-1{digit(1)}", lambda: digit(rng.randrange(7, 13)),
        lambda: f"{digit(2)}:{digit(2)}", lambda: f"@{word()}", lambda: word() + digit(1), lambda: f"{digit(1)},{digit(3)},{digit(3)}", lambda: f"{digit(1)}.{digit(1)}.{digit(1)}.{digit(1)}.{digit(1)}", lambda: f"{digit(2)}.{digit(2)}",
        lambda: f"{word()} at {word()}. {word()}", lambda: f"{word()} at {word()}.{word()}", lambda: f"{digit(4)} {digit(4)} {digit(3)}", lambda: f"the key {plain_word()} of {plain_word()}", lambda: f"a secret {plain_word()}", lambda: f"key {plain_word()}{plain_word()}",
        lambda: f"token {plain_word()}", lambda: f"password {pick(['is', 'was', 'rules', 'change', 'reset'])} {plain_word()}", lambda: f"20{digit(2)}/0{digit(1)}/1{digit(1)} {digit(2)}:{digit(2)}:{digit(2)}", lambda: f"{plain_word()}-{plain_word()}-{plain_word()}-{digit(2)}",
        lambda: f"www.{plain_word()}.com/{plain_word()}/{digit(4)}", lambda: f"{plain_word()}_{plain_word()}_{digit(1)}.{plain_word()}", lambda: f"{digit(4)} {digit(4)} {digit(4)} {digit(4)} {digit(4)}",
    ]
    cues = {"phone": ["call ", "tel "], "card": ["card ", ""], "ip": ["host ", ""], "email": ["mail ", "write to ", ""]}
    text, spans = "", []
    for _ in range(rng.randrange(2, 5)):
        text += " ".join(word() for _ in range(rng.randrange(1, 5))) + pick([" ", ", ", ". ", "\n"])
        if rng.random() < 0.6:
            for _ in range(pick([1, 1, 1, 2])):  # two in a row now and then
                kind, quote = pick(KINDS), ""
                if kind == "secret":
                    made, needs = secret()
                    if needs or rng.random() < 0.7:
                        text += pick(["password", "passwd", "token", "secret", "key", "api_key", "Password", "TOKEN"]) + pick(["=", " = ", ": ", " = ", ":"])
                        quote = pick(["", "", "\"", "'"])
                        text += quote
                else:
                    text += pick([*cues[kind], "", "", ""])
                    made = makers[kind]()
                spans.append((kind, len(text), len(text) + len(made)))
                text += made + quote + pick([" ", ", ", "; ", " ", "\n"] if not quote else [" ", "\n"])
        else:
            text += pick(plain)() + pick([" ", ". ", ", "])
    return text, spans


@lru_cache
def train(sentences: int = 900, rounds: int = 6, seed: int = 7, rate: float = 0.3, decay: float = 1e-3) -> dict[str, list[float]]:
    """Weights by feature and transition, one for each kind: adaptive gradient steps on the conditional log-likelihood of
    made-up sentences, less decay times half the squared weights."""
    import random

    import numpy as np

    rng = random.Random(seed)
    data = []
    for _ in range(sentences):
        text, spans = _made_up(rng)
        held = candidates(text)
        place = {s: c for c, s in enumerate(held)}
        truth = [(place[s], KINDS.index(k)) for k, *s in [(k, a, b) for k, a, b in spans] for s in [tuple(s)] if s in place]
        data.append((text, [span_features(text, a, b) for a, b in held], truth))
    names = sorted({f for _, fs, _ in data for x in fs for f in x} | {INTO, OUT, *(f"from:{k}" for k in KINDS)})
    weights = {f: np.zeros(len(KINDS)) for f in names}
    squares = {f: np.full(len(KINDS), 1e-2) for f in names}
    for _ in range(rounds):
        rng.shuffle(data)
        for text, features, truth in data:
            if not features:
                continue
            chart = Chart(text, weights, features)
            push = -chart.shares
            steps = {INTO: -chart.entered.sum(axis=0), OUT: -chart.left.sum(axis=0), **{f"from:{k}": -chart.pairs[i] for i, k in enumerate(KINDS)}}
            for n, (c, k) in enumerate(truth):  # in order of place
                push[c, k] += 1
                follows = n and chart.near[truth[n - 1][0], c]
                steps[f"from:{KINDS[truth[n - 1][1]]}" if follows else INTO][k] += 1
                if n + 1 == len(truth) or not chart.near[c, truth[n + 1][0]]:
                    steps[OUT][k] += 1
            for c, fs in enumerate(features):
                for f in fs:
                    steps[f] = steps[f] + push[c] if f in steps else push[c].copy()
            for f, g in steps.items():
                g = g - decay * weights[f]
                squares[f] += g * g
                weights[f] += rate * g / np.sqrt(squares[f])
    return {f: w.tolist() for f, w in weights.items()}


def _finder(weights):
    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            both = [find_spans(t, weights.value) for t in batch.column(1).to_pylist()]
            out = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x[i]] for x in both], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[ID, TEXT, REST, "base", "spans"])

    return run


def find_pii(docs: DataFrame, weights: dict[str, list[float]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with base and spans: arrays of (kind, start, end), by kind and start."""
    base = pack(docs, id_col, text_col, ["base", "spans"])
    kinds = ", ".join(f"{c} {ddl(base.schema[c].dataType)}" for c in (ID, TEXT, REST))
    sent = docs.sparkSession.sparkContext.broadcast(weights or train())
    span = "array<struct<kind: string, start: bigint, end: bigint>>"
    made = base.mapInArrow(_finder(sent), f"{kinds}, base {span}, spans {span}")
    return unpack(made, docs, id_col, text_col, {"base": F.col("base"), "spans": F.col("spans")})
