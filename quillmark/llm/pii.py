"""Personal data: base patterns, plus candidates accepted by boosted trees.

Base spans (e-mail, IP address, payment card, phone) are found by fixed rules and always stay. High-recall generators propose
further, possibly overlapping spans: secrets (also of letters alone), bank accounts in either case, national numbers with dashes or spaces, written-out and
spoken addresses, phones without a plus (groups of two, areas with a number, three groups), and cards and phones that the fixed rules lose because they run into a neighbouring number.
Gradient-boosted trees score each candidate from its format and its context; scores are calibrated on held-out examples, and the
threshold of a kind is the lowest calibrated probability at which the held-out precision reaches the target. Of overlapping
accepted candidates the likelier, then the longer, then the earlier stays; one that overlaps a base span is dropped, as that
span stands already.

The trees are trained on labelled examples that this module makes from a fixed seed: true spans and look-alikes (hashes, order
numbers, versions, identifiers) in contexts of several languages. No table is used for training.

Null and empty text: no span. Offsets are code points, ends exclusive. Texts are scanned whole, of any length; scans, features and
redaction are linear in the text but for a sort of its spans. Equal texts and repeated rows give equal spans, each row its own. Empty tables
give empty results. Columns beyond the id, the text and ``also`` are left out, whatever their names.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import random
import re

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "iban", "national_id", "contact", "local_phone", "card", "phone")
KINDS = BASE_KINDS + ADDED_KINDS[:5]

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")  # any run: a pattern that can fail after a long run would be quadratic
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _is_digits(s: str, low: int, high: int) -> str | None:
    digits = "".join(c for c in s if "0" <= c <= "9")
    return digits if low <= len(digits) <= high else None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed rules, by kind as listed, then start; a failing match is dropped and not tried anew."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text) is None:
        return out
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append(("ip", at, end))
            at = end + 1
    for m in _CARD.finditer(text):
        if (d := _is_digits(m.group(), 13, 19)) and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if _is_digits(m.group(), 9, 15)]
    return out


# ---- candidates

#: What proposes candidates; a run is taken whole (possessive) and only from its start, which keeps each scan linear.
GENERATORS = (
    ("secret", re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}+")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[a-z]{2}[0-9]{2}\x20?[a-z0-9]{4}(?:\x20?(?=[a-z]{0,3}[0-9])[a-z0-9]{4}){1,6}(?:\x20?(?=[a-z]{0,2}[0-9])[a-z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("national_id", re.compile(r"(?<![0-9-])(?<![0-9]\x20)[0-9]{3}([\x20-])[0-9]{2}\1[0-9]{4}(?![0-9-]|\x20[0-9])")),
    ("contact", re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?[(\[]dot[)\]]\x20?[A-Za-z0-9-]++)++", re.I)),
    ("contact", re.compile(r"(?<![A-Za-z0-9._-])(?<!dot\x20)[A-Za-z0-9_-]++(?:\x20dot\x20[A-Za-z0-9_-]++)*+\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++", re.I)),
    ("local_phone", re.compile(r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-]?[0-9])")),
    ("local_phone", re.compile(r"(?<![0-9+.-])(?<![0-9]\x20)[0-9]{2}(?:[\x20.-][0-9]{2}){4}(?![0-9]|[\x20.-][0-9])")),
    ("local_phone", re.compile(r"(?<![0-9+.-])(?:\(0[0-9]{1,4}\)[\x20/-]?|0[0-9]{1,4}[\x20/-])[0-9]{5,8}(?![0-9]|[.-][0-9])")),
    ("card", re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])")),
    ("phone", re.compile(r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])")),
)
CUES = {
    "secret": ("password", "passwd", "token", "secret", "api_key", "apikey", "key", "bearer", "contraseña", "passwort", "mot de passe"),
    "iban": ("iban", "account", "konto", "compte", "cuenta"),
    "national_id": ("ssn", "social", "national", "id number", "ausweis", "dni"),
    "contact": ("mail", "contact", "kontakt", "write", "reach", "correo"),
    "local_phone": ("phone", "tel", "call", "fax", "mobile", "telefon", "téléphone", "teléfono"),
    "card": ("card", "visa", "karte", "carte", "tarjeta", "pay"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "telefon", "téléphone", "teléfono"),
}
#: Ends of addresses that the examples use.
TOP_DOMAINS = ("com", "org", "net", "de", "fr", "es", "edu", "io", "info")
DECOYS = ("order", "version", "commit", "sha", "checksum", "isbn", "build", "part", "section", "ref", "case", "digest")
_WIDTH = 28
_RUN = re.compile(r"[b-df-hj-np-tv-z]+", re.I)


_COUNTRY = re.compile(r"\+[0-9]{1,3}[\x20.-]?$")
_ACCOUNT = re.compile(r"[A-Za-z]{2}[0-9]{2}[A-Za-z0-9]{11,30}")
_MIXED = re.compile(r"[a-z][A-Z]")


def proposed(text: str, start: int, end: int) -> bool:
    """Whether a run of letters, digits and signs may be a secret: it holds a digit, mixes upper and lower case, or has a value's place.

    An account number whose check digits are right is one already."""
    run = text[start:end]
    if _ACCOUNT.fullmatch(run) and _mod97(run):
        return False
    return _DIGIT.search(run) is not None or end - start >= 16 and _MIXED.search(run) is not None or text[max(0, start - 2) : start].strip()[-1:] in ("=", ":", '"', "'")


def candidates(text: str) -> list[tuple[str, int, int]]:
    out = []
    digits, low = _DIGIT.search(text) is not None, None
    for kind, pattern in GENERATORS:
        if kind == "contact":
            low = text.lower() if low is None else low
            if not (any(x in low for x in ("(at)", "[at]")) or " dot " in low and " at " in low):
                continue
        elif kind != "secret" and not digits:
            continue
        for m in pattern.finditer(text):
            if not (kind == "secret" and not proposed(text, *m.span()) or kind == "local_phone" and _COUNTRY.search(text, max(0, m.start() - 6), m.start())):
                out.append((kind, *m.span()))
    return out


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    s = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def _consonants(s: str) -> float:
    """Length of the longest run of letters without a vowel, up to 20."""
    return float(min(20, max(map(len, _RUN.findall(s)), default=0)))


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate, as numbers."""
    s, before = text[start:end], text[max(0, start - _WIDTH) : start].lower()
    after = text[end : end + 12]
    n = len(s)
    digits, upper, lower = (sum(map(f, s)) for f in (str.isdigit, str.isupper, str.islower))
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:]))
    return [
        ADDED_KINDS.index(kind), n, digits / n, upper / n, lower / n, (n - digits - upper - lower) / n, switches / n, _entropy(s),
        float(re.fullmatch(r"[0-9a-f]+", s) is not None), float(re.match(r"AKIA|ASIA|ghp_|sk-|xox", s) is not None),
        float(kind == "iban" and _mod97(s)), float(any(c in before for c in CUES[kind])), float(any(c in before for c in DECOYS)),
        float(before.rstrip(' "\'').endswith(("=", ":"))), float(start > 0 and text[start - 1] in "\"'"), float(after[:1] in "\"'" if after else 0),
        float(bool(before) and before[-1].isalnum()), sum(a.islower() != b.islower() for a, b in zip(s, s[1:]) if a.isalpha() and b.isalpha()) / n, _consonants(s), float(s.isdigit()), float(kind == "card" and luhn("".join(c for c in s if "0" <= c <= "9"))),
        float(s.lstrip("(")[:1] == "0"), float(sum(c in " .-/" for c in s)), float(s.rpartition(" ")[2].lower() in TOP_DOMAINS), float(kind == "contact" and s[-1] not in ")]" and "[" not in s and "(" not in s),
    ]


class Boosted:
    """Gradient-boosted regression trees of depth ``depth`` on the logistic loss."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3):
        self.rounds, self.depth, self.rate, self.trees, self.start = rounds, depth, rate, [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = y.mean()
        self.start = math.log(p / (1 - p))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 18)[1:-1])) for f in range(x.shape[1])]
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            tree = self._grow(x, q - y, q * (1 - q), cuts, np.arange(len(y)), 0)
            self.trees.append(tree)
            score += self.rate * self._walk(tree, x)
        return self

    def _grow(self, x, g, h, cuts, rows, depth):
        gain_of = lambda a, b: a * a / (b + 1.0)
        total = gain_of(g[rows].sum(), h[rows].sum())
        best = (1e-6, None, None)
        if depth < self.depth and len(rows) > 8:
            for f, points in enumerate(cuts):
                v = x[rows, f]
                for c in points:
                    left = v <= c
                    if 0 < left.sum() < len(rows):
                        gl, hl = g[rows[left]].sum(), h[rows[left]].sum()
                        gr, hr = g[rows[~left]].sum(), h[rows[~left]].sum()
                        if (gain := gain_of(gl, hl) + gain_of(gr, hr) - total) > best[0]:
                            best = (gain, f, c)
        if best[1] is None:
            return -g[rows].sum() / (h[rows].sum() + 1.0)
        left = x[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(x, g, h, cuts, rows[left], depth + 1), self._grow(x, g, h, cuts, rows[~left], depth + 1)

    def _walk(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        left = x[:, tree[0]] <= tree[1]
        out = np.empty(len(x))
        out[left], out[~left] = self._walk(tree[2], x[left]), self._walk(tree[3], x[~left])
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum(self._walk(t, x) for t in self.trees)


def examples(n: int = 6300, seed: int = 11) -> list[tuple[str, str, int, int, int]]:
    """Labelled candidates (text, kind, start, end, label), from a fixed seed."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: pick(low, r.randint(2, 9))
    spoken = lambda: "".join(r.choice("bcdfghklmnprstvw") + r.choice("aeiou") + r.choice(("", "", "n", "r", "st", "sch")) for _ in range(r.randint(2, 5)))

    def iban(valid):
        country, body = r.choice(("DE", "FR", "GB", "ES", "LU")), pick(dig, r.choice((16, 18, 20)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        s = f"{country}{(check if valid else (check + r.randint(1, 90)) % 97 + 2) % 100:02d}{body}"
        s = s.lower() if r.random() < 0.25 else s
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.5 else s

    def made(kind, label):
        cue = r.choice(CUES[kind]) if r.random() < 0.6 else ""
        if kind == "secret":
            if label:
                form = r.randrange(5)
                if form == 4:
                    s = pick(low + up, r.randint(16, 60))
                    return s, r.choice(CUES[kind]) + r.choice((' = "', "=", ": ", "='", ' = '))
                s = ("AKIA" + pick(up + dig, 16)) if form == 0 else pick("0123456789abcdef", r.choice((16, 18, 24, 32, 40))) if form == 1 else pick(low + up + dig, r.randint(16, 40)) if form == 2 else "ghp_" + pick(low + up + dig, 36)
                cue = cue if form in (0, 3) else r.choice(CUES[kind])
                return s, cue + (r.choice((" = \"", "=", ": ", "='")) if cue else "")
            form = r.randrange(7)
            if form > 3:  # words, also in a value's place
                joined, case = r.choice(("", "", "-", "_", "/")), r.choice((str, str, str.capitalize, str.upper))
                s = joined.join(case(spoken()) for _ in range(r.randint(3, 5)))
                s += (spoken() * 6)[: max(0, 12 - len(s))]
                return s, r.choice((r.choice(CUES[kind]) + ": ", r.choice(CUES[kind]) + " ", spoken() + ": ", spoken() + " = ", spoken() + " ", spoken() + " ", spoken() + ": \""))
            s = pick("0123456789abcdef", r.choice((32, 40, 64))) if form == 0 else f"{word()}-{r.randint(1, 99)}-{word()}{word()}" if form == 1 else pick(dig, r.randint(12, 16)) if form == 2 else f"{word()}_{word()}{r.randint(1, 2030)}"
            return s, r.choice((*DECOYS, word())) + " "
        if kind == "iban":
            return iban(label), (cue or (word() if label else r.choice(DECOYS))) + r.choice((" ", ": "))
        if kind == "national_id":
            s = f"{r.randint(1, 899):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}".replace("-", r.choice("-- "))
            return s, (r.choice(CUES[kind]) if label else r.choice((*DECOYS, word()))) + r.choice((" ", ": "))
        if kind == "contact" and r.random() < 0.4:  # spoken
            name, host = word() + (" dot " + word()) * r.choice((0, 1, 1, 2)), word() + (" dot " + word()) * r.choice((0, 0, 1))
            return (f"{name} at {host} dot {r.choice(TOP_DOMAINS)}", (cue or word()) + " ") if label else (f"{word()} at {word()} dot {word()}{word()}", r.choice((*DECOYS, word())) + " ")
        if kind == "contact":
            s = f"{word() * r.choice((1, 1, 1, 9))}.{word()} [at] {word() * r.choice((1, 1, 1, 9))}{''.join(' [dot] ' + word() for _ in range(r.choice((0, 0, 1, 5))))} [dot] {r.choice(('com', 'org', 'net'))}"
            return (s, (cue or word()) + " ") if label else (f"{word()} (at) {word()}(dot){word()}{word()}{word()}", r.choice(DECOYS) + " ")
        if kind == "card":
            s = pick(dig, 15)
            d = next(c for c in dig if luhn(s + c) == bool(label))
            s += d
            return (s if r.random() < 0.7 else " ".join(s[i : i + 4] for i in range(0, 16, 4))), (cue or word()) + " "
        if kind == "phone":
            s = f"+{r.randint(1, 99)} ({pick(dig, 3)}) {pick(dig, 3)}-{pick(dig, 4)}"
            return (s, (cue or word()) + " ") if label else (f"+{pick(dig, 3)}{pick(dig, 3)}{pick(dig, 3)}{pick(dig, 4)}", r.choice(DECOYS) + " ")
        form = r.randrange(6)
        if form == 4:
            s = r.choice(" .-").join([r.choice("00001") + pick(dig, 1) if label else pick(dig, 2), *(pick(dig, 2) for _ in range(4))])
        elif form == 5:
            area, number = "0" + pick(dig, r.randint(1, 4)), pick(dig, r.randint(5, 8))
            s = f"({area}) {number}" if r.random() < 0.5 else area + r.choice(" /-") + number
        else:
            s = ("{}-{}-{}", "({}) {}-{}", "{} {} {}", "{}.{}.{}")[form].format(pick(dig, 3), pick(dig, 3), pick(dig, 4))
        return s, (r.choice(CUES[kind]) if label else r.choice((*DECOYS, word()))) + r.choice((" ", ": "))

    out = []
    for i in range(n):
        kind, label = ADDED_KINDS[i % len(ADDED_KINDS)], int(r.random() < 0.5)
        s, lead = made(kind, label)
        if kind == "secret" and r.random() < 0.15:  # shouted pages
            s, lead = s.upper(), lead.upper()
        head = f"{word()} {word()}{r.choice((' ', ', ', '. '))}{lead}"
        tail = ('"' if lead.endswith('"') else "'" if lead.endswith("'") else "") + r.choice(("", "", "", "!!", "###", ",", "$$$")) + f" {word()} {word()}."
        out.append((head + s + tail, kind, len(head), len(head) + len(s), label))
    return out


class Model:
    def __init__(self, precision: float = 0.97):
        rows = examples()
        x = np.array([features(t, k, a, b) for t, k, a, b, _ in rows])
        y = np.array([r[4] for r in rows], float)
        kind = x[:, 0].astype(int)
        held = np.arange(len(y)) % 3 == 0
        self.trees = Boosted().fit(x[~held], y[~held])
        raw = self.trees.raw(x[held])
        self.a, self.b = self._platt(raw, y[held])
        p = self.calibrated(raw)
        self.threshold = {}
        for k, name in enumerate(ADDED_KINDS):
            pk, yk = p[kind[held] == k], y[held][kind[held] == k]
            good = [t for t in np.unique(pk) if yk[pk >= t].mean() >= precision]
            self.threshold[name] = max(0.5, float(min(good))) if good else 1.1

    @staticmethod
    def _platt(raw, y):
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * raw + b)))
            ga, gb = ((p - y) * raw).mean() + 1e-3 * (a - 1), (p - y).mean()
            a, b = a - 0.1 * ga, b - 0.1 * gb
        return a, b

    def calibrated(self, raw):
        return 1 / (1 + np.exp(-(self.a * raw + self.b)))

    def accept(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        found = candidates(text)
        if not found:
            return []
        p = self.calibrated(self.trees.raw(np.array([features(text, *c) for c in found])))
        order = sorted((-q, a - b, a, k, b) for (k, a, b), q in zip(found, p.tolist(), strict=True) if q >= self.threshold[k])
        taken, out = merged(sorted((a, b) for _, a, b in base)), []
        for _, _, a, k, b in order:
            i = bisect.bisect_left(taken, (a, -1))
            if (i == len(taken) or taken[i][0] >= b) and (i == 0 or taken[i - 1][1] <= a):
                taken.insert(i, (a, b))
                out.append((k, a, b))
        return in_order(out)


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with overlaps joined."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@functools.lru_cache(maxsize=1)
def model() -> Model:
    return Model()


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, overlapping ones joined, replaced by its first kind in brackets. One sweep over the sorted spans."""
    out, done, start, end, kind = [], 0, 0, 0, -1
    for a, b, k in [*sorted((a, b, KINDS.index(k)) for k, a, b in spans), (len(text) + 1, 0, 0)]:
        if kind >= 0 and a < end:
            end, kind = max(end, b), min(kind, k)
            continue
        if kind >= 0:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
            done = end
        start, end, kind = a, b, k
    return "".join([*out, text[done:]])


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of base spans by kind, digest of the base spans, and all spans."""
    shared = df.sparkSession.sparkContext.broadcast(model())  # bounded: 40 small trees

    def make():
        trained = shared.value

        def apply(texts):
            out = {f"n_{k}": [] for k in BASE_KINDS} | {"base_sha256": [], "spans": []}
            for t in texts:
                base = base_spans(t or "")
                for k in BASE_KINDS:
                    out[f"n_{k}"].append(sum(s[0] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
                out["spans"].append(listed(in_order(base + trained.accept(t or "", base))))
            return out

        return apply

    return map_texts(df, id_col, text_col, "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string", make)


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the id, ``also``, and ``redacted``, the text without any span that is found; a null text stays null."""
    shared = df.sparkSession.sparkContext.broadcast(model())

    def make():
        trained = shared.value

        def one(t):
            base = base_spans(t)
            spans = base + trained.accept(t, base)
            return redact(t, spans) if spans else t

        return lambda texts: {"redacted": [None if t is None else one(t) for t in texts]}

    return map_texts(df, id_col, text_col, "redacted string", make, also)
