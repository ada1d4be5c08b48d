"""Personal data: exact patterns, and a character BiLSTM with CRF transitions for other spellings.

The network is trained here, in numpy, on labelled spans in invented sentences. It
reads overlapping windows; each is decoded by Viterbi, and a character's label
is that of the window in which it is farthest from an edge. Where a span begins and ends is what these labels say, to whole
words; no pattern of its spelling is asked, only checks of its numbers (see ``plausible``). So it adds spellings such as
``name [at] host [dot] org`` or ``(555) 123-4567``.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")

# ---------------------------------------------------------------- exact patterns
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for d in digits[-2::-2]:
        total += int(d) * 2 - 9 * (d > "4")
    return total % 10 == 0


def _small(part: str) -> bool:
    return len(part := part.lstrip("0")) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of the exact patterns' matches, in order; code points, end exclusive.

    Matches of one kind don't overlap; one that fails its check is passed over whole. A match
    never begins inside a run of digits (or an e-mail inside its run of name characters),
    so each run is tried once from its beginning: time is linear in the text.
    """
    found, done = [], 0
    for m in _HOST.finditer(text):
        at = m.start()
        while at > done and text[at - 1] in _LOCAL:
            at -= 1
        if at < m.start():
            found.append((at, 0, m.end()))
            done = m.end()
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NO_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# ---------------------------------------------------------------- the network
_MARKS = "@._%+-()[] :/,#=*"
_CLASSES = 26 + 26 + 1 + len(_MARKS) + 2
N_LABELS = 1 + 2 * len(KINDS)  # 0: none; 1 + 2k begins kind k, 2 + 2k goes on


def _class_table() -> np.ndarray:
    """Class of each code point below 256; those above are letters of another script."""
    t = np.full(257, _CLASSES - 1, np.uint8)
    for i in range(26):
        t[ord("a") + i], t[ord("A") + i] = i, 26 + i
    t[ord("0") : ord("9") + 1] = 52
    for i, c in enumerate(_MARKS):
        t[ord(c)] = 53 + i
    t[[ord(c) for c in "\t\n\r"]] = 53 + _MARKS.index(" ")
    for i in range(192, 257):
        t[i] = _CLASSES - 2
    return t


_TABLE = _class_table()


def classes(text: str) -> np.ndarray:
    return _TABLE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 256)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiLstmCrf:
    """Parameters: per direction, input weights by class (C, 4H), recurrent weights (H, 4H); output (2H, L); transitions (L, L)."""

    def __init__(self, hidden: int = 32, seed: int = 7):
        r = np.random.default_rng(seed)
        self.h = hidden
        p = {}
        for d in "fb":
            p["x" + d] = r.normal(0, 0.3, (_CLASSES, 4 * hidden))
            p["x" + d][:, hidden : 2 * hidden] += 1.0  # the forget gate starts open
            p["u" + d] = r.normal(0, 0.3 / np.sqrt(hidden) * 2, (hidden, 4 * hidden))
        p["o"] = r.normal(0, 0.3, (2 * hidden, N_LABELS))
        p["ob"] = np.zeros(N_LABELS)
        p["t"] = np.zeros((N_LABELS, N_LABELS))
        self.p = {k: v.astype(np.float32) for k, v in p.items()}
        # A kind goes on only after its own beginning.
        self.allowed = np.array([[not (b > 0 and b % 2 == 0) or a in (b - 1, b) for b in range(N_LABELS)] for a in range(N_LABELS)])
        self.first = np.array([not (b > 0 and b % 2 == 0) for b in range(N_LABELS)])

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        n, length = x.shape
        h = self.h
        hs, cache = np.zeros((length, n, h), np.float32), []
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = self.p["x" + d][x[:, t]] + state @ self.p["u" + d]
            s = _sigmoid(z[:, : 3 * h])
            g = np.tanh(z[:, 3 * h :])
            before, prev = cell, state
            cell = s[:, h : 2 * h] * cell + s[:, :h] * g
            tc = np.tanh(cell)
            state = s[:, 2 * h :] * tc
            hs[t] = state
            if keep:
                cache.append((t, s, g, before, prev, tc))
        return hs, cache

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(length, n, labels) scores of windows ``x`` (n, length)."""
        return np.concatenate([self._run(x, d, False)[0] for d in "fb"], axis=2) @ self.p["o"] + self.p["ob"]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best label sequence of each window, (n, length)."""
        e = self.emissions(x)
        length, n, _ = e.shape
        step = np.where(self.allowed, self.p["t"], np.float32(-1e4))
        best, back = np.where(self.first, e[0], np.float32(-1e4)), np.zeros((length, n, N_LABELS), np.int8)
        for t in range(1, length):
            total = best[:, :, None] + step
            back[t] = total.argmax(axis=1)
            best = total.max(axis=1) + e[t]
        out = np.zeros((n, length), np.int8)
        out[:, -1] = best.argmax(axis=1)
        rows = np.arange(n)
        for t in range(length - 1, 0, -1):
            out[:, t - 1] = back[t][rows, out[:, t]]
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of label sequences ``y`` and its gradients."""
        n, length = x.shape
        h, g = self.h, {k: np.zeros_like(v) for k, v in self.p.items()}
        hf, cf = self._run(x, "f", True)
        hb, cb = self._run(x, "b", True)
        both = np.concatenate([hf, hb], axis=2)
        e = both @ self.p["o"] + self.p["ob"]
        # Forward and backward sums, each position scaled to a sum of one; ``scale`` holds by what.
        top = e.max(axis=2, keepdims=True).astype(np.float64)
        weight, step = np.exp(e - top), np.where(self.allowed, np.exp(self.p["t"].astype(np.float64)), 0.0)
        alpha, beta, scale = np.zeros((length, n, N_LABELS)), np.ones((length, n, N_LABELS)), np.zeros((length, n, 1))
        for t in range(length):
            a = (alpha[t - 1] @ step if t else np.broadcast_to(self.first, (n, N_LABELS))) * weight[t]
            scale[t] = a.sum(axis=1, keepdims=True)
            alpha[t] = a / scale[t]
        for t in range(length - 2, -1, -1):
            beta[t] = (weight[t + 1] * beta[t + 1] / scale[t + 1]) @ step.T
        z = (np.log(scale) + top).sum(axis=(0, 2))
        at, rows = np.arange(length)[:, None], np.arange(n)[None]
        gold = e[at, rows, y.T].sum(axis=0, dtype=np.float64) + self.p["t"][y[:, :-1], y[:, 1:]].sum(axis=1, dtype=np.float64)
        de = alpha * beta
        de[at, rows, y.T] -= 1
        dt = step * (alpha[:-1].reshape(-1, N_LABELS).T @ (weight[1:] * beta[1:] / scale[1:]).reshape(-1, N_LABELS))
        np.subtract.at(dt, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        de = (de / n).astype(np.float32)
        g["t"] = np.where(self.allowed, dt / n, 0).astype(np.float32)
        g["o"] = both.reshape(-1, 2 * h).T @ de.reshape(-1, N_LABELS)
        g["ob"] = de.sum(axis=(0, 1))
        dh_all = de @ self.p["o"].T
        for d, cache, part in (("f", cf, dh_all[:, :, :h]), ("b", cb, dh_all[:, :, h:])):
            dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            u, dzs = self.p["u" + d], np.zeros((length, n, 4 * h), np.float32)
            for t, s, gg, before, prev, tc in reversed(cache):
                dh = dh + part[t]
                i, f, o = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                dzs[t] = dz
                g["u" + d] += prev.T @ dz
                dh, dc = dz @ u.T, dc * f
            hot = np.zeros((length * n, _CLASSES), np.float32)
            hot[np.arange(length * n), x.T.ravel()] = 1
            g["x" + d] = hot.T @ dzs.reshape(length * n, 4 * h)
        return float((z - gold).mean()), g


# ---------------------------------------------------------------- labelled spans to train on
_COMMON = """the of and to in is was for on that with as it at by from this have be are not you his they which or an were her all we their has when who
will more if no out so what up said its about than into them can only other time new some could these may first then do any like my now over such our man
me even most made after also did many must before through back years where much your way well down should because each just those people mr how too
little state good very make world still own see men work long get here between both life being under never day same another know while last might us
der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie
le la les des et un une du en est que qui dans pour pas au sur ne se ce il sont plus par avec el los las del se por con para una su lo como pero sus"""
_CUES = """mail e-mail email contact write to reach me under send it to my address is you can find call phone tel telephone mobile ring us on text number fax server host
address ip router ping card visa pay with account billed paid order from my new old work private personal please or and via cc reply""".split()
_SYLLABLES = "the an re ing on ter al is vo sch que ado mi un ba jo ma li kes tor nel wi ra den bo".split()


def _sentence(r: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """An invented passage with its labelled spans ``start, end, kind``."""
    common = _COMMON.split()
    pick = lambda *x: r.choice(x)
    num = lambda n: "".join(r.choices("0123456789", k=n))

    def label() -> str:
        """A word of any make: in names and hosts as in the text around them, so that only the spelling tells them apart."""
        u = r.random()
        if u < 0.3:
            return "".join(pick(*_SYLLABLES) for _ in range(r.randrange(1, 4)))
        if u < 0.55:
            return pick(*common).lower()
        if u < 0.9:
            return "".join(pick(*("bcdfghjklmnpqrstvwxz" if (i + int(u * 100)) % 2 else "aeiouy")) + (pick(*"lnrst") if r.random() < 0.25 else "") for i in range(r.randrange(2, 8)))
        return "".join(pick(*"abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(1, 6)))

    def word() -> str:
        w = pick(*common) if r.random() < 0.6 else label()
        if r.random() < 0.12:
            k = r.randrange(len(w) + 1)
            w = w[:k] + pick(*"éäñçß") + w[k:]
        return w.title() if r.random() < 0.15 else w.upper() if r.random() < 0.03 else w + pick(",", ".", "") * int(r.random() < 0.2)

    def email() -> str:
        at, dot = pick(("@", "."), ("[at]", "[dot]"), ("(at)", "(dot)"), (" at ", " dot "), (" at ", " dot "), ("{at}", "{dot}"), ("<at>", "<dot>"), ("-at-", "-dot-"), (" *at* ", " *dot* "), ("_at_", "_dot_"), (" @ ", "."), ("(@)", "."), ("[at]", "."), ("(at)", "."), (" at ", "."), ("@", " dot "), ("@", "[dot]"))
        if at[0] in "[({<":
            around = pick("", " ", " ")
            at = around + (at if r.random() < 0.8 else at[0] + " " + at[1:-1] + " " + at[-1]) + around
            dot = dot if dot == "." else around + (dot if r.random() < 0.9 else dot[0] + " " + dot[1:-1] + " " + dot[-1]) + around
        if r.random() < 0.25:
            at, dot = at.upper(), dot.upper()
        parts = [label(), *([pick(".", "_", "-", "+", dot) + label()] if r.random() < 0.5 else []), *([num(2)] if r.random() < 0.2 else [])]
        if at == " at " and dot == "." and len(parts) == 1:
            parts.append(pick("_", ".", "") + num(2))  # a bare word at a host isn't an address
        name = "".join(parts)
        host = dot.join([label() + (num(1) if r.random() < 0.1 else ""), *([label()] if r.random() < 0.3 else []), *(["co"] if r.random() < 0.1 else []), pick("com", "org", "net", "de", "uk", "io", "edu", "fr", "info", "es", "co")])
        made = name + at + host
        return made.title() if r.random() < 0.05 else made

    def ip() -> str:
        return pick(".", "[.]", " . ", "(.)", "[.]", " [.] ", ". ", "(.) ").join(str(k) for k in r.choices(range(256), k=4))

    def card() -> str:
        digits = num(r.randrange(13, 16))
        digits += next(c for c in "0123456789" if luhn(digits + c))
        cut = pick("", " ", "-", ".", "/", "  ", " - ", "_")
        return cut.join(digits[i : i + 4] for i in range(0, len(digits), 4)) if r.random() < 0.85 else digits

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        first = pick("+1 ", "+44 ", "", "", "", "1-", "00", "0", "1 ", "+49-")
        return first + pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"{a}/{b}/{c}", f"{a} {b} {c}", f"({a}) {b} {c}", f"{a} {b}-{c}", f"({a}) {b}.{c}", f"{a}/{b}{c}", f"{a} - {b} - {c}")

    def other() -> str:
        return pick(
            lambda: f"version {num(1)}.{num(1)}", lambda: f"token = \"{''.join(r.choices('0123456789abcdef', k=24))}\"", lambda: num(r.randrange(1, 9)), lambda: f"{num(2)}.{num(2)}.{num(4)}",
            lambda: f"20{num(2)}-0{num(1)}-1{num(1)}", lambda: f"{label()}@{label()}", lambda: f"no. {num(3)}/{num(2)}", lambda: f"{num(1)},{num(3)}.{num(2)}", lambda: f"1{num(1)}:{num(2)}:{num(2)}",
            lambda: f"{word()} at {word()}", lambda: f"{pick(*common)} at {label()}.{pick('com', 'org', 'net')}", lambda: f"{word()} at {word()}. {word().title()}", lambda: word() + pick("###", "***", "$$$", "**"),
            lambda: word() + "&&&", lambda: f"the dot {word()}", lambda: f"{word()} dot", lambda: f"{num(4)} {num(4)}", lambda: f"{num(1)}.{num(1)}.{num(1)}", lambda: f"{num(4)}-{num(2)}-{num(2)} {num(2)}:{num(2)}",
            lambda: f"{num(3)} {num(3)}", lambda: " ".join(num(3) for _ in range(r.randrange(3, 6))), lambda: f"{num(2)}, {num(2)}, {num(2)}, {num(2)}", lambda: f"{num(12)}",
            lambda: f"${num(3)},{num(3)},{num(3)}.{num(2)}", lambda: f"isbn {num(3)}-{num(1)}-{num(3)}",
        )()

    text, spans = "", []
    while len(text) < 92:
        text += word() + pick(" ", " ", " ", " ", "\n", " | ")
        u = r.random()
        if u < 0.22:
            if r.random() < 0.6:
                text += " ".join(pick(*_CUES) for _ in range(r.randrange(1, 4))) + pick(" ", " ", ": ", " = ", " (", ":\n", " - ")
            kind = r.choices(range(4), [0.5, 0.14, 0.14, 0.22])[0]
            made = (email, ip, card, phone)[kind]()
            spans.append((len(text), len(text) + len(made), kind))
            text += made + pick(" ", " ", ", ", ". ", "\n", ") ", "; ", "! ", "? ")
        elif u < 0.34:
            text += other() + " "
    shift = r.randrange(12)  # windows begin anywhere
    return text[shift:], [(a - shift, b - shift, k) for a, b, k in spans if a >= shift]


def labelled(n: int, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = random.Random(seed)
    x, y = np.full((n, length), 53 + _MARKS.index(" "), np.uint8), np.zeros((n, length), np.int64)
    for i in range(n):
        text, spans = _sentence(r)
        c = classes(text)[:length]
        x[i, : len(c)] = c
        for a, b, k in spans:
            if a < length:
                y[i, a:b] = 2 + 2 * k
                y[i, a] = 1 + 2 * k
    return x, y


_trained: dict[tuple, BiLstmCrf] = {}


def trained(steps: int = 450, batch: int = 128, length: int = 88, seed: int = 11) -> BiLstmCrf:
    """The network, trained by Adam on invented sentences; the same for the same arguments. Kept while the process lives."""
    key = (steps, batch, length, seed)
    if key not in _trained:
        net = BiLstmCrf()
        m, v = ({k: np.zeros_like(w) for k, w in net.p.items()} for _ in range(2))
        x, y = labelled(batch * 60, length, seed)
        r = np.random.default_rng(seed)
        for s in range(1, steps + 1):
            rows = r.integers(len(x), size=batch)
            _, g = net.gradients(x[rows], y[rows])
            size = np.sqrt(sum(float((w * w).sum()) for w in g.values()))
            rate = 0.04 * min(1, s / 20) * (1 - s / (1.1 * steps))
            for k, w in g.items():
                w = w * min(1.0, 5.0 / (size + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * w
                v[k] = 0.99 * v[k] + 0.01 * w * w
                net.p[k] = net.p[k] - (rate * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-8)).astype(np.float32)
        _trained[key] = net
    return _trained[key]


# ---------------------------------------------------------------- whole texts
WINDOW, STRIDE = 96, 48
_AT = re.compile(r"@|(?<![A-Za-z0-9])at(?![A-Za-z0-9])", re.I)
#: A window without any of this isn't run: four digits near each other, an @, or the word "at" with a dot between characters, a bracket before a dot or the word "dot" soon after.
_TRIGGER = re.compile(
    r"[0-9](?:[^0-9A-Za-z]{0,5}[0-9]){3,}|@|(?<![A-Za-z0-9])at(?![A-Za-z0-9])(?=.{1,60}?(?:(?<![A-Za-z0-9])dot(?![A-Za-z0-9])|[A-Za-z0-9]\.[A-Za-z0-9]|[\[({<]\s?\.))", re.I | re.S
)


def plausible(kind: int, s: str) -> bool:
    """Whether a span that the network found can be of its kind, in any spelling: ranges, counts of digits and checksums; an address holds an @ or the word "at"."""
    if kind == 0:
        return bool(_AT.search(s))
    if kind == 1:
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(map(_small, parts))
    digits = _NO_DIGIT.sub("", s)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 10 <= len(digits) <= 15


def _whole_words(text: str, a: int, b: int, most: int = 64) -> tuple[int, int] | None:
    """A labelled span without spaces at its ends, and with all of the words that it begins and ends in; None if one goes on for over ``most`` characters."""
    while a < b and text[a].isspace():
        a += 1
    while a < b and text[b - 1].isspace():
        b -= 1
    if a == b:
        return None
    lo, hi = a, b
    while lo > 0 and a - lo <= most and text[lo].isalnum() and text[lo - 1].isalnum():
        lo -= 1
    while hi < len(text) and hi - b <= most and text[hi - 1].isalnum() and text[hi].isalnum():
        hi += 1
    return None if a - lo > most or hi - b > most else (lo, hi)


def _windows(text: str) -> list[int]:
    """Starts of the windows, on a grid of STRIDE, that hold a trigger."""
    out: list[int] = []
    for m in _TRIGGER.finditer(text):
        lo = max(0, -(-(m.start() - WINDOW + 1) // STRIDE))
        hi = (m.end() - 1) // STRIDE
        if out:
            lo = max(lo, out[-1] + 1)
        out += range(lo, hi + 1)
    return out


def added_spans(net: BiLstmCrf, texts: list[str], bases: list[list[tuple[int, int, int]]], at_once: int = 1024) -> list[list[tuple[int, int, int]]]:
    """The network's spans in each text that don't touch a base span."""
    where = [(i, k * STRIDE) for i, t in enumerate(texts) for k in _windows(t)]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    labels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for at in range(0, len(where), at_once):
        part = where[at : at + at_once]
        x = np.full((len(part), WINDOW), 53 + _MARKS.index(" "), np.uint8)
        for r, (i, a) in enumerate(part):
            c = classes(texts[i][a : a + WINDOW])
            x[r, : len(c)] = c
        got = net.decode(x)
        inner = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1
        for (i, a), row in zip(part, got, strict=True):
            if i not in labels:
                labels[i] = (np.zeros(len(texts[i]), np.int8), np.zeros(len(texts[i]), np.int16))
            own, depth = labels[i]
            n = min(WINDOW, len(own) - a)
            deep = np.where(a == 0, np.arange(WINDOW)[::-1] + 1, inner)[:n]
            better = deep > depth[a : a + n]
            own[a : a + n][better] = row[:n][better]
            depth[a : a + n][better] = deep[better]
    for i, (own, _) in labels.items():
        text, taken = texts[i], bases[i]
        on = np.nonzero(own)[0]
        if not len(on):
            continue
        kinds = (own[on] - 1) // 2
        cut = np.nonzero((np.diff(on) > 1) | (np.diff(kinds) != 0) | (own[on][1:] % 2 == 1))[0] + 1
        for run, kind in zip(np.split(on, cut), kinds[np.concatenate(([0], cut))].tolist(), strict=True):
            at = _whole_words(text, int(run[0]), int(run[-1]) + 1)
            if at is None:
                continue
            a, b = at
            if plausible(kind, text[a:b]) and all(b <= s or a >= e for s, _, e in taken + found[i]):
                found[i].append((a, kind, b))
    return found


def find(docs: DataFrame, steps: int = 450) -> DataFrame:
    """Personal data in each whole text of ``docs`` (``doc_id, text``).

    Returns ``doc_id, n_email, n_ip, n_card, n_phone`` (exact patterns), ``base_sha256`` of
    their list, and ``spans`` (theirs and the network's). Null and empty texts have none.
    Repeated rows stay, and other columns are ignored. The network is trained on the driver
    (some 10,000 numbers) and sent to the executors.
    """
    net = docs.sparkSession.sparkContext.broadcast(trained(steps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            more = added_spans(net.value, texts, base)
            counts = [[sum(k == kind for _, k, _ in x) for x in base] for kind in range(4)]
            sums = [hashlib.sha256(shown(x).encode()).hexdigest() for x in base]
            spans = [shown(sorted(x + y)) for x, y in zip(base, more, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sums, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
