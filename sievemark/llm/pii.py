"""Personal data: exact base rules, and a character-level bidirectional LSTM with CRF transitions.

The base rules read the whole text in linear time. The model, trained in numpy from labelled spans
(given ones, or ones made by a seeded rule: each kind in many written forms, among words, numbers and
secrets that look alike), adds spans that the rules miss, such as ``bob (at) example.com`` or
``030/1234567``. It reads every character of every text, in windows of ``WINDOW`` that overlap by
``OVERLAP``; where windows overlap their tag scores are blended, and one Viterbi pass decodes the whole text.
Windows of many texts go through the network together, whatever their lengths.
That pass is exact and skips what can't matter: where no run of tags through a character can be worth
more than tags outside, whatever transitions bring, it is outside on a best path, so only the others are decoded.

An added span touches no base span and keeps its kind's definition: four numbers up to 255, 14 to
19 digits with their check sum, 10 to 15 digits, or an address with a name and a host.

Defined results: null text counts as empty; a text without spans has the hash of the empty string;
repeated rows each get a row; an empty table gives an empty result; other columns are ignored. Long texts
are read in parts of ``PART`` characters, with the same result.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.common import read_table, text_or_empty

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# ---- base rules ------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """The check sum: every second digit from the right doubled, digits of the results added up."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """From each at sign leftwards over local characters, so long runs cost their length once."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[Span]:
    """All base spans, by start and then by kind as listed."""
    out: list[Span] = emails(text) if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---- the model -------------------------------------------------------------------------------

#: Characters with a number of their own; others fall into classes.
_SIGNS = " \n\t@.-+()_%,:;/=\"'<>[]#*|!?&{}" + "abcdefghijklmnopqrstuvwxyz"
_CLASSES = len(_SIGNS) + 5
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
EMBED, HIDDEN, WINDOW, OVERLAP, PART, TRAINED, BOUND = 8, 12, 512, 32, 1 << 21, 96, 1.5


def codes(text: str) -> np.ndarray:
    """A small number for every character: signs and a-z as such, else digit, upper case, other letter, ..."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _table()[np.minimum(points, 256)]


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    n = len(_SIGNS)
    t = np.full(257, n + 2, np.uint8)
    for p in range(256):
        c = chr(p)
        t[p] = _SIGNS.index(c) if c in _SIGNS else n if c.isdigit() and p < 128 else n + 1 if c.isupper() and p < 128 else n + 2 if c.isalpha() else n + 3 if p == 160 else n + 4
    t[160] = _SIGNS.index(" ")
    return t


def squash(x: np.ndarray) -> np.ndarray:
    """In tanh's place: straight between -1 and 1, so it costs one comparison each way."""
    return np.clip(x, -1, 1)


def _slope(y: np.ndarray) -> np.ndarray:
    return (np.abs(y) < 1).astype(np.float64)


def _lstm(x: np.ndarray, p: dict, d: str, keep: bool) -> tuple[np.ndarray, list]:
    """x: (T, B, E). Hidden states in the order of x, and what the gradient needs."""
    steps, rows, _ = x.shape
    h, c, out, saved = np.zeros((rows, HIDDEN)), np.zeros((rows, HIDDEN)), np.empty((steps, rows, HIDDEN)), []
    pre = x @ p["W" + d] + p["b" + d]
    for t in range(steps):
        z = pre[t] + h @ p["U" + d]
        g = 0.5 + 0.5 * squash(0.5 * z[:, : 3 * HIDDEN])
        i, f, o, u = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :], squash(z[:, 3 * HIDDEN :])
        before = c
        c = f * before + i * u
        th = squash(c)
        if keep:
            saved.append((h, before, i, f, o, u, th))
        h = o * th
        out[t] = h
    return out, saved


def _lstm_back(dout: np.ndarray, x: np.ndarray, p: dict, d: str, saved: list, grad: dict) -> np.ndarray:
    dh = dc = np.zeros((x.shape[1], HIDDEN))
    every = np.empty((len(saved), x.shape[1], 4 * HIDDEN))
    for t in range(len(saved) - 1, -1, -1):
        h, before, i, f, o, u, th = saved[t]
        dh = dh + dout[t]
        dc = dc + dh * o * _slope(th)
        gates = _slope(np.concatenate([2 * i - 1, 2 * f - 1, 2 * o - 1, u], axis=1))
        dz = np.concatenate([0.25 * dc * u, 0.25 * dc * before, 0.25 * dh * th, dc * i], axis=1) * gates
        grad["U" + d] += h.T @ dz
        every[t] = dz
        dh, dc = dz @ p["U" + d].T, dc * f
    grad["W" + d] += np.einsum("tbe,tbk->ek", x, every, optimize=True)
    grad["b" + d] += every.sum((0, 1))
    return every @ p["W" + d].T


def _scores(ids: np.ndarray, p: dict, keep: bool = False):
    x = p["E"][ids.T]
    fore, saved_f = _lstm(x, p, "f", keep)
    back, saved_b = _lstm(x[::-1], p, "b", keep)
    both = np.concatenate([fore, back[::-1]], axis=2)
    return both @ p["O"] + p["c"], (x, both, saved_f, saved_b)


def _crf(s: np.ndarray, y: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of tags y (T, B), and the gradients of scores and transitions.

    Forward and backward sums run over probabilities that are scaled at every step.
    """
    steps, rows, k = s.shape
    top = s.max(axis=2, keepdims=True)
    e, x = np.exp(s - top), np.exp(trans)
    alpha, beta, scale = np.empty_like(s), np.ones_like(s), np.empty((steps, rows, 1))
    for t in range(steps):
        a = e[t] * (alpha[t - 1] @ x) if t else e[0]
        scale[t] = a.sum(1, keepdims=True)
        alpha[t] = a / scale[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = (e[t + 1] * beta[t + 1] / scale[t + 1]) @ x.T
    norm = (np.log(scale) + top).sum((0, 2))
    ds = alpha * beta
    dt = np.einsum("tbi,tbj->ij", alpha[:-1], e[1:] * beta[1:] / scale[1:], optimize=True) * x
    r = np.arange(rows)
    gold = np.take_along_axis(s, y[:, :, None], 2).sum((0, 2)) + trans[y[:-1], y[1:]].sum(0)
    ds[np.arange(steps)[:, None], r[None, :], y] -= 1
    np.subtract.at(dt, (y[:-1].ravel(), y[1:].ravel()), 1)
    return float((norm - gold).mean()), ds / rows, dt / rows


class Bounds:
    """What transitions can bring to a run of other tags that stands in for outside ones."""

    def __init__(self, trans: np.ndarray) -> None:
        rest = trans - trans[0, 0]
        self.enter, self.leave, self.inner = float(rest[0, 1:].max()), float(rest[1:, 0].max()), float(rest[1:, 1:].max())

    def gains(self, s: np.ndarray) -> np.ndarray:
        """The most that each place can bring to a run; ``s``: the highest score of another tag there, less outside's."""
        return s.astype(np.float64) + self.inner

    def undecided(self, gains: np.ndarray) -> np.ndarray:
        """The places of a whole text that lie in some run that may be worth more than outside tags.

        The best run through a place is the best sum that ends there and the best that begins there; running
        sums less their least values so far give both.
        """
        if not len(gains):
            return np.zeros(0, np.int64)
        g = gains.copy()
        g[0] += max(0.0, -self.enter)
        g[-1] += max(0.0, -self.leave)
        return np.flatnonzero(_best_ending(g) + _best_ending(g[::-1])[::-1] - g + self.enter + self.leave - self.inner > -1e-4)


def _best_ending(g: np.ndarray) -> np.ndarray:
    sums = np.cumsum(g)
    return sums - np.minimum.accumulate(np.concatenate([[0.0], sums[:-1]]))


def viterbi(s: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The tags of one best path of scores (N, K)."""
    bounds = Bounds(trans)
    s = s[:, 1:] - s[:, :1]
    rest = bounds.undecided(bounds.gains(s.max(1)))
    out = np.zeros(len(s), np.int8)
    if len(rest):
        runs = np.split(rest, np.flatnonzero(np.diff(rest) > 1) + 1)
        for run, tags in zip(runs, decode_runs([s[r] for r in runs], [r[0] > 0 for r in runs], [r[-1] < len(s) - 1 for r in runs], trans)):
            out[run] = tags
    return out


def decode_runs(runs: list[np.ndarray], after: list[bool], before: list[bool], trans: np.ndarray) -> list[np.ndarray]:
    """Best tags of runs of scores (N, K - 1) less outside's; ``after`` and ``before`` say whether a run follows or precedes an outside tag."""
    order = sorted(range(len(runs)), key=lambda k: -len(runs[k]))
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(runs)
    sizes = [len(runs[k]) for k in order]
    done, kinds = 0, len(trans)
    while done < len(order):
        # Runs of like length go together, so padding at most doubles the work.
        steps = sizes[done]
        end = min(bisect.bisect_right(sizes, -(steps // 2), lo=done, key=lambda n: -n) if steps > 1 else len(order), done + max(1, 400_000 // steps))
        part, own = order[done:end], np.array(sizes[done:end])
        done = end
        column = np.arange(len(part))
        live = np.searchsorted(-own, -np.arange(steps)).tolist()  # runs longer than each step
        best = np.zeros((steps, kinds, len(part)), np.float32)  # scores, and then the best sums that end there
        best[np.concatenate([np.arange(n) for n in own.tolist()]), 1:, np.repeat(column, own)] = np.concatenate([runs[n] for n in part])
        best[0] += np.where(np.array([after[n] for n in part]), trans[0][:, None], 0)
        for t in range(1, steps):
            best[t, :, : live[t]] += (best[t - 1, :, None, : live[t]] + trans[:, :, None]).max(0)
        last = (best[own - 1, :, column].T + np.where(np.array([before[n] for n in part]), trans[:, 0][:, None], 0)).argmax(0)
        tags = np.zeros((steps, len(part)), np.int8)
        for t in range(steps - 1, -1, -1):
            tags[t, : live[t]] = now = last[: live[t]]
            if t:
                last[: live[t]] = (best[t - 1, :, : live[t]] + trans[:, now]).argmax(0)
        for r, n in enumerate(part):
            out[n] = tags[: own[r], r]
    return out


# Frequent short words of English, German, French and Spanish, for the made examples.
_WORDS = "the of and to in is that it was for on are with as be at by this had not but from or have an they which one you we will no more if out so der die das und zu den ist von mit sich des auf nicht ein eine als auch es an werden aus er hat dass le la les de et un une du que dans qui par pour au sur pas plus el los las y se con para su lo como dot com at a mail phone call tel fax card number server host write email contact ip address".split()


def made_examples(n: int, seed: int = 7, size: int = TRAINED) -> list[tuple[str, list[Span]]]:
    """Labelled windows: each kind in many forms, and words, numbers, dates, secrets and versions without one."""
    g = random.Random(seed)
    below = lambda a, b: a + int(g.random() * (b - a))
    pick = lambda *a: a[int(g.random() * len(a))]
    digits = lambda k: f"{below(0, 10**k):0{k}d}"
    hexes = lambda k: f"{g.getrandbits(4 * k):0{k}x}"

    def word(a: int = 1, b: int = 4) -> str:
        return "".join(pick("b", "c", "d", "f", "g", "h", "l", "m", "n", "p", "r", "s", "t", "st", "tr", "ch", "") + pick("a", "e", "i", "o", "u", "ei", "ou", "é", "ä") + pick("", "", "n", "r", "s", "t") for _ in range(below(a, b + 1)))

    def plain(a: int = 1, b: int = 3) -> str:
        return "".join(c for c in word(a, b) if c.isascii())

    def prose() -> str:
        own = [pick(*_WORDS) if g.random() < 0.45 else word() for _ in range(below(1, 7))]
        return " ".join(w.capitalize() if g.random() < 0.12 else w for w in own) + pick("", "", "", ".", ",", " -", ":", "!", "?")

    def email() -> str:
        name = pick(plain(), word(), f"{plain()}.{plain()}", f"{plain()}_{plain()}", f"{plain()}{digits(2)}")
        name = name.capitalize() if g.random() < 0.1 else name
        host, top = pick(plain(2, 3), word(2, 3), f"{plain()}-{plain()}"), pick("com", "org", "net", "de", "fr", "es", "example.com", "co.uk")
        at = pick("@", "@", "@", " (at) ", " [at] ", "(at)", "[at]", " at ", " {at} ", " @ ")
        dot = pick(".", ".", " (dot) ", " [dot] ", "[dot]", " dot ") if at != "@" else "."
        return f"{name}{at}{host}{' dot ' if at == ' at ' else dot}{top}"

    def card() -> str:
        body = pick("4", "5", "37", "6") + digits(below(12, 16))
        number = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        sep = pick("", " ", "-", ".", ".", "/", "\u00a0", "  ", " - ")
        return sep.join(number[i : i + 4] for i in range(0, len(number), 4))

    def phone() -> str:
        n, a, b, c = below(1, 99), digits(3), digits(3), digits(4)
        return pick(
            f"+{n} ({a}) {b}-{c}", f"+{n}{digits(10)}", f"+{n} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"0{digits(2)}/{digits(7)}", f"0{digits(3)}/{digits(6)}",
            f"00{n} {digits(2)} {digits(7)}", f"0{digits(2)} {digits(4)} {digits(4)}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"+{n} (0){digits(2)} / {b} {c}", f"1-{a}-{b}-{c}", f"0{digits(3)}-{digits(7)}",
        )

    def ip() -> str:
        four = [str(below(1, 255)) for _ in range(4)]
        return pick(".", ".", "[.]", " . ", "(.)").join(four) if g.random() < 0.8 else f"{four[0]}.{four[1]}.{four[2]}[.]{four[3]}"

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}

    def noise() -> str:
        year = f"{pick(19, 20)}{digits(2)}"
        return pick(
            f"{digits(2)}:{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"{year}-0{below(1, 9)}-1{digits(1)}", f"1{digits(1)}/0{below(1, 9)}/{year}", f"{below(1, 30)}.{below(1, 12)}.{year}", f"v{digits(1)}.{below(0, 20)}.{digits(1)}",
            f"{digits(3)},{digits(3)}", f"{below(1, 99)},{digits(3)},{digits(3)}", f"${digits(2)}.{digits(2)}", f'= "{hexes(40)}"', f"password={hexes(18)}", f"AKIA{hexes(16).upper()}", f"sk_live_{hexes(24)}", f"ghp_{hexes(36)}", f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}",
            f"CC BY {below(1, 5)}.0.", f"version {below(1, 9)}.", digits(below(1, 9)), f"{digits(4)} {digits(4)}", f"{digits(2)} {digits(2)} {digits(2)}", f"@{plain()}", f"{digits(3)}.{digits(3)}.{digits(3)}", digits(25), f"978-{digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}",
            f"{digits(3)}-{digits(4)}", f"pp. {digits(2)}-{digits(3)}", f"({year})", f"http://{plain()}.com/{plain()}/{digits(4)}", f"{digits(1)}.{digits(5)}", f"{plain()} at the {plain()} dot", f"we met at {word()} at {digits(1)}", f"{plain()}[{digits(1)}]", f"#{digits(5)}", f"{digits(2)} x {digits(2)}", f"{digits(4)}/{digits(2)}", f"({plain()}) {plain()}", "| " * below(1, 4), "$%&#@! " * below(1, 3),
        )

    out = []
    for _ in range(n):
        parts, spans, length = [], [], 0
        while length < size:
            kind = pick(*KINDS, "", "", "", "", "noise", "noise", "noise")
            piece = makers[kind]() if kind in makers else noise() if kind else prose()
            if kind in makers:
                spans.append((kind, length, length + len(piece)))
            piece += pick(" ", " ", " ", " ", ", ", ". ", "\n", "; ", ") ", " | ")
            parts.append(piece)
            length += len(piece)
        shift = below(0, max(1, length - size + 1))
        text = "".join(parts)[shift : shift + size]
        out.append((text, [(k, max(a - shift, 0), min(b - shift, size)) for k, a, b in spans if a - shift < size and b - shift > 0]))
    return out


def train(examples: list[tuple[str, list[Span]]], steps: int = 450, rows: int = 128, rate: float = 0.025, seed: int = 3, size: int = TRAINED) -> dict[str, np.ndarray]:
    """Parameters fitted by Adam to the likelihood of the labelled windows' tags; transitions within ``BOUND``."""
    ids, tags = np.zeros((len(examples), size), np.int64), np.zeros((len(examples), size), np.int64)
    for n, (text, spans) in enumerate(examples):
        c = codes(text[:size])
        ids[n, : len(c)] = c
        for kind, a, b in spans:
            k = KINDS.index(kind)
            tags[n, a:b] = 2 + 2 * k
            tags[n, a] = 1 + 2 * k
    g = np.random.default_rng(seed)
    shape = {"E": (_CLASSES, EMBED), "O": (2 * HIDDEN, TAGS), "c": (TAGS,), "T": (TAGS, TAGS)}
    for d in "fb":
        shape |= {"W" + d: (EMBED, 4 * HIDDEN), "U" + d: (HIDDEN, 4 * HIDDEN), "b" + d: (4 * HIDDEN,)}
    p = {n: g.normal(0, 0.3, s) if len(s) > 1 else np.zeros(s) for n, s in shape.items()}
    first, second = {n: np.zeros(s) for n, s in shape.items()}, {n: np.zeros(s) for n, s in shape.items()}
    for step in range(1, steps + 1):
        own = g.integers(0, len(examples), rows)
        s, (x, both, saved_f, saved_b) = _scores(ids[own], p, True)
        _, ds, dt = _crf(s, tags[own].T, p["T"])
        grad = {n: np.zeros(v) for n, v in shape.items()}
        grad["T"], grad["c"] = dt, ds.sum((0, 1))
        grad["O"] = np.einsum("tbh,tbk->hk", both, ds)
        dboth = ds @ p["O"].T
        dx = _lstm_back(dboth[:, :, :HIDDEN], x, p, "f", saved_f, grad)
        dx += _lstm_back(dboth[::-1, :, HIDDEN:], x[::-1], p, "b", saved_b, grad)[::-1]
        np.add.at(grad["E"], ids[own].T, dx)
        scale = min(1.0, 5.0 / (1e-9 + np.sqrt(sum((v * v).sum() for v in grad.values()))))
        for n in p:
            first[n] = 0.9 * first[n] + 0.1 * scale * grad[n]
            second[n] = 0.99 * second[n] + 0.01 * (scale * grad[n]) ** 2
            p[n] = p[n] - rate * (0.3 + 0.7 * (1 - step / steps)) * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)
        p["T"] = np.clip(p["T"], -BOUND, BOUND)
    return p


@lru_cache(maxsize=1)
def default_model() -> dict[str, np.ndarray]:
    return train(made_examples(3000))


class Reader:
    """A model made ready for many windows at once: single precision, features first."""

    def __init__(self, p: dict[str, np.ndarray]) -> None:
        self.embed = np.ascontiguousarray(p["E"].T.astype(np.float32))
        self.sides = []
        out, base = p["O"][:, 1:] - p["O"][:, :1], p["c"][1:] - p["c"][0]
        for d, side, shift in ("f", out[:HIDDEN], base), ("b", out[HIDDEN:], 0 * base):
            gates = np.concatenate([p["U" + d], p["W" + d], p["b" + d][None, :]])
            gates[:, : 3 * HIDDEN] *= 0.25  # a gate is half of 1 + squash of half its input
            gates[-1, : 3 * HIDDEN] += 0.5
            tags = np.concatenate([side, np.zeros((EMBED, TAGS - 1)), shift[None, :]])
            self.sides.append(np.ascontiguousarray(np.concatenate([gates, tags], axis=1).T.astype(np.float32)))
        self.trans = p["T"].astype(np.float32)
        self.bounds = Bounds(self.trans)

    def scores(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(T, TAGS - 1, B): scores, less outside's, of the character codes (T, B) of windows of falling ``sizes``.

        Each direction begins at an end of a window, wherever that is, so a window needs no padding; what
        lies beyond a window's end has no meaning.
        """
        steps, rows = ids.shape
        live = np.searchsorted(-sizes, -np.arange(steps)).tolist()  # windows longer than each step
        out = np.zeros((steps, TAGS - 1, rows), np.float32)
        for t, s in self._pass(self.sides[0], ids, range(steps), live[:1] + live):
            out[t, :, : s.shape[1]] = s
        for t, s in self._pass(self.sides[1], ids, range(steps - 1, -1, -1), live[::-1]):
            out[t, :, : s.shape[1]] += s
        return out

    def _pass(self, whole: np.ndarray, ids: np.ndarray, order: range, live: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """One direction: each place in ``order`` with its scores (TAGS - 1, windows).

        One product a step gives the next gates and the scores of the states before them, so it takes in the
        windows of both places; ``live`` numbers them.
        """
        rows, gates = ids.shape[1], 4 * HIDDEN
        every_x, every_z, every_c = np.zeros((HIDDEN + EMBED + 1, rows), np.float32), np.empty((len(whole), rows), np.float32), np.zeros((HIDDEN, rows), np.float32)
        every_x[-1] = 1
        # The bounds of squash for each gate, along the windows: numpy takes longer over single numbers.
        high, low = np.ones((1, rows), np.float32), np.repeat(np.array([0, 0, 0, -1], np.float32), rows).reshape(4, 1, rows)
        last, m = None, 0
        for t, n in zip(order, live):
            x, z, c = every_x[:, :n], every_z[:, :n], every_c[:, :n]
            np.take(self.embed, ids[t, :n], axis=1, out=x[HIDDEN:-1], mode="clip")
            np.matmul(whole, x, out=z)
            if last is not None:
                yield last, z[gates:, : min(m, n)]
            last, m = t, n
            h, i, f, o, u = x[:HIDDEN], z[:HIDDEN], z[HIDDEN : 2 * HIDDEN], z[2 * HIDDEN : 3 * HIDDEN], z[3 * HIDDEN : gates]
            four = z[:gates].reshape(4, HIDDEN, n)
            np.minimum(four, high[:, :n], out=four)
            np.maximum(four, low[:, :, :n], out=four)
            u *= i
            c *= f
            c += u
            np.minimum(c, high[:, :n], out=h)
            np.maximum(h, low[3, :, :n], out=h)
            h *= o
        if last is not None:
            yield last, whole[gates:] @ every_x[:, :m]


_RAMP = (np.arange(1, OVERLAP + 1) / (OVERLAP + 1)).astype(np.float32)


def windows(size: int, low: int = 0, high: int | None = None) -> list[tuple[int, int]]:
    """The overlapping windows (start, end) of a text of ``size`` characters that meet [low, high)."""
    stride, high = WINDOW - OVERLAP, size if high is None else high
    last = max(0, -(-(size - WINDOW) // stride))
    return [(j * stride, min(size, j * stride + WINDOW)) for j in range(max(0, (low - WINDOW) // stride + 1), min(last, (high - 1) // stride) + 1)]


class Scores:
    """Blended scores, less outside's, of the parts (codes of a whole text, from, to), one after the other.

    Windows go together by length, whatever text they are of, so few are read alone.
    """

    def __init__(self, parts: list[tuple[np.ndarray, int, int]], reader: Reader, block: int = 1024) -> None:
        offsets = np.cumsum([0] + [hi - lo for _, lo, hi in parts]).tolist()
        jobs = [(n, a, b) for n, (own, lo, hi) in enumerate(parts) if hi > lo for a, b in windows(len(own), lo, hi)]
        order = sorted(range(len(jobs)), key=lambda j: jobs[j][1] - jobs[j][2])
        self.top = np.zeros(offsets[-1], np.float32)  # the highest score of each place
        # Where a window's own places begin (its end is the next one's), and where its first place would be.
        self.starts = np.array([offsets[n] + max(a, parts[n][1]) - parts[n][1] for n, a, _ in jobs], np.int64)
        self.zeros = np.array([offsets[n] + a - parts[n][1] for n, a, _ in jobs], np.int64)
        self.rank = np.empty(len(jobs), np.int64)
        self.rank[order] = np.arange(len(jobs))
        self.block, self.blocks = block, []
        # A window but the last of its text is whole; its end is blended into the beginning of the next.
        ends = np.zeros((OVERLAP, TAGS - 1, sum(b - a == WINDOW for _, a, b in jobs)), np.float32)
        for k in range(0, len(jobs), block):
            part = [jobs[j] for j in order[k : k + block]]
            sizes = np.array([b - a for _, a, b in part])
            ids = np.zeros((len(part), sizes[0]), np.uint8)
            for r, (n, a, b) in enumerate(part):
                ids[r, : b - a] = parts[n][0][a:b]
            self.blocks.append(reader.scores(np.ascontiguousarray(ids.T).astype(np.intp), sizes))
            if whole := int((sizes == WINDOW).sum()):
                ends[:, :, k : k + whole] = self.blocks[-1][-OVERLAP:, :, :whole]
        ramp = _RAMP[:, None, None]
        for k, s in zip(range(0, len(jobs), block), self.blocks):
            part = order[k : k + block]
            if later := [r for r, j in enumerate(part) if j and jobs[j - 1][0] == jobs[j][0]]:
                s[:OVERLAP, :, later] = s[:OVERLAP, :, later] * ramp + ends[:, :, self.rank[[part[r] - 1 for r in later]]] * ramp[::-1]
            top = np.ascontiguousarray(s.max(1).T)
            for r, j in enumerate(part):
                n, a, b = jobs[j]
                own, lo, hi = parts[n]
                x, y = max(a, lo), min(b if b == len(own) else b - OVERLAP, hi)
                if x < y:
                    self.top[offsets[n] + x - lo : offsets[n] + y - lo] = top[r, x - a : y - a]

    def at(self, places: np.ndarray) -> np.ndarray:
        """(N, TAGS - 1): the scores of N places."""
        job = np.searchsorted(self.starts, places, side="right") - 1
        step, rank, out = places - self.zeros[job], self.rank[job], np.empty((len(places), TAGS - 1), np.float32)
        order = np.argsort(rank, kind="stable")
        cuts = np.searchsorted(rank[order], self.block * np.arange(len(self.blocks) + 1)).tolist()
        for s, a, b in zip(self.blocks, cuts, cuts[1:]):
            here = order[a:b]
            out[here] = s[step[here], :, rank[here] % self.block]
        return out


def _parts(texts: list[str]) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, from, to) of about ``PART`` characters; parts of a longer text are alone."""
    now: list[tuple[int, int, int]] = []
    size = 0
    for n, text in enumerate(texts):
        if now and size + len(text) > PART:
            yield now
            now, size = [], 0
        if len(text) > PART:
            yield from ([(n, lo, min(len(text), lo + PART))] for lo in range(0, len(text), PART))
            continue
        now.append((n, 0, len(text)))
        size += len(text)
    if now:
        yield now


def text_tags(texts: list[str], reader: Reader) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, tags) of the characters of each text that are not sure to be outside.

    A text of several parts is read twice: for what its places can gain, then for the scores of those that
    are undecided; so memory goes with a part, but for a number a character.
    """
    bounds = reader.bounds
    runs: list[np.ndarray] = []
    after: list[bool] = []
    before: list[bool] = []
    owner: list[tuple[int, np.ndarray]] = []

    def keep(n: int, places: np.ndarray, scores: np.ndarray) -> None:
        cuts = np.flatnonzero(np.diff(places) > 1) + 1
        for r, x in zip(np.split(places, cuts), np.split(scores, cuts)):
            if len(r):
                runs.append(x)
                after.append(bool(r[0] > 0))
                before.append(bool(r[-1] < len(texts[n]) - 1))
                owner.append((n, r))

    for group in _parts(texts):
        if len(group) == 1 and group[0][2] - group[0][1] < len(texts[group[0][0]]):
            n, lo, _ = group[0]
            if lo == 0:
                keep(n, *_long_text(texts[n], reader))
            continue
        s = Scores([(codes(texts[n]), lo, hi) for n, lo, hi in group], reader)
        gains, at = bounds.gains(s.top), 0
        rests = []
        for n, lo, hi in group:
            rests.append(bounds.undecided(gains[at : at + hi - lo]) + at)
            at += hi - lo
        scores, done, at = s.at(np.concatenate(rests)), 0, 0
        for (n, lo, hi), rest in zip(group, rests):
            keep(n, rest - at, scores[done : done + len(rest)])
            done += len(rest)
            at += hi - lo
    out: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
    for (n, r), tags in zip(owner, decode_runs(runs, after, before, reader.trans)):
        out[n].append((r, tags))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int8))
    return [(np.concatenate([r for r, _ in own]), np.concatenate([t for _, t in own])) if own else none for own in out]


def _long_text(text: str, reader: Reader) -> tuple[np.ndarray, np.ndarray]:
    own = codes(text)
    cuts = [(lo, min(len(own), lo + PART)) for lo in range(0, len(own), PART)]
    gains = np.concatenate([reader.bounds.gains(Scores([(own, lo, hi)], reader).top) for lo, hi in cuts])
    rest, found = reader.bounds.undecided(gains), []
    for lo, hi in cuts:
        a, b = np.searchsorted(rest, [lo, hi])
        if b > a:
            found.append(Scores([(own, lo, hi)], reader).at(rest[a:b] - lo))
    return rest, np.concatenate([np.zeros((0, TAGS - 1), np.float32), *found])


_NUMBER = re.compile(r"[0-9]+")


def _plausible(kind: str, text: str) -> bool:
    """The definition of a kind, whatever the form it is written in."""
    numbers = _NUMBER.findall(text)
    digits = "".join(numbers)
    if kind == "email":
        return len(text) >= 6 and ("@" in text or "at" in text.lower()) and "." in text.lower().replace("dot", ".")
    if kind == "ip":
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return a, b


def model_spans(texts: list[str], p: dict[str, np.ndarray] | Reader) -> list[list[Span]]:
    """Spans that the model finds in each whole text and that keep their kind's definition."""
    reader = p if isinstance(p, Reader) else Reader(p)
    out: list[list[Span]] = [[] for _ in texts]
    for n, (places, tags) in enumerate(text_tags(texts, reader)):
        inside = np.flatnonzero(tags)
        run: list | None = None
        for at, tag in [*zip(places[inside].tolist(), tags[inside].tolist()), (None, 0)]:
            kind = (tag - 1) // 2
            if run and at == run[2] and kind == run[0] and tag % 2 == 0:
                run[2] = at + 1
                continue
            if run:
                a, b = _trimmed(texts[n], run[1], run[2])
                if a < b and _plausible(KINDS[run[0]], texts[n][a:b]):
                    out[n].append((KINDS[run[0]], a, b))
            run = [kind, at, at + 1] if at is not None else None
    return out


def all_spans(texts: list[str], p: dict[str, np.ndarray] | Reader) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, base and added spans) of each text."""
    base = [base_spans(t) for t in texts]
    out = []
    for own, more in zip(base, model_spans(texts, p)):
        added = [s for s in more if all(s[2] <= b[1] or s[1] >= b[2] for b in own)]
        out.append((own, ordered([*own, *added])))
    return out


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _by_size(batch: pa.RecordBatch, most: int = PART) -> Iterator[pa.RecordBatch]:
    """Slices of (id, text) batches with about ``most`` bytes, or one text."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
        if i > start and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """doc_id, counts of base spans, their hash, and all spans (kind:start:end), a row per document."""
    p = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(p)
        for batch in batches:
            for part in _by_size(batch):
                found = all_spans(part.column(1).to_pylist(), reader)
                counts = [pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS]
                hashes = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, hashes, pa.array([listed(every) for _, every in found], pa.string())], names=[c.split()[0] for c in RESULT.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, RESULT)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(doc_id, text) with every span replaced by its kind in brackets."""
    p = model or default_model()

    def mask(text: str, spans: list[Span]) -> str:
        parts, at = [], 0
        for kind, a, b in spans:
            if a >= at:
                parts += [text[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        return "".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(p)
        for batch in batches:
            for part in _by_size(batch):
                texts = part.column(1).to_pylist()
                clean = [mask(t, every) for t, (_, every) in zip(texts, all_spans(texts, reader))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(clean, pa.string())], names=["doc_id", "text"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, text string")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(read_table(spark, sf_dir, "documents"))
