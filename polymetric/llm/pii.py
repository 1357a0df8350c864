"""Personal data: exact patterns, and a linear-chain conditional random field beside them.

The field labels tokens by word-shape features of the token and its two
neighbours.  It is trained on the driver from a small labelled table, and its
spans are added where no pattern matched: addresses with "[at]" and "[dot]",
network addresses with bracketed dots, phone numbers without a plus sign, card
numbers with dots or slashes between their groups.  Spans of digits must pass the pattern's own check (Luhn, number of
digits, parts up to 255), so numbers that only look alike stay out.

Decoding does not visit plain words.  ``gap`` proves on the trained weights
that the best path through a stretch of plain tokens of that length is
"nothing" in its middle, whatever surrounds it, so a text is cut there; only
the pieces around tokens that are not plain are decoded, many at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_or_empty, without

KINDS = ("email", "ip", "card", "phone")

# ---- patterns -------------------------------------------------------------

# Each is linear in the text: nothing starts inside a run that it has tried.
_at = re.compile("@").finditer
_local = re.compile(r"[A-Za-z0-9._%+-]*").match
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_digits = re.compile(r"[0-9]").findall


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d)
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def card_ok(s: str) -> bool:
    digits = "".join(_digits(s))
    return 13 <= len(digits) <= 19 and luhn(digits)


def ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def phone_ok(s: str) -> bool:
    return 9 <= len(_digits(s)) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain; the local part is read backwards from each @."""
    end = 0
    for m in _at(text):
        at = m.start()
        if at < end:
            continue
        start = at
        while start > end and (text[start - 1] in _LOCAL):
            start -= 1
        if start < at and (d := _domain(text, at + 1)):
            end = d.end()
            yield start, end
        # A failed @ is no part of a later local part, so nothing before it is read again.


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start; matches that fail their check are dropped."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, m.start(), m.end()) for m in _ip(text) if ip_ok(m[0])]
    out += [(2, m.start(), m.end()) for m in _card(text) if card_ok(m[0])]
    out += [(3, m.start(), m.end()) for m in _phone(text) if phone_ok(m[0])]
    return out


# ---- the field ------------------------------------------------------------

LABELS = ("O", *KINDS)
#: A token is a stretch without white space.  One that is longer than this, or
#: has more digits than a card number can have (a phone number has less), is cut
#: at punctuation before the field sees it, so what is inside is found too.
LONG, MOST_DIGITS = 80, 19
#: No address is longer: 64 characters, the at sign and 255, with room for spelling them out.
ADDRESS = 328
#: Places in a text that can hold something else than plain words.
_odd = re.compile(r"[0-9@\[({]").finditer
_space = re.compile(r"[ \t-\r]").search
_marks = re.compile(r"[\[({](?:at|dot)[\])}]", re.I)
_token = re.compile(r"[^ \t-\r]+")
#: Cuts of a long token, each used where the one before leaves it long: at what
#: separates entities, at what no entity holds, and between words and numbers.
_cuts = (
    re.compile(r"[^ \t-\r,;|]+").finditer,
    re.compile(r"[\w@.%+\-/\[\](){}]+").finditer,
    re.compile(r"[0-9+(][0-9()+./_-]*|[^0-9+(]+").finditer,
)
_slash = re.compile(r"[^/]+").finditer
_bracketed = re.compile(r"[0-9]{1,3}(?:\s?[\[({](?:\.|dot)[\])}]\s?[0-9]{1,3}){3}", re.I).fullmatch
_number = re.compile(r"[0-9]+").findall


def token_shape(token: str) -> str:
    return PLAIN if plain(token) else shape(token)


def shape(token: str) -> str:
    """Letters a, digits 0, with runs of one kind cut to a length class; the other characters as they are."""
    if len(token) > LONG:
        return "long"
    core = token.strip(".,;:!?\"'")
    if _marks.fullmatch(core):
        return "<" + core[1:-1].lower() + ">"
    out = []
    for run in re.finditer(r"[0-9]+|[^\W\d_]+|.", core):
        s = run[0]
        if "0" <= s[0] <= "9":
            out.append("0" * min(len(s), 5))
        elif s[0].isalpha():
            out.append("a")
        else:
            out.append(s[0])
    return "".join(out)


_zeros = re.compile(r"0+").sub


def plain(token: str) -> bool:
    return len(token) <= LONG and not (any(c in "0123456789@" for c in token) or _marks.search(token))


PLAIN, EDGE = "a", "|edge|"


def features(shapes: list[str], left: str = EDGE, right: str = EDGE) -> list[list[str]]:
    """For each token: its shape, its neighbours', and coarser ones of its own, such as one in which all numbers are alike."""
    padded = [left, *shapes, right]
    out = []
    for i, s in enumerate(shapes, 1):
        digits, kinds = s.count("0"), "".join(sorted({c for c in s if not c.isalnum()}))
        out.append([f"s={s}", f"p={padded[i - 1]}", f"n={padded[i + 1]}", f"d={min(digits, 12)}", f"k={kinds}", f"c={_zeros('0', s)}", f"m={s[:1]}{s[-1:]}"])
    return out


def labelled_table(seed: int = 4) -> list[tuple[list[str], list[int]]]:
    """A few hundred short sequences of tokens with a label each; the same at every call."""
    rng = np.random.default_rng(seed)
    words = "please write to reach me under the office number or call again from our list before noon. Thanks, see page section item costs about total version year room line The In and then it was near with table value".split()
    names = "anna karl maria jose luis marie peter lena info contact sales office".split()
    hosts = "mail post home site work uni lab shop".split()
    tops = "com org net de fr es".split()

    def num(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def pick(xs):
        return xs[rng.integers(len(xs))]

    def card() -> str:
        body = num(15)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    def email():
        o, c = pick([("[", "]"), ("(", ")"), ("{", "}")])
        local, host, top = pick(names) + pick(["", num(2)]), pick(hosts), pick(tops)
        spelled = pick([[local, f"{o}at{c}", host, f"{o}dot{c}", top], [local, f"{o}at{c}", host, f"{o}dot{c}", top], [local, f"{o}at{c}", f"{host}.{top}"]])
        return ["".join(spelled)] if rng.random() < 0.4 else spelled

    def phone():
        a, b, c = num(3), num(3), num(4)
        return pick([[f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], [f"({a}){b}-{c}"]])

    def cardnumber():
        s, by = card(), pick(["/", ".", "_"])
        return [by.join((s[:4], s[4:8], s[8:12], s[12:]))]

    def address():
        o, c = pick([("[", "]"), ("(", ")"), ("{", "}")])
        a = [str(rng.integers(0, 10 ** int(rng.integers(1, 4))) % 256) for _ in range(4)]
        by = pick([f"{o}.{c}", f"{o}dot{c}"])
        return [by.join(a)] if rng.random() < 0.6 else [a[0], by, a[1], by, a[2], by, a[3]]

    def nothing():
        return pick([[num(4)], [num(int(rng.integers(1, 4)))], [f"{num(2)}.{num(2)}.{num(4)}"], [f"{num(4)}-{num(2)}-{num(2)}"], [f"({num(4)})"], [f"{num(1)}.{num(1)}.{num(1)}"], ["[1]"], [f"${num(3)}"], [f"{num(2)}:{num(2)}"], [f"{num(3)},{num(3)}"], [num(16)], ["(see"], ["{x}"], [f"x{num(3)}"], [f"+{num(1)}"], [f"{num(3)}%"], ["a@b"], [f'"{num(6)}abc{num(5)}"']])

    out = []
    for _ in range(420):
        tokens, labels = [], []
        for _ in range(int(rng.integers(1, 4))):
            for _ in range(int(rng.integers(1, 5))):
                tokens.append(pick(words)), labels.append(0)
            kind = int(rng.integers(0, 8))
            made, label = ((email(), 1), (cardnumber(), 3), (phone(), 4), (address(), 2))[kind] if kind < 4 else (nothing(), 0)
            tokens += made
            labels += [label] * len(made)
            if rng.random() < 0.3:
                tokens[-1] += pick([".", ","])
        for _ in range(int(rng.integers(0, 4))):
            tokens.append(pick(words)), labels.append(0)
        out.append((tokens, labels))
    return out


class Field:
    """Weights of features by label, and of steps between labels."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, steps: np.ndarray):
        self.index, self.weights, self.steps = index, weights, steps

    def emissions(self, shapes: list[str], left: str = EDGE, right: str = EDGE) -> np.ndarray:
        out = np.zeros((len(shapes), len(LABELS)))
        for i, found in enumerate(features(shapes, left, right)):
            for f in found:
                j = self.index.get(f)
                if j is not None:
                    out[i] += self.weights[j]
        return out

    def viterbi(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of a batch (sequence, place, label) padded to one length; ties to the smaller label."""
        n, most, k = emissions.shape
        score, back = emissions[:, 0].copy(), np.zeros((n, most, k), dtype=np.int8)
        for t in range(1, most):
            step = score[:, :, None] + self.steps[None]
            back[:, t] = step.argmax(axis=1)
            score = np.where((t < lengths)[:, None], step.max(axis=1) + emissions[:, t], score)
        out = np.zeros((n, most), dtype=np.int8)
        label = score.argmax(axis=1)
        for t in range(most - 1, -1, -1):
            out[:, t] = label
            label = np.where(t < lengths, back[np.arange(n), t, label], label) if t else label
        return out

    def gap(self) -> int:
        """Plain tokens after which what follows can't change what went before.

        For a stretch of that many plain tokens between plain ones, the best
        way from any label to any label passes through O in its middle.
        """
        e = self.emissions([PLAIN] * 3)[1]
        for n in range(2, 40):
            # Best score from label i to label j over n plain tokens, with and without O in the middle.
            best, free, mid = None, None, (n - 1) // 2
            for block in (None, 0):
                m = self.steps.copy()
                for t in range(n):
                    here = e.copy()
                    if block is not None and t == mid:
                        here[block] = -np.inf
                    m = (m + here)[:, :, None] + self.steps[None]
                    m = m.max(axis=1)
                if block is None:
                    best = m
                else:
                    free = m
            if (best > free + 1e-9).all():
                return n
        raise ValueError("plain words are not plain to this field")


def train(table: list[tuple[list[str], list[int]]], rounds: int = 150, decay: float = 0.02) -> Field:
    """Maximum likelihood with a Gaussian prior, by Adam on the whole table."""
    seqs = [([token_shape(t) for t in tokens], labels) for tokens, labels in table]
    names = sorted({f for s, _ in seqs for fs in features(s) for f in fs})
    index = {f: i for i, f in enumerate(names)}
    k, most = len(LABELS), max(len(s) for s, _ in seqs)
    per = len(features([PLAIN])[0])
    x = np.zeros((len(seqs), most, per), dtype=np.int64)
    y, lengths = np.zeros((len(seqs), most), dtype=np.int64), np.array([len(s) for s, _ in seqs])
    for i, (s, labels) in enumerate(seqs):
        for t, fs in enumerate(features(s)):
            x[i, t] = [index[f] for f in fs]
            y[i, t] = labels[t]
    on = np.arange(most)[None] < lengths[:, None]
    both = on[:, 1:]
    w, steps = np.zeros((len(names), k)), np.zeros((k, k))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(steps), np.zeros_like(steps)]

    def lse(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    hot = np.eye(k)[y] * on[:, :, None]
    for r in range(1, rounds + 1):
        e = w[x].sum(axis=2) * on[:, :, None]
        f, b = np.zeros((len(seqs), most, k)), np.zeros((len(seqs), most, k))
        f[:, 0] = e[:, 0]
        for t in range(1, most):
            f[:, t] = np.where(on[:, t, None], lse(f[:, t - 1, :, None] + steps[None], 1) + e[:, t], f[:, t - 1])
        for t in range(most - 2, -1, -1):
            b[:, t] = np.where(on[:, t + 1, None], lse(steps[None] + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
        z = lse(f[:, -1], 1)
        p = np.exp(f + b - z[:, None, None]) * on[:, :, None]
        pair = np.exp(f[:, :-1, :, None] + steps[None, None] + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        gw = np.zeros_like(w)
        np.add.at(gw, x[on], (hot - p)[on][:, None, :])
        gs = (hot[:, :-1, :, None] * hot[:, 1:, None, :]).sum((0, 1)) - pair.sum((0, 1))
        for v, g, i in ((w, gw - decay * w, 0), (steps, gs - decay * steps, 2)):
            state[i] = 0.9 * state[i] + 0.1 * g
            state[i + 1] = 0.999 * state[i + 1] + 0.001 * g * g
            v += 0.15 * (state[i] / (1 - 0.9**r)) / (np.sqrt(state[i + 1] / (1 - 0.999**r)) + 1e-8)
    return Field(index, w, steps)


# ---- texts ----------------------------------------------------------------


def pieces(text: str, gap: int) -> list[list[tuple[int, int]]]:
    """Token spans around tokens that are not plain, with ``gap`` tokens of either side, as far as a text goes."""
    odd, end = [], -1
    for m in _odd(text):
        if m.start() < end:
            continue
        a = m.start()
        while a > 0 and text[a - 1] not in " \t\n\x0b\x0c\r":
            a -= 1
        stop = _space(text, m.start())
        end = stop.start() if stop else len(text)
        if end - a > LONG or not plain(text[a:end]):
            odd.append((a, end))
    out: list[list[tuple[int, int]]] = []
    for a, b in odd:
        if out and a < out[-1][-1][1]:
            # Already read as context of the one before: go on from there.
            here = out[-1]
        else:
            before = _before(text, a, gap + 1)
            if out and before and before[0][0] <= out[-1][-1][0]:
                here = out[-1]
                here.extend(s for s in before if s[0] > here[-1][0])
                here.append((a, b))
            else:
                here = [*before, (a, b)]
                out.append(here)
        last = here[-1][1]
        need = gap + 1
        while need and here[need - gap - 2][0] > a:  # context that is there already
            need -= 1
        for m in _token.finditer(text, last):
            if need <= 0:
                break
            here.append(m.span())
            need -= 1
    return out


def _before(text: str, a: int, n: int) -> list[tuple[int, int]]:
    """Up to ``n`` token spans that end before ``a``; a token longer than LONG ends the context."""
    out: list[tuple[int, int]] = []
    i = a
    while len(out) < n:
        while i > 0 and text[i - 1] in " \t\n\x0b\x0c\r":
            i -= 1
        if not i:
            break
        end = i
        while i > 0 and text[i - 1] not in " \t\n\x0b\x0c\r":
            i -= 1
        out.append((i, end))
    return out[::-1]


def checked(kind: int, text: str, start: int, end: int) -> tuple[int, int] | None:
    """A decoded span without punctuation around it, if it passes its kind's check."""
    while start < end and text[start] in ".,;:!?\"'":
        start += 1
    while end > start and text[end - 1] in ".,;:!?\"'":
        end -= 1
    s = text[start:end]
    if not s:
        return None
    if kind == 0 and len(s) > ADDRESS:
        return None
    if kind == 0 and not ("@" in s or re.search(r"[\[({]at[\])}]", s, re.I)):
        return None
    if kind == 1 and not (re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", s) and ip_ok(s) or _bracketed(s) and all(int(n) <= 255 for n in _number(s))):
        return None
    if kind == 2 and not card_ok(s):
        return None
    if kind == 3 and not (phone_ok(s) and re.fullmatch(r"[+0-9(][0-9().\x20-]*[0-9]", s)):
        return None
    return start, end


def parts(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """A token with more digits than an entity can have, or longer than LONG, cut at punctuation as far as that goes."""

    def large(x: int, y: int) -> bool:
        return (y - x > LONG and any(_odd(text, x, y))) or len(_digits(text[x:y])) > MOST_DIGITS

    out = [(a, b)]
    for cut in _cuts:
        if not any(large(x, y) for x, y in out):
            return out
        out = [s for x, y in out for s in ([m.span() for m in cut(text, x, y)] or [(x, y)] if large(x, y) else [(x, y)])]
    # Slashes stand inside cards, but between numbers too.
    done = []
    for x, y in out:
        by_slash = [m.span() for m in _slash(text, x, y)] if large(x, y) else []
        whole = len(by_slash) > 1 and all(len(_digits(text[p:q])) >= 9 for p, q in by_slash)
        done += by_slash if whole else [(x, y)]
    return done


def apart(kind: int, text: str, run: list[tuple[int, int]], free: Callable[[tuple[int, int]], bool]) -> list[tuple[int, int]]:
    """Spans in a run of tokens, cut at token borders, that pass the check and are free; as many tokens as possible lie in them."""
    best: list[tuple[int, tuple[int, int] | None, int]] = [(0, None, 0)] * (len(run) + 1)
    for t in range(len(run) - 1, -1, -1):
        best[t] = (best[t + 1][0], None, t + 1)
        digits = 0
        for u in range(t, len(run)):
            digits += len(_digits(text[run[u][0] : run[u][1]])) if kind else 0
            if digits > MOST_DIGITS or (kind == 0 and run[u][1] - run[t][0] > ADDRESS):
                break
            n = u + 1 - t + best[u + 1][0]
            if n > best[t][0] and (span := checked(kind, text, run[t][0], run[u][1])) and free(span):
                best[t] = (n, span, u + 1)
    out, t = [], 0
    while t < len(run):
        _, span, t = best[t]
        out += [span] if span else []
    return out


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], field: Field, gap: int, cache: dict, split: bool = False) -> list[list[tuple[int, int, int]]]:
    """What the field finds in texts beside the spans of the patterns.

    A run of one label is a span; with ``split``, a run that is none is cut
    at token borders, and tokens at punctuation, into spans that pass.
    """
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    work = [(i, [p for a, b in spans for p in parts(t, a, b)] if split else spans) for i, t in enumerate(texts) for spans in pieces(t, gap)]
    work.sort(key=lambda x: len(x[1]))
    at = 0
    while at < len(work):
        # Batches of like lengths, bounded in tokens.
        most = len(work[min(at + 255, len(work) - 1)][1])
        n = max(1, min(256, 65_536 // most))
        some = work[at : at + n]
        at += n
        lengths = np.array([len(s) for _, s in some])
        emissions = np.zeros((len(some), lengths.max(), len(LABELS)))
        for row, (i, spans) in enumerate(some):
            text = texts[i]
            left = PLAIN if _before(text, spans[0][0], 1) else EDGE
            right = PLAIN if _token.search(text, spans[-1][1]) else EDGE
            key = (left, right, *(token_shape(text[a:b]) if b - a <= LONG else "long" for a, b in spans))
            e = cache.get(key)
            if e is None:
                e = field.emissions(list(key[2:]), left, right)
                if len(cache) < 20_000 and len(key) < 64:
                    cache[key] = e
            emissions[row, : len(spans)] = e
        labels = field.viterbi(emissions, lengths)
        for row, (i, spans) in enumerate(some):
            taken, t = base[i], 0

            def free(span: tuple[int, int], taken: list = taken) -> bool:
                return not any(a < span[1] and span[0] < b for _, a, b in taken)

            while t < len(spans):
                label, u = labels[row, t], t + 1
                if label:
                    while u < len(spans) and labels[row, u] == label:
                        u += 1
                    span = checked(int(label) - 1, texts[i], spans[t][0], spans[u - 1][1])
                    if span and free(span):
                        found[i].append((int(label) - 1, *span))
                    elif split:
                        found[i] += [(int(label) - 1, *s) for s in apart(int(label) - 1, texts[i], spans[t:u], free)]
                t = u
    return found


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(df: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """All columns of ``df`` with ``n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    The counts and the hash are of the patterns' spans, ``spans`` has the
    field's too, by kind and start.  Positions are code points of the whole
    text; a null text is empty and has no spans.  Rows are independent; an
    empty table gives an empty one.  Columns of ``df`` with these names are
    replaced.
    """
    spark = df.sparkSession
    ship(spark)
    field = field or train(labelled_table())
    known = spark.sparkContext.broadcast((field, field.gap()))  # a few thousand numbers

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, gap = known.value
        cache: dict = {}
        for batch in batches:
            rows = []
            for b, more in spans_of(batch.tolist(), model, gap, cache):
                n = [sum(1 for s in b if s[0] == k) for k in range(4)]
                rows.append((*n, hashlib.sha256(spelled(b).encode()).hexdigest(), spelled(sorted(set(b) | set(more)))))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    names = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    data = without(df, *names, "__found").withColumn("__found", look(text_or_empty(text)))
    return data.withColumns({n: F.col(f"__found.{n}") for n in names}).drop("__found")


def mask(df: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """``df`` with every span in ``text`` replaced by its kind in angle brackets; of overlapping ones, by the first.

    Null texts stay null and texts without spans stay as they are.
    """
    spark = df.sparkSession
    ship(spark)
    field = field or train(labelled_table())
    known = spark.sparkContext.broadcast((field, field.gap()))

    @F.pandas_udf("string")
    def replace(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.tolist()
            yield pd.Series([masked(t, b + more) for t, (b, more) in zip(texts, spans_of(texts, *known.value, {}))], dtype=object)

    return df.withColumn(text, F.when(F.col(text).isNotNull(), replace(text_or_empty(text))))


def spans_of(texts: list[str], field: Field, gap: int, cache: dict) -> Iterator[tuple[list, list]]:
    """The patterns' spans and the field's, for each text."""
    for i in range(0, len(texts), 256):
        some = texts[i : i + 256]
        base = [base_spans(t) for t in some]
        yield from zip(base, added_spans(some, base, field, gap, cache, split=True))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < end:  # what an overlapping span has more goes too
            end = max(end, b)
            continue
        out += [text[end:a], f"<{KINDS[kind].upper()}>"]
        end = b
    return "".join([*out, text[end:]])


def pii_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
