"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that finds what is written otherwise."""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import arrow_map

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48
TAUGHT = 64  # length of the windows it is trained on
SLICE_CHARS = STRIDE << 14
LABELS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
HIDDEN = 16
RUN_WINDOWS = 256  # windows decoded together: their gates fit the cache of a core
# Symbols: ASCII as it is, then a letter, a digit, white space and anything else beyond it, and the padding.
SYMBOLS, PAD = 133, 132

# The base patterns. Possessive runs find what greedy ones find, in linear time.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
TRIGGER = re.compile(r"[0-9@]|[\[(]at[\])]")
WRITTEN_AT = re.compile(r"[\[(]at[\])]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + k % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def small_parts(text: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in DIGITS.findall(text))


def is_card(text: str) -> bool:
    digits = "".join(DIGITS.findall(text))
    return 14 <= len(digits) <= 19 and luhn(digits)


def is_phone(text: str) -> bool:
    return 10 <= sum(map(len, DIGITS.findall(text))) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: a run of local characters up to an at sign, and no earlier than the last address's end."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", end if found else at + 1)


def base_spans(text: str, checked: bool = True) -> list[Span]:
    """What the fixed patterns find, by start and kind; ``checked=False`` keeps those that look right but fail their check."""
    out = [("email", a, b) for a, b in emails(text)]
    for kind, pattern, check in (("ip", IP, small_parts), ("card", CARD, is_card), ("phone", PHONE, is_phone)):
        for found in pattern.finditer(text):
            if check(found.group()) or not checked and (kind == "ip" or kind == "card" and 14 <= sum(map(len, DIGITS.findall(found.group()))) <= 19):
                out.append((kind, *found.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# Exact checks of what the model finds.
ANY_EMAIL = re.compile(r"[^\s@,;:<>()\[\]]+(?:@|\x20@\x20|\x20?[\[(]at[\])]\x20?)[^\s@,;:<>()\[\]]+(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[^\W_][\w-]*)+")
ANY_IP = re.compile(r"[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)|\x20\.\x20)[0-9]{1,3}){3}")
ANY_CARD = re.compile(r"[0-9](?:[\x20./_-]{0,3}[0-9]){13,18}")
ANY_PHONE = re.compile(r"(?:\+|\(|[0-9])[\x20()./0-9-]+[0-9]")


def holds(kind: str, text: str) -> bool:
    if kind == "email":
        return ANY_EMAIL.fullmatch(text) is not None
    if kind == "ip":
        return ANY_IP.fullmatch(text) is not None and small_parts(text)
    if kind == "card":
        return ANY_CARD.fullmatch(text) is not None and is_card(text)
    # A plain number is no phone: groups are needed, the first of them no year.
    return ANY_PHONE.fullmatch(text) is not None and is_phone(text) and len(DIGITS.findall(text)) >= 3


# ---------------------------------------------------------------- labelled spans


def _digits(draw: random.Random, n: int) -> str:
    return "".join(draw.choice("0123456789") for _ in range(n))


def _word(draw: random.Random, least: int = 2, most: int = 9) -> str:
    return "".join(draw.choice("abcdefghijklmnopqrstuvwxyzäéñ") for _ in range(draw.randint(least, most)))


def written_span(draw: random.Random, kind: str) -> str:
    """One more way to write data of a kind: as the base patterns have it, or otherwise."""
    if kind == "email":
        at, dot = draw.choice([("@", ".")] * 3 + [(" @ ", "."), (" (at) ", "."), ("[at]", "."), (" [at] ", " [dot] "), ("(at)", "(dot)")])
        name = _word(draw) + draw.choice(["", "." + _word(draw), str(draw.randint(1, 99)), "_" + _word(draw)])
        return name + at + draw.choice(["mail", "post", _word(draw)]) + draw.choice(["", str(draw.randint(1, 9))]) + dot + draw.choice(["com", "org", "net", "de", "fr", "example" + dot + "com"])
    if kind == "ip":
        return draw.choice([".", ".", ".", "[.]", "(.)", " . "]).join(str(draw.randint(0, 255)) for _ in range(4))
    if kind == "card":
        sizes = draw.choice([(4, 4, 4, 4)] * 3 + [(4, 6, 5), (16,), (15,), (4, 4, 4, 4, 3)])
        return draw.choice([" ", "-", "", ".", "/", "  "]).join(_digits(draw, n) for n in sizes)
    country = draw.choice(["+1", "+49", "+33", "+34", "0049", "001", "1"])
    gap = draw.choice([" ", "-", ".", "/"])
    a, b, c = _digits(draw, 3), _digits(draw, 3), _digits(draw, 4)
    plain = [f"({a}) {b}-{c}", f"{a}{gap}{b}{gap}{c}", f"0{a}{gap}{b}{c}{gap}{draw.randint(0, 9)}", f"({a}){b}{gap}{c}"]
    return draw.choice([f"{country} ", f"{country}{gap}", "", ""]) + draw.choice(plain)


def other_numbers(draw: random.Random) -> str:
    """Numbers and signs that are no one's data."""
    y, m, d = draw.randint(1900, 2030), draw.randint(1, 12), draw.randint(1, 28)
    return draw.choice(
        [
            f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{m}/{d}/{y}", f"{y}-{m:02}-{d:02} {d:02}:{m:02}:00", f"{y}-{y + 4}",
            f"version {m}.{d}", f"v{m}.{d}.{y % 10}", f"CC BY-NC {m}.0.", f"${draw.randint(1, 9)},{_digits(draw, 3)}.{_digits(draw, 2)}", f"3.{_digits(draw, 6)}",
            _digits(draw, draw.randint(1, 12)), f"{_digits(draw, 2)} {_digits(draw, 3)} {_digits(draw, 3)}", f"978-{m}-{_digits(draw, 2)}-{_digits(draw, 6)}-{d % 10}",
            f'token = "{"".join(draw.choice("0123456789abcdef") for _ in range(40))}"', "AKIA" + "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)),
            "password=" + "".join(draw.choice("0123456789abcdef") for _ in range(16)), f"{_word(draw)}@{_word(draw)}", f"@{_word(draw)}", f"{_word(draw)}-{_digits(draw, 3)}-{_digits(draw, 3)}",
            "1 2 3 4 5 6 7 8", f"{draw.randint(1, 99)}%", f"§ {m}.{d}", f"{_digits(draw, 4)}:{_digits(draw, 4)}:{_digits(draw, 4)}", f"#{_digits(draw, 6)}",
        ]
    )


def labelled(windows: list[str], seed: int = 1, rounds: int = 4) -> list[tuple[str, list[Span]]]:
    """Windows with their spans: the base spans they hold, and at a blank in most of them one or two more, or numbers, drawn here.

    Windows in which a phone pattern runs into other numbers are left out, since nothing says where the phone ends.
    """
    draw, out = random.Random(seed), []
    plain = [w for w in windows if all(is_phone(m.group()) for m in PHONE.finditer(w))]
    for text in (plain or ["", " "]) * rounds:
        spans = base_spans(text, checked=False)
        gaps = [k for k, c in enumerate(text) if c == " " and not any(a <= k < b for _, a, b in spans)]
        if gaps and draw.random() < 0.8:
            at = draw.choice(gaps) + 1
            new, made = "", []
            for _ in range(1 if draw.random() < 0.7 else 2):
                kind = draw.choice([*KINDS, "", "", ""])
                part = written_span(draw, kind) if kind else other_numbers(draw)
                made += [(kind, at + len(new), at + len(new) + len(part))] if kind else []
                new += part + " "
            text = text[:at] + new + text[at:]
            spans = [(k, a + len(new) * (a >= at), b + len(new) * (a >= at)) for k, a, b in spans] + made
        # Mostly around a span, sometimes anywhere; what the edge cuts is left as it is.
        near = draw.choice(spans)[1] - draw.randrange(TAUGHT // 2) if spans and draw.random() < 0.8 else draw.randint(0, max(0, len(text) - TAUGHT))
        begin = max(0, min(near, len(text) - TAUGHT))
        out.append((text[begin : begin + TAUGHT], [(k, max(0, a - begin), min(TAUGHT, b - begin)) for k, a, b in spans if b > begin and a < begin + TAUGHT]))
    return out


# ---------------------------------------------------------------- model


@lru_cache(maxsize=1)
def _symbol_table() -> np.ndarray:
    """Symbol of each code point of the basic plane."""
    table = np.full(1 << 16, 131, np.uint8)
    table[:128] = np.arange(128)
    for code in range(128, 1 << 16):
        char = chr(code)
        table[code] = 128 if char.isalpha() else 129 if char.isdigit() else 130 if char.isspace() else 131
    return table


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _symbol_table()[np.minimum(codes, 0xFFFF)]


class Tagger(NamedTuple):
    """Weights: per direction the input (symbols x gates), state (hidden x gates) and bias; the output layer; the transitions.

    Gates stand in the order input, forget, output, candidate.
    """

    forward: tuple[np.ndarray, np.ndarray, np.ndarray]
    backward: tuple[np.ndarray, np.ndarray, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    transitions: np.ndarray


ALLOWED = np.array([[to % 2 == 1 or to == 0 or frm in (to, to - 1) for to in range(LABELS)] for frm in range(LABELS)])
FIRST = np.array([0.0 if to % 2 == 1 or to == 0 else -1e4 for to in range(LABELS)], np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def _lstm(inputs: np.ndarray, weights: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, list]:
    """States (time, batch, hidden) over symbols (time, batch), and what the gradient needs."""
    table, recurrent, bias = weights
    size = recurrent.shape[0]
    state = memory = np.zeros((inputs.shape[1], size), np.float32)
    states, kept = np.empty((*inputs.shape, size), np.float32), []
    table = table + bias
    for t, own in enumerate(inputs):
        gates = table[own] + state @ recurrent
        three = _sigmoid(gates[:, : 3 * size])
        i, f, o = three[:, :size], three[:, size : 2 * size], three[:, 2 * size :]
        g = np.tanh(gates[:, 3 * size :])
        before = memory
        memory = f * memory + i * g
        out = np.tanh(memory)
        kept.append((state, before, i, f, o, g, out))
        state = states[t] = o * out
    return states, kept


def _lstm_gradient(inputs: np.ndarray, weights, kept: list, grad: np.ndarray) -> list[np.ndarray]:
    table, recurrent, bias = weights
    d_recurrent, all_gates = np.zeros_like(recurrent), np.empty((*inputs.shape, table.shape[1]), np.float32)
    d_state = d_memory = np.zeros_like(kept[0][0])
    for t in range(len(inputs) - 1, -1, -1):
        state, before, i, f, o, g, out = kept[t]
        d_state = d_state + grad[t]
        d_memory = d_memory + d_state * o * (1 - out * out)
        d_gates = all_gates[t]
        np.concatenate([d_memory * g * i * (1 - i), d_memory * before * f * (1 - f), d_state * out * o * (1 - o), d_memory * i * (1 - g * g)], 1, out=d_gates)
        d_recurrent += state.T @ d_gates
        d_state, d_memory = d_gates @ recurrent.T, d_memory * f
    # The rows of each symbol are summed as a product with its indicator.
    d_table = (inputs.reshape(-1) == np.arange(len(table))[:, None]).astype(np.float32) @ all_gates.reshape(-1, table.shape[1])
    return [d_table, d_recurrent, d_table.sum(0)]


def emissions(model: Tagger, inputs: np.ndarray) -> np.ndarray:
    """Label scores (time, batch, labels) of symbols (time, batch)."""
    ahead, _ = _lstm(inputs, model.forward)
    behind, _ = _lstm(inputs[::-1], model.backward)
    return np.concatenate([ahead, behind[::-1]], 2) @ model.out + model.out_bias


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def crf_gradient(scores: np.ndarray, transitions: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log likelihood of the labels, and its gradients by scores and by transitions."""
    steps, batch, _ = scores.shape
    ahead, behind = np.empty_like(scores), np.zeros_like(scores)
    ahead[0] = scores[0] + FIRST
    for t in range(1, steps):
        ahead[t] = _log_sum(ahead[t - 1][:, :, None] + transitions, 1) + scores[t]
    for t in range(steps - 2, -1, -1):
        behind[t] = _log_sum(transitions + (scores[t + 1] + behind[t + 1])[:, None, :], 2)
    total = _log_sum(ahead[-1], 1)
    d_scores = np.exp(ahead + behind - total[None, :, None])
    edges = ahead[:-1, :, :, None] + transitions + (scores[1:] + behind[1:])[:, :, None, :] - total[None, :, None, None]
    d_transitions = np.exp(edges).sum((0, 1))
    rows, columns = np.arange(steps)[:, None], np.arange(batch)[None]
    right = scores[rows, columns, gold].sum() + transitions[gold[:-1], gold[1:]].sum()
    d_scores[rows, columns, gold] -= 1
    np.add.at(d_transitions, (gold[:-1], gold[1:]), -1)
    return float(total.sum() - right), d_scores, d_transitions


def _encoded(windows: list[tuple[str, list[Span]]]) -> tuple[np.ndarray, np.ndarray]:
    inputs, gold = np.full((TAUGHT, len(windows)), PAD, np.uint8), np.zeros((TAUGHT, len(windows)), np.int64)
    for k, (text, spans) in enumerate(windows):
        inputs[: len(text), k] = symbols(text)
        for kind, a, b in spans:
            label = 1 + 2 * KINDS.index(kind)
            gold[a, k] = label
            gold[a + 1 : b, k] = label + 1
    return inputs, gold


def train(windows: list[tuple[str, list[Span]]], passes: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 1) -> Tagger:
    """Fit the tagger by Adam; the same windows give the same weights."""
    draw = np.random.default_rng(seed)
    inputs, gold = _encoded(windows)

    def direction() -> list[np.ndarray]:
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1
        return [draw.normal(0, s, (n, 4 * HIDDEN)).astype(np.float32) for n, s in ((SYMBOLS, 0.3), (HIDDEN, 0.2))] + [bias]

    params = [*direction(), *direction(), draw.normal(0, 0.2, (2 * HIDDEN, LABELS)).astype(np.float32), np.zeros(LABELS, np.float32)]
    params.append(np.where(ALLOWED, 0, -1e4).astype(np.float32))
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, steps = 0, passes * -(-len(windows) // batch)
    for _ in range(passes):
        order = draw.permutation(len(windows))
        for at in range(0, len(order), batch):
            own, labels = inputs[:, order[at : at + batch]], gold[:, order[at : at + batch]]
            ahead, kept = _lstm(own, params[:3])
            behind, kept_back = _lstm(own[::-1], params[3:6])
            both = np.concatenate([ahead, behind[::-1]], 2)
            _, d_scores, d_transitions = crf_gradient(both @ params[6] + params[7], params[8], labels)
            d_both = d_scores @ params[6].T
            gradients = _lstm_gradient(own, params[:3], kept, d_both[:, :, :HIDDEN])
            gradients += _lstm_gradient(own[::-1], params[3:6], kept_back, d_both[::-1, :, HIDDEN:])
            gradients += [np.einsum("tbh,tbl->hl", both, d_scores), d_scores.sum((0, 1)), np.where(ALLOWED, d_transitions, 0)]
            step += 1
            now = rate * (1 - 0.9 * step / steps) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for k, gradient in enumerate(gradients):
                gradient = gradient / own.shape[1]
                first[k] = 0.9 * first[k] + 0.1 * gradient
                second[k] = 0.999 * second[k] + 0.001 * gradient * gradient
                params[k] = (params[k] - now * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return Tagger(tuple(params[:3]), tuple(params[3:6]), *params[6:])


def decode(model: Tagger, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best labels (time, batch) by Viterbi, and the label scores; padding takes no label."""
    scores = emissions(model, inputs)
    scores[inputs == PAD, 1:] = -1e4
    best = scores[0] + FIRST
    back = np.empty(scores.shape, np.uint8)
    for t in range(1, len(scores)):
        ways = best[:, :, None] + model.transitions
        back[t] = ways.argmax(1)
        best = ways.max(1) + scores[t]
    labels = np.empty(inputs.shape, np.uint8)
    labels[-1] = best.argmax(1)
    columns = np.arange(inputs.shape[1])
    for t in range(len(scores) - 1, 0, -1):
        labels[t - 1] = back[t, columns, labels[t]]
    return labels, scores


# ---------------------------------------------------------------- texts


class Found(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    cut: bool


def _windows(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """Start and symbols of the windows that hold a digit or an at sign, be it written out: without one there is no data of these kinds.

    Windows overlap by half, so all that is no longer than that stands whole in one of them.
    """
    for begin in range(0, len(text), SLICE_CHARS):
        part = text[begin : begin + SLICE_CHARS + WINDOW]
        if not TRIGGER.search(part):
            continue
        own = symbols(part)
        hits = np.flatnonzero(((own >= 48) & (own <= 57)) | (own == 64))
        hits = np.append(hits, np.array([m.start() for m in WRITTEN_AT.finditer(part)], np.int64)) // STRIDE
        places = np.unique(np.concatenate([hits, hits - 1]))
        for k in places[(places >= 0) & (places < SLICE_CHARS // STRIDE)].tolist():
            yield begin + k * STRIDE, own[k * STRIDE : k * STRIDE + WINDOW]


def _candidates(model: Tagger, held: list[tuple[int, int, np.ndarray]], lengths: list[int], out: list[list[Found]]) -> None:
    """Decode windows (text, start, symbols) together and hand the spans to their texts."""
    inputs = np.full((WINDOW, len(held)), PAD, np.uint8)
    for k, (_, _, own) in enumerate(held):
        inputs[: len(own), k] = own
    labels, scores = decode(model, inputs)
    opens = np.argwhere((labels.T % 2) == 1)
    for k, a in opens.tolist():
        number, start, own = held[k]
        label = int(labels[a, k])
        b = a + 1
        while b < WINDOW and labels[b, k] == label + 1:
            b += 1
        # How much better the span is than no label in its place.
        path = [label] + [label + 1] * (b - a - 1)
        gain = float(scores[np.arange(a, b), k, path].sum() - scores[a:b, k, 0].sum())
        steps = [(int(labels[a - 1, k]), label)] if a else []
        steps += [(x, y) for x, y in zip(path, path[1:], strict=False)]
        gain += sum(float(model.transitions[x, y]) for x, y in steps)
        cut = a == 0 and start > 0 or b == WINDOW and start + b < lengths[number]
        out[number].append(Found(KINDS[(label - 1) // 2], start + a, start + b, gain, cut))


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in " .,;:-/'\"":
        a += 1
    while b > a and text[b - 1] in " .,;:-/'\"(":
        b -= 1
    return a, b


def covered(base: list[Span]) -> list[list[int]]:
    """Starts and ends of the runs that base spans cover."""
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return [starts, ends]


def outside(a: int, b: int, runs: list[list[int]]) -> Iterator[tuple[int, int]]:
    """What the covered runs leave of a span."""
    starts, ends = runs
    k = bisect_right(ends, a)
    while k < len(starts) and starts[k] < b:
        if a < starts[k]:
            yield a, starts[k]
        a = ends[k]
        k += 1
    if a < b:
        yield a, b


def reconciled(text: str, found: list[Found], base: list[Span]) -> list[tuple[str, int, int, float]]:
    """The added spans of a text: those of all windows, pieces of one span put together, checked, and of the overlapping ones those
    with the greatest sum of gains; none overlaps a base span, what runs into one is cut there."""
    whole: dict[Span, float] = {}
    joined: list[list] = []
    for own in sorted(found, key=lambda f: (f.kind, f.start, f.end)):
        if not own.cut:
            whole[own[:3]] = max(own.score, whole.get(own[:3], own.score))
        if joined and joined[-1][0] == own.kind and own.start <= joined[-1][2] and (own.cut or joined[-1][4]):
            last = joined[-1]
            joined[-1] = [own.kind, last[1], max(last[2], own.end), max(last[3], own.score), own.cut or last[4]]
        else:
            joined.append(list(own))
    for kind, a, b, score, cut in joined:
        if cut:
            whole.setdefault((kind, a, b), score)
    fits, runs = [], covered(base)
    for (kind, a, b), score in whole.items():
        a, b = trimmed(text, a, b)
        for x, y in outside(a, b, runs) if score > 0 else ():
            share = (y - x) / (b - a)
            x, y = trimmed(text, x, y)
            if holds(kind, text[x:y]) and not (x and text[x - 1].isalnum()) and not (y < len(text) and text[y].isalnum()):
                fits.append((kind, x, y, score * share))
    fits.sort(key=lambda f: (f[2], f[1]))
    ends, best = [f[2] for f in fits], [(0.0, ())]
    for k, own in enumerate(fits):
        before = best[bisect_right(ends, own[1], 0, k)]
        best.append(max(best[-1], (before[0] + own[3], (before, own)), key=lambda b: b[0]))
    out, chain = [], best[-1]
    while chain[1]:
        chain, own = chain[1]
        out.append(own)
    return out[::-1]


def spans_of(texts: list[str], model: Tagger | None) -> list[list[tuple[str, int, int, bool, float]]]:
    """(kind, start, end, base, gain) of each text, by start and kind; positions are code points."""
    base = [base_spans(text) for text in texts]
    added: list[list[Found]] = [[] for _ in texts]
    if model is not None:
        lengths, held = [len(t) for t in texts], []
        for number, text in enumerate(texts):
            for start, own in _windows(text):
                held.append((number, start, own))
                if len(held) == RUN_WINDOWS:
                    _candidates(model, held, lengths, added)
                    held = []
        if held:
            _candidates(model, held, lengths, added)
    out = []
    for text, own, more in zip(texts, base, added, strict=True):
        spans = [(*s, True, 0.0) for s in own]
        spans += [(k, a, b, False, gain) for k, a, b, gain in reconciled(text, more, own)] if more else []
        out.append(sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))
    return out


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,gain:double>>"


def fit(docs: DataFrame, max_windows: int = 1_500, max_docs: int = 5_000) -> Tagger:
    """A tagger from at most about ``max_docs`` documents, chosen by a hash of their text, and of those at most ``max_windows`` windows.

    Each such document gives the windows around its base spans, or else one window; on the driver a drawn span or number is
    written into most of them. The work of fitting does not grow with the table, nor do the weights.
    """
    share = min(1.0, max_docs / max(1, docs.count()))
    own = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(max(1, int(share * (1 << 20)))))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch.column(0).to_pylist():
            draw = random.Random(text or "")
            places = [a for _, a, _ in base_spans(text or "", checked=False)] or [draw.randrange(len(text or " "))]
            for a in places[:20]:
                begin = max(0, a - draw.randrange(WINDOW // 2, WINDOW))
                out.append((text or "")[begin : begin + 2 * WINDOW])
        return pa.RecordBatch.from_arrays([pa.array(out)], names=["window"])

    windows = arrow_map(own, cut, "window string").distinct().orderBy(F.xxhash64("window"), "window").limit(max_windows)
    return train(labelled([r["window"] for r in windows.collect()]))


def find(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """docs with a column ``spans`` (one of that name is replaced): kind, start, end (code points, end exclusive), base, gain.

    Base spans, by the fixed patterns, always stand; the model (None: patterns only) adds spans that overlap none of them and pass an exact check
    of their kind. Null and empty texts have none. Only windows with a digit or an at sign are read by the network, in whole texts
    of any length; a text is cut into slices, so memory follows the text and not the number of its windows. No shuffle; repeated rows are alike.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        kept = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "spans"}
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("gain", pa.float64())]))
        names = ("kind", "start", "end", "base", "gain")
        made = [[dict(zip(names, s, strict=True)) for s in own] for own in spans_of(texts, model)]
        return pa.RecordBatch.from_pydict(kept | {"spans": pa.array(made, kind)})

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "spans"]
    return arrow_map(docs, each, ", ".join([*fields, f"spans {SPANS}"]))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the hash of their list, and the list of all spans."""
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.expr(f"size(filter(spans, s -> s.base AND s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def masked(found: DataFrame) -> DataFrame:
    """``find``'s rows with each span of the text replaced by its kind in brackets; of overlapping spans the first one is shown."""
    step = lambda acc, s: F.struct(
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"]).alias("out"),
        F.greatest(acc["at"], s["end"]).alias("at"),
    )
    done = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)
    return found.withColumn("__done", done).withColumn("masked", F.concat("__done.out", F.expr("substr(text, __done.at + 1)"))).drop("__done")
