"""Conversation repair, phrase mining and personal data on small tables, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import conversations as cv
from lorekeep.llm import phrases, private

RANDOM = random.Random(11)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# ---------------------------------------------------------------- 11


def cheapest_by_hand(rows):
    """(cost, audit) over (initial, fault) rows, all ways kept by state."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    def grow(best):
        queue = list(best)
        while queue:
            state = queue.pop()
            for role in set(follows[state]) - {"s"}:
                way = best[state][0] + 5, best[state][1] + "I"
                if role not in best or way < best[role]:
                    best[role] = way
                    queue.append(role)
        return best

    best = grow({"": (0, "")})
    for initial, fault in rows:
        after = {}
        for state, (cost, audit) in best.items():
            ways = [(2, "D", state)]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                ways += [(more, "K", initial)] if initial and initial in follows[state] else []
                ways += [(1 + more, "R", role) for role in set(follows[state]) - {"s"}]
            for c, letter, to in ways:
                way = cost + c, audit + letter
                if to not in after or way < after[to]:
                    after[to] = way
        best = grow(after)
    return min(best[s] for s in ("", "a") if s in best)


def repair_by_hand(conv, rows):
    """The contract's columns from the damaged rows of a conversation, in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip("\x20\t\n\x0b\x0c\r")
        if not bare:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    cost, audit = cheapest_by_hand(list(zip(initials, faults, strict=True)))
    out, at = [], 0
    for letter in audit:
        before = out[-1].split(":")[0][0] if out else ""
        role = "assistant" if before == "u" else "user"
        if letter == "I":
            out.append(f"{role}:")
            continue
        _, own, text = rows[at]
        at += 1
        if letter != "D":
            out.append(f"{own if letter == 'K' else role}:{text}")
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (conv, gaps, *[faults.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest), out


def damage_by_hand(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out[conv]
        if fault == 1:
            text = ""
        elif fault == 2:
            text = re.sub("[.!?]", "", text)
        elif fault == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    said = lambda r: hashlib.md5(f"{r[1]}:{r[2]}".encode()).digest()
    return {conv: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, said(r))) for conv, own in out.items()}


def conversations(n):
    roles = ["system", "user", "assistant", "user", "assistant", "assistant", "tool", "", None, "sage", "User"]
    texts = ["Yes.", "No!", "well", " \t\n", "", None, "What? ", "a.b", "é日本。", "Done.\x0b", "cut\x85", "ok?\xa0"]
    rows = []
    for conv in range(n):
        size = RANDOM.choice([1, 2, 3, 5, 8, 13])
        for turn in range(size):
            plain = RANDOM.random() < 0.7
            role = ("user", "assistant")[turn % 2] if plain else RANDOM.choice(roles)
            text = f"Line {RANDOM.randrange(99)}." if plain else RANDOM.choice(texts)
            rows.append((conv, turn if RANDOM.random() < 0.9 else RANDOM.choice([None, 0, turn + 2, -3]), role, text))
    rows += [(None, t, "user", "a. ") for t in (None, 1, 1, 2)] + [(n, 5, "user", "Same.")] * 7
    return rows + [(n + 1, t, ("user", "assistant")[t % 2], f"Turn {t}." * (1 + t % 3)) for t in range(3000)]


def test_blocks_against_all_ways():
    rows = [[(RANDOM.choice(["s", "u", "a", "u", "a", ""]), RANDOM.choice(["", "", "", "truncated", "blank"])) for _ in range(RANDOM.randint(0, 30))] for _ in range(3000)]
    coded = lambda i, f: cv.GONE if f == "blank" else 2 + 2 * ("sua".index(i) if i else 3) + (f == "truncated")
    flat = np.array([coded(*r) for own in rows for r in own], np.uint8)
    cost, audits = cv.cheapest(flat, np.array([len(own) for own in rows]))
    assert list(zip(cost.tolist(), audits, strict=True)) == [cheapest_by_hand(own) for own in rows]


def test_repair_against_brute_force(spark, monkeypatch):
    rows = conversations(400)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("audit", F.lit("own"))
    want = {conv: repair_by_hand(conv, own) for conv, own in damage_by_hand(rows).items()}
    monkeypatch.setattr(cv, "SYMBOL_ROWS", 50)
    got = cv.digests(cv.damaged(frame))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((row for row, _ in want.values()), key=str)
    lines = defaultdict(dict)
    for r in cv.repaired(cv.damaged(frame)).collect():
        lines[r["conv_id"]][r["position"]] = f"{r['role']}:{r['text']}"
    assert {k: [v[i] for i in range(len(v))] for k, v in lines.items()} == {k: out for k, (_, out) in want.items() if out}


def test_repair_of_nothing_and_of_sound_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert cv.digests(cv.damaged(spark.createDataFrame([], schema))).count() == 0
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello."), (2, 4, "user", "Hi!")]
    got = {r["conv_id"]: (r["cost"], r["audit"], r["gaps"]) for r in cv.diagnose(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (0, "KKK", 0), 2: (2, "D", 0)}


# ---------------------------------------------------------------- 12


def phrases_by_hand(rows, least, first):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for k in range(1, 5):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in found.items():
            score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= 80 * a for b in longer):
                ranked.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def texts(n):
    vocabulary = ["of", "The", "the", "kind", "regards", "new", "York", "état", "ß", "日本", "a|b", "x\x85y", "\x00z", "end"]
    rows = []
    for _ in range(n):
        own = RANDOM.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=RANDOM.randint(0, 40))
        gaps = [RANDOM.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "? !"]) for _ in own]
        rows.append((RANDOM.choice(["en", "de", None, "und", ""]), "".join(w + g for w, g in zip(own, gaps, strict=True))))
    return rows + [("en", None), (None, ""), ("de", " \t\n.."), ("en", "kind regards new York " * 500), ("fr", "x" * 50_000)] + [("en", "kind regards")] * 40


@pytest.mark.parametrize("slice_bytes", [1 << 20, 300])
def test_phrases_against_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(phrases, "SLICE_BYTES", slice_bytes)
    rows = texts(400)
    frame = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit("own") for c in ("w1", "n", "rank", "phrase")})
    for least, first in ((30, 2000), (5, 7)):
        got = phrases.mine(frame, least, first)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == phrases_by_hand(rows, least, first)
    assert phrases.mine(frame.limit(0)).count() == 0
    assert phrases.mine(frame, 10**6).count() == 0


def test_slices_cover_every_window_once():
    data = np.frombuffer(" ".join(RANDOM.choice(["a", "bb.", "ccc\n", "d" * 30]) for _ in range(500)).encode(), np.uint8)
    whole = phrases.Words(data)
    got = []
    for part, own in phrases.slices(data, 37):
        words = phrases.Words(part)
        names = words.distinct.to_pylist()
        mine = int(np.searchsorted(words.starts, own))
        assert len(words.ids) >= min(mine + 3, len(words.ids))
        got += [names[i] for i in words.ids[:mine]]
    names = whole.distinct.to_pylist()
    assert got == [names[i] for i in whole.ids]


def test_a_full_filter_only_costs_time(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MAX_FILTER_BITS", 1 << 10)
    rows = texts(200)
    got = phrases.mine(spark.createDataFrame(rows, "lang string, text string"), 5)
    assert sorted(map(tuple, got.collect())) == phrases_by_hand(rows, 5, 2000)


# ---------------------------------------------------------------- 13

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_by_hand(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            if kind == "ip" and any(int(part) > 255 for part in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and sum(v // 10 + v % 10 for v in doubled) % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def data_texts(n):
    bits = ["a@b.c", "x.y_z@m-1.de.", "@", ".", "..", "-", " ", "+", "1", "255", "256", "007", "1.2.3.4", "4111 1111 1111 1111", "+1 (017) 555-7713", "(", ")", "é", "日", "\n", "_d", "%"]
    out = ["".join(RANDOM.choices(bits, k=RANDOM.randint(1, 14))) for _ in range(n)]
    card = "4111111111111111"
    return out + ["", card, card * 2, " ".join(card), "1" * 5000, "1." * 5000, "a" * 5000 + "@", "a@" * 2000, "+1" * 900, "+" + "1 " * 900, "5" + " 5" * 13, "0000000000001.2.3.4"]


def test_base_spans_against_the_patterns():
    for text in data_texts(4000):
        assert private.base_spans(text) == base_by_hand(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 10**6, "a" * 10**6, "1." * 500_000, "a." * 500_000 + "@", "@" * 10**6, "a@a" * 300_000, "+1" * 500_000):
        private.base_spans(text)


def test_gradients_of_the_network():
    draw = np.random.default_rng(3)
    inputs = draw.integers(0, private.SYMBOLS, (7, 3)).astype(np.uint8)
    weights = [draw.normal(0, 0.5, s).astype(np.float64) for s in ((private.SYMBOLS, 64), (16, 64), (64,))]
    goal = draw.normal(0, 1, (7, 3, 16))
    loss = lambda: float((private._lstm(inputs, weights)[0] * goal).sum())
    states, kept = private._lstm(inputs, weights)
    for own, grad in zip(weights, private._lstm_gradient(inputs, weights, kept, goal), strict=True):
        for _ in range(6):
            at = tuple(RANDOM.randrange(n) for n in own.shape) if own.shape[0] != private.SYMBOLS else (int(inputs[RANDOM.randrange(7), 0]), RANDOM.randrange(64))
            held, small = own[at], 1e-2
            own[at] = held + small
            up = loss()
            own[at] = held - small
            down = loss()
            own[at] = held
            assert abs((up - down) / (2 * small) - grad[at]) < 2e-2 * max(1, abs(grad[at]))


def test_crf_against_all_paths():
    from itertools import product

    draw = np.random.default_rng(4)
    scores, moves = draw.normal(0, 1, (4, 2, private.LABELS)), draw.normal(0, 1, (private.LABELS,) * 2)
    gold = draw.integers(0, private.LABELS, (4, 2))
    gold[0] = [0, 1]
    total = 0
    marginal = np.zeros_like(scores)
    for k in range(2):
        value = lambda path: private.FIRST[path[0]] + sum(scores[t, k, x] for t, x in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False))  # noqa: B023, E731
        paths = list(product(range(private.LABELS), repeat=4))
        weight = np.exp([value(p) for p in paths])
        total += np.log(weight.sum()) - value(tuple(gold[:, k]))
        for p, w in zip(paths, weight / weight.sum(), strict=True):
            for t, x in enumerate(p):
                marginal[t, k, x] += w
        for t in range(4):
            marginal[t, k, gold[t, k]] -= 1
    loss, d_scores, _ = private.crf_gradient(scores, moves, gold)
    assert abs(loss - total) < 1e-6 and np.allclose(d_scores, marginal, atol=1e-6)


@pytest.fixture(scope="module")
def tagger():
    words = ["".join(RANDOM.choice("abcdefghij") for _ in range(RANDOM.randint(2, 7))) for _ in range(300)]
    windows = [" ".join(RANDOM.choices(words, k=30)) for _ in range(800)]
    return private.train(private.labelled(windows, rounds=4), passes=7), words


def test_model_on_held_out_spans(tagger):
    model, words = tagger
    draw, met, false = random.Random(77), Counter(), 0
    for kind in private.KINDS * 60:
        span = private.written_span(draw, kind)
        text = " ".join(draw.choices(words, k=60))
        at = text.index(" ", 150) + 1
        whole = text[:at] + span + " " + text[at:]
        if private.holds(kind, span) and not private.base_spans(span):
            found = private.spans_of([whole], model)[0]
            met[kind, (kind, at, at + len(span)) in [s[:3] for s in found]] += 1
        other = text[:at] + private.other_numbers(draw) + " " + text[at:]
        false += any(not s[3] for s in private.spans_of([other], model)[0])
    assert false <= 3
    assert met["ip", True] >= 0.8 * (met["ip", True] + met["ip", False]) > 0
    assert met["phone", True] >= 0.5 * (met["phone", True] + met["phone", False]) > 0


def test_a_phone_that_a_number_hides(tagger):
    text = "call +1 (017) 555-7713 10.20.30.40 or not"
    assert ("phone", 5, 22) not in private.base_spans(text)
    assert ("phone", 5, 22, False) in [s[:4] for s in private.spans_of([text], tagger[0])[0]]


def test_a_span_that_runs_into_a_base_span_is_cut_there():
    text = "call +1 (017) 555-7713 10.20.30.40 or not"
    base = private.base_spans(text)
    assert base == [("ip", 23, 34)]
    got = private.reconciled(text, [private.Found("phone", 5, 34, 29.0, False)], base)
    assert got == [("phone", 5, 22, pytest.approx(18.0))]
    assert private.reconciled(text, [private.Found("phone", 8, 30, 29.0, False)], [("ip", 10, 20), ("ip", 15, 34)]) == []
    assert private.reconciled(text, [private.Found("ip", 23, 34, 9.0, False)], base) == []


def test_spans_are_found_wherever_windows_begin(tagger):
    model, words = tagger
    text = "call (017) 555-7713 or mail a.b@c.de from 10[.]0[.]0[.]7"
    met = 0
    for moved in range(1, 120, 7):
        before = " ".join(words)[:moved]
        whole = before + " " + text + " " + " ".join(words[:20])
        found = {(s[0], whole[s[1] : s[2]]) for s in private.spans_of([whole], model)[0]}
        assert ("email", "a.b@c.de") in found
        met += {("phone", "(017) 555-7713"), ("ip", "10[.]0[.]0[.]7")} <= found
    assert met >= 12  # of 17


def test_pieces_of_windows_are_put_together():
    whole, part = private.Found("ip", 90, 104, 9.0, False), private.Found("phone", 3, 9, 5.0, False)
    text = " " * 90 + "10[.]0[.]0[.]7" + " " * 10
    assert private.reconciled(text, [whole, part, private.Found("ip", 90, 96, 4.0, True)], []) == [("ip", 90, 104, 9.0)]
    pieces = [private.Found("ip", 90, 98, 4.0, True), private.Found("ip", 96, 104, 6.0, True)]
    assert private.reconciled(text, pieces, []) == [("ip", 90, 104, 6.0)]
    assert private.reconciled(text, pieces, [("email", 100, 110)]) == []


def test_find_on_odd_rows(spark, tagger, monkeypatch):
    rows = [(i, t) for i, t in enumerate([None, "", "é 日 a@b.de", "a@b.de", "a@b.de", "x" * 9000 + " 1.2.3.4 ", *data_texts(200)])] + [(None, "1.2.3.4")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("spans", "n_ip", "kind")})
    got = private.digests(private.find(frame, None)).collect()
    want = []
    for i, text in rows:
        base = base_by_hand(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        want.append((i, *[sum(k == kind for k, _, _ in base) for kind in PATTERNS], hashlib.sha256(joined.encode()).hexdigest(), joined))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    both = private.digests(private.find(frame, tagger[0])).collect()
    assert sorted(tuple(r)[:-1] for r in both if r[0] is not None) == sorted(w[:-1] for w in want if w[0] is not None)
    assert private.find(frame.limit(0), tagger[0]).count() == 0
    masked = {r["doc_id"]: r["masked"] for r in private.masked(private.find(frame, None)).collect()}
    assert masked[2] == "é 日 [email]" and masked[1] == "" and masked[0] is None
    monkeypatch.setattr(private, "train", lambda windows: len(windows))
    assert private.fit(frame) > 0 and private.fit(frame.limit(0)) == 8
