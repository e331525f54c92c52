"""The training-data operators on small tables: odd rows, and brute-force versions of what they do."""

import base64
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lorekeep.llm import bpe, lm, mixing, near, neighbours, quality, shards, token_counts, toxicity, urls
from lorekeep.llm.common import fold

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "toxicity string, block string, slot string, kept string, ids string, score string, __h string"
RANDOM = random.Random(3)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = ["".join(RANDOM.choice("abcdefghij") for _ in range(RANDOM.randint(2, 7))) for _ in range(400)]


def prose(n: int) -> str:
    return " ".join(RANDOM.choice(WORDS) for _ in range(n))


LONG, BASE = prose(30_000), prose(120)
TEXTS = [
    None, "", " \n\t", "one", "a b c d", BASE, BASE, BASE + " end", BASE.replace(" ", "  "), "x" * 9_000, LONG,
    "naïve ßüéè 日本語 🎉🎉 <|endoftext|>\r\n\x1c\x85   it's", "a!! b!! c!!\n" * 40, "a!! b!! c!!\n" * 40,
    *[prose(80) for _ in range(20)],
]
ROWS = [(i, t, "en", "s0" if i % 3 else None, 1) for i, t in enumerate(TEXTS)]
ROWS += [(None, BASE, None, None, None), (5, BASE, "en", "s0", 1), (6, "same id, other text", "en", "s9", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    clash = [f.split()[0] for f in CLASH.split(", ")]
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("own") for c in clash})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---------------------------------------------------------------- 1


def test_pfair_cycle_never_deviates_by_a_block(spark):
    shares = [7, 3, 1, 1, 12]
    frame = spark.createDataFrame([(shares,)], "shares array<long>")
    cycle = frame.select(mixing._cycle(F.col("shares"), F.lit(sum(shares)).cast("long")).alias("c")).first()["c"]
    taken = Counter()
    for slot, source in enumerate(cycle + cycle, 1):
        taken[source] += 1
        for i, share in enumerate(shares):
            assert abs(taken[i] - share * slot / sum(shares)) < 1
    assert [taken[i] for i in range(5)] == [2 * s for s in shares]


def test_mixing_places_every_row_once(spark, docs, nothing):
    got = mixing.mix(docs, block=4, bucket=5).collect()
    assert sorted(r["position"] for r in got) == list(range(len(ROWS)))
    assert Counter(r["source"] for r in got) == Counter(r[3] for r in ROWS)
    blocks = {(r["source"], r["block"]): r["slot"] for r in got}
    assert sorted(blocks.values()) == list(range(len(blocks)))
    assert mixing.mix(nothing).count() == 0


def test_mixing_follows_given_shares(spark):
    rows = [(i, f"text {i}", "en", "a" if i < 900 else "b", 1) for i in range(1200)]
    shares = spark.createDataFrame([("a", 3), ("b", 1)], "source string, share long")
    got = sorted(mixing.mix(spark.createDataFrame(rows, SCHEMA), shares, block=10, bucket=100).collect(), key=lambda r: r["position"])
    taken = 0
    for n, row in enumerate(got, 1):
        taken += row["source"] == "a"
        assert abs(taken - 0.75 * n) < 10 + 10 * 0.75


# ---------------------------------------------------------------- 2

RULES = [urls.HostRule("com", "/", "allow"), urls.HostRule("example.com", "/en/", "block"), urls.HostRule("net", "/es/", "block")]


def test_fixed_url_rules(spark):
    cases = {
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "no scheme/com": ("", "", None, "allow"),
        "http://A.Example.COM/en/x?q#f": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "https://example.com/fr/": ("example.com", "/fr/", "com/", "allow"),
        "https://notexample.com?/en/": ("notexample.com", "", None, "allow"),
        "x://y.net/es/://z": ("y.net", "/es/://z", "net/es/", "block"),
        "x://ÄB.net#/es/": ("Äb.net", "", None, "allow"),
    }
    frame = spark.createDataFrame([(i, u, "own") for i, u in enumerate(cases)], "page_id long, url string, verdict string")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(frame, RULES, []).collect()}
    assert got == cases


def test_rules_are_mined_from_labels_and_matched(spark):
    rows = [(i, f"https://{'casino-win' if i % 4 == 0 else 'news'}.example.org/{'en' if i % 3 else 'de'}/{i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = pages.select("page_id", (F.col("page_id") % 4 == 0).alias("block"))
    mined = urls.mine(pages, labels)
    assert {rule.tokens for rule in mined} == {("host=casino",), ("host=win",)} and all(r.confidence == 1 for r in mined)
    fresh = spark.createDataFrame([(1, "http://win.example.org/a"), (2, "http://winner.example.org/a")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(fresh, [], mined).collect()} == {1: "block", 2: "allow"}
    assert urls.mine(pages, labels.limit(0)) == []


def test_evidence_for_a_rule_does_not_depend_on_the_table(spark):
    pages = spark.range(30_000).select(
        F.col("id").alias("page_id"), F.expr("IF(id < 20, 'https://spam.example.org/', 'https://news.example.org/') || id").alias("url")
    )
    labels = pages.select("page_id", (F.col("page_id") < 20).alias("block"))
    for n in (100, 30_000):
        assert {r.tokens for r in urls.mine(pages.where(F.col("page_id") < n), labels)} == {("host=spam",)}


def test_copies_of_a_long_url_give_short_rules(spark):
    words = [chr(97 + i // 26) + chr(97 + i % 26) + "q" for i in range(60)]
    hot, clean = (f"https://{site}.example.org/" + "/".join(own) for site, own in (("spam", words[:30]), ("news", words[30:])))
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.expr(f"IF(id < 25, '{hot}', '{clean}')").alias("url"))
    mined = urls.mine(pages, pages.select("page_id", (F.col("page_id") < 25).alias("block")))
    assert sorted(r.tokens for r in mined) == sorted([("host=spam",), *((f"path={w}",) for w in words[:30])])
    assert all(r.confidence == 1 and r.support == 25 / 60 for r in mined)


@pytest.mark.parametrize("n", [18, 25])
def test_variants_of_a_long_url_give_short_rules(spark, n):
    """200 blocked pages that share n words, each without one of them: 2^n subsets occur together."""
    own = [chr(97 + i) + "zz" for i in range(n)]
    rows = [(k, "x://spam/" + "/".join(w for i, w in enumerate(own) if i != k % n)) for k in range(200)]
    rows += [(200 + k, f"x://news/{chr(97 + k % 20)}yy") for k in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    mined = urls.mine(pages, pages.select("page_id", (F.col("page_id") < 200).alias("block")))
    assert sorted(r.tokens for r in mined) == sorted([("host=spam",), *((f"path={w}",) for w in own)])
    assert all(r.confidence == 1 for r in mined)


def test_mined_rules_against_brute_force(spark):
    random = np.random.default_rng(4)
    drawn = random.random((300, 5)) < 0.5
    rows = [(i, "x://h/" + "/".join(w + v for w, on in zip("abcde", own, strict=True) if on for v in ("x", "y"))) for i, own in enumerate(drawn)]
    block = (drawn[:, 0] & drawn[:, 1]) | (drawn[:, 2] & (random.random(300) < 0.7))
    items = {"scheme=x": np.ones(300, bool), "host=h": np.ones(300, bool)}
    items |= {f"path={w}{v}": drawn[:, i] for i, w in enumerate("abcde") for v in "xy"}
    want, confidence = {}, {}
    for size in range(1, 6):
        for own in combinations(sorted(items), size):
            met = np.logical_and.reduce([items[t] for t in own])
            if (met & block).sum() >= 20:
                confidence[own] = (met & block).sum() / met.sum()
                less = max((confidence[sub] for n in range(1, size) for sub in combinations(own, n)), default=0)
                if confidence[own] >= 0.6 and confidence[own] > less:
                    want[own] = confidence[own]
    mined = urls.mine(
        spark.createDataFrame(rows, "page_id long, url string"),
        spark.createDataFrame(list(enumerate(block.tolist())), "page_id long, block boolean"),
    )
    assert {r.tokens: round(r.confidence, 9) for r in mined} == {t: round(c, 9) for t, c in want.items()} and len(mined) == len(want)


# ---------------------------------------------------------------- 3


def test_grammar_composes_context():
    model = toxicity.Model({"idio": 5.0}, {}, -4.0)
    run = toxicity.Scorer(model)
    one = lambda text: [m[0] for _, _, ms in run.clauses(text) for m in ms]
    assert one("you are an idiot") == [("insult", True, False, False)]
    assert one("He is not an IDIOTIC man. you") == [("insult", False, True, False)]
    assert one("she said idiot") == [("insult", False, False, True)]
    assert one("they will kill, destroy") == [("threat", True, False, False)]
    assert one("the film will kill time; an xidiot") == []
    plain, denied = run.score("an idiot")[0], run.score("not an idiot")[0]
    assert plain > denied > run.score("")[0]


def test_toxicity_learns_stems(spark, docs, nothing):
    rows = [(i, f"{prose(30)} {'grubnak' + RANDOM.choice('aeiou') if i % 5 == 0 else ''} {prose(5)}") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = frame.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    model = toxicity.fit(frame, labels)
    assert list(model.stems) == ["grub"]
    got = toxicity.score(frame, model).collect()
    assert all((r["toxicity"] >= 0.5) == (r["doc_id"] % 5 == 0) for r in got)
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == len(ROWS) and all(0 <= r["toxicity"] < 0.5 for r in odd)
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.fit(docs, labels.limit(0)).stems == {}


# ---------------------------------------------------------------- 4


def brute_base(text):
    own = words(text)
    windows = Counter(zip(own, own[1:], own[2:], strict=False))
    covered = {i + k for i in range(len(own) - 2) for k in range(3) if windows[tuple(own[i : i + 3])] > 1}
    lines = [line for line in (text or "").split("\n") if words(line)]
    failed = len(own) < 50 or 100 * len(covered) > 50 * len(own)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(own), sum(map(len, own)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_base_rules_against_brute_force(spark, docs):
    texts = [r[1] for r in ROWS] + ["a b c a b c a b c d\nx\nx\n \n #*|", "q w e r t y q w e " * 20 + prose(90)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[2:] for r in quality.base_counts(frame).collect()}
    assert got == {i: brute_base(t) for i, t in enumerate(texts)}


def test_quality_rejects_what_the_target_lacks(spark, docs, nothing):
    rows = [(i, prose(80) if i % 4 else " ".join(w.upper() + "!!" for w in prose(80).split())) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(frame, frame.where("doc_id % 4 > 0").select("doc_id"))
    got = {r["doc_id"]: r["kept"] for r in quality.judge(frame, model).collect()}
    assert got == {i: i % 4 > 0 for i in range(200)}
    assert quality.judge(docs, model).count() == len(ROWS)
    assert quality.judge(nothing, quality.fit(nothing, nothing.select("doc_id"))).count() == 0


# ---------------------------------------------------------------- 5


def test_nearest_against_brute_force(spark):
    generator = np.random.default_rng(1)
    held = {i: generator.standard_normal(12).astype(np.float32).tolist() for i in range(600)}
    for i in range(200, 320):
        held[i] = held[200]
    odd = {600: None, 601: [0.0] * 12, 602: [float("nan")] + [1.0] * 11, 603: [None] + [1.0] * 11, 604: [float("inf")] * 12, 605: []}
    frame = spark.createDataFrame(list((held | odd).items()), "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in neighbours.nearest(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    unit = np.array([held[i] for i in range(600)], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 600, 50):
        score = unit @ unit[q]
        best = sorted((i for i in held if i != q), key=lambda i: (-round(score[i], 12), i))[:5]
        hits += len({i for i, _ in got[q]} & set(best))
        assert all(abs(s - score[i]) < 1e-12 for i, s in got[q])
    assert set(got) == set(range(0, 600, 50)) and hits >= 0.95 * 60
    assert [i for i, _ in got[250]] == [200, 201, 202, 203, 204]
    few = neighbours.nearest(frame.where("vec_id IN (0, 7)"), F.col("vec_id") == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in few] == [(0, 1, 7)]
    assert neighbours.nearest(frame.where("vec_id >= 600"), F.lit(True)).count() == 0


def test_nearest_in_a_cluster_of_near_copies(spark):
    generator = np.random.default_rng(2)
    centre = generator.standard_normal(64)
    for kind, jitter in (("float", 8e-3), ("double", 1e-6)):
        held = centre + jitter * generator.standard_normal((2000, 64))
        held = held.astype(np.float32 if kind == "float" else np.float64).astype(np.float64)
        frame = spark.createDataFrame(list(enumerate(held.tolist())), f"vec_id long, embedding array<{kind}>")
        got = defaultdict(set)
        for r in neighbours.nearest(frame, F.col("vec_id") % 40 == 0).collect():
            got[r["query_id"]].add(r["vec_id"])
        unit = held / np.linalg.norm(held, axis=1, keepdims=True)
        # The square of the distance orders as the cosine does, and keeps more digits.
        apart = {q: ((unit - unit[q]) ** 2).sum(1) for q in range(0, 2000, 40)}
        hits = sum(len(got[q] & set(np.argsort(d)[1:6].tolist())) for q, d in apart.items())
        assert set(got) == set(apart) and hits >= 0.95 * 250


# ---------------------------------------------------------------- 6, 7

ALPHABET = "aaaabcdeé ß\n\t  \x1c\x1f\x85\xa0 　'stre 123٣六!!##$🎉日本語ـ́‍"
FUZZ = ["".join(RANDOM.choice(ALPHABET) for _ in range(RANDOM.randint(0, 60))) for _ in range(400)]


def test_token_counts_equal_the_library(spark, docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    long = ["".join(RANDOM.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (399, 401, 5_000, 100_000)]
    long += ["é" * 900, "aab" * 2_000, "=-" * 2_000, *["".join(RANDOM.choices(["the", "ing", "tion", "a", "e"], k=300)) for _ in range(40)]]
    texts = [t for t in TEXTS if t is not None] + FUZZ + ["<|endoftext|>" * 3, "ab" * 700, "a" * 3000, *long]
    assert token_counts.RankMerger(path).count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = token_counts.count_tokens(docs, path).collect()
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ROWS)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert token_counts.count_tokens(nothing, path).count() == 0


def test_transducer_equals_the_library_and_round_trips(spark, docs, nothing):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = [t for t in TEXTS if t is not None] + FUZZ
    assert bpe.Encoder(path).encode(texts).to_pylist() == library.encode_ordinary_batch(texts)
    got = bpe.round_trip(docs, path).collect()
    assert all(r["decoded"] == (r["text"] or "") and r["n_replaced"] == 0 for r in got)
    assert bpe.round_trip(nothing, path).count() == 0
    assert bpe.decode(bpe.encode(docs, path), path).where("decoded <> coalesce(text, '')").count() == 0


def test_arcs_made_together_equal_the_library(monkeypatch):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    draw = random.Random(7)
    texts = FUZZ + ["".join(chr(draw.randrange(128)) for _ in range(draw.randint(0, 60))) for _ in range(300)]
    texts += ["".join(draw.choices(["the", "ing", "tion", "é", "ß", "e", "Ç", " "], k=40)) for _ in range(200)]
    want = library.encode_ordinary_batch(texts)
    for few, followed in ((0, 1), (2, 3), (10_000, 4096)):
        monkeypatch.setattr(bpe, "FEW", few)
        monkeypatch.setattr(bpe, "FOLLOWED", followed)
        assert bpe.Encoder(path).encode(texts).to_pylist() == want


def test_often_used_chunks_stay_known(monkeypatch):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for limits in ({"CACHE": 40}, {"CACHE_IDS": 100}):
        with monkeypatch.context() as patch:
            for name, value in limits.items():
                patch.setattr(bpe, name, value)
            encoder, learned = bpe.Encoder(path), Counter()
            learn = encoder.learn
            patch.setattr(encoder, "learn", lambda chunks, learn=learn, learned=learned: (learned.update(chunks), learn(chunks))[1])
            for k in range(30):
                texts = [f"x the of the of word{k}{i} other{k}{i}ness" for i in range(8)]
                assert encoder.encode(texts).to_pylist() == library.encode_ordinary_batch(texts)
            assert learned[" the"] == learned[" of"] == 1 and len(encoder.known) <= 60 and len(encoder.ids) <= 250


def test_a_byte_that_no_rank_has_raises(tmp_path):
    path = str(tmp_path / "few.tiktoken")
    with open(path, "wb") as file:
        file.writelines(base64.b64encode(token) + b" %d\n" % rank for rank, token in enumerate([b"a", b"b", b"ab"]))
    encoder = bpe.Encoder(path)
    for texts in (["abz"], ["abz"], [f"ab{c}" for c in "cdefghijkl"]):
        with pytest.raises(ValueError, match="no token"):
            encoder.encode(texts)
    assert encoder.encode(["abab", "aab"]).to_pylist() == [[2, 2], [0, 2]]


def test_utf8_stream_cuts_anywhere():
    choice = [0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF, 0xE2, 0x82, 0xAC]
    for _ in range(3000):
        data = bytes(RANDOM.choice(choice) for _ in range(RANDOM.randint(0, 9)))
        stream, out, k = bpe.Utf8Stream(), "", 0
        while k < len(data):
            step = RANDOM.randint(1, 3)
            out += stream.feed(data[k : k + step])
            k += step
        assert out + stream.feed(b"", end=True) == data.decode(errors="replace")


# ---------------------------------------------------------------- 8


def test_lm_scores(spark, docs, nothing):
    trained = docs.withColumn("trained", fold(F.col("doc_id")) != 1).select("doc_id", "text", "trained", "score")
    got = lm.score(trained).collect()
    tokens = lambda t: [w.translate(LOWER) for w in words(t)] + [None]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, *_ in ROWS]
    counts = Counter(w for (_, t, *_), out in zip(ROWS, held, strict=True) if not out for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    want = defaultdict(list)
    for i, text, *_ in ROWS:
        own = tokens(text)
        base = sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        want[i].append((len(own), sum(w in counts for w in own), round(base, 6)))
    mine = defaultdict(list)
    for r in got:
        mine[r["doc_id"]].append((r["n_tokens"], r["n_known"], round(r["base_score"], 6)))
        assert r["train_tokens"] == total and r["score"] < 0
    assert {k: sorted(v) for k, v in mine.items()} == {k: sorted(v) for k, v in want.items()}
    assert lm.score(nothing.withColumn("trained", F.lit(True))).count() == 0
    untrained = lm.score(trained.withColumn("trained", F.lit(False))).collect()
    assert all(abs(r["score"]) < 1e-9 for r in untrained)  # one possible token: the unknown


def test_interpolation_weights_are_probabilities():
    weights = lm.learn({(8 << 24) | (5 << 12) | 9: 50, (0 << 24) | (0 << 12) | 3: 20}, 1000.0, 200.0)
    assert np.allclose(weights.sum(1), 1) and (weights >= 0).all()


# ---------------------------------------------------------------- 9


def test_shards_are_even_and_gapless(spark, docs, nothing):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("IF(id < 1200, 'hot text', repeat('x', CAST(id % 90 AS INT)))").alias("text"))
    for frame, part_rows in ((many, 100), (docs, 10)):
        got = shards.shard(frame, part_rows=part_rows).collect()
        total, by = sum(r["size"] for r in got), defaultdict(list)
        assert len(got) == frame.count()
        for r in got:
            by[r["shard"]].append(r)
        for own in by.values():
            assert sorted(r["slot"] for r in own) == list(range(len(own)))
        if frame is many:
            assert set(by) == set(range(16))
            assert all(abs(sum(r["size"] for r in own) - total / 16) < 2 * 91 for own in by.values())
    sizes = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in shards.shard(docs).collect())
    assert sizes == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    assert shards.shard(nothing).count() == 0


# ---------------------------------------------------------------- 10


def brute_links(rows):
    def grams(text):
        own = words(text)
        return frozenset(zip(*[own[k:] for k in range(5)], strict=False)) if len(own) >= 5 else frozenset([tuple(own)] if own else [])

    sets = [grams(t) for _, t, *_ in rows]
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    return [[j for j in range(len(rows)) if j != i and alike(sets[i], sets[j])] for i in range(len(rows))]


def test_near_duplicates_against_brute_force(spark, docs, nothing):
    stem = [prose(60).split() for _ in range(3)]
    rows = list(ROWS)
    for k in range(120):
        own = list(stem[k % 3])
        for _ in range(RANDOM.randint(0, 2)):
            own[RANDOM.randrange(60)] = RANDOM.choice(WORDS)
        rows.append((100 + k, " ".join(own), "en", "s1", 1))
    links = brute_links(rows)
    got = near.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r["doc_id"], r["n_links"]) for r in got) == Counter((rows[i][0], len(own)) for i, own in enumerate(links))
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[i], *(label[j] for j in own)]) for i, own in enumerate(links)]
    smallest = defaultdict(list)
    for i, root in enumerate(label):
        smallest[root].append(rows[i][0])
    want = Counter((rows[i][0], min((d for d in smallest[r] if d is not None), default=None)) for i, r in enumerate(label))
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == want
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({tuple(sorted([i, *own])) for i, own in enumerate(brute_links(ROWS))})
    assert near.near_duplicates(nothing).count() == 0


def test_blocks_of_a_hot_group_find_the_same(spark, monkeypatch):
    stem = prose(60).split()
    rows = []
    for k in range(90):
        own = list(stem)
        own[k % 60] = f"w{k}"
        rows.append((k, " ".join(own)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {tuple(r) for r in near.near_duplicates(frame).select("doc_id", "class_id", "n_links").collect()}
    monkeypatch.setattr(near, "BLOCK_ROWS", 16)
    assert {tuple(r) for r in near.near_duplicates(frame).select("doc_id", "class_id", "n_links").collect()} == whole
    assert all(r[1] == 0 and r[2] > 0 for r in whole)


def test_dense_regions_are_done_with_at_deep_prefixes(spark):
    stem = prose(300).split()
    rows = []
    for k in range(600):  # near copies of one text, and pairs that are close to the threshold
        own = list(stem)
        own[k % 300] = f"w{k}"
        rows.append((k, " ".join(own)))
    for k in range(600, 640, 2):
        own = prose(100).split()
        other = list(own)
        for at in (20, 60):
            other[at] = f"v{k}"
        rows += [(k, " ".join(own)), (k + 1, " ".join(other))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    signed = near.arrow_map(frame.select("doc_id", F.col("doc_id").alias("row"), near._word_hashes().alias("words")), near._sign, "doc_id long, row long, key binary, n long, sign binary")
    nodes = signed.select(F.col("doc_id").alias("node"), "sign")
    members, open_rows = near.forest_candidates(nodes, 0.8, 0.9999)
    roots = {r["node"]: r["root"] for r in members.collect()}
    # Nothing of the 600 near copies, which share subtrees in all trees, walks on.
    assert open_rows < 300
    assert all(roots[k] == 0 for k in range(600)) and all(roots.get(k + 1) == k for k in range(600, 640, 2))


def test_prefixes_shorten_until_the_recall():
    assert near.prefix_length(0.8, 0.9) == 8 and near.prefix_length(0.8, 0.9999) == 5


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages_take_odd_rows(spark, docs, nothing):
    folder = "/root/testdata/sf0.001"
    for frame in (docs, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            done = stage(spark, frame, folder)
            assert done.columns == frame.columns and done.count() <= frame.count()
    last = corpus_pipeline.tokenize(spark, docs, folder)
    assert last.where("lossless").count() == len(ROWS)


def test_pipeline_keeps_one_of_each(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    ids = [r["doc_id"] for r in got.select("doc_id").collect()]
    assert ids and len(ids) == len(set(ids))
    assert "text" not in got.columns
