"""The training-data operators against brute force, on odd rows and on the smallest test tables."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from lautwerk.llm import common, crf, language_id, lattice_lm, mixing, quality_crf
from lautwerk.llm import toxicity as tox
from lautwerk.llm.decontaminate import BROADCAST_BYTES, LEAST_EQUAL, SHORTEST, SPAN, STRETCH, decontaminate
from lautwerk.llm.jaccard_join import jaccard_components, jaccard_links
from lautwerk.llm.language_id import identify
from lautwerk.llm.lattice_lm import lattice_scores
from lautwerk.llm.license_scan import BASE, DECISIVE, DRIFT, EDITS, GRAM, SPREAD, TEMPLATES, license_scan
from lautwerk.llm.mixing import mix_sources, mixed_blocks, mixed_slots, shards
from lautwerk.llm.quality_crf import line_features, quality_scores
from lautwerk.llm.quality_rules import BAD_GIVEN, BELIEF, MIN_POSTERIOR, PRIOR_GOOD, ROUNDS, RULES, quality_rules
from lautwerk.llm.token_counts import piece_lengths, token_counts
from lautwerk.llm.toxicity import toxicity

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"w{k % 977}" for k in range(30_000))
NEAR = " ".join(f"near{k}" for k in range(120))
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", "de", None), (4, "one two", "de", "b"), (5, "one two", "de", "b"), (5, "one two", "de", "b"),
    (6, LONG, "en", "a"), (7, LONG + " tail", "en", "a"), (8, "x" * 300_000, None, "c"), (None, "null id text here", "en", "c"), (None, None, None, None),
    (9, NEAR, "en", "a"), (10, NEAR.replace("near7 ", "other "), "en", "a"), (11, NEAR.upper(), "en", "d"), (12, "12 345 !!", "en", "d"),
    (13, "ÄÖÜ ß Kİ K \x1c\x85 z y <|endoftext|> don't  stop　now   ", "de", "d"), (14, "Released under the MIT License.", "en", "a"),
    (15, "line a\nline a\nline b\n\nline a", "en", "a"), (16, "a b c d e f g h " * 9, "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string, kept string, n long, gid string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="module", params=["odd", "docs"])
def both(request):
    return request.getfixturevalue(request.param)



def multiset(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def texts_of(df):
    return [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in df.select("doc_id", "text", "source", "lang").collect()]


def held(i, folds, rest):
    return i is not None and zlib.crc32(str(i).encode()) % folds == rest


def test_word_hashes_agree_with_words():
    texts = [t or "" for _, t, *_ in ODD]
    for sep, pattern in ((common.SPACES, WORD), (common.NOT_ALNUM, ALNUM)):
        h, at, cut = common.word_hashes(pa.array(texts), sep)
        for k, text in enumerate(texts):
            words = pattern.findall(text.translate(A_Z))
            assert cut[k + 1] - cut[k] == len(words)
            assert h[cut[k] : cut[k + 1]].tolist() == [common.hash_of(w) for w in words[:5000]] + h[cut[k] + len(words[:5000]) : cut[k + 1]].tolist()


def test_token_counts(both, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for i, text, *_ in texts_of(both):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        expected[i, len((text or "").encode()), n, n > 1024] += 1
    assert multiset(token_counts(both), "doc_id", "n_bytes", "n_tokens", "over_limit") == expected
    # nearly all by shuffle
    assert multiset(token_counts(both, most_common=40), "doc_id", "n_bytes", "n_tokens", "over_limit") == expected
    pieces = piece_lengths(both).collect()
    assert len({r["piece"] for r in pieces}) == len(pieces)
    assert token_counts(none).count() == 0


def test_token_counts_of_random_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = np.random.default_rng(3)
    chars = [*"ab'sStTdDmMlLvVeErR 1 ²½ \n\t\r\x0b\x0c\x1c\x1f\x85\xa0   ​ 　é́ñ中文😀!?#$", "<|endoftext|>", "<|", "'ll", "'re", "  "]
    texts = ["".join(rng.choice(chars, rng.integers(0, 40))) for _ in range(600)]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    bad = [(texts[r["doc_id"]], r["n_tokens"]) for r in got if r["n_tokens"] != len(t.encode(texts[r["doc_id"]], add_special_tokens=False).ids)]
    assert not bad


def test_quality_rules(both, none):
    expected = Counter()
    for i, text, *_ in texts_of(both):
        text = text or ""
        w = WORD.findall(text)
        seen, cover = defaultdict(list), set()
        for j in range(len(w) - 7):
            seen[tuple(w[j : j + 8])].append(j)
        for at in seen.values():
            if len(at) > 1:
                cover.update(k for j in at for k in range(j, j + 8))
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        expected[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), failed] += 1
    out = quality_rules(both)
    assert multiset(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == expected
    assert out.where("base_failed and kept").count() == 0
    assert quality_rules(none).count() == 0


def test_quality_posteriors_agree_with_rows(both):
    """Votes from the measures in plain Python; expectation-maximisation text by text, without counting patterns first."""
    rows_ = quality_rules(both).collect()
    by_id = defaultdict(list)
    for i, text, *_ in texts_of(both):
        by_id[i].append(text or "")
    votes, names = [], list(RULES)
    for r in rows_:
        votes.append(tuple(r[f"vote_{n}"] for n in names))
        if len(set(by_id[r["doc_id"]])) > 1:
            continue
        text = by_id[r["doc_id"]][0]
        joined = "".join(WORD.findall(text))
        lines = [x for x in text.split("\n") if WORD.search(x)]
        m = dict(
            n_words=r["n_words"], word_chars=r["word_chars"], n_symbols=r["n_symbols"], n_dup_lines=r["n_dup_lines"], n_repeat_words=r["n_repeat_words"], n_lines=len(lines),
            n_upper=len(regex.findall(r"\p{Lu}", joined)), n_letters=len(regex.findall(r"\p{L}", joined)), n_distinct=len(set(WORD.findall(text))),
        )
        for (good, bad), vote in zip(RULES.values(), votes[-1], strict=True):
            holds = lambda e: eval(re.sub(r"(\w+) between (.+?) and (.+)$", r"\2 <= \1 <= \3", e).replace(" = ", " == "), {}, m)  # noqa: E731, B023, S307
            assert vote == (1 if holds(good) else -1 if holds(bad) else 0), (r["doc_id"], good)
    learn = [v for v, r in zip(votes, rows_) if r["n_words"] > 0]
    total = len(learn)
    pull = {1: BELIEF * PRIOR_GOOD * total, 0: BELIEF * (1 - PRIOR_GOOD) * total}
    prior, bad = PRIOR_GOOD, [dict(BAD_GIVEN) for _ in names]

    def good_odds(v):
        odds = math.log(prior / (1 - prior))
        for x, b in zip(v, bad):
            odds += math.log(b[1] / b[0]) if x < 0 else math.log((1 - b[1]) / (1 - b[0])) if x > 0 else 0
        return odds

    for _ in range(ROUNDS):
        post = [1 / (1 + math.exp(-good_odds(v))) for v in learn]
        mass = {1: pull[1] + sum(post), 0: pull[0] + sum(1 - p for p in post)}
        new = []
        for k in range(len(names)):
            share = {}
            for c in (1, 0):
                said = {x: sum((p if c else 1 - p) for p, v in zip(post, learn) if v[k] == x) for x in (1, -1)}
                no, yes = BAD_GIVEN[c] * pull[c] + said[-1], (1 - BAD_GIVEN[c]) * pull[c] + said[1]
                share[c] = no / (no + yes)
            new.append(share)
        prior, bad = mass[1] / (mass[1] + mass[0]), new
    for v, r in zip(votes, rows_):
        want = 1 / (1 + math.exp(-good_odds(v)))
        assert math.isclose(r["posterior"], want, rel_tol=1e-6, abs_tol=1e-9) and r["kept"] == (not r["base_failed"] and r["posterior"] >= MIN_POSTERIOR)


def test_quality_rules_keep_good_texts(docs, labels):
    got = quality_rules(docs).join(labels, "doc_id").toPandas()
    good = got[(got.quality == 1) & ~got.base_failed]
    assert good.kept.mean() > 0.98
    assert got[got.quality == 0].kept.mean() < 0.3


def test_crf_agrees_with_enumeration():
    rng = np.random.default_rng(0)
    cut, emission, trans = np.array([0, 1, 1, 5, 8]), rng.normal(size=8), rng.normal(size=(2, 2))
    p, pairs = crf.expected(emission, cut, trans)
    want, count = np.zeros(8), np.zeros((2, 2))
    for lo, hi in zip(cut[:-1], cut[1:]):
        n = hi - lo
        z, one, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n if n else 0):
            s = [code >> k & 1 for k in range(n)]
            weight = math.exp(sum(emission[lo + k] for k in range(n) if s[k]) + sum(trans[a, b] for a, b in zip(s, s[1:])))
            z += weight
            one += weight * np.array(s)
            for a, b in zip(s, s[1:]):
                two[a, b] += weight
        if n:
            want[lo:hi] = one / z
            count += two / z
    assert np.allclose(p, want) and np.allclose(pairs, count) and np.allclose(crf.marginals(emission, cut, trans), want)


def test_line_features_find_every_line():
    texts = ["a\nb\n", "", "\n", "x", "\n\ny"]
    _, size, cut = line_features(pa.array(texts))
    assert np.diff(cut).tolist() == [t.count("\n") + 1 for t in texts]
    assert len(size) == cut[-1]


@pytest.mark.parametrize("op, column, cutoff", [(quality_scores, "quality", 0.3), (toxicity, "toxic", 0.5)])
def test_classifiers(spark, odd, none, labels, op, column, cutoff):
    big = "/root/testdata/sf0.01"
    all_docs, all_labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = op(all_docs, all_labels).join(all_labels, "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: held(i, 5, 0))).all()
    assert ((got.score >= cutoff).astype(int) == got.predicted).all() and got.score.between(0, 1).all()
    test = got[got.held_out]
    assert (test.predicted == test[column]).mean() > 0.93
    for df, n in ((odd, len(ODD)), (none, 0)):
        assert op(df, all_labels).count() == n
        assert op(df, all_labels.limit(0)).count() == n


def test_language_id(spark, odd, none):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(big).join(big.select("doc_id", "lang"), "doc_id").toPandas()
    test = got[got.held_out]
    assert (test.lang == test.lang_pred).mean() > 0.97
    out = identify(odd).toPandas()
    assert len(out) == len(ODD)
    assert set(out[out.doc_id.isin([1, 2, 3, 12])].lang_pred) == {"und"}
    assert identify(none).count() == 0


class Sent:
    """A broadcast that went nowhere."""

    def __init__(self, value):
        self.value = value


def scored(module, model, texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([False] * len(texts)), pa.array(texts)], ["doc_id", "held_out", "text"])
    return pa.Table.from_batches(list(module._scorer(Sent(model))(iter([batch])))).to_pylist()


def grams_of(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    return {raw[k : k + n] for n in (1, 2, 3) for k in range(len(raw) - n + 1)}


def test_language_scores_agree_with_sets():
    texts = ["the quick brown fox", "a lazy dog sleeps", "the end of the day", "der schnelle fuchs", "ein müder hund schläft", "das ende des tages", "Über allen Gipfeln"]
    langs = ["en"] * 3 + ["de"] * 4
    model = language_id.fit(texts, langs)
    sets = [grams_of(t) for t in texts]
    kernel = lambda a, b: len(a & b) / math.sqrt(max(len(a), 1) * max(len(b), 1))
    marks = [i for n in ("de", "en") for i in range(len(texts)) if langs[i] == n]
    square = np.array([[kernel(sets[i], sets[j]) for j in marks] for i in marks])
    value, vector = np.linalg.eigh(square)
    white = vector[:, value > 1e-6 * value.max()] / np.sqrt(value[value > 1e-6 * value.max()])
    features = lambda own: np.r_[np.array([kernel(own, sets[j]) for j in marks]) @ white, 1.0]
    phi = np.array([features(x) for x in sets])
    y = np.array([[1.0 if x == n else -1.0 for n in ("de", "en")] for x in langs])
    weight = np.diag([1 / langs.count(x) for x in langs])
    coef = np.linalg.solve(phi.T @ weight @ phi + language_id.RIDGE / 20 * np.eye(phi.shape[1]), phi.T @ weight @ y)
    asked = ["the dog of the day", "ein fuchs", "ÜBER", "12 !!", "zzz qqq the", ""]
    for text, got in zip(asked, scored(language_id, model, asked), strict=True):
        out = features(grams_of(text)) @ coef
        share = np.exp(language_id.SHARPNESS * (out - out.max()))
        has = any(c.isalpha() for c in text)
        assert got["lang_pred"] == (("de", "en")[int(out.argmax())] if has else "und")
        assert math.isclose(got["score"], share.max() / share.sum() if has else 0.0, rel_tol=1e-3)


def marginals_by_enumeration(emission, trans):
    n, total, one = len(emission), 0.0, np.zeros(len(emission))
    for states in itertools.product((0, 1), repeat=n):
        weight = math.exp(sum(e for e, s in zip(emission, states) if s) + sum(trans[a, b] for a, b in itertools.pairwise(states)))
        total += weight
        one += weight * np.array(states)
    return one / total


def test_quality_scores_agree_with_enumeration():
    good = [f"A plain line of text number {k}.\nAnother one follows here." for k in range(12)]
    bad = [f"### $$$ ||| {k}\n%% && ** <> {k}\nBUY BUY BUY" for k in range(12)]
    model = quality_crf.fit(good + bad, [1] * 12 + [0] * 12)
    asked = ["", "A plain line.\n### $$$ |||\nAnother line follows here.", "\n".join(["words and words", "%%% ***"] * 4), "one"]
    for text, got in zip(asked, scored(quality_crf, model, asked), strict=True):
        x, size, cut = line_features(pa.array([text]))
        p = marginals_by_enumeration(((x - model["mean"]) / model["dev"]) @ model["w"], model["trans"])
        share = min(max((p * size).sum() / size.sum(), 1e-4), 1 - 1e-4)
        want = 1 / (1 + math.exp(-(model["a"] * math.log(share / (1 - share)) + model["b"])))
        assert math.isclose(got["score"], want, rel_tol=1e-6) and got["predicted"] == (want >= quality_crf.CUTOFF)
    scores = [r["score"] for r in scored(quality_crf, model, good + bad)]
    assert min(scores[:12]) >= quality_crf.CUTOFF > max(scores[12:])


def test_toxicity_scores_agree_with_enumeration():
    clean = [f"kind words about topic {k} and friends" for k in range(40)]
    toxic = [f"you are a xu person {k} and a vilewretch {k}" for k in range(40)]
    model = tox.fit(clean + toxic, [0] * 40 + [1] * 40)
    asked = ["", "a xu person", "kind friends about a vilewretch and xu words", "nothing here"]
    for text, got in zip(asked, scored(tox, model, asked), strict=True):
        ids, _, _ = tox.features(pa.array([text]))
        p = marginals_by_enumeration(model["w"][ids].sum(1).astype(float) + model["bias"], model["trans"]) if len(ids) else np.zeros(1)
        assert math.isclose(got["score"], p.max(), rel_tol=1e-5, abs_tol=1e-9) and got["toxic_words"] == np.flatnonzero(p >= tox.CUTOFF).tolist()
    # a word of two letters is marked as a longer one is
    assert [r["predicted"] for r in scored(tox, model, asked)] == [0, 1, 1, 0]


def shingle_set(text):
    w = WORD.findall((text or "").translate(A_Z))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("table", ["sf0.001", "odd", "dense"])
def test_jaccard_components(spark, odd, none, table):
    if table == "dense":
        rng = np.random.default_rng(1)
        base = [[f"b{g}_{k}" for k in range(60)] for g in range(4)]
        made = []
        for i in range(300):
            w = list(base[i % 4])
            for at in rng.choice(60, rng.integers(0, 6), replace=False):
                w[at] = f"e{rng.integers(0, 50)}"
            made.append((i, " ".join(w[: rng.integers(30, 61)])))
        df = spark.createDataFrame(made, "doc_id long, text string")
        pairs = made
    else:
        df = odd if table == "odd" else spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
        pairs = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    sets = [shingle_set(t) for _, t in pairs]
    parent = list(range(len(pairs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(pairs):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    expected = Counter((i, len(sets[k]), least.get(root(k))) for k, (i, _) in enumerate(pairs))
    assert multiset(jaccard_components(df), "doc_id", "n_shingles", "component_id") == expected
    links, members = jaccard_links(df)
    set_of = {}
    for r in members.collect():
        set_of.setdefault(r["class_id"], r["doc_id"])
    by_id = {i: s for (i, _), s in zip(pairs, sets) if s}
    distinct = {frozenset(s): None for s in sets if s}
    want_links = {frozenset((a, b)) for a, b in itertools.combinations(distinct, 2) if 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b)}
    got_links = [frozenset(frozenset(by_id[set_of[c]]) for c in r) for r in links.collect()]
    assert len(set_of) == len(distinct) and len(got_links) == len(want_links) and set(got_links) == want_links
    if table == "odd":
        assert jaccard_components(none).count() == 0 and jaccard_links(none)[0].count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (7, 7)], "src long, dst long")
    got = {r["id"]: r["component"] for r in common.connected_components(edges).collect()}
    assert got == {k: 0 for k in range(201)} | {500: 500, 501: 500}


def brute_decontamination(docs, items, shortest=SHORTEST):
    found = set()
    items = [(i, WORD.findall((t or "").translate(A_Z))) for i, t in items]
    for d, text, *_ in docs:
        w = WORD.findall((text or "").translate(A_Z))
        for i, item in items:
            if len(item) < shortest:
                continue
            for start in range(-len(item) + 1, len(w)):
                skip = max(0, -start)
                equal = [a == b for a, b in zip(w[max(start, 0) :], item[skip:])]
                m = min(STRETCH, len(equal), len(item) - skip)
                if m < min(SPAN, len(item) - skip) or m < min(SPAN, len(item)) or sum(equal) < 0.5 * m:
                    continue
                if any(100 * sum(equal[k : k + m]) >= LEAST_EQUAL * m for k in range(len(equal) - m + 1)):
                    found.add((d, i))
    return found


def test_decontamination(spark, odd, none, docs, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    sample = docs.orderBy("doc_id").limit(40)
    want = brute_decontamination(texts_of(sample), [(r["item_id"], r["text"]) for r in items.collect()])
    got = decontaminate(sample, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    words = [f"q{k}" for k in range(30)]
    swapped = list(words)
    for k in (4, 12, 20, 27):
        swapped[k] = "changed"
    special = spark.createDataFrame([(1, "so " + " ".join(swapped).upper() + " end"), (2, " ".join(words[:6])), (3, None), (4, "five words are enough here yes"), (5, " ".join(f"z{k}" for k in range(40)))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "Five words are enough here"), (3, "too short"), (4, None), (1, " ".join(words))], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate(special, bench).collect()} == {(1, 1), (4, 2)}
    assert decontaminate(odd, items).count() == 0
    assert decontaminate(none, items).count() == 0 and decontaminate(odd, items.limit(0)).count() == 0


@pytest.mark.parametrize("room", [BROADCAST_BYTES, 0])
def test_decontamination_finds_every_accepted_pattern(spark, room):
    items = {n: [f"i{n}_{k}" for k in range(n)] for n in range(1, STRETCH + 2)} | {40: [f"i40_{k}" for k in range(40)]}
    made, want = [], set()
    for n in range(1, STRETCH + 1):
        for s in range(n // 4 + 2):
            for off in itertools.combinations(range(n), s):
                if 100 * (n - s) >= LEAST_EQUAL * n:
                    want.add((len(made), n))
                made.append((len(made), " ".join(["so", *("x" if k in off else w for k, w in enumerate(items[n])), "end"])))
    # overlaps that an end of the text cuts short, and every fourth word replaced
    first = len(made)
    for n in range(2, STRETCH):
        for s in range(4):
            for off in itertools.combinations(range(n), s):
                for part, front in ((items[40][:n], True), (items[40][-n:], False)):
                    changed = ["x" if k in off else w for k, w in enumerate(part)]
                    made.append((len(made), " ".join(["so", "far", *changed] if front else [*changed, "so", "far"])))
    for n in (14, 40):
        made.append((len(made), " ".join("x" if k % 4 == 3 else w for k, w in enumerate(items[n]))))
    want |= brute_decontamination([(i, t) for i, t in made[first:]], [(40, " ".join(items[40])), (14, " ".join(items[14]))])
    assert {i for i, _ in want} >= {made[-1][0], made[-2][0]}
    df = spark.createDataFrame(made, "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    for shortest in (1, SHORTEST):
        got = decontaminate(df, bench, shortest=shortest, broadcast_bytes=room)
        assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(d, n) for d, n in want if n >= shortest}


def test_spaced_seeds_cover_what_the_rule_accepts():
    """All patterns of 1 to STRETCH words: a mask finds equal words in each, and the quick test of a seed leaves none of SPAN words out."""
    from lautwerk.llm.decontaminate import GAPPED, MASK

    places = lambda mask, p: [o for o in range(len(p) - len(mask) + 1) if all(p[o + k] for k, m in enumerate(mask) if m == "1")]
    for n in range(1, STRETCH + 1):
        for off in (x for s in range(n) for x in itertools.combinations(range(n), s) if 100 * (n - s) >= LEAST_EQUAL * n):
            p = [k not in off for k in range(n)]
            assert any(places(mask, p) for mask in (MASK, *GAPPED.get(n, ()))), p
            if n >= SPAN:
                for o in places(MASK, p):
                    after, before = p[o + len(MASK) : o + len(MASK) + 5], p[max(o - 5, 0) : o]
                    assert sum(after) >= 2 or sum(before) >= 2, (p, o)
    assert "0" in MASK


def test_decontamination_takes_repeated_items_once(spark, monkeypatch):
    from lautwerk.llm import decontaminate as module

    passages = [" ".join(f"{c}{k}" for k in range(20)) for c in "abc"]
    docs = spark.createDataFrame([(1, "x y " + passages[0]), (2, passages[1] + " " + passages[0]), (3, "nothing here"), (1, passages[2])], "doc_id long, text string")
    rows = [(100 * n + k, p.upper() if n % 2 else p) for n in range(50) for k, p in enumerate(passages)] + [(0, passages[1]), (None, passages[0])]
    items, seeded, seeds = spark.createDataFrame(rows, "item_id long, text string"), [], module._seeds
    monkeypatch.setattr(module, "_seeds", lambda df, words, masks: (seeded.append(df.count()) if words == "item" else None) or seeds(df, words, masks))
    for room in (BROADCAST_BYTES, 0):
        got = {(r["doc_id"], r["item_id"]): (r["n_equal"], r["n_aligned"], r["first_word"]) for r in decontaminate(docs, items, broadcast_bytes=room).collect()}
        want = {(1, 100 * n): (20, 20, 2) for n in range(50)} | {(1, 100 * n + 2): (20, 20, 0) for n in range(50)} | {(2, 100 * n): (20, 20, 20) for n in range(50)} | {(2, 100 * n + 1): (20, 20, 0) for n in range(50)}
        assert got == want | {(2, 0): (20, 20, 0), (1, None): (20, 20, 2), (2, None): (20, 20, 20)}
    assert seeded == [3, 3]


def test_decontamination_cuts_long_texts(spark, monkeypatch):
    """No array holds the words of a long text; what lies across the cuts is found once and counted from the text's start."""
    from lautwerk.llm import decontaminate as module

    rng = random.Random(3)
    bench = {k: [f"i{k}_{j}" for j in range(n)] for k, n in enumerate((5, 8, 12, 20, 59, 90))}
    made = []
    for d in range(6):
        words = [rng.choice(("so", "far", "É", "\U0001d54f", f"n{j}")) for j in range(rng.choice((700, 2000)))]
        for k in rng.choices(sorted(bench), k=25):
            at = rng.choice((0, len(words) - len(bench[k]) + rng.randrange(30), rng.randrange(len(words)), 4 * rng.randrange(len(words) // 4)))
            changed = [w if rng.random() > 0.15 else "x" for w in bench[k]][max(-at, 0) :]
            words[max(at, 0) : max(at, 0) + len(changed)] = changed
        made.append((d, rng.choice(("", "\t ", "\n")) + "".join(w + rng.choice((" ", "\n\n", " \x0b ")) for w in words)))
    made += [(0, made[1][1]), (None, made[2][1]), (90, ""), (91, " \n"), (92, None)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    items = spark.createDataFrame([(k, " ".join(w)) for k, w in bench.items()], "item_id long, text string")
    columns = ("doc_id", "item_id", "n_equal", "n_aligned", "first_word")
    want = multiset(module.decontaminate(docs, items, whole_bytes=1 << 30), *columns)
    assert {x[:2] for x in want} == brute_decontamination(made, [(k, " ".join(w)) for k, w in bench.items()]) and len(want) > 20
    monkeypatch.setattr(module, "UNIT", 4)
    for core, room in ((1, BROADCAST_BYTES), (1, 0), (200, BROADCAST_BYTES), (5000, BROADCAST_BYTES)):
        monkeypatch.setattr(module, "CORE", core)
        assert multiset(module.decontaminate(docs, items, broadcast_bytes=room, whole_bytes=0), *columns) == want, (core, room)


def test_decontamination_holds_pieces_of_long_texts(spark, monkeypatch):
    from lautwerk.llm import decontaminate as module

    passage = " ".join(f"p{k}" for k in range(20))
    docs = spark.createDataFrame([(1, "so far " * 100_000 + passage + " so far" * 50_000), (2, passage)], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    longest, seeds = [], module._seeds
    monkeypatch.setattr(module, "_seeds", lambda df, words, masks: (longest.append(df.agg(F.max(F.size(words))).first()[0]) if words == "w" else None) or seeds(df, words, masks))
    got = {tuple(r) for r in module.decontaminate(docs, items).collect()}
    assert got == {(1, 7, 20, 20, 200_000), (2, 7, 20, 20, 0)} and longest[0] <= 5000


def test_decontamination_hits_carry_no_text(spark, monkeypatch):
    """All hits of a text are held at once, so a text of many hits must not be in each."""
    from lautwerk.llm import decontaminate as module

    passage = [f"p{k}" for k in range(20)]
    docs = spark.createDataFrame([(1, " ".join((passage + ["so"]) * 70)), (2, " ".join(passage[3:]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(passage))], "item_id long, text string")
    seen, diagonal = [], module._diagonal
    monkeypatch.setattr(module, "_diagonal", lambda hits, *keep: seen.append(hits) or diagonal(hits, *keep))
    assert {tuple(r) for r in module.decontaminate(docs, items).collect()} == {(1, 7, 20, 20, 0), (2, 7, 17, 17, 0)}
    arrays = [c for c, kind in seen[0].dtypes if kind == "array<string>"]
    assert arrays and max(seen[0].agg(*(F.max(F.size(c)) for c in arrays)).first()) == 20


def test_decontamination_by_shuffle_agrees(docs, odd, sf, spark):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    for df in (docs, odd):
        assert multiset(decontaminate(df, items, broadcast_bytes=0), "doc_id", "item_id", "n_equal", "n_aligned", "first_word") == multiset(decontaminate(df, items), "doc_id", "item_id", "n_equal", "n_aligned", "first_word")


def test_license_scan(both, none):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    expected = Counter()
    for i, text, *_ in texts_of(both):
        w = ALNUM.findall((text or "").translate(A_Z))
        hits = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in hits]
        expected[i, len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))] += 1
    out = license_scan(both)
    assert multiset(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == expected
    assert license_scan(none).count() == 0


def brute_labels(text):
    """Labels and best cover of a text, by comparing words."""
    w = ALNUM.findall((text or "").translate(A_Z))
    found = {}
    for name, template in TEMPLATES.items():
        t = template.split()
        n = len(t) - GRAM + 1
        hits = [(a - b, a, b) for a in range(len(w) - GRAM + 1) for b in range(n) if w[a : a + GRAM] == t[b : b + GRAM]]
        groups = []
        for hit in sorted(hits):
            if groups and hit[0] - groups[-1][-1][0] <= DRIFT:
                groups[-1].append(hit)
            else:
                groups.append([hit])
        least = n - (1 if n <= GRAM else GRAM * math.ceil(len(t) / EDITS))
        for g in groups:
            for start in {a for _, a, _ in g}:
                places = {b for _, a, b in g if a >= start and a + GRAM - start <= SPREAD * len(t)}
                decisive = name not in DECISIVE or any(b <= t.index(DECISIVE[name]) < b + GRAM for b in places)
                if decisive and len(places) >= least:
                    found[name] = max(found.get(name, 0), len(places) / n)
    base = {label for phrase, label in BASE.items() if any(w[k : k + len(phrase.split())] == phrase.split() for k in range(len(w)))}
    return ",".join(sorted(base | set(found))), 1.0 if base else max(found.values(), default=0.0)


def test_license_labels_agree_with_words(spark, docs):
    twice = " ".join([TEMPLATES["apache-text"], "and", TEMPLATES["gpl-text"], TEMPLATES["apache-text"][10:]])
    df = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(-1, twice), (-2, TEMPLATES["bsd-text"].upper())], "doc_id long, text string"))
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in license_scan(df).collect()}
    want = {r["doc_id"]: brute_labels(r["text"]) for r in df.collect()}
    assert got == {i: (x, round(y, 9)) for i, (x, y) in want.items()}


def test_license_spans_survive_repeats(spark):
    """Any template before or after 1 to 10 of its own tails, or its own heads."""
    made, want = [], []
    for name, text in TEMPLATES.items():
        words = text.split()
        for k in range(1, 11):
            for part in (words[-3:], words[-4:], words[:3], words[1:4]):
                for order in ([text, *[" ".join(part)] * k], [*[" ".join(part)] * k, text]):
                    made.append((len(made), " ".join(order)))
                    want.append(name)
    made.append((len(made), "released under the mit license the mit license the mit license"))
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in license_scan(df).collect()}
    assert all(name in got[i][0].split(",") for i, name in enumerate([*want, "mit-notice"]))
    assert got == {i: (x, round(y, 9)) for i, (x, y) in ((i, brute_labels(t)) for i, t in made)}


def test_license_spans_survive_edits(spark):
    made, want = [(0, "this program is free of charge"), (1, "licensed under cc by 4 0"), (2, "licensed under the foo license version 2 0")], {0: set(), 1: set(), 2: set()}
    for name, text in TEMPLATES.items():
        words = text.split()
        inner = range(1, 4) if name == "mit-notice" else ()
        for k, w in enumerate(words):
            for edited in (["other"], [w, "more"]):
                if w != DECISIVE.get(name) and (k not in inner or len(edited) > 1 and k == 3):
                    want[len(made)] = {name}
                    made.append((len(made), " ".join(["x", "y", *words[:k], *edited, *words[k + 1 :], "z"])))
    got = {r["doc_id"]: set(r["labels"].split(",")) - set(BASE.values()) - {""} for r in license_scan(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert {i: v for i, v in got.items() if v != want[i]} == {}


def test_lattice_sums_all_segmentations():
    pieces, logp = lattice_lm.read_pieces(None)
    lattice = lattice_lm.Lattice(pieces, logp)
    at = {p: i for i, p in enumerate(pieces)}
    words = ["the", "ab", "x", "zür", "wordy"]
    raws = [w.encode() for w in words]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
    counts = np.array([1.0, 2, 3, 4, 5])
    got, gain = lattice.run(np.frombuffer(b"".join(raws), np.uint8), off, counts)
    want_gain = np.zeros(len(pieces))

    def ways(rest, first):
        if not rest:
            yield []
            return
        if first:
            yield from ([at[b" "], *w] for w in ways(rest, False))
        for k in range(1, len(rest) + 1):
            p = (b" " if first else b"") + rest[:k]
            if p in at:
                yield from ([at[p], *w] for w in ways(rest[k:], False))
        if not first:
            yield from ([at[rest[:1] + b"\x00byte"], *w] for w in ways(rest[1:], False))

    for k, raw in enumerate(raws):
        each = [(w, math.exp(sum(logp[i] for i in w))) for w in ways(raw, True)]
        total = sum(p for _, p in each)
        assert math.isclose(got[k], math.log(total), rel_tol=1e-9)
        for w, p in each:
            for i in w:
                want_gain[i] += counts[k] * p / total
    assert np.allclose(gain, want_gain)


def test_lattice_of_long_words_agrees():
    lattice, rng = lattice_lm.Lattice(*lattice_lm.read_pieces(None)), np.random.default_rng(4)
    words = [bytes(rng.choice(list(b"thequickfoxwordz"), n).tolist()) for n in (1, 3, 30, 700)] + ["zür".encode() * 9]
    off = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    raw, counts = np.frombuffer(b"".join(words), np.uint8), np.arange(1.0, 6.0)
    want, want_gain = lattice.run(raw, off, counts)
    gain, before = np.zeros(lattice.size), lattice_lm.LONG
    try:
        lattice_lm.LONG = 64
        got = [lattice._long(raw[a:b], c, gain) for a, b, c in zip(off, off[1:], counts)]
    finally:
        lattice_lm.LONG = before
    assert np.allclose(got, want) and np.allclose(gain, want_gain)


def test_lattice_scores(both, none):
    rows_ = texts_of(both)
    c, n = Counter(), 0
    for i, text, *_ in rows_:
        if not held(i, 7, 2):
            tokens = WORD.findall((text or "").translate(A_Z)) + [None]
            c.update(tokens)
            n += len(tokens)
    got = lattice_scores(both).collect()
    assert len(got) == len(rows_)
    want = Counter()
    for i, text, *_ in rows_:
        tokens = WORD.findall((text or "").translate(A_Z)) + [None]
        want[i, held(i, 7, 2), len(tokens), sum(c[t] > 0 for t in tokens), n, round(sum(math.log10((c[t] + 1) / (n + len(c) + 1)) for t in tokens), 4)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lattice_scores(none).count() == 0


def test_lattice_scores_of_texts(spark):
    """The model's score from the lattice of each word: one round of expectation-maximisation over the training words, then sums."""
    texts = ["the cat sat", "a cat on the mat", "zür x", "", "the the the end", "unheard of words", "the cat"]
    got = {r["doc_id"]: r["score"] for r in lattice_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    train = [i for i in range(len(texts)) if not held(i, 7, 2)]
    counts = Counter(w for i in train for w in texts[i].split())
    pieces, prior = lattice_lm.read_pieces(None)

    def run(logp, words, weight=None):
        raws = [w.encode() for w in words]
        return lattice_lm.Lattice(pieces, logp).run(np.frombuffer(b"".join(raws), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raws])]), weight)

    gain = run(prior, list(counts), np.array(list(counts.values()), float))[1]
    logp = np.log(gain + lattice_lm.PRIOR_PIECES * np.exp(prior)) - np.log(gain.sum() + lattice_lm.PRIOR_PIECES)
    tokens = sum(counts.values()) + len(train)
    stop = (len(train) + 1) / (tokens + 2)
    for i, text in enumerate(texts):
        words = text.split()
        of_words = run(logp, words)[0].sum() / math.log(10) if words else 0.0
        assert math.isclose(got[i], of_words + len(words) * math.log10(1 - stop) + math.log10(stop), rel_tol=1e-9)


def brute_targets(size):
    """Targets by weight in code point order, null last; the excess over twice a source's size is shared again."""
    named = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in size if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(named)}
    target, free, rest = {}, list(named), 1.5 * sum(size.values())
    while free:
        share = rest / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > 2 * size[s]]
        for s in over or free:
            target[s] = 2.0 * size[s] if over else share * weight[s]
        free, rest = ([s for s in free if s not in over], rest - sum(2 * size[s] for s in over)) if over else ([], 0)
    return target


def test_mixing(both, none):
    rows_ = texts_of(both)
    size = Counter()
    for _, text, source, _ in rows_:
        size[source] += len(WORD.findall(text or ""))
    got = mix_sources(both).collect()
    assert Counter((r["doc_id"], r["size"], r["source"], r["source_size"]) for r in got) == Counter((i, len(WORD.findall(t or "")), s, size[s]) for i, t, s, _ in rows_)
    target = brute_targets(size)
    assert sum(target.values()) <= 1.5 * sum(size.values()) + 1e-6
    taken = Counter()
    for r in got:
        assert math.isclose(r["target"], target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        assert (r["first_shard"] is None) == (r["taken"] == 0)
        taken[r["source"]] += r["taken"]
    for s in size:
        assert abs(taken[s] - target[s]) <= 32
    assert sorted(map(str, mix_sources(both).collect())) == sorted(map(str, got))
    assert mix_sources(none).count() == 0 and mixed_blocks(none).count() == 0
    assert shards(both).count() > 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 997, 1_000_000])
def test_permutation(spark, n):
    got = mixing.permuted(spark.range(n), F.col("id"), F.lit(n).cast("long"), F.lit(5), "to").toPandas()
    assert sorted(got.to) == list(range(n))
    if n == 1_000_000:
        # numbers of a source of one third in each shard: draws without replacement
        counts = np.bincount(got.to[got.id < n // 3] // mixing.SHARD)[: n // mixing.SHARD]
        want = math.sqrt(mixing.SHARD * (1 / 3) * (2 / 3) * (1 - mixing.SHARD / n))
        assert 0.85 < counts.std() / want < 1.15 and abs(counts.mean() - mixing.SHARD / 3) < 4 * want / math.sqrt(len(counts))


@pytest.mark.parametrize("n", [10**12, 9 * 10**12 + 7, 2**61 - 1])
def test_permutation_of_large_ranges(spark, n):
    i = F.lit(n - 1) - F.col("id") * (n // 5000)
    got = mixing.permuted(spark.range(5000), i, F.lit(n).cast("long"), F.lit(5), "to").toPandas().to
    assert got.nunique() == 5000 and got.between(0, n - 1).all()
    assert 0.45 < (got / n).mean() < 0.55 and 0.27 < (got / n).std() < 0.31


def test_numbers_of_many_sources(spark):
    size = {f"s{k:03d}": (k * 37) % 101 for k in range(300)} | {None: 4}
    docs = spark.createDataFrame([(k, " ".join(["w"] * n), s) for k, (s, n) in enumerate(size.items())], "doc_id long, text string, source string")
    target = brute_targets(size)
    for r in mix_sources(docs).collect():
        assert math.isclose(r["target"], target[r["source"]]) and r["source_size"] == size[r["source"]] and abs(r["taken"] - r["target"]) <= 32


def test_taken_and_text_come_from_the_mixed_slots(docs):
    slots, rows_ = mixed_slots(docs).toPandas(), mix_sources(docs).collect()
    assert sorted(slots.slot) == list(range(len(slots))) and (slots.slot // mixing.SHARD == slots.shard).all()
    text = {i: WORD.findall(t or "") for i, t, *_ in texts_of(docs)}
    words = defaultdict(list)
    for r in sorted(rows_, key=lambda r: r["doc_id"]):
        words[r["source"]] += [(r["doc_id"], w) for w in text[r["doc_id"]]]
    taken, shard, written = Counter(), {}, {}
    for slot, sh, source, block in zip(slots.slot, slots.shard, slots.source, slots.block, strict=True):
        own = words[source][block * mixing.BLOCK : (block + 1) * mixing.BLOCK]
        taken.update(i for i, _ in own)
        shard |= {i: min(sh, shard.get(i, sh)) for i, _ in own}
        written[slot] = " ".join(w for _, w in own)
    assert {r["doc_id"]: (r["taken"], r["first_shard"]) for r in rows_} == {r["doc_id"]: (taken[r["doc_id"]], shard.get(r["doc_id"])) for r in rows_}
    assert {r["slot"]: r["text"] for r in mixed_blocks(docs).collect()} == written


def test_targets_share_the_excess(spark):
    sums = spark.createDataFrame([("a", 10), ("b", 1000), (None, 1000)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.plan_sources(sums).collect()}
    assert got == pytest.approx({"a": 20.0, "b": (3015 - 20) / 3, None: (3015 - 20) * 2 / 3})


def test_near_duplicate_stage_drops_repeated_rows(spark):
    import corpus_pipeline as p

    rows = [(1, NEAR), (1, NEAR), (2, NEAR.upper()), (3, "something else entirely is written here")]
    got = p.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3]


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(p.STAGES[:2] + p.STAGES[3:4]):
        out = stage(spark, docs, sf)
        assert out.columns == columns
    kept = {r["doc_id"] for r in p.quality(spark, docs, sf).collect()}
    assert kept == {r["doc_id"] for r in quality_rules(docs).where("kept").collect()}
    final = p.run(spark, sf).toPandas()
    ids = set(final.doc_id)
    assert ids < kept and len(final) == len(ids)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = [shingle_set(text[i]) for i in ids]
    assert not any(100 * len(a & b) >= 75 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not brute_decontamination([(i, text[i]) for i in sorted(ids)[:10]], items)


CLASHING = ("kept_id", "twice_id", "dirty_id", "component_id", "row", "k", "word")


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_tables(spark, odd, none, sf, stage):
    import corpus_pipeline as p

    name, run = p.STAGES[stage]
    for df, rows in ((odd, len(ODD)), (none, 0)):
        named = df.select("doc_id", "text", "lang", "source", *(F.lit(k).alias(c) for k, c in enumerate(CLASHING)))
        out = run(spark, named, sf)
        assert out.count() <= rows
        if stage < 4:
            assert out.columns == named.columns
    if name == "near_duplicates":
        got = Counter(r["doc_id"] for r in run(spark, odd, sf).collect())
        assert got[5] == 0 and got[4] == 1 and got[10] == 0 and got[None] == 2
