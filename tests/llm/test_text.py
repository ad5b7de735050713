import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelnet.llm import bpe, langid, ngramlm, quality
from panelnet.llm.queries import public_vocabulary
from panelnet.llm.textkernel import slices, word_hashes, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.text(st.sampled_from(list("aB'rel s\n\t\x0b 1é漢🙂.!#")), max_size=60)


def counted(texts):
    parts = [quality.counts(d, o) for _, _, d, o in slices(pa.array(texts, pa.string()))]
    return [tuple(int(x) for x in row) for p in parts for row in zip(*p, strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_and_counts_equal_brute_force(texts):
    for t, got in zip(texts, counted(texts), strict=True):
        w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        runs = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        assert got[:5] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again))


def test_hashes_tell_words_apart():
    texts = [f"w{i} W{i} {i}w" for i in range(3000)]
    for fold, kinds in ((False, 9000), (True, 6000)):
        found = set()
        for _, _, d, o in slices(pa.array(texts), 4000):
            found |= set(word_hashes(d, words(d, o), fold).tolist())
        assert len(found) == kinds


def test_rules_and_verdicts(spark, messy, nothing):
    rows = [(i, " ".join(f"word{(i * 7 + k * k) % 97}" for k in range(60)), "en", "s") for i in range(200)]
    rows += [(500, "### " * 30 + " ".join(f"x{k}###" for k in range(80)), "en", "s"), (501, "a b", "en", "s"), (502, "a b c d e " * 20, "en", "s"), (503, None, "en", "s")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i in range(200)) and not got[500].kept and (got[501].base_failed, got[502].base_failed, got[503].base_failed) == (True, True, True)
    out = quality.judge(messy)
    assert out.count() == messy.count() and quality.judge(nothing).count() == 0
    few = quality.judge(spark.createDataFrame(rows[:5], "doc_id long, text string, lang string, source string")).collect()
    assert all(r.kept and 0 <= r.distance < 1 for r in few)  # a small group is judged too, by about the corpus's spread
    own = quality.judge(spark.createDataFrame([*rows, (900, rows[0][1], "de", None), (901, "?!;: " * 60 + rows[1][1], None, "s")], "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id: r.kept for r in own if r.doc_id > 899} == {900: True, 901: False}  # groups of one row


def lowest(x, share):
    """The least value that has the share of the values at or below it."""
    return np.sort(x, axis=0)[max(math.ceil(share * len(x)) - 1, 0)]


def test_estimates_equal_brute_force(spark):
    """Distances are those of concentration steps done one group at a time; of all subsets of small groups, the least determinant is found nearly always and never undercut."""
    rng, rules = np.random.default_rng(13), quality.Rules()
    groups = {f"g{k}": rng.normal(0, 1, (n, 6)) @ rng.normal(0, 0.6, (6, 6)) + 1 for k, n in enumerate([9] * 10 + [1, 2, 60, 300])}
    for x in groups.values():
        x[: len(x) // 6] += 15
    every = np.concatenate(list(groups.values()))
    rows = spark.createDataFrame([(g, *map(float, r)) for g, x in groups.items() for r in x], "group string, " + ", ".join(f"x{i} double" for i in range(6))).repartition(4)
    params, n = quality.estimates(rows, rules)
    got = {r.group: r for r in params.collect()}
    assert n == len(got) == len(groups)
    spread = lambda x: np.maximum((lowest(x, 0.75) - lowest(x, 0.25)) / 1.349, rules.floors)
    prior = lowest(every, 0.5), spread(every)
    scale, least_found = quality.consistency(rules), 0
    fitted = lambda x: quality.combined(len(x), x.mean(0), np.cov(x.T, bias=True).reshape(6, 6), prior, rules, scale)
    logdet = lambda e: np.linalg.slogdet(e[1])[1]
    distance = lambda x, e: np.einsum("ij,jk,ik->i", x - e[0], np.linalg.inv(e[1]), x - e[0])
    for g, x in groups.items():
        z = (x - lowest(x, 0.5)) / spread(x)
        r2 = (z**2).sum(1)
        inner = z[r2 <= quality.chi2_quantile(0.5, 6)]
        scores = [np.tanh(z).T @ np.tanh(z), (z / np.maximum(r2, 1e-12)[:, None]).T @ z, inner.T @ inner]
        tried = quality.started(len(x), lowest(x, 0.5), spread(x), scores, prior, rules)
        step = lambda e: fitted(x[distance(x, e) <= lowest(distance(x, e), rules.cover) + 1e-12])  # noqa: B023, E731
        for _ in range(rules.start_steps):
            tried = [step(e) for e in tried]
        best = min(tried, key=logdet)
        while logdet(after := step(best)) < logdet(best) - rules.gain:
            best = after
        white = np.array(got[g].white).reshape(6, 6)
        assert math.isclose(got[g].logdet, logdet(best), abs_tol=1e-6)
        assert np.allclose(((x - got[g].centre) @ white.T) ** 2 @ np.ones(6), distance(x, best), rtol=1e-6, atol=1e-8)
        if len(x) == 9:
            least = min(logdet(fitted(x[list(some)])) for some in itertools.combinations(range(9), 7))
            assert got[g].logdet >= least - 1e-9
            least_found += math.isclose(got[g].logdet, least, abs_tol=1e-6)
    assert least_found >= 8
    far = distance(groups["g13"], (np.array(got["g13"].centre), np.linalg.inv(np.array(got["g13"].white).reshape(6, 6).T @ np.array(got["g13"].white).reshape(6, 6))))
    assert (far[:50] > quality.chi2_quantile(1 - rules.tail, 6)).all() and (far[50:] < quality.chi2_quantile(1 - rules.tail, 6)).all()


def test_chi_squared_quantiles():
    assert math.isclose(quality.chi2_quantile(0.95, 6), 12.591587, abs_tol=1e-5)
    assert math.isclose(quality.chi2_quantile(0.99, 2), 9.210340, abs_tol=1e-5)


@pytest.fixture(scope="module")
def coder():
    v = public_vocabulary()
    return bpe._encoding(v.read(), v.pattern)


#: Another public pattern, whose matches may hold a line break behind a mark, and one whose matches hold two words and a space.
PATTERNS = (
    None,
    r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+",
    r"\p{L}+ \p{L}+|\p{L}+|[.!]+\n?| +|\s|.",
)


@pytest.mark.parametrize("pattern", PATTERNS)
@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab'rel lsvt  \n\n\t\r\x0b\x85 　 1é漢🙂.!")), max_size=120), st.integers(1, 40))
def test_tree_encoding_is_the_whole_text_s(coder, pattern, text, leaf):
    own = coder if pattern is None else bpe._encoding(public_vocabulary().read(), pattern)
    ids = bpe.encode_tree(text, own.encode_to_numpy, bpe.splitter(pattern or public_vocabulary().pattern), leaf)
    assert ids.tolist() == own.encode_ordinary(text)
    assert bpe.decode_tree(ids, own.decode_bytes, 3) == "".join(m[0] for m in bpe.splitter(pattern or public_vocabulary().pattern).finditer(text)).encode()


def test_windows_stay_small_on_prose(coder):
    rng, seen = random.Random(1), []
    text = " ".join(rng.choice(["alpha", "don't", "x.\n", "42", "bêta", "a  b"]) for _ in range(20000))
    ids = bpe.encode_tree(text, lambda t: (seen.append(len(t)), coder.encode_to_numpy(t))[1], bpe.splitter(public_vocabulary().pattern), 500)
    assert ids.tolist() == coder.encode_ordinary(text) and max(seen) <= 500 and sum(seen) < 2 * len(text)


@pytest.mark.parametrize("pattern", [r"(?<=a)b|.", r"\bx|.", r"^a|.", r"a$|."])
def test_patterns_that_look_behind_are_refused(pattern):
    with pytest.raises(ValueError, match="looks behind"):
        bpe.splitter(pattern)


def test_encoding_tables(spark, messy, nothing, coder):
    rows = [(r.doc_id, r.text) for r in messy.collect()] + [(900, "<|endoftext|> don't we're  x\n\n  y" * 3000), (901, "a" * 70000), (902, " " * 50000)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "doc_id long, text string, n_tokens string, other int")
    enc = bpe.bpe_encode(df, public_vocabulary(), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))
    got = enc.collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(r[0]) for r in rows) and got[0].other == 1
    text = {r[0]: r[1] or "" for r in rows}
    for r in got:
        ids = coder.encode_ordinary(text[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    back = bpe.bpe_decode(enc.select("doc_id", "ids"), public_vocabulary())
    assert {r.doc_id: bytes(r.decoded).decode() for r in back.collect()} == text
    assert bpe.bpe_encode(nothing, public_vocabulary()).count() == 0


def test_a_large_rank_file_is_refused(tmp_path, monkeypatch):
    (tmp_path / "r").write_bytes(b"x" * 100)
    monkeypatch.setattr(bpe, "MOST_RANK_BYTES", 50)
    with pytest.raises(ValueError, match="exceeds"):
        bpe.Vocabulary(str(tmp_path / "r"), "x").read()


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("model", [ngramlm.Model(), ngramlm.Model(exact_words=3, part_tokens=100, round_bytes=1 << 11)])
def test_scores_equal_brute_force(messy, model):
    train = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) != 0
    rows = messy.collect()
    c = collections.Counter(w for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 for w in [*WORD.findall(fold(r.text)), None])
    n, v = sum(c.values()), len(c)
    got = collections.defaultdict(list)
    for r in ngramlm.score_texts(messy, train, model).collect():
        got[r.doc_id].append(r)
    for r in rows:
        t = [*WORD.findall(fold(r.text)), None]
        x = got[r.doc_id][0]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(x.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
        assert x.score < 0
    assert sum(len(x) for x in got.values()) == len(rows)


@pytest.mark.parametrize("model", [ngramlm.Model(probes=24, more_probes=24), ngramlm.Model(probes=24, more_probes=24, exact_words=3, part_tokens=500, round_bytes=1 << 12)])
def test_bigram_scores_equal_a_model_of_all_counts(spark, model):
    """Every bigram of training counts, single ones too: scores lie between those of the levels below and above the counts, which meet at powers of two."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(30) * rng.randrange(30)}" for _ in range(rng.randrange(0, 60)))) for i in range(400)] + [(1000 + i, f"p{i} q{i}") for i in range(20) for _ in range(1 + i % 2)]
    c, c2 = collections.Counter(), collections.Counter()
    for i, t in rows:
        w = [*t.split(), None]
        if i % 5:
            c.update(w)
            c2.update(itertools.pairwise(w))
    n, v = sum(c.values()), len(c)
    false, low, high = v / 2.0**24, {}, {}
    two = lambda x, up: 0 if not x else 2.0 ** (math.ceil if up else math.floor)(math.log2(x))
    for i, t in rows:
        w = [*t.split(), None]
        p1 = lambda x, up=None: ((c[x] if up is None or not c[x] else two(c[x], up)) + 0.1) / (n + 0.1 * (v + 1))
        for store, up in ((low, False), (high, True)):
            store[i] = math.log10(p1(w[0])) + sum(math.log10(p1(x)) + math.log10(4 / (c[h] + 4 + false)) + math.log10(1 + two(c2[h, x], up) / (4 * (p1(x) if model.exact_words > 3 else p1(x, not up)))) for h, x in itertools.pairwise(w))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in ngramlm.score_texts(docs, F.col("doc_id") % 5 != 0, model).collect()}
    assert len(got) == len(high) and sum(x == 1 for x in c2.values()) > 100 and max(c2.values()) > 8
    assert all(low[i] - 1e-6 <= got[i] <= high[i] + 1e-6 for i in got)
    exact = [i for i in got if math.isclose(low[i], high[i], rel_tol=1e-9)]
    assert len(exact) > 10 and all(math.isclose(got[i], low[i], rel_tol=1e-9) for i in exact)


def test_texts_are_read_as_often_however_large_the_filter_is(spark):
    """The filter of the longer table has many times the stretches; texts go through a mapper that counts the rows it passes on."""
    rng = random.Random(3)
    model = ngramlm.Model(exact_words=3, part_tokens=100, round_bytes=1 << 11)
    times = []
    for n in (20, 400):
        passed = spark.sparkContext.accumulator(0)

        def counted(batches, passed=passed):
            for b in batches:
                passed.add(len(b))
                yield b

        rows = [(i, " ".join(f"w{rng.randrange(2000)}" for _ in range(20))) for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
        assert len({r.doc_id for r in ngramlm.score_texts(docs, F.col("doc_id") % 5 != 0, model).collect()}) == n
        times.append(passed.value / n)
    assert times[0] == times[1] <= 5


def test_rows_that_repeat_score_as_single_ones_with_their_counts(spark):
    """Beyond the stretch of frequent bigrams: repeated rows are not added up in the score."""
    rows = [(i, f"a b c d{i % 7} e{i % 5} f a b") for i in range(60)]
    model = ngramlm.Model(exact_words=3, part_tokens=50, round_bytes=1 << 11)
    plain = spark.createDataFrame([*rows, (500, "a b d1 e1 b c")], "doc_id long, text string")
    more = spark.createDataFrame([*rows, *[(500, "a b d1 e1 b c")] * 3], "doc_id long, text string").repartition(3)
    one = {r.doc_id: r.score for r in ngramlm.score_texts(plain, F.col("doc_id") < 500, model).collect()}
    got = ngramlm.score_texts(more, F.col("doc_id") < 500, model).collect()
    assert len(got) == 63 and all(math.isclose(r.score, one[r.doc_id], rel_tol=1e-9) for r in got)


def test_probabilities_of_a_head_sum_to_one(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(vocabulary[min(rng.randrange(60), rng.randrange(60))] for _ in range(40))) for i in range(150)]
    asked = {"": 10_000} | {w: 10_001 + k for k, w in enumerate(vocabulary)}
    heads = ["w0", "w5", "w20", "w40", "w59"]
    asked |= {f"{h} {w}": 20_000 + 100 * k + i for k, h in enumerate(heads) for i, w in enumerate(vocabulary)}
    docs = spark.createDataFrame(rows + [(i, t) for t, i in asked.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in ngramlm.score_texts(docs, F.col("doc_id") < 10_000, ngramlm.Model(probes=8)).collect()}
    end = got[asked[""]].base_score
    one = {w: got[asked[w]].base_score - end for w in vocabulary}
    for h in heads:
        mass = sum(10 ** (got[asked[f"{h} {w}"]].score - got[asked[w]].score - one[h] + one[w]) for w in vocabulary) + 10 ** (got[asked[h]].score - one[h])
        assert abs(mass - 1) < 0.12, (h, mass)


def test_scores_without_training_and_of_nothing(messy, nothing):
    got = ngramlm.score_texts(messy, F.lit(False)).collect()
    assert all(r.n_known == 0 and math.isclose(r.base_score, r.n_tokens * math.log10(0.1 / 0.1), abs_tol=1e-9) for r in got)
    assert ngramlm.score_texts(nothing, F.lit(True)).count() == 0


def test_filter_reads_counts_back_and_never_too_low():
    model = ngramlm.Model()
    key = ngramlm.mix(np.arange(1, 20001, dtype=np.uint64))
    count = 1 + np.arange(20000) % 3000
    stretch = ngramlm._filled(model)((pa.scalar(0),), pa.table({"keys": [key.tobytes(), key[:100].tobytes()], "counts": [(count - (np.arange(20000) < 100)).astype(np.uint32).tobytes(), np.ones(100, np.uint32).tobytes()]}))
    table = ngramlm.Filter(np.frombuffer(stretch["bits"][0].as_py(), np.uint8), np.zeros(2, np.int64), np.array([stretch["size"][0].as_py() * 8, 0]), model)
    level = model.level(key, count)
    got = table.levels(key, np.zeros(20000, np.int64))
    assert (got >= level).all() and (got == level).mean() > 0.99
    assert abs(model.value(level).sum() / count.sum() - 1) < 0.01  # right on average
    other = ngramlm.mix(np.arange(1 << 20, (1 << 20) + 100000, dtype=np.uint64))
    assert (table.levels(other, np.zeros(100000, np.int64)) > 0).sum() < 15 and not table.levels(key, np.ones(20000, np.int64)).any()


def test_bigrams_that_training_has_score_higher(spark):
    docs = spark.createDataFrame([(i, "a b a c a b b a") for i in range(50)] + [(1000, "a b a b a"), (1001, "a a a a a"), (1002, "a zz zz zz a")], "doc_id long, text string")
    got = {r.doc_id: r for r in ngramlm.score_texts(docs, F.col("doc_id") < 1000).collect()}
    assert got[1000].score > got[1001].score > got[1002].score and got[1000].score > got[1000].base_score
    assert (got[1002].n_known, got[1002].n_tokens) == (3, 6)


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(6)
    first = np.array([0, 0, 5, 6, 6, 12])
    score = rng.normal(0, 5, (12, 3)).astype(np.float32)
    got = langid.viterbi(score, first, 4.0)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if a < b:
            value = lambda p: sum(score[a + t, s] for t, s in enumerate(p)) - 4.0 * sum(x != y for x, y in itertools.pairwise(p))  # noqa: B023, E731
            assert math.isclose(value(got[a:b]), max(map(value, itertools.product(range(3), repeat=b - a))), abs_tol=1e-3)


@pytest.mark.parametrize("k", [127, 128, 129, 300])
def test_viterbi_of_many_languages(k):
    rng = np.random.default_rng(k)
    truth = rng.integers(0, k, 6)
    truth[0] = k - 1
    score = np.full((60, k), -10.0, np.float32)
    score[np.arange(60), np.repeat(truth, 10)] = 0
    assert langid.viterbi(score, np.array([0, 60]), 4.0).tolist() == np.repeat(truth, 10).tolist()


def test_word_scores_equal_brute_force_for_300_languages(spark):
    """Languages of words of their own, more than a byte tells apart: every text gets its own language, and scores are those of its trigrams."""
    word = lambda i, k: f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + k)}{i % 7}x"
    rows = [(i * 10 + k, " ".join(word(i, (k + j) % 20) for j in range(12)), f"l{i:03}") for i in range(300) for k in range(2)]
    learned = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5), F.lit(True))
    assert len(learned.langs) == 300
    buckets, counts = langid.Settings().buckets, collections.defaultdict(collections.Counter)
    hashed = lambda g: int(langid.mix(np.array([g[0] << 16 | g[1] << 8 | g[2]], np.uint64))[0]) & (buckets - 1)
    grams = lambda w: [hashed(b) for b in zip(b" " + w[:-1], w, w[1:] + b" ", strict=True)]
    for _, t, lang in rows:
        for w in t.encode().split():
            counts[lang].update(grams(w))
    data = b"fcj2x aab0x 12"
    w = words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    got, letters = langid._word_scores(np.frombuffer(data, np.uint8), w, learned, buckets)
    for n, x in enumerate(data.split()[:2]):
        want = np.array([sum(math.log((counts[lang][g] + 0.5) / (sum(counts[lang].values()) + 0.5 * buckets)) for g in grams(x)) for lang in learned.langs])
        assert np.allclose(got[n], np.maximum(want - want.max(), -200), atol=1e-3)
    assert not got[2].any() and letters.tolist() == [4, 4, 0]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), learned).collect()
    assert sum(r.lang_pred == f"l{r.doc_id // 10:03}" for r in out) > 590
    with pytest.raises(ValueError, match="more than 10 languages"):
        langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), langid.Settings(most_langs=10))


def test_languages_spans_and_odd_texts(spark, messy, nothing):
    en, de, ru = "the house and the garden with water", "das haus und der garten mit wasser für", "дом и сад с водой для всех"
    rows = [(i, " ".join([t] * 5), lang) for i in range(12) for t, lang in ((en, "en"), (de, "de"), (ru, "ru"))] + [(99, "x", None), (98, None, "en")]
    learned = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert learned.langs == ("de", "en", "ru")
    test = [(1, en), (2, de), (3, ru), (4, " ".join([en] * 6 + [de] * 2)), (5, None), (6, "12 34 ..."), (7, ""), (8, "漢字"), (9, " ".join([de] * 3000))]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(test, "doc_id long, text string"), learned, spans=True).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 6, 7, 9)] == ["en", "de", "ru", "en", "und", "und", "und", "de"]
    assert [s.lang for s in got[4].spans] == ["en", "de"] and got[4].spans[1].begin == 42 and 0.5 < got[4].score < 1
    assert got[5].score == 0 and got[1].score == 1 and got[8].lang_pred in learned.langs
    assert langid.identify(messy, learned).count() == messy.count() and langid.identify(nothing, learned).count() == 0
    none = langid.learn(nothing, F.lit(True))
    assert {r.lang_pred for r in langid.identify(messy, none).collect()} == {"und"}
