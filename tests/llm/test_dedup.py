import random
import re

import numpy as np

from panelnet.llm.components import components
from panelnet.llm.linededup import dedup_lines, repeated_runs
from panelnet.llm.minhash import Near, near_duplicates, superminhash
from panelnet.llm.textkernel import mix
from panelnet.llm.vectors import Close, near_vectors

from llm_texts import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = WORD.findall(fold(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def grouped(ids, linked):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in linked:
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_near_duplicates_equal_brute_force(messy):
    rows = {(r.doc_id, r.text) for r in messy.collect() if r.doc_id is not None}
    sets = {i: shingles(t) for i, t in rows}
    linked = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = grouped(sets, linked)
    for near in (Near(), Near(block_rows=3, block_shingles=200)):
        got = near_duplicates(messy, near).collect()
        assert len(got) == messy.count()
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert len(set(want.values())) < len(want) - 20


def test_repeated_ids_join_what_their_texts_link_to(spark):
    rng = random.Random(11)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (9, b), (7, c), (7, ""), (7, c), (20, c)]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == [(1, 1, True), (5, 1, False), (5, 1, False), (7, 7, True), (7, 7, True), (7, 7, True), (9, 1, False), (20, 7, False)]
    x, y = [1.0, 0.0, 0.2], [0.0, 1.0, 0.2]
    vectors = spark.createDataFrame([(3, x, 1), (5, x, 1), (5, y, 1), (9, y, 1), (9, x, 2)], "vec_id long, embedding array<double>, label int").repartition(3)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(vectors).collect())
    assert got == [(3, 1, 3, True), (5, 1, 3, False), (5, 1, 3, False), (9, 0, 3, False), (9, 1, 3, False)]


def test_large_buckets_fall_into_their_groups(spark):
    """One band of one row puts nearly all texts into a few buckets of many blocks, where several groups and single texts meet."""
    rng = random.Random(12)
    base = [[f"g{g}w{j}" for j in range(60)] for g in range(4)]
    rows = [(i, " ".join([*base[i % 4][: 58], f"x{rng.randrange(300)}", f"y{rng.randrange(300)}"])) for i in range(160)] + [(200 + i, prose(rng, 40)) for i in range(30)]
    sets = {i: shingles(t) for i, t in rows}
    want = grouped(sets, [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for near in (Near(block_rows=8, block_shingles=400), Near(bands=60, rows=1, margin=0.4, block_rows=7, block_shingles=600)):
        assert {r.doc_id: r.component_id for r in near_duplicates(docs, near).collect()} == want
    assert len(set(want.values())) == 34


def test_near_duplicates_of_nothing(nothing):
    assert near_duplicates(nothing).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for n in (6, 40, 400):
        for share in (0.5, 0.9):
            pool = mix(rng.integers(1, 1 << 62, 2 * n, dtype=np.uint64))
            common = int(n * share)
            x, y = pool[:n], np.concatenate((pool[:common], pool[n : 2 * n - common]))
            sig = superminhash(np.concatenate((x, y)), np.array([0, n, 2 * n]), 125)
            errors.append(abs((sig[0] == sig[1]).mean() - common / (2 * n - common)))
    assert max(errors) < 0.17
    assert (superminhash(np.array([5], np.uint64), np.array([0, 1]), 125) >> np.uint64(32)).max() == 124


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300), (None, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == grouped([i for i in range(61)] + list(range(100, 140)) + [200, 201, 202], [(a, b) for a, b in edges if a is not None and a != 300])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def line_brute(rows, least):
    seen, out = {}, {}
    for i, text in sorted(rows):
        lines = text.split("\n")
        bare = [x.strip("\x20\x09\x0a\x0b\x0c\x0d") for x in lines]
        n = [len(WORD.findall(x)) for x in bare]
        full = [p for p in range(len(lines)) if n[p]]
        gone = set()
        for a in range(len(full)):
            b, total = a, 0
            while b < len(full) and total < least:
                total += n[full[b]]
                b += 1
            if total < least:
                break
            key = tuple(bare[p] for p in full[a:b])
            first = seen.setdefault(key, (i, full[a], full[b - 1]))
            if first[0] != i or full[a] > first[2]:
                gone |= set(range(full[a], full[b - 1] + 1))
        out[i] = ("\n".join(x for p, x in enumerate(lines) if p not in gone), len(gone))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 9))) for _ in range(25)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\r"]) for _ in range(rng.randrange(0, 25)))) for i in range(60)]
    rows += [(100, "a b\n" * 40), (101, None), (102, ""), (103, " ".join(["long"] * 20000)), (104, " ".join(["long"] * 20000))]
    df = spark.createDataFrame([(*r, "x", 7, "y") for r in rows], "doc_id long, text string, n_lines string, n_removed int, h string")
    for least in (8, 50):
        want = line_brute([r for r in rows if r[1] is not None], least)
        got = {r.doc_id: r for r in dedup_lines(df, least).collect()}
        assert len(got) == len(rows) and got[101].text is None and got[101].n_removed == 0 and got[5].h == "y"
        assert {i: (r.text, r.n_removed) for i, r in got.items() if i != 101} == want
    assert want[104][0] == "" and want[103][1] == 0


def test_line_dedup_of_repeated_rows(spark):
    run = "\n".join(f"line {i} has six words now" for i in range(12))
    other = "top\n" + run + "\nend"
    get = lambda rows: sorted((r.doc_id, r.text, r.n_removed) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert get([(1, run), (2, run)]) == [(1, run, 0), (2, "", 12)]
    assert get([(1, run), (2, run), (2, run)]) == [(1, run, 0), (2, "", 12), (2, "", 12)]
    assert get([(1, run), (1, run), (2, other)]) == [(1, run, 0), (1, run, 0), (2, "top\nend", 12)]
    kept = get([(3, run), (3, other)])  # one of two texts of an id comes first, by hash
    assert [r[2] for r in kept] in ([0, 12], [12, 0]) and {r[1] for r in kept} in ({run, "top\nend"}, {"", other})
    odd = dedup_lines(spark.createDataFrame([(None, run), (None, run), (1, other)], "doc_id long, text string"))
    assert {(r.doc_id, r.text, r.n_removed) for r in odd.collect()} == {(None, run, 0), (1, other, 0)} and odd.count() == 3


def test_runs_name_their_first_place_and_odd_rows_stay(spark, messy, nothing):
    lines = "\n".join(f"line {i} has six words now" for i in range(20))
    df = spark.createDataFrame([(1, "head\n" + lines), (2, lines + "\ntail"), (3, "x")], "doc_id long, text string")
    assert [tuple(r) for r in repeated_runs(df).collect()] == [(2, 0, 19, 1, 1)]
    assert dedup_lines(nothing).count() == 0
    out = dedup_lines(messy)
    assert out.count() == messy.count() and out.filter("doc_id is null").first().text == "one two three four five six"


def test_vectors_equal_brute_force(spark, nothing):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 16))
    rows = [(i, (base[i % 30] + 0.05 * rng.standard_normal(16) * (i // 30)).tolist(), i % 3 if i % 17 else None) for i in range(150)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [1.0, None], 1), (204, [float("inf")] * 16, 1), (205, [], 1), (206, [1.0, 2.0], 1), (207, [2.0, 4.0], 1), (208, rows[1][1], 1), (209, rows[1][1], 2), (None, rows[1][1], 1)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "vec_id long, embedding array<float>, label int, links string").repartition(3)
    fine = {i: (np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(i, j) for i, (a, x) in fine.items() for j, (b, y) in fine.items() if i < j and x == y and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98]
    want = grouped([r[0] for r in rows if r[0] is not None], links)
    count = {i: sum(i in p for p in links) for i in want}
    for close in (Close(), Close(block_rows=4, bucket=1 << 20)):
        got = near_vectors(df, close).collect()
        assert len(got) == len(rows)
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == {i: (count[i], want[i], want[i] == i) for i in want}
    assert near_vectors(df.limit(0)).count() == 0


def test_joined_rows_come_as_stars(spark, monkeypatch):
    """Links that many buckets found are not read again once the components of the first round are known."""
    from panelnet.llm import minhash

    counts, whole = [], minhash.components

    def counted(links):
        counts.append(links.count())
        return whole(links)

    monkeypatch.setattr(minhash, "components", counted)
    texts = [(k, " ".join(f"w{n}" for n in range(300)) + f" x{k}") for k in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = minhash.near_duplicates(docs, minhash.Near(block_rows=8)).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 60
    assert counts[1] < counts[0] / 2
