import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from panelnet.llm import chat
from panelnet.llm.mixing import mix
from panelnet.llm.queries import op9_chat_formatting
from panelnet.llm.sharding import pack, shards

from llm_texts import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes, weights, most=3.0):
    """Targets by reference: cap and reshare until none is above."""
    total, capped, target = sum(sizes.values()), set(), {}
    while True:
        free = [s for s in sizes if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        level = rest / sum(weights[s] for s in free) if free else 0
        target = {s: most * sizes[s] if s in capped else level * weights[s] for s in sizes}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix_meets_targets(spark, messy):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(1, 60)), f"s{min(i % 9, 5)}" if i % 11 else None) for i in range(600)] + [(1000 + i, prose(rng, 5), "tiny") for i in range(3)] + [(2000, None, "s1"), (2001, "", "s2"), (0, "x", "s0"), (0, "x", "s0")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, source string, size int, taken string").repartition(4)
    got = mix(df).collect()
    assert len(got) == len(rows) and sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in mix(df).collect())
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = filled(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * want[r.source] and r.source_size == sizes[r.source] and r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes) and abs(want["tiny"] - 45) < 1e-9
    assert mix(messy).count() == messy.count() and mix(messy.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_fills_what_a_giant_document_leaves(spark, seed):
    rows = [(i, "a b c d e", "s") for i in range(4000)] + [(9000, "w " * 10000, "s")] + [(10000 + i, "a b c d e f", "t") for i in range(5000)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), seed=seed).filter("source = 's'").collect()
    assert got[0].target == 20000 and got[0].source_size == 30000
    assert sum(r.taken for r in got) > got[0].target - 5


def test_mix_of_many_equal_rows(spark):
    """Equal rows share their random number; the cut goes through them all the same, and reruns agree."""
    rows = [(7, "a b c d", "s")] * 6000 + [(None, None, None)] * 50 + [(None, "x y", None)] * 700 + [(i, "p q r", "t") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    once, again = (collections.Counter((r.doc_id, r.source, r.copies, r.taken) for r in mix(docs).collect()) for _ in range(2))
    target = {r.source: r.target for r in mix(docs).collect()}
    taken = collections.Counter()
    for (_, source, _, words), n in once.items():
        taken[source] += words * n
    assert once == again and sum(once.values()) == len(rows)
    assert all(0 <= target[s] - taken[s] < 4 for s in target) and len({k[2] for k in once if k[1] == "s"}) == 2
    out = corpus_pipeline.mix_sources(spark, spark.createDataFrame([(*r[:2], "en", r[2], 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert collections.Counter(r.source for r in out.collect()) == {s: sum(n * k[2] for k, n in once.items() if k[1] == s) for s in target}


def test_packing_balances_all_dimensions():
    rng = np.random.default_rng(2)
    sizes = rng.lognormal(0, 1, (3000, 3))
    own = pack(sizes, 7)
    load = np.stack([sizes[own == s].sum(axis=0) for s in range(7)])
    assert (np.abs(load / load.mean(axis=0) - 1) < 0.02).all()
    assert len(pack(np.zeros((0, 3)), 4)) == 0 and set(pack(np.zeros((5, 3)), 4)) <= {0, 1, 2, 3}


def test_shards_of_messy_and_skewed_tables(spark, messy):
    rng = random.Random(9)
    hot = prose(rng, 50)
    rows = [(i, prose(rng, rng.randrange(20, 80))) for i in range(3000)] + [(5000 + i, hot) for i in range(900)] + [(9000 + i, rng.choice(["same text", None, ""])) for i in range(30)]
    got = shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 6).collect()
    text = dict(rows)
    assert sorted(r.doc_id for r in got) == sorted(text)
    by = collections.defaultdict(list)
    for r in got:
        t = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 8, zlib.crc32(t))
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    load = np.array([sum(r.size for r in x) for x in by.values()])
    assert len(by) == 6 and np.abs(load / load.mean() - 1).max() < 0.05
    places = collections.defaultdict(set)
    for r in got:
        places[text[r.doc_id] or ""].add(r.shard)
    assert all(len(x) == 1 for t, x in places.items() if t != hot) and len(places[hot]) > 1
    assert shards(messy, 4).count() == messy.count() and shards(messy.limit(0), 4).count() == 0


PIECES = st.lists(st.sampled_from(["<|turn|>", "<|end|>", "<|text|>", "[INST]", "[/INST]", "</s>", "<s>", "\\", "|", "<", "a", "\n", "é", "$1", ">", "<\\|"]), max_size=8).map("".join)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), PIECES), min_size=1, max_size=4), min_size=1, max_size=12))
def test_chats_read_back(spark, talks):
    rows = [(c, t, 0, "message", role, text) for c, talk in enumerate(talks) for t, (role, text) in enumerate(talk)]
    out = chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, seq int, kind string, role string, text string"))).collect()
    for r in out:
        assert [(t.role, t.text) for t in r.turns] == talks[r.conv_id]
        assert r.loss == [x for role, x in talks[r.conv_id] if role == "assistant"]


def test_events_fold_into_messages(spark):
    e = [(1, 0, 1, "message", "user", "hi"), (1, 1, 2, "delta", "assistant", "He"), (1, 1, 3, "delta", None, "llo"), (1, 1, 4, "regenerate", "assistant", None), (1, 1, 6, "delta", None, "d"), (1, 1, 5, "delta", None, "Goo"), (1, 0, 7, "edit", None, "hello"), (2, 0, 1, "delta", "user", None), (None, 0, 1, "message", None, None), (1, 2, 9, "odd", "user", "bye")]
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold(spark.createDataFrame(e, "conv_id long, turn long, seq long, kind string, role string, text string").repartition(3)).collect()}
    assert got == {(1, 0): ("user", "hello"), (1, 1): ("assistant", "Good"), (1, 2): ("user", "bye"), (2, 0): ("user", ""), (None, 0): (None, "")}


def test_chat_query_on_odd_rows(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, None, None, "x"), (3, 0, "assistant", "é" * 50000), (1, 10, "user", "z"), (1, 9, "assistant", "y\\")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op9_chat_formatting(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 5 and got[1].turns_sha256 == sha("user\na\nassistant\n\nassistant\n\nassistant\ny\\\nuser\nz\n") and got[1].loss_sha256 == sha("y\\") and got[1].loss_chars == 2
    assert got[-7].n_turns == 2 and got[-7].loss_sha256 == sha("</s>[INST] ok [/INST]") and got[3].loss_chars == 50000 and got[2].n_turns == 1


def test_near_dedup_stage_links_from_a_similarity_of_0_8(spark):
    rows = []
    for i in range(40):
        w = [f"d{i}w{j}" for j in range(104)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[: 85 + i % 5], "x"]))]  # 100 sets of five words against 81 to 85 and one more
    rows += [(1000 + k, " ".join([f"e{j}" for j in range(104 - 26 * k)])) for k in range(2)]  # 74 of 100
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {2 * i for i in range(40)} | {1000, 1001}


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(4)
    lines = "\n".join(prose(rng, 15) for _ in range(4))
    texts = [prose(rng, 60) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, texts[3].replace("changed", "x") + " end"), (101, texts[0] + "\n" + lines), (102, texts[1] + "\n" + lines), (103, "123 456"), (104, None), (105, texts[7])]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        now = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = now.collect()
    ids = {k: {r.doc_id for r in x} for k, x in seen.items()}
    assert ids["language_id"] == set(dict(rows)) - {103, 104}
    cut = {r.doc_id: r.text for r in seen["line_dedup"]}
    assert 105 not in cut and cut[101] == lines and 102 not in cut and all(cut[i] == texts[i] for i in range(30))
    assert ids["near_dedup"] == ids["line_dedup"] - {100} and {r.doc_id: r.n_chars for r in seen["near_dedup"]}[101] == len(lines)
    copies = collections.Counter(r.doc_id for r in seen["mix_sources"])
    assert set(copies) <= ids["near_dedup"] and max(copies.values()) <= 3
    assert collections.Counter(r.doc_id for r in seen["encode"]) == copies
    assert all(r.decoded_sha256 == hashlib.sha256(cut[r.doc_id].encode()).hexdigest() and len(r.ids) == r.n_tokens for r in seen["encode"])
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "ids_sha256").collect())) == sorted(str(r) for r in now.select("doc_id", "ids_sha256").collect())
    with pytest.raises(Exception, match=r"."):
        corpus_pipeline.run(spark, str(tmp_path / "nowhere")).count()
