import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinlake.llm import leakage, lookalike, looks, mixing

SAFE = re.compile("[\x00-\x7f¡-¬®-ſ]")


def docs(spark, texts, **more):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts, 1)], "doc_id bigint, text string, form string")


def test_table_is_sound():
    table = looks.look_table()
    assert not [c for c in table if SAFE.match(c)]  # what is not suspect never changes
    assert all(looks.fold(looks.fold(c)) == looks.fold(c) for c in table)
    assert len({looks.fold(c) for c in "1lI0OaAá2"}) == 9


def test_column_fold_equals_python_fold(spark):
    rng = random.Random(4)
    signs = list(looks.look_table()) + list("aéÅßé̈ \n\t¿µ") + ["é", "가", "Å", "क़"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 30))) for _ in range(300)] + ["", None, "plain"]
    df = docs(spark, texts)
    got = {r.doc_id: r.f for r in df.select("doc_id", looks.fold_text(F.col("text")).alias("f")).collect()}
    assert got == {i: None if t is None else looks.fold(t) for i, t in enumerate(texts, 1)}


def test_trie_with_costs():
    trie = lookalike.Trie({"house": 3, "hours": 1, "mouse": 2})
    assert trie.search("hоu​sе") == {"house": 0}  # Cyrillic o and e, a zero-width space
    assert trie.search("hause") == {} and trie.search("hause", budget=1) == {"house": 1}
    assert trie.search("hhouse", budget=1) == {"house": 1} and trie.search("", budget=0) == {}
    more = lookalike.Trie({"ä": 1, "Märö": 2, "fine": 1, "x" * 20000: 1})
    assert more.search("\u04d3") == {"ä": 0} and more.search("М\u200bа\u0308r\u04e7") == {"Märö": 0} and more.search("ﬁne") == {"fine": 0}
    assert more.search("x" * 9999 + "\u00ad" + "х" * 10001) == {"x" * 20000: 0}  # no length is left out


def test_marks_do_not_hide_letters():
    for odd, plain in (("\u04d3", "ä"), ("а\u0308", "ä"), ("\u0451", "ë"), ("\u03cc", "ó"), ("ﬂa", "fla"), ("a\U000e0041b\U000e0100", "ab"), ("\u04e7\u0300", "ö\u0300")):
        assert looks.fold(odd) == unicodedata.normalize("NFC", plain), odd


def test_shards_follow_the_tokens(spark):
    texts = [f"w{i}\u200b w{i}" for i in range(300)] + ["мир", "cоp cop"]
    one = {(r.token, r.form, r.matched) for r in lookalike.spellings(docs(spark, texts)).collect()}
    many = {(r.token, r.form, r.matched) for r in lookalike.spellings(docs(spark, texts), per_shard=7).collect()}
    assert one == many and ("w7\u200b", "w7", True) in one and ("мир", "мир", True) in one


def test_same_looks(spark):
    pairs = [("naïve cat", "naïve cat"), ("naïve cat", "naïve cat"), ("Ab 1", "Ａｂ　１"), ("cop", "сор"), ("x​y", "xy")]
    texts = [t for p in pairs for t in p] + ["naive cat", "NAÏVE cat", "cat naïve", "ab 1", "Ab 2", "", "", None, "cop", "xy\nz", "xy z", "​", "﻿"]
    df = docs(spark, texts)
    got = {tuple(r) for r in lookalike.same_look_pairs(df).collect()}
    want = {(i, j) for i, a in enumerate(texts, 1) for j, b in enumerate(texts, 1) if i < j and a and b and a != b and looks.fold(a) == looks.fold(b)}
    assert got == want and (11, 12) not in got and len(got) > 6
    assert lookalike.same_look_pairs(docs(spark, [])).count() == 0
    classes = {r.doc_id: r for r in lookalike.look_classes(df).collect()}
    assert classes[1].class_id == classes[2].class_id == 1 and classes[1].form == "naïve cat" and len(classes) == len(texts)
    assert classes[16].form == "" and classes[18].form is None


def test_words_of_one_script_keep_it(spark):
    texts = ["мир сон", "мир", "сон", "nose сорока", "Мiр"]  # the last has a Latin i in a Cyrillic word
    got = [r.out for r in lookalike.normalize_looks(docs(spark, texts), into="out").orderBy("doc_id").collect()]
    assert got[:4] == texts[:4]


def brute_runs(docs_, items, n):
    w = lambda t: re.findall(r"[^\W_]+", looks.fold(t or "").lower().replace("ß", "ss"))

    def grams(t):
        v = w(t)
        return {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}

    held = [(j, grams(b)) for j, b in items]
    return {(i, j) for i, a in docs_ for g in [grams(a)] for j, h in held if g & h}


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    vocab = ["the", "of", "dose", "knee", "left", "was", "seen", "straße", "é", "12", "view", "MBq", "in"] + [f"w{i}" for i in range(40)]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    items = [(j, text(rng.randrange(3, 30))) for j in range(12)] + [(98, ""), (99, None)]
    bodies = [text(rng.randrange(0, 60)) for _ in range(120)]
    for k in range(0, 120, 4):  # plant whole items and parts, disguised
        part = (items[k % 12][1] or "").split()
        cut = rng.randrange(0, 5)
        bodies[k] += ". " + ",\n".join(part[cut:]).upper().replace("O", "О")
    bodies += ["", None, "..", text(3000) + " " + items[0][1]]
    df = docs(spark, bodies)
    its = spark.createDataFrame([(j, t, "val" if j % 2 else " TEST ") for j, t in items] + [(50, items[0][1], "train"), (51, items[0][1], None)], "item_id bigint, item_text string, split string")
    for run in (4, 12):
        got = {(r.doc_id, r.item_id): (r.longest, r.matched) for r in leakage.leaks(df, its, run).collect()}
        assert set(got) == brute_runs(list(enumerate(bodies, 1)), items, run), run
        twice = leakage.leaks(df.union(df), its.union(its), run)  # repeated rows change nothing
        assert {(r.doc_id, r.item_id): (r.longest, r.matched) for r in twice.collect()} == got
        index = leakage.PositionalIndex(df, leakage.held_out(its), broadcast_windows=0)  # the way without a broadcast
        assert {(r.doc_id, r.item_id): (r.longest, r.matched) for r in index.phrases(run).collect()} == got
    assert leakage.leaks(docs(spark, []), its).count() == 0 and leakage.leaks(df, its.where("false")).count() == 0


def test_whole_and_part(spark):
    item = "one two three four five six seven eight"
    df = docs(spark, [f"x {item} y", "two three four five six", "six five four three two one", "one x two y three z four w five", None])
    its = spark.createDataFrame([(1, item, "test")], "item_id bigint, item_text string, split string")
    got = {r.doc_id: (r.longest, r.matched, r.item_words) for r in leakage.leaks(df, its, 4).collect()}
    assert got == {1: (8, 8, 8), 2: (5, 5, 8)}
    near = {r.doc_id for r in leakage.PositionalIndex(df, its).proximity(1000, 4, 10).collect()}
    assert near == {1, 2, 3, 4}
    other = df.where("doc_id = 2").withColumn("text", F.lit("five six seven eight"))  # one id, two texts: each by itself
    got = {r.doc_id: (r.longest, r.matched) for r in leakage.leaks(df.union(other), its, 4).collect()}
    assert got == {1: (8, 8), 2: (5, 7)}


def test_token_counts_are_those_of_the_tokenizer(spark):
    texts = ["Dose was 5.89 µSv", "", None, "a" * 5000, "<|endoftext|> plain"]
    got = [r[0] for r in docs(spark, texts).orderBy("doc_id").select(mixing.tokens_and_topic(F.col("text"), mixing.TopicModel(*[np.zeros((0, mixing.WIDTH))] * 2)).alias("c")).select("c.n_tokens").collect()]
    enc = mixing._encoder(mixing.TOKENIZER)
    assert got == [len(enc.encode_ordinary(t)) if t else 0 for t in texts]


def mix_docs(spark, n=600):
    rng = random.Random(6)
    rows = [(i, " ".join(["word"] * rng.randrange(5, 60)), rng.choice(["big"] * 8 + ["Small ", "tiny", "stray", None]), rng.choice(["en", "EN", "fr", None]), "clash") for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, "big", "en", ""), (n + 1, "", "tiny", None, "")], "doc_id bigint, text string, source string, lang string, copies string")


def test_mix_holds_shares_and_caps(spark):
    targets = spark.createDataFrame([("big", 500, 1), ("small", 300, 8), ("tiny", 150, 1), ("absent", 50, 3)], "source string, target_permille int, max_repeats int")
    df = mix_docs(spark)
    mix = mixing.Mix(df, targets)
    rows = mix.report().collect()
    rep = {r.value: r for r in rows if r.dimension == "source"}
    assert {r.value for r in rows if r.dimension == "lang"} == {"en", "fr", "unknown"} and abs(sum(r.reached_permille for r in rows if r.dimension == "topic") - 1000) < 1e-6
    for s in ("big", "small"):
        assert rep[s].planned_tokens - 5 <= rep[s].tokens <= rep[s].planned_tokens + 1, s
    assert rep["tiny"].limited and rep["tiny"].tokens == rep["tiny"].available_tokens and rep["absent"].tokens == 0
    assert all(r.most_copies <= r.max_repeats for r in rep.values())
    again = mixing.Mix(df.repartition(7), targets)
    key = lambda m: sorted((r.doc_id, r.copies) for r in m.sample().collect())
    assert key(mix) == key(again)
    assert mixing.Mix(df.where("false"), targets).sample().count() == 0
    assert mixing.Mix(df, targets.where("false")).sample().count() == 0


def test_raking_keeps_other_marginals():
    import pandas as pd

    cells = pd.DataFrame([(s, la, t, 100 + 10 * i) for i, (s, la, t) in enumerate((s, la, t) for s in "ab" for la in ("en", "fr") for t in "xy")], columns=["source", "lang", "topic", "tokens"])
    w = mixing.rake(cells, {"a": 0.7, "b": 0.3}, {"a": 9, "b": 9}, 1000)
    mass = cells.assign(m=w * cells.tokens)
    assert mass.groupby("source").m.sum().to_dict() == pytest.approx({"a": 700, "b": 300})
    want = cells.groupby("lang").tokens.sum() / cells.tokens.sum()
    assert (mass.groupby("lang").m.sum() / 1000).to_dict() == pytest.approx(want.to_dict(), abs=1e-6)


def test_topics_come_from_all_documents(spark):
    """Every document lies nearest to the mean of its own topic, with term weights and means taken over all documents."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words[8 * g : 8 * g + 20], k=rng.randrange(4, 30))) for g in (rng.randrange(6) for _ in range(9000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("source", F.lit("a")).withColumn("lang", F.lit("en"))
    targets = spark.createDataFrame([("a", 1000, 1)], "source string, target_permille int, max_repeats int")
    topic = dict(mixing.Mix(df, targets).docs.select("doc_id", "topic").collect())
    enc = mixing._encoder(mixing.TOKENIZER)
    counts = np.array([mixing.hashed_counts(enc.encode_ordinary(t)) for t in texts])
    x = np.log1p(counts) * (np.log((1 + len(texts)) / (1 + (counts > 0).sum(axis=0))) + 1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    names = sorted(set(topic.values()))
    own = np.array([names.index(topic[i]) for i in range(len(texts))])
    means = np.array([x[own == j].mean(axis=0) for j in range(len(names))])
    far = 1 - 2 * x @ means.T + (means**2).sum(axis=1)
    assert len(names) == 8 and (far[np.arange(len(x)), own] - far.min(axis=1)).max() < 0.002
