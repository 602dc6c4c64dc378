"""Operators over texts, against brute force and on the odd cases."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewake.llm import chat, common, decontam, licenses, neardup, pii, quality, substrings

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "x"), (None, "no id here at all"), (5, "long " * 30000), (6, "same text twice over"), (6, "same text twice over"), (7, "naïve Ünïcode 日本語 \u200b")]


def frame(spark, rows):
    """Documents with a further column whose name operators use inside."""
    return spark.createDataFrame([(d, t, k, "en") for k, (d, t) in enumerate(rows)], "doc_id long, text string, n long, g string")


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@given(st.lists(st.text("ab é日 \n\t\x0b", max_size=12), max_size=6))
@settings(max_examples=200, deadline=None)
def test_words_and_hashes(texts):
    buffer, offsets = common.utf8(pa.array(texts, pa.string()))
    starts, ends, first = common.word_bounds(buffer, offsets, common.SPACES)
    found = [bytes(buffer[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    assert found == [w for t in texts for w in WORDS.findall(t)]
    assert np.diff(first).tolist() == [len(WORDS.findall(t)) for t in texts]
    hashes = common.word_hashes(buffer, starts, ends)
    assert len(set(hashes.tolist())) == len(set(found))


def thue_morse(n, swap=False):
    """A word of n letters whose like with a and b exchanged collides with it in every polynomial hash modulo a power of two."""
    return "".join("ba"[(bin(k).count("1") + swap) % 2] for k in range(n))


@pytest.mark.parametrize("n", [8, 64, 65, 1024, 4096])
def test_words_that_polynomials_confuse(n):
    a, b = thue_morse(n), thue_morse(n, True)
    buffer, offsets = common.utf8(pa.array([f"{a} {b} {a.upper()} {a}b"], pa.string()))
    starts, ends, _ = common.word_bounds(buffer, offsets, common.SPACES)
    for seed in (0, 1):
        h = common.word_hashes(buffer, starts, ends, fold_case=True, seed=seed)
        assert h[0] == h[2] and len(set(h.tolist())) == 3
    assert not set(common.word_hashes(buffer, starts, ends).tolist()) & set(common.word_hashes(buffer, starts, ends, seed=1).tolist())


def test_scopes_delete_what_is_not_kept(spark):
    def there(df):
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    with common.Scope():
        with common.Scope() as inner:
            a, b = common.materialize(spark.range(3).toDF("a"), "x"), common.materialize(spark.range(3).toDF("a"), "x")
            inner.keep(a)
        assert there(a) and not there(b)
    assert not there(a)
    assert common.fresh(spark.range(1).toDF("Text"), "text", "_text", "n") == ["_text", "__text", "n"]


# Quality


def test_statistics_of_odd_texts():
    x = quality.statistics(pa.array([None, "", "Abc def.", "a a a a"], pa.string()))
    assert not x[0].any() and not x[1].any() and np.isfinite(x).all()
    at = quality.STATISTICS.index
    assert x[3, at("repeats_previous")] == 0.75 and x[3, at("distinct_words")] == 0.25 and x[2, at("capitalised")] == 0.5 and x[2, at("ends_in_stop")] == 0.5


def test_trees_learn_and_traverse():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    trees = quality.grow(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    one = 0
    for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):  # node by node, for one row
        node = 0
        while node < len(feature):
            node = 2 * node + 1 + int(x[7, feature[node]] > threshold[node])
        one += leaf[node - len(feature)]
    assert abs(1 / (1 + np.exp(-(one + trees.prior))) - trees.score(x[7:8])[0]) < 1e-12
    assert quality.grow(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_quality_held_out(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model, ["doc_id"]).join(labels, "doc_id").filter(quality.held_out()).select("score", "quality").toPandas()
    assert len(rows) > 300 and ((rows["score"] >= 0.3) == (rows["quality"] == 1)).mean() > 0.95
    again = quality.train(docs.repartition(5), labels)
    assert (again.leaf == model.leaf).all()


def test_quality_odd_cases(spark):
    docs = frame(spark, ODD)
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    out = quality.score(docs, model).collect()
    assert len(out) == len(ODD) and all(r["score"] == 0.5 for r in out) and out[0].asDict().keys() == {"doc_id", "text", "n", "g", "score"}
    assert quality.score(frame(spark, []), model).count() == 0
    with pytest.raises(ValueError):
        quality.score(docs, model, name="N")
    named = docs.withColumnRenamed("g", "_text")
    assert quality.score(named, model).columns == ["doc_id", "text", "n", "_text", "score"]


def test_quality_of_repeated_ids(spark):
    rng = random.Random(4)
    docs = [(d % 40, " ".join(rng.choice(["good", "text", "##", "!!"]) for _ in range(20))) for d in range(120)]
    labels = spark.createDataFrame([(d % 40, d % 2, 0) for d in range(80)] + [(3, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    first = quality.train(frame(spark, docs), labels, most=30)
    rng.shuffle(docs)
    again = quality.train(frame(spark, docs).repartition(3), labels.repartition(5), most=30)
    assert (first.leaf == again.leaf).all() and (first.threshold == again.threshold).all() and first.prior == again.prior


# Licenses


@pytest.mark.parametrize(
    "text,labels",
    [
        ("Released under the MIT License.", "mit,mit-notice"), ("released UNDER the terms of the mit-license", "mit,mit-notice"), ("under the MIT License", "mit"), ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0-notice"),
        ("Licensed under the Apache License Version 3.0", "apache"), ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0-notice"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0-notice"),
        ("available under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc-4.0-notice"), ("mit licenses", ""), (licenses.TEMPLATES["mit-text"].replace("<<beginOptional>>(including the next paragraph)<<endOptional>>", ""), "mit-text"),
        (re.sub("<<.*?>>", " ", licenses.TEMPLATES["mit-text"]), "mit-text"), (re.sub("<<.*?>>", " ", licenses.TEMPLATES["mit-text"]).replace("without restriction", "with restriction"), ""),
    ],
)
def test_licenses(spark, text, labels):
    assert licenses.scan(frame(spark, [(1, text)]), ["doc_id"]).first()["labels"] == labels


def test_license_texts_and_scores(spark):
    texts = [re.sub("<<beginOptional>>.*?<<endOptional>>", "", t) for t in licenses.TEMPLATES.values()]
    texts = [re.sub('<<var;.*?original="(.*?)".*?>>', r"\1", t) for t in texts]
    rows = licenses.scan(frame(spark, [*enumerate(texts), (100, "mit license and MIT License"), (101, "Released under the MIT license")]), ["doc_id"]).collect()
    got = {r["doc_id"]: r for r in rows}
    for k, label in enumerate(licenses.TEMPLATES):
        assert label in got[k]["labels"].split(","), label
        assert got[k]["score"] == (1.0 if label.endswith("-text") else 0.9)
    assert got[100]["score"] == 0.8 * (2 / 3) and got[101]["score"] == 0.9
    for k, label in enumerate(licenses.TEMPLATES):
        for word in ("permission", "software", "license"):  # mandatory wording
            if f" {word} " in licenses.TEMPLATES[label].lower() and "<<" not in licenses.TEMPLATES[label]:
                assert not licenses.Automaton(licenses.parse(licenses.TEMPLATES[label])).found(licenses.words_of(texts[k].lower().replace(f" {word} ", " other ", 1)))


def test_hits_are_counted_in_one_walk(spark):
    import time

    docs = frame(spark, [(1, "mit license " * 80_000)])
    start = time.time()
    r = licenses.scan(docs, ["doc_id"]).first()
    assert (r["n_base"], r["first_word"], r["last_word"], r["n_words"]) == (80_000, 0, 159_998, 160_000) and time.time() - start < 20
    with pytest.raises(ValueError):
        licenses.scan(docs.withColumnRenamed("n", "score"), ["doc_id", "score"])


def test_license_markup():
    a = licenses.Automaton(licenses.parse('we <<var;name="gap";original="";match=".{0,2}">> grant <<beginOptional>>a <<beginOptional>>big<<endOptional>> right<<endOptional>> now'))
    accepted = ["we grant now", "we do grant now", "we do hereby grant a right now", "x we grant a big right now y"]
    refused = ["we do so hereby grant now", "we grant a now", "grant now", "we grant big right now", "we grant a big"]
    for text in accepted + refused:
        words = licenses.words_of(text)
        regex = re.search(licenses.pattern('we <<var;name="gap";original="";match=".{0,2}">> grant <<beginOptional>>a <<beginOptional>>big<<endOptional>> right<<endOptional>> now'), " " + "  ".join(text.split()) + " ")
        assert a.found(words) == (text in accepted) == bool(regex), text
    for bad in ("<<beginOptional>>x", "x<<endOptional>>", "<<other>>", '<<var;name="x">> y'):
        with pytest.raises(ValueError):
            licenses.parse(bad)


def test_license_odd_cases(spark):
    rows = licenses.scan(frame(spark, ODD), ["doc_id"]).collect()
    assert len(rows) == len(ODD)
    assert all(r["n_base"] == 0 and r["first_word"] is None and r["labels"] == "" and r["score"] == 0 for r in rows)
    two = licenses.scan(frame(spark, [(1, "mit license x apache  License, MIT license")]), ["doc_id"]).first()
    assert (two["n_base"], two["first_word"], two["last_word"], two["base_labels"]) == (3, 0, 5, "apache,mit") and licenses.scan(frame(spark, []), ["doc_id"]).count() == 0


# Chats


def test_layouts(spark):
    import json

    turns = [("user", "q\n<|im_end|>"), ("assistant", "a\\|b <\\|")]
    records = {
        "messages_content": {"messages": [{"role": r, "content": t} for r, t in turns]}, "messages_text": {"messages": [{"role": r, "text": t} for r, t in turns], "id": 7}, "from_value": {"conversations": [{"from": {"user": "human", "assistant": "gpt"}[r], "value": t} for r, t in turns]},
        "prompt_completion": {"prompt": turns[0][1], "completion": turns[1][1], "meta": {"prompt": 1}}, "instruction_output": {"instruction": turns[0][1], "input": "", "output": turns[1][1]}, "question_answer": {"answer": turns[1][1], "question": turns[0][1]},
    }
    odd = [json.dumps({"foo": 1}), "no json", None, "", json.dumps({"prompt": "p"}), json.dumps({"messages": []})]
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in records.items()] + [(None, x) for x in odd], "name string, record string")
    out = chat.format_chats(chat.canonical_turns(rows))
    got = out.withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("lost", chat.read_loss(F.col("formatted"), F.col("loss"))).collect()
    for r in got:
        assert r["layout"] == r["name"]
        assert [tuple(t) for t in r["back"]] == (turns if r["name"] else []) and r["lost"] == (turns[1][1] if r["name"] else "")
    system = chat.canonical_turns(spark.createDataFrame([(json.dumps({"system": "s", "instruction": "i", "input": "x", "response": "r"}),)], "record string")).first()
    assert [tuple(t) for t in system["turns"]] == [("system", "s"), ("user", "i\n\nx"), ("assistant", "r")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("u\\|^<\n", max_size=4), st.text("\\|<>im_startend\né", max_size=12)), min_size=1, max_size=3))
def test_escapes_are_reversible(spark, turns):
    rows = spark.createDataFrame([(turns,)], "turns array<struct<role:string,text:string>>")
    r = chat.format_chats(rows).withColumn("back", chat.read_turns(F.col("formatted"))).first()
    assert [tuple(t) for t in r["back"]] == turns


def test_conversations_with_ties_and_nulls(spark):
    rows = spark.createDataFrame([(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "y"), (None, 0, "user", "z"), (1, None, "system", "s")], "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.digests(chat.format_chats(chat.canonical_turns(chat.records_of(rows)))).collect()}
    assert out[1]["n_turns"] == 4 and out[1]["loss_chars"] == 1 and out[None]["n_turns"] == 1
    assert chat.digests(chat.format_chats(chat.canonical_turns(chat.records_of(rows.filter("false"))))).count() == 0


# Decontamination


def test_edit_distance():
    rng = random.Random(1)

    def brute(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            now = [i]
            for j, d in enumerate(t, 1):
                now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != d)))
            row = now
        return min(row)

    for _ in range(1500):
        p, t = ("".join(rng.choice("ab c") for _ in range(rng.randint(lo, 14))) for lo in (1, 0))
        best, got = brute(p, t), decontam.distance_within(p, t, len(p) - 1)
        assert (got[0] if got else len(p)) == best


def test_matches_are_those_of_brute_force(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(15))) for k in range(12)]
    docs = []
    for d in range(120):
        text = [rng.choice(words) for _ in range(40)]
        if d % 3 == 0:
            item = list(items[rng.randrange(12)][1])
            for _ in range(rng.randint(0, 14)):
                item[rng.randrange(len(item))] = rng.choice("abcd ")
            text[20:20] = ["".join(item).upper() if d % 2 else "*** " + "".join(item).replace(" ", "\n") + "!"]
        docs.append((d, " ".join(text)))
    expected = set()
    for d, t in docs:
        for k, i in items:
            i = decontam.plain(i)
            got = decontam.distance_within(i, decontam.plain(t), int(len(i) * 0.08))
            if got:
                expected.add((d, k, got[0]))
    bench = spark.createDataFrame([*items, (None, None), (99, ""), (98, "too few words"), items[0]], "item_id long, text string")
    for limits in ({}, {"block_chars": 200}):
        assert {(r["doc_id"], r["item_id"], r["edits"]) for r in decontam.matches(frame(spark, docs), bench, **limits).collect()} == expected
        clean = decontam.decontaminate(frame(spark, docs), bench, **limits)
        assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {e[0] for e in expected} and clean.columns == ["doc_id", "text", "n", "g"]
    assert 10 < len(expected) < 45


def test_decontamination_odd_cases(spark):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert decontam.decontaminate(frame(spark, ODD), bench).count() == len(ODD) and decontam.matches(frame(spark, ODD), bench.filter("false")).count() == 0
    assert decontam.decontaminate(frame(spark, ODD), bench.filter("false")).count() == len(ODD) and decontam.matches(frame(spark, []), bench).count() == 0
    assert decontam.matches(frame(spark, [(1, "x " * 50000 + "One, two three FOUR five six" + " y" * 50000), (None, "one two three four five six")]), bench).count() == 2


def test_short_items_and_scripts_without_spaces(spark):
    chinese = "一个水池有两个进水管单开甲管需要六小时注满单开乙管需要八小时注满问"
    edited = chinese[:10] + "丙" + chinese[11:]
    bench = spark.createDataFrame([(1, "What is 12 + 30?"), (2, chinese), (3, "ประเทศไทยมีเมืองหลวงชื่อว่าอะไร"), (4, "Yes"), (5, "日本の首都"), (6, " ?! ")], "item_id long, text string")
    docs = [
        (1, "Q: what is 12+30? A: 42"), (2, "somewhat is 12 + 30"), (3, "what is 12 + 305"), (4, "题目" + edited + "，答"), (5, "ถามว่าประเทศไทยมีเมืองหลวงชื่อว่าอะไรครับ"),
        (6, "yes."), (7, "yesterday, eyes"), (8, "質問：日本の首都はどこですか"), (9, "日本の古都"), (10, "?!"), (11, "what is 12 or 30"),
    ]
    expected = {(1, 1, 0), (4, 2, 1), (5, 3, 0), (6, 4, 0), (8, 5, 0)}
    for limits in ({}, {"block_chars": 20}):
        assert {(r["doc_id"], r["item_id"], r["edits"]) for r in decontam.matches(frame(spark, docs), bench, **limits).collect()} == expected
        kept = decontam.decontaminate(frame(spark, docs), bench, **limits)
        assert {r["doc_id"] for r in kept.collect()} == {2, 3, 7, 9, 10, 11}


# Passages


def removed(docs, window):
    texts = [(d, WORDS.findall(t or "")) for d, t in docs]
    least = {}
    for d, w in texts:
        for i in range(len(w) - window + 1):
            if d is not None:
                k = tuple(w[i : i + window])
                least[k] = min(least.get(k, d), d)
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and least[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def test_cover_has_every_difference():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


@pytest.mark.parametrize("window", [7, 13, 20])
def test_repeats(spark, window):
    rng = random.Random(window)
    words = ["w%d" % k for k in range(60)] + ["é", "日本", "Ä"]
    passages = [[rng.choice(words) for _ in range(rng.randint(window - 1, 3 * window))] for _ in range(6)]
    docs = []
    for d in rng.sample(range(1000), 80):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(1, 15))]
        docs.append((d, rng.choice([" ", "\n", " \t "]).join(text)))
    docs += [(docs[0][0], docs[1][1]), (2000, docs[2][1]), (2000, docs[2][1]), (None, docs[3][1]), (-5, docs[4][1]), *ODD]
    got = substrings.remove_repeats(frame(spark, docs).repartition(5), window, group_bytes=500, bucket_bytes=300).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got), key=repr) == removed(docs, window)


def test_windows_of_like_words_stay(spark):
    rng = random.Random(1)
    head = " ".join("w%d" % k for k in range(12))
    docs = []
    for k, n in enumerate((1024, 2048, 4096)):
        docs += [(2 * k, f"{head} {thue_morse(n)}"), (2 * k + 1, f"{head} {thue_morse(n, True)}")]
    rng.shuffle(docs)
    got = substrings.remove_repeats(frame(spark, docs)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got), key=repr) == removed(docs, 13)
    assert all(r["n_removed"] == 0 for r in got)


def test_plan_of_exchanges():
    small, large, huge = (substrings.plan(x, 8) for x in (10**8, 3 * 10**10, 10**14))
    assert small == (47, 8, 8) and large[1] > 500 and large[2] > 800
    groups, buckets, tasks = huge
    assert 2 * 10**14 / groups <= 257 << 20 and 0.6 * 10**14 / buckets <= 257 << 20 and tasks > 2 * 10**6


def test_repeats_of_empty(spark):
    assert substrings.remove_repeats(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(frame(spark, []), 5)


# Near duplicates


def components(docs, width, percent):
    sets = []
    for d, t in docs:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORDS.findall(t or "")]
        sets.append((d, {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()))
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=repr)


@pytest.mark.parametrize("small,block,block_bytes,star", [(256, 2048, 32 << 20, 512), (4, 3, 4000, 512), (4, 3, 32 << 20, 3)])
def test_near_duplicates(spark, small, block, block_bytes, star):
    rng = random.Random(9)
    words = ["v%d" % k for k in range(400)]
    docs, d = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 30, 60, 120]))]
        for _ in range(rng.choice([1, 2, 3, 25])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append((d, rng.choice([str.upper, str.lower])(rng.choice([" ", "\n"]).join(copy))))
            d += 1
    rng.shuffle(docs)
    docs += [(9001, None), (9002, ""), (None, docs[0][1]), (-3, docs[1][1])]
    out = neardup.near_duplicates(frame(spark, docs), 3, 85, small=small, block=block, block_bytes=block_bytes, star=star).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=repr) == components(docs, 3, 85)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in out)


def test_near_duplicates_odd_cases(spark):
    out = neardup.near_duplicates(frame(spark, ODD)).collect()
    assert len(out) == len(ODD) and {r["doc_id"] for r in out if not r["kept"]} == set()
    assert neardup.near_duplicates(frame(spark, [])).count() == 0 and neardup.near_duplicates(frame(spark, [(1, None)])).count() == 1


def test_unlike_words_do_not_link(spark):
    docs = [(k, thue_morse(n, swap)) for k, (n, swap) in enumerate((n, s) for n in (1024, 4096) for s in (False, True))] + [(9, thue_morse(1024).upper())]
    out = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, docs), 3, 85).collect()}
    assert out == {0: 0, 1: 1, 2: 2, 3: 3, 9: 0}


def test_shingles_that_share_their_upper_bits(monkeypatch):
    """Hashes that only differ in the lowest 20 bits still count once each."""
    low = np.array([5, 7, 5, 7, 5, 9], np.uint64)
    monkeypatch.setattr(common, "window_hashes", lambda words, width, seed=1: low[: len(words) - width + 1])
    (_, _, h, at), *_ = neardup._sets(pa.array(["a b c d e f g h"], pa.string()), 3)
    assert h.tolist() == [5, 7, 9] and at.tolist() == [0, 3]


# Personal data


def replaced(spark, rows, key="k"):
    return {r["n"]: r for r in pii.pseudonymize(frame(spark, rows), key).withColumnRenamed("n_entities", "found").collect()}


def plain_entities(text):
    """(start, end, kind, norm) of a text's entities, by the same patterns in another engine and plain rules."""
    patterns = {k: regex.compile(p) for k, p in pii.PATTERNS.items()}
    title, at = regex.compile(pii._TITLE), 0
    while text and at < len(text):
        found = [(m.start(), k, m) for k, (kind, p) in enumerate(patterns.items()) if (m := p.search(text, at))]
        if not found:
            return
        start, k, m = min(found, key=lambda x: x[:2])
        kind, end = list(patterns)[k], m.end()
        digits = regex.sub("[^0-9]", "", m[0])
        if kind == "card":
            doubled = [sum(divmod(2 * int(c), 10)) if j % 2 else int(c) for j, c in enumerate(reversed(digits))]
            kind = kind if sum(doubled) % 10 == 0 else None
        norm = m[0].lower() if kind in ("email", "secret") else digits if kind in ("card", "phone", "ssn") else title.sub("", m[0], count=1) if kind == "name" else m[0]
        if kind:
            yield start, end, kind, norm
        at = max(end, at + 1)


def test_surrogates_against_a_plain_version(spark):
    """Over all documents of a table: the same entities, nothing else touched, one surrogate for each and no two alike."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    people = ["Dr. Ada Lang met Prof. Kim", "Mrs. Lang and Dr. Lang, Prof. Dr. Weber", "Mx. Rivers wrote +33 1 23 45 67 89 and 555.123.4567", "key sk-AbCdEfGhIjKlMnOpQrSt 4111-1111-1111-1111 078-05-1120 a.b@c.org"]
    rows += [(100_000 + k, t) for k, t in enumerate(people)]
    out = replaced(spark, rows)
    drawn, every, n = {}, set(), 0
    for k, (_, text) in enumerate(rows):
        found = list(plain_entities(text))
        new, at, shift = out[k]["text"], 0, 0
        assert out[k]["found"] == len(found), text
        n += len(found)
        pieces = [text[a:b] for a, b in zip([0, *(e for _, e, _, _ in found)], [*(s for s, _, _, _ in found), len(text or "")], strict=True)] if text else []
        assert text or new == text
        for j, ((_, end, kind, norm), before) in enumerate(zip(found, pieces, strict=False)):
            assert new.startswith(before, at)
            behind = pieces[j + 1]
            stop = len(new) - sum(map(len, pieces[j + 1 :])) if j + 1 == len(found) else new.index(behind, at + len(before)) if behind else None
            at += len(before)
            if stop is None:
                break
            every.add((kind, norm))
            drawn.setdefault((kind, norm), set()).add(new[at:stop])
            at = stop
    assert n > 50 and {kind for kind, _ in drawn} >= {"email", "phone", "card", "ip", "secret", "name", "ssn"}
    plain = {key: {regex.sub("[^0-9]", "", x) if key[0] in ("card", "phone", "ssn") else regex.sub(pii._TITLE, "", x, count=1) if key[0] == "name" else x.lower() for x in xs} for key, xs in drawn.items()}
    assert all(len(xs) == 1 for (kind, _), xs in plain.items() if kind != "name")
    news = [(kind, x) for (kind, _), xs in plain.items() for x in xs]
    assert len(news) == len(set(news)) and not set(news) & every


def test_entities_keep_their_format(spark):
    text = "Mail ann.Lee+1@corp-x.co.uk, call +1 (325) 555-8094 or (020) 555-1234; card 4111 1111 1111 1111, ssn 123-45-6789, host 10.20.30.40. token = \"ffc3105535f423f352535e4ac53b5fefe076ac6d\""
    out = replaced(spark, [(1, text)])[0]
    new = out["text"]
    assert out["found"] == 7 and not any(x in new for x in ("ann", "325", "555-8094", "4111 1111", "123-45", "10.20.30.40", "ffc3105535"))
    shape = r'\AMail \w{3}\.\w{3}\+\d@\w{4}-\w\.\w{2}\.example, call \+1 \(\d{3}\) \d{3}-\d{4} or \(0\d\d\) \d{3}-\d{4}; card 4\d{3} \d{4} \d{4} \d{4}, ssn 9\d\d-\d\d-\d{4}, host 2\d\d\.\d+\.\d+\.\d+\. token = "[0-9a-f]{40}"\Z'
    assert re.match(shape, new), new
    digits = [int(c) for c in re.search(r"card ([\d ]+)", new)[1].replace(" ", "")][::-1]
    assert sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0


def test_clean_texts_stay(spark):
    clean = ["", None, "order 12345678 of 2024-01-02", "number 4111111111111112 fails its check", "version 1.2.3.4.5 and 999.1.1.1", "a@b", "x" * 5000 + "@", "12.50 + 7", "Mr. nobody"]
    out = replaced(spark, list(enumerate(clean)))
    assert all(out[k]["text"] == t and out[k]["found"] == 0 for k, t in enumerate(clean))


def test_neighbours_of_numbers(spark):
    rows = ["4111111111111111 12 pears", "4111111111111112 4111111111111111", "+1 (325) 555-8094 12 pears", "+1 (325) 555-8094", "3782-822463-10005."]
    out = [replaced(spark, list(enumerate(rows)))[k]["text"] for k in range(5)]
    assert out[0].endswith(" 12 pears") and out[1].startswith("4111111111111112 4") and out[0][:16] == out[1][17:] != "4111111111111111"
    assert out[2] == out[3] + " 12 pears" and re.fullmatch(r"3\d{3}-\d{6}-\d{5}\.", out[4])


def test_names_by_gender_and_script(spark):
    out = replaced(spark, [(1, "Mrs. Jane Smith met Mr. Smith and Herr Müller."), (2, "Mr Smith; госпожа Иванова и г-н Петров"), (3, "Mrs. Jane Smith")])
    first = re.fullmatch(r"Mrs\. (\w+) (\S+) met Mr\. (\S+) and Herr (\S+)\.", out[0]["text"])
    assert first[1] in pii.NAMES["latin", "female"] and first[2] != "Smith" and "Jane" not in out[0]["text"]
    second = re.fullmatch(r"Mr (\S+); госпожа (\S+) и г-н (\S+)", out[1]["text"])
    assert second[1] == first[3] and all(part in pii.NAMES["cyrillic", "family"] for part in second[2].split("-"))
    assert out[2]["text"] == f"Mrs. {first[1]} {first[2]}"


def test_distinct_entities_stay_distinct(spark):
    rows = [(k, f"Mr. {chr(65 + k // 26)}{chr(97 + k % 26)}xon wrote to u{k:03d}@mail.example.com from 10.0.{k // 250}.{k % 250}") for k in range(400)]
    out = replaced(spark, [*rows, *rows[:50]])
    news = [out[k]["text"] for k in range(400)]
    for pattern in (r"Mr\. (\S+)", r"(\S+@\S+)", r"from (\S+)"):
        assert len({re.search(pattern, t)[1] for t in news}) == 400
    assert all(out[400 + k]["text"] == news[k] for k in range(50))
    other = replaced(spark, rows[:20], "another key")
    assert sum(other[k]["text"] == news[k] for k in range(20)) == 0


def test_surrogates_are_no_entities_of_the_corpus(spark):
    rows = [(1, "ip 10.1.1.1")]
    new = replaced(spark, rows)[0]["text"]
    again = replaced(spark, [*rows, (2, new)])
    assert again[0]["text"] not in (new, rows[0][1]) and again[1]["text"] not in (new, rows[0][1]) and again[0]["text"] != again[1]["text"]


def test_pii_odd_cases(spark):
    out = pii.pseudonymize(frame(spark, ODD), "k")
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(repr, ODD)) and out.columns == ["doc_id", "text", "n", "g", "n_entities"]
    assert pii.pseudonymize(frame(spark, []), "k").count() == 0


def test_what_patterns_find_is_hinted(spark):
    secrets = ["sk-" + "aBcDeFgHiJkLmNoPqRsT", "ghp_" + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ", "AKIA" + "ABCDEFGHIJKLMNOP", "abcdef" * 6, "ABCDEF" * 10]
    others = ["a@b.xx", "1.2.3.4", "123-45-6789", "4111111111111111", "+12345", "Mr. Smith", "госпожа Иванова"]
    rows = spark.createDataFrame([(x,) for x in secrets + others], "t string")
    assert all(tuple(r) == (True, True) for r in rows.select(F.col("t").rlike(rf"\A(?:{pii.ANY})\z"), F.col("t").rlike(pii.HINT)).collect())
    out = replaced(spark, [(k, f"key = {x};") for k, x in enumerate(secrets)])
    assert all(out[k]["found"] == 1 and x not in out[k]["text"] for k, x in enumerate(secrets))


def test_cards_of_tables_and_groups_of_phones(spark):
    cards = ["id,{},ok", "no.{}", "{},x", "a, {}.", "x;{}"]
    phones = ["+33 1 23 45 67 89", "+33 (0) 1 23 45 67 89", "+33.1.23.45.67.89", "+32 2 555 12 12", "+36 1 234 5678", "555 123 4567", "555.123.4567", "+33 12 34 56 78"]
    stay = ["pi 3.4111111111111111", "0,4111111111111111", "id,4111111111111112,ok", "14111 111 1111", "1555 123 4567"]
    texts = [t.format("4111111111111111") for t in cards] + [f"tel {p}, or" for p in phones] + stay
    out = replaced(spark, list(enumerate(texts)))
    for k, t in enumerate(texts):
        new = out[k]["text"]
        assert re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", t)
        assert (new == t, out[k]["found"]) == ((True, 0) if t in stay else (False, 1)), t
        if t not in stay:  # all of it: the last groups too
            assert sum(a != b for a, b in zip(t, new, strict=True)) > 3
    assert [r[0] for r in spark.createDataFrame([(p,) for p in phones], "t string").select(F.col("t").rlike(rf"\A(?:{pii.PATTERNS['phone']})\z")).collect()] == [True] * len(phones)


def test_full_formats_are_widened(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    emails = [("email", "", f"{a}@{b}.xx") for a in letters for b in letters]
    phones = [("phone", "", f"1{k:04d}") for k in range(6000)]
    table = pii.assign(spark.createDataFrame([*emails, *phones, ("ip", "", "1.2.3.4")], "kind string, class string, norm string"), "k", attempts=3)
    got = {(r["kind"], r["norm"]): r["drawn"] for r in table.collect()}
    assert len(got) == len(emails) + len(phones) + 1 and len({(k, d) for (k, _), d in got.items()}) == len(got)
    assert not {(k, d) for (k, _), d in got.items()} & set(got)
    assert all(re.fullmatch(r"[a-z]+@[a-z]\.example", d) if k == "email" else re.fullmatch(r"1[0-9]{4,12}", d) for (k, _), d in got.items() if k != "ip")
    longer = next(d for (k, _), d in got.items() if k == "phone" and len(d) > 5)
    rows = spark.createDataFrame([("+1 23 45", longer), ("+12345", "19876")], "m string, d string")
    new = [r[0] for r in rows.select(pii.formatted(F.col("m"), F.lit("phone"), F.col("d"))).collect()]
    assert re.sub("[^0-9]", "", new[0]) == longer and new[0][:3] == "+1 " and new[1] == "+19876"


def test_wider_surrogates_of_each_kind(spark):
    norms = {"email": "a@b.xx", "ip": "1.2.3.4", "ssn": "123456789", "card": "4111111111111111", "phone": "12345", "secret": "akia" + "a" * 16, "name": "Smith"}
    rows = spark.createDataFrame([(k, n, "latin male" if k == "name" else "") for k, n in norms.items()], "kind string, norm string, class string")
    got = {r["kind"]: r["d"] for r in rows.select("kind", pii.surrogate("k", F.col("kind"), F.col("norm"), F.col("class"), 3, 2).alias("d")).collect()}
    assert re.fullmatch(r"2001:db8(:[0-9a-f]{4}){6}", got["ip"]) and [len(got[k]) for k in ("ssn", "card", "phone", "secret")] == [11, 18, 7, 22]
    assert sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(got["card"][::-1])) % 10 == 0


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_sketches_rule_out_next_to_no_pair_at_the_threshold(threshold):
    n = neardup.COORDINATES
    counts = np.arange(n + 1)
    lost = ~neardup._may_link(counts, np.int64(100), np.int64(100), threshold)
    assert 0 < sum(math.comb(n, int(k)) * threshold**k * (1 - threshold) ** (n - k) for k in counts[lost].tolist()) < 1e-6
