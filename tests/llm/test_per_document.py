"""Line rules, classifiers, encoders, shards and page texts: against brute force, round trips or held-out rows."""

import hashlib
import random
import re
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lumatab.llm import html_text, quality_rules, rule_ensemble, shard_table, token_files, toxicity, trees, word_bpe
from lumatab.llm.dom import read
from lumatab.llm.lexicon import Lexicon, compile_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: A null id, null and empty texts, white space of all kinds, repeated rows and ids, a very long text.
HARD = [
    (None, "null id here", None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \t\n\x0b\x0c\r ", "en", "s", 7), (4, "one two three", "en", "s", 13), (4, "one two three", "en", "s", 13),
    (4, "another text", "en", "s", 12), (5, "a\x85b c\xa0d e\x1cf <|endoftext|> <|startoftext|> x", "en", "s", 1), (6, "ÀÉ ΑΣ İ ŉ ½ ２ 한국어 \U0001f600👍🏽", "xx", "s", 1), (7, "word " * 40_000, "en", "s", 1), (8, "z" * 5_000, "en", "s", 1), (9, "!!! ??? ...", "en", "s", 1),
]
CLASH = {"lang": "n_words", "source": "stats"}


def hard(spark):
    return spark.createDataFrame(HARD, SCHEMA)


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def plain_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    grams = {}
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    inside = {j for at in grams.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


def test_line_counts(spark):
    r = random.Random(1)
    made = [(100 + i, "\n".join(" ".join(r.choices(["a", "b", "cc", "|", "*x", "ÄÖ"], k=r.randint(0, 30))) for _ in range(r.randint(0, 6))), "en", "s", 0) for i in range(60)]
    df = spark.createDataFrame(HARD + made, SCHEMA).withColumnsRenamed(CLASH)
    got = rows(quality_rules.line_quality(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    want = []
    for i, t, *_ in HARD + made:
        c = plain_counts(t)
        want.append((i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert got == sorted(map(repr, want))
    assert quality_rules.line_quality(df.limit(0)).count() == 0


def prose(n=10, seed=0):
    r = random.Random(seed)
    return "\n".join(" ".join("".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(14)) + ", and so on." for _ in range(n))


def test_line_rules():
    fails = quality_rules.line_fails
    assert fails("Home | News | Sport | Contact") == "navigation" and fails("### a *** b $$$") == "punctuation" and fails("BUY!! NOW!! OK!!") == "punctuation"
    assert fails(" ".join(["word"] * 40)) == "punctuation" and fails("All rights reserved.") == "boilerplate" and fails("It rained, so we stayed in.") is None
    menu = "\n".join(" | ".join("".join(random.Random(i * 9 + j).choices("abcdefgh", k=9)) for j in range(6)) for i in range(40))
    assert quality_rules.judge(prose())[6] and not quality_rules.judge(prose() + "\n" + menu)[5] and not quality_rules.judge(prose() + "\n" + menu)[6]
    assert quality_rules.judge(prose() + "\nRead more")[8] == prose()


def test_cleaned_documents(spark):
    df = spark.createDataFrame([*HARD, (50, prose() + "\nRead more", "en", "s", 1), (51, "Home | a | b | c\n" * 30, "en", "s", 1)], SCHEMA).withColumnsRenamed(CLASH)
    got = quality_rules.cleaned_documents(df)
    assert got.columns == df.columns and rows(got) == rows(spark.createDataFrame([(50, prose(), "en", "s", len(prose()))], SCHEMA))
    assert quality_rules.cleaned_documents(df.limit(0)).count() == 0


def labelled_docs(spark, n=600):
    r = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(r.choices("abcdefghijklmno", k=r.randint(2, 9))) for _ in range(r.randint(60, 120))]
        good, toxic = r.random() < 0.6, r.random() < 0.3
        if good and toxic:
            for _ in range(4):
                words[r.randrange(len(words))] = r.choice(["nastyword", "vilething"])
        text = ". ".join(" ".join(words[j : j + 9]).capitalize() for j in range(0, len(words), 9)) + "." if good else " | ".join(words[:40])
        docs.append((i, text, "en", "s", 0))
        labels.append((i, int(good), int(good and toxic)))
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rule_ensemble(spark):
    docs, labels = labelled_docs(spark)
    messy = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None)], labels.schema)).withColumn("text", F.lit("x"))
    model = rule_ensemble.train(docs, messy)
    assert 0 < len(model.rules) <= 400
    scored = rule_ensemble.score(docs.withColumnsRenamed(CLASH), model).join(labels, "doc_id").collect()
    for s in scored:
        assert s.held_out == (zlib.crc32(str(s.doc_id).encode()) % 3 == 1) and 0 <= s.score <= 1 and s.predicted == (s.score >= 0.5)
    out = [s for s in scored if s.held_out]
    assert np.mean([s.predicted == s.quality for s in out]) > 0.97
    # the compiled expression is the model
    x = np.array([rule_ensemble.statistics(r.text) for r in docs.orderBy("doc_id").collect()])
    assert np.allclose([s.score for s in sorted(scored, key=lambda s: s.doc_id)], model.score(x))
    edge = rule_ensemble.score(hard(spark), model)
    assert edge.count() == len(HARD) and edge.where("score IS NULL").count() == 0
    assert rule_ensemble.score(docs.limit(0), model).count() == 0
    assert rule_ensemble.accepted(docs.withColumnsRenamed(CLASH), model).columns == docs.withColumnsRenamed(CLASH).columns
    assert {r.doc_id for r in rule_ensemble.accepted(docs, model).collect()} == {s.doc_id for s in scored if s.predicted}


def test_statistics_by_plain_counts():
    """The twenty statistics from their definitions, character by character and word by word."""

    def plain(text):
        words = re.findall("[^ \t\n\x0b\x0c\r]+", text)
        n, blank = len(words), " \t\n\x0b\x0c\r"
        raw = [w.encode() for w in words]
        lines = [x.strip(blank) for x in text.split("\n") if x.strip(blank)]
        chars = sum(c not in blank for c in text)
        times = lambda marks: sum(text.startswith(m, i) for m in marks for i in range(len(text)))
        upper, lower, digits = (sum(a <= c <= b for c in text) for a, b in ("AZ", "az", "09"))
        shouts, i = 0, 0
        while (i := text.find("!!", i)) >= 0:
            shouts, i = shouts + 1, i + 2
        return [
            np.log1p(n), chars / n, len(set(words)) / n, plain_counts(text)[4] / n, sum(a == b for a, b in zip(words, words[1:])) / n, max(words.count(w) for w in set(words)) / n, n / len(lines),
            1 - len(set(lines)) / len(lines), times([". ", ".\n", "? ", "! "]) / n, text.count(",") / n, times("#*$%&<>~^=") / n, text.count("|") / n, shouts / n, digits / chars, upper / max(1, upper + lower),
            (upper + lower + len(text.encode()) - len(text)) / chars, sum(len(w) == 1 for w in raw) / n, sum(len(w) > 20 for w in raw) / n, len(text.encode()) / len(text), times("{}[]\\_") / n,
        ]

    r = random.Random(12)
    pieces = ["the ", "A", "word, ", "x|y ", "!!! ", "\n", " \n", "naïve ", "한국 ", "12 ", "#tag ", "{a_b} ", "the the the ", ". ", "?", "supercalifragilisticexpialidocious ", "\t", "\x85", "é"]
    texts = [t for _, t, *_ in HARD if t and t.strip(" \t\n\x0b\x0c\r") and len(t) < 10_000] + ["".join(r.choices(pieces, k=r.randint(3, 80))) + "end" for _ in range(150)]
    for t in texts:
        assert rule_ensemble.statistics(t) == pytest.approx(plain(t)), t
    assert rule_ensemble.statistics(None) == rule_ensemble.statistics("") == [0.0] * len(rule_ensemble.STATISTICS)


def test_score_by_plain_rules(spark):
    """The compiled expression against the rules one by one."""
    docs, labels = labelled_docs(spark, 300)
    model = rule_ensemble.train(docs, labels)
    texts = {d.doc_id: d.text for d in docs.collect()}
    assert model.rules
    for s in rule_ensemble.score(docs, model).collect():
        x = rule_ensemble.statistics(texts[s.doc_id])
        z = model.base + sum(w for rule, w in zip(model.rules, model.weights, strict=True) if all(x[f] <= cut if low else x[f] > cut for f, cut, low in rule))
        assert s.score == pytest.approx(1 / (1 + np.exp(-z))) and s.predicted == (s.score >= 0.5)


def test_held_out_labels_play_no_part(spark):
    docs, labels = labelled_docs(spark, 200)
    wrong = labels.withColumn("quality", F.when(rule_ensemble.fold(F.col("doc_id"), 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rule_ensemble.train(docs, labels) == rule_ensemble.train(docs.repartition(5), wrong)
    a, b = toxicity.train(docs, labels), toxicity.train(docs, labels.withColumn("toxic", F.when(rule_ensemble.fold(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert a.bias == b.bias and np.array_equal(a.weights, b.weights)


def test_no_labels(spark):
    docs, labels = labelled_docs(spark, 30)
    assert rule_ensemble.score(docs, rule_ensemble.train(docs, labels.limit(0))).select("score").distinct().first()[0] == pytest.approx(0.5)
    assert toxicity.score(docs, toxicity.train(docs, labels.limit(0))).select("score").distinct().first()[0] == pytest.approx(0.5)
    assert toxicity.score(docs, toxicity.train(docs, labels.withColumn("toxic", F.lit(0)))).where("predicted = 1").count() == 0


def test_lasso_drops_useless_rules():
    r = np.random.default_rng(0)
    x = (r.random((400, 20)) < 0.5).astype(float)
    y = (x[:, 3] > 0).astype(float)
    b, w = rule_ensemble.lasso_logistic(x, y, np.ones(400), 0.05)
    assert np.flatnonzero(np.abs(w) > 1e-6).tolist() == [3] and b < 0 < w[3]


def test_toxicity(spark):
    docs, labels = labelled_docs(spark, 1500)
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs.withColumnsRenamed(CLASH), model).join(labels, "doc_id").collect()
    assert all(s.held_out == (zlib.crc32(str(s.doc_id).encode()) % 5 == 0) for s in scored)
    out = [s for s in scored if s.held_out]
    assert np.mean([s.predicted == s.toxic for s in out]) > 0.95
    near, far = model.word_logits([b"nastywordd", b"kelomina"])
    assert near > 5 * abs(far)  # a misspelling shares n-grams
    edge = toxicity.score(hard(spark), model)
    assert edge.count() == len(HARD) and edge.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_scores_by_plain_loops():
    """The score from the model's table alone: n-grams hashed one by one, means of all words and of every window."""
    mask = 2**64 - 1

    def slot(gram, k, buckets):
        h = 0
        for c in gram:
            h = (h * 0x100000001B3 + c + 1) & mask
        return ((h ^ k) * 0x9E3779B97F4A7C15 & mask) >> 40, buckets

    def word(w, weights):
        w, found = b"<" + w + b">", []
        for k in toxicity.GRAMS:
            found += [slot(w[i : i + k], k, len(weights))[0] % len(weights) for i in range(len(w) - k + 1)]
        whole = sum((c + 1) * pow(0x100000001B3, i + 1, 2**64) for i, c in enumerate(w)) & mask
        found.append(((whole * 0x9E3779B97F4A7C15 & mask) >> 40) % len(weights))
        return sum(float(weights[x]) for x in found) / len(found)

    r = random.Random(3)
    model = toxicity.SubwordModel(-0.3, np.random.default_rng(3).normal(size=1000).astype(np.float32), 0.7, 1.3)
    texts = [None, "", " , ", "One", "a a a b", *(" ".join(r.choices(["Stop!", "go", "go", "naïve", "x" * 40, "(well)", "...", "É"], k=r.randint(1, 90))) for _ in range(40))]
    for text, z in zip(texts, toxicity.Scorer(model).logits(texts), strict=True):
        words = [x for w in re.findall("[^ \t\n\x0b\x0c\r]+", (text or "").lower()) if (x := w.encode().strip(toxicity._EDGES))]
        own = [word(w, model.weights) for w in words]
        runs = [v for i, v in enumerate(own) if not i or words[i] != words[i - 1]]
        starts = [*range(0, len(runs) - 16, 16), len(runs) - 16] if len(runs) > 16 else [0]
        best = max((sum(runs[i : i + 16]) / len(runs[i : i + 16]) for i in starts), default=0.0) if runs else 0.0
        assert z == pytest.approx(-0.3 + 0.7 * (sum(own) / len(own) if own else 0.0) + 1.3 * best, abs=1e-6)


def test_weights_of_text_and_window():
    r = np.random.default_rng(1)
    x = r.normal(size=(4000, 2))
    y = (r.random(4000) < 1 / (1 + np.exp(-(x @ [2.0, 0.0] - 1)))).astype(float)
    assert toxicity.combine(x, y, np.ones(4000), pull=1e-6) == pytest.approx([-1, 2, 0], abs=0.2)


def test_gram_table():
    words = [b"ab", b"abc", b"x" * 300, "é".encode()]
    bucket, who = toxicity.grams_of(words)
    per = np.bincount(who)
    assert per.tolist() == [sum(max(0, len(w) + 2 - n + 1) for n in toxicity.GRAMS) + 1 for w in words]
    alone = [sorted(toxicity.grams_of([w])[0].tolist()) for w in words]
    assert [sorted(bucket[who == i].tolist()) for i in range(4)] == alone


def test_windows():
    assert [a.tolist() for a in toxicity.windows(0)] == [[], []] and [a.tolist() for a in toxicity.windows(5)] == [[0], [5]]
    starts, ends = toxicity.windows(40)
    assert starts.tolist() == [0, 16, 24] and ends.tolist() == [16, 32, 40]


def ids_by_library(name, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("shard_ids", [1 << 24, 40])
def test_token_files(spark, tmp_path, shard_ids):
    uri = f"file://{tmp_path}/shards"
    df = hard(spark).withColumnsRenamed({"lang": "start", "source": "name"}).repartition(3)
    manifest = token_files.write_shards(df, uri, public_tokenizers.path("byte_bpe_50k.json"), shard_ids=shard_ids)
    got = token_files.read_shards(manifest, uri).orderBy("start").collect()
    want, at = [], 0
    found = {}
    for i, t, *_ in HARD:
        found.setdefault(i, []).append([*ids_by_library("byte_bpe_50k.json", t)[0], 0])
    assert [g.doc_id for g in got] == sorted((i for i, *_ in HARD), key=lambda i: (i is not None, i))
    for g in got:
        match = [x for x in found[g.doc_id] if len(x) == g.n_tokens and zlib.crc32(np.array(x, "<u4").tobytes()) == g.ids_crc32]
        assert match and g.start == at
        found[g.doc_id].remove(match[0])
        at += g.n_tokens
    names = sorted(p.name for p in (tmp_path / "shards").iterdir() if p.name.startswith("part-"))
    whole = np.concatenate([token_files.Shard((tmp_path / "shards" / n).read_bytes()).decode() for n in names])
    assert len(whole) == at


def test_token_files_of_long_white_space(spark, tmp_path):
    uri = f"file://{tmp_path}/wide"
    texts = {1: " " * 2_000_000, 2: "a <|endoftext|>" + "\n" * 1_200_000 + "b", 3: "short"}
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = token_files.read_shards(token_files.write_shards(df, uri, public_tokenizers.path("byte_bpe_50k.json")), uri).collect()
    want = {i: [*ids_by_library("byte_bpe_50k.json", t)[0], 0] for i, t in texts.items()}
    assert {(g.doc_id, g.n_tokens, g.ids_crc32) for g in got} == {(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}


def test_token_files_of_nothing(spark, tmp_path):
    uri = f"file://{tmp_path}/none"
    manifest = token_files.write_shards(hard(spark).limit(0), uri, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_files.read_shards(manifest, uri).count() == 0


@pytest.mark.parametrize("n, top", [(0, 10), (1, 1), (3, 70_000), (200_000, 3), (70_000, 50_257)])
def test_wavelet_support(n, top, monkeypatch):
    r = np.random.default_rng(n)
    ids = r.integers(0, top, n).astype(np.uint32)
    shard = token_files.Shard(token_files.pack([5], np.array([n], np.int64), ids))
    assert np.array_equal(shard.decode(), ids) and shard.doc_ids == [5] and shard.lengths.tolist() == [n]
    for i in r.integers(0, max(n, 1), min(n, 60)).tolist():
        s = int(ids[i])
        k = int((ids[:i] == s).sum())
        assert shard.access(i) == s and shard.rank(s, i) == k and shard.select(s, k) == i and shard.count(s) == int((ids == s).sum())
    assert shard.count(1 << 20) == 0 and shard.count(-1) == 0
    for bad in (lambda: shard.access(n), lambda: shard.select(1 << 20, 0)):
        with pytest.raises(IndexError):
            bad()
    with pytest.raises(ValueError):
        token_files.Shard(b"something else")


def test_word_bpe(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    r = random.Random(4)
    made = [(100 + i, " ".join(r.choices(["the", "The", "it's", "don't", "naïve", "über", "x1y2", "zzzyxq", "hello,world", "ǅ", "ﬁ", "é"], k=r.randint(0, 80))), "en", "s", 0) for i in range(50)]
    df = spark.createDataFrame(HARD + made, SCHEMA)
    want = []
    for i, t, *_ in HARD + made:
        ids, text = ids_by_library("word_bpe_49k.json", t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    for size in (word_bpe.LEXICON, 3):  # almost all words seen, almost none
        got = word_bpe.encode(df.withColumnsRenamed({"lang": "ids", "source": "_text_x"}), path, size=size, keep=("n_chars",))
        assert rows(got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == sorted(map(repr, want))
    back = word_bpe.decode(got, path).where("doc_id = 4 AND n_tokens = 3").first().decoded
    assert back == "one</w> two</w> three</w>"
    assert word_bpe.encode(df.limit(0), path).count() == 0


def test_long_words_merge_like_short_ones():
    m = word_bpe.merges_of(public_tokenizers.path("word_bpe_49k.json"))
    for w in ("abababab", "internationalization", "aaaaaaaaaaaaa", "zq"):
        chars = [m._chars[b] for b in w.encode()]
        chars[-1] += m.suffix
        assert m._merge_long([m.vocab[c] for c in chars]) == m.merge(w)


def test_lexicon_is_minimal_and_exact(tmp_path):
    r = random.Random(6)
    entries = {"".join(r.choices("abc", k=r.randint(1, 7))).encode() + end: [r.randrange(99) for _ in range(r.randint(1, 4))] for _ in range(300) for end in (b"", b"ing", b"ed")}
    (tmp_path / "x.lex").write_bytes(compile_words(entries))
    lexicon = Lexicon(str(tmp_path / "x.lex"))
    words = sorted(entries)
    assert lexicon.find(words).tolist() == list(range(len(words)))
    assert all(lexicon.output(i).tolist() == entries[w] for i, w in enumerate(words))
    other = [b"", b"zz", b"a" * 50, *(w + b"q" for w in words[:50])]
    assert lexicon.find([w for w in other if w not in entries]).tolist() == [-1] * sum(w not in entries for w in other)
    # states of the minimal automaton: one for each set of endings
    endings = {}
    for w in words:
        for k in range(len(w) + 1):
            endings.setdefault(w[:k], set()).add(w[k:])
    assert len(lexicon.final) == len({frozenset(e) for e in endings.values()})
    (tmp_path / "e.lex").write_bytes(compile_words({}))
    assert Lexicon(str(tmp_path / "e.lex")).find([b"a"]).tolist() == [-1]


def test_shard_table(spark):
    def plain(shards, slots):
        walks = []
        for s in shards:
            o, k = (int(hashlib.md5(f"{seed}:{s}".encode()).hexdigest()[:15], 16) for seed in ("offset", "skip"))
            walks.append(iter([(o + j * (k % (slots - 1) + 1)) % slots for j in range(slots)]))
        table = {}
        while len(table) < slots:
            for i, w in enumerate(walks):
                if len(table) < slots:
                    table[next(x for x in w if x not in table)] = i
        return [table[i] for i in range(slots)]

    names = [f"n{i}" for i in range(7)]
    assert shard_table.fill(names, 101) == plain(names, 101)
    sizes = np.bincount(shard_table.fill(names, 1009))
    assert sizes.max() - sizes.min() <= 1
    a, b = shard_table.fill(names, 65_537), shard_table.fill(names[:-1], 65_537)
    moved = sum(x != y for x, y in zip(a, b) if x != 6) / 65_537
    assert moved < 0.1  # what the lost shard did not hold hardly moves
    weighted = np.bincount(shard_table.fill(["a", "b"], 1009, weights=[3, 1]))
    assert abs(weighted[0] / weighted[1] - 3) < 0.05
    df = hard(spark)
    placed = shard_table.place(df, names, slots=101)
    assert placed.columns == [*df.columns, "slot", "shard"] and placed.count() == len(HARD)
    assert {r.doc_id: len(r.s) for r in placed.groupBy("doc_id").agg(F.collect_set("shard").alias("s")).collect()} == dict.fromkeys({i for i, *_ in HARD}, 1)
    table = shard_table.fill(names, 101)
    assert all(r.shard == names[table[r.slot]] for r in placed.collect()) and shard_table.place(df.limit(0), names).count() == 0
    for bad in (lambda: shard_table.fill(names, 100), lambda: shard_table.fill(["a", "a"], 101), lambda: shard_table.place(df.withColumnRenamed("lang", "slot"), names)):
        with pytest.raises(ValueError):
            bad()


def test_placed_rows_are_written_whole(spark, tmp_path):
    docs = hard(spark).unionByName(spark.createDataFrame([(i % 3, "long " * 20_000, "en", "hot", 1) for i in range(30)], SCHEMA)).repartition(4)
    names = [f"n{i}" for i in range(7)]
    placed = shard_table.place(docs, names, slots=101)
    shard_table.write_placed(placed, f"{tmp_path}/some", rows_per_file=5)
    assert rows(shard_table.read_placed(spark, f"{tmp_path}/some", placed.schema)) == rows(placed)
    for folder in (tmp_path / "some").glob("shard=*"):
        assert {r.shard for r in placed.where(F.col("shard") == folder.name[6:]).select("shard").collect()} == {folder.name[6:]}
    shard_table.write_placed(placed.limit(0), f"{tmp_path}/none")
    assert shard_table.read_placed(spark, f"{tmp_path}/none", placed.schema).count() == 0


def test_shard_query_writes_the_table(spark, tmp_path):
    from lumatab.llm import queries, shared

    hard(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op4_shard_table(spark, str(tmp_path))
    files = got.inputFiles()
    assert rows(got) == rows(shard_table.place(hard(spark), shard_table.SHARDS).select("doc_id", "slot", "shard"))
    home = shared.home(spark).removeprefix("file:").lstrip("/")
    assert files and all(f"/{home}/placed-" in f and "/shard=shard-" in f for f in files)
    assert rows(spark.read.parquet(*files).select("doc_id", "text")) == rows(hard(spark).select("doc_id", "text"))


PAGE = """<!DOCTYPE html><html><head><title>no</title><script>var x="<p>no</p>";</script></head><body>
<nav class="menu"><ul><li><a href=/a>Home</a></li><li><a href=/b>About</a></li></ul></nav><div class="ad">Buy this now. It is good.</div>
<article><h1>The &quot;title&quot; of it</h1><p>First   paragraph with <b>bold</b> and&nbsp;more words in it, to be long enough.<br>Second line of it.
<p>An unclosed paragraph &amp; more text follows here, quite a lot of text in fact, so it counts.</p><div class="share"><a href=x>Tweet</a></div></article>
<div class="comments"><h3>Comments</h3><p>I think this is great, thank you for the article.</p></div><footer>&copy; 2024 us. All rights reserved.</footer></body></html>"""
TEXT = 'The "title" of it\n\nFirst paragraph with bold and more words in it, to be long enough. Second line of it.\n\nAn unclosed paragraph & more text follows here, quite a lot of text in fact, so it counts.'


def test_html(spark):
    pages = [(1, "u", PAGE), (None, None, None), (2, "u", ""), (3, "u", "<p"), (3, "u", "<div>" * 3000 + "deep" + "</div>" * 3000), (4, "u", "plain < text & more"), (5, "u", "<!-- <p>never closed"), (6, "u", '<a href="x' * 200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.main_texts(df).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    assert next(r.text for r in got if r.page_id == 1) == TEXT and all(r.text == "" for r in got if r.page_id in (None, 2, 5))
    assert html_text.main_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "attribute, shown",
    [
        ('title="our hidden gem"', True), ("data-title='The hidden valley'", True), ('class="x hidden y"', True), ('data-css="display:none"', True), ('title="aria-hidden=true"', True), ('aria-hidden="false"', True),
        ('style="display:none-x"', True), ('style="display:none;display:block"', True), ('data-x=">" title="a > hidden b"', True), ("data-hidden", True),
        ("hidden", False), ("HIDDEN=''", False), ('title="a"hidden', False), ("aria-hidden=true", False), ('style="color:red; Display : none !important; display:block"', False), ("style=display:none", False),
    ],
)
def test_only_hidden_elements_are_silent(attribute, shown):
    for page in (PAGE.replace("<article>", f"<article {attribute}>"), PAGE.replace("<article>", f"<article><a {attribute}>").replace("</article>", "</a></article>")):
        assert [t for _, t in read(page).blocks if t in TEXT.split("\n\n")] == (TEXT.split("\n\n") if shown else [])
    assert not shown or html_text.extract([PAGE.replace("<article>", f"<article {attribute}>")], html_text.model()) == [TEXT]


def test_html_without_body():
    text = "A first sentence with quite a few words in it, so that it counts. And a second one follows here, as long as the first."
    nav = '<nav class="menu"><ul><li><a href=/a>Home</a></li><li><a href=/b>About</a></li></ul></nav>'
    pages = {"plain < text & more": "plain < text & more", text: text, f"<!DOCTYPE html><title>no</title><b>{text}</b><br>{text}": f"{text} {text}", f"{nav}{text}<footer>&copy; 2024 us. All rights reserved.</footer>": text}
    assert html_text.extract([*pages], html_text.model()) == [*pages.values()]
    # the implied body is like a written one; without loose text nothing is implied
    for page in (*pages, "<div><p>a</p></div>b<a href=x>c</a><p>d</p><i>e</i>"):
        assert read(page) == read(f"<body>{page}</body>")
    assert read("<div>a</div>").tag == ["#page", "div"]
    assert read("<html><body><p>a</p></body></html> b").blocks == [(3, "a"), (2, "b")]


class Plain(HTMLParser):
    """Main text of a labelled page by the library's parser: blocks of the text whose closest mark is 1."""

    BLOCKS = "html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li blockquote table tr td figure figcaption pre nav header footer aside form".split()

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.open, self.said, self.found, self.skip = [], [], [], None
        self.feed(source)
        self.close()
        self.end_block()

    def marked(self):
        return next((m for _, m in reversed(self.open) if m), "") == "1"

    def end_block(self):
        text = " ".join("".join(self.said).split())
        if text and self.marked():
            self.found.append(text)
        self.said = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.skip = tag
        elif tag == "br":
            self.said.append(" ")
        elif tag not in ("img", "input", "meta"):
            if tag in self.BLOCKS:
                names = [t for t, _ in self.open]
                if "p" in names and "td" not in names[names.index("p") :]:
                    self.handle_endtag("p")
                if tag == "li" and "li" in names and not {"ul", "ol"} & set(names[len(names) - names[::-1].index("li") :]):
                    self.handle_endtag("li")
                self.end_block()
            self.open.append((tag, dict(attrs).get("data-y", "")))

    def handle_endtag(self, tag):
        if tag == self.skip:
            self.skip = None
        elif tag in [t for t, _ in self.open]:
            at = len(self.open) - 1 - [t for t, _ in reversed(self.open)].index(tag)
            if tag not in self.BLOCKS and any(t == "td" for t, _ in self.open[at:]):
                return
            if any(t in self.BLOCKS for t, _ in self.open[at:]):
                self.end_block()
            del self.open[at:]

    def handle_data(self, data):
        if not self.skip:
            self.said.append(data)


def test_html_against_the_librarys_parser():
    """Reading and joining, on labels instead of odds; then the whole operator against the same labelled text."""
    maker = html_text._Maker(4711)
    sources = [maker.page() for _ in range(500)]
    want = ["\n\n".join(Plain(s).found) for s in sources]
    for source, text in zip(sources, want, strict=True):
        page = read(source)
        _, y = html_text.labelled(page)
        assert html_text.main_text(page, np.where(y > 0, 1.0, -1.0)) == text
    got = html_text.extract([re.sub(' data-y="."', "", s) for s in sources], html_text.model())
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.93 * 500


def test_html_keeps_what_the_contract_does_not_drop():
    for tag in ("math", "noscript", "object", "map", "button", "svg", "video", "span"):
        assert read(f"<p>a <{tag}>x</{tag}> b</p>").blocks == [(1, "a x b")], tag
    assert [t for _, t in read("<p>a<select><option>x</option></select> b<template><i>y</i></template></p>").blocks] == ["a b"]


@pytest.mark.parametrize("piece, end", [("<div>", "</div>"), ("<b>", "</b>"), ("<div></p>", "</div>"), ("<b><dd></dd>", ""), ("<div><li></li>", ""), ("<table><td><i></b>", ""), ("<a '>", "")])
def test_html_of_deep_nesting_is_linear(piece, end):
    began = time.process_time()
    page = read("<p>first</p>" + piece * 200_000 + "deep" + end * 200_000)
    assert page.blocks[-1][1].endswith("deep") or piece == "<a '>"
    assert time.process_time() - began < 30
    if piece == "<div>":
        html_text.extract(["<div>" * 200_000 + "deep"], html_text.model())
        assert time.process_time() - began < 90


def test_html_on_unseen_layouts():
    maker, trees_ = html_text._Maker(987), html_text.model()
    exact = 0
    for _ in range(120):
        page = read(maker.page())
        _, y = html_text.labelled(page)
        exact += html_text.main_text(page, trees_.logit(html_text.features(page))) == "\n\n".join(t for n, t in page.blocks if y[n])
    assert exact >= 0.93 * 120


def test_decoding_is_the_best_consistent_one():
    from itertools import product

    r = random.Random(8)
    for _ in range(60):
        n = r.randint(1, 7)
        parent = [-1] + [r.randrange(i) for i in range(1, n)]
        odds = np.array([r.uniform(-2, 2) for _ in range(n)])
        best, keep = -np.inf, None
        for state in product(range(3), repeat=n):  # undecided, main, out
            if state[0] or any((state[parent[i]], s) in ((1, 0), (2, 0), (2, 1)) for i, s in enumerate(state) if i):
                continue
            score = sum((0, odds[i], -odds[i])[s] for i, s in enumerate(state) if i)
            if score > best + 1e-12:
                best, keep = score, [s == 1 for s in state]
        assert html_text.decode(parent, odds).tolist() == keep


def test_boosting_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((800, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = trees.boost(x[:600], y[:600], rounds=60, depth=3)
    assert ((model.logit(x[600:]) > 0) == y[600:]).mean() > 0.93
    assert trees.boost(x[:5], np.ones(5), rounds=2).logit(x[:3]).min() > 3
