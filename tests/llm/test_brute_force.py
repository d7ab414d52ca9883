"""Operators against plain versions on small data, and round trips."""

import collections
import datetime
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakeload.llm import bpe, decontaminate, fingerprint, pii, queries, quality, simhash, toxicity
from lakeload.llm.lexicon import Lexicon, compile_lexicon

SF_DIR = "/root/testdata/sf0.001"
KEY = b"k" * 16


def texts(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


def test_permutation_is_one_to_one():
    for size in (1, 2, 7, 100, 1000):
        assert sorted(pii.permute(i, size, KEY, "t") for i in range(size)) == list(range(size))


def shape(text):
    return re.sub("[A-Z]", "X", re.sub("[a-z]", "x", re.sub("[0-9]", "9", text)))


def test_pseudonyms_keep_format_and_validity():
    text = "Ann.9@mail7.example.com 4111 1111 1111 1111 GB82 WEST 1234 5698 7654 32 2020-02-29 +1 (476) 555-6291 10.0.0.1 123-45-6789"
    made, counts = pii.pseudonymize_text(text, KEY)
    assert set(counts.values()) == {1} and made != text
    assert shape(made[:23]) == shape(text[:23])
    again, counts = pii.pseudonymize_text(made, KEY)
    assert set(counts.values()) == {1}
    datetime.date.fromisoformat(re.search(r"\d{4}-\d\d-\d\d", made).group())
    clean = "4111 1111 1111 1112, 300.1.1.1, 2021-02-30, 000-12-3456, a@b and words"
    assert pii.pseudonymize_text(clean, KEY)[0] == clean


def test_lexicon_finds_all_words_and_no_other():
    draw = random.Random(1)
    words = {"".join(draw.choices("abcé", k=draw.randint(1, 6))): [i, i + 1] for i in range(500)}
    lexicon = Lexicon(compile_lexicon(words))
    ordered = sorted(words, key=str.encode)
    asked = ordered + ["x", "", "abcabcabc", "zz"]
    assert lexicon.find([w.encode() for w in asked]).tolist() == [*range(len(ordered)), -1, -1, -1, -1]
    assert Lexicon(compile_lexicon({})).find([b"a"]).tolist() == [-1]


def test_ids_and_text_are_the_tokenizers(spark, frame):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, vocabulary = Tokenizer.from_file(path), bpe.load_vocabulary(path)
    rows = list(texts(spark).items())
    rows += [(-i, t) for i, t in enumerate(["", "don't <|endoftext|>x", "ΟΔΥΣΣΕΥΣ İ ½ 漢字 🎉", "a\x1db", "x" * 300], 1)]
    docs = frame(rows)
    out = bpe.encode(docs, vocabulary, bpe.build_lexicon(docs, vocabulary, 100))
    got = {r.doc_id: (r.ids, r.decoded) for r in out.collect()}
    for i, text in rows:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert got[i] == (ids, tokenizer.decode(ids, skip_special_tokens=False))
    back = {r.doc_id: r.text for r in bpe.decode(out, vocabulary).collect()}
    assert back == {i: decoded for i, (_, decoded) in got.items()}


def test_words_of_a_slice_are_merged_together(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    data = bpe.load_vocabulary(path)
    draw, vocabulary = random.Random(2), bpe.Vocabulary(data)
    words = ["".join(draw.choices("abcdeinorst漢é0-", k=draw.randint(1, 20))) for _ in range(2000)]
    words += ["x" * 300, "\n<|endoftext|>", "a", "the"]
    ids, n = vocabulary.merge_all(words)
    bounds = np.append(0, np.cumsum(n))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [vocabulary.merge(w) for w in words]
    assert [x.tolist() for x in vocabulary.merge_all([])] == [[], []]

    def alone(self, word):
        raise AssertionError("merged alone: " + word)

    # Short words that the lexicon lacks, in one text or several, are not merged one by one.
    monkeypatch.setattr(bpe.Vocabulary, "merge", alone)
    texts = ["unseen words, twice: unseen words don't count", "", "words again"]
    got, bounds, decoded = bpe.Encoder(data, compile_lexicon({})).encode(texts)
    tokenizer = Tokenizer.from_file(path)
    expected = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [got[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == expected
    assert decoded.to_pylist() == [tokenizer.decode(ids, skip_special_tokens=False) for ids in expected]


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", lower) if w]
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, linked):
    least = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if least[j] < least[i] and linked(prints[i], prints[j]):
                    least[i], changed = least[j], True
    return least


def near(a, b):
    return (a ^ b).bit_count() <= 2


def test_simhash_classes(spark):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, SF_DIR).collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts(spark).items()}
    classes = plain_classes(prints, near)
    assert got == {i: (f"{p:016x}", classes[i]) for i, p in prints.items()}


def test_links_of_large_buckets_are_exact(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 4)
    draw = np.random.default_rng(3)
    words = {int(x) for x in draw.integers(0, 1 << 62, 20)}
    for word in list(words):  # chains of words a bit or two apart
        for _ in range(12):
            word ^= (1 << int(draw.integers(0, 62))) | (1 << int(draw.integers(0, 62)))
            words.add(word)
    nodes = spark.createDataFrame([(w, w) for w in words], "node long, f0 long")
    found = simhash.components(simhash.golay_links(nodes)).collect()
    expected = plain_classes({w: w for w in words}, near)
    assert {r.node: r.component for r in found} == {w: c for w, c in expected.items() if w != c}


def test_fingerprints_of_edits(spark):
    got = {r.doc_id: r for r in queries.op3_fingerprints(spark, SF_DIR).collect()}
    plain, gaps = texts(spark), []
    ids = sorted(plain)
    for i, after in zip(ids, ids[1:] + ids[:1]):
        edit = fingerprint.edited(plain[i], plain[after])
        assert got[i].n_chars == len(plain[i])
        assert got[i].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        one, two = (collections.Counter(t.lower().split()) for t in (plain[i], edit))
        gaps.append(got[i].near_edited - sum((one & two).values()) / max(1, sum((one | two).values())))
    assert abs(np.mean(gaps)) < 0.03 and np.std(gaps) < 0.1


def test_ranges_meet_at_their_ends(spark, frame):
    docs = frame([(i, f"text {i} " * 5) for i in range(50)])
    rows = fingerprint.ranges_with_next(docs, rows=7).collect()
    own = [r.doc_id for r in rows if not r.follower]
    assert sorted(own) == list(range(50)) and len(rows) > len(own) + 3


def test_kneser_ney_probabilities_sum_to_one(spark, frame):
    model = quality.Model(frame([(1, "abracadabra of a bar"), (2, "banana of bar of a")]).select("text"), share=0.3)
    assert model.words == ["of"]
    units, letters = quality.Units(model.words), sorted(set("abracadabra banana bar"))
    for context in ("abr", "xyz", "ana", "a of a", "bar of "):
        ends = [context + c for c in [*letters, " of", "一"]]
        asked = spark.createDataFrame([(int(units.keys_of([t])[0][-1]),) for t in ends], "k long")
        seen = asked.count()
        total = model.log_probabilities(asked).agg(F.sum(F.exp("logp"))).first()[0]
        # "f" and "o" occur within the frequent word alone, so they are no units of the model.
        assert seen == model.vocabulary and abs(total - 1) < 1e-9


def plain_kneser_ney(trusted, words, order=4):
    """Log probability of a text's units, by dictionaries, as the method's definition has it."""

    def units(text):
        first, *rest = text.split(" ")
        out = list(first)
        for w in rest:
            out += [" " + w] if w in words else list(" " + w)
        return ["0" if u.isdigit() else "\ufffd" if u > "\uffff" else u for u in out]

    counts = [None] * (order + 1)
    counts[order] = Counter()
    for t in trusted:
        u = ["<"] * (order - 1) + units(t)
        counts[order].update(tuple(u[i : i + order]) for i in range(len(u) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    off, totals, free = [None], [None], [None]
    for n in range(1, order + 1):
        few = Counter(counts[n].values())
        d = quality.Model.discounts([few[i] for i in (1, 2, 3, 4)])
        off.append({g: d[min(c, 3) - 1] for g, c in counts[n].items()})
        total, left = Counter(), Counter()
        for g, c in counts[n].items():
            total[g[:-1]] += c
            left[g[:-1]] += off[n][g]
        totals.append(total)
        free.append(left)
    vocabulary = len(counts[1]) + 1

    def p(gram):
        if not gram:
            return 1 / vocabulary
        n, below = len(gram), p(gram[1:])
        if not totals[n][gram[:-1]]:
            return below
        return (counts[n][gram] - off[n].get(gram, 0) + free[n][gram[:-1]] * below) / totals[n][gram[:-1]]

    def log_probability(text):
        u = ["<"] * (order - 1) + units(text)
        return sum(math.log(p(tuple(u[i : i + order]))) for i in range(len(u) - order + 1))

    return log_probability


def test_quality_scores_are_those_of_plain_kneser_ney(spark, frame):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(12).select("text").collect()
    texts = [r.text[:700] for r in rows if r.text]
    texts += ["", " ", "of  of the", "no 17 of 2024 🎉 of the", "漢字" * 40, "unseen of the unseen"]
    good = frame([(i, t) for i, t in enumerate(texts[:8])])
    model = quality.Model(good.select("text"), share=0.005)
    assert len(model.words) > 2
    want = plain_kneser_ney(texts[:8], set(model.words))
    scored = quality._score(frame(list(enumerate(texts))), model).collect()
    assert len(scored) == len(texts)
    for r in scored:
        text = texts[r.doc_id]
        assert r.n == len(text)
        assert r.logp * max(r.n, 1) == pytest.approx(want(text), rel=1e-9, abs=1e-9)


def test_frequent_words_are_counted_exactly(spark, frame):
    texts = [" ".join(f"w{(i * j) % 37}" for j in range(60)) for i in range(40)] + ["", " ", "w1"]
    counts = Counter(w for t in texts for w in t.split(" "))
    least = sum(counts.values()) / 30
    want = sorted((w for w, c in counts.items() if w and c >= least), key=lambda w: (-counts[w], w))
    assert quality.frequent_words(frame(list(enumerate(texts))).repartition(5).select("text"), 1 / 30) == want
    assert quality.frequent_words(frame([(1, "a")]).where("false").select("text")) == []


def test_quality_keeps_trusted_and_rejects_noise(spark):
    sf_dir = SF_DIR.replace("0.001", "0.01")
    judged = queries.op4_quality(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    rates = {r.quality: r.rate for r in judged.groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("rate")).collect()}
    assert rates[1] > 0.98 and rates[0] < 0.15


def test_toxicity_on_the_held_out_fold(spark):
    sf_dir = SF_DIR.replace("0.001", "0.1")
    rows = queries.op5_toxicity(spark, sf_dir).where("held_out")
    labelled = rows.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    right = np.mean([r.predicted == r.toxic for r in labelled])
    assert right > 0.96
    assert not len(toxicity.features(""))


def test_items_are_found_with_other_values(spark, frame):
    item = "Anna Miller walked 12 km to the market and bought 3 kg of ripe apples, then Anna went home after 12 hours"
    same = "so before. " + item + " and more words follow here"
    other = item.replace("Anna", "Zoe").replace("Miller", "Adler").replace("12", "15").replace("3", "8")
    mixed = other.replace("15 hours", "16 hours").replace("Zoe went", "Eve went")
    clean = "A walk of some length to the market is good for everyone who likes ripe apples and long hours at home"
    docs = frame([(1, same), (2, other), (3, mixed), (4, clean)])
    benchmark = spark.createDataFrame([(9, item)], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.find_items(docs, benchmark).collect()}
    assert found[1].same == 1.0 and 2 in found and 4 not in found
    assert 3 not in found or found[3].same >= decontaminate.SHARE
