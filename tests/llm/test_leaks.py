"""Leaked benchmark items that were edited a little."""

import collections
import math
import random

import regex
from pyspark.sql import functions as F

from lakeload.llm import decontaminate

LONG = "a train leaves the old station at noon and reaches the far harbour before the last boat departs today".split()
BEFORE, AFTER = "some words that stand before it ", " and others that come after it"


def found(spark, frame, item, texts):
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = frame([(i, BEFORE + t + AFTER) for i, t in enumerate(texts)])
    return {r.doc_id for r in decontaminate.find_items(docs, benchmark).collect()}


def test_a_word_put_in_or_left_out(spark, frame):
    texts = []
    for i in range(1, len(LONG) - 1):
        texts.append(" ".join([*LONG[:i], "zebra", *LONG[i:]]))
        texts.append(" ".join([*LONG[:i], *LONG[i + 1 :]]))
    texts.append("nothing of the kind is said in this text")
    assert found(spark, frame, " ".join(LONG), texts) == set(range(len(texts) - 1))


def test_a_changed_word_at_any_offset(spark, frame):
    for size in (16, 10):
        item = LONG[:size]
        texts = []
        for i in range(size):
            texts.append("x " * (i % 6) + " ".join([*item[:i], "zebra", *item[i + 1 :]]))
        assert found(spark, frame, " ".join(item), texts) == set(range(size))


def test_a_copy_in_lower_case(spark, frame):
    item = "Anna Berg met Carl Dahl near Malmo while Erik Falk and Gustav Holm sailed to Visby"
    assert found(spark, frame, item, [item.lower(), "x " + item.lower()]) == {0, 1}


def test_items_of_numbers_are_found_verbatim(spark, frame):
    assert found(spark, frame, "What is 12 + 7?", ["What is 12 + 7?", "Where was it"]) == {0}


# Against a plain alignment

WORD, NAME = regex.compile(r"[\p{L}\p{M}\p{Nd}]+"), regex.compile(r"\p{Lu}\p{Ll}+")


def forms(text):
    words = WORD.findall(text or "")
    lower = [w.lower() for w in words]

    def template(w):
        if NAME.fullmatch(w):
            return "<name>"
        if regex.match(r"\p{Nd}", w):
            return "<num>"
        return "<unit>" if w.lower() in decontaminate.UNITS else w.lower()

    return lower, [template(w) for w in words]


def subsequence(one, many):
    """Length of the longest common subsequence and its pairs, traced from the end."""
    table = [[0] * (len(many) + 1) for _ in range(len(one) + 1)]
    for i, a in enumerate(one):
        for j, b in enumerate(many):
            table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
    i, j, pairs = len(one), len(many), []
    while i and j:
        if one[i - 1] == many[j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif table[i - 1][j] == table[i][j]:
            i -= 1
        else:
            j -= 1
    return table[-1][-1], pairs


def plain_items(docs, items):
    found = {}
    for item, text in items:
        words, templates = forms(text)
        n = len(words)
        size = n if n < 4 else min(8, n // 2)
        slack = math.ceil(0.6 * n)
        for doc, body in docs:
            own, own_templates = forms(body)
            shifts = set()
            for kind, (a, b) in enumerate(((words, own), (templates, own_templates))):
                for place in range(n - size + 1) if n else ():
                    run = a[place : place + size]
                    named = sum(not w.startswith("<") for w in templates[place : place + size])
                    if kind and not (named and (named >= 2 or named * 3 >= size)):
                        continue
                    shifts |= {at - place for at in range(len(b) - size + 1) if b[at : at + size] == run}
            for shift in shifts:
                low, high = max(shift - slack, 0), max(shift + n + slack, 0)
                same, _ = subsequence(words, own[low:high])
                alike, pairs = subsequence(templates, own_templates[low:high])
                slots = {(templates[i], words[i], own[low + j]) for i, j in pairs if templates[i].startswith("<")}
                consistent = len(slots) == len({s[:2] for s in slots}) == len({(s[0], s[2]) for s in slots})
                if same / n >= 0.7 or (consistent and alike / n >= 0.7):
                    result = (same / n, alike / n, consistent)
                    found[doc, item] = max(found.get((doc, item), result), result)
    return found


def check(spark, frame, docs, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_items(frame(docs), benchmark).collect()
    want = plain_items(docs, items)
    assert {(r.doc_id, r.item_id): (r.same, r.alike, r.consistent) for r in got} == want
    return want


def test_one_to_ten_words_put_in_at_each_place(spark, frame):
    docs = []
    for place in range(1, len(LONG)):
        for count in range(1, 11):
            put = ["zebra"] * count if count % 2 else [f"z{i}x" for i in range(count)]
            docs.append((len(docs), BEFORE + " ".join([*LONG[:place], *put, *LONG[place:]]) + AFTER))
    want = check(spark, frame, docs, [(1, " ".join(LONG)), (2, "quite another question that is nowhere to be found")])
    assert set(want) == {(i, 1) for i in range(len(docs))}


def test_edited_and_reparameterised_items_among_others(spark, frame):
    pick = random.Random(4)
    pool = "the of and a in to red blue river stone walks runs sees Anna Berlin Carl 12 7 3 km kg hours".split()
    items = [(i, " ".join(pick.choices(pool, k=pick.choice([2, 3, 4, 7, 12, 20, 70, 130])))) for i in range(14)]
    items.append((50, "Anna has 12 apples and gives 7 apples to Carl how many apples does Anna have"))
    docs = []
    for i in range(60):
        body = pick.choices(pool, k=pick.randrange(0, 30))
        for _ in range(pick.randrange(0, 3)):
            words = pick.choice(items)[1].split()
            for _ in range(pick.randrange(0, 4)):
                at = pick.randrange(len(words))
                words[at : at + pick.randrange(0, 2)] = pick.choices(pool, k=pick.randrange(0, 3))
                words = words or ["x"]
            body += words + pick.choices(pool, k=pick.randrange(0, 12))
        docs.append((i, " ".join(body)))
    docs.append((100, "Erik has 9 apples and gives 4 apples to Maja, how many apples does Erik have?"))
    docs.append((101, "Erik has 9 apples and gives 4 apples to Maja, how many apples does Olof have?"))
    want = check(spark, frame, docs, items)
    # Of the two with other values, one gives one name for another throughout.
    assert want[100, 50][2] and (101, 50) not in want and len(want) > 30
    assert any(item for _, item in want if len(dict(items)[item].split()) > 62)  # over a limb long


def test_rare_words_are_told_by_all_documents(spark, frame):
    item = "Anna Berg met 7 ΟΔΟΣ near the old Stra\u00dfe İn e\u0301t\u00e9"
    texts = [f"{i}, the ΟΔΟΣ'Α ΟΔΟΣ; the-old ANNA (berg)? İn E\u0301T\u00c9 x{i}" for i in range(40)] + [None, "", " .. ", "the"]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = frame(list(enumerate(texts)))
    counted = decontaminate._word_counts(docs, decontaminate.prepared_items(benchmark))
    words = docs.select(F.explode(decontaminate._lower_words(F.col("text"))).alias("w"))
    expected = collections.Counter(r.w for r in words.collect())
    hashed = {r.h: r.w for r in words.distinct().select("w", F.xxhash64("w").alias("h")).collect()}
    got = {hashed[r.word]: r.often for r in counted.collect()}
    own = benchmark.select(F.explode(decontaminate._lower_words(F.col("text"))).alias("w")).collect()
    assert got == {r.w: expected[r.w] for r in own if r.w in expected}
    assert got["the"] == 81 and got["anna"] == 40 and got["7"] == 1
