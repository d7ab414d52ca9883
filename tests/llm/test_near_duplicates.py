"""The near-duplicate stage against fingerprints compared pair by pair."""

import random

from lakeload.llm import simhash
from lakeload.llm.simhash import simhash64

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def texts_of_groups(rng, groups=12):
    """Copies with a few changed words, of texts long enough that some differ in no more than two bits."""
    pool = ["".join(rng.choices(LETTERS, k=rng.randint(2, 8))) for _ in range(3000)]
    for _ in range(groups):
        base = rng.choices(pool, k=rng.randint(200, 1200))
        yield " ".join(base)
        for _ in range(8):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(pool)
            yield " ".join(words)


def plain_stays(rows):
    """(id, text) of the rows that stay: of each component the least id, known ones first."""
    prints = [simhash64(t or "")[0] for _, t in rows]
    above = list(range(len(rows)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, one in enumerate(prints):
        for j in range(i):
            if (one ^ prints[j]).bit_count() <= 2:
                above[top(i)] = top(j)
    stays = {}
    for i, (doc, _) in enumerate(rows):
        root = top(i)
        stays[root] = min(stays.get(root, (True, 0)), (doc is None, doc or 0))
    return sorted(stays.values())


def kept(frame, rows):
    out = simhash.one_of_each(frame(rows))
    return out, sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())


def test_one_of_each_component_stays(frame):
    rng = random.Random(5)
    rows = list(enumerate(texts_of_groups(rng)))
    rng.shuffle(rows)
    rows += [(None, rows[0][1]), (None, "alone and without an id"), (900, ""), (901, None), (902, " . "[:1])]
    out, found = kept(frame, rows)
    expected = plain_stays(rows)
    assert found == expected
    assert len(expected) < len(rows) - 30  # groups there are
    assert out.columns == frame(rows).columns


def test_a_large_group_leaves_one(frame, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rng = random.Random(6)
    base = [f"word{rng.randrange(500)}" for _ in range(900)]
    rows = [(i, " ".join(base)) for i in range(40)]
    for i in range(40, 160):
        words = list(base)
        words[rng.randrange(900)] = f"other{i}"
        rows.append((i, " ".join(words)))
    rows.append((500, "a clean text that is like no other here"))
    _, found = kept(frame, rows)
    assert found == plain_stays(rows)
    assert (False, 500) in found


def test_rows_alike_in_id_and_text(frame):
    rows = [(7, "the same text twice"), (7, "the same text twice"), (7, "quite another text under that id here")]
    out, found = kept(frame, rows)
    assert found == [(False, 7), (False, 7)]
    assert sorted(r.text for r in out.collect()) == sorted({t for _, t in rows})
