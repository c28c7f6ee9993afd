"""Near-duplicates and repeated passages against brute force."""

import random
import re

from gleaner.llm import near_dedup
from gleaner.llm.near_dedup import near_duplicates
from gleaner.llm.substring import remove_repeats
from gleaner.session import Steps

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "É") for b in ("t", "s", "R", "ll")]


def shingles(text, size):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))}


def groups(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return sorted(((doc, len(sets[i]), least[find(i)] if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


def near_copies(seed, families=12, size=14):
    r = random.Random(seed)
    rows = []
    for _ in range(families):
        words = [r.choice(VOCABULARY) + str(r.randint(0, 40)) for _ in range(r.choice([1, 3, 30, 80]))]
        for _ in range(r.randint(1, size)):
            copy = [w if r.random() > r.choice([0, 0.02, 0.05, 0.1]) else "new" + str(r.random()) for w in words]
            rows.append((r.randint(0, 10_000), " ".join(copy)))
    return rows


def check(frame, rows, size, percent=80):
    got = near_duplicates(frame(rows), size, percent).collect()
    assert sorted(((g["doc_id"], g["n_shingles"], g["component_id"]) for g in got), key=str) == groups(rows, size, percent)
    assert all(g["kept"] == (g["doc_id"] == g["component_id"]) for g in got)


def test_near_copies_equal_brute_force(frame):
    check(frame, near_copies(1), 2)
    check(frame, near_copies(2), 5)


def test_large_family_is_compared_in_blocks(frame, monkeypatch):
    rows = near_copies(3, families=3, size=120)
    monkeypatch.setattr(near_dedup, "GROUP_SETS", 10)
    monkeypatch.setattr(near_dedup, "GROUP_SHINGLES", 600)
    monkeypatch.setattr(near_dedup, "PIVOTS", 2)
    check(frame, rows, 2)


def test_odd_rows(odd, frame, spark):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check(frame, rows, 2)
    assert near_duplicates(odd.limit(0)).count() == 0


def test_signature_estimates_similarity():
    import numpy as np

    r = np.random.default_rng(4)
    errors = []
    for _ in range(100):
        pool = r.integers(0, 1 << 63, 360, dtype=np.uint64)
        a, b = np.unique(pool[:300]), np.unique(pool[60:])
        same = (near_dedup.signature(a) == near_dedup.signature(b)).mean()
        errors.append(same - 240 / 360)
    # independent positions would spread by 0.0294
    assert abs(np.mean(errors)) < 0.008 and np.std(errors) < 0.0294
    one = near_dedup.signature(pool[:1])
    assert sorted(int(v) >> 48 for v in one) == list(range(near_dedup.POSITIONS))


def cut_by_hand(rows, length):
    texts = [WORD.findall(t or "") for _, t in rows]
    count = {}
    for words in texts:
        for i in range(len(words) - length + 1):
            w = tuple(words[i:i + length])
            count[w] = count.get(w, 0) + 1
    out = []
    for (doc, _), words in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(words) - length + 1):
            if count[tuple(words[i:i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((doc, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


def cut(docs, length):
    with Steps(docs.sparkSession, "test") as steps:
        rows = remove_repeats(docs, steps, length).select("doc.*", "n_words", "n_removed", "kept_text").collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], " ".join(WORD.findall(r["kept_text"]))) for r in rows), key=str)


def passages(seed, length):
    """Texts with shared passages around the limit, overlaps, runs of one word and repeats within a text."""
    r = random.Random(seed)
    word = lambda: r.choice(VOCABULARY) + str(r.randint(0, 500))
    shared = [[word() for _ in range(r.randint(length - 2, 2 * length))] for _ in range(6)]
    rows = []
    for k in range(60):
        words = []
        for _ in range(r.randint(0, 5)):
            kind = r.random()
            if kind < 0.4:
                words += [word() for _ in range(r.randint(1, 3 * length))]
            elif kind < 0.9:
                p = r.choice(shared)
                a = r.randint(0, 5)
                words += p[a:len(p) - r.randint(0, 5)]
            else:
                words += [r.choice("ab")] * r.randint(1, 2 * length)
        rows.append((k // 2, r.choice([" ", "\n", "  \t"]).join(words)))
    return rows + rows[:3]


def test_repeats_equal_brute_force(frame):
    for length in (35, 12):
        rows = passages(length, length)
        assert cut(frame(rows), length) == cut_by_hand(rows, length)


def test_repeats_of_odd_rows(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert cut(odd, 35) == cut_by_hand(rows, 35)
    assert cut(odd.limit(0), 35) == []


def test_kept_text_keeps_its_white_space(frame):
    common = " ".join(f"c{i}" for i in range(40))
    with Steps(frame([]).sparkSession, "test") as steps:
        rows = remove_repeats(frame([(1, f"a\n\nb {common}\tz"), (2, common), (3, "x  y")]), steps).collect()
    assert {r["doc"]["doc_id"]: r["kept_text"] for r in rows} == {1: "a\n\nb \tz", 2: "", 3: "x  y"}
