"""Golay SimHash, importance resampling and spelling variants against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from quillgate.llm import golay, importance, variants

DOCS = "doc_id long, text string, fp string, word string, n int, score string, rank int"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with those that the operators make."""
    return spark.createDataFrame([(i, t, "x", "y", 1, "z", 2) for i, t in rows], DOCS)


# ---- Golay SimHash


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    distinct = sorted(set(prints.values()))
    top = {p: p for p in distinct}

    def find(p):
        while top[p] != p:
            p = top[p]
        return p

    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= 2:
            top[find(a)] = find(b)
    least = {}
    for key, p in prints.items():
        least[find(p)] = min(least.get(find(p), key), key)
    return {key: least[find(p)] for key, p in prints.items()}


def test_golay_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.uint32)[::977]
    index = golay.codeword_index(words)
    assert len(np.unique(golay.codeword_index(np.arange(1 << 23, dtype=np.uint32)))) == 4096
    code = {int(golay.codeword_index(np.array([w]))[0]): w for w in words.tolist() if not golay.ERRORS[
        golay.BYTE_SYNDROMES[0][w & 255] ^ golay.BYTE_SYNDROMES[1][w >> 8 & 255] ^ golay.BYTE_SYNDROMES[2][w >> 16]]}
    for w, i in zip(words.tolist(), index.tolist()):
        if i in code:
            assert (w ^ code[i]).bit_count() <= 3
    assert all((a ^ b).bit_count() >= 7 for a, b in itertools.combinations(list(code.values())[:60], 2))


def test_every_print_within_two_bits_has_an_own_key_among_the_probing_keys():
    rng = random.Random(3)
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 2)):
            b ^= 1 << bit
        probing = set(golay.keys_of(np.array([a], np.uint64), True)[1].tolist())
        assert probing & set(golay.keys_of(np.array([b], np.uint64), False)[1].tolist())


@pytest.mark.parametrize("few", [0, 2, 32])
def test_prints_within_two_bits_are_linked(spark, monkeypatch, few):
    """Random prints, chains and a crowded family; ``few`` of 0 and 2 sends them through the words within one bit."""
    monkeypatch.setattr(golay, "FEW", few)
    rng = random.Random(few)
    prints = [0, (1 << 64) - 1, 1 << 63] + [rng.getrandbits(64) for _ in range(60)]
    for _ in range(150):
        prints.append(rng.choice(prints) ^ (1 << rng.randrange(64)) ^ rng.choice([0, 1 << rng.randrange(64), 7 << rng.randrange(60)]))
    family = rng.getrandbits(64)
    prints += [family ^ (1 << i) for i in range(40)]
    rows = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in sorted(set(prints))], "fp long")
    links = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in golay.print_links(rows).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    top = {p: p for p in prints}

    def find(p):
        while top[p] != p:
            p = top[p]
        return p

    for a, b in links:
        top[find(a)] = find(b)
    want = plain_components(dict(enumerate(sorted(set(prints)))))
    got = {i: find(p) for i, p in enumerate(sorted(set(prints)))}
    assert len(set(zip(want.values(), got.values()))) == len(set(want.values())) == len(set(got.values()))


def test_simhash_equals_plain_python(spark):
    rng = random.Random(11)
    make = lambda n: " ".join(rng.choice(["Alpha", "beta", "ünï", "d\x0be", "中文", "x" * 40]) for _ in range(n))
    texts = ["", None, " \t\n", "one", "One two", "a b c", "A  b\x0cc", "nb sp x y z", make(40_000)] + [make(rng.randint(1, 30)) for _ in range(60)]
    long = texts[8]
    texts += [long, long + " tail", long.replace("beta", "Beta"), texts[20] + " more"] + [texts[21]] * 5
    rows = list(enumerate(texts, 5))
    got = {r["doc_id"]: r for r in golay.near_duplicates(docs_of(spark, rows)).collect()}
    prints = {i: plain_print(t) for i, t in rows}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in got.items()} == plain_components(prints)
    assert got[5]["component_id"] == got[6]["component_id"] == got[7]["component_id"] == 5


def test_simhash_of_null_ids_and_empty_tables(spark):
    rows = [(None, "only here now"), (None, "only here now"), (None, "shared text of two"), (4, "shared text of two"), (4, "shared text of two")]
    got = sorted(map(tuple, golay.near_duplicates(docs_of(spark, rows)).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(None, None), (None, None), (None, 4), (4, 4), (4, 4)], key=str)
    assert golay.near_duplicates(docs_of(spark, [])).collect() == []


# ---- importance resampling


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def plain_resample(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(plain_features(text)[1])
    for text in target:
        t.update(plain_features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out, able = [], []
    for key, text in docs:
        words, found = plain_features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in found]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
        if len(words) >= 20:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], r[1]))
    drawn = able[:25 * len(able) // 100]
    left = Counter(out) - Counter(drawn)
    return sorted([(*r, k) for k, r in enumerate(drawn, 1)] + [(*r, None) for r in left.elements()], key=str)


def resample(spark, docs, target):
    bench = spark.createDataFrame([(str(i), t, 1) for i, t in enumerate(target)], "item_id string, text string, bucket int")
    got = importance.resample(docs_of(spark, docs), bench)
    return sorted(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_resampling_equals_plain_python(spark, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", 7)
    monkeypatch.setattr(importance, "RUN", 3)
    rng = random.Random(2)
    words = ["Alpha", "beta", "ünï-cödé", "D9", "中文", "e'f", "g_h"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, make(rng.randint(0, 60))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "..."), (203, "one"), (204, make(30_000)), (None, make(40)), (None, None)]
    docs += [docs[3]] * 20 + [(300, make(50))] * 31 + [(7, make(25))]
    target = [make(30), None, "", "alpha Beta " * 40]
    assert resample(spark, docs, target) == plain_resample(docs, target)
    monkeypatch.setattr(importance, "BLOCK", 1 << 16)
    assert resample(spark, docs, target) == plain_resample(docs, target)


def test_resampling_of_empty_tables(spark):
    assert resample(spark, [], ["a b"]) == []
    docs = [(i, "same words " * 12) for i in range(8)]
    assert resample(spark, docs, []) == plain_resample(docs, [])
    assert resample(spark, [(1, None)], []) == [(1, 0, 0, plain_resample([(1, None)], [])[0][3], None)]


def test_a_target_of_other_words_is_drawn_first(spark):
    docs = [(i, ("gold mine ore " if i % 4 == 0 else "rain cloud sky ") * 10) for i in range(200)]
    drawn = [r[0] for r in resample(spark, docs, ["gold mine ore " * 50]) if r[4]]
    assert len(drawn) == 50 and sum(i % 4 == 0 for i in drawn) >= 45


# ---- spelling variants


def plain_variants(docs):
    n = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}

    def is_near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    near = {w: [v for v in n if v != w and is_near(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(rows)


def found_variants(spark, docs):
    got = variants.spelling_variants(docs_of(spark, docs))
    return sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def edited(rng, word):
    at = rng.randrange(len(word))
    return rng.choice([word[:at] + word[at + 1:], word[:at] + rng.choice("abéz") + word[at:], word[:at] + rng.choice("abéz") + word[at + 1:]])


def crowd(rng, size, letters="abcdé"):
    """Words with many near words, of 5 to 2,000 occurrences."""
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(size)]
    for _ in range(2 * size):
        words.append(edited(rng, rng.choice(words)))
    return {w: rng.choice([4, 5, 5, 6, 25, 26, 130, 700]) for w in words if len(w) >= 5}


@pytest.mark.parametrize("few, frequent", [(0, 3), (3, 3), (64, 2), (10 ** 6, 0), (10 ** 6, 20), (64, 10 ** 6)])
def test_near_words_equal_plain_python(spark, monkeypatch, few, frequent):
    monkeypatch.setattr(variants, "LONGEST", 2 + few % 4)
    counts = crowd(random.Random(few + frequent), 40, "abé")
    words = sorted(w for w in counts if len(w) >= 6)
    table = spark.createDataFrame([(w, len(w)) for w in words], "word string, length int")
    got = sorted(map(tuple, variants.near_pairs(table, frequent, few).collect()))
    want = []
    for a, b in itertools.combinations(words, 2):
        x, y = sorted((a, b), key=len)
        if len(x) == len(y) and sum(p != q for p, q in zip(x, y)) == 1 or len(y) - len(x) == 1 and any(y[:i] + y[i + 1:] == x for i in range(len(y))):
            want.append((a, b))
    assert got == want and len(want) > 30


def test_variants_equal_plain_python(spark):
    rng = random.Random(9)
    counts = crowd(rng, 30)
    bag = [w.title() if rng.random() < 0.2 else w for w, n in counts.items() for _ in range(n)]
    rng.shuffle(bag)
    docs = [(i, rng.choice([" ", "-", "9", ", "]).join(bag[i * 60:(i + 1) * 60])) for i in range(len(bag) // 60 + 1)]
    docs += [(None, " ".join(bag[:300])), (None, None), (900, ""), (901, "ÀÉÎÕÜ × ÷÷÷÷÷÷ short"), (902, " ".join(bag[:20_000])), (903, "x" * 3000 + " " + "x" * 3001)]
    docs += [docs[0]] * 7
    got = found_variants(spark, docs)
    assert got == plain_variants(docs)
    assert any(r[2] != r[1] for r in got if r[1]) and any(r[4] == 0 for r in got)


def test_variants_of_empty_tables_and_ties(spark):
    assert found_variants(spark, []) == [] and found_variants(spark, [(1, None), (2, "a b")]) == []
    docs = [(i, "aaaaab " * 5 + "aaaaac " * 5 + ("aaaaaa " if i == 0 else "")) for i in range(9)] + [(99, "aaaaaa " * 6)]
    rows = {r[0]: r for r in found_variants(spark, docs)}
    assert found_variants(spark, docs) == plain_variants(docs)
    assert rows["aaaaaa"][1] in ("aaaaab", "aaaaac")


def test_too_many_grams_ask_for_more_places(spark, monkeypatch):
    words = sorted({w for w in crowd(random.Random(1), 60) if len(w) >= 6})
    table = spark.createDataFrame([(w, len(w)) for w in words], "word string, length int")
    whole = variants.gram_dictionary(table, 2)
    monkeypatch.setattr(variants, "MOST_GRAMS", len(whole) - 1)
    fewer = variants.gram_dictionary(table, 2)
    assert len(fewer) < len(whole) and {g for g in whole if len(g) == 2} <= set(fewer)
    assert all(g[:-1] in fewer for g in fewer if len(g) > 2)
