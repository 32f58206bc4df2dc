"""Line deduplication, importance resampling and spelling variants against plain versions, as queries and with their own interfaces."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import importance_resampling, line_dedup, queries, spelling_variants

FOLD = {c: c + 32 for c in range(65, 91)}
SHARED = ["A line that many documents share.", "\x0b Another LINE of some length, shared \t", "short one", "exactly twenty chars", "nineteen characters", "ÄÖÜ are not folded, but A-Z are"]


def texts():
    rng = random.Random(5)
    words = ["kitten", "mitten", "smitten", "sitting", "kiten", "Straße", "straßen", "Käse", "naïve", "naive", "occurrence", "occurence", "ocurrence", "banana", "bananna", "aaaaa", "aaaaaa", "aaaa", "zebra", "zebras"]
    out = []
    for i in range(150):
        lines = []
        for _ in range(rng.randint(0, 6)):
            lines.append(rng.choice(SHARED) if rng.random() < 0.4 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 14))))
            if rng.random() < 0.2:
                lines[-1] = rng.choice(["  ", "\t", ""]) + lines[-1].upper() + rng.choice(["\r", " ", ""])
        out.append("\n".join(lines))
    out += [None, "", "\n", "\n\n", SHARED[0], SHARED[0] + "\n" + SHARED[0], "äöü are not folded, but a-z are", "x" * 300_000, " ".join(words) * 2000, out[3], out[3], "no words: !? \x00", "one"]
    return out


@pytest.fixture(scope="module")
def rows():
    ids = random.Random(6).sample(range(-50, 10_000), len(texts()))
    return list(zip(ids, texts(), strict=True))


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    home = str(tmp_path_factory.mktemp("lines"))
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "rest": F.lit(1), "lines": F.lit(2)}).repartition(5).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([("a", "kitten mitten zebra ÄB c4"), ("b", None), (None, "kitten mitten")], "item_id string, text string").write.parquet(f"{home}/benchmark.parquet")
    return home


def plain_lines(rows, min_docs=3, min_length=20):
    holders, split = defaultdict(set), {}
    for i, t in rows:
        split[i] = [(x, x.strip(" \t\n\x0b\x0c\r").translate(FOLD)) for x in (t or "").split("\n")]
        for _, k in split[i]:
            if len(k) >= min_length:
                holders[k].add(i)
    shared = {k: max(h) for k, h in holders.items() if len(h) >= min_docs}
    return {i: (len(x), "\n".join(line for line, k in x if shared.get(k, i) == i)) for i, x in split.items()}


def test_op11(spark, folder, rows):
    want = plain_lines(rows)
    got = queries.queries()["op11_line_dedup"](spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        lines, kept = want[r["doc_id"]]
        assert (r["n_lines"], r["kept_sha256"]) == (lines, hashlib.sha256(kept.encode()).hexdigest())
    assert sum(r["n_dropped"] for r in got) > 60


def test_lines_with_hot_keys_repeated_rows_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_KEYS", 3)  # one key is hot, others aren't
    common, rare = "a line that is in every document here", "a line that is in only three of them"
    rows = [(i, f"{common}\nown line number {i}, of some length" + (f"\n{rare}" if i < 3 else "")) for i in range(40)]
    rows += [(39, rows[39][1]), (None, common), (None, ""), (None, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "t1": F.lit(2), "gone": F.lit("x"), "text_": F.lit(3)})
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"], r["gone"]) for r in line_dedup.drop_lines(docs, carry=["doc_id", "gone"]).collect())
    want = Counter((i, 2 + (i < 3), 1 + (i < 2), f"own line number {i}, of some length" + (f"\n{rare}" if i == 2 else ""), "x") for i in range(39))
    want += Counter({(39, 2, 0, rows[39][1], "x"): 2, (None, 1, 1, "", "x"): 1, (None, 1, 0, "", "x"): 2, (7, 1, 0, "", "x"): 1})
    assert got == want
    assert line_dedup.drop_lines(docs.where("false")).count() == 0


def plain_features(text, n=2):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    return words, [b" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def test_op12(spark, folder, rows):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(zlib.crc32(f) % 10_000 for f in plain_features(text)[1])
    for text in ("kitten mitten zebra ÄB c4", None, "kitten mitten"):
        t.update(zlib.crc32(f) % 10_000 for f in plain_features(text)[1])
    size_s, size_t = sum(s.values()), sum(t.values())
    want = {}
    for i, text in rows:
        words, found = plain_features(text)
        gain = sum(math.floor(1000 * math.log((t[b] + 1) * (size_s + 10_000) / ((s[b] + 1) * (size_t + 10_000)))) for b in (zlib.crc32(f) % 10_000 for f in found))
        weight = gain // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        want[i] = [len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))]
    able = sorted((-w[3], i) for i, w in want.items() if w[0] >= 20)
    drawn = {i: rank for rank, (_, i) in enumerate(able[: 25 * len(able) // 100], 1)}
    got = queries.queries()["op12_importance_resampling"](spark, folder).collect()
    assert len(got) == len(rows) and len(drawn) > 15
    for r in got:
        assert [r["n_features"], r["weight"], r["score"], r["rank"]] == [*want[r["doc_id"]][1:], drawn.get(r["doc_id"])]


@pytest.mark.parametrize("orders", [1, 2, 3])
@pytest.mark.parametrize("limit", [1, 7, 40, 1 << 20])
def test_ngrams_do_not_depend_on_how_texts_are_joined_or_cut(orders, limit):
    sample = ["A b c", None, "", "one", "ü ü ü ü x9 " * 9, "!!", "end of a text", "next"]
    want = Counter((i, zlib.crc32(f) % 97) for i, text in enumerate(sample) for f in plain_features(text, orders)[1])
    got = Counter()
    for owner, bucket, _ in importance_resampling.features([(t or "").encode() for t in sample], orders=orders, buckets=97, limit=limit):
        got.update(zip(owner.tolist(), bucket.tolist(), strict=True))
    assert got == want


def test_resampling_edges(spark):
    docs = spark.createDataFrame([(1, "w " * 30), (1, "w " * 30), (2, "w " * 30), (None, "v " * 25), (3, None), (4, "")], "doc_id long, text string").withColumns({"rank": F.lit("r"), "id": F.lit(0), "before": F.lit(1), "part": F.lit(2)})
    got = importance_resampling.resample(docs, docs.where("false"), percent=75, carry=["doc_id", "before"]).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3] and len(got) == 6
    assert {(r["n_features"], r["weight"], r["rank"]) for r in got if r["doc_id"] in (3, 4)} == {(0, 0, None)}
    assert importance_resampling.resample(docs.where("false"), docs).count() == 0
    assert np.array_equal(importance_resampling.bucket_counts(docs, buckets=5), np.bincount([zlib.crc32(f) % 5 for t in docs.collect() for f in plain_features(t["text"])[1]], minlength=5))


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_groups(n):
    forms, count = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        forms[w], count[w] = (best if best and n[best] >= 2 * n[w] else None), len(others)
    out = {}
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, n[w], count[w], n.get(forms[w]))
    return out


def test_op13(spark, folder, rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(FOLD)
            h = zlib.crc32(f"{i}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            n[low] += 1
    want = plain_groups({w: c for w, c in n.items() if len(w) >= 5 and c >= 3})
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in queries.queries()["op13_spelling_variants"](spark, folder).collect()}
    assert got == want and sum(w[0] is not None for w in want.values()) > 3


def test_groups_of_random_words(spark):
    rng = random.Random(8)
    n = {}
    for _ in range(900):
        word = "".join(rng.choice("abÿ") for _ in range(rng.randint(5, 9)))
        n[word] = rng.choice([3, 3, 4, 7, 20, 50, 200])
    chain = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx", "abcdwzyx"]
    n |= {w: 3 * 2**k for k, w in enumerate(chain)}
    n |= {"longer" * 40: 5, "longer" * 40 + "s": 9, "longer" * 39 + "longar": 10}
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling_variants.group(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got == plain_groups(n)
    assert got["abcdefgh"][1] == "abcdwzyx"


def test_word_edges(spark):
    docs = spark.createDataFrame([(1, "Hello hello HELLO ab×cd"), (None, "hello"), (2, None), (3, "")], "doc_id long, text string").withColumns({"word": F.lit("hello"), "n": F.lit(9)})
    assert [tuple(r) for r in spelling_variants.count_words(docs).collect()] == [("hello", 4)]
    assert spelling_variants.count_words(docs, noise=1, min_length=4, min_count=1).where("char_length(word) = 4").count() >= 1
    assert spelling_variants.group(spelling_variants.count_words(docs.where("false"))).count() == 0
    with pytest.raises(ValueError):
        spelling_variants.group(spelling_variants.count_words(docs), ratio=1)


def test_pivots_are_the_cheapest_disjoint_choice():
    rng = random.Random(9)
    for _ in range(300):
        grams = [(rng.randint(1, 9), k, at) for k, at in enumerate(rng.sample(range(12), rng.randint(3, 6)))]
        best = min(a[0] + b[0] for a in grams for b in grams if a[2] + 2 <= b[2])
        first, second = spelling_variants.pivots(grams)
        assert second[2] >= first[2] + 2 and first[0] + second[0] == best
