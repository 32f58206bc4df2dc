"""Every registered opN query on a small folder, each contract column against a plain version of its own."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tideline.llm import language_id, pieces, queries

WORDS = {
    "en": "the of and to in that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son mais comme été ou nous leur ont même elle cette être fait deux aussi".split(),
}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + (str(rng.randrange(99)) if rng.random() < 0.1 else "") for _ in range(n))


def documents():
    rng = random.Random(21)
    texts = [(prose(rng, lang := rng.choice(list(WORDS)), rng.randint(3, 120)), lang) for _ in range(120)]
    passage, item = prose(rng, "en", 40), prose(rng, "en", 30)
    texts += [texts[3], texts[3], texts[5], (texts[7][0] + " end", texts[7][1]), (texts[7][0].upper(), texts[7][1])]
    texts += [(f"{prose(rng, 'de', 20)} {passage} {prose(rng, 'de', 20)}", "de") for _ in range(4)]
    texts += [(item, "en"), (prose(rng, "en", 50) + " " + item.upper() + ". " + prose(rng, "en", 3), "en"), (prose(rng, "fr", 900) + " " + item, "fr"), ("one short item", "en"), ("x one, SHORT item y", "en")]
    texts += [(None, "en"), ("", None), ("123 !?", "de"), ("漢字 ﬁ é  x", None), ("a" * 500, "en"), ("ab" * 300 + " \t\n tail", None), ("\x00\x0b\x1c words\x85here", "en")]
    return [(i, t, lang, f"s{i % 3}", len(t or "")) for i, (t, lang) in enumerate(texts)], [("q1", item), ("q2", "one short item"), ("q3", None), ("q4", "!?"), ("q1", item), (None, prose(rng, "de", 20))]


@pytest.fixture(scope="module")
def docs():
    return documents()[0]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = documents()
    home, rng = str(tmp_path_factory.mktemp("llm")), random.Random(22)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{home}/benchmark.parquet")
    pages = [(i, f"http://h{i}/", [None, "", "x" * 99, "y" * 100, "é" * 60, f"<p>{i}</p>" * 20][rng.randrange(6)]) for i in range(60)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(f"{home}/pages.parquet")
    vectors = [(i, None if i == 7 else [rng.gauss(0, 1) if (i, k) != (9, 2) else math.nan for k in range(5)]) for i in range(320)]
    spark.createDataFrame([*vectors, (400, vectors[3][1]), (401, vectors[3][1])], "vec_id long, embedding array<float>").repartition(4).write.parquet(f"{home}/embeddings.parquet")
    return home


def rows_of(spark, folder, name):
    return queries.queries()[name](spark, folder).collect()


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op1(spark, folder):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in rows_of(spark, folder, "op1_warc")}
    assert set(got) == set(pages)
    for i, data in pages.items():
        first = min(j for j, other in pages.items() if other == data)
        again = len(data) >= 100 and first != i
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"], got[i]["refers_to"]) == (len(data), sha(data), "revisit" if again else "response", first if again else None)


def test_op2_and_op5(spark, folder, docs):
    library = pieces.pieces_of(pieces.read_model(None)).processor
    counts = {r["doc_id"]: r for r in rows_of(spark, folder, "op2_token_counts")}
    coded = {r["doc_id"]: r for r in rows_of(spark, folder, "op5_sentencepiece")}
    for i, text, *_ in docs:
        ids = library.encode(text or "")
        assert (counts[i]["n_bytes"], counts[i]["n_tokens"], counts[i]["over_limit"]) == (len((text or "").encode()), len(ids), len(ids) > 4096)
        ids.append(library.eos_id())
        assert (coded[i]["n_tokens"], coded[i]["ids_sha256"], coded[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(library.decode(ids).encode()))
    assert len(counts) == len(coded) == len(docs)


def _profile(text):
    """Sum of bound letter vectors, gram by gram."""
    letters, total = [0], np.zeros(language_id.DIMENSIONS)
    for c in text or "":
        x = ord(c.lower()[0]) if c.isalpha() else 0
        if x or letters[-1]:
            letters.append(x)
    if letters[-1]:
        letters.append(0)
    vectors = dict(zip(sorted(set(letters)), language_id.letter_vectors(np.array(sorted(set(letters))), language_id.DIMENSIONS, language_id.SEED).astype(float), strict=True))
    for x, y, z in zip(letters, letters[1:], letters[2:], strict=False):
        if y:
            total += np.roll(vectors[x], 2) * np.roll(vectors[y], 1) * vectors[z]
    return total


def test_op3(spark, folder, docs):
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in docs}
    sums = defaultdict(lambda: np.zeros(language_id.DIMENSIONS))
    for i, text, lang, *_ in docs:
        if not held[i] and lang is not None and text is not None:
            sums[lang] += _profile(text)
    names = sorted(sums)
    got, right = {r["doc_id"]: r for r in rows_of(spark, folder, "op3_language_id")}, []
    for i, text, lang, *_ in docs:
        v = _profile(text)
        if not v.any():
            want = ("und", 0.0)
        else:
            cosine = [float(v @ sums[k] / np.linalg.norm(v) / np.linalg.norm(sums[k])) for k in names]
            want = (names[int(np.argmax(cosine))], max(0.0, max(cosine)))
        assert got[i]["held_out"] == held[i] and got[i]["lang_pred"] == want[0] and got[i]["score"] == pytest.approx(want[1], abs=1e-9)
        if held[i] and lang and len(text or "") > 60 and " " in text:
            right.append(want[0] == lang)
    assert len(got) == len(docs) and sum(right) >= 0.95 * len(right) > 20


def test_op4(spark, folder):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    q = {i: [math.floor(1024 * x) for x in v] for i, v in vectors.items() if v is not None and all(map(math.isfinite, v))}
    want = []
    for i in (j for j in q if j % 100 == 0):
        scores = sorted((-sum(a * b for a, b in zip(q[i], v, strict=True)), j) for j, v in q.items() if j != i)
        want += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:10], 1)]
    assert sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in rows_of(spark, folder, "op4_top_k")) == sorted(want)


def _fingerprint(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in _split(text or "")]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _split(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def test_op6(spark, folder, docs):
    prints = {i: _fingerprint(text) for i, text, *_ in docs}
    root = {i: i for i in prints}
    for i in prints:
        for j in prints:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 3 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows_of(spark, folder, "op6_simhash")}
    assert got == {i: (f"{p:016x}", root[i]) for i, p in prints.items()}
    assert max(Counter(root.values()).values()) >= 3


def test_op7(spark, folder, docs):
    got = {r["doc_id"]: r for r in rows_of(spark, folder, "op7_sharding")}
    assert len(got) == len(docs)
    for i, text, *_ in docs:
        data = (text or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"], got[i]["law"], got[i]["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)
    slots = defaultdict(list)
    for r in got.values():
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[k]) for k in range(24)]
    assert set(slots) == set(range(24)) and max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_op8(spark, folder, docs):
    words = {i: [w.encode() for w in _split((text or "").translate({c: c + 32 for c in range(65, 91)}))] for i, text, *_ in docs}
    one, two = Counter(w for x in words.values() for w in x), Counter(p for x in words.values() for p in zip(x, x[1:], strict=False))
    total = sum(one.values())
    got = {r["doc_id"]: r for r in rows_of(spark, folder, "op8_stupid_backoff")}
    for i, x in words.items():
        own, pairs, s = Counter(x), Counter(zip(x, x[1:], strict=False)), 0.0
        for k, w in enumerate(x):
            v = max(one[w] - own[w], 1) / max(total - len(x), 1)
            if k:
                c = two[x[k - 1], w] - pairs[x[k - 1], w]
                v = c / (one[x[k - 1]] - own[x[k - 1]]) if c > 0 else 0.4 * v
            s += math.log(v)
        assert got[i]["n_words"] == len(x) and got[i]["log_score"] == pytest.approx(s) and (got[i]["mean_log_score"] is None) == (not x)


def _words(text):
    out, word = [], b""
    for b in (text or "").encode():
        b = b + 32 if 65 <= b <= 90 else b
        if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128:
            word += bytes([b])
        elif word:
            out.append(word)
            word = b""
    return [*out, word] if word else out


def test_op9(spark, folder, docs):
    windows = defaultdict(set)
    for item, text in documents()[1]:
        w = _words(text)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(item or "")
    got = {r["doc_id"]: r for r in rows_of(spark, folder, "op9_decontamination")}
    for i, text, *_ in docs:
        w, hit, items = _words(text), set(), set()
        for window, names in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    items |= names
        want = (len(w), len(hit), len(items), sha(",".join(sorted(items)).encode()), len(hit) > 0 and 20 * len(hit) >= len(w))
        assert tuple(got[i][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == want
    assert sum(r["contaminated"] for r in got.values()) >= 4 and any(r["n_hit"] and not r["contaminated"] for r in got.values())


def test_op10(spark, folder, docs):
    seen, got = set(), {r["doc_id"]: r for r in rows_of(spark, folder, "op10_suffix_dedup")}
    for i, text, *_ in docs:
        data, gone = (text or "").encode(), set()
        for k in range(len(data) - 99):
            s = data[k : k + 100]
            if s in seen:
                gone |= set(range(k, k + 100))
            seen.add(s)
        kept = bytes(b for k, b in enumerate(data) if k not in gone)
        want = (len(data), len(gone), sum(k - 1 not in gone for k in gone), sha(kept))
        assert tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == want
    assert sum(r["n_removed"] > 0 for r in got.values()) >= 8
