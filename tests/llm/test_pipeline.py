"""The pipeline's stages, each against its rule on its own input."""

import random

import pytest
import test_queries

from tideline.llm import language_id, pieces, shared

corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORDS = {"en": "the of and to in that it was for on are as with his they".split(), "de": "der die und in den von zu das mit sich des auf für ist im".split()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, home = random.Random(3), str(tmp_path_factory.mktemp("tables"))
    text = lambda lang, n: " ".join(rng.choice(WORDS[lang]) + str(rng.randrange(50)) * rng.randrange(2) for _ in range(n))
    rows = [(i, text(lang := ("en", "de")[i % 2], 150), lang, "s", 0) for i in range(40)]
    passage, item = text("en", 60), text("en", 30)
    rows += [(40, rows[0][1], "en", "s", 0), (41, rows[1][1] + " end", "de", "s", 0), (42, None, "en", "s", 0), (43, "123 456", None, "s", 0)]
    rows += [(44, text("en", 80) + " " + passage, "en", "s", 0), (45, passage + " " + text("en", 80), "en", "s", 0), (46, text("en", 100) + " " + item, "en", "s", 0), (None, text("de", 50), "de", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    return home


def _letters(text):
    return any(c.isalpha() for c in text or "")


def _similar(docs):
    """Documents of which one stays: the smallest id of each group that links of Jaccard 0.8 connect, null ids last."""
    words = [(r["text"] or "").encode().lower().split() for r in docs]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (not a and not b) or (a and b and len(a & b) >= 0.8 * len(a | b)):
                root = [root[j] if r == root[i] else r for r in root]
    groups = {}
    for r, doc in zip(root, docs, strict=True):
        groups.setdefault(r, []).append(doc)
    return [min(g, key=lambda d: (d["doc_id"] is None, d["doc_id"])) for g in groups.values()]


def _without_repeats(docs):
    seen, out = set(), []
    for r in sorted(docs, key=lambda d: (d["doc_id"] is None, d["doc_id"])):
        data, gone = (r["text"] or "").encode(), set()
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                gone |= set(range(k, k + 100))
            seen.add(data[k : k + 100])
        left = bytes(b for k, b in enumerate(data) if k not in gone).decode("utf-8", "ignore")
        if not gone or left:
            out.append((r["doc_id"], left if gone else r["text"]))
    return out


def _contaminated(text, items):
    w = test_queries._words(text)
    hit = set()
    for item in items:
        x = test_queries._words(item)
        for k in range(max(1, len(x) - 12) if x else 0):
            window = x[k : k + 13]
            for at in range(len(w) - len(window) + 1):
                if w[at : at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
    return len(hit) > 0 and 20 * len(hit) >= len(w)


def test_every_stage_against_a_plain_version(spark, folder):
    """Rows and texts of each stage, on what the stage before left."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    library = pieces.pieces_of(pieces.read_model(None)).processor
    plain = {
        "language": lambda rows: [(r["doc_id"], r["text"]) for r in rows if _letters(r["text"])],
        "near_duplicates": lambda rows: [(r["doc_id"], r["text"]) for r in _similar(rows)],
        "repeats": _without_repeats,
        "benchmark": lambda rows: [(r["doc_id"], r["text"]) for r in rows if not _contaminated(r["text"], items)],
        "tokens": lambda rows: [(r["doc_id"], (*library.encode(r["text"] or ""), library.eos_id())) for r in rows],
    }
    key = lambda x: (x[0] is None, x[0] or 0, str(x[1]))
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        docs = stage(spark, docs, folder).checkpoint()
        own = [(r["doc_id"], tuple(r["ids"]) if name == "tokens" else r["text"]) for r in docs.collect()]
        assert sorted(own, key=key) == sorted(plain[name](rows), key=key), name
        if name == "tokens":
            assert all(r["decoded_sha256"] == test_queries.sha(library.decode(list(r["ids"])).encode()) for r in docs.collect())


@pytest.mark.parametrize("number", range(5))
def test_stages_take_empty_tables_nulls_and_further_columns(spark, folder, number):
    name, stage = corpus_pipeline.STAGES[number]
    rows = [(None, None, None, None, None), (None, "", None, None, None), (1, "the of and to in", "en", "s", 3), (1, "the of and to in", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as row", "2 as n", "3 as rest", "4 as kept", "5 as part", "6 as ids", "7 as spans")
    assert stage(spark, docs.where("false"), folder).count() == 0
    want = {"language": 2, "near_duplicates": 2, "repeats": 4, "benchmark": 4, "tokens": 4}[name]
    assert stage(spark, docs, folder).count() == want


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert 30 < len(rows) < 48 and all(r["checked"] and r["n_tokens"] == len(r["ids"]) for r in rows)


def test_near_duplicates_by_similarity(spark):
    """A document of 150 words with three of them changed has a Jaccard index of 0.82 and far more than three other bits; one with nine changed is another document."""
    words = [f"w{i}" for i in range(150)]
    change = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(words))
    rows = [(1, change(), "en", "s", 0), (2, change(30, 75, 120), "en", "s", 0), (3, change(*range(5, 150, 16)), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()} == {1, 3}


def test_language_rejects_junk_and_what_was_not_learned(spark, folder):
    rng = random.Random(5)
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n)) for n in (120, 600, 3_000)]
    junk += ["съешь же ещё этих мягких французских булок да выпей чаю " * 5, "漢字仮名交じり文の例です" * 10, "xqz wvk " * 40]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = spark.createDataFrame([(100 + i, t, None, "s", 0) for i, t in enumerate(junk)], docs.schema)
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["language"](spark, docs.unionByName(more), folder).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - {42, 43}


def test_language_threshold_is_of_all_labelled_texts(spark):
    """Over 40,000 labelled texts, one in a thousand is 40 of them: the 41st lowest score counts, not one of a share of the texts."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(WORDS[lang]) + str(rng.randrange(9)) * rng.randrange(2) for _ in range(20)), lang) for i in range(40_001) for lang in [("en", "de")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    prototypes = language_id.fit(docs.where("doc_id < 1000"))
    found = language_id.predict(docs, prototypes, carry=["text", "lang"]).where(f"lang = lang_pred and char_length(text) >= {language_id.LEAST_CHARS}")
    scores = sorted(r["score"] for r in found.select("score").collect())
    place = 0.001 * (len(scores) - 1)
    low, high = scores[int(place)], scores[int(place) + 1]
    assert len(scores) == 40_001
    assert language_id.threshold(docs, prototypes) == pytest.approx(0.6 * (low + (high - low) * (place % 1)), abs=1e-12)


def test_stages_send_texts_in_small_batches(spark):
    """20 MB of texts in one partition: a batch has 4 MB at most, in a stage's lazy result too; a session's own limit stays."""

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    texts = spark.range(0, 10_000, 1, 1).selectExpr("id", "repeat('x', 2000) AS text")
    docs = spark.createDataFrame([(1, "one text", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    found = texts.mapInArrow(sizes, "n long")
    try:
        spark.conf.unset(shared.BATCH_LIMIT)
        assert [r["doc_id"] for r in stage(spark, docs, "").collect()] == [1]
        assert max(r["n"] for r in found.collect()) < 1.1 * shared.BATCH_BYTES
        spark.conf.set(shared.BATCH_LIMIT, "7000000")
        stage(spark, docs, "")
        assert spark.conf.get(shared.BATCH_LIMIT) == "7000000"
    finally:
        spark.conf.unset(shared.BATCH_LIMIT)
