"""Queries over data quality, text features, reviews and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import labels, metrics, quality
from ..operators.temporal import MINUTE
from . import views as v
from .views import BASE_SQL, rules_sql, text_ts

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


FULL_BARS = BASE_SQL + ", full_bars AS (SELECT *, epoch_us(ts_open_utc) // 3600000000 % 50 <> 0 AS is_valid_bar, strftime(ts_open_utc, '%Y-%m-%d') AS session_id FROM bars)"
COVER = ", valid AS (SELECT * FROM full_bars WHERE is_valid_bar), stepped AS (SELECT *, ts_open_utc - lag(ts_open_utc) OVER (PARTITION BY session_id ORDER BY ts_open_utc) > INTERVAL 1 HOUR AS gap FROM valid), cover AS (SELECT session_id, epoch_us(max(ts_open_utc) - min(ts_open_utc)) // 3600000000 + 1 AS expected_bars, epoch_us(max(ts_open_utc) - min(ts_open_utc)) // 3600000000 + 1 - count(*) AS missing_bars, count(*) FILTER (gap) AS gaps, 0 AS stale_bars FROM stepped GROUP BY 1)"


@query(f"WITH {FULL_BARS} {COVER} SELECT 'NQH4' AS contract_symbol, * FROM cover")
def a17_coverage(spark, d):
    return quality.coverage(v.full_bars(spark, d), 60)


@query(f"""WITH {FULL_BARS} {COVER} SELECT count(*) AS row_count, count(*) FILTER (is_valid_bar) AS valid_rows, count(*) FILTER (NOT is_valid_bar) AS invalid_rows, strftime(min(ts_open_utc) FILTER (is_valid_bar), '%Y-%m-%d %H:%M:%S') AS min_ts, strftime(max(ts_open_utc) FILTER (is_valid_bar), '%Y-%m-%d %H:%M:%S') AS max_ts,
count(*) FILTER (high < greatest(open, close) OR low > least(open, close)) AS invalid_ohlc_rows, count(*) FILTER (volume = 0) AS zero_volume_rows, 'NQ' AS symbols, 'NQH4' AS contracts, 'events' AS sources, 0::BIGINT AS duplicate_bar_keys, (SELECT sum(expected_bars)::BIGINT FROM cover) AS expected_bars, (SELECT sum(missing_bars)::BIGINT FROM cover) AS missing_bars, (SELECT sum(gaps)::BIGINT FROM cover) AS gaps, 0::BIGINT AS stale_bars FROM full_bars""")
def a16_bar_audit(spark, d):
    return quality.audit_bars(v.full_bars(spark, d), 60)


DOC_POSTS = "doc_posts AS (SELECT doc_id::VARCHAR AS post_id, text AS text_clean, sha256(coalesce(text, '')) AS content_hash, TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE AS created_at_utc, doc_id % 7 AS lag FROM documents)"


def doc_posts(spark, d):
    """Documents as posts, one a minute; every third has an image."""
    created = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("doc_id") * MINUTE)
    rows = v.table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("post_id"), F.col("text").alias("text_clean"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), created.alias("created_at_utc"))
    return rows.withColumns({"received_at_utc": F.timestamp_micros(F.unix_micros("created_at_utc") + F.col("doc_id") % 7 * 1_000_000), "has_image": F.col("doc_id") % 3 == 0, "has_video": F.lit(False)})


AUDIT = "count(*) AS row_count, count(post_id) - count(DISTINCT post_id) AS duplicate_post_ids, count(*) - count(DISTINCT content_hash) AS duplicate_content_hashes, count(*) FILTER (trim(coalesce(text_clean, '')) = '') AS empty_text_rows, count(*) FILTER (trim(coalesce(text_clean, '')) = '' AND post_id::BIGINT % 3 = 0) AS media_only_rows, strftime(min(created_at_utc), '%Y-%m-%d %H:%M:%S') AS min_created_at, strftime(max(created_at_utc), '%Y-%m-%d %H:%M:%S') AS max_created_at, max(lag) * 1000 AS max_feed_lag_ms"


@query(f"WITH {DOC_POSTS} SELECT {AUDIT} FROM doc_posts")
def a15_post_audit(spark, d):
    return quality.audit_posts(doc_posts(spark, d))


@query(f"WITH {DOC_POSTS} SELECT {AUDIT}, epoch_us(TIMESTAMP '2024-03-01 00:00:00' - max(created_at_utc)) // 1000000 AS max_post_lag_seconds, 0::BIGINT AS invalid_timestamp_rows, epoch_us(TIMESTAMP '2024-03-01 00:00:00' - max(created_at_utc)) // 1000000 > 1800 AS is_stale, 'author_id' AS missing_columns FROM doc_posts")
def a19_freshness(spark, d):
    return quality.freshness(doc_posts(spark, d), "2024-03-01 00:00:00", required=["post_id", "author_id"])


@query("SELECT max(doc_id) AS doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents GROUP BY coalesce(text, '')")
def w10_newest_per_hash(spark, d):
    return quality.keep_latest(doc_posts(spark, d).select("doc_id", "content_hash", "created_at_utc"), ["content_hash"], [F.col("created_at_utc")]).select("doc_id", "content_hash")


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^$', '') AS domains FROM pages")
def f3_url_domains(spark, d):
    return v.table(spark, d, "pages").select("page_id", F.concat_ws("|", tx.url_domains(F.array(F.coalesce("url", F.lit(""))))).alias("domains"))


@query(r"SELECT doc_id, length(t) AS post_length, CASE WHEN letters > 0 THEN round(capitals / letters, 6) ELSE 0 END AS all_caps_ratio, len(t) - len(replace(t, '!', '')) AS exclamation_count, len(regexp_extract_all(t, '[^\s\x0B\x{85}\p{Z}]+'))::INTEGER AS token_count, len(t) - len(replace(t, '?', '')) AS question_mark_count FROM (SELECT doc_id, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '\p{L}')) AS letters, len(regexp_extract_all(coalesce(text, ''), '\p{Lu}')) AS capitals FROM documents)")
def f4_text_features(spark, d):
    text = F.coalesce("text", F.lit(""))
    found = tx.punctuation_features(text, text)
    return v.table(spark, d, "documents").select("doc_id", *(found[k].alias(k) for k in ("post_length", "token_count", "all_caps_ratio", "exclamation_count", "question_mark_count")))


@query()
def f1_clean_pages(spark, d):
    """Clean text, addresses and plain text of every page; entities and NFKC have no SQL."""
    return v.table(spark, d, "pages").select("page_id", tx.clean_text(F.col("html")).alias("text_clean"), F.size(tx.urls(F.col("html"))).alias("n_urls"), tx.html_to_text(F.col("html")).alias("plain"))


@query(r"""WITH x AS (SELECT page_id, [url, regexp_replace(upper(url), '^HTTPS?://', 'ftp://Me@'), page_id::VARCHAR] AS addresses FROM pages),
hosts AS (SELECT page_id, list_sort(list_distinct([h for h in [lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) for u in addresses] if h <> ''])) AS hosts FROM x) SELECT page_id, array_to_string(hosts, ',') AS domains FROM hosts""")
def f4_page_domains(spark, d):
    """Hosts of every page's address, of the same one in capitals behind a user, and of what is no address."""
    capitals = F.regexp_replace(F.upper("url"), "^HTTPS?://", "ftp://Me@")
    rows = v.table(spark, d, "pages").select("page_id", F.array("url", capitals, F.col("page_id").cast("string")).alias("addresses"))
    return rows.select("page_id", F.array_join(tx.url_domains(F.col("addresses")), ",").alias("domains"))


@query()
def a38_fingerprint(spark, d):
    """A hash that doesn't depend on the order of rows; Spark's hash has no counterpart in SQL."""
    return quality.fingerprint(v.table(spark, d, "documents"))


def _tree_sql(table: str, key: str, columns: list[str], *, span: int = 64, fan: int = 16, levels: int = 6) -> str:
    part = " || '|' || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE length({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END" for c in sorted(columns))
    ctes = [f"counted AS (SELECT coalesce(floor({key} / {span}.0), -1)::BIGINT AS node, sha256({part}) AS digest, count(*) AS n FROM {table} GROUP BY ALL)"]
    ctes.append("l0 AS (SELECT node, sum(n)::BIGINT AS row_count, sha256(string_agg(digest || '*' || n::VARCHAR, '|' ORDER BY digest || '*' || n::VARCHAR)) AS digest FROM counted GROUP BY 1)")
    child = "lpad(node::VARCHAR, 20, '0') || ':' || digest"
    ctes += [f"l{k} AS (SELECT {'0::BIGINT' if k == levels else f'floor(node / {fan}.0)::BIGINT'} AS node, sum(row_count)::BIGINT AS row_count, sha256(string_agg({child}, '|' ORDER BY {child})) AS digest FROM l{k - 1} GROUP BY 1)" for k in range(1, levels + 1)]
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT {k} AS level, node, row_count, digest FROM l{k}" for k in range(levels + 1))


@query(_tree_sql("documents", "doc_id", ["doc_id", "text", "lang", "source", "n_chars"]))
def a38_digest_tree(spark, d):
    """Digests of ranges of documents, up to one for the table."""
    return quality.digest_tree(v.table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars"), "doc_id")


REVIEWS = "reviews AS (SELECT doc_id::VARCHAR AS event_id, 'q' AS reviewer_id, quality::VARCHAR AS label FROM labels UNION ALL SELECT doc_id::VARCHAR, 't', toxic::VARCHAR FROM labels)"


@query(f"WITH {REVIEWS}, per AS (SELECT event_id, count(*) AS n, count(DISTINCT reviewer_id) AS r FROM reviews GROUP BY 1) SELECT sum(n)::BIGINT AS row_count, count(*) AS unique_event_count, sum(n - r)::BIGINT AS duplicate_event_reviewer_rows, count(*) FILTER (r >= 2) AS multi_review_event_count FROM per")
def a23_review_audit(spark, d):
    return labels.audit_reviews(v.reviews(spark, d))


@query(f"WITH {REVIEWS} SELECT 'reviewer_id' AS column_name, reviewer_id AS value, count(*) AS n FROM reviews GROUP BY ALL UNION ALL SELECT 'label', label, count(*) FROM reviews GROUP BY ALL")
def a23_review_counts(spark, d):
    return labels.review_counts(v.reviews(spark, d), ["reviewer_id", "label"])


@query(f"WITH {REVIEWS}, per AS (SELECT event_id, count(DISTINCT reviewer_id) AS r, count(DISTINCT label) AS l FROM reviews GROUP BY 1) SELECT 'label' AS label_column, count(*) AS events, round(avg((l = 1)::INT), 6) AS unanimous_rate FROM per WHERE r >= 2")
def a24_agreement(spark, d):
    return labels.agreement(v.reviews(spark, d), ["label"])


P1 = "round(least(0.95, greatest(0.05, n_chars / 4096.0)), 4)::DOUBLE"
PRED = f"pred AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS actual, {P1} AS p1, round(1 - {P1}, 4) AS p0, CASE WHEN {P1} >= 0.5 THEN 'good' ELSE 'bad' END AS predicted, greatest({P1}, round(1 - {P1}, 4)) AS confidence FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)"


@query(f"WITH {PRED} SELECT actual, predicted, count(*) AS n FROM pred GROUP BY 1, 2")
def a26_confusion(spark, d):
    return metrics.confusion(v.predictions(spark, d))


CLASS = "SELECT label, count(*) FILTER (actual = label) AS support, count(*) FILTER (predicted = label) AS claimed, count(*) FILTER (actual = label AND predicted = label) AS hits FROM {0}, (VALUES ('good'), ('bad')) v(label) GROUP BY ALL"


@query(f"WITH {PRED}, c AS ({CLASS.format('pred')}), m AS (SELECT *, coalesce(hits / nullif(claimed, 0), 0) AS p, coalesce(hits / nullif(support, 0), 0) AS r FROM c) SELECT label, support, hits, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM m")
def a26_class_metrics(spark, d):
    return metrics.class_metrics(v.predictions(spark, d))


@query(f"WITH {PRED} SELECT round(avg(2 * power(CASE actual WHEN 'good' THEN 1 - p1 / (p1 + p0) ELSE p1 / (p1 + p0) END, 2)), 6) AS brier, round(avg(-ln(CASE actual WHEN 'good' THEN p1 ELSE p0 END / (p1 + p0))), 6) AS log_loss FROM pred")
def a27_probability_metrics(spark, d):
    return metrics.probability_metrics(v.predictions(spark, d), {"good": "p_good", "bad": "p_bad"})


@query(f"WITH {PRED}, b AS (SELECT least(floor(confidence * 10), 9) AS bin, count(*) AS n, avg(confidence) AS c, avg((actual = predicted)::INT) AS a FROM pred GROUP BY 1) SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b")
def a28_calibration_error(spark, d):
    return metrics.calibration_error(v.predictions(spark, d))


THRESHOLDS = "(VALUES (0.0), (0.5), (0.6), (0.7), (0.8), (0.9)) t(threshold)"
KEPT = f", kept AS (SELECT t.threshold::DOUBLE AS threshold, actual, predicted FROM pred, {THRESHOLDS} WHERE confidence >= t.threshold)"


@query(f"""WITH {PRED} {KEPT}, c AS (SELECT threshold, label, count(*) FILTER (actual = label) AS support, count(*) FILTER (predicted = label) AS claimed, count(*) FILTER (actual = label AND predicted = label) AS hits FROM kept, (VALUES ('good'), ('bad')) v(label) GROUP BY ALL HAVING support + claimed > 0),
f AS (SELECT threshold, avg(CASE WHEN support + claimed > 0 THEN round(2.0 * hits / (support + claimed), 6) END) AS f1 FROM c GROUP BY 1)
SELECT t.threshold::DOUBLE AS threshold, count(k.actual) AS n, (SELECT count(*) FROM pred) - count(k.actual) AS abstained, round(count(k.actual) / (SELECT count(*) FROM pred), 6) AS coverage, round(avg((actual = predicted)::INT), 6) AS accuracy, round(any_value(f.f1), 6) AS macro_f1
FROM {THRESHOLDS} LEFT JOIN kept k ON k.threshold = t.threshold LEFT JOIN f ON f.threshold = t.threshold GROUP BY 1""")
def a29_abstention_curve(spark, d):
    return metrics.abstention_curve(v.predictions(spark, d))


@query(f"WITH {PRED} {KEPT} SELECT threshold, 'actual' AS side, actual AS label, count(*) AS n FROM kept GROUP BY ALL UNION ALL SELECT threshold, 'predicted', predicted, count(*) FROM kept GROUP BY ALL")
def a29_label_counts(spark, d):
    return metrics.abstention_labels(v.predictions(spark, d))


FOLD_ARGS = {"first_train": 100, "test_rows": 40, "step": 60, "embargo_rows": 1, "purge_minutes": 30}
FOLD_SQL = """,
idx AS (SELECT post_id, received_at_utc, row_number() OVER (ORDER BY received_at_utc, post_id) - 1 AS i FROM posts),
begins AS (SELECT i AS test_start, least(i + 40, (SELECT count(*) FROM idx)) AS test_end, received_at_utc AS test_begins, received_at_utc - INTERVAL 30 MINUTE AS cutoff FROM idx WHERE i >= 101 AND (i - 101) % 60 = 0),
ends AS (SELECT received_at_utc, max(i) + 1 AS upto FROM idx GROUP BY 1),
found AS (SELECT b.*, least(b.test_start - 1, coalesce(e.upto, 0)) AS train_rows FROM begins b ASOF LEFT JOIN ends e ON b.cutoff >= e.received_at_utc),
folds AS (SELECT row_number() OVER (ORDER BY test_start) AS fold, test_start, test_end, train_rows FROM found WHERE train_rows >= 100)"""


def _folds(spark, d):
    return metrics.walk_forward_folds(v.posts(spark, d), ["received_at_utc", "post_id"], "received_at_utc", **FOLD_ARGS)


@query(f"WITH {BASE_SQL} {FOLD_SQL} SELECT * FROM folds")
def w13_walk_forward_folds(spark, d):
    return _folds(spark, d)[0].select("fold", "test_start", "test_end", "train_rows")


@query(f"WITH {BASE_SQL} {FOLD_SQL} SELECT fold, post_id FROM folds JOIN idx ON i >= test_start AND i < test_end")
def j11_fold_tests(spark, d):
    folds, rows = _folds(spark, d)
    return metrics.fold_tests(rows, folds, **{k: FOLD_ARGS[k] for k in ("first_train", "test_rows", "step", "embargo_rows")}).select("fold", "post_id")


FOLDED = f"WITH {PRED}, models AS (SELECT 'rule' AS model, (doc_id // 100)::BIGINT AS fold, actual, predicted FROM pred UNION ALL SELECT 'good', doc_id // 100, actual, 'good' FROM pred)"


def folded_predictions(spark, d):
    """Predictions of a rule and of a constant, in folds of a hundred ids."""
    rows = v.predictions(spark, d).select(F.floor(F.col("doc_id") / 100).alias("fold"), "actual", "predicted")
    return rows.withColumn("model", F.lit("rule")).unionByName(rows.withColumns({"model": F.lit("good"), "predicted": F.lit("good")}))


@query(f"""{FOLDED}, cells AS (SELECT model, fold, label, count(*) FILTER (actual = label) AS support, count(*) FILTER (predicted = label) AS claimed, count(*) FILTER (actual = label AND predicted = label) AS hits FROM models, (VALUES ('good'), ('bad')) v(label) GROUP BY ALL),
per AS (SELECT model, fold, round(avg(round(coalesce(2.0 * hits / nullif(support + claimed, 0), 0), 6)), 6) AS f1 FROM cells GROUP BY ALL),
pooled AS (SELECT model, label, sum(support) AS support, sum(claimed) AS claimed, sum(hits) AS hits FROM cells GROUP BY ALL),
whole AS (SELECT model, sum(support)::BIGINT AS n, round(sum(hits) / sum(support), 6) AS accuracy, round(avg(round(coalesce(2.0 * hits / nullif(support + claimed, 0), 0), 6)), 6) AS macro_f1 FROM pooled GROUP BY 1)
SELECT w.*, count(*) AS folds, round(avg(f1), 6) AS macro_f1_mean, round(stddev_pop(f1), 6) AS macro_f1_std, min(f1) AS macro_f1_min, max(f1) AS macro_f1_max FROM whole w JOIN per USING (model) GROUP BY ALL""")
def a31_walk_forward_summary(spark, d):
    return metrics.walk_forward_summary(folded_predictions(spark, d), ["bad", "good"])


@query(f"WITH {PRED} SELECT actual AS label FROM pred GROUP BY 1 ORDER BY count(*) DESC, actual LIMIT 1")
def a30_majority(spark, d):
    return metrics.majority(v.predictions(spark, d))


@query(f"WITH {BASE_SQL} SELECT post_id, row_number() OVER (ORDER BY received_at_utc, post_id) - 1 AS row_index, CASE WHEN row_number() OVER (ORDER BY received_at_utc, post_id) - 1 < greatest(1, floor((SELECT count(*) FROM posts) * (1 - 0.35::DOUBLE))) THEN 'train' ELSE 'test' END AS split FROM posts")
def w12_chronological_split(spark, d):
    return metrics.chronological_split(v.posts(spark, d), ["received_at_utc", "post_id"], "received_at_utc").select("post_id", "row_index", "split")


@query(f"WITH {BASE_SQL} {rules_sql()} SELECT post_id AS event_id, post_id, strftime(received_at_utc, '%Y-%m-%d %H:%M:%S') AS received_at_utc, d.text AS text_clean, sentiment AS rule_sentiment_label, tradeability AS rule_tradeability_label, array_to_string(topics, '|') AS rule_topic_labels, '' AS human_sentiment_label, '' AS review_notes FROM labelled JOIN posts p USING (post_id) LEFT JOIN documents d ON d.doc_id = p.doc_id".replace("strftime(received_at_utc", "strftime(p.received_at_utc"))
def k5_label_queue(spark, d):
    """The whole review queue; its hints come from the rules. Columns that are empty for all rows are tested apart."""
    rows = v.labelled(v.posts(spark, d, text=True), spark, d).withColumn("event_id", F.col("post_id"))
    return labels.label_queue(rows).select("event_id", "post_id", text_ts("received_at_utc"), "text_clean", "rule_sentiment_label", "rule_tradeability_label", "rule_topic_labels", "human_sentiment_label", "review_notes")
