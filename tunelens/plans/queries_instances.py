"""Registered queries over relations, instances, short texts and replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunelens.functions import text as t
from tunelens.operators import bow, features, profile
from tunelens.plans import fixtures
from tunelens.plans import oracle_views as v
from tunelens.session import scratch_path
from tunelens.sources import arff, replay, tweets

NUMERIC = ["id", "f_value", "f_hour", "f_user", "f_k"]
SCALED = ["f_value", "f_hour", "f_user", "f_k"]
GROUPS = {"value": ["f_value"], "time": ["f_hour"], "user": ["f_user", "f_k"], "type": ["f_type"]}


def _relation(spark, sf_dir):
    return fixtures.relation(spark, sf_dir)


def _written(spark, sf_dir):
    path = scratch_path(spark, "relation")
    arff.write_arff(_relation(spark, sf_dir), path)
    return path


def _arff_read(spark, sf_dir):
    return arff.read_arff(spark, _written(spark, sf_dir))


def _arff_write(spark, sf_dir):
    """Lines of the written relation by kind, and the cells of its rows."""
    lines = spark.read.text(_written(spark, sf_dir))
    is_row = arff.is_data_line(F.col("value"))
    cells = F.split("value", ",")
    return lines.agg(
        F.count_if(~is_row).alias("header_lines"),
        F.count_if(is_row).alias("rows"),
        F.sum(F.when(is_row, F.size(cells))).alias("cells"),
        F.max(F.when(F.col("value").contains("f_type"), F.col("value"))).alias("nominal_line"),
    )


def _arff_clean(spark, sf_dir):
    """Rows with a stray comma at the end, between comment lines, cleaned."""
    rows = fixtures.instances(spark, sf_dir).select(
        F.explode(
            F.array(
                F.concat(F.lit("% row "), F.col("id"), F.lit(",")),
                F.concat_ws(",", F.col("id"), F.col("f_type"), F.col("label"), F.lit("")),
            )
        ).alias("value")
    )
    return arff.clean_trailing(rows)


def _profile_numeric(spark, sf_dir):
    rows = profile.profile_numeric(_relation(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 6) for c in ("mean", "stdev")})


def _head_read(spark, sf_dir):
    path = scratch_path(spark, "head")
    arff.write_arff_head(profile.profile(_relation(spark, sf_dir)), path)
    head = arff.read_arff_head(spark, path)
    pairs = F.transform("domain", lambda v: F.concat(v, F.lit("="), F.col("counts")[v]))
    rounded = {c: F.round(c, 6) for c in ("min", "max", "mean", "stdev")}
    return head.withColumns({"counts": F.array_join(pairs, ","), **rounded}).drop("domain")


def _head_write(spark, sf_dir):
    return arff.head_lines(profile.profile(_relation(spark, sf_dir)), digits=4)


def _normalized(mode):
    def run(spark, sf_dir):
        rows = _relation(spark, sf_dir)
        stats = [r for r in profile.profile(rows).collect() if r["name"] not in ("id", "label")]
        scaled = features.normalize_features(rows, stats, mode)
        return scaled.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in SCALED})

    return run


def _binary(spark, sf_dir):
    rows = fixtures.instances(spark, sf_dir)
    return rows.select("id", features.to_binary(F.col("f_type"), "view").alias("class"))


def _drop_group(spark, sf_dir):
    rows = fixtures.instances(spark, sf_dir).select("id", *fixtures.INSTANCE_FEATURES)
    return features.drop_variants(rows, GROUPS)


def _tweet_read(spark, sf_dir):
    path = scratch_path(spark, "tweets")
    fixtures.tweets(spark, sf_dir).write.json(path)
    return tweets.read_tweets(spark, path)


def _tweet_preprocess(spark, sf_dir):
    rows = fixtures.tweets(spark, sf_dir)
    return rows.select("id", t.preprocess_text(F.col("text")).alias("text"))


def _text_features(preprocess):
    def run(spark, sf_dir):
        rows = features.text_features(fixtures.tweets(spark, sf_dir).select("id", "text"), preprocess).drop("text")
        return rows.withColumns({c: F.round(c, 6) for c in ("wordsPerSentence", "meanWordLength")})

    return run


def _user_features(spark, sf_dir):
    return features.user_features(fixtures.tweets(spark, sf_dir)).drop("text")


def _lexicon_features(spark, sf_dir):
    rows = fixtures.tweets(spark, sf_dir).select("id", "text")
    return features.lexicon_features(rows, fixtures.lexicon(spark)).drop("text")


def _tweet_replay(spark, sf_dir):
    rows = fixtures.tweets(spark, sf_dir).where("class IS NOT NULL").select("id", "text", "class")
    return replay.replay_file(rows, "id", chunk=100).table()


def _vocabulary(spark, sf_dir):
    return bow.adaptive_vocabulary(_tweet_replay(spark, sf_dir), "normal")


def _adaptive_bow(spark, sf_dir):
    return bow.adaptive_bow(_tweet_replay(spark, sf_dir), "normal").select("id", "chunk_id", "class", "bow")


def _replay_chunks(spark, sf_dir):
    rows = fixtures.instances(spark, sf_dir).select("id", "f_value", "label")
    return replay.replay_file(rows, "id", chunk=2_000).table()


def _dir_partitions(spark, sf_dir):
    rows = fixtures.instances(spark, sf_dir).select("id", "label")
    return replay.dir_partitions(rows, "id", max_count=100)


QUERIES = {
    "arff_read": _arff_read,
    "arff_write": _arff_write,
    "arff_clean": _arff_clean,
    "arff_profile_numeric": _profile_numeric,
    "arff_profile_nominal": lambda s, d: profile.profile_nominal(_relation(s, d)),
    "arff_head_read": _head_read,
    "arff_head_write": _head_write,
    "feature_count": lambda s, d: profile.feature_count(profile.profile(_relation(s, d))),
    "instances_binary": _binary,
    "instances_drop_group": _drop_group,
    **{f"instances_norm{m}": _normalized(m) for m in range(4)},
    "tweet_read": _tweet_read,
    "tweet_preprocess": _tweet_preprocess,
    "tweet_text_features": _text_features(False),
    "tweet_text_features_clean": _text_features(True),
    "tweet_user_features": _user_features,
    "tweet_lexicon_features": _lexicon_features,
    "tweet_vocabulary": _vocabulary,
    "tweet_adaptive_bow": _adaptive_bow,
    "replay_chunks": _replay_chunks,
    "dir_partitions": _dir_partitions,
}

_I = f"WITH {v.INSTANCES}"
_T = f"WITH {v.TWEETS}"
_TYPE_POS = "list_position([" + ", ".join(f"'{e}'" for e in fixtures.EVENT_TYPES) + "], f_type)"
_LABEL = "CAST(label AS VARCHAR)"


def _numeric_sql():
    parts = [
        f"SELECT '{c}' AS name, {i} AS pos, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
        f"avg({c}) AS mean, stddev_pop({c}) AS stdev FROM i"
        for i, c in enumerate(NUMERIC)
    ]
    return f"{_I}, pn AS ({' UNION ALL '.join(parts)})"


def _nominal_sql():
    parts = [
        f"SELECT 'f_type' AS name, 5 AS pos, '{e}' AS value, {j} AS value_pos, count(*) FILTER (f_type = '{e}') AS n FROM i"
        for j, e in enumerate(fixtures.EVENT_TYPES)
    ] + [
        f"SELECT 'label' AS name, 6 AS pos, '{e}' AS value, {e} AS value_pos, count(*) FILTER (label = {e}) AS n FROM i"
        for e in (0, 1)
    ]
    return f"po AS ({' UNION ALL '.join(parts)})"


def _norm_sql(mode):
    stats, out = [], []
    for c in SCALED:
        stats.append(
            f"min({c}) AS {c}_lo, max({c}) AS {c}_hi, avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_sd"
        )
        lo, hi = f"{c}_lo", f"{c}_hi"
        if mode == 0:
            expr = c
        elif mode == 3:
            expr = f"({c} - {c}_mean) / {c}_sd"
        else:
            value = c
            if mode == 2:
                lo = f"greatest({c}_lo, {c}_mean - 3 * {c}_sd)"
                hi = f"least({c}_hi, {c}_mean + 3 * {c}_sd)"
                value = f"greatest(least({c}, {hi}), {lo})"
            expr = f"({value} - {lo}) / ({hi} - {lo})"
        out.append(f"round({expr}, 6) + 0.0 AS {c}")
    return f"""{_I}, z AS (SELECT {", ".join(stats)} FROM i)
        SELECT id, {", ".join(out)}, CAST({_TYPE_POS} - 1 AS DOUBLE) AS f_type, {_LABEL} AS label FROM i, z"""


def _drop_sql():
    dropped = {name: f"no_{g}" for g, names in GROUPS.items() for name in names}
    out = ", ".join(
        f"CASE WHEN variant <> '{dropped[c]}' THEN {c} END AS {c}" for c in fixtures.INSTANCE_FEATURES
    )
    names = ", ".join(f"('{n}')" for n in ["all", *[f"no_{g}" for g in GROUPS]])
    return f"{_I} SELECT id, {out}, variant FROM i, (VALUES {names}) x(variant)"


# The patterns of the text features as SQL has them, stated apart from those of the code under test.
SQL_SPACE = r"[ \t\n\f\r]"
SQL_URL = r"https?://[^ \t\n\f\r]+"
SQL_USER = r"@[\p{L}0-9_]+"
SQL_RETWEET = r"(^|[ \t\n\f\r])RT([ \t\n\f\r]|$)"
SQL_DIGITS = r"[0-9]+"
SQL_PUNCTUATION = r"[\"#$%&'()*+,/:;<=>@\[\\\]^_`{|}~-]"
SQL_HASHTAG = r"#[\p{L}0-9_]+"
SQL_WORD = r"\p{L}+"
SQL_UPPER_WORD = r"^\p{Lu}\p{Lu}+$"
SQL_SENTENCE_END = r"[.!?]+"


def _clean_sql(text="text"):
    for pattern in (SQL_URL, SQL_USER, SQL_RETWEET, SQL_DIGITS, SQL_PUNCTUATION):
        text = f"regexp_replace({text}, '{_q(pattern)}', ' ', 'g')"
    return f"trim(regexp_replace({text}, '{_q(SQL_SPACE)}+', ' ', 'g'))"


def _q(pattern):
    return pattern.replace("'", "''")


def _count_sql(text, pattern):
    return f"CAST(len(regexp_extract_all({text}, '{_q(pattern)}')) AS INTEGER)"


def _text_sql(clean, digits=6):
    body = _clean_sql() if clean else "text"
    return f"""{_T}, q AS (SELECT *, {body} AS body FROM w),
        r AS (SELECT *, regexp_extract_all(body, '{SQL_WORD}') AS ws,
        len(list_filter(string_split_regex(body, '{SQL_SENTENCE_END}'), lambda s: regexp_matches(s, '[^ \\t\\n\\f\\r]')))
        AS n_sent, length(regexp_replace(body, '[^\\p{{L}}]', '', 'g')) AS n_let FROM q)
        SELECT id, {_count_sql("text", SQL_HASHTAG)} AS numHashtags, {_count_sql("text", SQL_URL)} AS numUrls,
        CAST(len(list_filter(regexp_extract_all(text, '{SQL_WORD}'), lambda x: regexp_matches(x, '{SQL_UPPER_WORD}')))
        AS INTEGER) AS numUpperCases, round(len(ws) / CAST(greatest(n_sent, 1) AS DOUBLE), {digits}) AS wordsPerSentence,
        round(coalesce(n_let / CAST(nullif(len(ws), 0) AS DOUBLE), 0), {digits}) AS meanWordLength FROM r"""


_TOKENS = f"regexp_extract_all(lower(text), '{SQL_WORD}')"


def _lexicon_sql():
    rows = ", ".join(
        f"('{w}', '{tag}', {'NULL' if s is None else s})" for w, tag, s in fixtures.lexicon_rows()
    )
    counts = ", ".join(f"count(*) FILTER (tag = '{tag}') AS {n}" for n, tag in features.LEXICON_COUNTS.items())
    return f"""{_T}, l(token, tag, score) AS (VALUES {rows}),
        k AS (SELECT id, unnest({_TOKENS}) AS token FROM w),
        h AS (SELECT id, tag, CAST(score AS DOUBLE) AS score FROM k JOIN l USING (token)),
        g AS (SELECT id, {counts}, coalesce(sum(score) FILTER (score > 0), 0.0) AS p,
        coalesce(sum(score) FILTER (score < 0), 0.0) AS n FROM h GROUP BY id)
        SELECT w.id, {", ".join(f"coalesce({n}, 0) AS {n}" for n in features.LEXICON_COUNTS)},
        coalesce(p, 0.0) AS sentimentScorePos, coalesce(n, 0.0) AS sentimentScoreNeg FROM w LEFT JOIN g ON w.id = g.id"""


_CHUNKED_TWEETS = f"""{_T}, d AS (SELECT id, text, class, (row_number() OVER (ORDER BY id) - 1)
    // 100 AS chunk_id FROM w WHERE class IS NOT NULL),
    tc AS (SELECT chunk_id, token, count_if(class = 'normal') AS n, count_if(class <> 'normal') AS o FROM
    (SELECT chunk_id, class, unnest(list_distinct({_TOKENS})) AS token FROM d) GROUP BY 1, 2),
    cl AS (SELECT chunk_id AS c, count_if(class = 'normal') AS n, count_if(class <> 'normal') AS o FROM d GROUP BY 1),
    tot AS (SELECT c, sum(n) OVER (ORDER BY c) AS tn, sum(o) OVER (ORDER BY c) AS tot_o FROM cl),
    vo AS (SELECT c + 1 AS chunk_id, token FROM tot JOIN tc ON tc.chunk_id <= c GROUP BY c, token, tn, tot_o
    HAVING sum(n) + sum(o) >= 10 AND sum(o) * tn > 2.0 * sum(n) * tot_o)"""

ORACLES = {
    "arff_read": f"""{_I} SELECT CAST(id AS DOUBLE) AS id, f_value, f_hour, f_user, f_k, f_type, {_LABEL} AS label
        FROM i""",
    "arff_write": f"""{_I} SELECT CAST(9 AS BIGINT) AS header_lines, count(*) AS rows, 7 * count(*) AS cells,
        '@attribute f_type {{{",".join(fixtures.EVENT_TYPES)}}}' AS nominal_line FROM i""",
    "arff_clean": f"""{_I} SELECT '% row ' || id || ',' AS value FROM i
        UNION ALL SELECT id || ',' || f_type || ',' || label FROM i""",
    "arff_profile_numeric": f"""{_numeric_sql()} SELECT name, pos, min, max, round(mean, 6) AS mean,
        round(stdev, 6) AS stdev FROM pn""",
    "arff_profile_nominal": f"{_I}, {_nominal_sql()} SELECT * FROM po",
    "arff_head_read": f"""{_numeric_sql()}, {_nominal_sql()} SELECT name, 'numeric' AS type, round(min, 6) AS min,
        round(max, 6) AS max, round(mean, 6) AS mean, round(stdev, 6) AS stdev, NULL AS counts FROM pn
        UNION ALL SELECT name, 'nominal', NULL, NULL, NULL, NULL, string_agg(value || '=' || n, ',' ORDER BY value_pos)
        FROM po GROUP BY name""",
    "arff_head_write": f"""{_numeric_sql()}, {_nominal_sql()}
        SELECT -1 AS pos, '% Features with min, max, average, stdev' AS value
        UNION ALL SELECT pos, '@attribute ' || name || printf(' numeric %.4f %.4f %.4f %.4f', min, max, mean, stdev)
        FROM pn UNION ALL SELECT pos, '@attribute ' || name || ' {{' || string_agg(value, ',' ORDER BY value_pos)
        || '}} {{' || string_agg(CAST(n AS VARCHAR), ',' ORDER BY value_pos) || '}}' FROM po GROUP BY pos, name""",
    "feature_count": f"{_numeric_sql()}, {_nominal_sql()} SELECT (SELECT count(*) FROM pn) + "
    "(SELECT count(DISTINCT name) FROM po) - 1 AS features",
    "instances_binary": f"""{_I} SELECT id, CASE WHEN f_type = 'view' THEN 'view' ELSE 'other' END AS class FROM i""",
    "instances_drop_group": _drop_sql(),
    **{f"instances_norm{m}": _norm_sql(m) for m in range(4)},
    "tweet_read": f"{_T} SELECT * FROM w",
    "tweet_preprocess": f"{_T} SELECT id, {_clean_sql()} AS text FROM w",
    "tweet_text_features": _text_sql(False),
    "tweet_text_features_clean": _text_sql(True),
    "tweet_user_features": f"{_T} SELECT * EXCLUDE (text) FROM w",
    "tweet_lexicon_features": _lexicon_sql(),
    "tweet_vocabulary": f"{_CHUNKED_TWEETS} SELECT * FROM vo",
    "tweet_adaptive_bow": f"""{_CHUNKED_TWEETS}, k AS (SELECT id, chunk_id, unnest({_TOKENS}) AS token FROM d),
        h AS (SELECT id, count(*) AS bow FROM k JOIN vo USING (chunk_id, token) GROUP BY id)
        SELECT d.id, chunk_id, class, coalesce(bow, 0) AS bow FROM d LEFT JOIN h ON d.id = h.id""",
    "replay_chunks": f"""{_I} SELECT id, f_value, label, (row_number() OVER (ORDER BY id) - 1)
        // 2000 AS chunk_id FROM i""",
    "dir_partitions": f"""{_I}, p AS (SELECT id, label, (row_number() OVER (ORDER BY id) - 1) // 100
        AS partition_id FROM i) SELECT * FROM p""",
}
