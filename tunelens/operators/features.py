"""Instance and text features: labels, feature subsets, normalisation, counts and lexicon scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tunelens.functions import text as t
from tunelens.operators.ordering import lookup

# The text feature groups.
FEATURE_GROUPS = {
    "user": ["cntLists", "cntPosts", "accountAge"],
    "tweet": ["numHashtags", "numUrls"],
    "text": ["numUpperCases", "wordsPerSentence", "meanWordLength"],
    "pos": ["cntAdjective", "cntAdverbs", "cntVerbs"],
    "sentiment": ["sentimentScorePos", "sentimentScoreNeg"],
    "network": ["cntFollowers", "cntFriends"],
    "bow": ["cntSwearWords"],
}


def to_binary(label: Column, normal: str, other: str = "other") -> Column:
    """Fold a multi-class label into the normal class and everything else."""
    return F.when(label == normal, F.lit(normal)).otherwise(F.lit(other))


def drop_features(df: DataFrame, names: list[str]) -> DataFrame:
    missing = set(names) - set(df.columns)
    if missing:
        raise ValueError(f"no such features: {sorted(missing)}")
    return df.drop(*names)


def drop_variants(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Every variant of the rows at once, from one scan: column ``variant``, the dropped features NULL."""
    named = F.explode(F.array(F.lit("all"), *[F.lit(f"no_{g}") for g in groups])).alias("variant")
    rows = df.select("*", named)
    dropped_in: dict[str, list[str]] = {}
    for group, names in groups.items():
        for name in names:
            dropped_in.setdefault(name, []).append(f"no_{group}")
    return rows.withColumns(
        {n: F.when(~F.col("variant").isin(variants), F.col(n)) for n, variants in dropped_in.items()}
    )


def normalize_features(df: DataFrame, profile: list[Row], mode: int) -> DataFrame:
    """Scale the profiled columns; modes: 0 none, 1 min-max, 2 min-max without outliers, 3 standardise.

    ``profile`` holds one row per attribute, so its values go into the plan as constants. A nominal column becomes
    the index of its value in the domain; a flat column becomes 0.
    """
    scaled = {}
    for p in profile:
        if p["name"] not in df.columns:
            continue
        x = F.col(p["name"])
        if p["type"] == "nominal":
            domain = F.array(*[F.lit(v) for v in p["domain"]])
            scaled[p["name"]] = (F.array_position(domain, x) - 1).cast("double")
        elif mode:
            scaled[p["name"]] = _scale(x.cast("double"), p, mode)
    return df.withColumns(scaled)


def _scale(x: Column, p: Row, mode: int) -> Column:
    low, high, mean, sd = p["min"], p["max"], p["mean"], p["stdev"]
    if mode == 2:
        low, high = max(low, mean - 3 * sd), min(high, mean + 3 * sd)
        x = F.greatest(F.least(x, F.lit(high)), F.lit(low))
    centre, width = (mean, sd) if mode == 3 else (low, high - low)
    if width == 0:
        return F.when(x.isNotNull(), F.lit(0.0))
    return (x - F.lit(centre)) / F.lit(width)


def text_features(df: DataFrame, preprocess: bool = False, text: str = "text") -> DataFrame:
    """Counts over the raw text; word and sentence lengths over the cleaned text if ``preprocess``."""
    raw = F.col(text)
    rows = df.withColumn("_t", t.preprocess_text(raw) if preprocess else raw).withColumn("_w", t.words(F.col("_t")))
    n_words = F.size("_w")
    return rows.select(
        *df.columns,
        t.count_matches(raw, t.HASHTAG).alias("numHashtags"),
        t.count_matches(raw, t.URL).alias("numUrls"),
        t.upper_words(raw).alias("numUpperCases"),
        (n_words / F.greatest(t.sentences(F.col("_t")), F.lit(1))).alias("wordsPerSentence"),
        F.coalesce(F.try_divide(t.letters(F.col("_t")), n_words), F.lit(0.0)).alias("meanWordLength"),
    )


def user_features(df: DataFrame, today: Column | None = None) -> DataFrame:
    """Author counters; ``accountAge`` in days, from ``createdAt`` when the source has that instead."""
    if "accountAge" not in df.columns:
        age = F.datediff(F.current_date() if today is None else today, F.col("createdAt"))
        df = df.withColumn("accountAge", age)
    counters = ("cntLists", "cntPosts", "accountAge", "cntFollowers", "cntFriends")
    return df.withColumns({c: F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for c in counters})


#: Rows of the largest lexicon that is broadcast: a few megabytes.
LEXICON_BROADCAST = 100_000

# Feature name by lexicon tag.
LEXICON_COUNTS = {
    "cntAdjective": "adjective",
    "cntAdverbs": "adverb",
    "cntVerbs": "verb",
    "cntSwearWords": "swear",
}


def lexicon_features(df: DataFrame, lexicon: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Tag counts and sentiment sums of each text against a (token, tag, score) lexicon.

    A token listed twice counts under each of its entries; a NULL text has none. Tokens are counted inside each document
    before they meet the lexicon, which is broadcast if its counted rows are few; else frequent tokens are spread over
    several tasks.
    """
    held = df.select(key, F.explode(t.tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    found = lookup(held, lexicon.select("token", "tag", "score"), "token", key, LEXICON_BROADCAST)
    hits = found.groupBy(key).agg(
        *[F.sum(F.when(F.col("tag") == tag, F.col("n"))).alias(name) for name, tag in LEXICON_COUNTS.items()],
        F.sum(F.when(F.col("score") > 0, F.col("score") * F.col("n"))).alias("sentimentScorePos"),
        F.sum(F.when(F.col("score") < 0, F.col("score") * F.col("n"))).alias("sentimentScoreNeg"),
    )
    names = [*LEXICON_COUNTS, "sentimentScorePos", "sentimentScoreNeg"]
    return df.join(hits, key, "left").withColumns(
        {n: F.coalesce(F.col(n), F.lit(0.0) if n.startswith("sent") else F.lit(0)) for n in names}
    )
