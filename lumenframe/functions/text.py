"""Text as column expressions: cleaning, tokens, similarity, masking, sentiment, keywords, summaries and chunks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Frequent English words.
STOPWORDS = tuple("a an and are as at be but by for from has have he her his i if in into is it its me my no not of on or our she so that the their them they this to was we were what when which who will with you your".split())
#: Fixed values of the counting lexicon.
POSITIVE = tuple("good great excellent amazing wonderful fantastic love like best happy glad pleased satisfied perfect awesome brilliant outstanding superb nice".split())
NEGATIVE = tuple("bad terrible awful horrible poor worst hate dislike unhappy sad angry disappointed useless broken waste fail problem".split())
#: Fixed values of the scanning lexicon; a word that ends with n't turns the next one too.
SCAN_POSITIVE = tuple("good great excellent amazing wonderful fantastic love happy joy best beautiful perfect awesome brilliant outstanding superb nice positive success win winning pleased delighted satisfied recommend".split())
SCAN_NEGATIVE = tuple("bad terrible awful horrible worst hate sad angry disappointed poor wrong fail failure negative problem issue broken useless waste annoying frustrating upset unhappy regret avoid".split())
INTENSIFIERS = tuple("very really extremely absolutely totally".split())
NEGATIONS = tuple("not n't no never neither nobody nothing".split())

CLEANERS: dict[str, Callable[[Column], Column]] = {
    "lowercase": F.lower,
    "remove_urls": lambda c: F.regexp_replace(c, r"https?://\S+|www\.\S+", " "),
    "remove_emails": lambda c: F.regexp_replace(c, r"\S+@\S+\.\S+", " "),
    "remove_mentions": lambda c: F.regexp_replace(c, r"@\w+", " "),
    "remove_hashtags": lambda c: F.regexp_replace(c, r"#\w+", " "),
    "remove_html": lambda c: F.regexp_replace(c, r"<[^>]+>", " "),
    "remove_numbers": lambda c: F.regexp_replace(c, r"[0-9]+", " "),
    "remove_punctuation": lambda c: F.translate(c, PUNCTUATION, ""),
    "remove_special_chars": lambda c: F.regexp_replace(c, r"(?U)[^\w\s]", " "),
    "remove_whitespace": lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")),
    "remove_stopwords": lambda c: F.array_join(F.filter(split_words(c), lambda w: ~F.lower(w).isin(*STOPWORDS)), " "),
}


def clean(c: Column, steps: list[str]) -> Column:
    return reduce(lambda x, s: CLEANERS[s](x), steps, c)


def split_words(c: Column) -> Column:
    """Words between white space, none of them empty."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def filter_words(c: Column, shortest: int = 2, longest: int = 50) -> Column:
    return F.array_join(F.filter(split_words(c), lambda w: F.char_length(w).between(shortest, longest)), " ")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"\b([a-zA-Z]{2,})\b"), F.lit(1))


def words(c: Column) -> Column:
    """Runs of at least two letters of any script, lower-cased; runs with digits or underscores are none."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{M}\p{N}_]+)"), F.lit(1)), lambda w: w.rlike(r"^[\p{L}\p{M}]{2,}$"))


def ngrams(words: Column, n: int) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(none)


def text_stats(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """Most frequent words with the column's mean length, mean word count and vocabulary."""
    whole = df.agg(F.avg(F.char_length(column)).alias("avg_length"), F.avg(F.size(split_words(F.col(column)))).alias("avg_words"))
    counts = df.select(F.explode(split_words(F.col(column))).alias("word")).groupBy("word").count()
    return counts.withColumn("vocabulary", F.count("*").over(Window.partitionBy())).orderBy(F.desc("count"), "word").limit(top).crossJoin(F.broadcast(whole))


def similarity_ratio(a: Column, b: Column) -> Column:
    """1 - edits / longer length; two empty texts are equal."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def token_set(c: Column) -> Column:
    return F.array_distinct(split_words(F.lower(c)))


def jaccard(a: Column, b: Column) -> Column:
    x, y = token_set(a), token_set(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def cosine_binary(a: Column, b: Column) -> Column:
    x, y = token_set(a), token_set(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.sqrt(F.size(x).cast("double") * F.size(y))), F.lit(0.0))


SIMILARITIES = {"jaccard": jaccard, "cosine": cosine_binary, "levenshtein": lambda a, b: similarity_ratio(F.lower(a), F.lower(b))}


def find_similar(df: DataFrame, column: str, query: str, method: str = "cosine", top: int = 5, key: str = "id") -> DataFrame:
    score = SIMILARITIES[method](F.col(column), F.lit(query))
    return df.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(top)


def similar_pairs(df: DataFrame, key: str, column: str, least: float = 0.5) -> DataFrame:
    """All pairs that share a token and whose binary cosine is at least ``least``.

    Equal token sets are compared as one. Sets of that cosine share at least ``least``² of either's tokens, so with tokens
    ordered from rare to frequent they meet in a token of their prefixes: as many tokens as leave one less than that share.
    """
    rows = df.select(F.col(key).alias("k"), F.array_sort(token_set(F.col(column))).alias("s")).where(F.size("s") > 0).distinct()
    sets = rows.select("s").distinct()
    long = sets.select("s", F.explode("s").alias("w"))
    ordered = long.join(long.groupBy("w").agg(F.count("*").alias("n")), "w").groupBy("s").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("t"))
    share = F.greatest(F.ceil(F.lit(max(least, 0.0) ** 2) * F.size("s") - 1e-9).cast("int"), F.lit(1))
    prefix = ordered.select("s", F.explode(F.slice("t", F.lit(1), F.greatest(F.size("s") - share + 1, F.lit(0)))["w"]).alias("w"))
    met = prefix.select(F.col("s").alias("x"), "w").join(prefix.select(F.col("s").alias("y"), "w"), "w").where(F.col("x") < F.col("y")).select("x", "y").distinct()
    score = F.size(F.array_intersect("x", "y")) / F.sqrt(F.size("x").cast("double") * F.size("y"))
    near = met.select("x", "y", score.alias("score")).where(F.col("score") >= least)
    side = lambda s, k: rows.select(F.col("s").alias(s), F.col("k").alias(k))
    across = near.join(side("x", "i"), "x").join(side("y", "j"), "y").where("i != j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "score")
    equal = side("x", "a").join(side("x", "b"), "x").where("a < b").select("a", "b", F.lit(1.0).alias("score"))
    return across.union(equal.where(F.col("score") >= least))


# Masking


def hash_value(c: Column) -> Column:
    return F.when(c != "", F.left(F.sha2(c, 256), F.lit(16)))


def redact(c: Column, kind: str) -> Column:
    return F.when(c != "", F.lit(f"[{kind.upper()}]"))


def partial_mask(c: Column, kind: str) -> Column:
    digits = F.regexp_replace(c, r"[^0-9]", "")
    if kind == "email":
        name, host = F.substring_index(c, "@", 1), F.substring_index(c, "@", -1)
        out = F.concat(F.left(name, F.lit(1)), F.lit("***@"), host)
    elif kind in ("phone", "card", "ssn"):
        out = F.concat(F.repeat(F.lit("*"), F.greatest(F.char_length(digits) - 4, F.lit(0))), F.right(digits, F.lit(4)))
    elif kind == "ip":
        out = F.concat(F.substring_index(c, ".", 2), F.lit(".*.*"))
    else:
        out = F.concat(F.left(c, F.lit(1)), F.repeat(F.lit("*"), F.greatest(F.char_length(c) - 1, F.lit(0))))
    return F.when(c != "", out)


def generalize(c: Column, kind: str) -> Column:
    out = F.concat(F.lit("*@*."), F.substring_index(c, ".", -1)) if kind == "email" else F.concat(F.substring_index(c, ".", 1), F.lit(".0.0.0")) if kind == "ip" else F.lit("[GENERALIZED]")
    return F.when(c != "", out)


def tokenize_values(df: DataFrame, column: str) -> DataFrame:
    """TOKEN_000001 and so on by sorted distinct value: equal values share a token."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_v")).distinct()
    numbered = values.withColumn("_t", F.concat(F.lit("TOKEN_"), F.lpad(F.row_number().over(Window.orderBy("_v")).cast("string"), 6, "0")))
    return df.join(numbered, F.col(column) == F.col("_v"), "left").withColumn(column, F.col("_t")).drop("_v", "_t")


MASKS = {"partial": partial_mask, "redact": redact, "generalize": generalize, "hash": lambda c, kind: hash_value(c), "null": lambda c, kind: F.lit(None).cast("string")}


def mask(df: DataFrame, columns: dict[str, str], strategy: str = "partial") -> DataFrame:
    """``columns``: name -> kind of personal data."""
    return df.withColumns({c: MASKS[strategy](F.col(c).cast("string"), kind) for c, kind in columns.items()})


#: Anchored patterns of kinds.
PATTERNS = {
    "email": r"^[\w.+-]+@[\w-]+\.[\w.-]+$",
    "url": r"^https?://[^\s/$.?#].[^\s]*$",
    "phone": r"^\+?[0-9][0-9 ().-]{6,}[0-9]$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "ip": r"^\d{1,3}(\.\d{1,3}){3}$",
    "date": r"^\d{4}-\d{2}-\d{2}",
}


def detect_kinds(df: DataFrame, columns: list[str], least: float = 0.8) -> DataFrame:
    """column, kind, share for each pattern that at least ``least`` of the values match, over all rows in one aggregate."""
    pairs = [(c, k) for c in columns for k in PATTERNS]
    wide = df.agg(*[F.avg(F.when(F.col(c).isNotNull(), F.col(c).cast("string").rlike(PATTERNS[k]).cast("double"))).alias(f"s{i}") for i, (c, k) in enumerate(pairs)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col(f"s{i}").alias("share")) for i, (c, k) in enumerate(pairs)]))).where(F.col("share") >= least)


# Analysis


def lexicon_sentiment(c: Column) -> Column:
    """(good - bad) / (good + bad) among the words between white space, 0 without either."""
    words = split_words(F.lower(c))
    good, bad = F.size(F.filter(words, lambda w: w.isin(*POSITIVE))), F.size(F.filter(words, lambda w: w.isin(*NEGATIVE)))
    return F.coalesce(F.try_divide((good - bad).cast("double"), good + bad), F.lit(0.0))


def scanned_sentiment(c: Column) -> Column:
    """One fold over the words between white space: a strengthener makes the next hit count 1.5, a negation turns it, and a hit
    ends both. (good - bad) / (good + bad), 0 without hits."""
    start = F.struct(F.lit(0.0).alias("good"), F.lit(0.0).alias("bad"), F.lit(1.0).alias("weight"), F.lit(False).alias("turned"))

    def step(s, w):
        good, bad = w.isin(*SCAN_POSITIVE), w.isin(*SCAN_NEGATIVE)
        strong, turns = w.isin(*INTENSIFIERS), w.isin(*NEGATIONS) | w.endswith("n't")
        counts = (good | bad) & ~strong & ~turns
        up = good != s["turned"]
        return F.struct(
            (s["good"] + F.when(counts & up, s["weight"]).otherwise(0.0)).alias("good"),
            (s["bad"] + F.when(counts & ~up, s["weight"]).otherwise(0.0)).alias("bad"),
            F.when(strong, 1.5).when(counts, 1.0).otherwise(s["weight"]).alias("weight"),
            F.when(strong, s["turned"]).when(turns, True).when(counts, False).otherwise(s["turned"]).alias("turned"),
        )

    end = F.aggregate(split_words(F.lower(c)), start, step)
    return F.coalesce(F.try_divide(end["good"] - end["bad"], end["good"] + end["bad"]), F.lit(0.0))


ENTITIES = {
    "EMAIL": r"[\w.+-]+@[\w-]+\.[\w.-]+",
    "URL": r"https?://[^\s]+",
    "MONEY": r"\$[0-9][0-9,]*(?:\.[0-9]+)?",
    "DATE": r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}",
    "PERSON": r"\b[A-Z][a-z]+(?: [A-Z][a-z]+){1,2}\b",
}


def entities(df: DataFrame, key: str, column: str) -> DataFrame:
    parts = [F.transform(F.regexp_extract_all(F.col(column), F.lit(p), F.lit(0)), _tagged(k)) for k, p in ENTITIES.items()]
    return df.select(key, F.inline(F.concat(*parts)))


def _tagged(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value"))


def term_counts(df: DataFrame, key: str, column: str, longest: int = 3) -> DataFrame:
    """key, term, tf over stopword-free words and their n-grams."""
    words = F.filter(tokens(F.col(column)), lambda w: ~w.isin(*STOPWORDS))
    made = df.select(F.col(key).alias("key"), words.alias("w"))
    grams = F.concat(*[ngrams(F.col("w"), n) for n in range(1, longest + 1)])
    return made.select("key", F.explode(grams).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))


def tfidf(df: DataFrame, key: str, column: str, top: int = 10, longest: int = 1) -> DataFrame:
    """The best terms of each text by tf * (ln((N + 1) / (df + 1)) + 1)."""
    counts = term_counts(df, key, column, longest)
    n = df.count()
    weights = counts.groupBy("term").agg((F.ln(F.lit(n + 1.0) / (F.count("*") + 1)) + 1).alias("idf"))
    scored = counts.join(weights, "term").withColumn("score", F.col("tf") * F.col("idf"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "term"))).where(F.col("rank") <= top).select("key", "term", "tf", "score", "rank")


def frequent_terms(df: DataFrame, column: str, top: int = 20, longest: int = 1) -> DataFrame:
    return term_counts(df.withColumn("_k", F.lit(0)), "_k", column, longest).select("term", "tf").orderBy(F.desc("tf"), "term").limit(top)


def position_keywords(df: DataFrame, key: str, column: str, top: int = 10, shortest: int = 3) -> DataFrame:
    """freq * (1 + half of how early the word first stands)."""
    words = F.filter(tokens(F.col(column)), lambda w: ~w.isin(*STOPWORDS) & (F.char_length(w) >= shortest))
    long = df.select(F.col(key).alias("key"), F.size(words).alias("n"), F.posexplode(words).alias("pos", "word"))
    scored = long.groupBy("key", "word").agg((F.count("*") * (1 + 0.5 * (1 - F.min("pos") / F.max("n")))).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "word"))).where(F.col("rank") <= top)


def yake_keywords(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """Frequency times one minus the mean relative position."""
    words = F.filter(tokens(F.col(column)), lambda w: ~w.isin(*STOPWORDS))
    long = df.select(F.size(words).alias("n"), F.posexplode(words).alias("pos", "term"))
    return long.groupBy("term").agg((F.count("*") * (1 - F.avg(F.col("pos") / F.col("n")))).alias("score")).orderBy(F.desc("score"), "term").limit(top)


def rake_keywords(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """Phrases between stopwords; a word scores (degree + frequency) / frequency, a phrase the sum of its words."""
    stops = r"(?i)\b(?:" + "|".join(STOPWORDS) + r")\b|[^\w\s]"
    phrases = df.select(F.explode(F.split(F.lower(F.col(column)), stops)).alias("p")).select(F.trim(F.regexp_replace("p", r"\s+", " ")).alias("phrase")).where("phrase != ''").select("phrase", F.split("phrase", " ").alias("w"))
    words = phrases.select(F.explode("w").alias("word"), (F.size("w") - 1).alias("deg")).groupBy("word").agg(((F.sum("deg") + F.count("*")) / F.count("*")).alias("s"))
    distinct = phrases.dropDuplicates(["phrase"])
    return distinct.select("phrase", F.explode("w").alias("word")).join(words, "word").groupBy("phrase").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "phrase").limit(top)


def textrank(df: DataFrame, column: str, top: int = 20, window: int = 4, rounds: int = 30, damping: float = 0.85, every: int = 10) -> DataFrame:
    """Ranks over the graph of words within ``window`` of each other; each round is a join and an aggregate over its edges, and
    every ``every`` rounds the lineage is cut by a checkpoint where a checkpoint folder is set."""
    words = F.filter(tokens(F.col(column)), lambda w: ~w.isin(*STOPWORDS))
    near = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda i: F.transform(F.slice(F.col("w"), i + 1, window - 1), lambda v: F.struct(F.get("w", i - 1).alias("a"), v.alias("b")))))
    pairs = df.select(words.alias("w")).where(F.size("w") > 1).select(F.inline(near)).where("a != b")
    edges = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a", "b").agg(F.count("*").cast("double").alias("weight"))
    edges = edges.join(edges.groupBy("a").agg(F.sum("weight").alias("out")), "a").select("a", "b", (F.col("weight") / F.col("out")).alias("share")).cache()
    ranks = edges.select(F.col("a").alias("word")).distinct().withColumn("rank", F.lit(1.0))
    for i in range(1, rounds + 1):
        flow = edges.join(ranks, F.col("a") == F.col("word")).groupBy("b").agg(F.sum(F.col("share") * F.col("rank")).alias("in"))
        ranks = flow.select(F.col("b").alias("word"), ((1 - damping) + damping * F.col("in")).alias("rank"))
        if i % every == 0 and df.sparkSession.sparkContext.getCheckpointDir():
            ranks = ranks.checkpoint()
    return ranks.orderBy(F.desc("rank"), "word").limit(top)


def summarize(df: DataFrame, key: str, column: str, sentences: int = 3) -> DataFrame:
    """The sentences whose words are most frequent in the text on average, in their order."""
    parts = F.filter(F.split(F.col(column), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    long = df.select(F.col(key).alias("key"), F.posexplode(parts).alias("pos", "sentence")).withColumn("w", F.filter(tokens(F.col("sentence")), lambda w: ~w.isin(*STOPWORDS)))
    freq = long.select("key", F.explode("w").alias("word")).groupBy("key", "word").count()
    scored = long.select("key", "pos", "sentence", F.size("w").alias("n"), F.explode_outer("w").alias("word")).join(freq, ["key", "word"], "left").groupBy("key", "pos", "sentence").agg(F.coalesce(F.try_divide(F.sum("count"), F.max("n")), F.lit(0.0)).alias("score"))
    best = scored.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "pos"))).where(F.col("rn") <= sentences)
    return best.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("summary"))


def chunks(df: DataFrame, key: str, column: str, size: int = 800, overlap: int = 120) -> DataFrame:
    """Overlapping runs of words: key, chunk_index, start (word), text, token_count and a hash of the text."""
    words = split_words(F.col(column))
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size("w") - overlap) / step).cast("int") - 1, F.lit(0)))
    made = df.select(F.col(key).alias("key"), words.alias("w")).where(F.size("w") > 0).select("key", "w", F.explode(starts).alias("chunk_index"))
    part = F.slice("w", F.col("chunk_index") * step + 1, size)
    return made.select("key", "chunk_index", (F.col("chunk_index") * step).alias("start"), F.array_join(part, " ").alias("text"), F.size(part).alias("token_count")).withColumn("hash", F.left(F.sha2("text", 256), F.lit(16)))


def ocr_artifacts(c: Column) -> Column:
    """More than one in twenty words looks like a scanning error."""
    odd = F.size(F.regexp_extract_all(c, F.lit(r"[|]{2,}|[^\x00-\x7F]{3,}|\b\w*\d[a-z]\d\w*\b|(?:\b\w\b ){4,}"), F.lit(0)))
    return F.coalesce(F.try_divide(odd, F.size(split_words(c))), F.lit(0.0)) > 0.05


def text_features(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    upper = F.char_length(c) - F.char_length(F.regexp_replace(c, "[A-Z]", ""))
    return df.withColumns({f"{column}_length": F.char_length(c), f"{column}_words": F.size(split_words(c)), f"{column}_has_digits": c.rlike("[0-9]"), f"{column}_upper_ratio": F.coalesce(F.try_divide(upper, F.char_length(c)), F.lit(0.0))})


def porter_stem(word: str) -> str:
    """Suffix stripping in the order plural, past and progressive, final y, and the commonest derivations."""
    def vowels(x: str) -> bool:
        return any(c in "aeiouy" for c in x)

    def measure(x: str) -> int:
        shape = "".join("v" if c in "aeiou" or (c == "y" and i and x[i - 1] not in "aeiou") else "c" for i, c in enumerate(x))
        return sum(a == "v" and b == "c" for a, b in zip(shape, shape[1:]))

    if len(word) < 3:
        return word
    for old, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(old):
            word = word[: len(word) - len(old)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and vowels(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "lsz":
                    word = word[:-1]
                break
    if word.endswith("y") and vowels(word[:-1]):
        word = word[:-1] + "i"
    for old, new in (("ational", "ate"), ("tional", "tion"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("ement", ""), ("ness", ""), ("ment", ""), ("ful", ""), ("able", ""), ("ible", "")):
        if word.endswith(old) and measure(word[: len(word) - len(old)]) > (0 if new else 1):
            return word[: len(word) - len(old)] + new
    return word


def stem(c: Column) -> Column:
    import pandas as pd

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        out = []
        for t in texts:
            out.append(None if t is None else " ".join(known.setdefault(w, porter_stem(w)) for w in t.lower().split()))
        return pd.Series(out, dtype=object)

    return run(c)
