"""Text functions compute what they name once, and give what the plain rules give."""

import random

from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.functions import values as C
from cairn.operators import budget as B


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def plain(text):
    """Compression without tests that leave steps out, by the same expressions."""
    mark = "\u0000"
    masked = F.regexp_replace(text, C.PROTECTED, mark)
    for old, new in C.PHRASES:
        masked = F.regexp_replace(masked, f"(?iu){old}", new)
    short = F.create_map(*(F.lit(x) for pair in C.ABBREVIATIONS.items() for x in pair))
    key = lambda w: F.lower(X.bare(F.regexp_replace(w, mark, "\u00000\u0000")))
    shorten = lambda w: F.coalesce(F.concat(F.try_element_at(short, key(w)), F.regexp_extract(w, r"[^\p{IsAlphabetic}\p{N}]*$", 0)), w)
    kept = F.transform(F.filter(X.words(masked), lambda w: ~key(w).isin(*C.FILLERS, *C.ARTICLES)), shorten)
    pieces, literals = F.split(F.array_join(kept, " "), mark, -1), F.regexp_extract_all(text, F.lit(C.PROTECTED), F.lit(0))
    return F.array_join(F.zip_with(pieces, literals, lambda p, x: F.concat(F.coalesce(p, F.lit("")), F.coalesce(x, F.lit("")))), "")


def test_condense_scores_sentences_once(spark):
    df = spark.createDataFrame([("One and two. The three. With four and five. " * 9,)], "text string").select(B.condense(F.lit("the and"), "text", F.lit(10)).alias("t"))
    assert plan(df).count("(?<=[.!?") == 1  # sentences, however often they are named
    assert df.head()[0] == " ".join(["The three."] * 5)


def test_compression_finds_keys_once_and_leaves_nothing_out(spark):
    texts = [
        "The database, actually; in order to deploy (the) configuration!", "IN ORDER TO see src/a.rs and `the code` at https://x.y/the", "\u212aonfigurasi \u212a the\u00e9 \u00abthe\u00bb \u00e9the", "due to the \u017fact that, \u0130n order to",
        "plain.toml C:\\the\\x a.b .rs an.RS x.md", "a\u0000the \u0000 the`", "well-known REPOSITORY... the", "", "   ", "``` the ``` and the", "pada saat ini: Yang lain",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    rows = df.select("text", X.compress("text").alias("is"), plain(F.col("text")).alias("should")).collect()
    assert all(r["is"] == r["should"] for r in rows), [r for r in rows if r["is"] != r["should"]]
    assert plan(df.select(X.compress("text").alias("c"))).count("\u00000\u0000") == 1


def test_tags_and_entities_by_fewer_patterns(spark):
    dice = random.Random(11)
    parts = [*C.TECH_TERMS[:12], "Redis", "GO", "rest", "forest", "x9", "9", "é", "K8s", ".", "/", "(", ")", "_", "ß", "İstanbul", "word"]
    texts = [None, "", *("".join(dice.choice(parts) + dice.choice(["", " ", ",", "é"]) for _ in range(dice.randrange(9))) for _ in range(300))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    plain = F.slice(F.array_intersect(F.array(*map(F.lit, C.TECH_TERMS)), X.tokens("t")), 1, C.MAX_TAGS)
    assert rows.filter(~X.tags("t").eqNullSafe(F.when(F.col("t").isNull(), F.array().cast("array<string>")).otherwise(plain)) & F.col("t").isNotNull()).count() == 0
    edges = r"^[^\p{IsAlphabetic}\p{N}./]+|[^\p{IsAlphabetic}\p{N}./]+$"
    words = rows.select(F.explode(X.words("t")).alias("w")).withColumn("c", F.regexp_replace("w", edges, ""))
    entity = F.lower("c").isin(*C.TECH_TERMS) | F.rlike("c", F.lit(r"^\p{IsUppercase}|[0-9]"))
    assert words.filter(entity & ~F.rlike("w", F.lit(X._ENTITY))).count() == 0  # the filter loses none
    assert words.filter(~F.rlike("w", F.lit(X._ENTITY))).count() > 0
