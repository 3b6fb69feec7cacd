"""Expense categories: keyword baseline, text features, trained model, pair router."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    HashingTF, IDF, NGram, Normalizer, RegexTokenizer, StringIndexer, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..functions.dates import is_weekend
from ..functions.text import fold

# Keywords of each category, in tie order.
KEYWORDS = {
    "market": ("market", "bakkal", "gida", "super", "migros", "sok", "carrefour", "a101", "bim", "sut", "ekmek"),
    "ulasim": ("taksi", "metro", "ulasim", "otobus", "tren", "havabus", "otopark", "yol", "uber"),
    "yemek": ("yemek", "restoran", "lokanta", "cafe", "kahve", "burger", "pizza", "doner", "firin"),
    "akaryakit": ("akaryakit", "benzin", "motorin", "petrol", "opet", "shell", "bp", "aytemiz"),
    "konaklama": ("otel", "hotel", "konaklama", "pansiyon", "airbnb"),
    "ofis": ("ofis", "kirtasiye", "kalem", "defter", "printer", "toner", "yazici", "bilgisayar"),
    "saglik": ("saglik", "eczane", "hastane", "klinik", "ilac", "muayene"),
    "egitim": ("egitim", "kurs", "okul", "universite", "kitap", "udemy"),
    "abonelik": ("abonelik", "subscription", "netflix", "spotify", "hosting", "saas", "domain", "cloud"),
    "kargo": ("kargo", "kurye", "cargo", "ptt", "aras", "mng", "yurtici", "ups"),
    "vergi_harc": ("vergi", "harc", "noter", "belediye", "damga"),
}


def keyword_category(rows: DataFrame, *texts: str) -> DataFrame:
    """Category with the most keyword hits, ties in dictionary order."""
    haystack = fold(F.concat_ws(" ", *texts))
    hits = F.array(*[
        F.struct(
            sum((F.contains("__hay", F.lit(w)).cast("int") for w in words), F.lit(0)).alias("hits"),
            F.lit(-i).alias("order"), F.lit(name).alias("category"),
        )
        for i, (name, words) in enumerate(KEYWORDS.items())
    ])
    scored = rows.withColumn("__hay", haystack).withColumn("__best", F.array_max(hits))
    n = F.col("__best.hits")
    return scored.withColumns({
        "category": F.when(n > 0, F.col("__best.category")).otherwise("diger"),
        "hits": n,
        "confidence": F.when(n > 0, F.round(F.least(F.lit(0.95), F.lit(0.48) + n * 0.14), 6)).otherwise(0.25),
    }).drop("__hay", "__best")


def category_features(sample: DataFrame) -> DataFrame:
    """One text per expense: words, payment, amount bucket and weekend marker."""
    bucket = F.when(F.col("amount_minor") >= 100_000, "amount_high").otherwise("amount_normal")
    day = F.when(is_weekend("occurred_at"), "weekend").otherwise("weekday")
    text = F.concat_ws(" ", F.coalesce("merchant_name", F.lit("")), F.coalesce("description", F.lit("")),
                       F.coalesce("payment_method_name", F.lit("")), bucket, day)
    return sample.withColumn("features_text", text)


def held_out(sample: DataFrame, folds: int = 5, fold: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows that teach and rows that are scored, dealt by a hash of the id: no row is on both sides."""
    own = F.pmod(F.xxhash64("id"), F.lit(folds)) == fold
    return sample.where(~own), sample.where(own)


def category_train(sample: DataFrame, label: str = "category_id", dimensions: int = 1 << 16, iterations: int = 400):
    """TF-IDF over words and word pairs, class-balanced logistic regression."""
    rows = sample.where(F.col(label).isNotNull())
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    size = counts.agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__k")).withColumn("__one", F.lit(1))
    # One row per class, joined back as a weight.
    weights = counts.withColumn("__one", F.lit(1)).join(size, "__one").select(
        label, (F.col("__all") / (F.col("__k") * F.col("__n"))).alias("class_weight"))
    weighted = rows.join(weights, label)
    stages = [
        StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip"),
        RegexTokenizer(inputCol="features_text", outputCol="w1", pattern=r"[^\p{L}\p{N}_]+"),
        NGram(inputCol="w1", outputCol="w2", n=2),
        # hashed counts: no word is left out and no vocabulary is gathered
        HashingTF(inputCol="w1", outputCol="c1", numFeatures=dimensions),
        HashingTF(inputCol="w2", outputCol="c2", numFeatures=dimensions),
        VectorAssembler(inputCols=["c1", "c2"], outputCol="c"),
        IDF(inputCol="c", outputCol="t"),
        Normalizer(inputCol="t", outputCol="features"),
        LogisticRegression(weightCol="class_weight", maxIter=iterations, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(weighted)


def category_score(model, sample: DataFrame, label: str = "category_id", n: int = 5) -> DataFrame:
    """Best category and the ``n`` most probable ones of each row."""
    labels = model.stages[0].labels
    names = F.array(*[F.lit(x) for x in labels])
    stages = model.stages[1:]
    scored = sample
    for stage in stages:
        scored = stage.transform(scored)
    pairs = F.zip_with(vector_to_array("probability"), names, lambda p, c: F.struct(p.alias("probability"), c.alias("category")))
    ranked = F.slice(F.sort_array(pairs, asc=False), 1, n)
    return scored.select("id", label, ranked.alias("candidates")).withColumn("predicted", F.get("candidates", F.lit(0))["category"])


def router_report(scored: DataFrame, threshold: float) -> DataFrame:
    """Errors of champion, challenger and the routed mix at one threshold."""
    chosen = F.col("probability") >= threshold
    mixed = F.when(chosen, F.col("challenger_cer")).otherwise(F.col("champion_cer"))
    return scored.agg(
        F.count(F.lit(1)).alias("samples"), F.count_distinct("doc_id").alias("documents"), F.count_if(chosen).alias("selected"),
        F.count_if(chosen & (F.col("challenger_cer") + 0.02 < F.col("champion_cer"))).alias("wins"),
        F.count_if(chosen & (F.col("champion_cer") + 0.02 < F.col("challenger_cer"))).alias("regressions"),
        F.round(F.avg("champion_cer"), 6).alias("champion_cer"), F.round(F.avg("challenger_cer"), 6).alias("challenger_cer"),
        F.round(F.avg(mixed), 6).alias("composed_cer"),
    )
