"""Quality rules by distribution divergence, with DataFrame functions only.

A document's histogram over character classes and its histogram over the common words of its language are
compared with the language's reference, the pooled histograms of all of that language's documents that pass
the base rules. The comparison is the Jensen-Shannon distance (root of the divergence in bits, 0 to 1). Short
documents give unreliable histograms: a distance counts only from `least_words` words on.

How far a document can get by lacking common words depends on their share in the reference: without any of them it is
at 0.32 to 0.33 where they make up a fifth. `most_word` alone, the fixed limit of the SQL, is beyond that. `word_share`
adds a limit relative to this reach, where LEAST_EXPECTED common words or more are to be expected in the document.

Edge cases: null text has no words and fails the base rules; an unknown or null language has a reference of its
own (null is one language) and no common words, so that its word distance is 0; repeated rows are judged alike;
an empty table gives no rows; other columns of the input are carried by `judge` and ignored by the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import SPACE, written

# The most common function words of each language.
COMMON = {
    "en": "the of and to in a is that it for on was be with as this by at are from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas plus".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
# Character classes as Java patterns of all that is outside the class; white space, bytes beyond ASCII and the rest follow.
SYMBOLS = r"#*$%&|<>"
CLASSES = {"symbol": f"[^{SYMBOLS}]+", "upper": r"[^\p{Lu}]+", "digit": r"[^0-9]+"}
N_CLASSES = len(CLASSES) + 3
WINDOW = 8
#: Common words to be expected in a document (words times the reference's share) before their lack says something.
LEAST_EXPECTED = 5


def window_hashes(words: Column) -> Column:
    """A hash for each 8-word window, from hashes of 4 words (a column of its own)."""
    return F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2), F.get(words, i + 3)))


def paired(halves: Column) -> Column:
    starts = F.slice(halves, F.lit(1), F.greatest(F.size(halves) - (WINDOW - 1), F.lit(0)))
    return F.transform(starts, lambda h, i: F.xxhash64(h, F.get(halves, i + WINDOW // 2)))


def repeated_places(pairs: Column) -> Column:
    """Places of the windows found twice or more, from (hash, place) pairs sorted by hash.

    pairs must be a column of its own: inside a lambda an expression would be evaluated for each element.
    """
    same = lambda p, q: F.coalesce(q["h"] == p["h"], F.lit(False))
    hit = lambda p, k: same(p, F.get(pairs, k - 1)) | same(p, F.get(pairs, k + 1))
    marked = F.transform(pairs, lambda p, k: F.when(hit(p, k), p["i"]))
    return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))


def covered(places: Column) -> Column:
    """Words under the windows that start at these (sorted) places."""
    state = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda s, i: F.struct((i + WINDOW).alias("end"), (s["n"] + (i + WINDOW) - F.greatest(s["end"], i)).alias("n"))
    return F.aggregate(places, state, step, lambda s: s["n"])


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Counts of each document; one pass over its text."""
    text = F.coalesce("text", F.lit(""))
    parts = docs.select(*keep, F.col("lang").alias("_lang"), text.alias("_text"))
    parts = parts.withColumn("_words", F.array_remove(F.split("_text", SPACE + "+", -1), ""))
    parts = parts.withColumn("_halves", window_hashes(F.col("_words"))).withColumn("_windows", paired(F.col("_halves")))
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    parts = parts.withColumn("_pairs", F.when(some, pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    parts = parts.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    common = None
    for lang, listed in COMMON.items():
        array = F.array(*map(F.lit, listed))
        common = F.when(F.col("_lang") == lang, array) if common is None else common.when(F.col("_lang") == lang, array)
    parts = parts.withColumn("_common", F.coalesce(common, F.array().cast("array<string>")))
    listed = sorted({w for some in COMMON.values() for w in some})
    parts = parts.withColumn("_found", F.filter("_words", lambda w: w.isin(*listed)))
    chars = F.array(*[F.length(F.regexp_replace("_text", pattern, "")).cast("long") for pattern in CLASSES.values()])
    parts = parts.select(
        *keep,
        "_lang",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered(repeated_places(F.col("_pairs"))).cast("long").alias("n_repeat_words"),
        F.length("_text").cast("long").alias("_chars"),
        F.octet_length("_text").cast("long").alias("_bytes"),
        chars.alias("_classes"),
        F.transform("_common", lambda c: (F.size("_found") - F.size(F.array_remove("_found", c))).cast("long")).alias("_counts"),
    )
    total = F.aggregate("_counts", F.lit(0).cast("long"), lambda a, b: a + b)
    space, wide = F.col("_chars") - F.col("word_chars"), F.col("_bytes") - F.col("_chars")
    named = [F.col("_classes")[i] for i in range(len(CLASSES))]
    classes = F.array(*named, space, wide, F.greatest(F.lit(0).cast("long"), F.col("_chars") - space - sum(named[1:], named[0])))
    return parts.select(
        *keep,
        "_lang",
        "n_words",
        "word_chars",
        F.col("_classes")[list(CLASSES).index("symbol")].alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)).alias("base_failed"),
        classes.alias("_classes"),
        F.when(F.size("_counts") > 0, F.concat("_counts", F.array(F.col("n_words") - total))).otherwise(F.col("_counts")).alias("_counts"),
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays; 0 where either is null, empty or without counts."""
    zero = F.lit(0.0)
    total = lambda x: F.aggregate(x, zero, lambda a, b: a + b)
    share = lambda x: F.transform(x, lambda v: v / total(x))
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(zero)
    part = F.zip_with(share(p), share(q), lambda a, b: (term(a, (a + b) / 2) + term(b, (a + b) / 2)) / 2)
    usable = F.coalesce((total(p) > 0) & (total(q) > 0), F.lit(False))
    return F.when(usable, F.sqrt(F.greatest(zero, total(part)))).otherwise(zero)


def lacking(n_words: Column, reference: Column) -> Column:
    """The distance of a document without common words; null where it is short for the reference's share of them."""
    total = F.aggregate(reference, F.lit(0.0), lambda a, b: a + b)
    share = (total - F.element_at(reference, -1)) / total
    none = F.transform(reference, lambda x, i: F.when(i == F.size(reference) - 1, 1.0).otherwise(0.0))
    return F.when((F.size(reference) > 0) & (n_words * share >= LEAST_EXPECTED), distance(none, reference))


def judge(docs: DataFrame, keep: list[str], least_words: int = 50, most_char: float = 0.25, most_word: float = 0.5, word_share: float | None = None) -> DataFrame:
    """keep..., the counts, base_failed, char_distance, word_distance and kept.

    word_share: word distances above this share of that of a document without common words are rejected as well.
    """
    measured = written(features(docs, keep))
    width, words = N_CLASSES, max(map(len, COMMON.values())) + 1
    sums = lambda name, n: F.array(*[F.sum(F.get(name, F.lit(i))).cast("double") for i in range(n)])
    reference = (
        measured.where(~F.col("base_failed"))
        .groupBy("_lang")
        .agg(sums("_classes", width).alias("_ref_classes"), sums("_counts", words).alias("_ref_counts"))
        .withColumn("_ref_counts", F.filter("_ref_counts", lambda x: x.isNotNull()))
        .withColumnRenamed("_lang", "_ref_lang")
    )
    # One row for each language; Spark decides by its measured size whether it is broadcast.
    doubles = lambda name: F.transform(name, lambda x: x.cast("double"))
    joined = measured.join(reference, F.col("_lang").eqNullSafe(F.col("_ref_lang")), "left")
    judged = joined.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        distance(doubles("_classes"), F.col("_ref_classes")).alias("char_distance"),
        distance(doubles("_counts"), F.col("_ref_counts")).alias("word_distance"),
        *([] if word_share is None else [lacking(F.col("n_words"), F.col("_ref_counts")).alias("_reach")]),
    ).withColumn("kept", ~F.col("base_failed") & ((F.col("n_words") < least_words) | ((F.col("char_distance") <= most_char) & (F.col("word_distance") <= most_word))))
    if word_share is None:
        return judged
    far = (F.col("n_words") >= least_words) & (F.col("word_distance") > F.col("_reach") * word_share)
    return judged.withColumn("kept", F.col("kept") & ~F.coalesce(far, F.lit(False))).drop("_reach")
