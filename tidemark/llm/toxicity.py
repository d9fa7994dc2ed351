"""Toxicity by weak supervision.

Voters look at a text's words: fixed lexicons of insults in four languages, of contempt, threats and courtesy, patterns
(shouting, attacks on a person, repeated marks, commands to go away, numbers), and lexicons induced from the training
labels (whole words, and stems of 4 to 7 characters seen once, twice, three times, or twice and in one of a hundred
words, that stand out in toxic documents). A voter fires (1) or abstains (0); some fire for toxic, some for clean texts.
A generative label model holds, for each class, each voter's firing rate (its accuracy, whichever class it speaks for)
and a common covariance of the votes (their correlations), estimated by expectation maximization on the votes
alone once the induced lexicons are chosen; correlated voters thereby share their weight. Its posteriors are the
soft labels on which a logistic regression over the presence of words and stems is trained; that linear classifier scores.

The label model and the classifier are fitted on a bounded sample of labelled rows: `most_rows` of the training
labels, those with the smallest md5 of the id (of rows that repeat the last id, those with the smallest md5 of the text). Word statistics that choose the lexicons cover all training labels.

Edge cases: null and empty texts get the intercept's score; labels that are null are left out, and repeated labels
of a document count once (the largest); without any training label of both classes every score is 0; repeated
documents are scored alike; an empty table gives no rows; only the text is an input of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import written

# Words of the fixed voters.
LEXICONS = {
    "insults": "idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown clowns dumb fool fools imbecile garbage filth vermin",
    "insults de": "idiot idioten dumm dummkopf trottel abschaum versager widerlich ekelhaft müll dreck",
    "insults fr": "idiot idiots imbécile imbéciles stupide crétin crétins ordure minable pathétique dégoûtant",
    "insults es": "idiota idiotas imbécil imbéciles estúpido estúpida basura escoria patético asqueroso",
    "contempt": "hate despise detest ridiculous useless shame ashamed hasse verachte déteste méprise odio desprecio",
    "threats": "kill die hurt destroy punish burn töten sterben tuer mourir matar morir",
    "courtesy": "please thanks thank welcome sorry bitte danke merci pardon gracias favor",
}
LEXICONS = {name: frozenset(words.split()) for name, words in LEXICONS.items()}
PERSON = frozenset("you your yours yourself du dein ihr toi vous votre tu usted".split())
AWAY = re.compile(r"\b(?:shut up|go away|get out|get lost|halt den mund|verschwinde|ferme[- ]la|dégage|cállate|lárgate)\b", re.IGNORECASE)
MARKS = re.compile(r"[!?]{2,}")
STEMS = (4, 5, 6, 7)
TOKEN = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.7


def held_out(doc_id: Column, of: int, rest: int = 1) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of)) == rest


def traits(word: str) -> list[str]:
    """A word and its stems (marked by a dash)."""
    return [word] + [word[:n] + "-" for n in STEMS if len(word) >= n]


def grades(trait: str, n: int, words: int) -> list[str]:
    """The features of a trait that n of a text's words have."""
    if n < 2 or trait[-1] != "-":
        return [trait]
    out = [trait, trait + "2"]
    if n > 2:
        out.append(trait + "3")
    if n * 100 >= words:
        out.append(trait + "%")
    return out


def features(text: str | None, of: Callable[[str], Iterable[str]] = traits) -> set[str]:
    """All features of a text. of: which traits of a word are looked at."""
    words = TOKEN.findall((text or "").lower())
    counts: Counter[str] = Counter()
    for word in words:
        for trait in of(word):
            counts[trait] += 1
    return {f for t, n in counts.items() for f in grades(t, n, len(words))}


def evidence(counts: DataFrame, n_toxic: int, n_clean: int, most: int, least_docs: int) -> list[str]:
    """The features with the largest log-likelihood ratio among those commoner in toxic documents (at most `most`)."""
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    p = (a + b) / (n_toxic + n_clean)
    term = lambda x, q: F.when(x > 0, x * F.log(x / q)).otherwise(0.0)
    gain = term(a, p * n_toxic) + term(b, p * n_clean)
    rows = counts.where((a + b >= least_docs) & (a * n_clean > 4 * b * n_toxic)).withColumn("gain", gain)
    return [r.feature for r in rows.orderBy(F.col("gain").desc(), "feature").limit(most).collect()]


PATTERNS = ("shouting", "attack on a person", "repeated marks", "sent away", "numbers")


def vote_names(induced: list[str]) -> list[str]:
    return [*LEXICONS, *PATTERNS, *induced]


def votes(text: str | None, found: set[str], induced: list[str]) -> list[float]:
    """1 for each voter that fires, in the order of vote_names."""
    text = text or ""
    capitals, letters = sum(map(str.isupper, text)), sum(map(str.isalpha, text))
    listed = [not found.isdisjoint(words) for words in LEXICONS.values()]
    attack = not found.isdisjoint(PERSON) and any(listed[:5])  # insults or contempt, of a person spoken to
    patterns = [text.count("!") >= 3 and capitals * 2 > letters, attack, bool(MARKS.search(text)), bool(AWAY.search(text)), sum(map(str.isdigit, text)) * 20 > len(text)]
    return [float(x) for x in (*listed, *patterns)] + [float(f in found) for f in induced]


def label_model(v: np.ndarray, start: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Posterior of toxic for each row of votes, from firing rates by class and the votes' covariance."""
    post, (n, m) = start.clip(0.02, 0.98), v.shape
    for _ in range(rounds):
        w1, w0 = post.sum() + 1e-9, (1 - post).sum() + 1e-9
        rate1, rate0 = (post @ v + 0.5) / (w1 + 1), ((1 - post) @ v + 0.05) / (w0 + 1)
        d1, d0 = v - rate1, v - rate0
        cov = ((d1 * post[:, None]).T @ d1 + (d0 * (1 - post)[:, None]).T @ d0) / n
        cov += np.eye(m) * (0.02 * np.trace(cov) / m + 1e-4)  # shrinkage keeps it invertible
        weight = np.linalg.solve(cov, rate1 - rate0)
        bias = -0.5 * (rate1 + rate0) @ weight + np.log((w1 + 1) / (w0 + 1))
        new = 1 / (1 + np.exp(-np.clip(v @ weight + bias, -30, 30)))
        done, post = np.abs(new - post).max() < 1e-4, new
        if done:
            break
    return post


def logistic(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, width: int, decay: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept on 0/1 features given as (row, column) pairs: full-batch Adam with weight decay."""
    w, b, n = np.zeros(width), 0.0, len(y)
    m, s = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        z = np.bincount(rows, w[cols], n) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        grad = np.append(np.bincount(cols, g[rows], width) + decay * w / max(1, width) ** 0.5, g.sum())
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, fold: int = 3, most_rows: int = 20_000, most_voters: int = 256, most_features: int = 2048, least_docs: int = 3) -> tuple[dict[str, float], float] | None:
    """Weights by feature and the intercept, from labels outside the held-out fold."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"), fold)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # the fold's texts leave before the join; labels may be many, so the join is a sort-merge join at every size
    texts = docs.where(~held_out(F.col("doc_id"), fold)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(known.hint("merge"), "doc_id")

    seen = written(rows)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "found": [sorted(features(t)) for t in batch["text"]]})

    n_toxic, n_clean = seen.agg(F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1)), F.lit(0)), F.coalesce(F.sum(F.when(F.col("toxic") != 1, 1)), F.lit(0))).first()
    if not n_toxic or not n_clean:
        return None
    one = F.when(F.col("toxic") == 1, 1).otherwise(0)
    spread_out = seen.select("toxic", "text").mapInPandas(spread, "toxic int, found array<string>")
    counts = spread_out.select(one.alias("y"), F.explode("found").alias("feature")).groupBy("feature").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    chosen = evidence(counts, n_toxic, n_clean, most_features, least_docs)
    induced = chosen[:most_voters]
    width, at = len(chosen), {f: i for i, f in enumerate(chosen)}

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [features(t) for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "votes": [np.array(votes(t, f, induced), "u1").tobytes() for t, f in zip(batch["text"], found, strict=True)], "columns": [sorted(at[x] for x in f if x in at) for f in found]})

    place = F.md5(F.col("doc_id").cast("string"))
    last, n_last = seen.select(place.alias("place")).orderBy("place").limit(most_rows).groupBy("place").count().orderBy(F.col("place").desc()).first()
    at_last = seen.where(place == last).orderBy(F.md5("text")).limit(n_last)
    sample = seen.where(place < last).unionByName(at_last).mapInPandas(narrow, "toxic int, votes binary, columns array<int>").toPandas()
    v = np.frombuffer(b"".join(sample["votes"]), "u1").reshape(len(sample), -1).astype(float)
    gold = (sample["toxic"].to_numpy() == 1).astype(float)
    # accuracies start from the labels; from there on the votes alone decide
    posterior = label_model(v, np.where(v.any(1), 0.25 + 0.5 * gold, 0.02))
    sizes = [len(x) for x in sample["columns"]]
    pairs = np.concatenate([np.asarray(x, int) for x in sample["columns"]]) if sum(sizes) else np.zeros(0, int)
    weights, bias = logistic(np.repeat(np.arange(len(sizes)), sizes), pairs, posterior, width)
    return {f: float(weights[i]) for f, i in at.items() if weights[i]}, bias


def score_documents(docs: DataFrame, labels: DataFrame, fold: int = 3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(docs, labels, fold)
    weights, bias = model or ({}, -np.inf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        watched = {f.rstrip("23%") if "-" in f else f for f in weights}
        known: dict[str, tuple[str, ...]] = {}

        def of(word: str) -> tuple[str, ...]:
            """The traits of a word that carry weight."""
            own = known.get(word)
            if own is None:
                if len(known) > 300_000:
                    known.clear()
                own = known[word] = tuple(t for t in traits(word) if t in watched)
            return own

        for batch in batches:
            scores = []
            for text in batch.column(1).to_pylist():
                z = bias + sum(weights.get(f, 0.0) for f in sorted(features(text, of)))
                scores.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))) if model else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id"), fold), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
