"""Mixing sources to target weights with soft membership, in DataFrame operations only.

A softmax classifier over the presence of hashed words and word endings, fitted on a bounded sample of the labelled table,
gives each document a posterior over domains; features that a chi-square test does not tell from chance weigh nothing. How
far the weights are trusted is chosen by the log loss of labelled rows that were held out, so posteriors are as soft as the
labels ask for. Document rates r >= 0 are then fitted so that the expected tokens of each domain, the sum of rate * tokens *
posterior, match targets: least squares over the residuals by projected gradient. A step is one aggregation to as many
numbers as there are domains and pairs of them; residuals are weighted by the inverse second moments of the posteriors of
rows whose rate is above zero, which makes a step of size 1 the right one. A document's rate follows from its posterior
and the steps so far, so nothing is shuffled and no state is kept by document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import shared

#: Hashed features: whole words, then their last three characters.
WORDS, ENDINGS = 1 << 15, 1 << 12
BUCKETS = WORDS + ENDINGS
#: A feature counts if its chi-square over the domains is above this, and it is in so many labelled texts at least.
CHI_SQUARE, LEAST = 15.0, 5
#: What the weights may be multiplied by; the held-out rows choose.
TRUST = [1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 1.0, 3 / 2]


def domain_of_labels() -> Column:
    """toxic before quality: the domains of a table with columns quality and toxic."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _features(words: Column) -> Column:
    """The distinct buckets of words and of their endings."""
    whole = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(WORDS)).cast("int"))
    ends = F.transform(words, lambda w: F.pmod(F.xxhash64(F.substring(w, -3, 3), F.lit(3)), F.lit(ENDINGS)).cast("int") + F.lit(WORDS))
    return F.concat(F.array_distinct(whole), F.array_distinct(ends))


def _with_features(df: DataFrame) -> tuple[DataFrame, str, str]:
    """df with two more columns: the buckets of its text's words, and how many words it has."""
    words, buckets, n = shared.free(df, "words", "buckets", "n_tokens")
    df = df.withColumn(words, F.filter(F.split(_text(), r"\s+"), lambda w: w != ""))
    return df.withColumn(buckets, _features(F.col(words))).withColumn(n, F.size(words).cast("long")).drop(words), buckets, n


@dataclass
class Classifier:
    """Log prior and log weights (BUCKETS by domains), and what the weights are multiplied by."""

    prior: np.ndarray
    weights: np.ndarray
    trust: float = TRUST[0]

    def sums(self, buckets: Column) -> list[Column]:
        """For each domain, the sum of a text's weights; 0 for a text without any."""

        def total(w: np.ndarray) -> Column:
            table = F.split(F.lit(",".join(f"{x:.6g}" for x in w)), ",").cast("array<double>")  # folded to one literal
            return F.aggregate(buckets, F.lit(0.0), lambda s, b: s + F.get(table, b))

        return [total(w) for w in self.weights.T]

    def posterior(self, sums: list[Column], trust: float | None = None) -> Column:
        """array<double> that sums to 1."""
        z = F.array(*[F.lit(float(p)) + x * F.lit(trust or self.trust) for p, x in zip(self.prior, sums)])
        e = lambda z: F.transform(z, lambda x: F.exp(x - F.array_max(z)))
        share = lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))
        once = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
        return once(z, lambda z: once(e(z), share))


def telling(seen: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which features count, from how many rows of each domain have them (seen) and there are (rows)."""
    n = seen.sum(axis=1, keepdims=True)
    expected = n * rows / max(1.0, rows.sum())
    chi = ((seen - expected) ** 2 / np.maximum(expected, 1e-12)).sum(axis=1)
    return (chi > CHI_SQUARE) & (n[:, 0] >= LEAST)


def fit_softmax(found: list[list[int]], y: np.ndarray, prior: np.ndarray, steps: int = 120, rate: float = 0.1, decay: float = 2e-3) -> np.ndarray:
    """Weights (BUCKETS by domains) of the features found in each row, by Adam on the log loss with a square penalty.

    The log prior is the intercept, so a text without a telling feature has the labels' shares.
    """
    k = len(prior)
    used, at = np.unique(np.fromiter((b for x in found for b in x), np.int64), return_inverse=True)
    row = np.repeat(np.arange(len(found)), [len(x) for x in found])
    w, m, v = np.zeros((len(used), k)), np.zeros((len(used), k)), np.zeros((len(used), k))
    for t in range(1, steps + 1 if len(used) else 1):
        z = prior + np.stack([np.bincount(row, w[at, c], len(found)) for c in range(k)], axis=1)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        off = (e / e.sum(axis=1, keepdims=True) - np.eye(k)[y]) / len(found)
        g = np.stack([np.bincount(at, off[row, c], len(used)) for c in range(k)], axis=1) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    out = np.zeros((BUCKETS, k))
    out[used] = w
    return out


def train(docs: DataFrame, labels: DataFrame, domains: list[str], sample: int = 6000, seed: int = 5) -> Classifier:
    """Fit on sample labelled ids at most; a quarter of them choose the trust before all of them give the weights.

    labels: doc_id, domain; other domains are ignored, and of several labels of an id the first by name counts. A table
    without labels gives uniform posteriors.
    """
    k = len(domains)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "domain").where(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    all_of = [F.sum((F.col("domain") == d).cast("long")).alias(f"n{i}") for i, d in enumerate(domains)]
    shares = known.agg(*all_of).first()
    share = np.array([float(shares[f"n{i}"] or 0) + 1 for i in range(k)])
    prior = np.log(share / share.sum())
    # ids drawn by hash: sample of them at most, so they can be sent to every task
    drawn = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text().alias("text")).join(F.broadcast(drawn), "doc_id")
    rows, buckets, n = _with_features(learn)
    rows = rows.where(F.col(n) > 0).select("domain", (F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(4)) == 0).alias("held"), F.col(buckets).alias("buckets"))
    rows = shared.save(rows, "mixing-labelled")
    array = lambda r, c: np.array([float(r[f"{c}{i}"] or 0) for i in range(k)])
    seen = np.zeros((BUCKETS, k))
    for r in rows.select("domain", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(*all_of).collect():  # BUCKETS rows at most
        seen[r["bucket"]] = array(r, "n")
    good = telling(seen, array(rows.agg(*all_of).first(), "n"))
    marks = F.split(F.lit(",".join("1" if x else "0" for x in good)), ",").cast("array<int>")
    found = rows.select("domain", "held", F.filter("buckets", lambda b: F.get(marks, b) == 1).alias("found")).collect()  # sample rows at most
    shared.drop(rows)
    y = np.array([domains.index(r["domain"]) for r in found], np.int64)
    held = np.array([r["held"] for r in found], bool)
    own = [r["found"] for r in found]
    trust = TRUST[0]
    if held.any() and not held.all():
        trial = fit_softmax([x for x, h in zip(own, held) if not h], y[~held], prior)
        z = np.array([trial[x].sum(axis=0) for x, h in zip(own, held) if h])

        def loss(t: float) -> float:
            p = prior + t * z
            p = p - p.max(axis=1, keepdims=True)
            return float((np.log(np.exp(p).sum(axis=1)) - p[np.arange(len(p)), y[held]]).sum())

        trust = min(TRUST, key=loss)
    return Classifier(prior, fit_softmax(own, y, prior), trust)


def _soft(docs: DataFrame, model: Classifier) -> tuple[DataFrame, str, str]:
    """docs with the columns n_tokens and p (under these or longer names)."""
    rows, buckets, n = _with_features(docs)
    s, p = shared.free(rows, "weight_sums", "p")
    rows = rows.withColumn(s, F.array(*model.sums(F.col(buckets)))).drop(buckets)
    return rows.withColumn(p, model.posterior([F.col(s)[i] for i in range(len(model.prior))])).drop(s), n, p


def fit_rates(soft: DataFrame, weights: list[float], total_tokens: float | None = None, steps: int = 60, tolerance: float = 1e-4) -> tuple[Column, dict]:
    """The rate of each row as a column over n_tokens and p, and a report (targets, reached, steps, miss).

    weights: target share of each domain. total_tokens: of the mixture; by default the total at which the domain with
    the largest target keeps the tokens that it has. Targets that no rates reach (a domain without tokens) leave the
    least weighted residual; miss is the largest residual as a share of the mixture, and tells that from a good fit.
    Rows without tokens have rate 1.
    """
    k = len(weights)
    p, n = [F.col("p")[i] for i in range(k)], F.col("n_tokens").cast("double")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def totals(rate: Column) -> tuple[np.ndarray, np.ndarray, float]:
        """Expected tokens by domain, second moments of the posteriors where the rate is above zero, and all tokens."""
        own = F.when(F.col("r") > 0, n).otherwise(F.lit(0.0))
        got = soft.select("n_tokens", "p", rate.alias("r")).agg(F.sum(n).alias("n"), *[F.sum(F.col("r") * n * p[i]).alias(f"a{i}") for i in range(k)], *[F.sum(own * p[i] * p[j]).alias(f"m{i}_{j}") for i, j in pairs]).first()
        moments = np.zeros((k, k))
        for i, j in pairs:
            moments[i, j] = moments[j, i] = float(got[f"m{i}_{j}"] or 0)
        return np.array([float(got[f"a{i}"] or 0) for i in range(k)]), moments, float(got["n"] or 0)

    rate = F.lit(1.0)
    reached, moments, tokens = totals(rate)
    if not tokens:
        return rate, {"targets": [0.0] * k, "reached": [0.0] * k, "steps": 0, "miss": 0.0}
    share = np.array(weights) / sum(weights)
    main = int(np.argmax(share))
    whole = total_tokens or float(reached[main] / share[main])
    target, size, step = share * whole, 1.0, 0
    miss = lambda x: float(np.abs(x - target).max() / whole)
    while step < steps and miss(reached) > tolerance and size > 1e-3:
        move = size * (np.linalg.inv(moments / tokens + 1e-9 * np.eye(k)) @ ((reached - target) / tokens))
        trial = F.greatest(F.lit(0.0), rate - sum((p[i] * F.lit(float(move[i])) for i in range(1, k)), p[0] * F.lit(float(move[0]))))
        got, active, _ = totals(trial)
        step += 1
        if np.linalg.norm(got - target) < np.linalg.norm(reached - target):
            rate, reached, moments, size = trial, got, active, min(1.0, 2 * size)
        else:  # too many rates met zero on the way: a shorter step
            size /= 4
    return F.when(F.col("n_tokens") > 0, rate).otherwise(F.lit(1.0)), {"targets": target.tolist(), "reached": reached.tolist(), "steps": step, "miss": miss(reached)}


def _copies(rate: Column, key: Column, digest: Column, seed: int) -> Column:
    """The rate rounded up or down by a hash of id and text, so that its expectation is the rate."""
    u = F.pmod(F.xxhash64(key, digest, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("int")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], total_tokens: float | None = None, seed: int = 9, **options) -> DataFrame:
    """(doc_id, digest, n_tokens, p, rate, copies, miss) for each row of docs, whatever else its columns are called.

    p: posteriors in the order of the targets; a text without a word has the labels' shares and rate 1. n_tokens counts
    words, and a null text has none; digest is xxhash64 of the text. miss is the fit's largest residual as a share of the
    mixture: above its tolerance of 1e-4 no rates were found that meet the targets. Repeated rows have equal rates and
    copies, null ids are ids. An empty table gives an empty one.
    """
    model = train(docs, labels, list(targets), **options)
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text().alias("text")).withColumn("digest", F.xxhash64("text"))
    soft = shared.save(_soft(table, model)[0].drop("text"), "posteriors")
    rate, report = fit_rates(soft, list(targets.values()), total_tokens)
    return soft.withColumn("rate", rate).withColumn("copies", _copies(F.col("rate"), F.col("doc_id"), F.col("digest"), seed)).withColumn("miss", F.lit(report["miss"]))


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float], total_tokens: float | None = None, seed: int = 9, **options) -> DataFrame:
    """docs, each row as often as its copies say (see mixed); the posteriors are made twice, so that no text is shuffled.

    Columns of docs are untouched, whatever they are called. An empty table gives an empty one.
    """
    model = train(docs, labels, list(targets), **options)
    narrow = docs.select("text")
    soft = shared.save(_soft(narrow, model)[0].drop("text"), "posteriors")
    rate, _ = fit_rates(soft, list(targets.values()), total_tokens)
    shared.drop(soft)
    rows, n, p = _soft(docs, model)
    # the number keeps the optimizer from copying the posterior's expression to each place that names it
    inner = rows.select(F.struct(*docs.columns).alias("row"), F.col(n).alias("n_tokens"), F.col(p).alias("p"), F.monotonically_increasing_id().alias("at"))
    inner = inner.select("row", "at", rate.alias("rate"), F.rand(seed).alias("any"))
    copies = _copies(F.col("rate"), F.col("row.doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit(""))), seed)
    many = F.when((F.col("at") >= 0) & (F.col("any") >= 0), copies).otherwise(F.lit(0))
    return inner.select("row", F.explode(F.array_repeat(F.lit(0), many)).alias("copy")).select("row.*")
