"""Quality classification with hierarchical empirical Bayes over sites.

1. A logistic classifier reads each text. It is fitted on a bounded sample of labelled
   documents; its odds over the sample's base rate are the document's own evidence.
2. Grouped aggregation over all documents gives each host, and each path within a host,
   the sum of the classifier's probabilities.
3. How much hosts differ from the whole, and paths from their host, beyond what chance
   explains, sets the strength of two Beta priors (method of moments). A host's rate is
   drawn to the global rate, a path's to its host's: sparse sites nearly take the prior.
4. A document's posterior joins its evidence with its path's rate, from which its own
   part is taken out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import small_batches, written

SAMPLE = 20_000  # labelled documents that the classifier is fitted on, at most
BROADCAST_SITES = 100_000  # more paths than that are joined by a shuffle
LIMIT = 12.0  # of evidence, in log odds


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


UPPER, LOWER, DIGIT = _mask(bytes(range(65, 91))), _mask(bytes(range(97, 123))), _mask(bytes(range(48, 58)))
MARKS = _mask(bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'-"))
HIGH = np.r_[np.zeros(128), np.ones(128)]
NAMES = ("size", "upper", "digit", "mark", "exclaim", "stop", "word_length", "distinct_words", "top_word", "repeated_lines", "high")


def features(text: str | None) -> np.ndarray:
    """Shares and sizes of the whole text; zeros if it has no words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    found = raw.lower().split()
    if not found:
        return np.zeros(len(NAMES))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters, n = counts @ (UPPER + LOWER + HIGH) + 1, len(raw)
    words: dict[bytes, int] = {}
    for w in found:
        words[w] = words.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return np.array([
        np.log1p(len(found)), counts @ UPPER / letters, counts @ DIGIT / n, counts @ MARKS / n, counts[33] / len(found), counts[46] / len(found),
        (n - len(found)) / len(found) / 10, np.log(len(words)) / np.log(len(found) + 1), max(words.values()) / len(found), 1 - len(set(lines)) / len(lines), counts @ HIGH / n,
    ])


class Classifier:
    """Standardised features and their squares, weighted; plain numbers that travel with the task."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray, base: float):
        self.mean, self.scale, self.weight, self.base = mean, scale, weight, base

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, z * z, np.ones((len(z), 1))])

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> Classifier:
        """Newton's method on the ridge-penalised likelihood. Without both classes, the evidence is nil."""
        rate = (y.sum() + 1) / (len(y) + 2)
        made = cls(x.mean(axis=0) if len(x) else np.zeros(len(NAMES)), (x.std(axis=0) + 1e-6) if len(x) else np.ones(len(NAMES)), np.zeros(2 * len(NAMES) + 1), float(np.log(rate / (1 - rate))))
        made.weight[-1] = made.base
        if 0 < y.sum() < len(y):
            a = made._design(x)
            for _ in range(rounds):
                p = 1 / (1 + np.exp(-np.clip(a @ made.weight, -30, 30)))
                gradient = a.T @ (y - p) - ridge * np.r_[made.weight[:-1], 0]
                curvature = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(a.shape[1])
                step = np.linalg.solve(curvature, gradient)
                made.weight = made.weight + step
                if np.abs(step).max() < 1e-6:
                    break
        return made

    def evidence(self, texts) -> np.ndarray:
        """Log odds of good quality over the base rate."""
        x = np.array([features(t) for t in texts]).reshape(-1, len(NAMES))
        return np.clip(self._design(x) @ self.weight - self.base, -LIMIT, LIMIT)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Classifier:
    """Fitted on the labelled documents with the smallest hashes of their ids, sample at most."""
    small_batches(docs.sparkSession)
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).groupBy(id_col).agg(F.max(text_col).alias("text"), F.max("_label").alias("label"))

    def measured(frames):
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "x": [features(t) for t in frame["text"]], "y": frame["label"].astype(float)})

    found = rows.select(F.col(id_col).cast("string").alias("id"), "text", "label").mapInPandas(measured, "id string, x array<double>, y double").toPandas().sort_values("id")
    x = np.stack(found["x"].to_numpy()) if len(found) else np.zeros((0, len(NAMES)))
    return Classifier.fit(x, found["y"].to_numpy(np.float64))


def _evidence(model: Classifier):
    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        return pd.Series(model.evidence(texts))

    return evidence


def _logit(p):
    return F.log(p / (1 - p))


def _chance(model: Classifier, evidence):
    return 1 / (1 + F.exp(-(evidence + F.lit(model.base))))


def site_rates(scored: DataFrame, model: Classifier) -> tuple[DataFrame, dict[str, float]]:
    """host, path, n, good, host_rate for each path, and the priors: rate, host_strength, path_strength.

    scored: host, path, evidence. Counts cover every row.
    """
    p = _chance(model, F.col("evidence"))
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("good"), F.sum(p * p).alias("squares")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    total = paths.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("good").alias("good"), F.sum("squares").alias("squares")).first()
    n, rate = total["n"], ((total["good"] or 0) + 1) / (total["n"] + 2)
    noise = max(1e-9, (total["squares"] or 0) / max(1, n) - rate * rate)  # of one document's probability

    def strength(groups: int, spread: float) -> float:
        between = max(spread - noise * groups / max(1, n), 1e-6)
        return float(np.clip(rate * (1 - rate) / between - 1, 1.0, 1e6))

    hs = hosts.agg(F.count("*").alias("k"), F.coalesce(F.sum(F.col("host_n") * F.pow(F.col("host_good") / F.col("host_n") - rate, 2)), F.lit(0.0)).alias("s")).first()
    host_strength = strength(hs["k"], hs["s"] / max(1, n))
    joined = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"])
    ps = joined.agg(F.count("*").alias("k"), F.coalesce(F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("host_good") / F.col("host_n"), 2)), F.lit(0.0)).alias("s")).first()
    path_strength = strength(max(0, ps["k"] - hs["k"]), ps["s"] / max(1, n))
    out = joined.select("host", "path", "n", "good", "host_n", "host_good")
    return out, {"rate": rate, "host_strength": host_strength, "path_strength": path_strength}


def _judged(rows: DataFrame, model: Classifier, threshold: float) -> DataFrame:
    """rows (own, host, path, evidence) with p_document, p_site, p_quality and kept."""
    rates, prior = site_rates(rows, model)
    sites = rates.select(*[F.col(c).alias(f"site_{c}") for c in rates.columns])
    if sites.count() <= BROADCAST_SITES:
        sites = F.broadcast(sites)
    joined = rows.join(sites, F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path")))
    p, k0, k1 = _chance(model, F.col("evidence")), prior["host_strength"], prior["path_strength"]
    host_rate = (F.col("site_host_good") - p + k0 * prior["rate"]) / (F.col("site_host_n") - 1 + k0)
    path_rate = (F.col("site_good") - p + k1 * host_rate) / (F.col("site_n") - 1 + k1)
    path_rate = F.least(F.greatest(path_rate, F.lit(1e-6)), F.lit(1 - 1e-6))
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + _logit(path_rate))))
    return joined.select("own", p.alias("p_document"), path_rate.alias("p_site"), posterior.alias("p_quality"), (posterior >= threshold).alias("kept"))


def _scored(docs: DataFrame, carried: list[str], model: Classifier, text_col: str, host_col: str, path_col: str) -> DataFrame:
    """own (the carried columns in a struct, apart from what is added), host, path, evidence; written, so that each text is read once."""
    own = F.struct(*[F.col(f"`{c}`") for c in carried]).alias("own")
    rows = docs.select(own, F.col(f"`{host_col}`").alias("host"), F.col(f"`{path_col}`").alias("path"), _evidence(model)(F.col(f"`{text_col}`")).alias("evidence"))
    return written(rows, "evidence")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: id_col, p_document, p_site, p_quality, kept.

    p_document is the classifier's probability, p_site the rate of the document's site
    without itself, p_quality the posterior; kept says that it reaches the threshold.
    Null or blank texts have all features zero. Null hosts or paths form a site of their
    own. Rows that repeat each get a row. Without usable labels the evidence is nil and
    p_document is one half. An empty table gives an empty result. Other columns are ignored.
    """
    model = train(docs, labels, id_col, text_col, sample=sample)
    out = _judged(_scored(docs, [id_col], model, text_col, host_col, path_col), model, threshold)
    return out.select(F.col("own").getField(id_col).alias(id_col), "p_document", "p_site", "p_quality", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that classify() keeps, with all their columns, whatever their names.

    Nulls, repeated rows and empty tables are as classify() has them.
    """
    model = train(docs, labels, id_col, text_col, sample=sample)
    out = _judged(_scored(docs, docs.columns, model, text_col, host_col, path_col), model, threshold).where("kept")
    return out.select(*[F.col("own").getField(c).alias(c) for c in docs.columns])
