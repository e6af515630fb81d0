"""Mixing to target weights by soft domain membership, in DataFrame functions only.

A naive-Bayes classifier over hashed words, fitted on the labels table, gives each document posterior probabilities of
the domains. A document's expected tokens of a domain are its tokens times the posterior. Nonnegative document
rates x are fitted by projected-gradient least squares, so that the domains' totals of rate * expected tokens meet the targets:
minimise |A'x - target|^2 in the metric of the domains' Gram matrix M = sum(tokens * p p') over the rows with x > 0, by
x <- max(0, x - p . M^-1 (A'x - target)), from x = 1 (in this metric the curvature is 1; a step that gains little is halved). Only the residuals, one number for each
domain, and their Gram matrix come to the driver in a round; a row's x is recomputed from them, so no state is stored.

Domains (fixed by the labels table): toxic for toxic = 1, else low for quality = 0 and good for quality = 1. A target is the
wanted multiple of the domain's present expected tokens. copies is the rate rounded at random by a hash of the
row's key: its expectation is the rate, and a rate of 1 or more never drops a row.

max_labelled bounds the labelled rows for the classifier (chosen by a hash of doc_id); all other sums run over all rows.

Defined cases: null or empty text has 0 tokens, the prior's posterior, and rate from its posterior alone; without labels all
domains are equally probable; a doc_id that is labelled repeatedly counts each time; repeated rows have equal rates; an
empty table gives an empty result; columns named like the results are replaced.
"""

import json
import logging
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table

DOMAINS = ("toxic", "low", "good")
#: Wanted multiple of each domain's expected tokens: good is raised enough that its documents are never thinned out.
TARGETS = {"toxic": 0.02, "low": 0.6, "good": 1.25}
BUCKETS, MAX_LABELLED, ROUNDS, TOLERANCE, PRIOR = 1 << 15, 20_000, 60, 1e-2, 1_000.0


def hashed_words(text: Column) -> Column:
    """Buckets of the words of a lower-cased text: runs of letters, and runs of other signs."""
    spaced = F.regexp_replace(F.lower(text), r"([^\p{L}\s]+)", " $1 ")
    return F.transform(F.filter(F.split(spaced, r"\s+"), lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def constant(values: list[list[float]]) -> Column:
    """A constant array of arrays of doubles (folded to one literal)."""
    return F.from_json(F.lit(json.dumps(values)), "array<array<double>>")


def domain(labels: DataFrame) -> Column:
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[list[float], list[list[float]]]:
    """Log priors, and a log-likelihood of each domain for each bucket (BUCKETS x domains)."""
    given = labels.select("doc_id", domain(labels).alias("d")).dropna()
    part = min(1.0, max_labelled / max(given.count(), 1))
    some = given.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20)))
    text = F.coalesce("text", F.lit(""))
    known = docs.join(F.broadcast(some), "doc_id")  # max_labelled pairs of numbers
    rows = known.select("d", F.explode(F.array_distinct(hashed_words(text))).alias("w")).groupBy("d", "w").count().collect()  # BUCKETS x domains at most
    n = {r.d: r["count"] for r in known.groupBy("d").count().collect()}
    total = sum(n.values())
    counts = [[0.0] * len(DOMAINS) for _ in range(BUCKETS)]
    for r in rows:
        counts[r.w][r.d] = float(r["count"])
    size = [sum(c[d] for c in counts) for d in range(len(DOMAINS))]
    likelihood = []
    for c in counts:
        share = (sum(c) + 0.5) / (sum(size) + 0.5 * BUCKETS)
        # PRIOR words of the general mix are added to each domain
        likelihood.append([round(math.log((x + PRIOR * share) / (size[d] + PRIOR) / share), 3) for d, x in enumerate(c)])
    return [math.log((n.get(d, 0) + 1) / (total + len(DOMAINS))) for d in range(len(DOMAINS))], likelihood


def posteriors(docs: DataFrame, model: tuple, text: str = "text") -> DataFrame:
    """docs with tokens and the posterior p of each domain.

    The log-likelihoods of a document's distinct buckets are summed and divided by the fourth root of their number:
    words of a text aren't independent, and undamped sums would make every posterior 0 or 1.
    """
    prior, likelihood = model
    size = len(DOMAINS)
    by_domain = constant([[row[d] for row in likelihood] for d in range(size)])
    words = hashed_words(F.coalesce(F.col(text), F.lit("")))
    docs = docs.drop("tokens", "p").withColumn("__w", words)
    docs = docs.withColumns({"tokens": F.size("__w").cast("long"), "__w": F.array_distinct("__w")})
    damp = F.pow(F.greatest(F.size("__w"), F.lit(1)).cast("double"), F.lit(0.25))

    def summed(d: int) -> Column:
        return F.aggregate("__w", F.lit(0.0), lambda s, w: s + F.get(F.get(by_domain, F.lit(d)), w))

    docs = docs.withColumn("__s", F.array(*(summed(d) / damp + prior[d] for d in range(size))))
    docs = docs.withColumn("__e", F.transform("__s", lambda s: F.exp(s - F.array_max("__s"))))
    total = F.aggregate("__e", F.lit(0.0), lambda a, x: a + x)
    return docs.withColumn("p", F.transform("__e", lambda e: e / total)).drop("__w", "__s", "__e")


def inverse(m: list[list[float]]) -> list[list[float]]:
    """Of a small symmetric matrix, with a ridge in case a domain is absent."""
    a = np.array(m)
    return np.linalg.inv(a + np.eye(len(a)) * (1e-9 * np.trace(a) + 1e-12)).tolist()


def rate_of(steps: list[list[float]]) -> Column:
    """x after the given steps in the domains' coordinates."""
    if not steps:
        return F.lit(1.0)

    def dot(s: Column) -> Column:
        out = F.get("p", F.lit(0)) * F.get(s, F.lit(0))
        for d in range(1, len(DOMAINS)):
            out = out + F.get("p", F.lit(d)) * F.get(s, F.lit(d))
        return out

    return F.aggregate(constant(steps), F.lit(1.0), lambda x, s: F.greatest(F.lit(0.0), x - dot(s)))


def fit_rates(rows: DataFrame, targets: list[float]) -> tuple[list[list[float]], list[float]]:
    """Steps that lead to the rates, and each domain's gap there, as a share of its own target; rows has tokens and p. One aggregation a round, over all rows.

    Ends when every domain is within TOLERANCE of its own target, or after ROUNDS, with a warning that names the gaps. The best steps count.
    """
    size = len(DOMAINS)
    p = [F.get("p", F.lit(d)) for d in range(size)]
    wanted, steps, last, pace, best = None, [], None, 1.0, None
    for _ in range(ROUNDS):
        x = rate_of(steps)
        active = F.when(x > 0, F.col("tokens")).otherwise(0)
        now = rows.withColumns({"x": x, "active": active}).agg(
            *(F.sum(F.col("active") * p[a] * p[b]).alias(f"m{a}{b}") for a in range(size) for b in range(size)),
            *(F.sum(F.col("x") * F.col("tokens") * p[d]).alias(f"t{d}") for d in range(size)),
        ).first()
        if now["t0"] is None:
            return [], [0.0] * size
        wanted = wanted or [now[f"t{d}"] * targets[d] for d in range(size)]
        gap = [now[f"t{d}"] - wanted[d] for d in range(size)]
        share = [gap[d] / max(wanted[d], 1e-9) for d in range(size)]
        missed = sum(map(abs, gap))
        if best is None or missed < best[0]:
            best = missed, list(steps), share
        if max(map(abs, share)) <= TOLERANCE:
            break
        pace = 1.0 if last is None or missed < 0.9 * last else max(0.1, pace / 2)
        last = missed
        solve = inverse([[now[f"m{a}{b}"] for b in range(size)] for a in range(size)])
        steps.append([pace * sum(solve[a][b] * gap[b] for b in range(size)) for a in range(size)])
    if max(map(abs, best[2])) > TOLERANCE:
        logging.getLogger(__name__).warning("targets out of reach: %s", ", ".join(f"{n} {100 * g:+.1f} %" for n, g in zip(DOMAINS, best[2], strict=True)))
    return best[1], best[2]


def mix_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, key: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """docs (or only some of its columns) with tokens, p (array of posteriors in the order of DOMAINS), rate, copies, and gaps: how far each domain's expected tokens end from its target, as a share of it (the same for all rows)."""
    scratch, targets = Scratch(docs.sparkSession), targets or TARGETS
    kept = [c for c in columns or docs.columns if c.lower() not in ("tokens", "p", "rate", "copies", "gaps")]
    # stored once: rates read the posteriors many times
    known = scratch.save(posteriors(docs, train(docs, labels)).select(*kept, "tokens", "p"), "posteriors")
    steps, gaps = fit_rates(known.select("tokens", "p"), [targets[d] for d in DOMAINS])
    uniform = F.pmod(F.xxhash64(F.col(key), F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return known.withColumn("rate", rate_of(steps)).withColumns({"copies": F.floor(F.col("rate") + uniform).cast("int"), "gaps": F.array(*map(F.lit, gaps))})


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=["doc_id"])
    return mixed.select("doc_id", "tokens", *(F.get("p", F.lit(d)).alias(f"p_{n}") for d, n in enumerate(DOMAINS)), "rate", "copies", *(F.get("gaps", F.lit(d)).alias(f"gap_{n}") for d, n in enumerate(DOMAINS)))


QUERIES = {"op2_soft_mixing": op2_mixing}
ORACLE: dict[str, str] = {}
