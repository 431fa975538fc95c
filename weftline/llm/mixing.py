"""Mixing sources to target weights: soft membership and distributed projected-gradient least squares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.hashing import text_words
from weftline.llm.tokens import RANKS, counter, has_content
from weftline.session import Scratch

BITS = 14
BUCKETS = 1 << BITS
FIT_DOCS = 100_000  # most labelled documents that the domain classifier is fitted on, taken by hash
LABEL_NOISE = 0.02  # share of labels that may name another domain than the one a document is of
STEPS = 64  # memberships are multiples of 1 / STEPS, so that documents of one membership are fitted as one
ITERATIONS = 40
MAX_SOURCES = 64
FINE = 4096
ROUNDING_PASSES = 6


def fit_domains(docs: DataFrame, domains: list[str], fit_docs: int = FIT_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Naive Bayes over hashed words from the labelled table: (log weights [domain, bucket], log priors).

    The last row is every other label. At most ``fit_docs`` labelled documents are used; the sums
    that come to the driver are at most domains x 16,384 numbers.
    """
    labelled = docs.filter(F.col("source").isNotNull())
    n = labelled.count()
    at = {s: i for i, s in enumerate(domains)}
    if n > fit_docs:
        labelled = labelled.filter(F.shiftrightunsigned(F.xxhash64("doc_id"), 12) < int((1 << 52) * fit_docs / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(at) + 1, BUCKETS))
        for b in batches:
            own = np.array([at.get(s, len(at)) for s in b.column(0).to_pylist()], int)
            doc, f = text_words(b.column(1).to_pylist(), BITS)  # presence: long documents do not drown the others
            for d in np.unique(own):
                sums[d] += np.bincount(f[own[doc] == d], minlength=BUCKETS)
        d, k = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(sums[d, k])], names=["d", "k", "n"])

    rows = labelled.select("source", "text").mapInArrow(run, "d int, k int, n double").groupBy("d", "k").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(domains) + 1, BUCKETS))
    counts[rows["d"].to_numpy(int), rows["k"].to_numpy(int)] = rows["n"].to_numpy(float)
    totals = counts.sum(1, keepdims=True)
    w = np.log((counts + 0.1) / (totals + 0.1 * BUCKETS))
    prior = np.log((totals[:, 0] + 1) / (totals.sum() + len(domains) + 1))
    return w - w.mean(0), prior


def posteriors(texts: list[str], weights: np.ndarray, priors: np.ndarray) -> np.ndarray:
    """P(domain | text) of each text; the evidence of its words, which depend on each other, is damped."""
    doc, f = text_words(texts, BITS)
    n = np.bincount(doc, minlength=len(texts))
    z = np.zeros((len(texts), len(weights)))
    if len(doc):
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        z[doc[first]] = np.add.reduceat(np.ascontiguousarray(weights.T)[f], first, axis=0)
    z = z / np.maximum(1.0, np.sqrt(n))[:, None] + priors
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def memberships(docs: DataFrame, domains: list[str], weights: np.ndarray, priors: np.ndarray, ranks: str, noise: float) -> DataFrame:
    """doc_id, source, domain (index of the label, or of the likeliest domain without one; -1 unwanted), tokens, m.

    ``m`` is P(domain | text, label) in steps of 1 / ``STEPS``, none of the wanted domains last: the
    classifier's posterior times the chance of the label, which is 1 - ``noise`` in its own domain and
    spread evenly over the labels elsewhere. A document without a label has the posterior alone.
    """
    with open(ranks, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    model = docs.sparkSession.sparkContext.broadcast((weights, priors))
    at, k = {s: i for i, s in enumerate(domains)}, len(domains) + 1
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, (w, prior) = counter(raw.value), model.value
        for b in batches:
            texts, sources = b.column(2).to_pylist(), b.column(1).to_pylist()
            p, told = posteriors(texts, w, prior), np.array([-1 if s is None else at.get(s, k - 1) for s in sources], int)
            known = np.flatnonzero(told >= 0)
            likely = np.full((len(known), k), noise / k)
            likely[np.arange(len(known)), told[known]] = 1 - noise
            p[known] *= likely
            p /= p.sum(1, keepdims=True)
            m = np.floor(p * STEPS)
            m[np.arange(len(m)), p.argmax(1)] += STEPS - m.sum(1)
            dom = np.where(told >= 0, told, p.argmax(1))
            dom[dom == k - 1] = -1
            cols = [b.column(0), b.column(1), pa.array(dom.astype(np.int32)), pa.array([count(t) for t in texts], pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(m.astype(np.int32).ravel()), k).cast(pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "source", "domain", "tokens", "m"])

    return docs.select("doc_id", "source", "text").mapInArrow(run, f"doc_id {ids}, source string, domain int, tokens int, m array<int>")


def _rates(m: np.ndarray, dom: np.ndarray, caps: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the given steps from 1: r <- clip(r - m g, 0, cap); unwanted documents stay at 0."""
    cap = np.where(dom >= 0, caps[dom], 0.0)
    r = np.minimum(cap, 1.0)
    for g in steps:
        r = np.clip(r - m[:, :-1] @ g, 0.0, cap)
    return r


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dom, tok = b.column("domain").to_numpy(zero_copy_only=False), b.column("tokens").to_numpy(zero_copy_only=False)
    m = b.column("m").flatten().to_numpy(zero_copy_only=False).reshape(len(dom), -1)
    return dom, tok.astype(float), m / STEPS


def expected_totals(members: DataFrame, k: int, caps: np.ndarray, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected tokens of each domain at the present rates, and the mass that could still come to it or leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((3, k))
        for b in batches:
            dom, tok, m = _columns(b)
            r, cap = _rates(m, dom, caps, steps), np.where(dom >= 0, caps[dom], 0.0)
            out += np.stack([(x * tok) @ m[:, :-1] for x in (r, (r < cap).astype(float), (r > 0).astype(float))])
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), *map(pa.array, out)], names=["s", "e", "up", "down"])

    sums = members.select("domain", "tokens", "m").mapInArrow(run, "s int, e double, up double, down double").groupBy("s").agg(*[F.sum(x).alias(x) for x in ("e", "up", "down")]).toPandas().set_index("s").reindex(range(k)).fillna(0.0)
    return sums["e"].to_numpy(), sums["up"].to_numpy(), sums["down"].to_numpy()


def fit_rates(members: DataFrame, want: np.ndarray, caps: np.ndarray, iterations: int = ITERATIONS, tolerance: float = 1e-5) -> list[np.ndarray]:
    """Projected gradient for min sum_s (E_s - want_s)^2, E_s = sum_d rate_d tokens_d m_ds, 0 <= rate <= cap.

    The gradient of a document is its membership times one number a domain, so an iteration is one
    pass that sends a vector of sums to the driver; the rates themselves are never gathered, but
    follow from the steps. Steps are scaled by the mass that can still move in each domain. Ends at
    the tolerance, where a round gains less than a thousandth, or after ``iterations``; the gap that
    is left is told by ``mix``.
    """
    k, before = len(want), np.inf
    steps: list[np.ndarray] = []
    for _ in range(iterations):
        e, up, down = expected_totals(members, k, caps, steps)
        gap = e - want
        miss = float((gap**2).sum())
        if np.abs(gap).max() <= tolerance * max(1.0, want.sum()) or miss > 0.998 * before:
            break
        before = miss
        free = np.where(gap < 0, up, down)
        steps.append(np.divide(gap, free, out=np.zeros(k), where=free > 0))
    return steps


def mix(documents: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, ranks: str = RANKS, label_noise: float = LABEL_NOISE, fit_docs: int = FIT_DOCS) -> tuple[DataFrame, DataFrame]:
    """(chosen: doc_id, source, domain, tokens, repeats, rate; shares: one row a source of ``targets`` or ``documents``).

    Documents with content and a wanted source (or, with null source, a wanted predicted domain)
    take part; a source that is not in ``targets`` or has no share is never chosen; one of
    ``targets`` without documents gets share 0 and the others keep their proportions. Without
    ``total_tokens`` the mix is as large as the caps allow with all proportions kept. More than 64
    target sources are refused: vectors of that length go through the fit.

    1. A classifier fitted on the labelled table gives every document's domain posteriors.
    2. Projected gradient fits rates whose expected domain totals match the targets. They alone say
       how much of a document is taken: documents of one source get rates of their own.
    3. Rates are rounded, source by source to their own total: whole repeats, then one more for
       documents in an order by hash and fraction until it is reached (two histograms of 4,096
       steps find the place, so no group is gathered or sorted). No document gets more than its
       source's max_repeats.

    ``shares`` tells expected shares (by membership) and actual ones (by source, after rounding),
    and the gap of each to the share that is wanted of the sources that have documents.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "p9")
    rows = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    wanted = sorted((r for r in rows if (r.share or 0) > 0 and (r.most or 0) > 0), key=lambda r: r.source)
    domains = [r.source for r in wanted]
    share, caps = np.array([r.share for r in wanted], float), np.array([r.most for r in wanted], float)

    docs = documents.select("doc_id", "source", "text").filter(has_content("text"))
    weights, priors = fit_domains(docs, domains, fit_docs)
    members = scratch.write(memberships(docs, domains, weights, priors, ranks, label_noise), "members")
    have = np.zeros(len(domains))
    for r in members.filter("domain >= 0").groupBy("domain").agg(F.sum("tokens").alias("t")).collect():
        have[r.domain] = r.t
    there = have > 0
    total = float((have * caps / share)[there].min()) if there.any() else 0.0
    if total_tokens is not None:
        total = min(total, total_tokens / max(share[there].sum(), 1e-12))
    want = np.where(there, share * total, 0.0)
    # documents of one source and membership have one rate: the fit runs over these, however many documents there are
    shapes = scratch.write(members.filter("domain >= 0").groupBy("domain", "m").agg(F.sum("tokens").alias("tokens")), "shapes")
    steps = fit_rates(shapes, want, caps) if len(domains) else []
    expected = expected_totals(shapes, len(domains), caps, steps)[0] if len(domains) else np.zeros(0)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dom, _, m = _columns(b)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(_rates(m, dom, caps, steps))], names=["doc_id", "source", "domain", "tokens", "rate"])

    ids = documents.schema["doc_id"].dataType.simpleString()
    fitted = members.filter("domain >= 0").mapInArrow(rated, f"doc_id {ids}, source string, domain int, tokens int, rate double") if len(domains) else members.filter("false").selectExpr("doc_id", "source", "domain", "tokens", "0D AS rate")
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)) if xs else F.array().cast("array<double>"), F.col("domain"))
    f = fitted.withColumn("cap", pick([float(x) for x in caps])).withColumn("base", F.floor(F.col("rate") + 1e-9).cast("int"))
    frac = F.greatest(F.lit(1e-9), F.col("rate") - F.col("base"))
    u = F.shiftrightunsigned(F.xxhash64("doc_id"), 12) / F.lit(float(1 << 52))
    v = u / frac
    f = f.withColumn("v", v / (1 + v)).withColumn("open", (F.col("base") < F.col("cap")) & (F.col("rate") > F.col("base") + 1e-9))
    f = f.withColumn("b1", F.floor(F.col("v") * FINE).cast("int")).withColumn("b2", F.floor((F.col("v") * FINE - F.floor(F.col("v") * FINE)) * FINE).cast("int"))
    f, extra = scratch.write(f, "order"), F.lit(False)
    need, due = [0.0] * len(domains), [0.0] * len(domains)
    for r in f.groupBy("domain").agg(F.sum(F.col("rate") * F.col("tokens")).alias("t"), F.sum(F.col("base") * F.col("tokens")).alias("b")).collect():
        need[r.domain], due[r.domain] = max(0.0, float(r.t - r.b)), float(r.t)
    for _ in range(ROUNDING_PASSES):  # later passes fill what a long document at the cut left over
        if not any(x > 1e-4 * w for x, w in zip(need, due)):
            break
        able = F.col("open") & ~extra & (F.col("tokens") <= pick(need))
        cut1 = {i: _cut(h, need[i]) for i, h in _histogram(f.filter(able), "b1").items()}
        c1 = pick([float(cut1.get(i, (0, 0))[0]) for i in range(len(domains))])
        cut2 = {i: _cut(h, cut1[i][1]) for i, h in _histogram(f.filter(able & (F.col("b1") == c1)), "b2").items()}
        c2 = pick([float(cut2.get(i, (0, 0))[0]) for i in range(len(domains))])
        extra = extra | (able & ((F.col("b1") < c1) | ((F.col("b1") == c1) & (F.col("b2") < c2))))
        need = [cut2[i][1] if i in cut2 else cut1[i][1] if i in cut1 else x for i, x in enumerate(need)]
    chosen = f.select("doc_id", "source", pick_name(domains).alias("domain"), "tokens", (F.col("base") + extra.cast("int")).cast("int").alias("repeats"), "rate").filter("repeats > 0")

    tgt = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    named = F.when(F.col("domain") >= 0, pick_name(domains)).otherwise(F.coalesce("source", F.lit("(none)")))
    avail = members.groupBy(named.alias("source")).agg(F.count(F.lit(1)).alias("available_documents"), F.sum("tokens").alias("available_tokens"))
    used = chosen.groupBy(F.col("domain").alias("source")).agg(F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"), F.sum(F.col("tokens").cast("long") * F.col("repeats")).alias("token_count"))
    shares = tgt.join(avail, "source", "full").join(used, "source", "left")
    whole = used.agg(F.sum("token_count").alias("_all"))
    zero = {c: 0 for c in ("available_documents", "available_tokens", "documents", "most_repeats", "token_count")}
    shares = shares.fillna(zero).withColumn("_all", F.lit(whole.first()[0] or 0))
    shares = shares.withColumn("actual_share", F.when(F.col("_all") > 0, F.col("token_count") / F.col("_all")).otherwise(F.lit(0.0))).drop("_all")
    part = lambda x: [float(y) / max(1e-12, float(x.sum())) for y in x]
    told = spark.createDataFrame(list(zip(domains, part(want), part(expected))), "source string, wanted_share double, expected_share double")
    shares = shares.join(F.broadcast(told), "source", "left").fillna(0.0, ["wanted_share", "expected_share"])
    shares = shares.withColumns({"expected_gap": F.col("expected_share") - F.col("wanted_share"), "actual_gap": F.col("actual_share") - F.col("wanted_share")})
    return chosen, shares


def pick_name(domains: list[str]):
    return F.get(F.array(*map(F.lit, domains)) if domains else F.array().cast("array<string>"), F.col("domain"))


def _histogram(df: DataFrame, col: str) -> dict[int, list[tuple[int, float]]]:
    """Tokens by domain and step, at most 64 x 4,097 numbers."""
    out: dict[int, list[tuple[int, float]]] = {}
    for r in df.groupBy("domain", col).agg(F.sum("tokens").alias("t")).collect():
        out.setdefault(r.domain, []).append((r[1], float(r.t)))
    return {k: sorted(h) for k, h in out.items()}


def _cut(hist: list[tuple[int, float]], need: float) -> tuple[int, float]:
    """First step that would pass the need, and what is still needed before it."""
    for step, t in hist:
        if t > need:
            return step, need
        need -= t
    return FINE + 1, need


def mixed_documents(documents: DataFrame, targets: DataFrame, **kw) -> DataFrame:
    return mix(documents, targets, **kw)[0]


def mixed_shares(documents: DataFrame, targets: DataFrame, **kw) -> DataFrame:
    return mix(documents, targets, **kw)[1]


def mix_checks(documents: DataFrame, targets: DataFrame, tolerance: float = 0.01, **kw) -> DataFrame:
    """A row a target source: documents used too often, documents of unwanted sources (told with every source), and whether its share is reached."""
    chosen, shares = mix(documents, targets, **kw)
    caps = targets.filter("source is not null").groupBy("source").agg(F.max("max_repeats").alias("max_repeats"))
    used = chosen.join(F.broadcast(caps.select(F.col("source").alias("domain"), "max_repeats")), "domain", "left")
    bad = used.groupBy(F.col("domain").alias("source")).agg(F.count_if(F.col("repeats") > F.col("max_repeats")).alias("over_cap_count"))
    lost = used.agg(F.count_if(F.col("max_repeats").isNull()).alias("unwanted_count"))
    out = shares.join(F.broadcast(caps.select("source")), "source", "left_semi").join(F.broadcast(bad), "source", "left").join(F.broadcast(lost))
    return out.select("source", F.coalesce("over_cap_count", F.lit(0)).alias("over_cap_count"), "unwanted_count", (F.abs("actual_gap") <= tolerance).alias("share_is_reached"))
