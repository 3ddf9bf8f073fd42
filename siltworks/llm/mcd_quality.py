"""Quality rules: counts over whole texts, then robust multivariate outliers per language and source.

Base rules fail a document of under ``MIN_WORDS`` words, or of which over
``MAX_REPEAT_PERCENT`` percent of the words lie in 8-word windows that the text
holds twice or more.  The others' statistics are transformed and rounded to
multiples of 1/``STEP``; each (language, source) with ``MIN_GROUP`` documents or
more gets a minimum-covariance-determinant estimate of its own, the rest of a
language one together, and what is left of the corpus one together.  A group
that is still too small rejects nothing.

The estimate is by C-steps over all rows, no sample: from two starts (medians
with MADs, and plain moments) the ``COVER`` share of rows nearest by Mahalanobis
distance gives the next mean and covariance, until both stand still; the start
with the smaller determinant wins.  Rounded values make sums and quantiles
exact, so results don't depend on partitioning.  Each pass is one aggregation by
group with partial aggregates, so a group of any size is fine; per group only a
few dozen numbers are kept.  Variances have a floor per statistic, so that a
statistic that is constant in most documents doesn't reject the others.
A document is rejected when its squared distance, scaled so that the group's
median distance is at most that of the normal distribution, exceeds ``CUTOFF``.

Cases: a null text is empty and fails the base rules; null lang or source are
values like others; repeated rows are judged alike and all kept or all dropped;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, slices, window_hash

MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
MIN_GROUP, COVER, MAX_STEPS = 200, 0.75, 8
#: The 0.999 quantile of chi-squared with five degrees of freedom, and its median.
CUTOFF, MEDIAN = 20.515, 4.351
STEP = 64
#: Transformed statistics and the floors of their standard deviations, chosen on labelled documents: the last two
#: are 0 for most, and one repeated line or window of a clean document is a step of 1 to 2.
FEATURES = {
    "f_words": (lambda: F.log1p("n_words"), 0.5),
    "f_length": (lambda: F.log(F.col("word_chars") / F.col("n_words")) * 4, 0.5),
    "f_symbols": (lambda: F.sqrt(F.col("n_symbols") / F.col("word_chars")) * 8, 0.25),
    "f_lines": (lambda: F.sqrt(F.col("n_dup_lines") / F.col("n_lines")) * 4, 0.8),
    "f_repeat": (lambda: F.sqrt(F.col("n_repeat_words") / F.col("n_words")) * 4, 0.8),
}
NAMES = list(FEATURES)
P = len(NAMES)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[i]:first[i + 1]]``."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


def _repeated(h: np.ndarray, width: int = 8) -> int:
    w = window_hash(h, width)
    if len(w) < 2:
        return 0
    order = np.argsort(w)
    same = np.diff(w[order]) == 0
    if not same.any():
        return 0
    edge = np.zeros(len(h) + 1, np.int64)
    hit = np.zeros(len(w), bool)
    hit[order[:-1]] |= same
    hit[order[1:]] |= same
    at = np.flatnonzero(hit)
    edge[: len(w)] += hit
    np.subtract.at(edge, at + width, 1)
    return int((np.cumsum(edge) > 0).sum())


def _duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier one."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines), len(lines) - len(set(lines))


def statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of each text; those after ``n_words`` are over words as runs of ``[^\\x20\\x09-\\x0D]``."""
    w = Words(texts)
    n = np.diff(w.first)
    continuing = (w.raw & 0xC0) == 0x80
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    h = w.hashes()
    lines = [_duplicate_lines(t) for t in texts]
    return {
        "n_words": n,
        "word_chars": _sums(~(continuing | blank[w.raw]), w.offsets),
        "n_symbols": _sums(_SYMBOL[w.raw], w.offsets),
        "n_dup_lines": np.array([x[1] for x in lines], np.int64),
        "n_repeat_words": np.array([_repeated(h[a:b]) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)], np.int64),
        "n_lines": np.array([x[0] for x in lines], np.int64),
    }


def measure(docs: DataFrame, *carry: str) -> DataFrame:
    """The columns ``carry`` of ``docs``, and the counts of its texts as columns ``__<name>``."""
    own = list(carry)
    rows = docs.select(*(F.col(f"`{c}`") for c in own), F.col("text").cast("string").alias("__text"))
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [f"__{k} long" for k in _STATS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, texts in slices(b.column(b.num_columns - 1)):
                found = statistics(texts)
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(found[k], pa.int64()) for k in _STATS)], names=[*own, *(f"__{k}" for k in _STATS)])

    return rows.mapInArrow(run, ddl)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _group(lang: Column, source: Column) -> Column:
    return F.to_json(F.struct(lang.alias("l"), source.alias("s")))


def groups(sizes: DataFrame) -> DataFrame:
    """(lang, source, n) to (__own, __group): each with enough rows for itself, else its language's rest, else the rest."""
    lang = F.to_json(F.struct(F.col("lang").alias("l"), F.lit(True).alias("rest")))
    small = sizes.where(F.col("n") < MIN_GROUP)
    by_lang = small.groupBy(lang.alias("__lang")).agg(F.sum("n").alias("n_lang"))
    own = _group(F.col("lang"), F.col("source"))
    return sizes.withColumn("__lang", lang).join(by_lang, "__lang", "left").select(own.alias("__own"), F.when(F.col("n") >= MIN_GROUP, own).when(F.col("n_lang") >= MIN_GROUP, F.col("__lang")).otherwise(F.lit("rest")).alias("__group"))


def _fit_schema() -> str:
    return "__group string, start int, n long, center array<double>, inverse array<double>, log_det double"


def _fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean, inverse covariance and determinant of each row of sums."""
    floor = np.diag([(FEATURES[k][1] * STEP) ** 2 for k in NAMES])
    for df in frames:
        out = []
        for r in df.itertuples(index=False):
            n, s = float(r.n), np.array(r.sums, float)
            mean = s[:P] / n
            cross = np.zeros((P, P))
            cross[np.tril_indices(P)] = s[P:]
            cov = np.tril(cross) + np.tril(cross, -1).T
            cov = cov / n - np.outer(mean, mean)
            # the covariance's excess over the floor stays positive definite with the floor added
            cov = cov + floor * np.clip(1 - np.diag(cov) / np.diag(floor), 0.05, 1)
            out.append((r.group, r.start, r.n, mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
        yield pd.DataFrame(out, columns=["__group", "start", "n", "center", "inverse", "log_det"])


def distance() -> Column:
    """Squared Mahalanobis distance of the features to ``center`` by ``inverse``."""
    d = [F.col(k) - F.col("center")[i] for i, k in enumerate(NAMES)]
    total = F.lit(0.0)
    for i in range(P):
        total = total + d[i] * d[i] * F.col("inverse")[i * P + i]
        for j in range(i):
            total = total + 2 * d[i] * d[j] * F.col("inverse")[i * P + j]
    return total


def _bin(d: Column) -> Column:
    """Distances in steps of about one percent: few values, so that quantiles over them are exact and small."""
    return F.floor(F.log1p(F.least(F.greatest(d, F.lit(0.0)), F.lit(1e9))) * 128).cast("long")


def _moments(rows: DataFrame) -> DataFrame:
    sums = [F.sum(k) for k in NAMES] + [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])) for i in range(P) for j in range(i + 1)]
    return rows.groupBy("__group", "start").agg(F.count("*").alias("n"), F.array(*sums).alias("sums")).select(F.col("__group").alias("group"), "start", "n", "sums").mapInPandas(_fit, _fit_schema())


def fit(rows: DataFrame) -> DataFrame:
    """MCD estimates by ``__group`` of integer features: center, inverse, scale."""
    medians = rows.groupBy("__group").agg(F.count("*").alias("n"), F.array(*(F.percentile(k, 0.5) for k in NAMES)).alias("center"))
    off = rows.join(medians, "__group").select("__group", *(F.abs(F.col(k) - F.col("center")[i]).alias(k) for i, k in enumerate(NAMES)), "n", "center")
    spread = off.groupBy("__group").agg(F.first("n").alias("n"), F.first("center").alias("center"), *(F.percentile(k, 0.5).alias(k) for k in NAMES))
    diagonal = [1 / F.pow(F.greatest(1.4826 * F.col(k), F.lit(FEATURES[k][1] * STEP)), 2) if i == j else F.lit(0.0) for i, k in enumerate(NAMES) for j in range(P)]
    first = spread.select("__group", F.lit(0).alias("start"), "n", "center", F.array(*diagonal).alias("inverse"), F.lit(1e300).alias("log_det"))
    now = cut(first.unionByName(_moments(rows.withColumn("start", F.lit(1)))), "mcd")
    for _ in range(MAX_STEPS):
        near = rows.join(now, "__group").select("__group", "start", *NAMES, _bin(distance()).alias("bin"))
        limit = near.groupBy("__group", "start").agg(F.percentile("bin", COVER).alias("limit"))
        after = cut(_moments(near.join(limit, ["__group", "start"]).where(F.col("bin") <= F.col("limit"))), "mcd")
        # one number: whether any group's determinant or center still moves
        a, b = after.alias("a"), now.alias("b")
        same = (F.abs(F.col("a.log_det") - F.col("b.log_det")) < 1e-9) & F.forall(F.zip_with("a.center", "b.center", lambda x, y: F.abs(x - y) < 1e-6), lambda t: t)
        moving = a.join(b, ["__group", "start"]).where(~same).limit(1).count()
        now = after
        if not moving:
            break
    best = now.groupBy("__group").agg(F.min(F.struct("log_det", "start", "n", "center", "inverse")).alias("b")).select("__group", "b.*")
    scaled = rows.join(best, "__group").groupBy("__group").agg(F.count("*").alias("rows"), F.percentile(_bin(distance()), 0.5).alias("mid"))
    return cut(best.join(scaled, "__group").where(F.col("rows") >= MIN_GROUP).select("__group", "center", "inverse", F.greatest(F.expm1(F.col("mid") / 128) / MEDIAN, F.lit(1.0)).alias("scale")), "mcd")


def judge(docs: DataFrame, *carry: str) -> DataFrame:
    """Columns ``carry`` of ``docs`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    ``docs`` needs text; lang and source may be lacking.
    """
    for c in ("lang", "source"):
        if c not in docs.columns:
            docs = docs.withColumn(c, F.lit(None).cast("string"))
    own = [f"__c{i}" for i in range(len(carry))]
    hidden = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(carry, own, strict=True)), F.col("lang").cast("string").alias("__lang"), F.col("source").cast("string").alias("__source"), "text")
    rows = cut(measure(hidden, *own, "__lang", "__source"), "statistics")
    rows = rows.withColumnsRenamed({f"__{k}": k for k in _STATS} | {"__lang": "lang", "__source": "source"}).withColumn("base_failed", base_failed())
    rows = rows.withColumns({k: F.when(~F.col("base_failed"), F.least(F.greatest(F.round(f() * STEP), F.lit(-64 * STEP)), F.lit(64 * STEP)).cast("long")) for k, (f, _) in FEATURES.items()})
    passed = rows.where(~F.col("base_failed"))
    named = groups(passed.groupBy("lang", "source").agg(F.count("*").alias("n")))
    named = cut(named, "groups")
    group = _group(F.col("lang"), F.col("source"))
    estimates = fit(cut(passed.select(group.alias("__own"), *NAMES).join(named, "__own").select("__group", *NAMES), "features"))
    out = rows.withColumn("__own", group).join(named, "__own", "left").join(estimates, "__group", "left")
    d = F.when(~F.col("base_failed"), distance() / F.col("scale"))
    kept = ~F.col("base_failed") & (F.coalesce(d, F.lit(0.0)) <= CUTOFF)
    return out.select(*(F.col(n).alias(c) for c, n in zip(carry, own, strict=True)), *_STATS[:5], "base_failed", kept.alias("kept"), F.round(d, 6).alias("distance"))


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that the rules reject, all its columns as they were."""
    kept = judge(docs, *docs.columns)
    # the counts stand after the carried columns, so a clash of names can't hide either
    names = kept.columns
    flag = names[len(docs.columns) :].index("kept") + len(docs.columns)
    numbered = kept.toDF(*(f"c{i}" for i in range(len(names))))
    return numbered.where(F.col(f"c{flag}")).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
