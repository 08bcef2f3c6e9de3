"""Quality rules: robust multivariate outliers among text statistics, per language and source.

Every text that passes the base rules has a vector of transformed statistics. The vectors of a language and
source have a minimum-covariance-determinant estimate: of all subsets of `share` of the rows, the one whose
covariance has the least determinant gives centre and scatter. It is found by concentration steps: take the
`share` of rows nearest by Mahalanobis distance under the last estimate, estimate again, until the steps end.
Each step is one aggregation over all rows: rows fall into narrow cells by distance, the moments of cells are
summed before the shuffle, and the cells up to the wanted share are added, the last one in part. No group of
rows meets in one task. Two starts (moments of all rows, spatial signs) run side by side and the smaller
determinant wins.

Groups of fewer than `min_rows` rows are pooled by language, and languages that are still too small in one
pool; if that is too small as well, its rows have no verdict of the method and stay.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweir.llm.common import WordHashes, bound_batches, clear_caches, mix64, raw, staged

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
STATS = "struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">"
SYMBOLS = [bytes([c]) for c in b"#*$%&|<>"]
WINDOW = 8
VECTOR = ["__x_length", "__x_word", "__x_symbols", "__x_lines", "__x_repeats", "__x_upper"]
#: least standard deviations: a statistic that hardly varies in a group still has this scale
FLOOR = [0.35, 0.08, 0.04, 0.12, 0.12, 0.08]


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words in runs of `window` words that are found twice or more."""
    k = len(hashes) - window + 1
    if k < 2:
        return 0
    total = np.zeros(k, np.uint64)
    for j in range(window):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[j:j + k]
    order = np.argsort(mix64(total), kind="stable")
    same = total[order][1:] == total[order][:-1]
    if not same.any():
        return 0
    at = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def text_counts(text: bytes | None, memo: WordHashes) -> tuple[int, ...]:
    """The COUNTS of a text."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.split()
    joined = np.frombuffer(b"".join(words), np.uint8)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (len(words), int(((joined & 0xC0) != 0x80).sum()), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(memo.of(words)), len(lines), int(((joined >= 65) & (joined <= 90)).sum()))


def counts_of(texts: pa.Array) -> pa.Array:
    clear_caches()
    memo, columns = WordHashes(), [[] for _ in COUNTS]
    for i in range(0, len(texts), 256):
        for text in raw(texts.slice(i, 256)):
            for column, value in zip(columns, text_counts(text, memo)):
                column.append(value)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], COUNTS)


def with_counts(docs: DataFrame, text: str, name: str) -> DataFrame:
    """docs with a struct column of the COUNTS of each whole text."""
    bound_batches(docs.sparkSession)
    return docs.withColumn(name, F.arrow_udf(counts_of, STATS)(F.col(text)))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])


def vector(s: Column) -> list[Column]:
    one = F.lit(1.0)
    return [F.log(one + s["n_words"]), F.log((one + s["word_chars"]) / (one + s["n_words"])),
            F.sqrt(s["n_symbols"] / F.greatest(s["word_chars"], one)), F.sqrt(s["n_dup_lines"] / F.greatest(s["n_lines"], one)),
            F.sqrt(s["n_repeat_words"] / F.greatest(s["n_words"], one)), F.sqrt(s["n_upper"] / F.greatest(s["word_chars"], one))]


def group_key(column: Column) -> Column:
    return F.when(column.isNull(), "1").otherwise(F.concat(F.lit("0"), column.cast("string")))


def chi_square(p: int, z: float) -> float:
    """The chi-square value of p degrees at the standard normal's z, by the cube-root approximation."""
    return p * (1 - 2 / (9 * p) + z * math.sqrt(2 / (9 * p))) ** 3


def groups(rows: DataFrame, min_rows: int) -> DataFrame:
    """(lang_key, source_key, gid): the pool that each language and source belongs to."""
    n = rows.groupBy("lang_key", "source_key").agg(F.count(F.lit(1)).alias("n"))
    by_lang = Window.partitionBy("lang_key")
    small = F.when(F.col("n") < min_rows, F.col("n")).otherwise(0)
    n = n.withColumn("left", F.sum(small).over(by_lang))
    rest = F.when((F.col("n") < min_rows) & (F.col("left") < min_rows), F.col("n")).otherwise(0)
    n = n.withColumn("rest", F.sum(rest).over(Window.partitionBy()))
    return n.select("lang_key", "source_key", F.when(F.col("n") >= min_rows, F.concat_ws("|", F.lit("s"), "lang_key", "source_key"))
                    .when(F.col("left") >= min_rows, F.concat_ws("|", F.lit("l"), "lang_key"))
                    .when(F.col("rest") >= min_rows, F.lit("all")).alias("gid"))


def _moments(weight: Column) -> list[Column]:
    p = len(VECTOR)
    return [F.sum(weight).alias("n"), F.array(*[F.sum(weight * F.col(v)) for v in VECTOR]).alias("s"),
            F.array(*[F.sum(weight * F.col(VECTOR[i]) * F.col(VECTOR[j])) for i in range(p) for j in range(i + 1)]).alias("ss")]


def _estimates(frames):
    """Centre, whitening rows and log determinant from the moments of each group."""
    p, low = len(VECTOR), np.tril_indices(len(VECTOR))
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            mean, cov = np.array(r.s) / r.n, np.zeros((p, p))
            cov[low] = np.array(r.ss) / r.n
            cov = cov + np.tril(cov, -1).T - np.outer(mean, mean)
            cov = (cov + cov.T) / 2 + np.diag(np.square(FLOOR))
            white = np.linalg.inv(np.linalg.cholesky(cov))
            out.append((r.gid, r.start, mean.round(9).tolist(), white.round(9).ravel().tolist(), float(np.linalg.slogdet(cov)[1]), r.reach))
        yield pd.DataFrame(out, columns=["gid", "start", "mean", "white", "logdet", "reach"])


def _distance(estimate: str = "") -> Column:
    """Squared Mahalanobis distance of the vector columns under columns mean and white."""
    p = len(VECTOR)
    d = [F.col(v) - F.col(estimate + "mean")[i] for i, v in enumerate(VECTOR)]
    terms = []
    for i in range(p):
        z = sum((F.col(estimate + "white")[i * p + j] * d[j] for j in range(i + 1)), F.lit(0.0))
        terms.append(z * z)
    return sum(terms[1:], terms[0])


def mcd(rows: DataFrame, share: float = 0.75, steps: int = 6) -> DataFrame:
    """(gid, mean, white, logdet, scale) per gid of rows (gid, VECTOR columns).

    white is the inverse Cholesky factor of the scatter, row by row; scale makes the distance at `share` of
    the rows that of the normal distribution.
    """
    shape = "gid string, start int, mean array<double>, white array<double>, logdet double, reach double"
    p, none = len(VECTOR), F.lit(0.0).alias("reach")
    one = F.lit(1.0)
    first = rows.groupBy("gid").agg(*_moments(one)).select("gid", F.lit(0).alias("start"), "n", "s", "ss", none)
    estimates = staged(first.mapInPandas(_estimates, shape))
    centred = rows.join(estimates.select("gid", "mean"), "gid")
    norm = F.sqrt(sum(((F.col(v) - F.col("mean")[i]) / F.lit(FLOOR[i])) ** 2 for i, v in enumerate(VECTOR)))
    weight = one / F.greatest(F.lit(1.0), norm)
    signs = centred.groupBy("gid").agg(*_moments(weight)).select("gid", F.lit(1).alias("start"), "n", "s", "ss", none)
    estimates = staged(estimates.unionByName(signs.mapInPandas(_estimates, shape)))
    for _ in range(steps):
        far = rows.join(estimates, "gid").withColumn("d2", _distance())
        cells = far.withColumn("cell", F.floor(16 * F.log2(1 + F.col("d2")))).groupBy("gid", "start", "cell").agg(
            *_moments(one), F.max("d2").alias("reach"))
        order = Window.partitionBy("gid", "start").orderBy("cell")
        wanted = share * F.sum("n").over(Window.partitionBy("gid", "start"))
        before = F.sum("n").over(order) - F.col("n")
        cells = cells.withColumn("part", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (wanted - before) / F.col("n")))).where("part > 0")
        near = cells.groupBy("gid", "start").agg(
            F.sum(F.col("n") * F.col("part")).alias("n"),
            F.array(*[F.sum(F.col("s")[i] * F.col("part")) for i in range(p)]).alias("s"),
            F.array(*[F.sum(F.col("ss")[i] * F.col("part")) for i in range(p * (p + 1) // 2)]).alias("ss"), F.max("reach").alias("reach"))
        estimates = staged(near.mapInPandas(_estimates, shape))
    best = estimates.groupBy("gid").agg(F.min(F.struct("logdet", "start", "mean", "white")).alias("b"))
    final = rows.join(best, "gid").withColumn("d2", _distance("b.")).withColumn("cell", F.floor(64 * F.log2(1 + F.col("d2"))))
    cells = final.groupBy("gid", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("d2").alias("reach"))
    upto = F.sum("n").over(Window.partitionBy("gid").orderBy("cell"))
    total = F.sum("n").over(Window.partitionBy("gid"))
    reach = cells.withColumn("r", F.when(upto >= share * total, F.col("reach"))).groupBy("gid").agg(F.min("r").alias("reach"))
    usual = chi_square(p, 0.6744897501960817 if share == 0.75 else _normal_quantile(share))
    return best.join(reach, "gid").select("gid", "b.mean", "b.white", "b.logdet",
                                          F.greatest(F.col("reach") / usual, F.lit(1.0)).alias("scale"))


def _normal_quantile(q: float) -> float:
    from statistics import NormalDist
    return NormalDist().inv_cdf(q)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", tail_z: float = 6.0,
          min_rows: int = 60, share: float = 0.75) -> DataFrame:
    """docs with struct columns `__counts` and `__verdict` (failed, distance, kept).

    A text fails the base rules with fewer than 20 words, or with over 30 % of its words in repeated runs of
    eight words. Of the others, a text is rejected where its squared distance exceeds the chi-square value at
    `tail_z` standard deviations. Null and empty texts have no words and fail. Null languages and sources are
    groups of their own. Rows without an estimate have distance null and stay. Repeated rows are judged alike.
    Clashing names in the input are not touched: all helper columns begin with two underscores. An empty
    table stays empty.
    """
    counted = with_counts(docs, text, "__counts").withColumns({"__lang": group_key(F.col(lang)), "__source": group_key(F.col(source))})
    s = F.col("__counts")
    slim = counted.select(F.col("__lang").alias("lang_key"), F.col("__source").alias("source_key"), s.alias("__counts")).where(~base_failed(s))
    rows = staged(slim.select("lang_key", "source_key", *[v.alias(n) for n, v in zip(VECTOR, vector(s))]))
    pools = staged(groups(rows, min_rows))
    fitted = mcd(staged(rows.join(pools.where("gid IS NOT NULL"), ["lang_key", "source_key"]).select("gid", *VECTOR)), share)
    fitted = staged(pools.join(fitted, "gid").select(F.col("lang_key").alias("__lang"), F.col("source_key").alias("__source"),
                                                           F.struct("mean", "white", "scale").alias("__fit")))
    cut = chi_square(len(VECTOR), tail_z)
    judged = counted.withColumns({n: v for n, v in zip(VECTOR, vector(s))} | {"__failed": base_failed(s)})
    judged = judged.join(fitted, ["__lang", "__source"], "left")
    distance = F.when(~F.col("__failed"), _distance("__fit.") / F.col("__fit.scale"))
    judged = judged.withColumn("__distance", distance)
    kept = ~F.col("__failed") & F.coalesce(F.col("__distance") <= cut, F.lit(True))
    return judged.withColumn("__verdict", F.struct(F.col("__failed").alias("failed"), F.col("__distance").alias("distance"),
                                                   kept.alias("kept"))).select(*docs.columns, "__counts", "__verdict")
