"""Quality rules: base rules, then robust multivariate outliers, in DataFrame functions only.

Word statistics come from arrays inside each row. For the documents that pass the base rules a
minimum-covariance-determinant estimate is made for each language and source: three deterministic
starts take concentration steps to the share `half` of rows that lie nearest, the start with the least
determinant goes on, and a last estimate over all rows within its TRUSTED share, made consistent at the normal
distribution, gives the distances. A document goes if a clean one would lie so far with chance `tail`
(a chi-squared quantile). Quantiles come from histograms of bounded size for each group, sums of
products are pre-aggregated before the shuffle, and the small matrices are factored as columns, so
that a group with a third of all rows is never gathered.

Small groups are judged too: every estimate shrinks towards the whole corpus by PRIOR_ROWS rows. Nulls:
a null text has no words and fails the base rules; null languages and sources are values of their own.
Very long texts are read whole. Rows in the bin of a quantile count as near together, so that ties don't
depend on an order; repeated rows get repeated verdicts; an empty table gives an empty one. Only the four
columns named are read, so that others may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumengrid.llm.common import WORD, join_checked, materialise

SPACE = r"[\x20\x09-\x0D]+"
#: Names of the transformed statistics, and the least standard deviation that each is given: many are 0 in
#: most texts, and a spread of 0 would reject whatever differs at all.
VECTOR = {"word_length": 0.06, "symbols": 0.08, "dup_lines": 0.12, "repeats": 0.08, "capitals": 0.06}
D = len(VECTOR)
#: Rows that the whole corpus counts as in the estimates of a group.
PRIOR_ROWS = 10
#: Share of a normal distribution that the last estimate takes in.
TRUSTED = 0.975
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]


def word_statistics(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Carried columns, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals.

    A word of a three-word window that occurs twice or more in the text counts as repeated. Windows
    are compared by 64-bit hashes within one text, sorted with their positions. Write the result before
    filtering by it: a filter would be pushed below, and repeat the array expressions inside each other.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals"]
    carry = [c for c in carry if c not in made]
    df = docs.select(*carry, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    df = df.withColumn("__words", F.array_remove(F.split("__text", SPACE), ""))
    df = df.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(WORD)))
    n = F.size("__words")
    df = df.select(
        *carry,
        n.cast("long").alias("n_words"),
        F.length(F.concat_ws("", "__words")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("__text", F.lit(r"[A-Z!]")).cast("long").alias("n_capitals"),
        F.when(
            n >= 3,
            F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2))),
        ).alias("__windows"),
    )
    same = F.size(F.array_distinct("__windows")) == F.size("__windows")
    ordered = F.when(~same, F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("__sorted", ordered)
    at = lambda k: F.get("__sorted", k)["h"]
    twice = F.filter("__sorted", lambda x, k: F.coalesce(at(k - 1) == x["h"], F.lit(False)) | F.coalesce(at(k + 1) == x["h"], F.lit(False)))
    df = df.withColumn("__places", F.sort_array(F.transform(twice, lambda x: x["i"])))
    # Each repeated window adds the words up to the next one, three at most.
    added = F.transform("__places", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("__places", k + 1) - p, F.lit(3))).cast("long"))
    repeats = F.coalesce(F.aggregate(added, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
    return df.select(*carry, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeats.cast("long").alias("n_repeat_words"), "n_capitals")


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> F.Column:
    """The transformed statistics, in the order of VECTOR."""
    n = F.col("n_words") + 10
    return F.array(
        F.log((F.col("word_chars") + 50) / n),
        F.sqrt(F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 10)),
        F.sqrt(F.col("n_repeat_words") / n),
        F.sqrt(F.col("n_capitals") / (F.col("word_chars") + 50)),
    )


def _distance() -> F.Column:
    """Squared Mahalanobis distance of x from mean; `inverse` holds the lower triangle of the inverted Cholesky factor.

    Like the other formulas of small matrices it is written as SQL, which is built much faster than columns.
    """
    rows = [" + ".join(f"get(inverse, {i * (i + 1) // 2 + j}) * (get(x, {j}) - get(mean, {j}))" for j in range(i + 1)) for i in range(D)]
    return F.expr(" + ".join(f"({z}) * ({z})" for z in rows))


def _factor(moments: DataFrame, prior: dict[str, list[float]], keys: tuple[str, ...] = ("group", "start")) -> DataFrame:
    """(keys, mean, inverse, log_det) from (keys, n, mean, cov): shrunk estimates and their Cholesky factors.

    Mean and covariance shrink towards the prior's as if it had PRIOR_ROWS rows, and every variance gets
    the least one.
    """
    floors = list(VECTOR.values())
    means = [f"w * get(mean, {i}) + (1 - w) * {prior['mean'][i]!r}D AS m{i}" for i in range(D)]
    cov = [f"w * get(cov, {k})" + (f" + (1 - w) * {prior['sd'][i] ** 2!r}D + {floors[i] ** 2!r}D" if i == j else "") + f" AS c{i}{j}" for k, (i, j) in enumerate(PAIRS)]
    df = moments.selectExpr(*keys, f"n / (n + {PRIOR_ROWS}D) AS w", "mean", "cov").selectExpr(*keys, *means, *cov)
    less = lambda i, j: "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
    for j in range(D):  # Cholesky by columns
        df = df.selectExpr("*", f"sqrt(greatest(c{j}{j}{less(j, j)}, {floors[j] ** 2 / 4!r}D)) AS l{j}{j}")
        df = df.selectExpr("*", *[f"(c{i}{j}{less(i, j)}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, D)])
    for i in range(D):  # the inverse, by rows
        row = [f"-({' + '.join(f'l{i}{k} * v{k}{j}' for k in range(j, i))}) / l{i}{i} AS v{i}{j}" for j in range(i)]
        df = df.selectExpr("*", *row, f"1D / l{i}{i} AS v{i}{i}")
    triangle = ", ".join(f"v{i}{j}" for i, j in PAIRS)
    return df.selectExpr(*keys, f"array({', '.join(f'm{i}' for i in range(D))}) AS mean", f"array({triangle}) AS inverse", f"2D * ({' + '.join(f'ln(l{i}{i})' for i in range(D))}) AS log_det")


def _moments(rows: DataFrame, x: str = "x", keys: tuple[str, ...] = ("group", "start")) -> DataFrame:
    """(keys, n, mean, cov) of the vectors; sums are pre-aggregated before they meet."""
    sums = [f"sum(get({x}, {i}))" for i in range(D)], [f"sum(get({x}, {i}) * get({x}, {j}))" for i, j in PAIRS]
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.expr(f"array({', '.join(part)})").alias(name) for part, name in zip(sums, "sp", strict=True)])
    cov = ", ".join(f"get(p, {k}) / n - get(s, {i}) / n * (get(s, {j}) / n)" for k, (i, j) in enumerate(PAIRS))
    return found.selectExpr(*keys, "n", f"array({', '.join(f'get(s, {i}) / n' for i in range(D))}) AS mean", f"array({cov}) AS cov")


def _robust(rows: DataFrame, width: float = 0.01) -> DataFrame:
    """(group, n, median, sd) with deviations from median absolute ones, by histograms of `width`."""
    at = rows.select("group", F.posexplode("x").alias("i", "v")).withColumn("bin", F.round(F.col("v") / width).cast("long"))
    bins = materialise(at.groupBy("group", "i", "bin").agg(F.count("*").alias("c")))

    def middle(table: DataFrame, by: str) -> DataFrame:
        inside = Window.partitionBy("group", "i")
        upto = F.sum("c").over(inside.orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
        half = table.withColumn("upto", upto).withColumn("all", F.sum("c").over(inside))
        return half.where(2 * F.col("upto") >= F.col("all")).groupBy("group", "i").agg(F.min(by).alias("middle"), F.max("all").alias("n"))

    median = middle(bins, "bin")
    away = bins.join(median.drop("n"), ["group", "i"]).withColumn("away", F.abs(F.col("bin") - F.col("middle")))
    spread = middle(away.groupBy("group", "i", "away").agg(F.sum("c").alias("c")), "away").withColumnRenamed("middle", "mad").drop("n")
    both = median.join(spread, ["group", "i"])
    parts = both.groupBy("group").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", (F.col("middle") * width).alias("m"), (1.4826 * width * F.col("mad")).alias("sd")))).alias("p"))  # D entries
    return parts.select("group", "n", F.transform("p", lambda e: e["m"]).alias("median"), F.transform("p", lambda e: e["sd"]).alias("sd"))


def _starts(rows: DataFrame, prior: dict[str, list[float]]) -> DataFrame:
    """(group, start, mean, inverse, log_det) of three starts: medians and deviations of each statistic, the
    plain mean and covariance, and the correlation of tanh-scores about the medians."""
    robust = materialise(_robust(rows))
    floors = F.array(*map(F.lit, VECTOR.values()))
    apart = [F.pow(F.get("sd", F.lit(i)), 2) if i == j else F.lit(0.0) for i, j in PAIRS]
    first = robust.select("group", F.lit(0).alias("start"), "n", F.col("median").alias("mean"), F.array(*apart).alias("cov"))
    second = _moments(rows.withColumn("start", F.lit(1)))
    scaled = join_checked(rows, robust, ["group"]).withColumn("start", F.lit(2))
    score = F.transform("x", lambda v, i: F.tanh((v - F.get("median", i)) / (F.get("sd", i) + F.get(floors, i))))
    scores = _moments(scaled.select("group", "start", score.alias("x")))
    root = lambda i: F.sqrt(F.greatest(F.get("z", F.lit(i * (i + 3) // 2)), F.lit(1e-12)))
    shape = [F.get("z", F.lit(k)) / (root(i) * root(j)) * F.get("sd", F.lit(i)) * F.get("sd", F.lit(j)) for k, (i, j) in enumerate(PAIRS)]
    third = scores.select("group", "start", F.col("cov").alias("z")).join(robust, "group")
    third = third.select("group", "start", "n", F.col("median").alias("mean"), F.array(*shape).alias("cov"))
    return materialise(_factor(materialise(first.unionByName(second).unionByName(third)), prior))


def _near(rows: DataFrame, model: DataFrame, n_models: int, share: float) -> tuple[DataFrame, DataFrame]:
    """Rows with the bin of their distance, and (group, start, limit): the bin in which the share's quantile lies."""
    far = join_checked(rows, model, ["group"], rows=n_models)
    far = far.withColumn("bin", F.floor(16 * F.log2(1 + _distance())).cast("long"))
    counts = far.groupBy("group", "start", "bin").agg(F.count("*").alias("c"))
    inside = Window.partitionBy("group", "start")
    upto = F.sum("c").over(inside.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    limit = counts.withColumn("upto", upto).withColumn("all", F.sum("c").over(inside)).where(F.col("upto") >= share * F.col("all"))
    return far.select("group", "start", "x", "bin"), materialise(limit.groupBy("group", "start").agg(F.min("bin").alias("limit")))


def outlier_models(rows: DataFrame, steps: int = 3, half: float = 0.75) -> tuple[DataFrame, int]:
    """(group, mean, inverse, spread) from materialised (group, x), and the number of groups.

    Each start takes two concentration steps; the one with the least determinant takes `steps` more. Mean and
    covariance are then taken again over all rows within the TRUSTED share of that estimate. Squared distances are
    divided by spread, the consistency factor at the normal distribution.
    """
    n_groups = rows.select("group").distinct().count()
    if not n_groups:
        return rows.sparkSession.createDataFrame([], "group string, mean array<double>, inverse array<double>, spread double"), 0
    whole = _robust(rows.withColumn("group", F.lit(""))).first()  # one row
    prior = {"mean": list(whole["median"]), "sd": list(whole["sd"])}
    model = _starts(rows, prior)
    for step in range(2 + steps):
        n_models = n_groups * (3 if step < 2 else 1)
        far, limit = _near(rows, model, n_models, half)
        near = join_checked(far, limit, ["group", "start"], rows=n_models).where(F.col("bin") <= F.col("limit"))
        model = materialise(_factor(materialise(_moments(near)), prior))
        if step == 1:
            best = model.groupBy("group").agg(F.min(F.struct("log_det", "start", "mean", "inverse")).alias("best"))
            model = materialise(best.select("group", "best.*"))
    distance = _distance() / consistency(half)
    trusted = join_checked(rows, model, ["group"], rows=n_groups).where(distance <= chi_squared(TRUSTED))
    last = materialise(_factor(materialise(_moments(trusted)), prior))
    out = model.select("group").join(last.select("group", "mean", "inverse", F.lit(consistency(TRUSTED)).alias("spread")), "group", "left")
    # A group without trusted rows keeps its estimate.
    own = model.select("group", F.col("mean").alias("mean_0"), F.col("inverse").alias("inverse_0"))
    out = out.join(own, "group").select("group", F.coalesce("mean", "mean_0").alias("mean"), F.coalesce("inverse", "inverse_0").alias("inverse"), F.coalesce("spread", F.lit(consistency(half))).alias("spread"))
    return materialise(out), n_groups


def _beyond(x: float, degrees: int) -> float:
    """Share of the chi-squared distribution with an odd number of degrees of freedom above x."""
    share = math.erfc(math.sqrt(x / 2))
    for k in range(1, degrees, 2):
        share += (x / 2) ** (k / 2) * math.exp(-x / 2) / math.gamma(k / 2 + 1)
    return share


def chi_squared(share: float, degrees: int = D) -> float:
    """Quantile of the chi-squared distribution, by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        low, high = (x, high) if _beyond(x, degrees) > 1 - share else (low, x)
    return low


def consistency(share: float) -> float:
    """What the covariance of the nearest share of a normal distribution must be multiplied by."""
    return share / (1 - _beyond(chi_squared(share), D + 2))


def judge(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    tail: float = 1e-7,
    steps: int = 3,
    half: float = 0.75,
) -> DataFrame:
    """One row per document: id, the word statistics, base_failed, distance (null if not judged) and kept."""
    stats = word_statistics(docs.select(F.col(id_column).alias("id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text")), "text", ("id", "lang", "source"))
    stats = stats.withColumn("base_failed", base_failed()).withColumn("x", F.when(~F.col("base_failed"), vector()))
    stats = stats.withColumn("group", F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"}))
    stats = materialise(stats)
    rows = materialise(stats.where(~F.col("base_failed")).select("group", "x"))
    model, n_groups = outlier_models(rows, steps, half)
    out = join_checked(stats, model, ["group"], "left", rows=n_groups)
    out = out.withColumn("distance", _distance() / F.col("spread"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi_squared(1 - tail), F.lit(True))
    return out.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))
