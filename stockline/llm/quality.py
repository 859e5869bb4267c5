"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Base statistics are built-in expressions over the whole text, row by row; nothing is shuffled for them.
The verdict of the method comes from minimum-covariance-determinant (MCD) estimates of the location and
scatter of transformed statistics within each (language, source):

* start from the coordinates' medians and quartile distances (a deterministic start);
* C-steps: keep the ``SUPPORT`` share of rows with the smallest Mahalanobis distances, estimate mean and
  covariance from them, repeat (each step lowers the determinant);
* scale the scatter so that the median squared distance is that of its chi-square law, never downwards, and
  reject rows beyond ``CUTOFF``.

A group of fewer than ``MIN_GROUP`` rows is judged by the estimate of all rows of its language, and where that
has fewer rows too, by that of all rows, however few: every row that passes the base rule has a distance.

Each step is two map-side combined aggregates over a compact table of the statistics (written once) and joins with
one row per group. A group's rows are dealt to ``SLICES`` slices by their values and ids, and its one row goes to each
of them, so a source that holds a third of all rows is no task's alone. Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockline.llm.storage import drop_stored, stored

SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SUPPORT = 0.75
STEPS = 4
SLICES = 32                # of a group's rows in a join
MIN_GROUP = 40             # smaller groups are judged by a wider one
CUTOFF = 31.8              # chi-square quantile, 4 degrees of freedom, 1 - 2e-6
MEDIAN = 3.357             # its median
# Transformed statistics and the least standard deviation each is given (a group may have none).
FLOORS = {"x_length": 0.08, "x_symbols": 0.35, "x_lines": 0.05, "x_repeats": 0.05}
X = list(FLOORS)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Columns of these names in ``docs`` are replaced. A null text has no words."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    keep = [c for c in docs.columns if c not in (*made, text_col)]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*keep, text.alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(*keep, F.array_remove(F.split("_text", SPACE), "").alias("_words"), lines.alias("_lines"),
                       F.regexp_count("_text", F.lit(SYMBOL)).cast("long").alias("n_symbols"))
    rows = rows.select(*keep, F.transform("_words", lambda w: F.xxhash64(w)).alias("_words"), "_lines", "n_symbols",
                       F.length(F.array_join("_words", "")).cast("long").alias("word_chars"))
    n = F.size("_words")
    window = lambda i: F.xxhash64(*[F.get(F.col("_words"), i + k) for k in range(WINDOW)])
    rows = rows.select(
        *keep, n.cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window))
        .otherwise(F.array().cast("array<bigint>")).alias("_windows"))
    # Only texts with a repeated window are sorted, to find where the repeated ones start.
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    rows = rows.withColumn("_sorted", F.when(some, F.sort_array(F.transform(
        "_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda k: F.get(F.col("_sorted"), k)
    twice = lambda k: F.coalesce(at(k)["h"] == at(k - 1)["h"], F.lit(False)) | F.coalesce(at(k)["h"] == at(k + 1)["h"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), twice), lambda k: at(k)["i"]))
    rows = rows.withColumn("_starts", F.when(F.col("_sorted").isNotNull(), starts)).drop("_sorted", "_windows")
    covered = F.aggregate("_starts", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda s, start: F.struct(
        (s["n"] + F.least(F.lit(WINDOW), start - s["last"])).alias("n"), start.alias("last")), lambda s: s["n"])
    repeats = F.when(F.col("_starts").isNull() | (F.size("_starts") == 0), F.lit(0)).otherwise(covered)
    return rows.withColumn("n_repeat_words", repeats.cast("long")).drop("_starts").select(*keep, *made)


def transformed(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) -> list[Column]:
    """Statistics that do not depend on length: mean word length and symbol rate (shrunk towards common
    values by 20 words, so that short texts are not extreme), shares of repeated lines and words."""
    n = F.col(n_words)
    return [F.log((F.col(word_chars) + 110) / (n + 20)).alias("x_length"),
            F.log((F.col(n_symbols) + 1) / (n + 20)).alias("x_symbols"),
            F.log1p(F.col(n_dup_lines) / (n / 20 + 5)).alias("x_lines"),
            F.log1p(F.col(n_repeat_words) / (n + 20)).alias("x_repeats")]


def _with_group(rows: DataFrame, groups: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``rows`` with the one row that ``groups`` has for their ``key``. A column _slice of theirs deals them; without
    it, their values do."""
    if "_slice" not in rows.columns:
        rows = rows.withColumn("_slice", F.pmod(F.xxhash64(*X), F.lit(SLICES)).cast("int"))
    each = groups.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    return rows.join(each, [key, "_slice"], how)


def _cholesky(groups: DataFrame) -> DataFrame:
    """Adds the lower factor l_i_j of the covariances v_i_j, one column of the factor after the other."""
    for j in range(len(X)):
        square = F.col(f"v_{j}_{j}") - sum((F.col(f"l_{j}_{k}") ** 2 for k in range(j)), F.lit(0.0))
        groups = groups.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(square, F.lit(1e-12))))
        for i in range(j + 1, len(X)):
            cross = F.col(f"v_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
            groups = groups.withColumn(f"l_{i}_{j}", cross / F.col(f"l_{j}_{j}"))
    return groups


def _distances(table: DataFrame, groups: DataFrame) -> DataFrame:
    """``table`` with the squared Mahalanobis distance d2 to its group (null without an estimate)."""
    factor = [f"l_{i}_{j}" for i in range(len(X)) for j in range(i + 1)]
    rows = _with_group(table, groups.select("g", *[f"m_{i}" for i in range(len(X))], *factor), "g")
    for i, x in enumerate(X):
        rest = F.col(x) - F.col(f"m_{i}") - sum((F.col(f"l_{i}_{j}") * F.col(f"y_{j}") for j in range(i)), F.lit(0.0))
        rows = rows.withColumn(f"y_{i}", rest / F.col(f"l_{i}_{i}"))
    return rows.withColumn("d2", sum((F.col(f"y_{i}") ** 2 for i in range(1, len(X))), F.col("y_0") ** 2))


def mcd(table: DataFrame, steps: int = STEPS, support: float = SUPPORT) -> DataFrame:
    """One row per group g with location m_i, factor l_i_j and the scale of its squared distances."""
    size = len(X)
    quartiles = table.groupBy("g").agg(F.count("*").alias("n"), *[
        F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"q_{i}")
        for i, x in enumerate(X)])
    start = [F.col(f"q_{i}")[1].alias(f"m_{i}") for i in range(size)]
    for i in range(size):
        for j in range(i + 1):
            spread = ((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349) ** 2 + FLOORS[X[i]] ** 2
            start.append((spread if i == j else F.lit(0.0)).alias(f"v_{i}_{j}"))
    groups = stored(_cholesky(quartiles.select("g", *start)), "mcd")
    for _ in range(steps):
        near = _distances(table, groups).where("d2 is not null").select("g", "_slice", "d2", *X)
        limit = stored(near.groupBy("g").agg(F.percentile_approx("d2", support, 10_000).alias("limit")), "mcd-limit")
        inner = _with_group(near, limit, "g", "inner").where("d2 <= limit")
        moments = [F.avg(x).alias(f"m_{i}") for i, x in enumerate(X)]
        for i in range(size):
            for j in range(i + 1):
                floor = FLOORS[X[i]] ** 2 if i == j else 0.0
                moments.append((F.covar_pop(X[i], X[j]) + floor).alias(f"v_{i}_{j}"))
        following = stored(_cholesky(inner.groupBy("g").agg(*moments)), "mcd")
        drop_stored(groups)
        drop_stored(limit)
        groups = following
    middle = _distances(table, groups).where("d2 is not null").groupBy("g").agg(
        F.greatest(F.lit(1.0), F.percentile_approx("d2", 0.5, 10_000) / MEDIAN).alias("scale"))
    return stored(groups.join(middle, "g"), "mcd-final")


def judging_groups(table: DataFrame) -> DataFrame:
    """(g_0, g) of the groups of ``table`` (g_0, g_1, ... from narrow to wide): the narrowest that has
    ``MIN_GROUP`` rows, else the widest."""
    widths = [c for c in table.columns if c.startswith("g_")]
    sizes = table.groupBy(*widths).agg(F.count("*").alias("_rows"))
    for c in widths[1:-1]:
        totals = sizes.groupBy(c).agg(F.sum("_rows").alias(f"_{c}"))
        sizes = sizes.join(totals, c)
    wide = F.col(widths[-1])
    for c in reversed(widths[:-1]):
        wide = F.when(F.col("_rows" if c == widths[0] else f"_{c}") >= MIN_GROUP, F.col(c)).otherwise(wide)
    return sizes.select("g_0", wide.alias("g"))


def judged(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", group_cols=("lang", "source")) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance).

    Null and empty texts have no words and fail the base rule. A null language or source is a group of its
    own; groups of fewer than ``MIN_GROUP`` rows that pass the base rule are judged by their first column's
    estimate (the language's), or that of all rows. Rows that fail the base rule may have no distance. Null
    ids stay null; repeated rows are judged once each; an empty table gives an empty result. Extra
    columns are not read."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in group_cols]
    # The number of parts before the names: a language's name is no group's.
    widths = [F.concat_ws("\x1f", F.lit(str(k)), *parts[:k]).alias(f"g_{i}")
              for i, k in enumerate(sorted({0, min(1, len(parts)), len(parts)}, reverse=True))]
    names = [f"g_{i}" for i in range(len(widths))]
    rows = statistics(docs.select(F.col(id_col).cast("long").alias("doc_id"), *widths,
                                  F.col(text_col).cast("string").alias("_body")), "_body")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    dealt = F.pmod(F.xxhash64("doc_id", *made), F.lit(SLICES)).cast("int").alias("_slice")
    table = stored(rows.select("doc_id", *names, *made, failed.alias("base_failed"), *transformed(*made), dealt), "quality")
    passed = table.where("not base_failed")
    wide = stored(judging_groups(passed.select(*names)), "quality-groups")
    # A wider estimate is of all its rows, those of groups with their own estimate included. Only the
    # estimates that some group is judged by are made.
    members = passed.select(F.explode(F.array(*names)).alias("g"), "_slice", *X)
    members = stored(_with_group(members, wide.select("g").distinct(), "g", "inner"), "quality-members")
    groups = mcd(members)
    rows = _with_group(table, wide, "g_0").withColumn("g", F.coalesce("g", F.lit("")))
    judged = _with_group(_distances(rows, groups), groups.select("g", "scale"), "g")
    distance = F.col("d2") / F.col("scale")
    return judged.select("doc_id", *made, "base_failed",
                         (~F.col("base_failed") & (distance <= CUTOFF)).alias("kept"),
                         distance.alias("distance"))
