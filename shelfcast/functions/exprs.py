"""Column expressions shared by the operators.

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen; none is a Python UDF.  The numeric conventions follow the reference's
Python semantics where they differ from Spark defaults:

* weekday: Monday = 0 (pandas `dayofweek`), Spark `weekday`.
* `int(x)` truncates toward zero: `cast('int')`.
* `round(x, 2)` on NumPy floats is half-to-even: `bround`.
* division by zero yields NULL (`try_divide`) instead of raising under ANSI.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Digits kept on double outputs that are compared across engines.
OUT_DIGITS = 6


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: str | Column) -> Column:
    """Round a double output to 6 dp so summation order does not leak into
    results.  Plain IEEE arithmetic (`floor(x*1e6 + 0.5) / 1e6`) rather than
    decimal rounding, so every engine lands on the same double, ties included."""
    scale = float(10 ** OUT_DIGITS)
    return F.floor(col_(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def r2(c: str | Column) -> Column:
    """Currency amounts: half-up to cents with the same IEEE formula as `r6`."""
    return F.floor(col_(c) * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


def r4(c: str | Column) -> Column:
    """Large measured values (perplexities ~1e4): half-up to 4 dp, same IEEE formula."""
    return F.floor(col_(c) * F.lit(1e4) + F.lit(0.5)) / F.lit(1e4)


def trunc_int(c: str | Column) -> Column:
    """Python `int(x)`: truncate toward zero."""
    return col_(c).cast("int")


def bround2(c: str | Column) -> Column:
    """Python/NumPy `round(x, 2)`: half-to-even."""
    return F.bround(col_(c), 2)


def safe_div(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col_(a), col_(b))


def weekday_mon0(c: str | Column) -> Column:
    return F.weekday(col_(c))


def py_float_text(c: str | Column) -> Column:
    """Text of a double as Python prints it, for values with few decimals and
    magnitude below 1e7 (the inputs here are already rounded to 2 dp)."""
    return col_(c).cast("string")


def fixed(c: str | Column, digits: int) -> Column:
    """Python `f"{x:.Nf}"`.  Java's formatter rounds half-up on the shortest
    decimal text, Python rounds the exact binary value half-to-even; rounding
    half-to-even first makes exact binary ties (x.125, x.375, ...) agree."""
    return F.format_string(f"%.{digits}f", F.bround(col_(c), digits))


def let(value: Column, body) -> Column:
    """Evaluate `value` once and pass it to `body` (a Column -> Column
    function).  Higher-order lambdas re-evaluate captured expressions per
    element; binding through a one-element `transform` avoids that."""
    return F.element_at(F.transform(F.array(value), body), 1)


def array_mean(arr: str | Column) -> Column:
    a = col_(arr)
    total = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return safe_div(total, F.size(a))


def array_pop_std(arr: str | Column) -> Column:
    """Population standard deviation of a numeric array (NumPy `np.std`)."""
    a = col_(arr)

    def from_mean(m):
        ss = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + (x.cast("double") - m) * (x.cast("double") - m))
        return F.sqrt(safe_div(ss, F.size(a)))
    return let(array_mean(a), from_mean)


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(
        F.zip_with(col_(a), col_(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda acc, x: acc + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(col_(a), F.lit(0.0),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity of two numeric arrays; 0 when either norm is 0."""
    den = norm(a) * norm(b)
    return F.when(den == 0, F.lit(0.0)).otherwise(dot(a, b) / den)


def word_tokens(text: str | Column) -> Column:
    """Python `str.split()`: runs of (Unicode) whitespace, no empty tokens."""
    return F.filter(F.split(col_(text), PY_WHITESPACE), lambda x: x != "")


def word_count(text: str | Column) -> Column:
    return F.size(word_tokens(text))


# Fixed value: the number pattern of the reference's numeric check, r"\d+\.?\d*".
# Python's `\d` matches any Unicode decimal digit, so it is spelled \p{Nd} here.
NUMBER_PATTERN = r"\p{Nd}+\.?\p{Nd}*"


def extract_numbers(text: str | Column) -> Column:
    return F.regexp_extract_all(col_(text), F.lit(NUMBER_PATTERN), 0)


def global_rank(df: DataFrame, order_col: str, descending: bool = True,
                partitions: int | None = None) -> DataFrame:
    """rank / dense_rank / percent_rank over the whole table without a single
    task that holds it.

    Rows are counted by key, so ties, however many, are one row from there on.
    The counted keys are range-partitioned once, into a table: their partition
    numbers are then data, and the running counts within a partition and the
    totals of the partitions before it agree.  Null keys rank as one value."""
    from pyspark.sql import Window

    from shelfcast.session import materialize
    n_parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.col("_key").desc() if descending else F.col("_key").asc()
    counted = df.groupBy(F.col(order_col).alias("_key")).agg(F.count("*").alias("_n"))
    keys = materialize(counted.repartitionByRange(n_parts, key).withColumn("_pid", F.spark_partition_id()), "rank-keys")
    ahead = Window.partitionBy("_pid").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    local = keys.withColumns({"_before": F.coalesce(F.sum("_n").over(ahead), F.lit(0)),
                              "_keys_before": F.count("*").over(ahead)})
    # One row per partition.
    parts = keys.groupBy("_pid").agg(F.sum("_n").alias("_rows"), F.count("*").alias("_keys"))
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "_pid", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_off"),
        F.coalesce(F.sum("_keys").over(earlier), F.lit(0)).alias("_koff"),
        F.sum("_rows").over(Window.partitionBy()).alias("_total"))
    ranks = local.join(offsets, "_pid").select(
        "_key", "_total", (F.col("_off") + F.col("_before") + 1).alias("_rank"),
        (F.col("_koff") + F.col("_keys_before") + 1).alias("_dense"))
    return df.join(ranks, F.col(order_col).eqNullSafe(F.col("_key"))).select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.col("_rank").alias("rank"), F.col("_dense").alias("dense_rank"),
        F.when(F.col("_total") <= 1, F.lit(0.0)).otherwise(
            (F.col("_rank") - 1) / (F.col("_total") - 1)).alias("percent_rank"))


# Fixed value: Python `str.split()` whitespace, as one character class.
PY_WHITESPACE = (r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                 r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")
# Word tokens for n-gram, TF-IDF and unigram models: lower-cased runs of
# Unicode letters and digits.
WORD_PATTERN = r"[\p{L}\p{N}]+"


def words(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(col_(text)), F.lit(WORD_PATTERN), 0)


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams in order; empty when the text has fewer than n tokens.
    The token array is bound once (`let`), not re-tokenised per position."""
    def grams(t):
        g = F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.array_join(F.slice(t, i + 1, n), " "))
        return F.when(F.size(t) >= n, g).otherwise(F.array().cast("array<string>"))
    return let(tokens, grams)


def term_counts(text: str | Column) -> Column:
    """array<struct<term, tf>> of the word tokens of one text, counted within
    the row: sorted tokens, cut where they change."""
    empty = F.array().cast("array<struct<term:string,tf:int>>")

    def counted(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (
            F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
        return F.when(F.size(s) > 0, let(starts, lambda b: F.zip_with(
            b, F.concat(F.slice(b, F.lit(2), F.size(b)), F.array(F.size(s) + 1)),
            lambda i, j: F.struct(F.element_at(s, i).alias("term"), (j - i).alias("tf"))))).otherwise(empty)
    return let(F.array_sort(F.coalesce(words(text), F.array().cast("array<string>"))), counted)
