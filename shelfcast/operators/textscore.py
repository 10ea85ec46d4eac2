"""Text scoring: length, numbers, numeric accuracy, ROUGE-N/L, unigram
perplexity and the weighted overall score.

Evaluation pairs come from `conversations`: a user turn (the reference text)
and the assistant turn that follows it (the generated text).  Pairs are
formed with an equi-join on (conv_id, turn + 1) rather than a `lead` window,
so one very long conversation is spread over many tasks.

ROUGE-N is a multiset n-gram overlap computed with explode + aggregation.
ROUGE-L needs a longest common subsequence; it runs as an Arrow-batched
pandas UDF with a bit-parallel LCS (one big-integer step per token), which
handles 20,000-word texts without the quadratic table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.functions.exprs import extract_numbers, ngrams, r4, r6, term_counts, word_count, words
from shelfcast.session import materialize

# Fixed values of the reference's overall score and coherence scaling.
W_FACTUAL, W_NUMERIC, W_COHERENCE = 0.4, 0.4, 0.2
PERPLEXITY_SCALE = 100.0
PAIR_KEYS = ("conv_id", "turn")


def conversation_pairs(conv: DataFrame) -> DataFrame:
    """(conv_id, turn, reference, generated): user turn t and assistant turn t+1."""
    user = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("reference"))
    reply = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("generated"))
    return user.join(reply, list(PAIR_KEYS))


def text_length(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, word_count(text_col).alias("n_words"),
                       F.char_length(text_col).alias("n_chars"))


def numbers_in_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    nums = extract_numbers(text_col)
    return docs.select(id_col, nums.alias("numbers"), F.size(nums).alias("n_numbers"))


def numeric_accuracy_expr(text: Column, expected: Column) -> tuple[Column, Column, Column]:
    """(checks, hits, score) for a map<string,double> of expected values: a
    value counts when `str(int(v))` or `str(v)` occurs in the text (substring
    test, so 45 also hits "145"), score = hits / checks, 0 without checks."""
    from shelfcast.functions.rules import py_int_text, py_repr
    entries = F.map_entries(expected)
    hit = F.transform(entries, lambda e: (
        F.contains(text, py_int_text(e["value"]))
        | F.contains(text, py_repr(e["value"]))).cast("int"))
    checks = F.size(entries)
    hits = F.aggregate(hit, F.lit(0), lambda a, x: a + x)
    score = F.when(checks > 0, hits / checks).otherwise(F.lit(0.0))
    return checks, hits, score


def strict_number_hits(text: Column, expected: Column) -> Column:
    """Exact-number variant: the value's text must be one of the numbers the
    regex extracts from the text."""
    from shelfcast.functions.exprs import let
    from shelfcast.functions.rules import py_int_text, py_repr
    return let(extract_numbers(text), lambda found: F.aggregate(F.transform(F.map_values(expected), lambda v: (
        F.array_contains(found, py_int_text(v)) | F.array_contains(found, py_repr(v))).cast("int")),
        F.lit(0), lambda a, x: a + x))


def exact_numbers(text: Column, expected: Column) -> Column:
    """Whether the numbers a text states are exactly the expected ones, in order."""
    return F.coalesce(extract_numbers(text) == expected, F.lit(False))


def _prf(overlap: Column, n_gen: Column, n_ref: Column) -> tuple[Column, Column, Column]:
    p = F.when(n_gen > 0, overlap / n_gen).otherwise(F.lit(0.0))
    r = F.when(n_ref > 0, overlap / n_ref).otherwise(F.lit(0.0))
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def rouge_n(pairs: DataFrame, ns=(1, 2), keys=PAIR_KEYS, gen: str = "generated", ref: str = "reference") -> DataFrame:
    """ROUGE-n precision / recall / F1 per pair for every n of `ns`, from
    clipped n-gram counts: the n-grams of both sides are unrolled together,
    counted by side in one aggregate, and folded per pair.  A pair's n-grams are
    as many as its texts are long."""
    def side(col, n, name):
        return F.transform(ngrams(words(col), n), lambda x: F.struct(
            F.lit(n).alias("n"), F.lit(name).alias("side"), x.alias("gram")))
    sides = [side(col, n, name) for n in ns for col, name in ((gen, "g"), (ref, "r"))]
    # One entry without an n-gram keeps pairs of empty texts.
    none = F.array(F.struct(F.lit(0).alias("n"), F.lit("").alias("side"), F.lit("").alias("gram")))
    grams = pairs.select(*keys, F.explode(F.concat(none, *sides)).alias("x")).select(*keys, "x.*")
    counted = grams.groupBy(*keys, "n", "gram").agg(
        F.count_if(F.col("side") == "g").alias("cg"), F.count_if(F.col("side") == "r").alias("cr"))
    of = lambda n, c: F.coalesce(F.sum(F.when(F.col("n") == n, c)), F.lit(0))
    totals = counted.groupBy(*keys).agg(*[x for n in ns for x in (
        of(n, F.col("cg")).alias(f"n_gen{n}"), of(n, F.col("cr")).alias(f"n_ref{n}"),
        of(n, F.least("cg", "cr")).alias(f"overlap{n}"))])
    out = []
    for n in ns:
        p, r, f = _prf(F.col(f"overlap{n}"), F.col(f"n_gen{n}"), F.col(f"n_ref{n}"))
        out += [r6(p).alias(f"rouge{n}_p"), r6(r).alias(f"rouge{n}_r"), r6(f).alias(f"rouge{n}_f")]
    return totals.select(*keys, *out)


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel (Hyyro 2004):
    one pass over `a` with big-integer bit vectors indexed by positions of `b`."""
    if not a or not b:
        return 0
    masks: dict = {}
    for j, tok in enumerate(b):
        masks[tok] = masks.get(tok, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for tok in a:
        u = v & masks.get(tok, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


@F.pandas_udf(T.LongType())
def lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(x) if x is not None else [], list(y) if y is not None else [])
                      for x, y in zip(a, b)], dtype="int64")


def rouge_l(pairs: DataFrame, keys=PAIR_KEYS, gen: str = "generated", ref: str = "reference",
            carry=()) -> DataFrame:
    toks = pairs.select(*keys, *carry, words(gen).alias("g"), words(ref).alias("r"))
    s = toks.select(*keys, *carry, F.size("g").alias("n_gen"), F.size("r").alias("n_ref"), lcs_udf("g", "r").alias("lcs"))
    p, rc, f = _prf(F.col("lcs"), F.col("n_gen"), F.col("n_ref"))
    return s.select(*keys, *carry, "n_gen", "n_ref", "lcs", r6(p).alias("rougeL_p"), r6(rc).alias("rougeL_r"),
                    r6(f).alias("rougeL_f"))


def unigram_model(terms: DataFrame):
    """Add-one unigram model of rows with counted `terms`: (term, count), a
    table of its own, and the scalars N (tokens) and V (vocabulary size)."""
    counts = materialize(terms.select(F.explode("terms").alias("t")).groupBy(F.col("t.term").alias("term"))
                         .agg(F.sum("t.tf").alias("c")), "unigrams")
    tot = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    return counts, int(tot["n"] or 0), int(tot["v"] or 0)


def counted_terms(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, terms): texts tokenised once, as a table; terms are counted
    within each row."""
    return materialize(texts.select(*keys, term_counts(text_col).alias("terms")), "terms")


def corpus_perplexity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Perplexity of every document under the add-one unigram model of the
    same corpus; the texts are tokenised once."""
    terms = counted_terms(docs, [id_col], text_col)
    return perplexity(terms, *unigram_model(terms), [id_col])


COMMON = 1_024  # terms whose counts go to every task


def perplexity(terms: DataFrame, counts: DataFrame, n_tokens: int, vocab: int, keys: list[str]) -> DataFrame:
    """Per row of counted `terms`: exp(mean over tokens of -ln p(w)),
    p(w) = (c_w + 1) / (N + V); coherence = max(0, 1 - perplexity / 100).

    The `COMMON` most frequent terms, which would meet in a few join keys, are a
    broadcast of that many rows; only the others are joined by term."""
    tf = terms.select(*keys, F.explode("terms").alias("t")).select(*keys, "t.*")
    head = F.broadcast(counts.orderBy(F.col("c").desc(), "term").limit(COMMON))
    denom = float(n_tokens + vocab)
    nll = F.col("tf") * -F.log((F.coalesce("c", F.lit(0)) + 1.0) / F.lit(denom))
    known = tf.join(head, "term").select(*keys, "tf", nll.alias("nll"))
    other = tf.join(head, "term", "left_anti").join(counts, "term", "left").select(*keys, "tf", nll.alias("nll"))
    g = known.unionByName(other).groupBy(*keys).agg(F.sum("tf").alias("n_tokens"), F.sum("nll").alias("nll"))
    ppl = F.exp(F.col("nll") / F.col("n_tokens"))
    return g.select(*keys, "n_tokens", r4(ppl).alias("perplexity"),
                    r6(F.greatest(F.lit(0.0), 1 - ppl / PERPLEXITY_SCALE)).alias("coherence"))


def overall_score(pairs: DataFrame, counts: DataFrame, n_tokens: int, vocab: int) -> DataFrame:
    """0.4 * ROUGE-L F + 0.4 * numeric accuracy + 0.2 * coherence per pair.
    Expected numbers are the ones the reference text states.  All but the
    coherence is one projection of the pairs."""
    keys = list(PAIR_KEYS)
    exp_nums = F.transform(extract_numbers("reference"), lambda s: F.struct(s.alias("k"), s.cast("double").alias("v")))
    expected = F.map_from_entries(F.array_distinct(exp_nums))
    _, _, score = numeric_accuracy_expr(F.col("generated"), expected)
    own = rouge_l(pairs.withColumns({"numeric": score, "length": word_count("generated")}), carry=("numeric", "length"))
    coh = perplexity(counted_terms(pairs, keys, "generated"), counts, n_tokens, vocab, keys).select(*keys, "coherence")
    out = own.join(coh, keys, "left").fillna(0.0, ["coherence"])
    overall = (F.col("rougeL_f") * W_FACTUAL + F.col("numeric") * W_NUMERIC + F.col("coherence") * W_COHERENCE)
    return out.select(*keys, F.col("rougeL_f").alias("factual_accuracy"), r6("numeric").alias("numerical_accuracy"),
                      "coherence", "length", r6(overall).alias("overall"))
