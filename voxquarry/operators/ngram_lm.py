"""Back-off n-gram language models as tables.

An n-gram is (n, hist, word) with hist the words before the last, joined by blanks. All estimation is grouping and joining;
pruning runs one job for each order, from the highest down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOS, EOS, UNK = "<s>", "</s>", "<unk>"


def _large(df: DataFrame) -> DataFrame:
    """A side that grows with the corpus: its size as Spark estimates it leaves out what exploding made of it, so it is never broadcast."""
    return df.hint("merge")


def longest_grams(sentences: DataFrame, words: str, order: int) -> DataFrame:
    """(n, hist, word, c) of the longest n-gram that ends at each place of <s> sentence </s>; those shorter than `order` begin a sentence."""
    s = sentences.select(F.concat(F.array(F.lit(BOS)), F.col(words), F.array(F.lit(EOS))).alias("w"))

    def one(i: Column) -> Column:
        n = F.least(i + 1, F.lit(order))
        return F.struct(n.alias("n"), F.array_join(F.slice("w", i - n + 2, n - 1), " ").alias("hist"), F.get("w", i).alias("word"))

    grams = s.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 1), one)).alias("g")).select("g.n", "g.hist", "g.word")
    return grams.groupBy("n", "hist", "word").agg(F.count(F.lit(1)).alias("c"))


def counts(sentences: DataFrame, words: str, order: int, keep=None) -> DataFrame:
    """(n, hist, word, c, n_ctx) of every n-gram of <s> sentence </s>: occurrences and distinct words before, none for the highest order.

    Each order is summed from the distinct n-grams of the next higher one, whose first words are the words before, and from
    those that begin a sentence. `keep` materialises steps that are read more than once (a function of a DataFrame).
    """
    keep = keep or (lambda df: df)
    longest = keep(longest_grams(sentences, words, order))
    level = longest.where(F.col("n") == order).withColumn("n_ctx", F.lit(0).cast("long"))
    out = level
    for n in range(order - 1, 0, -1):
        begin = longest.where(F.col("n") == n).select("hist", "word", "c", F.lit(0).alias("x"))
        t = level.select(_shorter(F.col("hist")).alias("hist"), "word", "c", F.lit(1).alias("x")).unionByName(begin)
        level = keep(t.groupBy("hist", "word").agg(F.sum("c").alias("c"), F.sum("x").alias("n_ctx")).select(F.lit(n).alias("n"), "hist", "word", "c", "n_ctx"))
        out = out.unionByName(level)
    return out


def discounts(table: DataFrame, order: int) -> DataFrame:
    """(n, d): max(0.1, n1) / (n1 + 2 n2) from counts of counts, 0 for single words; fails where an order has neither ones nor twos."""
    t = table.groupBy("n").agg(F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"))
    total = F.col("n1") + 2 * F.col("n2")
    ok = F.assert_true((F.col("n") == 1) | (total > 0), F.lit("an order has no n-gram that occurs once or twice"))
    return t.where(ok.isNull()).select("n", F.when(F.col("n") == 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.1), F.col("n1")) / total).alias("d"))


def probabilities(table: DataFrame, order: int) -> DataFrame:
    """Adds f: (c - d) / c(hist) for the highest order, by distinct contexts below; histories without any use counts."""
    per = table.groupBy("n", "hist").agg(F.sum("c").alias("_c"), F.sum("n_ctx").alias("_x"))
    t = table.join(_large(per), ["n", "hist"]).join(F.broadcast(discounts(table, order)), "n")  # a row for each order
    raw = (F.col("n") == order) | (F.col("_x") == 0)
    f = F.greatest(F.when(raw, F.col("c")).otherwise(F.col("n_ctx")) - F.col("d"), F.lit(0.0)) / F.when(raw, F.col("_c")).otherwise(F.col("_x"))
    return t.withColumn("f", f).drop("_c", "_x", "d")


def _shorter(hist: Column) -> Column:
    """A history without its first word."""
    return F.when(F.instr(hist, " ") > 0, F.expr("substring(hist, instr(hist, ' ') + 1)")).otherwise(F.lit(""))


def _joined(hist: str, word: str) -> Column:
    return F.trim(F.concat_ws(" ", hist, word))


def backoffs(table: DataFrame, order: int, p: str = "f") -> DataFrame:
    """Adds bow: (1 - sum of f over seen words) / (1 - sum of the lower order's f over the same words); null for the highest
    order, for n-grams that end a sentence or are no history, and where the denominator is not positive."""
    low = table.select((F.col("n") + 1).alias("n"), F.col("hist").alias("_h"), "word", F.col(p).alias("_low"))
    t = table.where("n > 1").withColumn("_h", _shorter(F.col("hist"))).join(_large(low), ["n", "_h", "word"])
    w = t.groupBy("n", "hist").agg(F.sum(p).alias("_a"), F.sum("_low").alias("_b"))
    w = w.select((F.col("n") - 1).alias("n"), F.col("hist").alias("_g"), F.when(F.col("_b") < 1, (1 - F.col("_a")) / (1 - F.col("_b"))).alias("bow"))
    out = table.withColumn("_g", _joined("hist", "word")).join(_large(w), ["n", "_g"], "left").drop("_g")
    return out.withColumn("bow", F.when(F.col("word") != EOS, F.col("bow")))


def estimate(sentences: DataFrame, words: str, order: int, keep=None) -> DataFrame:
    """(n, hist, word, c, n_ctx, f, bow); `keep` materialises the counts and the probabilities, which are read more than once."""
    keep = keep or (lambda df: df)
    return backoffs(keep(probabilities(counts(sentences, words, order, keep), order)), order)


def score(model: DataFrame, queries: DataFrame, order: int) -> DataFrame:
    """Adds log_p to queries (hist, word): the longest known n-gram's log10 f plus the back-off weights of the histories given
    up; a history without a weight counts 1; an unknown word is null. One pair of left joins for each order."""
    m = model.select("n", "hist", "word", F.log10("f").alias("_p"), F.log10("bow").alias("_b"))
    t = queries.withColumn("_hist", F.col("hist")).withColumn("_w", F.lit(0.0)).withColumn("log_p", F.lit(None).cast("double"))
    for n in range(order, 0, -1):
        size = F.when(F.col("_hist") == "", F.lit(0)).otherwise(F.size(F.split("_hist", " ")))
        t = t.withColumn("_k", size + 1)
        p = m.where(F.col("n") == n).select(F.col("n").alias("_k"), F.col("hist").alias("_hist"), "word", "_p")
        t = t.join(_large(p), ["_k", "_hist", "word"], "left")
        t = t.withColumn("log_p", F.coalesce("log_p", F.col("_w") + F.col("_p"))).drop("_p")
        if n > 1:
            b = m.where(F.col("n") == n - 1).select(_joined("hist", "word").alias("_hist"), F.lit(n).alias("_k"), F.col("_b"))
            t = t.join(_large(b), ["_hist", "_k"], "left")
            up = F.col("log_p").isNull() & (F.col("_k") == n)
            t = t.withColumn("_w", F.when(up, F.col("_w") + F.coalesce("_b", F.lit(0.0))).otherwise(F.col("_w")))
            t = t.withColumn("_hist", F.when(up, F.when(F.instr("_hist", " ") > 0, F.expr("substring(_hist, instr(_hist, ' ') + 1)")).otherwise(F.lit(""))).otherwise(F.col("_hist"))).drop("_b")
    return t.drop("_hist", "_w", "_k")


def sentence_scores(model: DataFrame, sentences: DataFrame, keys: list[str], words: str, order: int) -> DataFrame:
    """(keys, log_p, n): log10 probability of each sentence with its end, given its start; unknown words are left out of both."""
    s = sentences.select(*keys, F.concat(F.array(F.lit(BOS)), F.col(words), F.array(F.lit(EOS))).alias("w"))

    def asked(i: Column) -> Column:
        h = F.slice("w", F.greatest(i - (order - 1), F.lit(0)) + 1, F.least(i, F.lit(order - 1)))
        return F.struct(i.alias("i"), F.array_join(h, " ").alias("hist"), F.get("w", i).alias("word"))

    q = s.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), asked)).alias("q")).select(*keys, "q.i", "q.hist", "q.word")
    return score(model, q, order).groupBy(*keys).agg(F.sum("log_p").alias("log_p"), F.count("log_p").alias("n"))


def perplexity(scored: DataFrame) -> DataFrame:
    """10 ** (-sum of log_p / tokens) over all sentences."""
    return scored.agg(F.pow(F.lit(10.0), -F.sum("log_p") / F.sum("n")).alias("perplexity"))


def mass(model: DataFrame, order: int) -> DataFrame:
    """(hist, total): the probabilities of all words after each history of a model, which sum to 1 if it is sound.

    What a history doesn't list gets its back-off weight times the mass that the shorter history leaves: by inclusion, so
    that no vocabulary is multiplied with the histories. The empty history sums to 1 by itself.
    """
    seen = model.groupBy("n", "hist").agg(F.sum("f").alias("a"))
    low = model.select((F.col("n") + 1).alias("n"), F.col("hist").alias("_h"), "word", F.col("f").alias("_low"))
    b = model.where("n > 1").withColumn("_h", _shorter(F.col("hist"))).join(_large(low), ["n", "_h", "word"], "left").groupBy("n", "hist").agg(F.sum("_low").alias("b"))
    w = model.select((F.col("n") + 1).alias("n"), _joined("hist", "word").alias("hist"), "bow")
    t = seen.join(_large(b), ["n", "hist"], "left").join(_large(w), ["n", "hist"], "left")
    return t.select("n", "hist", (F.col("a") + F.when(F.col("n") > 1, F.coalesce("bow", F.lit(0.0)) * (1 - F.col("b"))).otherwise(F.lit(0.0))).alias("total"))


def prune(model: DataFrame, order: int, threshold: float, min_order: int = 2, keep=None) -> DataFrame:
    """Entropy pruning from the highest order down: an n-gram goes if leaving it out raises perplexity by less than
    `threshold` and no kept longer n-gram has it as history; back-off weights are computed anew at the end.

    `keep` materialises the model after each order (a function of a DataFrame), so that plans stay short.
    """
    keep = keep or (lambda df: df)
    model = keep(model.select("n", "hist", "word", "f", "bow"))
    for n in range(order, max(min_order - 1, 1), -1):
        top = model.where(F.col("n") == n).withColumn("_h", _shorter(F.col("hist")))
        q = top.select("n", "hist", "word", "f", "_h").withColumnsRenamed({"hist": "_full", "_h": "hist"})
        low = score(model, q.select("hist", "word").distinct(), n - 1)
        t = q.join(_large(low), ["hist", "word"]).withColumn("p_low", F.pow(F.lit(10.0), "log_p"))
        per = t.groupBy("_full").agg((1 - F.sum("f")).alias("num"), (1 - F.sum("p_low")).alias("den"))
        joint = history_probability(model, per.select(F.col("_full").alias("hist")).distinct(), n - 1)
        bow = model.where(F.col("n") == n - 1).select(_joined("hist", "word").alias("_full"), F.coalesce(F.log10("bow"), F.lit(0.0)).alias("old"))
        t = t.join(_large(per), "_full").join(_large(joint.withColumnRenamed("hist", "_full")), "_full").join(_large(bow), "_full", "left")
        new = F.log10(F.col("num") + F.col("f")) - F.log10(F.col("den") + F.col("p_low"))
        change = F.log10("p_low") + new - F.log10("f")
        entropy = -F.pow(F.lit(10.0), "joint") * (F.col("f") * change + F.col("num") * (new - F.coalesce("old", F.lit(0.0))))
        gone = t.where((F.pow(F.lit(10.0), entropy) - 1 < threshold) & F.lit(threshold > 0)).select(F.lit(n).alias("n"), F.col("_full").alias("hist"), "word")
        needed = model.where(F.col("n") == n + 1).select("hist").distinct().withColumnRenamed("hist", "_g")
        gone = gone.withColumn("_g", _joined("hist", "word")).join(_large(needed), "_g", "left_anti").drop("_g")
        model = keep(model.join(_large(gone), ["n", "hist", "word"], "left_anti"))
    return backoffs(model.drop("bow"), order)


def history_probability(model: DataFrame, histories: DataFrame, order: int) -> DataFrame:
    """(hist, joint): log10 probability of a history by the chain rule; a lone start symbol counts as the end symbol."""
    t = histories.withColumn("w", F.split("hist", " "))
    t = t.select("hist", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("k"))
    word = F.get("w", F.col("k") - 1)
    word = F.when((F.col("k") == 1) & (word == BOS), F.lit(EOS)).otherwise(word)
    q = t.select(F.col("hist").alias("_full"), F.array_join(F.slice("w", F.lit(1), F.col("k") - 1), " ").alias("hist"), word.alias("word"))
    return score(model, q, order).groupBy(F.col("_full").alias("hist")).agg(F.sum("log_p").alias("joint"))
