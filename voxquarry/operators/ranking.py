"""N-best lists, CTC collapse, rescoring, phrase boosting, keywords."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxquarry.scratch import materialise


def collapse(tokens: Column, blank: int = 0) -> Column:
    """CTC: runs of a token become one, then blanks go."""
    kept = F.filter(F.transform(tokens, lambda x, i: F.struct(x.alias("t"), F.coalesce(F.get(tokens, i - 1), F.lit(-1)).alias("p"), i.alias("i"))), lambda s: (s["i"] == 0) | (s["t"] != s["p"]))
    return F.filter(F.transform(kept, lambda s: s["t"]), lambda t: t != blank)


def prefix_beam(frames: np.ndarray, beam: int = 8, blank: int = 0) -> list[tuple[tuple[int, ...], float]]:
    """Prefixes of (frames, symbols) log probabilities with their total log probability, best first; equal prefixes are merged."""
    add = np.logaddexp
    hyps = {(): (0.0, -np.inf)}
    for row in frames:
        new: dict[tuple[int, ...], list[float]] = {}

        def put(p, b, nb, new=new):
            old = new.setdefault(p, [-np.inf, -np.inf])
            old[0], old[1] = add(old[0], b), add(old[1], nb)

        for p, (b, nb) in hyps.items():
            total = add(b, nb)
            put(p, total + row[blank], nb + row[p[-1]] if p else -np.inf)
            for s in np.argsort(-row)[: beam + 1]:
                if s != blank:
                    put((*p, int(s)), -np.inf, (b if p and p[-1] == s else total) + row[s])
        hyps = dict(sorted(((p, tuple(v)) for p, v in new.items()), key=lambda x: -add(*x[1]))[:beam])
    return [(p, float(add(*v))) for p, v in hyps.items() if add(*v) > -np.inf]


def rescore(nbest: DataFrame, keys: list[str], path: str, scores: dict[str, list[float]], base: str = "am") -> DataFrame:
    """Best path for each combination of weights: base + sum of weight * score, ties to the smaller path. The weights are
    short lists that the caller sets."""
    t = nbest
    for name, values in scores.items():
        t = t.withColumn(f"w_{name}", F.explode(F.array(*[F.lit(float(v)) for v in values])))
    total = F.col(base)
    for name in scores:
        total = total + F.col(f"w_{name}") * F.col(name)
    weights = [f"w_{n}" for n in scores]
    g = t.withColumn("_t", total).groupBy(*keys, *weights).agg(F.max(F.struct(F.col("_t"), -F.col(path))).alias("b"))
    return g.select(*keys, *weights, (-F.col("b.col2")).alias(path), F.col("b._t").alias("score"))


def top_k(df: DataFrame, keys: list[str], score: Column, k: int, tie: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(score.desc(), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class PhraseGraph:
    """Bonus scores for phrases while a sequence is read: a trie with failure links.

    A shared node has the largest token score of its phrases. Leaving a path takes its pending bonus back; the end of a
    phrase pays the scores of all phrases that end there (`strict`), or of the longest and starts anew.
    """

    def __init__(self, phrases: list[tuple], score: float = 1.0, scores: list[float] | None = None):
        self.next: list[dict] = [{}]
        self.token_score, self.node_score, self.end, self.fail, self.out, self.pay = [0.0], [0.0], [False], [0], [None], [0.0]
        for k, phrase in enumerate(phrases):
            own = (scores[k] if scores else 0.0) or score
            at = 0
            for j, token in enumerate(phrase):
                if token not in self.next[at]:
                    self.next[at][token] = len(self.next)
                    self.next.append({})
                    for column, value in ((self.token_score, 0.0), (self.node_score, 0.0), (self.end, False), (self.fail, 0), (self.out, None), (self.pay, 0.0)):
                        column.append(value)
                child = self.next[at][token]
                self.token_score[child] = max(self.token_score[child], own)
                self.node_score[child] = self.node_score[at] + self.token_score[child]
                self.end[child] = self.end[child] or j == len(phrase) - 1
                at = child
        queue = deque([0])
        while queue:
            at = queue.popleft()
            for token, child in self.next[at].items():
                f = self.fail[at]
                while at and token not in self.next[f] and f:
                    f = self.fail[f]
                self.fail[child] = self.next[f][token] if at and token in self.next[f] else 0
                f = self.fail[child]
                self.out[child] = f if self.end[f] else self.out[f]
                queue.append(child)
                below = self.pay[self.out[child]] if self.out[child] is not None else 0.0
                self.pay[child] = (self.node_score[child] if self.end[child] else 0.0) + below

    def step(self, state: int, token, strict: bool = True) -> tuple[float, int, int | None]:
        """(score, state, state of the longest phrase that ends here or None)."""
        at = state
        while token not in self.next[at] and at:
            at = self.fail[at]
        new = self.next[at].get(token, 0)
        gain = self.token_score[new] if token in self.next[state] else self.node_score[new] - self.node_score[state]
        hit = new if self.end[new] else self.out[new]
        if not strict and hit is not None:
            return gain + self.node_score[hit] - self.node_score[new], 0, hit
        return gain + self.pay[new], new, hit

    def total(self, tokens, strict: bool = True) -> float:
        """Score of a whole sequence; the pending bonus of an unfinished phrase is taken back at the end."""
        state = total = 0
        for t in tokens:
            gain, state, _ = self.step(state, t, strict)
            total += gain
        return total - self.node_score[state]

    def spots(self, tokens) -> list[tuple[int, int]]:
        """(end position, state) wherever a phrase ends."""
        state, out = 0, []
        for i, t in enumerate(tokens):
            _, state, hit = self.step(state, t)
            if hit is not None:
                out.append((i, hit))
        return out


def boost(df: DataFrame, tokens: str, phrases: list[tuple], score: float = 1.0, strict: bool = True) -> Column:
    """Bonus of each token array under a list of phrases, which the caller bounds; the automaton is built once a worker."""
    held = df.sparkSession.sparkContext.broadcast(PhraseGraph(phrases, score))

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: float(held.value.total(list(t), strict)) if t is not None else None)

    return run(F.col(tokens))


def keywords(df: DataFrame, keys: list[str], tokens: str, scores: str, phrases: list[tuple], threshold: float, trailing: int = 0, blank: int = 0) -> DataFrame:
    """(keys, phrase, end): phrases found whose mean token score reaches the threshold and that `trailing` blanks follow."""
    graph = PhraseGraph(phrases)
    ends = {}
    for k, p in enumerate(phrases):
        at = 0
        for t in p:
            at = graph.next[at][t]
        ends[at] = k
    held = df.sparkSession.sparkContext.broadcast((graph, ends, [len(p) for p in phrases]))

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("phrase", T.LongType()), T.StructField("end", T.LongType())])))
    def run(tok: pd.Series, sc: pd.Series) -> pd.Series:
        g, ends, lengths = held.value
        out = []
        for t, s in zip(tok, sc, strict=True):
            real = [i for i, x in enumerate(t) if x != blank]
            hits = []
            for j, state in g.spots([t[i] for i in real]):
                k = ends[state]
                own = real[j - lengths[k] + 1 : j + 1]
                rest = list(t[real[j] + 1 : real[j] + 1 + trailing])
                if np.mean([s[i] for i in own]) >= threshold and len(rest) == trailing and all(x == blank for x in rest):
                    hits.append({"phrase": k, "end": int(real[j])})
            out.append(hits)
        return pd.Series(out, dtype=object)

    t = df.select(*keys, F.explode(run(F.col(tokens), F.col(scores))).alias("h"))
    return t.select(*keys, "h.phrase", "h.end")


def state_costs(arcs: DataFrame, backoff: DataFrame, states: DataFrame, token: str, rounds: int) -> DataFrame:
    """(utt, state, cost): least cost of reading a token from a set of states, over back-off arcs; a min-plus step each round.

    states (utt, state, cost, token), arcs (src, token, dst, cost), backoff (src, dst, cost); `rounds` is the model's order.
    """
    reach = states
    for _ in range(rounds):
        down = reach.join(backoff.select(F.col("src").alias("state"), "dst", F.col("cost").alias("_c")), "state").select("utt", F.col("dst").alias("state"), (F.col("cost") + F.col("_c")).alias("cost"), token)
        reach = reach.unionByName(down).groupBy("utt", "state", token).agg(F.min("cost").alias("cost"))
    a = arcs.select(F.col("src").alias("state"), token, "dst", F.col("cost").alias("_c"))
    return reach.join(a, ["state", token]).groupBy("utt", F.col("dst").alias("state")).agg(F.min(F.col("cost") + F.col("_c")).alias("cost"))


def prefix_beams(utterances: DataFrame, keys: list[str], frames: str, beam: int = 8, blank: int = 0, best: int | None = None) -> DataFrame:
    """(keys, rank, prefix, log_p): the prefixes of each utterance's array of frames of log probabilities, best first from rank 1,
    all of the beam or the `best` ones. Utterances of an Arrow batch go frame by frame; null frames have no rows, none at
    all the empty prefix."""
    out = T.StructType([utterances.schema[k] for k in keys] + [T.StructField("rank", T.IntegerType()), T.StructField("prefix", T.ArrayType(T.IntegerType())), T.StructField("log_p", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for *own, f in pdf[[*keys, frames]].itertuples(index=False):
                found = [] if f is None else prefix_beam(np.array([list(r) for r in f], float), beam, blank)
                rows += [(*own, k, list(p), x) for k, (p, x) in enumerate(found[:best], 1)]
            yield pd.DataFrame(rows, columns=out.names)

    return utterances.select(*keys, frames).mapInPandas(run, out)


def read_tokens(arcs: DataFrame, backoff: DataFrame, tokens: DataFrame, start: str, rounds: int, steps: int) -> DataFrame:
    """(utt, cost): least cost of reading each utterance's tokens (utt, pos, token) from the start state, over all back-off paths;
    null where no path reads them. A step of min-plus joins for each of at most `steps` positions; the states between are written."""
    utts = materialise(tokens.groupBy("utt").agg((F.max("pos") + 1).alias("n")), "utterances")
    states = utts.select("utt", F.lit(start).alias("state"), F.lit(0.0).alias("cost"))
    ends = []
    for k in range(steps):
        here = states.join(tokens.where(F.col("pos") == k).select("utt", "token"), "utt")
        states = materialise(state_costs(arcs, backoff, here, "token", rounds), "states")
        ends.append(states.join(utts.where(F.col("n") == k + 1).select("utt"), "utt").groupBy("utt").agg(F.min("cost").alias("cost")))
    out = ends[0]
    for e in ends[1:]:
        out = out.unionByName(e)
    return utts.select("utt").join(out, "utt", "left")
