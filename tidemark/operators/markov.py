"""Token policies as smoothed Markov chains: counts, log-likelihood ratios, cross-entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .sequences import order


def steps(tokens: DataFrame, by: list[str], token: str = "token", lags: int = 1) -> DataFrame:
    """(…, prev, next): each transition once; `lags` tokens make the state."""
    w = order(by)
    state = F.concat_ws(",", *(F.lag(token, k).over(w) for k in range(lags, 0, -1)))
    full = F.lag(token, lags).over(w).isNotNull()
    return tokens.withColumns({"prev": F.when(full, state), "next": F.col(token).cast("int")}).filter(F.col("prev").isNotNull())


def fit(pairs: DataFrame, pop: list[str], symbols: int, smoothing: float = 1.0) -> DataFrame:
    """(pop, prev, next, logp): additive smoothing over `symbols`; unseen pairs take the state's rest, `floor`."""
    n = pairs.groupBy(*pop, "prev", "next").agg(F.count(F.lit(1)).alias("n"))
    total = pairs.groupBy(*pop, "prev").agg(F.count(F.lit(1)).alias("t"))
    logp = F.log((F.col("n") + smoothing) / (F.col("t") + smoothing * symbols))
    return n.join(total, [*pop, "prev"]).select(*pop, "prev", "next", logp.alias("logp"), F.log(smoothing / (F.col("t") + smoothing * symbols)).alias("floor"))


def score(pairs: DataFrame, policy: DataFrame, symbols: int, name: str) -> DataFrame:
    """Adds `name`: the log probability of each transition under one policy (a table of states x symbols rows)."""
    exact = policy.select("prev", "next", F.col("logp").alias(f"_{name}"))
    state = policy.select("prev", F.col("floor").alias(f"_{name}_floor")).distinct()
    joined = pairs.join(F.broadcast(exact), ["prev", "next"], "left").join(F.broadcast(state), "prev", "left")
    unseen = F.lit(1.0 / symbols)
    return joined.withColumn(name, F.coalesce(F.col(f"_{name}"), F.col(f"_{name}_floor"), F.log(unseen))).drop(f"_{name}", f"_{name}_floor")


def ratio(pairs: DataFrame, by: list[str], a: DataFrame, b: DataFrame, symbols: int) -> DataFrame:
    """(by, llr, nll_a): mean log p_a - mean log p_b; an account of one token has no transition and no row."""
    s = score(score(pairs, a, symbols, "la"), b, symbols, "lb")
    return s.groupBy(*by).agg((F.avg("la") - F.avg("lb")).alias("llr"), (-F.avg("la")).alias("nll_a"))


def moves(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, prev, next, n): each transition of an account once, with its count."""
    return pairs.groupBy(*by, "prev", "next").agg(F.count(F.lit(1)).alias("n"))


def fold_ratios(counts: DataFrame, pop: str, case: str, control: str, symbols: int, k: int) -> DataFrame:
    """(repeat, fold, pop, user, llr, z) of accounts held out in (repeat, fold); `counts` are moves with both columns.

    A fold's policies come from all counts less its own, so no account is copied to its k - 1 training sets. z centres
    by the training controls under the same policies. Policies have states x symbols rows for each repeat and fold."""
    own = counts.groupBy("repeat", "fold", "prev", "next").agg(*(F.sum(F.when(F.col(pop) == p, F.col("n")).otherwise(0)).alias(c) for c, p in (("a", case), ("b", control))))
    every = own.groupBy("repeat", "prev", "next").agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"))
    every = every.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    rest = every.join(own, ["repeat", "fold", "prev", "next"], "left")
    rest = rest.select("repeat", "fold", "prev", "next", *((F.col(f"_{c}") - F.coalesce(c, F.lit(0))).alias(c) for c in "ab"))
    totals = rest.groupBy("repeat", "fold", "prev").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    logp = lambda n, t: F.log((F.col(n) + 1.0) / (F.col(t) + symbols))
    law = rest.join(totals, ["repeat", "fold", "prev"]).select("repeat", F.col("fold").alias("law"), "prev", "next", (logp("a", "ta") - logp("b", "tb")).alias("ratio"))
    law = cut(law)
    s = counts.join(F.broadcast(law), ["repeat", "prev", "next"]).groupBy("repeat", "law", "fold", pop, "user").agg((F.sum(F.col("n") * F.col("ratio")) / F.sum("n")).alias("llr"))
    s = cut(s)  # read for the held-out accounts and for the controls
    reference = s.filter((F.col("fold") != F.col("law")) & (F.col(pop) == control)).groupBy("repeat", "law").agg(F.avg("llr").alias("_mu"), F.stddev_pop("llr").alias("_sd"))
    held = s.filter(F.col("fold") == F.col("law")).join(F.broadcast(reference), ["repeat", "law"])
    return held.select("repeat", "fold", pop, "user", "llr", ((F.col("llr") - F.col("_mu")) / (F.col("_sd") + 1e-9)).alias("z"))


def law_ratios(counts: DataFrame, pop: str, case: str, control: str, symbols: int) -> DataFrame:
    """(fold, pop, user, llr, z) of accounts held out of each law; `counts` are moves with `fold`, the account's own,
    and `law`, the fold whose training set made the tokens: every account has moves under every law.

    As `fold_ratios`, for tokens that differ from fold to fold."""
    train = counts.filter(F.col("fold") != F.col("law"))
    n = train.groupBy("law", "prev", "next").agg(*(F.sum(F.when(F.col(pop) == p, F.col("n")).otherwise(0)).alias(c) for c, p in (("a", case), ("b", control))))
    t = n.groupBy("law", "prev").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    part = lambda n, t: F.log((F.coalesce(n, F.lit(0)) + 1.0) / (F.coalesce(t, F.lit(0)) + symbols))
    # a row for each law, state and symbol
    s = counts.join(F.broadcast(cut(n)), ["law", "prev", "next"], "left").join(F.broadcast(cut(t)), ["law", "prev"], "left")
    s = cut(s.groupBy("law", "fold", pop, "user").agg((F.sum(F.col("n") * (part("a", "ta") - part("b", "tb"))) / F.sum("n")).alias("llr")))
    reference = s.filter((F.col("fold") != F.col("law")) & (F.col(pop) == control)).groupBy("law").agg(F.avg("llr").alias("_mu"), F.stddev_pop("llr").alias("_sd"))
    held = s.filter(F.col("fold") == F.col("law")).join(F.broadcast(reference), "law")
    return held.select("fold", pop, "user", "llr", ((F.col("llr") - F.col("_mu")) / (F.col("_sd") + 1e-9)).alias("z"))


def log_likelihoods(moved: DataFrame, train: DataFrame, pop: str, names: list[str], by: list[str], symbols: int) -> DataFrame:
    """(by, law, ll): the mean log probability of each account's moves under every named population's policy."""
    n = train.groupBy(F.col(pop).alias("law"), "prev", "next").agg(F.sum("n").alias("_n"))
    t = n.groupBy("law", "prev").agg(F.sum("_n").alias("_t"))
    each = moved.withColumn("law", F.explode(F.array(*map(F.lit, names))))
    each = each.join(F.broadcast(n), ["law", "prev", "next"], "left").join(F.broadcast(t), ["law", "prev"], "left")
    logp = F.log((F.coalesce("_n", F.lit(0)) + 1.0) / (F.coalesce("_t", F.lit(0)) + symbols))
    return each.groupBy(*by, "law").agg((F.sum(F.col("n") * logp) / F.sum("n")).alias("ll"))


# ---- contexts of variable length
def suffixes(tokens: DataFrame, by: list[str], depth: int, token: str = "token") -> DataFrame:
    """Adds `next` and c0 .. c<depth>: the last d tokens before each, joined by commas; null where there are fewer."""
    w = order(by)
    past = [F.lag(token, k).over(w) for k in range(1, depth + 1)]
    contexts = {f"c{d}": F.when(past[d - 1].isNotNull(), F.concat_ws(",", *reversed(past[:d]))) if d else F.lit("") for d in range(depth + 1)}
    return tokens.withColumns(contexts | {"next": F.col(token).cast("int")})


def context_tree(rows: DataFrame, by: list[str], depth: int, symbols: int, held: Column | None = None, scored: Column | None = None) -> list[DataFrame]:
    """For each length d from 0 the table (by, suffix, next, n, total, kinds, kept, own, up, p) of a context tree.

    A context of `total` tokens of `kinds` different ones gives the next token (n + kinds * up) / (total + kinds): as
    many counts as it has kinds escape to the law `up` of the context without its oldest token, and at last to the
    uniform law. With `held` (boolean) those rows are not counted; a context then stays only if its parent does and
    its law makes the held rows that meet it likelier than the parent's; where it does not, p is the parent's: own and
    up are the two.

    Rows that `scored` (boolean) names are neither counted nor held, but their contexts and symbols have rows too, with
    further columns: `met`, how many of them there are, and `ends`, how many of these have no longer context within
    `depth`. So `nats` scores them without a join.

    Rows are read once, to counts of their longest contexts, which all lengths are summed from. Each length takes an
    aggregate, a join and windows over the symbols of a context."""
    mark, seen = F.lit(False) if held is None else held, F.lit(True) if scored is None else ~scored
    contexts = [F.col(f"c{d}") for d in range(depth + 1)]
    length = sum((c.isNotNull().cast("int") for c in contexts[1:]), F.lit(0))
    counts = [F.count_if(seen & ~mark).alias("n"), F.count_if(seen & mark).alias("v")] + ([] if scored is None else [F.count_if(scored).alias("met")])
    cells = cut(rows.groupBy(*by, length.alias("_length"), F.coalesce(*reversed(contexts)).alias("_context"), "next").agg(*counts))
    out, around = [], Window.partitionBy(*by, "suffix")
    for d in range(depth + 1):
        suffix = F.substring_index("_context", ",", -d) if d else F.lit("")
        ends = [] if scored is None else [F.sum("met").alias("met"), F.sum(F.when(F.col("_length") == d, F.col("met")).otherwise(0)).alias("ends")]
        x = cells.filter(F.col("_length") >= d).groupBy(*by, suffix.alias("suffix"), "next").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), *ends)
        if d:
            parent = out[-1].select(*by, F.col("suffix").alias("_parent"), "next", F.col("p").alias("_up"), F.col("kept").alias("_above"))
            x = x.withColumn("_parent", F.regexp_replace("suffix", "^[^,]*,?", "")).join(parent, [*by, "_parent", "next"])
        else:
            x = x.withColumns({"_up": F.lit(1.0 / symbols), "_above": F.lit(True)})
        x = x.withColumns({"total": F.sum("n").over(around), "kinds": F.count_if(F.col("n") > 0).over(around)})
        x = x.withColumn("_own", F.when(F.col("total") > 0, (F.col("n") + F.col("kinds") * F.col("_up")) / (F.col("total") + F.col("kinds"))).otherwise(F.col("_up")))
        stays = F.col("_above") & (F.col("total") > 0)
        if held is not None and d:
            x = x.withColumn("_gains", F.sum(F.col("v") * (F.log("_own") - F.log("_up"))).over(around) > 0)
            stays = stays & F.col("_gains")
        x = x.withColumn("kept", stays)
        own, up = F.col("_own").alias("own"), F.col("_up").alias("up")
        p = F.when(F.col("kept"), F.col("_own")).otherwise(F.col("_up")).alias("p")
        out.append(cut(x.select(*by, "suffix", "next", "n", "total", "kinds", "kept", own, up, p, *(() if scored is None else ("met", "ends")))))
    return out


def nats(tree: list[DataFrame], by: list[str], fixed: tuple[int, ...] = ()) -> DataFrame:
    """(by, tree, order_<d>): mean nats a token of the rows that `context_tree` had to score, under the tree, and for
    each d of `fixed` (0 or 1) under the same counts at this depth, where no held rows judge a context.

    A row is met with at the longest of its contexts, where p is its probability: sums of the tables alone. A key of
    no such rows has no row here."""

    def part(t: DataFrame, n: Column, name: str, p: str) -> DataFrame:
        return t.select(*by, F.lit(name).alias("law"), n.alias("n"), (n * F.log(p)).alias("l")).filter("n > 0")

    parts = [part(t, F.col("ends"), "tree", "p") for t in tree]
    # at a fixed depth a row with fewer tokens before it has them all as context
    parts += [part(t, F.col("met" if d == k else "ends"), f"order_{k}", "own") for k in fixed for d, t in enumerate(tree[: k + 1])]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    means = every.groupBy(*by, "law").agg((-F.sum("l") / F.sum("n")).alias("m"))
    return means.groupBy(*by).agg(*(F.max(F.when(F.col("law") == c, F.col("m"))).alias(c) for c in ("tree", *(f"order_{k}" for k in fixed))))


def context_score(rows: DataFrame, tree: list[DataFrame], on: list[str], symbols: int, name: str) -> DataFrame:
    """Adds `name`: the log probability of each row's `next` under the tree, from the shortest context to the longest
    that is kept. Tables of lengths 0 and 1 are broadcast (symbols squared rows a law at most), longer ones joined."""
    x = rows.withColumn(name, F.lit(1.0 / symbols))
    for d, law in enumerate(tree):
        small = F.broadcast if d < 2 else (lambda t: t)
        nodes = law.filter("kept").select(*on, F.col("suffix").alias(f"c{d}"), F.col("total").alias("_total"), F.col("kinds").alias("_kinds")).distinct()
        pairs = law.filter("kept").select(*on, F.col("suffix").alias(f"c{d}"), "next", F.col("n").alias("_n"))
        x = x.join(small(nodes), [*on, f"c{d}"], "left").join(small(pairs), [*on, f"c{d}", "next"], "left")
        longer = (F.coalesce("_n", F.lit(0)) + F.col("_kinds") * F.col(name)) / (F.col("_total") + F.col("_kinds"))
        x = x.withColumn(name, F.when(F.col("_total").isNotNull(), longer).otherwise(F.col(name))).drop("_total", "_kinds", "_n")
    return x.withColumn(name, F.log(name))
