"""Mixing sources to target weights, by a budget of tokens that flows down a domain - language - source tree.

The root's budget is split among its children by weight, theirs among their children, down to the
leaves.  No node gets more than its tokens times ``max_epochs``; what it can't take goes to its siblings, by
weight, and only what all siblings together can't take is left to the node above, which has
taken that into account when it split (a node's capacity is the sum of its leaves').

A leaf's documents are read in seeded epochs: epoch e goes through all of them in the order of a hash of
(seed, e, id, text).  The leaf's selection is the shortest prefix of epoch 0, epoch 1, ... that
holds its budget: whole epochs, then documents up to a cut.  The cut is one row for each
leaf, found from token sums of hash ranges and a look into the range where the budget ends;
so no leaf, however large, is ever sorted or gathered as a whole, and selecting is a filter.

The text of the document where the cut falls is cut itself, after the last of its tokens that the budget wants.

A token is a word ``[^\\x20\\x09-\\x0D]+``.  The driver holds one row per leaf; more than ``max_leaves`` raise an error.

Defined results: null domain, language or source count as ``unknown``; null and empty texts have no tokens, and
are taken with the epoch they stand in; a leaf without tokens gives nothing; weights that aren't
named are ``default_weight``; repeated rows are taken together when the cut falls on them, each cut alike; extra columns
are passed on, but for those of the names that ``mix`` adds, which are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.shared import materialize

LEVELS = ("mix_domain", "mix_lang", "mix_source")


@dataclass(frozen=True)
class MixPlan:
    """Weights by path: ("web",), ("web", "en"), ("web", "en", "src0"); "*" stands for any name."""

    weights: Mapping[tuple[str, ...], int] = field(default_factory=dict)
    default_weight: int = 1
    share: float = 1.0  # of all tokens there are
    max_epochs: int = 4
    seed: int = 7
    max_leaves: int = 100_000

    def weight(self, path: tuple[str, ...]) -> int:
        for p in (path, ("*", *path[1:]), (*path[:1], "*", *path[2:]), ("*", "*", *path[2:])):
            if len(p) == len(path) and p in self.weights:
                return self.weights[p]
        return self.default_weight


def split_budget(amount: int, children: list[tuple[str, int, int]]) -> dict[str, int]:
    """``amount`` among (name, weight, capacity), by weight, nobody above capacity, what is left over to the others."""
    got = {name: 0 for name, _, _ in children}
    open_ = sorted((c for c in children if c[1] > 0 and c[2] > 0), key=lambda c: c[0])
    while amount > 0 and open_:
        total = sum(w for _, w, _ in open_)
        full = [c for c in open_ if amount * c[1] >= (c[2] - got[c[0]]) * total]
        if full:
            for name, _, capacity in full:
                amount -= capacity - got[name]
                got[name] = capacity
            open_ = [c for c in open_ if c not in full]
            continue
        shares = [(name, amount * w // total, amount * w % total) for name, w, _ in open_]
        left = amount - sum(s for _, s, _ in shares)
        extra = {name for name, _, _ in sorted(shares, key=lambda s: (-s[2], s[0]))[:left]}
        for name, s, _ in shares:
            got[name] += s + (name in extra)
        amount = 0
    return got


def leaf_budgets(leaves: dict[tuple[str, str, str], int], plan: MixPlan) -> dict[tuple[str, str, str], int]:
    """Tokens to take from each leaf, given the tokens it has."""

    def down(amount: int, path: tuple[str, ...], inside: dict[tuple[str, ...], int]) -> dict[tuple[str, ...], int]:
        if len(path) == len(LEVELS):
            return {path: amount}
        names = sorted({leaf[len(path)] for leaf in inside})
        groups = {n: {leaf: t for leaf, t in inside.items() if leaf[len(path)] == n} for n in names}
        shares = split_budget(amount, [(n, plan.weight((*path, n)), sum(g.values()) * plan.max_epochs) for n, g in groups.items()])
        out: dict[tuple[str, ...], int] = {}
        for n, g in groups.items():
            out |= down(shares[n], (*path, n), g)
        return out

    return down(int(sum(leaves.values()) * plan.share), (), dict(leaves))


def _keyed(docs: DataFrame, domain: Column) -> DataFrame:
    """``docs`` with the leaf, the text's hash (tie) and the number of tokens."""
    known = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    return docs.withColumns({
        LEVELS[0]: known(domain), LEVELS[1]: known(F.col("lang")), LEVELS[2]: known(F.col("source")),
        "mix_tie": F.coalesce(F.xxhash64("text"), F.lit(0)),
    })


def n_tokens(text: Column) -> Column:
    spaced = F.trim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " "))
    return F.when(text.isNull() | (spaced == ""), 0).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1).cast("long")


def _order(plan: MixPlan, epoch: Column) -> Column:
    """Place of a document in an epoch: a number of 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(plan.seed), epoch, F.col("doc_id"), F.col("mix_tie")), 1)


def cuts(base: DataFrame, plan: MixPlan) -> DataFrame:
    """For each leaf: epochs taken whole, and the last (place, doc_id, tie) taken of the epoch after them."""
    spark = base.sparkSession
    sums = base.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    rows = sums.limit(plan.max_leaves + 1).collect()
    if len(rows) > plan.max_leaves:
        raise ValueError(f"more than {plan.max_leaves} leaves")
    have = {tuple(r[c] for c in LEVELS): int(r["t"] or 0) for r in rows}
    budget = leaf_budgets(have, plan)
    table = [(*leaf, budget[leaf] // t if t else 0, budget[leaf] % t if t else 0) for leaf, t in have.items()]
    whole = spark.createDataFrame(table, f"{LEVELS[0]} string, {LEVELS[1]} string, {LEVELS[2]} string, whole long, rest long")
    bits = max(8, (max((r["n"] for r in rows), default=1) // 10_000).bit_length())
    placed = base.join(F.broadcast(whole), list(LEVELS)).withColumn("place", _order(plan, F.col("whole"))).withColumn("range", F.shiftrightunsigned("place", 63 - bits))
    by_range = placed.where("rest > 0").groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    before = by_range.withColumn("before", F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("range")) - F.col("t"))
    ending = before.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("t") >= F.col("rest"))).select(*LEVELS, "range", "before")
    inner = placed.join(F.broadcast(ending), [*LEVELS, "range"])  # one range of a leaf
    start = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("place", F.col("doc_id").asc_nulls_first(), "mix_tie").rowsBetween(Window.unboundedPreceding, -1))
    last = inner.withColumn("start", F.coalesce(start, F.col("before"))).where(F.col("start") < F.col("rest"))
    key = F.struct("place", "doc_id", "mix_tie")
    cut = last.groupBy(*LEVELS).agg(F.max(key).alias("cut"), F.max_by(F.col("rest") - F.col("start"), key).alias("cut_tokens"))
    return whole.join(cut, list(LEVELS), "left")


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), 0), F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame, plan: MixPlan, domain: Column) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, ...) once for each epoch that takes them: with mix_domain, mix_epoch, n_tokens, take_tokens.

    ``domain``: a source's domain, by the columns of ``docs``.  take_tokens is n_tokens but for the last document of a leaf, of which
    the budget may want a first part only; its text is cut to that.
    """
    docs = docs.drop(*LEVELS, "mix_tie", "mix_epoch", "n_tokens", "take_tokens")
    keyed = _keyed(docs, domain).withColumn("n_tokens", n_tokens(F.col("text")))
    base = materialize(keyed.select("doc_id", "mix_tie", *LEVELS, "n_tokens"), "mix")
    inner = "mix_cut"
    while inner in docs.columns:
        inner += "_"
    leaf = F.col(inner)
    cut = materialize(cuts(base, plan), "cuts").select(*LEVELS, F.struct("whole", "cut", "cut_tokens").alias(inner))
    here = F.struct(_order(plan, leaf["whole"]).alias("place"), "doc_id", "mix_tie")
    part = leaf["cut"].isNotNull() & (here <= leaf["cut"])
    epochs = F.sequence(F.lit(0).cast("long"), leaf["whole"] - F.when(part, 0).otherwise(1))
    out = keyed.join(F.broadcast(cut), list(LEVELS)).where((leaf["whole"] > 0) | part).withColumn("mix_epoch", F.explode(epochs))  # one row per leaf, max_leaves at most
    last = (F.col("mix_epoch") == leaf["whole"]) & (here == leaf["cut"])
    out = out.withColumn("take_tokens", F.when(last, F.least(leaf["cut_tokens"], "n_tokens")).otherwise(F.col("n_tokens")))
    out = out.withColumn("text", F.when(F.col("take_tokens") < F.col("n_tokens"), first_words(F.col("text"), F.col("take_tokens"))).otherwise(F.col("text")))
    return out.select(*docs.columns, LEVELS[0], "mix_epoch", "n_tokens", "take_tokens")
