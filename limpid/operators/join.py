"""Enriching joins: a left row stays one row. Right rows are aggregated by key before the join."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpid.functions import numbers
from limpid.functions.fuzzy import compared
from limpid.functions.text import key
from limpid.operators.registry import Context, operator
from limpid.operators.similar import most_similar
from limpid.storage import written
from limpid.table import ORD, Table, q


def names_for(left: tuple[str, ...], copied: list[str], how: str, affix: str, names: dict[str, str] | None = None) -> dict[str, str | None]:
    """The output name of each copied column, which names may call otherwise; None: not copied. Names are made unique."""
    out: dict[str, str | None] = {}
    taken = set(left)
    for c in copied:
        name = own = (names or {}).get(c, c)
        if own in taken:
            if how == "skip":
                out[c] = None
                continue
            if not (how == "overwrite" and own in left and own not in out.values()):
                name = affix + own if how == "prefix" else own + affix
        while name in taken and not (name == own and how == "overwrite" and own in left):
            name += affix or "_"
        out[c] = name
        taken.add(name)
    return out


def pair_keys(pairs: list[dict]) -> tuple[list[Column], list[Column]]:
    return [key(q(p["left"]), p.get("normalize")) for p in pairs], [key(q(p["right"]), p.get("normalize")) for p in pairs]


def _keyed(t: Table, keys: list[Column]) -> DataFrame:
    return t.df.select("*", *[k.alias(f"__k{i}") for i, k in enumerate(keys)])


def _several(t: Table, c: str, rule: str, separator: str) -> Column:
    """What many rows of t become in one cell; numbers alone count, empty texts don't."""
    number = F.when(q(c) != "", numbers.strict(q(c))) if t.number(c) is None else t.number(c)
    match rule:
        case "sum" | "min" | "max":
            return numbers.exact({"sum": F.sum, "min": F.min, "max": F.max}[rule](number))
        case "concat":
            own = F.array_sort(F.collect_list(F.when(q(c) != "", F.struct(F.col(ORD).alias("o"), q(c).alias("v")))))
            return F.array_join(F.transform(own, lambda x: x["v"]), separator)
    raise ValueError(f"unknown rule {rule!r}")


def partners_of(right: Table, p: dict) -> DataFrame:
    """(__k<i>, __n, __v<i>): for each key of an exact join its number of right rows and its copied cells."""
    right.need(*p["copied"], *[x["right"] for x in p["pairs"]])
    theirs = [key(q(x["right"]), x.get("normalize")) for x in p["pairs"]]
    how, rules, sep = p.get("multiple", "first"), p.get("rules") or {}, p.get("separator", ", ")
    first = lambda c: F.min_by(q(c), F.col(ORD))
    many = {"first": first, "flag_conflict": lambda c: F.lit(""), "aggregate": lambda c: _several(right, c, rules.get(c, "concat"), sep)}[how]
    cells = [(first(c) if how == "first" else F.when(F.count("*") == 1, first(c)).otherwise(many(c))).alias(f"__v{i}") for i, c in enumerate(p["copied"])]
    return _keyed(right, theirs).groupBy(*[f"__k{i}" for i in range(len(theirs))]).agg(F.count("*").alias("__n"), *cells)


def join_partners(t: Table, p: dict, partners: DataFrame, ctx: Context) -> Table:
    """The table with the cells of partners_of()."""
    t.need(*[x["left"] for x in p["pairs"]])
    mine = [key(q(x["left"]), x.get("normalize")) for x in p["pairs"]]
    joined, n = _keyed(t, mine).join(partners, [f"__k{i}" for i in range(len(mine))], "left"), F.col("__n")
    joined = ctx.count(joined, unmatched=F.count_if(n.isNull()), ambiguous=F.count_if(n > 1), matchedAuto=F.count_if(n >= 1))
    joined = joined.filter(n.isNotNull()) if p.get("type", "left") == "inner" else joined
    return _copied(t, p, joined, lambda i: F.col(f"__v{i}"))


def _copied(t: Table, p: dict, joined: DataFrame, cell: Callable[[int], Column]) -> Table:
    """The table with the copied cells of its partners, empty where there is none."""
    names = names_for(t.columns, p["copied"], p.get("collision", "suffix"), p.get("affix", "_droite"), p.get("names"))
    return replace(t, df=joined).select(t.cells() | {n: F.coalesce(cell(i), F.lit("")) for i, n in enumerate(names.values()) if n})


@operator("enrich_join")
def enrich_join(t: Table, p: dict, ctx: Context) -> Table:
    """table, pairs [{left, right, normalize}], copied [columns], type left or inner, multiple (first, aggregate or
    flag_conflict), rules {column: sum, min, max or concat}, collision (prefix, suffix, overwrite or skip), affix, names {column: its name in the result};
    with fuzzy {..} see resolve()."""
    right, copied = ctx.table(p["table"]), p["copied"]
    t.need(*[x["left"] for x in p["pairs"]])
    right.need(*copied, *[x["right"] for x in p["pairs"]])
    if not p.get("fuzzy"):
        # Written, so that the join has an exchange of its own on both sides and Spark can split a very frequent key.
        return join_partners(t, p, written(partners_of(right, p), "partners"), ctx)
    joined, status = resolved(t, right, p, copied), F.col("status")
    found = status.isin(*MATCHED)
    joined = ctx.count(joined, unmatched=F.count_if(~found), ambiguous=F.count_if(status == "pending"), matchedAuto=F.count_if(status == "auto"), matchedManual=F.count_if(status.isin("manual", "forced")))
    return _copied(t, p, joined.filter(found) if p.get("type") == "inner" else joined, lambda i: F.when(found, F.col(f"__v{i}")))


def unmatched(t: Table, right: Table, pairs: list[dict], side: str = "left") -> Table:
    """Rows of one side without a partner."""
    mine, theirs = pair_keys(pairs)
    own, other = ((t, mine), (right, theirs)) if side == "left" else ((right, theirs), (t, mine))
    on = [f"__k{i}" for i in range(len(mine))]
    return replace(own[0], df=_keyed(*own).join(_keyed(*other).select(*on), on, "left_anti").select(ORD, *map(q, own[0].columns)))


def ambiguous(t: Table, right: Table, pairs: list[dict]) -> Table:
    """Left rows with more than one partner."""
    mine, theirs = pair_keys(pairs)
    on = [f"__k{i}" for i in range(len(mine))]
    often = written(_keyed(right, theirs).groupBy(*on).count().filter("count > 1").select(*on), "several")
    return replace(t, df=_keyed(t, mine).join(often, on, "left_semi").select(ORD, *map(q, t.columns)))




def match_counts(t: Table, right: Table, pairs: list[dict]) -> DataFrame:
    """One row: matched (exactly one partner), ambiguous, unmatched_left, unmatched_right."""
    mine, theirs = pair_keys(pairs)
    on = [f"__k{i}" for i in range(len(mine))]
    a = _keyed(t, mine).groupBy(*on).agg(F.count("*").alias("a"))
    b = _keyed(right, theirs).groupBy(*on).agg(F.count("*").alias("b"))
    both = a.join(b, on, "full")
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("bigint")
    return both.agg(total("a", F.col("b") == 1).alias("matched"), total("a", F.col("b") > 1).alias("ambiguous"), total("a", F.col("b").isNull()).alias("unmatched_left"), total("b", F.col("a").isNull()).alias("unmatched_right"))


#: Statuses under which a left row has its right row.
MATCHED = ("forced", "manual", "auto")


def resolve(t: Table, right: Table, p: dict) -> DataFrame:
    """(left_ord, right_ord, score, status) for each left row; see resolved()."""
    return resolved(t, right, p).select(F.col(ORD).alias("left_ord"), "right_ord", "score", "status")


def resolved(t: Table, right: Table, p: dict, copied: Iterable[str] = ()) -> DataFrame:
    """t's rows with right_ord, score, status and `__v<i>`, the right row's copied cells, by fuzzy matching in blocks.

    fuzzy: {left: [columns], right: [columns], tokens, high, low, decisions [{left, right, decision}], forced [{left,
    right}]}; the pairs of p are the blocks, left and right of decisions and forced pairs are keys as compared() gives
    them, or the texts these come from. status: forced, manual, auto, pending, rejected or no_candidate. The best
    candidate has the highest score, the first of equals; a decision counts for the best pair only, the last one on it; a
    forced pair, the last one for its left key, goes before all, to the first right row with its key, if there is one.
    """
    f = p["fuzzy"]
    tokens, high, low = f.get("tokens", True), f.get("high", 90), f.get("low", 65)
    mine, theirs = pair_keys(p["pairs"])
    on = [f"__k{i}" for i in range(len(mine))]
    both = lambda df, cols, name: df.withColumn(name, compared(F.concat_ws(" ", *map(q, cols)), tokens))
    left = both(_keyed(t, mine), f["left"], "__a")
    right_row = F.struct(F.col(ORD).alias("ord"), *[q(c).alias(f"v{i}") for i, c in enumerate(copied)])
    other = both(_keyed(right, theirs), f["right"], "__b").select("__b", *on, right_row.alias("r"))
    # Equal texts score alike: each pair of texts in a block is looked at once, its first right row stands for it.
    texts = other.groupBy(*on, F.col("__b").alias("b")).agg(F.min_by("r", "r.ord").alias("r"))
    best = most_similar(left.select(*on, F.col("__a").alias("a")).distinct(), texts, on)
    best = best.select(*on, F.col("a").alias("__a"), "score", F.col("b").alias("__b"), "r", "scored")
    out, spark, said = left.join(best, [*on, "__a"], "left"), t.df.sparkSession, F.lit(None).cast("string")
    if told := [(i, _key_text(d["left"]), _key_text(d["right"]), d["decision"]) for i, d in enumerate(f.get("decisions") or [])]:
        rows = spark.createDataFrame(told, "i int, l string, r string, said string").select("i", compared(F.col("l"), tokens).alias("__a"), compared(F.col("r"), tokens).alias("__b"), "said")
        out, said = out.join(rows.groupBy("__a", "__b").agg(F.max_by("said", "i").alias("said")), ["__a", "__b"], "left"), F.col("said")
    status = (
        F.when(F.col("r").isNull(), "no_candidate").when(said == "validated", "manual").when(said == "rejected", "rejected")
        .when(F.col("score") >= high, "auto").when(F.col("score") >= low, "pending").otherwise("rejected")
    )
    out = out.withColumn("status", status)
    if told := [(i, _key_text(d["left"]), _key_text(d["right"])) for i, d in enumerate(f.get("forced") or [])]:
        rows = spark.createDataFrame(told, "i int, l string, r string").select("i", compared(F.col("l"), tokens).alias("__a"), compared(F.col("r"), tokens).alias("__b"))
        rows = rows.groupBy("__a").agg(F.max_by("__b", "i").alias("__b"))
        rows = rows.join(other.groupBy("__b").agg(F.min_by("r", "r.ord").alias("forced")), "__b").select("__a", "forced")
        out, is_forced = out.join(rows, "__a", "left"), F.col("forced").isNotNull()
        out = out.withColumns({"r": F.coalesce("forced", "r"), "score": F.when(is_forced, 100).otherwise(F.col("score")), "status": F.when(is_forced, "forced").otherwise(F.col("status"))})
    return out.select(*map(q, t.df.columns), F.col("r.ord").alias("right_ord"), "score", "status", *[F.col(f"r.v{i}").alias(f"__v{i}") for i, _ in enumerate(copied)])


def _key_text(x) -> str:
    return " ".join(x) if isinstance(x, (list, tuple)) else str(x)


def fuzzy_keys(t: Table, columns: list[str], tokens: bool = True) -> DataFrame:
    """(ord, key) for each row: the key under which decisions and forced pairs name it."""
    t.need(*columns)
    return t.df.select(F.col(ORD).alias("ord"), compared(F.concat_ws(" ", *map(q, columns)), tokens).alias("key"))


def unmatched_right(t: Table, right: Table, p: dict) -> Table:
    """Right rows that no left row was given."""
    return never_given(right, resolved(t, right, p))


def never_given(right: Table, found: DataFrame) -> Table:
    """Right rows that no left row was given, by what resolved() found."""
    used = found.filter(F.col("status").isin(*MATCHED)).select(F.col("right_ord").alias(ORD))
    return replace(right, df=right.df.join(used, ORD, "left_anti"))
