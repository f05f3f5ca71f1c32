"""Secret scans with corpus-wide ownership frequency. DataFrame functions only.

Every text is scanned for base patterns and for generic high-entropy tokens. The hash of each candidate's value is
counted over the corpus by distinct repositories (documents) and distinct owners (sources). A value of several owners,
or of very many repositories of one, is a widely copied example; one that few repositories of a single owner hold looks
live. Base findings are always reported, with their counts; a generic token is only reported if it looks live.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limpid.llm.spark import discard, id_key, materialise

#: Kinds: (pattern, group of the value, least length of the value). Fixed values of the contract, but for generic.
KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "generic": (r"[A-Za-z0-9_-]{24,}", 0, 24),
}
BASE = ("assign", "access", "hex")


def _pieces(text: Column, number: int) -> Column:
    """A kind's matches and what stands before each, in order; the last piece has no match."""
    pattern, group, _ = [*KINDS.values()][number]
    p = F.lit(pattern)
    every = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"), F.regexp_extract_all(text, p, F.lit(group)).alias("value"))
    return F.struct(F.lit(number).alias("kind"), F.filter(every, lambda x: x["hit"].isNotNull()).alias("pieces"))


def _good(kind: Column, value: Column) -> Column:
    long_enough = reduce(lambda a, b: a | b, [(kind == i) & (F.char_length(value) >= least) for i, (_, _, least) in enumerate(KINDS.values())])
    mixed = value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]")
    return long_enough & ((kind < len(BASE)) | mixed)


def find_secrets(texts: DataFrame) -> DataFrame:
    """(doc, h, start, kind, end, sha) of each leftmost non-overlapping match, in code points; texts: (doc, h, text), each
    (doc, h) once. Places are running sums of the lengths of matches and gaps. Generic tokens that overlap a base finding
    are left out."""
    kinds = texts.select("doc", "h", F.explode(F.array(*[_pieces(F.col("text"), i) for i in range(len(KINDS))])).alias("k"))
    each = kinds.select("doc", "h", "k.kind", F.posexplode("k.pieces").alias("i", "p")).select("doc", "h", "kind", "i", "p.*")
    upto = Window.partitionBy("doc", "h", "kind").orderBy("i")
    ends = each.withColumn("end", F.sum(F.char_length("gap") + F.char_length("hit")).over(upto).cast("bigint"))
    found = ends.withColumn("start", F.col("end") - F.char_length("hit")).filter(_good(F.col("kind"), F.col("value")))
    is_base = F.col("kind") < len(BASE)
    before = Window.partitionBy("doc", "h").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy("doc", "h").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("reach", F.max(F.when(is_base, F.col("end"))).over(before)).withColumn("next", F.min(F.when(is_base, F.col("start"))).over(behind))
    overlapped = F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    return found.filter(is_base | ~overlapped).select("doc", "h", "start", "kind", "end", F.sha2(F.concat(name, F.lit(":"), F.col("value")), 256).alias("sha"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", owners: int = 2, repos: int = 10) -> DataFrame:
    """A row for each row of docs: the id and `findings`, sorted by start and kind:
    array of (start, kind, end, sha, n_repos, n_owners, live), kind being the place in KINDS.

    live: fewer than `owners` owners and fewer than `repos` repositories hold the value. Generic tokens are kept only if
    live and if no base finding overlaps them. A null text is empty. A null owner is an owner of its own, the same as an
    empty name; ids are whole numbers, and rows without one count as one repository. Rows that are equal in id and text
    are scanned once and each get the result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), id_key(id_col).alias("doc"), F.xxhash64(text).alias("h"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), text.alias("text"))
    hit = reduce(lambda a, b: a | b, [F.col("text").rlike(p) for p, _, _ in KINDS.values()])
    rows = materialise(rows.withColumn("text", F.when(hit, F.col("text"))), "secrets")  # texts without a match end here
    some = rows.filter("text is not null")
    found = materialise(find_secrets(some.select("doc", "h", "text").dropDuplicates(["doc", "h"])), "findings")
    held = found.select("doc", "h", "sha").distinct().join(some.select("doc", "h", "owner").distinct(), ["doc", "h"])
    # Written, so that the join has an exchange of its own on both sides and Spark can split a value that very many texts hold.
    spread = materialise(held.groupBy("sha").agg(F.count_distinct("doc").alias("n_repos"), F.count_distinct("owner").alias("n_owners")), "spread")
    live = (F.col("n_owners") < owners) & (F.col("n_repos") < repos)
    rated = found.join(spread, "sha").withColumn("live", live).filter((F.col("kind") < len(BASE)) | F.col("live"))
    entry = F.struct("start", "kind", "end", "sha", "n_repos", "n_owners", "live")
    per_row = materialise(rated.groupBy("doc", "h").agg(F.array_sort(F.collect_list(entry)).alias("findings")), "rated")
    discard(docs.sparkSession, found, spread)
    empty = F.array().cast(per_row.schema["findings"].dataType)
    return rows.select("id", "doc", "h").join(per_row, ["doc", "h"], "left").select(F.col("id").alias(id_col), F.coalesce("findings", empty).alias("findings"))


def spans(findings: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
