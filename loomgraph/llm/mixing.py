"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only.

The token budget flows down a tree of domains, languages and sources. At each node it is shared out in proportion to
the children's weights; a child whose subtree can't supply its share (tokens times the epochs allowed) gives the
shortage back to its siblings, and only what a whole subtree lacks reaches the level above, since a subtree's capacity
is known before its parent shares out. Each leaf then takes whole epochs and a token-prefix of one more epoch, whose
order is a seeded hash. All budgets are whole numbers, so results are exact; what rounding down leaves (less than one
token a child) stays unspent.

A prefix is not found by sorting a leaf in one task: hash digits deal its rows to 4096 buckets, bucket sums are
accumulated, and only the bucket that the budget ends in is sorted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.common import fresh, written

#: Leaves of a tree up to this number are broadcast; beyond it they are joined by shuffle.
_BROADCAST_LEAVES = 20_000
WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Weights (whole numbers; 0 leaves a branch out), the budget as parts of the tokens there are, epochs and seed."""

    domain_of: dict = field(default_factory=dict)
    domains: dict = field(default_factory=dict)
    langs: dict = field(default_factory=dict)
    sources: dict = field(default_factory=dict)
    default_domain: str = "other"
    default_weight: int = 1
    numerator: int = 1
    denominator: int = 1
    max_epochs: int = 3
    seed: int = 11


#: The production mixture of the registered query.
PRODUCTION = Mix(
    domain_of={f"src{k}": d for d, ks in {"web": range(8), "books": range(8, 12), "code": range(12, 16), "forum": range(16, 20)}.items() for k in ks},
    domains={"web": 5, "books": 3, "code": 1, "forum": 1},
    langs={"en": 6, "fr": 2, "de": 1, "es": 1},
    sources={"src0": 4, "src9": 2},
)


def case_sql(column: str, values: dict, default) -> str:
    """A CASE over fixed values, the same text in Spark and in other SQL."""
    lit = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"CASE {column} {' '.join(f'WHEN {lit(k)} THEN {lit(v)}' for k, v in values.items())} ELSE {lit(default)} END" if values else lit(default)


def _share(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Add `alloc` to children (columns: parent, child, cap, w, budget of the parent) by exact water-filling."""
    big = lambda c: F.col(c).cast("decimal(38,0)")
    by = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    ordered = by.orderBy(F.col("cap") / F.col("w"), child)
    c = children.withColumn("_before", F.coalesce(F.sum("cap").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    c = c.withColumn("_weights", F.sum("w").over(ordered.rowsBetween(0, W.unboundedFollowing)))
    c = c.withColumn("_full", big("cap") * big("_weights") <= (big("budget") - big("_before")) * big("w"))
    c = c.withColumn("_left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(by), F.lit(0)))
    c = c.withColumn("_open", F.sum(F.when(~F.col("_full"), F.col("w"))).over(by))
    share = F.expr("CAST(_left AS DECIMAL(38,0)) * w DIV _open")
    return c.withColumn("alloc", F.when(F.col("_full"), F.col("cap")).otherwise(share).cast("long")).drop("_before", "_weights", "_full", "_left", "_open", "budget", "w")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Leaves (domain, lang, source, tokens) with `alloc`, the tokens that each is to give."""
    leaves = leaves.withColumn("cap", F.col("tokens") * mix.max_epochs)
    for column, weights in (("domain", mix.domains), ("lang", mix.langs), ("source", mix.sources)):
        leaves = leaves.withColumn(f"w_{column}", F.expr(f"CAST({case_sql(column, weights, mix.default_weight)} AS BIGINT)"))
    live = leaves.where("w_domain > 0 and w_lang > 0 and w_source > 0")
    total = leaves.agg(F.expr(f"CAST(sum(tokens) AS DECIMAL(38,0)) * {mix.numerator} DIV {mix.denominator}").alias("budget"))
    top = live.groupBy("domain").agg(F.sum("cap").alias("cap"), F.first("w_domain").alias("w")).crossJoin(F.broadcast(total)).withColumn("budget", F.col("budget").cast("long"))
    top = _share(top, [], "domain").select("domain", F.col("alloc").alias("budget"))
    mid = live.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.first("w_lang").alias("w")).join(top, "domain")
    mid = _share(mid, ["domain"], "lang").select("domain", "lang", F.col("alloc").alias("budget"))
    low = live.select("domain", "lang", "source", "tokens", "cap", F.col("w_source").alias("w")).join(mid, ["domain", "lang"])
    return _share(low, ["domain", "lang"], "source").drop("cap")


def mix_sources(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", key: str | None = None) -> DataFrame:
    """The selection of a mixture: doc_id, domain, lang, source, epoch, n_tokens and take_tokens, a row for each
    document and epoch that gives at least one token.

    Tokens are words (runs of all but space and \\x09-\\x0D). The last document of a leaf's prefix gives only the
    tokens that the budget still needs. Null lang and source count as 'unknown'; null and empty texts have no tokens
    and are never selected; a null id is ordered as 'null'; rows that share an id are rows of their own; an empty table
    gives no rows; other columns are ignored, but for `key`, a unique column that the selection keeps as its last.
    """
    leaf, keys = ["domain", "lang", "source"], [key] if key else []
    docs = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("unknown")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("unknown")).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long").alias("n_tokens"),
        *keys,
    ).where("n_tokens > 0")
    docs = written(docs.withColumn("domain", F.expr(case_sql("source", mix.domain_of, mix.default_domain))), "mix-tokens")
    leaves = budgets(docs.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens")), mix)
    leaves = written(leaves.select(*leaf, F.expr("alloc DIV tokens").alias("epochs"), F.expr("alloc % tokens").alias("rest")).where("epochs > 0 or rest > 0"), "mix-leaves")
    placed = docs.join(F.broadcast(leaves) if leaves.count() <= _BROADCAST_LEAVES else leaves, leaf)
    whole = placed.where("epochs > 0").select("doc_id", *leaf, F.explode(F.sequence(F.lit(0), F.col("epochs").cast("int") - 1)).alias("epoch"), "n_tokens", F.col("n_tokens").alias("take_tokens"), *keys)
    part = placed.where("rest > 0").withColumn("h", F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")))
    part = part.withColumn("bucket", F.substring("h", 1, 3))
    sums = part.groupBy(*leaf, "rest", "bucket").agg(F.sum("n_tokens").alias("held"))
    sums = sums.withColumn("before", F.sum("held").over(W.partitionBy(*leaf).orderBy("bucket")) - F.col("held")).where("before < rest").select(*leaf, "bucket", "held", "before")
    part = part.join(sums, [*leaf, "bucket"])
    inside = part.where("before + held <= rest").withColumn("take_tokens", F.col("n_tokens"))
    ends = part.where("before + held > rest")
    seen = F.sum("n_tokens").over(W.partitionBy(*leaf).orderBy("h", "doc_id", "n_tokens", *keys).rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens")
    ends = ends.withColumn("take_tokens", F.least("n_tokens", F.col("rest") - F.col("before") - seen)).where("take_tokens > 0")
    out = ["doc_id", *leaf, F.col("epochs").cast("int").alias("epoch"), "n_tokens", "take_tokens", *keys]
    return whole.union(inside.select(*out)).union(ends.select(*out))


def mixed_documents(docs: DataFrame, mix: Mix) -> DataFrame:
    """The selected documents themselves, with the columns of docs; rows with a null id or an id of several rows are
    rows of their own. A document of which the budget takes a part keeps its first words, joined by one space; a document
    of several epochs is there several times."""
    row, held, take = (fresh(docs, n) for n in ("mix_row", "mix_held", "mix_take"))
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    chosen = mix_sources(keyed, mix, key=row).select(row, F.col("n_tokens").alias(held), F.col("take_tokens").alias(take))
    met = keyed.join(chosen, row)
    words = F.slice(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(1), F.col(take).cast("int"))
    part = F.col(take) < F.col(held)
    out = met.withColumn("text", F.when(part, F.array_join(words, " ")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(part, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mixing_sql(mix: Mix) -> str:
    """The registered query in SQL: the same shares, with a prefix by one window over each leaf."""

    def level(name: str, table: str, parent: str, child: str, budget: str) -> str:
        by = f"PARTITION BY {parent}" if parent else ""
        order = f"OVER ({by} ORDER BY cap / w, {child} ROWS BETWEEN"
        return f"""
{name}1 AS (SELECT *, {budget} AS budget, COALESCE(SUM(cap) {order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before_cap,
  (SUM(w) {order} CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS later_w FROM {table}),
{name}2 AS (SELECT *, cap::HUGEINT * later_w <= (budget - before_cap) * w AS is_full FROM {name}1),
{name}3 AS (SELECT *, budget - COALESCE(SUM(CASE WHEN is_full THEN cap END) OVER ({by}), 0)::HUGEINT AS left_over,
  (SUM(CASE WHEN NOT is_full THEN w END) OVER ({by}))::HUGEINT AS open_w FROM {name}2),
{name} AS (SELECT *, CAST(CASE WHEN is_full THEN cap ELSE left_over * w // open_w END AS BIGINT) AS alloc FROM {name}3)"""

    w = lambda c, d: f"({case_sql(c, d, mix.default_weight)})::BIGINT"
    return f"""
WITH t AS (SELECT doc_id, COALESCE(lang, 'unknown') AS lang, COALESCE(source, 'unknown') AS source, len(regexp_extract_all(text, '{WORDS}'))::BIGINT AS n_tokens FROM documents),
d AS (SELECT *, {case_sql("source", mix.domain_of, mix.default_domain)} AS domain FROM t WHERE n_tokens > 0),
total AS (SELECT SUM(n_tokens)::HUGEINT * {mix.numerator} // {mix.denominator} AS b FROM d),
leaf AS (SELECT domain, lang, source, SUM(n_tokens)::BIGINT AS tokens, SUM(n_tokens)::BIGINT * {mix.max_epochs} AS cap, {w("domain", mix.domains)} AS wd, {w("lang", mix.langs)} AS wl, {w("source", mix.sources)} AS ws FROM d GROUP BY 1, 2, 3),
live AS (SELECT * FROM leaf WHERE wd > 0 AND wl > 0 AND ws > 0),
dom0 AS (SELECT domain, SUM(cap)::BIGINT AS cap, MIN(wd) AS w FROM live GROUP BY 1),{level("dom", "dom0", "", "domain", "(SELECT b FROM total)")},
lng0 AS (SELECT l.domain, l.lang, SUM(l.cap)::BIGINT AS cap, MIN(l.wl) AS w, MIN(dom.alloc) AS up FROM live l JOIN dom USING (domain) GROUP BY 1, 2),{level("lng", "lng0", "domain", "lang", "up::HUGEINT")},
src0 AS (SELECT l.domain, l.lang, l.source, l.tokens, l.cap, l.ws AS w, lng.alloc AS up FROM live l JOIN lng USING (domain, lang)),{level("src", "src0", "domain, lang", "source", "up::HUGEINT")},
b AS (SELECT domain, lang, source, alloc // tokens AS epochs, alloc % tokens AS rest FROM src WHERE alloc > 0),
p AS (SELECT d.*, epochs, rest, md5('{mix.seed}:' || epochs || ':' || COALESCE(doc_id::VARCHAR, 'null')) AS h FROM d JOIN b USING (domain, lang, source)),
q AS (SELECT *, SUM(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS seen FROM p)
SELECT doc_id, domain, lang, source, e::INTEGER AS epoch, n_tokens, n_tokens AS take_tokens FROM (SELECT *, unnest(range(epochs)) AS e FROM p)
UNION ALL SELECT doc_id, domain, lang, source, epochs::INTEGER, n_tokens, LEAST(n_tokens, rest - seen)::BIGINT FROM q WHERE rest - seen > 0"""
