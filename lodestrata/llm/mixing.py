"""Mixing sources to target weights by hierarchical budgets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release

SPACE = " \t\n\x0b\f\r"
#: Leaf tables up to so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_LEAVES = 20_000


@dataclass(frozen=True)
class Mix:
    """Integer weights by name at each level (``default`` for other names), the share of all tokens to select, epochs and seed."""

    domains: dict = field(default_factory=dict)
    languages: dict = field(default_factory=lambda: {"en": 50, "de": 20, "fr": 20, "es": 10})
    sources: dict = field(default_factory=dict)
    default: int = 10
    per_mille: int = 600
    max_epochs: int = 2
    seed: int = 17


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[ \\t\\n\\x0B\\f\\r]+"))).cast("long")


def _weights(level: Column, names: dict, default: int) -> Column:
    w = F.lit(max(0, default)).cast("long")
    for name, x in names.items():
        w = F.when(level == name, F.lit(max(0, int(x))).cast("long")).otherwise(w)
    return w


def _share(df: DataFrame, parents: list[str], node: str, supply: str, weight: str, budget: str, out: str) -> DataFrame:
    """Split ``budget`` among the nodes below ``parents`` by weight, none over its supply.

    Nodes whose supply is short for their weight come first and take all they
    have; what they leave goes to the rest by weight. Nodes without a weight
    get nothing. Integer arithmetic.
    """
    order = Window.partitionBy(*parents).orderBy((F.col(weight) <= 0).asc(), F.try_divide(F.col(supply), F.col(weight)).asc(), F.col(node).asc_nulls_first())
    had = F.coalesce(F.sum(supply).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum(weight).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    left = F.greatest(F.col(budget) - F.col("_had"), F.lit(0))
    fits = (F.col(weight) > 0) & (F.col(supply) * F.col("_open") <= left * F.col(weight))
    df = df.withColumn("_had", had).withColumn("_open", open_).withColumn("_fits", fits)
    # from the first node that doesn't fit on, all share what is left there
    first = Window.partitionBy(*parents)
    at = lambda c: F.min(F.when(~F.col("_fits"), F.col(c))).over(first)
    most = lambda c: F.max(F.when(~F.col("_fits"), F.col(c))).over(first)
    df = df.withColumn("_cut", at("_had")).withColumn("_cut_open", most("_open"))
    return df.withColumn(out, F.when(F.col("_fits"), F.col(supply)).otherwise(F.least(F.col(supply), F.expr(f"CASE WHEN _cut_open > 0 THEN greatest({budget} - _cut, 0L) * greatest({weight}, 0L) div _cut_open ELSE 0L END")))).drop("_had", "_open", "_fits", "_cut", "_cut_open")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Budget of each leaf (domain, lang, source, tokens): from the root down, so shortages go to siblings before they reach an ancestor's."""
    cap = F.col("tokens") * mix.max_epochs
    df = leaves.select("domain", "lang", "source", "tokens", cap.alias("s3"), _weights(F.col("source"), mix.sources, mix.default).alias("w3"))
    l2 = df.groupBy("domain", "lang").agg(F.sum("s3").alias("s2"), F.sum("tokens").alias("t2")).withColumn("w2", _weights(F.col("lang"), mix.languages, mix.default))
    l1 = l2.groupBy("domain").agg(F.sum("s2").alias("s1"), F.sum("t2").alias("t1")).withColumn("w1", _weights(F.col("domain"), mix.domains, mix.default))
    l1 = l1.withColumn("b0", F.expr(f"sum(t1) over () * {mix.per_mille} div 1000")).withColumn("root", F.lit(0))
    l1 = _share(l1, ["root"], "domain", "s1", "w1", "b0", "b1").select("domain", "b1")
    same = lambda a, b, *names: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]
    l2 = l2.alias("a").join(l1.alias("b"), same("a", "b", "domain")).select("a.*", "b.b1")
    l2 = _share(l2, ["domain"], "lang", "s2", "w2", "b1", "b2").select("domain", "lang", "b2")
    l3 = df.alias("a").join(l2.alias("b"), same("a", "b", "domain", "lang")).select("a.*", "b.b2")
    return _share(l3, ["domain", "lang"], "source", "s3", "w3", "b2", "budget").select("domain", "lang", "source", "tokens", "budget")


def _passing(parts: DataFrame, leaf: list[str], before: Column) -> DataFrame:
    """Of each leaf's ``_bucket`` parts in order, the first by which its running tokens pass ``_rest``, and the tokens ahead of it."""
    running = Window.partitionBy(*leaf).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = parts.withColumn("_end", before + F.sum("_n").over(running)).where("_end > _rest")
    first = ended.groupBy(*leaf).agg(F.min(F.struct("_bucket", (F.col("_end") - F.col("_n")).alias("_ahead"))).alias("_c"))
    return first.selectExpr(*leaf, "_c._bucket as _cut", "_c._ahead as _before")


def domain_of_source(source: Column) -> Column:
    """A stand-in where nothing says what a source's domain is: four groups by the last digit of its name."""
    return F.concat(F.lit("domain"), F.coalesce(F.try_to_number(F.right(source, F.lit(1)), F.lit("9")).cast("int") % 4, F.lit(0)).cast("string"))


def domain_of(docs: DataFrame) -> Column:
    """A document's domain: its column ``domain``, else the host of its ``url``, else a group of sources."""
    if "domain" in docs.columns:
        return F.col("domain").cast("string")
    if "url" in docs.columns:
        return F.try_parse_url(F.col("url").cast("string"), F.lit("HOST"))
    return domain_of_source(F.col("source").cast("string"))


_LEAF = ["_d", "_l", "_s"]


def _digest(seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_full").cast("string"), F.coalesce(F.col("_id"), F.lit("null"))))


def _same(a: str, b: str) -> list[Column]:
    return [F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{x}")) for x in _LEAF]


def _cuts(narrow: DataFrame, mix: Mix) -> tuple[DataFrame, bool]:
    """For each leaf the whole epochs and where the last one's prefix ends: bucket, then key and tokens of the last rows in it."""
    leaves = materialise(narrow.groupBy(F.col("_d").alias("domain"), F.col("_l").alias("lang"), F.col("_s").alias("source")).agg(F.sum("_t").alias("tokens")), "mix-leaves")
    plan = materialise(budgets(leaves, mix).where("tokens > 0 and budget > 0").selectExpr("domain as _d", "lang as _l", "source as _s", "budget div tokens as _full", "budget % tokens as _rest"), "mix-plan")
    small = plan.count() <= BROADCAST_LEAVES
    held = lambda df: F.broadcast(df) if small else df
    keyed = narrow.alias("r").join(held(plan).alias("p"), _same("r", "p")).select("r.*", "p._full", "p._rest").where("_rest > 0").withColumn("_key", _digest(mix.seed)).withColumn("_bucket", F.substring("_key", 1, 4))
    sums = materialise(keyed.groupBy(*_LEAF, "_rest", "_bucket").agg(F.sum("_t").alias("_n")), "mix-sums")
    coarse = F.substring("_bucket", 1, 2)
    span = _passing(sums.groupBy(*_LEAF, "_rest", coarse.alias("_bucket")).agg(F.sum("_n").alias("_n")), _LEAF, F.lit(0))
    inside = sums.alias("k").join(held(span).alias("c"), [*_same("k", "c"), coarse == F.col("c._cut")]).select("k.*", "c._before")
    cut = materialise(_passing(inside, _LEAF, F.col("_before")), "mix-cut")
    edge = keyed.alias("k").join(held(cut).alias("c"), [*_same("k", "c"), F.col("k._bucket") == F.col("c._cut")]).select("k.*", "c._before")
    edge = edge.groupBy(*_LEAF, "_rest", "_before", "_key", "_t").agg(F.sum("_t").alias("_n"))
    within = Window.partitionBy(*_LEAF).orderBy("_key", "_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = edge.withColumn("_end", F.col("_before") + F.sum("_n").over(within)).where("_end <= _rest").groupBy(*_LEAF).agg(F.max(F.struct("_key", "_t")).alias("_last"))
    out = plan.alias("p").join(held(cut).alias("c"), _same("p", "c"), "left").select("p.*", "c._cut").alias("q").join(held(ends).alias("e"), _same("q", "e"), "left")
    out = materialise(out.selectExpr("q.*", "e._last._key as _last_key", "e._last._t as _last_t"), "mix-cuts")
    release(leaves, plan, sums, cut)
    return out, small


def _selected(docs: DataFrame, mix: Mix, domain: Column | None) -> DataFrame:
    """The rows that the budgets select, each as a struct ``row``, with ``domain``, ``tokens`` and ``epoch``."""
    domain = domain_of(docs) if domain is None else domain
    values = [domain.alias("_d"), F.col("lang").cast("string").alias("_l"), F.col("source").cast("string").alias("_s"), F.col("doc_id").cast("string").alias("_id"), n_tokens(F.col("text")).alias("_t")]
    narrow = materialise(docs.select(*values), "mix-narrow")
    cuts, small = _cuts(narrow, mix)
    release(narrow)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *values)
    placed = rows.alias("r").join((F.broadcast(cuts) if small else cuts).alias("p"), _same("r", "p")).select("r.row", "r._id", "r._t", "r._d", "p._full", "p._rest", "p._cut", "p._last_key", "p._last_t").withColumn("_key", _digest(mix.seed))
    bucket = F.substring("_key", 1, 4)
    up_to = (F.col("_key") < F.col("_last_key")) | (F.col("_key") == F.col("_last_key")) & (F.col("_t") <= F.col("_last_t"))
    last = (F.col("_rest") > 0) & (F.col("_cut").isNull() | (bucket < F.col("_cut")) | (bucket == F.col("_cut")) & F.coalesce(up_to, F.lit(False)))
    # epochs 0 to _full - 1 whole, and the last one if its prefix reaches the row
    many = F.col("_full") + last.cast("long")
    return placed.withColumn("_many", many).where("_many > 0").select("row", F.col("_d").alias("domain"), F.col("_t").alias("tokens"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_many") - 1)).alias("epoch"))


def mix_sources(docs: DataFrame, mix: Mix = Mix(), domain: Column | None = None) -> DataFrame:
    """Select documents so that each leaf of the domain-language-source tree meets its token budget.

    Returns the rows selected with all their columns, plus ``mix_domain``,
    ``mix_tokens`` and ``mix_epoch`` (from 0; a leaf short of tokens gives its
    documents again, up to ``max_epochs`` times); columns of ``docs`` that have
    these names give way to them. The domain is a column given, or what
    ``domain_of`` finds. Tokens are words. Of a leaf's last epoch the rows are
    taken whose running tokens, in the order of md5(seed|epoch|doc_id), stay
    within the budget: a prefix. Where it ends is found in a narrow table of
    leaf, id and tokens: running sums go over 256 hash ranges of a leaf first,
    then over the 256 buckets of the range that holds the cut, so that only one
    of 65,536 buckets is sorted by rows. The texts are read twice: for their
    tokens, and to be selected. No exchange moves them.

    Null languages, sources and ids are values of their own; a null text has no
    tokens and comes with its epoch if the prefix reaches it; a text counts
    whole, however long; rows of one id and as many tokens are taken together
    or not at all, so a prefix ends between ids; an empty table gives no rows.
    Names of weight 0 give nothing, nor does a leaf whose budget is 0.
    """
    rest = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("mix_domain", "mix_tokens", "mix_epoch")]
    return _selected(docs, mix, domain).select(*rest, F.col("domain").alias("mix_domain"), F.col("tokens").alias("mix_tokens"), F.col("epoch").alias("mix_epoch"))


def mixed_documents(docs: DataFrame, mix: Mix = Mix(), domain: Column | None = None) -> DataFrame:
    """The same rows with the columns of ``docs`` alone, whatever their names."""
    return _selected(docs, mix, domain).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), domain=domain_of_source(F.col("source")))
    return out.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_epoch").alias("epoch"))


def _share_sql(source: str, parents: str, node: str, k: int, budget: str) -> str:
    part = f"PARTITION BY {parents}" if parents else ""
    order = f"{part} ORDER BY w{k} <= 0, s{k}::DOUBLE / nullif(w{k}, 0), {node} ASC NULLS FIRST"
    return f"""
a{k} AS (SELECT *, coalesce(sum(s{k}) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had, sum(w{k}) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM {source}),
f{k} AS (SELECT *, w{k} > 0 AND s{k} * open <= greatest({budget} - had, 0) * w{k} AS fits FROM a{k}),
c{k} AS (SELECT *, min(CASE WHEN NOT fits THEN had END) OVER ({part}) AS cut, max(CASE WHEN NOT fits THEN open END) OVER ({part}) AS cut_open FROM f{k}),
g{k} AS (SELECT * EXCLUDE (had, open, fits, cut, cut_open), CASE WHEN fits THEN s{k} ELSE least(s{k}, coalesce(greatest({budget} - cut, 0) * w{k} // nullif(cut_open, 0), 0)) END AS b{k} FROM c{k})"""


def op7_sql(mix: Mix = Mix()) -> str:
    case = lambda c, names: "CASE " + " ".join(f"WHEN {c} = '{n}' THEN {max(0, w)}" for n, w in names.items()) + f" ELSE {max(0, mix.default)} END" if names else str(max(0, mix.default))
    return f"""
WITH d AS (
  SELECT doc_id, lang, source, 'domain' || coalesce(try_cast(right(source, 1) AS INT) % 4, 0) AS domain, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\f\\r]+')) AS BIGINT) AS n_tokens FROM documents),
l3 AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, sum(n_tokens)::HUGEINT * {mix.max_epochs} AS s3, {case("source", mix.sources)} AS w3 FROM d GROUP BY ALL),
l2 AS (SELECT domain, lang, sum(s3) AS s2, sum(tokens) AS t2, {case("lang", mix.languages)} AS w2 FROM l3 GROUP BY ALL),
l1 AS (SELECT domain, sum(s2) AS s1, sum(t2) AS t1, {case("domain", mix.domains)} AS w1 FROM l2 GROUP BY ALL),
b0 AS (SELECT *, sum(t1) OVER () * {mix.per_mille} // 1000 AS b0 FROM l1),
{_share_sql("b0", "", "domain", 1, "b0")},
m2 AS (SELECT l2.*, g1.b1 FROM l2 JOIN g1 ON l2.domain IS NOT DISTINCT FROM g1.domain),
{_share_sql("m2", "domain", "lang", 2, "b1")},
m3 AS (SELECT l3.*, g2.b2 FROM l3 JOIN g2 ON l3.domain IS NOT DISTINCT FROM g2.domain AND l3.lang IS NOT DISTINCT FROM g2.lang),
{_share_sql("m3", "domain, lang", "source", 3, "b2")},
p AS (SELECT domain, lang, source, b3 // tokens AS full_, b3 % tokens AS rest FROM g3 WHERE tokens > 0),
k AS (SELECT d.*, full_, rest, md5(concat_ws('|', '{mix.seed}', CAST(full_ AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS key FROM d JOIN p ON d.domain IS NOT DISTINCT FROM p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source),
r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, n_tokens) AS upto FROM k),
o AS (
  SELECT doc_id, domain, lang, source, n_tokens, full_ AS epoch FROM r WHERE upto <= rest AND rest > 0
  UNION ALL SELECT doc_id, domain, lang, source, n_tokens, unnest(range(CAST(full_ AS BIGINT))) AS epoch FROM r WHERE full_ > 0)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epoch AS BIGINT) AS epoch FROM o"""
