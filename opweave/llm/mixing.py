"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic); a value that the targets don't name falls into
``other``, so that there are at most as many cells as the targets allow: |sources| x |languages| x
|topics|. Cells' tokens are raked to the three marginals in ``rounds`` rounds, and each document is kept
with the probability min(1, share * target tokens / tokens) of its cell, decided by a hash of its doc_id.

The share of tokens to keep is derived from the weights: the largest, up to ``SHARE``, that takes no probability
beyond 1, so that the expected kept tokens follow the weights in every cell. A share may be given instead; cells
whose weight is above 1 / share are then kept whole and fall short.

Edge cases: a target without documents is left out and the others are scaled up; a null source or
language falls into ``other``; a document without words (null, empty) has no tokens, weight 0 and
probability 0; equal doc_ids get equal decisions; an empty table gives no rows; columns of docs that have a
result's name are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opweave.session import table

#: Target shares by value; "other" is what isn't named.
SOURCES = {f"src{i}": 0.045 for i in range(20)} | {"other": 0.1}
LANGS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.1, "other": 0.05}
TOPICS = {"prose": 0.85, "table": 0.05, "loud": 0.04, "symbols": 0.04, "short": 0.02}
SHARE, ROUNDS = 0.8, 20
WORD = r"[^\x20\x09-\x0D]+"


def n_tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def topic(text: str = "text", tokens: str = "n_tokens") -> Column:
    """A document's kind, from its layout."""
    t = F.col(text)
    return F.when(F.contains(t, F.lit(" | ")), "table").when(F.contains(t, F.lit("!!")), "loud").when(t.rlike(r"[%&$#*]{3}"), "symbols").when(F.col(tokens) < 50, "short").otherwise("prose")


def _named(name: str, targets: dict) -> Column:
    return F.when(F.col(name).isin(*targets), F.col(name)).otherwise("other")


def rake(cells: dict[tuple, float], targets: list[dict], rounds: int = ROUNDS) -> dict[tuple, float]:
    """Weights of the cells, summing to 1, after ``rounds`` rounds over all marginals in turn."""
    w = {c: float(n) for c, n in sorted(cells.items()) if n > 0}
    for _ in range(rounds):
        for k, target in enumerate(targets):
            have: dict = {}
            for c, x in w.items():
                have[c[k]] = have.get(c[k], 0.0) + x
            whole = sum(target.get(v, 0.0) for v in sorted(have))
            w = {c: x * target.get(c[k], 0.0) / whole / have[c[k]] if have[c[k]] and whole else 0.0 for c, x in w.items()}
    return w


def followed(weights) -> float:
    """The largest share, up to SHARE, that leaves share * weight at 1 or less for every weight."""
    return min(SHARE, 1 / max(weights, default=1.0))


def calibrated(docs: DataFrame, sources=SOURCES, langs=LANGS, topics=TOPICS, share: float | None = None, rounds: int = ROUNDS) -> DataFrame:
    """The rows of docs with mix_source, mix_lang, mix_topic, mix_tokens, mix_weight (of a token, 1 on average), mix_prob and mix_kept."""
    cell = ["mix_source", "mix_lang", "mix_topic"]
    df = docs.drop("mix_tokens", *cell, "mix_weight", "mix_prob", "mix_kept", "mix_w").withColumns({"mix_tokens": n_tokens(), "mix_source": _named("source", sources), "mix_lang": _named("lang", langs)}).withColumn("mix_topic", topic(tokens="mix_tokens"))
    held = {tuple(r[c] for c in cell): r["n"] for r in df.groupBy(*cell).agg(F.sum("mix_tokens").alias("n")).collect()}  # bounded by the targets
    total = float(sum(held.values()))
    weight = {c: w * total / held[c] for c, w in rake(held, [sources, langs, topics], rounds).items()}
    share = followed(weight.values()) if share is None else share
    spark = docs.sparkSession
    values = ", ".join("('{}', '{}', '{}', {!r}D)".format(*(x.replace("'", "''") for x in c), w) for c, w in sorted(weight.items()))
    by_cell = spark.sql(f"select * from values {values} as t(mix_source, mix_lang, mix_topic, mix_w)" if values else "select '' mix_source, '' mix_lang, '' mix_topic, 0D mix_w where false")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    u = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    out = df.join(F.broadcast(by_cell), cell, "left").withColumn("mix_weight", F.when(F.col("mix_tokens") > 0, F.coalesce("mix_w", F.lit(0.0))).otherwise(F.lit(0.0))).drop("mix_w")
    return out.withColumn("mix_prob", F.least(F.lit(1.0), F.col("mix_weight") * share)).withColumn("mix_kept", u < F.col("mix_prob"))


def op9(spark, sf_dir):
    d = calibrated(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return d.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.round("mix_weight", 6).alias("weight"), F.round("mix_prob", 6).alias("prob"), F.col("mix_kept").alias("kept"))


def _oracle() -> str:
    named = lambda col, t: f"case when {col} in ({', '.join(repr(k) for k in t)}) then {col} else 'other' end"
    tables = "".join(f", {name}(v, x) as (values {', '.join(f'({k!r}, {v!r}::double)' for k, v in t.items())})" for name, t in (("ts", SOURCES), ("tl", LANGS), ("tt", TOPICS)))
    sql = f"""with d as (select doc_id, text, {named("source", SOURCES)} source, {named("lang", LANGS)} lang,
      len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint n_tokens from documents),
    e as (select *, case when contains(text, ' | ') then 'table' when contains(text, '!!') then 'loud' when regexp_matches(text, '[%&$#*]{{3}}') then 'symbols'
      when n_tokens < 50 then 'short' else 'prose' end topic from d){tables},
    c0 as (select source, lang, topic, sum(n_tokens)::double n, sum(n_tokens)::double w from e group by all having sum(n_tokens) > 0)"""
    k = 0
    for _ in range(ROUNDS):
        for col, t in (("source", "ts"), ("lang", "tl"), ("topic", "tt")):
            sql += f""",
    c{k + 1} as materialized (select source, lang, topic, n, w * x / (select sum(x) from {t} where v in (select {col} from c0)) / sum(w) over (partition by {col}) w from c{k} join {t} on v = {col})"""
            k += 1
    return (
        sql
        + f""",
    f as (select least({SHARE!r}::double, 1 / max(w * (select sum(n) from c0) / n)) share from c{k})
    select doc_id, source, lang, topic, n_tokens, round(weight, 6) weight, round(least(1.0::double, weight * (select share from f)), 6) prob,
      ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 8))::bigint / 4294967296.0::double < least(1.0::double, weight * (select share from f)) kept
    from (select e.*, case when n_tokens > 0 then coalesce(c.w * (select sum(n) from c0) / c.n, 0) else 0 end::double weight
      from e left join c{k} c using (source, lang, topic))"""
    )


QUERIES = {"op9_mixing": op9}
ORACLES = {"op9_mixing": _oracle()}
