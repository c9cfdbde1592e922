"""URL filters: host and path rules first, then a ratio of two character language models.

Rules decide what they fit. What they accept and reject also trains the models: for each class a smoothed
Markov model of variable order (the next character after up to ``ORDER`` others, Witten-Bell weights between
the orders). A URL's score is the difference of its log-likelihoods a character. Every fifth of the ruled
URLs, by hash, is kept out of the counts and sets the threshold.

Counts cover all URLs and grow with them, so they stay distributed: grams of the longest length are counted
once, shorter ones are rolled up from them, and each order's probabilities come from the order below by a
join on the gram without its first character. Positions of grams that occur often are scored by a broadcast
of those grams, of which there can't be many; the others meet theirs in a shuffle without hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parleylake.llm._shared import ascii_lower, materialize, table

#: Verdict and rule (host and path), as contracted.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
ORDER = 4
#: Of so many ruled URLs one is held out, by hash.
HELD_OUT = 5
#: Characters that a model thinks possible where it knows nothing, and marks that stand before and after a URL.
ALPHABET, BEFORE, AFTER = 256, "\x02", "\x03"
#: Scores are whole numbers of this part of a nat, so that sums don't depend on their order.
UNIT = 1_000_000
#: A gram is frequent if it has at least this part of all positions: there are at most so many such grams.
FREQUENT = 50_000
#: Bins of the threshold's histogram a nat, and how many nats it reaches to either side.
BINS, REACH = 50, 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first ``://`` with A-Z lower-cased, and the path up to ``?``, ``#`` or the end; null or no ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does; of equally long ones that with the longer host.

    A rule fits its host and all subdomains if the path starts with its own. Rules are a stated list; each is one comparison.
    """
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    split = lambda r: (r[: r.index("/")], r[r.index("/") :])
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), len(split(r[1])[0]), r[1])):
        own, start = split(rule)
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(start))
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen["rule"], chosen["verdict"]


def grams(url: Column, order: int) -> Column:
    """For each character of a URL and its end: that character after the ``order`` before it."""
    padded = F.concat(F.lit(BEFORE * order), F.coalesce(url, F.lit("")), F.lit(AFTER))
    return F.transform(F.sequence(F.lit(1), F.char_length(padded) - order), lambda i: F.substring(padded, i, F.lit(order + 1)))


def model(counts: DataFrame, order: int) -> DataFrame:
    """(``gram``, ``n``, ``gain``) for every gram of ``counts`` (``gram``, ``n``, ``good``, ``bad``): log-likelihood of its last character if accepted less that if rejected, in ``UNIT``.

    Witten-Bell: an order with n characters after a context, of t kinds, takes n of n + t parts of the probability, and the order below the rest.
    """
    levels = {order + 1: counts}
    for size in range(order, 0, -1):
        shorter = levels[size + 1].groupBy(F.substring("gram", 2, size).alias("gram")).agg(*[F.sum(c).alias(c) for c in ("n", "good", "bad")])
        levels[size] = materialize(shorter)
    below = None
    for size in range(1, order + 2):
        context = Window.partitionBy("context")
        rows = levels[size].withColumn("context", F.substring("gram", 1, size - 1))
        if size == 1:  # one context: its sums are one row
            sums = rows.agg(*[f.alias(name + c) for c in ("good", "bad") for name, f in (("n_", F.sum(c)), ("t_", F.count_if(F.col(c) > 0)))])
            rows = rows.crossJoin(F.broadcast(sums)).withColumns({"p_good": F.lit(1 / ALPHABET), "p_bad": F.lit(1 / ALPHABET)})
        else:
            rows = rows.withColumns({name + c: f.over(context) for c in ("good", "bad") for name, f in (("n_", F.sum(c)), ("t_", F.count_if(F.col(c) > 0)))})
            rows = rows.withColumn("shorter", F.substring("gram", 2, size - 1)).join(below, "shorter")
        p = lambda c: F.when(F.col(f"n_{c}") > 0, (F.col(c) + F.col(f"t_{c}") * F.col(f"p_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}"))).otherwise(F.col(f"p_{c}"))
        found = rows.select("gram", "n", p("good").alias("p_good"), p("bad").alias("p_bad"))
        below = materialize(found) if size > order else materialize(found.drop("n").withColumnRenamed("gram", "shorter"))
    return below.select("gram", "n", F.round((F.log("p_good") - F.log("p_bad")) * UNIT).cast("long").alias("gain"))


def scored(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """(``row``, ``score``) of ``urls`` (``row``, ``url``, ``fits``: 1 accepted, 0 rejected, null not for training): whole ``UNIT`` a character."""
    spots = urls.select("row", "fits", F.explode(grams(F.col("url"), order)).alias("gram"))
    # the counts of a file's URLs are summed where they are, so a frequent gram moves once a task
    counts = materialize(spots.groupBy("gram").agg(F.count("*").alias("n"), F.count_if(F.col("fits") == 1).alias("good"), F.count_if(F.col("fits") == 0).alias("bad")))
    gains = materialize(model(counts, order))
    total = gains.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * FREQUENT >= total
    frequent, others = gains.where(often).select("gram", "gain"), gains.where(~often).select("gram", "gain")
    spots = spots.select("row", "gram").join(F.broadcast(frequent), "gram", "left")  # at most FREQUENT grams
    known = spots.where(F.col("gain").isNotNull()).groupBy("row").agg(F.sum("gain").alias("gain"), F.count("*").alias("n"))
    rest = spots.where(F.col("gain").isNull()).select("row", "gram").join(others, "gram").groupBy("row").agg(F.sum("gain").alias("gain"), F.count("*").alias("n"))
    return known.unionByName(rest).groupBy("row").agg((F.sum("gain") / F.sum("n")).alias("score"))


def threshold(held_out: DataFrame) -> float:
    """The score that tells ``held_out`` (``score``, ``accepted``) apart best: the mean of both classes' shares told right, over bins of scores; of equally good ones that nearest 0. 0 without both classes."""
    bins = F.greatest(F.least(F.floor(F.col("score") / UNIT * BINS), F.lit(REACH * BINS)), F.lit(-REACH * BINS))
    found = held_out.groupBy(bins.alias("bin")).agg(F.count_if("accepted").alias("good"), F.count_if(~F.col("accepted")).alias("bad")).collect()  # at most 2 * REACH * BINS + 1 rows
    good, bad = sum(r["good"] for r in found), sum(r["bad"] for r in found)
    if not good or not bad:
        return 0.0
    right = {at: sum(r["good"] for r in found if r["bin"] >= at) / good + sum(r["bad"] for r in found if r["bin"] < at) / bad for at in range(-REACH * BINS, REACH * BINS + 2)}
    return min(right, key=lambda at: (-round(right[at], 12), abs(at), at)) / BINS


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, order: int = ORDER, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of ``pages``: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``score``, in nats a character, and ``threshold``.

    Null URLs are scored as empty ones, of which only the end is scored; long ones are scored whole. Repeated
    rows, null and repeated ids each keep their row and count as often as they stand there. Where rules accept
    or reject nothing, that class's model knows nothing; without both classes the threshold is 0, and a score
    of at least the threshold is allowed. An empty table gives no rows; further columns are ignored.
    """
    host, path = host_and_path(F.col(url_col))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows.withColumns({"rule": rule, "ruled": verdict}))
    out = F.coalesce(F.conv(F.substring(F.md5("url"), 1, 6), 16, 10).cast("long") % HELD_OUT == 0, F.lit(False))
    fits = F.when(~out, F.when(F.col("ruled") == "allow", 1).when(F.col("ruled") == "block", 0))
    scores = materialize(scored(rows.select("row", "url", fits.alias("fits")), order))
    found = rows.join(scores, "row")
    limit = threshold(found.where(out & F.col("ruled").isNotNull()).select("score", (F.col("ruled") == "allow").alias("accepted")))
    score = F.col("score") / UNIT
    judged = F.coalesce("ruled", F.when(score >= limit, "allow").otherwise("block"))
    return found.select("page_id", "host", "path", "rule", judged.alias("verdict"), score.alias("score"), F.lit(limit).alias("threshold"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages by their URLs."""
    return filter_urls(table(spark, sf_dir, "pages"))


def _order_sql(size: int) -> str:
    """The probabilities of grams of ``size`` characters, from those of one less."""
    sums = ", ".join(f"{name} OVER (PARTITION BY substr(gram, 1, {size - 1})) AS {as_}_{c}" for c in ("good", "bad") for name, as_ in ((f"sum({c})", "n"), (f"count_if({c} > 0)", "t")))
    p = ", ".join(f"CASE WHEN n_{c} > 0 THEN (g.{c} + t_{c} * {below}) / (n_{c} + t_{c}) ELSE {below} END AS p_{c}" for c in ("good", "bad") for below in ([f"b.p_{c}"] if size > 1 else [f"{1 / ALPHABET}::DOUBLE"]))
    join = f"JOIN p{size - 1} b ON b.gram = substr(g.gram, 2)" if size > 1 else ""
    return f"p{size} AS MATERIALIZED (SELECT g.gram, {p} FROM (SELECT *, {sums} FROM g{size}) g {join})"


_HOST, _PATH = "regexp_extract(rest, '^[^/?#]*')", "regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*')"
_CASES = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'rule': '{h}{p}', 'verdict': '{verdict}'}}"
    for verdict, h, p in sorted(((v, r[: r.index("/")], r[r.index("/") :]) for v, r in RULES), key=lambda r: -len(r[1] + r[2]))
)
ORACLE = f"""
WITH u AS (SELECT *, row_number() OVER () AS row, coalesce(CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END, '') AS rest FROM pages),
  h AS (SELECT page_id, row, url, translate({_HOST}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, {_PATH} AS path, coalesce(('0x' || substr(md5(url), 1, 6))::BIGINT % {HELD_OUT} = 0, false) AS held FROM u),
  r AS MATERIALIZED (SELECT *, CASE {_CASES} END AS r FROM h),
  pad AS (SELECT row, held, r.verdict AS v, repeat(chr(2), {ORDER}) || coalesce(url, '') || chr(3) AS t FROM r),
  s AS MATERIALIZED (SELECT row, held, v, substr(t, i, {ORDER + 1}) AS gram FROM (SELECT *, unnest(range(1, length(t) - {ORDER} + 1)) AS i FROM pad)),
  g{ORDER + 1} AS MATERIALIZED (SELECT gram, count_if(coalesce(v = 'allow', false) AND NOT held) AS good, count_if(coalesce(v = 'block', false) AND NOT held) AS bad FROM s GROUP BY gram),
  {", ".join(f"g{k} AS MATERIALIZED (SELECT substr(gram, 2) AS gram, sum(good) AS good, sum(bad) AS bad FROM g{k + 1} GROUP BY 1)" for k in range(ORDER, 0, -1))},
  {", ".join(_order_sql(k) for k in range(1, ORDER + 2))},
  sc AS MATERIALIZED (SELECT row, sum(round((ln(p_good) - ln(p_bad)) * {UNIT})::BIGINT)::DOUBLE / count(*) AS score FROM s JOIN p{ORDER + 1} USING (gram) GROUP BY row),
  b AS MATERIALIZED (SELECT greatest(least(floor(score / {UNIT} * {BINS}), {REACH * BINS}), {-REACH * BINS}) AS bin, r.verdict = 'allow' AS ok FROM sc JOIN r USING (row) WHERE held AND r.r IS NOT NULL),
  best AS (SELECT a, round(count_if(ok AND bin >= a) / nullif((SELECT count_if(ok) FROM b), 0) + count_if(NOT ok AND bin < a) / nullif((SELECT count_if(NOT ok) FROM b), 0), 12) AS v
           FROM b, (SELECT unnest(range({-REACH * BINS}, {REACH * BINS + 2})) AS a) GROUP BY a),
  lim AS (SELECT coalesce((SELECT a FROM best WHERE v IS NOT NULL ORDER BY v DESC, abs(a), a LIMIT 1), 0) / {BINS} AS t)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, CASE WHEN score / {UNIT} >= t THEN 'allow' ELSE 'block' END) AS verdict, score / {UNIT} AS score, t::DOUBLE AS threshold FROM r JOIN sc USING (row), lim
"""
