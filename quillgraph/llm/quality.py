"""Quality rules: plain limits, then robust multivariate outliers by language and source.

Statistics of whole texts become a vector of four figures that vary in clean text too: mean word length, marks and capitals for each
word, and how fast new words become rare. The shorter a text, the more its figures scatter, so they are drawn towards the median of its
language and source. For each language and source, each language, and all rows, the minimum covariance determinant is sought: from three
deterministic starts, concentration steps keep the `coverage` share of vectors nearest to the current centre by Mahalanobis distance
and re-estimate, until determinants fall by less than a hundredth; the start with the least one is reweighted. The estimate of a language and source is
drawn towards its language's and that towards all rows', the more the fewer rows it has, so every row is judged however small its group is.
Distances are ranked by narrow logarithmic bins, and the sums of a bin suffice for the next estimate, so a group of any size costs
a bounded number of rows after map-side aggregation. Clean distances are about chi-square with a longer tail; rows are rejected beyond
the place where distances are least dense, between a wide and a narrow tail.
Everything is built from DataFrame and SQL functions.
"""

from __future__ import annotations

import math
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import common

DIMENSIONS = 4
#: Share of the vectors that a concentration step keeps, and most steps.
COVERAGE, STEPS = 0.5, 8
#: Words at which half the variance of a figure counts as the text's own, and rows at which half an estimate is a group's own.
OWN_WORDS, OWN_ROWS = 500, 30
#: Share of the spread of all rows that is added to each variance, so that figures without any scatter can be divided by.
RIDGE = 1e-3
#: Tail probabilities between which the cut lies: nothing nearer than the first is rejected, nothing beyond the second is kept.
TAILS = (0.025, 1e-9)
#: Bins of distances for each unit of their logarithm, and bins on either side that count towards the density at a place.
FINE, AROUND = 32, 6
#: Up to so many groups, the table of estimates (under 300 bytes a row) is sent to all tasks; beyond, it is joined by shuffle, hot groups split.
SENT_GROUPS = 10_000

SPACE = r" \t\n\u000B\u000C\r"
REPEATED = """
element_at(transform(array(transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))), h ->
  if(size(array_distinct(h)) = size(h), 0,
    element_at(transform(array(sort_array(transform(h, (x, i) -> struct(x, i)))), p ->
      size(array_distinct(flatten(transform(
        filter(p, (q, j) -> coalesce(get(p, j - 1).x = q.x, false) or coalesce(get(p, j + 1).x = q.x, false)),
        q -> array(q.i, q.i + 1, q.i + 2)))))), 1))), 1)
"""
MARKS = "!\"#$%&''()*+,-./:;<=>?@[]^_`{|}~"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STATISTICS = {
    "n_words": "size(w)",
    "word_chars": f"char_length(translate(t, '{SPACE}', ''))",
    "n_symbols": "char_length(t) - char_length(translate(t, '#*$%&|<>', ''))",
    "n_dup_lines": f"element_at(transform(array(filter(split(t, '\\n'), l -> translate(l, '{SPACE}', '') <> '')), l -> size(l) - size(array_distinct(l))), 1)",
    "n_repeat_words": f"if(size(w) < 4, 0, {REPEATED})",
}
#: Further figures of the vector: marks, capitals and distinct words.
FIGURES = {
    "n_marks": f"char_length(t) - char_length(translate(t, '{MARKS}', ''))",
    "n_capitals": f"char_length(t) - char_length(translate(t, '{CAPITALS}', ''))",
    "n_distinct": "size(array_distinct(w))",
}


def statistics(text: str = "text") -> Column:
    """A struct of the statistics (long) of a whole text, given as an SQL expression; all 0 for null."""
    inner = ", ".join(f"'{name}', cast({rule} as bigint)" for name, rule in (STATISTICS | FIGURES).items())
    bound = f"element_at(transform(array(coalesce({text}, '')), t -> element_at(transform(array(filter(split(t, '[ \\\\t-\\\\r]+'), x -> x <> '')), w -> named_struct({inner})), 1)), 1)"
    return F.expr(bound)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def vector(s: str) -> list[str]:
    """Mean word length (its logarithm), marks and capitals for each word (square roots, as counts vary by theirs), and how distinct words
    fall behind words: the square root of log(words / distinct) / log(words)^2, which hardly depends on the length of a text."""
    words = f"greatest({s}.n_words, 2)"
    return [
        f"ln(greatest({s}.word_chars, 1) / {words})",
        f"sqrt({s}.n_marks / {words})",
        f"sqrt({s}.n_capitals / {words})",
        f"sqrt(ln({words} / least(greatest({s}.n_distinct, 1), {words}))) / ln({words})",
    ]


def group_key(lang: str, source: str) -> Column:
    """A non-null string for each pair, null values included."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.expr(c)), F.lit("?"))
    return F.concat(part(lang), F.lit("\u0001"), part(source))


def chi_square(x: float, dimensions: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dimensions // 2))


def chi_square_quantile(p: float, dimensions: int = DIMENSIONS) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        low, high = (m, high) if chi_square(m := (low + high) / 2, dimensions) < p else (low, m)
    return high


PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]
X = [f"x{i}" for i in range(DIMENSIONS)]
CENTRE = [f"m{i}" for i in range(DIMENSIONS)]
SCATTER = [f"c{i}{j}" for i, j in PAIRS]
FACTOR = [f"l{i}{j}" for i, j in PAIRS]


def factor(estimates: DataFrame, ridge: list[float], scale: float = 1.0) -> DataFrame:
    """Adds the lower Cholesky factor l{i}{j} of the covariance c{i}{j} times `scale`, with the ridge added to its diagonal, and the
    logarithm `det` of its determinant. Each entry is named by later ones (lateral aliases), so no expression grows."""
    entries = []
    for i, j in PAIRS:
        rest = f"c{i}{j} * {scale!r}D" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        entries.append(f"sqrt(greatest({rest} + {ridge[i]!r}D, {ridge[i] / 4!r}D)) AS l{i}{i}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    kept = [c for c in estimates.columns if c not in FACTOR and c != "det"]
    return estimates.selectExpr(*kept, *entries, " + ".join(f"2 * ln(l{i}{i})" for i in range(DIMENSIONS)) + " AS det")


def with_distance(rows: DataFrame, name: str, x: list[str]) -> DataFrame:
    """Adds the squared Mahalanobis distance of the expressions `x` by forward substitution, from the columns of `factor`."""
    solved = [f"({x[i]} - m{i}" + "".join(f" - l{i}{k} * __y{k}" for k in range(i)) + f") / l{i}{i} AS __y{i}" for i in range(DIMENSIONS)]
    return rows.selectExpr("*", *solved).selectExpr(*[f"`{c}`" for c in rows.columns], " + ".join(f"__y{i} * __y{i}" for i in range(DIMENSIONS)) + f" AS `{name}`")


def attached(rows: DataFrame, table: DataFrame) -> DataFrame:
    """`rows` with the columns of a written table of estimates, by g."""
    return common.attach(rows, table, "g", SENT_GROUPS)


SUMS = [f"s{i}" for i in range(DIMENSIONS)] + [f"s{i}{j}" for i, j in PAIRS]


def grouped(rows: DataFrame, keys: list[str], *expressions: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*map(F.expr, expressions))


def moments(rows: DataFrame, *keys: str) -> DataFrame:
    """Means m{i} and covariances c{i}{j} by keys from sums s{i}, s{i}{j} and counts n."""
    kept = grouped(rows, list(keys), "sum(n) AS n", *[f"sum({s}) AS {s}" for s in SUMS])
    return kept.selectExpr(*keys, *[f"s{i} / n AS m{i}" for i in range(DIMENSIONS)], *[f"s{i}{j} / n - (s{i} / n) * (s{j} / n) AS c{i}{j}" for i, j in PAIRS])


def sums(rows: DataFrame, *keys: str) -> DataFrame:
    return grouped(rows, list(keys), "count(*) AS n", *[f"sum(x{i}) AS s{i}" for i in range(DIMENSIONS)], *[f"sum(x{i} * x{j}) AS s{i}{j}" for i, j in PAIRS])


def quartiles(rows: DataFrame, total: int | None = None) -> DataFrame:
    """n, medians m{i} and spreads d{i} by g: from the quartiles, or the standard deviation where those are equal. `total` is about the
    number of rows, if it is known (as below)."""
    found = grouped(rows, ["g"], "count(*) AS n", *[f"percentile_approx({x}, array(0.25D, 0.5D, 0.75D), 1000) AS q{x}" for x in X], *[f"stddev_pop({x}) AS d{x}" for x in X])
    spread = [f"if(q{x}[2] > q{x}[0], (q{x}[2] - q{x}[0]) / 1.349D, greatest(d{x}, 1e-9D)) AS d{i}" for i, x in enumerate(X)]
    return common.few(found, total).selectExpr("g", "n", *[f"q{x}[1] AS m{i}" for i, x in enumerate(X)], *spread)


def starts(rows: DataFrame, middle: DataFrame, total: int | None = None) -> DataFrame:
    """(g, n, start, m, c): the medians, with three correlations over the spreads: none, of hyperbolic tangents, of directions."""
    scored = attached(rows, middle).selectExpr("g", *[f"greatest(-1e6D, least(1e6D, (x{i} - m{i}) / d{i})) AS z{i}" for i in range(DIMENSIONS)])
    norm = "sqrt(1e-12D + " + " + ".join(f"z{i} * z{i}" for i in range(DIMENSIONS)) + ")"
    scored = scored.selectExpr("g", f"{norm} AS norm", *[f"tanh(z{i}) AS t{i}" for i in range(DIMENSIONS)], *[f"z{i} / norm AS u{i}" for i in range(DIMENSIONS)])
    shapes = common.few(grouped(scored, ["g"], *[f"avg({k}{i} * {k}{j}) AS {k}{i}{j}" for k in "tu" for i, j in PAIRS]), total)
    related = lambda k, i, j: f"0.9D * coalesce(try_divide({k}{i}{j}, sqrt({k}{i}{i} * {k}{j}{j})), 0D)" if k else "0D"
    given = [f"named_struct('start', {at}, " + ", ".join(f"'c{i}{j}', d{i} * d{j}" + ("" if i == j else f" * {related(k, i, j)}") for i, j in PAIRS) + ")" for at, k in enumerate(("", "t", "u"))]
    return attached(shapes, middle).selectExpr("g", "n", *CENTRE, f"explode(array({', '.join(given)})) AS s").selectExpr("g", "n", *CENTRE, "s.*")


def scaled(columns: list[str], scale: float) -> dict[str, str]:
    return {c: f"{c} * {scale!r}D" if c in SCATTER else c for c in columns}


def aims(target: DataFrame, names: list[str]) -> DataFrame:
    """The columns `names` of a written table of estimates as w{name}, by g."""
    return common.renamed(target, "g", *[F.col(c).alias(f"w{c}") for c in names])


def mixed(own: dict[str, str], names: list[str]) -> list[str]:
    """Expressions by column; `names` among them are drawn towards the columns w{name}, the more the smaller n is."""
    return [f"(n * {e} + {OWN_ROWS} * w{c}) / (n + {OWN_ROWS}) AS {c}" if c in names else f"{e} AS {c}" for c, e in own.items()]


def towards(found: DataFrame, target: DataFrame | None, names: list[str], scale: float = 1.0) -> DataFrame:
    """Estimates (g, n, ...) with scatter times `scale`, and `names` drawn towards those of a written table by g, the more the fewer rows they come from."""
    own = scaled(found.columns, scale)
    return found.selectExpr(*mixed(own, [])) if target is None else attached(found, aims(target, names)).selectExpr(*mixed(own, names))


def concentrate(rows: DataFrame, sizes: DataFrame, middle: DataFrame, ridge: list[float], target: DataFrame | None = None, coverage: float = COVERAGE, steps: int = STEPS, total: int | None = None) -> DataFrame:
    """(g, m, c, l): the estimate with the least determinant that the concentration steps reach from any start."""
    names, starting = [*CENTRE, *SCATTER], total and 3 * total
    frame = sizes if target is None else common.cut(attached(sizes, aims(target, names)))
    current = common.cut(factor(towards(starts(rows, middle, total), target, names), ridge).drop("n"))
    consistent = coverage / chi_square(chi_square_quantile(coverage), DIMENSIONS + 2)
    before = None
    for _ in range(steps):
        away = with_distance(attached(rows, current), "away", X)
        bins = common.few(sums(away.withColumn("bin", bin_of("away")), "g", "start", "bin"), starting)
        within = bins.selectExpr("*", "coalesce(sum(n) OVER (PARTITION BY g, start ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nearer", "sum(n) OVER (PARTITION BY g, start) AS every")
        kept = common.few(moments(within.where(f"nearer < {coverage} * every"), "g", "start"), starting)
        found = attached(kept, frame).selectExpr(*mixed(scaled(["n", *kept.columns], consistent), names if target is not None else []))
        current = common.cut(factor(found, ridge).drop("n"), det=F.sum("det"))
        groups, now = common.rows_of(current), current.seen["det"]
        if not groups or before is not None and before - now < 1e-2 * groups:
            break
        before = now
    best = grouped(current, ["g"], f"min_by(struct({', '.join([*names, *FACTOR])}), det) AS e").select("g", "e.*")
    return common.cut(common.few(best, common.rows_of(current)))


def estimate(rows: DataFrame, ridge: list[float], target: DataFrame | None = None, total: int | None = None, **limits) -> DataFrame:
    """(g, n, m, c): size, centre and scatter for each group g of (g, x0..x3) by the minimum covariance determinant, reweighted.

    `target` holds a centre and scatter for each g; with it, every estimate on the way is drawn towards it, so that few rows suffice.
    """
    middle = common.cut(quartiles(rows, total))
    sizes = common.renamed(middle, "g", "n")
    names, inner = [*CENTRE, *SCATTER], chi_square_quantile(0.975)
    least = concentrate(rows, sizes, middle, ridge, target, total=total, **limits)
    near = moments(sums(with_distance(attached(rows, least), "away", X).where(f"away <= {inner}"), "g"), "g")
    near = attached(common.few(near, total), sizes)
    near = towards(near.select("g", "n", *names), target, names, 0.975 / chi_square(inner, DIMENSIONS + 2)).selectExpr("g", *[f"{c} AS near_{c}" for c in names])
    joined = attached(least.select("g", *names), sizes).join(near, "g", "left")  # where none of its rows is near, the estimate before stays
    return joined.selectExpr("g", "n", *[f"coalesce(near_{c}, {c}) AS {c}" for c in names])


def with_statistics(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """`docs` with columns __s (statistics) and __g (group); what they had under these names is replaced."""
    return docs.withColumns({"__s": statistics(text), "__g": group_key(lang, source)})


def vectors(stats: DataFrame) -> DataFrame:
    """(g, words, x0..x3) of the rows that pass the plain limits."""
    return stats.where(~base_failed(F.col("__s"))).selectExpr("__g AS g", "__s.n_words AS words", *[f"{v} AS {c}" for v, c in zip(vector("__s"), X, strict=True)])


def drawn(x: str, i: int, words: str) -> str:
    """Figure `i` drawn towards the median of its group, the more the shorter the text is."""
    return f"(md{i} + ({x} - md{i}) * sqrt({words} / ({words} + {OWN_WORDS})))"


def language_key(g: str) -> Column:
    """The part of a group key that stands for its language; no group key lacks the separator, so it is never one itself."""
    return F.substring_index(g, "\u0001", 1)


def by_scope(rows: DataFrame, groups: DataFrame, found) -> DataFrame:
    """`found(rows, target)` for all rows, then for each language with the former as target, then for each group with its language's.

    Languages and groups (a written table of keys g) without any row get what their target holds.
    """

    def complete(part: DataFrame, target: DataFrame) -> DataFrame:
        names = [c for c in part.columns if c not in ("g", "n")]
        own = part.select("g", F.col("n").alias("own_n"), *[F.col(c).alias(f"own_{c}") for c in names])
        return target.join(own, "g", "left").selectExpr("g", "coalesce(own_n, 0L) AS n", *[f"if(own_n IS NULL, {c}, own_{c}) AS {c}" for c in names])

    every = found(rows.withColumn("g", F.lit("")), None).drop("n").withColumnRenamed("g", "in")
    languages = common.few(groups.select(language_key("g").alias("g")).distinct(), common.rows_of(groups)).withColumn("in", F.lit(""))
    target = common.cut(languages.join(F.broadcast(every), "in").drop("in"))  # `every` is one row
    wide = complete(found(rows.withColumn("g", language_key("g")), target), target).drop("n").withColumnRenamed("g", "in")
    wide = F.broadcast(wide) if common.rows_of(target) <= SENT_GROUPS else wide  # as many rows as `target`
    target = common.cut(groups.withColumn("in", language_key("g")).join(wide, "in").drop("in"))
    return complete(found(rows, target), target)


def fit(stats: DataFrame, **limits) -> DataFrame:
    """(g, n, m, c, md, l) for every group g of rows with __s and __g: its medians, and the centre and factor its rows are judged by.

    There are no estimates if no row at all passes the plain limits."""
    rows, total = vectors(stats), common.rows_of(stats)
    groups = common.cut(common.few(stats.select(F.col("__g").alias("g")).distinct(), total))
    medians = by_scope(rows, groups, lambda x, target: towards(quartiles(x, total).select("g", "n", *CENTRE), target, CENTRE))
    medians = common.cut(medians.select("g", *[F.col(c).alias(f"md{i}") for i, c in enumerate(CENTRE)]))
    pulled = common.cut(attached(rows, medians).selectExpr("g", *[f"{drawn(c, i, 'words')} AS p{c}" for i, c in enumerate(X)]).toDF("g", *X))
    spread = quartiles(pulled.withColumn("g", F.lit("")), total).first()
    ridge = [RIDGE * spread[f"d{i}"] ** 2 if spread else 1e-18 for i in range(DIMENSIONS)]
    found = by_scope(pulled, groups, lambda x, target: estimate(x, ridge, target, total, **limits))
    return common.cut(factor(attached(found, medians), ridge))


def bin_of(name: str) -> Column:
    return F.expr(f"floor(ln({name} + 1e-9D) * {FINE})")


def least_dense(counts: dict[int, int], tails: tuple[float, float] = TAILS) -> float:
    """The cut between `tails` where rows by bin of distance are fewest, bins around weighted by nearness: the middle of the longest run of
    bins with as few (the first of those)."""
    low, high = (math.floor(math.log(chi_square_quantile(1 - t)) * FINE) for t in tails)
    near = {k: AROUND + 1 - abs(k) for k in range(-AROUND, AROUND + 1)}
    dense = [sum(counts.get(at + k, 0) * w for k, w in near.items()) for at in range(low, high + 1)]
    runs = [[at for at, _ in run] for fewest, run in groupby(enumerate(dense), key=lambda x: x[1] == min(dense)) if fewest]
    longest = max(runs, key=len)
    return math.exp((low + (longest[0] + longest[-1] + 1) / 2) / FINE)


def judged_vector() -> list[str]:
    return [drawn(v, i, "__s.n_words") for i, v in enumerate(vector("__s"))]


def cut_of(stats: DataFrame, estimates: DataFrame) -> float:
    """The cut for rows with __s and __g, from the counts of a bounded number of bins."""
    rows = attached(stats.where(~base_failed(F.col("__s"))).selectExpr("__s", "__g AS g"), estimates)
    low, high = (chi_square_quantile(1 - t) for t in TAILS)
    around = math.exp((AROUND + 1) / FINE)
    near = with_distance(rows, "d", judged_vector()).where(f"d BETWEEN {low / around} AND {high * around}")
    return least_dense(dict(common.few(near.groupBy(bin_of("d")).count(), common.rows_of(stats)).collect()))


def judge(stats: DataFrame, estimates: DataFrame, cut: float) -> DataFrame:
    """Adds __distance (null only if no row at all passes the plain limits) and __kept to rows with __s and __g."""
    params = estimates.selectExpr("g AS __g", *[f"md{i}" for i in range(DIMENSIONS)], *CENTRE, *FACTOR)
    if clash := [c for c in params.columns if c in stats.columns and c != "__g"]:
        raise ValueError(f"columns {clash} clash with those of the estimates; put them into a struct")
    rows = with_distance(common.attach(stats, params, "__g", SENT_GROUPS, "left"), "__distance", judged_vector())
    kept = ~base_failed(F.col("__s")) & F.coalesce(F.col("__distance") <= cut, F.lit(False))
    return rows.withColumn("__kept", kept).select(*[f"`{c}`" for c in stats.columns], "__distance", "__kept")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", **limits) -> DataFrame:
    """The rows of `docs` that pass, with their columns as they are.

    Null and empty texts have no words and are rejected. A null language or source is a value of its own. The fewer rows a group has, the
    more it is judged by its language and by all rows. Repeated rows are judged alike, rows at the cut are kept; an empty table gives an
    empty result. Rows are written once with their statistics, which the estimates and the verdict read.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    stats = common.cut(with_statistics(own, *[f"row.`{c}`" for c in (text, lang, source)]))
    fitted = fit(stats, **limits)
    return judge(stats, fitted, cut_of(stats, fitted)).where("__kept").select("row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    stats = common.cut(with_statistics(docs).select("doc_id", "__s", "__g"))
    fitted = fit(stats)
    judged = judge(stats, fitted, cut_of(stats, fitted))
    return judged.select("doc_id", *[F.col(f"__s.{c}") for c in STATISTICS], base_failed(F.col("__s")).alias("base_failed"), F.col("__kept").alias("kept"), F.col("__distance").alias("distance"))


QUERIES = {"op3_quality_rules": op3_quality_rules}
SQL: dict[str, str] = {}
