"""Column-level data quality of repeated loads: declared checks compiled into one shared aggregate scan.

The scan turns each cell of a load into at most two hashed entries, its value and (where asked) its format, and counts
them: (feed, load, column, kind, 128-bit hash, number) -> rows. No text is in this state. States of files, partitions or
days merge by adding counts, so a new load costs only its own scan. Everything else is compiled from the checks: figures
of each load and column are one aggregate of the state; what has to be held against the base is one exchange of the
compared entries, into buckets of a column's values, in which base counts, set differences, share differences and local
cumulative differences are taken at once. A check is a measure over these figures, a limit and the columns it covers;
`issues` evaluates all of them in one projection.

Scale: entries are counted on the map side, so a hot feed or value leaves a map task as one row. Buckets are cut at the
column's own approximate quantiles (numbers) or by hash (text), so no task holds a whole hot column; cumulative shares
over buckets follow from the buckets' totals, a table of feeds x loads x columns x BUCKETS rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaria.plans.materialize import cut, small_side

#: Texts that stand for "no value", compared without case and outer spaces.
NO_VALUE = (
    "", "-", "--", "---", ".", "..", "?", "??", "*", "#n/d", "#n/a", "#n/d!", "#null!", "#value!", "#ref!", "n/a", "n.a.", "n/d", "n.d.", "n/i", "n.i.", "s/d", "s/i", "s/n", "na", "nd", "nan",
    "nil", "none", "null", "(null)", "<null>", "<na>", "\\n", "(blank)", "blank", "empty", "vazio", "em branco", "missing", "unknown", "undefined", "not available", "not informed", "no value",
    "desconhecido", "indefinido", "ignorado", "não informado", "nao informado", "não disponível", "nao disponivel", "sem informação", "sem informacao", "sem valor", "sem dados",
    "desconocido", "no informado", "no disponible", "sin dato", "sin datos", "sin valor", "vacío", "vacio",
)
FEED, LOAD, NAME = "feed_id", "load_no", "column_name"
KEYS = (FEED, LOAD, NAME)
VALUE, FORMAT = 0, 1
EPS, BUCKETS, MAX_BROADCAST_FIGURES = 1e-9, 64, 50_000
BASE, LATER, ANY = "base", "later", "any"


@dataclass(frozen=True)
class Check:
    """An issue: `measure` (an expression over figures) exceeds `limit` in one of `columns`, in the loads it is meant for."""

    issue: str
    columns: Sequence[str]
    measure: str
    limit: float
    loads: str = LATER


@dataclass(frozen=True)
class Checks:
    """The columns of a table, the loads that are the base of a feed, what is declared of them, and the metrics that have
    to stay within the control limits of the loads before."""

    text: Sequence[str]
    numeric: Sequence[str]
    declared: Sequence[Check] = ()
    formats: Sequence[str] = ()
    control: Sequence[str] = ()
    base_loads: int = 3

    @property
    def columns(self) -> list[str]:
        return [*self.text, *self.numeric]

    def covers(self, *measures: str) -> list[str]:
        """Columns of the checks that use one of the measures."""
        return [c for c in self.columns if any(c in d.columns for d in self.declared for m in measures if m in d.measure)]


UPLOAD = Checks(
    text=("order_id", "order_date", "region", "category", "customer_feedback"),
    numeric=("amount", "quantity"),
    formats=("order_id", "order_date"),
    declared=(
        Check("missing", ("order_id", "order_date", "region", "category", "amount", "quantity", "customer_feedback"), "n_missing / n_rows - base_missing / base_rows", 0.10),
        Check("pattern", ("order_id", "order_date"), "pattern_share", 0.05),
        Check("value_set", ("region", "category"), "value_set_change", 0.30),
        Check("range", ("amount", "quantity"), "outside_share", 0.05),
        Check("distribution", ("region", "category", "amount", "quantity"), "distance", 0.25),
        Check("null_rate", ("order_id", "order_date", "region", "category", "amount", "quantity", "customer_feedback"), "abs(recorded_null_rate - n_null / n_rows)", 0.005, ANY),
        Check("n_unique", ("order_id", "order_date", "region", "category", "amount", "quantity", "customer_feedback"), "abs(recorded_unique - n_unique)", 0, ANY),
        Check("role", ("order_id", "order_date", "region", "category", "amount", "quantity", "customer_feedback"), "int(recorded_role <> first_role)", 0),
    ),
)


def value_format(value: Column) -> Column:
    """A value with each unbroken run of letters as one sign and each digit as another."""
    return F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "A"), r"\p{Nd}", "9")


#: White space around a value.
OUTER = " \t\n\x0b\f\r\u00a0"
LONGEST_NO_VALUE = max(map(len, NO_VALUE))


def stands_for_nothing(value: Column) -> Column:
    bare = F.btrim(value, F.lit(OUTER))
    return value.isNull() | F.when(F.length(bare) <= LONGEST_NO_VALUE, F.lower(bare).isin(*NO_VALUE)).otherwise(False)


_ENTRY = ("kind", "h1", "h2", "number", "absent", "length")


def value_state(df: DataFrame, checks: Checks = UPLOAD) -> DataFrame:
    """(feed_id, load_no, column_name, kind, h1, h2, number, absent, length, n): the mergeable state.

    kind is VALUE or FORMAT; h1 and h2 are a value's hash as written, null for a null or NaN one.
    """
    none = F.lit(None).cast("double")
    numbers = {c: F.nanvl(F.col(c).cast("double"), none) for c in checks.numeric}
    # each step is a projection of its own, so that no value is computed twice
    read = df.select(FEED, LOAD, *[F.col(c).cast("string").alias(f"v_{c}") for c in checks.text], *[x.alias(f"x_{c}") for c, x in numbers.items()], *[F.when(x.isNotNull(), F.col(c).cast("string")).alias(f"v_{c}") for c, x in numbers.items()])
    read = read.select("*", *[(F.col(f"x_{c}").isNull() if c in numbers else stands_for_nothing(F.col(f"v_{c}"))).alias(f"gone_{c}") for c in checks.columns])
    read = read.select("*", *[F.when(~F.col(f"gone_{c}"), value_format(F.col(f"v_{c}"))).alias(f"f_{c}") for c in checks.formats])

    def entry(c: str, kind: int, text: Column, number: Column, absent: Column) -> Column:
        h = [F.when(text.isNotNull(), F.xxhash64(*seed, text)) for seed in ((), (F.lit(1),))]
        return F.struct(F.lit(c).alias(NAME), F.lit(kind).alias("kind"), h[0].alias("h1"), h[1].alias("h2"), number.alias("number"), absent.alias("absent"), F.length(text).alias("length"))

    entries = [entry(c, VALUE, F.col(f"v_{c}"), F.col(f"x_{c}") if c in numbers else none, F.col(f"gone_{c}")) for c in checks.columns]
    entries += [F.when(F.col(f"f_{c}").isNotNull(), entry(c, FORMAT, F.col(f"f_{c}"), none, F.lit(False))) for c in checks.formats]
    rows = read.select(FEED, LOAD, F.explode(F.array(*entries)).alias("e")).where("e IS NOT NULL").select(FEED, LOAD, "e.*")
    return rows.groupBy(*KEYS, *_ENTRY).agg(F.count(F.lit(1)).alias("n"))


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all their rows."""
    whole = states[0]
    for s in states[1:]:
        whole = whole.unionByName(s)
    return whole.groupBy(*KEYS, *_ENTRY).agg(F.sum("n").alias("n"))


def _flagged(state: DataFrame, checks: Checks) -> DataFrame:
    return state.withColumn("is_base", F.col(LOAD) <= checks.base_loads)


def _n(when: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))


def profile(state: DataFrame, checks: Checks = UPLOAD, cuts: bool = False) -> DataFrame:
    """Per feed, load and column: rows, nulls, missing, distinct values as written, range, lengths, formats."""
    value, shown = F.col("kind") == VALUE, ~F.col("absent")
    is_format = F.col("kind") == FORMAT
    more = [F.percentile_approx("number", [i / BUCKETS for i in range(1, BUCKETS)], 1000).alias("cuts")] if cuts else []
    return state.groupBy(*KEYS).agg(
        _n(value).alias("n_rows"),
        _n(value & F.col("h1").isNull()).alias("n_null"),
        _n(value & F.col("absent")).alias("n_missing"),
        F.count(F.when(value, F.col("h1"))).alias("n_unique"),
        F.min("number").alias("min_number"),
        F.max("number").alias("max_number"),
        F.min(F.when(value & shown, F.col("length"))).alias("min_length"),
        F.max(F.when(value & shown, F.col("length"))).alias("max_length"),
        _n(value & shown).alias("n_values"),
        F.count(F.when(is_format, 1)).alias("n_formats"),
        *more,
    )


def with_base(figures: DataFrame, checks: Checks) -> DataFrame:
    """The figures with those of the feed's base: rows, missing ones, values, range, and where buckets are cut."""
    base, of = F.col(LOAD) <= checks.base_loads, Window.partitionBy(FEED, NAME)
    sums = {f"base_{c}": F.sum(F.when(base, F.col(f"n_{c}"))).over(of) for c in ("rows", "missing", "values")}
    low, high = F.min(F.when(base, F.col("min_number"))).over(of), F.max(F.when(base, F.col("max_number"))).over(of)
    return figures.withColumns({**sums, "low": low, "high": high, "cuts": F.max_by("cuts", F.when(F.col("cuts").isNotNull(), F.col("n_values"))).over(of)})


def compared(state: DataFrame, figures: DataFrame, checks: Checks, text: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """The figures with those against the base: pattern_share, value_set_change, outside_share and distance.

    distance is half the sum of the absolute differences of value shares for text; for numbers it is the largest
    difference of the cumulative shares. Between two of the load's values the load's share is constant and the base's is
    monotone, so that difference lies just before or at one of the load's values. Inside a bucket both cumulative counts
    start at zero; what lies in the buckets below moves all differences of a bucket alike.
    """
    shown = state.where(~F.col("absent") & ((F.col("kind") == FORMAT) | F.col(NAME).isin(*text, *numeric)))
    known = figures.select(*KEYS, "n_values", "base_values", "low", "high", "cuts")
    v = shown.join(small_side(known, MAX_BROADCAST_FIGURES), list(KEYS))
    below = F.size(F.filter("cuts", lambda c: c < F.col("number")))
    v = v.withColumn("bucket", F.when(F.col("number").isNull(), F.pmod("h1", F.lit(BUCKETS)).cast("int")).otherwise(below)).drop("cuts")
    in_bucket = (FEED, NAME, "kind", "bucket")
    base, own = F.when(F.col(LOAD) <= checks.base_loads, F.col("n")).otherwise(0), F.col("n")
    same = Window.partitionBy(*in_bucket, "h1", "h2")
    up_to = lambda *keys: Window.partitionBy(*keys).orderBy("number").rangeBetween(Window.unboundedPreceding, 0)
    v = v.repartition(*in_bucket)
    v = v.withColumns({"base_n": F.sum(base).over(same), "first": F.row_number().over(same.orderBy(LOAD)) == 1, "b_to": F.sum(base).over(up_to(*in_bucket)), "l_to": F.sum(own).over(up_to(*in_bucket, LOAD))})
    p, q = F.col("n") / F.col("n_values"), F.try_divide("base_n", "base_values")
    incl = F.try_divide("b_to", "base_values") - F.col("l_to") / F.col("n_values")
    excl = incl - q + p
    outside = (F.col("number") < F.col("low")) | (F.col("number") > F.col("high"))
    t = v.groupBy(*in_bucket, LOAD).agg(
        F.sum("n").alias("n"), F.first("n_values").alias("n_values"), F.first("base_values").alias("base_values"), _n(F.col("base_n") == 0).alias("odd"), F.count(F.lit(1)).alias("size"), F.count(F.when(F.col("base_n") > 0, 1)).alias("shared"),
        F.count(F.when(F.col("first") & (F.col("base_n") > 0), 1)).alias("base_size"), F.sum(F.abs(p - q)).alias("seen"), F.sum(q).alias("covered"), _n(outside).alias("outside"), F.max(F.greatest(incl, excl)).alias("most"), F.min(F.least(incl, excl)).alias("least"),
    )
    lower = lambda *keys: Window.partitionBy(FEED, NAME, "kind", *keys).orderBy("bucket").rangeBetween(Window.unboundedPreceding, -1)
    b_off = F.coalesce(F.sum(F.when(F.col(LOAD) <= checks.base_loads, F.col("n"))).over(lower()), F.lit(0))
    l_off = F.coalesce(F.sum("n").over(lower(LOAD)), F.lit(0))
    t = t.withColumn("off", F.try_divide(b_off, F.col("base_values")) - l_off / F.col("n_values"))
    form, value = F.col("kind") == FORMAT, F.col("kind") == VALUE
    t = t.groupBy(*KEYS).agg(
        F.sum(F.when(form, F.col("odd"))).alias("odd"), F.sum(F.when(form, F.col("n"))).alias("formatted"), F.sum(F.when(form, F.col("base_size"))).alias("base_forms"),
        *[F.sum(F.when(value, F.col(c))).alias(c) for c in ("size", "shared", "base_size", "seen", "covered", "outside")],
        F.max(F.when(value, F.greatest(F.col("most") + F.col("off"), -F.col("least") - F.col("off")))).alias("steps"),
    )
    out = figures.drop("cuts").join(t, list(KEYS), "left")
    of = Window.partitionBy(FEED, NAME)
    later, is_text, is_number = F.col(LOAD) > checks.base_loads, F.col(NAME).isin(*text), F.col(NAME).isin(*numeric)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    base_size, base_forms = F.sum("base_size").over(of), F.sum("base_forms").over(of)
    change = F.try_divide(zero("size") + base_size - 2 * zero("shared"), base_size)
    return out.withColumns(
        {
            "pattern_share": F.when(later & (base_forms > 0), F.try_divide("odd", "formatted")),
            "value_set_change": F.when(later & is_text, change),
            "outside_share": F.when(later & is_number & F.col("low").isNotNull(), F.try_divide("outside", "n_values")),
            "distance": F.when(later & (F.col("base_values") > 0), F.when(is_text, (F.col("seen") + 1 - F.col("covered")) / 2).when(is_number, F.col("steps"))),
        }
    ).drop("odd", "formatted", "base_forms", "size", "shared", "base_size", "seen", "covered", "outside", "steps")


def numeric_distance(s: DataFrame, columns: Sequence[str], checks: Checks = UPLOAD) -> DataFrame:
    """(feed_id, load_no, column_name, distance) of numeric columns of later loads, from the state alone."""
    figures = cut(with_base(profile(s, checks, cuts=True), checks))
    return compared(s, figures, checks, [], columns).where("distance IS NOT NULL").select(*KEYS, "distance")


def change_profile(df: DataFrame, checks: Checks = UPLOAD) -> DataFrame:
    """The profile with the number of formats of every column and, for later loads, how far the formats, values and
    distribution of the columns whose checks ask for it are from the base."""
    every = Checks(checks.text, checks.numeric, checks.declared, checks.columns, checks.control, checks.base_loads)
    out = _against_base(cut(value_state(df, every)), every)
    covered = lambda measure: F.when(F.col(NAME).isin(*checks.covers(measure)), F.col(measure)).alias(measure)
    mine = ("pattern_share", "value_set_change", "outside_share", "distance")
    return out.select(*[c for c in out.columns if c not in mine], *map(covered, mine))


def _against_base(state: DataFrame, checks: Checks) -> DataFrame:
    figures = cut(with_base(profile(state, checks, cuts=True), checks))
    both = checks.covers("value_set_change", "outside_share", "distance")
    return compared(state, figures, checks, [c for c in both if c in checks.text], [c for c in both if c in checks.numeric])


def with_recorded(figures: DataFrame, recorded: DataFrame) -> DataFrame:
    """The figures beside what was recorded for each load and column, and the role recorded for the first load."""
    r = recorded.where(F.col("name").isNotNull()).select(
        FEED, LOAD, F.col("name").alias(NAME), F.col("role").alias("recorded_role"), F.col("n_unique").alias("recorded_unique"), F.nanvl(F.col("null_rate").cast("double"), F.lit(None).cast("double")).alias("recorded_null_rate")
    )
    first = F.min(F.when(F.col(LOAD) == 1, F.col("recorded_role"))).over(Window.partitionBy(FEED, NAME))
    return figures.join(r.distinct().withColumn("first_role", first), list(KEYS), "full_outer")


def evaluated(figures: DataFrame, checks: Checks) -> DataFrame:
    """(feed_id, load_no, column_name, issue) of all declared checks that fail, distinct."""
    later = F.col(LOAD) > checks.base_loads
    failed = [F.when((F.expr(c.measure) > c.limit + EPS) & F.col(NAME).isin(*c.columns) & (later if c.loads == LATER else F.lit(True)), F.lit(c.issue)) for c in checks.declared]
    return figures.select(*KEYS, F.explode(F.array_compact(F.array(*failed))).alias("issue")).distinct()


def issues(df: DataFrame, recorded: DataFrame | None = None, checks: Checks = UPLOAD) -> DataFrame:
    """(feed_id, load_no, column_name, issue): every check that a load fails, distinct.

    Nulls, NaN, blanks and texts standing for "no value" are missing and enter no other check. A feed without base
    loads, or whose base has no value in a column, gives no row of the checks that need one; an empty table gives none.
    Repeated rows count as often as they were delivered. Columns besides the named ones are ignored. A metric under
    control that leaves its limits is the issue `control_<metric>`.
    """
    figures = _against_base(cut(value_state(df, checks)), checks)
    if recorded is None:
        recorded = df.sparkSession.createDataFrame([], f"{FEED} int, {LOAD} int, name string, role string, n_unique long, null_rate double")
    found = evaluated(with_recorded(figures, recorded), checks)
    if checks.control:
        out = control_limits(figures, checks.control).where("out_of_control")
        found = found.unionByName(out.select(*KEYS, F.concat(F.lit("control_"), "metric").alias("issue")))
    return found


def control_limits(figures: DataFrame, metrics: Sequence[str], sigmas: float = 3.0, least: int = 3) -> DataFrame:
    """(feed_id, load_no, column_name, metric, value, center, spread, out_of_control) per load and metric.

    Center and spread are the mean and sample deviation of the same metric over all earlier loads of the feed; a load
    is out of control if at least `least` precede it and it lies more than `sigmas` deviations from the center.
    """
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    long = figures.select(*KEYS, F.explode(cells).alias("c")).select(*KEYS, "c.*")
    w = Window.partitionBy(FEED, NAME, "metric").orderBy(LOAD).rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("center", F.avg("value").over(w)).withColumn("spread", F.stddev_samp("value").over(w)).withColumn("before", F.count("value").over(w))
    out = (F.col("before") >= least) & (F.abs(F.col("value") - F.col("center")) > sigmas * F.col("spread") + EPS)
    return long.withColumn("out_of_control", F.coalesce(out, F.lit(False))).drop("before")
