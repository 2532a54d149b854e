"""What a forecast document says at a time: groups to intervals, baseline, overlays, wind overrides, composites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FIELDS = ("wind_dir", "wind_speed", "gust", "vis_m", "ceiling_ft", "weather")


def absolutise(groups: DataFrame, anchor: str, token: str, out: str) -> DataFrame:
    """DDHH or DDHHMM against an anchor; an earlier day is next month's, hour 24 is the next day's 0, no such day is null."""
    dd, hh = F.expr(f"try_cast(substring({token}, 1, 2) as int)"), F.expr(f"try_cast(substring({token}, 3, 2) as int)")
    mi = F.coalesce(F.expr(f"try_cast(nullif(substring({token}, 5, 2), '') as int)"), F.lit(0))
    month = F.trunc(F.when(dd < F.dayofmonth(anchor), F.add_months(F.to_date(anchor), 1)).otherwise(F.to_date(anchor)), "month")
    day = F.when((dd >= 1) & (dd <= F.dayofmonth(F.last_day(month))), F.date_add(month, dd - 1))
    return groups.withColumn(out, day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hh, mi))


def baseline(groups: DataFrame, times: DataFrame, by: list[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The state at each time: the last FM or INITIAL group at or before it, then every BECMG complete by then, in order.

    groups: by, kind, start, end and fields (null: not said). A BECMG overrides only what it says. Groups of one
    document meet its times in an equi join; the fold is an ordered aggregate over the few groups of a document.
    """
    g = F.struct(F.when(F.col("kind") == "BECMG", F.col("end")).otherwise(F.col("start")).alias("at"), (F.col("kind") == "BECMG").cast("int").alias("later"), *fields)
    lists = groups.where(F.col("kind").isin("INITIAL", "FM", "BECMG")).groupBy(*by).agg(F.array_sort(F.collect_list(g)).alias("g"))
    blank = "named_struct(" + ", ".join(f"'{f}', cast(null as {dict(groups.dtypes)[f]})" for f in fields) + ")"
    whole = "named_struct(" + ", ".join(f"'{f}', x.{f}" for f in fields) + ")"
    over = "named_struct(" + ", ".join(f"'{f}', coalesce(x.{f}, a.{f})" for f in fields) + ")"
    fold = f"aggregate(filter(g, x -> x.at <= t), {blank}, (a, x) -> if(x.later = 0, {whole}, {over}))"
    return times.join(lists, by).withColumn("s", F.expr(fold)).select(*times.columns, "s.*")


def overlays(groups: DataFrame, times: DataFrame, by: list[str]) -> DataFrame:
    """The temporary groups active at each time, with what they don't say left null."""
    temp = groups.where(F.col("kind").startswith("TEMPO") | F.col("kind").startswith("PROB")).select(*by, "kind", "start", "end", *FIELDS)
    return times.join(temp, by).where((F.col("start") <= F.col("t")) & (F.col("t") < F.col("end"))).select(*times.columns, "kind", *FIELDS)


def folded(groups: DataFrame, fields: tuple[str, ...], changes: bool = False) -> DataFrame:
    """A row for each INITIAL group: doc, station, h (its validity), and a document's groups folded once, in order of their times.

    _s: the states (at, fields) from `at` on until the next one's, behind a first one that says nothing; _o: the temporary groups (grp, where groups
    have one, start, end, fields); with changes, _t: the FM and BECMG groups (kind, grp, start, end, fields). Groups are gathered by document, of which
    each has a handful.
    """
    kinds = dict(groups.dtypes)
    whole = F.col("kind").isin("INITIAL", "FM", "BECMG")
    at = F.when(F.col("kind") == "BECMG", F.col("end")).otherwise(F.col("start"))
    temporary = (F.col("kind").startswith("TEMPO") | F.col("kind").startswith("PROB")) & F.col("start").isNotNull() & F.col("end").isNotNull()
    base = F.collect_list(F.when(whole & at.isNotNull(), F.struct(at.cast("long").alias("at"), (F.col("kind") == "BECMG").cast("int").alias("later"), *fields)))
    slot = ["grp"] if "grp" in groups.columns else []
    over = F.collect_list(F.when(temporary, F.struct(*slot, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), *fields)))
    first = F.collect_list(F.when((F.col("kind") == "INITIAL") & F.col("valid_h").isNotNull(), F.struct("station", F.col("valid_h").cast("long").alias("h"))))
    changing = F.when(F.col("kind").isin("FM", "BECMG"), F.struct("kind", "grp", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), *fields))
    more = [F.collect_list(changing).alias("_t")] if changes else []
    kept = ["_t"] if changes else []
    # a document without an INITIAL group says nothing: it goes before its groups are gathered
    begun = groups.where("doc is not null").withColumn("_begun", F.max(F.col("kind") == "INITIAL").over(W.partitionBy("doc"))).where("_begun")
    lists = begun.groupBy("doc").agg(F.array_sort(base).alias("_g"), over.alias("_o"), first.alias("_i"), *more)
    blank = "named_struct('at', cast(-9000000000000000000 as bigint), " + ", ".join(f"'{f}', cast(null as {kinds[f]})" for f in fields) + ")"
    step = "named_struct('at', x.at, " + ", ".join(f"'{f}', if(x.later = 0, x.{f}, coalesce(x.{f}, element_at(a, -1).{f}))" for f in fields) + ")"
    rows = lists.select("doc", "_o", *kept, F.explode("_i").alias("i"), F.expr(f"aggregate(_g, array({blank}), (a, x) -> concat(a, array({step})))").alias("_s"))
    return rows.select("doc", "i.station", "i.h", "_s", "_o", *kept)


def state_stretches(rows: DataFrame, hours: int, fields: tuple[str, ...]) -> DataFrame:
    """`folded` with _c: the stretches of hours (_lo, _hi, fields, alternate: false) of each state from h on that have an hour."""
    said = ", ".join(f"'{f}', s.{f}" for f in fields)
    last = f"h + {hours - 1}"
    states = f"transform(_s, (s, k) -> named_struct('_lo', greatest(s.at, h), '_hi', least(coalesce(try_element_at(_s, k + 2).at - 1, {last}), {last}), {said}, 'alternate', false))"
    return rows.withColumn("_c", F.expr(states)).withColumn("_c", F.expr("filter(_c, s -> s._lo <= s._hi)"))


def stretches(groups: DataFrame, hours: int, fields: tuple[str, ...], unsaid: tuple[str, ...] = ()) -> DataFrame:
    """doc, station, h, lo, hi, fields, alternate: `spoken` before its hours are dealt out: what is said alike from hour lo to hour hi."""
    kinds = dict(groups.dtypes)
    told = ", ".join(f"'{f}', " + (f"cast(null as {kinds[f]})" if f in unsaid else f"coalesce(x.{f}, s.{f})") for f in fields)
    alternates = f"flatten(transform(_o, x -> transform(_c, s -> named_struct('_lo', greatest(s._lo, x.start), '_hi', least(s._hi, x.end - 1), {told}, 'alternate', true))))"
    rows = state_stretches(folded(groups, fields), hours, fields)
    rows = rows.select("doc", "station", "h", F.explode(F.expr(f"concat(_c, filter({alternates}, s -> s._lo <= s._hi))")).alias("c"))
    return rows.select("doc", "station", "h", F.col("c._lo").alias("lo"), F.col("c._hi").alias("hi"), *(F.col(f"c.{f}").alias(f) for f in fields), "c.alternate")


def spoken(groups: DataFrame, hours: int, fields: tuple[str, ...], unsaid: tuple[str, ...] = ()) -> DataFrame:
    """Doc, station, t, fields, alternate: `baseline` and `overlays` for each of the `hours` from a document's INITIAL validity on.

    groups: doc, station, kind, valid_h, start, end, fields. States change at groups alone, so a document's groups are folded once to stretches of hours,
    an alternate's stretches are its hours in each state's, and only then are hours dealt out: one grouping by document.
    Alternates don't say the fields of `unsaid`.
    """
    rows = stretches(groups, hours, fields, unsaid)
    return rows.select("doc", "station", F.explode(F.sequence("lo", "hi")).alias("t"), *fields, "alternate")


def composite(bulletins: DataFrame, by: list[str]) -> DataFrame:
    """Which bulletin governs when: effective times never fall, are clamped to the product's window, and end at the next."""
    w = W.partitionBy(*by).orderBy("issue", "bulletin")
    eff = F.greatest(F.max(F.greatest("issue", "valid_from")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)), F.first("valid_from").over(w))
    stop = F.max("valid_to").over(W.partitionBy(*by))
    rows = bulletins.withColumn("start", eff)
    rows = rows.withColumn("end", F.least(F.coalesce(F.lead("start").over(w), stop), stop))
    return rows.where("start < end")


def wind_overrides(states: DataFrame, overrides: DataFrame, by: list[str]) -> DataFrame:
    """The last override at or before a time replaces the wind alone."""
    last = states.select(*by, "t").distinct().join(overrides, by).where("after <= t").groupBy(*by, "t").agg(F.max_by(F.struct("o_dir", "o_speed", "o_gust"), "after").alias("o"))
    j = states.join(last, [*by, "t"], "left")
    pick = lambda f, o: F.when(F.col("o").isNotNull(), F.col(f"o.{o}")).otherwise(F.col(f)).alias(f)
    return j.select(*(pick(c, {"wind_dir": "o_dir", "wind_speed": "o_speed", "gust": "o_gust"}[c]) if c in ("wind_dir", "wind_speed", "gust") else F.col(c) for c in states.columns))


def prevailing_groups(states: DataFrame, by: list[str], fields: tuple[str, ...] = FIELDS, last: str = "t") -> DataFrame:
    """Hourly states (by, t, fields) to the fewest groups that give them back: by, kind, start, end, fields.

    The first hour's state is the INITIAL group, and each hour whose state differs from the one before it begins a group. That is a
    BECMG, complete by then and saying what changes, where at most half of the fields change and none becomes unknown; else
    an FM with the whole state. Fewer groups can't do, as each tells of one change. A state may stand for the hours from t to `last`.
    """
    w = W.partitionBy(*by).orderBy("t")
    state = F.struct(*fields)
    rows = states.withColumn("_state", state).withColumn("_before", F.lag("_state").over(w)).withColumn("_first", F.min("t").over(W.partitionBy(*by))).withColumn("_last", F.max(last).over(W.partitionBy(*by)))
    rows = rows.where(F.col("_before").isNull() | ~F.col("_state").eqNullSafe(F.col("_before")))
    same = [F.col(f"_state.{c}").eqNullSafe(F.col(f"_before.{c}")) for c in fields]
    changed = sum((F.when(x, 0).otherwise(1) for x in same[1:]), F.when(same[0], 0).otherwise(1))
    lost = F.lit(False)
    for c in fields:
        lost = lost | (F.col(f"_state.{c}").isNull() & F.col(f"_before.{c}").isNotNull())
    kind = F.when(F.col("_before").isNull(), "INITIAL").when((2 * changed <= len(fields)) & ~lost, "BECMG").otherwise("FM")
    rows = rows.withColumn("kind", kind)
    becoming = F.col("kind") == "BECMG"
    said = [F.when(becoming & x, None).otherwise(F.col(f"_state.{c}")).alias(c) for c, x in zip(fields, same)]
    start = F.when(becoming, F.greatest(F.col("t") - 1, F.col("_first"))).otherwise(F.col("t"))
    return rows.select(*by, "kind", start.alias("start"), F.when(becoming, F.col("t")).otherwise(F.col("_last") + 1).alias("end"), *said)


def temporary_groups(alternates: DataFrame, states: DataFrame, by: list[str], slot: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Alternates (by, slot, t, fields: whole states) to the fewest TEMPO groups that give them back over the hourly states.

    Consecutive hours of a slot make one group as long as each field either keeps its value, and is said, or is the prevailing one in all of
    them, and isn't. A shorter run of such hours is one as well, so the longest runs from the first hour on are the fewest. The hours of a
    document's slot are folded in order; they are a handful.
    """
    p = states.select(*by, "t", F.struct(*fields).alias("p"))
    hours = alternates.select(*by, slot, "t", F.struct(*fields).alias("a")).join(p, [*by, "t"])
    lists = hours.groupBy(*by, slot).agg(F.array_sort(F.collect_list(F.struct("t", F.col("t").alias("until"), "a", "p"))).alias("h"))
    return temporary_runs(lists, dict(alternates.dtypes), by, slot, fields)


def temporary_runs(lists: DataFrame, kinds: dict[str, str], by: list[str], slot: str, fields: tuple[str, ...]) -> DataFrame:
    """`temporary_groups` of slots that are gathered: by, slot, h: array of t, until, a, p in order: the hours from t to until have the alternate a over the state p."""
    # a run: start, end, the value of each field, whether it is kept (c), whether it is the prevailing one (e)
    run = ", ".join(f"v_{f}: {kinds[f]}, c_{f}: boolean, e_{f}: boolean" for f in fields)
    first = "named_struct('start', x.t, 'end', x.until, " + ", ".join(f"'v_{f}', x.a.{f}, 'c_{f}', true, 'e_{f}', x.a.{f} <=> x.p.{f}" for f in fields) + ")"
    kept = {f: f"(r.c_{f} and (r.v_{f} <=> x.a.{f}))" for f in fields}
    even = {f: f"(r.e_{f} and (x.a.{f} <=> x.p.{f}))" for f in fields}
    goes_on = " and ".join(["x.t = r.end + 1", *(f"({kept[f]} or {even[f]})" for f in fields)])
    longer = "named_struct('start', r.start, 'end', x.until, " + ", ".join(f"'v_{f}', r.v_{f}, 'c_{f}', {kept[f]}, 'e_{f}', {even[f]}" for f in fields) + ")"
    typed = f"cast(array() as array<struct<start: bigint, end: bigint, {run}>>)"
    # the last run is looked at by a transform over an array of one, which names it once
    step = f"if(size(acc) = 0, array({first}), flatten(transform(slice(acc, -1, 1), r -> if({goes_on}, concat(slice(acc, 1, size(acc) - 1), array({longer})), concat(acc, array({first}))))))"
    runs = lists.select(*by, slot, F.expr(f"explode(aggregate(h, {typed}, (acc, x) -> {step}))").alias("r"))
    return runs.select(*by, slot, F.lit("TEMPO").alias("kind"), F.col("r.start").alias("start"), (F.col("r.end") + 1).alias("end"), *(F.when(~F.col(f"r.e_{f}"), F.col(f"r.v_{f}")).alias(f) for f in fields))
