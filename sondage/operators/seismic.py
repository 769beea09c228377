"""Traces and travel times: offsets, pickers, reciprocity, layered refraction, dispersion images."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.ordered import lowest, quantiles


def offsets(traces: DataFrame, points: DataFrame, source: str, receiver: str) -> DataFrame:
    """Distance between source and receiver of each trace; null where a point isn't known."""
    s = points.where("role = 'source'").select(F.col("id").alias(source), F.col("x").alias("_sx"), F.col("y").alias("_sy"))
    r = points.where("role = 'receiver'").select(F.col("id").alias(receiver), F.col("x").alias("_rx"), F.col("y").alias("_ry"))
    d = F.sqrt((F.col("_sx") - F.col("_rx")) ** 2 + (F.col("_sy") - F.col("_ry")) ** 2)
    return traces.join(s, source, "left").join(r, receiver, "left").withColumn("offset", d).drop("_sx", "_sy", "_rx", "_ry")


def samples(traces: DataFrame, key: str, array: str) -> DataFrame:
    """A row per sample: key, i, v."""
    return traces.select(key, F.posexplode(array).alias("i", "v")).withColumn("v", F.col("v").cast("double"))


def _samples(traces: DataFrame, key: str, array: str) -> DataFrame:
    """As ``samples``, with the key as ``trace``: a key may have any name."""
    return samples(traces.select(F.col(key).alias("trace"), F.col(array).alias("a")), "trace", "a")


def _energy_ratios(traces: DataFrame, key: str, array: str, n: int, modified: bool) -> DataFrame:
    """(trace, i, r) where both windows are whole."""
    s = _samples(traces, key, array)
    w = Window.partitionBy("trace").orderBy("i")
    trail, lead = w.rowsBetween(-(n - 1), 0), w.rowsBetween(1, n)
    e = F.col("v") * F.col("v")
    r = s.select("trace", "i", "v", F.when(F.count("v").over(trail) == n, F.sum(e).over(trail)).alias("t"), F.when(F.count("v").over(lead) == n, F.sum(e).over(lead)).alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    floor = F.lit(1e-9) * F.max(F.col("t") + F.col("l")).over(Window.partitionBy("trace")) + F.lit(1e-30)
    r = r.select("trace", "i", "v", (F.col("l") / (F.col("t") + floor)).alias("r"))
    return r.withColumn("r", F.pow(F.col("r") * F.abs("v"), 3)) if modified else r


def energy_ratio(traces: DataFrame, key: str, array: str, n: int, modified: bool = False) -> DataFrame:
    """Per trace the sample with the largest ratio of the next ``n`` samples' energy to the last ``n`` ones', and the ratio.

    Only where both windows are whole. A floor of 1e-9 of the largest energy of both windows keeps a silent lead-in
    finite. ``modified``: the cube of the ratio times the sample's size.
    """
    r = _energy_ratios(traces, key, array, n, modified)
    return r.groupBy("trace").agg(F.min_by("i", F.struct(-F.round("r", 9), F.col("i"))).alias("pick"), F.max("r").alias("ratio")).withColumnRenamed("trace", key)


def guided_pick(traces: DataFrame, key: str, array: str, n: int, expected: Column | DataFrame, half: int, edits: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """(key, expected, pick, ratio, edited): per trace the largest energy ratio within ``half`` samples of where it is expected.

    ``expected`` is a column of ``traces`` (a sample: a model's prediction, a neighbour's pick) or a table (key, expected).
    A trace without an expected sample, or without a ratio of ``least`` or more near it, has no pick. ``edits`` (key, pick)
    are picks made by hand: they stay as they are, whatever is expected, and those of unknown traces are left out.
    """
    known = traces.select(key, expected.cast("double").alias("expected")) if isinstance(expected, Column) else traces.select(key).join(expected.select(key, F.col("expected").cast("double").alias("expected")), key, "left")
    r = _energy_ratios(traces, key, array, n, False).join(known.withColumnRenamed(key, "trace"), "trace")
    near = r.where((F.abs(F.col("i") - F.col("expected")) <= half) & (F.col("r") >= least))
    best = near.groupBy(F.col("trace").alias(key)).agg(F.min_by("i", F.struct(-F.round("r", 9), F.abs(F.col("i") - F.col("expected")), F.col("i"))).alias("pick"), F.max("r").alias("ratio"))
    out = known.join(best, key, "left").select(key, "expected", "pick", "ratio")
    return with_edits(out, edits, [key], ["pick"]) if edits is not None else out.withColumn("edited", F.lit(False))


def sta_lta(traces: DataFrame, key: str, array: str, short: int, long: int, threshold: float) -> DataFrame:
    """Per trace the first sample whose short over long average of the energy reaches the threshold.

    The long window grows from the start of the record; the first ``short`` - 1 samples have no short window.
    """
    w = Window.partitionBy("trace").orderBy("i")
    e = F.col("v") * F.col("v")
    sta, lta = F.avg(e).over(w.rowsBetween(-(short - 1), 0)), F.avg(e).over(w.rowsBetween(-(long - 1), 0))
    r = _samples(traces, key, array).select("trace", "i", (sta / (lta + F.lit(1e-30))).alias("r")).where(F.col("i") >= short - 1)
    return r.groupBy("trace").agg(F.min(F.when(F.col("r") >= threshold, F.col("i"))).alias("pick"), F.max("r").alias("most")).withColumnRenamed("trace", key)


def aic_pick(traces: DataFrame, key: str, array: str) -> DataFrame:
    """Per trace the sample after the break with the least two-segment information criterion; variances are 1e-30 at least.

    Traces of fewer than four samples have no row.
    """
    s = _samples(traces, key, array)
    w = Window.partitionBy("trace").orderBy("i")
    upto, after, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing), Window.partitionBy("trace")
    k, n = F.col("i") + 1, F.count("v").over(whole)
    var = lambda f: F.greatest(F.var_pop("v").over(f), F.lit(1e-30))
    r = s.select("trace", k.alias("k"), n.alias("n"), var(upto).alias("a"), var(after).alias("b")).where("n >= 4 AND k <= n - 2")
    aic = F.col("k") * F.ln("a") + (F.col("n") - F.col("k") - 1) * F.ln("b")
    return r.groupBy("trace").agg(F.min_by("k", F.struct(F.round(aic, 6), F.col("k"))).alias("pick")).withColumnRenamed("trace", key)


def reciprocity(table: DataFrame, seq: str, source_x: str, receiver_x: str, time: str, tolerance: float = 0.25, shot: str | None = None, by: str | None = None) -> DataFrame:
    """Pairs of readings with source and receiver exchanged: i, j, shot_ab, shot_ba, x_a, x_b, offset, t_ab, t_ba, dt.

    Positions that round to the same multiple of the tolerance are one; a reading at its own source has no pair. dt is
    t_ab - t_ba, where ab is the reading with the smaller ``seq``. ``by``: pairs are made within a line only.
    """
    q = lambda c: F.rint(F.col(c) / tolerance).cast("long")
    named = F.col(shot).cast("string") if shot else F.lit("")
    line = [F.col(by).alias("line")] if by else []
    t = table.select(*line, F.col(seq).alias("i"), q(source_x).alias("s"), q(receiver_x).alias("r"), named.alias("shot_ab"), F.col(source_x).alias("x_a"), F.col(receiver_x).alias("x_b"), F.col(time).alias("t_ab")).where("x_a <> x_b")
    b = t.select(*(["line"] if by else []), F.col("i").alias("j"), F.col("s").alias("r"), F.col("r").alias("s"), F.col("shot_ab").alias("shot_ba"), F.col("t_ab").alias("t_ba"))
    met = t.join(b, [*(["line"] if by else []), "s", "r"]).where("i < j")
    return met.select("i", "j", "shot_ab", "shot_ba", "x_a", "x_b", F.abs(F.col("x_b") - F.col("x_a")).alias("offset"), "t_ab", "t_ba", (F.col("t_ab") - F.col("t_ba")).alias("dt"))


def apparent_gradient(table: DataFrame, seq: str, offset: str, time: str) -> DataFrame:
    """(v_top, v_bottom) of a starting gradient from apparent velocities (offset over time), both of positive readings.

    v_top is the median of the nearest tenth of the readings, three at least, v_bottom the larger of 1.1 times the
    median of the farthest tenth and 1.5 v_top; equal offsets are in the order of ``seq``, a number. The tenths are cut at exact
    ranks without a sort of all rows in one task.
    """
    used = table.where((F.col(offset) > 0) & (F.col(time) > 0)).select(F.col(offset).cast("double").alias("d"), F.col(seq).alias("k"), (F.col(offset) / F.col(time)).alias("v"))
    size = used.agg(F.greatest(F.lit(3), F.floor(F.count(F.lit(1)) / 10)).alias("n"), F.count(F.lit(1)).alias("all"))
    ends = []
    for side, name in ((1, "near"), (-1, "far")):
        rows = used.select((side * F.col("d")).alias("d"), "v", (side * F.col("k")).alias("k"))
        ends.append(lowest(rows, "d", "k", size, "n").select("v", F.lit(name).alias("side")))
    both = quantiles(ends[0].unionAll(ends[1]), ["side"], "v", {"m": 0.5})
    top, far = F.max(F.when(F.col("side") == "near", F.col("m"))), F.max(F.when(F.col("side") == "far", F.col("m")))
    return both.agg(top.alias("v_top"), F.greatest(far * 1.1, top * 1.5).alias("v_bottom"))


def intercept_times(layers: DataFrame, model: str = "model") -> DataFrame:
    """Intercept time of each layer's head wave: 2 h sqrt(vk2 - vj2) / (vj vk) summed over the layers above.

    ``layers``: model, layer (from 0), v, h. Null where a layer above is as fast.
    """
    up = layers.select(F.col(model), F.col("layer").alias("j"), F.col("v").alias("vj"), F.col("h").alias("hj"))
    gap = F.col("v") * F.col("v") - F.col("vj") * F.col("vj")
    term = F.when(gap > 0, 2 * F.col("hj") * F.sqrt(gap) / (F.col("vj") * F.col("v")))
    pairs = layers.join(up, model).where("j < layer").groupBy(model, "layer", "v").agg(F.sum(term).alias("s"), F.count(term).alias("c"), F.count(F.lit(1)).alias("all"))
    top = layers.where("layer = 0").select(model, "layer", "v", F.lit(0.0).alias("intercept"))
    return top.unionAll(pairs.select(model, "layer", "v", F.when(F.col("c") == F.col("all"), F.col("s"))))


def first_arrivals(layers: DataFrame, at: DataFrame, model: str = "model") -> DataFrame:
    """Least travel time over the branches at each offset of ``at`` (model, offset)."""
    branch = intercept_times(layers, model).where("intercept IS NOT NULL")
    return at.join(branch, model).groupBy(model, "offset").agg(F.min(F.col("intercept") + F.col("offset") / F.col("v")).alias("time"))


def fit_two_layers(picks: DataFrame, shot: str, x: str, t: str, least: int = 2) -> DataFrame:
    """Per shot the cut of its picks (by offset) into a line through the origin and a free one with least squared error."""
    w = Window.partitionBy(shot).orderBy(x)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    xx, xt, tt = F.col(x) * F.col(x), F.col(x) * F.col(t), F.col(t) * F.col(t)
    sums = {"n1": F.count(F.lit(1)).over(before), "xx1": F.sum(xx).over(before), "xt1": F.sum(xt).over(before), "tt1": F.sum(tt).over(before), "n2": F.count(F.lit(1)).over(after), "x2": F.sum(x).over(after), "t2": F.sum(t).over(after), "xx2": F.sum(xx).over(after), "xt2": F.sum(xt).over(after), "tt2": F.sum(tt).over(after)}
    c = picks.select(shot, *[e.alias(k) for k, e in sums.items()]).where((F.col("n1") >= least) & (F.col("n2") >= max(2, least)))
    c = c.withColumn("den", F.col("n2") * F.col("xx2") - F.col("x2") * F.col("x2")).where("den > 1e-9 AND xx1 > 0")
    c = c.withColumn("p1", F.col("xt1") / F.col("xx1")).withColumn("p2", (F.col("n2") * F.col("xt2") - F.col("x2") * F.col("t2")) / F.col("den"))
    c = c.withColumn("i2", (F.col("t2") - F.col("p2") * F.col("x2")) / F.col("n2"))
    sse = F.col("tt1") - F.col("p1") * F.col("xt1") + F.col("tt2") - F.col("p2") * F.col("xt2") - F.col("i2") * F.col("t2")
    ok = c.where("p1 > 0 AND p2 > 0 AND p2 < p1 AND i2 > 0")  # faster below, later start
    best = ok.withColumn("sse", F.round(sse, 9)).groupBy(shot).agg(F.min_by(F.struct("n1", "p1", "p2", "i2", "sse"), F.struct("sse", "n1")).alias("b"))
    v1, v2 = 1 / F.col("b.p1"), 1 / F.col("b.p2")
    depth = F.col("b.i2") * v1 * v2 / (2 * F.sqrt(v2 * v2 - v1 * v1))
    return best.select(shot, F.col("b.n1").alias("cut"), v1.alias("v1"), v2.alias("v2"), depth.alias("depth"), F.col("b.sse").alias("sse"))


def dispersion_image(traces: DataFrame, shot: str, offset: str, array: str, dt: float, frequencies: list[float], velocities: list[float], normalize: bool = False) -> DataFrame:
    """Phase-shift energy per shot, frequency and velocity: unit spectra stacked with the phase of each velocity.

    The sum is over all traces of the shot, silent ones too, divided by their number; ``normalize``: and by the largest
    energy of its frequency.
    """
    f = F.explode(F.array(*[F.lit(float(x)) for x in frequencies]))
    per = traces.select(shot, offset, array, f.alias("f"))

    def part(fn) -> Column:
        return F.aggregate(F.transform(array, lambda v, i: v.cast("double") * fn(2 * math.pi * F.col("f") * dt * i)), F.lit(0.0), lambda s, x: s + x)

    spec = per.select(shot, offset, "f", part(F.cos).alias("re"), (-part(F.sin)).alias("im"))
    size = F.sqrt(F.col("re") ** 2 + F.col("im") ** 2)
    unit = spec.withColumn("ur", F.when(size > 0, F.col("re") / size).otherwise(0.0)).withColumn("ui", F.when(size > 0, F.col("im") / size).otherwise(0.0))
    grid = unit.select(shot, offset, "f", "ur", "ui", F.explode(F.array(*[F.lit(float(v)) for v in velocities])).alias("c"))
    k = 2 * math.pi * F.col("f") / F.col("c") * F.col(offset)
    sums = grid.groupBy(shot, "f", "c").agg(F.sum(F.col("ur") * F.cos(k) - F.col("ui") * F.sin(k)).alias("r"), F.sum(F.col("ur") * F.sin(k) + F.col("ui") * F.cos(k)).alias("i"), F.count(F.lit(1)).alias("n"))
    out = sums.select(shot, "f", "c", (F.sqrt(F.col("r") ** 2 + F.col("i") ** 2) / F.col("n")).alias("energy"))
    most = F.max("energy").over(Window.partitionBy(shot, "f"))
    return out.withColumn("energy", F.col("energy") / F.when(most > 0, most).otherwise(1.0)) if normalize else out


def pick_max(image: DataFrame, by: list[str]) -> DataFrame:
    """The velocity of most energy at each frequency, the lowest of equal ones."""
    return image.groupBy(*by).agg(F.min_by("c", F.struct(-F.round("energy", 9), F.col("c"))).alias("velocity"), F.max("energy").alias("energy"))


def konno_ohmachi(spectrum: DataFrame, by: str, f: str, v: str, b: float = 40.0) -> DataFrame:
    """Each spectrum smoothed over all its positive frequencies with weights (sin(a)/a)**4, a = b log10(f/fc).

    (by, fc, smooth); values at frequencies of 0 and below stay as they are.
    """
    rows = spectrum.select(F.col(by).alias("_by"), F.col(f).cast("double").alias("_f"), F.col(v).cast("double").alias("_v"))
    a = F.lit(b) * F.log10(F.col("_f") / F.col("fc"))
    w = F.when(a == 0, 1.0).otherwise(F.pow(F.sin(a) / a, 4))
    positive = rows.where("_f > 0")
    met = positive.join(positive.select("_by", F.col("_f").alias("fc")).distinct(), "_by")
    smooth = met.groupBy("_by", "fc").agg((F.sum(w * F.col("_v")) / F.sum(w)).alias("smooth"))
    return smooth.unionAll(rows.where("_f <= 0")).withColumnRenamed("_by", by)


def with_edits(picks: DataFrame, edits: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``picks`` with the values of ``edits`` where a key has one, and whether it had; edits of unknown keys are left out."""
    e = edits.select(*keys, *[F.col(v).alias(f"_{v}") for v in values], F.lit(True).alias("_e"))
    out = picks.join(e, keys, "left")
    return out.withColumns({v: F.coalesce(F.col(f"_{v}"), F.col(v)) for v in values}).withColumn("edited", F.coalesce("_e", F.lit(False))).drop("_e", *[f"_{v}" for v in values])


def resample(curve: DataFrame, by: str, f: str, v: str, at: DataFrame) -> DataFrame:
    """A curve at the frequencies of ``at`` (by, f), linear, only within its range."""
    o = Window.partitionBy(by).orderBy(f)
    seg = curve.select(by, F.col(f).alias("f0"), F.col(v).alias("v0"), F.lead(f).over(o).alias("f1"), F.lead(v).over(o).alias("v1"))
    met = at.join(seg, by).where((F.col(f) >= F.col("f0")) & ((F.col(f) < F.col("f1")) | ((F.col(f) == F.col("f0")) & F.col("f1").isNull())))
    return met.select(by, f, F.when(F.col("f1").isNull(), F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col(f) - F.col("f0")) / (F.col("f1") - F.col("f0"))).alias(v))


def spread(traces: DataFrame, spacing: float | None = None, source_offset: float | None = None, standoff: float = 0.0) -> DataFrame:
    """Traces of shot records (a source of a file each) with resolved receiver_x, source_x, offset and geometry_from (headers, arguments or mixed).

    Metres given here win over headers. Missing receivers lie between their neighbours in the record; the job fails for
    a record whose headers give no receiver or one place for all, no source, or several delays. ``standoff``: distance
    of the source from the line.
    """
    from .records import filled

    rows = traces.where("error IS NULL").withColumn("_record", F.struct("file", "source_id"))
    rows = rows.withColumn("_first", F.min("trace").over(Window.partitionBy("_record")))
    each = rows.groupBy("_record").agg(F.count_distinct("receiver_x").alias("_places"), F.min_by("source_x", F.when(F.col("source_x").isNotNull(), F.col("trace"))).alias("_source"), F.count_distinct(F.coalesce("delay", F.lit(0.0))).alias("_delays"))
    fail = lambda said: F.raise_error(F.concat(F.col("file"), F.lit(said)))
    met = filled(rows, "_record", "trace", "receiver_x").join(each, "_record")
    receiver = (F.col("trace") - F.col("_first")) * float(spacing) if spacing is not None else F.when((F.col("_places") < 2), fail(": receiver positions are empty or constant, pass spacing").cast("double")).otherwise(F.col("filled"))
    source = F.lit(float(source_offset)) if source_offset is not None else F.when(F.col("_source").isNull(), fail(": no source position, pass source_offset").cast("double")).otherwise(F.col("_source"))
    origin = "headers" if spacing is None and source_offset is None else "arguments" if spacing is not None and source_offset is not None else "mixed"
    delay = F.when(F.col("_delays") > 1, fail(": several delays").cast("double")).otherwise(F.col("delay"))
    out = met.withColumns({"receiver_x": receiver, "source_x": source, "delay": delay}).drop("filled", "_record", "_first", "_places", "_source", "_delays")
    d = F.col("receiver_x") - F.col("source_x")
    return out.withColumn("offset", F.sqrt(d * d + float(standoff) ** 2)).withColumn("geometry_from", F.lit(origin))


def regression(rows: DataFrame, by: list[str], x: str, y: str, weight: str | None = None, origin: bool = False) -> DataFrame:
    """Per group: n, slope and intercept of a weighted least-squares line, through the origin if asked; null if undetermined."""
    w = F.col(weight) if weight else F.lit(1.0)
    used = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (w > 0)).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), w.alias("_w"))
    s = lambda e: F.sum(F.col("_w") * e)
    sums = used.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("_s"), s(F.col("_x")).alias("_sx"), s(F.col("_y")).alias("_sy"), s(F.col("_x") * F.col("_x")).alias("_xx"), s(F.col("_x") * F.col("_y")).alias("_xy"))
    if origin:
        return sums.select(*by, "n", F.when(F.col("_xx") > 0, F.col("_xy") / F.col("_xx")).alias("slope"), F.lit(0.0).alias("intercept"))
    den = F.col("_s") * F.col("_xx") - F.col("_sx") * F.col("_sx")
    slope = F.when(den > 1e-12 * F.col("_s") * F.col("_xx"), (F.col("_s") * F.col("_xy") - F.col("_sx") * F.col("_sy")) / den)
    return sums.select(*by, "n", slope.alias("slope"), ((F.col("_sy") - slope * F.col("_sx")) / F.col("_s")).alias("intercept"))


def clipped(curve: DataFrame, f: str, v: str, frequency: tuple[float, float] | None = None, wavelength: tuple[float, float] | None = None) -> DataFrame:
    """A dispersion curve within a band of frequencies and of wavelengths (velocity over frequency), ends included."""
    out = curve if frequency is None else curve.where(F.col(f).between(*frequency))
    return out if wavelength is None else out.where((F.col(v) / F.col(f)).between(*wavelength))


PICKS = "shot string, channel int, time double, use boolean, quality double, edited boolean"


def write_picks(picks: DataFrame, path: str) -> None:
    """Every pick, used or not, as CSV with a header; columns that aren't there are written empty."""
    names = [c.split(" ") for c in PICKS.split(", ")]
    picks.select(*[(F.col(n) if n in picks.columns else F.lit(None)).cast(kind).alias(n) for n, kind in names]).write.csv(path, header=True)


def read_picks(spark: SparkSession, path: str) -> DataFrame:
    """Picks that ``write_picks`` or a person has written; shot, channel, time and use are needed, a pick without a time isn't used."""
    raw = spark.read.csv(path, header=True)
    lost = sorted({"shot", "channel", "time", "use"} - set(raw.columns))
    if lost:
        raise ValueError(f"{path} is missing column(s) {lost}")
    names = [c.split(" ") for c in PICKS.split(", ")]
    out = raw.select(*[(F.col(n) if n in raw.columns else F.lit(None)).try_cast(kind).alias(n) for n, kind in names])
    return out.withColumns({"use": F.col("time").isNotNull() & F.coalesce("use", F.lit(False)), "quality": F.coalesce("quality", F.lit(0.0)), "edited": F.coalesce("edited", F.lit(True))})


def traveltime_table(picks: DataFrame, points: DataFrame, source: str = "source_id", receiver: str = "receiver_id") -> DataFrame:
    """``picks`` with source_x and receiver_x of the points (role, id, x); null where a point isn't known."""
    at = lambda role, key: points.where(F.col("role") == role).select(F.col("id").alias(key), F.col("x").alias(f"{role}_x"))
    return picks.join(at("source", source), source, "left").join(at("receiver", receiver), receiver, "left")
