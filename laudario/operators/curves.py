"""Laboratory time series of a patient: closed list of series, date filters, deltas, compact text.

Points come from observations in the unit of their series; a value with a comparison sign is none, and
an occurrence with two candidates gives no point. Series of all patients are computed at once. One
patient may have a third of all points, so points are numbered in a global sort and meet the point before
them by number; no series is gathered, and texts are one row a point.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laudario.functions import text as T
from laudario.functions.text import compact_number
from laudario.session import numbered

# Series as (key, label, concept, unit, order).
SERIES = (
    ("hemoglobin", "Hemoglobina", "lab.hemoglobina", "g/dL", 10), ("platelets", "Plaquetas", "lab.plaquetas", "/mm³", 20), ("leukocytes", "Leucócitos totais", "lab.leucocitos", "/mm³", 30),
    ("crp", "PCR", "lab.proteina-c-reativa", "mg/L", 50), ("ast", "TGO", "lab.tgo", "U/L", 60), ("alt", "TGP", "lab.tgp", "U/L", 70), ("amylase", "Amilase", "lab.amilase", "U/L", 80), ("lipase", "Lipase", "lab.lipase", "U/L", 90),
    ("bilirubin-total", "BT", "lab.bilirrubina-total", "mg/dL", 101), ("bilirubin-direct", "BD", "lab.bilirrubina-direta", "mg/dL", 102), ("bilirubin-indirect", "BI", "lab.bilirrubina-indireta", "mg/dL", 103),
    ("creatinine", "Creatinina", "lab.creatinina", "mg/dL", 120), ("urea", "Ureia", "lab.ureia", "mg/dL", 140), ("sodium", "Sódio", "lab.sodio", "mEq/L", 150), ("potassium", "Potássio", "lab.potassio", "mEq/L", 160),
)
# Series made of several values or of computed ones, as (key, label, unit, order).
LEUKOGRAM, BILIRUBINS, RATE = ("leukogram", "Leucograma", "/mm³", 40), ("bilirubins", "Bilirrubinas", "mg/dL", 110), ("egfr", "TFG", "mL/min/1,73m²", 130)
HEMOGRAM = "lab.hemograma-completo"
# White cell fractions as (label, label keys).
FRACTIONS = (("N", ("SEGMENTADOS NEUTROFILOS", "NEUTROFILOS")), ("L", ("LINFOCITOS",)), ("B", ("BASTONETES",)), ("Mielócitos", ("MIELOCITOS",)), ("Metamielócitos", ("METAMIELOCITOS",)), ("Blastos", ("BLASTOS",)))


@dataclass(frozen=True)
class DateFilter:
    """All points, a closed range of days, or the last `days` up to `today`."""

    start: date | None = None
    end: date | None = None
    days: int | None = None
    today: date | None = None

    def __post_init__(self):
        if self.days is not None and (self.days <= 0 or self.today is None or self.start or self.end):
            raise ValueError("the last days need a positive number and today's date alone")
        if (self.start is None) != (self.end is None) or self.start and self.start > self.end:
            raise ValueError("a range needs both days in order")

    def keeps(self, ts: Column) -> Column:
        day = F.to_date(ts)
        if self.days is not None:
            return day.between(F.date_sub(F.lit(self.today), self.days - 1), F.lit(self.today))
        if self.start is not None:
            return day.between(F.lit(self.start), F.lit(self.end))
        return F.lit(True)


    def spans_years(self) -> bool:
        """Whether the filter's own boundaries lie in different years."""
        return self.start is not None and self.start.year != self.end.year


def of_patient(df: DataFrame, patient: str) -> DataFrame:
    """The rows of one patient; a key that has none is an error."""
    own = df.where(F.col("patient_key") == patient)
    if own.isEmpty():
        raise ValueError(f"unknown patient: {patient}")
    return own


def unit_key(c: Column) -> Column:
    """Units compared without case, spaces and raised digits."""
    return F.translate(F.upper(F.replace(F.trim(c), F.lit(" "), F.lit(""))), "³²", "32")


def points(observations: DataFrame, when: DateFilter = DateFilter(), keys: list[str] | None = None) -> DataFrame:
    """(patient_key, series_key, ts, episode_key, observation_id, value) of the chosen series (all by default).

    Unknown series are an error, an empty list gives no points. A delivery that repeats an observation
    counts once, the one received first.
    """
    known = {s[0] for s in SERIES}
    if keys is not None and not set(keys) <= known:
        raise ValueError(f"unknown series: {sorted(set(keys) - known)}")
    chosen = [s for s in SERIES if keys is None or s[0] in keys]
    spark = observations.sparkSession
    rows = [(k, c, u, label, o) for k, label, c, u, o in chosen]
    definition = F.broadcast(spark.createDataFrame(rows, "series_key string, concept_id string, unit string, label string, place int").withColumnRenamed("label", "series_label"))
    exact = ~F.ltrim("raw_value").rlike("^[<>]") & F.col("numeric_value").isNotNull() & F.col("requested_at").isNotNull()
    hits = observations.where(exact & when.keeps(F.col("requested_at"))).join(definition, "concept_id").where(unit_key(F.coalesce("normalized_unit", "raw_unit")) == unit_key(F.col("unit")))
    once = hits.groupBy("patient_key", "series_key", "observation_id").agg(F.min(F.struct("received_at", "requested_at", "episode_key", "occurrence_id", "numeric_value", "unit", "series_label", "place")).alias("x"))
    flat = once.select("patient_key", "series_key", "observation_id", F.col("x.requested_at").alias("ts"), "x.episode_key", "x.occurrence_id", F.col("x.numeric_value").alias("value"), "x.unit", "x.series_label", "x.place")
    # Two candidates in an occurrence are none.
    alone = flat.groupBy("patient_key", "series_key", "occurrence_id").agg(F.count("*").alias("n"), F.first(F.struct("ts", "episode_key", "observation_id", "value", "unit", "series_label", "place")).alias("p")).where("n = 1")
    return alone.select("patient_key", "series_key", "p.*")


def sequence(series: DataFrame) -> DataFrame:
    """Adds n (place in the series), `before` (the previous point's value), delta, and repeated_day."""
    order = ("patient_key", "series_key", "ts", "episode_key", "observation_id")
    placed = numbered(series, *order, name="number")
    first = placed.groupBy("patient_key", "series_key").agg(F.min("number").alias("first"))
    day = placed.groupBy("patient_key", "series_key", F.to_date("ts").alias("day")).agg((F.count("*") > 1).alias("repeated_day"))
    prior = placed.select("patient_key", "series_key", (F.col("number") + 1).alias("number"), F.col("value").alias("before"))
    out = placed.join(prior, ["patient_key", "series_key", "number"], "left").join(first, ["patient_key", "series_key"]).withColumn("day", F.to_date("ts")).join(day, ["patient_key", "series_key", "day"])
    return out.withColumn("n", (F.col("number") - F.col("first") + 1).cast("int")).withColumn("delta", F.col("value") - F.col("before")).drop("number", "first", "day")


def shown(c: Column) -> Column:
    return compact_number(c)


def decimals(c: Column) -> Column:
    """Decimals that the compact form of a value shows, two at most."""
    return F.length(F.regexp_extract(shown(c), r",(\d+)$", 1))


def sql_shown(e: str) -> str:
    return f"translate(regexp_replace(regexp_replace(format('{{:,.2f}}', CAST(round({e}, 2) AS DOUBLE)), '0+$', ''), '\\.$', ''), ',.', '.,')"


def delta_text(value: Column, before: Column, tenths: Column) -> Column:
    """A signed difference with as many decimals as the two values show, or with one; `±0` if there is none."""
    delta = value - before
    most = F.greatest(decimals(value), decimals(before))
    rounded = F.when(most == 0, F.round(delta, 0)).when(most == 1, F.round(delta, 1)).otherwise(F.round(delta, 2))
    return F.when(delta == 0, "±0").otherwise(F.concat(F.when(delta > 0, "+").otherwise(""), F.when(tenths, tenth_text(delta)).otherwise(shown(rounded))))


def tenth_text(c: Column) -> Column:
    """One decimal, always shown."""
    return F.translate(F.call_function("format_number", F.round(c, 1), F.lit("0.0")), ".", ",")


_COMMON = ("patient_key", "series_key", "ts", "episode_key", "observation_id", "value", "unit", "series_label", "place", "body")


def _named(df: DataFrame, series: tuple[str, str, str, int]) -> DataFrame:
    key, label, unit, place = series
    return df.withColumn("series_key", F.lit(key)).withColumn("series_label", F.lit(label)).withColumn("unit", F.lit(unit)).withColumn("place", F.lit(place)).select(*_COMMON)


def bilirubins(series: DataFrame) -> DataFrame:
    """The bilirubins of one time of an episode as points of one series, without a value of their own."""
    own = series.where(F.col("series_key").startswith("bilirubin-"))
    item = F.struct("place", F.concat_ws(" ", "series_label", shown(F.col("value"))).alias("t"))
    g = own.groupBy("patient_key", "episode_key", "ts").agg(F.array_sort(F.collect_list(item)).alias("items"), F.min("observation_id").alias("observation_id"))
    body = F.concat(F.lit("("), F.array_join(F.transform("items", lambda x: x["t"]), " | "), F.lit(")"))
    return _named(g.withColumn("body", body).withColumn("value", F.lit(None).cast("decimal(28,10)")), BILIRUBINS)


def leukograms(observations: DataFrame) -> DataFrame:
    """Points like `Leuco 14.020 (N 77,6% | L 9,7%)` of each blood count, without a value of their own.

    Each part counts only if exactly one observation has it; without a single leukocyte value or any
    fraction there is no point. Fractions are cut to one decimal.
    """
    df = observations.where((F.col("concept_id") == HEMOGRAM) & F.col("requested_at").isNotNull()).withColumn("k", T.normalize_label(F.coalesce("label", F.lit(""))))
    unit = unit_key(F.coalesce("normalized_unit", "raw_unit"))
    total = (F.col("k") == "LEUCOCITOS") & (unit == unit_key(F.lit("/mm³"))) & F.col("numeric_value").isNotNull() & ~F.ltrim("raw_value").rlike("^[<>]")
    aggs = [F.count_if(total).alias("n"), F.max(F.when(total, F.col("numeric_value"))).alias("v"), F.min(F.when(total, F.col("observation_id"))).alias("observation_id"), F.min("requested_at").alias("ts")]
    for i, (_, labels) in enumerate(FRACTIONS):
        test = F.col("k").isin(*labels) & F.coalesce(unit == "%", F.lit(False)) & F.col("numeric_value").isNotNull()
        aggs += [F.count_if(test).alias(f"n{i}"), F.max(F.when(test, F.col("numeric_value"))).alias(f"v{i}")]
    g = df.groupBy("patient_key", "episode_key", "occurrence_id").agg(*aggs)
    one = [F.when(F.col(f"n{i}") == 1, F.concat(F.lit(name + " "), tenth_text(truncate_tenth(F.col(f"v{i}"))), F.lit("%"))) for i, (name, _) in enumerate(FRACTIONS)]
    g = g.where("n = 1").withColumn("parts", F.concat_ws(" | ", *one)).where("parts != ''")
    return _named(g.withColumn("body", F.concat(F.lit("Leuco "), shown(F.col("v")), F.lit(" ("), F.col("parts"), F.lit(")"))).withColumn("value", F.lit(None).cast("decimal(28,10)")), LEUKOGRAM)


def rate_series(assessed: DataFrame) -> DataFrame:
    """Computed filtration rates as points of a series."""
    rates = rate_points(assessed).select("patient_key", F.col("day").cast("timestamp_ntz").alias("ts"), "episode_key", F.lit("").alias("observation_id"), F.col("value").cast("decimal(28,10)").alias("value"))
    return _named(rates.withColumn("body", tenth_text(F.col("value"))), RATE)


def all_series(observations: DataFrame, assessed: DataFrame | None = None, when: DateFilter = DateFilter(), keys: list[str] | None = None) -> DataFrame:
    """Points of single values, and of bilirubins, blood counts and rates together, with the text of each (`body`)."""
    single = points(observations, when, keys).withColumn("body", shown(F.col("value")))
    kept = observations.where(when.keeps(F.col("requested_at")))
    out = single.select(*_COMMON).unionByName(bilirubins(single)).unionByName(leukograms(kept))
    return out if assessed is None else out.unionByName(rate_series(assessed).where(when.keeps(F.col("ts"))))


def texts(series: DataFrame, include_delta: bool = True, when: DateFilter = DateFilter()) -> DataFrame:
    """(patient_key, place, series_key, n, heading, piece): the text of every point, in the order of the series and of time.

    The year shows if the patient's points, or the filter's boundaries, span several; the time on days with several points.
    """
    years = series.groupBy("patient_key").agg(((F.min(F.year("ts")) != F.max(F.year("ts"))) | F.lit(when.spans_years())).alias("with_year"))
    s = sequence(series).join(years, "patient_key")
    stamp = F.concat(F.date_format("ts", "dd/MM"), F.when(F.col("with_year"), F.date_format("ts", "/yy")).otherwise(""), F.when(F.col("repeated_day"), F.date_format("ts", " HH:mm")).otherwise(""))
    delta = F.when(F.lit(include_delta) & F.col("before").isNotNull() & F.col("value").isNotNull(), F.concat(F.lit(" ("), delta_text(F.col("value"), F.col("before"), F.col("series_key") == RATE[0]), F.lit(")"))).otherwise("")
    heading = F.concat(F.lit("#"), F.col("series_label"), F.lit(" ("), F.col("unit"), F.lit("):"))
    return s.select("patient_key", "place", "series_key", "n", heading.alias("heading"), F.concat(stamp, F.lit(" - "), F.col("body"), delta).alias("piece"))


def truncate_tenth(c: Column) -> Column:
    """Toward zero to one decimal."""
    return F.signum(c) * F.floor(F.abs(c.cast("decimal(20,10)")) * 10) / 10


def rate_points(assessed: DataFrame) -> DataFrame:
    """(patient_key, ts, episode_key, value, delta): filtration rates cut to one decimal, and their change.

    Only episodes with exactly one computed rate and a readable request date give a point.
    """
    day = F.when(F.col("raw_request_date").rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_timestamp("raw_request_date", F.lit("dd/MM/yyyy"))).cast("date")
    computed = assessed.where("reason IS NULL").select("patient_key", "episode_key", "derived_observation_id", day.alias("day"), truncate_tenth(F.col("value")).alias("value")).dropDuplicates(["derived_observation_id"])
    alone = computed.groupBy("patient_key", "episode_key").agg(F.count("*").alias("n"), F.first("day").alias("day"), F.first("value").alias("value")).where("n = 1 AND day IS NOT NULL")
    w = W.partitionBy("patient_key").orderBy("day", "episode_key")
    return alone.select("patient_key", "day", "episode_key", "value", F.round(F.col("value") - F.lag("value").over(w), 1).alias("delta"))
