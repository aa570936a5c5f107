"""Clinical text of episodes: exams in editorial order, one piece each, everything accounted for.

Input is one row an observation. Rendering groups by occurrence, then by episode; a piece is a string,
so the second grouping carries no observations. Options change the text without touching what precedes.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laudario.functions import text as T
from laudario.operators import render as R
from laudario.session import numbered, small_side

# Groups of exams in the order in which they are written.
GROUPS = (
    ("hemograma-completo", "hemoglobina", "hematocrito", "reticulocitos", "leucocitos", "plaquetas"),
    ("tempo-protrombina", "tempo-tromboplastina", "fibrinogenio", "dimero-d"),
    ("proteina-c-reativa", "vhs", "ferritina", "ferro-serico", "transferrina"),
    ("ureia", "creatinina", "acido-urico", "cistatina-c"),
    ("sodio", "potassio", "cloreto", "calcio-total", "magnesio", "fosforo"),
    ("glicemia-jejum", "glicemia-acaso", "glicemia-pos-prandial", "hemoglobina-glicada", "frutosamina", "lactato", "colesterol-total", "colesterol-hdl", "colesterol-ldl", "triglicerideos"),
    ("tgo", "tgp", "fosfatase-alcalina", "gama-gt", "bilirrubina-total", "bilirrubina-direta", "bilirrubina-neonatal", "albumina", "proteinas-totais", "desidrogenase-latica"),
    ("amilase", "lipase"),
    ("troponina-i", "troponina-t", "ck-mb", "ck-total"),
    ("gasometria-arterial", "gasometria-venosa"),
    ("urina-tipo-i", "creatinina-urinaria", "microalbuminuria", "proteinuria-24h"),
    ("urocultura", "cultura-aspirado-traqueal", "cultura-swab-nasal", "cultura-swab-retal", "hemocultura-primeira", "hemocultura-segunda", "hemocultura-cateter", "antibiograma", "bacterioscopico-gram", "pesquisa-baar", "pesquisa-fungos"),
    ("anti-hiv", "hbsag", "anti-hbs", "anti-hcv", "citomegalovirus-igg", "citomegalovirus-igm", "toxoplasmose-igg", "toxoplasmose-igm", "vdrl", "dengue-ns1"),
    ("tsh", "t4-livre", "t4-total", "t3-total", "beta-hcg", "psa-total", "psa-livre", "tipagem-sanguinea"),
)
# Short names of exams.
SHORT = {
    "lab.plaquetas": "Plaq", "lab.tempo-tromboplastina": "TTPa", "lab.creatinina": "Cr", "lab.ureia": "Ureia", "lab.sodio": "Na", "lab.potassio": "K", "lab.cloreto": "Cl", "lab.calcio-total": "Ca",
    "lab.magnesio": "Mg", "lab.fosforo": "P", "lab.glicemia-jejum": "Glic", "lab.lactato": "Lact", "lab.proteina-c-reativa": "PCR", "lab.vhs": "VHS", "lab.tgo": "TGO", "lab.tgp": "TGP",
    "lab.fosfatase-alcalina": "FA", "lab.gama-gt": "GGT", "lab.albumina": "Alb", "lab.ck-mb": "CK-MB", "lab.hemoglobina": "Hb", "lab.hematocrito": "Ht", "lab.leucocitos": "Leuco", "lab.bilirrubina-total": "BT", "lab.bilirrubina-direta": "BD",
}
CULTURES = ("urocultura", "cultura-aspirado-traqueal", "cultura-swab-nasal", "cultura-swab-retal", "hemocultura-primeira", "hemocultura-segunda", "hemocultura-cateter")
LAST = 2**31 - 1
EMPTY, HIDDEN = "Sem resultados laboratoriais projetáveis.", "Culturais"


def rank_rows() -> list[tuple[str, int, int, str | None]]:
    return [(f"lab.{c}", g, o, SHORT.get(f"lab.{c}")) for g, group in enumerate(GROUPS) for o, c in enumerate(group)]


def is_culture(concept: Column) -> Column:
    return concept.isin(*[f"lab.{c}" for c in CULTURES])


def own_line(concept: Column) -> Column:
    """Whether an exam is written on lines of its own."""
    return concept.isin("lab.urina-tipo-i", "lab.gasometria-arterial", "lab.gasometria-venosa") | concept.contains("cultura") | concept.contains("antibiograma")


def link_cultures(nested: DataFrame) -> DataFrame:
    """Adds `linked` (the antibiograms that belong to a culture) and `linked_to` (the culture that an antibiogram belongs to).

    An antibiogram belongs to a culture of its episode that names one of its organisms, if exactly one does. Occurrences
    are joined by episode and organism, so nothing gathers.
    """
    own = nested.select("episode_key", "occurrence_id", "form", F.explode("organisms").alias("o"))
    own = own.select("episode_key", "occurrence_id", "form", T.normalize_label(F.col("o.name")).alias("organism")).where("organism != ''").distinct()
    cultures = own.where("form = 'microbiology-culture'").select("episode_key", "organism", F.col("occurrence_id").alias("culture"))
    pairs = own.where("form = 'susceptibility-panel'").join(cultures, ["episode_key", "organism"]).groupBy("episode_key", "occurrence_id").agg(F.count_distinct("culture").alias("n"), F.min("culture").alias("linked_to")).where("n = 1").drop("n")
    sides = nested.select("episode_key", "occurrence_id", "groups").join(pairs, ["episode_key", "occurrence_id"])
    held = sides.groupBy("episode_key", F.col("linked_to").alias("occurrence_id")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("occurrence_id", "groups"))), lambda x: x["groups"])).alias("linked"))
    return nested.join(pairs, ["episode_key", "occurrence_id"], "left").join(held, ["episode_key", "occurrence_id"], "left")


def first_deliveries(observations: DataFrame) -> DataFrame:
    """One row an observation: of repeated deliveries the one received first."""
    once = observations.groupBy("observation_id").agg(F.min(F.struct("received_at", "patient_key", "episode_key", "occurrence_id", "concept_id", "label", "raw_value", "raw_unit", "requested_at")).alias("x"))
    return once.select("observation_id", "x.*")


def nested_occurrences(observations: DataFrame, derived: DataFrame | None = None) -> DataFrame:
    """One row an occurrence with its observations in their order, the time, the first label and the filtration rate cut to one decimal, if it has exactly one."""
    once = first_deliveries(observations).withColumn("rate", F.lit(None).cast("double"))
    if derived is not None:
        rates = derived.where("reason IS NULL").groupBy(F.col("source_observation_id").alias("observation_id")).agg(F.max("value").alias("rate"))
        once = once.drop("rate").join(rates, "observation_id", "left")
    item = F.struct(F.col("observation_id").alias("id"), "label", "raw_value", "raw_unit")
    items = once.groupBy("patient_key", "episode_key", "occurrence_id", "concept_id").agg(F.min("requested_at").alias("requested_at"), F.array_sort(F.collect_list(item)).alias("observations"), F.min("label").alias("label"), F.count("rate").alias("rates"), F.max("rate").alias("rate"))
    tenths = (F.floor(F.col("rate") * 10) % 10).cast("string")
    return items.withColumn("rate", F.when(F.col("rates") == 1, F.concat(F.floor(F.col("rate")).cast("string"), F.lit(","), tenths))).drop("rates")


_EMPTY = {"narratives": "array<string>", "specimens": "array<string>", "attributes": "array<struct<name:string,value:string>>", "organisms": R.ORGANISMS, "groups": R.GROUPS, "evidence": "array<string>"}


@lru_cache(4)
def _made(application: str) -> Column:
    """The expression of an occurrence's lines; it is large, so an application builds it once."""
    return R.lines(
        concept=F.col("concept_id"), form=F.col("form"), name=F.col("name"), observations=F.col("prepared"), narratives=F.col("narratives"), specimens=F.col("specimens"), attributes=F.col("attributes"),
        organisms=F.col("organisms"), groups=F.col("groups"), linked=F.col("linked"), rate=F.col("rate"),
    )


def rendered(nested: DataFrame, concepts: DataFrame, *, units: bool = False, cultures: bool = True) -> DataFrame:
    """Nested occurrences with rank, `lines`, disposition and notice.

    Columns of `nested` that are absent (narratives, specimens, attributes, organisms, groups, evidence) count as empty.
    Hidden cultures and antibiograms written within their culture are suppressed by policy. Without a line
    the narratives and the evidence, else the label, are kept as a safe fallback, with a notice.
    """
    spark = nested.sparkSession
    given = "organisms" in nested.columns
    for name, kind in _EMPTY.items():
        if name not in nested.columns:
            nested = nested.withColumn(name, F.expr(f"cast(array() as {kind})"))
    rank = F.broadcast(spark.createDataFrame(rank_rows(), "concept_id string, grp int, ord int, short string"))  # a fixed list
    catalogue = small_side(concepts.select("concept_id", "display_name", F.col("structural_form_id").alias("form")).dropDuplicates(["concept_id"]))
    named = nested.join(rank, "concept_id", "left").join(catalogue, "concept_id", "left")
    named = named.withColumn("name", F.coalesce("short", R.title_case(F.col("display_name")), R.title_case(F.col("label")), F.lit("")))
    micro = F.coalesce(F.col("form").isin(*R.CULTURES), F.lit(False))
    if given and cultures:
        named = link_cultures(named)
    else:
        named = named.withColumn("linked_to", F.lit(None).cast("string")).withColumn("linked", F.expr(f"cast(array() as {R.GROUPS})"))
    named = named.withColumn("prepared", R.prepared(F.col("observations"), units))
    made = _made(spark.sparkContext.applicationId)
    named = named.withColumn("made", made).withColumn("hidden", micro & F.lit(not cultures) | F.col("linked_to").isNotNull())
    left = F.array_distinct(F.filter(F.concat(F.coalesce("narratives", F.expr("cast(array() as array<string>)")), F.coalesce("evidence", F.expr("cast(array() as array<string>)"))), lambda t: F.trim(t) != ""))
    kept = F.concat(F.lit("Resultado não estruturado: "), F.when(F.size(left) > 0, F.array_join(left, " | ")).otherwise(F.coalesce("label", F.lit(""))))
    blank = (F.size("made") == 0) | (F.size(F.filter(F.transform("observations", lambda o: F.coalesce(F.trim(o["raw_value"]), F.lit(""))), lambda v: v != "")) == 0) & ~micro & (F.size("made") == 1) & (F.size("attributes") == 0) & (F.size("narratives") == 0)
    return named.select(
        "patient_key", "episode_key", "occurrence_id", "concept_id", "requested_at", F.coalesce("grp", F.lit(LAST)).alias("grp"), F.coalesce("ord", F.lit(LAST)).alias("ord"), F.size("observations").alias("fields"), "form", "observations", "rate", "narratives", "specimens", "attributes", "organisms", "groups", "linked_to",
        F.when(F.col("hidden"), F.expr("cast(array() as array<string>)")).when(blank, F.array(kept)).otherwise(F.col("made")).alias("lines"),
        F.when(F.col("hidden"), "SuppressedByExplicitPolicy").when(blank, "SafeFallback").otherwise("Rendered").alias("disposition"),
        F.when(F.col("hidden"), F.lit(None)).when(blank, "safe-fallback").when(F.col("form") == "susceptibility-panel", "unlinked-susceptibility-preserved").alias("notice"),
    )


def occurrences(observations: DataFrame, concepts: DataFrame, derived: DataFrame | None = None, *, units: bool = False, cultures: bool = True) -> DataFrame:
    """`rendered` over observations alone, with `piece`, the lines in one text (NULL where suppressed)."""
    done = rendered(nested_occurrences(observations, derived), concepts, units=units, cultures=cultures)
    return done.withColumn("piece", F.when(F.size("lines") > 0, F.array_join("lines", "\n")))


def ranked(rendered: DataFrame) -> DataFrame:
    """Place of each occurrence in its episode: by group, order, then in the order of the document; unknown exams last."""
    return rendered.select("episode_key", "occurrence_id", "grp", "ord", F.row_number().over(W.partitionBy("episode_key").orderBy("grp", "ord", "occurrence_id")).alias("place"))


def episode_texts(rendered: DataFrame) -> DataFrame:
    """(patient_key, episode_key, ts, text): a heading with the time and the exams in order; some exams, and those of several lines, on lines of their own."""
    key = F.struct("grp", "ord", "occurrence_id", "lines")
    own = own_line(F.col("concept_id")) | (F.size("lines") != 1)
    there = F.size("lines") > 0
    g = rendered.groupBy("patient_key", "episode_key").agg(
        F.min("requested_at").alias("ts"), F.array_sort(F.collect_list(F.when(there & ~own, key))).alias("plain"), F.array_sort(F.collect_list(F.when(there & own, key))).alias("own"),
        F.max(F.coalesce((F.col("disposition") == "SuppressedByExplicitPolicy") & own_line(F.col("concept_id")), F.lit(False))).alias("hidden"),
    )
    plain = F.array_join(F.flatten(F.transform("plain", lambda x: x["lines"])), " | ")
    lines = F.flatten(F.transform("own", lambda x: x["lines"]))
    first = F.when(F.size("plain") > 0, plain).when(F.size("own") > 0, F.lit(None)).when(F.col("hidden"), HIDDEN).otherwise(EMPTY)
    heading = F.concat(F.lit("Laboratoriais ("), F.coalesce(F.date_format("ts", "dd/MM/yyyy – HH:mm"), F.lit("sem data")), F.lit("):"))
    return g.select("patient_key", "episode_key", "ts", F.concat_ws("\n", F.concat_ws(" ", heading, first), F.when(F.size("own") > 0, F.array_join(lines, "\n"))).alias("text"))


def patient_texts(rendered: DataFrame, identities: DataFrame | None = None, patient: str | None = None) -> DataFrame:
    """(patient_key, place, episode_key, text): each patient's episodes, the newest first; those without a time last.

    With identities (patient_key, patient_name, first_input_index) a heading with the patient's name stands at place 0.
    `patient` keeps one patient. A patient may have a third of all episodes, so they are numbered in a global sort and not gathered.
    """
    if patient is not None:
        rendered = rendered.where(F.col("patient_key") == patient)
    e = episode_texts(rendered).withColumn("late", F.coalesce(-F.unix_micros(F.col("ts").cast("timestamp")), F.lit(2**62)))
    placed = numbered(e, "patient_key", "late", "episode_key", name="number")
    first = placed.groupBy(F.col("patient_key").alias("who")).agg(F.min("number").alias("first"))
    out = placed.join(first, F.col("patient_key").eqNullSafe(F.col("who"))).select("patient_key", (F.col("number") - F.col("first") + 1).alias("place"), "episode_key", "text")
    if identities is None:
        return out
    who = identities.groupBy("patient_key").agg(F.min(F.struct("first_input_index", "patient_name")).alias("x")).join(first, F.col("patient_key") == F.col("who"))
    return out.unionByName(who.select("patient_key", F.lit(0).cast("bigint").alias("place"), F.lit(None).cast("string").alias("episode_key"), F.concat(F.lit("Paciente: "), F.coalesce("x.patient_name", F.lit(""))).alias("text")))


def culture_notices(rendered: DataFrame) -> DataFrame:
    """Patients with cultures: how many occurrences, in how many episodes."""
    return rendered.where(F.col("form").isin(*R.CULTURES)).groupBy("patient_key").agg(F.count("*").alias("occurrences"), F.count_distinct("episode_key").alias("episodes"))


def culture_review(rendered: DataFrame) -> DataFrame:
    """(patient_key, episode_key, occurrence_id, lines): what a reader must look at where cultures are hidden; `rendered` shows them."""
    return rendered.where(F.col("form").isin(*R.CULTURES) & (F.size("lines") > 0)).select("patient_key", "episode_key", "occurrence_id", F.array_join("lines", "\n").alias("lines"))


def fields(rendered: DataFrame, *, cultures: bool = True) -> DataFrame:
    """(episode_key, occurrence_id, kind, field, disposition, reason, line): every field of every occurrence, accounted for.

    A field is projected if a line of its occurrence shows it, hidden by policy, or for audit only.
    """
    shown = (F.size("lines") > 0) & (F.col("disposition") != "SuppressedByExplicitPolicy")
    micro = F.coalesce(F.col("form").isin(*R.CULTURES), F.lit(False))
    open_ = ~micro | F.lit(cultures)

    def rows(kind: str, array: Column, key, term, shows: Column, reason: str, policy=None) -> Column:
        def one(x: Column, i: Column) -> Column:
            forbidden = policy(x) if policy is not None else F.lit(False)
            return F.struct(F.lit(kind).alias("kind"), key(x, i).alias("field"), term(x).alias("term"), (shows & ~forbidden).alias("shows"), F.when(forbidden & ~(micro & F.lit(not cultures)), "SuppressedByExplicitPolicy").otherwise("AuditOnly").alias("else_"), F.when(forbidden, "explicit-clinical-policy").otherwise(reason).alias("reason"))

        return F.transform(array, one)

    at = lambda name: lambda x, i: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]"))
    nothing = lambda x: F.lit(None).cast("string")
    label = lambda o: T.normalize_label(F.coalesce(o["label"], F.lit("")))
    policy = lambda o: (label(o) == R.REPORTED_RATE) | (F.col("concept_id") == R.PROTHROMBIN) & label(o).isin("CONTROLE NORMAL", "AMOSTRA")
    wordy = lambda t: F.trim(t) != ""
    entries = F.flatten(F.transform("groups", lambda g, i: F.transform(g["entries"], lambda e, j: F.struct(F.concat(F.lit("microbiology.susceptibilityGroups["), i.cast("string"), F.lit("].entries["), j.cast("string"), F.lit("]")).alias("field"), e["drug"].alias("drug")))))
    every = F.concat(
        rows("Observation", F.col("observations"), lambda o, i: o["id"], lambda o: o["raw_value"], shown & open_, "culture-review-only", policy),
        rows("DerivedObservation", F.when(F.col("rate").isNotNull(), F.array("rate")).otherwise(F.expr("cast(array() as array<string>)")), at("derived"), lambda r: F.concat(F.lit("TFG "), r), shown, "not-computed-audit-only"),
        rows("Attribute", F.col("attributes"), at("attributes"), nothing, F.lit(False), "structured-duplicate-or-audit-only"),
        rows("Narrative", F.col("narratives"), at("narratives"), lambda t: t, shown & F.when(micro, F.lit(cultures)).otherwise(F.col("concept_id").isin(R.HEMOGRAM, R.GRAM)), "audit-only", lambda t: ~wordy(t)),
        rows("Specimen", F.col("specimens"), at("specimens"), lambda t: t, shown & F.when(micro, F.lit(cultures)).otherwise(F.col("concept_id") == R.GRAM), "compact-output-policy"),
        rows("Relationship", F.when(F.col("linked_to").isNotNull(), F.array("linked_to")).otherwise(F.expr("cast(array() as array<string>)")), at("relationships"), nothing, F.lit(False), "culture-review-only"),
        rows("Organism", F.col("organisms"), at("microbiology.organisms"), lambda o: o["name"], shown & F.lit(cultures), "culture-review-only"),
        rows("SusceptibilityGroup", F.col("groups"), at("microbiology.susceptibilityGroups"), lambda g: g["organism"], shown & F.lit(cultures), "culture-review-only"),
        rows("SusceptibilityEntry", entries, lambda e, i: e["field"], lambda e: e["drug"], shown & F.lit(cultures), "culture-review-only"),
    )
    flat = rendered.select("episode_key", "occurrence_id", "lines", F.explode(every).alias("f"))
    hit = F.array_position(F.transform("lines", lambda line: F.coalesce(F.contains(F.lower(line), F.lower(F.col("f.term"))) & (F.trim("f.term") != ""), F.lit(False))), F.lit(True))
    found = F.col("f.shows") & (hit > 0)
    return flat.select(
        "episode_key", "occurrence_id", "f.kind", "f.field", F.when(found, "Projected").otherwise(F.col("f.else_")).alias("disposition"),
        F.when(found, "rendered").when(F.col("f.shows"), "not-selected-by-editorial-policy").otherwise(F.col("f.reason")).alias("reason"), F.when(found, (hit - 1).cast("int")).alias("line"),
    )


def coverage(rendered: DataFrame) -> DataFrame:
    """Occurrences and fields by disposition in all; they add up to the input."""
    return rendered.groupBy("disposition").agg(F.count("*").alias("occurrences"), F.sum("fields").alias("fields"))


def coverage_totals(rendered: DataFrame, accounted: DataFrame) -> DataFrame:
    """One row: occurrences in all and by disposition, fields in all and by disposition, and whether all of them are accounted for."""
    occ = rendered.agg(
        F.count("*").alias("occurrences"), F.count_distinct("episode_key").alias("episodes"), F.count_distinct("patient_key").alias("patients"), *[F.count_if(F.col("disposition") == d).alias(n) for d, n in (("Rendered", "rendered"), ("SafeFallback", "safe_fallbacks"), ("SuppressedByExplicitPolicy", "suppressed"))],
        F.coalesce(F.sum("fields"), F.lit(0)).alias("observations"), F.count("notice").alias("notices"),
    )
    own = accounted.agg(
        F.count("*").alias("fields"), F.count_if(F.col("kind") == "Observation").alias("observation_fields"), *[F.count_if(F.col("disposition") == d).alias(n) for d, n in (("Projected", "projected_fields"), ("AuditOnly", "audit_fields"), ("SuppressedByExplicitPolicy", "suppressed_fields"))],
    )
    both = occ.crossJoin(own)  # one row each
    complete = (F.col("rendered") + F.col("safe_fallbacks") + F.col("suppressed") == F.col("occurrences")) & (F.col("observation_fields") == F.col("observations")) & (F.col("projected_fields") + F.col("audit_fields") + F.col("suppressed_fields") == F.col("fields"))
    return both.withColumn("is_complete", complete)
