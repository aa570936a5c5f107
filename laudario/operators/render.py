"""The lines of one laboratory occurrence, by its kind: panels in their order, cultures with antibiograms, single values.

An occurrence is one row with its observations, specimens, narratives, attributes, organisms and
antibiograms as arrays, which are bounded by the occurrence. All forms are expressions over these
arrays, so nothing is shuffled and no row leaves the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from laudario.functions import text as T

# Concepts with a form of their own.
HEMOGRAM, COAGULATION_TIME, PROTHROMBIN, GRAM, CREATININE = "lab.hemograma-completo", "lab.tempo-tromboplastina", "lab.tempo-protrombina", "lab.bacterioscopico-gram", "lab.creatinina"
# Panels whose components have an order, and what they are called.
PANELS = {
    "lab.gasometria-arterial": ("Gasometria arterial", ("PH", "PCO2", "PO2", "HCO3", "B E", "BE", "CO2 TOTAL", "O2 SATURACAO", "SATO2", "LACTATO")),
    "lab.gasometria-venosa": ("Gasometria venosa", ("PH", "PCO2", "PO2", "HCO3", "B E", "BE", "CO2 TOTAL", "O2 SATURACAO", "SATO2", "LACTATO")),
    "lab.urina-tipo-i": ("EQU", ("COR", "ASPECTO", "DENSIDADE", "PH", "PROTEINAS", "GLICOSE", "CETONAS", "BILIRRUBINA", "UROBILINOGENIO", "NITRITO", "LEUCOCITOS", "LEUCO", "HEMACIAS", "CELULAS EPITELIAIS", "BACTERIAS")),
}
# Short names of components, by their label key.
COMPONENTS = {
    "HEMOGLOBINA": "Hb", "HEMATOCRITO": "Ht", "HEMACIAS": "Hemácias", "V C M": "VCM", "VCM": "VCM", "H C M": "HCM", "HCM": "HCM", "C H C M": "CHCM", "CHCM": "CHCM", "RDW": "RDW", "LEUCOCITOS": "Leuco",
    "SEGMENTADOS NEUTROFILOS": "Neut", "NEUTROFILOS": "Neut", "BASTONETES": "Bast", "LINFOCITOS": "Linf", "MONOCITOS": "Mono", "EOSINOFILOS": "Eos", "BASOFILOS": "Baso", "PLAQUETAS": "Plaq", "RETICULOCITOS": "Retic",
    "GLICEMIA": "Glic", "LACTATO": "Lact", "PH": "pH", "PCO2": "pCO2", "PO2": "pO2", "HCO3": "HCO3", "B E": "BE", "BE": "BE", "O2 SATURACAO": "SatO2", "SATO2": "SatO2",
    "BILIRRUBINA TOTAL": "BT", "BILIRRUBINA DIRETA": "BD", "BILIRRUBINA INDIRETA": "BI", "TEMPO DE POSITIVIDADE": "Tempo de positividade",
}
# Red cell values, and white cell fractions with whether their label must be equal.
RED = (("Hb", ("HEMOGLOBINA",)), ("Ht", ("HEMATOCRITO",)), ("VCM", ("V C M", "VCM")), ("HCM", ("H C M", "HCM")), ("CHCM", ("C H C M", "CHCM")), ("RDW", ("RDW",)), ("Hemácias", ("HEMACIAS",)))
WHITE = (
    ("Neut", ("SEGMENTADOS", "NEUTROFILOS"), False), ("Bast", ("BASTONETES",), False), ("Meta", ("METAMIELOCITOS",), False), ("Mielo", ("MIELOCITOS",), True), ("Blastos", ("BLASTOS",), True),
    ("Linf", ("LINFOCITOS",), False), ("Mono", ("MONOCITOS",), False), ("Eos", ("EOSINOFILOS",), False), ("Baso", ("BASOFILOS",), False),
)
CULTURES = ("microbiology-culture", "susceptibility-panel")
REPORTED_RATE = "TAXA DE FILTRACAO GLOMERULAR ESTIMADA"
_SECTIONS = ("ERITROCITOS", "LEUCOCITOS", "PLAQUETAS")

#: The schema of an occurrence's arrays.
OBSERVATIONS = "array<struct<id:string,label:string,raw_value:string,raw_unit:string>>"
ORGANISMS = "array<struct<id:string,name:string>>"
GROUPS = "array<struct<organism_id:string,organism:string,entries:array<struct<drug:string,result:string,interpretation:string>>>>"


def title_case(c: Column) -> Column:
    """Labels in capitals with every word's first letter large; labels with small letters as they are."""
    t = F.trim(c)
    parts = F.regexp_extract_all(F.lower(t), F.lit(r"\p{L}[\p{L}\p{M}\p{Nd}']*|[^\p{L}]+"), F.lit(0))
    large = F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))), "")
    return F.when(t.rlike(r"\p{Ll}"), t).otherwise(large)


def sql_title_case(e: str) -> str:
    t = f"trim({e}, ' ')"
    parts = f"regexp_extract_all(lower({t}), '\\p{{L}}[\\p{{L}}\\p{{M}}\\p{{Nd}}'']*|[^\\p{{L}}]+')"
    return f"CASE WHEN regexp_matches({t}, '\\p{{Ll}}') THEN {t} ELSE array_to_string(list_transform({parts}, lambda x: upper(x[1]) || x[2:]), '') END"


def component(label: Column) -> Column:
    """A component's short name, else its label as a title."""
    key = T.normalize_label(label)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in COMPONENTS.items() for x in kv]), key), title_case(label))


def sql_component(e: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COMPONENTS.items())
    return f"coalesce(CASE {T.sql_normalize_label(e)} {cases} END, {sql_title_case(e)})"


def _pick(array: Column, test) -> Column:
    return F.get(F.filter(array, test), F.lit(0))


def _has(o: Column, keys: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [o["k"].contains(k) for k in keys])


def _some(*values: Column) -> Column:
    return F.filter(F.array(*values), lambda x: x.isNotNull())


def _filled(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def _none() -> Column:
    return F.expr("cast(array() as array<string>)")


def _lines(text: Column, there: Column) -> Column:
    return F.when(there, F.array(text)).otherwise(_none())


def prepared(observations: Column, units: bool) -> Column:
    """The observations with their label key `k`, their name `c` as a component, and the value as it is shown."""

    def one(o: Column) -> Column:
        value = F.coalesce(o["raw_value"], F.lit(""))
        shown = F.when(F.lit(units) & _filled(o["raw_unit"]), F.concat_ws(" ", value, o["raw_unit"])).otherwise(value)
        return F.struct(o["id"].alias("id"), F.coalesce(o["label"], F.lit("")).alias("label"), value.alias("raw_value"), o["raw_unit"].alias("raw_unit"), T.normalize_label(F.coalesce(o["label"], F.lit(""))).alias("k"), component(F.coalesce(o["label"], F.lit(""))).alias("c"), shown.alias("shown"))

    return F.transform(F.coalesce(observations, F.expr(f"cast(array() as {OBSERVATIONS})")), one)


def hemogram(obs: Column, narratives: Column) -> Column:
    """Red cells, leukocytes with their fractions as `% [absolute]`, remarks on the cells, platelets last."""

    def value(name: str, keys: tuple[str, ...]) -> Column:
        return F.concat(F.lit(name + " "), _pick(obs, lambda o: _has(o, keys))["shown"])

    def fits(keys: tuple[str, ...], equal: bool):
        return lambda o: o["k"].isin(*keys) if equal else _has(o, keys)

    fractions = []
    for name, keys, equal in WHITE:
        matching = F.filter(obs, fits(keys, equal))
        percent = _pick(matching, lambda o: F.coalesce(F.trim(o["raw_unit"]) == "%", F.lit(False)))
        absolute = _pick(matching, lambda o: F.coalesce(F.trim(o["raw_unit"]) != "%", F.lit(True)))
        share = F.concat(F.lit(name + " "), percent["raw_value"], F.lit("%"))
        count = F.concat(F.lit("["), absolute["shown"], F.lit("]"))
        fractions.append(F.when(percent.isNotNull() & absolute.isNotNull(), F.concat_ws(" ", share, count)).when(percent.isNotNull(), share).when(absolute.isNotNull(), F.concat(F.lit(name + " "), count)))
    fractions.append(F.concat(F.lit("Eritroblastos/100 Leuco "), _pick(obs, lambda o: _has(o, ("ERITROBLASTOS",)))["shown"]))
    every = _some(*fractions)
    leuko = F.concat(value("Leuco", ("LEUCOCITOS",)), F.when(F.size(every) > 0, F.concat(F.lit(" ("), F.array_join(every, " | "), F.lit(")"))).otherwise(""))
    remarks = F.concat(F.transform(F.filter(obs, lambda o: o["k"].contains("OBSERV")), lambda o: o["raw_value"]), narratives)
    remarks = F.array_distinct(F.filter(remarks, lambda t: _filled(t) & ~T.normalize_label(t).isin(*_SECTIONS)))
    items = F.concat(_some(*[value(n, k) for n, k in RED], leuko), F.transform(remarks, lambda t: F.concat(F.lit("Observação laboratorial: "), t)), _some(value("Plaq", ("PLAQUETAS",))))
    return _lines(F.array_join(items, " | "), F.size(items) > 0)


def ordered_panel(obs: Column, name: Column, order: tuple[str, ...]) -> Column:
    """Components in the order of the first entry that their label contains, others last, each in document order."""

    def place(o: Column) -> Column:
        return reduce(lambda acc, x: acc.when(o["k"].contains(x[1]), x[0]), list(enumerate(order))[1:], F.when(o["k"].contains(order[0]), 0)).otherwise(len(order))

    keyed = F.array_sort(F.transform(obs, lambda o, i: F.struct(place(o).alias("p"), i.alias("i"), F.concat_ws(" ", o["c"], o["shown"]).alias("t"))))
    return _lines(F.concat(name, F.lit(": "), F.array_join(F.transform(keyed, lambda x: x["t"]), " | ")), F.size(obs) > 0)


def coagulation_time(obs: Column) -> Column:
    own = _pick(obs, lambda o: o["k"] == "AMOSTRA")
    return _lines(F.concat(F.lit("TTPa "), own["shown"]), own.isNotNull())


def prothrombin(obs: Column) -> Column:
    items = F.transform(F.filter(obs, lambda o: o["k"].isin("ATIVIDADE", "RNI")), lambda o: F.concat(F.when(o["k"] == "RNI", "RNI ").otherwise("Atividade "), o["shown"]))
    return _lines(F.concat(F.lit("TP: "), F.array_join(items, " | ")), F.size(items) > 0)


def gram(obs: Column, narratives: Column, specimens: Column) -> Column:
    """The first value and results as they are, other values with their names, narratives, the material."""
    own = F.transform(obs, lambda o, i: F.when((i == 0) | (o["k"] == "RESULTADO"), o["raw_value"]).otherwise(F.concat_ws(" ", o["c"], o["raw_value"])))
    items = F.concat(F.filter(F.concat(own, narratives), _filled), F.transform(F.slice(specimens, 1, 1), lambda s: F.concat(F.lit("material "), s)))
    return _lines(F.concat(F.lit("Bacterioscópico (Gram): "), F.array_join(items, " | ")), F.size(items) > 0)


def microbiology(name: Column, obs: Column, attributes: Column, narratives: Column, specimens: Column, organisms: Column, groups: Column, linked: Column) -> Column:
    """A heading with material and result, narratives, then each organism with its antibiogram.

    An organism's own antibiogram comes first, else that of a linked one with the same organism. A
    result with a minimal concentration is written out, others as S, R or I.
    """
    material = F.get(specimens, F.lit(0))
    result = F.coalesce(F.get(obs, F.lit(0))["raw_value"], _pick(attributes, lambda a: T.normalize_label(a["name"]) == "CULTURAL")["value"])
    heading = F.concat(name, F.lit(":"), F.when(_filled(material), F.concat(F.lit(" material "), material)).otherwise(""), F.when(_filled(result), F.concat(F.when(_filled(material), " | ").otherwise(" "), result)).otherwise(""))

    def entry(e: Column) -> Column:
        key = T.normalize_label(F.coalesce(e["result"], F.lit("")))
        said = F.when(e["interpretation"] == "SENSIVEL", "S").when(e["interpretation"] == "RESISTENTE", "R").when(e["interpretation"] == "INTERMEDIARIO", "I").otherwise(e["result"])
        return F.concat_ws(" ", e["drug"], F.when(key.contains("MIC") | key.contains("CIM"), e["result"]).otherwise(said))

    def lines_of(o: Column, i: Column) -> Column:
        own = _pick(groups, lambda g: g["organism_id"] == o["id"])
        other = _pick(linked, lambda g: T.normalize_label(F.coalesce(g["organism"], F.lit(""))) == T.normalize_label(F.coalesce(o["name"], F.lit(""))))
        entries = F.coalesce(own["entries"], other["entries"])
        return F.concat(F.array(F.concat(F.lit("Organismo "), (i + 1).cast("string"), F.lit(": "), F.coalesce(o["name"], F.lit("")))), _lines(F.concat(F.lit("Antibiograma: "), F.array_join(F.transform(entries, entry), " | ")), F.coalesce(F.size(entries), F.lit(0)) > 0))

    return F.concat(F.array(heading), F.filter(narratives, _filled), F.flatten(F.transform(organisms, lines_of)))


def generic(name: Column, panel: Column, concept: Column, form: Column, obs: Column, attributes: Column, rate: Column) -> Column:
    """Panels as `name: component value | …`, one value as `name value`, several as components; attributes only without values.

    Rates that the laboratory reports itself are left out; a computed one follows the creatinine.
    """
    own = F.filter(obs, lambda o: o["k"] != REPORTED_RATE)
    items = F.transform(own, lambda o, i: F.concat_ws(" ", F.when((i == 0) & ((form == "scalar-related") | (concept == CREATININE)), name).otherwise(o["c"]), o["shown"]))
    items = F.when(rate.isNull() | (concept != CREATININE), items).otherwise(F.concat(F.slice(items, 1, 1), F.array(F.concat(F.lit("TFG "), rate)), F.slice(items, F.lit(2), F.greatest(F.size(items), F.lit(1)))))
    extra = F.transform(F.filter(attributes, lambda a: ~T.normalize_label(a["name"]).isin("MATERIAL", "AMOSTRA")), lambda a: F.concat_ws(" ", component(a["name"]), a["value"]))
    wide = form.isin("key-value-panel", "sectioned-panel", "multi-analyte-panel")
    alone = F.when(wide, F.array(F.concat(panel, F.lit(": "), F.array_join(extra, " | ")))).otherwise(extra)
    return (
        F.when((F.size(own) == 0) & (F.size(extra) > 0), alone).when(F.size(items) == 0, _none()).when(wide | (form == "indexed-assay"), F.array(F.concat(panel, F.lit(": "), F.array_join(items, " | "))))
        .when((F.size(items) == 1) & (F.size(own) == 1), F.array(F.concat_ws(" ", name, F.get(own, F.lit(0))["shown"]))).otherwise(F.array(F.array_join(items, " | ")))
    )


def lines(*, concept: Column, form: Column, name: Column, observations: Column, narratives: Column, specimens: Column, attributes: Column, organisms: Column, groups: Column, linked: Column, rate: Column) -> Column:
    """The lines of an occurrence; none if nothing can be rendered. NULL arrays count as empty, a NULL form as a single value.

    `observations` have been `prepared` in a column of their own, so that they are prepared once.
    """
    form = F.coalesce(form, F.lit("scalar"))
    concept = F.coalesce(concept, F.lit(""))
    obs = observations
    narratives, specimens = F.coalesce(narratives, _none()), F.coalesce(specimens, _none())
    attributes = F.coalesce(attributes, F.expr("cast(array() as array<struct<name:string,value:string>>)"))
    organisms, groups, linked = F.coalesce(organisms, F.expr(f"cast(array() as {ORGANISMS})")), F.coalesce(groups, F.expr(f"cast(array() as {GROUPS})")), F.coalesce(linked, F.expr(f"cast(array() as {GROUPS})"))
    panel = reduce(lambda acc, kv: acc.when(concept == kv[0], kv[1][0]), list(PANELS.items()), F.when(concept == HEMOGRAM, "Hemograma")).otherwise(name)
    out = F.when(concept == HEMOGRAM, hemogram(obs, narratives))
    for key, (title, order) in PANELS.items():
        out = out.when(concept == key, ordered_panel(obs, F.lit(title), order))
    out = out.when(concept == COAGULATION_TIME, coagulation_time(obs)).when(concept == PROTHROMBIN, prothrombin(obs)).when(concept == GRAM, gram(obs, narratives, specimens))
    out = out.when(form.isin(*CULTURES), microbiology(name, obs, attributes, narratives, specimens, organisms, groups, linked))
    return out.otherwise(generic(name, panel, concept, form, obs, attributes, rate))
