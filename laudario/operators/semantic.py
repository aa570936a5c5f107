"""Typed laboratory content: exams found in lines by their catalogue names, and what belongs to them.

An exam begins at a line whose label is a name of the catalogue and owns the lines up to the next one;
over a page that is a running last value. Pages go on with the exam of the page before if they begin
with `MATERIAL` or the exam is a panel. Everything else is routed by the line's label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laudario.functions import text as T
from laudario.session import small_side

PANEL = "sectioned-panel"


def aliases(concepts: DataFrame) -> DataFrame:
    """(key, concept_id, structural_form_id): every display name and alias under its label key.

    A key that names two concepts is an error.
    """
    names = concepts.select("concept_id", "structural_form_id", F.explode(F.array_union(F.array("display_name"), F.coalesce("observed_aliases", F.expr("cast(array() as array<string>)")))).alias("n")).where("n IS NOT NULL")
    keys = names.select(T.normalize_label(F.col("n")).alias("key"), "concept_id", "structural_form_id").distinct()
    double = keys.groupBy("key").agg(F.count_distinct("concept_id").alias("n")).where("n > 1").limit(1).collect()
    if double:
        raise ValueError(f"the catalogue name {double[0]['key']!r} stands for several concepts")
    return keys


CULTURE = "microbiology-culture"


def anchored(lines: DataFrame, concepts: DataFrame) -> DataFrame:
    """Active lines with the exam they belong to: anchor line, concept, `reason` where there is none.

    A line whose label is a catalogue name opens an exam unless, in view of the exam opened last on the page,
    its label is a component of that exam, or `CULTURAL` within a culture, or names that exam again
    while neither its anchor line states a result nor a `MATERIAL` line stands between. As each decision depends on
    the one before, the page's catalogue lines, which are few, are folded in their order.
    """
    active = lines.where("disposition = 'Active'").select("document_id", "page_number", "line_id", "line_key", "source_index", "text")
    active = active.withColumn("label_key", T.normalize_label(T.literal_label(F.col("text"))))
    parts = concepts.select("concept_id", F.explode("observed_components").alias("p")).select("concept_id", T.normalize_label(F.col("p")).alias("key")).groupBy("key").agg(F.collect_set("concept_id").alias("part_of"))
    names = aliases(concepts).withColumnRenamed("concept_id", "own_concept").withColumnRenamed("structural_form_id", "own_form").join(parts, "key", "left")
    hit = active.repartition("document_id").join(small_side(names), active["label_key"] == F.col("key"), "left").drop("key")
    w = W.partitionBy("document_id", "page_number").orderBy("source_index", "line_id")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = F.coalesce(F.count(F.when(F.col("label_key") == "MATERIAL", 1)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    named = F.struct(
        "line_key", F.col("own_concept").alias("concept"), F.col("own_form").alias("form"), "label_key", F.coalesce("part_of", F.expr("cast(array() as array<string>)")).alias("part_of"),
        F.col("text").rlike(r"(?s)^[^:]*:.*\S").alias("result"), F.col("material").alias("material"),
    )
    df = hit.withColumn("material", before)
    df = df.withColumn("named", F.collect_list(F.when(F.col("own_concept").isNotNull(), named)).over(whole))
    last = "element_at(acc, -1)"
    again = f"{last}.concept = x.concept AND x.material = {last}.material AND NOT {last}.result"
    fold = f"""aggregate(named, slice(named, 1, 0), (acc, x) -> CASE WHEN size(acc) > 0 AND (
        array_contains(x.part_of, {last}.concept) OR ({last}.form = '{CULTURE}' AND x.label_key = 'CULTURAL') OR ({again})) THEN acc ELSE concat(acc, array(x)) END)"""
    # Only the page's catalogue lines look at the fold.
    opens = F.expr(f"exists({fold}, x -> x.line_key = line_key)")
    df = df.withColumn("opens", F.when(F.col("own_concept").isNotNull(), F.coalesce(opens, F.lit(False))).otherwise(False))
    anchor = F.when(F.col("opens"), F.struct("line_key", F.col("own_concept").alias("concept_id"), F.col("own_form").alias("form")))
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("anchor", F.last(anchor, ignorenulls=True).over(upto)).select("document_id", "page_number", "line_id", "line_key", "source_index", "text", "label_key", "opens", F.col("anchor.line_key").alias("anchor_key"), F.col("anchor.concept_id").alias("concept_id"), F.col("anchor.form").alias("form"))


def continued(anchors: DataFrame) -> DataFrame:
    """Lines before a page's first exam go to the last exam of the page before, if it may go on; else they keep a reason.

    All of it is windows over the documents that `anchored` has brought together.
    """
    page = W.partitionBy("document_id", "page_number")
    previous = W.partitionBy("document_id").orderBy("page_number").rangeBetween(-1, -1)
    df = anchors.withColumn("prev", F.max(F.struct("source_index", "line_id", "anchor_key", "concept_id", "form")).over(previous))
    df = df.withColumn("first_label", F.min(F.struct("source_index", "line_id", "label_key")).over(page)["label_key"]).withColumn("any_anchor", F.max("opens").over(page))
    can = F.col("prev.anchor_key").isNotNull() & ((F.col("prev.form") == PANEL) | (F.col("first_label") == "MATERIAL"))
    df = df.withColumn("carry", F.when(can, F.col("prev")))
    own = F.coalesce("anchor_key", "carry.anchor_key")
    reason = F.when(own.isNull(), F.when(F.col("any_anchor"), "PrefixWithoutSafeContext").otherwise("NoKnownAnchor"))
    return df.select("document_id", "page_number", "line_id", "line_key", "source_index", "text", "label_key", "opens", own.alias("anchor_key"), F.coalesce("concept_id", "carry.concept_id").alias("concept_id"), F.coalesce("form", "carry.form").alias("form"), reason.alias("reason"))


def routed(owned: DataFrame) -> DataFrame:
    """Adds `route`: Specimen, Numeric, Coded, Attribute, Narrative or Title.

    For the activated partial thromboplastin time `AMOSTRA` is a result and no specimen.
    """
    seg = F.trim(T.result_segment(F.col("text")))
    specimen = F.col("label_key").isin("MATERIAL", "AMOSTRA") & ~((F.col("label_key") == "AMOSTRA") & F.coalesce(F.col("concept_id") == "lab.tempo-tromboplastina", F.lit(False)))
    route = (
        F.when(specimen, "Specimen").when(seg.rlike(r"\d"), "Numeric").when(F.col("text").contains(":") & (F.length(seg) > 0), "Coded").when(F.col("opens") | F.col("text").contains(":"), "Title").otherwise("Narrative")
    )
    return owned.withColumn("route", route)


def observations(routes: DataFrame) -> DataFrame:
    """Numeric and coded observations with ordinals within their exam and stable ids."""
    pattern = F.lit("(?i)" + T.NUMERIC)
    seg = T.result_segment(F.col("text"))
    num = routes.where("route = 'Numeric' AND anchor_key IS NOT NULL").select("document_id", "anchor_key", "concept_id", "line_id", "line_key", "page_number", "source_index", T.literal_label(F.col("text")).alias("label"), F.posexplode(F.arrays_zip(F.regexp_extract_all(seg, pattern, 1).alias("v"), F.regexp_extract_all(seg, pattern, 2).alias("u"))).alias("k", "x"))
    num = num.select("document_id", "anchor_key", "concept_id", "line_id", "line_key", "page_number", "source_index", "label", "k", F.col("x.v").alias("raw_value"), F.nullif("x.u", F.lit("")).alias("raw_unit"), F.lit(None).cast("string").alias("coded_value"))
    coded = routes.where("route = 'Coded' AND anchor_key IS NOT NULL").select("document_id", "anchor_key", "concept_id", "line_id", "line_key", "page_number", "source_index", T.literal_label(F.col("text")).alias("label"), F.lit(0).alias("k"), F.trim(seg).alias("raw_value"), F.lit(None).cast("string").alias("raw_unit"), F.trim(seg).alias("coded_value"))
    both = num.unionByName(coded)
    w = W.partitionBy("anchor_key").orderBy("page_number", "source_index", "line_id", "k")
    return both.withColumn("ordinal", F.row_number().over(w) - 1).withColumn("numeric_value", F.when(F.col("coded_value").isNull(), T.parse_decimal(F.col("raw_value"))))


SEGMENTATION_RULE = "semantic.segmentation.catalogue-anchor"


def records(routes: DataFrame, lines: DataFrame, concepts: DataFrame) -> DataFrame:
    """One row an exam: representation status, rules, and how many lines, words, specimens and narratives it owns.

    An exam with a narrative beyond its first line is structured with a residual. The rules are that of the
    segmentation, the concept's extraction strategy and those of its lines, each once, in order.
    """
    own = routes.where("anchor_key IS NOT NULL").join(lines.select("line_key", "applied_rule_ids", "source_word_ids"), "line_key")
    g = own.groupBy("anchor_key", "concept_id").agg(
        F.count("*").alias("lines"), F.sum(F.coalesce(F.size("source_word_ids"), F.lit(0))).alias("words"), F.count_if(F.col("route") == "Specimen").alias("specimens"),
        F.count_if((F.col("route") == "Narrative") & (F.col("line_key") != F.col("anchor_key"))).alias("narratives"), F.array_distinct(F.flatten(F.collect_set("applied_rule_ids"))).alias("own"),
    )
    named = g.join(small_side(concepts.select("concept_id", "extraction_strategy_id").dropDuplicates(["concept_id"])), "concept_id", "left")
    rules = F.array_sort(F.array_distinct(F.filter(F.concat(F.array(F.lit(SEGMENTATION_RULE), F.col("extraction_strategy_id")), "own"), lambda r: r.isNotNull())))
    status = F.when(F.col("narratives") > 0, "StructuredWithResidual").otherwise("FullyStructured")
    return named.select("anchor_key", "concept_id", status.alias("status"), F.array_join(rules, " ").alias("rules"), "lines", "words", "specimens", "narratives")


def evidence(owned: DataFrame, lines: DataFrame) -> DataFrame:
    """(anchor_key, line_key, position, document_id, page_number, line_id, words, suppressed): every line of an exam in order, with what it is traced to."""
    own = owned.where("anchor_key IS NOT NULL").select("anchor_key", "line_key", "document_id", "page_number", "source_index", "line_id")
    w = W.partitionBy("anchor_key").orderBy("page_number", "source_index", "line_id")
    traced = lines.select("line_key", F.array_join("source_word_ids", ",").alias("words"), F.coalesce(F.size("suppressed_segments"), F.lit(0)).alias("suppressed"))
    return own.withColumn("position", F.row_number().over(w) - 1).join(traced, "line_key").select("anchor_key", "line_key", "position", "document_id", "page_number", "line_id", "words", "suppressed")


def organisms(routes: DataFrame) -> DataFrame:
    """(anchor_key, line_key, organism_id, organism): what the `CULTURAL` lines of cultures name, unless it is `NEGATIVO`."""
    value = F.trim(F.regexp_extract("text", "^[^:]*:(.*)$", 1))
    named = routes.where((F.col("form") == CULTURE) & (F.col("label_key") == "CULTURAL") & F.col("text").contains(":")).withColumn("organism", value)
    return named.where((F.col("organism") != "") & (F.upper("organism") != "NEGATIVO")).select("anchor_key", "line_key", T.stable_id("organism", F.col("anchor_key"), F.col("organism")).alias("organism_id"), "organism")


def susceptibility(rows: DataFrame) -> DataFrame:
    """Unpivots antibiogram rows: the i-th cell `drug: result` belongs to the i-th organism.

    `rows` has block, organisms (text split by bars) and text (cells split by bars).
    """
    cells = rows.select("block", F.split("organisms", r"\|").alias("o"), F.posexplode(F.split("text", r"\|")).alias("i", "cell"))
    drug, result = F.trim(F.substring_index("cell", ":", 1)), F.trim(F.regexp_extract("cell", "^[^:]*:(.*)$", 1))
    return cells.where(F.col("cell").contains(":")).select("block", F.trim(F.get("o", F.col("i"))).alias("organism"), drug.alias("drug"), result.alias("result"), interpretation(result).alias("interpretation")).where("organism IS NOT NULL AND organism != ''")


def interpretation(result: Column) -> Column:
    key = T.normalize_label(result)
    return F.when(key == "SENSIVEL", "S").when(key == "RESISTENTE", "R").when(key == "INTERMEDIARIO", "I")


def culture_links(cultures: DataFrame, panels: DataFrame) -> DataFrame:
    """(panel, culture) of an episode that share an organism, only where exactly one culture does.

    `cultures` and `panels` have episode_key, id and organism.
    """
    c = cultures.select("episode_key", T.normalize_label(F.col("organism")).alias("o"), F.col("id").alias("culture"))
    p = panels.select("episode_key", T.normalize_label(F.col("organism")).alias("o"), F.col("id").alias("panel"))
    pairs = p.join(c, ["episode_key", "o"]).select("episode_key", "panel", "culture").distinct()
    return pairs.groupBy("episode_key", "panel").agg(F.count("*").alias("n"), F.min("culture").alias("culture")).where("n = 1").select("episode_key", "panel", "culture")


def coverage(owned: DataFrame) -> DataFrame:
    """Owned and unsupported lines by page, document and in all, in one pass; `lossless` if every line is one of them, and owned once."""
    return owned.rollup("document_id", "page_number").agg(
        F.count("*").alias("lines"), F.count("anchor_key").alias("owned"), F.count("reason").alias("unsupported"), F.count_distinct("anchor_key").alias("exams"), (F.count("*") - F.count_distinct("line_key")).alias("multiply_owned"),
    ).select("document_id", "page_number", "lines", "owned", "unsupported", "exams", "multiply_owned", ((F.col("owned") + F.col("unsupported") == F.col("lines")) & (F.col("multiply_owned") == 0)).alias("lossless"))
