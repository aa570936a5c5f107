"""Every line of a page classified, first matching rule wins; states are windows over the page.

A page is the partition of all windows, so one shuffle serves them all. States (history, notes, methods)
are expressed by the last line at which something happened, not by a walk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laudario.functions import text as T
from laudario.operators.notes import BLOCK_STARTS, FOOTER_REST, FOOTER_START, NOTE_RULES

PAGE = ("document_id", "page_number")
REFERENCE = r"(?i)\bValor(?:es)?\s+de\s+Refer[eê]ncia\s*:?"


def _starts(c: Column, word: str) -> Column:
    return F.lower(c).startswith(word.lower())


def match_note(key: Column) -> tuple[Column, Column]:
    """(rule, goes on to the footer) of a comparison key; NULL and false if no rule fits."""
    rule = reduce(lambda acc, r: acc.when(key.startswith(r[1]), F.lit(r[0])), NOTE_RULES[1:], F.when(key.startswith(NOTE_RULES[0][1]), F.lit(NOTE_RULES[0][0])))
    long = reduce(lambda acc, r: acc | key.startswith(r[1]), [r for r in NOTE_RULES if r[2]], F.lit(False))
    return rule, long


def match_block(key: Column, following: Column) -> Column:
    """Rule of a heading that is a note only because of the next line."""
    head = F.regexp_replace(key, ":+$", "")
    out = None
    for rule, heading, prefix in BLOCK_STARTS:
        test = (head == heading) & F.coalesce(following.startswith(prefix), F.lit(False))
        out = F.when(test, rule) if out is None else out.when(test, rule)
    return out


def predicates(lines: DataFrame, text: str = "text") -> DataFrame:
    """Adds the flags that the states need: `hist`, `method`, `calc`, `boundary`, `marker`, `rule`, `long`, `balance`, `open_end`."""
    w = W.partitionBy(*PAGE).orderBy("source_index", "line_id")
    df = lines.withColumn("norm", T.normalize_text(F.col(text)))
    df = df.withColumn("key", T.comparison_key(F.col("norm")))
    c, key = F.col("norm"), F.col("key")
    rule, long = match_note(key)
    fragment = F.regexp_replace(key, ":+$", "").isin("VALOR DE", "VALORES DE", "REFERENCIA", "REFERENCIAS")
    df = df.withColumn("hist", _starts(c, "Resultados Anteriores") | _starts(c, "Resultado Anterior")).withColumn("method", _starts(c, "Método") | _starts(c, "Metodo"))
    df = df.withColumn("calc", c.rlike(r"(?i)^Idade:\s*\d+\s+Sexo:\s*\S+$")).withColumn("fragment", fragment).withColumn("material", _starts(c, "Material"))
    df = df.withColumn("boundary", F.col("method") | F.col("material") | F.col("hist") | c.rlike(REFERENCE) | fragment | T.is_upper_label(c) | T.is_any_label(c) | T.is_section_title(c))
    df = df.withColumn("marker", key.rlike("^(NOTA|ATENCAO|OBSERVACAO|OBSERVACOES)")).withColumn("rule", F.coalesce(rule, match_block(key, F.lead("key").over(w)))).withColumn("long", long)
    df = df.withColumn("balance", F.regexp_count(c, F.lit(r"\(")) - F.regexp_count(c, F.lit(r"\)"))).withColumn("open_end", (F.col("balance") > 0) | c.rlike(r"[-=]\s*$"))
    return df.withColumn("empty_label", F.replace(key, F.lit("."), F.lit("")).isin("OBSERVACAO:", "OBSERVACOES:"))


def bounds(lines: DataFrame) -> DataFrame:
    """Adds `i` (place of the line on its page), `header` and `footer` flags.

    The header goes to the first line that begins `Data Col`; the footer begins at the first line that
    begins as one and has the four other footer lines after it.
    """
    w = W.partitionBy(*PAGE).orderBy("source_index", "line_id")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = w.rowsBetween(1, W.unboundedFollowing)
    df = lines.withColumn("i", F.row_number().over(w) - 1)
    df = df.withColumn("header_end", F.min(F.when(_starts(F.col("norm"), "Data Col"), F.col("i"))).over(whole))
    rest = reduce(lambda a, b: a & b, [F.max(_starts(F.col("norm"), p).cast("int")).over(after) == 1 for p in FOOTER_REST])
    df = df.withColumn("can_foot", _starts(F.col("norm"), FOOTER_START) & F.coalesce(rest, F.lit(False)))
    df = df.withColumn("footer_start", F.min(F.when(F.col("can_foot"), F.col("i"))).over(whole))
    return df.withColumn("header", F.coalesce(F.col("i") <= F.col("header_end"), F.lit(False))).withColumn("footer", F.coalesce(F.col("i") >= F.col("footer_start"), F.lit(False)))


def classify(lines: DataFrame, text: str = "text") -> DataFrame:
    """Adds `class` to every line: Header, Footer, History, BoilerplateNote, Method, EmptyLabel, Reference or Active; and `note_rule`, the rule of the note that a line belongs to.

    NULL texts are Active. The class doesn't depend on how the rows are partitioned.
    """
    df = bounds(predicates(lines, text))
    body = ~F.col("header") & ~F.col("footer")
    upto = W.partitionBy(*PAGE).orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*PAGE).orderBy("i").rowsBetween(W.unboundedPreceding, -1)

    def last(test: Column, frame=upto) -> Column:
        return F.coalesce(F.max(F.when(body & test, F.col("i"))).over(frame), F.lit(-1))

    df = df.withColumn("last_hist", last(F.col("hist"))).withColumn("last_break", last(F.col("boundary") & ~F.col("hist")))
    df = df.withColumn("in_hist", body & (F.col("last_hist") > F.col("last_break")))
    free = ~F.col("in_hist")
    start = F.col("rule").isNotNull() & free
    df = df.withColumn("last_note", last(start)).withColumn("note_long", F.last(F.when(body & start, F.col("long")), ignorenulls=True).over(upto)).withColumn("note_end", last((F.col("boundary") | F.col("marker")) & ~start & free))
    df = df.withColumn("in_note", body & free & (F.col("last_note") > F.col("last_hist")) & (F.coalesce("note_long", F.lit(False)) | (F.col("note_end") < F.col("last_note"))))
    free = free & ~F.col("in_note")
    df = df.withColumn("last_method", last(F.col("method") & free, before))
    # a method line goes on while it and its continuations stay open and nothing else begins
    df = df.withColumn("last_closed", last(free & ~F.col("calc") & ~F.col("open_end"), before)).withColumn("last_other", last(free & ~F.col("calc") & ~F.col("method") & (F.col("boundary") | F.col("marker"))))
    going = (F.col("last_method") >= 0) & (F.col("last_method") > F.col("last_hist")) & (F.col("last_method") > F.col("last_note")) & (F.col("last_closed") < F.col("last_method")) & (F.col("last_other") < F.col("last_method"))
    df = df.withColumn("in_method", body & free & (F.col("method") | F.col("calc") | going))
    out = (
        F.when(F.col("header"), "Header").when(F.col("footer"), "Footer").when(F.col("in_hist"), "History").when(F.col("in_note"), "BoilerplateNote").when(F.col("in_method"), "Method")
        .when(F.col("empty_label"), "EmptyLabel").when(F.col("fragment"), "Reference").when(~F.col("material") & F.col("norm").rlike("^" + REFERENCE), "Reference").otherwise("Active")
    )
    rule = F.last(F.when(body & start, F.col("rule")), ignorenulls=True).over(upto)
    return df.withColumn("class", out).withColumn("note_rule", F.when(F.col("class") == "BoilerplateNote", rule))


def parenthesis_joins(lines: DataFrame) -> DataFrame:
    """(line_key, next_key, joined) of active lines whose open bracket the next active line closes.

    A line that was joined to the one before opens no further join.
    """
    w = W.partitionBy(*PAGE).orderBy("source_index", "line_id")
    df = lines.where("disposition = 'Active'").withColumn("b", F.regexp_count("text", F.lit(r"\(")) - F.regexp_count("text", F.lit(r"\)")))
    df = df.withColumn("nb", F.lead("b").over(w)).withColumn("next_text", F.lead("text").over(w)).withColumn("next_key", F.lead("line_key").over(w))
    return df.where("b > 0 AND nb < 0").select("line_key", "next_key", F.concat_ws(" ", "text", "next_text").alias("joined"))


#: Labels that header lines begin with (fixed values).
HEADER_LABELS = ("Nome do Paciente", "Data Nascimento", "Solicitante", "Registro", "Nr Requisição", "Origem", "Hora Req", "Data Col")
#: Patterns of header lines with two values (fixed values).
PATIENT = r"(?i)^Nome do Paciente\.*:\s*(.*?)\s+Sexo\.*:\s*(.+)$"
BIRTH = r"(?i)^Data Nascimento\.*:\s*(\S*)\s+Idade\.*:\s*(.*)$"
REQUEST = r"(?i)^Nr Requisi[cç][aã]o\.*:\s*(\S*)\s+Data Req:\s*(.*)$"
COLLECTION = r"(?i)^Data Col\.*:\s*(\S*)\s+Hora Col:\s*(.*)$"
NO_HEADER = "Cabeçalho sem marcador Data Col."


def parse_header(lines: DataFrame) -> DataFrame:
    """The 14 header fields of each page, the ids of its header lines, and the fragments that no field explains.

    The header goes to the first line that begins `Data Col`; without one all fields are NULL and the
    only fragment says so. Of several matches the last one counts. Lines between the requester and the
    request go on with the requester, those between the origin and the end with the origin. The first four lines
    are letterhead. A header is a bounded number of lines, so it is read as an array.
    """
    df = lines.withColumn("norm", T.normalize_text(F.coalesce("text", F.lit(""))))
    end = F.min(F.when(_starts(F.col("norm"), "Data Col"), F.struct("source_index", "line_id"))).over(W.partitionBy(*PAGE))
    df = df.withColumn("end", end).withColumn("inside", F.struct("source_index", "line_id") <= F.col("end"))
    by_page = df.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.when(F.col("inside"), F.struct("source_index", "line_id", "norm")))).alias("rows"))
    h = by_page.withColumn("t", F.transform("rows", lambda r: r["norm"])).withColumn("n", F.size("rows"))
    places = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    h = h.withColumn("places", places)

    def last(test) -> Column:
        """Place of the last line that passes, or -1."""
        return F.coalesce(F.array_max(F.filter("places", lambda i: test(F.get("t", i)))), F.lit(-1))

    def known(x: Column) -> Column:
        return reduce(lambda a, b: a | b, [_starts(x, label) for label in HEADER_LABELS])

    for name, test in {
        "patient": lambda x: x.rlike(PATIENT), "birth": lambda x: x.rlike(BIRTH), "requester": lambda x: _starts(x, "Solicitante"), "registry": lambda x: _starts(x, "Registro"),
        "request": lambda x: x.rlike(REQUEST), "source": lambda x: _starts(x, "Origem"), "hour": lambda x: _starts(x, "Hora Req"), "collection": lambda x: x.rlike(COLLECTION),
    }.items():
        h = h.withColumn(f"at_{name}", last(test))

    def line(name: str) -> Column:
        return F.get("t", F.when(F.col(f"at_{name}") >= 0, F.col(f"at_{name}")))

    def filled(c: Column) -> Column:
        return F.nullif(F.trim(c), F.lit(""))

    def group(name: str, pattern: str, g: int) -> Column:
        return filled(F.regexp_extract(line(name), pattern, g))

    def content(name: str) -> Column:
        return F.regexp_extract(line(name), "^[^:]*:(.*)$", 1)

    def parted(name: str, label: str) -> tuple[Column, Column]:
        """What stands before and behind a second label in a line."""
        c = content(name)
        at = F.instr(F.lower(c), F.lit(label.lower() + ":"))
        return filled(F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c)), filled(F.when(at > 0, F.substring(c, at + len(label) + 1, F.length(c))))

    def run_on(first: Column, begin: str, stop: Column) -> Column:
        """A value with the lines that go on with it."""
        more = F.filter("places", lambda i: (i > F.col(begin)) & (i < stop) & ~known(F.get("t", i)))
        return F.nullif(F.array_join(F.concat(F.when(first.isNotNull(), F.array(first)).otherwise(F.expr("cast(array() as array<string>)")), F.transform(more, lambda i: F.get("t", i))), " "), F.lit(""))

    requester, registration = parted("requester", "Registro")
    origin, hour = parted("source", "Hora Req")
    h = h.withColumn("requester0", requester).withColumn("registration0", registration).withColumn("origin0", origin).withColumn("hour0", hour)
    going = (F.col("at_requester") >= 0) & (F.col("at_request") > F.col("at_requester"))
    spread = (F.col("at_source") >= 0) & (F.col("n") - 1 > F.col("at_source"))
    rest = F.filter("places", lambda i: (i >= 4) & ~known(F.get("t", i)) & (F.get("t", i) != "") & ~((F.col("at_requester") >= 0) & (i > F.col("at_requester")) & (i < F.col("at_request"))) & ~((F.col("at_source") >= 0) & (i > F.col("at_source")) & (i < F.col("n") - 1)))
    some = F.col("n") > 0
    return h.select(
        *PAGE, F.get("t", F.lit(0)).alias("issuer"), F.get("t", F.lit(1)).alias("laboratory"), group("patient", PATIENT, 1).alias("patient_name"), group("patient", PATIENT, 2).alias("sex"),
        group("birth", BIRTH, 1).alias("birth_date"), group("birth", BIRTH, 2).alias("reported_age"), F.when(going, run_on(F.col("requester0"), "at_requester", F.col("at_request"))).otherwise(F.col("requester0")).alias("requester"),
        F.when(F.col("at_registry") > F.col("at_requester"), F.trim(content("registry"))).otherwise(F.col("registration0")).alias("requester_registration"),
        group("request", REQUEST, 1).alias("request_number"), group("request", REQUEST, 2).alias("request_date"), F.when(F.col("at_hour") > F.col("at_source"), F.trim(content("hour"))).otherwise(F.col("hour0")).alias("request_time"),
        F.when(spread, run_on(F.col("origin0"), "at_source", F.col("n") - 1)).otherwise(F.col("origin0")).alias("origin"), group("collection", COLLECTION, 1).alias("collection_date"), group("collection", COLLECTION, 2).alias("collection_time"),
        F.transform("rows", lambda r: r["line_id"]).alias("source_line_ids"), F.when(some, F.transform(rest, lambda i: F.get("t", i))).otherwise(F.array(F.lit(NO_HEADER))).alias("unresolved_fragments"),
    )


def counters(lines: DataFrame) -> DataFrame:
    """Active and suppressed lines of each document."""
    return lines.groupBy("document_id").agg(F.count_if(F.col("disposition") == "Active").alias("active_lines"), F.count_if(F.col("disposition") != "Active").alias("suppressed_lines"))
