"""Deeply nested JSON records as flat tables, by Dewey labelling.

Every object of a record that is an element of an array gets a Dewey label: for each of its ancestors
and itself the place of the array among its owner's arrays and the ordinal in it, as five digits,
joined by dots (`0-00000.1-00002.0-00001`). The label of the parent is the label with its last part cut
off, so no identifiers of parents are carried through the walk, and the nodes of one schema path form
one table. Arrays of names that are not known form tables, too. One pass over a record yields all
tables; nothing is shuffled.

Shapes that senders mix are read alike: names in any letter case and with underscores, an object where
an array of one is meant, an array written as a string of JSON, and wrappers around the root.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from json.decoder import WHITESPACE, scanstring
from json.scanner import NUMBER_RE

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laudario.session import spread

# Array name -> (node kind, names of the node's own id, arrays that it may hold).
SCHEMA = {
    "patients": ("patient", ("patientkey",), ("episodes",)),
    "episodes": ("episode", ("episodekey",), ("laboratoryoccurrences",)),
    "laboratoryoccurrences": ("occurrence", ("occurrenceid",), ("observations",)),
    "observations": ("observation", ("observationid",), ()),
    "pages": ("page", ("pagenumber",), ("lines", "words")),
    "lines": ("line", ("id",), ("cells",)),
    "cells": ("cell", ("id",), ()),
    "words": ("word", ("id",), ()),
}
ROOTS = ("patients", "pages")
WIDTH = 5  # digits of an ordinal in a label; longer ordinals keep all their digits

NODES = "record_id bigint, dewey string, schema_path string, node_kind string, ordinal int, own_id string, fields string"
_ARROW = pa.schema([("record_id", pa.int64()), ("dewey", pa.string()), ("schema_path", pa.string()), ("node_kind", pa.string()), ("ordinal", pa.int32()), ("own_id", pa.string()), ("fields", pa.string())])


def _plain(name: str) -> str:
    return name.replace("_", "").lower()


def _refuse(name: str):
    raise ValueError(name)


def _space(text: str, at: int) -> int:
    return WHITESPACE.match(text, at).end()


def _key(text: str, at: int) -> tuple[str, int]:
    """The name of a member that begins at `at`, and where its value begins."""
    if text[at : at + 1] != '"':
        raise ValueError("a name is missing")
    name, at = scanstring(text, at + 1, True)
    at = _space(text, at)
    if text[at : at + 1] != ":":
        raise ValueError("a colon is missing")
    return name, _space(text, at + 1)


_PLAIN = {"true": True, "false": False, "null": None}


def parse_deep(text: str):
    """The value of a JSON text that nests too deeply for the parser of the standard library; a stack stands for its recursion."""
    stack: list[list] = []
    at = _space(text, 0)
    while True:
        sign = text[at : at + 1]
        if sign in ("{", "[") and sign:
            value, at = ({} if sign == "{" else []), _space(text, at + 1)
            if text[at : at + 1] != ("}" if sign == "{" else "]"):
                name = None
                if sign == "{":
                    name, at = _key(text, at)
                stack.append([value, name])
                continue
            at += 1
        elif sign == '"':
            value, at = scanstring(text, at + 1, True)
        elif word := next((w for w in _PLAIN if text.startswith(w, at)), None):
            value, at = _PLAIN[word], at + len(word)
        elif number := NUMBER_RE.match(text, at):
            whole, part, power = number.groups()
            value, at = (float(number[0]) if part or power else int(whole)), number.end()
        else:
            raise ValueError("a value is missing")
        while stack:
            owner, name = stack[-1]
            if name is None:
                owner.append(value)
            else:
                owner[name] = value
            at = _space(text, at)
            sign = text[at : at + 1]
            if sign == ",":
                at = _space(text, at + 1)
                if name is not None:
                    stack[-1][1], at = _key(text, at)
                break
            if sign != ("]" if name is None else "}"):
                raise ValueError("an end is missing")
            value, at = owner, at + 1
            stack.pop()
        else:
            if _space(text, at) != len(text):
                raise ValueError("more than one value")
            return value


def parse(text: str):
    """The value of a well-formed JSON text of any depth; ValueError otherwise (NaN and Infinity are not JSON)."""
    try:
        return json.loads(text, parse_constant=_refuse)
    except RecursionError:
        return parse_deep(text)


def _elements(value) -> list:
    """The elements of an array, of an object standing for an array of one, or of an array written as text."""
    if isinstance(value, str):
        if not value.lstrip()[:1] in ("{", "["):
            return []
        try:
            value = parse(value)
        except ValueError:
            return []
    if isinstance(value, dict):
        return [value]
    return value if isinstance(value, list) else []


def _text(value) -> str | None:
    if value is None or isinstance(value, (dict, list)) or value == "":
        return None
    return ("true" if value else "false") if isinstance(value, bool) else str(value)


def _roots(value) -> Iterator[dict]:
    """The outermost objects with a root array, through wrappers of any depth."""
    stack = [value]
    while stack:
        value = stack.pop()
        if isinstance(value, str) and value[:1] in "{[":
            try:
                value = parse(value)
            except ValueError:
                continue
        if isinstance(value, list):
            stack.extend(reversed(value))
        elif isinstance(value, dict):
            if any(_plain(k) in ROOTS for k in value):
                yield value
            else:
                stack.extend(reversed(list(value.values())))


def label(parent: str, slot: int, ordinal: int) -> str:
    part = f"{slot}-{ordinal:0{WIDTH}d}"
    return f"{parent}.{part}" if parent else part


def _fields(node: dict, inner: dict) -> str:
    """The node's values that are no arrays of objects, as JSON; lists too deep to be written are left out."""
    own = {k: v for k, v in node.items() if _plain(k) not in inner}
    try:
        return json.dumps(own, ensure_ascii=False)
    except RecursionError:
        return json.dumps({k: v for k, v in own.items() if not isinstance(v, (dict, list))}, ensure_ascii=False)


def _arrays(node: dict, known: tuple[str, ...], every: bool) -> dict[str, list]:
    """The node's arrays of objects by name; those of known names whatever they hold."""
    out = {}
    for k, v in node.items():
        name = _plain(k)
        if name in known:
            out[name] = _elements(v)
        elif every and (isinstance(v, (dict, list)) or isinstance(v, str) and v[:1] in ("{", "[")):
            elements = _elements(v)
            if any(isinstance(e, dict) for e in elements):
                out[name] = elements
    return out


def walk(payload: str, scalars: bool = True, every: bool = True) -> list[tuple]:
    """(dewey, schema_path, node_kind, ordinal, own_id, fields) of each node; none if the text is no JSON.

    `node_kind` is NULL for nodes of arrays that are not known where they stand; these are left out
    where `every` is off. `fields` holds the node's own values as JSON, or None where `scalars` is off.
    Null elements count in the ordinals but are no nodes, and neither are elements that are no objects.
    """
    try:
        top = parse(payload)
    except ValueError:
        return []
    out: list[tuple] = []
    roots = 0
    for holder in _roots(top):
        for root, elements in _arrays(holder, ROOTS, every).items():
            stack = [("", roots, root, root in ROOTS and root, elements)]
            roots += 1
            while stack:
                parent, slot, path, array, elements = stack.pop()
                kind, ids, known = SCHEMA[array] if array else (None, ("id",), ())
                for i, node in enumerate(elements):
                    if not isinstance(node, dict):
                        continue
                    here = label(parent, slot, i)
                    inner = _arrays(node, known, every)
                    own = {_plain(k): v for k, v in node.items()}
                    id_ = next((t for n in ids if (t := _text(own.get(n))) is not None), None)
                    out.append((here, path, kind, i, id_, _fields(node, inner) if scalars else None))
                    for j, (name, below) in enumerate(inner.items()):
                        stack.append((here, j, f"{path}.{name}", name in known and name, below))
    return out


def label_nodes(df: DataFrame, record: str = "record_id", payload: str = "payload", scalars: bool = True) -> DataFrame:
    """One row for each node of each record, with its Dewey label and schema path.

    NULL, empty and damaged payloads yield nothing; a repeated record yields its nodes again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in _ARROW]
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for node in walk(text, scalars) if text else ():
                    columns[0].append(rid)
                    for column, value in zip(columns[1:], node):
                        column.append(value)
                if len(columns[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)
                    columns = [[] for _ in _ARROW]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    return spread(df.select(F.col(record).cast("bigint").alias("record_id"), F.col(payload).alias("payload"))).mapInArrow(run, NODES)


def parent_label(dewey: Column) -> Column:
    """The label of the parent: the label without its last part; NULL for children of the root."""
    return F.when(dewey.contains("."), F.regexp_replace(dewey, r"\.[^.]*$", ""))


def flat_table(nodes: DataFrame, kind: str) -> DataFrame:
    """The table of one node kind: record_id, dewey, parent_dewey, ordinal, own_id, fields (JSON)."""
    return nodes.where(F.col("node_kind") == kind).select("record_id", "dewey", parent_label(F.col("dewey")).alias("parent_dewey"), "ordinal", "own_id", "fields")


def other_tables(nodes: DataFrame) -> DataFrame:
    """The rows of all tables that are not known, with their schema paths."""
    return nodes.where("node_kind is null").select("schema_path", "record_id", "dewey", parent_label(F.col("dewey")).alias("parent_dewey"), "ordinal", "own_id", "fields")


LINKS = "record_id bigint, node_kind string, parent_id string, child_id string"
_LINKS = pa.schema([("record_id", pa.int64()), ("node_kind", pa.string()), ("parent_id", pa.string()), ("child_id", pa.string())])


def links(df: DataFrame, record: str = "record_id", payload: str = "payload") -> DataFrame:
    """Distinct (record_id, node_kind, parent_id, child_id) of every node.

    Labels are resolved to ids within a record by truncation; ids that are absent are `#` and the
    ordinal. Records repeated under one id give their rows once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                nodes = walk(text, False, False)
                names = {n[0]: n[4] if n[4] is not None else f"#{n[3]}" for n in nodes}
                seen = {(rid, kind, names.get(dewey.rpartition(".")[0], "root"), names[dewey]): None for dewey, _, kind, _, _, _ in nodes}
                rows.extend(seen)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_LINKS)], schema=_LINKS)

    found = spread(df.select(F.col(record).cast("bigint").alias("record_id"), F.col(payload).alias("payload"))).mapInArrow(run, LINKS)
    return found.dropDuplicates(["record_id", "node_kind", "parent_id", "child_id"])
