"""Between node and edge tables and provenance documents as JSON."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.scalars import json_string
from weftgraph.model import KINDS, PREFIXES, RELATIONS


def _object(entries: Column) -> Column:
    """A JSON object from an array of (key, literal). Keys without anything to escape are only put in quotes."""
    quoted = lambda k: F.when(F.rlike(k, F.lit(r"^[ !#-\[\]-~]*\z")), F.concat(F.lit('"'), k, F.lit('"'))).otherwise(json_string(k))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))


def literal(value: Column) -> Column:
    """The JSON text of a VARIANT in one form: numbers written with a point or an exponent keep one (1.0 isn't 1, 1e-05 is
    1.0E-5, 2.50 is 2.5), whole ones have none. Numbers inside arrays and objects lose a zero fraction."""
    kind = F.schema_of_variant(value)
    whole = F.regexp_extract(kind, r"^DECIMAL\((\d+),0\)$", 1)  # plain integers of up to 18 digits are BIGINT
    text = F.when(kind == "STRING", json_string(value.cast("string"))).otherwise(F.to_json(value))
    return F.when((whole != "") & (F.length(whole) < 3) & (F.lpad(whole, 2, "0") <= "18"), F.concat(text, F.lit(".0"))).otherwise(text)


def canonical(attrs: Column) -> Column:
    """A map of attribute names to JSON literals, its literals in the form of ``literal`` and its keys in order."""
    entries = F.transform(F.map_entries(attrs), lambda e: F.struct(e["key"].alias("key"), literal(F.try_parse_json(e["value"])).alias("value")))
    return F.map_from_entries(F.array_sort(entries))


def statements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, block, key, value (JSON), statement: a row for each node and edge. Ids of relations are blank nodes and not
    part of the statement."""
    n = nodes.select(
        "doc_id", F.col("kind").alias("block"), F.col("node_id").alias("key"), _object(F.map_entries("attrs")).alias("value"),
        F.concat_ws("\x1f", "kind", "node_id", F.to_json(canonical(F.col("attrs")))).alias("statement"),
    )
    body = F.lit(None).cast("string")
    role = F.when(F.coalesce(F.length("role"), F.lit(0)) > 0, F.concat(F.lit(',"prov:role":'), json_string(F.col("role")))).otherwise("")
    for rel, (a, b, *_) in RELATIONS.items():
        text = F.concat(F.lit(f'{{"{a}":'), json_string(F.col("src")), F.lit(f',"{b}":'), json_string(F.col("dst")), role, F.lit("}"))
        body = F.when(F.col("rel") == rel, text).otherwise(body)
    said = F.concat_ws("\x1f", "rel", "src", "dst", F.coalesce("role", F.lit("")))
    return n.unionByName(edges.select("doc_id", F.col("rel").alias("block"), F.col("edge_id").alias("key"), body.alias("value"), said.alias("statement")))


def grouped(rows: DataFrame, *more: Column) -> DataFrame:
    """doc_id, json [, more]: compact JSON, all blocks present; one shuffle. Of rows that repeat block and key one stays."""
    parts = F.array_sort(F.collect_list(F.struct("block", "key", "value"))).alias("parts")  # one document's
    found = rows.groupBy("doc_id").agg(parts, *more)
    after = lambda i: F.get(F.col("all"), i + 1)
    found = found.withColumnRenamed("parts", "all")
    single = F.filter("all", lambda p, i: ~(p["block"].eqNullSafe(after(i)["block"]) & p["key"].eqNullSafe(after(i)["key"])))
    found = found.withColumn("parts", single).drop("all")
    text = [F.lit(f'{{"prefix":{json.dumps(PREFIXES, separators=(",", ":"))}')]
    of = lambda block: F.filter("parts", lambda p: p["block"] == block)
    for b in (*KINDS, *RELATIONS):
        text += [F.lit(f',"{b}":'), _object(of(b))]
    return found.withColumn("json", F.concat(*text, F.lit("}"))).drop("parts")


def to_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, json: one document for each doc_id."""
    return grouped(statements(nodes, edges).drop("statement"))


def with_json(rows: DataFrame) -> DataFrame:
    """Whole documents as rows, whose nodes have attributes (``generate.run_documents``), with one more column ``json``: compact
    JSON as ``to_documents`` makes it, without a shuffle. Of parts that repeat block and key one stays."""
    parts = {}
    for b in KINDS:
        parts[f"parts_{b}"] = F.transform(b, lambda n: F.struct(n["node_id"].alias("key"), _object(F.map_entries(n["attrs"])).alias("value")))
    for b, (x, y, *_) in RELATIONS.items():
        value = lambda e: F.struct(e["src"].alias(x), e["dst"].alias(y), F.nullif(e["role"], F.lit("")).alias("prov:role"))
        there = F.filter(b, lambda e: e["edge_id"].isNotNull() & e["src"].isNotNull() & e["dst"].isNotNull())
        parts[f"parts_{b}"] = F.transform(there, lambda e: F.struct(e["edge_id"].alias("key"), value(e).alias("value")))
    found = rows.select("*", *[F.sort_array(p).alias(name) for name, p in parts.items()])
    text = [F.lit(f'{{"prefix":{json.dumps(PREFIXES, separators=(",", ":"))}')]
    for b in (*KINDS, *RELATIONS):
        all_parts = F.col(f"parts_{b}")
        single = F.filter(all_parts, lambda p, i: ~p["key"].eqNullSafe(F.get(all_parts, i + 1)["key"]))
        text += [F.lit(f',"{b}":'), _object(single) if b in KINDS else F.to_json(F.map_from_entries(single), {"ignoreNullFields": "true"})]
    return found.select(*rows.columns, F.concat(*text, F.lit("}")).alias("json"))


def tables_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of whole documents as rows, whose nodes have attributes."""
    tagged = lambda n, name: F.transform(n, lambda e: F.struct(F.lit(n).alias(name), e.alias("e")))
    each = lambda names, name: F.flatten(F.array(*[tagged(n, name) for n in names]))
    return tuple(rows.select("doc_id", F.inline(each(names, name))).select("doc_id", name, "e.*") for names, name in ((KINDS, "kind"), (RELATIONS, "rel")))


def parse(documents: DataFrame) -> DataFrame:
    """doc_id, doc: (doc_id, json) as VARIANT; null for what isn't JSON, or repeats a key in an object."""
    return documents.select("doc_id", F.try_parse_json("json").alias("doc"))


def members(value: Column) -> Column:
    """The members of an object of a VARIANT as a map; null for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def block_of(doc: Column, name: Column) -> Column:
    """The members of a block of a document; null if there is none or it is no object."""
    return members(F.try_element_at(members(doc), name))


def blocks(names: Iterable[str]) -> Column:
    """Literals (block, a, b): names of blocks and, of relations, the keys of their ends."""
    ends = lambda n: RELATIONS[n][:2] if n in RELATIONS else (None, None)
    return F.array(*[F.struct(*[F.lit(x).cast("string").alias(k) for k, x in zip(("block", "a", "b"), (n, *ends(n)), strict=True)]) for n in names])


def _entries(parsed: DataFrame, names: Iterable[str]) -> DataFrame:
    """doc_id, block, a, b, key, value of the members of the blocks that are objects, in one pass over a document."""
    none = F.array().cast("array<struct<block: string, a: string, b: string, key: string, value: variant>>")

    def inside(s: Column) -> Column:
        found = F.map_entries(block_of(F.col("doc"), s["block"]))
        return F.coalesce(F.transform(found, lambda e: F.struct(s["block"].alias("block"), s["a"].alias("a"), s["b"].alias("b"), e["key"].alias("key"), e["value"].alias("value"))), none)

    return parsed.select("doc_id", F.inline(F.flatten(F.transform(blocks(names), inside))))


def with_rows(parsed: DataFrame, attrs: bool = False) -> DataFrame:
    """``parsed`` documents (doc_id, doc) as rows, in one pass without a shuffle: an array of elements (node_id, is_object, has_type
    [, attrs]) for each kind and one of edges (edge_id, is_object, src, src_text, dst, dst_text, role) for each relation, as ``elements`` and
    ``relations`` have them, and ``lacking``: the blocks that are missing or no objects, with whether they are there."""
    at = lambda n, kind: F.try_variant_get("doc", f"$['{n}']", kind)
    inner = {k: "map<string,variant>" for k in KINDS} | {r: f"struct<`{a}`:variant,`{b}`:variant,`prov:role`:variant>" for r, (a, b, *_) in RELATIONS.items()}
    maps = [at(n, f"map<string,{kind}>").alias(f"in_{n}") for n, kind in inner.items()]
    found = parsed.select("*", at("prefix", "map<string,variant>").alias("prefix"), *maps)
    named = lambda **cols: F.struct(*[c.alias(k) for k, c in cols.items()])
    sorted_attrs = lambda m: F.map_from_entries(F.sort_array(F.map_entries(F.transform_values(m, lambda _, v: literal(v)))))

    def element(e: Column) -> Column:
        more = {"attrs": sorted_attrs(e["value"])} if attrs else {}
        return named(node_id=e["key"], is_object=e["value"].isNotNull(), has_type=F.coalesce(F.map_contains_key(e["value"], "prov:type"), F.lit(False)), **more)

    def edge(a: str, b: str) -> tuple:
        is_text = lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))
        string = lambda v: F.try_variant_get(v, "$", "string")
        plain = lambda v, text: F.when(text, string(v)).when(F.is_variant_null(v), "None").otherwise(F.to_json(v))
        read = lambda e: named(key=e["key"], m=e["value"], src_text=is_text(e["value"][a]), dst_text=is_text(e["value"][b]))
        made = lambda e: named(
            edge_id=e["key"], is_object=e["m"].isNotNull(), src=plain(e["m"][a], e["src_text"]), src_text=e["src_text"],
            dst=plain(e["m"][b], e["dst_text"]), dst_text=e["dst_text"], role=string(e["m"]["prov:role"]),
        )
        return read, made

    rows = []
    for n in inner:
        entries = F.map_entries(f"in_{n}")
        if n in KINDS:
            array, empty = F.transform(entries, element), f"array<struct<node_id:string,is_object:boolean,has_type:boolean{',attrs:map<string,string>' if attrs else ''}>>"
        else:
            read, made = edge(*RELATIONS[n][:2])
            array = F.transform(F.transform(entries, read), made)
            empty = "array<struct<edge_id:string,is_object:boolean,src:string,src_text:boolean,dst:string,dst_text:boolean,role:string>>"
        rows.append(F.coalesce(array, F.array().cast(empty)).alias(n))
    lacking = F.array_compact(F.array(*[F.when(F.col(f"in_{n}").isNull(), named(block=F.lit(n), there=at(n, "variant").isNotNull())) for n in inner]))
    # a whole copy of the document is only made where no block tells that it is an object
    is_object = F.coalesce(*[F.col(f"in_{n}").isNotNull() | F.lit(None) for n in inner], members(F.col("doc")).isNotNull())
    return found.select(*parsed.columns, "prefix", is_object.alias("is_object"), lacking.alias("lacking"), *rows)


def elements(parsed: DataFrame) -> DataFrame:
    """doc_id, kind, node_id, is_object, has_type, ptype, attrs (JSON literals): every declared element."""
    rows = _entries(parsed, KINDS).withColumn("m", members(F.col("value")))
    return rows.select(
        "doc_id", F.col("block").alias("kind"), F.col("key").alias("node_id"), F.col("m").isNotNull().alias("is_object"),
        F.coalesce(F.map_contains_key("m", "prov:type"), F.lit(False)).alias("has_type"),
        F.try_variant_get("value", "$['prov:type']", "string").alias("ptype"),
        F.map_from_entries(F.array_sort(F.map_entries(F.transform_values("m", lambda k, v: literal(v))))).alias("attrs"),
    )


def relations(parsed: DataFrame) -> DataFrame:
    """doc_id, rel, edge_id, is_object, has_src, src, has_dst, dst, role. An end that is no string is its JSON text."""
    rows = _entries(parsed, RELATIONS).withColumn("m", members(F.col("value")))
    out = []
    for side, key in (("src", "a"), ("dst", "b")):
        end = F.try_element_at("m", F.col(key))
        is_text = F.coalesce(F.schema_of_variant(end) == "STRING", F.lit(False))
        plain = F.when(F.is_variant_null(end), "None").when(is_text, F.try_variant_get(end, "$", "string")).otherwise(F.to_json(end))
        out += [F.coalesce(F.map_contains_key("m", F.col(key)), F.lit(False)).alias(f"has_{side}"), plain.alias(side), is_text.alias(f"{side}_text")]
    role = F.try_variant_get("value", "$['prov:role']", "string").alias("role")
    return rows.select("doc_id", F.col("block").alias("rel"), F.col("key").alias("edge_id"), F.col("m").isNotNull().alias("is_object"), *out, role)


def to_tables(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of documents (doc_id, json), or of parsed ones (doc_id, doc). Attribute values are JSON literals in the
    form of ``literal``. Each table is one narrow pass over the documents."""
    parsed = documents if "doc" in documents.columns else parse(documents)
    nodes = elements(parsed).where("is_object").select("doc_id", "kind", "node_id", "ptype", "attrs")
    return nodes, relations(parsed).where("is_object").select("doc_id", "rel", "edge_id", "src", "dst", "role")
