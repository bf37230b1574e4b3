"""Conformance checks of provenance documents, the gate and its report.

Rules are joins and filters over node and edge tables, which JSON documents are exploded into, and become rows
of errors (doc_id, stage, item, message); ``stage`` and ``item`` put messages in the order of the rules, and
within a rule in the order of ids. References are anti joins on (doc_id, kind, id).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.model import KINDS, RELATIONS, REQUIRED_PREFIXES, expected_counts
from weftgraph.operators import documents as D
from weftgraph.operators.stats import document_stats

CHECKS = ("schema", "shacl", "round_trip")
POLICIES = ("strict", "warn", "abort")
MAX_FAILURES = 200
SHACL_MESSAGES = 10


def check_names(names: Sequence[str]) -> tuple[str, ...]:
    """The wanted checks in their fixed order; an unknown name is a ValueError."""
    unknown = sorted(set(names) - set(CHECKS))
    if unknown:
        raise ValueError(f"Unknown check(s): {unknown}")
    return tuple(c for c in CHECKS if c in names)


def _errors(df: DataFrame, stage: int, item: Column, message: Column) -> DataFrame:
    return df.select("doc_id", F.lit(stage).alias("stage"), item.alias("item"), message.alias("message"))


def _say(text: str, *cols: str | Column) -> Column:
    return F.format_string(text, *[F.col(c) if isinstance(c, str) else c for c in cols])


def repr_text(c: Column) -> Column:
    """A string as Python shows it: quotes chosen and backslashes doubled, without other escapes."""
    body = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    has, has2 = F.contains(c, F.lit("'")), F.contains(c, F.lit('"'))
    return F.when(has & ~has2, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))


def element_errors(elements: DataFrame) -> DataFrame:
    """Elements (doc_id, kind, node_id, is_object, has_type) whose attributes are no object or have no type."""
    n = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("string")
    item = F.concat_ws("|", n, "node_id")
    out = _errors(elements.where("not is_object"), 3, item, _say("%s '%s' attributes not an object", "kind", "node_id"))
    return out.unionByName(_errors(elements.where("is_object and not has_type"), 3, item, _say("%s '%s' missing prov:type", "kind", "node_id")))


def _endpoints(relations: DataFrame) -> DataFrame:
    """Two rows an edge: key and kind of the end, whether it is there, what it refers to."""
    ends = []
    for side, k, kind in (("src", 0, 2), ("dst", 1, 3)):
        key = F.create_map(*[F.lit(x) for r, v in RELATIONS.items() for x in (r, v[k])])
        bucket = F.create_map(*[F.lit(x) for r, v in RELATIONS.items() for x in (r, v[kind])])
        ends.append(F.struct(
            F.lit(k).alias("side"), key[F.col("rel")].alias("key"), bucket[F.col("rel")].alias("kind"), F.col(f"has_{side}").alias("has"),
            F.col(side).alias("ref"), F.col(f"{side}_text").alias("is_text"),
        ))
    return relations.select("doc_id", "rel", "edge_id", F.inline(F.array(*ends)))


def relation_errors(relations: DataFrame, declared: DataFrame) -> DataFrame:
    """Malformed relations, missing ends and ends that no element of their kind declares (an anti join)."""
    n = F.array_position(F.array(*map(F.lit, RELATIONS)), F.col("rel"))
    order = F.concat_ws("|", n.cast("string"), F.format_string("%06d", F.length("edge_id")), "edge_id")
    out = _errors(relations.where("not is_object"), 4, order, _say("%s '%s' not an object", "rel", "edge_id"))
    ends = _endpoints(relations.where("is_object"))
    order = F.concat_ws("|", order, F.col("side").cast("string"))
    out = out.unionByName(_errors(ends.where("not has"), 4, order, _say("%s '%s' missing %s", "rel", "edge_id", "key")))
    ids = declared.select("doc_id", "kind", F.col("node_id").alias("ref"), F.lit(True).alias("found")).distinct()
    lost = ends.where("has").join(ids, ["doc_id", "kind", "ref"], "left").where("found is null or not is_text")
    other = F.when(F.col("ref") == "true", "True").when(F.col("ref") == "false", "False").otherwise(F.col("ref"))
    shown = F.when(F.col("is_text"), repr_text(F.col("ref"))).otherwise(other)
    return out.unionByName(_errors(lost, 4, order, _say("%s '%s' %s=%s not a declared %s", "rel", "edge_id", "key", shown, "kind")))


def cardinality_errors(stats: DataFrame, failed: DataFrame, folds: int = 5) -> DataFrame:
    """Counts against the template, only for documents without earlier errors."""
    want = expected_counts(folds)
    clean = stats.join(failed.select("doc_id").distinct(), "doc_id", "left_anti")
    tests = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("name"), F.col(k).alias("got"), F.lit(w).alias("want")) for i, (k, w) in enumerate(want.items())])
    rows = clean.select("doc_id", F.inline(tests)).where("got <> want")
    return _errors(rows, 5, F.col("i").cast("string"), _say("%s=%d, expected %d", "name", F.col("got").cast("long"), F.col("want").cast("long")))


def table_errors(nodes: DataFrame, edges: DataFrame, cardinality: bool = True, folds: int = 5) -> DataFrame:
    """The same rules over node and edge tables, where a null type, end or id is a missing one."""
    elements = nodes.select("doc_id", "kind", "node_id", F.lit(True).alias("is_object"), F.col("ptype").isNotNull().alias("has_type"))
    relations = edges.select(
        "doc_id", "rel", "edge_id", F.lit(True).alias("is_object"), F.col("src").isNotNull().alias("has_src"), "src", F.lit(True).alias("src_text"),
        F.col("dst").isNotNull().alias("has_dst"), "dst", F.lit(True).alias("dst_text"), "role",
    )
    out = element_errors(elements).unionByName(relation_errors(relations, elements))
    return out.unionByName(cardinality_errors(document_stats(nodes, edges), out, folds)) if cardinality else out


def shacl_errors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The activity shape: at least one association, and each association's target is an agent."""
    acts = nodes.where("kind = 'activity'").select("doc_id", "node_id").distinct()
    assoc = edges.where("rel = 'wasAssociatedWith'").select("doc_id", F.col("src").alias("node_id"), "dst")
    agents = nodes.where("kind = 'agent'").select("doc_id", F.col("node_id").alias("dst")).distinct()
    none = acts.join(assoc, ["doc_id", "node_id"], "left_anti")
    out = _errors(none, 0, F.col("node_id"), _say("Activity has no prov:wasAssociatedWith agent: %s", "node_id"))
    wrong = assoc.join(acts, ["doc_id", "node_id"], "left_semi").join(agents, ["doc_id", "dst"], "left_anti").distinct()
    return out.unionByName(_errors(wrong, 1, F.concat_ws("|", "node_id", "dst"), _say("Value of prov:wasAssociatedWith is not a prov:Agent: %s -> %s", "node_id", "dst")))


def _element_rows(i: int, kind: str, error: Callable, parsed: bool) -> list[Column]:
    """Arrays of errors of the nodes of a kind."""
    say = lambda text: lambda n: error(3, F.concat_ws("|", F.lit(str(i)), n["node_id"]), F.concat(F.lit(f"{kind} '"), n["node_id"], F.lit(f"' {text}")))
    untyped = say("missing prov:type")
    if not parsed:
        return [F.transform(F.filter(kind, lambda n: n["ptype"].isNull()), untyped)]
    broken, typeless = F.filter(kind, lambda n: ~n["is_object"]), F.filter(kind, lambda n: n["is_object"] & ~n["has_type"])
    return [F.transform(broken, say("attributes not an object")), F.transform(typeless, untyped)]


def _relation_rows(i: int, rel: str, error: Callable, parsed: bool) -> Callable[[Column], Column]:
    """From an edge to the array of its errors, with nulls for what is right."""
    a, b, kind_a, kind_b, _ = RELATIONS[rel]

    def errors(e: Column) -> Column:
        begin = F.concat(F.lit(f"{rel} '"), e["edge_id"], F.lit("' "))
        order = F.concat_ws("|", F.lit(str(i)), F.format_string("%06d", F.length(e["edge_id"])), e["edge_id"])

        def end(side: int, name: str, key: str, kind: str) -> Column:
            ref, text = e[name], e[f"{name}_text"] if parsed else F.lit(True)
            other = F.when(ref == "true", "True").when(ref == "false", "False").otherwise(ref)
            shown = F.when(text, repr_text(ref)).otherwise(other)
            lost = F.coalesce(F.array_contains(f"lost_{kind}", ref), F.lit(False)) | ~text
            said = F.when(ref.isNull(), F.concat(begin, F.lit(f"missing {key}"))).when(lost, F.concat(begin, F.lit(f"{key}="), shown, F.lit(f" not a declared {kind}")))
            return F.when(said.isNotNull(), error(4, F.concat(order, F.lit(f"|{side}")), said))

        ends = F.array(end(0, "src", a, kind_a), end(1, "dst", b, kind_b))
        return F.when(e["is_object"], ends).otherwise(F.array(error(4, order, F.concat(begin, F.lit("not an object"))))) if parsed else ends

    return errors


def _suspect(rel: str, parsed: bool) -> Callable[[Column], Column]:
    """Whether an edge may have an error."""
    *_, kind_a, kind_b, _ = RELATIONS[rel]

    def test(e: Column) -> Column:
        found = F.lit(False)
        for name, kind in (("src", kind_a), ("dst", kind_b)):
            found = found | e[name].isNull() | F.coalesce(F.array_contains(f"lost_{kind}", e[name]), F.lit(False))
        return found | ~(e["is_object"] & e["src_text"] & e["dst_text"]) if parsed else found

    return test


def row_errors(docs: DataFrame, cardinality: bool = True, folds: int = 5, parsed: bool = False) -> DataFrame:
    """``docs`` with two more columns, ``schema`` and ``shacl``: the errors (stage, item, message) of the same rules over whole
    documents as rows (an array of nodes for each kind, one of edges for each relation: ``generate.run_documents``, or
    with parsed ``documents.with_rows``, whose malformed blocks are errors too). Sets of ids are compared within a row; nothing is shuffled, and messages
    are only made where the sets differ."""
    c, of = F.col, lambda names: [c(n) for n in names]
    error = lambda stage, item, message: F.struct(F.lit(stage).alias("stage"), item.alias("item"), message.alias("message"))
    none = F.array().cast("array<struct<stage: int, item: string, message: string>>")
    unless = lambda good, errors: F.when(good, none).otherwise(errors)
    ids = {k: c(k)["node_id"] for k in KINDS}
    refs: dict[str, list[Column]] = {k: [] for k in KINDS}
    for rel, (_, _, a, b, _) in RELATIONS.items():
        refs[a].append(c(rel)["src"])
        refs[b].append(c(rel)["dst"])
    objects = (lambda block: F.filter(block, lambda e: e["is_object"])) if parsed else (lambda block: block)
    agents, acts = F.array_compact(objects(c("agent"))["node_id"]), F.array_distinct(objects(c("activity"))["node_id"])
    added = {f"lost_{k}": F.array_except(F.concat(*refs[k]), F.array_compact(ids[k])) for k in KINDS}
    added |= {
        "lonely": F.array_except(acts, F.array_compact(objects(c("wasAssociatedWith"))["src"])),
        "wrong": F.array_except(objects(c("wasAssociatedWith"))["dst"], agents),
    }
    found = docs.withColumns(added)

    said = [block_errors()] if parsed else []
    said += [x for i, k in enumerate(KINDS) for x in _element_rows(i + 1, k, error, parsed)]
    for i, (rel, (*_, kind_a, kind_b, _)) in enumerate(RELATIONS.items()):
        good = (F.size(f"lost_{kind_a}") == 0) & (F.size(f"lost_{kind_b}") == 0)
        if parsed:
            good &= ~F.exists(rel, lambda e: ~(e["is_object"] & e["src_text"] & e["dst_text"]))
        suspects = F.filter(rel, _suspect(rel, parsed))
        said.append(unless(good, F.array_compact(F.flatten(F.transform(suspects, _relation_rows(i + 1, rel, error, parsed))))))
    alone = F.transform("lonely", lambda n: error(0, n, _say("Activity has no prov:wasAssociatedWith agent: %s", n)))
    not_agent = lambda e: F.coalesce(F.array_contains(acts, e["src"]), F.lit(False)) & ~F.coalesce(F.array_contains(agents, e["dst"]), F.lit(False))
    pairs = F.array_distinct(F.transform(F.filter(objects(c("wasAssociatedWith")), not_agent), lambda e: F.struct(e["src"], e["dst"])))
    to = lambda e: error(1, F.concat_ws("|", e["src"], e["dst"]), _say("Value of prov:wasAssociatedWith is not a prov:Agent: %s -> %s", e["src"], e["dst"]))
    shacl = F.concat(alone, unless(F.size("wrong") == 0, F.transform(pairs, to)))
    found = found.select(*of(docs.columns), F.concat(*said).alias("said"), shacl.alias("shacl"))

    if cardinality:
        size = {k: F.size(F.array_distinct(ids[k])) for k in KINDS}
        got = {"nodes": sum(size.values(), F.lit(0)), "edges": sum((F.size(r) for r in RELATIONS), F.lit(0))} | dict(zip(("entities", "activities", "agents"), size.values(), strict=True))
        tests = [F.when(got[k] != w, error(5, F.lit(str(i)), F.concat(F.lit(f"{k}="), got[k].cast("string"), F.lit(f", expected {w}")))) for i, (k, w) in enumerate(expected_counts(folds).items())]
        schema = F.when(F.size("said") == 0, F.array_compact(F.array(*tests))).otherwise(F.col("said"))
    else:
        schema = F.col("said")
    return found.select(*of(docs.columns), schema.alias("schema"), "shacl")


def block_errors() -> Column:
    """What isn't an object at all, lacks a prefix, or has a block of the wrong kind, of rows of ``documents.with_rows``."""
    error = lambda stage, item, text: F.struct(F.lit(stage).alias("stage"), item.cast("string").alias("item"), text.alias("message"))
    lost = F.array_compact(F.array(*[F.when(~F.map_contains_key("prefix", n), error(1, F.lit(i), F.lit(f"missing required prefix '{n}'"))) for i, n in enumerate(REQUIRED_PREFIXES)]))
    prefixes = F.when(F.col("prefix").isNull(), F.array(error(1, F.lit(0), F.lit("missing or malformed 'prefix' block")))).otherwise(lost)
    names = F.array(*map(F.lit, KINDS)), F.array(*map(F.lit, RELATIONS))
    number = lambda e: [(F.array_position(n, e["block"]) - 1).cast("int") for n in names]

    def malformed(e: Column) -> Column:
        kind, rel = number(e)
        missing = error(2, kind, F.concat(F.lit("missing or malformed '"), e["block"], F.lit("' block")))
        wrong = error(4, rel + 1, F.concat(F.lit("relation block '"), e["block"], F.lit("' not an object")))
        return F.when(kind >= 0, missing).when(e["there"], wrong)

    none = F.array(error(0, F.lit(""), F.lit("document is not a JSON object")))
    return F.when(F.col("is_object"), F.concat(prefixes, F.array_compact(F.transform("lacking", malformed)))).otherwise(none)


def round_trip_diff(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, only_first, only_second: statements that differ after tables -> JSON -> tables, as multisets. Each document
    is compared as a row: the statements are shuffled once, with the document's own parts."""
    first = F.sort_array(F.collect_list("statement")).alias("first")
    return _again(D.grouped(D.statements(nodes, edges), first)).select("doc_id", "only_first", "only_second")


def round_trip_rows(docs: DataFrame) -> DataFrame:
    """``docs``, whole documents as rows whose nodes have attributes, with only_first and only_second of ``round_trip_diff``: rows -> JSON -> rows,
    without a shuffle. Literals are only put into one form where their texts differ as they are."""

    def said(form: Callable[[Column], Column]) -> Column:
        node = lambda k: lambda n: F.concat_ws("\x1f", F.lit(k), n["node_id"], F.to_json(form(n["attrs"])))
        edge = lambda r: lambda e: F.concat_ws("\x1f", F.lit(r), e["src"], e["dst"], F.coalesce(e["role"], F.lit("")))
        parts = [F.transform(k, node(k)) for k in KINDS] + [F.transform(r, edge(r)) for r in RELATIONS]
        return F.sort_array(F.concat(*parts))

    plain = said(lambda m: F.map_from_entries(F.sort_array(F.map_entries(m))))
    found = D.with_json(docs).withColumn("plain", plain)
    return _again(found, F.when(F.col("plain") == F.col("second"), F.col("plain")).otherwise(said(D.canonical))).select(*docs.columns, "only_first", "only_second")


def _again(docs: DataFrame, first: Column | None = None) -> DataFrame:
    """``docs`` with only_first and only_second: their statements (a sorted array ``first``) against those of their ``json``."""
    attrs = lambda m: F.to_json(F.map_from_entries(F.sort_array(F.map_entries(F.transform_values(m, lambda _, x: D.literal(x))))))
    parsed = docs.withColumn("doc", F.try_parse_json("json"))
    none = F.array().cast("array<string>")
    again = []
    for b in KINDS:
        inside = F.map_entries(F.try_variant_get("doc", f"$['{b}']", "map<string,map<string,variant>>"))
        again.append(F.coalesce(F.transform(inside, lambda e: F.concat_ws("\x1f", F.lit(b), e["key"], attrs(e["value"]))), none))
    for r, (x, y, *_) in RELATIONS.items():
        inside = F.map_values(F.try_variant_get("doc", f"$['{r}']", f"map<string,struct<`{x}`:string,`{y}`:string,`prov:role`:string>>"))
        again.append(F.coalesce(F.transform(inside, lambda m: F.concat_ws("\x1f", F.lit(r), m[x], m[y], F.coalesce(m["prov:role"], F.lit("")))), none))
    both = parsed.withColumn("second", F.sort_array(F.concat(*again)))
    if first is not None:
        both = both.withColumn("first", first)
    numbered = lambda c: F.transform(c, lambda x, i: F.concat_ws("\x1f", x, (i - F.array_position(F.col(c), x)).cast("string")))
    lost = lambda a, b: F.when(F.col("first") == F.col("second"), 0).otherwise(F.size(F.array_except(numbered(a), numbered(b)))).cast("long")
    return both.select("*", lost("first", "second").alias("only_first"), lost("second", "first").alias("only_second"))


def round_trip_errors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    bad = round_trip_diff(nodes, edges).where("only_first > 0 or only_second > 0")
    return _errors(bad, 0, F.lit(""), _say("RDF graphs not isomorphic: +%d/-%d triples", "only_first", "only_second"))


def validate(documents: DataFrame, checks: Sequence[str] = CHECKS, cardinality: bool = True, folds: int = 5) -> DataFrame:
    """doc_id, valid, checks (array of name, status, errors), summary: an outcome for each document (doc_id, json); doc_id is
    unique and not null.

    All wanted checks run whatever the others say. A document that can't be read as a graph has no statements
    that the later checks could reject. summary has the first three messages of each failed check, or 'ok'.
    """
    docs = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "json")
    names = check_names(checks)
    found = row_errors(D.with_rows(D.parse(docs), "round_trip" in names), cardinality, folds, parsed=True)
    if "round_trip" in names:
        found = found.withColumns({b: F.filter(b, lambda e: e["is_object"]) for b in (*KINDS, *RELATIONS)})
        found = round_trip_rows(found)
        differs = (F.col("only_first") > 0) | (F.col("only_second") > 0)
        said = _say("RDF graphs not isomorphic: +%d/-%d triples", "only_first", "only_second")
        one = F.struct(F.lit(0).alias("stage"), F.lit("").alias("item"), said.alias("message"))
        found = found.withColumn("round_trip", F.array_compact(F.array(F.when(differs, one))))
    sort = lambda name: F.transform(F.sort_array(name), lambda e: e["message"])
    cut = lambda name, own: F.slice(own, 1, SHACL_MESSAGES) if name == "shacl" else own
    found = found.select("doc_id", *[cut(name, sort(name)).alias(name) for name in names])
    good, results, texts = F.lit(True), [], []
    for name in names:
        failed = F.size(name) > 0
        good &= ~failed
        results.append(F.struct(F.lit(name).alias("name"), F.when(failed, "fail").otherwise("pass").alias("status"), F.col(name).alias("errors")))
        texts.append(F.when(failed, F.concat(F.lit(f"{name}: "), F.array_join(F.slice(name, 1, 3), "; "))))
    empty = F.array().cast("array<struct<name: string, status: string, errors: array<string>>>")
    return found.select("doc_id", good.alias("valid"), (F.array(*results) if results else empty).alias("checks"), F.when(good, "ok").otherwise(F.concat_ws(" | ", *texts)).alias("summary"))


def gate(documents: DataFrame, outcomes: DataFrame, policy: str = "strict") -> DataFrame:
    """The documents that may be written: strict leaves failing ones out, warn lets them pass, abort raises."""
    if policy not in POLICIES:
        raise ValueError(f"Unknown policy: {policy}")
    if policy == "warn":
        return documents
    failing = outcomes.where("not valid")
    if policy == "abort":
        first = failing.orderBy("doc_id").select("doc_id", "summary").first()
        if first:
            raise RuntimeError(f"Validation failed for {first['doc_id']} ({first['summary']}); aborting (policy='abort').")
    return documents.join(failing.select("doc_id"), "doc_id", "left_anti")


def check_counts(outcomes: DataFrame) -> DataFrame:
    """name, status, n."""
    return outcomes.select(F.inline("checks")).groupBy("name", "status").agg(F.count("*").alias("n"))


def report(outcomes: DataFrame, policy: str, checks: Sequence[str]) -> dict:
    """The conformance report; at most 200 failures, by id."""
    t = outcomes.agg(F.count("*").alias("n"), F.count_if("valid").alias("ok")).first()
    counts = {(r["name"], r["status"]): r["n"] for r in check_counts(outcomes).collect()}  # a few rows
    failures = outcomes.where("not valid").orderBy("doc_id").select("doc_id", "summary").limit(MAX_FAILURES).collect()
    by = lambda status: {n: counts[n, status] for n in check_names(checks) if (n, status) in counts}
    return {
        "enabled": True, "checks": list(check_names(checks)), "policy": policy, "documents_validated": t["n"], "documents_passed": t["ok"],
        "documents_failed": t["n"] - t["ok"], "documents_skipped_write": t["n"] - t["ok"] if policy == "strict" else 0,
        "check_pass_counts": by("pass"), "check_fail_counts": by("fail"), "check_skip_counts": by("skipped"),
        "failures": [{"path": r["doc_id"], "summary": r["summary"]} for r in failures],
    }
